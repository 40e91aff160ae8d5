"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which of their ids meet.

1. Both tokenizers' tokens are laid over the same bytes, a space and the text. A label string says for each byte whether
   no token ends there, one of A, one of B, or one of both. A regex cuts the string after each both-label: each span is a
   group, and its labels tell how many tokens of either side it holds.
2. Wherever a token ends, one token of A and one of B overlap that no earlier end has paired: so each end is a link, and
   there are as many links as ends, never tokens times tokens.
3. How many documents hold an id pair is one aggregate over the documents' distinct pairs, summed up before it is shuffled.
   The table of pairs goes back to the documents as a broadcast while it is small, else by a plain join; sums for each
   document are again made before the shuffle. An A id has at most as many partners as B has ids.

Texts are tokenised once; what is stored between the steps is each document's distinct pairs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import gathered
from .common import slices, stored, table

A, RANKS, B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
SLICE = 1 << 20  # bytes of texts that are tokenised together
BROADCAST_PAIRS = 500_000  # 16 MB or so; only the plan depends on it, not the result

OWN = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
SPAN = re.compile(rb"[^\x03]*\x03")


@dataclass(frozen=True)
class Files:
    """What the tokenizers are made of, a few megabytes fixed by their vocabularies."""

    a: str  # JSON of the byte-level one
    ranks: dict  # the same vocabulary as ranks
    pattern: str
    b: bytes  # the model of the piece-wise one
    odd: str  # a class of the code points that the two libraries of A may see differently

    @classmethod
    def read(cls, a: str, ranks: str, pattern: str, b: str) -> "Files":
        with open(a, encoding="utf-8") as f, open(ranks, "rb") as g, open(b, "rb") as h:
            return cls(f.read(), {base64.b64decode(t): int(r) for t, r in map(bytes.split, g)}, pattern, h.read(), unlike_letters())


def unlike_letters() -> str:
    """A class of the code points that `tokenizers` and tiktoken don't put in the same one of letters, numbers, spaces and others."""
    import tiktoken
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000)
    odd: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        one = tiktoken.Encoding("classes", pat_str=f"{kind}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs = pre_tokenizers.Split(Regex(f"{kind}+"), "removed", invert=True).pre_tokenize_str(every)
        odd |= set(bytes(one.encode_ordinary(every)).decode()) ^ set("".join(t for t, _ in theirs))
    return "[" + "".join(f"\\U{ord(x):08x}" for x in sorted(odd)) + "]" if odd else r"(?!)"


def byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones of Latin-1 stand for themselves, the
    others follow from U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in itself} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(itself)))}


class Spelt:
    """The bytes of each id of a vocabulary."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array(list(map(len, texts)), np.int64)
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(texts), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return gathered(self.data, self.starts[ids], self.sizes[ids]).tobytes()


class Both:
    """The two tokenizers, as a task holds them."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken

        self.files, self.slow = files, None
        self.fast = tiktoken.Encoding("a", pat_str=files.pattern, mergeable_ranks=files.ranks, special_tokens={})
        self.unlike = re.compile(files.odd)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        n, piece = self.pieces.get_piece_size(), self.pieces.id_to_piece
        self.b = Spelt([bytes([int(piece(i)[3:-1], 16)]) if self.pieces.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)])
        size = max(files.ranks.values()) + 1
        texts = [b""] * size
        for t, r in files.ranks.items():
            texts[r] = t
        self.a = Spelt(texts)

    def encode_a(self, text: str) -> np.ndarray:
        """By the fast library, where both agree for sure, else by the one that the JSON is made for."""
        if not self.unlike.search(text):
            return np.array(self.fast.encode_ordinary(text), np.int64)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.files.a)
            self.slow.encode_special_tokens = True
            levels = byte_level()
            longest = max(self.slow.get_vocab().values()) + 1
            entries = map(self.slow.id_to_token, range(longest))
            self.a = Spelt([bytes(levels[c] for c in t) if t and set(t) <= set(levels) else b"" for t in entries])
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.pieces.encode(texts, num_threads=1)] if texts else []


class Printed:
    """Ids in decimal, followed by what parts them."""

    MARKS = b",|;"

    def __init__(self, ids: int):
        self.ids, self.words = ids, Spelt([b"%d%c" % (i, m) for m in self.MARKS for i in range(ids)])

    def __call__(self, ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all, and of how many each id is."""
        at = marks * self.ids + ids
        return gathered(self.words.data, self.words.starts[at], self.words.sizes[at]), self.words.sizes[at]


def labelled(size: int, a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each byte: 0 where no token ends, 1 one of A, 2 one of B, 3 both."""
    labels = np.zeros(size, np.uint8)
    labels[a_ends - 1] |= 1
    labels[b_ends - 1] |= 2
    return labels


def met(a: list[np.ndarray], b: list[np.ndarray], spelt_a: Spelt, spelt_b: Spelt, printed: Printed | None):
    """Of texts' tokens, where each text's tokens of A and B have the same bytes: numbers of groups and of links of each
    text, the groups as bytes of each text, and the distinct pairs: text, key (A id times B's ids, plus B id), times."""
    ids_a, ids_b = np.concatenate(a), np.concatenate(b)
    ends_a, ends_b = np.cumsum(spelt_a.sizes[ids_a]), np.cumsum(spelt_b.sizes[ids_b])
    count_a, count_b = np.cumsum(list(map(len, a))), np.cumsum(list(map(len, b)))
    text_ends = ends_a[count_a - 1]
    labels = labelled(int(ends_a[-1]), ends_a, ends_b)
    cut = np.cumsum(np.fromiter(map(len, SPAN.findall(labels.tobytes())), np.int64))  # where groups end
    at = np.flatnonzero(labels)
    told = labels[at].astype(np.int64)
    i, j = np.cumsum(told & 1) - (told & 1), np.cumsum(told >> 1) - (told >> 1)
    links = np.diff(np.searchsorted(at, text_ends), prepend=0)
    groups = np.diff(np.searchsorted(cut, text_ends, "right"), prepend=0)
    width, n_b = len(spelt_a.sizes) * len(spelt_b.sizes), len(spelt_b.sizes)
    every, times = np.unique(np.repeat(np.arange(len(a)), links) * width + ids_a[i] * n_b + ids_b[j], return_counts=True)
    texts = []
    if printed:
        # Tokens in the order of print: for each group A's, then B's.
        upto_a, upto_b = np.searchsorted(ends_a, cut, "right"), np.searchsorted(ends_b, cut, "right")
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], upto_b])[np.searchsorted(cut, ends_a)]
        place_b = np.arange(len(ids_b)) + upto_a[np.searchsorted(cut, ends_b)]
        ids, marks = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.int64)
        ids[place_a], ids[place_b] = ids_a, ids_b
        marks[place_a], marks[place_b] = np.where(labels[ends_a - 1] == 3, 1, 0), np.where(labels[ends_b - 1] == 3, 2, 0)
        data, sizes = printed(ids, marks)
        ends = np.cumsum(sizes)[count_a + count_b - 1].tolist()
        whole = data.tobytes()
        texts = [whole[s : e - 1] for s, e in zip([0, *ends], ends)]
    return groups, links, texts, every // width, every % width, times


def tokenised(df: DataFrame, files: Files, text: str = "text", keep: Callable[[bytes], str] | None = bytes.decode) -> DataFrame:
    """df without its text, with n_a, n_b, n_groups, n_links, groups, pairs and times.

    groups is each document's `a1,a2|b1;a3|b2,b3` in decimal ids, or what `keep` makes of its bytes (it may be long), or
    empty if keep is None. pairs are the distinct linked id pairs, as the A id times the number of B's ids plus the B id, times
    how often each is linked. Null and empty texts, and those whose tokens' bytes aren't a space and the text, have no tokens:
    zeros, an empty text and empty lists. Texts of any length are tokenised whole, in slices bounded by bytes.
    """
    from pyspark.sql import types as T

    df = df.drop(*OWN, "pairs", "times")
    rest = [f for f in df.schema.fields if f.name != text]
    told = df.sparkSession.sparkContext.broadcast(files)

    def make(batches):
        import pyarrow as pa

        both = Both(told.value)
        printed = Printed(max(len(both.a.sizes), len(both.b.sizes), len(told.value.ranks) + 1)) if keep else None
        for one in (x for big in batches for x in slices(big, text, SLICE)):
            texts = [t or "" for t in one.column(text).to_pylist()]
            some = [k for k, t in enumerate(texts) if t]
            ids_a, ids_b, held = [], [], []
            for k, b in zip(some, both.encode_b([texts[k] for k in some])):
                a, whole = both.encode_a(" " + texts[k]), b" " + texts[k].encode("utf-8", "surrogatepass")
                if both.a(a) == whole and both.b(b) == whole:
                    held.append(k)
                    ids_a.append(a)
                    ids_b.append(b)
            n = len(texts)
            counts, groups = np.zeros((4, n), np.int64), [""] * n
            of, keys, times = (np.zeros(0, np.int64),) * 3
            if held:
                counts[0, held], counts[1, held] = list(map(len, ids_a)), list(map(len, ids_b))
                counts[2, held], counts[3, held], printed_texts, of, keys, times = met(ids_a, ids_b, both.a, both.b, printed)
                of = np.array(held)[of]
                for k, t in zip(held, printed_texts):
                    groups[k] = keep(t)
            offsets = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
            made = [*map(pa.array, counts), pa.array(groups, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(one.column(f.name) for f in rest), *made], [*(f.name for f in rest), *OWN[:5], "pairs", "times"])

    long = T.LongType()
    own = [*(T.StructField(c, long) for c in OWN[:4]), T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(long)), T.StructField("times", T.ArrayType(T.IntegerType()))]
    return df.mapInArrow(make, T.StructType([*rest, *own]))


def pair_counts(rows: DataFrame, b_ids: int, pairs: str = "pairs") -> DataFrame:
    """pair, n, best: how many rows hold each id pair, and whether no pair of its A id is held by more. An A id's pairs
    stand together: at most b_ids of them."""
    counts = rows.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_a = W.partitionBy(F.floor(F.col("pair") / b_ids))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def aligned(df: DataFrame, files: Files, text: str = "text", keep: Callable[[bytes], str] | None = bytes.decode) -> DataFrame:
    """df without its text, with the first five of OWN (see `tokenised`) and n_best and count_sum.

    An id pair's count is in how many documents (rows) of df it is linked. n_best is how many of a document's links have the
    highest count of their A id, ties included, count_sum the sum of its links' counts; both are 0 without links. Repeated rows
    and rows without ids are documents each; clashing columns are replaced; an empty table gives no rows."""
    import sentencepiece

    b_ids = sentencepiece.SentencePieceProcessor(model_proto=files.b).get_piece_size()
    row = "aligned_row"
    rows = stored(tokenised(df, files, text, keep).withColumn(row, F.monotonically_increasing_id()))
    counts = stored(pair_counts(rows, b_ids))
    few = counts.count() <= BROADCAST_PAIRS
    held = rows.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("one")).select(row, F.col("one.pairs").alias("pair"), F.col("one.times").alias("k"))
    held = held.join(F.broadcast(counts) if few else counts, "pair")
    sums = held.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, row, "left").drop(row)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op11_align(spark, sf_dir):
    import public_tokenizers as P

    files = Files.read(P.path(A), P.path(RANKS), P.PATTERN, P.path(B))
    out = aligned(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), files, keep=sha256)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {"op11_align": op11_align}
SQL: dict[str, str] = {}
