"""Byte-level BPE by corpus-level merge replay.

1. Texts are split into pieces; each batch of texts sends its distinct pieces to the dictionary, which is dealt into
   parts by a hash of the piece. So each distinct piece of the corpus is in one part, however often it occurs.
2. A part lists its distinct pieces once. An inverted index leads from each mergeable pair (by the rank of its bytes) to
   the places where it stands in that list. Merges are applied in rank order, each to all its places, and only the two
   neighbours of a merged place are indexed anew. Every batch gets the ids of its pieces back.
3. Batches meet their answers and are put together by looking pieces up.

What moves is a batch's distinct pieces, their ids, and texts as numbers of pieces; no part or batch depends on how
often a piece, text or source occurs. A batch sends one row to each part that holds a piece of its own, so rows are at most the
batches' distinct pieces: beyond so many parts they grow with the corpus, not with its square.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from heapq import heappop, heappush
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, slices, stored, table, unpack

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BATCH_CHARS, BATCH_DOCS, PART_DOCS = 8_000_000, 16_384, 20_000
SIMPLE = 0x24F  # texts up to this code point are split by a pattern of plain classes


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def newer_letters() -> str:
    """A class of the code points that Python's regex takes for letters, numbers or spaces and tiktoken doesn't.

    The two libraries follow different editions of Unicode; tiktoken's is the one that counts.
    """
    import regex
    import tiktoken

    every = "".join(chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000)
    own = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}\s]+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    theirs = set(bytes(own.encode_ordinary(every)).decode())
    odd = [ord(c) for c in regex.findall(r"[\p{L}\p{N}\s]", every) if c not in theirs]
    runs: list[list[int]] = []
    for x in odd:
        if runs and runs[-1][1] == x - 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]" if runs else r"(?!)"


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each word, as merging its lowest-ranked adjacent pair (the leftmost of equals) again and again gives."""
    texts = _texts(ranks)
    single = [ranks[bytes([b])] for b in range(256)]
    merged: dict[tuple[int, int], int] = {}  # ranks of pairs of ids, -1 for none: as many as the vocabulary allows
    ids: list[int] = []
    after: list[int] = []
    before: list[int] = []
    places: dict[int, list[int]] = {}
    heap: list[int] = []
    starts = []

    def rank_of(a: int, b: int) -> int:
        r = merged.get((a, b))
        if r is None:
            r = merged[a, b] = ranks.get(texts[a] + texts[b], -1)
        return r

    def index(r: int, at: int) -> None:
        found = places.get(r)
        if found is None:
            places[r] = [at]
            heappush(heap, r)
        else:
            found.append(at)

    for w in words:
        whole = ranks.get(w)
        first = len(ids)
        starts.append(first)
        ids += [whole] if whole is not None else [single[b] for b in w]
        n = len(ids) - first
        before += [-1, *range(first, first + n - 1)] if n else []
        after += [*range(first + 1, first + n), -1] if n else []
        for at in range(first, first + n - 1):
            r = rank_of(ids[at], ids[at + 1])
            if r >= 0:
                index(r, at)
    starts.append(len(ids))
    while heap:
        r = heappop(heap)
        wait = -1  # places before this one wait: their word has a pair of lower rank now
        for at in sorted(places.pop(r)):
            if at < wait:
                index(r, at)
                continue
            b = after[at]
            if b < 0 or ids[at] < 0 or rank_of(ids[at], ids[b]) != r:
                continue  # a neighbour's merge took part of this pair
            ids[at], ids[b] = r, -1
            c, a = after[b], before[at]
            after[at] = c
            s = t = r
            if c >= 0:
                before[c] = at
                s = rank_of(r, ids[c])
                if s >= 0:
                    index(s, at)
            if a >= 0:
                t = rank_of(ids[a], r)
                if t >= 0:
                    index(t, a)
            if 0 <= s < r or 0 <= t < r:
                wait = starts[bisect_right(starts, at)]
    return [[i for i in ids[s:e] if i >= 0] for s, e in zip(starts, starts[1:])]


_known: dict[int, tuple[dict, list]] = {}


def _texts(ranks: dict[bytes, int]) -> list[bytes]:
    got = _known.get(id(ranks))
    if got is None or got[0] is not ranks:
        texts = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            texts[r] = t
        _known.clear()
        got = _known[id(ranks)] = (ranks, texts)
    return got[1]


def plain_pattern(pattern: str, odd: str) -> str | None:
    """pattern with its classes written out for code points up to SIMPLE, for Python's own engine; None if it has other
    escapes than these."""
    import re

    import regex

    every = "".join(map(chr, range(SIMPLE + 1)))
    out, inside, at = "", False, 0
    while at < len(pattern):
        name = re.match(r"\\[pP]\{[LN]\}|\\[sS]", pattern[at:])
        if name:
            negated = name.group()[1].isupper()
            own = [x for x in regex.findall(f"\\{name.group()[1].lower()}{name.group()[2:]}", every) if not re.match(odd, x)]
            if negated and inside:
                return None
            members = "".join(f"\\u{ord(x):04x}" for x in own)
            out += members if inside else f"[{'^' * negated}{members}]"
            at += len(name.group())
            continue
        if pattern[at] == "\\" or pattern[at : at + 2] == "(?" and pattern[at : at + 3] not in ("(?!", "(?=", "(?:"):
            return None
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out += pattern[at]
        at += 1
    return out


class Splitter:
    """Texts to pieces, by the classes of tiktoken's edition of Unicode."""

    def __init__(self, pattern: str, odd: str = r"(?!)"):
        import re

        import regex

        plain = plain_pattern(pattern, odd)
        self.pattern, self.odd, self.plain = regex.compile(pattern), re.compile(odd), plain and re.compile(plain)
        self.beyond = re.compile(f"[^\\0-\\u{SIMPLE:04x}]")

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.plain and not self.beyond.search(text):
            return [m.group() for m in self.plain.finditer(text)]
        if not self.odd.search(text):
            return [m.group() for m in self.pattern.finditer(text)]
        # A private code point is neither letter, number nor space in any edition.
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.odd.sub("\ue000", text))]


class Numbers(dict):
    """Pieces and their numbers, given as they come."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


def write_pieces(pieces: list[bytes]) -> bytes:
    sizes = np.array(list(map(len, pieces)), np.uint32)
    return len(head := pack(sizes)).to_bytes(8, "little") + head + pack(np.frombuffer(b"".join(pieces), np.uint8))


def read_pieces(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    ends = np.cumsum(unpack(data[8 : 8 + n], np.uint32), dtype=np.int64).tolist()
    text = unpack(data[8 + n :], np.uint8).tobytes()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each place, joined."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(starts - (ends - sizes), sizes)
    return values[at]


class Speller:
    """Ids to the bytes they stand for."""

    def __init__(self, ranks: dict[bytes, int]):
        texts = _texts(ranks)
        self.sizes = np.array(list(map(len, texts)), np.int64)
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(texts), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return gathered(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()


OWN = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
ROW = "batch long, kind int, part int, pieces binary, ids binary, sizes binary, rest binary"


def encoded(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", part_docs: int = PART_DOCS) -> DataFrame:
    """df without its text, with n_tokens, ids (little-endian 32-bit integers), ids_sha256 and decoded_sha256.

    Every row is kept; null counts as the empty text, which has no ids; very long texts are encoded whole, in a batch of
    their own. Repeated rows are encoded each. Clashing columns are replaced; an empty table gives none. The ranks go to
    executors as one broadcast (about a megabyte, fixed by the vocabulary).
    """
    from pyspark.sql import types as T

    df = df.drop(*OWN)
    spark, keep = df.sparkSession, [f for f in df.schema.fields if f.name != text]
    told = spark.sparkContext.broadcast((ranks, pattern, newer_letters()))
    parts = max(8, -(-df.count() // part_docs))

    def batches(rows):
        """(number, rows as an Arrow table, pieces of each text) of runs of rows of one partition."""
        import pyarrow as pa
        from pyspark import TaskContext

        split, number = Splitter(*told.value[1:]), TaskContext.get().partitionId() << 32
        held, pieces, chars = [], [], 0
        for big in rows:
            for b in slices(big, text):
                held.append(b)
                for t in b.column(text).to_pylist():
                    pieces.append(split(t))
                    chars += len(t or "")
                if chars >= BATCH_CHARS or len(pieces) >= BATCH_DOCS:
                    yield number, pa.Table.from_batches(held), pieces
                    number, held, pieces, chars = number + 1, [], [], 0
        if pieces:
            yield number, pa.Table.from_batches(held), pieces

    def dealt(pieces: list[bytes], order=None) -> dict[int, list[int]]:
        """Places of pieces by part of the dictionary, in order."""
        out: dict[int, list[int]] = {}
        for k in range(len(pieces)) if order is None else order:
            out.setdefault(crc32(pieces[k]) % parts, []).append(k)
        return out

    def row(batch, kind, part=0, pieces=None, ids=None, sizes=None, rest=None):
        return {"batch": batch, "kind": kind, "part": part, "pieces": pieces, "ids": ids, "sizes": sizes, "rest": rest}

    def schema():
        import pyarrow as pa

        return pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("pieces", "ids", "sizes", "rest"))])

    def ask(rows):
        import pyarrow as pa

        for number, _, pieces in batches(rows):
            distinct = sorted(p.encode("utf-8", "surrogatepass") for p in set(chain.from_iterable(pieces)))
            yield pa.RecordBatch.from_pylist([row(number, 1, i, write_pieces([distinct[k] for k in own])) for i, own in dealt(distinct).items()], schema())

    def answer(asked):
        import pyarrow as pa

        lists = [read_pieces(x) for x in asked.column("pieces").to_pylist()]
        words = sorted(set(chain.from_iterable(lists)))
        known = dict(zip(words, replay(words, told.value[0]), strict=True))
        out = []
        for number, part, packed, own in zip(asked.column("batch").to_pylist(), asked.column("part").to_pylist(), asked.column("pieces").to_pylist(), lists):
            ids = [known[p] for p in own]
            out.append(row(number, 1, part, crc32(packed).to_bytes(4, "little"), pack(np.array(list(chain.from_iterable(ids)), np.uint32)), pack(np.array(list(map(len, ids)), np.uint32))))
        return pa.Table.from_pylist(out, schema())

    def body(rows):
        import pyarrow as pa

        for number, whole, pieces in batches(rows):
            numbers = Numbers()
            tokens = np.array([numbers[p] for p in chain.from_iterable(pieces)], np.int32)
            order = np.argsort(-np.bincount(tokens, minlength=len(numbers)), kind="stable").astype(np.int32)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order), dtype=np.int32)  # small numbers for frequent pieces
            listed = [p.encode("utf-8", "surrogatepass") for p in numbers]
            sink = pa.BufferOutputStream()
            rest = whole.drop_columns([text]).combine_chunks()
            with pa.ipc.new_stream(sink, rest.schema) as out:
                out.write_table(rest)
            made = row(number, 0, 0, write_pieces([listed[i] for i in order.tolist()]), pack(rank[tokens]), pack(np.array(list(map(len, pieces)), np.int64)), pa.compress(sink.getvalue(), "zstd", asbytes=True))
            yield pa.RecordBatch.from_pylist([made | {"part": sink.getvalue().size}], schema())

    def finish(rows):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema_out = to_arrow_schema(out)
        ranks, spell = told.value[0], Speller(told.value[0])
        rows = rows.to_pylist()
        own = next((r for r in rows if not r["kind"]), None)
        if own is None:
            return schema_out.empty_table()  # answers for a batch that was split otherwise when it was read again
        pieces = read_pieces(own["pieces"])
        places = dealt(pieces, sorted(range(len(pieces)), key=pieces.__getitem__))  # as the batch asked for them
        starts, sizes, flat, end = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [np.zeros(0, np.uint32)], 0

        def tell(where, each, ids):
            nonlocal end
            sizes[where], starts[where] = each, end + np.cumsum(each) - each
            flat.append(ids)
            end += len(ids)

        for r in (r for r in rows if r["kind"]):
            where = places.get(r["part"], [])
            if crc32(write_pieces([pieces[k] for k in where])).to_bytes(4, "little") == r["pieces"]:
                tell(places.pop(r["part"]), unpack(r["sizes"], np.uint32).astype(np.int64), unpack(r["ids"], np.uint32))
        if lost := list(chain.from_iterable(places.values())):  # only if a batch came out otherwise when it was made again
            each = replay([pieces[k] for k in lost], ranks)
            tell(lost, np.array(list(map(len, each)), np.int64), np.array(list(chain.from_iterable(each)), np.uint32))
        flat = np.concatenate(flat)
        tokens, at, columns = unpack(own["ids"], np.int32), 0, ([], [], [], [])
        for n in unpack(own["sizes"], np.int64).tolist():
            mine = tokens[at : at + n]
            at += n
            ids = gathered(flat, starts[mine], sizes[mine])
            raw = ids.astype("<u4").tobytes()
            for c, x in zip(columns, (len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256(spell(ids)).hexdigest()), strict=True):
                c.append(x)
        rest = pa.ipc.open_stream(pa.decompress(own["rest"], own["part"], "zstd")).read_all()
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.string())
        for name, c, kind in zip(OWN, columns, kinds, strict=True):
            rest = rest.append_column(name, pa.array(c, kind))
        return rest

    kinds = [T.LongType(), T.BinaryType(), T.StringType(), T.StringType()]
    out = T.StructType([*keep, *(T.StructField(n, k) for n, k in zip(OWN, kinds, strict=True))])
    answers = stored(df.select(text).mapInArrow(ask, ROW).groupBy("part").applyInArrow(answer, ROW))
    return df.mapInArrow(body, ROW).unionByName(answers).groupBy("batch").applyInArrow(finish, out)


def decoded(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """df without its ids, with the bytes they stand for as `decoded`; null ids give null."""
    from pyspark.sql import types as T

    df = df.drop("decoded")
    told = df.sparkSession.sparkContext.broadcast(ranks)
    keep = [f for f in df.schema.fields if f.name != ids]

    def decode(batches):
        import pyarrow as pa

        spell = Speller(told.value)
        for b in batches:
            got = [None if x is None else spell(np.frombuffer(x, "<u4")) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(got, pa.binary())], [*(f.name for f in keep), "decoded"])

    return df.mapInArrow(decode, T.StructType([*keep, T.StructField("decoded", T.BinaryType())]))


def op4_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encoded(docs, read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    return out.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")


QUERIES = {"op4_bpe": op4_bpe}
SQL: dict[str, str] = {}
