"""Document fingerprints by spot signatures: chains of content words that follow anchors (very common words).

A fingerprint is the set of a text's signatures, written as ascending 8-digit hex numbers. Likeness is the Jaccard
similarity of two sets. near_pairs() finds all pairs of different sets from a threshold: sets are partitioned by length so
that each can only match its own partition and the next; inverted lists in a partition hold the rarest signatures of
each set; what they bring together is compared, if lengths and the rest of the lists don't rule it out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, slices, stored, table

PART_ROWS, MOST_PARTS = 2000, 20_000

# Common words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be but by for from he in is it of on or that the this to was with
au aux ce dans des du elle en est et il la le les ne par pas pour qui que se sur un une
als auf aus das dem den der die ein eine für im ist mit nicht sich sie und von zu
al como con del el es lo los las más no para por su sus una y
"""


class AnchorHashes(WordHashes):
    """Hashes whose lowest bit tells anchors."""

    def __init__(self, anchors: set[bytes]):
        super().__init__()
        self.anchors = anchors

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh3_64_digest

        got = xxh3_64_digest(word)
        got = self[word] = bytes([got[0] & 254 | (word in self.anchors)]) + got[1:]
        return got


class Spots:
    """Text to an ascending array of 32-bit signatures. Remembers hashes of words, up to a fixed number.

    Words are what ASCII white space parts, A-Z lower-cased, without .,;:!?"'(). A signature is an anchor and the two
    next words that aren't anchors. A text without any has one signature of all its words; one without words none.
    """

    def __init__(self, anchors: str = ANCHORS):
        self.known = AnchorHashes({w.encode() for w in anchors.split()})

    def __call__(self, text: str) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        h = self.known.of(text.encode("utf-8", "surrogatepass").lower().translate(None, b".,;:!?\"'()").split())
        common = (h & np.uint64(1)).astype(bool)
        content = np.flatnonzero(~common)
        at = np.flatnonzero(common)
        first = np.searchsorted(content, at)
        ok = first + 1 < len(content)
        at, first = at[ok], first[ok]
        if not len(at):
            return np.array([xxh3_64_intdigest(h.tobytes()) >> 32], np.uint64) if len(h) else h
        s = h[at] * np.uint64(0x9E3779B97F4A7C15)
        for k in (0, 1):
            s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[content[first + k]]
        s = (s ^ (s >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return np.unique(s >> np.uint64(32))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets; 0 where their lengths rule out `least`. Two empty sets: 1."""
    short, long = sorted((len(a), len(b)))
    if not long:
        return 1.0
    if short < least * long or not short:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (short + long - both)


def written(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint64)


def with_next(df: DataFrame, key: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows dealt into ranges of key, each range with a copy of the first row of the next (the last: of the first).

    Adds part and guest (true for the copy, which comes last); each partition is ordered by part, guest, key. The
    driver sees one number for each range, at most MOST_PARTS. Null keys come first, as one range.
    """
    from pyspark.ml.feature import Bucketizer

    spark, rows = df.sparkSession, df.count()
    wanted = max(1, min(MOST_PARTS, -(-rows // part_rows)))
    place = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
    cuts = []
    if wanted > 1:
        probs = [i / wanted for i in range(1, wanted)]
        cuts = sorted({float(x) for x in df.select(F.percentile_approx(place, probs, 10 * wanted)).first()[0] or [] if x > float("-inf")})
    bucketed = Bucketizer(splits=[float("-inf"), *(cuts or [0.0]), float("inf")], inputCol="_place", outputCol="_part").transform(df.withColumn("_place", place))
    bucketed = bucketed.withColumn("part", F.col("_part").cast("int")).drop("_part", "_place")
    firsts = sorted((r["part"], r["least"]) for r in bucketed.groupBy("part").agg(F.min(F.struct(F.col(key).isNotNull().alias("n"), F.col(key).alias("k")))["k"].alias("least")).collect())
    guests = [(p, least, firsts[i - 1][0]) for i, (p, least) in enumerate(firsts)]
    guests = spark.createDataFrame(guests, f"part int, _least {df.schema[key].dataType.simpleString()}, _before int")
    homes = F.array(F.struct(F.col("part"), F.lit(False).alias("guest")))
    away = F.array(F.struct(F.col("_before").alias("part"), F.lit(True).alias("guest")))
    dealt = bucketed.join(F.broadcast(guests), "part").withColumn("_home", F.explode(F.when(F.col(key).eqNullSafe(F.col("_least")), F.concat(homes, away)).otherwise(homes)))
    dealt = dealt.select(*df.columns, "_home.part", "_home.guest")
    return dealt.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "guest", F.asc_nulls_first(key), *(c for c in df.columns if c != key))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The contract's row for each row of docs. Null texts count as empty; rows that share a doc_id follow each other
    in the order of their texts; a sole row is its own next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def compare(batches):
        import pyarrow as pa

        spots, schema = Spots(), pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        held = None  # the row that waits for its next: part, id, text, signatures
        for b in (x for big in batches for x in slices(big)):
            out = []
            for part, guest, i, text in zip(b.column("part").to_pylist(), b.column("guest").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if guest and held is None:
                    continue  # a further copy with the same key
                own = spots(text)
                if held is not None:
                    _, was, old, signs = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    other = spots(edited)
                    out.append((was, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(signs), written(other), likeness(signs, other), likeness(signs, own)))
                held = None if guest else (part, i, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return with_next(rows, "doc_id", part_rows).mapInArrow(compare, SCHEMA)


LEAST, LIST_ROWS = 0.8, 2048


def signature_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the ascending array of its signatures, for each row; null texts count as empty."""

    def make(batches):
        import pyarrow as pa

        spots = Spots()
        for b in (x for big in batches for x in slices(big)):
            got = [spots(t or "").astype(np.int64) for t in b.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, got)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(offsets, np.concatenate([*got, np.zeros(0, np.int64)]))], ["doc_id", "sigs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(make, "doc_id long, sigs array<long>")


def near_pairs(docs: DataFrame, least: float = LEAST, list_rows: int = LIST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has doc_id and class_id, the least doc_id with an equal set; pairs has a, b (class ids,
    a < b) and likeness, for all classes of different sets from `least` on.

    Rows without doc_id or signatures are in no class. Copies stay one class and are never paired off. Texts of any
    length are read whole; other columns are ignored; an empty table gives no rows. Inverted lists of more than
    list_rows sets are dealt into blocks and compared block against block, so none is ever in one task.
    """
    sets = stored(signature_sets(docs).filter("doc_id is not null and size(sigs) > 0"))
    keyed = sets.withColumn("k", F.struct(F.xxhash64("sigs"), F.xxhash64(F.lit(5), "sigs"), F.size("sigs")))
    named = keyed.groupBy("k").agg(F.min("doc_id").alias("class_id"), F.min("sigs").alias("sigs"))
    members = keyed.select("doc_id", "k").join(named.select("k", "class_id"), "k").select("doc_id", "class_id")
    n = F.size("sigs")
    # Lengths n and n' >= n can match only if n >= least * n', so at most one partition (a factor of 1 / least) apart.
    part = F.floor(F.log(n.cast("double")) / math.log(1 / least) + 1e-9).cast("int") if least < 1 else n
    classes = stored(named.select("class_id", "sigs", n.alias("n"), part.alias("part")))
    places = classes.select("class_id", "n", "part", F.explode("sigs").alias("sig"))
    common = places.groupBy("sig").agg(F.count("*").alias("c"))
    order = F.array_sort(F.collect_list(F.struct("c", "sig")))
    first = F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)
    heads = places.join(common.filter("c > 1"), "sig").groupBy("class_id", "n", "part").agg(order.alias("shared"))
    # A signature of one set only brings nothing together: such ones are the rarest and come first in a prefix.
    own = F.col("n") - F.size("shared")
    heads = heads.withColumn("shared", F.slice("shared", 1, F.greatest(F.lit(0), first - own)))
    lists = stored(heads.select("class_id", "n", "part", F.explode("shared").alias("s")).select("class_id", "n", "part", "s.sig", F.ceil(F.col("s.c") / list_rows).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    here = lists.withColumn("x", block).withColumn("y", F.explode(F.expr("sequence(0, blocks - 1)")))
    there = lists.withColumn("y", block).withColumn("x", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("part", F.explode(F.array(F.col("part"), F.col("part") - 1)))
    a, b = here.alias("a"), there.alias("b")
    same = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    rising = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.class_id") < F.col("b.class_id")))
    fits = F.col("a.n") >= least * F.col("b.n") - 1e-9
    found = a.join(b, same & rising & fits).select(F.col("a.class_id").alias("one"), F.col("b.class_id").alias("two")).distinct()
    whole = lambda name, s: classes.select(F.col("class_id").alias(name), F.col("sigs").alias(s))
    both = found.join(whole("one", "p"), "one").join(whole("two", "q"), "two").withColumn("i", F.size(F.array_intersect("p", "q")))
    likeness_ = F.col("i") / (F.size("p") + F.size("q") - F.col("i"))
    pairs = both.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), likeness_.alias("likeness")).filter(F.col("likeness") >= least - 1e-12)
    return members, pairs


def op10_spotsigs(spark, sf_dir):
    return compared(table(spark, sf_dir, "documents"))


QUERIES = {"op10_spotsigs": op10_spotsigs}
SQL: dict[str, str] = {}
