"""What several operators share: the shared scratch folder, partition counts and byte-exact word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII separators; only A-Z are lower-cased.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset: on one machine (tests) below a temporary folder, on a
    cluster an error, since executors wouldn't share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="menurank-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/menurank-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors. The shuffle files of the
    write are deleted when it ends; an executor lost meanwhile costs recomputation from the last stored table."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._menurank_path = path
    return out


def cached(df: DataFrame) -> DataFrame:
    """A small df that several steps of one operator read: kept by executors, made again where one is lost. Callers
    unpersist it before they return."""
    return df.persist()


def drop(*frames: DataFrame) -> None:
    for df in frames:
        df.unpersist()


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote for these frames, which nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._menurank_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lowered(text):
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(remainder_of: int, doc_id="doc_id"):
    """crc32 of doc_id as text modulo remainder_of; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % remainder_of


class WordHashes(dict):
    """Words (bytes) and the 8 bytes that stand for them. Past `limit` words it forgets all and goes on."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh3_64_digest

        got = self[word] = xxh3_64_digest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def ascii_words(text: str | None) -> list[bytes]:
    """What ASCII white space (space, 9 to 13) parts, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


SLICE_BYTES = 4 << 20


def slices(batch, column: str = "text", limit: int = SLICE_BYTES):
    """An Arrow batch in slices whose texts have at most `limit` bytes together, or that are one row; so what a worker
    makes of a batch is bounded by bytes, not by rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        upto = max(at + 1, upto)
        yield batch.slice(at, upto - at)
        at = upto
    pa.default_memory_pool().release_unused()


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers without pattern."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (see ascii_words) of an Arrow column of texts, and where each text's words begin in
    them (one number more than texts); null is a text without words.

    A word's hash takes its length and then eight bytes after eight, each step one-to-one in these bytes: words of up
    to eight bytes and equal length never collide, others as hashes of 64 bits do."""
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest

    column = pa.concat_arrays([column.cast(pa.large_string()).fill_null("")])
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size, data = int(bounds[-1] - bounds[0]), column.buffers()[2]
    raw = np.zeros(size + 8, np.uint8)
    if size:
        raw[:size] = _LOWER[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = ~_SPACE[raw[:size]]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    opens[cuts] |= inside[1:-1][cuts]  # texts stand side by side, without a space
    closes[cuts - 1] |= inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    length = end - start
    lanes = np.ndarray((size + 1,), np.uint64, raw, 0, (1,))
    h = _mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = _mix(h ^ (lanes[start] & _MASKS[np.minimum(length, 8)]))
    at, left = 8, np.flatnonzero(length > 8)
    while len(left) and at < LONG_WORD:
        h[left] = _mix(h[left] ^ (lanes[start[left] + at] & _MASKS[np.minimum(length[left] - at, 8)]))
        at += 8
        left = left[length[left] > at]
    for i in left.tolist():
        h[i] = xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return h, np.searchsorted(start, bounds)


def pack(array: np.ndarray) -> bytes:
    """The array's size in bytes, then its first bytes, second bytes and so on, compressed."""
    import pyarrow as pa

    planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(data: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()
