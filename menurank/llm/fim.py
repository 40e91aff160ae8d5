"""Fill-in-the-middle: documents cut in three at unit boundaries and put together with the middle last.

Each text is decoded to an array of code points. Units end where two neighbours are of classes that a unit doesn't hold side by
side; flatnonzero gives these boundaries, and hashes of the seed and the document choose two ranks among them. The pieces
between are slices of the array, encoded again. Documents are independent of each other: nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

SEED, RATE, SPM = 7, 100, 50
MARKERS = ("<P>", "<S>", "<M>")
OWN = ["n", "form", "prefix_chars", "middle_chars", "output"]


def lines(codes: np.ndarray) -> np.ndarray:
    """Whether a unit ends after each code point but the last: lines, with the feeds that end them."""
    return codes[:-1] == 10


def words(codes: np.ndarray) -> np.ndarray:
    """Words, with the ASCII white space after them; white space at the start is a unit of its own."""
    space = (codes == 32) | (codes >= 9) & (codes <= 13)
    return space[:-1] & ~space[1:]


def characters(codes: np.ndarray) -> np.ndarray:
    return np.ones(max(0, len(codes) - 1), bool)


UNITS = {"lines": lines, "words": words, "characters": characters}


def boundaries(codes: np.ndarray, unit: str) -> np.ndarray:
    """0 and the end of each unit."""
    if not len(codes):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(UNITS[unit](codes)) + 1, [len(codes)]])


def draws(seed, doc_id) -> tuple[int, ...]:
    """Four numbers below 2**32; a null doc_id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def encoded(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def transformed(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "lines", seed: int = SEED, rate: int = RATE, spm: int = SPM, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """df without its text, with n (units), form, prefix_chars, middle_chars and output.

    Of 100 documents `rate` are cut, and of 100 that are cut `spm` have the form spm: suffix, prefix, middle; the others
    psm: prefix, suffix, middle; each piece follows its marker. The rest are plain, the text itself, as are empty texts and
    those that hold a marker; their numbers of code points are null. A null text counts as empty, a null key as the empty text.
    Rows of one key draw alike. Texts of any length are cut whole. No marker may hold or overlap another."""
    from pyspark.sql import types as T

    if len(set(markers)) < 3 or any(a[-k:] == b[:k] for a in markers for b in markers for k in range(1, len(a) + 1) if (a, k) != (b, len(b))):
        raise ValueError("markers must differ, and none may end as one begins")
    df = df.drop(*OWN)
    rest = [f for f in df.schema.fields if f.name != text]
    p, s, m = markers

    def cut(key, whole: str):
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = boundaries(codes, unit)
        n = len(ends) - 1
        h1, h2, h3, h4 = draws(seed, key)
        if not whole or h3 % 100 >= rate or any(x in whole for x in markers):
            return n, "plain", None, None, whole
        one, two = (int(ends[i]) for i in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = map(encoded, (codes[:one], codes[one:two], codes[two:]))
        form = "spm" if h4 % 100 < spm else "psm"
        out = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
        return n, form, one, two - one, out

    def make(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for b in (x for big in batches for x in slices(big, text)):
            made = [cut(k, t or "") for k, t in zip(b.column(key).to_pylist(), b.column(text).to_pylist())]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*made), kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), *columns], [*(f.name for f in rest), *OWN])

    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    return df.mapInArrow(make, T.StructType([*rest, *(T.StructField(c, k) for c, k in zip(OWN, kinds, strict=True))]))


def restored(output="output", form="form", markers: tuple[str, str, str] = MARKERS):
    """The text that an output and its form were made of, as a column: markers part it in four, of which the first is empty."""
    quoted = "|".join(f"\\Q{m}\\E" for m in markers)
    parts = F.split(F.col(output), quoted, -1)
    part = lambda i: F.get(parts, F.lit(i))
    psm, spm = F.concat(part(1), part(3), part(2)), F.concat(part(2), part(3), part(1))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def op13_fim(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = transformed(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


ORACLE = """
with u as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') u, sha256('7:' || coalesce(doc_id::varchar, '')) h from documents),
h as (select *, len(u)::bigint n, [('0x' || substr(h, 8 * i + 1, 8))::bigint for i in range(4)] h4 from u),
c as (select *, t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h4[3] % 100 >= 100 plain, least(h4[1] % (n + 1), h4[2] % (n + 1)) a, greatest(h4[1] % (n + 1), h4[2] % (n + 1)) b from h),
p as (select *, array_to_string(u[1 : a], '') pre, array_to_string(u[a + 1 : b], '') mid, array_to_string(u[b + 1 :], '') suf, case when plain then 'plain' when h4[4] % 100 < 50 then 'spm' else 'psm' end form from c)
select doc_id, n, form, case when not plain then length(pre) end as prefix_chars, case when not plain then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p"""

QUERIES = {"op13_fim": op13_fim}
SQL = {"op13_fim": ORACLE}
