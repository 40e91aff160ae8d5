"""Column functions for semi-structured text. All are expressions, so Catalyst sees through them."""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NUTRIENTS

GROUP = r"\(([0-9]{1,2}(?:\.[0-9]{1,2})*)\)"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
SPACE = r"(?U)[\s\x1c-\x1f]"
_PLAIN = r"^ *+[!-~가-힣]++(?: [!-~가-힣]++)*+ *+\z"  # words of ASCII and Hangul with a space between: nothing to collapse
_EMPTY = "cast(array() as array<string>)"


def stripped(x: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _stripped_column(x: Column) -> Column:
    """The same for what costs nothing to read more than once: texts with a letter, digit or sign of ASCII or a syllable of
    Hangul at either end, as most have, are not searched."""
    solid = lambda c: F.ascii(c).between(33, 126) | F.ascii(c).between(0xAC00, 0xD7A3)
    return F.when(solid(F.substring(x, 1, 1)) & solid(F.substring(x, -1, 1)), x).otherwise(stripped(x))


@cache
def _entities() -> str:
    """A JSON object of the entity names that end in a semicolon."""
    import json

    return json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")}, ensure_ascii=False)


def _code_point(number: Column) -> Column:
    ok = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    # Numbers 128 to 159 mean the characters of Windows' western code page.
    western = [0x20AC, 0x81, 0x201A, 0x192, 0x201E, 0x2026, 0x2020, 0x2021, 0x2C6, 0x2030, 0x160, 0x2039, 0x152, 0x8D, 0x17D, 0x8F, 0x90, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2013, 0x2014, 0x2DC, 0x2122, 0x161, 0x203A, 0x153, 0x9D, 0x17E, 0x178]
    meant = F.when(number.between(128, 159), F.get(F.lit(western), (number - 128).cast("int"))).otherwise(number)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(ok, meant).otherwise(0xFFFD).cast("long")), 8, "0")), "UTF-32")


def decoded(x: Column) -> Column:
    """Entities decoded in a single pass, then stripped; null gives an empty text.

    Names need their semicolon here; `&amp` without one stays as it is."""
    names = F.from_json(F.lit(_entities()), "map<string,string>")

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        hexed, tens = F.conv(F.substring(name, 3, 8), 16, 10).cast("long"), F.substring(name, 2, 9).cast("long")
        number = F.when(name.rlike("^#[xX]"), hexed).otherwise(tens)
        found = F.try_element_at(names, name)
        return F.when(name == "", F.concat(F.lit("&"), piece)).when(name.startswith("#"), F.concat(_code_point(number), rest)).when(found.isNotNull(), F.concat(found, rest)).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(F.coalesce(x, F.lit("")), "&")
    whole = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), one), ""))
    return F.when(F.contains(x, F.lit("&")), stripped(whole)).otherwise(_stripped_column(F.coalesce(x, F.lit(""))))


def dishes(x: Column) -> Column:
    """Texts between <br>s without any code group, white space collapsed; empty ones dropped."""
    without = lambda p: F.when(F.contains(p, F.lit("(")), F.regexp_replace(p, GROUP, "")).otherwise(p)
    clean = lambda p: F.when(p.rlike(_PLAIN), F.trim(p)).otherwise(stripped(F.regexp_replace(p, f"{SPACE}+", " ")))
    return F.filter(F.transform(F.transform(F.split(decoded(x), r"(?iU)<br\s*/?>"), without), clean), lambda p: p != "")


def codes(x: Column) -> Column:
    """Ascending distinct codes of those groups whose every code is in 1..19."""
    groups = F.regexp_extract_all(decoded(x), F.lit(GROUP), F.lit(1))
    numbers = F.transform(groups, lambda g: F.transform(F.split(g, "\\."), lambda c: c.cast("int")))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(numbers, lambda a: F.forall(a, lambda c: c.between(1, 19))))))


def first_number(x: Column) -> Column:
    return F.regexp_extract(decoded(x), NUMBER, 0).try_cast("double")


def nutrient(x: Column, name: str) -> Column:
    return F.regexp_extract(decoded(x), rf"{NUTRIENTS[name]}(?iU:\s*\(g\)\s*:\s*)({NUMBER})", 1).try_cast("double")


def compact_date(x: Column) -> Column:
    """yyyyMMdd as a date, month and day with one or two digits; null if it is none."""
    t = stripped(F.coalesce(x, F.lit("")))
    parts = r"^([0-9]{4})(1[0-2]|0[1-9]|[1-9])(3[0-1]|[1-2][0-9]|0[1-9]|[1-9])$"
    part = lambda i, n: F.lpad(F.regexp_extract(t, parts, i), n, "0")
    plain = F.coalesce(x, F.lit("")).rlike(r"^(?!0000)[0-9]{8}\z")
    short = lambda i, n: F.substring(x, i, n)
    eight = F.concat_ws("-", short(1, 4), short(5, 2), short(7, 2)).try_cast("date")
    return F.when(plain, eight).when(t.rlike(parts), F.try_to_date(F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)), "yyyy-MM-dd"))


def utc_stamp(x: Column) -> Column:
    """A timestamp as an ISO text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def range_fault(start: Column, end: Column, most_days: int) -> Column:
    """What is wrong with a range of two yyyyMMdd texts: date, order, length, or null for nothing."""
    exact = lambda x: F.when(x.rlike("^[0-9]{8}$"), F.try_to_date(x, "yyyyMMdd"))
    a, b = exact(start), exact(end)
    return F.when(a.isNull() | b.isNull(), "date").when(a > b, "order").when(F.date_diff(b, a) >= most_days, "length")


def without_hyphens(x: Column) -> Column:
    return F.replace(x, F.lit("-"), F.lit(""))


def csv_terms(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), stripped), lambda t: t != "")


def ordered_distinct(terms: Column) -> Column:
    """Stripped terms without empty ones, each once, in the order of their first place."""
    return F.array_distinct(F.filter(F.transform(terms, stripped), lambda t: t != ""))


def folded(x: Column) -> Column:
    """Case folded, as far as lower case and the German sharp s go."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def tokens(x: Column) -> Column:
    return F.filter(F.split(folded(x), f"{SPACE}+"), lambda w: w != "")


def spaced_words(x: Column) -> Column:
    """Folded tokens with one space between; null gives an empty text."""
    return stripped(F.regexp_replace(folded(F.coalesce(x, F.lit(""))), f"{SPACE}+", " "))


def char_grams(x: Column, sizes=(2, 3, 4)) -> Column:
    """All n-grams of each token with a space at either end, repeats kept.

    Tokens stand side by side with one space between, so an n-gram is a window without a space inside."""
    spaced = F.concat(F.lit(" "), stripped(F.regexp_replace(folded(x), f"{SPACE}+", " ")), F.lit(" "))
    windows = [F.regexp_extract_all(spaced, F.lit(f"(?s)(?=(.{'[^ ]' * (z - 2)}.))."), F.lit(1)) for z in sizes]
    return F.when(stripped(x) == "", F.expr(_EMPTY)).otherwise(F.concat(*windows))


def runs(terms: str) -> Column:
    """Each distinct one of an ascending array column with its number, as term and n."""
    t = F.col(terms)
    first = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    ends = F.concat(F.slice(first, 2, F.size(t)), F.array(F.size(t)))
    return F.when(F.size(t) > 0, F.transform(F.arrays_zip(first.alias("a"), ends.alias("b")), lambda r: F.struct(F.get(t, r["a"]).alias("term"), (r["b"] - r["a"]).alias("n"))))


def hangul_words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("[가-힣]{2,}"), F.lit(0))


def contains_any(x: Column, words: list[str]) -> Column:
    """x must be folded."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, folded(F.lit(w)))
    return out


def menu_types(x: Column, classes: dict[str, list[str]]) -> Column:
    """Names of the classes with a keyword in x, in their order."""
    t = folded(x)
    return F.filter(F.array(*(F.when(contains_any(t, words), F.lit(name)) for name, words in classes.items())), lambda c: c.isNotNull())


def spice_level(x: Column, levels: dict[int, list[str]]) -> Column:
    t, out = folded(x), F
    for level in sorted(levels, reverse=True):
        out = out.when(contains_any(t, levels[level]), level)
    return out.otherwise(2)


def hits(x: Column, terms: Column) -> Column:
    """Those terms that x (folded) contains, in their order."""
    return F.filter(terms, lambda t: F.contains(x, folded(t)))


def listed_codes(c: Column, none: str) -> Column:
    return F.when(F.size(c) == 0, none).otherwise(F.array_join(F.transform(c, lambda n: n.cast("string")), ", "))
