"""URL filters: path rules first, then logistic regression on hashed character n-grams of host and path.

Training is one SQL expression over the small labelled table (a fold of stochastic gradient steps), scoring is one
expression over pages: no Python, join or shuffle touches a row.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, table

SLOTS, EPOCHS, RATE = 4096, 20, 1.0
BLOCK_ABOVE = 0.0  # log-odds above which a URL is blocked: where the model finds junk likelier

# The rules as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# Words that junk hosts and plain hosts are put together from.
JUNK = """
casino poker bets betting slots jackpot lottery prizes bingo roulette winner adult porn xxx sex cams singles escort nude pills meds
viagra pharmacy steroid spam ads click track popup banner traffic seo backlinks links warez cracks keygen torrent replica payday loans
cheap free win buy fake phishing malware hack farm
""".split()
PLAIN = """
library garden weather tribune university guide museum kitchen science travel book school cycling astronomy parliament institute
theater thread therapy northern archive orchestra hospital history geography mathematics chemistry biology railway bakery cinema
concert football recipes language dictionary newspaper radio government council charity church village mountain harbor forest
river ocean island bridge castle market painter poetry novel teacher student research engineer software hardware network
database compiler journal review article letter notebook nation station education table cable stable clothing health earth
month other mother brother winter printer letters season reason person union million region television version
""".split()


def _labelled() -> list[tuple[str, str, int]]:
    """(host, path, label), 1 to be blocked: each word stands before two others of its kind, joined by a hyphen or not.
    Both kinds have the same joints, sub-domains, reserved
    domains and paths, so that these tell nothing."""
    out = []
    for words, label in ((JUNK, 1), (PLAIN, 0)):
        for i, word in enumerate(words):
            for step in (5, 17):
                host = ("", "www.", "blog.", "m.")[(i + step) % 4] + word + ("-", "", "-")[i % 3] + words[(i + step) % len(words)] + (".test", ".example.com", ".example.net", ".example.org")[(i + i // 4) % 4]
                out.append((host, ("/en/100", "/fr/210.html", "/de/31/", "/es/512", "/item/7", "/about/now")[i % 6], label))
    return out


LABELLED = [*_labelled(), ("", "", 0)]  # what has no host is no junk host


def held_out(host: str) -> bool:
    """Whether a labelled host is kept out of training, to measure on: a quarter, by hash."""
    return host != "" and int(hashlib.md5(host.encode()).hexdigest()[:2], 16) % 4 == 0


TRAINED = [row for row in LABELLED if not held_out(row[0])]


def host_path(url):
    """Host (A-Z lower-cased) and path by the rule of the contract; null or no `://` gives two empty texts."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url.substr(F.instr(url, "://") + 3, F.length(url)), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    host = F.coalesce(lowered(F.substring_index(rest, "/", 1)), F.lit(""))
    return host, F.coalesce(rest.substr(F.length(host) + 1, F.length(rest)), F.lit(""))


def rule_of(host: str, path: str) -> tuple[str, str]:
    """SQL for the longest rule that fits, and for its verdict; null if none does. For any SQL dialect."""
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"when ({host} = '{h}' or {host} like '%.{h}') and {path} like '{p}%' then " for _, h, p in by_length]
    case = lambda say: "case " + " ".join(f + f"'{say(r)}'" for f, r in zip(fits, by_length, strict=True)) + " end"
    return case(lambda r: r[1] + r[2]), case(lambda r: r[0])


def slots(host, path, size: int = SLOTS):
    """Distinct hash slots of the 3-grams of ^host$ and of the path, in which a run of digits is one 0; md5, so that any SQL engine gives the same."""

    def grams(text, tag):
        # The characters are bound as a lambda's argument, so that a long text is split once, not once a gram.
        windows = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 3, F.lit(0))), lambda i: F.concat(F.lit(tag), F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))
        return F.when(F.length(text) >= 3, F.flatten(F.transform(F.array(F.split(text, "")), windows))).otherwise(F.array(F.concat(F.lit(tag), text)))

    every = F.concat(grams(F.concat(F.lit("^"), host, F.lit("$")), "h"), grams(F.regexp_replace(path, "[0-9]+", "0"), "p"))
    return F.array_distinct(F.transform(every, lambda g: F.pmod(F.conv(F.md5(g).substr(1, 4), 16, 10).cast("int"), F.lit(size))))


def train(labelled: DataFrame, size: int = SLOTS, epochs: int = EPOCHS, rate: float = RATE) -> list[float]:
    """size weights and a bias from a small table (host, path, label), which must fit one row. Order: label's hash."""
    x = F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.when((i == size) | F.array_contains("s", i), 1 / F.sqrt(F.size("s") + 0.0)).otherwise(0.0))
    rows = labelled.select("label", F.md5(F.concat_ws("/", "host", "path")).alias("at"), slots(F.col("host"), F.col("path"), size).alias("s"))
    rows = rows.select(F.struct("at", F.col("label").cast("double").alias("y"), x.alias("x")).alias("e"))
    once = rows.agg(F.array_sort(F.collect_list("e")).alias("all"))
    # The gradient's factor is the same for all slots: bind it once in a one-element array.
    fold = f"""aggregate(sequence(1, {epochs}), transform(sequence(0, {size}), i -> 0D), (w, n) ->
      aggregate(all, w, (v, e) ->
        element_at(transform(
          array({rate}D * (e.y - 1 / (1 + exp(-aggregate(zip_with(v, e.x, (p, q) -> p * q), 0D, (s, t) -> s + t))))),
          g -> zip_with(v, e.x, (p, q) -> p + g * q)), 1)))"""
    return [float(w) for w in once.select(F.expr(fold).alias("w")).first()["w"]]  # size + 1 numbers


def log_odds(host, path, weights: list[float]):
    size = len(weights) - 1
    s, w = slots(host, path, size), F.array(*map(F.lit, weights))
    return F.aggregate(s, F.lit(weights[size]), lambda a, i: a + F.get(w, i)) / F.sqrt(F.size(s) + 0.0)


def judged(pages: DataFrame, weights: list[float]) -> DataFrame:
    """page_id, host, path, rule, verdict for each row; repeated rows stay, null urls have empty host and path, urls of any
    length are read whole, other columns are ignored (host, path and so on too); an empty table gives none."""
    host, path = host_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of("host", "path")
    model = F.when(log_odds(F.col("host"), F.col("path"), weights) > BLOCK_ABOVE, "block").otherwise("allow")
    return split.select("page_id", "host", "path", F.expr(rule).alias("rule"), F.coalesce(F.expr(verdict), model).alias("verdict"))


def op6_urls(spark, sf_dir):
    labelled = spark.createDataFrame(TRAINED, "host string, path string, label int")
    return judged(table(spark, sf_dir, "pages"), train(labelled))


def plain_slots(h: str, p: str) -> list[int]:
    grams = []
    for tag, t in (("h", f"^{h}$"), ("p", re.sub("[0-9]+", "0", p))):
        grams += [tag + t[i : i + 3] for i in range(len(t) - 2)] or [tag + t]
    return sorted({int(hashlib.md5(g.encode()).hexdigest()[:4], 16) % SLOTS for g in grams})


def plain_log_odds(h: str, p: str, w: list[float]) -> float:
    s = plain_slots(h, p)
    return (w[SLOTS] + sum(w[i] for i in s)) / math.sqrt(len(s))


def plain_weights() -> list[float]:
    """The same training written plainly, for the oracle."""
    rows = sorted((hashlib.md5(f"{h}/{p}".encode()).hexdigest(), y, plain_slots(h, p)) for h, p, y in TRAINED)
    w = [0.0] * (SLOTS + 1)
    for _ in range(EPOCHS):
        for _, y, s in rows:
            k = 1 / math.sqrt(len(s))
            g = RATE * (y - 1 / (1 + math.exp(-k * (w[SLOTS] + sum(w[i] for i in s))))) * k
            for i in [*s, SLOTS]:
                w[i] += g
    return w


def oracle() -> str:
    rule, verdict = rule_of("host", "path")
    w = plain_weights()
    gram = lambda t, tag: f"case when length({t}) >= 3 then list_transform(range(1, length({t}) - 1), lambda i: '{tag}' || substr({t}, i, 3)) else ['{tag}' || {t}] end"
    return f"""
with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from a),
c as (select *, '^' || host || '$' h, regexp_replace(path, '[0-9]+', '0', 'g') p from b),
d as (select *, list_distinct(list_transform(list_concat({gram("h", "h")}, {gram("p", "p")}), lambda g: cast(('0x' || substr(md5(g), 1, 4)) as int) % {SLOTS})) s from c),
e as (select *, list_sum(list_transform(s, lambda i: ({[round(x, 12) for x in w[:SLOTS]]})[i + 1])) + {w[SLOTS]} as logit from d)
select page_id, host, path, {rule} as rule, coalesce({verdict}, case when logit > {BLOCK_ABOVE} then 'block' else 'allow' end) as verdict from e"""


QUERIES = {"op6_urls": op6_urls}
SQL = {"op6_urls": oracle()}
