"""Deterministic k-means labels on standardised features, seeded by evenly spaced rows in calorie order.

Several groups of rows (those that an allergy set leaves, say) are fitted at once. Rows are read once for the distinct feature
vectors with how many rows of each group have them, once more for the seeds; medians, deviations and the rounds are
made from these vectors: groups with few in one task each, all rounds at once, else with one aggregate a round for all groups.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from functools import reduce
from math import inf, sqrt

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import HEARTY, LIGHT, MIDDLE, TOO_FEW
from .steps import forget, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

FEATURES = ["calories", "carbs_g", "protein_g", "fat_g", "dish_count"]
ROUNDS, MOST_AT_ONCE, SAMPLE = 30, 100_000, 4096
SMALL = 100_000  # distinct points a group (10 MB) that a task may hold; only the plan depends on it


def numbers(features: list[str]) -> list[Column]:
    """Features as doubles; what is no number is null."""
    as_double = [F.col(f).try_cast("double") for f in features]
    return [F.when(~F.isnan(c), c).alias(f) for c, f in zip(as_double, features, strict=True)]


@dataclass
class Fit:
    """What is known of one group: numbers of rows and of rows with all nutrition values, how features are filled and
    standardised, centroids, and the name of each."""

    features: list[str]
    n: int = 0
    complete: int = 0
    unlike: int = 0
    fill: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    centroids: list[list[float]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def x(self) -> list[Column]:
        return [F.coalesce(c, F.lit(v)) for c, v in zip(numbers(self.features), self.fill, strict=True)]

    def z(self) -> list[Column]:
        return [(c - F.lit(m)) / F.lit(s) for c, m, s in zip(self.x(), self.mean, self.spread, strict=True)]

    def of(self, values: list[float]) -> list[float]:
        return [(v - m) / s for v, m, s in zip(values, self.mean, self.spread, strict=True)]

    def name(self) -> Column:
        """The label of a row."""
        if len(self.names) == 1:
            return F.lit(self.names[0])
        return F.get(F.array(*map(F.lit, self.names)), nearest(self.z(), [[F.lit(v) for v in c] for c in self.centroids]))


def nearest(z: list[Column], centroids: list[list[Column]]) -> Column:
    """The number of the nearest centroid, the least of equals."""
    distance = lambda c: reduce(lambda a, b: a + b, ((x - y) ** 2 for x, y in zip(z, c, strict=True)))
    return F.array_min(F.array(*(F.struct(distance(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centroids))))["k"]


def points(rows: DataFrame, groups: list[Column], features: list[str]) -> tuple[DataFrame, list[Fit]]:
    """(g, x, w): each group's distinct filled vectors and how many of its rows have them; and fits without centroids."""
    parts = [g.alias(f"g{i}") for i, g in enumerate(groups)]
    counts = [F.count_if(F.col(f"g{i}")).alias(f"w{i}") for i in range(len(groups))]
    vectors = written(rows.select(*numbers(features), *parts).groupBy(*features).agg(*counts))
    whole = reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in features[:-1]))
    told = vectors.agg(*(x for i in range(len(groups)) for x in (
        F.sum(f"w{i}").alias(f"n{i}"), F.sum(F.when(whole, F.col(f"w{i}"))).alias(f"c{i}"), F.array(*(F.percentile(f, F.lit(0.5), F.col(f"w{i}")) for f in features)).alias(f"m{i}"),
    ))).first()
    fits = [Fit(features, told[f"n{i}"] or 0, told[f"c{i}"] or 0, fill=[m or 0.0 for m in told[f"m{i}"]]) for i in range(len(groups))]
    each = [F.struct(F.lit(i).alias("g"), F.array(*f.x()).alias("x"), F.col(f"w{i}").alias("w")) for i, f in enumerate(fits)]
    out = written(vectors.select(F.inline(F.array(*each))).filter("w > 0").groupBy("g", "x").agg(F.sum("w").alias("w")))
    forget(vectors)
    # Deviations from the median first: their squares lose no digits where a feature is far from 0.
    fill, width = F.lit([f.fill for f in fits]), range(len(features))
    apart = lambda j: F.get("x", F.lit(j)) - F.get(F.get(fill, F.col("g")), F.lit(j))
    sums = out.groupBy("g").agg(F.count("*").alias("unlike"), *(x for j in width for x in (
        F.sum(F.col("w") * apart(j)).alias(f"s{j}"), F.sum(F.col("w") * apart(j) ** 2).alias(f"q{j}"), (F.min(apart(j)) == F.max(apart(j))).alias(f"flat{j}"),
    ))).collect()
    for f in fits:
        f.mean, f.spread = [0.0] * len(features), [1.0] * len(features)
    for r in sums:  # a row a group
        f = fits[r["g"]]
        shift = [r[f"s{j}"] / f.n for j in width]
        f.unlike, f.mean = r["unlike"], [m + s for m, s in zip(f.fill, shift, strict=True)]
        f.spread = [1.0 if r[f"flat{j}"] else sqrt(max(0.0, r[f"q{j}"] / f.n - shift[j] ** 2)) or 1.0 for j in width]
    return out, fits


def imputed(rows: DataFrame, key: str, features: list[str] = FEATURES) -> tuple[DataFrame, dict]:
    """key, x (imputed features) and z (standardised), with how many rows there are and how many are complete."""
    made, (fit,) = points(rows, [F.lit(True)], features)
    forget(made)
    return rows.select(key, F.array(*fit.x()).alias("x"), F.array(*fit.z()).alias("z")), {"n": fit.n, "complete": fit.complete}


@dataclass
class Bracket:
    """Where the row at one position of one group's order is: between two rows, either end included or not."""

    group: Column
    order: list[Column]
    skip: int
    n: int
    low: tuple | None = None
    high: tuple | None = None
    with_low: bool = True
    with_high: bool = True

    def below(self, row: tuple, same: bool) -> Column:
        """Whether a row comes before `row` in the order (or is it)."""
        out = F.lit(same)
        for c, v in reversed(list(zip(self.order, row, strict=True))):
            out = (c < F.lit(v)) | ((c == F.lit(v)) & out)
        return out

    def pinned(self) -> bool:
        """Whether all rows inside share the order's values."""
        return self.low is not None and self.high is not None and self.with_low and self.with_high and _place(self.low) == _place(self.high)

    def inside(self) -> Column:
        out = self.group
        if self.low is not None:
            out = out & ~self.below(self.low, not self.with_low)
        return out if self.high is None else out & self.below(self.high, self.with_high)


def selected(rows: DataFrame, brackets: list[Bracket], carry: list[str]) -> list:
    """For each bracket the columns carry of the row `skip` places into it, by distributed selection for all brackets at once.

    While a bracket holds more than MOST_AT_ONCE rows, about SAMPLE of them, those with the least hashes, tell where to cut, and
    one count tells on which side the row is; then only rows inside are read. Rows that share all of the order fill a bracket
    together, and any of them is the row. Only brackets that are small are sorted."""

    def tagged(which: list[int], columns: list[Column], chosen=lambda i: F.lit(True)) -> DataFrame:
        one = lambda i: F.struct(F.lit(i).alias("t"), *(c.alias(f"o{j}") for j, c in enumerate(brackets[i].order)))
        return rows.select(*columns, F.explode(F.array_compact(F.array(*(F.when(brackets[i].inside() & chosen(i), one(i)) for i in which)))).alias("o")).select(*(c for c in carry if columns), "o.*")

    turn, made = 0, []
    while wide := [i for i, b in enumerate(brackets) if b.n > MOST_AT_ONCE and not b.pinned()]:
        turn += 1
        least = lambda i: F.pmod(F.xxhash64(*brackets[i].order, F.lit(turn)), F.lit(1 << 40)) < F.lit(int(SAMPLE / brackets[i].n * (1 << 40)))  # noqa: E731, B023
        told = tagged(wide, [], least).collect()  # SAMPLE rows a bracket, about
        cuts = {}
        for i in wide:
            b, own = brackets[i], sorted((tuple(r)[1:] for r in told if r["t"] == i), key=_place)
            if own:
                at, margin = b.skip / b.n * len(own), 2 * sqrt(len(own))
                cuts[i] = own[max(0, int(at - margin))], own[min(len(own) - 1, int(at + margin) + 1)]
        if not cuts:
            continue
        counts = rows.agg(*(x for i in cuts for x in (F.count_if(brackets[i].inside() & brackets[i].below(cuts[i][0], False)).alias(f"a{i}"), F.count_if(brackets[i].inside() & brackets[i].below(cuts[i][1], True)).alias(f"b{i}")))).first()
        for i, (low, high) in cuts.items():
            b, before, upto = brackets[i], counts[f"a{i}"], counts[f"b{i}"]
            if b.skip < before:
                b.high, b.with_high, b.n = low, False, before
            elif b.skip >= upto:
                b.low, b.with_low, b.skip, b.n = high, False, b.skip - upto, b.n - upto
            else:
                b.low, b.with_low, b.high, b.with_high, b.skip, b.n = low, True, high, True, b.skip - before, upto - before
        rows = written(rows.filter(reduce(lambda a, c: a | c, (b.inside() for b in brackets))))
        made.append(rows)
    fast = {i: F.any_value(F.when(b.inside(), F.struct(*carry)), F.lit(True)).alias(f"v{i}") for i, b in enumerate(brackets) if b.pinned()}
    found = {i: v for i, v in zip(fast, rows.agg(*fast.values()).first(), strict=True)} if fast else {}
    if others := [i for i in range(len(brackets)) if i not in fast]:
        tags = tagged(others, [F.col(c) for c in carry])
        order = [c for c in tags.columns if c not in ("t", *carry)]
        placed = tags.withColumn("r", F.row_number().over(W.partitionBy("t").orderBy(*order)) - 1)
        wanted = F.get(F.lit([b.skip for b in brackets]), F.col("t"))
        found |= {r["t"]: r for r in placed.filter(F.col("r") == wanted).collect()}
    forget(*made)
    return [found[i] for i in range(len(brackets))]


def _place(row: tuple) -> list:
    """To sort rows as Spark does: what is no number comes last."""
    return [(v != v, None if v != v else v) for v in row]


def at_positions(rows: DataFrame, order: list[str], positions: list[int]) -> list:
    """The rows at 0-based positions of an order; of rows that share all of it, any."""
    n = rows.count()
    return selected(rows, [Bracket(F.lit(True), [F.col(c) for c in order], p, n) for p in positions], rows.columns)


def fitted(rows: DataFrame, key: str, groups: list[Column], most: int = 3, features: list[str] = FEATURES) -> list[Fit]:
    """A fit for each group of rows. Fewer than 3 rows, or than 3 with all nutrition values, give one name; so does one centroid.
    Of equal calories the lesser key comes first. key must be unique."""
    made, fits = points(rows, groups, features)
    width, ask = range(len(features)), []
    for i, f in enumerate(fits):
        k = min(max(1, int(most)), f.n, f.unlike)
        if f.n < 3 or f.complete < 3:
            f.names = [TOO_FEW]
        elif k == 1:
            f.names = [MIDDLE]
        else:
            ask += [(i, round(j * (f.n - 1) / (k - 1))) for j in range(k)]  # halves to even
    if ask:
        slim = rows.select(F.col(key).alias("_key"), *numbers(features), *(g.alias(f"_g{i}") for i, g in enumerate(groups)))
        brackets = [Bracket(F.col(f"_g{i}"), [fits[i].x()[0], F.col("_key")], p, fits[i].n) for i, p in ask]
        for (i, _), r in zip(ask, selected(slim, brackets, features), strict=True):
            fits[i].centroids.append(fits[i].of([r[c] if r[c] is not None else v for c, v in zip(features, fits[i].fill, strict=True)]))
        _rounds(made, fits, sorted({i for i, _ in ask}), width)
    forget(made)
    return fits


def _rounds(made: DataFrame, fits: list[Fit], moving: list[int], width: range) -> None:
    """Lloyd's rounds for these groups, then names by the centroids' mean calories."""
    mean, spread = (_table([getattr(f, of) for f in fits]) for of in ("mean", "spread"))
    z = ", ".join(f"(x[{j}] - {mean}[g][{j}]) / {spread}[g][{j}]" for j in width)
    here = written(made.filter(F.col("g").isin(moving)).select("g", "w", F.get("x", F.lit(0)).alias("c"), F.expr(f"array({z})").alias("z")))
    if here.count() <= SMALL * len(moving):
        told = _in_tasks(here, fits, width)
    else:
        told = _in_jobs(here, fits, moving, width)
    for i in moving:
        rank = [k for _, k in sorted((c, k) for g, k, c in told if g == i)]
        names = {c: MIDDLE for c in rank[1:-1]} | {rank[0]: LIGHT} | {rank[-1]: HEARTY}
        fits[i].names = [names.get(k, MIDDLE) for k in range(len(fits[i].centroids))]
    forget(here)


def _in_tasks(here: DataFrame, fits: list[Fit], width: range) -> list[tuple]:
    """All rounds of a group in one task, which holds its points: SMALL of them a group, about."""
    starts = [f.centroids for f in fits]

    def settle(key, points):
        import numpy as np
        import pandas as pd

        z, w, used = np.stack(points["z"]), points["w"].to_numpy(float), np.array(starts[key[0]])
        many = range(len(used))

        def label(centroids):
            apart = np.zeros((len(z), len(centroids)))
            for j in width:
                apart += (z[:, j, None] - centroids[None, :, j]) ** 2
            return apart.argmin(axis=1)

        for _ in range(ROUNDS):
            own = label(used)
            n = np.bincount(own, w, len(used))
            sums = np.stack([np.bincount(own, w * z[:, j], len(used)) for j in width], axis=1)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], used)
            last = used
            if (np.abs(new - used) <= 1e-8 + 1e-5 * np.abs(used)).all() and ((new == used).all() or (label(new) == own).all()):
                break
            used = new
        own = label(last)
        n, c = np.bincount(own, w, len(last)), np.bincount(own, w * points["c"].to_numpy(float), len(last))
        return pd.DataFrame({"g": key[0], "k": many, "centroid": [x.tolist() for x in last], "c": [c[k] / n[k] if n[k] else None for k in many]})

    rows = here.groupBy("g").applyInPandas(settle, "g int, k int, centroid array<double>, c double").orderBy("g", "k").collect()  # a row a centroid
    for r in rows:
        fits[r["g"]].centroids[r["k"]] = r["centroid"]
    return [(r["g"], r["k"], r["c"]) for r in rows if r["c"] is not None]


def _table(rows: list) -> str:
    """Nested lists of numbers as a SQL array."""
    one = lambda v: f"array({', '.join(map(one, v))})" if isinstance(v, list) else "double('Infinity')" if v == inf else f"{v!r}D"
    return one(rows)


def _in_jobs(here: DataFrame, fits: list[Fit], moving: list[int], width: range) -> list[tuple]:
    """Each round as one aggregate for all groups."""
    many = max(len(fits[i].centroids) for i in moving)
    far = [inf] * len(width)  # what a group lacks is nearest to nothing

    def label(centroids: list[list[list[float]]]) -> Column:
        whole = _table([c + [far] * (many - len(c)) for c in centroids])
        apart = lambda k: " + ".join(f"pow(z[{j}] - {whole}[g][{k}][{j}], 2)" for j in width)
        return F.expr(f"array_min(array({', '.join(f'struct({apart(k)} as d, {k} as k)' for k in range(many))})).k")

    sums = [F.expr(f"sum(w * z[{j}])").alias(f"v{j}") for j in width]
    used, done = [f.centroids for f in fits], set()
    for _ in range(ROUNDS):
        left = [i for i in moving if i not in done]
        if not left:
            break
        means = here.filter(F.col("g").isin(left)).groupBy("g", label(used).alias("k")).agg(F.sum("w").alias("n"), *sums).collect()  # a row a centroid
        new = [[list(c) for c in u] for u in used]
        for r in means:
            new[r["g"]][r["k"]] = [r[f"v{j}"] / r["n"] for j in width]
        close = {i for i in left if all(abs(a - b) <= 1e-8 + 1e-5 * abs(b) for x, y in zip(new[i], used[i]) for a, b in zip(x, y))}
        if doubt := [i for i in close if new[i] != used[i]]:
            other = here.filter(F.col("g").isin(doubt)).filter(label(new) != label(used)).select("g").distinct().collect()
            close -= {r["g"] for r in other}
        done |= close
        last, used = used, [u if i in close or i not in left else n for i, (u, n) in enumerate(zip(used, new))]
    for i in moving:
        fits[i].centroids = used[i] if i in done else last[i]
    told = here.groupBy("g", label([f.centroids for f in fits]).alias("k")).agg(F.expr("sum(w * c) / sum(w)").alias("c")).collect()
    return [(r["g"], r["k"], r["c"]) for r in told]


def labelled(rows: DataFrame, key: str, most: int = 3, features: list[str] = FEATURES) -> DataFrame:
    """rows with cluster_name (see `fitted`)."""
    (fit,) = fitted(rows, key, [F.lit(True)], most, features)
    return rows.withColumn("cluster_name", fit.name())
