"""Explainable ranking: exclusion, clusters, similarity and keyword rules in one score, for one profile or many."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X
from ..functions.rounding import fixed2, round1
from .kmeans import fitted
from .steps import written
from .tfidf import with_similarities


@dataclass(frozen=True)
class Rules:
    """Keyword lists, so that other tables than meals can be ranked."""

    types: dict = field(default_factory=lambda: C.MENU_TYPES)
    spice: dict = field(default_factory=lambda: C.SPICE)


@dataclass(frozen=True)
class Profile:
    likes: tuple[str, ...] = ()
    avoids: tuple[str, ...] = ()
    preferred_types: tuple[str, ...] = ()
    spice_level: int = 2
    allergy_codes: tuple[int, ...] = ()

    def validated(self, rules: Rules | None = None) -> "Profile":
        """Stripped, without repeats; ValueError where a limit is broken."""
        rules = rules or Rules()
        unique = lambda terms: tuple(dict.fromkeys(t for t in (str(v).strip() for v in terms) if t))
        likes, avoids, types = map(unique, (self.likes, self.avoids, self.preferred_types))
        codes = tuple(sorted({int(c) for c in self.allergy_codes}))
        if max(len(likes), len(avoids)) > 5:
            raise ValueError("likes and avoids may have 5 terms each")
        if not 1 <= int(self.spice_level) <= 5:
            raise ValueError("spice_level must be 1 to 5")
        if unknown := sorted(set(types) - set(rules.types)):
            raise ValueError(f"unknown menu types: {', '.join(unknown)}")
        if any(not 1 <= c <= 19 for c in codes):
            raise ValueError("allergy codes must be 1 to 19")
        return Profile(likes, avoids, types, int(self.spice_level), codes)

    def query(self) -> str:
        """Likes count twice."""
        return " ".join([*self.likes, *self.likes, *self.preferred_types])


OWN = ["similarity", "score", "reason", "cluster_name", "safety_notice", "profile", "rank"]
AT_ONCE = 32  # profiles in one plan; more make a plan for each so many
_NUTRITION = {"calories", "carbs_g", "protein_g", "fat_g", "dish_count"}


def _codes(codes) -> Column:
    return F.lit(list(codes)).cast("array<int>") if codes else F.expr(_NO_CODES)


_NO_CODES, _NO_TERMS = "cast(array() as array<int>)", "cast(array() as array<string>)"


class Ranking:
    """Some profiles' rankings of one table, as one plan. Allergy sets are groups of rows: clusters and the similarity's
    statistics are of the rows that a set leaves, each made once for all sets.

    rows are written once, and counted by set in that same pass; everything else reads that copy. key must be unique."""

    def __init__(self, rows: DataFrame, key: str, profiles: dict[str, Profile], rules: Rules | None = None):
        if missing := sorted({"menu_text", "allergy_codes", "date"} - set(rows.columns)):
            raise ValueError(f"missing columns: {', '.join(missing)}")
        self.rules, self.key = rules or Rules(), key
        self.profiles = {name: p.validated(self.rules) for name, p in profiles.items()}
        self.sets = sorted({p.allergy_codes for p in self.profiles.values()})
        self.of = [self.sets.index(p.allergy_codes) for p in self.profiles.values()]
        own = F.coalesce("allergy_codes", F.expr(_NO_CODES))
        self.safe = [~F.arrays_overlap(own, _codes(s)) if s else F.lit(True) for s in self.sets]
        seen = Observation()
        self.rows = written(rows.drop(*OWN).observe(seen, F.count("*").alias("n"), *(F.count_if(~c).alias(f"x{i}") for i, c in enumerate(self.safe))))
        told = seen.get
        self.excluded = {name: told[f"x{i}"] for name, i in zip(self.profiles, self.of, strict=True)}
        self.left = [told["n"] - told[f"x{i}"] for i in range(len(self.sets))]
        self.fits = fitted(self.rows, key, self.safe) if _NUTRITION <= set(rows.columns) else None

    def near(self) -> DataFrame:
        """The rows with their similarity to each profile's query."""
        return with_similarities(self.rows, self.key, "menu_text", [p.query() for p in self.profiles.values()], self.of, self.safe, self.left)

    def tenths(self, near: DataFrame) -> list[Column]:
        """For each profile the tenth that a safe row's score before rounding is in, else null: rounding moves it by one at most.
        Only sums of conditions on the text, so that all rows of all profiles are cheap."""
        t = X.folded(F.coalesce("menu_text", F.lit("")))
        has = lambda words: F.coalesce(X.contains_any(t, list(words)), F.lit(False)).cast("int")
        count = lambda lists: reduce(lambda a, b: a + b, map(has, lists), F.lit(0))
        hot, out = X.spice_level(F.col("menu_text"), self.rules.spice), []
        for j, p in enumerate(self.profiles.values()):
            raw = self.raw(F.get("_similarities", F.lit(j)), count([w] for w in p.likes), count(self.rules.types[c] for c in p.preferred_types), count([w] for w in p.avoids), F.abs(F.lit(p.spice_level) - hot))
            out.append(F.when(self.safe[self.of[j]], F.floor(raw * 10).cast("int")))
        return out

    @staticmethod
    def raw(similarity: Column, likes: Column, types: Column, avoids: Column, spice: Column) -> Column:
        raw = F.lit(C.BASE) + similarity * C.BY_SIMILARITY + C.BY_LIKE * likes + C.BY_TYPE * types - C.BY_AVOID * avoids - C.BY_SPICE * spice
        return F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))

    def scored(self, near: DataFrame | None = None) -> DataFrame:
        """profile, its number and the rows safe for it, with similarity and score; near: some of the rows only."""
        rules = self.rules
        terms = lambda t: F.lit(list(t)) if t else F.expr(_NO_TERMS)
        asked = F.array(*(
            F.struct(F.lit(j).alias("_j"), F.lit(name).alias("profile"), F.lit(self.of[j]).alias("_set"), terms(p.likes).alias("_likes"), terms(p.avoids).alias("_avoids"), terms(p.preferred_types).alias("_types"), F.lit(p.spice_level).alias("_level"), _codes(p.allergy_codes).alias("_codes"))
            for j, (name, p) in enumerate(self.profiles.items())
        ))
        t = F.col("menu_text")
        rows = (self.near() if near is None else near).withColumn("_text", X.folded(t)).withColumn("_found", X.menu_types(t, rules.types)).withColumn("_hot", X.spice_level(t, rules.spice))
        each = rows.select("*", F.inline(asked)).filter(~F.arrays_overlap(F.coalesce("allergy_codes", F.expr(_NO_CODES)), "_codes"))
        each = each.withColumns({
            "similarity": F.get("_similarities", F.col("_j")), "_likes": X.hits(F.col("_text"), F.col("_likes")), "_avoids": X.hits(F.col("_text"), F.col("_avoids")),
            "_types": F.filter("_types", lambda c: F.array_contains(F.col("_found"), c)), "_spice": F.abs(F.col("_level") - F.col("_hot")),
        })
        return each.withColumn("score", round1(self.raw(F.col("similarity"), F.size("_likes"), F.size("_types"), F.size("_avoids"), F.col("_spice"))))

    def explained(self, scored: DataFrame) -> DataFrame:
        """Scored rows with reason, cluster_name and safety_notice in place of what these are made of."""
        part = lambda name, words: F.when(F.size(words) > 0, F.concat(F.lit(C.REASONS[name]), F.array_join(words, ", ")))
        reason = F.concat_ws(" · ", F.concat(F.lit(C.REASONS["similarity"]), fixed2(F.col("similarity"))), part("likes", "_likes"), part("types", "_types"), part("avoids", "_avoids"), F.concat(F.lit(C.REASONS["spice"]), F.col("_spice").cast("string")))
        name = F.lit(C.TOO_FEW)
        for i, fit in enumerate(self.fits or ()):
            name = F.when(F.col("_set") == i, fit.name()).otherwise(name)
        out = scored.withColumns({"reason": reason, "cluster_name": name, "safety_notice": F.lit(C.SAFETY_NOTICE)})
        return out.select(*self.rows.columns, *OWN[:5], "profile", *(c for c in ("rank",) if c in scored.columns))

    def best(self, top: int) -> DataFrame:
        """profile, rank and each profile's `top` rows by score (as rounded), then date, then key.

        A first pass counts each profile's rows by the tenth of their score. The best ones are in the highest tenths that
        hold `top` rows, or one below, as scores are rounded. Only rows there are scored as a whole, sorted and explained."""
        near = self.near()
        tenths = self.tenths(near)
        counted = near.select(F.posexplode(F.array(*tenths)).alias("j", "tenth")).filter("tenth is not null").groupBy("j", "tenth").count()
        least, held = [-1] * len(self.profiles), [0] * len(self.profiles)
        for r in sorted(counted.collect(), key=lambda r: -r["tenth"]):  # 1,001 rows a profile at most
            if held[r["j"]] < top:
                least[r["j"]], held[r["j"]] = r["tenth"] - 1, held[r["j"]] + r["count"]
        high = reduce(lambda a, b: a | b, (F.coalesce(x >= F.lit(n), F.lit(False)) for x, n in zip(tenths, least, strict=True)))
        some = self.scored(near.filter(high))
        order = W.partitionBy("_j").orderBy(F.desc("score"), "date", self.key)
        return self.explained(some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))


def scored(rows: DataFrame, key: str, profile: Profile, rules: Rules | None = None) -> DataFrame:
    """Rows safe for the profile with similarity, score, reason, cluster_name and safety_notice. Clusters and the
    similarity's statistics are of the safe rows only. key must be unique."""
    one = Ranking(rows, key, {"": profile}, rules)
    return one.explained(one.scored()).drop("profile")


def recommend(rows: DataFrame, key: str, profile: Profile, top: int = 3, rules: Rules | None = None) -> DataFrame:
    """The `top` rows by score (as rounded), then date, then key; a bounded sort."""
    return _ranked(rows, key, {"": profile}, top, rules).drop("profile", "rank").orderBy(F.desc("score"), "date", key)


def _ranked(rows: DataFrame, key: str, profiles: dict[str, Profile], top: int, rules: Rules | None) -> DataFrame:
    if top < 1:
        raise ValueError("top must be at least 1")
    names = list(profiles)
    parts = [Ranking(rows, key, {n: profiles[n] for n in names[i : i + AT_ONCE]}, rules).best(top) for i in range(0, len(names), AT_ONCE)]
    return reduce(DataFrame.unionByName, parts)


def excluded(rows: DataFrame, profile: Profile) -> int:
    """How many rows the profile's allergy codes rule out."""
    return rows.agg(F.count_if(F.coalesce(F.arrays_overlap("allergy_codes", _codes(profile.allergy_codes)), F.lit(False))).alias("n")).first()["n"]


def profile_faults(profiles: DataFrame, rules: Rules | None = None) -> DataFrame:
    """profile, fault for each row of a table of profiles that breaks a limit: the first of terms, spice, types, codes."""
    known = F.lit(list((rules or Rules()).types))
    unique = lambda c: F.size(X.ordered_distinct(F.coalesce(c, F.expr(_NO_TERMS))))
    strange = F.size(F.array_except(X.ordered_distinct(F.coalesce("preferred_types", F.expr(_NO_TERMS))), known))
    fault = (
        F.when(F.greatest(unique("likes"), unique("avoids")) > 5, "terms").when(~F.coalesce("spice_level", F.lit(2)).between(1, 5), "spice")
        .when(strange > 0, "types").when(F.exists(F.coalesce("allergy_codes", F.expr(_NO_CODES)), lambda c: ~c.between(1, 19)), "codes")
    )
    return profiles.select("profile", fault.alias("fault")).filter("fault is not null")


def profile_table(profiles: DataFrame) -> dict[str, Profile]:
    """Profiles by name from a table (profile, likes, avoids, preferred_types, spice_level, allergy_codes); nulls count as
    empty lists and level 2. Profiles are what is asked, not data: some thousands at most."""
    lists = lambda r: [tuple(r[c] or ()) for c in ("likes", "avoids", "preferred_types")]
    rows = profiles.orderBy("profile").collect()
    if len({r["profile"] for r in rows}) < len(rows):
        raise ValueError("profiles must have different names")
    return {r["profile"]: Profile(*lists(r), 2 if r["spice_level"] is None else r["spice_level"], tuple(r["allergy_codes"] or ())) for r in rows}


def batch(rows: DataFrame, key: str, profiles: dict[str, Profile] | DataFrame, top: int = 3, rules: Rules | None = None) -> DataFrame:
    """profile, rank and the ranked rows for each of several profiles: one plan for AT_ONCE of them."""
    return _ranked(rows, key, profile_table(profiles) if isinstance(profiles, DataFrame) else profiles, top, rules)


def what_if(rows: DataFrame, key: str, profile: Profile, rules: Rules | None = None, **changes) -> DataFrame:
    """The best row of a profile beside that of the profile with some values changed."""
    return batch(rows, key, {"before": profile, "after": replace(profile, **changes)}, 1, rules)
