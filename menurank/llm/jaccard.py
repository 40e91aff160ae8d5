"""N-gram Jaccard join: a grouped prefix join over sets of word n-grams, and the components that its links make.

1. Texts with equal sets are one class. Classes with the same size and the same prefix are one group.
2. A prefix holds a set's first n - ceil(t*n) + 1 members in one global order, rare ones first: members that share a
   prefix member only can reach the threshold t. The order is by counts over the whole corpus, kept in a table of hash
   slots whose size follows the corpus, then by hash; any order is right, this one keeps posting lists short.
3. Group pairs that share a prefix member and pass the filters by size, by place (which know how many prefix members a
   group has alone) and by sketch are expanded to classes and verified on whole sets. For components not every pair matters:
   first each group is checked against the most copied group of each of its lists, its predecessor there, and each class
   against its group's first. Then only those pairs are left whose classes are in different components by then; these
   are all verified. So no link between components is missed, and a cluster of near copies costs about one check a
   member, not one a pair.

A posting list that is long, by its own count, is dealt into blocks by a hash of the group; blocks' firsts are compared with each
other. What is left of a list is classed by size, and only classes whose sizes may link are compared, block against block.
No list is ever in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cached, drop, forget, slices, stored, table, word_hashes
from .graph import components

LEAST_BITS, MOST_BITS, CHUNKS = 20, 24, 64
SKETCH = 4  # longs
ROUNDS, MANY = 2, 8
BLOCK = 2048  # groups of a posting list in one block
BROADCAST_IDS = 1_000_000  # 16 MB; only the plan depends on it, not the result


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """For each text of an Arrow column the ascending array of its distinct n-grams' 64-bit hashes.

    Words are what ASCII white space parts, A-Z lower-cased. A text of fewer words has one n-gram of all of them; one
    without words has none.
    """
    from xxhash import xxh3_64_intdigest

    h, firsts = word_hashes(column)
    n = max(0, len(h) - width + 1)
    s = h[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, width):
        s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    s = (s ^ (s >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    s ^= s >> np.uint64(30)
    out = []
    for a, b in zip(firsts.tolist(), firsts[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        else:
            out.append(np.array([xxh3_64_intdigest(h[a:b].tobytes())], np.uint64) if b > a else h[:0])
    return out


def slot_counts(texts: DataFrame, width: int, bits: int) -> np.ndarray:
    """How many n-grams (a text counts once for an n-gram) fall in each of 2**bits hash slots, up to 2**32 - 1. Each task
    adds up its own counts; sums are made in CHUNKS parts."""

    def count(batches):
        import pyarrow as pa

        counts = np.zeros(1 << bits, np.uint32)
        for big in batches:
            for b in slices(big):
                for s in shingle_sets(b.column("text"), width):
                    np.add.at(counts, (s & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        chunks = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in counts.reshape(CHUNKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(chunks, pa.binary())], ["chunk", "counts"])

    each = (1 << bits) // CHUNKS

    def total(key, chunks):
        import pyarrow as pa

        sums = np.zeros(each, np.uint64)
        for b in chunks:
            for x in b.column("counts").to_pylist():
                sums += np.frombuffer(pa.decompress(x, 4 * each, "zstd", asbytes=True), np.uint32)
        held = np.minimum(sums, 2**32 - 1).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["chunk", "counts"])

    from collections.abc import Iterator

    import pyarrow as pa

    total.__annotations__ = {"key": tuple[pa.Scalar, ...], "chunks": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    rows = texts.select("text").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(total, "chunk int, counts binary").collect()
    counts = np.zeros((CHUNKS, each), np.uint32)
    for r in rows:  # 4 * 2**bits bytes in all, 64 MB at most
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.uint32)
    return counts.ravel()


def coded(counts: np.ndarray) -> np.ndarray:
    """A byte for each slot, of count c: about 8 * log2(c + 1), rounded up; the order of members is by it."""
    return np.minimum(255, np.ceil(8 * np.log2(counts.astype(float) + 1))).astype(np.uint8)


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """doc_id and its set, as an ascending array of longs."""

    def make(batches):
        import pyarrow as pa

        for big in batches:
            for b in slices(big):
                got = shingle_sets(b.column("text"), width)
                offsets = np.cumsum([0, *map(len, got)], dtype=np.int32)
                members = np.concatenate([*got, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(offsets, members)], ["doc_id", "members"])

    return texts.select("doc_id", "text").mapInArrow(make, "doc_id long, members array<long>")


def sketch(members: np.ndarray) -> np.ndarray:
    """64 * SKETCH bits: whether an odd number of members falls on each. Two sets' sketches differ in no more bits than
    the sets in members, so sketches too different rule a pair out."""
    odd = np.bincount((members >> np.uint64(50)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(texts: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n, the set's and its prefix's 128-bit signatures (two longs each), its sketch, its prefix in the global order, and where
    in that order the prefix ends (a long of the level and 55 bits of the hash)."""
    told = texts.sparkSession.sparkContext.broadcast(levels)  # a byte a slot
    mask = np.uint64(len(levels) - 1)

    def make(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        levels = told.value
        for big in batches:
            for b in slices(big):
                sizes, signs, begins, sketches, heads, ends = [], [], [], [], [], []
                for s in shingle_sets(b.column("text"), width):
                    n = len(s)
                    first = n - (percent * n + 99) // 100 + 1 if n else 0
                    level = levels[(s & mask).astype(np.int64)]
                    order = np.argsort(level, kind="stable")[:first]
                    sizes.append(n)
                    signs.append(xxh3_128_digest(s.tobytes()))
                    sketches.append(sketch(s))
                    begins.append(xxh3_128_digest(s[order].tobytes()))
                    heads.append(s[order].view(np.int64))
                    ends.append((int(level[order[-1]]) << 55) + (int(s[order[-1]]) >> 9) if first else -1)
                sign, begin = (np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (signs, begins))
                offsets = np.cumsum([0, *map(len, heads)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(offsets, np.concatenate([*heads, np.zeros(0, np.int64)]))
                columns = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sign[:, 0]), pa.array(sign[:, 1]), pa.array(begin[:, 0]), pa.array(begin[:, 1]), pa.ListArray.from_arrays(np.arange(len(sketches) + 1, dtype=np.int32) * SKETCH, np.concatenate(sketches)), lists, pa.array(ends, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2", "p1", "p2", "sketch", "prefix", "last"])

    return texts.select("doc_id", "text").mapInArrow(make, "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, sketch array<long>, prefix array<long>, last long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold; a pair may come twice where a doc_id has several rows. Both
    joins are plain, so that Spark may split the pairs of a hub."""
    ids = cached(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    few = ids.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = sets_of(wanted, width)
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    out = stored(both.filter((100 + percent) * F.col("i") >= percent * (F.size("x") + F.size("y"))).select("a", "b"))
    drop(ids)
    return out


def reachable(x: str, y: str, percent: int):
    """Whether two groups may be linked that share a member of their prefixes, if it is the first that they share.

    Linked groups share a first member, so they pass at that one. After it, all the rest may be shared, but of the group
    whose prefix ends first in the global order only what another group's prefix holds too (rank counts these) and what
    lies beyond its prefix: what no other prefix holds, the other set lacks."""
    c = lambda side, name: F.col(f"{side}.{name}")
    rest = lambda side: c(side, "n") - c(side, "at") - 1
    known = lambda side: c(side, "held") - c(side, "rank") - 1 + c(side, "tail")
    after = F.when(c(x, "last") <= c(y, "last"), F.least(known(x), rest(y))).otherwise(F.least(rest(x), known(y)))
    most = 1 + after
    sizes = (100 * F.least(c(x, "n"), c(y, "n"))) >= percent * F.greatest(c(x, "n"), c(y, "n"))
    unlike = sum((F.bit_count(F.get(c(x, "sketch"), F.lit(i)).bitwiseXOR(F.get(c(y, "sketch"), F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    close = F.coalesce((100 + percent) * unlike <= (100 - percent) * (c(x, "n") + c(y, "n")), F.lit(True))  # a group of several classes has no sketch
    return sizes & ((100 + percent) * most >= percent * (c(x, "n") + c(y, "n"))) & close


def dealt(posted: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """posted (k, at, token) with blocks and block: lists of more than `block` postings are dealt into blocks by a hash of k.

    A list's length is its own count, whatever share of the corpus a token's slot has, so a rare token's list is one block. Only
    lengths of long lists meet the postings again: there are at most postings / block of them, cached, which come second."""
    long = cached(posted.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("token", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    few = long.count() <= BROADCAST_IDS
    out = posted.join(F.broadcast(long) if few else long, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return out.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("k"), "blocks").cast("int")).otherwise(0)), long


def paired(rows: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Left and right rows of lists (token, n, g and more) with a key `meet`: two rows of a list whose sizes may link have
    one key in common, left and right, and no two others than those.

    Rows of a list are classed by size, so that linked ones are of one class or of neighbouring ones. A class of more rows than
    `block` is dealt into blocks, by its own count; a row is repeated once a block it meets, which are one or two in
    lists that aren't long."""
    width = float(np.log(100 / percent)) * (1 + 1e-9)
    sized = rows.withColumn("size", F.floor(F.log("n") / width).cast("int"))
    order = W.partitionBy("token").orderBy("size")  # a list's classes: as many as its sizes have powers
    counts = sized.groupBy("token", "size").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    beside = lambda f, step: F.when(f("size").over(order) == F.col("size") + step, f("parts").over(order))
    counts = counts.withColumn("up", beside(F.lead, 1)).withColumn("down", beside(F.lag, -1))
    placed = sized.join(counts, ["token", "size"]).withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("g"), "parts").cast("int")).otherwise(0))
    key = lambda kind, size, i, j: F.struct(F.lit(kind).alias("kind"), size.alias("size"), i.alias("i"), j.alias("j"))
    none = F.expr("cast(array() as array<struct<kind: int, size: int, i: int, j: int>>)")
    size, part = F.col("size"), F.col("part")
    right_of = F.concat(F.transform(F.sequence(part, F.col("parts") - 1), lambda j: key(0, size, part, j)), F.coalesce(F.transform(F.sequence(F.lit(0), F.col("up") - 1), lambda j: key(1, size, part, j)), none))
    left_of = F.concat(F.transform(F.sequence(F.lit(0), part), lambda i: key(0, size, i, part)), F.coalesce(F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: key(1, size - 1, i, part)), none))
    return placed.withColumn("meet", F.explode(right_of)), placed.withColumn("meet", F.explode(left_of))


def jaccard_classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: sets of word `width`-grams, linked from percent/100.

    component_id is the least doc_id reachable. Null and empty texts have empty sets and are linked with nothing. Rows
    that share a doc_id are parts of one document: links of each count for all, if their sets aren't equal. Rows with
    a null doc_id link to nothing and have no component. Texts of any length are read whole, in slices bounded by bytes.
    An empty table gives no rows. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = min(MOST_BITS, max(LEAST_BITS, docs.count().bit_length() + 1))
    every = stored(prefixes(texts, width, percent, coded(slot_counts(texts, width, bits))))
    one = lambda c: F.min_by(c, "p1").alias(c)  # noqa: E731  equal in a class
    some = every.filter("n > 0 and doc_id is not null")
    classes = stored(some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min("p1").alias("p1"), F.min("p2").alias("p2")))
    top = F.min(F.struct("id", "s1", "s2")).alias("top")
    groups = stored(classes.groupBy("n", "p1", "p2").agg(top, F.sum("copies").alias("copies"), F.count("*").alias("many")).select("n", "p1", "p2", F.col("top.id").alias("g"), "top.s1", "top.s2", "copies", "many"))
    member = stored(classes.select("n", "p1", "p2", "id").join(groups.select("n", "p1", "p2", "g"), ["n", "p1", "p2"]).select("id", "n", "g"))
    # Prefixes move once, for the first class of each group; k numbers the groups.
    whole = some.groupBy("doc_id", "n", "s1", "s2").agg(one("sketch"), one("prefix"), F.min("last").alias("last")).withColumnRenamed("doc_id", "g")
    whole = whole.join(groups.drop("p1", "p2"), ["g", "n", "s1", "s2"]).withColumn("sketch", F.when(F.col("many") == 1, F.col("sketch")))
    whole = stored(whole.select(F.monotonically_increasing_id().alias("k"), "g", "n", "copies", "last", (F.col("n") - F.size("prefix")).alias("tail"), "sketch", "prefix"))
    facts = whole.drop("prefix")

    # Blocks of posting lists of two or more groups (or of long lists), then what each group can share at all. Postings
    # are numbers; what is known of their groups is joined to those that are shared.
    lists = W.partitionBy("token", "block").orderBy("k")
    posted, long = dealt(whole.select("k", F.posexplode("prefix").alias("at", "token")), BLOCK)
    posted = posted.withColumn("before", F.lag("k").over(lists)).withColumn("after", F.lead("k").over(lists))
    posted = stored(posted.filter("before is not null or after is not null or blocks > 1").drop("before", "after"))
    drop(long)
    own = W.partitionBy("k")
    shared = stored(posted.withColumn("rank", F.row_number().over(own.orderBy("at")) - 1).withColumn("held", F.count("*").over(own)))
    forget(posted, groups)
    place = F.struct("g", "n", "last", "tail", "sketch", "at", "rank", "held")
    lists = W.partitionBy("token", "block").orderBy(F.desc("copies"), "n", "k")
    beside = shared.join(facts, "k").withColumn("first", F.first(place).over(lists)).withColumn("before", F.lag(place).over(lists)).withColumn("own", place)

    apart = ~((F.col("x.low") == F.col("y.high")) & (F.col("x.high") == F.col("y.low")))

    def linked(to: str):
        """The pair of own and to, if the two may be linked."""
        ok = F.col(to).isNotNull() & reachable("own", to, percent) & (F.col(f"{to}.g") != F.col("own.g"))
        return F.when(ok, F.struct(F.least("own.g", f"{to}.g").alias("a"), F.greatest("own.g", f"{to}.g").alias("b")))

    head = F.when((F.col("blocks") > 1) & F.col("before").isNull(), F.struct("token", "copies", "own"))  # a row for each block
    beside = stored(beside.select(linked("first").alias("p"), linked("before").alias("q"), head.alias("head")).filter("p is not null or q is not null or head is not null"))
    heads = beside.filter("head is not null").select("head.*")
    heads = heads.withColumn("first", F.first("own").over(W.partitionBy("token").orderBy(F.desc("copies"), "own.n", "own.g"))).select(linked("first").alias("p"))
    spokes = member.filter("id <> g").select(F.col("g").alias("a"), F.col("id").alias("b"))
    near = [x.filter(f"{c} is not null").select(f"{c}.*") for x, c in ((beside, "p"), (beside, "q"), (heads, "p"))]
    tried = stored(near[0].union(near[1]).union(near[2]).union(spokes).distinct())
    links = verified(tried, texts, width, percent)
    forget(beside)
    old = [shared, whole, member, tried, links]

    # Lists that hold several components. While they have many pairs for their rows, neighbours in a random order of
    # each list are tried: groups with many links soon are one component, and their other pairs needn't be made.
    turn, pairs_before = 0, None
    while True:
        found = stored(components(links))
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))  # say all that links said
        known = stored(member.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "g", F.coalesce("component", "id").alias("c")))
        span = cached(known.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high")))
        spread = shared.join(facts.drop("copies").join(span, "g"), "k").drop("k")
        mixed = spread.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h").select("token")
        open_ = stored(spread.join(mixed, "token"))
        old += [found, known, open_]
        size = open_.groupBy("token").count().agg(F.sum("count").alias("rows"), F.sum(F.expr("count * (count - 1) / 2")).alias("pairs")).first()
        rows_left, pairs_left = size["rows"] or 0, size["pairs"] or 0
        if pairs_left <= MANY * rows_left or turn >= ROUNDS and pairs_left > 0.7 * pairs_before:
            break
        turn, pairs_before = turn + 1, pairs_left
        drop(span)
        own = F.struct(*(c for c in open_.columns if c not in ("token", "blocks", "block")))
        before = F.lag(own).over(W.partitionBy("token", "block").orderBy(F.xxhash64("g", "token", F.lit(turn))))
        beside = open_.select(own.alias("x"), before.alias("y")).filter(apart & reachable("x", "y", percent))
        more = stored(beside.select(F.least("x.g", "y.g").alias("a"), F.greatest("x.g", "y.g").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        got = verified(more, texts, width, percent)
        tried, links = tried.union(more), stars.union(got)
        old += [more, got]

    # All pairs whose classes are still in different components, and classes of one group that are.
    lefts, rights = paired(open_.drop("block", "blocks"), percent, BLOCK)
    x, y = lefts.alias("x"), rights.alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.meet") == F.col("y.meet"))
    once = (F.col("x.meet.kind") == 1) | (F.col("x.meet.i") < F.col("x.meet.j")) | (F.col("x.g") < F.col("y.g"))
    pairs = x.join(y, same & once & apart & reachable("x", "y", percent)).select(F.least("x.g", "y.g").alias("g1"), F.greatest("x.g", "y.g").alias("g2"))
    inner = span.filter("low <> high").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    pairs = cached(pairs.union(inner).distinct())
    one, two = known.select(F.col("g").alias("g1"), F.col("id").alias("i1"), F.col("c").alias("c1")), known.select(F.col("g").alias("g2"), F.col("id").alias("i2"), F.col("c").alias("c2"))
    rest = pairs.join(one, "g1").join(two, "g2").filter("c1 <> c2").select(F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b")).distinct()
    rest = cached(rest.join(tried, ["a", "b"], "left_anti"))
    more = verified(rest, texts, width, percent)
    final = stored(components(stars.union(more)))
    forget(*old, more)
    drop(pairs, rest, span)

    named = classes.select("n", "s1", "s2", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("c"))
    out = every.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def op2_jaccard(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"), 4, 85)


ORACLE = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') l from documents),
s as (select doc_id, list_distinct(case when len(l) = 0 then []::varchar[] when len(l) < 4 then [array_to_string(l, ' ')]
  else list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i : i + 3], ' ')) end) s from w),
n as (select doc_id, len(s) n from s),
e as (select doc_id, unnest(s) g from s),
p as (select x.doc_id a, y.doc_id b, count(*) i from e x join e y on x.g = y.g and x.doc_id < y.doc_id group by all),
link as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
two as (select a, b from link union select b, a from link),
reach(d, r) as (select doc_id, doc_id from documents union select two.b, r from reach join two on two.a = reach.d)
select n.doc_id, n.n::bigint as n_shingles, min(r) as component_id from n join reach on d = n.doc_id group by all"""

QUERIES = {"op2_jaccard": op2_jaccard}
SQL = {"op2_jaccard": ORACLE}
