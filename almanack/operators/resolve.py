"""Entity resolution: which rows are one event, and what the merged row holds.

Exact passes group by a key.  Pair passes join rows within a block on the
distinct words that they share, so pairs without common words never meet, and
keep what the similarity rule says.  Greedy passes keep the order-dependent
semantics of a walk over each block; a block of over ``GREEDY_ROWS`` rows gets
the same clusters by rounds over its pairs.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions import scores, text
from almanack.sources import tables

GREEDY_ROWS = 5000


def merge(df: DataFrame, by: str, latest: str, order: str, rules: dict[str, str]) -> DataFrame:
    """One row for each ``by``: longest, latest non-null, first non-null, union, any, most, as the rules say for each column.

    All are aggregates with partial results, but for the unions of arrays.
    """
    c = F.col
    how = {
        "longest": lambda n: F.max_by(n, F.struct(F.length(F.coalesce(c(n), F.lit(""))), c(order))),
        "latest": lambda n: F.max_by(n, F.when(c(n).isNotNull(), F.struct(c(latest), c(order)))),
        "first": lambda n: F.min_by(n, F.when(c(n).isNotNull(), c(order))),
        "union": lambda n: F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))),
        "set": lambda n: F.array_sort(F.collect_set(n)),
        "any": lambda n: F.coalesce(F.bool_or(n), F.lit(False)),
        "most": lambda n: F.max(n),
        "least": lambda n: F.min(n),
    }
    return df.groupBy(by).agg(*(how[rule](n).alias(n) for n, rule in rules.items()), F.count("*").alias("merged"))


def image_key(url: Column, day: Column) -> Column:
    """Rows of a day with the same image, query aside; null for short urls."""
    plain = F.substring_index(url, "?", 1)
    return F.when(F.length(plain) >= 30, F.concat_ws("|", plain, day.cast("string")))


def similar_pairs(df: DataFrame, key: str, block: list[str], tokens: str, least: float = 0.55, shared: int = 2) -> DataFrame:
    """Pairs (a < b) of a block with at least ``shared`` common words and a Jaccard similarity of ``least``.

    Prefix filtering, which is exact: with a set's n words ordered from the
    rarest of the block on, two sets of that similarity share one of their first
    n - max(ceil(least x n), shared) + 1 words.  So rows meet by an equi-join on (block, rare
    word), and frequent words bring nobody together.  Rows with equal word sets
    are joined once, by a representative, and come back as links to it.
    """
    sized = df.select(F.col(key).alias("k"), *block, F.array_sort(tokens).alias("t")).filter(F.size("t") > 0)
    reps = sized.groupBy(*block, "t").agg(F.min("k").alias("k"))
    copies = sized.join(reps.withColumnRenamed("k", "a"), [*block, "t"]).filter("k > a").select("a", F.col("k").alias("b"), F.size("t").alias("common"), F.lit(1.0).alias("similarity")).filter(F.col("common") >= shared)
    words = reps.select("k", *block, F.explode("t").alias("w"))
    often = words.groupBy(*block, "w").agg(F.count("*").alias("c"))
    ranked = words.join(often, [*block, "w"]).groupBy("k", *block).agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("r"))
    n = F.size("r")
    first = ranked.select("k", *block, F.transform("r", lambda x: x["w"]).alias("t"), F.explode(F.slice(F.col("r"), 1, F.greatest(n - F.greatest(F.ceil(n * F.lit(least) - 1e-9).cast("int"), F.lit(shared)) + 1, F.lit(0)))).alias("x")).select("k", *block, "t", F.col("x.w").alias("w"))
    left, right = first.select(*block, "w", F.col("k").alias("a"), F.col("t").alias("ta")), first.select(*block, "w", F.col("k").alias("b"), F.col("t").alias("tb"))
    near = left.join(right, [*block, "w"]).filter("a < b").withColumn("common", F.size(F.array_intersect("ta", "tb"))).withColumn("similarity", F.col("common") / (F.size("ta") + F.size("tb") - F.col("common")))
    return copies.unionByName(near.filter((F.col("common") >= shared) & (F.col("similarity") >= least)).select("a", "b", "common", "similarity").distinct())


def _greedy_rounds(rows: DataFrame, least: float, shared: int) -> DataFrame:
    """k and cluster as the walk gives them, for blocks of any size. ``rows``: k, o (the order), g (the block), t (sorted words).

    Rows with equal words join the same head, so word sets are walked, by their
    first rows.  A set is a head once no earlier similar set can be one; the sets
    similar to a head are none.  Each round settles some, until no link is open.
    """
    sets = tables.settle(rows.groupBy("g", "t").agg(F.min(F.struct("o", "k")).alias("h")), "greedy-sets")
    near = similar_pairs(sets, "h", ["g"], "t", max(0.0, least - 1e-9), shared)
    links = tables.settle(near.filter(F.col("common") >= F.lit(least) * F.round(F.col("common") / F.col("similarity"))).select("a", "b"), "greedy-links")
    open_, none = links, links.select("b").limit(0)
    while not open_.isEmpty():
        heads = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        covered = tables.settle(open_.join(heads, "a").select("b").distinct(), "greedy-covered")
        none = none.unionByName(covered)
        open_ = tables.settle(open_.join(covered, "b", "left_anti").join(covered.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b"), "greedy-open")
    joined = links.join(none.withColumnRenamed("b", "a"), "a", "left_anti").groupBy(F.col("b").alias("h")).agg(F.min("a").alias("head"))
    found = sets.join(joined, "h", "left").select("g", "t", F.coalesce("head", "h").alias("head"), F.col("head").isNotNull().alias("moved"))
    alone = (F.size("t") < max(shared, 1)) & ~F.col("moved")
    return rows.join(found, ["g", "t"]).select("k", F.when(alone, F.col("k")).otherwise(F.col("head.k")).alias("cluster"))


def greedy_clusters(df: DataFrame, key: str, block: list[str], tokens: str, order: str, least: float = 0.55, shared: int = 2) -> DataFrame:
    """key and cluster (the first row's key): rows in order join the first earlier cluster head that they resemble."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["o", "k"])
        heads: list[tuple] = []
        found = []
        for k, words in zip(frame["k"], frame["t"]):
            words = set(words)
            for head, other in heads:
                both = len(words & other)
                if both >= shared and both >= least * len(words | other):
                    found.append((k, head))
                    break
            else:
                heads.append((k, words))
                found.append((k, k))
        return pd.DataFrame(found, columns=["k", "cluster"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.to_json(F.struct(*block)).alias("g"), F.array_sort(F.array_distinct(tokens)).alias("t"))
    large = tables.settle(rows.groupBy("g").count().filter(F.col("count") > GREEDY_ROWS).select("g"), "greedy-large")
    out = rows.join(large, "g", "left_anti").groupBy("g").applyInPandas(walk, f"k {kind}, cluster {kind}")
    if not large.isEmpty():
        out = out.unionByName(_greedy_rounds(rows.join(large, "g", "left_semi"), least, shared))
    return out.select(F.col("k").alias(key), "cluster")


def hamming_pairs(df: DataFrame, key: str, block: list[str], hashes: str, most: int = 5) -> DataFrame:
    """Pairs of a block whose 64-bit hashes differ in at most ``most`` bits.

    The hash is cut into most + 1 bands; two such hashes agree in one of them,
    so an equi-join on (block, band) finds all pairs.  Rows with equal hashes are
    joined once, by the least of them, and come back as links to it.
    """
    df = df.select(F.col(key).alias("k"), *block, F.col(hashes).alias("h")).filter("h IS NOT NULL")
    reps = df.groupBy(*block, "h").agg(F.min("k").alias("k"))
    copies = df.join(reps.withColumnRenamed("k", "a"), [*block, "h"]).filter("k > a").select("a", F.col("k").alias("b"), F.lit(0).alias("distance"))
    n = most + 1
    cuts = [i * 64 // n for i in range(n + 1)]
    bands = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.col("h"), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))))
    rows = reps.select("k", *block, "h", F.explode(bands).alias("band"))
    a, b = rows.select(*block, "band", F.col("k").alias("a"), F.col("h").alias("ha")), rows.select(*block, "band", F.col("k").alias("b"), F.col("h").alias("hb"))
    met = a.join(b, [*block, "band"]).filter("a < b").select("a", "b", scores.hamming(F.col("ha"), F.col("hb")).alias("distance"))
    return copies.unionByName(met.filter(F.col("distance") <= most).distinct())


def hamming_members(df: DataFrame, key: str, block: list[str], hashes: str, most: int = 5) -> DataFrame:
    """All pairs of rows (a < b) of a block whose hashes differ in at most ``most`` bits, copies too: classes of equal hashes are compared once, then both sides' rows stand for them."""
    rows = df.select(F.col(key).alias("k"), *block, F.struct(*block, F.col(hashes).alias("h")).alias("c")).dropna(subset=block).filter("c.h IS NOT NULL")
    classes = rows.select("c", *block, F.col("c.h").alias("h")).distinct()
    near = hamming_pairs(classes, "c", block, "h", most)
    met = near.unionByName(classes.select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(0).alias("distance")))
    of = lambda c, k: rows.select(F.col("c").alias(c), F.col("k").alias(k))
    both = met.join(of("a", "x"), "a").join(of("b", "y"), "b").filter((F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & (F.col("a") != F.col("b"))))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def sign_hash(vector: Column) -> Column:
    """A 64-bit hash with a bit for each of 64 values: 1 if it is above the mean of them (an average hash)."""
    mean = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(vector)
    bits = F.transform(vector, lambda x, i: F.when(x.cast("double") > mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def collapse_spam(df: DataFrame, title: str, url: str, day: str, order: str, least: int = 4, recurring: Column | None = None) -> DataFrame:
    """Of ``least`` or more rows with one title (80 characters) and url the earliest stays, unless they recur; ``order`` tells rows of a day apart. Groups are counted by aggregates, so a frequent title is never sorted in a task."""
    named = df.withColumn("__title", F.substring(F.lower(title), 1, 80)).withColumn("__url", F.coalesce(F.substring_index(url, "?", 1), F.lit(""))).withColumn("__at", F.struct(F.col(day).alias("day"), F.col(order).alias("order")))
    recurs = F.lit(False) if recurring is None else F.coalesce(F.bool_or(recurring), F.lit(False))
    groups = named.groupBy("__title", "__url").agg(F.count("*").alias("__n"), recurs.alias("__recurs"), F.min("__at").alias("__first"))
    spam = groups.filter((F.col("__n") >= least) & ~F.col("__recurs")).select(F.col("__title").alias("__t"), F.col("__url").alias("__u"), "__first")
    met = named.join(spam, F.col("__title").eqNullSafe(F.col("__t")) & (F.col("__url") == F.col("__u")), "left")
    return met.filter(F.col("__first").isNull() | (F.col("__at") == F.col("__first"))).select(*df.columns)


def same_series(day_a: Column, day_b: Column, a: Column, b: Column) -> Column:
    """Rows of one publisher on different days that are one recurring event."""
    both, share = F.size(F.array_intersect(a, b)), scores.jaccard(a, b)
    return (day_a != day_b) & ((share >= 0.75) | (both >= 4) | ((share >= 0.9) & (both >= 2)))


def tokens_of(df: DataFrame, title: str, name: str = "tokens") -> DataFrame:
    return df.withColumn(name, text.title_tokens(F.col(title)))


