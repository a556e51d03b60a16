"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

1. ``targets``: a source's target is its weight's share of all words, at most
   ``CAP`` times its own words.  What a capped source leaves goes to the others
   by weight.  In the order of cap / weight, the level of a source, if those
   before it are capped, is (all words - their caps) / (weights from it on); it
   grows as long as sources are capped and shrinks after, so the final level is
   the greatest, and a target is the least of cap and level x weight.
2. ``mix``: a target of e whole times the source's words and r more takes every
   document e times.  The fractional epoch takes documents in the order of their
   keys, -ln(u) / weight with u from the hash of id and text, until r words are
   taken: sampling without replacement by weight.  The document that the budget
   ends in gives its first words only, so a long one can't overshoot.

The order is never sorted as a whole.  1 - exp(-key) puts every document into one
of ``BINS`` bins in the order of keys; words are summed by source and bin.  Running
sums over 256 runs of bins, then over the 256 bins of one run, find the bin that
the budget ends in.  Only that bin, a BINS-th of a source, is sorted by itself;
below it all is taken, above nothing.

Edge cases: null text has size 0; a source of size 0 has target 0; a null source
is one of its own, last in order; a document without a weight, or with one of 0 or less, counts as 1;
equal rows have equal keys, and which of them the budget ends in makes no
difference to the result; ids may be null or repeated; an empty table gives no
rows.  Reruns agree, whatever the partitions, but for rows that are alike in id,
text, source and weight.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm import shared

CAP, BINS = 3, 1 << 16


def size(text: str = "text") -> Column:
    """The words of a text: runs without white space, each put down as one letter with the blanks around it."""
    marks = F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.length(marks)).otherwise(F.lit(0)).cast("long")


def uniform(key: str = "doc_id", text: str = "text") -> Column:
    """In (0, 1), from 52 bits of the hash of id and text."""
    name = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return (F.conv(F.substring(F.md5(F.encode(name, "utf-8")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def in_turn(nth: Column) -> Column:
    """Weights 1, 2, 3, repeating, by place from 0."""
    return (nth % 3 + 1).cast("long")


def targets(sources: DataFrame, weight: Column, cap: int = CAP) -> DataFrame:
    """``sources`` (source, source_size; one row each) with a whole-numbered ``weight`` over the column ``nth`` (place in code-point order, null last), and target."""
    named = sources.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("weight", weight).withColumn("cap", cap * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = named.withColumn("level", left / weights)
    level = F.max("level").over(everything)
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).drop("level", "cap")


def weighed(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` (with doc_id and name) with the ``weight`` of their doc_id, the greatest of several, or 1; rows without an id are spread by their name."""
    known = weights.filter("doc_id IS NOT NULL AND weight > 0").groupBy("doc_id").agg(F.max("weight").cast("double").alias("weight")).withColumn("salt", F.lit(0))
    salt = F.when(F.col("doc_id").isNull(), F.pmod("name", F.lit(1024))).otherwise(0).cast("int")
    return rows.withColumn("salt", salt).join(known, ["doc_id", "salt"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop("salt")


def ended(sums: DataFrame, plan: DataFrame) -> DataFrame:
    """source, bin, rest, before: the bin of each source in which ``rest`` words are reached, and the words before it; ``sums`` (source, bin, words) begin at ``begin``."""
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s, p = sums.withColumn("upto", F.sum("words").over(upto)).alias("s"), plan.alias("p")
    found = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.source", "bin", "rest", (F.col("begin") + F.col("upto") - F.col("words")).alias("before"), (F.col("begin") + F.col("upto")).alias("after"))
    return found.filter("before < rest AND rest <= after").drop("after")


def mix(docs: DataFrame, weights: DataFrame | None = None, source_weight: Column | None = None, cap: int = CAP, bins: int = BINS) -> DataFrame:
    """doc_id, size, source, source_size, target, epochs (whole ones of its source) and taken of each row.

    ``weights`` (doc_id, weight) are the documents' qualities; ``source_weight`` is a source's weight over ``nth``, its place.
    """
    rows = docs.select("doc_id", "source", size().alias("size"), uniform().alias("u"), F.xxhash64("text").alias("name"))
    rows = rows.withColumn("weight", F.lit(1.0)) if weights is None else weighed(rows, weights)
    rows = rows.withColumn("key", -F.log("u") / F.col("weight")).drop("u", "weight")
    rows = rows.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * bins), F.lit(bins - 1)).cast("int"))
    rows = shared.table(rows, "mixing-rows")
    binned = shared.table(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mixing-bins")
    sources = targets(binned.groupBy("source").agg(F.sum("words").alias("source_size")), in_turn(F.col("nth")) if source_weight is None else source_weight, cap)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    plan = shared.table(sources.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mixing-targets")

    wide = isqrt(bins - 1) + 1
    coarse = binned.groupBy("source", F.floor(F.col("bin") / wide).alias("bin")).agg(F.sum("words").alias("words"))
    start = shared.table(ended(coarse, plan.withColumn("begin", F.lit(0).cast("long"))), "mixing-runs")
    fine = binned.join(start.select(F.col("source").alias("of"), F.col("bin").alias("run")), F.col("source").eqNullSafe(F.col("of")) & (F.floor(F.col("bin") / wide) == F.col("run")))
    edge = ended(fine.select("source", "bin", "words"), start.select("source", "rest", F.col("before").alias("begin")))
    p, e = plan.alias("p"), edge.alias("e")
    plan = shared.table(p.join(e, F.col("p.source").eqNullSafe(F.col("e.source")), "left").select("p.*", F.coalesce("e.bin", F.lit(-1)).alias("edge"), "e.before"), "mixing-plan").alias("p")

    dealt = rows.alias("r").join(plan, F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", "p.source_size", "p.target", "p.epochs", "p.rest", "p.edge", "p.before")
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "name", "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.filter("bin = edge").withColumn("before", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    ends = ends.withColumn("more", F.least("size", F.greatest(F.col("rest") - F.col("before"), F.lit(0))))
    others = dealt.filter("bin <> edge").withColumn("more", F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(0))
    taken = F.col("epochs") * F.col("size") + F.col("more")
    return ends.unionByName(others).select("doc_id", "size", "source", "source_size", "target", "epochs", taken.alias("taken"))


def quality(labels: DataFrame) -> DataFrame:
    """Weights of labelled documents: 2 where a label calls one good, else 1/2."""
    return labels.filter("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))
