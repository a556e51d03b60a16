"""A taste model: TF-IDF vectors in long form, centroids of liked and disliked texts, bounded cosine scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) over words of letters and digits of three characters or more."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2)
    return df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def weigh(tf: DataFrame, key: str, n: DataFrame) -> DataFrame:
    """(key, term, w): tf x ln((1 + n) / (1 + df)), each vector of length one. ``n``: a one-row frame with column n."""
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = tf.join(df_, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * F.log((1 + F.col("n")) / (1 + F.col("df"))))  # one row on the right
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms.filter("norm > 0"), key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def centroid(vectors: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(term, w): the mean vector of the members, of length one."""
    mean = vectors.join(members.select(key), key, "left_semi").groupBy("term").agg(F.sum("w").alias("w"))
    length = mean.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return mean.crossJoin(F.broadcast(length)).filter("norm > 0").select("term", (F.col("w") / F.col("norm")).alias("w"))  # one row on the right


def cosine(vectors: DataFrame, center: DataFrame, key: str, name: str) -> DataFrame:
    return vectors.join(center.withColumnRenamed("w", "cw"), "term").groupBy(key).agg(F.sum(F.col("w") * F.col("cw")).alias(name))


def taste(liked: Column, disliked: Column, low: float = -0.10, high: float = 0.15) -> Column:
    """Bounded: 0.3 of the liked cosine less 0.2 of the disliked one."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.greatest(F.lit(low), F.least(F.lit(high), 0.3 * zero(liked) - 0.2 * zero(disliked)))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of floats, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
