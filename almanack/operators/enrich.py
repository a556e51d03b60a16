"""Derived columns: categories, neighbourhoods, provenance, reasons, highlights, default images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions import rules, text
from almanack.operators import phrases, relational


def categories(content: Column, table: dict[str, list[str]], short: int = 5) -> Column:
    """The categories whose keywords the text has, in the table's order; 'other' if none. Keywords of up to ``short`` characters count as whole words only."""
    low = F.lower(F.coalesce(content, F.lit("")))

    def found(words: list[str]) -> Column:
        return low.rlike(rules.any_of([w for w in words if len(w) <= short], True)) | low.rlike(rules.any_of([w for w in words if len(w) > short]))

    have = F.array_compact(F.array(*(F.when(found(words), name) for name, words in table.items())))
    return F.when(F.size(have) == 0, F.array(F.lit("other"))).otherwise(have)


def neighborhood(explicit: Column, venue: Column, content: Column, venues: list[tuple[str, str]], words: list[tuple[str, str]]) -> Column:
    """A stated neighbourhood, else the longest venue key in the venue, else the first keyword of the text; else null."""
    v, t = F.lower(F.coalesce(venue, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    by_length = sorted(venues, key=lambda x: (-len(x[0]), x[0]))
    nothing = F.lit(None).cast("string")
    return F.coalesce(explicit, *(F.when(v.contains(k), h) for k, h in by_length), *(F.when(t.rlike(rules.any_of([k], True)), h) for k, h in words), nothing)


def longest_match(df: DataFrame, key: str, content: str, table: DataFrame, needle: str, value: str) -> DataFrame:
    """key and the value of the longest needle in the text (ties: first by name); rows without one are absent. Few needles go to all rows as one array, more are joined."""
    if relational.few(table):
        bag = table.agg(F.sort_array(F.collect_list(F.struct((-F.length(needle)).alias("o"), F.col(needle).alias("n"), F.col(value).alias("v")))).alias("bag"))
        hit = F.try_element_at(F.filter("bag", lambda r: F.contains(F.col(content), r["n"])), F.lit(1))
        return df.crossJoin(F.broadcast(bag)).select(key, hit["v"].alias(value), hit["n"].alias(needle)).filter(F.col(value).isNotNull())  # one row on the right
    met = phrases.found_needles(df, key, content, table, needle).join(table, needle)
    best = met.groupBy(key).agg(F.min(F.struct((-F.length(needle)).alias("o"), F.col(needle).alias("n"), F.col(value).alias("v"))).alias("x"))
    return best.select(key, F.col("x.v").alias(value), F.col("x.n").alias(needle)).filter(F.col(value).isNotNull())


def provenance(df: DataFrame, key: str, candidates: list[tuple[int, str]], follows: DataFrame) -> DataFrame:
    """The first followed handle among a row's candidates, in order of priority: key, handle, via. ``follows``: handle."""
    tried = None
    for priority, column in candidates:
        one = df.select(key, F.lit(priority).alias("via"), F.explode(text.handle_variants(F.col(column))).alias("handle"))
        tried = one if tried is None else tried.unionByName(one)
    hit = tried.join(relational.small(follows.select(text.fold(F.col("handle")).alias("handle")).distinct()), "handle")
    return hit.groupBy(key).agg(F.min(F.struct("via", "handle")).alias("m")).select(key, "m.handle", "m.via")


def default_image(df: DataFrame, images: DataFrame) -> DataFrame:
    """Rows without an image get their source's."""
    i = relational.small(images.select("source", F.col("image_url").alias("__i")))
    return df.join(i, "source", "left").withColumn("image_url", F.coalesce(F.when(F.length("image_url") > 0, F.col("image_url")), "__i")).drop("__i").select(*df.columns)


def reasons(*ranked: tuple[Column, str]) -> Column:
    """The first three labels whose condition holds, without repeats."""
    return F.slice(F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(label)) for c, label in ranked)))), 1, 3)


def title_prefix(title: Column, cats: Column) -> Column:
    """A bare line-up of names at a comedy event is called one; a bare 'X by Y' at a book club, too."""
    names = F.split(title, r"\s*,\s*")
    lineup = (F.size(names) >= 3) & F.forall(names, lambda n: n.rlike(r"^[A-Z][\w'.-]+(?: [A-Z][\w'.-]+){1,2}$"))
    book = title.rlike(r"^[A-Z].{2,60} by [A-Z][\w'.-]+(?: [A-Z][\w'.-]+){0,3}$")
    return F.when(F.array_contains(cats, "comedy") & lineup, F.concat(F.lit("Comedy: "), title)).when(F.array_contains(cats, "books") & book, F.concat(F.lit("Book club: "), title)).otherwise(title)


def indoors(cats: Column, venue: Column) -> Column:
    """No 'outdoors' in an arena, hall or theatre."""
    return F.when(F.lower(F.coalesce(venue, F.lit(""))).rlike(r"\b(?:arena|center|hall|theat(?:er|re)|stadium club)\b"), F.array_remove(cats, "outdoors")).otherwise(cats)


def lane(columns: Column) -> Column:
    return F.when(columns, "personal").otherwise("adjacent")
