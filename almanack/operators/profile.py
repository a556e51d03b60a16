"""Interest profiles: counters learnt from use, their boosts, and the lists a user sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions import rules, scores, text

#: Weight of each action on the counters of an event's account, host and categories.
WEIGHTS = {"open": 1, "click": 1, "save": 3, "attend": 5, "follow": 4, "hide": -3}


def counters(actions: DataFrame, dims: list[str]) -> DataFrame:
    """(user_id, dim, key, weight) from actions (user_id, action and the dims); weights don't fall below zero. Works on streams, too, but for the clamp by user."""
    w = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v)))), F.col("action")), F.lit(0))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in dims)))
    rows = actions.select("user_id", w.alias("w"), each.alias("x")).filter("x.key IS NOT NULL")
    return rows.groupBy("user_id", F.col("x.dim").alias("dim"), F.col("x.key").alias("key")).agg(F.greatest(F.lit(0), F.sum("w")).alias("weight"))


def bump(counts: Column, key: Column, by: Column) -> Column:
    """A map of counters with one of them changed, never below zero."""
    return F.map_zip_with(counts, F.create_map(key, by), lambda k, a, b: F.greatest(F.lit(0), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))


def merge_maps(a: Column, b: Column) -> Column:
    """The larger value of each key."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


def boost(df: DataFrame, account: str, categories: str, accounts: Column, liked: Column, hidden: Column) -> Column:
    """Up to 250 thousandths for accounts and categories that were used before, less up to 200 for hidden ones; maps of counters as columns."""
    seen = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    by_category = F.aggregate(F.col(categories), F.lit(0).cast("double"), lambda acc, c: acc + scores.saturating(seen(liked, c), 20.0, 60.0))
    plus = F.least(F.lit(250.0), scores.saturating(seen(accounts, F.col(account)), 40.0, 150.0) + by_category)
    return plus - F.least(F.lit(200.0), scores.saturating(seen(hidden, F.col(account)), 60.0, 200.0))


def profile_boost(followed: Column, words: Column, topics: list[str], curated: Column, torn: Column) -> Column:
    """150 for a followed account with a whole title, 30 for each topic in the words up to 100, 50 for a curated host; 250 at most."""
    low = F.lower(words)
    hits = sum((low.rlike(rules.any_of([t], True)).cast("int") for t in topics), F.lit(0))
    return F.least(F.lit(250), F.when(followed & ~torn, 150).otherwise(0) + F.least(F.lit(100), hits * 30) + F.when(curated, 50).otherwise(0))


def topic_scores(parts: list[tuple[DataFrame, int]], floor: int) -> DataFrame:
    """(topic, score): a floor, and the weighted sums of several (topic, n) counts."""
    out = None
    for df, w in parts:
        one = df.select("topic", (F.col("n") * w).alias("s"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("topic").agg((F.sum("s") + floor).alias("score"))


def saved(ids: DataFrame, events: DataFrame, stubs: DataFrame, key: str = "event_id") -> DataFrame:
    """Saved events as they are now, else as they were when saved."""
    e = events.select(key, F.struct(*events.columns).alias("now"))
    s = stubs.select(key, F.struct(*stubs.columns).alias("then"))
    named = [F.coalesce(F.col(f"now.{c}"), F.col(f"then.{c}")).alias(c) if c in events.columns and c in stubs.columns else F.col(f"{'now' if c in events.columns else 'then'}.{c}").alias(c) for c in dict.fromkeys([*events.columns, *stubs.columns]) if c != key]
    return ids.select(key).join(e, key, "left").join(s, key, "left").select(key, *named)


def directory(df: DataFrame, query: str = "", categories: list[str] = (), hoods: list[str] = (), slots: list[str] = (), active: bool = False) -> DataFrame:
    """Communities by facets that all must hold; within a facet any value does. slots are 'weekday-part'."""
    any_ = lambda c, v: F.arrays_overlap(F.col(c), F.array(*map(F.lit, v))) if v else F.lit(True)
    named = F.lower(F.concat_ws(" ", "name", "summary")).contains(query.lower())
    live = (F.col("event_count") > 0) if active else F.lit(True)
    return df.filter(named & any_("categories", categories) & any_("hoods", hoods) & any_("slots", slots) & live).orderBy(F.desc(F.col("event_count") > 0), F.desc("event_count"), "name")


def summary(name: Column, categories: Column, cadence: Column, hood: Column) -> Column:
    """A sentence about a community."""
    what = F.coalesce(F.try_element_at(categories, F.lit(1)), F.lit("events"))
    return F.concat(name, F.lit(" hosts "), F.when(cadence == "once", F.lit("")).otherwise(F.concat(cadence, F.lit(" "))), what, F.when(hood.isNotNull(), F.concat(F.lit(" in "), hood)).otherwise(""), F.lit("."))


def personal_name(name: Column) -> Column:
    """Two or three capitalised words without a word of an organisation."""
    return name.rlike(r"^[A-Z][a-z'’-]+(?: [A-Z]\.?)?(?: [A-Z][a-z'’-]+){1,2}$") & ~F.lower(name).rlike(r"\b(?:club|bar|house|studio|collective|society|museum|gallery|theat(?:er|re)|books?|events?|project)\b")


def labels(df: DataFrame) -> Column:
    """Highlights of an event, in order."""
    c = F.col
    return F.array_compact(F.array(
        F.when(F.coalesce(c("user_saved"), F.lit(False)), "saved"), F.when(c("price") == "free", "free"), F.when(F.size("contributing_sources") >= 2, "confirmed"), F.when(F.coalesce(c("engagement_delta"), F.lit(0)) >= 50, "rising"),
        F.when(F.coalesce(c("recurring"), F.lit(False)), "recurring"), F.when(F.coalesce(c("account_verified"), F.lit(False)), "verified"), F.when(text.hits(F.coalesce(c("title"), F.lit("")), ["opening", "premiere", "debut"]) > 0, "opening"),
    ))


def page(df: DataFrame, order: list, name: str, size: int, offset: int = 0) -> DataFrame:
    """``size`` rows from ``offset`` on in a total order, each with its place."""
    rows = df.orderBy(*order).limit(offset + size)  # the feature: a page
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1).filter(F.col(name) >= offset)
