"""Organisers as communities: identities, cadence, profiles, similarity, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions import text
from almanack.operators import graph, relational
from almanack.sources import tables


def identities(events: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """(key, root): events joined into communities wherever they share an alias. ``aliases``: key, alias."""
    anchor = aliases.groupBy("alias").agg(F.min(key).alias("a"))
    links = aliases.join(anchor, "alias").select("a", F.col(key).alias("b"))
    roots = graph.components(links.filter("a <> b"))
    return events.join(roots.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("root", key).alias("root"))


def cadence(rows: DataFrame, by: str, day: str) -> DataFrame:
    """by, dates, gap (upper median of days between distinct dates), cadence, top_weekdays (the two most frequent)."""
    d = rows.select(by, F.col(day).alias("d")).distinct()
    gaps = d.withColumn("gap", F.datediff("d", F.lag("d").over(Window.partitionBy(by).orderBy("d"))))
    medians = gaps.groupBy(by).agg(F.count("*").alias("dates"), F.array_sort(F.collect_list("gap")).alias("g")).select(by, "dates", F.try_element_at("g", (F.floor(F.size("g") / 2) + 1).cast("int")).alias("gap"))
    days = d.groupBy(by, F.weekday("d").alias("w")).agg(F.count("*").alias("n"), F.min("d").alias("first"))
    best = relational.top_by(days, [by], [F.desc("n"), "first"], 2).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"].cast("string")), ",").alias("top_weekdays"))
    name = F.when(F.col("gap").isNull(), "once").when(F.col("gap") <= 1, "daily").when(F.col("gap") <= 9, "weekly").when(F.col("gap") <= 18, "biweekly").when(F.col("gap") <= 45, "monthly").otherwise("occasional")
    return medians.join(best, by).withColumn("cadence", name)


def top_values(rows: DataFrame, by: str, value: str, k: int, name: str, first: str) -> DataFrame:
    """by and the ``k`` most frequent values, comma-joined; ties by first occurrence."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"), F.min(first).alias("f"))
    return relational.top_by(counts, [by], [F.desc("n"), "f", value], k).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value].cast("string")), ",").alias(name))


def similarity(a_cats: Column, b_cats: Column, a_hoods: Column, b_hoods: Column, a_cadence: Column, b_cadence: Column) -> Column:
    """In thousandths: half by categories, a fifth by neighbourhoods, 150 for the same cadence."""
    part = lambda x, y, w: F.coalesce(F.floor(F.try_divide(F.size(F.array_intersect(x, y)) * w, F.size(F.array_union(x, y)))), F.lit(0))
    return part(a_cats, b_cats, 500) + part(a_hoods, b_hoods, 200) + F.when(a_cadence == b_cadence, 150).otherwise(0)


#: Steps of the bound, in thousandths, from which on all pairs are known; the last has every pair with anything in common.
LEVELS = (750, 600, 450, 300, 1)
_MOST = {"cats": 500, "hoods": 200, "cadence": 150}


def _rarest(sets: DataFrame, of: str) -> DataFrame:
    """``sets`` (c and arrays) with the array ``of`` in the order of rarity among all classes; empty arrays stay."""
    one = sets.select("c", F.explode(of).alias("v"))
    often = one.groupBy("v").agg(F.count("*").alias("n"))
    ranked = one.join(often, "v").groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias(f"__{of}"))
    return sets.join(ranked, "c", "left").withColumn(of, F.coalesce(f"__{of}", F.array().cast("array<string>"))).drop(f"__{of}")


def _first(of: str, least: float) -> Column:
    """The rarest values of which two sets with a Jaccard similarity of ``least`` share one."""
    n = F.size(of)
    return F.slice(F.col(of), 1, n - F.greatest(F.ceil(n * F.lit(least) - 1e-9).cast("int"), F.lit(1)) + 1)


def _tagged(tag: str | Column, values: Column) -> Column:
    return F.transform(values, lambda x: F.concat_ws("\x01", F.lit(tag) if isinstance(tag, str) else tag, x))


def _crossed(x: Column, y: Column) -> Column:
    return F.flatten(F.transform(x, lambda v: F.transform(y, lambda w: F.concat_ws("\x01", v, w))))


def _keys(bound: int) -> Column:
    """Keys of which two classes share one if their similarity reaches ``bound``: rare values of either set or of both, with and without the cadence."""
    keys = []
    for points, tag in ((_MOST["cadence"], F.concat(F.lit("="), "cadence")), (0, F.lit("*"))):
        least = bound - points  # what the sets must bring
        cats, hoods = (least - _MOST["hoods"]) / _MOST["cats"], (least - _MOST["cats"]) / _MOST["hoods"]
        either = max(least, 1) / (_MOST["cats"] + _MOST["hoods"])
        if cats > 1 or hoods > 1:
            continue
        if hoods > 0:
            found = _tagged("b", _crossed(_first("cats", cats), _first("hoods", hoods)))
        elif cats > 0:
            found = _tagged("c", _first("cats", cats))
        else:
            found = F.concat(_tagged("c", _first("cats", either)), _tagged("h", _first("hoods", either)))
        keys.append(_tagged(tag, found))
    return F.array_distinct(F.concat(*keys))


def most_similar(profiles: DataFrame, key: str, k: int = 6) -> DataFrame:
    """a, b, similarity, rank: the ``k`` most similar others of each, among all that have anything in common.

    A threshold algorithm over inverted lists.  Communities with one profile are a
    class, named by its least member; of a class, only the first k + 1 members can
    be among anyone's k, and of all classes only the k + 1 best.  Lists are kept by
    rare values: at each of ``LEVELS`` a class that is still open meets those with
    which it shares a key, which finds every pair that reaches the level.  Once its
    k + 1 best reach the level, no unseen one can be better, and it is closed; so
    the long lists of frequent values are read by few.  Who has only a cadence in
    common ties with all others of it, so there the first k + 1 members suffice.
    """
    many, none = k + 1, F.array().cast("array<string>")
    sets = [F.array_sort(F.array_distinct(F.coalesce(F.filter(F.transform(c, lambda x: x.cast("string")), lambda x: x.isNotNull()), none))) for c in ("categories", "hoods")]
    p = profiles.select(F.col(key).alias("m"), sets[0].alias("cats"), sets[1].alias("hoods"), F.coalesce("cadence", F.lit("")).alias("cadence"))
    classes = tables.settle(p.groupBy("cats", "hoods", "cadence").agg(F.min("m").alias("c"), F.count("*").alias("members")), "classes")
    member = tables.settle(p.join(classes, ["cats", "hoods", "cadence"]).select("c", "m"), "members")
    first = relational.top_by(member, ["c"], ["m"], many, "__n").select(F.col("c").alias("cb"), F.col("m").alias("b"))
    classes = tables.settle(_rarest(_rarest(classes, "cats"), "hoods"), "rarest")

    open_, best = classes, None
    for bound in LEVELS:
        met = tables.settle(_meet(open_, classes, bound, many), "similar-met")
        best = met if best is None else tables.settle(best.join(open_.select(F.col("c").alias("ca")), "ca", "left_anti").unionByName(met), "similar-best")
        reached = met.filter(F.col("similarity") >= bound).groupBy(F.col("ca").alias("c")).agg(F.sum("members").alias("n")).filter(F.col("n") >= many)
        open_ = tables.settle(open_.join(reached, "c", "left_anti"), "similar-open")
        if open_.isEmpty():
            break
    near = relational.top_by(best.select("ca", "cb", "similarity").join(first, "cb").select("ca", "b", "similarity"), ["ca"], [F.desc("similarity"), "b"], many, "__n").drop("__n")
    mine = member.select(F.col("c").alias("ca"), F.col("m").alias("a")).join(near, "ca").filter("a <> b")
    return relational.top_by(mine, ["a"], [F.desc("similarity"), "b"], k).select("a", "b", "similarity", "rank")


def _candidates(open_: DataFrame, classes: DataFrame, bound: int, many: int) -> DataFrame:
    """(ca, cb): every class of ``open_`` with itself and with those that may reach the bound."""
    left, right = (df.select(F.col("c").alias(f"c{x}"), F.explode(_keys(bound)).alias("key")) for x, df in (("a", open_), ("b", classes)))
    pairs = left.join(right, "key").select("ca", "cb").unionByName(open_.select(F.col("c").alias("ca"), F.col("c").alias("cb")))
    if bound <= _MOST["cadence"]:
        some = relational.top_by(classes.filter("cadence <> ''").select("cadence", F.col("c").alias("cb")), ["cadence"], ["cb"], many, "__n").drop("__n")
        pairs = pairs.unionByName(open_.select(F.col("c").alias("ca"), "cadence").join(some, "cadence").select("ca", "cb"))
    return pairs.distinct()


def _meet(open_: DataFrame, classes: DataFrame, bound: int, many: int) -> DataFrame:
    """ca, cb, similarity, members (``many`` at most): the best ``many`` candidates of each."""
    side = lambda x: classes.select(F.col("c").alias(f"c{x}"), F.col("cats").alias(f"s{x}"), F.col("hoods").alias(f"h{x}"), F.col("cadence").alias(f"w{x}"), F.least("members", F.lit(many)).alias(f"m{x}"))
    a, b = side("a").drop("ma"), side("b")
    cadence = lambda x: F.nullif(F.col(x), F.lit(""))
    points = similarity(F.col("sa"), F.col("sb"), F.col("ha"), F.col("hb"), cadence("wa"), cadence("wb"))
    scored = _candidates(open_, classes, bound, many).join(a, "ca").join(b, "cb").select("ca", "cb", points.alias("similarity"), F.col("mb").alias("members")).filter("similarity > 0")
    return relational.top_by(scored, ["ca"], [F.desc("similarity"), "cb"], many, "__n").drop("__n")


def observe(history: DataFrame, seen: DataFrame, today: Column, days: int = 365) -> DataFrame:
    """History with this run's observations, one for each (community, event, date), none older than ``days``."""
    both = history.unionByName(seen.select(*history.columns)).dropDuplicates(["community_id", "event_id", "date"])
    return both.filter(F.datediff(today, "date") <= days)


def qualified(verified: Column, dedicated: Column, dates: Column) -> Column:
    """Whether a group of events is a community: verified, on a platform of its own, or seen on two dates."""
    return verified | dedicated | (dates >= 2)


def states(rows: DataFrame, by: str, venue: str, day: str, order: str, today: Column, days: int = 90) -> DataFrame:
    """by, venue (the most frequent, ties by first occurrence), recent (rows of the last ``days`` days before today), latest, state."""
    recent = F.count_if(F.col(day).between(F.date_sub(today, days), F.date_sub(today, 1)))
    whole = rows.groupBy(by).agg(recent.alias("recent"), F.max(day).alias("latest"))
    named = top_values(rows, by, venue, 1, "venue", order)
    state = F.when(F.col("latest") >= today, "active").when(F.col("recent") > 0, "quiet").otherwise("past")
    return whole.join(named, by, "left").select(by, "venue", "recent", "latest", state.alias("state"))


def with_history(found: DataFrame, history: DataFrame) -> DataFrame:
    """community_id, event_id, date: what ``history`` (community_id, event_id, date) kept under any alias of a community (community_id, aliases)."""
    names = found.select(F.col("community_id").alias("__c"), F.explode("aliases").alias("community_id")).distinct()
    return names.join(history, "community_id").select(F.col("__c").alias("community_id"), "event_id", "date").distinct()


def leads(listed: DataFrame, represented: DataFrame, alias: str = "alias") -> DataFrame:
    """Listed leads whose folded alias no community has."""
    known = represented.select(text.fold(F.col(alias)).alias("__a")).distinct()
    return listed.withColumn("__a", text.fold(F.col(alias))).join(known, "__a", "left_anti").drop("__a")
