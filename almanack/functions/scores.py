"""Scores in whole thousandths, so that sums, ranks and ties are exact."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions import dates, rules


def tier(value: Column, tiers: list[tuple[float, int]], otherwise: int = 0) -> Column:
    """The points of the first tier that the value reaches."""
    out = F.when(F.lit(False), 0)
    for least, points in tiers:
        out = out.when(value >= least, points)
    return out.otherwise(otherwise)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def confirmation(sources: Column, accounts: Column) -> Column:
    return tier(F.coalesce(F.size(sources), F.lit(0)), rules.SOURCE_CONFIRMATION) + tier(F.coalesce(F.size(accounts), F.lit(0)), rules.ACCOUNT_CONFIRMATION)


def account_yield(share: Column, posts: Column) -> Column:
    return F.when(posts >= 5, tier(share, rules.YIELD_TIERS)).otherwise(0)


def velocity(delta: Column) -> Column:
    return tier(F.coalesce(delta, F.lit(0)), rules.VELOCITY_TIERS)


def comentions(n: Column) -> Column:
    return tier(F.coalesce(n, F.lit(0)), rules.COMENTION_TIERS)


def credibility(verified: Column, followers: Column) -> Column:
    return F.least(F.lit(60), F.when(verified, 40).otherwise(0) + tier(F.coalesce(followers, F.lit(0)), rules.FOLLOWER_TIERS))


def content(image: Column, description: Column) -> Column:
    n = F.length(F.trim(F.coalesce(description, F.lit(""))))
    return F.when(F.length(F.coalesce(image, F.lit(""))) > 30, 20).otherwise(0) + F.when(n.between(60, 600), 30).when(n.between(30, 59), 10).otherwise(0)


def popularity(likes: Column, comments: Column, views: Column, attendance: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = zero(likes) + zero(comments) * 5 + F.least(F.lit(2000), zero(views) / 10) + zero(attendance) * 50
    return F.when(n > 0, tier(n, rules.POPULARITY_TIERS, 350)).otherwise(400)


def price(text: Column) -> Column:
    amount = F.regexp_extract(text, r"\$(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when((text == "free") | (amount == 0), 1000).when(text == "unknown", 600).when(amount <= 20, 850).when(amount <= 50, 600).when(amount <= 100, 400).when(amount.isNotNull(), 250).otherwise(500)


def categories(have: Column, preferred: list[str]) -> Column:
    n = F.size(F.array_intersect(have, F.array(*map(F.lit, preferred))))
    return F.when(F.coalesce(F.size(have), F.lit(0)) == 0, 300).when(n == 0, 150).when(n == 1, 600).when(n == 2, 850).otherwise(1000)


def completeness(image: Column, description: Column, start: Column, venue: Column) -> Column:
    has = lambda c, points: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, points).otherwise(0)
    return has(image, 350) + F.when(F.length(F.coalesce(description, F.lit(""))) > 30, 300).otherwise(0) + has(start, 200) + has(venue, 150)


def hot(sources: Column, first_seen: Column, now: Column) -> Column:
    """Several sources and new: within a day, three days or a week."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(first_seen)) / 86400)
    return F.when((F.size(sources) < 2) | age.isNull() | (age > 7), 0).when(age <= 1, 80).when(age <= 3, 50).otherwise(30)


def soon(day: Column, start: Column, today: Column, now_minutes: Column) -> Column:
    """Points for the days left, and for the hours left of today."""
    days, left = F.datediff(day, today), dates.start_minutes(start) - now_minutes
    tonight = F.when(left.isNull(), 70).when(left < 0, 30).when(left <= 180, 120).when(left <= 360, 100).otherwise(70)
    return F.when(days.isNull() | (days < 0), 0).when(days == 0, tonight).when(days == 1, 60).when(days <= 4, 40).when(days <= 7, 30).when(days <= 14, 15).otherwise(0)


def weekday_fit(day: Column, cats: Column) -> Column:
    w, has = F.weekday(day), lambda *c: F.arrays_overlap(cats, F.array(*map(F.lit, c)))
    party = F.when(has("parties", "singles"), F.when(w.isin(4, 5), 50).when(w <= 2, -30).otherwise(0)).otherwise(0)
    music = F.when(has("music") & w.isin(3, 4, 5), 40).otherwise(0)
    sport = F.when(has("fitness", "wellness") & (w < 5), 30).otherwise(0)
    return F.coalesce(clamp(party + music + sport, -50, 60), F.lit(0))


def hour_fit(day: Column, start: Column, cats: Column) -> Column:
    h = F.floor(dates.start_minutes(start) / 60)
    early = h.between(6, 9) & F.arrays_overlap(cats, F.array(*map(F.lit, ("fitness", "wellness", "outdoors"))))
    return F.when(h.isNull(), 0).when(early, 20).when(h.between(18, 21), 40).when(h.between(17, 22), 20).when(h.between(9, 15) & (F.weekday(day) < 5), -20).otherwise(0)


def trending(accounts: Column, delta: Column, first_seen: Column, day: Column, today: Column, now: Column) -> Column:
    """At least two of: several accounts, growing engagement, first seen within three days; and not past."""
    signs = (F.size(accounts) >= 2).cast("int") + (F.coalesce(delta, F.lit(0)) >= 50).cast("int") + F.coalesce(((F.unix_timestamp(now) - F.unix_timestamp(first_seen)) <= 3 * 86400).cast("int"), F.lit(0))
    return (day >= today) & (signs >= 2)


def miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    rad = lambda c: c * F.lit(pi / 180)
    a = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lng2 - lng1) / 2), 2)
    return F.lit(3958.8 * 2) * F.asin(F.sqrt(a))


def near(distance: Column) -> Column:
    return F.when(distance <= 1, 60).when(distance <= 3, 40).when(distance <= 6, 20).when(distance >= 15, -30).otherwise(0)


def final(base: Column, explicit: Column, stacked: Column, soft: Column, audience: Column) -> Column:
    """clamp(base + explicit + clamp(stacked, -200, 320) - soft - audience) within 0 to 1000."""
    return clamp(base + explicit + clamp(stacked, -200, 320) - soft - audience, 0, 1000)


def base(parts: dict[str, Column]) -> Column:
    """The weighted parts, each 0 to 1000, to at most 550."""
    return F.floor(sum((F.coalesce(parts[k], F.lit(0)) * w for k, w in rules.BASE_WEIGHTS.items()), F.lit(0)) / 1000)


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def account_score(bio: Column, posts: Column, followers: Column, event_posts: Column) -> Column:
    """0 to 1000 for an account that may announce events."""
    words = F.when(F.lower(F.coalesce(bio, F.lit(""))).rlike(r"event|music|comedy|gallery|venue|club|tickets|rsvp"), 350).otherwise(0)
    share = F.coalesce(F.try_divide(event_posts * 1000, posts), F.lit(0))
    return clamp((words + F.least(F.lit(400), F.floor(share * 0.6)) + F.when(followers.between(500, 200_000), 250).otherwise(0)).cast("int"), 0, 1000)


def saturating(count: Column, points: float, cap: float) -> Column:
    """min(cap, points x log2(1 + count)): the first signs of interest count most."""
    return F.least(F.lit(cap), F.lit(points) * F.log2(1 + count))
