"""Rule tables of any size: phrases and needles found in texts by equi-joins, so nothing is sent to every row and nothing is refused.

``found_phrases`` is for whole words in texts of any length, ``found_needles`` for
any run of characters in short fields (names, titles, addresses).  In both, a rule
is anchored by a part of at most ``WORDS`` words or ``LETTERS`` characters that few
rules share; a text has each of its parts once, and rules and texts
meet by it.  A phrase of up to ``WORDS`` words is its own anchor and needs no more;
others are checked against the text.  Most parts of a text are no anchor: a sieve of
one bit a hash, of at most 2^``SIEVE`` bits whatever the number of rules, is broadcast
and holds them back before the shuffle; it lets every anchor through, and what it lets
through besides the join drops.  Whether the rules are broadcast is Catalyst's
choice, by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.sources import tables

WORDS, LETTERS, SIEVE, SHARED = 4, 5, 28, 16


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _parts(items: Column, n: Column) -> Column:
    """The distinct runs of ``n`` adjoining items, joined by blanks."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), " ")))


def _runs(text: Column, n: Column) -> Column:
    """The distinct runs of ``n`` characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def _anchored(names: DataFrame, parts: Column, size: Column) -> DataFrame:
    """``names`` (name) with ``anchor``, the part that fewest of them have, and its ``size``; a table."""
    one = names.select("name", size.alias("size"), F.explode(parts).alias("anchor"))
    often = one.groupBy("anchor").agg(F.count("*").alias("n"))
    best = one.join(often, "anchor").groupBy("name", "size").agg(F.min(F.struct("n", "anchor")).alias("x"))
    return tables.settle(best.select("name", "size", F.col("x.anchor").alias("anchor")), "anchors")


def _long_anchors(names: DataFrame) -> DataFrame:
    """``names`` (name), of over ``WORDS`` words, with ``anchor``: the longest part, which needs no shuffle of the names; only where over ``SHARED`` names have it, the part that fewest of them share."""
    parts = _parts(F.split("name", " "), F.lit(WORDS))
    longest = names.select("name", F.array_max(F.transform(parts, lambda p: F.struct(F.length(p), F.xxhash64(p), p.alias("p"))))["p"].alias("anchor"))
    hot = tables.settle(longest.groupBy(F.xxhash64("anchor").alias("h")).agg(F.count("*").alias("n")).filter(F.col("n") > SHARED).select("h"), "hot")
    if hot.isEmpty():
        return longest
    hashed = longest.withColumn("h", F.xxhash64("anchor"))
    rarest = _anchored(hashed.join(hot, "h", "left_semi").select("name"), parts, F.lit(WORDS)).select("name", "anchor")
    return hashed.join(hot, "h", "left_anti").select("name", "anchor").unionByName(rarest)


def _sizes(anchors: DataFrame) -> list[int]:
    """The sizes of anchors that there are, at most ``WORDS`` or ``LETTERS`` of them."""
    return sorted(r["size"] for r in anchors.select("size").distinct().collect())


def _sieved(parts: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """``parts`` (anchor) without most of those that are none of the ``n`` anchors: eight bits an anchor, up to 2^``SIEVE``, in blocks of 64 words of 64 bits."""
    bits = min(SIEVE, max(12, (8 * n - 1).bit_length()))
    low = lambda c, k: c.bitwiseAND(F.lit((1 << k) - 1))
    at = low(F.xxhash64("anchor"), bits).alias("h")
    h = F.col("h")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low(h, 6).cast("int"))
    words_ = anchors.select(at).groupBy(F.shiftright(h, 6).alias("w")).agg(F.bit_or(bit).alias("b"))
    blocks = words_.groupBy(F.shiftright("w", 6).alias("__block")).agg(F.map_from_entries(F.collect_list(F.struct(low(F.col("w"), 6).cast("int").alias("i"), "b"))).alias("m"))
    sieve = blocks.select("__block", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("__bits"))
    dealt = parts.withColumn("h", at)
    word = F.get("__bits", low(F.shiftright(h, 6), 6).cast("int"))
    is_set = F.call_function("shiftrightunsigned", word, low(h, 6).cast("int")).bitwiseAND(F.lit(1)) == 1
    return dealt.join(F.broadcast(sieve), (F.shiftright(h, 12) == F.col("__block")) & is_set).select(*parts.columns)


def found_phrases(df: DataFrame, key: str, text: str, rules: DataFrame, phrase: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, phrase) once for each rule whose words adjoin in the row's text, whatever stands between words; rules without words are never found. Columns of the rules in ``carry`` come along."""
    name = F.array_join(words(F.col(phrase)), " ")
    spelled = rules.select(phrase, *carry, name.alias("name")).distinct().filter("name <> ''")
    own = F.split("name", " ")
    other = F.when(F.col("name") != F.col(phrase), F.col("name")).alias("name")  # most rules are spelled as their words: those are kept once
    kept = tables.settle(spelled.select(F.size(own).alias("size"), phrase, *carry, other), "rules")
    table = kept.withColumn("name", F.coalesce("name", phrase))
    counts = {r["size"]: r["count"] for r in table.groupBy("size").count().collect()}
    texts = df.select(key, words(F.col(text)).alias("__w"))
    of = lambda sizes: texts.select(key, F.explode(F.concat(*(_parts(F.col("__w"), F.lit(n)) for n in sizes))).alias("anchor"))
    out = table.limit(0).join(texts.select(key).limit(0)).select(key, phrase, *carry)
    if sizes := sorted(n for n in counts if n <= WORDS):
        short = table.filter(F.col("size") <= WORDS).select(F.col("name").alias("anchor"), phrase, *carry)
        met = _sieved(of(sizes), short, sum(counts[n] for n in sizes)).join(short, "anchor").distinct()
        out = met.select(key, phrase, *carry)
    if many := sum(c for n, c in counts.items() if n > WORDS):
        long = table.filter(F.col("size") > WORDS)
        anchors = _long_anchors(long.select("name").distinct())
        open_ = tables.settle(_sieved(of([WORDS]), anchors, many).join(anchors, "anchor").select(key, "name").distinct(), "open")
        padded = df.select(key, F.concat(F.lit(" "), F.array_join(words(F.col(text)), " "), F.lit(" ")).alias("__t"))
        seen = padded.join(open_, key).filter(F.contains("__t", F.concat(F.lit(" "), "name", F.lit(" ")))).select(key, "name").distinct()
        found = seen.join(long, "name").select(key, phrase, *carry)
        out = out.unionByName(found) if sizes else found
    return out


def found_needles(df: DataFrame, key: str, text: str, rules: DataFrame, needle: str) -> DataFrame:
    """(key, needle) once for each rule that the row's text contains; for fields, as the runs of a text cost its length squared. Empty needles are in every text that isn't null."""
    names = rules.select(F.col(needle).alias("name")).filter("name IS NOT NULL").distinct()
    size = F.least(F.length("name"), F.lit(LETTERS))
    anchors = _anchored(names.filter("name <> ''"), _runs(F.col("name"), size), size)
    texts = df.select(key, F.col(text).alias("__t")).filter("__t IS NOT NULL")
    out = texts.join(names.filter("name = ''")).select(key, "name")  # the empty needle is one row at most
    if sizes := _sizes(anchors):
        parts = texts.select(key, "__t", F.explode(F.concat(*(_runs(F.col("__t"), F.lit(n)) for n in sizes))).alias("anchor"))
        out = out.unionByName(parts.join(anchors, "anchor").filter(F.contains("__t", F.col("name"))).select(key, "name").distinct())
    return out.withColumnRenamed("name", needle)
