"""How filters of documents act on each other: an audit by inclusion and exclusion.

1. ``flags``: a document's failures, one flag for each filter, from its whole
   text; a narrow table.  E (a text that a smaller doc_id has) is settled by the
   least doc_id of each text, which is aggregated before any shuffle.
2. ``joint``: for each of the 32 sets of filters, the documents of a part that
   fail all of them: sums of products of flags, J(S).  J of no filter is the
   part's size.  The same for good and for toxic documents.
3. ``audit``: Möbius inversion over the sets.  With the signs (-1)^|T|, the sum of
   J(T) over T within S counts those that pass all of S (survivors); over the
   sets that hold a filter, with (-1)^(|T|-1), those that fail it alone.  The
   filters' removals are a game whose Harsanyi dividend of T is (-1)^(|T|-1) J(T),
   and a filter's Shapley value is the sum of dividends / |T| over the sets that
   hold it; times the number of orders it is a whole number.

So a part's 600 rows come from 96 sums, and no document is walked once for each
order.  Edge cases: null text is empty; a null part is the empty string; labels
that repeat count if any of them says so, nulls don't; a row without a doc_id has
no smaller one, is nobody's smaller one, and has no labels; rows that repeat the
least doc_id of a text don't fail E; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm import shared

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
_BLANK, _OTHER = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def text_failures(text: Column) -> dict[str, Column]:
    """A: under 100 words; B: under 80 % of them distinct; C: over 10 % of the code points are A-Z; D: a sign of code or tables."""
    words = F.array_remove(F.split(text, _BLANK), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * upper > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def _salted(df: DataFrame) -> DataFrame:
    """With ``salt``, by which rows without an id are spread when ids are joined."""
    return df.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.hash("name"), F.lit(1024))).otherwise(0).cast("int"))


def flags(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, A to E, good and toxic (0 or 1 each) of every row; documents are read once, and texts aren't shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("name"), *(f.cast("int").alias(k) for k, f in text_failures(text).items()))
    rows = shared.table(rows, "audit-flags")
    first = rows.filter("doc_id IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic")))).withColumn("salt", F.lit(0))
    found = rows.join(first, ["name", "doc_id"], "left")
    found = _salted(found).join(known, ["doc_id", "salt"], "left")
    fails_e = (F.col("doc_id").isNotNull() & F.col("is_first").isNull()).cast("int").alias("E")
    return found.select("part", *FILTERS[:4], fails_e, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def joint(flagged: DataFrame) -> DataFrame:
    """part, and ``all``, ``good``, ``toxic``: arrays of the documents that fail every filter of a set, by the set's number (A is bit 0)."""
    one = F.lit(1).cast("long")

    def product(s: int) -> Column:
        out = one
        for k, name in enumerate(FILTERS):
            out = out * F.col(name) if s >> k & 1 else out
        return out

    sums = [F.sum(product(s) * w).alias(f"{of}_{s}") for of, w in (("all", one), ("good", F.col("good")), ("toxic", F.col("toxic"))) for s in range(SETS)]
    return flagged.groupBy("part").agg(*sums).select("part", *(F.array(*(f"{of}_{s}" for s in range(SETS))).alias(of) for of in ("all", "good", "toxic")))


def _has(sets: Column, k: int) -> Column:
    return F.getbit(sets, F.lit(k)) == 1


def _added(c: str, k: int) -> Column:
    """To each set that holds the k-th filter, the value of the set without it."""
    return F.transform(c, lambda x, s: x + F.when(_has(s, k), F.col(c)[s.bitwiseXOR(F.lit(1 << k))]).otherwise(F.lit(0).cast("long")))


def inverted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each of the ``columns`` (J by set) as survivors by set: J(T) with the sign of |T|, summed over the subsets of each set, a filter at a time."""
    for c in columns:
        df = df.withColumn(c, F.transform(c, lambda x, s: F.when(F.bit_count(s) % 2 == 1, -x).otherwise(x)))
    for k in range(len(FILTERS)):
        df = df.withColumns({c: _added(c, k) for c in columns})
    return df


def dividends(j: str, weight: list[int]) -> Column:
    """For each filter, the sum over the sets T that hold it of (-1)^(|T|-1) J(T) weight[|T|]."""
    weights = F.array(*(F.lit(w).cast("long") for w in weight))
    signed = F.transform(j, lambda x, s: F.when(F.bit_count(s) % 2 == 1, x).otherwise(-x) * weights[F.bit_count(s)])
    held = lambda k: F.filter(signed, lambda _, s: _has(s, k))
    return F.array(*(F.aggregate(held(k), F.lit(0).cast("long"), lambda a, x: a + x) for k in range(len(FILTERS))))


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from ``joint``."""
    n = len(FILTERS)
    known = counts.select("part", "all", *(F.col(c).alias(f"kept_{c}") for c in ("all", "good", "toxic")), dividends("all", [1] * (n + 1)).alias("alone"), dividends("all", [0, *(factorial(n) // k for k in range(1, n + 1))]).alias("value"))
    known = inverted(known, ["kept_all", "kept_good", "kept_toxic"])
    order = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS))))
    steps = known.withColumn("filter_order", order).withColumn("step", F.explode(F.array(*(F.lit(i + 1) for i in range(len(FILTERS))))))
    letters = lambda upto: sum((F.when(F.instr(F.substring("filter_order", F.lit(1), upto), name) > 0, 1 << k).otherwise(0) for k, name in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("before", letters(F.col("step") - 1)).withColumn("after", letters(F.col("step"))).withColumn("k", F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    at = lambda c, i: F.col(c)[F.col(i)]
    removed = lambda of: at(f"kept_{of}", "before") - at(f"kept_{of}", "after")
    fails = F.col("all")[F.col("after") - F.col("before")]  # the set of this filter alone
    return steps.select("part", "filter_order", "step", at("kept_all", "after").alias("kept"), removed("all").alias("removed"), (fails - removed("all")).alias("redundant"), at("alone", "k").alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), at("value", "k").alias("shapley"))
