"""Queries over the scalar functions: ``documents``, ``conversations``, ``benchmark`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions import dates, scores
from almanack.functions import text as tx
from almanack.operators import admission, enrich, phraseblocks, resolve, stats, taste
from almanack.plans.registry import query
from almanack.sources.tables import load

TOPICS = {"legal": ["license", "licensed", "copyright"], "contact": ["email", "@", "phone", "call"], "money": ["price", "$", "free"], "tech": ["http", "code", "api"], "shout": ["!!"]}
PLACES = [("the", "article"), ("and", "joined"), ("de", "romance"), ("und", "german"), ("licensed", "legal")]
ANCHOR = "2024-01-17"

_LOW = "lower(coalesce(text, ''))"


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(split_part(text, chr(10), 1)), '^(?i:copy of)\\s+', ''), '(?:\\s+#[0-9A-Za-z_]+){2,}\\s*$', ''), '\\s+', ' ', 'g')) AS title
FROM documents WHERE text IS NOT NULL
""".replace("\\\\", "\\"))
def title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display titles of the first lines."""
    rows = load(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", tx.clean_title(F.substring_index("text", "\n", 1)).alias("title"))


@query()
def description_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions cut at a sentence or word; look-behind has no counterpart in the oracle's dialect, tests hold the rules."""
    return load(spark, sf_dir, "documents").select("doc_id", tx.clean_description(F.col("text")).alias("description"))


@query(f"""
SELECT doc_id, CASE WHEN len(c) = 0 THEN 'other' ELSE array_to_string(c, ',') END AS categories FROM (
SELECT doc_id, list_filter([CASE WHEN t LIKE '%license%' OR t LIKE '%copyright%' THEN 'legal' END,
  CASE WHEN regexp_matches(t, '\\b(email|phone|call)\\b') OR (false) THEN 'contact' END,
  CASE WHEN regexp_matches(t, '\\b(price|free)\\b') THEN 'money' END,
  CASE WHEN regexp_matches(t, '\\b(http|code|api)\\b') THEN 'tech' END], lambda x: x IS NOT NULL) AS c
FROM (SELECT doc_id, regexp_replace({_LOW}, '[^a-z0-9]+', ' ', 'g') AS t FROM documents))
""".replace("\\\\", "\\"))
def category_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by keywords in a fixed order; short ones as whole words."""
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " ")
    table = {"legal": ["license", "copyright"], "contact": ["email", "phone", "call"], "money": ["price", "free"], "tech": ["http", "code", "api"]}
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(enrich.categories(plain, table), ",").alias("categories"))


@query("""
WITH k(needle, hood) AS (VALUES ('and', 'joined'), ('licensed', 'legal'), ('thand', 'thick'), ('tion', 'noun'), ('entai', 'gallic')),
m AS (SELECT doc_id, needle, hood, row_number() OVER (PARTITION BY doc_id ORDER BY length(needle) DESC, needle) AS r FROM documents JOIN k ON contains(text, needle))
SELECT doc_id, needle, hood FROM m WHERE r = 1
""")
def neighborhood_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest key that the text has decides."""
    table = spark.createDataFrame([("and", "joined"), ("licensed", "legal"), ("thand", "thick"), ("tion", "noun"), ("entai", "gallic")], "needle string, hood string")
    return enrich.longest_match(load(spark, sf_dir, "documents"), "doc_id", "text", table, "needle", "hood").select("doc_id", "needle", "hood")


@query("""
SELECT conv_id, turn, CASE WHEN n = 1 THEN printf('%02d:%02d', CAST(m // 60 AS INT), CAST(m % 60 AS INT)) END AS start_time FROM (
SELECT conv_id, turn, len(list_distinct(ms)) AS n, list_min(ms) AS m FROM (
SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(lower(text), '[0-9]{1,2}(?::[0-9]{2})? ?[ap]m'), lambda x:
  CASE WHEN CAST(regexp_extract(x, '^([0-9]+)', 1) AS INT) BETWEEN 1 AND 12 THEN
    (CAST(regexp_extract(x, '^([0-9]+)', 1) AS INT) % 12 + CASE WHEN contains(x, 'pm') THEN 12 ELSE 0 END) * 60 + coalesce(TRY_CAST(nullif(regexp_extract(x, ':([0-9]{2})', 1), '') AS INT), 0) END), lambda v: v >= 360) AS ms
FROM conversations))
""")
def time_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start time from text, if it names exactly one."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", dates.time_from_text(F.lit(""), F.col("text")).alias("start_time"))


@query("""
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\\b(tonight|today)\\b') THEN DATE '2024-01-17' WHEN regexp_matches(t, '\\btomorrow\\b') THEN DATE '2024-01-18'
  WHEN regexp_extract(t, '\\bin ([0-9]{1,3}) days?\\b', 1) <> '' THEN DATE '2024-01-17' + CAST(regexp_extract(t, '\\bin ([0-9]{1,3}) days?\\b', 1) AS INT)
  WHEN regexp_matches(t, '\\bthis weekend\\b') THEN DATE '2024-01-20' END AS date
FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)
""".replace("\\\\", "\\"))
def relative_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'tonight', 'tomorrow' and the like, from a fixed day."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", dates.relative_date(F.col("text"), F.lit(ANCHOR).cast("date")).alias("date"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\bfree\\b') OR regexp_matches(text, '\\$0([^.0-9]|$)') OR regexp_matches(lower(text), '\\bno (cover|charge)\\b|\\bcomplimentary\\b') THEN 'free'
  WHEN regexp_extract(text, '\\$([0-9]+(?:\\.[0-9]{2})?)', 1) <> '' THEN '$' || regexp_extract(text, '\\$([0-9]+(?:\\.[0-9]{2})?)', 1) ELSE 'unknown' END AS price
FROM documents
""".replace("\\\\", "\\"))
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """free, a price or unknown."""
    return load(spark, sf_dir, "documents").select("doc_id", tx.price_of(F.col("text")).alias("price"))


@query("""
SELECT doc_id, length(text) AS n, CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 200 WHEN length(trim(coalesce(text, ''))) < 60 THEN 500 WHEN length(trim(coalesce(text, ''))) <= 600 THEN 1000 ELSE 800 END AS quality,
  CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), '!!') AS INT) + CAST(contains(lower(text), 'http') AS INT) AS hits
FROM documents WHERE text IS NOT NULL
""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length tiers and keyword hits."""
    rows = load(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", F.length("text").cast("long").alias("n"), tx.description_quality(F.col("text")).alias("quality"), tx.hits(F.col("text"), ["license", "!!", "http"]).alias("hits"))


_TOK = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND NOT list_contains(['the','and','for','with','from','this','that','live','presents','featuring','your','our','you','are','new','york','nyc','brooklyn','event','night'], w))))"


@query(f"""
WITH b AS (SELECT item_id, {_TOK.format(c='text')} AS t FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.t, y.t)) AS common
FROM b x JOIN b y ON x.item_id < y.item_id AND len(list_intersect(x.t, y.t)) >= 1
 AND len(list_intersect(x.t, y.t)) >= 0.05 * (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))
""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items whose word sets are alike, by an equi-join on words."""
    rows = resolve.tokens_of(load(spark, sf_dir, "benchmark"), "text").withColumn("block", F.lit(0))
    return resolve.similar_pairs(rows, "item_id", ["block"], "tokens", 0.05, 1).select("a", "b", F.col("common").cast("long").alias("common"))


_TERMS = "(SELECT item_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) > 2)) AS term FROM benchmark)"


@query(f"""
WITH tf AS (SELECT item_id, term, count(*) AS tf FROM {_TERMS} GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark),
w0 AS (SELECT item_id, term, tf * ln((1 + n) / (1 + df)) AS w FROM tf JOIN df USING (term), n),
nm AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY 1 HAVING sqrt(sum(w * w)) > 0),
w AS (SELECT item_id, term, w / norm AS w FROM w0 JOIN nm USING (item_id)),
c0 AS (SELECT term, sum(w) AS w FROM w WHERE item_id % 2 = 0 GROUP BY 1), l AS (SELECT sqrt(sum(w * w)) AS norm FROM c0),
c AS (SELECT term, w / norm AS w FROM c0, l)
SELECT item_id, CAST(round(sum(w.w * c.w), 5) AS DOUBLE) AS liked FROM w JOIN c USING (term) GROUP BY 1
""")
def tfidf_taste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each item to the centroid of the liked ones (even ids)."""
    rows = load(spark, sf_dir, "benchmark")
    vectors = taste.weigh(taste.terms(rows, "item_id", "text"), "item_id", rows.agg(F.count("*").alias("n")))
    center = taste.centroid(vectors, rows.filter("item_id % 2 = 0").select("item_id"), "item_id")
    return taste.cosine(vectors, center, "item_id", "liked").select("item_id", F.round("liked", 5).alias("liked"))


@query("""
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(coalesce(text, '')), '\\b(going|see you there|count me in|got tickets)\\b') THEN 2 ELSE 0 END
  + CASE WHEN len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '(?:^|[^a-z0-9_.])@([a-z0-9_.]{2,30})', 1))) >= 2 THEN 1 ELSE 0 END AS signal
FROM conversations
""".replace("\\\\", "\\"))
def attendance_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent to come and tagged friends."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.attendance_signal(F.col("text")).alias("signal"))


@query("""
WITH r(name, needle, least) AS (VALUES ('license', 'license', 1), ('shouting', '!!', 1), ('nowhere', 'zzzzqqqq', 1)),
c AS (SELECT name, count(*) AS hits FROM documents JOIN r ON contains(lower(concat_ws(' ', text, source)), needle) GROUP BY 1)
SELECT name, coalesce(hits, 0) AS hits, coalesce(hits, 0) >= least AS ok FROM r LEFT JOIN c USING (name)
""")
def must_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that must be met by some row."""
    rules = spark.createDataFrame([("license", "license", 1), ("shouting", "!!", 1), ("nowhere", "zzzzqqqq", 1)], "name string, needle string, least int")
    return stats.must_surface(load(spark, sf_dir, "documents"), ["text", "source"], rules)


@query("""
SELECT doc_id, regexp_matches(t, 'license|copyright') OR regexp_matches(t, '\\b(disgusting|stupid)\\b') AS blocked, regexp_matches(text, '^[A-Z][a-z]{13,} ') AS glued
FROM (SELECT doc_id, text, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL)
""".replace("\\\\", "\\"))
def hard_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked phrases and words, and glued handles."""
    rows = load(spark, sf_dir, "documents").filter("text IS NOT NULL")
    plain = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")
    return rows.select("doc_id", admission.blocked(plain, ["license", "copyright"], ["disgusting", "stupid"], [], []).alias("blocked"), admission.glued_handle(F.col("text")).alias("glued"))


def _fragment_sql() -> str:
    how = {"prefix": "starts_with(t, '{}')", "suffix": "ends_with(t, '{}')", "contains": "contains(t, '{}')", "regex": "regexp_matches(t, '{}')"}
    cases = ", ".join(f"CASE WHEN {how[kind].format(pattern.replace(chr(39), chr(39) * 2))} THEN '{name}' END" for name, kind, pattern in admission.FRAGMENTS)
    return f"SELECT conv_id, turn, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS rule_ids FROM (SELECT conv_id, turn, lower(trim(split_part(coalesce(text, ''), chr(10), 1))) AS t FROM conversations)"


@query(_fragment_sql())
def caption_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the rules by which a turn looks torn off."""
    rows = load(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.array_join(admission.fragment_rules(F.substring_index("text", "\n", 1), admission.FRAGMENTS), ",").alias("rule_ids"))


@query("""
SELECT c_custkey, CAST(greatest(-50, least(60, CASE WHEN c_mktsegment = 'BUILDING' THEN 40 ELSE 0 END + CASE WHEN c_acctbal > 5000 THEN 30 ELSE 0 END)) AS INT) AS fit,
  CASE WHEN abs(c_acctbal) >= 1000 THEN regexp_replace(printf('%.1f', floor(abs(c_acctbal) / 100) / 10), '\\.0$', '') || 'k' ELSE CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) END AS shown
FROM customer
""".replace("\\\\", "\\"))
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped sums and short counts."""
    n = F.floor(F.abs("c_acctbal"))
    shown = F.when(n >= 1000, tx.display_count(F.floor(F.abs("c_acctbal") / 100) * 100)).otherwise(n.cast("string"))
    fit = scores.clamp(F.when(F.col("c_mktsegment") == "BUILDING", 40).otherwise(0) + F.when(F.col("c_acctbal") > 5000, 30).otherwise(0), -50, 60)
    return load(spark, sf_dir, "customer").select("c_custkey", fit.cast("int").alias("fit"), shown.alias("shown"))


_RUNS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


@query(f"""
WITH t AS (SELECT {_RUNS} AS w FROM conversations),
r AS (SELECT phrase, count(*) AS weight FROM (SELECT unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS phrase FROM t, (VALUES (2), (3), (6)) AS s(n)) GROUP BY phrase),
d AS (SELECT doc_id, {_RUNS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS phrase FROM d, (VALUES (2), (3), (6)) AS s(n))
SELECT doc_id, count(*) AS n_rules, max(weight) AS weight, min_by(phrase, (-weight, phrase)) AS phrase FROM g JOIN r USING (phrase) GROUP BY doc_id
""")
def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every run of two, three and six words that the conversations have (over 100,000 at the smallest scale), found in all documents: how many a document has, and the heaviest."""
    rules = phraseblocks.said(load(spark, sf_dir, "conversations"), "text", (2, 3, 6))
    return phraseblocks.counted(load(spark, sf_dir, "documents"), "doc_id", "text", rules, "phrase", "weight", clean=True)
