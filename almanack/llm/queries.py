"""The thin queries of the language-model operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.llm import decontam, exactdedup, filteraudit, langid, mixing, neardup, packing, sharding, shared, spelling, substrings, tokenfile, toxicity, warc

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(load(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), window=1024, end_id=0))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write(load(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), tokenfile.folder(spark), end_id=2)
    return tokenfile.digests(tokenfile.read(manifest))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.mark(load(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = warc.write(load(spark, sf_dir, "pages"), shared.place(spark, "warc"))
    return warc.digests(warc.assemble(warc.read(paths, payloads=False)))


ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS keep FROM p),
b AS (SELECT *, list_aggregate(list_transform(string_split(x, ''), lambda c: CASE c
        WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011'
        WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111'
        WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011'
        WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END), 'string_agg', '') AS bits FROM h)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
         + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
         + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM b
"""


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(load(spark, sf_dir, "documents"), 16)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = load(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.bucket() % 5
    weights = toxicity.train(docs, load(spark, sf_dir, "labels"), fold != 0)
    scored = toxicity.score(docs, weights, carry=["doc_id"])
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = load(spark, sf_dir, "documents"), langid.bucket() % 4
    names, model = langid.train(docs, fold != 2)
    found = langid.label(docs, names, model, carry=["doc_id"])
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.mark(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return marked.drop("spans")


ORACLES["op7_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
      FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM p),
o AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS phrase
      FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS r(i)),
m AS (SELECT doc_id, item_id, o.i, o.k FROM o JOIN p ON o.phrase = p.phrase AND o.k = p.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(load(spark, sf_dir, "documents"))


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


@query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"), mixing.quality(load(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op13_mixing"] = r"""
WITH q AS (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 2.0 ELSE 0.5 END AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))
        / CAST(coalesce(weight, 1) AS DOUBLE) AS key FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, nth) AS place FROM w),
l AS (SELECT a.nth, (SELECT CAST(sum(CASE WHEN b.place < a.place THEN b.source_size - 3 * b.source_size ELSE b.source_size END) AS DOUBLE)
             / CAST(sum(CASE WHEN b.place < a.place THEN 0 ELSE b.weight END) AS DOUBLE) FROM o AS b) AS level FROM o AS a),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT max(level) FROM l) * weight) AS target FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT doc_id, size, source_size, target, epochs, CAST(round(target) AS BIGINT) - epochs * source_size AS rest,
      sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
"""


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(filteraudit.joint(filteraudit.flags(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))))


# every document is walked through every order here
ORACLES["op11_filter_audit"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
      || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END)
      || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
      || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
      FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT '' AS filter_order UNION ALL
      SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(filter_order) < 5 AND NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1 : step - 1] AS earlier FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
c AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS hit, fails = x AS alone,
      len(list_filter(string_split(earlier, ''), lambda y: y <> '' AND contains(fails, y))) > 0 AS gone FROM g, s),
a AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM c GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM a
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents"))


# crc32 by its polynomial, bit by bit; near words meet in the word without a letter
ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
g AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, count(*) AS k FROM r WHERE length(run) >= 5 GROUP BY doc_id, run),
x AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(name)), lambda i: CAST('0x' || substr(hex(name), 2 * i + 1, 2) AS BIGINT))),
      lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a, b) & 255, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))) AS h FROM g),
y AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM x),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM y WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
e AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, unnest(range(length(word))) AS t(i)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM e AS a JOIN e AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT e.word, v.word, v.n FROM e JOIN v ON e.rest = v.word UNION SELECT v.word, e.word, e.n FROM e JOIN v ON e.rest = v.word),
b AS (SELECT word, count(*) AS n_near, min_by(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM v LEFT JOIN b USING (word)),
w AS (SELECT word, word AS at, form AS further FROM f UNION ALL SELECT w.word, f.word, f.form FROM w JOIN f ON w.further = f.word)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM f JOIN w ON f.word = w.word AND w.further IS NULL
"""
