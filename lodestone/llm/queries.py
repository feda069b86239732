"""Queries of the text operators over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, language, licenses, mixing, near_duplicates, pieces, pii, quality_model, quality_rules, ranking, substrings, wrappers
from .common import table

#: Vocabulary of the queries on pieces.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def surrogate_key(spark: SparkSession) -> str:
    """The key of surrogates: the setting lodestone.pii.key, or for these queries over invented texts a word that is no secret."""
    return spark.conf.get("lodestone.pii.key", "invented")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents"), surrogate_key(spark))
    return done.select("doc_id", "text", "n_entities", F.array_join("entity_kinds", ",").alias("entity_kinds"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = quality_model.score(docs.select("doc_id", "text"), quality_model.train(docs))
    return rated.select("doc_id", F.round("quality_score", 6).alias("score"), (F.col("quality_score") >= 0.5).alias("kept"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~held_out), "doc_id", "text", "lang")
    found = language.predict(docs, model)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "lang_pred", "score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode(table(spark, sf_dir, "documents"), PIECES)
    digests = F.transform("segmentations", lambda ids: F.sha2(F.array_join(ids, " "), 256))
    return done.select("doc_id", F.size(F.get("segmentations", 0)).cast("long").alias("n_pieces"), F.transform("scores", lambda x: F.round(x, 3)).alias("scores"), digests.alias("ids_sha256"), "round_trip")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_decontaminate, op3_substrings, op4_pii, op5_quality_model, op6_licenses, op7_language, op8_near_duplicates, op9_pieces, op10_main_text, op11_divergence, op12_mix, op13_search)}

ORACLE: dict[str, str] = {
    "op2_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win ON g.g = win.g AND g.n = win.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
""",
    "op11_divergence": r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT lang, source, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM w) GROUP BY ALL HAVING count(*) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM w) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(s, 0) AS s FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS s FROM n GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (s + v) AS BIGINT) AS p FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
ln AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS s FROM n GROUP BY lang, term),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (s + v) AS BIGINT) AS q FROM ln JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 200
""",
    "op12_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws(' ', 'mix', CAST(doc_id AS VARCHAR), md5(text))) AS key FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS n, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS w FROM d GROUP BY source),
o AS (SELECT *, sum(n) OVER () - coalesce(sum(3 * n) OVER f, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS among FROM s WINDOW f AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * n * among <= w * rest AS capped FROM o),
t AS (SELECT source, n, CASE WHEN capped THEN CAST(3 * n AS DOUBLE) ELSE CAST(w * (SELECT max(rest) FROM c WHERE NOT capped AND among = (SELECT max(among) FROM c WHERE NOT capped)) AS DOUBLE) / CAST((SELECT max(among) FROM c WHERE NOT capped) AS DOUBLE) END AS target FROM c),
p AS (SELECT doc_id, d.size, n, target, CAST(floor(target + 0.5) AS BIGINT) AS goal, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE (goal // n) * size + greatest(0, least(start + size, goal % n) - least(start, goal % n)) END AS BIGINT) AS taken FROM p
""",
    "op13_search": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT row_number() OVER () AS id, doc_id, w, len(w) AS n FROM w WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM d),
t AS (SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(w) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL),
k AS (SELECT term, CAST(floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM t, c GROUP BY term, c.n),
m AS (SELECT id, doc_id, 100 - 50 + ((50 * d.n * c.n) // c.l) AS m FROM d, c),
s AS (SELECT item_id, id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM i JOIN t USING (term) JOIN k USING (term) JOIN m USING (id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
""",
}
