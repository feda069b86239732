"""Registered queries of the engine over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import facts, html, segments, text, urls
from .operators import clusters, engine, lexicon, search, state, status
from .plans import analysis
from .sources import sites

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# The word rules of the test lexicon.
WORDS = ["the", "and", "from", "license", "token"]
TAGS = {w: w for w in WORDS}
LANGS = ("en", "fr", "de", "es")
REASONS = {"short": ["SHORT"], "noisy": ["SYMBOLS", "DIGITS"], "long": ["LONG"]}
AS_OF = "TIMESTAMP_NTZ '2001-01-01 00:00:00'"


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as cards: status, fit, sources, tags, flags and review reasons."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    flag = lambda c, k: F.when(c, F.lit(k))
    flags = F.array_compact(F.array(flag(F.col("n_chars") < 200, "SHORT"), flag(F.col("text").rlike("[#*$%]"), "SYMBOLS"), flag(F.col("text").rlike("[0-9]"), "DIGITS"), flag(F.col("n_chars") > 5000, "LONG")))
    d = d.select("doc_id", "text", "n_chars", F.col("lang").alias("fit"), F.col("source").alias("category"), F.array(F.struct(F.col("source").alias("name"))).alias("sources"), F.when(F.coalesce("quality", F.lit(1)) == 1, "active").otherwise("excluded").alias("status"), search.tagged(F.col("text"), TAGS).alias("tags"), flags.alias("flags"))
    return d.withColumn("review_reasons", search.review_reasons(F.col("flags"), F.lit("review"), REASONS))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).where("status = 'active'")


def joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


# Words in RE2 have no lookaround; a group of other characters at either side is the same test.
EDGE = r"(^|[^\p{L}\p{N}])%s($|[^\p{L}\p{N}])"
CARDS = rf"""WITH cards AS (SELECT d.doc_id, d.text, d.n_chars, d.lang AS fit, d.source AS category, CASE WHEN coalesce(l.quality, 1) = 1 THEN 'active' ELSE 'excluded' END AS status,
list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(strip_accents(coalesce(d.text, ''))), '{EDGE % w}') THEN '{w}' END" for w in WORDS)}], lambda x: x IS NOT NULL) AS tags,
list_filter([CASE WHEN d.n_chars < 200 THEN 'SHORT' END, CASE WHEN regexp_matches(d.text, '[#*$%]') THEN 'SYMBOLS' END, CASE WHEN regexp_matches(d.text, '[0-9]') THEN 'DIGITS' END, CASE WHEN d.n_chars > 5000 THEN 'LONG' END], lambda x: x IS NOT NULL) AS flags
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
active AS (SELECT *, list_filter([CASE WHEN list_contains(flags, 'SHORT') THEN 'short' END, CASE WHEN list_has_any(flags, ['SYMBOLS', 'DIGITS']) THEN 'noisy' END, CASE WHEN list_contains(flags, 'LONG') THEN 'long' END], lambda x: x IS NOT NULL) AS review_reasons FROM cards WHERE status = 'active')
"""


@register(CARDS + "SELECT doc_id, fit, category, n_chars, array_to_string(tags, ',') AS tags, array_to_string(review_reasons, ',') AS review_reasons FROM active ORDER BY n_chars DESC, doc_id")
def active_listing(spark, sf_dir):
    # the sort samples its input; a narrow exchange before it keeps the texts from being read twice
    rows = active(spark, sf_dir).select("doc_id", "fit", "category", "n_chars", joined("tags"), joined("review_reasons"))
    return rows.repartition("doc_id").orderBy(F.desc("n_chars"), "doc_id")


@register(CARDS + "SELECT doc_id, n_chars FROM active WHERE fit = 'en' AND category = 'src1' AND list_has_all(tags, ['the', 'and'])")
def filter_conjunction(spark, sf_dir):
    return search.search(active(spark, sf_dir), fit="en", category="src1", tags=["the", "and", "the"], fits=LANGS).select("doc_id", "n_chars")


@register(CARDS + "SELECT doc_id FROM active WHERE list_has_all(tags, ['from', 'the'])")
def tags_all_of(spark, sf_dir):
    return search.search(active(spark, sf_dir), tags=["from", "the"]).select("doc_id")


@register(r"""WITH h AS (SELECT regexp_extract(url, '^https?://(?:www\.)?([^/?#:]+)', 1) AS host, list(DISTINCT regexp_extract(url, '^(https?)', 1)) AS s, count(*) AS n FROM pages GROUP BY 1)
SELECT host, n AS n_pages FROM h WHERE list_contains(s, 'http')""")
def sources_any_of(spark, sf_dir):
    url = F.col("url")
    hosts = load(spark, sf_dir, "pages").groupBy(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "").alias("host")).agg(F.collect_set(F.struct(F.try_parse_url(url, F.lit("PROTOCOL")).alias("name"))).alias("sources"), F.count("*").alias("n_pages"))
    return search.search(hosts, source="http").select("host", "n_pages")


@register(CARDS + "SELECT doc_id FROM active WHERE list_contains(review_reasons, 'noisy')")
def review_reason_filter(spark, sf_dir):
    return search.search(active(spark, sf_dir), review="noisy", reasons=tuple(REASONS)).select("doc_id")


@register(CARDS + "SELECT k.key, CAST(count(a.doc_id) AS BIGINT) AS n FROM (VALUES ('short'), ('noisy'), ('long'), ('unused')) k(key) LEFT JOIN active a ON list_contains(a.review_reasons, k.key) GROUP BY 1")
def review_reason_counts(spark, sf_dir):
    dim = spark.createDataFrame([(k,) for k in (*REASONS, "unused")], "key string")
    return search.member_counts(active(spark, sf_dir), "review_reasons", dim, "key")


@register(CARDS + "SELECT doc_id FROM active WHERE contains(concat_ws(' ', category, lower(strip_accents(text)), array_to_string(tags, ' ')), 'the on')")
def search_substring(spark, sf_dir):
    return search.search(active(spark, sf_dir), text="Thé ON", over=("category", "text")).select("doc_id")


@register(rf"""WITH t AS (SELECT doc_id, lower(strip_accents(split_part(coalesce(text, ''), chr(10), 1))) AS t FROM documents)
SELECT doc_id FROM t WHERE (NOT regexp_matches(t, '{EDGE % "(?:of|with)"}') OR regexp_matches(t, '{EDGE % "the"}')) AND regexp_matches(t, '{EDGE % "(?:and|is|de|und)"}')""")
def candidate_predicate(spark, sf_dir):
    line = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return load(spark, sf_dir, "documents").where(search.candidate(line, "of|with", "the", "and|is|de|und")).select("doc_id")


@register("SELECT doc_id, length(text) BETWEEN 100 AND 25000 AS good_text, length(split_part(text, chr(10), 1)) <= 240 AS good_title FROM documents")
def length_guards(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.length("text").between(100, 25_000).alias("good_text"), (F.length(F.split_part("text", F.lit("\n"), F.lit(1))) <= 240).alias("good_title"))


@register(rf"SELECT doc_id, regexp_matches(lower(strip_accents(coalesce(text, ''))), '{EDGE % '(?:the|le) (?:of|de|and)'}') AS found FROM documents")
def phrase_match(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.phrase(F.col("text"), "(?:the|le) (?:of|de|and)").alias("found"))


@register(CARDS + f"SELECT doc_id, CASE {' '.join(f"WHEN list_contains(tags, '{w}') THEN '{w}'" for w in reversed(WORDS))} ELSE 'none' END AS category FROM cards")
def rule_first_match(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.coalesce(engine.first_match(text.normalize(F.col("text")), [(w, w) for w in reversed(WORDS)]), F.lit("none")).alias("category"))


@register(CARDS + "SELECT doc_id, array_to_string(list_filter(tags, lambda t: t <> 'and' OR NOT list_contains(tags, 'the')), ',') AS tags FROM cards")
def tag_set_minus(spark, sf_dir):
    tags = F.col("tags")
    return cards(spark, sf_dir).select("doc_id", F.array_join(F.when(F.array_contains(tags, "the"), F.array_except(tags, F.array(F.lit("and")))).otherwise(tags), ",").alias("tags"))


@register(CARDS + "SELECT fit AS key, count(*) AS n FROM active GROUP BY fit UNION ALL SELECT 'xx', 0 UNION ALL SELECT 'all', count(*) FROM active")
def facet_fit_counts(spark, sf_dir):
    return search.counts(active(spark, sf_dir), "fit", [*LANGS, "xx"], "all")


@register("SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 10 = 0 GROUP BY n_name")
def facet_category_counts(spark, sf_dir):
    got = load(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).count()
    return load(spark, sf_dir, "nation").join(got, "n_nationkey", "left").select("n_name", F.coalesce("count", F.lit(0)).alias("n"))


@register(CARDS + "SELECT DISTINCT unnest(tags) AS tag FROM active ORDER BY tag")
def facet_distinct_tags(spark, sf_dir):
    return active(spark, sf_dir).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


@register(CARDS + "SELECT count(*) AS n_all, count_if(status = 'excluded')::BIGINT AS n_excluded, max(n_chars) AS most FROM cards")
def scalar_counts(spark, sf_dir):
    return cards(spark, sf_dir).agg(F.count("*").alias("n_all"), F.count_if(F.col("status") == "excluded").alias("n_excluded"), F.max("n_chars").alias("most"))


@register("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type")
def category_distribution(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type")


@register("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def top_k(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5)


@register(CARDS + "SELECT doc_id, array_to_string(flags, ',') AS flags FROM cards WHERE len(flags) > 0")
def flagged_rows(spark, sf_dir):
    return cards(spark, sf_dir).where(F.size("flags") > 0).select("doc_id", joined("flags"))


# Runs and sources: event types are sources, event ids runs, values and users their outcomes.
RUNS = "WITH runs AS (SELECT event_type AS source, event_id AS run_id, CASE WHEN user_id % 7 = 0 THEN 'failed' WHEN user_id % 5 = 0 THEN 'partial' ELSE 'success' END AS status, ts AS finished_at, value, user_id FROM events)\n"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("run_id"), F.when(u % 7 == 0, "failed").when(u % 5 == 0, "partial").otherwise("success").alias("status"), F.col("ts").alias("finished_at"), "value", "user_id")


@register(RUNS + "SELECT source, max(run_id) AS run_id, arg_max(status, run_id) AS status, arg_max(value, run_id) AS value FROM runs GROUP BY source")
def latest_per_key(spark, sf_dir):
    return status.latest(runs(spark, sf_dir).select("source", "run_id", "status", "value"), "source", "run_id")


@register(RUNS + "SELECT source, max(run_id) AS run_id, arg_max(finished_at, run_id) AS finished_at FROM runs WHERE status = 'success' GROUP BY source")
def last_success_per_key(spark, sf_dir):
    return status.latest(runs(spark, sf_dir).where("status = 'success'").select("source", "run_id", "finished_at"), "source", "run_id")


STALE = "TIMESTAMP '2024-01-24 00:00:00'"


@register(RUNS + f"SELECT source, count(*) AS total, count_if(finished_at <= {STALE})::BIGINT AS stale, count_if(status = 'failed')::BIGINT AS failures FROM runs GROUP BY source")
def freshness_conditional_agg(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("finished_at") <= F.expr(STALE.replace("STAMP", "STAMP_NTZ"))).alias("stale"), F.count_if(F.col("status") == "failed").alias("failures"))


@register(
    RUNS
    + f"""SELECT d.source, coalesce(arg_max(r.status, r.run_id), 'never') AS last_status, arg_max(r.finished_at, r.run_id) AS last_finished, arg_max(CASE WHEN r.status = 'success' THEN r.finished_at END, CASE WHEN r.status = 'success' THEN r.run_id END) AS last_success,
count(r.run_id) AS total, coalesce(count_if(r.finished_at <= {STALE}), 0)::BIGINT AS stale, coalesce(count_if(r.status = 'failed'), 0)::BIGINT AS failures FROM (SELECT DISTINCT source FROM runs UNION ALL SELECT 'idle') d LEFT JOIN runs r ON r.source = d.source GROUP BY d.source"""
)
def refresh_status(spark, sf_dir):
    r = runs(spark, sf_dir)
    sources = spark.createDataFrame([(s,) for s in ("click", "error", "idle", "purchase", "signup", "view")], "source string")
    return status.refresh(sources, r, r, "source", "run_id", "finished_at", F.col("finished_at") <= F.expr(STALE.replace("STAMP", "STAMP_NTZ")), F.col("status") == "failed")


DAYS = RUNS + ", per AS (SELECT user_id, source, CASE WHEN NOT bool_or(status = 'failed' OR value > 90) THEN 'success' WHEN bool_or(status = 'success') THEN 'partial' ELSE 'failed' END AS source_status FROM runs GROUP BY user_id, source)\n"


def per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return runs(spark, sf_dir).groupBy("user_id", "source").agg(status.source_status(F.bool_or(s == "failed"), F.bool_or(F.col("value") > 90), F.bool_or(s == "success")).alias("source_status"))


@register(DAYS.replace("\n, per", ", per") + "SELECT * FROM per")
def source_status_rollup(spark, sf_dir):
    return per_source(spark, sf_dir)


@register(DAYS.replace("\n, per", ", per") + "SELECT user_id, CASE WHEN bool_and(source_status = 'failed') THEN 'failed' WHEN bool_or(source_status <> 'success') THEN 'partial' ELSE 'success' END AS run_status FROM per GROUP BY user_id")
def run_status_rollup(spark, sf_dir):
    return status.run_status(per_source(spark, sf_dir), "user_id", "source_status")


@register(RUNS + "SELECT coalesce(source, 'all') AS source, count(*) AS found, count_if(status = 'success')::BIGINT AS verified, count_if(status = 'failed')::BIGINT AS failed FROM runs GROUP BY ROLLUP (source)")
def refresh_counters(spark, sf_dir):
    s = F.col("status")
    return runs(spark, sf_dir).rollup("source").agg(F.count("*").alias("found"), F.count_if(s == "success").alias("verified"), F.count_if(s == "failed").alias("failed")).withColumn("source", F.coalesce("source", F.lit("all")))


@register(RUNS + ", r AS (SELECT source, run_id, row_number() OVER (PARTITION BY source ORDER BY run_id) AS k FROM runs WHERE status = 'failed') SELECT source, string_agg('run ' || run_id, '; ' ORDER BY run_id) AS errors FROM r WHERE k <= 5 GROUP BY source")
def bounded_error_list(spark, sf_dir):
    failed = runs(spark, sf_dir).where("status = 'failed'").select("source", "run_id", F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("e"))
    return status.first_errors(failed, ["source"], "run_id", "e", 5)


@register(RUNS + f"SELECT run_id, CASE WHEN status = 'failed' THEN 'error' WHEN finished_at IS NULL OR finished_at <= {STALE} THEN 'stale' ELSE 'fresh' END AS state FROM runs")
def stale_flag(spark, sf_dir):
    at = F.col("finished_at")
    return runs(spark, sf_dir).select("run_id", F.when(F.col("status") == "failed", "error").when(at.isNull() | (at <= F.expr(STALE.replace("STAMP", "STAMP_NTZ"))), "stale").otherwise("fresh").alias("state"))


# Recheck queues over orders: the order date is the last check, the key decides the last attempt.
QUEUE = """WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS source, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS checked, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2000-12-31 21:00:00' WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '2000-12-30 00:00:00' END AS attempted, o_orderkey % 13 = 0 AS bad FROM orders)
"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tried = F.when(k % 3 == 0, F.expr("TIMESTAMP_NTZ '2000-12-31 21:00:00'")).when(k % 3 == 1, F.expr("TIMESTAMP_NTZ '2000-12-30 00:00:00'"))
    return load(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("source"), F.when(k % 11 != 0, F.col("o_orderdate")).alias("checked"), tried.alias("attempted"), (k % 13 == 0).alias("bad"))


@register(
    QUEUE
    + """SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY attempted NULLS FIRST, checked NULLS FIRST, id) AS k FROM o
WHERE (checked IS NULL OR checked <= TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 7 DAYS OR bad) AND (attempted IS NULL OR attempted <= TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 6 HOURS)) WHERE k <= 20"""
)
def recheck_queue(spark, sf_dir):
    o = orders(spark, sf_dir)
    due = o.where(state.due(F.expr(AS_OF), F.col("checked"), F.col("attempted"), F.col("bad")))
    return state.queue(due, "source", [F.asc_nulls_first("attempted"), F.asc_nulls_first("checked"), F.asc("id")], 20).select("id", "source")


@register(QUEUE + "SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY checked NULLS FIRST, id) AS k FROM o WHERE bad) WHERE k <= 10")
def retry_failed_queue(spark, sf_dir):
    return state.queue(orders(spark, sf_dir).where("bad"), "source", [F.asc_nulls_first("checked"), F.asc("id")], 10).select("id", "source")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 3 OR o_orderkey % 11 = 0")
def pending_incremental(spark, sf_dir):
    k = F.col("o_orderkey")
    versioned = load(spark, sf_dir, "orders").select("o_orderkey", (k % 4).alias("analysis_version"), F.when(k % 11 != 0, F.col("o_orderdate")).alias("analyzed_at"))
    return state.pending(versioned, 3).select("o_orderkey")


@register("SELECT o_orderkey, o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 2 HOURS AS live, CASE WHEN o_orderstatus = 'O' AND NOT o_orderdate > TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 2 HOURS THEN 'failed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'success' END AS status FROM orders")
def lease_decision(spark, sf_dir):
    r = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("success").alias("status"))
    return state.lease(r, F.expr("TIMESTAMP_NTZ '1998-06-01 00:00:00'")).select("o_orderkey", "live", "status")


# Upserts over customers: keys below three quarters are the target, those above one half the batch.
@register("""WITH t AS (SELECT c_custkey AS k, c_mktsegment AS title, c_acctbal AS kept, 9 AS v, 1 AS seen FROM customer WHERE c_custkey % 4 < 3), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS title, 2 AS seen FROM customer WHERE c_custkey % 4 > 1)
SELECT coalesce(t.k, b.k) AS k, coalesce(b.title, t.title) AS title, t.kept, CAST(CASE WHEN b.k IS NULL THEN t.v WHEN t.k IS NULL OR t.title <> b.title THEN 0 ELSE t.v END AS INT) AS v, CAST(coalesce(b.seen, t.seen) AS INT) AS seen FROM t FULL JOIN b ON t.k = b.k""")
def upsert_merge(spark, sf_dir):
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey")
    target = c.where(k % 4 < 3).select(k.alias("k"), F.col("c_mktsegment").alias("title"), F.col("c_acctbal").alias("kept"), F.lit(9).alias("v"), F.lit(1).alias("seen"))
    batch = c.where(k % 4 > 1).select(k.alias("k"), F.when(k % 3 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("title"), F.lit(2).alias("seen"))
    return state.upsert(target, batch, "k", "seen", "title", "v")


@register("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS company, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS raw_description, CASE WHEN c_custkey % 3 = 0 THEN 'fresh' ELSE c_mktsegment END AS description,
CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'unknown' END AS availability, CASE WHEN c_custkey % 3 = 2 THEN 'gone' END AS detail_error, CAST(CASE WHEN c_custkey % 3 = 2 THEN 9 ELSE 0 END AS INT) AS analysis_version FROM customer""")
def coalesce_preserve_original(spark, sf_dir):
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey")
    none = lambda t="string": F.lit(None).cast(t)
    table = c.select(k.alias("id"), F.col("c_name").alias("title"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("description"), none().alias("raw_description"), F.lit("unknown").alias("availability"), none().alias("availability_reason"), none().alias("detail_error"), none("timestamp_ntz").alias("detail_checked_at"), none("timestamp_ntz").alias("detail_attempted_at"), F.lit(9).alias("analysis_version"))
    found = c.select(k.alias("id"), F.when(k % 3 == 0, "ok").when(k % 3 == 1, "closed").otherwise("failed").alias("outcome"), F.lit("").alias("title"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("N/A").alias("company"), F.lit("fresh").alias("description"), F.lit("gone").alias("reason"))
    return state.detailed(table, found, "id", F.expr(AS_OF)).select("id", "company", "raw_description", "description", "availability", "detail_error", "analysis_version")


@register("SELECT p_partkey, p_name, 'unknown' AS availability, CAST(0 AS INT) AS analysis_version FROM part")
def schema_evolve_defaults(spark, sf_dir):
    new = {"availability": ("string", "unknown"), "analysis_version": ("int", 0), "p_name": ("string", "x")}
    return state.evolve(state.evolve(load(spark, sf_dir, "part").select("p_partkey", "p_name"), new), new)


@register("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1")
def first_seen_dedupe(spark, sf_dir):
    order = [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return state.first_seen(load(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"), ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber")


@register("SELECT c_nationkey AS nation, count(*) AS found FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def feed_union_counts(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    feeds = c.select(F.col("c_nationkey").alias("nation")).unionByName(load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))).unionByName(c.where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation")))
    return feeds.groupBy("nation").agg(F.count("*").alias("found"))


@register("SELECT n_name, CAST(page AS INT) AS page, 'https://example.org/' || lower(n_name) || CASE WHEN page = 1 THEN '' ELSE '?page=' || page END AS link FROM nation, range(1, 4) t(page)")
def feed_page_expand(spark, sf_dir):
    from .sources.bronze import feed_pages

    page = F.when(F.col("page") == 1, "").otherwise(F.concat(F.lit("?page="), F.col("page").cast("string")))
    return feed_pages(load(spark, sf_dir, "nation").select("n_name"), 3, F.concat(F.lit("https://example.org/"), F.lower("n_name"), page))


@register("WITH s AS (SELECT l_orderkey, min(l_linenumber) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l.l_orderkey, count(*) AS n_pages FROM lineitem l LEFT JOIN s ON l.l_orderkey = s.l_orderkey WHERE last IS NULL OR l_linenumber <= last GROUP BY 1")
def pagination_take_while(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return state.take_while(lines, "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.count("*").alias("n_pages"))


# Text columns.
PLAIN = "lower(strip_accents(coalesce(text, '')))"
WORDS_SQL = rf"trim(regexp_replace({PLAIN}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@register(f"SELECT doc_id, {PLAIN} AS plain FROM documents")
def text_normalize(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("plain"))


@register(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM documents")
def text_clean(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("body"))


@register(f"SELECT doc_id, {WORDS_SQL} AS words FROM documents")
def words_canonical(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("words"))


@register("SELECT p_partkey, trim(regexp_replace(p_name, ' (widget|bolt)$', '')) AS title FROM part")
def title_canonical(spark, sf_dir):
    shown = F.concat(F.col("p_name"), F.lit(" (remote, 5 EUR)"))
    return load(spark, sf_dir, "part").select("p_partkey", text.title(shown, F.lit("none"), "widget|bolt").alias("title"))


@register("SELECT c_custkey, 'customer ' || right(c_name, 9) AS company FROM customer")
def company_canonical(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", text.company(F.concat(F.lit("SRL "), F.col("c_name"), F.lit(", Ltd")), ("srl ",), (" ltd",)).alias("company"))


@register(f"WITH w AS (SELECT doc_id, string_split({WORDS_SQL}, ' ') AS w FROM documents) SELECT doc_id, CAST(CASE WHEN len(w) < 5 THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS BIGINT) AS n FROM w")
def shingle_count(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(text.shingles(F.col("text"))).cast("long").alias("n"))


@register("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'over 2 years' WHEN 1 THEN 'over 5 ani' ELSE 'over two teams' END AS said FROM orders")
def number_words(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, "over two years").when(k == 1, "over cinci ani").otherwise("over two teams")
    return load(spark, sf_dir, "orders").select("o_orderkey", text.number_words(said).alias("said"))


@register(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM documents)
SELECT doc_id, CASE WHEN length(body) = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'verified' WHEN contains(text, ' the ') AND length(trim(split_part(string_split(text, ' the ')[-1], '.', 1))) > 0 THEN 'recovered' WHEN length(body) > 3000 OR contains(body, '###') THEN 'contaminated' ELSE 'recovered' END AS quality FROM d""")
def text_repair_quality(spark, sf_dir):
    quality = F.when(F.col("doc_id") % 5 == 0, "verified").otherwise("unverified")
    return load(spark, sf_dir, "documents").select("doc_id", text.repaired(F.col("text"), quality, " the ", ".", "###", 3000)["quality"].alias("quality"))


# First lines with what a board adds to a title: the employer, a skill, pay, a synonym, the employer again, or the place.
_LINE = "translate(split_part(coalesce(text, ''), chr(10), 1), '()', '  ')"


@register(rf"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, source, trim(regexp_replace(lower(strip_accents({_LINE})), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS w FROM documents)
SELECT doc_id, trim(CASE k WHEN 1 THEN w || ' python' WHEN 3 THEN 'system administrator ' || w WHEN 4 THEN CASE WHEN w = '' THEN source ELSE w END ELSE w END) AS title FROM d""")
def title_forms(spark, sf_dir):
    # only first lines go on, each cut from its text once
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("line"))
    line = F.translate("line", "()", "  ")
    forms = [F.concat(line, F.lit(" ("), F.initcap("source"), F.lit(")")), F.concat(line, F.lit(" (Python)")), F.concat(line, F.lit(" (500 - 700 EUR)")), F.concat(F.lit("Сис. Админ "), line), F.concat(line, F.lit(" "), F.upper("source")), F.concat(line, F.lit(", Chișinău"))]
    which = (F.col("doc_id") % 6).cast("int")
    shown, employer = reduce(lambda rest, i: F.when(which == i, forms[i]).otherwise(rest), range(len(forms)), F.lit(None)), F.concat(F.lit("ICS "), "source")
    return d.select("doc_id", text.title(shown, employer).alias("title"))


@register("SELECT c_custkey, CASE c_custkey % 5 WHEN 3 THEN w || ' ltd' WHEN 4 THEN 'sc ' || w ELSE w END AS company FROM (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS w FROM customer)")
def company_forms(spark, sf_dir):
    forms = [("ICS ", " S.R.L."), ("O.C.N. «", "»"), ("", " SA"), ("", ", Ltd"), ("SC ", " srl")]
    name = F.get(F.array(*[F.concat(F.lit(a), "c_name", F.lit(b)) for a, b in forms]), (F.col("c_custkey") % 5).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", text.company(name).alias("company"))


# Whole pages as they were stored: a menu, the mark twice, the text, and what ends it; every fifth is verified, and some are of no known site.
@register(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 5 = 0 THEN 'verified' ELSE 'unverified' END AS q, doc_id % 4 AS k FROM documents),
s AS (SELECT *, CASE k WHEN 0 THEN 'Menu Descrierea poziției vacante links Descrierea poziției vacante' || t || ' Trimite CV acum Despre companie 10 ani' WHEN 1 THEN t || ' Top angajator' WHEN 2 THEN t ELSE 'Descrierea poziției vacante ' || t END AS body FROM d),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN k = 0 THEN t ELSE body END, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain FROM s),
r AS (SELECT *, CASE WHEN body = '' THEN 'missing' WHEN q = 'verified' THEN 'verified' WHEN length(body) > 25000 OR k = 1 THEN 'contaminated' ELSE 'recovered' END AS quality FROM c)
SELECT doc_id, quality, md5(CASE quality WHEN 'verified' THEN body WHEN 'recovered' THEN plain ELSE '' END) AS body_md5 FROM r""")
def stored_text_repair(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    bodies = [F.concat(F.lit("Menu Descrierea poziției vacante links Descrierea poziției vacante"), t, F.lit(" Trimite CV acum Despre companie 10 ani")), F.concat(t, F.lit(" Top angajator")), t, F.concat(F.lit("Descrierea poziției vacante "), t)]
    k = (F.col("doc_id") % 4).cast("int")
    d = load(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*bodies), k).alias("body"), F.when(F.col("doc_id") % 5 == 0, "verified").otherwise("unverified").alias("q"), F.when(k < 2, "Delucru.md").otherwise("Lucru.md").alias("source"))
    got = sites.stored_text(F.col("body"), F.col("q"), F.col("source"))
    return d.select("doc_id", F.inline(F.array(got))).select("doc_id", "quality", F.md5("text").alias("body_md5"))


# Sentences keep their ends; in SQL an abbreviation is hidden while the text is cut.
SAID = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)([ei]\.\s?[ge])\.', '\1' || chr(2), 'g'), '([\n;!?])', '\1' || chr(1), 'g'), '\.(\s+\p{L})', '.' || chr(1) || '\1', 'g'), chr(1)), lambda s: replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), chr(2), '.')), lambda s: length(s) > 0)"


@register(f"WITH s AS (SELECT doc_id, {SAID} AS s FROM documents) SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS said FROM s")
def sentence_split(spark, sf_dir):
    found = load(spark, sf_dir, "documents").select("doc_id", segments.sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("said"))


@register("SELECT n_nationkey, 'Intro ' || n_name AS intro, 'do ' || n_name || chr(10) || 'and more' AS responsibilities, 'know SQL. No header here: requirement' || chr(10) || 'знать ' || n_name AS requirements, 'tea' || chr(10) || '- ceai' AS benefits, 'Git' AS preferred FROM nation")
def section_split(spark, sf_dir):
    parts = ["Intro ", F.col("n_name"), "\nDuties:\ndo ", F.col("n_name"), "\nRequirements: know SQL. No header here: requirement\nWHAT WE OFFER\ntea\nResponsabilități\nand more\nТребования:\nзнать ", F.col("n_name"), "\nBeneficii: - ceai\nNice to have:\nGit"]
    body = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return load(spark, sf_dir, "nation").select("n_nationkey", segments.sections(body).alias("s")).select("n_nationkey", "s.intro", "s.responsibilities", "s.requirements", "s.benefits", "s.preferred")


@register(rf"""WITH s AS (SELECT doc_id, list_filter({SAID}, lambda s: regexp_matches(lower(strip_accents(s)), '\bthe\b')) AS s FROM documents), u AS (SELECT doc_id, list_filter(s, lambda x, i: list_position(s, x) = i)[1:3] AS s FROM s)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS quotes FROM u""")
def evidence_top3(spark, sf_dir):
    quotes = segments.evidence(segments.records(F.col("text"), "Vacancy text"), r"(?<![a-z0-9_])the(?![a-z0-9_])")
    found = load(spark, sf_dir, "documents").select("doc_id", F.transform(quotes, lambda q: q["text"]).alias("q"))
    return found.select("doc_id", F.size("q").cast("long").alias("n"), F.md5(F.array_join("q", "|")).alias("quotes"))


# What is said of experience, by order, and the years that it asks for (n: a number from 2 to 9).
SAID_YEARS = [("{n}+ years of experience. Also 9 years preferred experience", "n"), ("experience of 6 months", "0.5"), ("experience up to 1 year", "0"), ("the company has 20 years of experience", None), ("Опыт работы не менее {n}-х лет", "n"), ("Experiență de minim {n} ani", "n"), ("at least two years, or {n} years of experience", "n"), ("{n} years of experience or students", None), ("Minimum {n} yrs experience; driving experience of 9 years", "n"), ("{n} months of experience", "n / 12")]


@register(f"WITH o AS (SELECT o_orderkey, o_orderkey % 8 + 2.0 AS n FROM orders) SELECT o_orderkey, CASE o_orderkey % {len(SAID_YEARS)} {' '.join(f'WHEN {i} THEN {v}' for i, (_, v) in enumerate(SAID_YEARS) if v)} END::DOUBLE AS minimum FROM o")
def experience_extract(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.get(F.array(*[F.regexp_replace(F.lit(t), r"\{n\}", (k % 8 + 2).cast("string")) for t, _ in SAID_YEARS]), (k % len(SAID_YEARS)).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", facts.experience(said)["minimum"].alias("minimum"))


# What is said of pay, by part, and what counts of it (n: hundreds).
SAID_PAY = [("Salary {n} EUR", "{n} EUR"), ("Salary:\n{n} lei\n900 lei;\nother", "{n} lei; 900 lei"), ("Salary after internship {n} EUR", ""), ("Salary: EUR {n}", "EUR {n}"), ("Remunerare: de la {n} lei net", "de la {n} lei"), ("Compensation: {n} - 99 000 USD a month", "{n} - 99 000 USD"), ("Payment terms: invoices over {n} EUR", ""), ("Зарплата: от {n} до 99 000 лей", "от {n} до 99 000 лей"), ("Salary\n{n} MDL per month", "{n} MDL"), ("Premium of {n} EUR", "")]


@register(f"WITH p AS (SELECT p_partkey, p_size || '00' AS n FROM part) SELECT p_partkey, CASE WHEN p_partkey % 11 = 10 THEN n ELSE replace(['{"', '".join(v for _, v in SAID_PAY)}'][p_partkey % 11 + 1], '{{n}}', n) END AS salary FROM p".replace("\n", "' || chr(10) || '"))
def salary_extract(spark, sf_dir):
    k, n = (F.col("p_partkey") % 11).cast("int"), F.concat(F.col("p_size").cast("string"), F.lit("00"))
    body = F.get(F.array(*[F.regexp_replace(F.lit(t), r"\{n\}", n) for t, _ in SAID_PAY]), k)
    return load(spark, sf_dir, "part").select("p_partkey", facts.salary(F.when(k == 10, n), F.col("p_name"), body).alias("salary"))


# Titles and duties that are paired by order key; each rule is one search in SQL, in the same order.
TITLED = ["Junior QA tester", "Data Scientist - Python Developer", "Office manager", "Специалист ИТ-поддержки", "Linux developer", "Helper", "Specialist IT", "WordPress Developer", "Account manager for SEO", "Suport tehnic", "Internship IT", "Графический дизайнер", "Programator 1C"]
DUTIES = ["plain duties", "reset of passwords and technical issues", "seo and google ads", "bug reports", "information technology", "we write clean code", "анализ данных"]
_EDGE = r"(^|[^\p{{L}}\p{{N}}])(?:{0})($|[^\p{{L}}\p{{N}}])"


def _first(column: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{_EDGE.format(p)}') THEN '{k}'" for k, p in rules) + " END"


@register(
    f"""WITH o AS (SELECT o_orderkey, lower(['{"', '".join(TITLED)}'][o_orderkey % {len(TITLED)} + 1]) AS t, lower(['{"', '".join(DUTIES)}'][o_orderkey % {len(DUTIES)} + 1]) AS d FROM orders),
r AS (SELECT *, regexp_matches(t, '{_EDGE.format(lexicon.NON_TECH)}') AS odd, CASE WHEN regexp_matches(t, '{_EDGE.format(lexicon.DEVELOPER)}') AND NOT regexp_matches(t, '{lexicon.NOT_DEVELOPER}') THEN 'Software Development' ELSE {_first("t", [(k, p) for k, p, _ in lexicon.CATEGORIES])} END AS titled, {_first("d", [(k, p) for k, _, p in lexicon.CATEGORIES])} AS duty, {_first("d", [(k, p) for k, _, p in lexicon.CATEGORIES if k not in ("General IT", "IT Internships")])} AS closer FROM o),
n AS (SELECT *, coalesce(titled, CASE WHEN NOT odd THEN duty END) AS named FROM r)
SELECT o_orderkey, CASE WHEN odd OR named IS NULL THEN 'General IT' WHEN named = 'General IT' THEN coalesce(closer, named) ELSE named END AS category, odd OR named IS NULL AS unrelated FROM n"""
)
def title_category(spark, sf_dir):
    pick = lambda of: F.get(F.array(*map(F.lit, of)), (F.col("o_orderkey") % len(of)).cast("int"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", text.normalize(pick(TITLED)).alias("_title"), text.normalize(pick(DUTIES)).alias("_relevant"))
    return engine.categorised(rows).select("o_orderkey", "category", F.col("_unrelated").isNotNull().alias("unrelated"))


FIT = "CASE l_linenumber % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'other' WHEN 2 THEN 'stretch' ELSE 'beginner' END"


@register(f"""SELECT l_orderkey, l_linenumber, CAST(least(35 + CASE WHEN l_returnflag = 'R' THEN 35 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 20 WHEN l_quantity > 25 THEN 20 ELSE 0 END + CASE WHEN l_tax > 0.04 THEN 15 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 5 ELSE 0 END,
CASE {FIT} WHEN 'review' THEN 49 WHEN 'other' THEN 30 WHEN 'stretch' THEN 65 ELSE 100 END) AS INT) AS fit_score FROM lineitem""")
def score_case(spark, sf_dir):
    points = engine.score(F.expr("l_returnflag = 'R'"), F.expr("l_linestatus = 'O'"), F.expr("l_quantity > 25"), F.expr("l_tax > 0.04"), F.expr("l_discount > 0.05"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", engine.capped(points, F.expr(FIT)).cast("int").alias("fit_score"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' AND l_tax > 0.05 THEN 'closed' WHEN l_quantity > 40 THEN 'senior' WHEN l_returnflag = 'R' THEN 'outside' WHEN l_discount < 0.02 THEN 'unrelated' END AS reason FROM lineitem")
def exclusion_precedence(spark, sf_dir):
    rules = [("unrelated", F.expr("l_discount < 0.02")), ("outside", F.expr("l_returnflag = 'R'")), ("senior", F.expr("l_quantity > 40")), ("closed", F.expr("l_linestatus = 'F' AND l_tax > 0.05"))]
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", engine.last_reason(rules).alias("reason"))


@register()
def rule_engine(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text", F.col("source").alias("location"), F.lit("remote").alias("work_mode"), F.lit(None).cast("string").alias("schedule"), F.lit("verified").alias("description_quality"), F.lit("open").alias("availability"), F.lit(0).alias("analysis_version"), F.lit(None).cast("timestamp_ntz").alias("analyzed_at"))
    return analysis.analyse(d, F.expr(AS_OF)).select("id", "category", joined("tags"), joined("quality_flags"), "entry_fit", "fit_score", "status", "exclusion_reason")


# URLs, pages and JSON.
@register(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS s, regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) AS h, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS r FROM pages)
SELECT page_id, CASE WHEN s = 'https' AND regexp_full_match(r, '/(en|fr|de|es)/\d+') THEN s || '://' || h || r END AS link FROM p""")
def url_canonicalize(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.safe_link(F.col("url"), path=r"/(en|fr|de|es)/\d+").alias("link"))


@register(r"SELECT page_id, regexp_extract(url, '/(\d+)/?(?:[?#].*)?$', 1) AS id FROM pages")
def url_id_extract(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.trailing_id(F.col("url")).alias("id"))


def _without(page: str, *tags: str) -> str:
    for tag in tags:
        page = f"regexp_replace({page}, '(?s)<{tag}>.*?</{tag}>', '', 'g')"
    return page


def _visible(page: str) -> str:
    """SQL for the text of a regular page: blocks end lines, other tags go, references are read, spaces are single."""
    page = f"regexp_replace(regexp_replace(regexp_replace({page}, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '<br>|</(p|div|li|ul|ol|h[1-6]|tr|section|article|header|main|table)>', chr(10), 'g'), '<[^>]+>', '', 'g')"
    for name, sign in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        page = f"replace({page}, '&{name};', '{sign}')"
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({page}, '[ \\t\\r\\f\\v]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@register(f"SELECT page_id, {_visible(_without("coalesce(html, '')", 'title', 'style', 'script', 'nav', 'footer'))} AS text FROM pages")
def html_to_text(spark, sf_dir):
    body = html.html_to_text("html")
    return load(spark, sf_dir, "pages").select("page_id", body.alias("text"))


@register(f"""WITH p AS (SELECT page_id, {_visible("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, CAST(length({_visible("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")}) AS BIGINT) AS n_chars FROM pages)
SELECT page_id, nullif(title, '') AS title, n_chars, CASE WHEN n_chars < 100 THEN 'description too short' WHEN n_chars > 25000 THEN 'description too long' END AS error FROM p""")
def html_main_text(spark, sf_dir):
    found = sites.details(load(spark, sf_dir, "pages").select("page_id", F.lit("page").alias("source"), "html"), {"page": sites.GENERIC})
    return found.select("page_id", F.when(F.col("title") != "", F.col("title")).alias("title"), F.length("description").cast("long").alias("n_chars"), "error")


@register(r"WITH n AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages) SELECT page_id, unnest(regexp_extract_all(nav, '<a href=\"([^\"]*)\">', 1)) AS link FROM n")
def html_listing_links(spark, sf_dir):
    found = load(spark, sf_dir, "pages").select("page_id", F.explode(html.listing_links(F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1))).alias("x"))
    return found.select("page_id", "x.link")


# Pages with one of several notices around them, so that some are closed: by a status element, by a date, or not (hidden, or said beside the advert).
NOTICES = ["<div class='alert'>This vacancy is no longer available</div>{0}", "<h1>Вакансия закрыта</h1>{0}", "<p>This job is closed</p><div class='vacancy-content'>{0}</div>", "<div class='alert' hidden>This job has expired</div><div class='vacancy-content'>{0}</div>", "<script type='application/ld+json'>{{\"@type\":\"JobPosting\",\"title\":\"x\",\"description\":\"y\",\"validThrough\":\"2000-05-01\"}}</script>{0}", "<script type='application/ld+json'>{{\"@type\":\"JobPosting\",\"title\":\"x\",\"description\":\"y\",\"validThrough\":\"2002-05-01\"}}</script>{0}"]


@register("SELECT page_id, page_id % 6 IN (0, 1, 4) AS closed, CASE page_id % 6 WHEN 0 THEN 'This vacancy is no longer available' WHEN 1 THEN 'Вакансия закрыта' WHEN 4 THEN 'posting expired' END AS reason FROM pages")
def closed_detect(spark, sf_dir):
    around = [n.format("\u0001").split("\u0001") for n in NOTICES]
    part = lambda i: F.get(F.array(*[F.lit(a[i]) for a in around]), (F.col("page_id") % len(NOTICES)).cast("int"))
    page = F.concat(part(0), F.coalesce("html", F.lit("")), part(1))
    found = sites.details(load(spark, sf_dir, "pages").select("page_id", F.lit("page").alias("source"), page.alias("html")), {"page": sites.GENERIC})
    return found.select("page_id", sites.closed(F.expr(AS_OF)).alias("c")).select("page_id", "c.closed", "c.reason")


# Links of pages as references of five kinds, read on the page they stand on.
def _codes(path: str) -> str:
    return f"replace(replace(url_encode({path}), '%2C', ','), '%2F', '/')"


@register(rf"""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+', 0) AS scheme, regexp_extract(url, '//([^/?#]*)', 1) AS host, regexp_extract(url, '//[^/]*([^?#]*)', 1) AS path, regexp_extract(url, '\?[^#]*', 0) AS query, x.i AS pos, substr(x.h, 2) AS word
  FROM (SELECT page_id, url, unnest(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h, i: {{'h': h, 'i': i - 1}})) AS x FROM pages)),
w AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder, {_codes('word')} AS coded FROM l)
SELECT page_id, pos, CASE pos % 5 WHEN 0 THEN scheme || '://' || host || '/' || coded WHEN 1 THEN scheme || '://' || host || folder || coded WHEN 2 THEN scheme || '://' || host || coalesce(nullif(regexp_replace(folder, '[^/]+/$', ''), ''), '/') || coded WHEN 3 THEN scheme || '://files.example.org/' || coded ELSE scheme || '://' || host || path || '?w=1#' || word END AS link FROM w""")
def url_resolve(spark, sf_dir):
    hrefs = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"')), lambda h: F.substring(h, 2, 1 << 20))
    found = load(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(hrefs).alias("pos", "word"))
    kinds = [F.concat(F.lit("/"), F.col("word")), F.col("word"), F.concat(F.lit(".././"), F.col("word")), F.concat(F.lit(" //Files.example.org/a/../"), F.col("word")), F.concat(F.lit("?w=1#"), F.col("word"))]
    link = F.get(F.array(*kinds), F.col("pos") % 5)
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), urls.shown(urls.resolve(link, F.col("url"))).alias("link"))


# The menus of pages as lists of adverts of three sites: a card an entry, with an icon, a badge and a company; links are relative, of another host, or not of an advert.
SITE_LINKS = {"Rabota.md": ("/ro/joburi/$1/1/22?from=menu", "https://www.rabota.md/ro/locuri-de-munca/{}/22"), "Lucru.md": ("//lucru.md/ru/munca/$1/77/", "https://www.lucru.md/ru/munca/{}/77"), "Delucru.md": ("/ro/job/{}#$1", "https://www.delucru.md/ro/job/{}")}
ENTRY = r'<li><a href="/([^"]*)">([^<]*)</a></li>'


@register(rf"""WITH l AS (SELECT page_id, page_id % 3 AS k, unnest(regexp_extract_all(html, '{ENTRY}', 1)) AS slug, unnest(regexp_extract_all(html, '{ENTRY}', 2)) AS word FROM pages),
w AS (SELECT DISTINCT page_id, k, slug, regexp_replace(replace(word, '&amp;', '&'), '\s+', ' ', 'g') AS word, CASE k WHEN 0 THEN 'https://www.rabota.md/ro/locuri-de-munca/' || {_codes('slug')} || '/22' WHEN 1 THEN 'https://www.lucru.md/ru/munca/' || {_codes('slug')} || '/77' ELSE 'https://www.delucru.md/ro/job/' || page_id END AS link FROM l)
SELECT page_id, CASE k WHEN 0 THEN 'Rabota.md' WHEN 1 THEN 'Lucru.md' ELSE 'Delucru.md' END AS source, link, CASE WHEN k = 2 THEN 'Operator' ELSE word END AS title, CASE k WHEN 0 THEN word || ' SRL' WHEN 1 THEN 'N/A' ELSE 'Gama' END AS company FROM w GROUP BY ALL""")
def listing_adverts(spark, sf_dir):
    names = list(SITE_LINKS)
    k = (F.col("page_id") % 3).cast("int")
    cards = [
        f"""<div class="vacancyCardItem"><a class="vacancyShowPopup x" href="{SITE_LINKS[names[0]][0]}"><svg><b>i</b></svg> <span>$2</span><i class="badge">NEW</i></a><p><a href="/ro/companies/3">$2 SRL</a></p></div>""",
        f"""<div data-vacancy-id="7"><h2><a class="vacancyShowPopup" href="{SITE_LINKS[names[1]][0]}">$2<i class="salary">500 EUR</i></a></h2><span class="company-name">Facebook</span></div><a class="vacancyShowPopup" href="/ru/munca">$2</a>""",
        """<div class="job-item"><div class="job-title"><a class="link-job" href="/ro/job/{}#$1">Operator</a></div><i class="company-name"> Gama </i></div><a class="link-job" href="https://evil.test/ro/job/1">$2</a>""",
    ]
    card = F.replace(F.get(F.array(*map(F.lit, cards)), k), F.lit("{}"), F.col("page_id").cast("string"))
    page = F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.regexp_extract_all("html", F.lit(ENTRY), F.lit(0)), lambda e: F.regexp_replace(e, F.lit(ENTRY), card)), "\n"))
    pages = load(spark, sf_dir, "pages").select("page_id", F.get(F.array(*map(F.lit, names)), k).alias("source"), page.alias("html"))
    return sites.listing(pages, keep=("page_id",)).select("page_id", "source", "link", "title", "company")


# The articles of pages in the places that sites keep their adverts in: first of a chain, after a short one, in a posting alone, and by id.
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"


# Where the fourth shape's own element is too short, the one around it counts, with the word before it.
@register(rf"""WITH a AS (SELECT page_id, page_id % 4 AS k, {_visible(_ARTICLE)} AS t FROM pages), p AS (SELECT page_id, k, CASE WHEN k = 3 AND length(t) < 100 THEN 'Top' || t ELSE t END AS body FROM a)
SELECT page_id, CASE k WHEN 0 THEN 'Head ' || page_id WHEN 1 THEN 'First' WHEN 2 THEN 'Posted' ELSE 'Op' END AS title, CASE k WHEN 0 THEN 'Alfa' WHEN 2 THEN 'Beta' ELSE 'N/A' END AS company, CASE k WHEN 0 THEN 'Orhei' WHEN 2 THEN 'Balti, Cahul' WHEN 3 THEN 'Ungheni' ELSE '' END AS location,
CASE WHEN k = 2 THEN 'Remote' WHEN k = 3 THEN 'Oficiu' ELSE '' END AS work_mode, CASE k WHEN 0 THEN '900 EUR' WHEN 3 THEN '700' ELSE '' END AS salary, md5(CASE WHEN k <> 2 OR length(body) > 0 THEN body ELSE '' END) AS body_md5, CASE WHEN length(body) < 100 THEN 'description too short' WHEN length(body) > 25000 THEN 'description too long' END AS error FROM p""")
def detail_pages(spark, sf_dir):
    article = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    graph = F.to_json(F.struct(F.array(F.struct(F.array(F.lit("Thing"), F.lit("JobPosting")).alias("@type"), F.lit("Posted").alias("title"), article.alias("description"), F.lit("TELECOMMUTE").alias("jobLocationType"), F.struct(F.lit("Beta").alias("name")).alias("hiringOrganization"), F.array(*[F.struct(F.struct(F.lit(x).alias("addressLocality")).alias("address")) for x in ("Balti", "Cahul")]).alias("jobLocation"))).alias("@graph")))
    shapes = [
        F.concat(F.lit("<p class='vacancy-title'>Head "), F.col("page_id").cast("string"), F.lit("</p><b class='vacancy-summary-item-mobile'>Orhei</b><i class='vacancy-salary'>900  EUR</i><div class='vacancy-info'><a href='/ro/companies/1'>Alfa</a></div><div class='vacancy-content'>"), article, F.lit("</div><aside>More adverts</aside>")),
        F.concat(F.lit("<h1>First</h1><div class='vacancy-content'>Short</div><div data-js-vacancy-content>"), article, F.lit("</div>")),
        F.concat(F.lit("<script type='application/ld+json'>{broken</script><script type='application/ld+json'>"), graph, F.lit("</script><main>Menu</main>")),
        F.concat(F.lit("<h1 class='job-item-title'>Op</h1><div id='job-description'>Top<div class='content-text'>"), article, F.lit("</div></div><div><b class='text-muted3'>Oraș:</b> <b>Ungheni</b></div><div><b class='text-muted3'>Locație:</b><b></b><b>Oficiu</b></div><div><b class='text-muted3'>Salariu:</b><b>700</b></div>")),
    ]
    k = (F.col("page_id") % 4).cast("int")
    pages = load(spark, sf_dir, "pages").select("page_id", F.when(k == 3, "Delucru.md").when(k == 2, "Lucru.md").otherwise("Rabota.md").alias("source"), F.get(F.array(*shapes), k).alias("html"))
    return sites.details(pages).select("page_id", "title", "company", "location", "work_mode", "salary", F.md5("description").alias("body_md5"), "error")


@register("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(props->>'k' AS INT) END AS k FROM events")
def json_parse_tolerant(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    return load(spark, sf_dir, "events").select("event_id", F.coalesce(text.json_object(raw, "map<string,int>")["k"], F.lit(-1)).alias("k"))


@register("SELECT event_id, '{\"k\":' || CAST(props->>'k' AS VARCHAR) || '}' AS props FROM events")
def json_roundtrip(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.to_json(text.json_object(F.col("props"), "map<string,int>")).alias("props"))


@register(r"SELECT '| ' || n_nationkey || ' | ' || n_name || '\|x |' AS line FROM nation")
def markdown_rows(spark, sf_dir):
    return load(spark, sf_dir, "nation").select(F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), text.cell(F.concat(F.col("n_name"), F.lit("|x"))), F.lit(" |")).alias("line"))


@register("SELECT event_id, strftime(ts + INTERVAL 2 HOURS, '%d/%m/%Y, %H:%M') AS shown FROM events")
def date_format_tz(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", text.shown_date(F.col("ts").cast("timestamp"), "Europe/Chisinau").alias("shown"))


# Near-duplicate cards: blocks of one language and one source.
BLOCKS = rf"""WITH d AS (SELECT doc_id AS id, lang, source, n_chars, trim(regexp_replace(lower(strip_accents(split_part(coalesce(text, ''), chr(10), 1))), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS title, string_split({WORDS_SQL}, ' ') AS w FROM documents),
s AS (SELECT *, list_distinct(string_split(title, ' ')) AS t, CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM d),
p AS (SELECT a.id AS a, b.id AS b, a.title = b.title AS same, 2.0 * len(list_intersect(a.t, b.t)) / nullif(len(a.t) + len(b.t), 0) AS titles, least(len(a.g), len(b.g)) AS shortest, coalesce(2.0 * len(list_intersect(a.g, b.g)) / nullif(len(a.g) + len(b.g), 0), 0.0) AS dice FROM s a JOIN s b ON a.lang = b.lang AND a.source = b.source AND a.id < b.id)
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    line = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return d.select(F.col("doc_id").alias("id"), "lang", "source", "n_chars", text.words(line).alias("title"), text.shingles(F.col("text"), hashed=True).alias("shingles")).withColumn("tokens", F.array_distinct(F.split("title", " ")))


@register(BLOCKS + "SELECT a, b FROM p WHERE same OR (titles >= 0.7 AND shortest >= 25 AND dice >= 0.88)")
def dedup_pairs(spark, sf_dir):
    return clusters.pairs(blocks(spark, sf_dir), ["lang", "source"])


@register(BLOCKS + "SELECT a, b, round(dice, 9) AS dice FROM p WHERE same OR dice >= 0.88")
def dedup_dice(spark, sf_dir):
    return clusters.candidates(blocks(spark, sf_dir), ["lang", "source"]).select("a", "b", F.round("dice", 9).alias("dice"))


@register(BLOCKS + "SELECT lang, title, arg_max(id, (n_chars, -id)) AS primary_id FROM d GROUP BY lang, title")
def dedup_representative(spark, sf_dir):
    d = blocks(spark, sf_dir).drop("shingles", "tokens")
    return d.groupBy("lang", "title").agg(F.max_by("id", F.struct("n_chars", -F.col("id"))).alias("primary_id"))


@register(BLOCKS + "SELECT min(id) AS cluster_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(DISTINCT id) - 1 AS duplicate_count FROM d GROUP BY lang, title")
def dedup_cluster_sources(spark, sf_dir):
    d = blocks(spark, sf_dir).drop("shingles", "tokens").withColumn("link", F.col("id").cast("string"))
    d = d.withColumn("cluster_id", F.min("id").over(Window.partitionBy("lang", "title")))
    names = F.array_sort(F.array_distinct(F.transform("sources", lambda s: s["name"])))
    return clusters.cards_of(d, "cluster_id", [F.col("n_chars"), -F.col("id")], "link", "source").select("cluster_id", F.array_join(names, ",").alias("sources"), "duplicate_count")


@register()
def dedup_clusters(spark, sf_dir):
    return clusters.clusters(blocks(spark, sf_dir), ["lang", "source"], ["id"])


# Coverage and audits.
COVER = "WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'excluded' ELSE 'active' END AS st FROM lineitem WHERE l_orderkey % 3 <> 0), f AS (SELECT l_orderkey, arg_min(st, (l_linenumber, st)) AS st FROM s GROUP BY 1), c AS (SELECT o_orderkey AS id, o_orderpriority AS source, CASE WHEN st IS NULL THEN 'missing' WHEN st = 'active' THEN 'visible' ELSE 'stored_excluded' END AS outcome FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)\n"


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = load(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "excluded").otherwise("active").alias("status"), "l_linenumber")
    stored = stored.withColumn("at", F.struct("l_linenumber", "status"))
    return status.coverage(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source")), stored, ["id"], "at")


@register(COVER + "SELECT id, source, outcome FROM c")
def coverage_left_join(spark, sf_dir):
    return covered(spark, sf_dir).select("id", "source", "outcome")


@register(COVER + "SELECT source, count(*) AS candidates, count_if(outcome = 'visible')::BIGINT AS visible, count_if(outcome = 'stored_excluded')::BIGINT AS excluded, count_if(outcome = 'missing')::BIGINT AS missing FROM c GROUP BY source")
def coverage_summary(spark, sf_dir):
    n = lambda k: F.count_if(F.col("outcome") == k)
    return covered(spark, sf_dir).groupBy("source").agg(F.count("*").alias("candidates"), n("visible").alias("visible"), n("stored_excluded").alias("excluded"), n("missing").alias("missing"))


@register("SELECT d.doc_id, concat_ws(',', CASE WHEN (d.n_chars > 300)::INT IS DISTINCT FROM l.quality THEN 'quality' END, CASE WHEN (d.n_chars > 4000)::INT IS DISTINCT FROM l.toxic THEN 'toxic' END) AS wrong FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def audit_diff(spark, sf_dir):
    both = load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id")
    wrong = status.differences({"quality": ((F.col("n_chars") > 300).cast("int"), F.col("quality")), "toxic": ((F.col("n_chars") > 4000).cast("int"), F.col("toxic"))})
    return both.select("doc_id", F.array_join(wrong, ",").alias("wrong"))


# Personal state: users are owners, event types what they did to a document.
STATES = "WITH e AS (SELECT *, user_id % 50 AS doc, CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN 'interview' WHEN 'error' THEN '' END AS st FROM events WHERE event_type IN ('purchase', 'signup', 'error'))\n"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return load(spark, sf_dir, "events").where(t.isin("purchase", "signup", "error")).select("user_id", "event_id", "ts", F.when(t == "purchase", "applied").when(t == "signup", "interview").otherwise("").alias("st"))


@register(
    STATES
    + """, r AS (SELECT user_id, ts, event_id, st, sum(CASE WHEN st = '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e), l AS (SELECT user_id, arg_max(st, (ts, event_id)) AS status, max(ts) AS updated_at, max(run) AS run FROM r GROUP BY 1)
SELECT l.user_id, l.status, min(r.ts) AS applied_at, l.updated_at FROM l JOIN r ON r.user_id = l.user_id AND r.run = l.run AND r.st <> '' WHERE l.status <> '' GROUP BY ALL"""
)
def application_state_fold(spark, sf_dir):
    return state.personal(changes(spark, sf_dir), ["user_id"], "ts", F.col("st"), [F.asc("ts"), F.asc("event_id")]).select("user_id", "status", "applied_at", "updated_at")


@register("SELECT count_if(event_type = 'view')::BIGINT AS saved, count_if(event_type IN ('purchase', 'signup'))::BIGINT AS applications, count_if(value < 2)::BIGINT AS hidden FROM events")
def personal_counts(spark, sf_dir):
    return load(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "view").alias("saved"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("applications"), F.count_if(F.col("value") < 2).alias("hidden"))


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 20)")
def hidden_anti_join(spark, sf_dir):
    hidden = load(spark, sf_dir, "events").where("event_type = 'error' AND value > 20").select(F.col("user_id").alias("doc_id"))
    return search.hidden_out(load(spark, sf_dir, "documents").select("doc_id"), hidden, "doc_id")


@register("WITH s AS (SELECT event_id AS entry_id, unnest([user_id, user_id + 1]) AS l FROM events WHERE event_type = 'view'), c AS (SELECT o_orderkey AS card_id, unnest([o_orderkey, o_custkey]) AS l FROM orders) SELECT card_id, min(entry_id) AS entry_id FROM c JOIN s ON c.l = s.l GROUP BY card_id")
def alias_overlap_join(spark, sf_dir):
    entries = load(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("event_id").alias("entry_id"), F.array(F.col("user_id"), F.col("user_id") + 1).alias("links"))
    return state.overlaps(entries, load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("card_id"), F.array("o_orderkey", "o_custkey").alias("links")))


@register("SELECT e.event_id, coalesce(d.source, 'snapshot') AS source, d.doc_id IS NULL AS saved_snapshot FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id AND d.lang = 'en' WHERE e.event_type = 'view'")
def snapshot_coalesce_join(spark, sf_dir):
    live = load(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("user_id"), "source")
    saved = load(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "user_id").join(live, "user_id", "left")
    return saved.select("event_id", F.coalesce("source", F.lit("snapshot")).alias("source"), F.col("source").isNull().alias("saved_snapshot"))


@register(CARDS + "SELECT k.key, CAST(count(c.doc_id) AS BIGINT) AS n FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('xx')) k(key) LEFT JOIN cards c ON c.fit = k.key GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM cards")
def analyzed_fit_counts(spark, sf_dir):
    return search.counts(cards(spark, sf_dir), "fit", ["en", "de", "fr", "es", "xx"], "all")


SAVED = "mine AS (SELECT doc_id, fit, category, n_chars AS fit_score, tags FROM active WHERE doc_id IN (SELECT user_id FROM events WHERE event_type = 'view'))\n"


def mine(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = load(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("doc_id"))
    return entries, active(spark, sf_dir).withColumn("fit_score", F.col("n_chars"))


@register(CARDS + "," + SAVED + "SELECT doc_id, fit_score FROM mine WHERE fit = 'en' AND list_has_all(tags, ['the']) ORDER BY fit_score DESC, doc_id")
def personal_view(spark, sf_dir):
    entries, live = mine(spark, sf_dir)
    return search.personal_view(entries, live, "doc_id", fit="en", fits=LANGS, tags=["the"]).select("doc_id", "fit_score")


@register(CARDS + "," + SAVED + "SELECT k.key, CAST(count(m.doc_id) AS BIGINT) AS n FROM (VALUES ('en'), ('de'), ('fr'), ('es')) k(key) LEFT JOIN mine m ON m.fit = k.key GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM mine")
def personal_fit_counts(spark, sf_dir):
    entries, live = mine(spark, sf_dir)
    return search.counts(search.personal_view(entries, live, "doc_id"), "fit", ["en", "de", "fr", "es"], "all")


@register(
    """WITH r AS (SELECT o_orderkey AS run_id, o_orderpriority AS source, o_orderdate AS started_at FROM orders WHERE o_orderstatus = 'O'), d AS (SELECT l_orderkey AS run_id, min(l_returnflag) AS source, count(*) AS found, count_if(l_quantity > 10) AS saved, count_if(l_tax > 0.06) AS failed, max(CASE WHEN l_discount > 0.09 THEN repeat('late ', 80) END) AS error FROM lineitem WHERE l_linestatus = 'F' OR l_quantity > 45 GROUP BY 1)
SELECT coalesce(r.run_id, d.run_id) AS run_id, coalesce(r.source, d.source) AS source, CASE WHEN d.run_id IS NULL THEN 'running' WHEN failed = 0 AND error IS NULL THEN 'success' WHEN saved > 0 THEN 'partial' ELSE 'failed' END AS status, CASE WHEN r.run_id IS NULL THEN TIMESTAMP '2001-01-01 00:00:00' ELSE CAST(started_at AS TIMESTAMP) END AS started_at, CASE WHEN d.run_id IS NOT NULL THEN TIMESTAMP '2001-01-01 00:00:00' END AS finished_at, found, saved, failed, left(error, 300) AS error FROM r FULL JOIN d ON r.run_id = d.run_id"""
)
def run_bookkeeping(spark, sf_dir):
    none = lambda t: F.lit(None).cast(t)
    runs = load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("source"), F.lit("running").alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"), none("timestamp_ntz").alias("finished_at"), *[none("long").alias(c) for c in ("found", "saved", "failed")], none("string").alias("error"))
    late = F.max(F.when(F.col("l_discount") > 0.09, F.repeat(F.lit("late "), 80)))
    done = load(spark, sf_dir, "lineitem").where("l_linestatus = 'F' OR l_quantity > 45").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.min("l_returnflag").alias("source"), F.count("*").alias("found"), F.count_if(F.col("l_quantity") > 10).alias("saved"), F.count_if(F.col("l_tax") > 0.06).alias("failed"), late.alias("error"))
    return status.booked(runs, done, F.expr(AS_OF))
