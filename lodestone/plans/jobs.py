"""The stored adverts as a whole: the full write-back of their analysis, cards without duplicates, and the read query over cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts, segments, text
from ..operators import clusters, engine, search, state
from ..operators.rules import Rules
from ..sources import sites
from ..sources.versions import commit

# What a text must say for its place to be the default one, the default place, and reasons to look at an advert again with their flags.
TOWN, TOWN_NAME = r"chisinau|кишинев", "Chișinău"
REVIEW = {
    "experience": ["EXPERIENCE_UNCLEAR", "CONFLICTING_EXPERIENCE", "EXPERIENCE_OR_STUDENTS", "MIXED_SENIORITY", "ADVANCED_SKILLS_REQUESTED"],
    "degree": ["DEGREE_REQUIRED"],
    "pay": ["INTERNSHIP_PAY_UNCLEAR"],
    "details": ["DESCRIPTION_UNVERIFIED", "LOCATION_UNCONFIRMED"],
}
# Tags that tell adverts of one title apart, and flags that do not.
APART, ALIKE = ("Remote", "Hybrid", "Part Time", "Rotational Shifts", "Driver's License"), ("PAY_NOT_STATED",)
#: Columns of the table that analysis writes.
WRITTEN = ("raw_description", "description", "description_quality", "company", "responsibilities_text", "requirements_text", "location", *("category tags quality_flags tag_evidence flag_evidence category_evidence experience_min payment_status entry_fit fit_score exposure_score exclusion_reason reasons status analysis_version".split()), "analyzed_at")


def derive(jobs: DataFrame, as_of: Column, only_pending: bool = True, rules: Rules = engine.DEFAULT) -> DataFrame:
    """``jobs`` with all columns of WRITTEN worked out for the due rows; the rest pass through as they are.

    The description as it first came is kept, the one that is shown is repaired,
    names of no company become N/A, a missing place is taken from the text, and
    the sections on duties and requirements are columns of their own. One narrow
    map without a shuffle.
    """
    up_to_date = F.coalesce((F.col("analysis_version") == rules.version) & F.col("analyzed_at").isNotNull(), F.lit(False))
    todo = state.pending(jobs, rules.version) if only_pending else jobs
    raw = F.coalesce("raw_description", "description") if "raw_description" in jobs.columns else F.col("description")
    todo = todo.withColumn("raw_description", raw).withColumn("__stored", sites.stored_text(F.col("description"), F.col("description_quality"), F.col("source")))
    # a generator, so that the repaired text is worked out once
    rest = [c for c in todo.columns if c not in ("__stored", "description", "description_quality", "text")]
    todo = todo.select(*rest, F.inline(F.array("__stored"))).withColumnRenamed("quality", "description_quality")
    town = F.when(text.normalize(F.col("text")).rlike(TOWN), TOWN_NAME).otherwise("")
    todo = todo.withColumns({"location": F.coalesce(F.nullif("location", F.lit("")), town), "company": F.coalesce(text.valid_company(F.col("company")), F.lit("N/A")), "__sections": segments.sections(F.col("text"))})
    done = engine.evaluate(todo, rules)
    done = done.withColumns({"description": F.nullif("text", F.lit("")), "responsibilities_text": F.col("__sections.responsibilities"), "requirements_text": F.col("__sections.requirements"), "analyzed_at": as_of}).drop("text", "__sections")
    return done.unionByName(jobs.where(up_to_date), allowMissingColumns=True) if only_pending else done


def write_back(spark: SparkSession, root: str, as_of: Column, only_pending: bool = True, lease: int | None = None, rules: Rules = engine.DEFAULT) -> int:
    """Publishes the newest version of the table at ``root`` with its due rows analysed, on what other writers left: all rows or none."""

    def change(jobs: DataFrame | None) -> DataFrame:
        if jobs is None:
            raise ValueError(f"no table at {root}")
        return derive(jobs, as_of, only_pending, rules)

    return commit(spark, root, change, lease=lease)


def prepared(jobs: DataFrame, links: dict[str, sites.Site] = sites.SITES) -> DataFrame:
    """``jobs`` with safe links and what duplicates are told by: words of title and company, shingles of the duties, requirements, blockers, pay.

    Rows whose link leads off their site go. Adverts of unknown companies are
    like no other, so they get a key of their own.
    """
    safe = sites._by_source(F.col("source"), links, lambda s: sites.allowed(F.col("link"), s.origin, s.path, s.aliases))
    # sections that are stored come before those of the description, which are used where both are empty
    own = segments.sections(F.col("description"))
    duties = lambda column, name: F.coalesce(F.nullif(column, F.lit("")), F.nullif(own[name], F.lit("")))
    role = F.concat_ws("\n", duties("responsibilities_text", "responsibilities"), duties("requirements_text", "requirements"))
    who, named = text.company(F.col("company")), text.title(F.col("title"), F.col("company"))
    asked = F.array_sort(F.filter("tags", lambda t: (F.endswith(t, F.lit(" Required")) & (t != "No Experience Required")) | t.isin(*APART)))
    blockers = F.array_sort(F.array_except("quality_flags", F.array(*map(F.lit, ALIKE))))
    pay = facts.salary(F.col("salary"), F.col("title"), F.col("description"), F.array_contains("quality_flags", "INTERNSHIP_PAY_UNCLEAR"))
    out = jobs.where(safe.isNotNull()).select("*", named.alias("__title"), who.alias("__company"), text.shingles(F.when(role != "", role).otherwise(F.col("description"))).alias("__shingles"), F.array_join(asked, "|").alias("__asked"), F.array_join(blockers, "|").alias("__blockers"), pay.alias("salary_amount"))
    unknown = F.col("__company").isin("", "n a")
    return out.withColumn("__alone", F.when(unknown, F.col("id")))


#: What two adverts must share to be one: the company and all that was decided on them.
KEY = ["__alone", "__company", "entry_fit", "experience_min", "category", "__asked", "__blockers"]


def cards(jobs: DataFrame, links: dict[str, sites.Site] = sites.SITES) -> DataFrame:
    """One row a group of duplicates: its best advert, with sources (name, link), duplicate_count, salary_amount and review_reasons.

    Adverts come in the order of fit score, then newest first, and join the
    first group all of whose members they equal. The best one is verified, has
    the latest check, the longest text (500 shingles count), stated pay, the
    shortest title, the largest id, or the first link. Its source comes first,
    the others in their order, each link once. Rows have no order of their own:
    see listed().
    """
    rows = prepared(jobs, links)
    side = rows.select("id", *KEY, F.col("__title").alias("title"), F.array_distinct(F.split("__title", " ")).alias("tokens"), F.col("__shingles").alias("shingles"), "fit_score", "scraped_at")
    order = [-F.col("fit_score"), -F.unix_micros(F.col("scraped_at").cast("timestamp"))]
    grouped = clusters.clusters(side, KEY, order)
    place = F.struct(*[x for c in order for x in (c.isNull(), c)], F.col("id"))
    rank = F.struct(
        (F.coalesce("description_quality", F.lit("")) == "verified").cast("int"), F.coalesce(F.unix_micros(F.col("detail_checked_at").cast("timestamp")), F.lit(0)), F.least(F.size("__shingles"), F.lit(500)),
        (F.col("salary_amount") != "").cast("int"), -F.length("title"), F.col("id"),
    )
    # a rank names its advert, as ids differ
    marked = rows.select("id", "link", F.col("source").alias("name"), rank.alias("rank"), place.alias("place")).join(grouped, "id")
    once = marked.groupBy("cluster_id", "link").agg(F.min("place").alias("place"), F.max_by("name", "place").alias("name"), F.max(F.struct("rank", "id")).alias("top"))
    best = once.groupBy("cluster_id").agg(F.max_by(F.struct("top.id", "link", "name"), "top").alias("best"), F.collect_list(F.struct("place", "name", "link")).alias("members"))
    source = lambda m: F.struct(m["name"].alias("name"), m["link"].alias("link"))
    others = F.transform(F.filter(F.array_sort("members"), lambda m: m["link"] != F.col("best.link")), source)
    found = best.select(F.col("best.id").alias("id"), F.concat(F.array(source(F.col("best"))), others).alias("sources"))
    kept = [c for c in rows.columns if not c.startswith("__")]
    out = rows.select(*kept).join(found, "id").withColumn("duplicate_count", F.size("sources") - 1)
    return out.withColumn("review_reasons", search.review_reasons(F.col("quality_flags"), F.col("entry_fit"), REVIEW))


def listed(found: DataFrame) -> DataFrame:
    """Cards in the order they are shown: best score, newest, then by link."""
    return found.orderBy(F.desc("fit_score"), F.desc_nulls_last("scraped_at"), "link")


def read(jobs: DataFrame, fit: str = "beginner", links: dict[str, sites.Site] = sites.SITES, **wanted) -> DataFrame:
    """The read query: cards of the active adverts that meet the conditions of search(). Unknown fits or reasons raise ValueError."""
    active = cards(jobs.where("status = 'active'"), links).withColumn("fit", F.col("entry_fit"))
    return listed(search.search(active, fit=fit, fits=("beginner", "stretch", "review", "other"), reasons=tuple(REVIEW), **wanted)).drop("fit")


def filters(jobs: DataFrame, links: dict[str, sites.Site] = sites.SITES) -> DataFrame:
    """(facet, name, n): what the cards can be filtered by, zeros included: fits, categories, review reasons, tags, and how many adverts are excluded."""
    active = cards(jobs.where("status = 'active'"), links).select("entry_fit", "category", "review_reasons", "tags")
    dims = {"fit": ["beginner", "stretch", "review", "other"], "category": [k for k, _, _ in engine.DEFAULT.categories], "review": list(REVIEW)}
    one = lambda facet, name: F.struct(F.lit(facet).alias("facet"), name.alias("name"))
    each = lambda facet, column: F.transform(column, lambda x: one(facet, x))
    said = F.concat(F.array(one("fit", F.col("entry_fit")), one("fit", F.lit("all")), one("category", F.col("category"))), each("review", "review_reasons"), each("tag", "tags"))
    counted = active.select(F.explode(said).alias("x")).groupBy("x.facet", "x.name").agg(F.count("*").alias("n"))
    out = jobs.where("status = 'excluded'").agg(F.lit("excluded").alias("facet"), F.lit("excluded").alias("name"), F.count("*").alias("n"))
    known = jobs.sparkSession.createDataFrame([(f, n) for f, names in (dims | {"fit": [*dims["fit"], "all"]}).items() for n in names], "facet string, name string")
    return known.join(counted, ["facet", "name"], "full_outer").select("facet", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n")).unionByName(out)
