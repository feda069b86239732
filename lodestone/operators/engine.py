"""The rule engine: ordered categories, labels with evidence, payment, place, score and decision; all of it row-local columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segments
from ..functions.facts import experience
from ..functions.literals import Words
from ..functions.text import normalize, shown_number
from . import lexicon as lex
from .rules import VERSION, Rules

DEFAULT = Rules()
_ABOUT = "experience|experienta|опыт"


def phrase(words: str) -> str:
    """A pattern for words that stand between characters that are no letters or digits."""
    return rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"


# What is looked for in whole texts and their sentences, and in what they ask for.
_SAID = [lex.NO_EXPERIENCE, lex.ENTRY_BODY, lex.STUDENTS, phrase(lex.INTERNSHIP), lex.PRIOR, _ABOUT, lex.NO_DEGREE, lex.DEGREE, lex.FEE, lex.UNPAID, lex.TRAINING, lex.PAID_INTERNSHIP, lex.LATER_JOB, lex.PAID, lex.RELOCATION, *lex.ABROAD, lex.REMOTE_TEXT, lex.PART_TIME, lex.FLEXIBLE, lex.SHIFTS, lex.DRIVER]
_DUTIES = [lex.ADVANCED, lex.PORTFOLIO, lex.CUSTOMERS]


def has(text: Column, words: str) -> Column:
    """Whether words stand in an already normalized text; never null."""
    return said(text, phrase(words))


def said(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs; never null."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def first_match(text: Column, rules: list[tuple[str, str]], test=has) -> Column:
    """Name of the first rule that matches, null if none."""
    return F.coalesce(*[F.when(test(text, p), F.lit(k)) for k, p in rules])


def last_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The last reason that holds: later ones overwrite earlier ones."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in reversed(reasons)])


def score(no_experience: Column, entry_title: Column, entry_body: Column, student: Column, training: Column) -> Column:
    w = lex.WEIGHTS
    add = lambda c, n: F.when(c, n).otherwise(0)
    return F.lit(w["base"]) + add(no_experience, w["no_experience"]) + F.when(entry_title, w["entry_title"]).when(entry_body, w["entry_body"]).otherwise(0) + add(student, w["student"]) + add(training, w["training"])


def capped(points: Column, fit: Column) -> Column:
    """The score under the limit of its fit."""
    most = reduce(lambda out, k: F.when(fit == k, lex.CAPS[k]).otherwise(out), lex.CAPS, F.lit(100))
    return F.least(points, most)


def categorised(d: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``d`` (_title, _relevant) with category, _titled (found by the title) and _unrelated (why it is no such role, or null)."""
    title, relevant = F.col("_title"), F.col("_relevant")
    words = Words([phrase(b) for _, _, b in rules.categories])
    d = d.withColumn("_duties", words.standing(relevant))
    stands = lambda text, p: words.when(F.col("_duties"), phrase(p), has(text, p))
    listed = F.when(has(title, lex.DEVELOPER) & ~said(title, lex.NOT_DEVELOPER), "Software Development").otherwise(first_match(title, [(k, t) for k, t, _ in rules.categories]))
    odd = has(title, lex.NON_TECH)
    d = d.withColumn("_titled", listed).withColumn("_odd", odd)
    named = F.coalesce("_titled", F.when(~F.col("_odd"), first_match(relevant, [(k, b) for k, _, b in rules.categories], stands)))
    # a general name gives way to what the duties say
    closer = first_match(relevant, [(k, b) for k, _, b in rules.categories if k not in ("General IT", "IT Internships")], stands)
    d = d.withColumn("_named", named).withColumn("_named", F.when(F.col("_named") == "General IT", F.coalesce(closer, F.lit("General IT"))).otherwise(F.col("_named")))
    planner = said(title, lex.PLANNED) & said(relevant, lex.PLANNING) & ~said(relevant, lex.CODING)
    d = d.withColumn("_unrelated", F.when(planner, lex.EXCLUDED["production"]).when(F.col("_named").isNull() | F.col("_odd"), lex.EXCLUDED["unrelated"]))
    return d.withColumn("category", F.when(F.col("_unrelated").isNotNull(), "General IT").otherwise(F.col("_named")))


def evaluate(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``df`` (title, text, location, work_mode, schedule, description_quality, availability, and salary if there is one) with the engine's columns.

    category, tags, quality_flags, tag_evidence, flag_evidence,
    category_evidence, experience_min, payment_status, entry_fit, fit_score,
    exposure_score, exclusion_reason, reasons, status, analysis_version. Null
    fields count as empty. Stages are plain projections: one narrow map without
    a shuffle, whatever the size. Quotes are unchanged parts of their source,
    three at most. Reasons are ordered, each a label and the sentence that shows
    it, where one does.
    """
    c, e = F.col, lambda k: F.coalesce(F.col(k), F.lit(""))
    kept = df.columns
    d = df.withColumn("_sec", segments.sections(c("text")))
    d = d.withColumn("_text", normalize(c("text")))
    d = d.withColumns({"_title": normalize(c("title")), "_full": segments.trimmed(c("_text")), "_mode": normalize(c("work_mode")), "_sched": normalize(c("schedule")), "_place": normalize(c("location")), "_pay": normalize(c("salary") if "salary" in kept else F.lit(""))})
    joined = lambda *parts: F.array_join(F.filter(F.array(*[c(f"_sec.{p}") for p in parts]), lambda x: F.length(x) > 0), "\n")
    or_all = lambda x: F.when(F.length(x) > 0, x).otherwise(c("_sec.full_text"))
    d = d.withColumn("_read", or_all(joined("intro", "responsibilities", "requirements")))
    d = d.withColumn("_relevant", F.when(c("_read") == c("_sec.full_text"), c("_text")).otherwise(normalize(c("_read"))))
    parts = {k: segments.records(c(f"_sec.{k}"), v) for k, v in segments.TITLES.items()}
    d = d.withColumn("_whole", segments.records(c("text"), "Vacancy text"))
    # a text without headers is all of one kind, and its sentences are known
    same = F.transform("_whole", lambda r: r.withField("section", F.lit(segments.TITLES["responsibilities"])))
    parts["responsibilities"] = F.when(c("_sec.responsibilities") == segments.trimmed(c("_sec.full_text")), same).otherwise(parts["responsibilities"])
    d = d.withColumns({"_requirements": parts["requirements"], "_preferred": parts["preferred"], "_by": F.concat(*[parts[k] for k in segments.TITLES])})
    d = d.withColumn("_exp", experience(c("text"), c("_sec.requirements"), c("_sec.preferred"), c("_whole")))
    d = d.withColumn("_said", F.array_join(F.transform(F.filter("_by", lambda r: r["section"] != "Benefits"), lambda r: r["normalized"]), "\n"))
    d = categorised(d, rules)
    tongues = "|".join(rules.languages.values()) or r"(?!)"
    whole, skilled, asked = Words([*_SAID, phrase(tongues)]), Words([phrase(p) for p in rules.skills.values()]), Words(_DUTIES)
    d = d.withColumns({"_words": whole.standing(F.concat_ws("\n", "_title", "_full")), "_skills": skilled.standing(c("_said")), "_asks": asked.standing(c("_relevant"))})
    heard = lambda n, p: whole.when(c("_words"), p, said(n, p))
    duty = lambda n, p: asked.when(c("_asks"), p, said(n, p))
    some_say = lambda rows, p, test: whole.when(c("_words"), p, F.exists(rows, test))
    skill = lambda p: skilled.when(c("_skills"), phrase(p), has(c("_said"), p))
    title, full, relevant, low = c("_title"), c("_full"), c("_relevant"), c("_exp.minimum")
    both = F.concat_ws("\n", title, full)
    wished = lambda n: said(n, lex.OPTIONAL) | ((F.length("_sec.preferred") > 0) & F.contains(normalize(c("_sec.preferred")), n))

    # Signals of applicants.
    prior = lambda n: said(n, lex.PRIOR) & ~said(n, lex.NO_EXPERIENCE) & (~said(n, lex.TOOL_USE) | said(n, lex.EMPLOYED))
    mentioned = F.exists(F.concat("_exp.required", "_exp.preferred", "_exp.alternatives"), lambda x: x["mentioned"] > 0)
    speech = F.filter(segments.records(or_all(joined("requirements", "preferred", "intro", "responsibilities")), ""), lambda r: has(r["normalized"], tongues))
    speech = whole.when(c("_words"), phrase(tongues), speech, F.array())
    d = d.withColumns(
        {
            "_noexp": heard(full, lex.NO_EXPERIENCE), "_etitle": has(title, lex.ENTRY_TITLE), "_ebody": heard(full, lex.ENTRY_BODY), "_friendly": heard(full, lex.STUDENTS), "_intern": heard(both, phrase(lex.INTERNSHIP)), "_senior": has(title, lex.SENIOR), "_advanced": duty(relevant, lex.ADVANCED), "_mentioned": mentioned,
            "_vague": some_say("_requirements", lex.PRIOR, lambda r: prior(r["normalized"]) & ~said(r["normalized"], lex.OPTIONAL) & ~said(r["normalized"], r"\d|students?|studenti")),
            "_worked": some_say(F.concat("_requirements", "_preferred"), lex.PRIOR, lambda r: prior(r["normalized"])),
            "_optional": some_say("_by", _ABOUT, lambda r: said(r["normalized"], _ABOUT) & (said(r["normalized"], lex.OPTIONAL) | (r["section"] == "Preferred qualifications")) & ~said(r["normalized"], r"(?:company|compania|компания).{0,50}(?:years?|ani|лет)")),
            "_nodegree": heard(full, lex.NO_DEGREE), "_degree": some_say("_requirements", lex.DEGREE, lambda r: said(r["normalized"], lex.DEGREE) & ~said(r["normalized"], lex.OPTIONAL) & ~said(r["normalized"], lex.DEGREE_OR)),
            "_speech": F.transform(speech, lambda r: F.struct(r["text"].alias("text"), r["normalized"].alias("normalized"), (said(r["normalized"], lex.LANGUAGE_COURSE) & ~said(r["normalized"], lex.LANGUAGE_KNOWN)).alias("course"), wished(r["normalized"]).alias("soft"), (~said(r["normalized"], lex.LANGUAGE_FREE) & said(r["normalized"], lex.LANGUAGE_LEVEL)).alias("hard"))),
        }
    )
    # Signals of training, pay and place.
    d = d.withColumns(
        {
            "_course": said(title, lex.COURSE_TITLE) & ~said(title, lex.TEACHER), "_fee": heard(full, lex.FEE) & F.exists("_whole", lambda r: said(r["normalized"], lex.FEE) & ~said(r["normalized"], lex.NO_FEE)),
            "_unpaid": heard(full, lex.UNPAID), "_training": heard(both, lex.TRAINING), "_ipaid": heard(full, lex.PAID_INTERNSHIP), "_later": c("_intern") & heard(full, lex.LATER_JOB), "_anypay": said(c("_pay"), lex.PAID) | heard(full, lex.PAID),
            "_abroad": heard(both, lex.RELOCATION) | (said(title, lex.ABROAD_TITLE) & reduce(lambda a, b: a & b, [heard(full, p) for p in lex.ABROAD])),
            "_there": F.length("_place") > 0, "_local": said(c("_place"), lex.LOCAL), "_remote": said(c("_mode"), lex.REMOTE_MODE) | heard(full, lex.REMOTE_TEXT), "_hybrid": said(F.when(F.length("_mode") > 0, c("_mode")).otherwise(full), lex.HYBRID),
        }
    )
    entry = c("_etitle") | c("_ebody")
    mixed, unclear = c("_senior") & c("_etitle"), c("_vague") & low.isNull()
    some = F.coalesce(low > 0, F.lit(False))
    degree, conflict, later = c("_degree") & ~c("_nodegree"), c("_noexp") & some, c("_later") & ~c("_ipaid")
    badge = c("_friendly") & ~c("_mentioned")
    alternatives = F.size("_exp.alternatives") > 0
    paid = c("_ipaid") | (~c("_later") & c("_anypay"))
    payment = F.when(c("_fee"), "fee_required").when(c("_unpaid"), "unpaid").when(paid, "paid").otherwise("unknown")
    outside = c("_there") & ~c("_local") & ~(c("_remote") & said(c("_place"), lex.ANYWHERE))

    spoken = lambda p, kind: F.exists("_speech", _speaks(p, kind))
    js = rules.skills.get("JavaScript / Node", r"(?!)")
    scripts = F.exists("_by", lambda r: (r["section"] != "Benefits") & has(r["normalized"], js) & ~(said(r["normalized"], lex.REACT_TO) & ~said(r["text"], lex.REACT)))
    tags = [
        ("No Experience Required", c("_noexp")), ("Students / Graduates Welcome", badge & ~c("_worked")), ("Junior / Entry Level", entry & ~c("_intern")), ("Internship / Trainee", c("_intern")), ("Experience Preferred", (F.size("_exp.preferred") > 0) | c("_optional")),
        ("Employer Training", c("_training")), ("Paid Internship", c("_ipaid") & c("_intern")), ("Remote", c("_remote")), ("Hybrid", c("_hybrid")), ("Part Time", said(c("_sched"), lex.PART_TIME) | heard(full, lex.PART_TIME)), ("Flexible Schedule", heard(full, lex.FLEXIBLE)), ("Rotational Shifts", heard(full, lex.SHIFTS)),
        ("Driver's License", heard(full, lex.DRIVER)), ("No Degree Required", c("_nodegree")), ("Portfolio", duty(relevant, lex.PORTFOLIO)), ("Customer Facing", duty(relevant, lex.CUSTOMERS)),
        *[(k, (has(title, p) | skill(p)) & (has(title, p) | scripts if p == js else F.lit(True))) for k, p in rules.skills.items()],
    ]
    labels = [F.when(v, F.lit(k)) for k, v in tags]
    labels += [F.when(has(title, p) | spoken(p, "Required"), F.lit(f"{k} Required")).when(spoken(p, "Preferred"), F.lit(f"{k} Preferred")) for k, p in rules.languages.items()]
    flags = [
        ("EXPERIENCE_INFLATION_2PLUS_YEARS", low >= 2), ("EXPERIENCE_REQUIREMENT_1YEAR", (low >= 1) & (low < 2)), ("SOME_EXPERIENCE_REQUIRED", (low > 0) & (low < 1)), ("EXPERIENCE_OR_STUDENTS", alternatives), ("CONFLICTING_EXPERIENCE", conflict), ("MIXED_SENIORITY", mixed), ("ADVANCED_SKILLS_REQUESTED", c("_advanced")),
        ("EXPERIENCE_UNCLEAR", unclear), ("INTERNSHIP_PAY_UNCLEAR", later), ("TRAINING_FEE_OR_COURSE", c("_fee") | c("_course")), ("UNPAID", c("_unpaid")), ("PAY_NOT_STATED", payment == "unknown"), ("RELOCATION_REQUIRED", c("_abroad")), ("OUTSIDE_CHISINAU", outside), ("LOCATION_UNCONFIRMED", ~c("_there")),
        ("DEGREE_REQUIRED", degree), ("NOT_RELEVANT", c("_unrelated").isNotNull()),
    ]
    complete = (F.length("_full") >= 100) & ~F.coalesce(c("description_quality"), F.lit("unverified")).isin("missing", "contaminated")
    d = d.withColumns({"_tags": F.array_sort(F.array_compact(F.array(*labels))), "_flags": F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in flags])), "_complete": complete, "_payment": payment})

    flag = lambda k: F.array_contains("_flags", k)
    signal = c("_noexp") | entry | c("_friendly")
    barrier = reduce(lambda a, b: a | b, [flag(k) for k in ("MIXED_SENIORITY", "DEGREE_REQUIRED", "ADVANCED_SKILLS_REQUESTED", "EXPERIENCE_OR_STUDENTS", "CONFLICTING_EXPERIENCE", "INTERNSHIP_PAY_UNCLEAR")])
    open_ = c("_complete") & ~barrier
    fit = F.when(open_ & some & (low < 2), "stretch").when(open_ & signal & ~flag("EXPERIENCE_UNCLEAR"), F.when(some, "stretch").otherwise("beginner")).when(signal, "review").otherwise("other")
    x = lex.EXCLUDED
    senior = c("_senior") & ~flag("MIXED_SENIORITY")
    late = last_reason([(x["fee"], flag("TRAINING_FEE_OR_COURSE")), (x["unpaid"], flag("UNPAID")), (x["relocation"], flag("RELOCATION_REQUIRED")), (x["outside"], flag("OUTSIDE_CHISINAU")), (x["experience"], flag("EXPERIENCE_INFLATION_2PLUS_YEARS") & ~flag("CONFLICTING_EXPERIENCE")), (x["senior"], senior), (x["closed"], c("availability") == "closed")])
    d = d.withColumns({"_fit": fit, "exclusion_reason": F.coalesce(late, c("_unrelated"))})
    placeless = flag("LOCATION_UNCONFIRMED") & c("_fit").isin("beginner", "stretch") & c("exclusion_reason").isNull()
    more = [("DESCRIPTION_UNVERIFIED", ~c("_complete")), ("BEGINNER_ELIGIBILITY_UNCONFIRMED", c("_fit") == "other"), ("SENIOR_ROLE", senior), ("VACANCY_CLOSED", c("availability") == "closed")]
    d = d.withColumns({"entry_fit": F.when(c("exclusion_reason").isNotNull(), "excluded").when(placeless, "review").otherwise(c("_fit")), "_flags": F.concat("_flags", F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in more])))})
    why = lex.REASONS
    begun = F.get(F.filter("_whole", lambda r: said(r["normalized"], lex.ENTRY_BODY)), F.lit(0))["text"]
    least = F.get(F.filter("_exp.required", lambda x: x["years"] == low), F.lit(0))["evidence"]
    cited = {why["entry_body"]: begun, why["alternative"]: F.get("_exp.alternatives", F.lit(0))["evidence"]}
    reasons = [
        (c("exclusion_reason"), c("exclusion_reason").isNotNull()), (why["no_experience"], c("_noexp")), (why["entry_title"], c("_etitle")), (why["entry_body"], c("_ebody") & ~c("_etitle")), (why["student"], badge & ~c("_worked")), (why["student_prior"], c("_friendly") & ~(badge & ~c("_worked"))), (why["training"], c("_training")),
        (F.format_string(why["years"], shown_number(low)), low.isNotNull()), (why["alternative"], alternatives), (why["incomplete"], ~c("_complete")), (why["no_signal"], ~signal), (why["degree"], flag("DEGREE_REQUIRED")), (why["advanced"], c("_advanced")), (why["later_pay"], flag("INTERNSHIP_PAY_UNCLEAR")), (why["unclear"], flag("EXPERIENCE_UNCLEAR")), (why["no_place"], placeless),
    ]
    out = d.withColumns(
        {
            "tags": c("_tags"), "quality_flags": c("_flags"), "tag_evidence": _tag_quotes(rules), "flag_evidence": _flag_quotes(),
            "category_evidence": F.when(c("_titled").isNotNull() & (c("_titled") == c("category")), _sourced("title", "Job title")).otherwise(_quotes(reduce(lambda o, r: F.when(c("category") == r[0], phrase(r[2])).otherwise(o), rules.categories, F.lit(r"(?!)")))),
            "experience_min": low, "payment_status": c("_payment"), "exposure_score": F.when(F.array_contains("_tags", "Customer Facing"), 5.0).otherwise(0.0),
            "fit_score": capped(score(c("_noexp"), c("_etitle"), c("_ebody"), badge & ~c("_worked"), c("_training")), c("entry_fit")),
            "reasons": F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), _reason(k, cited.get(k) if isinstance(k, str) else least if i else None)) for i, (k, v) in enumerate(reasons)])),
            "status": F.when(c("exclusion_reason").isNotNull(), "excluded").otherwise("active"), "analysis_version": F.lit(rules.version),
        }
    )
    new = ["category", "tags", "quality_flags", "tag_evidence", "flag_evidence", "category_evidence", "experience_min", "payment_status", "entry_fit", "fit_score", "exposure_score", "exclusion_reason", "reasons", "status", "analysis_version"]
    return out.select(*[k for k in kept if k not in new], *new)


def _reason(label: str | Column, evidence: Column | None) -> Column:
    return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence"))


def _speaks(language: str, kind: str):
    """Whether a sentence asks for a language: as Required, or as Preferred."""
    return lambda r: has(r["normalized"], language) & ~r["course"] & (r["soft"] if kind == "Preferred" else ~r["soft"] & r["hard"])


def _cited(found: Column) -> Column:
    """The first three records as (text, section), under the section that holds the same sentence."""
    section = lambda r: F.coalesce(F.get(F.filter("_by", lambda x: x["text"] == r["text"]), 0)["section"], F.lit("Vacancy text"))
    return F.slice(F.array_distinct(F.transform(F.slice(found, 1, 3), lambda r: F.struct(r["text"].alias("text"), section(r).alias("section")))), 1, 3)


def _quotes(pattern: Column) -> Column:
    return _cited(F.filter("_whole", lambda r: F.rlike(r["normalized"], pattern)))


def _sourced(column: str, section: str) -> Column:
    return F.array(F.struct(F.col(column).alias("text"), F.lit(section).alias("section")))


def _quoted(held: str, rules: list[tuple[str, str, bool]], fields: list[tuple[str, str, str, str]], special: list[tuple[str, Column]]) -> Column:
    """A map of the labels in ``held`` to their quotes: of the field or the title where the pattern stands there, else of the text.

    ``rules`` are (label, pattern, whether the title may show it), ``fields``
    (label, column, normalized column, section). The patterns are data, so that
    one expression serves all labels.
    """
    listed = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(p).alias("pattern"), F.lit(t).alias("titled")) for k, p, t in rules])

    def one(x: Column) -> Column:
        quotes = F.when(x["titled"] & F.rlike(F.col("_title"), x["pattern"]), _sourced("title", "Job title")).otherwise(_quotes(x["pattern"]))
        for label, column, normal, section in fields:
            quotes = F.when((x["label"] == label) & (F.length(column) > 0) & F.rlike(F.col(normal), x["pattern"]), _sourced(column, section)).otherwise(quotes)
        return F.struct(x["label"].alias("k"), quotes.alias("v"))

    found = F.transform(F.filter(listed, lambda x: F.array_contains(held, x["label"])), one)
    own = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in special]), lambda x: F.array_contains(held, x["k"]))
    return F.map_from_entries(F.filter(F.concat(found, own), lambda x: F.size(x["v"]) > 0))


def _tag_quotes(known: Rules) -> Column:
    rules = [
        ("No Experience Required", lex.NO_EXPERIENCE, False), ("Students / Graduates Welcome", lex.STUDENTS, False), ("Junior / Entry Level", f"{phrase(lex.ENTRY_TITLE)}|{lex.ENTRY_BODY}", True), ("Internship / Trainee", phrase(lex.INTERNSHIP), True), ("Employer Training", lex.TRAINING, True), ("Paid Internship", lex.PAID_INTERNSHIP, False),
        ("Remote", f"{lex.REMOTE_MODE}|{lex.REMOTE_TEXT}", False), ("Hybrid", lex.HYBRID, False), ("Part Time", lex.PART_TIME, False), ("Flexible Schedule", lex.FLEXIBLE, False), ("Rotational Shifts", lex.SHIFTS, False), ("Driver's License", lex.DRIVER, False), ("No Degree Required", lex.NO_DEGREE, False), ("Portfolio", lex.PORTFOLIO, False), ("Customer Facing", lex.CUSTOMERS, False),
        *[(k, phrase(p), True) for k, p in known.skills.items()],
    ]
    fields = [("Remote", "work_mode", "_mode", "Work arrangement on source"), ("Hybrid", "work_mode", "_mode", "Work arrangement on source"), ("Part Time", "schedule", "_sched", "Schedule on source")]
    special = [("Experience Preferred", _cited(F.filter("_whole", lambda r: F.exists("_exp.preferred", lambda x: x["evidence"] == r["text"]) | (said(r["normalized"], "experience|experienta|опыт") & (said(r["normalized"], lex.OPTIONAL) | F.exists("_preferred", lambda x: x["text"] == r["text"]))))))]
    for k, p in known.languages.items():
        for kind in ("Required", "Preferred"):
            mine = F.filter("_speech", _speaks(p, kind))
            special.append((f"{k} {kind}", F.when(has(F.col("_title"), p), _sourced("title", "Job title")).otherwise(_cited(mine)) if kind == "Required" else _cited(mine)))
    return _quoted("_tags", rules, fields, special)


def _flag_quotes() -> Column:
    of = lambda kind: _cited(F.filter("_whole", lambda r: F.exists(f"_exp.{kind}", lambda x: x["evidence"] == r["text"])))
    rules = [("MIXED_SENIORITY", phrase(lex.SENIOR), True), ("SENIOR_ROLE", phrase(lex.SENIOR), True), ("ADVANCED_SKILLS_REQUESTED", lex.ADVANCED, False), ("EXPERIENCE_UNCLEAR", lex.PRIOR, False), ("INTERNSHIP_PAY_UNCLEAR", lex.LATER_JOB, False), ("TRAINING_FEE_OR_COURSE", f"{lex.COURSE_TITLE}|{lex.FEE}", True), ("UNPAID", lex.UNPAID, False), ("RELOCATION_REQUIRED", lex.ABROAD_SAID, True), ("DEGREE_REQUIRED", lex.DEGREE, False)]
    special = [(k, of("required")) for k in ("EXPERIENCE_INFLATION_2PLUS_YEARS", "EXPERIENCE_REQUIREMENT_1YEAR", "SOME_EXPERIENCE_REQUIRED", "CONFLICTING_EXPERIENCE")]
    special += [("EXPERIENCE_OR_STUDENTS", of("alternatives")), ("OUTSIDE_CHISINAU", _sourced("location", "Location on source"))]
    return _quoted("_flags", rules, [], special)
