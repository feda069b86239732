"""Adverts and what the rule engine must make of them: one table of cases, judged in one run."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import engine

MORE = "You will join a small team and learn the work on real projects. A salary is paid and the office is bright and modern."
CITY = "Chișinău"


def ad(title, text=MORE, location=CITY, work_mode=None, schedule=None, quality="verified", availability="open"):
    return (title, text, location, work_mode, schedule, quality, availability)


def asks(line, title="Junior Developer"):
    return ad(title, f"Requirements:\n{line}\n{MORE}")


#: name: (advert, expected values by column; "+tags" and the like: must hold, "-tags": must not).
CASES = {
    # roles by title
    "network": (ad("Junior Linux - Network Administrator"), {"category": "Systems & Networks"}),
    "devops": (ad("Junior DevOps"), {"category": "Systems & Networks"}),
    "tests": (ad("Junior QA Automation (Python)"), {"category": "QA & Testing"}),
    "scientist who develops": (ad("Junior Data Scientist - Python Developer"), {"category": "Data & Analytics"}),
    "entry of data": (ad("Data Entry and Verification Specialist"), {"category": "Data Entry & Operations"}),
    "product": (ad("IT Product Manager Internship"), {"category": "Product & Project Assistance"}),
    "graphics": (ad("Junior Graphic Designer"), {"category": "Design & UX"}),
    "pages": (ad("Asistent WordPress & Content"), {"category": "Web Content & E-commerce"}),
    "security": (ad("Junior SOC Analyst"), {"category": "Cybersecurity & Monitoring"}),
    "search engines": (ad("SEO specialist (junior)"), {"category": "Marketing & Web Tech"}),
    "russian developer": (ad("Младший разработчик"), {"category": "Software Development"}),
    "russian support": (ad("Специалист ИТ-поддержки"), {"category": "IT Support & Helpdesk"}),
    "internship": (ad("Internship IT"), {"category": "IT Internships"}),
    "developer on a platform": (ad("Linux Developer Junior"), {"category": "Software Development"}),
    "wordpress developer": (ad("Junior WordPress Developer"), {"category": "Web Content & E-commerce"}),
    "recruiter": (ad("Junior Recruiter", f"We develop software. {MORE}"), {"entry_fit": "excluded", "+quality_flags": ["NOT_RELEVANT"]}),
    "office": (ad("Asistent director / Office Manager", f"We develop software. {MORE}"), {"status": "excluded"}),
    "finance with a category in its title": (ad("Finance Data Analyst (intern)"), {"status": "excluded", "category": "General IT"}),
    "customer support without technical duties": (ad("Customer Support Representative", f"Take bookings and answer complaints. {MORE}"), {"status": "excluded"}),
    "customer support with them": (ad("Customer Support Representative", f"No experience required. Help users with technical issues. {MORE}"), {"category": "IT Support & Helpdesk", "status": "active"}),
    "general title, technical duties": (ad("Entry-Level IT Job (Training Provided)", f"Support clients with technical issues and password reset.\nRequirements:\nEnglish advanced level.\n{MORE}"), {"category": "IT Support & Helpdesk", "+tags": ["English Required", "Employer Training"]}),
    "benefits do not name the role": (ad("Junior PHP Developer", f"Responsibilities:\nWrite code.\nBenefits:\nEnglish courses, marketing events. {MORE}"), {"category": "Software Development", "-tags": ["English Required"]}),
    "production planner": (ad("Programator producție", f"Planificarea comenzilor de producție. {MORE}"), {"status": "excluded", "+quality_flags": ["NOT_RELEVANT"]}),
    # experience
    **{f"asks for {n}": (asks(line), {"entry_fit": "excluded", "experience_min": float(n), "+quality_flags": ["EXPERIENCE_INFLATION_2PLUS_YEARS"]}) for n, line in ((2, "Minimum 2 years of experience."), (4, "4+ years of experience."), (5, "Experiență de 5 ani."), (10, "At least ten years of experience."), (3, "Minimum 3 yrs experience."))},
    "romanian years": (asks("Experiență de cel puțin 2 ani."), {"experience_min": 2.0}),
    "russian years": (asks("Опыт работы не менее 2-х лет."), {"experience_min": 2.0}),
    "russian word": (asks("Опыт работы не менее двух лет."), {"experience_min": 2.0}),
    "english word": (asks("Two years of experience required."), {"experience_min": 2.0}),
    "romanian word": (asks("Experiență de doi ani."), {"experience_min": 2.0}),
    "years in a company": (asks("3 years of experience in a software company."), {"experience_min": 3.0}),
    "two mentions": (asks("At least two years, or 5 years of experience."), {"experience_min": 5.0}),
    "upper limit": (asks("Up to 1 year of experience."), {"experience_min": 0.0}),
    "range from none": (asks("0-2 years of experience."), {"entry_fit": "beginner", "experience_min": 0.0}),
    "range from one": (asks("1-3 years of experience."), {"entry_fit": "stretch", "+quality_flags": ["EXPERIENCE_REQUIREMENT_1YEAR"]}),
    "months": (asks("6 months of experience."), {"experience_min": 0.5, "+quality_flags": ["SOME_EXPERIENCE_REQUIRED"]}),
    "minimum without the word": (asks("Minimum 2 years with Java."), {"experience_min": 2.0}),
    "age of the company": (ad("Internship IT", f"Our company has 12 years of experience. 6 months of training. {MORE}"), {"experience_min": None}),
    "mentor": (asks("Mentored by a colleague with 7 years of experience."), {"experience_min": None}),
    "driving": (asks("Driving experience of 3 years."), {"experience_min": None}),
    "wish in brackets": (asks("1 year of experience as an analyst (e-commerce is a plus)."), {"experience_min": 1.0}),
    "preferred years": (ad("Junior Developer", f"Requirements:\nNo experience required.\nNice to have:\n2 years of experience preferred.\nBenefits:\n{MORE}"), {"entry_fit": "beginner", "experience_min": None, "+tags": ["Experience Preferred"]}),
    "student alternative": (ad("Junior Developer", f"Cerințe:\nExperiență de cel puțin 2 ani sau studenți.\n{MORE}"), {"entry_fit": "review", "+quality_flags": ["EXPERIENCE_OR_STUDENTS"]}),
    "contradiction": (ad("Junior Developer", f"No experience required. Requirements:\nAt least 2 years of experience. {MORE}"), {"entry_fit": "review", "+quality_flags": ["CONFLICTING_EXPERIENCE"]}),
    "vague": (asks("Previous work experience in development."), {"entry_fit": "review", "+quality_flags": ["EXPERIENCE_UNCLEAR"]}),
    "advanced": (asks("Deep knowledge of frameworks."), {"entry_fit": "review", "+quality_flags": ["ADVANCED_SKILLS_REQUESTED"]}),
    "russian optional": (ad("Junior Linux Administrator", f"Требования к кандидатам:\nОпыт работы с Linux является преимуществом.\nОпыт работы - не обязательно.\n{MORE}"), {"entry_fit": "beginner"}),
    # education
    "degree": (asks("Studii superioare.", "Junior SEO Specialist"), {"entry_fit": "review", "+quality_flags": ["DEGREE_REQUIRED"]}),
    "no degree": (ad("IT Support (Entry Level)", f"Previous experience or technical studies are not required. {MORE}"), {"entry_fit": "beginner", "+tags": ["No Degree Required"]}),
    "unfinished degree": (ad("Junior DevOps Engineer", f"Vom aprecia să ai:\nStudii superioare finalizate sau în curs de finalizare.\nLinux de bază. {MORE}"), {"entry_fit": "beginner", "+tags": ["Students / Graduates Welcome"]}),
    "russian degree": (ad("Инженер технической поддержки", f"Что мы ожидаем от кандидата\nВысшее техническое образование.\nОпыт работы не обязателен.\n{MORE}"), {"entry_fit": "review", "+quality_flags": ["DEGREE_REQUIRED"]}),
    # fees and pay
    "fee": (ad("Junior IT Support", f"A training fee is required. {MORE}"), {"status": "excluded", "payment_status": "fee_required"}),
    "romanian fee": (ad("Junior IT Support", f"Taxă de instruire: 500 lei. {MORE}"), {"status": "excluded"}),
    "russian fee": (ad("Junior IT Support", f"Платное обучение перед началом. {MORE}"), {"status": "excluded"}),
    "no fee": (ad("IT Internship", f"No training fee. Training provided. {MORE}"), {"status": "active", "+tags": ["Employer Training"]}),
    "fee that the employer pays": (ad("IT Internship", f"Training fee covered: company pays all costs. {MORE}"), {"status": "active"}),
    "russian free course": (ad("IT Internship", f"Бесплатное обучение за счет работодателя. {MORE}"), {"status": "active"}),
    "paid internship": (ad("IT Internship", f"This is a paid internship. {MORE}"), {"payment_status": "paid", "+tags": ["Paid Internship", "Internship / Trainee"]}),
    "unpaid internship": (ad("IT Internship", f"This is an unpaid internship. {MORE}"), {"entry_fit": "excluded", "+quality_flags": ["UNPAID"]}),
    "later pay": (ad("Stagiar SEO", "Oferim stagiere cu angajare ulterioară.\nCerințe:\nCunoștințe SEO de bază.\nBeneficii:\nPosibilitatea de angajare și salariu foarte bun în acest caz, la birou."), {"payment_status": "unknown", "entry_fit": "review", "-tags": ["Paid Internship"]}),
    "russian later job": (ad("Стажер SEO", f"Мы предлагаем стажировку с последующим трудоустройством.\n{MORE}"), {"entry_fit": "review"}),
    "course advert": (ad("QA training course for juniors"), {"status": "excluded", "+quality_flags": ["TRAINING_FEE_OR_COURSE"]}),
    # place and time
    "clients abroad": (ad("Junior Developer", f"Benefits:\nGerman lessons, clients in Germany. {MORE}"), {"status": "active"}),
    "onboarding abroad": (ad("Junior Java Developer with onboarding in Germany"), {"status": "excluded", "+quality_flags": ["RELOCATION_REQUIRED"]}),
    "internship abroad": (ad("C++ internship", f"Travel costs reimbursement. Free accommodation throughout the internship. After the internship, a well-paid job in Chisinau. {MORE}"), {"status": "excluded"}),
    "another town": (ad("Junior Developer", location="Bălți"), {"status": "excluded", "+quality_flags": ["OUTSIDE_CHISINAU"]}),
    "remote at home": (ad("Junior Developer", location="Moldova", work_mode="Remote"), {"status": "active", "+tags": ["Remote"]}),
    "remote elsewhere": (ad("Junior Developer", location="Romania", work_mode="Remote"), {"status": "excluded"}),
    "remote in the text beside a mode": (ad("Junior Developer", f"Work from home. {MORE}", work_mode="Full time"), {"+tags": ["Remote"]}),
    "no place": (ad("Junior Developer", location=""), {"entry_fit": "review", "+quality_flags": ["LOCATION_UNCONFIRMED"]}),
    "times": (ad("Junior Developer", f"Flexible schedule, night shifts. {MORE}", schedule="Part-time"), {"+tags": ["Part Time", "Flexible Schedule", "Rotational Shifts"]}),
    # languages and skills
    "languages": (ad("Junior IT Support", f"Cerințe:\nCunoașterea limbii engleze nivel B2. Знание русского языка.\nNice to have:\nGerman language preferred.\nBenefits:\nFree French courses. {MORE}"), {"+tags": ["English Required", "Russian Required", "German Preferred"], "-tags": ["French Required", "German Required"]}),
    "accents": (ad("Junior IT Support", f"Требования:\nЗнание английского языка.\n{MORE}"), {"+tags": ["English Required"]}),
    "skills": (ad("Junior C# / .NET Developer", f"Requirements:\nC++, JavaScript, Python and SQL. {MORE}"), {"+tags": ["C# / .NET", "C++", "JavaScript / Node", "Python", "SQL / DB"], "-tags": ["Java"]}),
    "to react": (ad("Junior IT Support", f"You react to requests quickly. {MORE}"), {"-tags": ["JavaScript / Node"]}),
    "licence and portfolio": (ad("Junior Graphic Designer", f"Permis de conducere cat. B. Send a portfolio. {MORE}"), {"+tags": ["Driver's License", "Portfolio"]}),
    "customers": (ad("Junior IT Support", f"Phone and email support for customers. {MORE}"), {"+tags": ["Customer Facing"], "exposure_score": 5.0}),
    # decisions
    "nothing read": (ad("Junior Developer", ""), {"entry_fit": "review", "+quality_flags": ["DESCRIPTION_UNVERIFIED"]}),
    "mixed seniority": (ad("Programator 1C (Junior / Middle)"), {"entry_fit": "review", "+quality_flags": ["MIXED_SENIORITY"]}),
    "senior": (ad("Senior Developer"), {"status": "excluded", "+quality_flags": ["SENIOR_ROLE"]}),
    "closed": (ad("Junior Developer", availability="closed"), {"status": "excluded", "+quality_flags": ["VACANCY_CLOSED"]}),
    "no signal": (ad("PHP Developer"), {"entry_fit": "other", "fit_score": 30, "+quality_flags": ["BEGINNER_ELIGIBILITY_UNCONFIRMED"]}),
    "all signals": (ad("Junior Developer", f"No experience required. Students welcome. Training provided. {MORE}"), {"entry_fit": "beginner", "fit_score": 100, "+tags": ["No Experience Required", "Students / Graduates Welcome", "Junior / Entry Level"]}),
    "nulls": ((None,) * 7, {"status": "excluded", "category": "General IT"}),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, *a) for k, (a, _) in CASES.items()]
    table = spark.createDataFrame(rows, "name string, title string, text string, location string, work_mode string, schedule string, description_quality string, availability string")
    return {r["name"]: r for r in engine.evaluate(table).collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(judged, name):
    got = judged[name]
    for column, want in CASES[name][1].items():
        if column[0] in "+-":
            assert all((w in got[column[1:]]) == (column[0] == "+") for w in want), (column, want, got[column[1:]], got["reasons"])
        else:
            assert got[column] == want, (column, got[column], got["quality_flags"], got["reasons"], got["tags"])


def test_every_tag_has_unchanged_quotes(judged):
    for name, (advert, _) in CASES.items():
        r = judged[name]
        assert set(r["tag_evidence"]) == set(r["tags"]), (name, set(r["tags"]) ^ set(r["tag_evidence"]))
        for quote in [q for v in (*r["tag_evidence"].values(), *r["flag_evidence"].values(), r["category_evidence"]) for q in v]:
            assert any(quote["text"] in (part or "") for part in advert[:5]), (name, quote)


def test_sections_of_quotes(judged):
    assert [tuple(q) for q in judged["languages"]["tag_evidence"]["German Preferred"]] == [("German language preferred.", "Preferred qualifications")]
    assert [tuple(q) for q in judged["russian years"]["flag_evidence"]["EXPERIENCE_INFLATION_2PLUS_YEARS"]] == [("Опыт работы не менее 2-х лет.", "Requirements")]
    assert [tuple(q) for q in judged["network"]["category_evidence"]] == [("Junior Linux - Network Administrator", "Job title")]


def test_rules_from_a_table(spark, judged):
    """The same labels from the rules as a table; a rule that is added there counts, and makes rows due again."""
    from lodestone.operators import rules, state

    held = rules.table(spark)
    assert rules.read(held) == rules.Rules() and rules.read(held).version == engine.VERSION
    more = rules.read(held.unionByName(spark.createDataFrame([("skill", 99, "any", "cobol|fortran", "Old Languages"), ("category", 99, "title", "arhivar", "Archives")], rules.SCHEMA)))
    rows = [("new", "Junior arhivar", f"You know COBOL. {MORE}", "Chisinau", None, None, "verified", "open"), ("old", *CASES["network"][0])]
    table = spark.createDataFrame(rows, "name string, title string, text string, location string, work_mode string, schedule string, description_quality string, availability string")
    got = {r["name"]: r for r in engine.evaluate(table, more).collect()}
    assert got["new"]["category"] == "Archives" and "Old Languages" in got["new"]["tags"] and [q["text"] for q in got["new"]["tag_evidence"]["Old Languages"]] == ["You know COBOL."]
    same = [c for c in judged["network"].asDict() if c not in ("name", "analysis_version")]
    assert [got["old"][c] for c in same] == [judged["network"][c] for c in same]
    done = table.withColumn("analysis_version", F.lit(engine.VERSION)).withColumn("analyzed_at", F.current_timestamp())
    assert more.version != engine.VERSION and state.pending(done, engine.VERSION).count() == 0 and state.pending(done, more.version).count() == 2
    for bad in (("skill", 1, "title", "x", "y"), ("flag", 1, "any", "x", "y"), ("skill", 1, "any", "(", "y"), ("skill", 1, "any", None, "y")):
        with pytest.raises(ValueError):
            rules.read(spark.createDataFrame([bad], rules.SCHEMA))
