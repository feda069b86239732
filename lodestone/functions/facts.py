"""Numbers in prose: required experience and pay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.lexicon import OPTIONAL
from .segments import records, trimmed
from .text import clean, let, normalize, number_words

# Mentions of years, what makes them an applicant's experience, and what does not.
YEARS = r"(?<![\p{L}\p{N}])(\d{1,2})(?:\s*(?:-|to|до)\s*(\d{1,2}))?\s*(?:\+|-х|-го)?\s*(years?|yrs?|ani|an|лет|года?|luni|months?|месяц[а-я]*)(?!\p{L})"
MONTHS = r"luni|months?|месяц"
ABOUT = r"experien[a-z]*|опыт[а-я]*"
MINIMUM = r"minimum|minim|at least|cel putin|не менее|от \d"
MAYBE = r"experien|опыт|minim|at least|cel putin|не менее|от "
COMPANY = r"(?:company|compania|компания|работаем).{0,80}(?:years?|ani|лет)"
MENTOR = r"mana dreapta a unui|mentored by|under (?:the )?(?:guidance|supervision) of|под руководством.{0,40}(?:наставника|коллеги)"
DRIVING = r"стаж[а-я]* вождения|driving experience|experienta (?:de |in )?conducere"
TRAINING, TRAINED = r"training|instruire|обучение", r"(?:years?|ani|лет).{0,20}(?:of )?experience|experienta.{0,40}\d|опыт.{0,40}\d"
UPPER = r"up to|pana la|до\s*$"
STUDENTS = r"(?:or|sau)\s+student|или\s+студент"
# Amounts of money, labels of pay, and pay that comes later.
NUMBER = r"\d+(?:[ .,\u00a0]\d{3})*(?:[.,]\d{1,2})?"
CURRENCY = r"(?:MDL|USD|EUR|lei|euro|dolari|доллар[а-я]*|ле[йя]|\$|€)"
RANGE = r"(?:-|–|—|to|până la|pana la|до)"
AMOUNT = rf"(?<![\p{{L}}\p{{N}}])(?:{CURRENCY}\s*{NUMBER}(?:\s*{RANGE}\s*(?:{CURRENCY}\s*)?{NUMBER})?|{NUMBER}(?:\s*{RANGE}\s*{NUMBER})?\s*{CURRENCY})(?!\p{{L}})"
FROM = r"(?:from|de la|începând de la|incepand de la|от)\s*"
BARE = rf"(?iu)^(?:(?:from|de la|от)\s*)?{NUMBER}(?:\s*{RANGE}\s*{NUMBER})?$"
AMOUNT_LINE = rf"(?iu)^(?:(?:from|de la|от)\s*)?{AMOUNT}(?:\s*(?:per month|monthly|pe lun[aă]|/month|/lun[aă]|в месяц))?[;.!]?$"
ROLE = r"(?iu)^(?:intern(?:ship)?|trainee|junior|stagiar|specialist junior|стажер|стажёр|младший специалист)\s*:\s*"
PAY = r"salary|salari[au]|remunerare|зарплат[а-я]*|заработн[а-я]* плат[а-я]*|compensation|pay:"
LATER = r"after.{0,30}(?:internship|training)|dupa.{0,25}(?:stagiu|instruire)|после.{0,25}стажировк"
LABEL = r"(?iu)^(?:salary|salari[au]l?|зарплата|compensation|remunerare)\s*:$"


def experience(text: Column, requirements: Column | None = None, preferred: Column | None = None, held: Column | None = None) -> Column:
    """struct<required, preferred, alternatives array<struct<years, mentioned, evidence>>, minimum double>.

    Every mention of years or months counts that stands near a word for
    experience, or in a sentence of ``requirements`` that names a minimum. The
    first number of a range counts, months are twelfths, and an upper bound asks
    for none; ``mentioned`` is the larger number. Company age, training, mentors
    and driving do not count. A student alternative comes first, then options
    (worded so, or in ``preferred``). The minimum is the largest required
    number, or null; 0 differs from null. ``held`` may give the records of the
    text, where they are known already.
    """
    tail, head = (lambda s, n: F.substring(s, F.greatest(F.length(s) - n + 1, F.lit(1)), F.lit(n))), (lambda s, n: F.substring(s, F.lit(1), F.lit(n)))

    def mention(said: Column, n: Column, implied: Column, wished: Column, pieces: Column, m: Column, i: Column) -> Column:
        before, after = F.array_join(F.slice(pieces, 1, 2 * i + 1), ""), F.array_join(F.slice(pieces, 2 * i + 3, F.size(pieces)), "")
        low, high, unit = (F.nullif(F.regexp_extract(m, YEARS, k), F.lit("")) for k in (1, 2, 3))
        years = lambda x: F.when(unit.rlike(MONTHS), x.cast("double") / 12).otherwise(x.cast("double"))
        near = F.concat(tail(before, 100), m, head(after, 100))
        counted = (near.rlike(ABOUT) | implied) & ~(near.rlike(TRAINING) & ~near.rlike(TRAINED))
        # an option in brackets that hold no mention does not make the mention optional
        judged = F.when(before.rlike(r"\([^)]*$"), n).otherwise(F.regexp_replace(n, r"\([^)]*\)", ""))
        kind = F.when(n.rlike(STUDENTS), "alternatives").when(judged.rlike(OPTIONAL) | wished, "preferred").otherwise("required")
        value = F.when(tail(before, 20).rlike(UPPER), F.lit(0.0)).otherwise(years(low))
        return F.struct(value.alias("years"), years(F.coalesce(high, low)).alias("mentioned"), said.alias("evidence"), kind.alias("kind"), counted.alias("counted"))

    def read(r: Column, asked: Column, optional: Column) -> Column:
        def numbered(n: Column) -> Column:
            implied = F.array_contains(asked, r["normalized"]) & n.rlike(MINIMUM)
            wished = (F.length(optional) > 0) & F.contains(optional, r["normalized"])
            ours = (n.rlike(ABOUT) | implied) & ~n.rlike(COMPANY) & ~n.rlike(f"{MENTOR}|{DRIVING}")
            found = F.regexp_extract_all(n, F.lit(YEARS), F.lit(0))
            pieces = F.flatten(F.zip_with(F.split(n, YEARS, -1), found, lambda x, y: F.array(x, F.coalesce(y, F.lit("")))))
            listed = let(pieces, lambda p: F.transform(found, lambda m, i: mention(r["text"], n, implied, wished, p, m, i)))
            return F.when(ours, F.filter(listed, lambda x: x["counted"]))

        return let(number_words(r["normalized"]), numbered)

    def buckets(found: Column) -> Column:
        of = lambda k: F.transform(F.filter(found, lambda x: x["kind"] == k), lambda x: F.struct(x["years"].alias("years"), x["mentioned"].alias("mentioned"), x["evidence"].alias("evidence")))
        return F.struct(of("required").alias("required"), of("preferred").alias("preferred"), of("alternatives").alias("alternatives"), F.array_max(F.transform(of("required"), lambda x: x["years"])).alias("minimum"))

    # what counts stands near a word for experience or in a sentence that names a minimum, and most sentences hold neither
    timed = F.filter(records(text, "") if held is None else held, lambda r: r["normalized"].rlike(MAYBE) & r["normalized"].rlike(r"years?|yrs?|\ban\b|ani|лет|год|luni|month|месяц"))
    # what sentences are held against is worked out once a text, not once a sentence
    listed = F.transform(records(F.lit("") if requirements is None else requirements, ""), lambda r: r["normalized"])
    against = F.struct(listed.alias("asked"), (F.lit("") if preferred is None else normalize(preferred)).alias("optional"))
    found = let(against, lambda k: F.transform(timed, lambda r: read(r, k["asked"], k["optional"])))
    return let(F.flatten(F.array_compact(found)), buckets)


def salary(field: Column, title: Column, text: Column, unclear: Column | None = None) -> Column:
    """The stated pay, or empty: the field (with an amount or a bare number), else the title's amount, else lines about pay.

    An amount is a number or range with a currency on either side. Lines on pay
    after an internship do not count; a label alone in its line takes up to
    three lines of amounts; else the first amount of the line, or of the line of
    amounts after it, with a word for "from". ``unclear`` suppresses all.
    """
    found = lambda c: F.regexp_extract(c, rf"(?iu)({AMOUNT})", 1)
    stated = F.regexp_replace(clean(field), r"\s+", " ")
    is_amount = lambda c: F.coalesce(F.regexp_replace(c, ROLE, "").rlike(AMOUNT_LINE), F.lit(False))

    def line_pay(lines: Column, line: Column, i: Column) -> Column:
        more = [F.get(lines, i + k) for k in (1, 2, 3)]
        held = [is_amount(more[0]), is_amount(more[0]) & is_amount(more[1]), is_amount(more[0]) & is_amount(more[1]) & is_amount(more[2])]
        joined = F.concat_ws("; ", *[F.when(h, F.regexp_replace(m, r"[;.!]$", "")) for h, m in zip(held, more, strict=True)])
        here = F.concat_ws(" ", line, F.when(F.coalesce(more[0].rlike(AMOUNT_LINE), F.lit(False)), more[0]))
        single = F.regexp_extract(here, rf"(?iu)((?:{FROM})?{AMOUNT})", 1)
        single = F.coalesce(F.nullif(single, F.lit("")), F.nullif(found(here), F.lit("")))
        n = normalize(line)
        return F.when(n.rlike(PAY) & ~n.rlike(LATER), F.coalesce(F.when(line.rlike(LABEL), F.nullif(joined, F.lit(""))), single))

    first = lambda lines: F.get(F.filter(F.transform(lines, lambda line, i: line_pay(lines, line, i)), lambda x: x.isNotNull()), F.lit(0))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+"), clean)
    out = F.coalesce(F.when(stated.rlike(rf"(?iu){AMOUNT}") | stated.rlike(BARE), stated), F.nullif(trimmed(found(F.coalesce(title, F.lit("")))), F.lit("")), let(lines, first), F.lit(""))
    return out if unclear is None else F.when(F.coalesce(unclear, F.lit(False)), "").otherwise(out)
