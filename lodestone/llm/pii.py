"""Personal data and secrets replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, let, small

# The shapes of the entities that are looked for.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ACCESS_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
SECRET = r"(?i:\b(?:password|passwd|secret|token|api_key|apikey)\b[ ]?[=:][ ]?[\"']?[A-Za-z0-9_\-+/]{8,}[\"']?)"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
CARD = r"(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?!\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
PHONE = r"(?<![\d\w])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?!\d)"
MALE = "Mr|Herr|Monsieur|Señor|Sr|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа"
#: Titles of either gender.
NEUTRAL = "Dr|Prof|Professor|доктор|профессор"
#: Words within names that stay: particles and initials.
PARTICLE = "von|van|de|der|den|del|della|di|da|dos|du|la|le|zu|zur|bin|al"
_TITLES = "|".join(sorted({x for t in (MALE, FEMALE, NEUTRAL) for w in t.split("|") for x in (w, w.upper())}))
_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)*"
NAME = rf"\b(?:{_TITLES})\b\.? +(?:\p{{Lu}}\. ?)*(?:(?:{PARTICLE}) )*{_WORD}(?: (?:\p{{Lu}}\. ?)*(?:(?:{PARTICLE}) )*{_WORD}){{0,3}}"
SHAPES = {"email": EMAIL, "access_key": ACCESS_KEY, "secret": SECRET, "ip": IPV4, "card": CARD, "ssn": SSN, "phone": PHONE, "name": NAME}
ANY = "|".join(SHAPES.values())
#: No entity can stand in a text without one of these.
HINT = rf"[0-9@]|(?:AKIA|ASIA)[A-Z0-9]{{16}}|[=:][ ]?[\"']?[A-Za-z0-9_\-+/]{{8,}}|\b(?:{_TITLES})\b\.? +\p{{L}}"

# Surrogate names by gender and script.
NAMES = {
    ("m", "latin"): ["Aldo", "Bruno", "Carlo", "Dario", "Elmo", "Fabio", "Guido", "Hugo", "Ivo", "Jano", "Leo", "Milo", "Nino", "Otto", "Pablo", "Rolf"],
    ("f", "latin"): ["Alma", "Berta", "Clara", "Dora", "Elsa", "Flora", "Greta", "Hanna", "Irma", "Julia", "Lena", "Mona", "Nora", "Olga", "Paula", "Rosa"],
    ("m", "cyrillic"): ["Антон", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Степан"],
    ("f", "cyrillic"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ku", "la", "me", "no", "pi", "ra", "se", "ti", "vo", "wa", "ze", "lu"],
    "cyrillic": ["ба", "ве", "го", "ди", "жу", "за", "ки", "ло", "ма", "не", "по", "ру", "са", "те", "фи", "хо"],
}
#: Rounds of drawing after which a format is taken to be used up. Names, addresses, phones and secrets grow by the round, so only fixed formats can come so far.
MAX_ROUNDS = 64
#: Rounds in which phones and secrets keep their length, if they have letters or digits that can change.
SAME_LENGTH = 8
#: Most colliding entities whose replacements are broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 100_000


def kind_of(entity: Column) -> Column:
    found = F.lit("name")
    for name in reversed([k for k in SHAPES if k != "name"]):
        found = F.when(entity.rlike(rf"^(?:{SHAPES[name]})$"), name).otherwise(found)
    return found


def identity(kind: Column, entity: Column) -> Column:
    """What mentions of one entity have in common: case of addresses and names, punctuation of numbers and key names don't count."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    return (
        F.when(kind.isin("email", "family", "given_m", "given_f"), F.lower(entity))
        .when(kind.isin("card", "ssn", "phone"), digits)
        .when(kind == "secret", F.regexp_extract(entity, r"[=:][ ]?[\"']?([A-Za-z0-9_\-+/]{8,})", 1))
        .otherwise(entity)
    )


def _stream(key: str, kind: Column, ident: Column, attempt: Column) -> Column:
    """A keyed digest (HMAC of SHA-256) as 64 hexadecimal digits."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    message = F.encode(F.concat_ws("|", kind, ident, attempt.cast("string")), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _draw(digest: Column, i: Column, n) -> Column:
    """The i-th number below n of a digest; long formats go round, shifted by the round."""
    at = (i * 2) % 62
    return ((F.conv(F.substr(digest, at + 1, F.lit(2)), 16, 10).cast("int") + 7 * (i / 31).cast("int")) % n).cast("int")


def _refill(text: Column, digest: Column) -> Column:
    """``text`` with each letter and digit replaced by one of its class; the rest stays. The n-th letter or digit depends only on n."""
    upper, lower, digit = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("0123456789")

    def put(c: Column, n: Column) -> Column:
        pick = lambda letters, k: F.substr(letters, _draw(digest, n, F.lit(k)) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), pick(digit, 10)).when(c.rlike("[A-Z]"), pick(upper, 26)).when(c.rlike("[a-z]"), pick(lower, 26)).otherwise(c)

    chars = F.split(text, "")
    return F.array_join(F.aggregate(chars, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n")), lambda a, c: F.struct(F.concat(a["out"], F.array(put(c, a["n"]))).alias("out"), (a["n"] + c.rlike("[A-Za-z0-9]").cast("int")).alias("n")), lambda a: a["out"]), "")


def _luhn(number: Column) -> Column:
    """Whether the digits pass the card checksum."""
    digits = F.reverse(F.filter(F.split(number, ""), lambda c: c.rlike("[0-9]")))
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(entity: Column, digest: Column) -> Column:
    """First digit and spacing stay; the last digit restores the checksum where the original had it."""
    filled = F.concat(F.substr(entity, F.lit(1), F.lit(1)), F.substr(_refill(entity, digest), F.lit(2)))
    head = F.substr(filled, F.lit(1), F.length(filled) - 1)
    valid = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), lambda x: _luhn(x)), 1)
    return let(valid, lambda v: F.when(_luhn(entity), v).otherwise(filled))


def parts(kind: Column, entity: Column) -> Column:
    """array<struct<kind, ident, sample>> of what is replaced in a mention: family name and given names, last first, whatever the title; else the whole."""
    part = lambda k, x: F.struct(k.alias("kind"), identity(k, x).alias("ident"), x.alias("sample"))
    named = F.filter(_words(entity), _is_name)
    family = part(F.lit("family"), F.element_at(named, -1))
    male = entity.rlike(rf"^(?i:{MALE})\b")
    # a title of either gender leaves it to the name's ending
    given = lambda x: part(F.when(male | (entity.rlike(rf"^(?i:{NEUTRAL})\b") & ~x.rlike("(?iu)[aая]$")), "given_m").otherwise("given_f"), x)
    others = F.transform(F.reverse(F.slice(named, F.lit(1), F.greatest(F.size(named) - 1, F.lit(0)))), given)
    return F.when(kind != "name", F.array(part(kind, entity))).otherwise(F.concat(F.array(family), others))


def _words(entity: Column) -> Column:
    """The words of a titled name without its title."""
    return F.split(F.regexp_replace(entity, r"^[^ ]+ +", ""), r" |(?<=\.)(?=\p{Lu})")


def _is_name(word: Column) -> Column:
    return ~word.rlike(rf"^(?:(?:{PARTICLE})|\p{{Lu}}\.|)$")


def _named(word: Column, kind: Column, digest: Column, attempt: Column) -> Column:
    """A family or given name in the script of the word, longer by two syllables with each attempt."""
    cyrillic = word.rlike(r"^\p{IsCyrillic}")
    one = lambda of, k: F.get(F.array(*[F.lit(x) for x in of]), _draw(digest, k, F.lit(len(of))))
    more = lambda script, n: F.array_join(F.filter(F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k > 0, one(SYLLABLES[script], k))), lambda x: x.isNotNull()), "")
    made = F.lit(None).cast("string")
    for script, here in (("latin", ~cyrillic), ("cyrillic", cyrillic)):
        made = F.when(here & (kind == "family"), F.concat(F.initcap(more(script, 4 + 2 * attempt)), F.lit("н" if script == "cyrillic" else "n"))).otherwise(made)
        for gender in "mf":
            made = F.when(here & (kind == f"given_{gender}"), F.concat(one(NAMES[gender, script], F.lit(0)), more(script, 2 * attempt))).otherwise(made)
    return F.when(word.rlike(r"^[\p{Lu}'’-]{2,}$"), F.upper(made)).otherwise(made)


def surrogate(entity: Column, kind: Column, ident: Column, attempt: Column, key: str) -> Column:
    """The replacement of one part of a mention: the digest depends on the part's identity alone, the layout on the mention."""

    def made(d: Column) -> Column:
        octets = F.concat_ws(".", *[(_draw(d, F.lit(k), F.lit(223)) + 1).cast("string") for k in range(4)])
        at = F.regexp_extract(entity, r"@.*$", 0)
        tail = F.regexp_extract(entity, r"(\.[A-Za-z]{2,})$", 1)
        local = F.regexp_extract(entity, r"^[^@]+", 0)
        lead = F.regexp_extract(entity, r"^(?:(?i:password|passwd|secret|token|api_key|apikey))[ ]?[=:][ ]?[\"']?", 0)
        value = F.substr(entity, F.length(lead) + 1)
        hexed = F.translate(F.substr(F.repeat(d, 8), F.lit(1), F.length(value)), "", "")
        code = F.when(F.regexp_replace(value, r"[\"']$", "").rlike("^[0-9a-f]+$"), F.concat(F.substr(hexed, F.lit(1), F.length(F.regexp_replace(value, r"[\"']$", ""))), F.regexp_extract(value, r"[\"']$", 0))).otherwise(_refill(value, d))
        longer = lambda sign, n: _refill(F.repeat(F.lit(sign), F.greatest(n, F.lit(0))), F.sha2(d, 256))
        country = F.regexp_extract(entity, r"^\+?\d{1,3}(?=[ .-]?\()|^\+\d", 0)
        return (
            F.when(kind == "email", F.concat(_refill(F.lower(local), d), longer("x", attempt - 1), F.lit("@"), _refill(F.lower(F.substr(at, F.lit(2), F.length(at) - 1 - F.length(tail))), F.reverse(d)), F.lower(tail)))
            .when(kind == "access_key", F.concat(F.substr(entity, F.lit(1), F.lit(4)), _refill(F.substr(entity, F.lit(5)), d)))
            .when(kind == "secret", F.concat(lead, F.regexp_extract(code, r"^[^\"']*", 0), longer("x", F.when(value.rlike("[A-Za-z0-9]"), attempt - SAME_LENGTH).otherwise(attempt)), F.regexp_extract(code, r"[\"']?$", 0)))
            .when(kind == "ip", octets)
            .when(kind == "card", _card(entity, d))
            .when(kind == "phone", F.concat(country, F.substr(_refill(entity, d), F.length(country) + 1), longer("0", attempt - SAME_LENGTH)))
            .when(kind == "ssn", _refill(entity, d))
            .otherwise(_named(entity, kind, d, attempt))
        )

    return let(_stream(key, kind, ident, attempt), made)


def replaced(entity: Column, kind: Column, attempt_of, key: str) -> Column:
    """The replacement of a mention, whose j-th part is drawn at ``attempt_of(j)``. The title of a name stays."""
    new = F.transform(parts(kind, entity), lambda p, j: surrogate(p["sample"], p["kind"], p["ident"], attempt_of(j), key))

    def named(both: Column) -> Column:
        words, names = both["words"], both["names"]
        put = lambda w, i: F.when(_is_name(w), F.get(names, F.size(F.filter(F.slice(words, F.lit(1), i), _is_name)))).otherwise(w)
        return F.concat(F.regexp_extract(entity, r"^[^ ]+ +", 0), F.array_join(F.transform(words, put), " "))

    return F.when(kind == "name", let(F.struct(_words(entity).alias("words"), F.reverse(new).alias("names")), named)).otherwise(F.get(new, 0))


def mentions(docs: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """Rows of ``id_cols`` with the entities of each text in order."""
    text = F.col(text_col)
    return docs.select(*id_cols, F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).alias("found")).where(F.size("found") > 0)


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """(kind, ident, attempt) of the entities whose first surrogate is another's surrogate or a real entity.

    All claims on one surrogate are ordered; the first keeps it, the others draw
    again, until none is left. Distinctness is over the whole table. A fixed
    format with more entities than it has values raises an error.
    """
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_ = entities.select("kind", "ident", "sample", F.lit(0).alias("attempt")).repartition(tasks, "kind", "ident")
    real = entities.select("kind", F.col("ident").alias("new_ident"))
    for _ in range(MAX_ROUNDS):
        made = open_.withColumn("new", surrogate(F.col("sample"), F.col("kind"), F.col("ident"), F.col("attempt"), key))
        # kept, so that the drawing is planned and done once a round, not once for each use
        made = cut(made.select("kind", "ident", identity(F.col("kind"), F.col("new")).alias("new_ident")))
        first = made.groupBy("kind", "new_ident").agg(F.min("ident").alias("first"), F.count("*").alias("n"))
        losers = made.join(first.where(F.col("n") > 1), ["kind", "new_ident"]).where(F.col("ident") != F.col("first")).select("kind", "ident")
        taken = made.join(real, ["kind", "new_ident"], "left_semi").select("kind", "ident")
        again = cut(losers.unionByName(taken).distinct())
        if again.isEmpty():
            return open_.where(F.col("attempt") > 0).select("kind", "ident", "attempt")
        mark = small(again.withColumn("more", F.lit(1)), BROADCAST_ROWS)
        open_ = cut(open_.join(mark, ["kind", "ident"], "left").select("kind", "ident", "sample", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")))
    kinds = sorted(r[0] for r in again.select("kind").distinct().collect())
    raise ValueError(f"no distinct surrogates left for {', '.join(kinds)}")


def bare_names(text: Column, found: Column, kinds: Column, new: Column) -> Column:
    """``text`` with the names of its titled mentions replaced where they stand without title: family alone, or given and family."""
    edge = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x, F.lit(r"\E(?![\p{L}\p{N}])"))
    pairs = F.arrays_zip(found.alias("old"), new.alias("new"), kinds.alias("kind"))
    names = F.transform(F.filter(pairs, lambda p: p["kind"] == "name"), lambda p: F.struct(F.regexp_replace(p["old"], r"^[^ ]+ +", "").alias("old"), F.regexp_replace(p["new"], r"^[^ ]+ +", "").alias("new")))
    last = F.transform(names, lambda p: F.struct(F.element_at(F.split(p["old"], " "), -1).alias("old"), F.element_at(F.split(p["new"], " "), -1).alias("new")))
    swap = lambda into, of: F.aggregate(F.array_distinct(of), into, lambda a, p: F.when(F.contains(a, p["old"]), F.regexp_replace(a, edge(p["old"]), p["new"])).otherwise(a))
    return F.when(F.size(names) > 0, swap(swap(text, names), last)).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with each detected entity in ``text_col`` replaced, plus n_entities and entity_kinds.

    The same entity gets the same surrogate wherever it stands, and another one
    under another ``key``; different entities get different ones, none of which
    is an entity of the input. A name that a text gives with its title is
    replaced in that text without title too, the family name alone or after the
    given name; a given name alone stays, as many are words. n_entities counts
    mentions that were detected by their shape. Texts without entities, nulls
    and empty ones included, stay byte for byte. Rows may repeat; an empty
    table gives an empty one; other columns pass through, and where one has a
    name of ours, ours ends in an underscore.
    """
    text = F.col(text_col)
    names = list(docs.columns)
    n_col, kinds_col = free("n_entities", names), free("entity_kinds", names)
    found_col, all_kinds, new_col, row_col, redo_col = (free(f"__{x}", names) for x in ("found", "kinds", "new", "row", "redo"))
    listed = mentions(docs, [], text_col).select(F.explode("found").alias("entity"))
    listed = listed.select("entity", kind_of(F.col("entity")).alias("kind"))
    listed = listed.select(F.inline(parts(F.col("kind"), F.col("entity"))))
    entities = cut(listed.groupBy("kind", "ident").agg(F.min("sample").alias("sample")))
    retry = cut(attempts(entities, key))
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))
    none = F.array().cast("array<string>")
    rows = docs.withColumn(found_col, F.coalesce(found, none))
    rows = rows.withColumn(all_kinds, F.transform(found_col, lambda e: kind_of(e)))
    if retry.isEmpty():
        new = F.zip_with(found_col, all_kinds, lambda e, k: replaced(e, k, lambda j: F.lit(0), key))
        rows = rows.withColumn(new_col, F.when(F.size(found_col) > 0, new).otherwise(none))
    else:  # attempts of the parts that collided are looked up by part, never by document
        rows = cut(rows.withColumn(row_col, F.monotonically_increasing_id()))
        each = rows.where(F.size(found_col) > 0).select(F.col(row_col).alias("row"), F.posexplode(F.zip_with(found_col, all_kinds, lambda e, k: parts(k, e))).alias("i", "of"))
        each = each.select("row", "i", F.posexplode("of").alias("j", "part")).select("row", (2 * F.col("i") + F.col("j")).alias("at"), "part.kind", "part.ident")
        redo = each.join(small(retry, BROADCAST_ROWS), ["kind", "ident"]).groupBy(F.col("row").alias(row_col)).agg(F.map_from_entries(F.collect_list(F.struct("at", "attempt"))).alias(redo_col))
        rows = rows.join(small(redo, BROADCAST_ROWS), row_col, "left").drop(row_col)
        tried = lambda i, j: F.coalesce(F.try_element_at(F.col(redo_col), 2 * i + j), F.lit(0))
        new = F.transform(found_col, lambda e, i: replaced(e, F.get(all_kinds, i), lambda j: tried(i, j), key))
        rows = rows.withColumn(new_col, F.when(F.size(found_col) > 0, new).otherwise(none)).drop(redo_col)
    woven = let(F.split(text, ANY, -1), lambda p: F.array_join(F.flatten(F.transform(p, lambda x, i: F.array(x, F.coalesce(F.get(new_col, i), F.lit(""))))), ""))
    woven = let(woven, lambda t: bare_names(t, F.col(found_col), F.col(all_kinds), F.col(new_col)))
    out = rows.withColumn(text_col, F.when(F.size(found_col) > 0, woven).otherwise(text))
    return out.withColumn(n_col, F.size(found_col).cast("long")).withColumn(kinds_col, F.array_sort(F.array_distinct(all_kinds))).drop(found_col, all_kinds, new_col)
