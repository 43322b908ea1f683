"""Surrogates for personal data and secrets, with DataFrame operations only.

Found: e-mail addresses in any script, secrets (values after password, token, ...; access keys), IBANs, IPv4 and IPv6
addresses, social security numbers, payment cards, phone numbers, and names after a title (Mr, Mrs, Herr, Frau, Señor,
г-н, ...) with all other mentions of such a name or its family name in the same text. IBANs and cards count only if their
check sums are right: other numbers stay as they are. Each different entity gets a surrogate made from a secret key, so that it is the same wherever it is mentioned,
however it is formatted there (coreference), and of its own kind: letters stay letters of their script and case, digits
digits; phone numbers keep their country, cards their first digit and valid check digit, IBANs their country and check
sum, addresses stay in range, names keep script and the gender that a title of theirs tells, in whatever text it does. A
phone number with and without its +1 is one entity, and so are the stems of a couple's family name in Russian.

Collision checks: a surrogate is taken only if no other entity of the kind has it and no real entity equals it; the others
are made anew with the next attempt, until all are distinct; once surrogates of an entity's length seem to be used up, it
gets a longer one. What is joined are entities of different texts: texts without a mention never leave their task, and
texts with one meet their surrogates by their digest.

Defined cases: null texts stay null, empty ones empty; text outside mentions stays as it is, however long; repeated rows
are all rewritten alike; of equal surrogates the entity that sorts first keeps its own; other columns, whatever their
names, are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpoint, fresh, release

MALE = ["Mr", "Herr", "Señor", "Monsieur", "г-н", "господин", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "г-жа", "госпожа", "Госпожа"]
NEUTRAL = ["Dr", "Prof"]
#: Attempts with surrogates as long as the entity, and attempts in all.
PLAIN_ATTEMPTS, MAX_ATTEMPTS = 6, 30

_WORD = r"[\p{L}\p{M}\p{N}"
_EMAIL = rf"(?<!{_WORD}._%+-]){_WORD}._%+-]++@(?={_WORD}.-]*\.\p{{L}}{{2}}){_WORD}-]++(?:\.{_WORD}-]++)++"
_BEFORE = r"(?i:password|passwort|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
_SECRET = _BEFORE + r"(?=\S{8})[^\s\"'<>,;]{7,}[^\s\"'<>,;.!?:)\]}]"
_KEY = r"\bAKIA[0-9A-Z]{16}\b|\b(?:sk-|ghp_|xox[bp]-)[A-Za-z0-9-]{16,}+|\bBearer [A-Za-z0-9._~+/-]{15,}[A-Za-z0-9_~+/=-]"
_IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
_IP6 = r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}(?![\w:])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<![\d.+-])(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{13,19}|\d(?:[ -]?\d){12,18})(?![\d-])"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\d.,+-])0\d{2,4}[ /]\d{5,7}(?![\d-])"
_TITLE = r"(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.? "
_NAME = rf"(?<![\p{{L}}\p{{N}}]){_TITLE}" + r"\p{Lu}\p{L}++(?: \p{Lu}\p{L}++)?"
ENTITY = "|".join((_EMAIL, _SECRET, _KEY, _IBAN, _IP, _IP6, _SSN, _CARD, _PHONE, _NAME))
#: False only for texts in which ENTITY can't match; cheap to tell.
_HINT = rf"[@0-9]|(?i:passw|pwd|token|secret|api[_-]?key)|sk-|ghp_|xox|Bearer |{_TITLE}|[0-9A-Fa-f]:"
#: Endings of Russian family names of men; those of women have one letter more.
_RUSSIAN = "(?:ов|ев|ёв|ин|ын)"

#: Country codes of one and two digits; all others have three.
_COUNTRY_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_CONSONANTS, _VOWELS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдклмнпрст", "greek": "βγδκλμνπρστ"}, {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
_ENDINGS = {
    "latin given male": "on", "latin given female": "ia", "latin given other": "en", "latin family male": "er", "latin family female": "er", "latin family other": "er",
    "cyrillic given male": "ан", "cyrillic given female": "ина", "cyrillic given other": "ень", "cyrillic family male": "ов", "cyrillic family female": "ова", "cyrillic family other": "енко",
    "greek given male": "ος", "greek given female": "ια", "greek given other": "εν", "greek family male": "ης", "greek family female": "η", "greek family other": "ου",
}
#: First code point and number of the letters of an alphabet: digits, a-z, A-Z, accented Latin (twice), Greek, Cyrillic,
#: Armenian, Hebrew, Arabic (twice), Devanagari, Thai, Georgian, Hiragana, Katakana, Han, Hangul.
_ALPHABETS = [(48, 10), (97, 26), (65, 26), (0xE0, 23), (0xF8, 7), (0x3B1, 25), (0x430, 32), (0x561, 38), (0x5D0, 27), (0x621, 26), (0x641, 10), (0x915, 37), (0xE01, 46), (0x10D0, 33), (0x3041, 86), (0x30A1, 90), (0x4E00, 20902), (0xAC00, 11172)]


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once and written once in the plan."""
    return F.transform(F.array(value), body)[0]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _chars(s: Column) -> Column:
    return F.split(s, "")


def kind_of(m: Column) -> Column:
    """What a mention is: the same order as in ENTITY."""
    return (
        F.when(m.rlike(r"^[^\s=:\"']+@"), "email")
        .when(m.rlike(r"^(?i:password|passwort|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]"), "secret")
        .when(m.rlike(r"^(AKIA|sk-|ghp_|xox[bp]-|Bearer .{16})"), "secret")
        .when(m.rlike(r"^[0-9A-Fa-f]{1,4}:"), "ipv6")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card")
        .when(m.rlike(r"^[+(\d]"), "phone")
        .otherwise("name")
    )


def _gender(m: Column) -> Column:
    title = F.regexp_extract(m, r"^([^\s.]+)", 1)
    return F.when(title.isin(MALE), "male").when(title.isin(FEMALE), "female").otherwise("other")


def _value(m: Column) -> Column:
    """A secret without the word before it."""
    return F.regexp_replace(m, f"^(?:{_BEFORE}|Bearer )", "")


def is_entity(m: Column) -> Column:
    """False for what has the form of an IBAN or a card but not its check sum."""
    kind, solid = kind_of(m), F.regexp_replace(m, " ", "")
    rest = _rest97(F.concat(F.substring(solid, F.lit(5), F.length(solid)), F.substring(solid, 1, 4)))
    return F.when(kind == "iban", rest == 1).when(kind == "card", _luhn(_digits(m)) == 0).otherwise(True)


def parts_of(m: Column) -> Column:
    """array<struct<kind, name>>: what a mention refers to, however it is written; a name has a part for each word."""
    kind = kind_of(m)
    name = (
        F.when(kind == "email", F.when(F.length(F.lower(m)) == F.length(m), F.lower(m)).otherwise(m))
        .when(kind == "secret", _value(m))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "ip", m)
        .when(kind == "ipv6", F.lower(m))
        .when(kind == "phone", F.concat(F.when(m.startswith("+"), "+").when(m.rlike(r"^\(|^\d{3}[.-]"), "+1").otherwise(""), _digits(m)))
        .otherwise(_digits(m))
    )
    words = F.split(F.regexp_replace(F.lower(m), f"^(?i){_TITLE}", ""), " ")

    def role(w, i):
        family = (F.size(words) == 1) | (i > 0)
        by_form = F.when(family & w.rlike(f"{_RUSSIAN}а$"), "female").when(family & w.rlike(f"{_RUSSIAN}$"), "male").otherwise("other")
        gender = F.when(_gender(m) == "other", by_form).otherwise(_gender(m))
        stem = F.when(family & (gender == "female") & w.rlike(f"{_RUSSIAN}а$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
        return F.struct(F.concat(F.when(family, F.lit("family ")).otherwise(F.lit("given ")), gender).alias("kind"), stem.alias("name"))

    roles = F.transform(words, role)
    return F.when(kind == "name", roles).otherwise(F.array(F.struct(kind.alias("kind"), name.alias("name"))))


def _substituted(name: Column, seed: Column) -> Column:
    """Every digit and letter replaced by one of its own alphabet, other characters kept; a Latin letter outside the
    alphabets by an accented one, any other letter by one of a-z."""
    alphabets = F.array(*(F.struct(F.lit(first).alias("first"), F.lit(n).alias("n")) for first, n in _ALPHABETS))

    def one(c, i):
        code = F.ascii(c)
        own = F.filter(alphabets, lambda r: (code >= r["first"]) & (code < r["first"] + r["n"]))
        other = F.when(c.rlike(r"\p{IsLatin}"), alphabets[3]).when(c.rlike(r"\p{L}"), alphabets[1])
        drawn = lambda r: F.decode(F.unhex(F.lpad(F.hex(r["first"] + F.pmod(F.xxhash64(seed, i), r["n"])), 4, "0")), "UTF-16BE")
        return F.coalesce(_let(F.coalesce(F.get(own, F.lit(0)), other), drawn), c)

    return F.array_join(F.transform(_chars(name), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""

    def worth(c, i):
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), worth), F.lit(0), lambda a, x: a + x) % 10


def _rest97(text: Column) -> Column:
    """The number that letters (A is 10) and digits spell, modulo 97."""

    def step(acc, c):
        return F.when(c.rlike("[A-Z]"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(_chars(text), F.lit(0), step)


def _name_word(name: Column, kind: Column, seed: Column, more: Column) -> Column:
    """A made-up word of name's script with an ending that fits kind; null for a script without syllables."""
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").when(name.rlike(r"\p{IsLatin}"), "latin")

    def spelt(s):
        by_script = lambda letters: F.element_at(F.create_map(*(F.lit(x) for pair in letters.items() for x in pair)), s)
        pick = lambda letters, i: F.substring(letters, (F.pmod(F.xxhash64(seed, i), F.length(letters)) + 1).cast("int"), F.lit(1))
        stem = F.transform(F.sequence(F.lit(0), more + 3), lambda i: F.concat(pick(by_script(_CONSONANTS), 2 * i), pick(by_script(_VOWELS), 2 * i + 1)))
        return F.concat(F.array_join(stem, ""), pick(by_script(_CONSONANTS), F.lit(-2)), F.element_at(F.create_map(*(F.lit(x) for pair in _ENDINGS.items() for x in pair)), F.concat_ws(" ", s, kind)))

    return _let(script, spelt)


def surrogate(kind: Column, name: Column, attempt: Column, key: str) -> Column:
    """What stands for an entity, in the plain form that parts_of gives; equal arguments give equal results. From the
    attempt PLAIN_ATTEMPTS on it is longer than the entity, as surrogates of that length seem to be used up."""
    # The gender of a family name shapes its ending alone, so that a couple keeps one stem.
    seed_of = F.sha2(F.concat_ws("\x1f", F.lit(key), F.split(kind, " ")[0], name, attempt.cast("string")), 256)
    more = F.greatest(attempt - PLAIN_ATTEMPTS + 1, F.lit(0)).cast("int")

    def made(seed):
        extra = lambda letters: F.array_join(F.transform(F.slice(F.sequence(F.lit(1), 2 * more + 1), F.lit(1), 2 * more), lambda i: F.substring(F.lit(letters), (F.pmod(F.xxhash64(seed, -i), F.lit(len(letters))) + 1).cast("int"), F.lit(1))), "")

        def of_plain(plain):
            body = F.concat(F.substring(name, 1, 1), F.substring(plain, F.lit(2), F.length(name) - 1), extra("0123456789"))
            checked = lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string"))
            abroad = F.regexp_extract(name, f"{_COUNTRY_CODE}|^0", 0)
            area = (F.pmod(F.xxhash64(seed, F.lit(-1)), F.lit(8)) + 2).cast("string")
            phone = F.concat(abroad, area, F.substring(plain, F.length(abroad) + 2, F.length(name)), extra("0123456789"))
            country = F.substring(name, 1, 2)
            iban = lambda bank: F.concat(country, F.lpad((98 - _rest97(F.concat(bank, country, F.lit("00")))).cast("string"), 2, "0"), bank)
            dot = F.length(name) - F.instr(F.reverse(name), ".") + 1
            prefix = F.regexp_extract(name, "^(AKIA|sk-|ghp_|xox[bp]-)", 1)
            return (
                F.when(kind == "email", F.concat(extra("abcdefghijklmnopqrstuvwxyz"), F.substring(plain, F.lit(1), dot - 1), F.substring(name, dot, F.length(name))))
                .when(kind == "secret", F.concat(prefix, F.substring(plain, F.length(prefix) + 1, F.length(name)), extra("0123456789abcdef")))
                .when(kind == "iban", _let(F.concat(F.substring(plain, F.lit(5), F.length(name)), extra("0123456789")), iban))
                .when((kind == "card") & (_luhn(name) == 0), _let(F.substring(body, F.lit(1), F.length(body) - 1), checked))
                .when(kind == "card", body)
                .when(kind == "phone", phone)
                .otherwise(F.concat(plain, extra("0123456789")))
            )

        octet = lambda i: (F.pmod(F.xxhash64(seed, i), F.lit(254)) + 1).cast("string")
        hexed = F.array_join(F.transform(_chars(name), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(F.pmod(F.xxhash64(seed, i), F.lit(16)))))), "")
        return F.coalesce(
            F.when(kind == "ip", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), octet), "."))
            .when((kind == "ipv6") | (kind == "secret") & name.rlike("^[0-9a-f]+$"), F.concat(hexed, extra("0123456789abcdef")))
            .when(kind.rlike("^(given|family) "), _name_word(name, kind, seed, more)),
            _let(_substituted(name, seed), of_plain),
        )

    return _let(seed_of, made)


def _formatted(mention: Column, kind: Column, name: Column, new: Column) -> Column:
    """The plain surrogate in the mention's own format: its separators, its case, the word before a secret. What the
    surrogate has more than the entity stands before an address, and after the rest."""
    digits_before = lambda i: F.length(_digits(F.substring(mention, F.lit(1), i)))
    places = F.sequence(F.lit(1), F.length(mention))
    at_home = (kind == "phone") & name.startswith("+") & ~mention.startswith("+")
    plain = F.when(at_home, F.substring(_digits(new), F.lit(2), F.length(new))).otherwise(_digits(new))
    numbered = F.array_join(F.transform(places, lambda i: F.when(F.substring(mention, i, F.lit(1)).rlike(r"\d"), F.substring(plain, digits_before(i), F.lit(1))).otherwise(F.substring(mention, i, F.lit(1)))), "")
    over = F.greatest(F.length(new) - F.length(mention), F.lit(0))
    cased = F.array_join(F.zip_with(_chars(mention), _chars(F.substring(new, over + 1, F.length(new))), lambda old, c: F.when(old != F.lower(old), F.upper(c)).otherwise(c)), "")
    solid_before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), " ", ""))
    spaced = F.array_join(F.transform(places, lambda i: F.when(F.substring(mention, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substring(new, solid_before(i), F.lit(1)))), "")
    return (
        F.when(kind == "email", F.concat(F.substring(new, F.lit(1), over), cased))
        .when(kind == "secret", F.concat(F.substring(mention, F.lit(1), F.length(mention) - F.length(name)), new))
        .when(kind == "iban", F.concat(spaced, F.substring(new, F.length(name) + 1, F.length(new))))
        .when(kind.isin("ssn", "card", "phone"), F.concat(numbered, F.substring(plain, F.length(_digits(mention)) + 1, F.length(plain))))
        .when(kind == "ipv6", F.when(mention == F.upper(mention), F.upper(new)).otherwise(new))
        .when(kind.rlike("^(given|family) "), F.initcap(new))
        .otherwise(new)
    )


def resolved(entities: DataFrame, key: str) -> DataFrame:
    """(kind, name, new) for distinct entities (kind, name): surrogates that differ from each other and from all entities."""
    family = lambda c: F.split(c, " ")[0]
    left, taken = entities.select("kind", "name"), None
    forms = F.when(F.col("kind") == "family female", F.array(F.lower("name"), F.concat(F.lower("name"), F.lit("а")))).otherwise(F.array(F.lower("name")))
    real = entities.select(family(F.col("kind")).alias("sort"), F.explode(forms).alias("new")).distinct()
    for attempt in range(MAX_ATTEMPTS):
        tries = left.select("kind", "name", family(F.col("kind")).alias("sort"), surrogate(F.col("kind"), F.col("name"), F.lit(attempt), key).alias("made"))
        tries = checkpoint(tries.select("kind", "name", "sort", "made", F.lower("made").alias("new")))
        first = tries.groupBy("sort", "new").agg(F.min("name").alias("name"))  # a family name of either gender is one entity
        free = first.join(real, ["sort", "new"], "left_anti")
        if taken is not None:
            free = free.join(taken.select(family(F.col("kind")).alias("sort"), F.lower("new").alias("new")), ["sort", "new"], "left_anti")
        won = checkpoint(free.join(tries, ["sort", "new", "name"]).select("kind", "name", F.col("made").alias("new")))
        taken = won if taken is None else taken.unionByName(won)
        done = left
        left = checkpoint(left.join(won, ["kind", "name"], "left_anti"))
        release(tries, done if attempt else None)
        if left.isEmpty():
            return taken
    raise RuntimeError(f"some entities have no distinct surrogate after {MAX_ATTEMPTS} attempts")


def with_genders(entities: DataFrame, key: str) -> DataFrame:
    """resolved(), where a name that is met without a gender too is the one that is known by one gender alone."""
    role, gender = F.split("kind", " ")[0], F.split("kind", " ")[1]
    named = entities.where(F.col("kind").rlike("^(given|family) ")).select(role.alias("role"), gender.alias("gender"), "kind", "name")
    known = named.where("gender <> 'other'").groupBy("role", "name").agg(F.min("kind").alias("as_kind"), F.max("kind").alias("other_kind")).where("as_kind = other_kind")
    same = checkpoint(named.where("gender = 'other'").join(known, ["role", "name"]).select("kind", "name", "as_kind"))
    table = resolved(entities.join(same, ["kind", "name"], "left_anti"), key)
    return table.unionByName(same.join(table.withColumnRenamed("kind", "as_kind"), ["as_kind", "name"]).select("kind", "name", "new"))


def pattern_of(found: Column) -> Column:
    """ENTITY and the names that mentions with a title give, with or without their given names; null if there are none."""
    titled = F.filter(found, lambda m: m.rlike(rf"^{_TITLE}\p{{Lu}}"))
    names = F.array_distinct(F.transform(titled, lambda m: F.regexp_replace(m, f"^{_TITLE}", "")))
    ways = F.transform(F.filter(names, lambda n: F.length(n) > 1), lambda n: F.regexp_replace(n, r"^(\S+ )(?=\S)", "(?:$1)?"))
    edge = r")(?![\p{L}\p{M}\p{N}_@]|[.-][\p{L}\p{N}])"
    return F.when(F.size(ways) > 0, F.concat(F.lit(rf"{ENTITY}|(?<![\p{{L}}\p{{M}}\p{{N}}_@.-])(?:"), F.array_join(ways, "|"), F.lit(edge)))


def found_in(text: Column) -> Column:
    """struct<pattern, mentions>: what stands for what in the text, in order; pattern is null where ENTITY is enough."""

    def whole(first):
        return _let(F.struct(pattern_of(first).alias("pattern")), lambda p: F.struct(p["pattern"].alias("pattern"), F.when(p["pattern"].isNotNull(), F.regexp_extract_all(text, p["pattern"], F.lit(0))).otherwise(first).alias("mentions")))

    return F.when(text.rlike(_HINT), _let(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), whole))


def replace(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with surrogates in their texts; count_col, if named, tells how many mentions were replaced.

    Texts are searched once, those with a name after a title twice; docs and what was found in them are written to the shared
    folder and read from there. Texts with mentions are cut at them again when the surrogates are known.
    """
    text = F.col(text_col)
    found, digest, new, gone = fresh(docs, "found", "digest", "surrogates", "digest_of")
    rows = checkpoint(docs.withColumn(found, found_in(text)))
    mentions, pattern = F.col(found)["mentions"], F.col(found)["pattern"]
    size = F.coalesce(F.size(F.filter(mentions, is_entity)), F.lit(0))
    some = rows.where(size > 0)
    held = checkpoint(some.select(F.md5(text.cast("binary")).alias("digest"), mentions.alias("mentions")).groupBy("digest").agg(F.first("mentions").alias("mentions")))
    each = held.select("digest", F.posexplode("mentions").alias("at", "mention"))
    kept = each.where(~is_entity(F.col("mention"))).select("digest", "at", F.col("mention").alias("new"))
    parts = each.where(is_entity(F.col("mention"))).select("digest", "at", "mention", F.posexplode(parts_of(F.col("mention"))).alias("part", "p")).select("digest", "at", "mention", "part", "p.kind", "p.name")
    table = with_genders(checkpoint(parts.select("kind", "name").distinct()), key)
    made = parts.join(table, ["kind", "name"]).select("digest", "at", "part", "mention", "kind", _formatted(F.col("mention"), F.col("kind"), F.col("name"), F.col("new")).alias("new"))
    named = F.col("kind").rlike("^(given|family) ")
    whole = made.groupBy("digest", "at").agg(F.first("mention").alias("mention"), F.min("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), " ").alias("new"))
    whole = whole.select("digest", "at", F.when(named, F.concat(F.regexp_extract("mention", f"^({_TITLE})", 1), F.col("new"))).otherwise(F.col("new")).alias("new")).unionByName(kept)
    per_text = checkpoint(whole.groupBy(F.col("digest").alias(gone)).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias(new)))
    release(held)
    touched = some.withColumn(digest, F.md5(text.cast("binary"))).join(per_text, F.col(digest) == F.col(gone))
    gaps = F.when(pattern.isNotNull(), F.split(text, pattern, -1)).otherwise(F.split(text, ENTITY, -1))
    joined = F.array_join(F.zip_with(gaps, F.col(new), lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
    columns = lambda df, value: df.select(*(value.alias(c) if c == text_col else F.col(c) for c in docs.columns), *([size.cast("int").alias(count_col)] if count_col else []))
    return columns(rows.where(size == 0), text).unionByName(columns(touched, joined))
