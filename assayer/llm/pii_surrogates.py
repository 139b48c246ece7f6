"""PII surrogates with DataFrame functions only (operator 10).

Entities (e-mail addresses, phone numbers, card numbers, IBANs, social security numbers, IPv4
addresses, secrets, and persons named after an honorific) are found by one regular expression over the
whole text and replaced by surrogates of the same type: digits by digits, letters by letters of the
same case and script (Latin, Cyrillic, Greek, Han; others by Latin ones), separators kept. Texts that
hold none of the signs without which nothing can match (a digit, an at sign, an honorific, the start of
a key) are not searched further.

A person is an honorific and up to three name words, with hyphens, apostrophes, inner capitals and
particles, which stay. The last word is the surname, those before it are given names. A given name
follows the gender of its honorific; after a title without gender it is the person of the one gender
with which the corpus has that name, if there is just one. Once a document names a person so, the name
words stand for that person wherever else they stand as words of their own in it.

A surrogate is a keyed hash (SHA-256 twice, key inside and outside) of type, normalised value and
attempt, so an entity has one surrogate wherever and however it is written (coreference): phone and
card numbers are compared by their digits, addresses without case, parts of a name one by one, and the
domain of an address has a surrogate of its own. The table of distinct entities is checked: two
entities of a type with one surrogate (addresses with all of it, the domain included), or a surrogate
that is a real entity of the corpus, send the later entity (by value) to its next attempt, until all
are distinct. A shape with fewer surrogates than the corpus has entities is left at attempt
``LONGER_AT``: from there octets have three digits, and other surrogates more characters with every
attempt. Entities beyond their first attempt are exceptions; up to ``MAP_ENTRIES`` of them are looked
up in a constant map, more are joined.

Text without entities is returned as it is. Defined results: a null text stays null with no entities;
an empty text stays empty; repeated rows get equal surrogates; null ids are kept; an empty table gives
an empty table. Columns named like output columns are replaced. A person whom a document never names
with an honorific is not detected there, and card surrogates keep no check digit.

The key is given by the caller; the queries take it from ``spark.assayer.pii.key``.
"""

from __future__ import annotations

import json
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.common import materialise, shielded, table, without

KEY_SETTING = "spark.assayer.pii.key"
MAP_ENTRIES = 2_000
#: From this attempt on a surrogate is longer than its entity: the shape has too few of its own.
LONGER_AT = 6
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος")
OTHER = ("Dr", "Prof")
_HONORIFIC = "|".join((*FEMALE, *MALE, *OTHER))
_NOT_AFTER = r"(?<![\p{L}\p{N}])"
_NOT_BEFORE = r"(?![\p{L}\p{N}])"
_PARTICLES = "von|vom|zu|zum|zur|van|der|den|de|del|della|di|da|das|dos|du|la|le|ter|ten|bin|ibn|al|el|y|e"
_NAME_WORD = rf"(?!(?:{_HONORIFIC})(?!\p{{L}}))" + r"\p{Lu}\p{L}*+(?:(?:['’](?!s(?!\p{L}))|\-)\p{L}++)*+(?<=\p{Ll})"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]+\.)+\p{L}{2,}",
    "secret": _NOT_AFTER + r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})" + _NOT_BEFORE,
    "iban": _NOT_AFTER + r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _NOT_BEFORE,
    "card": _NOT_AFTER + r"(?:[0-9]{13,19}|[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,7})" + _NOT_BEFORE,
    "ssn": r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])",
    "phone": r"(?<![\p{L}\p{N}.])(?:(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,5}\)[ .\-]?[0-9]{2,4}[ .\-]?[0-9]{2,4}|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}|[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4})" + _NOT_BEFORE,
    "name": _NOT_AFTER + rf"(?:{_HONORIFIC})\.? (?:(?:{_PARTICLES}) )*{_NAME_WORD}(?: (?:(?:{_PARTICLES}) )*{_NAME_WORD}){{0,2}}" + _NOT_BEFORE,
}
_TITLED = rf"^(?:{_HONORIFIC})\.? "
#: Every entity holds one of these.
SIGNS = rf"[0-9@]|[a-f]{{32}}|[A-F]{{32}}|gh[pousr]_|sk-|AKIA|ASIA|{_NOT_AFTER}(?:{_HONORIFIC})\.? "
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Syllables of surrogate names by script: consonants, vowels, endings of female, male and other given names, ending of surnames.
SCRIPTS = {
    "latin": ("bdfgklmnprstvzjh", "aeiouaeiouaeioua", "a", "o", "e", "er"),
    "cyrillic": ("бдфгклмнпрствзжх", "аеиоуаеиоуаеиоуа", "а", "он", "е", "ов"),
    "greek": ("βδφγκλμνπρστθζξχ", "αεηιοωαεηιοωαεηι", "α", "ος", "ι", "ης"),
}
_HEX = "0123456789abcdef"
LETTERS = {"latin": "bcdfghjkmnpqrtvz", "cyrillic": "бвгджзклмнпрстфх", "greek": "βγδζθκλμνξπρστφχ", "han": "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳"}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once and stands in the plan once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(m: Column) -> Column:
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(r"^(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_.*|sk-.*)$"), "secret")
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(m.rlike(r"^\p{Lu}"), "name")
        .when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,7})$"), "card")
        .otherwise("phone")
    )


def normal(kind: Column, m: Column) -> Column:
    """The value by which entities are the same."""
    return F.when(kind == "email", F.lower(m)).when(kind.isin("card", "ssn", "phone", "iban"), F.regexp_replace(m, r"[ .()\-]", "")).when(kind == "secret", F.lower(m)).otherwise(m)


def digest(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    inner = F.sha2(F.concat_ws("\x01", F.lit(key), kind, value, attempt.cast("string")), 256)
    return F.sha2(F.concat_ws("\x01", F.lit(key), inner), 256)


def _shaped(m: Column, d: Column) -> Column:
    """Letters and digits of ``m`` replaced by those of the digest, one by one; the rest kept."""

    def one(i: Column) -> Column:
        def of(c: Column, before: Column) -> Column:
            hexit = F.substring(d, F.pmod(before, F.lit(60)) + 1, F.lit(1))
            digit = F.translate(hexit, "abcdef", "361709")
            first = (before == 1) & (c != "0") & (digit == "0") & (F.char_length(F.regexp_replace(m, r"[^\p{L}\p{N}]", "")) > 1)  # no new leading zero
            script = F.when(c.rlike(r"\p{IsCyrillic}"), LETTERS["cyrillic"]).when(c.rlike(r"\p{IsGreek}"), LETTERS["greek"]).when(c.rlike(r"\p{IsHan}"), LETTERS["han"]).otherwise(LETTERS["latin"])
            letter = F.substring(script, F.instr(F.lit(_HEX), hexit), F.lit(1))
            return F.when(c.rlike("[0-9]"), F.when(first, "7").otherwise(digit)).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

        before = F.char_length(F.regexp_replace(F.substring(m, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        return _let(F.substring(m, i, F.lit(1)), lambda c: _let(before, lambda n: of(c, n)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(m)), one), "")


def _octets(m: Column, d: Column, longer: Column) -> Column:
    def one(part: Column, i: Column) -> Column:
        n = F.conv(F.substring(d, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        size = F.when(longer, 3).otherwise(F.char_length(part))
        return F.when(size == 1, n % 9 + 1).when(size == 2, n % 90 + 10).otherwise(n % 155 + 100).cast("string")

    return F.array_join(F.transform(F.split(m, r"\."), one), ".")


def _name(part: Column, d: Column, kind: Column, more: Column) -> Column:
    def written(script: str) -> Column:
        consonants, vowels, female, male, other, surname = SCRIPTS[script]
        c, v = F.translate(d, _HEX, consonants), F.translate(d, _HEX, vowels)
        body = F.concat(*(x for i in (1, 4, 7) for x in (F.substring(c, i, 1), F.substring(v, i + 1, 1))), F.substring(c, 11, 1), F.translate(more, _HEX, consonants))
        end = F.when(kind == "given-f", female).when(kind == "given-m", male).when(kind == "given-x", other).otherwise(surname)
        return F.initcap(F.concat(body, end))

    return F.when(part.rlike(r"^\p{IsCyrillic}"), written("cyrillic")).when(part.rlike(r"^\p{IsGreek}"), written("greek")).otherwise(written("latin"))


def _name_words(m: Column) -> Column:
    """Array of (kind, value) arrays: the hyphenated parts of each word after the honorific."""
    words = F.split(F.regexp_replace(m, rf"^(?:{_HONORIFIC})\.? ", ""), " ")
    given = F.concat(F.lit("given-"), gender_of(m))

    def word(w: Column, i: Column, n: Column) -> Column:
        kind = F.when(w.rlike(rf"^(?:{_PARTICLES})$"), "particle").when(i + 1 < n, given).otherwise("surname")
        return F.transform(F.split(w, "-"), lambda p: F.struct(kind.alias("kind"), p.alias("value")))

    return _let(words, lambda all_: F.transform(all_, lambda w, i: word(w, i, F.size(all_))))


def parts_of(kind: Column, m: Column) -> Column:
    """Array of the entities in a match: the parts of a name and of an address count by themselves."""
    item = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    name = F.filter(F.flatten(_name_words(m)), lambda p: p["kind"] != "particle")
    address = F.array(item(F.lit("email"), F.lower(m)), item(F.lit("domain"), F.lower(F.substring_index(m, "@", -1))))
    return F.when(kind == "name", name).when(kind == "email", address).otherwise(F.array(item(kind, normal(kind, m))))


def gender_of(m: Column) -> Column:
    first = F.regexp_extract(m, rf"^({_HONORIFIC})", 1)
    return F.when(first.isin(*FEMALE), "f").when(first.isin(*MALE), "m").otherwise("x")


def _longer(d: Column, attempt: Column) -> Column:
    return F.when(attempt >= LONGER_AT, F.substring(d, F.lit(25), (attempt - LONGER_AT + 1) * 4)).otherwise("")


def name_replacement(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a name word."""
    return _let(digest(kind, value, attempt, key), lambda d: _name(value, d, kind, _longer(d, attempt)))


def replacement(kind: Column, value: Column, m: Column, attempt: Column, key: str) -> Column:
    """The surrogate of one entity but a name word (kind and normalised value), in the format of ``m``."""

    def of(d: Column) -> Column:
        more = _longer(d, attempt)
        letters, digits = F.translate(more, _HEX, LETTERS["latin"]), F.translate(more, "abcdef", "361709")
        code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .\-(])", 0)  # country code, kept
        tld = F.regexp_extract(value, r"\.(com|net|org)$", 1)
        head = F.regexp_extract(m, r"^(AKIA|ASIA|gh[pousr]_|sk-)", 0)
        hexits = F.substring(F.concat(d, d), F.lit(1), F.char_length(m))
        # what keeps its shape: what stands before, what is shaped, what is added
        kept = F.when(kind == "phone", code).when(kind == "secret", head).otherwise("")
        shaped = F.when(kind == "email", F.substring_index(value, "@", 1)).otherwise(F.substring(m, F.char_length(kept) + 1, F.char_length(m)))
        added = F.when(kind == "email", letters).when(kind.isin("phone", "card", "ssn", "iban"), digits).otherwise("")
        return (
            F.when(kind == "domain", F.concat(F.substring(F.translate(d, _HEX, LETTERS["latin"]), 1, 12), F.lit(".example."), F.when(tld == "", "com").otherwise(tld)))
            .when(kind == "ip", _octets(m, d, attempt >= LONGER_AT))
            .when((kind == "secret") & m.rlike(r"^[0-9a-f]+$"), hexits)
            .when((kind == "secret") & m.rlike(r"^[0-9A-F]+$"), F.upper(hexits))
            .otherwise(F.concat(kept, _let(shaped, lambda x: _shaped(x, d)), added))
        )

    return _let(digest(kind, value, attempt, key), of)


def canonical(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """A surrogate as its entity's normalised value would be written: what distinctness is about."""
    made = F.lower(F.when(kind.startswith("given-") | (kind == "surname"), name_replacement(kind, value, attempt, key)).otherwise(replacement(kind, value, value, attempt, key)))
    # domains are kept apart by themselves, so an address is told by its domain, and none is real
    return F.when(kind == "email", F.concat(made, F.lit("@\x01"), F.substring_index(value, "@", -1))).otherwise(made)


def entity_table(matches: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt, as_kind) of every distinct entity, all surrogates of a kind distinct; a
    given name after a title without gender is told as the person that it is.

    ``matches``: one array column ``matches``.
    """
    m = F.col("m")
    found = matches.select(F.explode("matches").alias("m")).groupBy("m").agg(F.lit(1).alias("_"))
    found = found.select(F.explode(_let(kind_of(m), lambda k: parts_of(k, m))).alias("e")).select("e.*").distinct()
    found = materialise(found, "pii-found")
    # names after a title without gender that the corpus has with one gender
    gendered = found.where("kind IN ('given-f', 'given-m')").groupBy("value").agg(F.max("kind").alias("as_kind"), F.count("*").alias("n")).where("n = 1").drop("n")
    found_as = gendered.join(found.where("kind = 'given-x'").select("value"), "value")
    found = found.join(found_as.select(F.lit("given-x").alias("kind"), "value"), ["kind", "value"], "left_anti")
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt")
    have = materialise(found.withColumn("attempt", F.lit(0)).withColumn("surrogate", canonical(kind, value, F.lit(0), key)), "pii-entities")
    real = have.select("kind", F.lower("value").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    while True:  # every attempt from LONGER_AT on has a larger space
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "value"))
        told = have.withColumn("place", place).join(real, ["kind", "surrogate"], "left").withColumn("bad", (F.col("place") > 1) | F.col("real").isNotNull())
        told = materialise(told.drop("place", "real"), "pii-attempt")
        if told.where("bad").isEmpty():
            own = told.select("kind", "value", "attempt", F.col("kind").alias("as_kind"))
            same = own.where("as_kind IN ('given-f', 'given-m')")
            return own.unionByName(same.join(found_as, ["as_kind", "value"]).select(F.lit("given-x").alias("kind"), "value", "attempt", "as_kind"))
        again = told.withColumn("attempt", F.when(F.col("bad"), attempt + 1).otherwise(attempt)).drop("bad")
        have = again.withColumn("surrogate", F.when(attempt > 0, canonical(kind, value, attempt, key)).otherwise(F.col("surrogate")))


def _name_part(p: Column, told: Column, key: str) -> Column:
    made = _let(told, lambda t: name_replacement(F.coalesce(F.substring_index(t, "/", -1), p["kind"]), p["value"], _attempt(t), key))
    return F.when(p["kind"] == "particle", p["value"]).otherwise(made)


def _attempt(told: Column) -> Column:
    return F.coalesce(F.substring_index(told, "/", 1).cast("int"), F.lit(0))


def _written(kind: Column, m: Column, told_of, key: str) -> Column:
    """The surrogate text of a match."""
    made = F.transform(parts_of(kind, m), lambda p: replacement(p["kind"], p["value"], F.when(kind == "email", p["value"]).otherwise(m), _attempt(told_of(p)), key))
    title = F.regexp_extract(m, rf"^(?:{_HONORIFIC})\.? ", 0)
    words = F.transform(_name_words(m), lambda w: F.array_join(F.transform(w, lambda p: _name_part(p, told_of(p), key)), "-"))
    whole = _let(F.array_join(made, "@"), lambda x: F.when((kind == "email") & (F.upper(m) == m), F.upper(x)).otherwise(x))
    return F.when(kind == "name", F.concat(title, F.array_join(words, " "))).otherwise(whole)


def _mentioned(matches: Column, told_of, key: str) -> Column:
    """(value, surrogate) of the name words by which a document's persons may be mentioned again, the
    first way of a word for all. Words of one letter are left alone."""
    names = F.flatten(F.transform(F.filter(matches, lambda m: m.rlike(_TITLED)), lambda m: F.flatten(_name_words(m))))
    long = F.filter(names, lambda p: (F.char_length(p["value"]) > 1) & (p["kind"] != "particle"))
    said = F.transform(long, lambda p: F.struct(p["value"].alias("value"), _name_part(p, told_of(p), key).alias("surrogate")))
    return F.filter(F.array_distinct(said), lambda x: x["value"].isNotNull())


def _without_mentions(rest: Column, mentioned: Column) -> Column:
    one = lambda t, x: F.regexp_replace(t, F.concat(F.lit(_NOT_AFTER + r"\Q"), x["value"], F.lit(r"\E" + _NOT_BEFORE)), x["surrogate"])
    return F.transform(rest, lambda t: F.aggregate(mentioned, t, one))


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten and entities: array of (kind, surrogate)."""
    docs, named_back = shielded(docs, ("_matches", "_told", "_mentioned", "_rid"))
    t = F.col(f"`{text}`").cast("string")
    none = F.array().cast("array<string>")
    matches = F.when(t.rlike(SIGNS), F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))).otherwise(none)
    table_ = entity_table(docs.select(matches.alias("matches")).where(F.size("matches") > 0), key)
    told = F.concat_ws("/", F.col("attempt").cast("string"), "as_kind")
    exceptions = materialise(table_.where("attempt > 0 OR kind <> as_kind").select(F.concat_ws(":", "kind", "value").alias("entity"), told.alias("told")), "pii-exceptions")
    n = exceptions.count()
    rows = docs.select(*[f"`{c}`" for c in without(docs, ["entities"])]).withColumn("_matches", matches)
    entity = lambda p: F.concat_ws(":", p["kind"], p["value"])
    if n <= MAP_ENTRIES:
        known = {r.entity: r.told for r in exceptions.collect()}  # at most MAP_ENTRIES
        table_map = F.from_json(F.lit(json.dumps(known)), "map<string,string>") if known else None
        told_of = lambda p: F.lit(None).cast("string") if table_map is None else F.element_at(table_map, entity(p))
    else:
        rows = _join_told(rows, exceptions)
        told_of = lambda p: F.element_at(F.col("_told"), entity(p))
    written = F.transform("_matches", lambda m: _let(kind_of(m), lambda kind: F.struct(kind.alias("kind"), _written(kind, m, told_of, key).alias("surrogate"))))
    rows = rows.withColumn("entities", F.when(F.size("_matches") > 0, written).otherwise(F.array().cast("array<struct<kind:string,surrogate:string>>")))
    named = F.exists("_matches", lambda m: m.rlike(_TITLED))
    rows = rows.withColumn("_mentioned", F.when(named, _mentioned(F.col("_matches"), told_of, key)))
    rest = F.split(t, ENTITY, -1)
    rest = F.when(F.col("_mentioned").isNotNull(), _without_mentions(rest, F.col("_mentioned"))).otherwise(rest)
    joined = F.array_join(F.zip_with(rest, F.col("entities"), lambda a, e: F.concat(a, F.coalesce(e["surrogate"], F.lit("")))), "")
    rows = rows.withColumn(text, F.when(F.size("_matches") > 0, joined).otherwise(F.col(f"`{text}`")))
    return named_back(rows.drop("_matches", "_told", "_mentioned"))


def _join_told(rows: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Many exceptions: each row with such entities gets what is told of its own."""
    rows = materialise(rows.withColumn("_rid", F.monotonically_increasing_id()), "pii-rows")
    m = F.col("m")
    own = rows.select("_rid", F.explode("_matches").alias("m")).select("_rid", F.explode(_let(kind_of(m), lambda k: parts_of(k, m))).alias("e")).select("_rid", F.concat_ws(":", "e.kind", "e.value").alias("entity")).distinct()
    maps = own.join(exceptions, "entity").groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct("entity", "told"))).alias("_told"))
    return rows.join(maps, "_rid", "left").drop("_rid")


def rewrite_documents(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its own columns: text rewritten and n_chars, where there is one, counted again."""
    docs, named_back = shielded(docs, ("entities",))
    out = replace_entities(docs, key).select(*[f"`{c}`" for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return named_back(out)


def session_key(spark: SparkSession) -> str:
    """The key that the session sets. One that sets none gets a key of its own, which nobody else can know:
    its surrogates agree within the session, and with no other one."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")
