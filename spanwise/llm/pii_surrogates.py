"""Surrogates for personal data, in DataFrame operations only.

Entities are found by one pattern. An entity is its kind and its core: what is the same
however it is written (the digits of a phone number, a lower-case address). The surrogate of
a core follows from a key: characters are replaced one by one by others of the same sort and
script, within what the kind allows, so length, punctuation and case stay; a name keeps its
title and gets a first name of the same gender and script. After a title that tells no gender, the
first name does (a known one, or else by its last letter), so a name is the same person under
either title; letters of other scripts become Latin ones. The same core gets the same
surrogate in all documents, and e-mail addresses of one domain keep sharing one.

Surrogates are checked over all distinct cores: where two cores got the same one, or one is
a core that occurs, all but the least core try again under the next attempt, until no
collision is left. From attempt `WIDEN` on, where a kind has hardly any free surrogates, each core
still left gets a number of its own, written behind the surrogate; so the attempts end. First attempts are computed in place from the key, so only documents with
a core of a later attempt, which are few, take part in a join; texts do not move otherwise.

Results for odd input. Null text stays null, without entities; text without entities stays
as it is. Repeated rows get equal results. Rows with a null id are treated like any other.
An empty table gives an empty result. Overlapping matches go to the first, and at one place
to the kind named first. Other columns are kept by `replace_entities`, which adds
`n_entities` and `entities` (kind and surrogate in order); columns of these names give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize, table

#: Titles, by the gender that they tell.
MALE = ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Don", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof"]
#: First names by gender and script.
FIRST = {
    ("m", "latin"): ["Adrian", "Bruno", "Carl", "Dario", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Karim", "Lukas", "Martin", "Nils", "Oscar", "Pablo"],
    ("f", "latin"): ["Alma", "Bianca", "Clara", "Dora", "Elena", "Frida", "Greta", "Hanna", "Ines", "Julia", "Klara", "Laura", "Marta", "Nora", "Olga", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Илья"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Нина"],
    ("m", "greek"): ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος", "Φίλιππος"],
    ("f", "greek"): ["Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"],
}
#: Letters that stand for each other, by code points: plain and marked ones of Latin, Cyrillic and Greek, and Armenian.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
ALPHABETS += ["".join(c for c in map(chr, range(first, last)) if c.islower() and c.upper().lower() == c and len(c.upper()) == 1) for first, last in ((0xDF, 0x180), (0x450, 0x530), (0x3AC, 0x3CF), (0x561, 0x587))]
ALPHABETS += ["йъыь"]
#: The first attempt that writes a number behind the surrogate.
WIDEN = 5

_EDGE, _STOP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.?"
#: Phone numbers: three groups of 3, 3 and 4; after a country's code; after a trunk 0, 9 to 12 digits that are no date.
_PHONES = [
    r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}",
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ ./-]?\d){5,11}",
    r"(?!\d\d[ ./-]\d\d[ ./-](?:19|20)\d\d(?!\d))(?:0\d[ ./-](?:[ ./-]?\d){7,9}|0\d\d[ ./-](?:[ ./-]?\d){6,8}|0\d{3,4}[ ./-](?:[ ./-]?\d){5,7})",
    r"\(0\d{1,4}\)[ ./-]?\d(?:[ ./-]?\d){4,8}",
]
#: Kinds by precedence.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}" + _STOP,
    "key": _EDGE + r"AKIA[0-9A-Z]{16}" + _STOP,
    "hash": _EDGE + r"[0-9a-fA-F]{40}" + _STOP,
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _STOP,
    "card": _EDGE + r"\d{4}(?:[ -]?\d{4}){3}" + _STOP,
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}" + _STOP,
    "phone": r"(?<![\p{L}\p{N}+])(?:" + "|".join(p + _STOP for p in _PHONES) + ")",
    "ip": r"(?<![\p{L}\p{N}.])" + rf"{_OCTET}(?:\.{_OCTET}){{3}}" + r"(?![\p{L}\p{N}]|\.\d)",
    "name": _EDGE + _TITLE + r"(?: \p{Lu}[\p{L}'-]{1,30}){1,3}" + _STOP,
}
#: No kind starts otherwise, so the alternatives are tried at few places.
PATTERN = r"(?=[\p{L}\p{N}._%+(-])(?:" + "|".join(KINDS.values()) + ")"
#: Some character or word that every entity has.
HINT = r"[@0-9]|AKIA|" + "|".join(MALE + FEMALE + NEUTRAL)


def kind_of(match: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(match.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def _gender(match: Column) -> Column:
    """Of the title, else of the first name."""
    starts = lambda titles: match.rlike("^(?:" + "|".join(titles) + r")[. ]")
    first = F.lower(F.regexp_extract(match, rf"^{_TITLE} ([^ ]+)", 1))
    known = {g: [n.lower() for (of, _), names in FIRST.items() if of == g for n in names] for g in "mf"}
    by_name = F.when(first.isin(known["f"]), "f").when(first.isin(known["m"]), "m").when(first.rlike("[aàáâαάая]$"), "f").otherwise("m")
    return F.when(starts(FEMALE), "f").when(starts(MALE), "m").otherwise(by_name)


def core_of(match: Column, kind: Column) -> Column:
    """What is the same however the entity is written."""
    digits = F.regexp_replace(match, r"[^0-9]", "")
    named = F.concat(_gender(match), F.lit("|"), F.lower(F.regexp_replace(match, rf"^{_TITLE} ", "")))
    return (
        F.when(kind == "phone", F.right(digits, F.lit(10)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.lower(F.replace(match, F.lit(" "), F.lit(""))))
        .when(kind == "name", named)
        .otherwise(F.lower(match))
    )


def _pick(seed: Column, at: Column | int, n: int | Column) -> Column:
    """A number below n that follows from the seed and a place."""
    return F.pmod(F.xxhash64(seed, F.lit(at) if isinstance(at, int) else at), F.lit(n) if isinstance(n, int) else n)


def _letter(c: Column, v: Column, alphabets: list[str]) -> Column:
    """A letter of the same script; of scripts without an alphabet here, a Latin one."""
    every, begin = "".join(alphabets), [sum(map(len, alphabets[:k])) for k in range(len(alphabets))]
    table = lambda values: F.array(*(F.lit(x) for k, letters in enumerate(alphabets) for x in [values[k]] * len(letters)))
    at = F.instr(F.lit(every), c)
    own = F.pmod(v, F.element_at(table([len(x) for x in alphabets]), at)) + F.element_at(table(begin), at)
    return F.when(at > 0, F.substr(F.lit(every), (own + 1).cast("int"), F.lit(1))).when(c.rlike(r"\p{L}"), F.substr(F.lit(every), (F.pmod(v, F.lit(len(alphabets[0]))) + 1).cast("int"), F.lit(1))).otherwise(c)


def _joined(n: Column, make) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), make), "")


def _luhn(digits: Column, last: bool) -> Column:
    """Sum of the digits with every other doubled; last: the check digit is among them."""
    value = lambda i: F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    doubled = lambda i: (i % 2 == (0 if last else 1))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(doubled(i), (value(i) * 2) % 10 + F.floor(value(i) / 5).cast("int")).otherwise(value(i)))


def surrogate(kind: Column, core: Column, attempt: Column, key: str) -> Column:
    """The replacement of a core under the key."""
    sep = F.lit("\x01")
    seed = F.sha2(F.concat(F.lit(key), sep, kind, sep, core, sep, attempt.cast("string")), 256)
    n = F.length(core)
    char = lambda i: F.substr(core, i, F.lit(1))
    digit = lambda v: F.pmod(v, F.lit(10)).cast("string")
    any_of = lambda c, v: F.when(c.between("0", "9"), digit(v)).otherwise(_letter(c, v, ALPHABETS))
    v = lambda i: F.xxhash64(seed, i)

    domain = F.substring_index(core, "@", -1)
    shared = F.sha2(F.concat(F.lit(key), sep, F.lit("domain"), sep, domain), 256)
    top = n - F.length(F.substring_index(core, ".", -1))
    email = _joined(n, lambda i: F.when(i > top, char(i)).when(i > n - F.length(domain), any_of(char(i), F.xxhash64(shared, i - n))).otherwise(any_of(char(i), v(i))))
    hashed = _joined(n, lambda i: F.substr(F.lit("0123456789abcdef"), (F.pmod(v(i), F.lit(16)) + 1).cast("int"), F.lit(1)))
    phone = _joined(n, lambda i: F.when((n == 10) & i.isin(1, 4), (F.pmod(v(i), F.lit(8)) + 2).cast("string")).otherwise(digit(v(i))))
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.pmod(v(i), F.lit(254)) + 1).cast("string")), ".")
    body = _joined(n - 1, lambda i: F.when(i == 1, char(i)).otherwise(digit(v(i))))
    check = F.pmod(-_luhn(body, False), F.lit(10))
    valid = _luhn(core, True) % 10 == 0
    card = F.concat(body, F.when(valid, check).otherwise((check + 1 + _pick(seed, 99, 9)) % 10).cast("string"))
    kept = lambda first: _joined(n, lambda i: F.when(i <= first, char(i)).otherwise(any_of(char(i), v(i))))

    words = F.split(F.substr(core, F.lit(3)), " ")
    script = F.when(core.rlike(r"\p{IsCyrillic}"), "cyrillic").when(core.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.substr(core, F.lit(1), F.lit(1))
    first = F.lit("")
    for (g, s), names in FIRST.items():
        first = F.when((gender == g) & (script == s), F.element_at(F.array(*map(F.lit, names)), (_pick(seed, 97, len(names)) + 1).cast("int"))).otherwise(first)
    rest = F.transform(words, lambda w, k: F.initcap(_joined(F.length(w), lambda i: _letter(F.substr(w, i, F.lit(1)), F.xxhash64(seed, k, i), ALPHABETS))))
    name = F.when(F.size(words) > 1, F.array_join(F.concat(F.array(first), F.slice(rest, 2, 3)), " ")).otherwise(rest[0])
    made = (
        F.when(kind == "email", email)
        .when(kind == "hash", hashed)
        .when(kind == "phone", phone)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "key", kept(F.lit(4)))
        .when(kind == "iban", kept(F.lit(2)))
        .when(kind == "name", name)
        .otherwise(_joined(n, lambda i: digit(v(i))))
    )
    number = (attempt - WIDEN).cast("string")
    mark = F.when(kind.isin("email", "name"), F.translate(number, "0123456789", "abcdefghij")).when(kind == "ip", F.concat(F.lit("."), number)).otherwise(number)
    return F.when(attempt >= WIDEN, F.concat(made, mark)).otherwise(made)


def written_like(match: Column, kind: Column, core: Column, new: Column) -> Column:
    """The surrogate in the format of the match: its punctuation, spaces and capitals."""
    upper = lambda c, s: F.when((F.upper(c) == c) & (F.lower(c) != c), F.upper(s)).otherwise(s)
    spaced = kind.isin("phone", "card", "ssn", "iban")
    squeezed = lambda s: F.length(F.regexp_replace(s, r"[^0-9A-Za-z]", ""))
    extra = F.when(spaced, squeezed(match) - F.length(core)).otherwise(0)

    def char(i: Column) -> Column:
        c = F.substr(match, i, F.lit(1))
        at = F.when(spaced, squeezed(F.substr(match, F.lit(1), i))).otherwise(i) - extra
        return F.when(spaced & ~c.rlike("[0-9A-Za-z]") | (at < 1), c).otherwise(upper(c, F.substr(new, at, F.lit(1))))

    title = F.regexp_extract(match, rf"^{_TITLE} ", 0)
    rest = F.substr(match, F.length(title) + 1)
    named = F.concat(title, F.when((F.upper(rest) == rest) & (F.length(rest) > 2), F.upper(new)).otherwise(new))
    capital = (kind == "hash") & match.rlike("[A-F]") & (F.upper(match) == match)
    more = F.substr(new, F.length(core) + 1)
    return F.when(kind == "ip", new).when(kind == "name", named).when(capital, F.upper(new)).otherwise(F.concat(_joined(F.length(match), char), more))


def _matches(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Kind and core of every entity, and a hash of the text that has it."""
    text = F.col(text_col)
    found = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("text_hash"), F.explode(_matches(text)).alias("match"))
    found = found.withColumn("kind", kind_of(F.col("match")))
    return found.select("text_hash", "kind", core_of(F.col("match"), F.col("kind")).alias("core"))


def later_attempts(found: DataFrame, key: str) -> DataFrame:
    """The cores whose first surrogate collides, with the attempt that does not."""
    cores = materialize(found.select("kind", "core").distinct(), "cores")
    make = lambda df: df.withColumn("new", surrogate(F.col("kind"), F.col("core"), F.col("attempt"), key))
    now = make(cores.withColumn("attempt", F.lit(0)))
    # surrogates and cores in one form: lower-case, and a name without the mark of its gender
    written = F.when(F.col("kind") == "name", F.regexp_replace("core", r"^[mfn]\|", "")).otherwise(F.col("core"))
    taken = materialize(cores.select("kind", F.lower(written).alias("form"), F.lit(True).alias("real")).distinct(), "taken")
    while True:
        order = F.row_number().over(W.partitionBy("kind", "form").orderBy("attempt", "core"))
        now = materialize(now.withColumn("form", F.lower("new")).withColumn("nth", order).join(taken, ["kind", "form"], "left").withColumn("clash", (F.col("nth") > 1) | F.col("real").isNotNull()).drop("nth", "real", "form"), "surrogates")
        if now.where("clash").isEmpty():
            return now.where("attempt > 0").select("kind", "core", "attempt")
        # from WIDEN on, cores that share a surrogate get different numbers, above all that were given before
        left, given = now.where("clash"), now.agg(F.max("attempt")).first()[0]
        if given + 1 < WIDEN:
            again = make(left.select("kind", "core", (F.col("attempt") + 1).alias("attempt")))
        else:
            numbered = left.select("kind", "core", F.row_number().over(W.partitionBy("kind", "new").orderBy("core")).alias("nth"))
            again = make(numbered.select("kind", "core", (F.col("nth") + max(given, WIDEN - 1)).cast("int").alias("attempt")))
        now = now.where("not clash").drop("clash").unionByName(again)


def replace_entities(docs: DataFrame, key: str = "surrogates", text_col: str = "text") -> DataFrame:
    """`docs` with surrogates in the text, and n_entities and entities."""
    found = materialize(entities(docs, text_col), "entities")
    later = later_attempts(found, key)
    names = [c for c in docs.columns if c not in ("n_entities", "entities")]
    rows = docs.select(F.struct(*(F.col(c) for c in names)).alias("row"))
    text = F.col("row")[text_col]
    if later.isEmpty():
        rows = rows.withColumn("attempts", F.lit(None).cast("map<string,int>"))
    else:
        held = found.join(later, ["kind", "core"]).groupBy("text_hash").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "core"), "attempt"))).alias("attempts"))
        rows = rows.join(held, F.xxhash64(text) == F.col("text_hash"), "left").drop("text_hash")
    rows = rows.withColumn("matches", _matches(F.coalesce(text, F.lit(""))))

    def entity(m: Column) -> Column:
        return F.struct(m.alias("match"), kind_of(m).alias("kind"), core_of(m, kind_of(m)).alias("core"))

    def renewed(e: Column) -> Column:
        attempt = F.coalesce(F.try_element_at("attempts", F.concat_ws("|", e["kind"], e["core"])), F.lit(0))
        return F.struct(e["kind"].alias("kind"), written_like(e["match"], e["kind"], e["core"], surrogate(e["kind"], e["core"], attempt, key)).alias("surrogate"))

    rows = rows.withColumn("entities", F.transform(F.transform("matches", entity), renewed))
    parts = F.zip_with(F.split(text, PATTERN, -1), F.concat(F.transform("entities", lambda e: e["surrogate"]), F.array(F.lit(""))), lambda p, s: F.concat(p, s))
    new_text = F.when(F.size("matches") > 0, F.array_join(parts, "")).otherwise(text)
    kept = [(new_text if c == text_col else F.col("row")[c]).alias(c) for c in names]
    return rows.select(*kept, F.size("matches").alias("n_entities"), "entities")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
