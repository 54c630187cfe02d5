r"""Surrogates for personal data (DataFrame and SQL functions only).

Entities are found by pattern, brought to a canonical form (so that one entity written
in two ways stays one), and given a surrogate derived from a key and that form: the same
type, the same format (digit groups, case, country and trunk prefixes, check digit), the
same script and, for titled names, the same gender. Surrogates of different entities are
compared over the whole corpus, and with the entities themselves; a collision derives
the next surrogate until all are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import written
from trailweave.llm.sieve import maybe, sieve
from trailweave.operators.layout import hub_join

#: Titles by gender, names by script and gender.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "госпожа", "г-жа", "κυρία")
MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος")
NEUTRAL = ("Dr", "Prof")
NAMES = {
    ("latin", "f"): ("Alda", "Berta", "Carla", "Dora", "Elena", "Flora", "Greta", "Helga", "Irma", "Julia", "Klara", "Lotte", "Maria", "Nora", "Olga", "Paula"),
    ("latin", "m"): ("Albert", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Karl", "Leo", "Marco", "Niklas", "Oskar", "Paul"),
    ("latin", "s"): ("Abel", "Bauer", "Costa", "Dahl", "Engel", "Fabre", "Garcia", "Hansen", "Ibarra", "Jensen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Perez", "Quinn", "Roth", "Silva", "Torres"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Максим", "Олег", "Юрий"),
    ("cyrillic", "s"): ("Беленко", "Воронюк", "Гончар", "Дяченко", "Коваль", "Литвин", "Мельник", "Шевчук"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ιωάννα", "Μαρία", "Σοφία", "Χρυσή"),
    ("greek", "m"): ("Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"),
    ("greek", "s"): ("Βλάχου", "Γαλάνη", "Δούκα", "Μακρή", "Παππά", "Ρήγα"),
}
#: Attempts after which a format has no values left. With half of them free, an entity gets
#: this far with a probability of 2 ** -ATTEMPTS.
ATTEMPTS = 128
_TITLE = "|".join(sorted((*FEMALE, *MALE, *NEUTRAL), key=len, reverse=True))

#: Type -> pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "card": r"(?<![\p{L}\p{N}.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\p{L}\p{N}-])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "person": rf"(?<![\p{{L}}\p{{N}}-])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity holds one of these; the costly pattern is not tried on a text without them.
HINT = rf"@|\d\d|\d\.\d\.\d\.\d|(?:{_TITLE})\.? \p{{Lu}}"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(text: Column) -> Column:
    """All entities of a text in order, as written; none for null."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(e: Column) -> Column:
    out = F.lit("person")
    for name in reversed([n for n in PATTERNS if n != "person"]):
        out = F.when(e.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def canonical(type_: Column, e: Column) -> Column:
    """The form that all spellings of one entity share."""
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(type_ == "email", F.lower(e))
        .when(type_ == "ip", e)
        .when(type_ == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .when(type_ == "person", F.concat_ws("|", _gender(e), F.lower(F.regexp_extract(e, rf"^(?:{_TITLE})\.? (.*)$", 1))))
        .otherwise(digits)
    )


def _gender(e: Column) -> Column:
    m, f = "|".join(MALE), "|".join(FEMALE)
    return F.when(e.rlike(rf"^(?:{f})\.? "), F.lit("f")).when(e.rlike(rf"^(?:{m})\.? "), F.lit("m")).otherwise(F.lit("n"))


def surrogate(key: str) -> tuple[Column, Column]:
    """Canonical surrogate of (type, canon, attempt), and the keyed digest ``_h`` that it reads.
    Formats are applied later."""
    h = F.sha2(F.concat_ws("|", F.lit(key), "type", "canon", F.col("attempt").cast("string")), 256)
    return F.expr(
        f"""CASE type
WHEN 'email' THEN {_mail()}
WHEN 'iban' THEN {_iban()}
WHEN 'ip' THEN array_join(transform(sequence(1, 4), i -> cast(1 + pmod(xxhash64(_h, i), 254) AS string)), '.')
WHEN 'person' THEN {_person()}
WHEN 'card' THEN {_checked()}
ELSE concat(substr(canon, 1, greatest(length(canon) - 10, 0)), {_spell("right(canon, 10)", "any")}) END"""
    ), h


def _spell(s: str, case: str) -> str:
    """Letters become letters of the same script (vowels stay vowels), digits digits; an
    e-mail's top domain and all other characters stay."""
    keep = "i >= length(canon) - length(substring_index(canon, '.', -1))" if case == "lower" else "false"
    pools = (("[aeiouàáâãäåèéêëìíîïòóôõöùúûü]", "aeiou"), ("[\\\\p{IsLatin}&&[^A-Z]]", "bcdfghjklmnpqrstvwxz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[0-9]", "0123456789"), ("\\\\p{IsCyrillic}", "абвгдежзиклмнопрстуф"), ("\\\\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφ"))
    cases = " ".join(f"WHEN c RLIKE '^{p}$' THEN substr('{pool}', cast(1 + pmod(xxhash64(_h, i), {len(pool)}) AS int), 1)" for p, pool in pools)
    return f"array_join(transform(split({s}, ''), (c, i) -> CASE WHEN {keep} THEN c {cases} ELSE c END), '')"


def _mail() -> str:
    """Every third attempt adds a letter before the @, without end."""
    more = "array_join(transform(sequence(1, 1 + cast(attempt div 3 AS int)), i -> CASE WHEN i = 1 THEN '' ELSE substr('bcdfghjklmnpqrstvwxz', cast(1 + pmod(xxhash64(_h, i), 20) AS int), 1) END), '')"
    return f"replace({_spell('canon', 'lower')}, '@', concat({more}, '@'))"


def _iban() -> str:
    """The country stays; the check digits are right if they were, and wrong if they were not."""

    def rest(s: str) -> str:  # of the number that the letters (A is 10) and digits spell
        return f"aggregate(split({s}, ''), 0, (a, c) -> cast(pmod(CASE WHEN c RLIKE '^[0-9]$' THEN a * 10 + cast(c AS int) ELSE a * 100 + ascii(c) - 55 END, 97) AS int))"

    country, right = "substr(canon, 1, 2)", rest("concat(substr(canon, 5), substr(canon, 1, 4))") + " = 1"
    check = f"98 - {rest('concat(b, ' + country + ', ' + chr(39) + '00' + chr(39) + ')')}"
    shown = f"CASE WHEN {right} THEN {check} ELSE pmod({check} + 1 + pmod(xxhash64(_h, 0), 96), 97) END"
    return f"element_at(transform(array({_spell('substr(canon, 5)', 'any')}), b -> concat({country}, lpad(cast({shown} AS string), 2, '0'), b)), 1)"


def _checked() -> str:
    """A number of the same length and first digit whose last digit keeps the Luhn check as
    it was: right numbers stay right, wrong ones wrong."""

    def luhn(s: str) -> str:
        return (
            f"pmod(aggregate(sequence(1, length({s})), 0L, (a, k) -> a + CASE WHEN pmod(length({s}) - k, 2) = 0 THEN cast(substr({s}, k, 1) AS int) "
            f"ELSE pmod(2 * cast(substr({s}, k, 1) AS int), 10) + (2 * cast(substr({s}, k, 1) AS int)) div 10 END), 10)"
        )

    body = "concat(substr(canon, 1, 1), array_join(transform(sequence(2, length(canon) - 1), i -> cast(pmod(xxhash64(_h, i), 10) AS string)), ''))"
    last = f"pmod(10 - {luhn('b0')}, 10)"
    off = "CASE WHEN " + luhn("canon") + " = 0 THEN 0 ELSE 1 + pmod(xxhash64(_h, 0), 9) END"
    return f"element_at(transform(array({body}), b -> concat(b, cast(pmod({last.replace('b0', 'concat(b, ' + chr(39) + '0' + chr(39) + ')')} + {off}, 10) AS string))), 1)"


def _person() -> str:
    """gender|name in the script and with the number of words of the original; every third
    attempt adds a surname, without end, so no number of names exhausts the pools."""

    def pick(pool: tuple[str, ...], salt: str) -> str:
        return "element_at(array(" + ", ".join(_quoted(n.lower()) for n in pool) + f"), cast(1 + pmod(xxhash64(_h, {salt}), {len(pool)}) AS int))"

    def full(script: str) -> str:
        s = NAMES[script, "s"]
        given = f"CASE WHEN substr(canon, 1, 1) = 'f' THEN {pick(NAMES[script, 'f'], '1')} WHEN substr(canon, 1, 1) = 'm' THEN {pick(NAMES[script, 'm'], '1')} ELSE {pick(NAMES[script, 'f'] + NAMES[script, 'm'], '1')} END"
        sur = f"array_join(transform(sequence(2, 2 + cast(attempt div 3 AS int)), i -> {pick(s, 'i')}), '-')"
        return f"concat(substr(canon, 1, 2), CASE WHEN instr(canon, ' ') > 0 THEN concat({given}, ' ', {sur}) ELSE {sur} END)"

    return f"CASE WHEN canon RLIKE '\\\\p{{IsCyrillic}}' THEN {full('cyrillic')} WHEN canon RLIKE '\\\\p{{IsGreek}}' THEN {full('greek')} ELSE {full('latin')} END"


def assign(entities: DataFrame, key: str) -> DataFrame:
    """A distinct surrogate for each distinct (type, canon): type, canon, s.

    An attempt that gives two entities one surrogate leaves it with the least of them; the
    others, and entities whose surrogate is a real entity, try again. Names and e-mails grow
    with the attempts, so there are always more of them. The other types keep their length:
    a corpus that holds nearly all values of a format has no surrogates left, and that is a
    ValueError after ATTEMPTS attempts.
    """
    value, digest = surrogate(key)

    def tried(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_h", digest).withColumn("s", value).select("type", "canon", "attempt", "s")

    names = written(entities.select("type", "canon").distinct(), "pii-names")
    real = names.select("type", F.col("canon").alias("s"), F.lit(True).alias("taken"))
    state = written(tried(names.withColumn("attempt", F.lit(0))), "pii-state")
    for _ in range(ATTEMPTS):
        first = state.groupBy("type", "s").agg(F.min(F.struct("attempt", "canon")).alias("f"))
        judged = state.join(first, ["type", "s"]).join(real, ["type", "s"], "left")
        judged = judged.select("type", "canon", "attempt", "s", ((F.col("f.canon") != F.col("canon")) | F.col("taken").isNotNull()).alias("clash"))
        judged = written(judged, "pii-judged")
        if judged.filter("clash").isEmpty():
            return judged.select("type", "canon", "s")
        again = tried(judged.filter("clash").withColumn("attempt", F.col("attempt") + 1).drop("s", "clash"))
        state = written(judged.filter("NOT clash").drop("clash").unionByName(again), "pii-state")
    raise ValueError("a format has fewer values than the corpus needs surrogates")


def render(type_: Column, e: Column, s: Column) -> Column:
    """The canonical surrogate ``s`` in the format in which the entity is written."""
    filled = F.expr(
        "array_join(transform(split(e, ''), (c, i) -> CASE WHEN c RLIKE '[A-Za-z0-9]' "
        "THEN substr(s, length(regexp_replace(substr(e, 1, i), '[^A-Za-z0-9]', '')) + 1, 1) ELSE c END), '')"
    )
    name = F.initcap(F.regexp_replace(F.substring(s, 3, 2**31 - 1), "-", " - "))
    name = F.regexp_replace(name, " - ", "-")
    title = F.regexp_extract(e, rf"^((?:{_TITLE})\.? )", 1)
    return (
        F.when(type_ == "email", F.when(e == F.upper(e), F.upper(s)).otherwise(s))
        .when(type_ == "ip", s)
        .when(type_ == "person", F.concat(title, F.when(e == F.upper(e), F.upper(name)).otherwise(name)))
        .otherwise(filled)
    )


def anonymise(docs: DataFrame, key: str = "trailweave") -> DataFrame:
    """All rows of (doc_id, text): doc_id, n_entities, types (of each entity, in order), text
    with every entity replaced.

    The same entity has the same surrogate everywhere, different ones have different ones,
    and no surrogate is an entity of the corpus. Null texts stay null and have none; empty
    and entity-free texts stay as they are; repeated rows stay; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    seen = rows.withColumn("ents", found(F.col("text"))).filter(F.size("ents") > 0)
    # A row is known by its id and the hash of its text; rows equal in both get the same text.
    seen = written(seen.select("doc_id", "mark", "ents", F.split("text", ANY, -1).alias("parts")), "pii-found")
    each = seen.select("doc_id", "mark", F.posexplode("ents").alias("pos", "e")).withColumn("type", kind(F.col("e")))
    each = written(each.withColumn("canon", canonical(F.col("type"), F.col("e"))).withColumn("entity", F.concat_ws("|", "type", "canon")), "pii-each")
    map_ = assign(each, key).select(F.concat_ws("|", "type", "canon").alias("entity"), "s")
    new = hub_join(each, "entity", map_).select("doc_id", "mark", F.struct("pos", "type", render(F.col("type"), F.col("e"), F.col("s")).alias("v")).alias("x"))
    new = new.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("x")).alias("new"))
    put = F.zip_with("parts", F.transform("new", lambda x: x["v"]), lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    back = seen.join(new, seen["doc_id"].eqNullSafe(new["doc_id"]) & (seen["mark"] == new["mark"]))
    changed = back.select(seen["doc_id"], F.size("ents").alias("n_entities"), F.transform("new", lambda x: x["type"]).alias("types"), F.array_join(put, "").alias("text"))
    # The pattern is tried again only on texts that the sieve takes for one of those above.
    rows = maybe(rows.withColumn("k", F.xxhash64("doc_id", "mark")), sieve(seen.select(F.xxhash64("doc_id", "mark").alias("k"))), "hit")
    same = rows.filter(F.when(F.col("hit"), F.coalesce(F.size(found(F.col("text"))), F.lit(0)) <= 0).otherwise(F.lit(True)))
    return same.select("doc_id", F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("types"), "text").unionByName(changed)
