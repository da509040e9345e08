"""Surrogates for personal data.

Entities are detected by pattern, brought into a canonical form, and every distinct one
gets a keyed surrogate of its own kind: letters stay letters and digits digits, an
address keeps its shape, a card its first digit and checksum, an IBAN its country and
checksum, a phone its country code, a name its gender and script. One entity has one surrogate in all documents, however it is written
(coreference); two entities never share one, and no surrogate is an entity that occurs
in the corpus: claims that collide are drawn again until every entity has its own.

A name is detected by its title; the words of a name so detected are replaced at every other
place of the same document too, with or without the title.

Everything is DataFrame operations. Only documents that hold entities are shuffled;
distinct mentions are gathered first, so a mention in a third of all documents is one row
of the surrogate table.

Secrets, addresses, keys and IBANs start at a word's border; phones, cards, SSNs and IPs also
directly behind a letter, and names behind a digit. Given names of one document that differ in gender
only get one surrogate where the title is missing.

Defined cases: a null text stays null with no entities; texts without entities are
returned as they are, whatever their length; repeated rows are treated alike; an empty table gives an empty
result; other columns of the documents, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icx.llm.common import written

KEY = "icx surrogate key"

TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "г-н", "κ.")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "г-жа", "κα")

#: kind -> pattern; where two kinds fit, the earlier wins. None needs to look far back.
PATTERNS = {
    "secret": r"""(?:[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)\s{0,2}[=:]\s{0,2}["']?[^\s"']{6,256}""",
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "key": r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})\b",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9.,/+-])0[1-9][0-9]{1,3}[ /-][0-9]{6,8}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9])(?!\.[0-9])",
    "person": r"(?<!\p{L})(?:" + "|".join(t.replace(".", r"\.") for t in TITLES_M + TITLES_F) + r")\.? \p{Lu}\p{Ll}{1,30}(?:[ -]\p{Lu}\p{Ll}{1,30})?(?!\p{L})",
}
#: Kinds that start where no letter or digit of ASCII stands before; the others look back for themselves.
BORDERED = ("secret", "email", "key", "iban")
#: A first look at one character spares the patterns at most places.
LOOKS = ("(?<![A-Za-z0-9])", "(?=[0-9(+])", "(?=[" + "".join(sorted({t[0] for t in TITLES_M + TITLES_F})) + "])")
ANY = "|".join(
    f"{look}(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in kinds) + ")"
    for look, kinds in zip(LOOKS, (BORDERED, ("phone", "ssn", "card", "ip"), ("person",)))
)
#: Digits that are compared without what stands between them.
DIGIT_KINDS = ("phone", "ssn", "card")
#: A word that may be a name without its title; an address that begins in it goes first.
WORD = r"\p{Lu}\p{Ll}{1,30}"
BARE = rf"(?<![\p{{L}}\p{{N}}_]){WORD}(?![\p{{L}}\p{{N}}_])(?![A-Za-z0-9._%+-]{{0,64}}@)"
#: Country calling codes: one, two or three digits (fixed values of the numbering plan).
CALLING = "^\\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Names to draw from, by script and gender. Parameters, not a lexicon of what is detected.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul",
    ("latin", "f"): "Anna Bella Clara Diana Emma Flora Greta Helena Irene Julia Karin Laura Marta Nina Olga Paula",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Олег Павел Роман",
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лидия Мария Нина Ольга Полина",
    ("greek", "m"): "Άρης Βασίλης Γιώργος Δημήτρης Ηλίας Θάνος Κώστας Λουκάς Μάνος Νίκος Πέτρος Στέφανος",
    ("greek", "f"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Σοφία",
}
SURNAMES = {
    "latin": "Abel Berger Costa Dorn Engel Fabre Garnier Hahn Ibarra Jansen Keller Lorenz Moreau Navarro Olsen Perrin Quint Reyes Sander Torres",
    "cyrillic": "Абрамов Белов Воронов Громов Дроздов Ершов Жуков Зимин Ильин Козлов Лебедев Морозов Носов Орлов Панин",
    "greek": "Αλεξίου Βλάχος Γεωργίου Δήμου Ζήσης Ιωάννου Καραγιάννης Λάμπρου Μακρής Νικολάου Παππάς Ρήγας",
}


def _per_kind(kind: Column, choices: dict[str, Column], other: Column) -> Column:
    out = other
    for k, c in choices.items():
        out = F.when(kind == k, c).otherwise(out)
    return out


def _one_of(value: Column, words: tuple[str, ...]) -> Column:
    return value.isin(*words)


def kind_of(mention: Column) -> Column:
    """First kind whose pattern fits the whole mention."""
    out = F.lit(None).cast("string")
    for k, p in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{p})$"), F.lit(k)).otherwise(out)
    return out


def may_hold(text: Column) -> Column:
    """What every entity needs: a digit, an address sign, the start of a key, a title, or a named value.

    These plain searches let most texts pass without the patterns.
    """
    needs = [text.contains(x) for x in ("@", "AKIA", "sk-")] + [text.contains("gh") & text.contains("_")]
    needs += [text.contains(t.rstrip(".")) for t in TITLES_M + TITLES_F if not any(t != o and t.startswith(o) for o in TITLES_M + TITLES_F)]
    named = (text.contains("=") | text.contains(":")) & text.rlike("(?i)passw|secret|token|api[_-]?key")
    out = text.rlike("[0-9]") | named
    for n in needs:
        out = out | n
    return F.coalesce(out, F.lit(False))


def _titled(text: Column) -> Column:
    """Whether a text holds a name with a title."""
    out = F.lit(False)
    for t in TITLES_M + TITLES_F:
        out = out | text.contains(t.rstrip("."))
    return out & text.rlike(PATTERNS["person"])


def _cut(text: Column, pattern: str, mark, names) -> Column:
    """A text in pieces, plain ones and mentions in turns.

    `names` makes the names of the document from all matches; `mark` tells which matches are
    mentions. They are set between marks that hold the text's own hash, so no text holds them.
    """
    edge = F.concat(F.lit("<"), F.sha2(text, 256), F.lit(">"))
    found, plain = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def joined(c: Column) -> Column:
        known = c["names"]
        return F.concat(F.element_at(c["plain"], 1), F.array_join(F.transform(
            c["found"], lambda m, i: F.concat(F.when(mark(m, known), F.concat(c["edge"], m, c["edge"])).otherwise(m), F.element_at(c["plain"], i + 2))), ""))

    bound = F.struct(found.alias("found"), plain.alias("plain"), edge.alias("edge"))
    bound = F.transform(F.array(bound), lambda c: F.struct(c["found"].alias("found"), c["plain"].alias("plain"), c["edge"].alias("edge"), names(c["found"]).alias("names")))
    return F.element_at(F.transform(bound, lambda c: F.split(joined(c), c["edge"])), 1)


def _names(found: Column) -> Column:
    """The words of all names with a title, in lower case."""
    persons = F.filter(found, lambda m: m.rlike(f"^(?:{PATTERNS['person']})$"))
    words = F.transform(persons, lambda m: F.split(F.lower(F.regexp_extract(m, r"^\S+ (.*)$", 1)), "[ -]"))
    return F.array_distinct(F.flatten(words))


def mentions(docs: DataFrame) -> DataFrame:
    """Documents that hold entities: doc_id, row (content key), the text in pieces, plain and mention in
    turns, and the list of mentions in order. A mention is an entity or a word of a name of the document."""
    bare = lambda m: m.rlike(f"^{WORD}$")  # noqa: E731  (no entity is one such word)
    text = F.col("text")
    with_names = _cut(text, f"{ANY}|{BARE}", lambda m, known: ~bare(m) | F.array_contains(known, F.lower(m)), _names)
    others = _cut(text, ANY, lambda m, known: F.lit(True), lambda found: F.array().cast("array<string>"))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    cut = rows.filter(may_hold(text)).select("doc_id", "row", F.when(_titled(text), with_names).otherwise(others).alias("pieces"))
    return cut.filter(F.size("pieces") > 1).withColumn("found", F.filter("pieces", lambda x, i: i % 2 == 1))


def parsed(distinct: DataFrame) -> DataFrame:
    """Mention -> kind, and its entities as (part, etype, norm, script); a name has up to two parts.
    Words without a title are left out."""
    m, kind = F.col("mention"), F.col("kind")
    value = _per_kind(kind, {
        "secret": F.regexp_extract(m, r"""^[A-Za-z_-]+\s{0,2}[=:]\s{0,2}["']?(.*)$""", 1),
        "person": F.regexp_extract(m, r"^\S+ (.*)$", 1),
    }, m)
    title = F.regexp_replace(F.regexp_extract(m, r"^(\S+) ", 1), r"\.$", "")
    gender = F.when(_one_of(title, tuple(t.rstrip(".") for t in TITLES_M)), "m").otherwise("f")
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    norm = _per_kind(kind, {k: F.regexp_replace(value, "[^0-9+]", "") for k in DIGIT_KINDS} | {
        "email": F.lower(value), "iban": F.regexp_replace(value, " ", ""), "person": F.lower(value),
    }, value)
    typed = distinct.withColumn("kind", kind_of(F.col("mention"))).filter("kind IS NOT NULL").select(
        "mention", "kind", value.alias("value"), norm.alias("norm"), gender.alias("gender"), script.alias("script")
    )
    names = F.split("norm", "[ -]")
    part = lambda p, etype, n: F.struct(F.lit(p).alias("part"), etype.alias("etype"), n.alias("norm"), F.col("script"))
    surname = part("last", F.lit("surname"), F.element_at(names, -1))
    given = part("first", F.concat(F.lit("given_"), F.col("gender")), F.element_at(names, 1))
    plain = part("all", F.col("kind"), F.col("norm"))
    parts = F.when(F.col("kind") == "person", F.when(F.size(names) > 1, F.array(given, surname)).otherwise(F.array(surname))).otherwise(F.array(plain))
    return typed.select("mention", "kind", "value", F.explode(parts).alias("e")).select("mention", "kind", "value", "e.*")


def _draws(key: str, attempt: Column) -> Column:
    """512 hex digits that depend on the key, the entity and the attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), "etype", "script", "norm", attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(8)])


def _byte(draws: Column, i: Column) -> Column:
    return F.conv(F.substring(draws, F.pmod(i, F.lit(256)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _luhn(digits: Column) -> Column:
    """Checksum of a digit string whose last digit is the check digit; 0 if valid."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1),
    )
    return F.aggregate(each, F.lit(0), lambda t, d: t + F.when(d > 9, d - 9).otherwise(d)) % 10


def _mod97(chars: Column) -> Column:
    """Remainder by 97 of digits and capitals, A as 10 to Z as 35."""
    return F.aggregate(
        F.split(chars, ""), F.lit(0),
        lambda t, c: F.when(c.rlike("^[0-9]$"), (t * 10 + F.ascii(c) - 48) % 97).when(c.rlike("^[A-Z]$"), (t * 100 + F.ascii(c) - 55) % 97).otherwise(t),
    )


def candidates(entities: DataFrame, key: str) -> DataFrame:
    """Entities with the surrogate that their current `attempt` draws."""
    rows = entities.withColumn("draws", _draws(key, F.col("attempt")))
    norm, kind, draws = F.col("norm"), F.col("etype"), F.col("draws")
    n = F.length(norm)
    tail = n - F.instr(F.reverse(norm), ".")  # where the last label of an address begins
    kept = _per_kind(kind, {"phone": F.greatest(F.length(F.regexp_extract(norm, CALLING, 0)), F.lit(1)), "card": F.lit(1), "key": F.lit(4), "iban": F.lit(2)}, F.lit(0))
    letters = F.when(norm.rlike("^[0-9a-f]+$"), "abcdef").otherwise("abcdefghijklmnopqrstuvwxyz")

    def swapped(c: Column, i: Column) -> Column:
        b = _byte(draws, i)
        pick = lambda chars: F.substring(chars, F.pmod(b, F.length(chars)) + 1, F.lit(1))
        fixed = (i < kept) | ((kind == "email") & (i >= tail))
        return (
            F.when(fixed, c)
            .when(c.rlike("^[0-9]$"), pick(F.lit("0123456789")))
            .when(c.rlike("^[a-z]$"), pick(letters))
            .when(c.rlike("^[A-Z]$"), pick(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
            .otherwise(c)
        )

    mapped = F.array_join(F.transform(F.split(norm, ""), swapped), "")
    # should a short form have no free surrogates left, later attempts make it longer
    more = F.when(F.col("attempt") >= 8, F.substring(F.translate(F.reverse(draws), "0123456789", "ghijklmnop"), F.lit(1), F.col("attempt") - 7)).otherwise("")
    body = F.substring(mapped, F.lit(1), n - 1)
    card = F.concat(body, F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    country, rest = F.substring(mapped, F.lit(1), F.lit(2)), F.substring(mapped, F.lit(5), n)
    checked = F.concat(country, F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0"), rest)
    iban = F.when(_mod97(F.concat(F.substring(norm, F.lit(5), n), F.substring(norm, F.lit(1), F.lit(4)))) == 1, checked).otherwise(mapped)
    ip = F.concat_ws(".", *[(_byte(draws, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])

    def named(pool: dict) -> Column:
        """One name of the pool; later attempts join several with hyphens."""
        out = F.lit("")
        for k, words in pool.items():
            array = F.array(*[F.lit(w) for w in words.split()])
            joined = F.array_join(
                F.transform(F.sequence(F.lit(0), (F.col("attempt") / 2).cast("int")), lambda i: F.element_at(array, F.pmod(_byte(draws, i), F.size(array)) + 1)), "-"
            )
            out = F.when(F.col("script") == k, joined).otherwise(out)
        return out

    by_gender = {g: {s: w for (s, x), w in GIVEN.items() if x == g} for g in ("m", "f")}
    surrogate = _per_kind(kind, {
        "card": F.when(_luhn(norm) == 0, card).otherwise(mapped), "ip": ip, "surname": named(SURNAMES),
        "given_m": named(by_gender["m"]), "given_f": named(by_gender["f"]),
        "email": F.concat(more, mapped), "secret": F.concat(mapped, more), "phone": mapped, "ssn": mapped, "iban": iban, "key": mapped,
    }, mapped)
    return rows.withColumn("surrogate", surrogate).drop("draws")


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(etype, norm, script) -> surrogate, one to one within a type and disjoint from all entities.

    Each round the first claimant (by norm) of a free surrogate keeps it; the others draw
    again. A claim is compared in lower case.
    """
    spark = entities.sparkSession
    entities = written(entities.select("etype", "norm", "script").distinct(), "entities")
    known = entities.select("etype", F.lower("norm").alias("claim")).distinct()
    open_rows, taken, attempt = entities, None, 0
    while True:
        drawn = candidates(open_rows.withColumn("attempt", F.lit(attempt)), key).withColumn("claim", F.lower("surrogate"))
        free = drawn.join(known, ["etype", "claim"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("etype", F.lower("surrogate").alias("claim")), ["etype", "claim"], "left_anti")
        first = free.groupBy("etype", "claim").agg(F.min(F.struct("norm", "script", "surrogate")).alias("w"))
        won = written(first.select("etype", "w.norm", "w.script", "w.surrogate"), f"surrogates{attempt}")
        taken = won if taken is None else taken.unionAll(won)
        rest = written(open_rows.join(won, ["etype", "norm", "script"], "left_anti"), f"open{attempt}")
        if rest.isEmpty():
            return taken
        open_rows, attempt = rest, attempt + 1
        if attempt == 200:
            raise RuntimeError("an entity type has fewer surrogates than entities")


def rendered(found: DataFrame, table: DataFrame) -> DataFrame:
    """Mention -> replacement, in the mention's own format."""
    keyed = found.join(table, ["etype", "norm", "script"])
    one = lambda p: F.max(F.when(F.col("part") == p, F.col("surrogate")))
    rows = keyed.groupBy("mention", "kind", "value").agg(one("all").alias("all"), one("first").alias("first"), one("last").alias("last"))
    value = F.col("value")
    chars = F.split(value, "")
    digit_no = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", ""))
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(F.regexp_replace("all", r"\+", ""), digit_no(i), F.lit(1))).otherwise(c)), "")
    grown = F.length("all") - F.length(value)
    email = F.concat(
        F.substring(F.col("all"), F.lit(1), grown),
        F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[A-Z]$"), F.upper(F.substring(F.col("all"), grown + i + 1, F.lit(1)))).otherwise(F.substring(F.col("all"), grown + i + 1, F.lit(1)))), ""),
    )
    solid_no = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), " ", ""))
    iban = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(F.col("all"), solid_no(i), F.lit(1)))), "")
    person = F.when(F.col("first").isNull(), F.col("last")).otherwise(F.concat("first", F.regexp_extract(value, "[ -]", 0), "last"))
    new = _per_kind(F.col("kind"), {k: digits for k in DIGIT_KINDS} | {"email": email, "iban": iban, "person": person}, F.col("all"))
    before = F.substring(F.col("mention"), F.lit(1), F.length("mention") - F.length(value))
    return rows.select("mention", F.concat(before, new).alias("replacement"), "kind")


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds: one row per document."""
    dirty = written(mentions(docs), "mentions")
    distinct = dirty.select(F.explode("found").alias("mention")).distinct()
    found = written(parsed(distinct), "parsed")
    drawn = written(surrogates(found, key), "drawn")
    table = rendered(found, drawn)
    spots = dirty.select("row", "doc_id", F.posexplode("found").alias("at", "mention")).distinct()
    whole = spots.join(table, "mention").select("row", "doc_id", "at", "kind", "replacement")
    lists = whole.unionByName(_untitled(spots, found, drawn)).groupBy(F.col("row").alias("_r"), F.col("doc_id").alias("_d")).agg(
        F.array_sort(F.collect_list(F.struct("at", "replacement"))).alias("new"), F.array_sort(F.collect_set("kind")).alias("kinds")
    )
    text = F.array_join(F.transform("pieces", lambda x, i: F.when(i % 2 == 1, F.get("new", F.floor(i / 2).cast("int"))["replacement"]).otherwise(x)), "")
    on = (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    changed = dirty.join(lists, on).select("doc_id", text.alias("text"), F.size("new").cast("long").alias("n_entities"), "kinds")
    holds = F.when(may_hold(F.col("text")), F.col("text").rlike(ANY)).otherwise(F.lit(False))
    clean = docs.select("doc_id", "text").filter(~holds)
    none = F.array().cast("array<string>")
    return changed.unionAll(clean.select("doc_id", "text", F.lit(0).cast("long"), none))


def _untitled(spots: DataFrame, found: DataFrame, drawn: DataFrame) -> DataFrame:
    """Words of a document's names where they stand without a title, as (row, doc_id, at, kind, replacement).

    A word that is a given name and a surname in one document counts as the surname.
    """
    parts = found.filter("kind = 'person'").join(drawn, ["etype", "norm", "script"]).select("mention", "norm", F.struct("part", "surrogate").alias("p"))
    named = spots.join(parts, "mention").groupBy(F.col("row").alias("_r"), F.col("doc_id").alias("_d"), F.col("norm").alias("_word"))
    names = named.agg(F.max("p").alias("p"))
    words = spots.filter(F.col("mention").rlike(f"^{WORD}$")).withColumn("word", F.lower("mention"))
    on = (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("word") == F.col("_word"))
    return words.join(names, on).select("row", "doc_id", "at", F.lit("person").alias("kind"), F.col("p.surrogate").alias("replacement"))
