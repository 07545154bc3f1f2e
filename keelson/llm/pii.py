"""PII: surrogates for detected personal data, in DataFrame and SQL functions.

Email addresses, phone numbers, card numbers, social security numbers, bank accounts, IPv4
addresses and names after a title are found by one pattern. Each entity has a normal form
(digits without separators, lower case), so every mention of it in the corpus, however
formatted, gets the same surrogate. A surrogate's characters come from a keyed SHA-512 of
kind and normal form: letters become letters, digits digits, octets octets; card numbers
keep their first digit and whether their check digit is right, account numbers their
country, addresses their top-level domain, given names their gender, all names their
script. A mention keeps its own separators and capitals. A name is one entity whatever its
title: its gender comes from the titles of all its mentions in the corpus, or else from the
lists of given names, and where a text has it with a title, other capitalised mentions in
that text are replaced too.

Surrogates are checked over the whole corpus: within a class no two entities may share one,
and none may equal an entity that really occurs. Losers of a collision (all but the first
by normal form) are drawn again with the next attempt number.

Only rows that hold an entity are shuffled; the others pass straight through. Defined
results: null stays null; empty texts and texts without an entity stay as they are; equal
texts get equal results; a value that an earlier alternative of the pattern covers is that
kind only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut_lineage

#: Titles and what they say of the gender; given names by gender and script: fixed values.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "г-жа", "госпожа")
NEUTRAL = ("Dr", "Prof", "доктор")
GIVEN = {
    ("m", "latin"): "Adam Arne Boris Carl Colin David Emil Felix George Hugo Ivan Jonas Karl Leo Mark Martin Oscar Otto Paul Peter Robert Simon Thomas Victor".split(),
    ("f", "latin"): "Ada Alice Anna Berta Clara Diana Elena Emma Eva Flora Greta Helen Ida Irene Julia Klara Laura Lena Maria Nora Olga Paula Rosa Vera".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
    ("f", "cyrillic"): "Алла Анна Вера Галина Дарья Елена Жанна Зоя Инна Ирина Лариса Мария Нина Ольга Раиса Софья".split(),
}
SYLLABLES = {
    "latin": "ba ben cor dal der fen gar hol kel lan mar nor per ros sen tor".split(),
    "cyrillic": "ба бел вор гор дан зор кал лан мар нов пет рос сам тар хол чер".split(),
}

_TITLES = "|".join(MALE + FEMALE + NEUTRAL)
_NAME = r"\p{Lu}\p{L}{1,30}"
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
CARD = r"(?<![\d+-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{3,4}(?![\d-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
TITLE = rf"(?<!\p{{L}})(?:{_TITLES})\.? (?=\p{{Lu}}\p{{L}})"
#: A title and one or two names, parted again by name_parts().
NAME = rf"{TITLE}{_NAME}(?: {_NAME})?"
#: The first alternative that matches at a place decides.
PATTERN = "|".join((EMAIL, IP, CARD, SSN, PHONE, IBAN, NAME))
MAX_ATTEMPTS = 64
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def name_parts(found: Column, pieces: Column) -> tuple[Column, Column]:
    """found and pieces with each titled name as one match for each name; the title goes to
    the piece before it."""
    titled = lambda m: m.rlike(f"^{TITLE}")
    title = lambda m: F.regexp_extract(m, f"^({TITLE})", 1)
    names = lambda m: F.split(F.regexp_replace(m, f"^{TITLE}", ""), " ")
    matches = F.flatten(F.transform(found, lambda m: F.when(titled(m), names(m)).otherwise(F.array(m))))

    def gaps(m: Column, i: Column) -> Column:
        first = F.concat(F.get(pieces, i), title(m))
        return F.when(titled(m) & (F.size(names(m)) > 1), F.array(first, F.lit(" "))).otherwise(F.array(first))

    return matches, F.concat(F.flatten(F.transform(found, gaps)), F.array(F.element_at(pieces, -1)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def class_of(value: Column) -> Column:
    """The class of a match; names are one class whatever their title."""
    return (
        F.when(value.contains("@"), "email").when(value.rlike(f"^(?:{IP})$"), "ip").when(value.rlike(f"^(?:{SSN})$"), "ssn")
        .when(value.rlike(f"^(?:{CARD})$"), "card").when(value.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(value.rlike("[0-9]"), "phone")
        .otherwise("name")
    )


def gender_hint(before: Column, after: Column, following: Column) -> Column:
    """m or f where a title says so of the given name that it stands before, else null."""
    title = F.regexp_extract(before, rf"(?<!\p{{L}})({_TITLES})\.? $", 1)
    given = (after == " ") & following.rlike(r"^\p{Lu}")
    return F.when(given & title.isin(*MALE), "m").when(given & title.isin(*FEMALE), "f")


def with_kinds(mentions: DataFrame) -> DataFrame:
    """class, norm, kind of each entity of the mentions. A name has the gender that its titles
    name in any mention, or else, also where they differ, the one that GIVEN has for it."""
    said = [F.max(F.when(F.col("hint") == g, 1).otherwise(0)).alias(g) for g in "mf"]
    listed = {g: F.col("norm").isin(*[n.lower() for (own, _), names in GIVEN.items() if own == g for n in names]) for g in "mf"}
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").when(listed["m"], "m").when(listed["f"], "f")
    kind = F.when((F.col("class") == "name") & gender.isNotNull(), F.concat(F.lit("given_"), gender)).otherwise(F.col("class"))
    return mentions.groupBy("class", "norm").agg(*said).select("class", "norm", kind.alias("kind"))


def normal_form(kind: Column, value: Column) -> Column:
    """What all mentions of one entity share."""
    return (
        F.when(kind.isin("card", "ssn", "phone"), _digits(value))
        .when(kind == "iban", F.upper(F.regexp_replace(value, " ", "")))
        .otherwise(F.lower(value))
    )


def _drawn(digest: Column, place: Column, below: int) -> Column:
    """A number below ``below`` (256 at most) from the digest's byte at a place."""
    pair = F.substring(digest, 1 + 2 * F.pmod(place, F.lit(64)), F.lit(2))
    return F.pmod(F.conv(pair, 16, 10).cast("int"), F.lit(below))


def _spelled(text: Column, digest: Column, kept: Column) -> Column:
    """text with letters and digits from ``kept`` on drawn anew, all else as it is."""
    letter = lambda i: F.substring(F.lit(LETTERS), 1 + _drawn(digest, i, 26), F.lit(1))
    def one(c: Column, i: Column) -> Column:
        return (
            F.when(i < kept, c).when(c.rlike("[0-9]"), _drawn(digest, i, 10).cast("string"))
            .when(c.rlike("[a-z]"), letter(i)).when(c.rlike("[A-Z]"), F.upper(letter(i))).otherwise(c)
        )
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after these digits (an odd number of them)."""
    def value(c: Column, i: Column) -> Column:
        doubled = c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 0, 2).otherwise(1)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    total = F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def _choose(names: list[str], digest: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), _drawn(digest, F.lit(0), len(names)))


def candidate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form for one attempt."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")).cast("binary"), 512)
    domain = F.substring_index(norm, ".", -1)
    email = F.concat(_spelled(F.expr("substring(norm, 1, char_length(norm) - char_length(substring_index(norm, '.', -1)))"), digest, F.lit(0)), domain)
    octets = F.transform(F.split(norm, r"\."), lambda o, i: F.when(i == 0, 1 + _drawn(digest, i, 223)).otherwise(_drawn(digest, i, 256)).cast("string"))
    most = F.expr("substring(norm, 1, char_length(norm) - 1)")
    card_head = _spelled(most, digest, F.lit(1))
    right = F.substring(norm, -1, 1) == _luhn(most).cast("string")
    wrong = F.pmod(_luhn(card_head) + 1 + _drawn(digest, F.lit(63), 9), F.lit(10))
    card = F.concat(card_head, F.when(right, _luhn(card_head)).otherwise(wrong).cast("string"))
    script = lambda latin, cyrillic: F.when(norm.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)

    def syllables(script_name: str, count: Column) -> Column:
        parts = F.array(*map(F.lit, SYLLABLES[script_name]))
        return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.get(parts, _drawn(digest, i, 16))), "")

    surname = script(syllables("latin", 3 + attempt), F.concat(syllables("cyrillic", 3 + attempt), F.when(norm.endswith("а"), "а").otherwise("")))
    extra = lambda name: F.when(attempt > 0, syllables(name, attempt)).otherwise("")
    given = {g: F.lower(script(F.concat(_choose(GIVEN[g, "latin"], digest), extra("latin")), F.concat(_choose(GIVEN[g, "cyrillic"], digest), extra("cyrillic")))) for g in "mf"}
    return (
        F.when(kind == "email", email).when(kind == "ip", F.array_join(octets, ".")).when(kind == "card", card)
        .when(kind == "iban", _spelled(norm, digest, F.lit(2))).when(kind == "given_m", given["m"]).when(kind == "given_f", given["f"])
        .when(kind == "name", surname).when(kind == "phone", _spelled(norm, digest, F.lit(1))).otherwise(_spelled(norm, digest, F.lit(0)))
    )


def rendered(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate with the separators and capitals of a mention."""
    def step(state: Column, c: Column) -> Column:
        fills = c.rlike("[0-9A-Za-z]")
        return F.struct(
            (state["i"] + F.when(fills, 1).otherwise(0)).alias("i"),
            F.concat(state["out"], F.when(fills, F.substring(surrogate, state["i"], F.lit(1))).otherwise(c)).alias("out"),
        )
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))
    spaced = F.aggregate(F.split(value, ""), start, step)["out"]
    named = F.when(value == F.upper(value), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    cased = F.when(value == F.upper(value), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("card", "ssn", "phone", "iban"), spaced).when(kind == "name", named).when(kind == "email", cased).otherwise(surrogate)


def choose_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """class, norm, kind, surrogate for distinct (class, norm, kind) rows, collision-free within
    a class."""
    waiting, chosen = entities, None
    for attempt in range(MAX_ATTEMPTS):
        drawn = waiting.withColumn("surrogate", candidate(F.col("kind"), F.col("norm"), F.lit(attempt), key))
        free = drawn.join(entities.select("class", F.col("norm").alias("surrogate")), ["class", "surrogate"], "left_anti")
        if chosen is not None:
            free = free.join(chosen.select("class", "surrogate"), ["class", "surrogate"], "left_anti")
        won = free.groupBy("class", "surrogate").agg(F.min(F.struct("norm", "kind")).alias("e")).select("class", "e.norm", "e.kind", "surrogate")
        won = won if chosen is None else chosen.unionByName(won)
        chosen = cut_lineage(won)
        waiting = cut_lineage(entities.join(chosen, ["class", "norm"], "left_anti"))
        if waiting.isEmpty():
            return chosen
    raise ValueError(f"no free surrogates after {MAX_ATTEMPTS} attempts")


def untitled(piece: Column, known: Column) -> Column:
    """A piece of text between matches in runs of letters and of other characters, as
    struct<token, new>; new is the surrogate of a capitalised word that is a known name."""

    def named(token: Column) -> Column:
        new = F.when(token.rlike(r"^\p{Lu}"), F.try_element_at(known, F.lower(token)))
        return F.struct(token.alias("token"), F.when(new.isNotNull(), rendered(F.lit("name"), token, new)).alias("new"))

    return F.transform(F.regexp_extract_all(piece, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), named)


def replace_private(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds (sorted, distinct) for each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    none = F.array().cast("array<string>")
    # every entity has an at sign, a digit before a digit or separator, or a title
    may_hold = F.col("text").contains("@") | F.col("text").rlike("[0-9][0-9().-]") | F.col("text").rlike(NAME)
    found = F.when(may_hold, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(none)
    rows = rows.withColumn("found", F.coalesce(found, none))
    plain = rows.where(F.size("found") == 0).select("doc_id", "text", F.lit(0).alias("n_entities"), none.alias("kinds"))
    holding = cut_lineage(rows.where(F.size("found") > 0).select(F.monotonically_increasing_id().alias("row"), "doc_id", "found", F.split("text", PATTERN, -1).alias("pieces")))
    parted = name_parts(F.col("found"), F.col("pieces"))
    holding = holding.select("row", "doc_id", parted[0].alias("found"), parted[1].alias("pieces"))
    places = holding.select("row", F.posexplode("found").alias("at", "value"), "found", "pieces")
    hint = gender_hint(F.get("pieces", F.col("at")), F.get("pieces", F.col("at") + 1), F.coalesce(F.get("found", F.col("at") + 1), F.lit("")))
    places = places.select("row", "at", "value", class_of(F.col("value")).alias("class"), hint.alias("hint"))
    mentions = cut_lineage(places.withColumn("norm", normal_form(F.col("class"), F.col("value"))))
    chosen = choose_surrogates(cut_lineage(with_kinds(mentions)), key)
    named = mentions.join(chosen, ["class", "norm"]).select("row", "at", "kind", "class", "norm", "surrogate", rendered(F.col("class"), F.col("value"), F.col("surrogate")).alias("new"))
    known = F.collect_set(F.when(F.col("class") == "name", F.struct("norm", "surrogate")))
    gathered = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("new"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.map_from_entries(known).alias("known"))
    whole = holding.join(gathered, "row")
    tokens = F.when(F.size("known") > 0, F.transform("pieces", lambda p: untitled(p, F.col("known"))))
    whole = whole.withColumn("tokens", tokens).withColumn("more", F.coalesce(F.aggregate("tokens", F.lit(0), lambda n, t: n + F.size(F.filter(t, lambda x: x["new"].isNotNull()))), F.lit(0)))
    said = lambda t: F.array_join(F.transform(t, lambda x: F.coalesce(x["new"], x["token"])), "")
    spoken = F.coalesce(F.transform("tokens", said), F.col("pieces"))
    joined = F.array_join(F.transform(spoken, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("new.new"), i), F.lit("")))), "")
    return plain.unionByName(whole.select("doc_id", joined.alias("text"), (F.size("found") + F.col("more")).alias("n_entities"), "kinds"))
