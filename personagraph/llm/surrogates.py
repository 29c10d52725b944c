"""Surrogates for personal data, DataFrame operations only.

Entities are found by one pattern per text, which also gives the text between them. Equal entities in any writing
(case, separators, titles) share one canonical form, and each distinct form gets one keyed surrogate: digits for digits,
letters for letters in the same case, valid check digits for valid ones, names of the same gender and script, mail under
a reserved domain. A form's surrogate must be no other form's surrogate and no entity of the corpus; forms that lose a
collision draw again. The surrogate is then poured into each writing of the entity, so format and coreference stay.

Texts meet their surrogates by key of document and text, never by entity, so a frequent entity weighs no more than its
documents; distinct forms and writings are made by aggregation before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, text_of

KEY = "surrogates"
#: Draws in the length of the form itself. Each later one is a character longer, so every form settles however few free
#: values its format has.
DRAWS = 12

#: Titles by gender, and frequent given names by gender; titles alone and names before a family name tell a person.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Господин Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Doña Госпожа Κυρία".split(),
    "u": "Dr Prof Профессор".split(),
}
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Hans Peter Klaus Jürgen Pierre Jean Michel "
    "José Juan Carlos Luis Иван Сергей Дмитрий Александр Γιώργος Δημήτρης".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Anna Maria Ursula Monika Marie Nathalie Isabelle "
    "Carmen Ana Lucía Анна Мария Ольга Елена Μαρία Ελένη".split(),
}
#: Names to choose from, by script and gender; "u" takes any.
POOLS = {
    ("latin", "m"): "Adrian Bruno Conrad Dorian Emil Felix Gregor Hugo Ivo Jonas Karl Leon Milan Nils Oskar Paul Quentin Ruben Simon Tobias".split(),
    ("latin", "f"): "Alma Bianca Clara Dora Elsa Flora Greta Helena Irma Julia Klara Lena Mina Nora Olivia Paula Rosa Silvia Tessa Vera".split(),
    ("latin", "family"): "Albers Bergmann Castell Dorn Ellison Falk Garner Holm Irving Jansen Keller Lorenz Marlow Norden Orwell Prescott Quist Rowan Selby Thorne".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Лев Максим".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Ева Зоя Инна Кира Лидия Нина".split(),
    ("cyrillic", "family"): "Белов Волков Громов Донской Ершов Жуков Зимин Ильин Котов Ларин".split(),
    ("greek", "m"): "Άρης Βασίλης Λουκάς Μάρκος Νίκος Πέτρος Στέφανος Φώτης".split(),
    ("greek", "f"): "Άννα Βέρα Δάφνη Ζωή Ηρώ Κλειώ Λυδία Νίκη".split(),
    ("greek", "family"): "Βλάχος Δέδες Ζέρβας Κάππος Λάμπρου Μάνος Ράπτης Σάββας".split(),
}
SYLLABLES = {"latin": "an be co du el fi go ha is ka".split(), "cyrillic": "ан бе ко ду ел фи го ха ис ка".split(), "greek": "αν βε κο δυ ελ φι γο χα ισ κα".split()}
#: Letters and signs to draw from, one for each hexadecimal digit: letters by script, signs for forms of nothing else.
LATIN, CYRILLIC, GREEK = "acdeghjkmnprstvw", "абвгдежзиклмнопр", "αβγδεζηθικλμνξοπ"
SIGNED = "!#$%&()*+-./:=?@"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "(?:" + "|".join(t for group in TITLES.values() for t in group) + r")\.? +"
_GIVEN = "(?:" + "|".join(n for group in GIVEN.values() for n in group) + ")"
#: Kinds in the order in which they are tried at a place. Each first looks at one character, which spares most places.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?=[0-9A-Fa-fgs])(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])"
    r"|(?<=[\"'])(?<=(?i:token|secret|password|passwd|api_key|apikey)[ ]?[=:][ ]?[\"'])[^\"'\s]{6,}+(?=[\"'])",
    "ip": rf"(?=[0-9])(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?=[0-9])(?<![0-9+])(?:[0-9]{13,19}+|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7})(?![0-9])",
    "phone": r"(?=[0-9+(])(?<![0-9])(?:(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
    r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "person": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}{_NAME}(?: +{_NAME})?|{_GIVEN} +{_NAME})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity has one of these, so other texts are passed over.
SIGNS = rf"[0-9@\"']|(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}|{_GIVEN} )|[A-Fa-f]{{32}}"


def _kind(raw: Column) -> Column:
    """The first kind whose pattern the whole entity matches; quoted secrets match none of them."""
    tests = [(k, raw.rlike(rf"\A(?:{p})\z")) for k, p in PATTERNS.items()]
    return reduce(lambda rest, t: F.when(t[1], t[0]).otherwise(rest), reversed(tests), F.lit("secret"))


def _canonical(kind: Column, raw: Column) -> Column:
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind.isin("ssn", "card", "phone"), digits)
        .when(kind == "iban", F.replace(raw, F.lit(" ")))
        .otherwise(raw)
    )


def _titles(gender: str) -> str:
    return r"\A(?:" + "|".join(TITLES[gender]) + r")\.? "


def _name_forms(raw: Column) -> Column:
    """The names of a person as (kind, form): family or given name with gender, script last."""
    bare = F.regexp_replace(raw, rf"\A{_TITLE}", "")
    names = F.split(bare, " +")
    first = F.get(names, F.lit(0))
    gender = (
        F.when(raw.rlike(_titles("m")) | first.isin(*GIVEN["m"]), "m").when(raw.rlike(_titles("f")) | first.isin(*GIVEN["f"]), "f").otherwise("u")
    )
    script = F.when(raw.rlike(r"\p{IsCyrillic}{2}\z"), "cyrillic").when(raw.rlike(r"\p{IsGreek}{2}\z"), "greek").otherwise("latin")
    family = F.struct(F.concat(F.lit("family "), script).alias("kind"), F.element_at(names, -1).alias("form"))
    given = F.struct(F.concat(F.lit("given_"), gender, F.lit(" "), script).alias("kind"), first.alias("form"))
    return F.when(F.size(names) > 1, F.array(given, family)).otherwise(F.array(family))


def _forms(kind: Column, raw: Column) -> Column:
    return F.when(kind == "person", _name_forms(raw)).otherwise(F.array(F.struct(kind.alias("kind"), _canonical(kind, raw).alias("form"))))


def _stream(key: str, draw: Column, name: str, n: Column) -> Column:
    """At least ``n`` hexadecimal digits from the key, the form and the draw."""
    blocks = F.sequence(F.lit(0), (n / 64).cast("int"))
    seed = F.concat_ws("\x1f", F.lit(key), F.lit(name), "kind", "form", draw.cast("string"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", seed, b.cast("string")), 256)), "")


def _letters(stream: Column, known: str) -> Column:
    return F.translate(stream, "0123456789abcdef", known)


def _digits(stream: Column) -> Column:
    return F.translate(stream, "abcdef", "246810")


def _like(form: Column, stream: Column, hexadecimal: Column, signs: Column) -> Column:
    """Digits for digits, letters for letters of the same script in the same case (a to f in hexadecimal forms), signs for
    signs where a form has nothing else, the rest as it is."""
    letters = F.when(hexadecimal, F.translate(stream, "0123456789", "abcdefbdfa")).otherwise(_letters(stream, LATIN))

    def one(k: Column) -> Column:
        c = F.substring(form, k, F.lit(1))
        at = lambda text: F.substring(text, k, F.lit(1))
        cased = lambda known: F.when(c.rlike(r"\p{Lu}"), F.upper(at(_letters(stream, known)))).otherwise(at(_letters(stream, known)))
        return (
            F.when(c.rlike("[0-9]"), at(_digits(stream)))
            .when(c.rlike("[a-z]"), at(letters))
            .when(c.rlike("[A-Z]"), F.upper(at(letters)))
            .when(signs, at(_letters(stream, SIGNED)))
            .when(c.rlike(r"\p{Nd}"), at(_digits(stream)))
            .when(c.rlike(r"\p{L}"), F.when(c.rlike(r"\p{IsCyrillic}"), cased(CYRILLIC)).when(c.rlike(r"\p{IsGreek}"), cased(GREEK)).otherwise(cased(LATIN)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the last but one doubled."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(F.pmod(n - k, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _syllable(known: list[str]) -> Callable[[Column], Column]:
    def one(k: Column) -> Column:
        pick = F.conv(F.substring(F.col("_stream"), 10 + 2 * k, F.lit(2)), 16, 10).cast("int")
        return F.get(F.array(*[F.lit(x) for x in known]), F.pmod(pick, F.lit(len(known))))

    return one


def _drawn(forms: DataFrame, key: str, draws: int) -> DataFrame:
    """``forms`` (kind, form, draw) with their surrogates, longer by a character for each of the ``draws`` that is beyond.
    Steps are columns, so each is worked out once."""
    n = F.length("form")
    grown = F.greatest(F.col("draw") - F.lit(draws - 1), F.lit(0))
    wide = forms.withColumns(
        {
            "_stream": _stream(key, F.col("draw"), "form", n + 16 + 4 * grown),
            "_hex": F.col("form").rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z"),
            "_signs": ~F.col("form").rlike(r"[\p{L}\p{Nd}]"),
        }
    )
    wide = wide.withColumn("_more", F.substring(F.col("_stream"), n + 1, grown))
    wide = wide.withColumn("_like", F.concat(_like(F.col("form"), F.col("_stream"), F.col("_hex"), F.col("_signs")), _digits(F.col("_more"))))
    number = lambda a, size: F.conv(F.substring("_stream", a, size), 16, 10).cast("long")
    octet = lambda at: F.pmod(F.conv(F.substring(F.col("_stream"), at, F.lit(4)), 16, 10).cast("long"), F.lit(256)).cast("string")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), 3 + grown), lambda k: octet(4 * k + 1)), ".")
    # The last digit makes the check sum of a valid number valid again.
    head = F.expr("substring(_like, 1, length(_like) - 1)")
    check = F.pmod(10 - F.pmod(_luhn(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn(F.col("form")), F.lit(10)) == 0, F.concat(head, check)).otherwise(F.col("_like"))
    local = F.concat(F.substring_index("_like", "@", 1), _letters(F.col("_more"), LATIN))
    domain = F.substring_index("form", "@", -1)
    owner = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256)
    email = F.concat(local, F.lit("@"), F.translate(F.substring(owner, 1, 10), "0123456789", "ghjkmnprst"), F.lit(".example"))
    names = F.lit(None).cast("string")
    for (script, part), pool in POOLS.items():
        own = F.col("kind") == (f"family {script}" if part == "family" else f"given_{part} {script}")
        if part == "m":  # either gender where none is known
            own = own | ((F.col("kind") == f"given_u {script}") & (F.pmod(number(1, 2), F.lit(2)) == 0))
        elif part == "f":
            own = own | ((F.col("kind") == f"given_u {script}") & (F.pmod(number(1, 2), F.lit(2)) == 1))
        pick = F.get(F.array(*[F.lit(x) for x in pool]), F.pmod(number(3, 8), F.lit(len(pool))).cast("int"))
        more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("draw"), F.lit(1))), _syllable(SYLLABLES[script])), "")
        # The first draw is a name of the pool as it is, later ones grow by syllables.
        names = F.when(own, F.concat(pick, F.when(F.col("draw") > 0, more).otherwise(F.lit("")))).otherwise(names)
    kind = F.col("kind")
    surrogate = F.coalesce(names, F.when(kind == "ip", octets).when(kind == "card", card).when(kind == "email", email).otherwise(F.col("_like")))
    return wide.withColumn("surrogate", surrogate).drop("_stream", "_hex", "_signs", "_more", "_like")


def surrogates(forms: DataFrame, key: str = KEY, draws: int = DRAWS) -> DataFrame:
    """kind, form, surrogate of distinct ``forms`` (kind, form): no two of a kind share one, none is a form itself.

    A form that meets another with its surrogate keeps it only if it comes first in order; the rest draw again, after
    ``draws`` with ever longer surrogates.
    """
    forms = cut(forms)
    settled = None
    waiting = forms.withColumn("draw", F.lit(0))
    for draw in count():
        drawn = cut(_drawn(waiting, key, draws))
        firsts = drawn.groupBy("kind", "surrogate").agg(F.min("form").alias("form"))
        free = firsts.join(forms.select("kind", F.col("form").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        free = cut(free.select("kind", "form", "surrogate"))
        settled = free if settled is None else settled.unionByName(free)
        waiting = cut(drawn.join(free, ["kind", "form"], "left_anti").select("kind", "form", F.lit(draw + 1).alias("draw")))
        if waiting.isEmpty():
            return settled


def _poured(raw: Column, kind: Column, made: Column) -> Column:
    """The writing ``raw`` with the surrogate's characters."""
    first = F.get(made, F.lit(0))
    gaps = F.split(raw, "[0-9]")
    digits = F.array_join(F.zip_with(gaps, F.split(first, ""), lambda g, d: F.concat(F.coalesce(g, F.lit("")), F.coalesce(d, F.lit("")))), "")
    blanks = F.split(raw, "[A-Z0-9]")
    iban = F.array_join(F.zip_with(blanks, F.split(first, ""), lambda g, d: F.concat(F.coalesce(g, F.lit("")), F.coalesce(d, F.lit("")))), "")
    # Mail in capitals stays in capitals.
    email = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(first)).otherwise(first)
    title = F.regexp_extract(raw, rf"\A{_TITLE}", 0)
    person = F.concat(title, F.array_join(made, " "))
    return (
        F.when(kind == "person", person)
        .when(kind.isin("ssn", "card", "phone"), digits)
        .when(kind == "iban", iban)
        .when(kind == "email", email)
        .otherwise(first)
    )


def replacements(docs: DataFrame, key: str = KEY, draws: int = DRAWS) -> tuple[DataFrame, DataFrame]:
    """Found entities (doc_id, text_hash, at, raw) of distinct texts, and the writings with kind and replacement."""
    text = text_of("text")
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text.alias("text"))
        .filter(F.col("text").rlike(SIGNS))
        .select("doc_id", "text_hash", F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1)).alias("raws"))
        .filter(F.size("raws") > 0)
    )
    # Rows with equal id and text are one here.
    found = cut(found.select("doc_id", "text_hash", F.posexplode("raws").alias("at", "raw")).distinct())
    writings = cut(found.select("raw").distinct().withColumn("kind", _kind(F.col("raw"))).withColumn("forms", _forms(F.col("kind"), F.col("raw"))))
    parts = writings.select("raw", F.col("kind").alias("whole"), F.posexplode("forms").alias("part", "f")).select("raw", "whole", "part", "f.kind", "f.form")
    made = cut(surrogates(parts.select("kind", "form").distinct(), key, draws))
    # A writing has two parts at most.
    joined = parts.join(made, ["kind", "form"]).groupBy("raw", "whole").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "surrogate"))), lambda x: x["surrogate"]).alias("made"))
    return found, cut(joined.select("raw", F.col("whole").alias("kind"), _poured(F.col("raw"), F.col("whole"), F.col("made")).alias("new")))


def replace(docs: DataFrame, key: str = KEY, draws: int = DRAWS) -> DataFrame:
    """All rows and columns of ``docs``, with surrogates in the texts, and n_replaced (a longer name where it is taken).

    The same entity has the same surrogate in all texts and reruns; the key decides which. Null texts stay null; null
    ids, repeated rows and empty texts are rows like others; an empty table gives no rows.
    """
    found, writings = replacements(docs, key, draws)
    # The entities of one text, in order.
    per_text = (
        found.join(writings.select("raw", "new"), "raw")
        .groupBy("doc_id", "text_hash")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("news"))
    )
    news, count = free_name(docs, "news"), free_name(docs, "n_replaced")
    per_text = cut(per_text.withColumnRenamed("news", news))
    same = docs["doc_id"].cast("long").eqNullSafe(per_text["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(per_text["text_hash"])
    # One plan at every size: texts are dealt by their keys, as they must be where entities are many.
    joined = docs.join(per_text.hint("merge"), same, "left").select(*[docs[c] for c in docs.columns], per_text[news])
    gaps = F.split(F.col("text"), ANY, -1)
    whole = F.array_join(F.zip_with(gaps, F.col(news), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    return joined.select(
        *[F.when(F.col(news).isNotNull(), whole).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size(news), F.lit(0)).alias(count),
    )
