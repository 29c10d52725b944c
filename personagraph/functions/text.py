"""Signals read out of profile text, as plain column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P

SIGNALS = "array<struct<signal:string,matched_text:string>>"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    return non_empty(F.regexp_extract(text, pattern, group))


def words_with(text: Column, pattern: str) -> Column:
    """The words of a text that hold ``pattern``, in order.

    Links and addresses never span white space, and their patterns look no further than the next
    character, so what these words hold is what the text holds; prose never reaches the patterns.
    """
    return F.filter(F.split(text, r"\s+", -1), lambda word: word.rlike(pattern))


def tokens_with(text: Column, pattern: str) -> Column:
    """The words of a text that hold ``pattern``, one space between them."""
    return F.array_join(words_with(text, pattern), " ")


def explode_rows(df: DataFrame, items: Column | str, out: str, position: str = "_pos") -> DataFrame:
    """One row per element of an array.

    The outer form with a filter behind it: the plain form makes the optimizer test the array's size
    first, which would evaluate an extraction twice.
    """
    rows = df.select("*", F.posexplode_outer(items).alias(position, out))
    return rows.filter(F.col(position).isNotNull())


def _signal(name: str, matched: Column) -> Column:
    return F.struct(F.lit(name).alias("signal"), matched.alias("matched_text"))


def attestations(text: Column) -> Column:
    """Ordered distinct (signal, matched text) of no-AI statements."""
    hashtags = F.transform(all_matches(text, P.NOAI_HASHTAG), lambda m: _signal("bio_tag", m))
    phrases = F.transform(
        F.filter(F.array(*map(F.lit, P.NOAI_PHRASES)), lambda p: F.contains(text, p)),
        lambda p: _signal("bio_tag", p),
    )
    singles = [
        F.array(_signal(name, first_match(text, pattern)))
        for name, pattern in (("glaze_mention", P.GLAZE), ("nightshade_mention", P.NIGHTSHADE))
    ]
    found = F.filter(F.concat(hashtags, phrases, *singles), lambda s: s["matched_text"].isNotNull())
    return F.coalesce(F.array_distinct(found), F.array().cast(SIGNALS))


def _not_negated() -> str:
    """Look-behind for "no / non / not / sfw only" inside the twelve characters before a marker.

    The window starts a fresh text, so a word that fills it exactly needs no boundary before it.
    """
    window = P.NEGATION_WINDOW
    gap = r"[\s:,-]"
    forms = []
    for word, boundary in (("no", r"\b"), ("non", ""), ("not", r"\b")):
        room = window - len(word)
        forms.append(rf"\b{word}{boundary}{gap}{{0,{room}}}")
        forms.append(rf"{word}{boundary}{gap}{{{room}}}")
    room = window - len("sfwonly")
    for inner in range(room + 1):
        forms.append(rf"sfw[\s-]{{{inner}}}only{gap}{{0,{room - inner}}}")
    return "(?<!" + "|".join(forms) + ")"


def adult_markers(text: Column) -> Column:
    """Ordered distinct adult self-labels, minus the negated ones."""
    guard = _not_negated()
    # The marker is looked for first; the costly look-behind runs only where one stands.
    found = F.concat(*[all_matches(text, f"{P.IC}(?={marker}){guard}(?:{marker})") for marker in P.ADULT_MARKERS])
    return F.transform(F.array_distinct(found), lambda m: _signal("bio_marker", m))


def email(text: Column) -> Column:
    near = F.when(F.contains(text, F.lit("@")), tokens_with(text, "@"))
    return F.lower(F.nullif(F.regexp_extract(near, P.EMAIL, 0), F.lit("")))


COMMISSION = "struct<status:string,confidence:double,detail:string>"


def commission_status(text: Column, multiplier: float = 1.0) -> Column:
    """Best reading of the text: highest score, a closed reading wins ties, then the earlier pattern."""
    matched = F.array(*[F.regexp_extract(text, pattern, 0) for pattern, _, _ in P.COMMISSIONS])
    rules = F.array(
        *[
            F.struct(
                F.lit(confidence * multiplier).alias("score"),
                F.lit(int(status == "closed")).alias("closed"),
                F.lit(-order).alias("order"),
                F.lit(status).alias("status"),
            )
            for order, (_, status, confidence) in enumerate(P.COMMISSIONS)
        ]
    )
    readings = F.zip_with(
        rules,
        matched,
        lambda r, m: F.struct(r["score"], r["closed"], r["order"], r["status"], m.alias("matched")),
    )
    hits = F.filter(readings, lambda r: F.coalesce(r["matched"], F.lit("")) != "")
    # One element at most, so the winner is named once.
    best = F.transform(
        F.slice(F.array_sort(hits, _best_first), 1, 1),
        lambda r: F.struct(
            r["status"].alias("status"),
            F.round(r["score"], 2).alias("confidence"),
            strip_space(r["matched"]).alias("detail"),
        ),
    )
    low = F.lower(text)
    maybe = F.contains(low, F.lit(P.COMMISSION_SIGNS[0]))
    for sign in P.COMMISSION_SIGNS[1:]:
        maybe = maybe | F.contains(low, F.lit(sign))
    return F.when(maybe, F.get(best, F.lit(0)))


def _best_first(a: Column, b: Column) -> Column:
    """Order of readings: score, closed, earlier pattern."""

    def key(r: Column) -> Column:
        return F.struct(r["score"].alias("s"), r["closed"].alias("c"), r["order"].alias("o"))

    return F.when(key(a) > key(b), -1).when(key(a) < key(b), 1).otherwise(0)


def looks_like_artist(text: Column) -> Column:
    # Most places of a text fall to one test of the next character, not to one for each hint.
    hints = P.ARTIST_HINTS.removeprefix(P.IC)
    return F.coalesce(text.rlike(f"{P.IC}(?=[{P.ARTIST_STARTS}])(?:{hints})"), F.lit(False))


def looks_like_project(text: Column) -> Column:
    return F.coalesce(text.rlike(P.PROJECT_HINTS), F.lit(False))


def project_account(handle: Column, name: Column, bio: Column) -> Column:
    tests = [handle.rlike(P.PROJECT_HANDLE), name.rlike(P.PROJECT_NAME), bio.rlike(P.PROJECT_SELF)]
    hit = F.coalesce(tests[0], F.lit(False))
    for test in tests[1:]:
        hit = hit | F.coalesce(test, F.lit(False))
    return hit


MENTION = "struct<handle:string,claim:string,relation_hint:string,matched_text:string>"


def _around_signs(text: Column) -> Column:
    """The text with long stretches between two @ signs shortened in their middle.

    What stays of a stretch is its first run without white space, which holds any handle however long, and the tail
    that the next sign's context can reach; so no mention changes, and the pattern below never walks through prose.
    """
    stretch = rf"(?s)\A(\S*+)\s.*(.{{{P.MENTION_CONTEXT + 1}}})\z"
    short = F.transform(F.split(text, "@", -1), lambda p: F.regexp_replace(p, stretch, "$1 $2"))
    return F.when(F.contains(text, F.lit("@")), F.array_join(short, "@"))


def mentions(text: Column, platform: Column) -> Column:
    """One struct per mentioned handle, the first mention of a handle wins.

    Every match carries its own context: the lazy run of up to 24 characters in front starts where the
    previous match ended, which is the context rule itself, so no match offsets are needed.
    """
    empty = F.array().cast(f"array<{MENTION}>")
    near = _around_signs(text)
    by_platform = F.lit(None).cast("array<string>")
    for slug, pattern in P.MENTIONS.items():
        flags, body = pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]
        context = f"(?s){flags}.{{0,{P.MENTION_CONTEXT}}}?{body}"
        by_platform = F.when(platform == slug, all_matches(near, context)).otherwise(by_platform)

    def read(context: Column) -> Column:
        low = F.lower(context)

        def first_token(tokens: list[str]) -> Column:
            return F.get(F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(low, t)), F.lit(0))

        alt = first_token(P.ALT_TOKENS)
        return F.struct(
            F.substring_index(context, "@", -1).alias("handle"),
            F.when(alt.isNotNull(), "same_person").otherwise("related").alias("claim"),
            F.coalesce(alt, first_token(P.RELATED_TOKENS)).alias("relation_hint"),
            strip_space(context).alias("matched_text"),
        )

    found = F.transform(by_platform, read)
    return F.coalesce(first_of_each(found, lambda m: F.lower(m["handle"]), MENTION), empty)


def first_of_each(items: Column, key, kind: str) -> Column:
    """Keep the first element of every key, in order; ``kind`` is the element type.

    Sorting makes this n log n inside one row, and ``items`` is evaluated once.
    """
    tagged = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    start = F.struct(
        F.lit(None).cast("string").alias("last"), F.array().cast(f"array<struct<i:int,x:{kind}>>").alias("kept")
    )
    firsts = F.aggregate(
        F.array_sort(tagged),
        start,
        lambda acc, t: F.struct(
            t["k"].alias("last"),
            F.when(acc["last"].eqNullSafe(t["k"]), acc["kept"])
            .otherwise(F.array_append(acc["kept"], F.struct(t["i"].alias("i"), t["x"].alias("x"))))
            .alias("kept"),
        ),
        lambda acc: acc["kept"],
    )
    return F.transform(F.array_sort(firsts), lambda t: t["x"])


def language(text: Column) -> Column:
    """Dominant script, first test that hits wins."""
    tests = F.lit("unknown")
    for code, pattern in reversed(P.LANGUAGE_SCRIPTS):
        tests = F.when(text.rlike(pattern), code).otherwise(tests)
    return F.when(text.isNull(), "unknown").otherwise(tests)
