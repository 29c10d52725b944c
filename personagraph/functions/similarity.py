"""Name similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _longest_match(a: Column, b: Column) -> Column:
    """at, size and other of the longest common substring: its place in ``a`` (the first of several) and in ``b``.

    A window over ``a`` grows while ``b`` holds it and else moves on by one, never shrinking.
    """
    none = F.struct(F.lit(1).alias("i"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def step(q: Column, _: Column) -> Column:
        fits = (q["i"] + q["size"] <= F.length(a)) & F.contains(b, F.substring(a, q["i"], q["size"] + 1))
        return F.struct(
            F.when(fits, q["i"]).otherwise(q["i"] + 1).alias("i"),
            F.when(fits, q["size"] + 1).otherwise(q["size"]).alias("size"),
            F.when(fits, q["i"]).otherwise(q["at"]).alias("at"),
        )

    found = F.aggregate(F.sequence(F.lit(1), F.length(a) * 2), none, step)
    return _let(found, lambda q: F.struct(q["at"].alias("at"), q["size"].alias("size"), F.instr(b, F.substring(a, q["at"], q["size"])).alias("other")))


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all characters (Ratcliff and Obershelp); 0 where a side is empty.

    The longest common substring matches, and so do those of what stands before it in both and of what stands behind:
    a fold over a stack of such pairs, which ends after at most twice as many steps as the shorter name has characters.
    """
    pair = "array<struct<a: string, b: string>>"

    def push(*pairs: tuple[Column, Column]) -> Column:
        made = F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in pairs])
        return F.filter(made, lambda p: (p["a"] != "") & (p["b"] != "")).cast(pair)

    def matched(state: Column, top: Column, m: Column) -> Column:
        x, y = top["a"], top["b"]
        below = F.slice(state["stack"], F.lit(1), F.size(state["stack"]) - 1)
        more = push(
            (F.substring(x, F.lit(1), m["at"] - 1), F.substring(y, F.lit(1), m["other"] - 1)),
            (F.substring(x, m["at"] + m["size"], F.length(x)), F.substring(y, m["other"] + m["size"], F.length(y))),
        )
        stack = F.when(m["size"] > 0, F.concat(below, more)).otherwise(below)
        return F.struct(stack.alias("stack"), (state["total"] + m["size"]).alias("total"))

    def step(state: Column, _: Column) -> Column:
        one = lambda top: _let(_longest_match(top["a"], top["b"]), lambda m: matched(state, top, m))
        return F.when(F.size(state["stack"]) == 0, state).otherwise(_let(F.element_at(state["stack"], -1), one))

    start = F.struct(push((a, b)).alias("stack"), F.lit(0).alias("total"))
    steps = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)) * 2 + 1)
    total = F.aggregate(steps, start, step, lambda state: state["total"])
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(total * 2.0 / (F.length(a) + F.length(b)))


def exact_score(a: Column, b: Column) -> Column:
    """1 for equal, 0.9 for containment of names of four letters or more, else null."""
    both = (F.length(a) >= 4) & (F.length(b) >= 4)
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when(both & inside, F.lit(0.9))


def name_score(a: Column, b: Column) -> Column:
    """Similarity of two normalized names: decided by equality or containment, else by matching characters."""
    return F.coalesce(exact_score(a, b), matching_ratio(a, b))
