"""Line dedup by a segment-partition edit join, DataFrame operations only.

Equal lines fold into one row first. Each distinct line is cut into EDITS + 1 segments; two lines within EDITS edits
share a segment at a place that shifts by few characters (Li, Deng, Wang, Feng: Pass-Join, 2011). So every line is
indexed under its own segments, and probes the indexes of its own and up to EDITS smaller lengths with the substrings
that can match there; equal keys give candidates. What is left of them after the common start and end is verified by
bit-parallel edit distance over a band of 2 * EDITS + 1 diagonals (Hyyro, 2003), the state of a step being two words.

Under a key that many lines share, as near copies do, pairs are made only if a 64-bit mark of their neighbouring
characters allows so few edits; the rest of them is compared there and goes no further.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, free_name, text_of

#: Edits (characters added, lost or changed) up to which lines are one.
EDITS = 2
#: Two lines may differ by one edit for so many characters of the longer one, and by EDITS at most: more edits make
#: another line of a short one.
CHARS_PER_EDIT = 6
#: So many ids of lines are sent to all tasks at most; beyond, texts are shuffled to them.
SENT_IDS = 1_000_000

_WHITE = " \t\r\x0b\x0c"


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line: lines that are not blank, without ASCII white space at either end."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text_of("text"), "\n")).alias("line_no", "raw"))
    return lines.select("doc_id", "line_no", F.btrim("raw", F.lit(_WHITE)).alias("line")).filter("line <> ''")


def _names(line: Column) -> list[Column]:
    """128 bits that tell a line, in place of its text."""
    return [F.xxhash64(line).alias("name"), F.xxhash64(F.lit(1), line).alias("name2")]


def distinct_lines(docs: DataFrame) -> DataFrame:
    """id, line, n_copies, first (struct of none, doc_id, line_no): one row per distinct line; none sorts null ids last."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    found = occurrences(docs).groupBy("line").agg(F.count("*").alias("n_copies"), F.min(place).alias("first"))
    return found.select(F.monotonically_increasing_id().alias("id"), "line", "n_copies", "first")


def _cuts(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of all substrings that a line looks up; shift 0 of its own length is its own
    segment, which is indexed. The bounds follow from the edits that can lie on either side of a segment."""
    out = []
    for less in range(edits + 1):
        for k in range(edits + 1):
            left, right = k, edits - k
            for shift in range(max(-left, less - right), min(left, less + right) + 1):
                if less or shift:
                    out.append((less, k, shift))
    return out


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """key, id, probe of every segment and probed substring of ``lines`` (id, line)."""
    n = F.length("line")

    def entry(less: int, k: int, shift: int, probe: bool) -> Column:
        size = n - less
        start = F.expr(f"(length(line) - {less}) * {k} div {edits + 1}").cast("int")
        end = F.expr(f"(length(line) - {less}) * {k + 1} div {edits + 1}").cast("int")
        at = start + shift
        key = F.xxhash64(size, F.lit(k), F.substring("line", at + 1, end - start))
        return F.when((size >= 0) & (at >= 0) & (at + end - start <= n), F.struct(key.alias("key"), F.lit(probe).alias("probe")))

    entries = [entry(0, k, 0, False) for k in range(edits + 1)] + [entry(*c, True) for c in _cuts(edits)]
    return lines.select("id", F.explode(F.array(*entries)).alias("e")).filter("e is not null").select("id", "e.key", "e.probe")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (key, id, probe) whose key another line has too."""
    by = Window.partitionBy("key")
    ends = rows.withColumns({"_low": F.min("id").over(by), "_high": F.max("id").over(by)})
    return ends.filter(F.col("_low") != F.col("_high")).select("key", "id", "probe")


def _marks(line: Column) -> Column:
    """64 bits, each the parity of how often the pairs of neighbouring characters of one class occur."""
    chars = _chars(F.concat(F.lit("\n"), line, F.lit("\n")))
    bits = F.zip_with(
        F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: _bit(F.xxhash64(a, b))
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(64)).cast("int"))


def _pairs(shared: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(low, high) ids under one key, of which one is indexed there, and whose marks allow so many edits: an edit ends
    two pairs of neighbours at most and makes two."""
    marked = shared.join(texts.select("id", "marks"), "id")
    left = marked.filter(~F.col("probe")).select("key", F.col("id").alias("a"), F.col("marks").alias("a_marks"))
    right = marked.select("key", F.col("id").alias("b"), "probe", F.col("marks").alias("b_marks"))
    met = left.join(right, "key").filter((F.col("a") != F.col("b")) & (F.col("probe") | (F.col("a") < F.col("b"))))
    met = met.filter(F.bit_count(F.col("a_marks").bitwiseXOR(F.col("b_marks"))) <= 4 * edits)
    return met.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()


def _near(lines: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (low, high), and (id, line, marks) of all lines that share a key with another."""
    shared = cut(_shared(_keys(lines, edits)))
    ids = cut(shared.select("id").distinct())
    # A few ids spare the texts a shuffle.
    known = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    texts = cut(lines.select("id", "line").join(known, "id", "left_semi").withColumn("marks", _marks(F.col("line"))))
    return _pairs(shared, texts, edits), texts


def candidates(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(low, high) ids of ``lines`` (id, line) that may be within ``edits``; none that is within is missing."""
    return _near(lines, edits)[0]


def _common(a: Column, b: Column) -> Column:
    """Length of the common start of two texts, by halving steps."""
    top = F.ceil(F.log2(F.greatest(F.length(a), F.length(b), F.lit(2)))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), top), lambda k: F.pow(F.lit(2), top - k).cast("int"))
    part = lambda text, at, n: F.substring(text, at + 1, n)
    # A step past the end of either text compares what is there, so the sum is cut to the shorter one.
    return F.least(F.aggregate(steps, F.lit(0), lambda at, n: F.when(part(a, at, n) == part(b, at, n), at + n).otherwise(at)), F.length(a), F.length(b))


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _distance(long: Column, short: Column, edits: int) -> Column:
    """Edit distance of two texts, or some number above ``edits``; ``long`` is at least as long, by at most ``edits``.

    Bit k of a word belongs to the k-th row of the band, which goes one row down with each character of ``long``. The
    lowest row's value is followed along its diagonal; rows past the end of ``short`` match nothing, so the wanted value
    is some vertical differences further up.
    """
    band = 2 * edits + 1
    ones = (1 << band) - 1
    n, m = F.size(long), F.size(short)
    # The characters of ``short`` that each row of the band sees, beside that of ``long``.
    seen = [F.concat(F.array_repeat(F.lit(None).cast("string"), edits - k), short) for k in range(edits + 1)]
    seen += [F.slice(short, k + 1, F.greatest(m - k, F.lit(0))) for k in range(1, edits + 1)]
    table = F.slice(F.arrays_zip(long.alias("char"), *[c.alias(f"row{k}") for k, c in enumerate(seen)]), 1, n)
    word = lambda v: F.lit(v).cast("long")
    cut_off = lambda v: v.bitwiseAND(word(ones))

    def step(state: Column, at: Column) -> Column:
        char = at["char"]
        equal = sum((F.when(at[f"row{k}"] == char, word(1 << k)).otherwise(word(0)) for k in range(1, band)), F.when(at["row0"] == char, word(1)).otherwise(word(0)))
        up, down = state["up"], state["down"]
        carried = ((equal.bitwiseAND(up)) + up).bitwiseXOR(up)
        return F.struct(up.alias("up"), down.alias("down"), state["low"].alias("low"), cut_off(carried.bitwiseOR(equal).bitwiseOR(down)).alias("flat"))

    def settle(s: Column) -> Column:
        right_up = s["down"].bitwiseOR(cut_off(F.bitwise_not(s["flat"].bitwiseOR(s["up"]))))
        moved = F.shiftright(s["flat"], 1)
        return F.struct(
            s["flat"].bitwiseAND(s["up"]).bitwiseOR(cut_off(F.bitwise_not(moved.bitwiseOR(right_up)))).alias("up"),
            moved.bitwiseAND(right_up).alias("down"),
            (s["low"] + F.when(s["flat"].bitwiseAND(word(1 << (band - 1))) == 0, 1).otherwise(0)).alias("low"),
        )

    start = F.struct(word(ones ^ ((1 << edits) - 1)).alias("up"), word(0).alias("down"), F.lit(edits).alias("low"))

    def advance(state: Column, at: Column) -> Column:
        # One element at a time through a list, so that the match word is worked out once.
        return F.aggregate(F.array(step(state, at)), state, lambda _, s: settle(s))

    end = F.aggregate(table, start, advance)
    bit = lambda v, k: F.shiftright(end[v], k).bitwiseAND(word(1)).cast("int")
    ups = [F.when(F.lit(k) >= edits - (n - m), bit("up", k) - bit("down", k)).otherwise(0) for k in range(2 * edits)]
    return end["low"] - sum(ups[1:], ups[0]) if ups else end["low"]


def links(lines: DataFrame, edits: int = EDITS, longer: int = 0) -> DataFrame:
    """(low, high) ids of different ``lines`` (id, line) whose edit distance is at most ``edits``, and of which one has
    ``longer`` characters or more."""
    pairs, texts = _near(lines, edits)
    met = pairs.join(texts.select(F.col("id").alias("low"), F.col("line").alias("a")), "low").join(
        texts.select(F.col("id").alias("high"), F.col("line").alias("b")), "high"
    )
    met = met.filter((F.abs(F.length("a") - F.length("b")) <= edits) & (F.greatest(F.length("a"), F.length("b")) >= longer))
    rest = met.withColumn("start", _common(F.col("a"), F.col("b"))).select(
        "low", "high", F.expr("reverse(substring(a, start + 1))").alias("a"), F.expr("reverse(substring(b, start + 1))").alias("b")
    )
    rest = rest.withColumn("end", _common(F.col("a"), F.col("b"))).select(
        "low", "high", F.expr("substring(a, end + 1)").alias("a"), F.expr("substring(b, end + 1)").alias("b")
    )
    ordered = rest.withColumn("swap", F.length("a") < F.length("b")).select(
        "low", "high", _chars(F.when(F.col("swap"), F.col("b")).otherwise(F.col("a"))).alias("long"), _chars(F.when(F.col("swap"), F.col("a")).otherwise(F.col("b"))).alias("short")
    )
    # Each list is used several times below; from a written table it is made once.
    return cut(ordered).withColumn("distance", _distance(F.col("long"), F.col("short"), edits)).filter(F.col("distance") <= edits).select("low", "high")


def near_links(lines: DataFrame, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(low, high) ids of different ``lines`` (id, line) that differ by one edit at most for each ``chars_per_edit``
    characters of the longer one, and by ``edits`` at most."""
    n = F.length("line")
    found = []
    for e in range(1, edits + 1):
        longer = e * chars_per_edit
        # A pair belongs to the edits that its longer line allows; the other line is shorter by so many at most.
        some = lines.filter(n >= longer - e)
        found.append(links(some if e == edits else some.filter(n < longer + chars_per_edit), e, longer))
    return reduce(DataFrame.unionByName, found)


def _grouped(docs: DataFrame, edits: int, chars_per_edit: int) -> DataFrame:
    """Distinct lines with n_links, and the group's id."""
    lines = cut(distinct_lines(docs))
    found = cut(near_links(lines, edits, chars_per_edit))
    degree = found.select(F.explode(F.array("low", "high")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    named = components(found).withColumnRenamed("node", "id").join(degree, "id")
    return lines.join(named, "id", "left").select(
        "line", "n_copies", "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("group")
    )


def _told(docs: DataFrame, edits: int, chars_per_edit: int) -> DataFrame:
    """Distinct lines that have copies or near copies, by name, with their first place and that of their group."""
    found = _grouped(docs, edits, chars_per_edit).filter("n_copies > 1 or n_links > 0")
    rows = cut(found.select(*_names(F.col("line")), F.length("line").cast("long").alias("n_chars"), "n_copies", "n_links", "first", "group"))
    heads = rows.groupBy("group").agg(F.min("first").alias("head"))
    return rows.join(heads, "group").withColumns({"group_doc": F.col("head.doc_id"), "group_line": F.col("head.line_no").cast("long")})


def repeated(docs: DataFrame, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row per distinct line that has copies or near copies: doc_id, line_no, n_chars, n_copies, n_links, group_doc,
    group_line.

    doc_id and line_no tell where the line stands first, group_doc and group_line where the first line of its group
    does; n_copies counts equal lines, n_links the other distinct lines within ``edits``, and within one edit for each
    ``chars_per_edit`` characters. Lines are trimmed of ASCII white space, blank ones are none. Null and empty texts have
    no lines; rows without id come after all others and tell a null doc_id; repeated rows count as copies;
    an empty table gives no rows; columns other than doc_id and text are not read.
    """
    place = [F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").cast("long").alias("line_no")]
    return _told(docs, edits, chars_per_edit).select(*place, "n_chars", "n_copies", "n_links", "group_doc", "group_line")


def members(docs: DataFrame, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The columns of ``repeated``, one row for each place (doc_id, line_no) where such a line stands: the places of a
    group but its first, (group_doc, group_line), are those that ``clean`` takes out. Repeated rows of ``docs`` repeat
    their places."""
    places = occurrences(docs).select("doc_id", F.col("line_no").cast("long").alias("line_no"), *_names(F.col("line")))
    told = cut(_told(docs, edits, chars_per_edit).drop("first", "group", "head"))
    return places.join(told, ["name", "name2"]).select("doc_id", "line_no", "n_chars", "n_copies", "n_links", "group_doc", "group_line")


def clean(docs: DataFrame, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``docs`` with only the first line of every group left in the texts; blank lines and all rows stay.

    Rows that share a doc_id share its lines' places, so all of them keep what the first occurrence keeps. Null texts
    stay null.
    """
    grouped = _grouped(docs, edits, chars_per_edit)
    heads = cut(grouped.groupBy("group").agg(F.min("first").alias("head")).select("head.doc_id", "head.line_no"))
    line_no, raw, row = (free_name(docs, x) for x in ("line_no", "raw", "row"))
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    lines = numbered.select(row, "doc_id", F.posexplode(F.split("text", "\n")).alias(line_no, raw))
    same = lines["doc_id"].cast("long").eqNullSafe(heads["doc_id"]) & (lines[line_no] == heads["line_no"])
    kept = lines.filter(F.btrim(raw, F.lit(_WHITE)) != "").join(heads, same, "left_semi").unionByName(
        lines.filter(F.btrim(raw, F.lit(_WHITE)) == "")
    )
    # The lines of one text, which was one row before.
    texts = kept.groupBy(row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line_no, raw))), lambda x: x[raw]), "\n").alias("text"))
    back = numbered.withColumnRenamed("text", raw).join(texts, row, "left")
    return back.select(*[F.when(F.col(raw).isNotNull(), F.coalesce("text", F.lit(""))).alias("text") if c == "text" else F.col(c) for c in docs.columns])
