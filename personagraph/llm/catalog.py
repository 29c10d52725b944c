"""Queries of the numbered operators over whole tables, with production parameters, and SQL where it can ask the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum, filter_audit, gzip_members, html_blocks, license_diagonals, line_edit_join, metric_trees, quality_votes, simhash_trie, spaced_seeds, subword_bags, surrogates, token_columns
from .common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The vocabulary of the token queries; other paths may be given to the operators.
VOCABULARY = "byte_bpe_50k.json"


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@_query
def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@_query
def op2_token_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    token_columns.write(token_columns.encoded(table(spark, sf_dir, "documents"), vocabulary()), path)
    return token_columns.digests(token_columns.read(spark, path))


@_query
def op3_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_diagonals.scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    templates = [*license_diagonals.PHRASES, *license_diagonals.PASSAGES]
    rows = ", ".join(f"({k}, '{t.label}', {t.phrase}, '{t.text}')" for k, t in enumerate(templates))
    gap, short, long = license_diagonals.GAP, license_diagonals.PHRASE_GRAM, license_diagonals.PASSAGE_GRAM
    return rf"""
WITH templates(template, label, phrase, txt) AS (VALUES {rows}),
places AS (
  SELECT template, label, phrase, len(w) AS size, k AS spot, list_slice(w, k + 1, k + CASE WHEN phrase THEN {short} ELSE {long} END) AS gram
  FROM (SELECT *, string_split(txt, ' ') AS w FROM templates), unnest(range(len(w) - CASE WHEN phrase THEN {short - 1} ELSE {long - 1} END)) AS u(k)),
texts AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT row, k AS word, list_slice(w, k + 1, k + {short}) AS short, list_slice(w, k + 1, k + {long}) AS long FROM texts, unnest(range(len(w))) AS u(k)),
hits AS (
  SELECT row, word, p.* FROM grams JOIN places p ON short = gram AND phrase
  UNION ALL SELECT row, word, p.* FROM grams JOIN places p ON long = gram AND NOT phrase),
diagonals AS (
  SELECT row, template, label, phrase, size, word - spot AS diagonal, count(*) AS votes, min(word) AS first, max(word) AS last, list(spot) AS spots
  FROM hits GROUP BY ALL),
base AS (SELECT row, label, diagonal AS first, 1.0::DOUBLE AS score FROM diagonals WHERE phrase AND votes = size - {short - 1}),
marked AS (
  SELECT *, lag(diagonal) OVER lined IS NULL OR abs(diagonal - lag(diagonal) OVER lined) > {license_diagonals.SHIFT} OR first > lag(last) OVER lined + {gap} AS fresh
  FROM diagonals WHERE NOT phrase WINDOW lined AS (PARTITION BY row, template ORDER BY first, diagonal)),
numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY row, template ORDER BY first, diagonal) AS span FROM marked),
spans AS (
  SELECT row, label, len(list_distinct(flatten(list_transform(flatten(list(spots)), lambda a: range(a, a + {long}))))) / size::DOUBLE AS score
  FROM numbered GROUP BY row, template, label, size, span),
found AS (SELECT row, label, first, score, TRUE AS phrase FROM base UNION ALL SELECT row, label, NULL, score, FALSE FROM spans),
told AS (
  SELECT row, count(*) FILTER (phrase) AS n_base, min(first) AS first_word, max(first) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (phrase)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label) FILTER (score >= {license_diagonals.COVERED})), ',') AS labels, max(score) AS score
  FROM found GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM texts LEFT JOIN told USING (row)"""


ORACLES["op3_license_diagonals"] = _license_sql()


@_query
def op4_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_votes.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality")
    )


def _quality_sql() -> str:
    """Counts, votes and the estimate; the estimate runs all its rounds, of which the last change no sixth decimal."""
    stop = ", ".join(f"'{w.decode()}'" for w in sorted(quality_votes.STOP_WORDS))
    shares = {
        "chars": "word_chars / n", "signs": "n_symbols / n", "dups": "n_dup_lines / l", "reps": "n_repeat_words / n", "stops": "n_stop / n",
        "letters": "n_letters / n", "upper": "n_upper / nullif(word_chars, 0)", "loud": "n_loud / n", "ended": "n_ended / l",
    }
    rules = [
        ("chars BETWEEN 2.5 AND 12", "chars < 1.5 OR chars > 25"), ("signs < 0.05", "signs > 0.4"), ("dups < 0.1", "dups > 0.5"),
        ("reps < 0.1", "reps > 0.4"), ("stops > 0.04", "stops < 0.005 AND n_words >= 30"), ("letters > 0.9", "letters < 0.6"),
        ("upper < 0.15", "upper > 0.5"), ("loud < 0.02", "loud > 0.2"), ("ended > 0.6", "ended < 0.1 AND n_lines >= 3"),
        ("n_words >= 100", "n_words < 20"),
    ]
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for good, bad in rules)
    return rf"""
WITH RECURSIVE texts AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
words AS (SELECT row, unnest(w) AS x, unnest(range(len(w))) AS k FROM texts),
grams AS (SELECT row, k, x || ' ' || lead(x) OVER lined || ' ' || lead(x, 2) OVER lined AS g FROM words WINDOW lined AS (PARTITION BY row ORDER BY k)),
windows AS (SELECT row, k, count(*) OVER (PARTITION BY row, g) AS times FROM grams WHERE g IS NOT NULL),
covered AS (SELECT row, count(DISTINCT k + j) AS n_repeat_words FROM windows, unnest(range(3)) AS v(j) WHERE times > 1 GROUP BY row),
counted AS (
  SELECT doc_id, row, len(w) AS n_words, len(lines) AS n_lines, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: list_contains([{stop}], translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS n_stop,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    (length(text) - length(replace(text, '!!', ''))) / 2 AS n_loud, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:"''][\x20\x09-\x0D]*$'))) AS n_ended
  FROM texts LEFT JOIN covered USING (row)),
shared AS (
  SELECT *, n_words < {quality_votes.LEAST_WORDS} OR n_repeat_words > {quality_votes.MOST_REPEATED} * n_words AS base_failed, {", ".join(f"{v} AS {k}" for k, v in shares.items())}
  FROM (SELECT *, nullif(n_words, 0) AS n, nullif(n_lines, 0) AS l FROM counted)),
voted AS (SELECT *, [{votes}] AS votes FROM shared),
patterns AS (SELECT votes, count(*) AS times, row_number() OVER (ORDER BY votes) AS p FROM voted WHERE NOT base_failed GROUP BY votes),
cells AS (SELECT p, times, r, votes[r] AS v FROM patterns, unnest(range(1, {len(rules) + 1})) AS u(r)),
em(it, p, good) AS (
  SELECT 0, p, greatest(0.05, least(0.95, 0.5 + 0.45 * list_sum(list_transform(votes, lambda x: CASE WHEN x < 0 THEN {quality_votes.OBJECTION} * x ELSE x END)) / greatest(1, len(list_filter(votes, lambda x: x <> 0))))) FROM patterns
  UNION ALL
  SELECT it + 1, p, 1 / (1 + exp(-greatest(-500, least(500, any_value(prior) + sum(odds))))) FROM (
    SELECT it, p, ln((yes + 1) / (no + 1)) AS prior, CASE v WHEN 0 THEN 0 WHEN 1 THEN greatest(0, o) ELSE least(0, o) END AS odds FROM (
      SELECT *, ln((yes_v + 1) / (yes + 3)) - ln((no_v + 1) / (no + 3)) AS o FROM (
        SELECT it, p, v, sum(times * good) OVER (PARTITION BY r, v) AS yes_v, sum(times * (1 - good)) OVER (PARTITION BY r, v) AS no_v,
          sum(times * good) OVER (PARTITION BY r) AS yes, sum(times * (1 - good)) OVER (PARTITION BY r) AS no FROM em JOIN cells USING (p))))
  WHERE it < {quality_votes.ROUNDS} GROUP BY it, p),
judged AS (SELECT votes, good FROM em JOIN patterns USING (p) WHERE it = {quality_votes.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(good, 0) >= {quality_votes.THRESHOLD} AS kept,
  round(good, 6) AS quality FROM voted LEFT JOIN judged USING (votes)"""


ORACLES["op4_quality_votes"] = _quality_sql()


@_query
def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@_query
def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_replaced")


@_query
def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spaced_seeds.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "items", "n_items", "first_word", "last_word", "similarity")


def _leak_sql() -> str:
    size, flank = spaced_seeds.WINDOW, spaced_seeds.WINDOW - 1 - min(m[-1] for m in spaced_seeds.MASKS)
    mask = lambda w, at, m: "[" + ", ".join(f"{w}[{at} + {k + 1}]" for k in m) + "]"
    seeds = " UNION ALL ".join(
        f"SELECT d.row, i.item, d.k AS word, i.k AS item_word FROM (SELECT row, k, {mask('w', 'k', m)} AS seen FROM dp WHERE k + {m[-1]} < len(w)) d "
        f"JOIN (SELECT item, k, {mask('w', 'k', m)} AS seen FROM ip WHERE k + {m[-1]} < len(w)) i USING (seen)"
        for m in spaced_seeds.MASKS
    )
    split = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    return f"""
WITH items AS (SELECT * FROM (SELECT item_id AS item, {split} AS w FROM benchmark) WHERE len(w) > 0),
ip AS (SELECT item, w, k FROM items, unnest(range(len(w))) AS u(k) WHERE len(w) >= {size}),
docs AS (SELECT doc_id, text, row_number() OVER () AS row, {split} AS w FROM documents),
dp AS (SELECT row, w, k FROM docs, unnest(range(len(w))) AS u(k)),
hits AS (
  SELECT doc_id, text, item, word, item_word, d.w AS dw, i.w AS iw
  FROM (SELECT DISTINCT * FROM ({seeds})) JOIN docs d USING (row) JOIN items i USING (item)),
windows AS (
  SELECT doc_id, text, item, word, item_word, s, len(list_filter(range({size}), lambda j:
    coalesce(dw[word + s + j + 1] = iw[item_word + s + j + 1], FALSE))) AS equal
  FROM hits, unnest(range(-{flank}, 1)) AS u(s) WHERE item_word + s >= 0 AND item_word + s + {size} <= len(iw) AND word + s >= 0 AND word + s + {size} <= len(dw)),
best AS (
  SELECT doc_id, text, item, word, item_word, max(struct_pack(equal := equal, s := s)) AS b FROM windows GROUP BY ALL),
found AS (
  SELECT doc_id, text, item, word + b.s AS first, word + b.s + {size - 1} AS last, b.equal / {size}::DOUBLE AS similarity FROM best WHERE b.equal >= {size - spaced_seeds.CHANGED}
  UNION ALL
  SELECT doc_id, text, item, k, k + len(i.w) - 1, 1.0 FROM (SELECT * FROM items WHERE len(w) < {size}) i, docs d, unnest(range(len(d.w))) AS u(k)
  WHERE list_slice(d.w, k + 1, k + len(i.w)) = i.w)
SELECT doc_id, array_to_string(list_sort(list(DISTINCT item)), ',') AS items, count(DISTINCT item) AS n_items, min(first)::BIGINT AS first_word,
  max(last)::BIGINT AS last_word, max(similarity) AS similarity FROM found GROUP BY doc_id, text"""


ORACLES["op7_spaced_seeds"] = _leak_sql()


@_query
def op8_gzip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    gzip_members.write_monolithic(table(spark, sf_dir, "pages"), f"{path}/monolithic")
    gzip_members.normalise(spark, f"{path}/monolithic", path)
    return gzip_members.read_records(spark, path)


ORACLES["op8_gzip_members"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(x, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""


@_query
def op9_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edit_join.members(table(spark, sf_dir, "documents"))


@_query
def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = curriculum.in_order(curriculum.plan(table(spark, sf_dir, "documents")))
    first = F.round(F.get("positions", F.lit(0)), 9)
    return planned.select("doc_id", "size", "source_size", "target", "taken", "source", first.alias("first_position"))


def _mix_sql() -> str:
    weights, epochs = list(curriculum.WEIGHTS), curriculum.EPOCHS
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('{curriculum.KEY}/' || coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS turn FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighted AS (
  SELECT *, {weights}[place % {len(weights)} + 1] AS weight, source_size * {epochs} AS most,
    CASE WHEN place % 2 = 0 THEN {curriculum.TILT} ELSE {-curriculum.TILT} END::DOUBLE AS tilt FROM sources),
leveled AS (
  SELECT *, row_number() OVER lined AS n, (sum(source_size) OVER () - coalesce(sum(most) OVER (lined ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (lined ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW lined AS (ORDER BY most / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size, tilt, least(coalesce((SELECT level FROM leveled WHERE level * weight <= most ORDER BY n LIMIT 1), 0) * weight, most)::DOUBLE AS target
  FROM leveled),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized JOIN targets USING (source)),
passes AS (SELECT *, len(list_filter(range({epochs}), lambda e: 2 * (start + e * source_size) + size <= 2 * target AND target > 0)) AS times, (2 * start + size) / (2 * target) AS share FROM placed)
SELECT doc_id, size, source_size, target, times * size AS taken, source,
  CASE WHEN times > 0 THEN round(2 * share / (1 - tilt + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)), 9) END AS first_position FROM passes"""


ORACLES["op10_curriculum"] = _mix_sql()


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _audit_sql() -> str:
    letters = ", ".join(f"('{x}')" for x in filter_audit.FILTERS)
    tables = ", ".join(f"(VALUES {letters}) AS t{k}(x{k})" for k in range(1, 6))
    unlike = " AND ".join(f"x{a} <> x{b}" for a in range(1, 6) for b in range(a + 1, 6))
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT doc_id, part, CASE WHEN len(w) < {filter_audit.LEAST_WORDS} THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < {filter_audit.LEAST_DISTINCT} * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {filter_audit.MOST_CAPITALS} * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '{filter_audit.SIGNS}') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM texts),
told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN told USING (doc_id) GROUP BY part, fails),
orders AS (SELECT x1 || x2 || x3 || x4 || x5 AS filter_order FROM {tables} WHERE {unlike}),
steps AS (
  SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS hit, fails = letter AS alone,
    regexp_matches(left(filter_order, step - 1), '[_' || fails || ']') AS gone
  FROM cells, (SELECT filter_order, k::INT AS step, substr(filter_order, k, 1) AS letter FROM orders, unnest(range(1, 6)) AS u(k))),
counted AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted"""


ORACLES["op11_filter_audit"] = _audit_sql()


@_query
def op12_metric_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_trees.report(table(spark, sf_dir, "embeddings"))


def _codes_sql() -> str:
    """Every round spelled out: parts against all entries of their codebook."""
    parts, rounds = metric_trees.PARTS, metric_trees.ROUNDS
    nearest = """
near{k} AS MATERIALIZED (
  SELECT row, part, x, min(pair)[2] AS entry, min(pair)[1] AS err FROM (
    SELECT row, p.part, p.x, [list_sum(list_transform(list_zip(p.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.entry] AS pair
    FROM pieces p JOIN book{k} b USING (part)) GROUP BY ALL)"""
    book = """
book{j} AS MATERIALIZED (
  SELECT part, entry, coalesce(z, y) AS y FROM book{k} LEFT JOIN (
    SELECT part, entry, list(CASE WHEN t % n < 0 THEN (t - t % n - n) // n ELSE (t - t % n) // n END ORDER BY place) AS z FROM (
      SELECT part, entry, place, sum(v)::BIGINT AS t, count(*)::BIGINT AS n FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS place FROM near{k}) GROUP BY ALL)
    GROUP BY part, entry) USING (part, entry))"""
    steps = ",".join(nearest.format(k=k) + "," + book.format(k=k, j=k + 1) for k in range(rounds))
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, list_transform(embedding, lambda x: floor({metric_trees.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT row, part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) AS x FROM kept, unnest(range({parts})) AS u(part)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x AS y FROM pieces WHERE row <= {metric_trees.ENTRIES}),{steps},{nearest.format(k=rounds)},
coded AS (SELECT row, array_to_string(list(printf('%02x', entry) ORDER BY part), '') AS code, sum(err)::BIGINT AS error FROM near{rounds} GROUP BY row),
told AS (SELECT sha256(array_to_string(flatten(list(y ORDER BY part, entry)), ',')) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256, label FROM kept JOIN coded USING (row), told"""


ORACLES["op12_metric_trees"] = _codes_sql()


@_query
def op13_subword_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_bags.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
