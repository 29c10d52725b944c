"""Quality rules by weak supervision.

Each rule looks at a few counts of a text and votes good, bad or abstains. Documents with the same votes are one
pattern, and there are at most 3 to the power of the number of rules of them whatever the corpus holds; so one
aggregation gives all that expectation-maximisation needs. It estimates how often each rule votes either way on good
and on bad documents, and the posterior probability of each pattern replaces the demand that all rules agree.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut

#: A text fails at once below so many words, or if more than such a share of its words is repeated.
LEAST_WORDS = 50
MOST_REPEATED = 0.5
THRESHOLD = 0.5
ROUNDS = 100
OBJECTION = 3

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: Frequent short words of four languages, counted as a sign of prose.
STOP_WORDS = frozenset(
    "the of and to in is that for it on with as was be by at this are from or an la le les de des et un une en du que "
    "pour dans qui sur avec pas est au der die das und ist von zu den mit im ein eine nicht auf sie dem el los las y "
    "por con para una del se no su al lo como".encode().split()
)
COUNTS = "n_words n_lines word_chars n_symbols n_dup_lines n_repeat_words n_stop_words n_letters n_upper n_shouted n_ended".split()
FEATURES = "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS)


def _vote(good: Column, bad: Column) -> Column:
    """1, -1, or 0 for an abstention; also where a share is undefined."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part), F.col(whole))


#: Name of a rule, and its vote from the counts.
RULES: dict[str, Callable[[], Column]] = {
    "word_length": lambda: _vote(_share("word_chars", "n_words").between(2.5, 12), (_share("word_chars", "n_words") < 1.5) | (_share("word_chars", "n_words") > 25)),
    "symbols": lambda: _vote(_share("n_symbols", "n_words") < 0.05, _share("n_symbols", "n_words") > 0.4),
    "dup_lines": lambda: _vote(_share("n_dup_lines", "n_lines") < 0.1, _share("n_dup_lines", "n_lines") > 0.5),
    "repeats": lambda: _vote(_share("n_repeat_words", "n_words") < 0.1, _share("n_repeat_words", "n_words") > 0.4),
    "stop_words": lambda: _vote(_share("n_stop_words", "n_words") > 0.04, (_share("n_stop_words", "n_words") < 0.005) & (F.col("n_words") >= 30)),
    "letters": lambda: _vote(_share("n_letters", "n_words") > 0.9, _share("n_letters", "n_words") < 0.6),
    "capitals": lambda: _vote(_share("n_upper", "word_chars") < 0.15, _share("n_upper", "word_chars") > 0.5),
    "shouting": lambda: _vote(_share("n_shouted", "n_words") < 0.02, _share("n_shouted", "n_words") > 0.2),
    "line_ends": lambda: _vote(_share("n_ended", "n_lines") > 0.6, (_share("n_ended", "n_lines") < 0.1) & (F.col("n_lines") >= 3)),
    "length": lambda: _vote(F.col("n_words") >= 100, F.col("n_words") < 20),
}


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of one whole text. Words are runs without ASCII white space; lines are parted by line feeds."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    solid = np.frombuffer(raw.translate(None, WHITE), np.int8)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        reach = 0
        for k, w in enumerate(windows):
            if often[w] > 1:
                repeated += k + 3 - max(k, reach)
                reach = k + 3
    letters = ((solid >= 65) & (solid <= 90)) | ((solid >= 97) & (solid <= 122)) | (solid < 0)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n))
    with_letter = np.add.reduceat(letters, ends - np.fromiter(map(len, words), np.int64, n)) > 0
    return (
        n,
        len(lines),
        int((solid > -65).sum()),  # without the continuation bytes of UTF-8
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        sum(map(STOP_WORDS.__contains__, raw.lower().split())),
        int(with_letter.sum()),
        int(((solid >= 65) & (solid <= 90)).sum()),
        raw.count(b"!!"),
        sum(x.rstrip(WHITE).endswith((b".", b"!", b"?", b":", b'"', b"'")) for x in lines),
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and COUNTS of every row; null texts count as empty."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [counts(x or "") for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "text_hash", *COUNTS]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, FEATURES)


def estimate(patterns: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, dict]:
    """Posterior of good for each row of ``patterns`` (votes), and what was estimated.

    Each rule has, for good and for bad documents, its own chances of voting good, bad and abstaining. The start is the
    mean vote, in which a bad vote weighs OBJECTION good ones, as rules abstain where they doubt; chances are smoothed as if one document of each kind had been seen, and a rule is never believed to vote
    against its meaning: its good votes speak for good, its bad votes for bad, or not at all.
    """
    if not len(patterns):
        return np.zeros(0), {"prior": 0.5, "chances": np.zeros((0, 2, 3))}
    n_rules = patterns.shape[1]
    shown = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    voted = np.maximum(1, (patterns != 0).sum(1))
    good = np.clip(0.5 + 0.45 * np.where(patterns < 0, OBJECTION * patterns, patterns).sum(1) / voted, 0.05, 0.95)
    prior, log_odds = 0.5, np.zeros((n_rules, 3))
    chances = np.zeros((n_rules, 2, 3))
    for _ in range(rounds):
        prior = (weights @ good + 1) / (weights.sum() + 2)
        for y, share in ((1, good), (0, 1 - good)):
            seen = np.einsum("p,prv->rv", weights * share, shown) + 1
            chances[:, y] = seen / seen.sum(1, keepdims=True)
        log_odds = np.log(chances[:, 1]) - np.log(chances[:, 0])
        log_odds[:, 0] = np.minimum(log_odds[:, 0], 0)
        log_odds[:, 1] = 0
        log_odds[:, 2] = np.maximum(log_odds[:, 2], 0)
        z = np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", shown, log_odds)
        new = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        if np.abs(new - good).max() < 1e-10:
            good = new
            break
        good = new
    return good, {"prior": prior, "chances": chances}


def judge(docs: DataFrame, rules: dict[str, Callable[[], Column]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Features of every row with n_words, base_failed, votes, quality (posterior) and kept.

    Null, empty and wordless texts fail at once; null ids stay null; repeated rows each give a row and each count in the
    estimate; an empty table gives no rows; columns other than doc_id and text are not read. Documents that fail at once
    take no part in the estimate.
    """
    spark = docs.sparkSession
    rules = rules or RULES
    names = [f"vote_{k}" for k in rules]
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    rows = features(docs)
    rows = cut(
        rows.withColumn("base_failed", (n < LEAST_WORDS) | (repeated > MOST_REPEATED * n)).withColumns(
            {f"vote_{k}": rule().cast("byte") for k, rule in rules.items()}
        )
    )
    # At most 3 ** len(rules) patterns, however many documents there are.
    seen = rows.filter(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    patterns = np.array([[r[k] for k in names] for r in seen], int).reshape(len(seen), len(names))
    quality, _ = estimate(patterns, np.array([r["n"] for r in seen], float))
    known = spark.createDataFrame(
        [(*map(int, p), float(q)) for p, q in zip(patterns, quality)], ", ".join(f"{k} byte" for k in names) + ", quality double"
    )
    judged = rows.join(F.broadcast(known), names, "left")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= threshold))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    kept = judge(docs, **options).filter("kept").select("doc_id", "text_hash").distinct()
    same_id = docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"])
    return docs.join(kept, same_id & F.xxhash64(docs["text"]).eqNullSafe(kept["text_hash"]), "left_semi")
