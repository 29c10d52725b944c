"""Small tables with the odd cases that every operator must take, and plain Python twins of shared rules."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    words = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiouéß')}{k % 7 or ''}" for k in range(vocabulary)]
    out = [rng.choice(words + ["the", "of", "and", "to"] * 40) for _ in range(n)]
    for k in range(9, n, 10):
        out[k] += "."
    lines = [" ".join(out[k : k + 40]).capitalize() + "." for k in range(0, n, 40)]
    return "\n".join(lines)


def rows(seed=5, n=40):
    """Ordinary texts, copies, near copies, and null, empty, blank, long and repeated rows."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        text = prose(rng, rng.randint(60, 220))
        out.append((k, text, "en", f"src{k % 4}", len(text)))
    text = out[3][1]
    out += [(n + k, text, "en", "src1", len(text)) for k in range(6)]  # copies
    out += [(n + 10 + k, text.replace("the", "thy", k % 2), "en", None, len(text)) for k in range(4)]  # near copies, no source
    long = prose(rng, 6000)
    out += [
        (n + 20, None, None, None, None),
        (n + 21, "", "en", "src0", 0),
        (n + 22, " \n\t \n", "en", "src0", 5),
        (n + 23, long, "en", "src2", len(long)),
        (n + 24, "one", "en", "src0", 3),
        (n + 24, "one", "en", "src0", 3),  # a repeated row
        (None, prose(rng, 80), "en", "src3", 0),
        (None, None, "en", "src3", 0),
        (n + 25, "😀 Ünïcode ΣΑΣ İ K  x y " * 30, "en", "Src0", 0),
    ]
    return out


def docs(spark, data=None, extra=True):
    """The rows as a table, with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    if not extra:
        return df
    from pyspark.sql import functions as F

    names = ["row", "words", "fp", "text_hash", "first", "line", "line_no", "key", "twin", "at", "kept", "id", "own", "news", "n_replaced"]
    return df.withColumns({c: F.lit(c) for c in names})
