"""A small table of documents with every odd case, and columns whose names the operators use themselves."""

import random

from pyspark.sql import functions as F

VOCABULARY = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ré") for b in ("ra", "sto", "tin", "ve", "zy", "")]
EXTRA = ("id", "bucket", "n_words", "k1", "copy", "place", "judged", "cut", "h", "component", "words", "label")


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def documents():
    rng = random.Random(5)
    passage, base = prose(rng, 70), prose(rng, 120)
    words = base.split()
    near = [" ".join(words[:i] + [rng.choice(VOCABULARY)] + words[i + 1 :]) for i in (3, 40, 90, 100)]
    texts = [
        base, *near, base, base.upper(), passage, prose(rng, 30) + " " + passage + "\n" + prose(rng, 40), prose(rng, 20) + "\t" + passage,
        passage + " " + passage, "", None, "   \n\t ", "one two", "one two", "One TWO", prose(rng, 49), prose(rng, 50), "x " * 200,
        "\n".join(["the same line here"] * 12), prose(rng, 6000), prose(rng, 3000) + " " + passage + " " + prose(rng, 3000),
        "a" * 300, "é" * 120, "word " * 60 + passage, " ".join(w + "$$$" for w in prose(rng, 90).split()), "\0 zero \0 bytes \0",
    ]
    rows = list(enumerate(texts))
    rows += [(None, base), (None, None), rows[7], rows[7], rows[11]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None, **names):
    """The rows as a table; ``names`` renames its two columns."""
    df = spark.createDataFrame(documents() if rows is None else rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({c: F.lit(c) for c in EXTRA})
    return df.withColumnsRenamed(names)


def by_id(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(tuple(row)[1:])
    return out
