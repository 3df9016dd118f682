"""Awkward documents: nulls, blanks, very long texts, ties, repeated rows, columns that clash with results."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words bigint, labels string"


def words(n, seed=0, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward(spark):
    base = words(400, 1)
    near = base.split()
    near[7] = "changed"
    texts = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \t\n \x0b\n"),
        (7, words(40_000, 2)),
        (8, "short text"),
        (9, "é à ü ß 漢字 🎉 " * 30),
        (None, words(60, 3)),
        (None, None),
        (10, "one\ntwo\nthree\nfour\n" * 6),
        (10, "one\ntwo\nthree\nfour\n" * 6),
    ]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s" if i != 3 else None, 1, 0.5, 7, "x") for i, t in texts], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
