"""Fixtures with what operators must bear: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, skey string, copies int, cls string, root string, shard int, kept boolean"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    long = prose(9, 30_000, 5000)
    texts = [
        (1, prose(1, 200)), (2, None), (3, ""), (4, "  \t\n "), (5, "one two"), (6, prose(1, 200)), (7, prose(1, 200)), (7, prose(1, 200)),
        (None, prose(2, 60)), (None, None), (8, long), (9, long + " tail"), (10, "É" * 50 + " ünïcödé   漢字 😀"), (11, "a b c d e f g h " * 40),
        (12, "word\n" * 30), (13, prose(3, 120) + "\n" + prose(4, 10)), (100, prose(3, 120) + "\n" + prose(5, 10)), (200, "\x00\x1f#*$ &|<>"), (200, prose(6, 90)),
    ]
    sources = ["a", None, "b", "a", "", "a", "c"]
    langs = ["en", "de", None, "en"]
    return [(d, t, langs[i % 4], sources[i % 7], i, i, "r", "s", 2, "c", "x", 0, False) for i, (d, t) in enumerate(texts)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
