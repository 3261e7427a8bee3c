"""Awkward documents: nulls, empty and very long texts, ties, repeated rows, and extra columns named like internal ones."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, block long, `row` string, rep long, n long, `range` int, guest string, digest string, key string, page_id long"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijé") for _ in range(r.randint(2, 6))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (5, base), (9, base), (2, " ".join(near)), (7, None), (8, ""), (10, "   \n\t "), (11, "one"), (12, "one two"), (None, base), (None, None), (13, words(2, 80)), (13, words(2, 80)),
        (14, words(3, 40) + " " + " ".join(base.split()[20:60])), (15, words(4, 30_000)), (16, "x" * 300_000), (17, "dup line here\n" * 40), (18, "a b c d e " * 60), (19, "ünïcödé 日本語 😀 ▁ " + words(5, 70)), (13, words(6, 60)),
    ]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), 1, True, 3, "r", 4, 5, 6, "g", "d", "k", 7) for i, t in rows], SCHEMA)
