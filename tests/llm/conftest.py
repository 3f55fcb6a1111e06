from __future__ import annotations

import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, key string, size string, words string, kept string, name int, start int, copies int, node int, n_lines string, shard string, rank int, place int"
PASSAGE = " ".join(f"w{i}" for i in range(60))


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    prose = [
        (1, "The cat sat.\nOn the mat it sat.\nAnd that was all there was to say about it on this day in May."),
        (2, "The  cat\tsat.\nOn the mat it sat.\nAnd that was all there was to say about it on this day in May."),
        (3, "The cat sat.\nOn the mat it sat.\nAnd that was all there was to say about it on this day in May."),
        (3, "The cat sat.\nOn the mat it sat.\nAnd that was all there was to say about it on this day in May."),
        (3, "other words under one id"), (None, "The cat sat."), (None, "The cat sat."), (None, None), (4, None), (5, ""), (6, " \n\t "), (7, "x"), (8, "X"),
        (9, PASSAGE + " tail one"), (10, "head two " + PASSAGE), (11, "a " * 50), (12, " ".join(f"v{i % 997}" for i in range(30000))),
        (13, "Licensed under the Apache License, Version 2.0.\n" + PASSAGE[:90]), (14, "don't stop <|endoftext|> ÉCOLE ΑΣ　日本語 \x1c end"), (15, "\n\n\nend\n"),
    ]
    langs, sources = ["en", None, "de"], ["a", "b", None, "c", "a", "a"]
    return [(i, t, langs[k % 3], sources[k % 6], None if k % 4 == 0 else 7, 1, "k", "s", "w", "no", 5, 6, 7, 8, "n", "s", 9, 10) for k, (i, t) in enumerate(prose)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def marks(spark):
    rows = [(1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 0, 1), (9, 0, 1), (10, 0, 1), (11, None, None), (None, 1, 1), (12, 1, 0), (12, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
