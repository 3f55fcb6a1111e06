"""Whole jobs: what the operators once left out."""

from __future__ import annotations

import random
import textwrap

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import license_scan, lm_score


def test_held_out_text_scores_better_than_its_shuffled_copy(spark):
    draw = random.Random(1)
    follow = {f"w{i}": [f"w{draw.randrange(60)}" for _ in range(2)] for i in range(60)}

    def text() -> list[str]:
        words = [f"w{draw.randrange(60)}"]
        while len(words) < 40:
            words.append(draw.choice(follow[words[-1]]))
        return words

    rows = [(i, " ".join(text())) for i in range(300)]
    held = [r.id for r in spark.range(800).where(lm_score.is_held_out(F.col("id"), 7, 2)).collect()]
    copies = dict(zip([i for i in held if i < 300], [i for i in held if i >= 300]))
    for i, copy in copies.items():
        words = rows[i][1].split()
        rows.append((copy, " ".join(draw.sample(words, len(words)))))
    learnt = dict(zip([i for i in range(300) if i not in held][:10], [i for i in range(300, 800) if i not in held]))
    for i, copy in learnt.items():  # training texts are told apart as well: none is a history of itself
        words = rows[i][1].split()
        rows.append((copy, " ".join(draw.sample(words, len(words)))))
    score = {r.doc_id: r.score for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(score[i] > score[copy] + 10 for i, copy in learnt.items())
    assert len(copies) > 20 and all(score[i] > score[copy] + 10 for i, copy in copies.items())


def test_weights_of_histories_add_up_to_one():
    weights = lm_score._proper(np.random.default_rng(3).random((lm_score.SEEN**2, 3)) + 0.1)
    assert np.allclose(weights.sum(axis=1), 1) and not weights[: lm_score.SEEN, 1].any() and not weights[:: lm_score.SEEN, 2].any()


def test_near_copy_stage_keeps_one_row_of_each_group_whatever_its_id(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(1, text["a"]), (1, text["b"]), (2, text["c"]), (3, text["c"] + " tail"), (3, text["d"]), (None, text["a"] + " tail"), (None, "alone with no id at all"), (None, "alone with no id at all"), (7, ""), (7, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copy_stage(spark, docs, "").collect()]
    want = [(1, text["a"]), (1, text["b"]), (2, text["c"]), (3, text["d"]), (None, "alone with no id at all"), (7, ""), (None, None), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_wrapped_notices_are_compared_as_a_whole(spark):
    mit, gpl = (next(t for name, t in reversed(license_scan.TEMPLATES) if name == kind) for kind in ("MIT", "GPL-3.0"))
    wrap = lambda text, width, mark, gap="\n": gap.join(mark + line for line in textwrap.wrap(text, width))
    notices = [(name, wrap(text, width, mark, gap)) for name, text in (("MIT", mit), ("GPL-3.0", gpl)) for width in (40, 50, 60) for mark, gap in (("", "\n"), ("# ", "\n#\n"), (" * ", "\n\n"))]
    rows = [(i, "first line\n" + text + "\nlast line", f"/{i}") for i, (_, text) in enumerate(notices)] + [(100 + i, "plain prose\nwithout a notice", "/plain") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: r for r in license_scan.license_scan(docs, F.col("path")).collect()}
    for i, (name, _) in enumerate(notices):
        assert (got[i].license, got[i].line) == (name, 1) and got[i].cosine > 0.9, (i, name, got[i])
    assert all(got[100 + i].license is None for i in range(30))
