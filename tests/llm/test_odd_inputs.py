"""Every operator over nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import json
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import bpe, exact_dedup, jaccard_join, license_scan, line_dedup, lm_score, mixing, quality, substring_dedup, toxicity
from tests.llm.conftest import PASSAGE, words_of

PATH = public_tokenizers.path("word_bpe_49k.json")
PER_DOCUMENT = {
    "exact": lambda d, m: exact_dedup.exact_dedup(d), "quality": lambda d, m: quality.quality_rules(d, m), "jaccard": lambda d, m: jaccard_join.near_copies(d),
    "toxicity": lambda d, m: toxicity.toxicity(d, m), "lines": lambda d, m: line_dedup.line_dedup(d), "bpe": lambda d, m: bpe.encode(d, PATH, True),
    "license": lambda d, m: license_scan.license_scan(d, F.col("source")), "mix": lambda d, m: mixing.mix(d), "lm": lambda d, m: lm_score.lm_scores(d),
    "passages": lambda d, m: substring_dedup.repeated_passages(d),
}


@pytest.mark.parametrize("name", sorted(PER_DOCUMENT))
def test_empty_table_gives_no_rows(empty, marks, name):
    assert PER_DOCUMENT[name](empty, marks).collect() == []


@pytest.mark.parametrize("name", sorted(PER_DOCUMENT))
def test_one_row_per_document_and_no_labels(odd, odd_rows, marks, name):
    got = PER_DOCUMENT[name](odd, marks.limit(0)).collect()
    key = lambda i: -1 if i is None else i
    assert sorted(key(r.doc_id) for r in got) == sorted(key(r[0]) for r in odd_rows)


def test_exact(odd, odd_rows):
    got = exact_dedup.exact_dedup(odd).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for i, t, *_ in odd_rows:
        groups.setdefault(norm(t), []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = [i for i in by_sha[r.text_sha256] if i is not None]
        assert (r.keep_id, r.group_size) == (min(ids, default=None), len(by_sha[r.text_sha256])) and (not r.kept or r.doc_id == r.keep_id)
    assert sum(r.kept for r in got) == len(groups)


def test_index_holds_full_digests_and_tells_strangers(spark):
    rows = spark.createDataFrame([(i, f"text {i % 500}") for i in range(1500)], "doc_id long, text string")
    index = exact_dedup.build_index(exact_dedup.digests(rows), 3).collect()
    assert sum(r.n for r in index) == 500 and all(len(r.digests) == 32 * r.n and len(r.locators) == 8 * r.n for r in index)
    new = spark.createDataFrame([(9000 + i, f"text {i}") for i in range(400, 600)], "doc_id long, text string")
    got = exact_dedup.classify(exact_dedup.build_index(exact_dedup.digests(rows), 3), exact_dedup.digests(new), 3).collect()
    assert sum(r.in_history for r in got) == 500 and sum(not r.in_history for r in got) == 100
    assert sum(r.group_size for r in got) == 1700 and {r.keep_id for r in got if r.in_history} == set(range(500))


def test_bpe_matches_the_library(odd, odd_rows):
    lib = Tokenizer.from_file(PATH)
    want = sorted((e.ids, lib.decode(e.ids, skip_special_tokens=False)) for e in lib.encode_batch([r[1] or "" for r in odd_rows], add_special_tokens=False))
    got = bpe.encode(odd, PATH, True).collect()
    assert sorted((r.ids, r.decoded) for r in got) == want
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in got)


def test_automaton_gives_the_merges_order():
    spec = json.loads(open(PATH, encoding="utf-8").read())
    automaton, ranks = bpe.tokenizer(json.dumps(spec)).automaton, {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
    vocab = spec["model"]["vocab"]
    for word in ["aaaa", "aaaaa", "abababab", "interoperability", "zzzzyx", "bananas", "thththe"]:
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            best = min((ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else (1 << 30, 0)
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        assert automaton.encode(word) == [vocab[p] for p in parts]


def test_mix(odd, odd_rows):
    got = mixing.mix(odd).collect()
    total = sum(len(words_of(r[1])) for r in odd_rows)
    assert all(0 <= r.taken <= 2 * r.size and r.taken == sum(p.taken for p in r.parts) for r in got)
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1
    for source, target in targets.items():
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 0.5
    again = mixing.mix(odd.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_get_equal_exact_counts(spark):
    counts = spark.createDataFrame([([40, 0, 7, 1000],)], "counts array<long>")
    shards = [r.counts for r in mixing.split_counts(counts, 6).collect()]
    assert [sum(c) for c in zip(*shards)] == [40, 0, 7, 1000] and {sum(s) for s in shards} <= {174, 175} and min(min(s) for s in shards) >= 0


def test_hypergeometric_draws_have_the_right_mean(spark):
    for total, marked, taken in ((50, 10, 20), (50, 40, 20), (50, 10, 40), (50, 45, 45), (9, 0, 4), (9, 9, 4)):
        drawn = spark.range(2000).selectExpr(mixing.hypergeometric(f"{total}L", f"{marked}L", f"{taken}L", "(id + 0.5D) / 2000D") + " AS x")
        low, high, mean = drawn.agg(F.min("x"), F.max("x"), F.avg("x")).first()
        assert max(0, taken + marked - total) <= low <= high <= min(marked, taken) and abs(mean - marked * taken / total) < 0.02


def test_binomial_tail_is_exact(spark):
    from math import comb

    for k, n, p in ((0, 10, 0.01), (2, 500, 0.01), (3, 40, 0.2), (40, 5000, 0.01)):
        got = spark.sql(f"SELECT {quality.binomial_tail('k', 'n', p)} FROM (SELECT {k}L AS k, {n}L AS n)").first()[0]
        assert abs(got - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_cutoffs_reject_bad_and_keep_good(spark):
    text = lambda i: " ".join(f"word{(i * 7 + j) % 1009}{'#$' if i % 4 == 0 else ''}" for j in range(40))
    docs = spark.createDataFrame([(i, text(i), "en", "s", 1) for i in range(3200)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(3200)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in got)


def test_lines(odd):
    got = {(r.doc_id, r.text): r for r in line_dedup.line_dedup(odd).collect()}
    first = [r for r in got.values() if r.doc_id == 1][0]
    assert first.n_removed == 0 and first.n_lines == 3
    assert [r.n_removed for r in got.values() if r.doc_id == 2] == [2]  # its first line differs
    assert {(None, None), (4, None), (5, ""), (6, " \n\t ")} <= set(got)


def test_line_runs_take_their_length_from_the_first_copy(spark):
    block = [f"line {i}" for i in range(9)]
    docs = spark.createDataFrame([(1, "\n".join(["a", *block, "b"])), (2, "\n".join(["c", *block[2:8], "d", "a"])), (3, "\n".join(block[:1]))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert (got[2].text, got[2].n_removed, got[2].longest_run) == ("c\nd\na", 6, 6) and got[1].n_removed == got[3].n_removed == 0
    three = {r.doc_id: r for r in line_dedup.line_dedup(docs, min_lines=7).collect()}
    assert three[2].n_removed == 0


def test_suffix_ranks_stop_when_all_are_settled(spark):
    docs = spark.createDataFrame([(1, "\n".join("abcdefgh")), (2, "\n".join("abcdefgx"))], "doc_id long, text string")
    rounds = line_dedup.suffix_ranks(line_dedup.line_sequence(docs, line_dedup.texts_in_order(docs)), 3)
    assert [(n, r.count()) for n, r in rounds] == [(1, 14), (2, 12), (3, 10), (4, 8)]


def test_licenses(spark):
    apache, text = "Licensed under the Apache License, Version 2.0.", "nothing here"
    rows = [(1, f"{text}\n{apache}", "a/b"), (2, text, "a/b/c/d"), (3, text, "a"), (4, "Released under the MIT License.", "a/b/c"), (5, None, "a/bc"), (6, text, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.license, r.from_directory) for r in license_scan.license_scan(docs, F.col("path")).collect()}
    assert got == {1: ("Apache-2.0", None), 2: ("MIT", "a/b/c"), 3: (None, None), 4: ("MIT", None), 5: (None, None), 6: (None, None)}


def test_passages(odd):
    got = {(r.doc_id, r.n_words): r for r in substring_dedup.repeated_passages(odd).collect()}
    assert got[9, 62].n_removed == got[10, 62].n_removed == 60
    assert got[9, 62].kept_sha256 == hashlib.sha256(b"tail one").hexdigest() and got[10, 62].removed == [[2, 62]]
    assert got[11, 50].n_removed == 50 and got[12, 30000].n_removed == 30000 and got[7, 1].n_removed == 0
    assert len(PASSAGE.split()) == 60


def test_toxicity_swaps_do_not_move_the_score(spark):
    filler = lambda i: " ".join(f"plain{(i * 31 + j) % 400}" for j in range(20))
    rows = [(i, filler(i) + (" you idiot women" if i % 5 == 1 and i % 2 else " you idiot" if i % 5 == 1 else " the men came" if i % 5 == 2 else ""), int(i % 5 == 1)) for i in range(1200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "the women came"), (2, "the men came"), (3, "you idiot"), (4, None)], "doc_id long, text string")
    score = lambda penalty: {r.doc_id: r.score for r in toxicity.score(probe, *toxicity.train(docs, labels, penalty=penalty)).collect()}
    free, held = score(0.0), score(50.0)
    assert abs(held[1] - held[2]) < abs(free[1] - free[2]) and held[1] < free[1] and held[3] > 0.5 > held[4]


def test_pipeline_runs_over_odd_rows(spark, odd, marks, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing", "BPE"]
