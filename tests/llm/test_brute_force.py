"""Whole small tables against SQL where it can say the operator, else against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import jaccard_join, lm_score
from larkspur.llm.queries import ORACLES, QUERIES
from larkspur.session import written
from tests.compare import differences, duck
from tests.llm.conftest import words_of

NO_SQL = {"op3_jaccard_join", "op4_toxicity", "op6_bpe_automaton", "op9_lm_scores"}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    words = words_of((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def near_components(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    sets, holders = {i: shingles(t) for i, t in rows}, collections.defaultdict(list)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sorted(sets.items()):
        for j, same in collections.Counter(j for s in own for j in holders[s]).items():
            if 100 * same >= 75 * (len(own) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert differences(spark, sf_dir, QUERIES[name], ORACLES[name], con) is None


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL and len(QUERIES) == 10


def test_near_copies(spark, sf_dir, con):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_jaccard_join"](spark, sf_dir).collect()}
    assert got == near_components(con.execute("SELECT doc_id, text FROM documents").fetchall())


def test_near_copies_of_all_sizes_and_distances(spark):
    """Families of edited copies, chains of them and passages that many share."""
    rng, rows = np.random.default_rng(3), []
    passage = [f"p{i}" for i in range(70)]
    for family in range(30):
        base = [f"f{family}w{j}" for j in range(int(rng.integers(3, 400)))]
        for _ in range(12):
            text = list(base)
            for at in rng.integers(0, len(text), int(rng.integers(0, max(2, len(text) // 18)))):
                text[at] = f"x{rng.integers(1 << 30)}"
            if rng.random() < 0.5:
                base = text  # a chain
            rows.append((len(rows), " ".join(text + (passage if family % 3 == 0 else []))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), nearest=1).collect()}
    assert got == near_components(rows)


def test_folded_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n, m in ((5, 9), (300, 260), (3000, 2500), (70, 400)):
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(1, 1 << 62, m - n // 2).astype(np.uint64)]))
        p, q = jaccard_join.fold(np.unique(a)), jaccard_join.fold(b)
        size = min(len(p), len(q))
        apart = np.unpackbits(jaccard_join.halve(p, size) ^ jaccard_join.halve(q, size)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_base_scores_and_counts(spark, sf_dir, con):
    texts = {i: words_of((t or "").translate(LOWER)) + [None] for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(w for i, words in texts.items() if not held[i] for w in words)
    total, kinds = sum(counts.values()), len(counts)
    got = QUERIES["op9_lm_scores"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        words = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words), sum(counts[w] > 0 for w in words), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words), rel_tol=1e-9)
        assert r.score < 0


def test_word_probabilities_sum_to_one():
    """Over all bytes that may come next the probabilities are those of eight binary choices: they sum to 1."""
    zeros, ones = (np.random.default_rng(k).integers(0, 50, lm_score.STARTS[-1]).astype(np.float32) for k in (1, 2))
    stretch, level, weights = lm_score._stretch(zeros, ones), lm_score._level(zeros + ones).astype(np.uint8), lm_score._first_weights()
    total = 0.0
    for byte in range(256):
        data = np.array([byte], np.uint8)
        log = np.zeros(1)
        for node, bit in lm_score._bits(data):
            at = [lm_score._slot(w, c, node).astype(np.int64) + lm_score.STARTS[w] for w, c in enumerate(lm_score._contexts(data, np.zeros(1, np.int64)))]
            mixing = weights[level[at[-2]].astype(np.int64) * lm_score.GATE + level[at[-1]]].astype(np.float32)
            logit = mixing[:, -1] + sum(mixing[:, w] * stretch[a] for w, a in enumerate(at))
            log -= np.log1p(np.exp(np.where(bit, -logit, logit)))
        total += float(np.exp(log)[0])
    assert abs(total - 1) < 1e-3


def test_toxicity_held_out_accuracy(spark):
    rows, labels = "/root/testdata/sf0.1/documents.parquet", "/root/testdata/sf0.1/labels.parquet"
    from larkspur.llm import toxicity

    docs, marks = spark.read.parquet(rows), spark.read.parquet(labels)
    got = toxicity.toxicity(docs, marks).join(marks.select("doc_id", "toxic"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    counts = {(r.toxic, r.predicted): r["count"] for r in got}
    assert counts.get((0, 1), 0) <= 0.01 * counts[0, 0] and counts.get((1, 0), 0) <= 0.15 * (counts[1, 1] + counts.get((1, 0), 0))


def test_pipeline_stages_against_their_own_input(spark, sf_dir, tmp_path):
    labels = f"CREATE VIEW labels AS SELECT * FROM '{sf_dir}/labels.parquet'"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, sf_dir))
        docs.write.parquet(f"{tmp_path}/{number}")
        con = duckdb.connect()
        con.execute(f"CREATE TABLE documents AS SELECT * FROM '{tmp_path}/{number}/*.parquet'")
        con.execute(labels)
        ask = lambda sql: con.execute(sql).fetchall()
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if number == 0:
            assert ids == sorted(i for (i,) in ask(f"SELECT doc_id FROM ({ORACLES['op2_quality_rules']}) WHERE kept"))
        elif number == 1:
            want = dict(ask(f"SELECT doc_id, kept_sha256 FROM ({ORACLES['op5_line_dedup']})"))
            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in out.collect()} == want
        elif number == 2:
            assert ids == sorted(i for i, (_, c) in near_components(ask("SELECT doc_id, text FROM documents")).items() if i == c or c is None)
        elif number == 3:
            want = [i for i, size, taken in ask(f"SELECT doc_id, size, taken FROM ({ORACLES['op8_mix_sources']})") for part in (min(size, taken), taken - size) if size and 2 * part >= size]
            taken = {i: t for i, _, t in ask(f"SELECT doc_id, size, taken FROM ({ORACLES['op8_mix_sources']})")}
            assert abs(len(ids) - len(want)) <= 20 and all(taken[i] > 0 for i in ids) and collections.Counter(ids).most_common(1)[0][1] <= 2
        else:
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = sorted((i, hashlib.sha256(" ".join(map(str, lib.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()) for i, t in ask("SELECT doc_id, text FROM documents"))
            assert sorted((r.doc_id, r.ids_sha256) for r in out.collect()) == want
        assert out.columns == (corpus_pipeline.COLUMNS if number < 4 else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        docs = out
