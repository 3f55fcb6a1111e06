"""Centroid clustering, lexical search and byte-level BPE against plain Python and the public library."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import byte_bpe, centroid_clustering, lexical_search

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
null_last = lambda i: (i is None, i or 0)


@pytest.fixture(scope="module")
def tok():
    with open(PATH, "rb") as file:
        return byte_bpe.tokenizer(file.read(), PATTERN)


@pytest.fixture(scope="module")
def library(tok):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tok.ranks, special_tokens={})


PIECES = st.sampled_from(["a", "b", "the", " ", "  ", "\n", "\t", "'", "s", "'re", "ll", "é", "Ä", "ª", "²", "\x85", "\xa0", "日本", "1", "23", "!", "…", "՘", "　", "x" * 40, "\x1c", "🙂", "<|endoftext|>"])
TEXTS = st.lists(PIECES | st.characters(codec="utf-8"), max_size=30).map("".join)


# --- byte-level BPE ------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_are_the_library_s(tok, library, text):
    ids = tok.encode(text)
    assert ids == library.encode_ordinary(text) and tok.decode(ids) == text.encode()
    assert tok.ids(tok.prefixes(text)) == ids


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 60), st.integers(0, 60), TEXTS)
def test_edited_tables_are_those_of_the_new_text(tok, text, start, size, replacement):
    start = min(start, len(text))
    got, _ = tok.edit(tok.prefixes(text), start, start + size, replacement)
    want = tok.prefixes(text[:start] + replacement + text[start + size :])
    assert (got.text, got.ends, got.tables) == (want.text, want.ends, want.tables)


def test_every_prefix_has_its_own_last_token(tok, library):
    for piece in (b" interoperability", "日本語日本語".encode(), b"aaaaaaaaaaaaa", b"ababababab"):
        table = tok.last_tokens(piece)
        for n in range(1, len(piece) + 1):
            whole = tok.merge(piece[:n])
            assert tok.label[table[n]] == whole[-1]
        assert tok.last_tokens(piece, table[:4]) == table


def test_pairs_stay_apart_as_the_merges_say(tok):
    rng = np.random.default_rng(3)
    for t, x in rng.integers(0, len(tok.ranks), (3000, 2)).tolist() + [(tok.ranks[b" th"], tok.ranks[b"e"]), (tok.ranks[b"a"], tok.ranks[b"aa"])]:
        assert tok.goes_on(t, x) == (tok.merge(tok.label[t] + tok.label[x]) == [tok.label[t], tok.label[x]])


def test_an_edit_computes_only_what_is_near(tok):
    text = " ".join(f"word{i} other" for i in range(5000))
    have = tok.prefixes(text)
    got, appended = tok.edit(have, len(text), len(text), "ed and on")
    assert appended <= 20 and tok.ids(got) == tok.encode(text + "ed and on")
    got, edited = tok.edit(have, 20000, 20004, "X")
    assert edited <= 60 and tok.ids(got) == tok.encode(text[:20000] + "X" + text[20004:])
    long = "ab" * 3000  # one piece: the entries before the edit stay
    assert tok.edit(tok.prefixes(long), 5990, 5991, "q")[1] <= 20


def test_windows_do_not_show(tok, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WINDOW", 7)
    for text in ("don't   stop  now\n\n  we'll go " * 20, "a" * 100, " " * 50 + "x", "日本語 " * 30, "it's'" * 9):
        assert tok.encode(text) == library.encode_ordinary(text)


def test_memory_starts_anew(tok, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    text = " ".join(f"w{i % 17}" for i in range(200))
    assert tok.encode(text) == library.encode_ordinary(text)


def test_byte_bpe_over_odd_rows(odd, odd_rows, empty, library):
    want = sorted((library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in odd_rows)
    got = byte_bpe.encode(odd, PATH, PATTERN, with_ids=True).collect()
    assert sorted((r.ids, bytes(r.decoded)) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert sorted((r.doc_id for r in got), key=null_last) == sorted((r[0] for r in odd_rows), key=null_last)
    assert byte_bpe.encode(empty, PATH, PATTERN).collect() == byte_bpe.prefix_tables(empty, PATH, PATTERN).collect() == []


def test_registered_query_over_the_whole_table(spark, sf_dir, library):
    from larkspur.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op13_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edits_of_a_table(spark, odd, library):
    rows = [(1, 1, None, None, " More."), (1, 2, 0, 3, "A"), (2, 1, 4, 9, None), (4, 1, 0, 0, "new"), (9, 1, 10**6, None, "s"), (99, 1, 0, 1, "none"), (None, 1, 0, 0, "x")]
    edits = spark.createDataFrame(rows, "doc_id long, edit_no int, start int, end int, replacement string")
    tables = byte_bpe.prefix_tables(odd, PATH, PATTERN)
    texts = Counter((r.doc_id, r.text) for r in tables.collect())
    got = byte_bpe.apply_edits(tables, edits, PATH, PATTERN).collect()
    change = {1: lambda t: "A" + (t + " More.")[3:], 2: lambda t: t[:4] + t[9:], 4: lambda t: "new" + t, 9: lambda t: t + "s"}
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, change.get(i, str)(t)) for (i, t), n in texts.items() for _ in range(n))
    assert all(r.ids == library.encode_ordinary(r.text) for r in got) and all(r.n_computed == 0 for r in got if r.doc_id not in change)


# --- lexical search ------------------------------------------------------------------------------------------


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = Counter(x for _, t in own for x in set(t))
    out = []
    for item_id, text in items:
        hits = []
        for doc_id, t in own:
            tf = Counter(t)
            m = 100 - 90 + (90 * len(t) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in set(terms(text)) if tf[x])
            if score > 0:
                hits.append((-score, null_last(doc_id), doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(hits, key=lambda h: h[:2])[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "The cat sat on the MAT"), (2, None), (3, ""), (4, "!?"), (5, "w3 w4 w5 tail zzz"), (5, "w3 w4 w5 tail zzz"), (6, "日本語 Αποκλειστικά don't"), (7, "x"), (None, "other words " * 3), (8, "v1 v2 v1 absent"), (9, "a")]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ITEMS": 2, "TILE_DOCS": 3, "TILE_TERMS": 2, "TEXT_BYTES": 64}, {"BLOCK_PAIRS": 4, "EXACT": 30_000_000_000}])
def test_search_against_plain_python(spark, odd, odd_rows, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical_search, name, value)
    items = spark.createDataFrame([(*i, "t", 1) for i in ITEMS], "item_id long, text string, term string, score int")
    got = lexical_search.search(odd, items, 3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search([(r[0], r[1]) for r in odd_rows], ITEMS, 3)


def test_equal_scores_go_by_id_wherever_they_are(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "TILE_DOCS", 4)
    docs = spark.createDataFrame([(i, "one two three" if i % 3 else "four") for i in range(60, 0, -1)], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "two")], "item_id int, text string")
    assert [(r.rank, r.doc_id) for r in lexical_search.search(docs, items, 5).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 4), (4, 5), (5, 7)]


def test_search_without_documents_or_items(spark, empty, odd):
    items = spark.createDataFrame([(1, "two")], "item_id int, text string")
    assert lexical_search.search(empty, items).collect() == lexical_search.search(odd, items.limit(0)).collect() == []


def test_products_are_exact_at_the_bound():
    n = 700
    block = lexical_search.Block(np.arange(n, dtype=np.uint64), np.empty(0, np.uint8), np.zeros(n + 1, np.int64), np.array([0]), np.arange(n + 1), np.zeros(n, np.int64))
    weights, impact = np.full(n, 24_999_999, np.int64), np.full(n, 999_983, np.int64)
    scores = lexical_search.tile_scores(block, weights, np.zeros(n, np.int64), np.arange(n), impact, 1)
    assert int(scores[0, 0]) == n * 24_999_999 * 999_983 > 1 << 53


def test_equal_hashes_need_equal_bytes():
    from larkspur.llm.common import Words

    block = lexical_search.make_block([lexical_search.Row(item_no=0, terms=["abc", "xyz"])])
    data = np.frombuffer(b"abc abd xyz", np.uint8)
    words = Words(data, np.array([0, len(data)]), table=lexical_search._SEPARATOR)
    assert sorted(lexical_search.look_up(block, words)[0].tolist()) == [0, 2]
    block.data = np.frombuffer(b"abqxyz" if bytes(block.data[:3]) == b"abc" else b"xyzabq", np.uint8)
    assert lexical_search.look_up(block, words)[0].tolist() == [2]


# --- centroid clustering -------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, seed="2"):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) and abs(v) < 1 << 19 for v in x):
            kept.append((i, [math.floor(256 * v) for v in x]))
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs)]
    own = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in own:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in own), key=repr)


def odd_vectors(n=160):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 64)) * 2
    rows = [(i, [float(np.float32(v)) for v in centres[i % 6] + rng.normal(size=64) * 0.1]) for i in range(n)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (None, rows[0][1]), (900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 65), (904, [None] + [0.0] * 63)]
    rows += [(905, [math.nan] + [0.0] * 63), (906, [math.inf] + [0.0] * 63), (907, [1e30] + [0.0] * 63), (908, [-0.001] * 64), (909, [0.0] * 64), (910, [500000.0] * 64), (911, [-500000.0] * 64)]
    return rows


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (7, 3), (400, 2), (1, 1)])
def test_clusters_against_plain_python(spark, k, rounds):
    rows = odd_vectors()
    frame = spark.createDataFrame([(i, x, "l", 1) for i, x in rows], "vec_id long, embedding array<float>, cluster string, vec int").repartition(3)
    got = centroid_clustering.cluster(frame, k, rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, k, rounds)


def test_no_vector_is_kept(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert centroid_clustering.cluster(frame).collect() == centroid_clustering.cluster(frame.limit(0)).collect() == []


def test_equal_vectors_are_one_cluster(spark):
    frame = spark.createDataFrame([(i, [0.5] * 64) for i in range(50)], "vec_id long, embedding array<float>")
    assert {(r.cluster, r.distance) for r in centroid_clustering.cluster(frame).collect()} == {(0, 0)}


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (30, 64))
    vectors = (centres[rng.integers(0, 30, 2000)] + rng.integers(-15, 16, (2000, 64))).astype(np.int64)
    vectors[:50] = centres[rng.integers(0, 30, 50)]  # on a centroid, where bounds are tight
    pivots = centroid_clustering.choose_pivots(centres)
    r, near = centroid_clustering.make_round(centres, pivots), centroid_clustering.pivot_distances(vectors, pivots)
    exact = np.stack([centroid_clustering.squared(vectors, c) for c in centres], axis=1)
    assert (centroid_clustering.lower_bounds(r, near) <= exact).all()
    cluster, distance, measured = centroid_clustering.assign(r, vectors, near)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert measured < len(vectors) * len(centres) / 2


# --- single long lines in line dedup -------------------------------------------------------------------------


def test_single_lines_of_fifty_words_are_runs(spark):
    from larkspur.llm import line_dedup

    long, almost, short = " ".join(f"p{i}" for i in range(50)), " ".join(f"verylongword{i}" for i in range(49)), "short line"
    rows = [
        (1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\nd"), (3, long), (4, f"{almost}\ne"), (5, f"{almost}\nf"), (6, f"g\n{short}\nh"),
        (7, "  ".join(f"q{i}" for i in range(60))), (7, "  ".join(f"q{i}" for i in range(60))), (8, f"{long} \ni"), (None, long),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text, r.n_removed, r.longest_run) for r in line_dedup.line_dedup(docs).collect()), key=str)
    want = [(i, t, 0, 0) for i, t in rows]
    want[1], want[2], want[9] = (2, "c\nd", 1, 1), (3, "", 1, 1), (None, "", 1, 1)
    want[7] = (7, "", 1, 1)
    assert got == sorted(want, key=str)
