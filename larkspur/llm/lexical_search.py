"""Ranked lexical search by dense blocked matrix products.

Items are taken in blocks of a bounded number of terms.  One pass over the documents keeps, in tiles of some hundred
documents, how often each has the block's terms; the counts of documents come from the tiles.  A second pass multiplies,
for each tile, the items' weights by the documents' impacts: both are compacted to the terms that the tile has and cut
so narrow that every partial sum of integers stays below 2^53, where float64 is exact.  Sums go on in 64-bit integers.  A
tile's best documents are cut at the score of the last one, so that all of equal score meet before ids decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Words, text_blocks, text_or_empty
from larkspur.session import written

TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block ends before it has more items or more (item, term) pairs than these; an item alone may have more.
BLOCK_ITEMS, BLOCK_PAIRS = 256, 32_768
#: Documents of a tile, terms multiplied at a time, bytes of text looked at together.
TILE_DOCS, TILE_TERMS, TEXT_BYTES = 512, 1024, 1 << 19
EXACT = 1 << 53
IMPACT = 1_000_000  # no impact reaches it
TILE_SCHEMA = "doc_id array<long>, n array<long>, sizes array<int>, terms array<int>, counts array<int>, seen array<int>, seen_in array<int>, n_docs long, n_terms long"
HIT_SCHEMA = "item_no long, doc_id long, score long"
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[b for lo, hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)) for b in range(lo, hi + 1)]] = True


@dataclass
class Block:
    """Terms of some items: hashes in order, bytes of each, and for each the items that have it."""

    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    items: np.ndarray  # numbers of the items
    pair_starts: np.ndarray  # pairs of term t: pair_items[pair_starts[t]:pair_starts[t + 1]]
    pair_items: np.ndarray  # places in ``items``


def make_block(rows: list[Row]) -> Block:
    """A block of rows (item_no, terms)."""
    vocabulary = sorted({t for r in rows for t in r.terms})
    data = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), table=_SEPARATOR)
    hashes = words.hashes()
    order = np.argsort(hashes)
    place = {vocabulary[j]: i for i, j in enumerate(order.tolist())}
    pairs = sorted((place[t], i) for i, r in enumerate(rows) for t in r.terms)
    terms = np.array([p[0] for p in pairs], np.int64)
    own = [vocabulary[j].encode() for j in order.tolist()]
    return Block(
        hashes[order], np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]), np.array([r.item_no for r in rows], np.int64),
        np.searchsorted(terms, np.arange(len(own) + 1)), np.array([p[1] for p in pairs], np.int64))


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each of some runs, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts; a longer text comes in parts cut after a separator."""
    for lo, hi, buf, offsets in text_blocks(texts, TEXT_BYTES):
        if len(buf) <= 2 * TEXT_BYTES:
            yield lo, hi, buf, offsets
            continue
        stops = np.flatnonzero(_SEPARATOR[buf]) + 1
        at = 0
        while at < len(buf):
            k = int(np.searchsorted(stops, at + TEXT_BYTES))
            end = int(stops[k]) if k < len(stops) else len(buf)
            yield lo, hi, buf[at:end], np.array([0, end - at])
            at = end


def look_up(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words that are terms of the block, and which; equal hashes count only with equal bytes."""
    hashes = words.hashes()
    at = np.minimum(np.searchsorted(block.hashes, hashes), len(block.hashes) - 1)
    which = np.flatnonzero(block.hashes[at] == hashes)
    term = at[which]
    sizes = words.ends[which] - words.starts[which]
    same = sizes == block.starts[term + 1] - block.starts[term]
    which, term, sizes = which[same], term[same], sizes[same]
    if len(which):
        differ = words.buf[_places(words.starts[which], sizes)] != block.data[_places(block.starts[term], sizes)]
        same = ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)
        which, term = which[same], term[same]
    return which, term


def _tile(ids: pa.Array, n: np.ndarray, key: np.ndarray, tf: np.ndarray, width: int) -> list:
    """One row of the tile table; key = document x width + term, in order."""
    doc, term = key // width, key % width
    seen, seen_in = np.unique(term, return_counts=True)
    return [ids, n, np.bincount(doc, minlength=len(n)), term, tf, seen, seen_in, int((n > 0).sum()), int(n.sum())]


def _one(value, kind: pa.DataType) -> pa.Array:
    """A column of one row: a number, or a list of them."""
    if isinstance(value, int):
        return pa.array([value], kind)
    values = value if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def tiles(docs: DataFrame, block) -> DataFrame:
    """Tiles of the documents: ids, numbers of terms, the block's terms with their counts, and sums over the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        width = len(own.hashes)
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 5, pa.int64(), pa.int64()]
        names = [c.split()[0] for c in TILE_SCHEMA.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(lo, TILE_DOCS)
                n, keys, counts = np.zeros(part.num_rows, np.int64), [], []
                for first, end, buf, offsets in _parts(part.column(1)):
                    words = Words(buf, offsets, lower=True, table=_SEPARATOR)
                    each = np.diff(words.first)
                    n[first:end] += each
                    if not width:
                        continue
                    which, term = look_up(own, words)
                    key, tf = np.unique(np.repeat(np.arange(first, end), each)[which] * width + term, return_counts=True)
                    keys.append(key)
                    counts.append(tf)
                key, back = np.unique(np.concatenate(keys or [np.empty(0, np.int64)]), return_inverse=True)  # parts of a long text meet
                tf = np.bincount(back, np.concatenate(counts or [np.empty(0)]), len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([_one(v, kind) for v, kind in zip(_tile(part.column(0), n, key, tf, max(width, 1)), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, TILE_SCHEMA)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of each count in a document of n terms, in 64-bit integers."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))


def tile_scores(block: Block, weights: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
    """Exact scores (items x documents) of one tile: products over slices of the terms that it has."""
    scores = np.zeros((len(block.items), n_docs), np.int64)
    order = np.argsort(term, kind="stable")
    doc, term, impact = doc[order], term[order], impact[order]
    present, first = np.unique(term, return_index=True)
    first = np.append(first, len(term))
    largest = int(weights[present].max(initial=1)) or 1
    step = max(1, min(TILE_TERMS, (EXACT - 1) // (largest * IMPACT)))
    for lo in range(0, len(present), step):
        own = present[lo : lo + step]
        sizes = block.pair_starts[own + 1] - block.pair_starts[own]
        left = np.zeros((len(block.items), len(own)))
        left[block.pair_items[_places(block.pair_starts[own], sizes)], np.repeat(np.arange(len(own)), sizes)] = np.repeat(weights[own], sizes)
        a, b = first[lo], first[min(lo + step, len(present))]
        right = np.zeros((len(own), n_docs))
        right[np.searchsorted(own, term[a:b]), doc[a:b]] = impact[a:b]
        scores += (left @ right).astype(np.int64)
    return scores


class Best:
    """The k best documents of each item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.item = self.score = self.ids = np.empty(0, np.int64)
        self.no_id = np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        floor = self.floor
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        item, at = np.nonzero(scores >= floor[:, None])  # all that are level with the last one as well
        if not len(item):
            return
        parts = (self.item, item), (self.score, scores[item, at]), (self.ids, ids[at]), (self.no_id, no_id[at])
        item, score, ids, no_id = (np.concatenate(p) for p in parts)
        order = np.lexsort((ids, no_id, -score, item))
        rank = np.arange(len(item)) - np.searchsorted(item[order], item[order])
        stays = order[rank < self.k]
        self.item, self.score, self.ids, self.no_id = item[stays], score[stays], ids[stays], no_id[stays]
        last = self.item[self.k - 1 :] == self.item[: max(len(self.item) - self.k + 1, 0)]  # the k-th of a full list
        at = np.flatnonzero(last) + self.k - 1
        self.floor[self.item[at]] = self.score[at]


def score_tiles(tiled: DataFrame, block, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_no, doc_id, score): the k best documents of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = block.value, weights.value
        best = Best(len(own.items), k)
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n", "sizes", "terms", "counts")]
            for i in range(batch.num_rows):
                ids, n, sizes, terms, counts = (c[i].values for c in columns)
                n, sizes, terms, counts = (x.to_numpy().astype(np.int64) for x in (n, sizes, terms, counts))
                if not len(terms):
                    continue
                doc = np.repeat(np.arange(len(n)), sizes)
                scores = tile_scores(own, w, doc, terms, impacts(counts, n[doc], n_docs, n_terms), len(n))
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(own.items[best.item]), pa.array(best.ids, mask=best.no_id), pa.array(best.score)], ["item_no", "doc_id", "score"])

    return tiled.select("doc_id", "n", "sizes", "terms", "counts").mapInArrow(run, HIT_SCHEMA)


def blocks_of(sizes: Iterator[Row]) -> Iterator[tuple[int, int]]:
    """Ranges of item numbers, from rows (item_no, size) in their order; nothing but the open range is held."""
    first = last = None
    items = pairs = 0
    for r in sizes:
        if first is not None and (items == BLOCK_ITEMS or pairs + r.size > BLOCK_PAIRS):
            yield first, last
            first, items, pairs = None, 0, 0
        first, last = (r.item_no if first is None else first), r.item_no
        items, pairs = items + 1, pairs + r.size
    if first is not None:
        yield first, last


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item with a score above 0: item_id, rank, doc_id, score.

    Each row of ``items`` (item_id, text) is an item of its own, each row of ``docs`` (doc_id, text) a document of its
    own, so repeated rows take ranks of their own.  A null or empty text has no terms: it is found by nothing and finds
    nothing.  Equal scores rank by ascending doc_id, null ids last.  Other columns are ignored; without documents or
    items there are no rows.
    """
    terms = F.array_distinct(F.regexp_extract_all(F.translate(text_or_empty(), UPPER, LOWER), F.lit(TERM), F.lit(1)))
    asked = written(items.select(F.monotonically_increasing_id().alias("item_no"), "item_id", terms.alias("terms")).filter(F.size("terms") > 0))
    context = docs.sparkSession.sparkContext
    hits = docs.sparkSession.createDataFrame([], HIT_SCHEMA)
    for first, last in blocks_of(asked.select("item_no", F.size("terms").alias("size")).orderBy("item_no").toLocalIterator()):
        block = make_block(asked.filter(F.col("item_no").between(first, last)).orderBy("item_no").select("item_no", "terms").collect())  # bounded, see above
        shared = context.broadcast(block)
        tiled = written(tiles(docs, shared))
        n_docs, n_terms = tiled.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        seen = tiled.select(F.explode(F.arrays_zip("seen", "seen_in")).alias("x")).groupBy("x.seen").agg(F.sum("x.seen_in").alias("df"))
        weights = np.zeros(len(block.hashes), np.int64)
        for r in seen.collect():  # at most the block's terms
            weights[r.seen] = term_weight(n_docs, r.df)
        found = score_tiles(tiled, shared, context.broadcast(weights), n_docs, n_terms, k)
        hits = hits.unionByName(written(found))
    order = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")


QUERY = {"op12_lexical_search": lambda spark, sf_dir: search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))}

ORACLE = {
    "op12_lexical_search": r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
item AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark, low
),
token AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents, low),
tf AS (SELECT doc_id, term, count(*) AS tf FROM token GROUP BY doc_id, term),
doc AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM doc),
weight AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM item) GROUP BY term) t, total
),
score AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
    FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN doc USING (doc_id), total
    GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
}
