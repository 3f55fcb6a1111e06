"""Removal of long repeated passages by recompression.

Rounds of pair naming shrink every text's word sequence.  A symbol's name is a hash of what it stands for, so a name
means the same everywhere without a dictionary.  In a round each symbol is a left or a right one by a bit of its name,
and a left one followed by a right one becomes a new symbol.  Whether two symbols join depends on them alone, so two
copies of a passage are parsed alike except near their ends: a round can spoil one symbol at either end, hence after R
rounds at most 2^R - 1 words there.  Equal neighbours never join (a run's length in a passage depends on where the
passage is cut): a run stays a run of one name.

So every repeated window of ``width`` words has, in both copies and at the same place among its first 2^R words, the
start of a high-level symbol, with ``width - 2^R + 1`` words of the window behind it.  The words from each such start
are hashed and counted; windows round the starts that come twice are hashed and counted in turn, which verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import PACKED_SCHEMA, Packer, Words, input_tasks, mix64, pack_places, partitions, rolling, sequence_names, text_blocks, unpack, unpack_places
from larkspur.session import written

WIDTH = 35
ROUNDS = 4
_SECOND_BASE = 0x9FB21C651E98DF25
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
TEXT_SCHEMA = "doc_id long, name long, n_words long, words_sha256 string"


def symbol_starts(hashes: np.ndarray, text_of: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Word places at which the symbols start after some rounds over consecutive texts."""
    names, at, text = hashes, np.arange(len(hashes)), text_of
    for r in range(rounds):
        right = (mix64(names + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        joins = np.flatnonzero(~right[:-1] & right[1:] & (text[:-1] == text[1:]))
        joined = names.copy()
        joined[joins] = mix64(names[joins] * np.uint64(0xC2B2AE3D27D4EB4F) + mix64(names[joins + 1]) + np.uint64(r))
        keep = np.ones(len(names), bool)
        keep[joins + 1] = False
        names, at, text = joined[keep], at[keep], text[keep]
    return at


def _blocks(batches: Iterator[pa.RecordBatch], text: int):
    for batch in batches:
        for lo, hi, buf, offsets in text_blocks(batch.column(text)):
            words = Words(buf, offsets)
            hashes = words.hashes()
            yield batch, lo, hi, buf, words, hashes, sequence_names(words.first, hashes), np.repeat(np.arange(hi - lo), np.diff(words.first))


def _joined(words: Words, data: bytes, lo: int, hi: int, keep: np.ndarray | None = None) -> str:
    """SHA-256 of the words lo:hi (those of ``keep``), joined by spaces."""
    if keep is None:
        return hashlib.sha256(b" ".join(data[words.starts[lo] : words.ends[hi - 1]].split()) if hi > lo else b"").hexdigest()
    return hashlib.sha256(b" ".join([data[a:b] for a, b in zip(words.starts[lo:hi][keep], words.ends[lo:hi][keep])])).hexdigest()


def _seeds(buckets: int, width: int, rounds: int):
    span = width - (1 << rounds) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(buckets), set()
        for _, _, _, _, words, hashes, names, text_of in _blocks(batches, 1):
            new = np.zeros(len(names), bool)
            for i, name in enumerate(names.tolist()):
                if name not in seen:
                    seen.add(name)
                    new[i] = True
            key, second = rolling(hashes, span), rolling(hashes, span, _SECOND_BASE)
            at = symbol_starts(hashes, text_of, rounds)
            at = at[new[text_of[at]] & (at + span <= words.first[1:][text_of[at]])]
            yield from packer.add(second[at] % np.uint64(buckets), key[at], at - words.first[text_of[at]], names[text_of[at]])
        yield from packer.flush()

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lo, hi, buf, words, _, names, _ in _blocks(batches, 1):
        data, first = buf.tobytes(), words.first
        shas = [_joined(words, data, first[i], first[i + 1]) for i in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names.view(np.int64)), pa.array(np.diff(first)), pa.array(shas)], ["doc_id", "name", "n_words", "words_sha256"])


def _repeated(buckets: int):
    """Of a bucket's entries those whose key is at two places or more, packed for the buckets of their texts.

    The bucket comes from another hash of the same words, so equal keys of a bucket agree in both.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key, place, text = unpack(frame["keys"], frame["places"], frame["texts"], frame["counts"])
        order = np.argsort(key, kind="stable")
        key, place, text = key[order], place[order], text[order]
        where = mix64(text + mix64(place.astype(np.uint64)))
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        twice = np.repeat(np.minimum.reduceat(where, edges) != np.maximum.reduceat(where, edges), np.diff(edges, append=len(key)))
        place, text = place[twice], text[twice]
        order = np.argsort(text, kind="stable")
        place, text = place[order], text[order]
        return pd.DataFrame(pack_places((mix64(text) % np.uint64(buckets)).astype(np.int64), place, text), columns=["bucket", "places", "texts", "counts"])

    return run


def _by_text(frame: pd.DataFrame) -> pd.DataFrame:
    """A row for each text of a bucket with all its places, as many as words at most."""
    place, text = unpack_places(frame["places"], frame["texts"], frame["counts"])
    order = np.lexsort((place, text))
    place, text = place[order], text[order]
    at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    return pd.DataFrame({"name": text[at].view(np.int64), "places": [p.astype(np.uint32).tobytes() for p in np.split(place, at[1:])]})


def _repeated_places(packed: DataFrame, buckets: int) -> DataFrame:
    """(name, places): the places of each text whose key is at another place too."""
    found = packed.groupBy("bucket").applyInPandas(_repeated(buckets), "bucket long, places binary, texts binary, counts binary")
    return found.groupBy("bucket").applyInPandas(_by_text, "name long, places binary")


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, name, places) for rows ``wanted`` (doc_id, name, places)."""
    ids = wanted.select(F.col("doc_id").alias("_id"), "name", "places")
    return docs.select(F.col("doc_id").cast("long"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "name", "places")


def _own(batches: Iterator[pa.RecordBatch]):
    """Texts with their places; rows that share a doc_id with the text meant are passed over."""
    for batch, lo, hi, buf, words, hashes, names, text_of in _blocks(batches, 1):
        wanted = batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        places = batch.column(3)
        own = {i: np.unique(np.frombuffer(places[lo + i].as_buffer(), np.uint32)).astype(np.int64) for i in np.flatnonzero(wanted == names)}
        yield batch, lo, buf, words, hashes, names, own


def _windows(buckets: int, width: int, rounds: int):
    back = (1 << rounds) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for _, _, _, words, hashes, names, own in _own(batches):
            key, second = rolling(hashes, width), rolling(hashes, width, _SECOND_BASE)
            for i, seeds in own.items():
                lo, n = words.first[i], words.first[i + 1] - words.first[i] - width + 1
                if n <= 0:
                    continue
                cover = np.zeros(n + back + 2, np.int32)
                np.add.at(cover, np.minimum(np.maximum(seeds - back, 0), n), 1)
                np.add.at(cover, np.minimum(seeds, n - 1) + 1, -1)
                at = np.flatnonzero(np.cumsum(cover[:n]) > 0)
                yield from packer.add(second[lo + at] % np.uint64(buckets), key[lo + at], at, np.full(len(at), names[i]))
        yield from packer.flush()

    return run


def _spans(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, buf, words, _, names, own in _own(batches):
            data, rows = buf.tobytes(), []
            for i, starts in own.items():
                lo, hi = words.first[i], words.first[i + 1]
                edges = np.zeros(hi - lo + 1, np.int32)
                edges[starts] += 1
                edges[starts + width] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                ends = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                rows.append((names[i : i + 1].view(np.int64)[0], int(gone.sum()), _joined(words, data, lo, hi, ~gone), ends.reshape(-1, 2).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["name", "n_removed", "kept_sha256", "removed"])

    return run


def repeated_passages(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and ``removed``, the stretches of words taken out.

    A word goes if a window of ``width`` words that covers it starts at another place too, in any document.  Texts with
    equal words are one text here; if there are two or more of them, all their words go (``width`` words or more).  A
    null text is empty.  Texts shorter than a window lose nothing.  Repeated rows are copies of each other; null and
    repeated ids are allowed.  Other columns are ignored; an empty table gives no rows.
    """
    if width < 1 << rounds:
        raise ValueError("a window must be longer than a symbol")
    spark = docs.sparkSession
    buckets = max(partitions(spark), 2 * input_tasks(docs))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    texts = written(rows.mapInArrow(_texts, TEXT_SCHEMA))
    distinct = texts.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))

    seeds = _repeated_places(rows.mapInArrow(_seeds(buckets, width, rounds), PACKED_SCHEMA), buckets)
    seeded = written(seeds.join(distinct, "name"))
    windows = _repeated_places(_with_texts(rows, seeded).mapInArrow(_windows(buckets, width, rounds), PACKED_SCHEMA), buckets)
    once = seeded.where("copies = 1").select("name", "doc_id")
    cut = _with_texts(rows, windows.join(once, "name")).mapInArrow(_spans(width), "name long, n_removed long, kept_sha256 string, removed array<array<long>>")

    several = distinct.where("copies > 1").select("name", F.lit(True).alias("several"))
    whole = F.coalesce(F.col("several"), F.lit(False)) & (F.col("n_words") >= width)
    everything = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    return (
        texts.join(several, "name", "left").join(cut, "name", "left")
        .select(
            "doc_id", "n_words",
            F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
            F.when(whole, everything).otherwise(F.coalesce("removed", F.array().cast("array<array<long>>"))).alias("removed"),
        )
    )


QUERY = {"op10_substring_dedup": lambda spark, sf_dir: repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")}

ORACLE = {
    "op10_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT row, words, unnest(range(0, len(words) - {WIDTH - 1})) AS p FROM d WHERE len(words) >= {WIDTH}),
h AS (SELECT row, p, md5(array_to_string(words[p + 1:p + {WIDTH}], ' ')) AS h FROM x),
y AS (SELECT row, p FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT row, p + unnest(range({WIDTH})) AS p FROM y),
r AS (SELECT row, list(p) AS gone FROM g GROUP BY row),
w AS (SELECT row, doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS p FROM d),
k AS (SELECT w.row, string_agg(word, ' ' ORDER BY w.p) AS kept FROM w ANTI JOIN g ON w.row = g.row AND w.p = g.p GROUP BY w.row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (row) LEFT JOIN k USING (row)
"""
}
