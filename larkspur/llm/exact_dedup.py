"""Exact deduplication against a minimal perfect hash over the distinct digests of earlier documents.

The index is a table with one row per digest bucket.  A bucket holds the bit arrays of a minimal perfect hash and, by
slot, the full 32-byte digest, the locator (doc_id) of the row that stays and the number of rows seen.  A lookup
computes the slot and compares all digest bytes, so a digest that is not in the index is never taken for a member.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import SPACE, mix64, partitions, text_or_empty
from larkspur.session import written

INDEX_SCHEMA = "bucket long, n long, level_bits array<long>, bits binary, digests binary, locators binary, counts binary"
CLASS_SCHEMA = "digest binary, keep_id long, group_size long, in_history boolean"
NO_ID = np.iinfo(np.int64).max


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole normalised text; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(normalised(text_or_empty()).cast("binary"), 256)).alias("digest"))


# --- minimal perfect hash of one bucket ----------------------------------------------------------------------


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Positions of the digests (rows of four 64-bit words) in the bit array of a level."""
    x = mix64(keys[:, 0] + np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64)))
    for word in range(1, 4):
        x = mix64(x ^ keys[:, word])
    return (x % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Cascading bit arrays: a key that is alone at its position of a level gets that bit, the others go on."""
    sizes, parts = [], []
    while len(keys):
        size = max(64, 2 * len(keys))
        at = _place(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        parts.append(alone)
        keys = keys[~alone[at]]
    return sizes, np.concatenate(parts) if parts else np.empty(0, bool)


def slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key, the rank of its bit; -1 where no level has a bit for it."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = start + _place(keys[left], level, size)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + size
    return out


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, 4)


def _ids(column: pd.Series) -> np.ndarray:
    return column.astype("Int64").fillna(NO_ID).to_numpy(np.int64)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(frame["digest"])
    sizes, bits = build_hash(keys)
    order = np.argsort(slots(keys, sizes, bits))
    return pd.DataFrame({
        "bucket": [int(frame["bucket"].iloc[0])], "n": [len(frame)], "level_bits": [sizes], "bits": [np.packbits(bits).tobytes()],
        "digests": [keys[order].tobytes()], "locators": [_ids(frame["keep_id"])[order].tobytes()], "counts": [frame["group_size"].to_numpy(np.int64)[order].tobytes()],
    })


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Classes of one bucket: every slot of the index with what was added to it, then the digests that are new."""
    keys, ids, counts = _keys(new["digest"]), _ids(new["keep_id"]), new["group_size"].to_numpy(np.int64)
    member = np.zeros(len(keys), bool)
    parts = []
    if len(index):
        row = index.iloc[0]
        sizes = [int(x) for x in row["level_bits"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        keep, total = np.frombuffer(row["locators"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
        at = slots(keys, sizes, bits)
        member = (at >= 0) & (held[np.maximum(at, 0)] == keys).all(axis=1)
        at = at[member]  # distinct digests, so distinct slots
        keep[at] = np.minimum(keep[at], ids[member])
        total[at] += counts[member]
        parts.append((held, keep, total, True))
    parts.append((keys[~member], ids[~member], counts[~member], False))
    frames = [
        pd.DataFrame({"digest": [k.tobytes() for k in ks], "keep_id": pd.array(np.where(w == NO_ID, 0, w), dtype="Int64"), "group_size": c, "in_history": h}).assign(keep_id=lambda f, w=w: f["keep_id"].mask(w == NO_ID))
        for ks, w, c, h in parts
    ]
    return pd.concat(frames, ignore_index=True)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def n_buckets(rows: DataFrame, bucket_rows: int) -> int:
    return max(partitions(rows.sparkSession), -(-rows.count() // bucket_rows))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Index of the distinct digests of ``history`` (doc_id, digest), one row per bucket.

    Rows are counted before they are shuffled, so a digest that a third of all rows share is one row per task.
    """
    return _bucketed(_grouped(history), buckets).groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA)


def classify(index: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """Classes (digest, keep_id, group_size, in_history) of the indexed digests and of the rows ``new``."""
    asked = _bucketed(_grouped(new), buckets)
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_look_up, CLASS_SCHEMA)


def exact_dedup(docs: DataFrame, bucket_rows: int = 200_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, in_history.

    The older half of the id range is the history, later documents (and those without an id) are looked up in it.
    Of equal texts the smallest doc_id stays.  A null text is empty, empty texts are equal to each other.  A null
    doc_id stays only if its whole group has none; of rows that repeat both id and text, one is kept.  Other columns
    are ignored; an empty table gives no rows.
    """
    rows = written(digests(docs))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = (low + high) // 2 if low is not None else 0
    old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    buckets = n_buckets(rows, bucket_rows)
    classes = classify(build_index(rows.where(old), buckets), rows.where(~old), buckets)
    copies = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("_copies"))
    return (
        copies.join(classes, "digest")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        .select("doc_id", "keep_id", "group_size", ((F.col("_copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history")
    )


QUERY = {"op1_exact_dedup": lambda spark, sf_dir: exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("in_history")}

ORACLE = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
}
