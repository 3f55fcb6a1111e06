"""N-gram Jaccard join with parity sketches.

A document is its set of word shingles.  Each shingle flips one bit of a long bit sketch, cut into blocks; two documents
whose sets differ in d shingles differ in at most d bits, so in at most d blocks.  Documents of 2^j to 2^(j+1) shingles
(and those below that can still reach a partner there) form a size band with one number of blocks.  Similarity at least
t bounds d by D = (1 - t) / (1 + t) * (sum of the sizes), so of a document's R blocks that are not empty a linked partner
has R - D or more.  Blocks meet by their contents; a document of which too few blocks are met by any other can have no
link and leaves.  The sketch is sparse and only its set bits are ever held; a block travels as a fingerprint of its bits.
Folded to as many bits as there are shingles, the sketch still bounds d from below, which drops pairs before their sets
are compared; with eight times the bits the bound is so close that hardly a pair without a link passes.

Links join documents to components.  Documents that share a block are first compared with one of them only (a star);
where that leaves several components within a block's documents, pairs across components are compared, nearest folded
sketches first, in tiles, until no candidate pair across components is left.  So no link between components is missed,
and near copies of each other are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import PACKED_SCHEMA, Packer, Words, arrow_batches, input_tasks, mix64, partitions, rolling, sequence_names, sums_before, text_blocks, unpack
from larkspur.session import written

SHINGLE = 5
PERCENT = 75
TILE = 2048
TEXT_SCHEMA = "doc_id long, node long, n_shingles long, folded binary"
GROUP_SCHEMA = "key long, keys long, nodes array<long>, needs array<long>"
#: Bytes of a key that travel beside its bucket; keys that only then look equal are told apart by the sets.
KEY_BYTES = 5
SET_SCHEMA = "node long, shingles binary"
#: Bytes of text hashed together, and texts of an Arrow batch: what a task holds in its worker and beside the heap.
TEXT_BYTES, BATCH_TEXTS = 1 << 18, 1000
#: Ids up to which those wanted are sent to every task instead of shuffling the texts.
FEW_IDS = 200_000
#: Bits a shingle of the sketches that are compared across components, and bytes of them compared at once.
FINE, COMPARED = 8, 1 << 22
#: Lists of nodes in a part that is searched for pairs across components.
LISTS = 2000
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def most_different(a, b, percent: int = PERCENT):
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (100 - percent) * (a + b) // (100 + percent)


def _shingles(batches: Iterator[pa.RecordBatch], width: int = SHINGLE):
    """Sorted distinct shingle hashes of consecutive texts: (batch, lo, hi, hashes, first, node names, extra)."""
    for batch in batches:
        for lo, hi, buf, offsets in text_blocks(batch.column(1), TEXT_BYTES):
            words = Words(buf, offsets, lower=True)
            hashes, n = words.hashes(), np.diff(words.first)
            text_of = np.repeat(np.arange(hi - lo), n)
            grams = rolling(hashes, width)
            text = text_of[: len(grams)]
            whole = np.arange(len(grams)) + width <= words.first[1:][text]
            grams, text = grams[whole], text[whole]
            short = np.flatnonzero((n > 0) & (n < width))
            grams, text = np.concatenate([grams, sequence_names(words.first, hashes)[short]]), np.concatenate([text, short])
            order = np.lexsort((grams, text))
            grams, text = grams[order], text[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
            grams, text = grams[new], text[new]
            first = np.searchsorted(text, np.arange(hi - lo + 1))
            yield batch, lo, hi, grams, text, first, sequence_names(first, grams)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lo, hi, grams, _, first, nodes in _shingles(batches):
        folded = [fold(grams[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(nodes.view(np.int64)), pa.array(np.diff(first)), pa.array(folded, pa.binary())], ["doc_id", "node", "n_shingles", "folded"])


def n_blocks(band: np.ndarray) -> np.ndarray:
    """Blocks of a band's sketches: enough that those not empty nearly always exceed the difference allowed."""
    low = np.int64(1) << band
    return np.where(low <= 16, 8 * low, np.where(low < 128, 2 * low, low))


def block_keys(grams: np.ndarray, text: np.ndarray, sizes: np.ndarray, band: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, need) of the blocks of the texts in a band each; ``text`` indexes ``sizes`` and ``band``.

    ``need`` is how many blocks a text shares with any linked partner at least.  Texts for which that says nothing have a
    key more, by which they meet each other, and need one.
    """
    blocks = n_blocks(band)[text]
    scrambled = mix64(grams ^ np.uint64(0x5851F42D4C957F2D))
    block = (scrambled % blocks.astype(np.uint64)).astype(np.int64)
    order = np.argsort((text.astype(np.int64) << 40) + block, kind="stable")
    at_text, at_block = text[order], block[order]
    edges = np.flatnonzero(np.concatenate([[True], (at_text[1:] != at_text[:-1]) | (at_block[1:] != at_block[:-1])])) if len(order) else np.empty(0, np.int64)
    content = np.bitwise_xor.reduceat(mix64(scrambled[order]), edges) if len(edges) else np.empty(0, np.uint64)
    own, block = at_text[edges], at_block[edges]
    largest = np.minimum(100 * sizes // percent, (np.int64(2) << band) - 1)
    need = np.bincount(own, minlength=len(sizes)) - most_different(sizes, largest, percent)
    key = mix64(content + mix64((block << 8).astype(np.uint64) + band[own].astype(np.uint64)))
    scarce = np.flatnonzero((need < 1) & (sizes > 0))
    need = np.maximum(need, 1)
    key, own = np.concatenate([key, mix64(band[scarce].astype(np.uint64))]), np.concatenate([own, scarce])
    order = np.argsort(own, kind="stable")
    return key[order], own[order], need[own[order]]


def bands_of(sizes: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, band) for the band of each size, then for the next one where a linked partner can be in it."""
    some = np.flatnonzero(sizes > 0)
    band = np.floor(np.log2(sizes[some])).astype(np.int64)
    yield some, band
    up = 100 * sizes[some] >= percent * (np.int64(2) << band)
    yield some[up], band[up] + 1


def _keys(buckets: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(buckets, KEY_BYTES), set()
        for _, _, _, grams, text, first, nodes in _shingles(batches):
            sizes = np.diff(first)
            for i, node in enumerate(nodes.tolist()):
                if node in seen:
                    sizes[i] = 0  # an equal set has given its blocks
                seen.add(node)
            for upper, (texts, band) in enumerate(bands_of(sizes, percent)):
                index = np.full(len(sizes), -1)
                index[texts] = np.arange(len(texts))
                use = index[text] >= 0
                key, own, need = block_keys(grams[use], index[text[use]], sizes[texts], band, percent)
                yield from packer.add(mix64(key) % np.uint64(buckets), key, 2 * need + upper, nodes[texts[own]])
        yield from packer.flush()

    return run


def _groups(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes that share a key, in sorted lists of at most TILE; equal lists once, with the number of keys they stand for.

    A list entry tells the band in its lowest bit and the blocks needed above it.
    """
    key, place, node = unpack(frame["keys"], frame["places"], frame["texts"], frame["counts"], KEY_BYTES)
    order = np.lexsort((node, key))
    key, place, node = key[order], place[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, place, node = key[new], place[new], node[new]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(edges[1:], len(key))
    shared = np.flatnonzero(ends - edges > 1)
    sums = sums_before(mix64(node + mix64(place.astype(np.uint64))))
    names = mix64((sums[ends[shared]] - sums[edges[shared]]) + (ends - edges)[shared].astype(np.uint64))
    names, once, times = np.unique(names, return_index=True, return_counts=True)
    rows = []
    for name, i, n in zip(names.view(np.int64).tolist(), once, times.tolist()):
        for lo in range(edges[shared[i]], ends[shared[i]], TILE):
            hi = min(lo + TILE, ends[shared[i]])
            rows.append((name, n, node[lo:hi].view(np.int64), place[lo:hi]))
    return pd.DataFrame({"key": [r[0] for r in rows], "keys": [r[1] for r in rows], "nodes": [r[2] for r in rows], "needs": [r[3] for r in rows]})


def supported(found: DataFrame) -> DataFrame:
    """(key, tile, nodes): the groups that are enough to find every link, equal ones once.

    Nodes that others meet in fewer blocks than a link needs leave.  Of a node's R blocks all but R - need differ from a
    linked partner's at most, so with blocks in one order for all, rarest first, two linked nodes have one in common
    among their first R - need + 1; the blocks that nobody else has come first and meet nobody.
    """
    found = written(found)
    entries = found.select("key", F.element_at("nodes", 1).alias("tile"), "keys", F.explode(F.arrays_zip("nodes", "needs")).alias("e")).select("key", "tile", "keys", F.col("e.nodes").alias("node"), F.col("e.needs").alias("place"))
    met = entries.groupBy("node", "place").agg(F.sum("keys").alias("met")).withColumn("spare", F.col("met") - F.shiftright("place", 1)).where("spare >= 0")
    met = written(met.select("node", "place", "spare"))
    if met.count() <= FEW_IDS:
        met = F.broadcast(met)
    left = entries.join(met, ["node", "place"]).groupBy("key", "tile", "node", "place", "spare").agg(F.sum("keys").alias("keys"))
    sizes = left.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rarest = W.partitionBy("node", "place").orderBy("size", "key").rowsBetween(W.unboundedPreceding, -1)
    first = left.join(sizes, "key").withColumn("before", F.coalesce(F.sum("keys").over(rarest), F.lit(0))).where("before <= spare")
    groups = first.groupBy("key", "tile").agg(F.array_sort(F.collect_set("node")).alias("nodes"))  # TILE of them at most
    several = groups.groupBy("key").agg(F.sum(F.size("nodes")).alias("_n"), F.count("*").alias("_tiles")).where("_n > 1")
    groups = groups.join(several, "key")
    alone = groups.where("_tiles = 1").dropDuplicates(["nodes"])
    return alone.union(groups.where("_tiles > 1")).select("key", "tile", "nodes")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts whose node is the one wanted."""
    for batch, lo, hi, grams, text, first, nodes in _shingles(batches):
        wanted = batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = []
        for i in np.flatnonzero(wanted == nodes.view(np.int64)):
            own = grams[first[i] : first[i + 1]]
            rows.append((int(wanted[i]), own.tobytes()))
        kinds = (pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["node", "shingles"])


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes ``wanted`` (doc_id, node), from the texts."""
    wanted = written(wanted.select(F.col("doc_id").alias("_id"), "node"))
    if wanted.count() <= FEW_IDS:
        wanted = F.broadcast(wanted)
    return written(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "node").mapInArrow(_sets, SET_SCHEMA))


def fold(grams: np.ndarray, bits: int | None = None) -> np.ndarray:
    """The sketch folded to a power of two of bits, about as many as there are shingles (64 at least)."""
    bits = bits or max(64, 1 << int(np.ceil(np.log2(max(len(grams), 1)))))
    odd = np.bincount((mix64(grams ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def halve(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def near_enough(pairs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that sizes and folded sketches leave possible."""
    side = lambda name: sketches.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("folded").alias(f"of_{name}"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(p), len(q))
                mask.append(int(_BITS[halve(p, size) ^ halve(q, size)].sum(dtype=np.int64)) <= most_different(n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(mask, pa.bool_()))

    sized = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInArrow(keep, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, linked): pairs of nodes with their sets compared whole."""
    one = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                linked.append(100 * same >= percent * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return pairs.join(one, "b").join(two, "a").select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component, by spreading minima and following them."""
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")))
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "theirs").alias("component"))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = written(lower.join(roots, "component", "left").select("node", "was", F.least("component", F.coalesce("root", "component")).alias("component")))
        labels = jumped.select("node", "component")
        if jumped.where("was <> component").isEmpty():
            return labels


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of FINE bits for each shingle of whole sets: (node, n, sketch)."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        sketches = [fold(x, max(64, FINE << int(np.ceil(np.log2(max(len(x), 1)))))).tobytes() for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sketches, pa.binary())], ["node", "n", "sketch"])


def _apart(sketches: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the sketches x[i] and y[i] differ, the longer one folded to the length of the other."""
    length = np.array([len(s) for s in sketches])
    out = np.zeros(len(x), np.int64)
    shape = (length[x] << 32) + length[y]
    for code in np.unique(shape):
        own = np.flatnonzero(shape == code)
        size = int(min(code >> 32, code & 0xFFFFFFFF))
        sides = []
        for ends in (x[own], y[own]):
            used, at = np.unique(ends, return_inverse=True)
            sides.append((np.stack([halve(sketches[i], size) for i in used]), at))
        (p, i), (q, j) = sides
        step = max(1, COMPARED // size)
        for lo in range(0, len(own), step):
            out[own[lo : lo + step]] = _BITS[p[i[lo : lo + step]] ^ q[j[lo : lo + step]]].sum(axis=1, dtype=np.int64)
    return out


def _forests(k: int, ends: list[tuple[int, int]]) -> list[int]:
    """Which of the edges, in order, ``k`` forests take in, each edge the first one in which it joins two trees."""
    trees: list[dict[int, int]] = []
    taken = []

    def root(tree: dict[int, int], x: int) -> int:
        while (up := tree.get(x, x)) != x:
            tree[x] = tree.get(up, up)
            x = up
        return x

    for at, (x, y) in enumerate(ends):
        lo, hi = 0, len(trees)  # two nodes that a forest joins are joined in all before it
        while lo < hi:
            mid = (lo + hi) // 2
            if root(trees[mid], x) == root(trees[mid], y):
                lo = mid + 1
            else:
                hi = mid
        if lo == k:
            continue
        if lo == len(trees):
            trees.append({})
        trees[lo][root(trees[lo], x)] = root(trees[lo], y)
        taken.append(at)
    return taken


def _candidates(k: int, percent: int):
    """Nearest candidates across components within lists of nodes, or between two lists: ``k`` forests over the components.

    ``lists`` has nodes and others (empty: pairs within nodes), ``seen`` each node's component, size and sketch once.
    Lists name the same pairs again and again; those are compared once, and fewer than ``k`` are named for a component.
    """

    def run(lists: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        seen = seen.sort_values("node")
        name, comp, size = (seen[c].to_numpy(np.int64) for c in ("node", "component", "n"))
        sketches = [np.frombuffer(s, np.uint8) for s in seen["sketch"]]
        pairs, waiting = [], 0
        for nodes, others in zip(lists["nodes"], lists["others"]):
            own = np.searchsorted(name, nodes)
            own2 = np.searchsorted(name, others) if len(others) else own
            fits = (comp[own][:, None] != comp[own2][None, :]) & (100 * np.minimum.outer(size[own], size[own2]) >= percent * np.maximum.outer(size[own], size[own2]))
            i, j = np.nonzero(fits)
            pairs.append((np.minimum(own[i], own2[j]) << 32) + np.maximum(own[i], own2[j]))
            waiting += len(i)
            if waiting > 1_000_000:
                pairs, waiting = [np.unique(np.concatenate(pairs))], 0
        codes = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        x, y = codes >> 32, codes & 0xFFFFFFFF
        apart = _apart(sketches, x, y)
        near = apart <= most_different(size[x], size[y], percent)
        x, y, apart = x[near], y[near], apart[near]
        order = np.lexsort((y, x, apart))  # places follow the nodes' order, so x is the smaller node
        x, y = x[order], y[order]
        taken = _forests(k, list(zip(comp[x].tolist(), comp[y].tolist())))
        return pd.DataFrame({"a": name[x[taken]], "b": name[y[taken]], "more": np.full(len(taken), len(taken) < len(x))})

    return run


def _mixed(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, tile, nodes): the groups that hold several components."""
    members = groups.select("key", F.explode("nodes").alias("node")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return written(groups.join(mixed, "key").select("key", "tile", "nodes"))


def _across(groups: DataFrame, labels: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, more): candidate pairs across components in groups that hold several; ``more`` if there may be further ones.

    Lists are dealt by their first node; a sketch goes once to each part that has a list with its node.
    """
    tiles = _mixed(groups, labels)
    split = tiles.join(tiles.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "key")
    left, right = split.select("key", F.col("tile").alias("t"), "nodes"), split.select("key", "tile", F.col("nodes").alias("others"))
    between = left.join(right, "key").where("t < tile").select("nodes", "others")
    lists = tiles.select("nodes", F.array().cast("array<long>").alias("others")).union(between)
    parts = max(partitions(tiles.sparkSession), tiles.count() // LISTS)
    lists = written(lists.withColumn("part", F.pmod(F.xxhash64(F.element_at("nodes", 1), F.try_element_at("others", F.lit(1))), F.lit(parts))))
    seen = lists.select("part", F.explode(F.concat("nodes", "others")).alias("node")).distinct().join(labels, "node", "left").join(sketches, "node")
    seen = seen.select(F.col("part").alias("of_part"), "node", F.coalesce("component", "node").alias("component"), "n", "sketch")
    found = lists.groupBy("part").cogroup(seen.groupBy("of_part")).applyInPandas(_candidates(k, percent), "a long, b long, more boolean")
    return found.groupBy("a", "b").agg(F.max("more").alias("more"))


def near_copies(docs: DataFrame, percent: int = PERCENT, nearest: int = 4) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, the smallest doc_id that links reach.

    A-Z is lowered.  A text with fewer words than a shingle is one shingle; one without words, empty or null, is linked
    with nothing and is its own component, also among its likes.  Repeated rows have equal sets and share a component.
    A null doc_id is never a component's id unless all its ids are null.  Other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    buckets = max(partitions(spark), 2 * input_tasks(docs))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    with arrow_batches(spark, BATCH_TEXTS):
        texts = written(rows.mapInArrow(_texts, TEXT_SCHEMA))
    sketches = written(texts.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("folded").alias("folded")))

    packed = rows.mapInArrow(_keys(buckets, percent), PACKED_SCHEMA)
    found = packed.groupBy("bucket").applyInPandas(_groups, GROUP_SCHEMA)
    with arrow_batches(spark, BATCH_TEXTS):
        groups = written(supported(found))

    centres = groups.groupBy("key").agg(F.min(F.array_min("nodes")).alias("a"))
    star = groups.join(centres, "key").select("a", F.explode("nodes").alias("b")).where("a <> b").distinct()
    star = written(near_enough(star, sketches, percent))
    ends = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    have = sets_of(rows, ends.join(sketches.select("node", "doc_id"), "node"))
    compared = written(verified(star, have, percent))
    labels, k, exhausted = components(compared.where("linked")), nearest, False
    # a list's first node has met all others in the star, so pairs of the others are left
    others = groups.join(centres, "key").select("key", "tile", F.array_except("nodes", F.array("a")).alias("nodes")).where("size(nodes) > 0")
    lists = others.groupBy("key").agg(F.sum(F.size("nodes")).alias("_n"), F.count("*").alias("_tiles")).where("_n > 1")
    others = others.join(lists, "key")
    groups = written(others.where("_tiles = 1").dropDuplicates(["nodes"]).union(others.where("_tiles > 1")).select("key", "tile", "nodes"))
    # the nodes that any later round compares: their whole sets, and finer sketches that few pairs pass without a link
    rest = written(_mixed(groups, labels).select(F.explode("nodes").alias("node")).distinct())
    new = sets_of(rows, rest.join(have.select("node"), "node", "left_anti").join(sketches.select("node", "doc_id"), "node"))
    have = have.union(new)
    fine = written(have.join(rest, "node", "left_semi").select("node", "shingles").mapInArrow(_fine, "node long, n long, sketch binary"))
    while not exhausted:
        pairs = written(_across(groups, labels, fine, k, percent))
        k *= 16
        exhausted = pairs.where("more").isEmpty()  # then these are all pairs that could join components
        fresh = written(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti").select("a", "b"))
        if fresh.isEmpty():
            continue
        done = written(verified(fresh, have, percent))
        compared = written(compared.union(done))
        if not done.where("linked").isEmpty():
            labels = components(compared.where("linked"))

    joined = texts.join(labels, "node", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    smallest = joined.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = written(joined.select("doc_id", "n_shingles", "component"))
    return linked.join(smallest, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


QUERY = {"op3_jaccard_join": lambda spark, sf_dir: near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLE = {}
