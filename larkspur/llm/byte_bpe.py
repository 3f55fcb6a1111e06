"""Byte-level BPE by dynamic programming over prefixes.

A sequence of tokens is what the merges give exactly if every two neighbours stay apart when they are merged alone:
merges run in one order everywhere, so the first that could cross a border would cross it in the pair as well.  So each
prefix of a piece has one valid last token: the one that ends there and may follow the last token of the prefix it
leaves.  ``last_tokens`` stores that token for every prefix.  A piece's tokens are read off its table from the end; an
appended byte adds an entry and changes none; after an edit the entries before it stay and, from the first old cut
between pieces behind it, so do all others.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters and numbers (by hexadecimal code point) that came after version 16 of Unicode, which the pattern means.
LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb "
    "11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 "
    "191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_LATER = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in LATER.split()) + "]")
#: Stands in for such characters while a text is split: neither letter, number nor white space.
_OTHER = "�"
#: A piece that ends so many characters before the end of a text stays when text is appended: the pattern looks at two more.
MARGIN = 3
#: Characters split at a time.
WINDOW = 1 << 20
#: Pieces that a task remembers with their tokens, their characters, and pairs of tokens with their verdict; a full memory starts anew.
REMEMBERED = 250_000
REMEMBERED_CHARS = 8 << 20
PAIRS = 500_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TABLE_SCHEMA = "doc_id long, text string, cuts binary, last_tokens binary, ids array<int>, n_computed long"


def read_ranks(spec: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 and number in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, spec.splitlines()) if token}


@dataclass
class Prefixes:
    """A text, its pieces' ends in characters, and for each piece the last token of every prefix (entry 0: none)."""

    text: str
    ends: list[int]
    tables: list[list[int]]


def _ranges(code: str) -> str:
    """The Latin-1 characters of a class, as text for a character class."""
    return "".join(re.escape(chr(c)) for c in range(256) if regex.match(code, chr(c)))


def latin_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts of Latin-1 characters only, with its classes spelt out, which splits them faster."""

    def spelt(found: re.Match) -> str:
        inside = found[0].startswith("[")
        text = re.sub(r"\\p\{\w+\}|\\s", lambda m: _ranges(m[0]), found[0])
        return text if inside else f"[{text}]"

    return re.compile(re.sub(r"\[[^\]]*\]|\\p\{\w+\}|\\s", spelt, pattern.replace(r"\S", r"[^\s]")))


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PrefixTokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.label = {rank: token for token, rank in ranks.items()}
        self.pattern, self.latin = regex.compile(pattern), latin_pattern(pattern)
        sizes: dict[bytes, set[int]] = {}
        for token in ranks:
            sizes.setdefault(token[-2:], set()).add(len(token))
        for token, own in sizes.items():
            if len(token) == 2 and token[1:] in ranks:
                own.add(1)
        self.sizes = {end: sorted(own, reverse=True) for end, own in sizes.items()}
        self.edges: dict[int, tuple | None] = {}  # token -> what stands at its two edges while it is merged
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}  # piece -> its ids as little-endian bytes
        self.chars = 0

    def merge(self, data: bytes) -> list[bytes]:
        """The merges as defined: the two neighbours whose joined bytes have the lowest rank, leftmost first, until none have one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, t: int) -> tuple | None:
        """The bytes at the left and at the right edge of a token, from the rank on at which they stand there.

        None if the merges do not give the token; without lists if they run out of the order of ranks.
        """
        parts, left, right, before = [self.label[t][i : i + 1] for i in range(len(self.label[t]))], [], [], -1
        left.append((-1, parts[0]))
        right.append((-1, parts[-1]))
        ordered = True
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                return None
            ordered &= rank >= before
            before = rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                left.append((rank, parts[0]))
            if at == len(parts) - 1:
                right.append((rank, parts[-1]))
        return (left, right) if ordered else ()

    def edges_of(self, t: int) -> tuple | None:
        if t not in self.edges:
            self.edges[t] = self._edges(t)
        return self.edges[t]

    def _goes_on(self, t: int, x: int) -> bool:
        """Whether some merge crosses the border: two parts that stand there at one time and join before either is used up.

        Of equal ranks the leftmost goes first, so a join must come before the left part's next merge and may come with the
        right part's.
        """
        before, after = self.edges_of(t), self.edges_of(x)
        if before is None or after is None:
            return False
        if not before or not after:
            return self.merge(self.label[t] + self.label[x]) == [self.label[t], self.label[x]]
        lefts, rights, ranks = before[1], after[0], self.ranks
        i = j = 0
        while True:
            until_i = lefts[i + 1][0] if i + 1 < len(lefts) else 1 << 41
            until_j = rights[j + 1][0] if j + 1 < len(rights) else 1 << 41
            rank = ranks.get(lefts[i][1] + rights[j][1])
            if rank is not None and rank < until_i and rank <= until_j:
                return False
            if until_i == until_j == 1 << 41:
                return True
            if until_i <= until_j:
                i += 1
            else:
                j += 1

    def goes_on(self, t: int, x: int) -> bool:
        """Whether token x may follow token t: merged alone, the two stay as they are."""
        found = self.pairs.get((t, x))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[t, x] = self._goes_on(t, x)
        return found

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The valid last token of every prefix of a piece; ``known`` has those of its first prefixes."""
        last = list(known) if known else [-1]
        ranks, sizes, goes_on = self.ranks, self.sizes, self.goes_on
        for end in range(len(last), len(piece) + 1):
            for size in sizes.get(piece[max(end - 2, 0) : end], (1,)):
                start = end - size
                t = ranks.get(piece[start:end]) if start >= 0 else None
                if t is not None and (goes_on(last[start], t) if start else self.edges_of(t) is not None):
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token for byte {piece[end - 1]}")
        return last

    def read_off(self, piece: bytes, last: list[int]) -> list[int]:
        """Tokens of a piece from its table.  A piece that is a token itself is that token, whatever the merges say."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= len(self.label[last[end]])
        return out[::-1]

    def learn(self, pieces: set[str]) -> None:
        """Remember the tokens of some pieces.  In order, a piece takes the entries of the prefix it shares with the one before."""
        new = sorted(p.encode() for p in pieces.difference(self.known))
        self.chars += sum(map(len, new))
        if len(self.known) + len(new) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.known.clear()
            new = sorted(p.encode() for p in pieces)
            self.chars = sum(map(len, new))
        before, last = b"", [-1]
        for piece in new:
            same = 0
            for a, b in zip(before, piece):
                if a != b:
                    break
                same += 1
            last = self.last_tokens(piece, last[: same + 1])
            before = piece
            self.known[piece.decode()] = array("I", self.read_off(piece, last)).tobytes()

    def pieces(self, text: str, at: int = 0) -> Iterator[list[str]]:
        """The pieces of ``text[at:]`` in lists.  A window's last pieces wait for the next one, as what follows may change them."""
        latin, size = is_latin(text), WINDOW
        seen = text if latin or not _LATER.search(text) else _LATER.sub(_OTHER, text)
        findall = (self.latin if latin else self.pattern).findall
        while at < len(text):
            end = min(at + size, len(text))
            found, stop = findall(seen, at, end), end
            if end < len(text):
                while found and stop > end - MARGIN:
                    stop -= len(found.pop())
                if not found:
                    size *= 2
                    continue
            if seen is not text:
                ends = np.cumsum([0, *map(len, found)]) + at
                found = [text[a:b] for a, b in zip(ends[:-1], ends[1:])]
            yield found
            at, size = stop, WINDOW

    def encode_all(self, texts: Iterator[str]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, ids as little-endian 32-bit integers), windows of a text in order; texts without pieces give none.

        Pieces are looked up for many short texts, or one window of a long one, at a time.
        """
        held, size = [], 0

        def encoded():
            self.learn(set().union(*(found for _, found in held)))
            look_up = self.known.__getitem__
            for number, found in held:
                yield number, b"".join(map(look_up, found))

        for number, text in enumerate(texts):
            for found in self.pieces(text):
                held.append((number, found))
                size += sum(map(len, found)) if len(text) > WINDOW else len(text)
                if size >= WINDOW:
                    yield from encoded()
                    held, size = [], 0
        yield from encoded()

    def encode(self, text: str) -> list[int]:
        return [i for _, data in self.encode_all(iter([text])) for i in np.frombuffer(data, "<u4").tolist()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))

    # --- tables that can be appended to and edited -------------------------------------------------------------

    def prefixes(self, text: str) -> Prefixes:
        found = [p for part in self.pieces(text) for p in part]
        return Prefixes(text, np.cumsum([*map(len, found)], dtype=np.int64).tolist(), [self.last_tokens(p.encode()) for p in found])

    def ids(self, have: Prefixes) -> list[int]:
        starts = [0, *have.ends]
        return [i for a, b, last in zip(starts, have.ends, have.tables) for i in self.read_off(have.text[a:b].encode(), last)]

    def edit(self, have: Prefixes, start: int, end: int, replacement: str) -> tuple[Prefixes, int]:
        """The tables after ``text[start:end]`` became ``replacement``, and how many entries had to be computed.

        Pieces before the edit stay, the piece it falls into keeps the entries of what is unchanged, and splitting
        stops at the first old cut behind the edit: what a piece is depends on nothing before it.
        """
        old, size = have.text, len(have.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        text, shift = old[:start] + replacement + old[end:], len(replacement) - (end - start)
        kept = int(np.searchsorted(have.ends, start - MARGIN, "right"))
        at = have.ends[kept - 1] if kept else 0
        ends, tables, computed = have.ends[:kept], have.tables[:kept], 0
        number = {0: 0} | {e: i + 1 for i, e in enumerate(have.ends)}  # old cut -> the piece that starts there
        done = False
        for found in self.pieces(text, at):
            for piece in found:
                same = number.get(at - shift) if at >= start + len(replacement) else None
                if same is not None:
                    ends += [e + shift for e in have.ends[same:]]
                    tables += have.tables[same:]
                    done = True
                    break
                data, known = piece.encode(), None
                before = number.get(at) if at <= start else None
                if before is not None and before < len(have.tables):
                    mine = old[at : have.ends[before]].encode()
                    n = next((i for i, (a, b) in enumerate(zip(data, mine)) if a != b), min(len(data), len(mine)))
                    known = have.tables[before][: n + 1]
                tables.append(self.last_tokens(data, known))
                computed += len(data) + 1 - len(known or [-1])
                at += len(piece)
                ends.append(at)
            if done:
                break
        return Prefixes(text, ends, tables), computed


@functools.lru_cache(maxsize=2)
def tokenizer(spec: bytes, pattern: str) -> PrefixTokenizer:
    """A tokenizer from the content of its rank file; each worker builds it once."""
    return PrefixTokenizer(read_ranks(spec), pattern)


def _spec(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())  # the file's size, whatever the input


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ``ids`` and ``decoded`` (bytes).

    A null text is empty and has no tokens.  Rows are taken as they come, so repeated rows, null ids and other columns
    change nothing; an empty table gives no rows.  Nothing is shuffled; a task holds one batch of texts and the ids of
    one window of a text, unless ids are asked for.
    """
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(spec.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [[0, hashlib.sha256(), hashlib.sha256(), [], []] for _ in range(part.num_rows)]
                for number, data in tok.encode_all(text.as_py() or "" for text in part.column(1)):
                    row, ids = found[number], np.frombuffer(data, "<u4").tolist()
                    decoded = tok.decode(ids)
                    row[0] += len(ids)
                    row[1].update(data)
                    row[2].update(decoded)
                    if with_ids:
                        row[3] += ids
                        row[4].append(decoded)
                rows = [(n, ids_hash.hexdigest(), text_hash.hexdigest(), ids, b"".join(parts)) for n, ids_hash, text_hash, ids, parts in found]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
                width = 5 if with_ids else 3
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array([r[i] for r in rows], kinds[i]) for i in range(width)], names[: width + 1])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA + (", ids array<int>, decoded binary" if with_ids else ""))


def _table_row(tok: PrefixTokenizer, doc_id, have: Prefixes, computed: int) -> tuple:
    flat = np.array([t for table in have.tables for t in table[1:]], "<u4")  # one entry a byte
    return doc_id, have.text, np.array(have.ends, "<u4").tobytes(), flat.tobytes(), tok.ids(have), computed


def _table_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "text", "cuts", "last_tokens", "ids", "n_computed"])


def _read_table(text: str, cuts: bytes, flat: bytes) -> Prefixes:
    ends, last = np.frombuffer(cuts, "<u4").tolist(), np.frombuffer(flat, "<u4").tolist()
    tables, at, start = [], 0, 0
    for end in ends:
        n = len(text[start:end].encode())
        tables.append([-1, *last[at : at + n]])
        at, start = at + n, end
    return Prefixes(text, ends, tables)


def prefix_tables(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the text, the ends of its pieces, the last token of every prefix (4 bytes each) and the ids.

    This is what ``apply_edits`` goes on from.  A null text is empty.  Takes odd inputs as ``encode`` does.
    """
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(spec.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                rows = []
                for doc_id, text in zip(*(batch.column(i).slice(lo, 100).to_pylist() for i in (0, 1))):
                    have = tok.prefixes(text or "")
                    rows.append(_table_row(tok, doc_id, have, sum(len(t) - 1 for t in have.tables)))
                yield _table_batch(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TABLE_SCHEMA)


def apply_edits(tables: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """The tables after ``edits`` (doc_id, edit_no, start, end, replacement; characters, end exclusive) in order of edit_no.

    An edit at the end of a text appends to it.  ``n_computed`` is the number of prefixes that were encoded anew.  Edits
    beyond the text count as at its end, a null replacement is empty, null positions mean the end; documents without
    edits stay as they are, edits without a document do nothing.  A document's edits meet in its own row.
    """
    spec = _spec(tables, path)
    one = F.struct("edit_no", "start", "end", "replacement")
    own = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(one)).alias("edits"))
    rows = tables.select("doc_id", "text", "cuts", "last_tokens").join(own, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(spec.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                out = []
                for row in batch.slice(lo, 100).to_pylist():
                    have, computed = _read_table(row["text"], row["cuts"], row["last_tokens"]), 0
                    for e in row["edits"] or []:
                        size = len(have.text)
                        start = size if e["start"] is None else e["start"]
                        have, n = tok.edit(have, start, size if e["end"] is None else e["end"], e["replacement"] or "")
                        computed += n
                    out.append(_table_row(tok, row["doc_id"], have, computed))
                yield _table_batch(out)

    return rows.mapInArrow(run, TABLE_SCHEMA)


def _query(spark, sf_dir):
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERY = {"op13_byte_bpe": _query}
ORACLE = {}
