"""BPE encoding and decoding with a tokenization automaton.

``compile_merges`` builds the automaton over token arcs, one merge after the other.  It starts with one state on which
every base symbol is a loop.  The merge (u, v) adds a gadget: a state for "after u" that copies the state reached by u
and lacks the arc v, and a new arc uv, that leads where v led, from every state that has u.  In the end a sequence of
arcs is a path exactly if it is the sequence of tokens that the merges give.  States share structure: "after u" is kept
as the list of arcs taken away from the state it copies, and what a new arc starts from is read off its left parts.
Looked-up transitions are kept in a table.

A pre-split word is encoded by running arcs over its symbols, longest label first, and stepping back where the state
has no arc that goes on; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = 1 << 60
END = "</w>"
#: Words that a task remembers with their tokens; a full memory starts anew.
REMEMBERED = 250_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White space of the pattern that splits words; str.split() takes the same and those of the second pattern.
_BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = re.compile(f"[{_BLANKS}]+")
_ONLY_STR = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Automaton:
    """Transitions between tokens; a state is named by the arc that leads to it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.label = {i: t for t, i in vocab.items()}
        self.made = {}  # arc -> (left part, right part, time of its merge)
        self.cut = {}  # (u, v) -> time at which the state after u lost the arc v
        self.arcs = {}  # label -> arc
        self.table = {}  # (arc, arc) -> whether the second goes on from the state after the first
        produced = {a + b for a, b in merges}
        for text, i in vocab.items():
            if text not in produced:
                self.arcs[text] = i
        for time, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if a in self.arcs and b in self.arcs and self._goes_on(u, v, time):
                self.cut[u, v] = time
                self.made[uv] = (u, v, time)
                self.arcs[a + b] = uv
        self.longest = max(map(len, self.arcs), default=1)

    def _goes_on(self, t: int, x: int, now: int = NEVER) -> bool:
        """Whether the state after ``t`` has the arc ``x`` before time ``now``.

        The state after t copies, at t's making, that after t's right part, and so on down; the arc x came with x's
        left part, and so on down.  A cut of such a pair counts if both were there when it was made: before t's copy
        was taken, and not after x's arc was (one merge that fits twice in a row applies at the left).
        """
        after, copied = t, now
        while True:
            arc, came = x, now
            while True:
                time = self.cut.get((after, arc))
                if time is not None and time < copied and (time < came or (time == came and came != now)):
                    return False
                part = self.made.get(arc)
                if part is None:
                    break
                arc, came = part[0], part[2]
            part = self.made.get(after)
            if part is None:
                return True
            after, copied = part[1], part[2]

    def goes_on(self, t: int, x: int) -> bool:
        found = self.table.get((t, x))
        if found is None:
            if len(self.table) > 500_000:
                self.table.clear()
            found = self.table[t, x] = self._goes_on(t, x)
        return found

    def encode(self, word: str) -> list[int]:
        """Tokens of a pre-split word in byte symbols."""
        whole = self.arcs.get(word + END)
        if whole is not None:
            return [whole]
        n, arcs = len(word), self.arcs
        path, places, tries, at, size = [], [], [], 0, min(len(word), self.longest)
        while True:
            while size:
                end = at + size
                x = arcs.get(word[at:end] if end < n else word[at:] + END)
                if x is not None and (not path or self.goes_on(path[-1], x)):
                    break
                size -= 1
            if size:
                path.append(x)
                places.append(at)
                tries.append(size)
                at += size
                if at == n:
                    return path
                size = min(n - at, self.longest)
            else:
                if not path:
                    raise ValueError(f"no path for {word!r}")
                path.pop()
                at, size = places.pop(), tries.pop() - 1


class Tokenizer:
    """The automaton with the text rules of a tokenizer file: special tokens, NFC, lower case, pre-split."""

    def __init__(self, spec: dict):
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.label = dict(self.automaton.label) | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", _BLANKS)).findall
        self.symbols = dict(enumerate(byte_symbols()))
        self.known: dict[str, tuple[int, str, str]] = {}

    def ids_of_word(self, word: str) -> list[int]:
        """Tokens of a string without white space, normalised already."""
        return [i for piece in self.pieces(word) for i in self.automaton.encode(piece.encode().decode("latin-1").translate(self.symbols))]

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            lower = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # no rule for a final sigma
            return _BLANK.split(lower) if _ONLY_STR.search(lower) else lower.split()
        return _BLANK.split(text.lower()) if _ONLY_STR.search(text) else text.lower().split()

    def _remember(self, word: str) -> tuple[int, str, str]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        ids = self.ids_of_word(word)
        found = self.known[word] = (len(ids), " ".join(map(str, ids)), " ".join(map(self.label.__getitem__, ids)))
        return found

    def parts(self, text: str) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids, decoded) of each word, the last two as texts joined by spaces."""
        known, remember = self.known, self._remember
        pieces = self.special_pattern.split(text) if self.special_pattern and "<" in text else [text]
        for piece in pieces:
            if piece in self.special and len(pieces) > 1:
                yield 1, str(self.special[piece]), piece
                continue
            for word in self._words(piece):
                found = known.get(word) or remember(word)
                if found[0]:
                    yield found

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.parts(text) for i in part[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by spaces, as the tokenizer file names no decoder."""
        return " ".join(map(self.label.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def tokenizer(spec: str) -> Tokenizer:
    """A tokenizer from the text of its file; each worker compiles it once."""
    return Tokenizer(json.loads(spec))


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ``ids`` and ``decoded``.

    A null text is empty and has no tokens.  Rows are taken as they come, so repeated rows, null ids and other columns
    change nothing; an empty table gives no rows.  Nothing is shuffled, a task holds one batch of texts.
    """
    with open(path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())  # the file's size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(spec.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for text in part.column(1):
                    found = list(tok.parts(text.as_py() or ""))
                    ids, decoded = " ".join([f[1] for f in found]), " ".join([f[2] for f in found])
                    row = [sum([f[0] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    rows.append(row + [[int(i) for i in ids.split()], decoded] if with_ids else row)
                kinds = [pa.int64(), pa.string(), pa.string()] + ([pa.list_(pa.int32()), pa.string()] if with_ids else [])
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else [])
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if with_ids else ""))


def _query(spark, sf_dir):
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERY = {"op6_bpe_automaton": _query}
ORACLE = {}
