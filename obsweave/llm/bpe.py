"""BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a word ends in exactly one token. An automaton over the vocabulary gives all tokens
that end at a position; the one that may follow the last token of the prefix before it is stored. Back-pointers
from the whole word give the ids. Two tokens may follow each other when merging their joined bytes by rank brings
back just these two.

Null and empty texts have no ids. Repeated rows are encoded alike. Other columns pass unchanged unless they are
called like a new column, which then wins.
"""

from __future__ import annotations

import json
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from obsweave.llm.common import SLICE, slices
from obsweave.session import ship

# Encoded pieces that a Python worker remembers at most; then it starts anew.
REMEMBERED = 600_000

# The published pattern that cuts texts into words before byte-level merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

# A single space between two visible characters always starts a word.
_CUT = re.compile(r"(?<=\S) (?=\S)")

_LOADED: dict[str, Encoder] = {}


def byte_characters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else the next one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, spare = {}, 256
    for b in range(256):
        if b in shown:
            chars[b] = chr(b)
        else:
            chars[b], spare = chr(spare), spare + 1
    return [chars[b] for b in range(256)]


class Encoder:
    """A byte-level vocabulary with its merges, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        chars = byte_characters()
        self.to_char = dict(enumerate(chars))
        to_byte = {c: b for b, c in enumerate(chars)}
        self.ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.left: dict[int, tuple[int, int, int]] = {}
        for r, (x, y) in enumerate(pairs):
            whole, a, b = self.ids[x + y], self.ids[x], self.ids[y]
            self.rank[a, b] = r
            self.left.setdefault(whole, (r, a, b))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if token not in self.special and self._merged(token) == [i]:
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        size = max([*self.ids.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, i in self.ids.items():
            raw[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.lengths = np.array([len(x) for x in raw], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.words = regex.compile(WORDS)
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}

    def _merged(self, token: str) -> list[int]:
        """Ids that plain merging by rank gives; used once per vocabulary entry to leave out unreachable ones."""
        parts = [self.ids[c] for c in token]
        while len(parts) > 1:
            r, at = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:])))
            if r == 1 << 60:
                break
            parts[at:at + 2] = [self.ids_of(parts[at], parts[at + 1])]
        return parts

    def ids_of(self, a: int, b: int) -> int:
        if not hasattr(self, "joined"):
            self.joined = {(a, b): whole for whole, (_, a, b) in self.left.items()}
        return self.joined[a, b]

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Nodes on the right (0) or left (1) edge of a token's merge tree, lowest first, each with the rank at which it is absorbed."""
        known = self.spines.get((token, side))
        if known is None:
            known, absorbed = [(token, float("inf"))], float("inf")
            node = token
            while node in self.left:
                r, a, b = self.left[node]
                node, absorbed = (b if side == 0 else a), r
                known.append((node, absorbed))
            known.reverse()
            self.spines[token, side] = known
        return known

    def compatible(self, first: int, second: int) -> bool:
        """Whether merging keeps the border: at no time does the pair across it come before both inner merges."""
        if len(self.fits) > 8 * REMEMBERED:
            self.fits.clear()
        found = self.fits[first << 32 | second] = self._keeps_border(self.spine(first, 0), self.spine(second, 1))
        return found

    def _keeps_border(self, ends, begins) -> bool:
        i = k = 0
        while True:
            (a, a_gone), (b, b_gone) = ends[i], begins[k]
            across = self.rank.get((a, b), float("inf"))
            if across < a_gone and across <= b_gone and across != float("inf"):
                return False
            if a_gone == b_gone == float("inf"):
                return True
            if a_gone <= b_gone:
                i += 1
            else:
                k += 1

    def word(self, mapped: str) -> bytes:
        """Ids of one word, given in byte characters."""
        known = self.fits.get
        back, last = [0] * (len(mapped) + 1), [-1] * (len(mapped) + 1)
        for end, (length, token) in self.automaton.iter(mapped):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                fits = known(last[start] << 32 | token)
                if fits is None:
                    fits = self.compatible(last[start], token)
                if not fits:
                    continue
            back[end], last[end] = start, token
        ids, at = [], len(mapped)
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, text: str) -> bytes:
        out, known = [], self.pieces
        for word in self.words.findall(text):
            ids = known.get(word)
            if ids is None:
                ids = self.word(word.encode().decode("latin-1").translate(self.to_char))
                if len(word) < 64:
                    known[word] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(text) < 64:
            known[text] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit numbers, of a text without special tokens."""
        if not text:
            return b""
        known, out = self.pieces, []
        if len(known) > REMEMBERED:
            known.clear()
        for part in _CUT.split(text):
            part = " " + part if out else part
            out.append(known.get(part) or self.piece(part))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.cut_special is None or not self.cut_special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += [self.plain(text[at:m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        out = []
        every = np.frombuffer(ids, dtype="<u4")
        for start in range(0, len(every), 1 << 18):
            part = every[start:start + (1 << 18)]
            lengths = self.lengths[part]
            before = np.cumsum(lengths) - lengths
            out.append(self.bytes[np.arange(lengths.sum()) + np.repeat(self.starts[part] - before, lengths)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def load(path: str) -> Encoder:
    """The encoder of a file; each Python worker reads it once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _mapped(df: DataFrame, new: str, kind: str, made) -> DataFrame:
    """`df` with the column `new` of Spark type `kind`, made from Arrow batches."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c != new]
    schema = df.select(*kept).schema.add(new, kind)

    def run(batches):
        for batch in slices(batches, SLICE):
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), made(batch)], names=[*kept, new])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of the whole text: binary, four little-endian bytes for each id."""
    def made(batch):
        coder = load(path)
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        return pa.array([coder.encode(t or "") for t in texts], pa.binary())
    return _mapped(df, ids, "binary", made)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of ids written by `encode`; null ids give an empty text."""
    def made(batch):
        coder = load(path)
        every = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        return pa.array([coder.decode(x or b"") for x in every], pa.string())
    return _mapped(df, text, "string", made)
