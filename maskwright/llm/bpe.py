"""BPE encoding and decoding by prefix-sharing trie traversal.

The state of a trie node is the last token of the encoding of the node's prefix. It is the one vocabulary
token t ending there for which the encoding of what precedes t, followed by t, is stable, which only depends
on the last token before t. Distinct words are visited in sorted order, which is a depth-first walk of their
trie: a stack keeps the states of the current path, so a prefix shared by many words is worked out once. A
word's encoding is read off backwards from its last state.

The work runs inside Arrow batches of whole documents; nothing is shuffled. Each worker keeps the encodings
of frequent white-space runs in a cache of bounded size.

Defined results: a null text counts as empty (no ids); the strings of special tokens in a text give the
special ids; the vocabulary file's own normaliser and splitter are used for every text beyond Latin letters.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import take

#: Texts made of these characters need no composition, and lower-casing and splitting them is the same for
#: Python and the vocabulary's rules (tests go through every one of them).
PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-©«-±´-¸»¿-ɏ]*")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
END = "</w>"
#: Words, and white-space runs, that a worker keeps.
CACHE = 1_000_000
#: Rows and bytes of texts worked on at once.
ROWS, BYTES = 2048, 8 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class TrieEncoder:
    """Encoder and decoder for a word-level BPE file whose word ends carry a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.rules = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in self.vocab.items() if t.endswith(END) and t != END}
        self.width = {i: len(t) for t, i in self.inner.items()} | {i: len(t) for t, i in self.final.items()}
        self._spines()
        self.letters = dict(enumerate(byte_letters()))
        self.bytes = {i: struct.pack("<I", i) for i in self.vocab.values()}
        self.chunks: dict[str, bytes] = {}
        self.packed: dict[str, bytes] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _spines(self) -> None:
        """For each token the parts at its right and left edge while it is being merged, with the rank of the merge
        that ends each part; and the rank of each pair of tokens."""
        last = 1 << 30
        made: dict[str, tuple[str, str, int]] = {}
        self.pairs: dict[int, int] = {}
        for (a, b), rank in self.ranks.items():
            made.setdefault(a + b, (a, b, rank))
            self.pairs[self.vocab[a] << 20 | self.vocab[b]] = rank
        self.right: list[list[tuple[int, int]]] = [[] for _ in range(max(self.vocab.values()) + 1)]
        self.left: list[list[tuple[int, int]]] = [[] for _ in self.right]
        for token, i in self.vocab.items():
            for side, spine in ((1, self.right[i]), (0, self.left[i])):
                part, ends = token, last
                spine.append((i, ends))
                while part in made:
                    ends, part = made[part][2], made[part][side]
                    spine.append((self.vocab[part], ends))
        self.starts = {t[:n] for t in [*self.inner, *self.final] for n in range(len(t))} | {""}
        self.numbers = {"": 0}
        self.suffixes = [""]
        #: By suffix and letter: what _step found.
        self.steps: list[dict[str, tuple[int, list, list]]] = [{}]
        #: By token and next token: whether they stay apart.
        self.stable: list[dict[int, bool]] = [{} for _ in self.right]
        self.known = 0

    def _step(self, suffix: int, letter: str) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
        """From the longest suffix that begins a token, by one letter: the next such suffix, and the tokens
        (id, letters) that end here, longest first, inside a word and at its end."""
        text = self.suffixes[suffix] + letter
        ends = [text[k:] for k in range(len(text))]
        inner = [(self.inner[t], len(t)) for t in ends if t in self.inner]
        final = [(self.final[t], len(t)) for t in ends if t in self.final]
        while text not in self.starts:
            text = text[1:]
        if text not in self.numbers:
            self.numbers[text] = len(self.suffixes)
            self.suffixes.append(text)
            self.steps.append({})
        self.steps[suffix][letter] = found = (self.numbers[text], inner, final)
        return found

    def _follows(self, before: int, token: int) -> bool:
        """Whether two tokens stay apart when joined: no merge across the border comes before the merges that
        take its two sides away (of equal merges the one further left comes first)."""
        pairs = self.pairs
        known = True
        for x, x_ends in self.right[before]:
            for y, y_ends in self.left[token]:
                if (rank := pairs.get(x << 20 | y)) is not None and rank < x_ends and rank <= y_ends:
                    known = False
        self.known += 1
        if self.known > 4 * CACHE:
            self.known = 0
            for d in self.stable:
                d.clear()
        self.stable[before][token] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids (little-endian, 32 bits) of each distinct word in byte letters, walking the words' trie depth first."""
        out: dict[str, bytes] = {}
        path: list[int] = []  # last token of each prefix
        suffixes: list[int] = []  # longest suffix of each prefix that begins a token
        previous, steps, stable, width, packed = "", self.steps, self.stable, self.width, self.bytes
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word) - 1)
            while shared < most and previous[shared] == word[shared]:
                shared += 1
            del path[shared:], suffixes[shared:]
            suffix = suffixes[-1] if shared else 0
            at = shared
            for letter in word[shared:]:
                at += 1
                step = steps[suffix].get(letter) or self._step(suffix, letter)
                suffix = step[0]
                for token, n in step[1 + (at == len(word))]:
                    if n == at:
                        break
                    before = path[at - n - 1]
                    if (known := stable[before].get(token)) is None:
                        known = self._follows(before, token)
                    if known:
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word[:at]!r}")
                if at < len(word):
                    path.append(token)
                    suffixes.append(suffix)
            ids, at = [packed[token]], len(word) - width[token]
            while at > 0:
                token = path[at - 1]
                ids.append(packed[token])
                at -= width[token]
            ids.reverse()
            out[word] = b"".join(ids)
            previous = word
        return out

    def _words(self, chunk: str) -> list[str]:
        """Words of a white-space run, in byte letters."""
        if chunk.isascii() and chunk.isprintable():
            return [chunk] if chunk.isalpha() else SPLIT.findall(chunk)
        if PLAIN.fullmatch(chunk):
            words = [chunk] if chunk.isalpha() else SPLIT.findall(chunk)
            return [w.encode().decode("latin-1").translate(self.letters) for w in words]
        return [w for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(chunk)]

    def learn(self, chunks: set[str]) -> None:
        """Adds the encodings of the white-space runs to the cache."""
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        if len(self.packed) > CACHE:
            self.packed.clear()
        split = {c: self._words(c) for c in chunks}
        new = {w for ws in split.values() for w in ws} - self.packed.keys()
        self.packed |= self.encode_words(new)
        packed = self.packed
        for c, ws in split.items():
            self.chunks[c] = packed[ws[0]] if len(ws) == 1 else b"".join([packed[w] for w in ws])

    def release(self) -> None:
        """Gives the words of a finished task free: a worker lives on, and rare words seldom come back."""
        self.chunks.clear()
        self.packed.clear()

    def runs(self, text: str) -> list[str]:
        """Normalised white-space runs."""
        if PLAIN.fullmatch(text):
            return text.lower().split()
        return [c for c in self.rules.normalizer.normalize_str(text).split(" ") if c]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[list[str] | bytes]] = []
        for text in texts:
            own: list[list[str] | bytes] = []
            for k, piece in enumerate(self.cut.split(text or "") if self.cut and "<|" in (text or "") else [text or ""]):
                own.append(struct.pack("<I", self.special[piece]) if k % 2 else self.runs(piece))
            parts.append(own)
        seen: set[str] = set()
        for own in parts:
            for p in own:
                if isinstance(p, list):
                    seen.update(p)
        if missing := seen - self.chunks.keys():
            if len(self.chunks) > CACHE:  # cleared as a whole: then what this batch holds is learnt again
                missing = seen
            self.learn(missing)
        get = {c: self.chunks[c] for c in seen}.__getitem__
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in own]) for own in parts]

    def decode(self, ids: bytes) -> str:
        """The token strings joined by spaces, special ones kept: this vocabulary has no decoder of its own."""
        names = self.names
        return " ".join([names[i] for i in memoryview(ids).cast("I")])


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ROWS rows, and BYTES of text unless one text alone is longer."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, before + BYTES, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded string]) of every whole text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in parts:
            for s in portions(b, 1):
                packed = enc.encode_batch(s.column(1).to_pylist())
                cols = [s.column(0), pa.array([memoryview(x).cast("I").tolist() for x in packed], pa.list_(pa.int32()))]
                if decoded:
                    cols.append(pa.array([enc.decode(x) for x in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "ids", "decoded"][: len(cols)])
        enc.release()

    rows = take(df, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, without shipping ids out of the workers."""
    from hashlib import sha256

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in parts:
            for s in portions(b, 1):
                packed = enc.encode_batch(s.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        s.column(0),
                        pa.array([len(x) // 4 for x in packed], pa.int64()),
                        pa.array([sha256(x).hexdigest() for x in packed]),
                        pa.array([sha256(enc.decode(x).encode()).hexdigest() for x in packed]),
                    ],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        enc.release()

    rows = take(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
