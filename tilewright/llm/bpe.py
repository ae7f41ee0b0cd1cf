"""Byte-level BPE by a backtracking encoder.

A text is cut by the tokenizer's pre-token pattern. Within a pre-token the
encoder takes the longest token that matches next, found by an Aho-Corasick
automaton over all token byte strings, and checks it against the token before
it: a pair is compatible if merging the two byte strings by rank would not
join or split them elsewhere. Where it is not compatible, the next shorter
token is tried, and where none is left the encoder steps back by one token; a
position found to be a dead end is marked and never tried again, so the work
is linear in the length. The result is exactly that of merging by rank, for a
vocabulary in which merging makes every token, as training leaves it.

Decoding gathers token bytes from one buffer by a table of offsets.

Defined results: a null text is encoded as an empty one; the control string of
a special token inside a text becomes that token, as the reference library
does by default; ids outside the vocabulary decode to nothing; a very long text
takes time and memory in proportion; documents' ids may be of any type, and
null; rows that repeat an id keep their rows; an empty table gives an empty
table; extra columns are ignored by ``encode`` and ``decode``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.words import id_kind

#: The pre-token pattern. Letters, the most frequent, come first: no alternative after them can match where they do.
PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII texts, which the standard library matches in half the time.
ASCII_PATTERN = r" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered by a worker; longer ones than ``CACHED_CHARS`` are not.
CACHE, CACHED_CHARS = 1 << 18, 32


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Tables of one vocabulary file, built once in each worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for s, i in vocab.items():
            if s not in self.special:
                self.bytes[i] = to_bytes(s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(b) for b in self.bytes], out=self.offsets[1:])
        self.buffer = np.frombuffer(b"".join(self.bytes), np.uint8)
        # Rank of the merge that makes a token, its two parts, and the token a pair makes.
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.pair: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.pair[a, b] = c
            if self.parts[c] is None:
                self.parts[c], self.rank[c] = (a, b), r
        own = {s: i for s, i in vocab.items() if s not in self.special}
        self.ids = {self.bytes[i]: i for i in own.values()}
        self.automaton = ahocorasick.Automaton()
        for i in own.values():  # the automaton works on text, so bytes stand as Latin-1
            self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.sizes = [len(b) for b in self.bytes]
        self.reach = max(self.sizes)
        self.shorter = self._shorter(own.values())
        self.merged = {}  # compatibility of pairs, filled as they come up
        self.decimal = [str(i) for i in range(size)].__getitem__
        self.split, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        names = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.specials = regex.compile(f"({names})") if names else None
        self.cache: dict[str, tuple[int, str]] = {}

    def _shorter(self, ids) -> dict[int, int]:
        """The longest token that is a proper prefix of each token, -1 if there is none."""
        out = {}
        for i in ids:
            b = self.bytes[i]
            out[i] = next((self.ids[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ids), -1)
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves ``left`` and ``right`` as two tokens when they stand side by side."""
        key = (left, right)
        known = self.merged.get(key)
        if known is None:
            if len(self.merged) >= 1 << 18:
                self.merged.clear()
            known = self.merged[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges, step by step. At each step the facing
        # parts must not have a merge of their own that comes before the merges undone so far.
        rank, parts, pair = self.rank, self.parts, self.pair
        limit = len(self.pair) + 1
        at_right = False  # ties: of two equal merges the left one is done first
        while True:
            joined = pair.get((left, right))
            if joined is not None:
                r = rank[joined]
                if r < limit or (r == limit and at_right):
                    return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left, at_right = a, parts[left][1], False
            else:
                limit, right, at_right = b, parts[right][0], True

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 text of its bytes.

        The automaton's own leftmost-longest tokens are the answer if each is
        compatible with the one before; only else are positions gone back to.
        """
        longest, merged, compatible = self.automaton.iter_long, self.merged, self.compatible
        greedy = [token for _, token in longest(piece)]
        good = 1
        for pair in zip(greedy, greedy[1:]):
            known = merged.get(pair)
            if not (compatible(*pair) if known is None else known):
                break
            good += 1
        else:
            return greedy
        sizes, shorter, reach, n = self.sizes, self.shorter, self.reach, len(piece)
        tokens = greedy[:good]
        at = sum([sizes[t] for t in tokens])
        token = shorter[greedy[good]]
        dead: set[int] = set()
        while at < n:
            last = tokens[-1] if tokens else -1
            while token >= 0:
                end = at + sizes[token]
                if end not in dead:
                    if last < 0:
                        break
                    known = merged.get((last, token))
                    if compatible(last, token) if known is None else known:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at = end
                if at < n:
                    token = next(longest(piece[at : at + reach]))[1]
            else:
                if not tokens:
                    raise ValueError("the vocabulary does not cover every byte")
                dead.add(at)
                token = tokens.pop()
                at -= sizes[token]
                token = shorter[token]
        return tokens

    def _plain(self, text: str, out: list[int]) -> None:
        cache = self.cache
        for piece in (self.split_ascii if text.isascii() else self.split)(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode().decode("latin-1"))
                if len(piece) <= CACHED_CHARS:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[piece] = ids
            out += ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if self.specials is None:
            self._plain(text, out)
            return out
        for i, part in enumerate(self.specials.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.bytes))]
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        total = int(size.sum())
        # Position of every byte: its token's start plus its place within the token.
        place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        return self.buffer[np.repeat(start, size) + place].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ``vocabulary`` is the path of a tokenizer's JSON file, the same on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for batch in batches:
            ids = [np.asarray(t.encode(x.as_py()), np.int32) for x in batch.column(1)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_kind(docs, doc_id)}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for batch in batches:
            texts = pa.array((t.decode(_ints(x)) for x in batch.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_kind(encoded, 'doc_id')}, ids array<int>, text string")


def _ints(x) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else np.empty(0, np.int64)


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(t: Tokenizer, doc_ids: pa.Array, each: Iterator[np.ndarray]) -> pa.RecordBatch:
    n, a, b = [], [], []
    for ids in each:
        n.append(len(ids))
        a.append(hashlib.sha256(",".join(map(t.decimal, ids.tolist())).encode()).hexdigest())
        b.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents, the text decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for batch in batches:
            yield _digested(t, batch.column(0), map(_ints, batch.column(1)))

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_kind(encoded, 'doc_id')}, {_DIGESTS}")


def round_trip(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``digests(encode(docs))``, in one Python stage: a task holds one tokenizer, and ids don't cross to the JVM and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for batch in batches:
            yield _digested(t, batch.column(0), (np.asarray(t.encode(x.as_py()), np.int64) for x in batch.column(1)))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_kind(docs, doc_id)}, {_DIGESTS}")
