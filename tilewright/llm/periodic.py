"""Periodic runs by catching squares online.

Words are appended one at a time. Whenever a power-of-two block of words is
complete it gets a name (the pair of its halves' names), and from then on acts
as a catcher: when the words just appended have the name of a block that lies
``q`` words back, ``q`` may be the period of a square, and a suffix comparison
for ``q`` begins. A square of period ``q`` holds in its first half a whole
aligned block of ``2 ** k`` words where ``2 ** (k + 1) - 1 <= q``, so a block
of level ``k`` looks after periods from ``2 ** (k + 1) - 1`` up to the next
level's; two blocks of each level can match at a time.

The comparison is extended to the left at once and settled when the square's
last word has come. A square that is not the power of a shorter period opens a
run, which each appended word prolongs or ends. Comparisons use running hashes
where they are long, and no square is reported before its words were compared
themselves, so a text of n words takes about n log n steps, whatever it holds.

Defined results: a null text or one without words has no runs and an empty
collapsed text; ids may be of any type, null or repeated, and each row keeps
its row; very long texts take memory in proportion to their words; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.tensor import let

MIN_LENGTH = 12
#: Comparisons up to so many words are made directly, longer ones by hash first.
_DIRECT = 64
_MOD, _BASE = (1 << 61) - 1, 0x1F2E3D4C5B6A798
_SPACES = r"[\x20\x09-\x0D]+"


class SquareCatcher:
    """Finds the runs of a sequence of small integers (one for each distinct word) as it is appended."""

    def __init__(self) -> None:
        self.words: list[int] = []
        self.names: dict[tuple[int, int], int] = {}  # of two halves: the name of the whole, below zero
        self.blocks: list[list[int]] = [self.words]  # by level: names of the completed blocks
        self.ended: list[list[int]] = [[]]  # by level: where a named window ended last, and
        self.called: list[list[int]] = [[]]  # its name, at the end modulo the level's size
        self.running: dict[int, int] = {}  # period: start of the run that holds the last word
        self.waiting: dict[int, int] = {}  # period: start of the square that may be coming
        self.due: dict[int, list[tuple[int, int]]] = {}  # last word of a coming square: (start, period)
        self.hashes = [0]
        self.found: list[tuple[int, int, int]] = []  # (start, end, period)

    def append_all(self, words: Iterable[int]) -> None:
        w, blocks, running, due, name_of, ended, called = self.words, self.blocks, self.running, self.due, self.names.get, self.ended, self.called
        catch, complete = self._catch, self._complete
        last, second = (w[-1] if w else None), (w[-2] if len(w) > 1 else None)
        for i, x in enumerate(words, len(w)):
            w.append(x)
            if running:
                for q in [q for q in running if w[i - q] != x]:
                    self.found.append((running.pop(q), i, q))
            if i in due:
                for s, q in due.pop(i):
                    if self.waiting.get(q) == s:
                        del self.waiting[q]
                    self._settle(s, q, i)
            if x == last:
                catch(i - 1, 1, i)
            if x == second:
                catch(i - 2, 2, i)
            name, k = name_of((last, x)), 1
            while name is not None:
                size = 1 << k
                back = i - 3 * size + 2  # the nearest start that this level looks after
                b = back >> k
                if b >= 0:
                    named = blocks[k]
                    if named[b] == name:
                        catch(b << k, i + 1 - size - (b << k), i)
                    if b and named[b - 1] == name:
                        catch((b - 1) << k, i + 1 - size - ((b - 1) << k), i)
                at = i & (size - 1)
                left = called[k][at] if ended[k][at] == i - size else None
                ended[k][at], called[k][at] = i, name
                if left is None:
                    break
                name, k = name_of((left, name)), k + 1
            if i & 1:
                complete(i + 1)
            last, second = x, last

    def _complete(self, n: int) -> None:
        """Names the blocks that end with the n-th word."""
        blocks, names, k = self.blocks, self.names, 1
        while not n & ((1 << k) - 1):
            if k == len(blocks):
                blocks.append([])
                self.ended.append([-(1 << k) - 1] * (1 << k))
                self.called.append([0] * (1 << k))
            halves = (blocks[k - 1][-2], blocks[k - 1][-1])
            blocks[k].append(names.setdefault(halves, -len(names) - 1))
            k += 1

    def _powered(self, s: int, q: int) -> bool:
        """Whether a run of a shorter period, of which q is a multiple, holds all from s on."""
        return any(q % p == 0 and begun <= s for p, begun in self.running.items() if p < q)

    def _catch(self, a: int, q: int, i: int) -> None:
        """The block at a stands again q words later, at the end."""
        if q in self.running or self._powered(a, q):
            return
        w, s = self.words, a
        stop = max(0, a - _DIRECT)
        while s > stop and w[s - 1] == w[s - 1 + q]:
            s -= 1
        if s == stop and s:
            s -= self._equal_before(s, q)
        if self.waiting.get(q) == s:
            return
        end = s + 2 * q - 1
        if end <= i:
            self._settle(s, q, i)
        else:
            self.waiting[q] = s
            self.due.setdefault(end, []).append((s, q))

    def _settle(self, s: int, q: int, i: int) -> None:
        """Opens a run if all from s to word i has period q, and no shorter one."""
        if q in self.running or self._powered(s, q):
            return
        w, n = self.words, i + 1 - q - s
        if w[i] != w[i - q] or w[s : s + _DIRECT][:n] != w[s + q : s + q + _DIRECT][:n]:
            return
        if n > _DIRECT and (self._hash(s, s + n) != self._hash(s + q, i + 1) or w[s : s + n] != w[s + q : i + 1]):
            return
        self.running[q] = s

    def _hash(self, a: int, b: int) -> int:
        h, w = self.hashes, self.words
        while len(h) <= b:
            h.append((h[-1] * _BASE + w[len(h) - 1] + 1) % _MOD)
        return (h[b] - h[a] * pow(_BASE, b - a, _MOD)) % _MOD

    def _equal_before(self, s: int, q: int) -> int:
        """How many words before s equal those q later; a false equality of hashes is undone by comparing the words."""
        low, high = 0, s
        while low < high:
            m = (low + high + 1) // 2
            if self._hash(s - m, s) == self._hash(s - m + q, s + q):
                low = m
            else:
                high = m - 1
        w = self.words
        if w[s - low : s] != w[s - low + q : s + q]:
            low = next(m for m in count() if m == s or w[s - m - 1] != w[s - m - 1 + q])
        return low

    def runs(self, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs so far, by start and period."""
        n = len(self.words)
        all_runs = [*self.found, *((s, n, q) for q, s in self.running.items())]
        return sorted((s, e - s, q) for s, e, q in all_runs if e - s >= min_length)


def runs_of(words: list, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words."""
    number = defaultdict(count().__next__)
    catcher = SquareCatcher()
    catcher.append_all(map(number.__getitem__, words))
    return catcher.runs(min_length)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period; ``runs`` come by start."""
    out, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        if b > at:
            out += words[at:a]
            at = max(at, b)
    return out + words[at:]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each document's runs in words, and its text without their repetitions.

    A run is a stretch of the words ``[^\\x20\\x09-\\x0D]+`` with a least period q
    and a length of max(min_length, 2 q) or more that can't be prolonged.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts = [], [], []
            for body in batch.column(1):
                words = body.as_py().split()  # of bytes, so at ASCII white space alone
                found = runs_of(words, min_length)
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(collapsed(words, found)))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(search, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def words(text: Column) -> Column:
    """The words that ``find`` sees, as an array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")


def longest(runs: Column) -> Column:
    """(length, before, below) of the longest run, the earliest and then of the least period; null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("below"))))


def listed(runs: Column) -> Column:
    """All runs as lines ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")


def looped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a loop planted in one text of ten, chosen by h = crc32 of the id as text.

    Where h mod 10 is 0, g = h div 10 and n words: from word a = g mod n on the
    text repeats its p = 1 + (n - a) div (3 + g mod 8) words from a. Rows of null
    id stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        head, unit = F.slice(w, 1, a), F.slice(w, a + 1, p)
        copies = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.concat(head, F.slice(F.flatten(F.array_repeat(unit, copies)), F.lit(1), n - a)), " ")

    chosen = (h % 10 == 0) & F.col(doc_id).isNotNull()
    planted = let(words(F.col(text)), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(F.col(text)))
    return docs.withColumn(text, F.when(chosen, planted).otherwise(F.col(text)))
