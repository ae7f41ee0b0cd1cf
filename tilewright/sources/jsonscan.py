"""Arrays of objects within large JSON files, read in parallel.

A JSON file is one object whose values are arrays of objects, as annotation
files are. What a byte means depends on whether it stands in a string and how
deep, which all bytes before it decide. So a first job counts, for each range
of bytes, its quotes and its change of depth for either way that it may begin;
the ranges' states follow by adding up. A second job, which knows the states,
finds where the top object's arrays begin and end. A reader then takes a range
of one array: it begins at the first object that starts there, reads on to the
end of the last, and hands each to a JSON parser by itself.

The driver holds a row for each range. Tasks hold a block and an object.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

from tilewright.sources import records, splits
from tilewright.sources.records import FilePart, FileReader, open_path, sizes_below
from tilewright.storage import new_path

SPLIT_BYTES = 32 << 20
BLOCK = 1 << 20
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)


class Scanner:
    """Brackets outside strings, block by block, from a known state."""

    def __init__(self, inside: bool = False, depth: int = 0, escaped: bool = False) -> None:
        self.inside, self.depth, self.escaped = inside, depth, escaped

    def scan(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, depth after each) of the brackets of the next block."""
        n = len(block)
        quotes = np.flatnonzero(block == 34)
        back = block == 92
        if back.any() or self.escaped:
            # Length of the run of backslashes that ends before each place: an odd one escapes a quote.
            last = np.maximum.accumulate(np.where(back, -1, np.arange(n))) if n else np.empty(0, int)
            before = np.r_[-1, last]
            run = np.arange(n + 1) - 1 - before + np.where(before < 0, int(self.escaped), 0)
            quotes = quotes[run[quotes] % 2 == 0]
            self.escaped = bool(run[n] % 2)
        places = np.flatnonzero((block == 91) | (block == 93) | (block == 123) | (block == 125))
        outside = (np.searchsorted(quotes, places) + self.inside) % 2 == 0
        places = places[outside]
        signs = np.where((block[places] == 91) | (block[places] == 123), 1, -1)
        depth = self.depth + np.cumsum(signs)
        self.inside = bool((len(quotes) + self.inside) % 2)
        self.depth = int(depth[-1]) if len(depth) else self.depth
        return places, depth


def _escaped_at(f, at: int) -> bool:
    """Whether an odd run of backslashes ends before a place."""
    run = 0
    while at > 0:
        step = min(at, 4096)
        piece = f.read_at(step, at - step)
        bare = len(piece) - len(piece.rstrip(b"\\"))
        run += bare
        at -= step
        if bare < step:
            break
    return run % 2 == 1


def blocks(f, start: int, end: int, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(start, end, size):
        yield at, np.frombuffer(f.read_at(min(size, end - at), at), np.uint8)


def _summary(r: dict) -> Iterator[tuple]:
    """(path, start, odd number of quotes, change of depth if it begins outside a string, and inside one)."""
    with records._random_access(r["path"]) as f:
        escaped = _escaped_at(f, r["start"])
        two = [Scanner(inside, 0, escaped) for inside in (False, True)]
        for _, block in blocks(f, r["start"], r["end"]):
            for s in two:
                s.scan(block)
        yield r["path"], r["start"], two[0].inside, two[0].depth, two[1].depth


def _arrays(r: dict) -> Iterator[tuple]:
    """(path, place, key) where an array of the top object begins, and (path, place, None) where one ends."""
    with records._random_access(r["path"]) as f:
        s = Scanner(r["inside"], r["depth"], _escaped_at(f, r["start"]))
        for at, block in blocks(f, r["start"], r["end"]):
            places, depth = s.scan(block)
            for i in np.flatnonzero((block[places] == 91) & (depth == 2)).tolist():
                place = at + int(places[i])
                head = _KEY.search(f.read_at(min(place, 4096), max(0, place - 4096)))
                if head is None:
                    raise ValueError(f"{r['path']} isn't an object of arrays")
                yield r["path"], place, json.loads(b'"' + head[1] + b'"')
            for i in np.flatnonzero((block[places] == 93) & (depth == 1)).tolist():
                yield r["path"], at + int(places[i]), None


def index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, suffixes: tuple[str, ...] = (".json",)) -> str:
    """Finds the arrays of the files below ``path``, stores their ranges as lines of JSON and returns the path of that table."""
    ranges = splits._ranges(path, suffixes, split_bytes)
    # A file of one range begins outside of all and need not be counted.
    alone = {r["path"] for r in ranges if r["start"] == 0 and r["end"] == r["size"]}
    told = splits._each(spark, [r for r in ranges if r["path"] not in alone], "path string, start long, odd boolean, out long, into long", _summary)
    by_range, own, inside, depth = {(x.path, x.start): x for x in told}, None, False, 0
    for r in ranges:
        if r["path"] != own:
            own, inside, depth = r["path"], False, 0
        r["inside"], r["depth"] = inside, depth
        if x := by_range.get((own, r["start"])):
            depth += x.into if inside else x.out
            inside ^= x.odd
    events: dict[str, list] = {}
    for x in splits._each(spark, ranges, "path string, place long, key string", _arrays):
        events.setdefault(x.path, []).append((x.place, x.key))
    where = new_path(spark, "arrays")
    system, inner = open_path(where)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner, compression=None) as out:
        for own, found in sorted(events.items()):
            found.sort(key=lambda e: e[0])
            for (begun, key), (ended, closing) in zip(found[::2], [*found[1::2], (-1, None)]):
                if key is None or closing is not None or ended < 0:
                    raise ValueError(f"{own} is cut short")
                for r in ranges:
                    a, b = max(begun + 1, r["start"]), min(ended, r["end"])
                    if r["path"] == own and a < b:
                        state = (False, 2) if a == begun + 1 else (bool(r["inside"]), int(r["depth"]))
                        out.write((json.dumps({"path": own, "key": key, "start": a, "end": b, "inside": state[0], "depth": state[1]}) + "\n").encode())
    return where


def objects(f, start: int, end: int, inside: bool, depth: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the objects of an array that begin in the range."""
    s, held, begun = Scanner(inside, depth, _escaped_at(f, start)), [], None
    at, size = start, f.size()
    while at < end or begun is not None:
        data = f.read_at(block, at)
        if not data:
            raise ValueError("an object is cut short")
        array = np.frombuffer(data, np.uint8)
        places, after = s.scan(array)
        kind = array[places]
        starts, ends = (kind == 123) & (after == 3), (kind == 125) & (after == 2)
        from_ = 0  # where what is held goes on in this block
        for i in np.flatnonzero(starts | ends).tolist():
            place = int(places[i])
            if starts[i]:
                if at + place >= end:
                    return
                begun, from_ = at + place, place
            elif begun is not None:
                yield begun, b"".join([*held, data[from_ : place + 1]])
                held, begun = [], None
        if begun is not None:
            held.append(data[from_:])
        at += len(data)
        if at >= size and begun is not None:
            raise ValueError("an object is cut short")


class ArrayReader(FileReader):
    """The objects of the array called ``section``; subclasses say what a row holds."""

    section = ""

    def parts(self) -> list[FilePart]:
        raise ValueError("arrays are read with the table that jsonscan.index makes")

    def partitions(self) -> list[FilePart]:
        if "arrays" not in self.options:
            return self.parts()
        found = [s for s in records.splits_of(self.options["arrays"]) if s["key"] == self.section]
        # A part's page says whether it begins inside a string, its first how deep.
        return [FilePart(s["path"], int(s["inside"]), s["start"], s["end"], s["depth"]) for s in found] or [FilePart("")]

    def records(self, partition: FilePart) -> Iterator[tuple]:
        with records._random_access(partition.path) as f:
            for place, text in objects(f, partition.start, partition.end, bool(partition.page), partition.first):
                yield (os.path.basename(partition.path), place, *self.row(json.loads(text)))

    def row(self, found: dict) -> tuple:
        raise NotImplementedError
