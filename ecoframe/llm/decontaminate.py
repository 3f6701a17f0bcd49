"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping segments. A segment of length L with at most e edits keeps at least
L - q + 1 - q * e of its q-grams, and all of them on diagonals that lie within e of each other. Per text, shared q-grams are
counted in overlapping bands of diagonals; bands that reach the bound are verified by banded alignment. Case and kinds of white
space don't count as differences.

The benchmark is the query set: it is taken in blocks of at most `block_chars` characters (read to the driver one at a time and
broadcast, so the size is bounded), and all texts are scanned once a block. Nothing of the texts is shuffled. Items too short
for one edit and a positive bound are searched exactly, by an automaton, and count as whole words only. Short items are allowed
as many edits as leave the bound positive. Pairs of equal q-grams are counted in lots, so a long text of one repeated line needs
no more memory than another.

Defined results: a null or empty text has no hits; an empty item none either; repeated rows give repeated hits; items that share
an id or have none are told under that id, or none; of places that fit equally well, the first in its band is told; empty tables
give no rows; other columns are ignored. Texts of any length are read whole. Offsets are code points in the text as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoframe.llm.common import NO_ID, text_rows

Q = 8
#: Segments with a lower bound are kept apart: more texts reach it by chance, which would cost the others too.
LIGHT = 16
#: A q-gram that occurs more often in its segment is not counted, and the bound is lower by its number.
OFTEN = 3
#: Pairs of a place in a text and one in a segment that are held at a time.
PAIRS = 1 << 19
TABLE = 22


def codes(text: str) -> np.ndarray:
    """Code points, lower case where that keeps the length, white space as a space; one for each of the text's."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    out = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    out[(out >= 9) & (out <= 13)] = 32
    return out


def grams(x: np.ndarray) -> np.ndarray:
    """Hash of the Q = 8 code points from each place on."""
    h = x * np.uint32(0x9E3779B1)
    for step, factor in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F)):
        if len(h) <= step:
            return np.zeros(0, np.uint32)
        h = (h[:-step] * np.uint32(factor)) ^ (h[:-step] >> np.uint32(15)) ^ (h[step:] + np.uint32(0x165667B1))
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
    return h


@dataclass
class Segment:
    item: int
    codes: np.ndarray
    edits: int
    bound: int

    def __post_init__(self):
        self.chars, self.wanted = np.unique(self.codes, return_counts=True)

    def lacks(self, part: np.ndarray) -> int:
        """Characters of the segment that a part of a text lacks: each takes an edit of its own, so most bands need no alignment."""
        which = np.minimum(np.searchsorted(self.chars, part), len(self.chars) - 1)
        there = np.bincount(which[self.chars[which] == part], minlength=len(self.chars))
        return int(np.maximum(self.wanted - there, 0).sum())


def cut_item(length: int, size: int, step: int) -> list[tuple[int, int]]:
    if length <= size:
        return [(0, length)]
    return [(a, a + size) for a in range(0, length - size, step)] + [(length - size, length)]


def often(g: np.ndarray) -> np.ndarray:
    """Whether a q-gram occurs more than OFTEN times in its segment."""
    _, which, times = np.unique(g, return_inverse=True, return_counts=True)
    return times[which] > OFTEN


class Index:
    """Segments of one class with the table of their q-grams. `skip` leaves out those that occur often in their segment."""

    def __init__(self, segments: list[Segment], skip: bool):
        self.segments = segments
        table = []
        for i, s in enumerate(segments):
            g = grams(s.codes)
            offset = np.flatnonzero(~often(g)) if skip else np.arange(len(g))
            table.append((g[offset], np.full(len(offset), i), offset))
        gram = np.concatenate([g for g, _, _ in table])
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.owner = np.concatenate([o for _, o, _ in table])[order]
        self.offset = np.concatenate([o for _, _, o in table])[order]
        self.seen = np.zeros(1 << TABLE, bool)
        self.seen[self.gram >> np.uint32(32 - TABLE)] = True
        self.longest = max(len(s.codes) for s in segments)
        self.window = max(len(s.codes) + s.edits for s in segments)
        self.least = min(s.bound for s in segments)
        self.edits = np.array([s.edits for s in segments], np.int64)
        self.bounds = np.array([s.bound for s in segments], np.int64)

    def dense(self, g: np.ndarray) -> np.ndarray:
        """Places of q-grams of the benchmark, where enough of them lie within one window."""
        at = np.flatnonzero(self.seen[g >> np.uint32(32 - TABLE)])
        if len(at) < self.least:
            return at[:0]
        # The `least`-th after each must lie within the window; all from the one to the other stay.
        k = self.least - 1
        full = at[k:] - at[: len(at) - k] <= self.window
        mark = np.zeros(len(at) + 1, np.int64)
        first = np.flatnonzero(full)
        np.add.at(mark, first, 1)
        np.add.at(mark, first + k + 1, -1)
        return at[np.cumsum(mark[:-1]) > 0]

    def bands(self, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(segment, base) of the bands of diagonals that reach the bound, place by place; PAIRS pairs of place and offset at a time.

        A band spans two widths, so bands overlap by one: each pair counts in the band that it starts and in the one before.
        Counts go on from one lot of places to the next only for bands whose diagonals can still meet a later place.
        """
        at = self.dense(g)
        lo, hi = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        total = np.cumsum(hi - lo)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
            n = hi[a:b] - lo[a:b]
            entry = np.repeat(lo[a:b] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            owner = self.owner[entry]
            base = (np.repeat(at[a:b], n) - self.offset[entry] + self.window) // np.maximum(self.edits[owner], 1)
            key, count = _pairs_counted(owner, base)
            keys, counts = _counted(np.concatenate([keys, key, key - 1]), np.concatenate([counts, count, count]))
            segment, base = keys >> 40, keys & ((1 << 40) - 1)
            if b < len(at):
                width = np.maximum(self.edits[segment], 1)
                shut = (base + 2) * width - self.window <= at[b] - self.longest
            else:
                shut = np.ones(len(keys), bool)
            good = shut & (counts >= self.bounds[segment])
            if good.any():
                yield segment[good], base[good]
            keys, counts, a = keys[~shut], counts[~shut], b

    def hits(self, x: np.ndarray, g: np.ndarray) -> list[tuple[int, int, int, int]]:
        found: list[tuple[int, int, int, int]] = []
        last: dict[int, int] = {}
        for segments, bases in self.bands(g):
            for s, b in zip(segments.tolist(), bases.tolist()):
                seg = self.segments[s]
                w = max(seg.edits, 1)
                low, high = b * w - self.window - seg.edits, b * w - self.window + 2 * w + seg.edits
                if low <= last.get(s, low - 1) <= high:
                    continue  # the neighbouring band has the same match
                hit = equal(seg.codes, x, low, high) or (
                    seg.lacks(x[max(low, 0):high + len(seg.codes)]) <= seg.edits and align(seg.codes, x, low, high, seg.edits))
                if hit:
                    last[s] = hit[0]
                    if found and found[-1][0] == seg.item and found[-1][1] <= hit[0] <= found[-1][2]:
                        found[-1] = (seg.item, found[-1][1], max(found[-1][2], hit[1]), min(found[-1][3], hit[2]))
                    else:
                        found.append((seg.item, *hit))
        return found


def _pairs_counted(owner: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (owner, base) with their counts; by a table where the keys lie close together."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, least = int(owner.min()), int(base.min())
    span = int(base.max()) - least + 1
    if (int(owner.max()) - first + 1) * span > 4 * len(owner):
        return np.unique(owner * (1 << 40) + base, return_counts=True)
    table = np.bincount((owner - first) * span + (base - least))
    at = np.flatnonzero(table)
    return (first + at // span) * (1 << 40) + least + at % span, table[at]


def _counted(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its counts."""
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[edge], np.add.reduceat(count[order], edge)


class Query:
    """One block of the benchmark, made ready for scanning."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float, size: int, step: int):
        self.short = ahocorasick.Automaton()
        classes: dict[str, list[Segment]] = {"long": [], "light": [], "repeating": []}
        for item, text in items:
            x = codes(text.strip())
            # Equal segments of an item are one.
            for a, b in {x[a:b].tobytes(): (a, b) for a, b in cut_item(len(x), size, step)}.values():
                edits = int(edit_rate * (b - a))
                while edits > 0 and b - a - Q + 1 - Q * edits < 1:
                    edits -= 1  # too short for that many
                bound = b - a - Q + 1 - Q * edits
                if edits == 0 and bound < LIGHT:
                    if len(x):
                        plain = "".join(map(chr, x))
                        self.short.add_word(plain, (*self.short.get(plain, ()), (item, len(plain))))
                    continue
                # q-grams that occur often in the segment meet everywhere in a text of such; the others must reach the bound alone.
                left = bound - int(often(grams(x[a:b])).sum())
                kind = "repeating" if left < 1 else "long" if left >= LIGHT else "light"
                classes[kind].append(Segment(item, x[a:b], edits, bound if left < 1 else left))
        self.short.make_automaton()
        self.indexes = [Index(segments, kind != "repeating") for kind, segments in classes.items() if segments]

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits); overlapping ones of an item are one."""
        x = codes(text)
        found: list[tuple[int, int, int, int]] = []
        if len(self.short):
            plain = "".join(map(chr, x))
            for last, owners in self.short.iter(plain):
                found += [(item, last + 1 - n, last + 1, 0) for item, n in owners if _whole(plain, last + 1 - n, last + 1)]
        g = grams(x) if self.indexes else x
        for index in self.indexes:
            found += index.hits(x, g)
        return _merge(found)


def _whole(text: str, start: int, end: int) -> bool:
    """Whether the part neither starts nor ends inside a word."""
    return not (start > 0 and text[start - 1].isalnum() and text[start].isalnum()
                or end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def equal(pattern: np.ndarray, x: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """An occurrence without edits on diagonals low..high, which needs no alignment."""
    low = max(low, 0)
    part, wanted, at = x[low:high + len(pattern)].tobytes(), pattern.tobytes(), -1
    while (at := part.find(wanted, at + 1)) >= 0:
        if at % 4 == 0:
            return low + at // 4, low + at // 4 + len(pattern), 0
    return None


def align(pattern: np.ndarray, x: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """The pattern within diagonals low..high of x, with at most `edits` edits: (start, end, edits) of the best place."""
    end = _banded(pattern, x, low, high)
    if end is None or end[1] > edits:
        return None
    stop, best = end
    n = len(pattern)
    back = _banded(pattern[::-1], x[max(0, stop - n - edits):stop][::-1], -edits, edits)
    return stop - (back[0] if back and back[1] <= best else n), stop, best


def _banded(pattern: np.ndarray, x: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
    """(end in x, edits) of the best alignment of the whole pattern with a part of x on diagonals low..high."""
    k = np.arange(low, high + 1)
    far = len(pattern) + len(x) + 1
    padded = np.full(len(pattern) + len(k) + 1, 0xFFFFFFFF, np.uint32)
    a, b = max(low, 0), min(len(x), low + len(padded))
    if a < b:
        padded[a - low:b - low] = x[a:b]
    row = np.where((k >= 0) & (k <= len(x)), 0, far)
    step = np.arange(len(k))
    for j, c in enumerate(pattern):
        new = row + (padded[j:j + len(k)] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        place = k + j + 1
        new[(place < 0) | (place > len(x))] = far
        row = np.minimum.accumulate(new - step) + step
        row[(place < 0) | (place > len(x))] = far
    best = int(np.argmin(row))
    return (int(k[best]) + len(pattern), int(row[best])) if row[best] < far else None


def _merge(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for item, start, end, edits in sorted(found):
        if out and out[-1][0] == item and start <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(end, out[-1][2]), min(edits, out[-1][3]))
        else:
            out.append((item, start, end, edits))
    return out


def find(docs: DataFrame, benchmark: DataFrame, edit_rate: float = 0.08, size: int = 120, step: int = 60, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, key, print, item_id, start, end, edits): where texts hold passages of the benchmark's items."""
    items = text_rows(benchmark, "item_id").select(F.col("key").alias("item"), "text").filter("text <> ''")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    spark, rows, parts = docs.sparkSession, text_rows(docs), []
    shape = "doc_id long, key long, print long, item_id long, start long, end long, edits long"
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in block])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            query = Query(shared.value, edit_rate, size, step)
            for x in batches:
                out = [(d, k, p, *hit) for d, k, p, t in zip(x["doc_id"], x["key"], x["print"], x["text"]) for hit in query.hits(t)]
                yield pd.DataFrame(out, columns=["doc_id", "key", "print", "item_id", "start", "end", "edits"]).astype({"doc_id": "Int64"})

        parts.append(rows.mapInPandas(run, shape))
    hits = reduce(DataFrame.unionByName, parts)
    return hits.withColumn("item_id", F.when(F.col("item_id") != NO_ID, F.col("item_id")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no passage of the benchmark."""
    hit = find(docs, benchmark).select(F.col("key").alias("__key"), F.col("print").alias("__print")).distinct()
    key, print_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumns({"__key": key, "__print": print_})
    return rows.join(hit, ["__key", "__print"], "left_anti").select(*docs.columns)
