"""Substring dedup by a hash-compared suffix sort.

Byte windows of `width` that may repeat meet in shards (see `repeats`). A shard lays its pieces of text end to end and keeps
prefix hashes (a polynomial over 64 bits). The common extension of two suffixes is found by binary search on these hashes, so
comparing two suffixes takes a logarithmic number of steps; with that comparison the suffixes are merge-sorted, all merges of a
level at once. First the suffixes at which runs of windows start are sorted, as far as the run reaches: equal runs are settled as
a whole. Then those at each window of what is left are. Suffixes that agree on a window stand side by side; equal hashes
are verified byte by byte.

Defined results: a null or empty text has no bytes; texts under `width` bytes lose none; rows that repeat an id with its text
are one occurrence; a null id is later than any other; empty tables give no rows; other columns are ignored. Texts that
share an id, or have none, are apart, in the order of the hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ecoframe.llm.common import text_rows
from ecoframe.llm.repeats import Units, all_runs, covered, mix, removed_runs, with_removed

WIDTH, GRAM = 100, 32
BASE = np.uint64(0x2545F4914F6CDD1D)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
#: The lowest 0 to 8 bytes of a word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def split(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def hashes(data: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(data, np.uint8)]


UNITS = Units(WIDTH, GRAM, split, hashes, lambda data, a, b: data[a:b], lambda piece: piece)


class Suffixes:
    """Prefix hashes of one stretch of bytes, and the sort of suffixes by them."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        n = len(data)
        # The eight bytes from each place on.
        self.words = np.ndarray((n,), "<u8", data + bytes(8), strides=(1,))
        self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, BASE))))
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[self.bytes] * self.power[:-1])))

    def extension(self, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, up to `depth`."""
        low = depth.astype(np.int64)
        # Most of what is compared is equal all the way.
        open_ = np.flatnonzero(~self._same(a, b, low))
        a, b, high = a[open_], b[open_], low[open_] - 1
        least = np.zeros(len(a), np.int64)
        while (part := np.flatnonzero(least < high)).size:
            mid = (least[part] + high[part] + 1) >> 1
            same = self._same(a[part], b[part], mid)
            least[part], high[part] = np.where(same, mid, least[part]), np.where(same, high[part], mid - 1)
        low[open_] = least
        return low

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n bytes from a and from b on have one hash."""
        x, y = self.prefix[a + n] - self.prefix[a], self.prefix[b + n] - self.prefix[b]
        ahead = b - a
        x *= self.power[np.maximum(ahead, 0)]
        y *= self.power[np.maximum(-ahead, 0)]
        return x == y

    def windows(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """One hash for the `depth` bytes from each place on."""
        return (self.prefix[at + depth] - self.prefix[at]) * self.power[len(self.bytes) - at]

    def below(self, a: np.ndarray, b: np.ndarray, depth: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffix at a sorts before that at b (or is equal to it)."""
        shared = self.extension(a, b, depth)
        end = shared >= depth
        at = np.minimum(shared, np.maximum(depth - 1, 0))
        return np.where(end, or_equal, self.bytes[a + at] < self.bytes[b + at])

    def sort(self, at: np.ndarray, group: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group, equal ones in the order given; groups stand together. Depths agree in a group."""
        n = len(at)
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [n])))
        base, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        order, width = np.arange(n), 1
        while width < (sizes.max() if n else 0):
            place = np.arange(n) - base
            block = place // width
            left = block % 2 == 0
            other = np.where(left, block + 1, block - 1) * width
            low, high = np.minimum(other, size), np.minimum(other + width, size)
            active = np.flatnonzero(high > low)
            lo, hi = low[active] + base[active], high[active] + base[active]
            own, is_left, d = at[order[active]], left[active], depth[order[active]]
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                mine, theirs, dd, ll = own[open_], at[order[mid]], d[open_], is_left[open_]
                # A left element goes before equal ones of the right block, a right element after equal ones of the left.
                shared = self.extension(theirs, mine, dd)
                k = np.minimum(shared, np.maximum(dd - 1, 0))
                before = np.where(shared >= dd, ~ll, self.bytes[theirs + k] < self.bytes[mine + k])
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            target = np.arange(n)
            start_of_other = low[active] + base[active]
            pair = np.minimum(block[active], np.where(is_left, block[active] + 1, block[active] - 1)) * width
            target[active] = base[active] + pair + (place[active] - block[active] * width) + (lo - start_of_other)
            new = np.empty_like(order)
            new[target] = order
            order, width = new, 2 * width
        return order

    def equal_to_previous(self, order: np.ndarray, at: np.ndarray, group: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Whether each suffix of `order` agrees with the one before it, verified byte by byte."""
        out = np.zeros(len(order), bool)
        if len(order) < 2:
            return out
        b, a = order[1:], order[:-1]
        same = np.flatnonzero((group[a] == group[b]) & (depth[a] == depth[b]))
        hit = same[self.extension(at[a[same]], at[b[same]], depth[a[same]]) >= depth[a[same]]]
        for k in range(0, len(hit), 1 << 16):
            part = hit[k:k + (1 << 16)]
            x, y, d = at[a[part]], at[b[part]], depth[a[part]]
            ok, live, j = np.ones(len(part), bool), np.arange(len(part)), 0
            # Eight bytes at a time, the last ones up to the end; of less than eight only those that count.
            while (live := live[ok[live] & (d[live] > j)]).size:
                step = np.maximum(np.minimum(j, d[live] - 8), 0)
                other = self.words[x[live] + step] ^ self.words[y[live] + step]
                ok[live] = (other & _MASKS[np.minimum(d[live], 8)]) == 0
                j += 8
            out[part + 1] = ok
        return out


def _later(s: Suffixes, at: np.ndarray, group: np.ndarray, depth: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which suffixes agree with one of their group that stands earlier (key, start). Rows come in any order.

    A suffix whose hash, as far as it reaches, is no other's in its group agrees with none and isn't sorted.
    """
    several = _several(mix(s.windows(at, depth)) + depth.astype(np.uint64), group)
    by = several[np.lexsort((start[several], key[several], depth[several], group[several]))]
    out = np.zeros(len(at), bool)
    at, group, depth, key, start = at[by], group[by], depth[by], key[by], start[by]
    apart = np.cumsum(np.concatenate(([0], ((group[1:] != group[:-1]) | (depth[1:] != depth[:-1])).astype(np.int64)))) if len(at) else group
    order = s.sort(at, apart, depth)
    equal = s.equal_to_previous(order, at, apart, depth)
    lead = np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))
    later = (key[order] != key[order[lead]]) | (start[order] != start[order[lead]])
    out[by[order]] = later
    return out


def _numbered(gram: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One number for each pair of gram and place."""
    return np.unique(mix(gram + np.uint64(0x9E3779B97F4A7C15) * place.astype(np.uint64)), return_inverse=True)[1]


def _several(gram: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where a pair of gram and place occurs more than once."""
    if not len(gram):
        return np.zeros(0, np.int64)
    inverse = _numbered(gram, place)
    return np.flatnonzero(np.bincount(inverse)[inverse] > 1)


def locate(contents: list[bytes], keys: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Which windows of each piece start earlier too, within the pieces given; `keys` rank the texts."""
    base = np.concatenate(([0], np.cumsum([len(c) for c in contents])))
    s = Suffixes(b"".join(contents))
    piece, start, n, gram, anchor = all_runs((_BYTES[s.bytes[a:b]] for a, b in zip(base, base[1:])), UNITS)
    gone = np.zeros(base[-1], bool)
    # Suffixes can agree only if they have the same anchor at the same place, and reach equally far.
    ahead = anchor - start
    many = _several(gram, n * (1 << 32) + ahead)
    at, key, place = start[many] + base[piece[many]], keys[piece[many]], start[many] + starts[piece[many]]
    later = np.zeros(len(start), bool)
    later[many] = _later(s, at, _numbered(gram[many], ahead[many]), n[many] + WIDTH - 1, key, place)
    mark = np.zeros(base[-1] + 1, np.int32)
    first = start + base[piece]
    np.add.at(mark, first[later], 1)
    np.add.at(mark, first[later] + n[later], -1)
    gone |= np.cumsum(mark[:-1]) > 0
    # Single windows of the runs that stay, where an anchor has more than one of them.
    left = np.flatnonzero(~later)
    left = left[_several(gram[left], np.zeros(len(left), np.int64))]
    step = np.arange(n[left].sum()) - np.repeat(np.cumsum(n[left]) - n[left], n[left])
    run = np.repeat(left, n[left])
    many = _several(gram[run], ahead[run] - step)
    run, step = run[many], step[many]
    w_at, key, place = first[run] + step, keys[piece[run]], start[run] + starts[piece[run]] + step
    gone[w_at[_later(s, w_at, _numbered(gram[run], ahead[run] - step), np.full(len(run), WIDTH), key, place)]] = True
    return [gone[a:b - WIDTH + 1] for a, b in zip(base, base[1:])]


def dedup(docs: DataFrame, part: int = 2048, crowd: int = 4096, block: int = 1 << 21) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every row: bytes that an earlier window covers are removed."""
    return _apply(docs, part, crowd, block, True)


def summary(docs: DataFrame, part: int = 2048, crowd: int = 4096, block: int = 1 << 21) -> DataFrame:
    """`dedup` without the bytes."""
    return _apply(docs, part, crowd, block, False)


def _apply(docs: DataFrame, part: int, crowd: int, block: int, texts: bool) -> DataFrame:
    rows = text_rows(docs).select("doc_id", "key", "print", "text")
    met = with_removed(rows, removed_runs(rows, UNITS, locate, part, crowd, block))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out: list[tuple] = []
            for text, listed in zip(x["text"], x["runs"]):
                data = split(text)
                kept, spans = data, 0
                if listed is not None:
                    gone = covered(len(data), listed, WIDTH)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    spans = int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1).sum())
                out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            done = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield pd.concat([x[["doc_id"]].reset_index(drop=True), done], axis=1)

    out = met.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if texts else out.drop("kept")
