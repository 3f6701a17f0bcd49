"""What the two substring operators share: which windows may repeat, and where what may be equal meets.

A window is `width` consecutive units (words or bytes). Each window has an anchor, the gram of `gram` units with the smallest
hash inside it (leftmost if equal), so equal windows have equal anchors, at the same place. Consecutive windows share anchors:
a text gives one row for each run of them, not one for each window.

1. Rows meet by anchor. Within an Arrow batch those with equal anchors become one row with a list. Anchors that occur once are
   done: their windows can't repeat.
2. Every other window goes to a shard that depends on its anchor only: the text and the part of it in which the anchor occurs
   first. Texts that share much so share one shard, and runs side by side travel as one piece of text. An anchor that over
   `crowd` texts have is dealt out over several shards by text.
3. A shard finds, by the operator's own method (`settle`), which windows start earlier too. Where an anchor was dealt out, the
   first of each window within a shard is compared by a 128-bit hash with those of the sister shards.
4. Removed runs of windows go back to their texts.

A text is known by (key, print): its id and a hash of it. Texts that share an id, or have none, are told apart, and occurrences
are ordered by (key, print, place). Rows equal in both are one place.

All keys are functions of the data, so a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a packed gram that hold its place; windows are taken in stretches shorter than that.
PLACE = 24
STRETCH = (1 << PLACE) - 4096
#: So many units at most are laid end to end, which keeps what is worked out at once in a processor's cache.
TOGETHER = 1 << 16


@dataclass(frozen=True)
class Units:
    """How texts are cut into units. `hashes`: one 64-bit number a unit; `piece`: the bytes of units a to b."""

    width: int
    gram: int
    split: Callable[[str], object]
    hashes: Callable[[object], np.ndarray]
    piece: Callable[[object, int, int], bytes]
    of_piece: Callable[[bytes], object]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def rolled(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` units from each place on, by doubling."""
    if len(h) < length:
        return h[:0]
    parts, power, size = [], h, 1
    while size <= length:
        if length & size:
            parts.append((size, power))
        if 2 * size <= length:
            power = mix(power[:-size] * np.uint64(0x9E3779B97F4A7C15) + power[size:])
        size *= 2
    size, out = parts[-1]
    for n, part in reversed(parts[:-1]):
        m = len(h) - size - n + 1
        out = mix(out[:m] * np.uint64(0xC2B2AE3D27D4EB4F) + part[size:size + m])
        size += n
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each place on (van Herk)."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1:n])


def runs(h: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor's gram, anchor's place) of the runs of windows that share an anchor."""
    grams = rolled(h, units.gram)
    inside = units.width - units.gram + 1
    windows = len(h) - units.width + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    starts, anchors = [], []
    for a in range(0, windows, STRETCH):
        part = grams[a:min(windows, a + STRETCH) + inside - 1]
        packed = (part & ~np.uint64((1 << PLACE) - 1)) | np.arange(len(part), dtype=np.uint64)
        place = (_least(packed, inside) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        starts.append(first + a)
        anchors.append(place[first] + a)
    start, anchor = np.concatenate(starts), np.concatenate(anchors)
    return start, np.diff(np.concatenate((start, [windows]))), grams[anchor], anchor


def _end_to_end(hashed: list[np.ndarray], units: Units) -> tuple[np.ndarray, ...]:
    """`all_runs` of a few texts in one pass: windows that cross from text to text are left out."""
    lengths = np.array([len(h) for h in hashed])
    windows = np.maximum(lengths - units.width + 1, 0)
    begin, before = np.cumsum(lengths) - lengths, np.cumsum(windows) - windows
    if not windows.any():
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none
    grams = rolled(np.concatenate(hashed), units.gram)
    packed = (grams & ~np.uint64((1 << PLACE) - 1)) | np.arange(len(grams), dtype=np.uint64)
    text = np.repeat(np.arange(len(hashed)), windows)
    at = np.arange(len(text)) + np.repeat(begin - before, windows)
    place = (_least(packed, units.width - units.gram + 1)[at] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    place, text, at = place[first], text[first], at[first]
    return text, at - begin[text], np.diff(np.concatenate((first, windows.sum(keepdims=True)))), grams[place], place - begin[text]


def all_runs(hashed: Iterable[np.ndarray], units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which text, then `runs` of it, for all runs of the texts; `hashed` gives one number a unit of each, and is not held as a whole."""
    none = np.zeros(0, np.int64)
    found, held, size, before = [(none, none, none, np.zeros(0, np.uint64), none)], [], 0, 0
    for h in chain(hashed, [None]):
        if held and (h is None or size + len(h) > TOGETHER):
            if size > TOGETHER:
                one = runs(held[0], units)
                found.append((np.full(len(one[0]), before), *one))
            else:
                text, *some = _end_to_end(held, units)
                found.append((text + before, *some))
            held, size, before = [], 0, before + len(held)
        if h is not None:
            held.append(h)
            size += len(h)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(5))


def anchors(rows: DataFrame, units: Units) -> DataFrame:
    """(gram, key, print, start, n, texts, more): a run of windows; `more` lists key, print, start, n of further runs of the batch with that
    gram, and `texts` says how many texts they are in.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            text, start, n, gram, _ = all_runs((units.hashes(units.split(t)) for t in x["text"]), units)
            key, mark = (x[c].to_numpy(np.int64)[text] for c in ("key", "print"))
            order = np.lexsort((start, mark, key, gram))
            start, n, gram, key, mark = start[order], n[order], gram[order].view(np.int64), key[order], mark[order]
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, int)
            other = np.concatenate(([True], (gram[1:] != gram[:-1]) | (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]))) if len(gram) else np.zeros(0, bool)
            texts = np.add.reduceat(other.astype(np.int32), first) if len(first) else np.zeros(0, np.int32)
            more = np.full(len(first), None, object)
            size = np.diff(np.concatenate((first, [len(gram)])))
            for i in np.flatnonzero(size > 1):
                s = slice(first[i] + 1, first[i] + size[i])
                more[i] = np.stack((key[s], mark[s], start[s], n[s]), 1).ravel()
            yield pd.DataFrame({"gram": gram[first], "key": key[first], "print": mark[first], "start": start[first].astype(np.int32),
                                "n": n[first].astype(np.int32), "texts": texts, "more": more})

    return rows.select("key", "print", "text").mapInPandas(run, "gram long, key long, print long, start int, n int, texts int, more array<long>")


def suspects(found: DataFrame, part: int, crowd: int) -> DataFrame:
    """(key, print, start, n, shard, dealt): runs whose anchor occurs more than once, and the shard that they belong to."""
    same = Window.partitionBy("gram")
    listed = F.when(F.col("more").isNull(), 0).otherwise(F.expr("cast(size(more) div 4 as int)"))
    met = found.withColumns({"times": F.sum(listed + 1).over(same), "among": F.sum("texts").over(same), "first": F.min(F.struct("key", "print", "start")).over(same)}).filter("times > 1")
    rest = F.transform(F.sequence(F.lit(0), listed - 1), lambda i: F.struct(
        F.get("more", 4 * i).alias("key"), F.get("more", 4 * i + 1).alias("print"), F.get("more", 4 * i + 2).cast("int").alias("start"),
        F.get("more", 4 * i + 3).cast("int").alias("n")))
    own = F.array(F.struct("key", "print", "start", "n"))
    every = F.explode(F.when(F.col("more").isNull(), own).otherwise(F.concat(own, rest)))
    met = met.select("among", "first", every.alias("r")).select("r.*", "among", "first")
    shards = F.ceil(F.col("among") / crowd).cast("int")
    shard = F.xxhash64("first.key", "first.print", F.floor(F.col("first.start") / part), shards, F.pmod(F.xxhash64("key", "print"), shards))
    return met.select("key", "print", "start", "n", shard.alias("shard"), (shards > 1).alias("dealt"))


def pieces(rows: DataFrame, runs_of: DataFrame, units: Units) -> DataFrame:
    """(shard, dealt, key, print, start, piece): the text of suspect windows; runs side by side in one shard are one piece."""
    lists = runs_of.groupBy("key", "print").agg(F.array_sort(F.collect_set(F.struct("start", "n", "shard", "dealt"))).alias("runs"))
    # The same columns as in `with_removed`, so that both joins read one exchange of the texts.
    met = _joined(rows, lists, "inner")
    shape = "shard long, dealt boolean, key long, print long, start int, piece binary"
    names = ["shard", "dealt", "key", "print", "start", "piece"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for x in batches:
            out: list[tuple] = []
            for key, mark, text, listed in zip(x["key"], x["print"], x["text"], x["runs"]):
                # Equal rows stand side by side and are one place.
                if before == (before := (key, mark)):
                    continue
                content = units.split(text)
                open_: list = []
                for r in [*listed, None]:
                    if open_ and r is not None and r["start"] == open_[3] and r["shard"] == open_[0]:
                        open_[3] = r["start"] + r["n"]
                        continue
                    if open_:
                        out.append((open_[0], open_[1], key, mark, open_[2], units.piece(content, open_[2], open_[3] + units.width - 1)))
                    if r is not None:
                        open_ = [r["shard"], r["dealt"], r["start"], r["start"] + r["n"]]
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return met.mapInPandas(run, shape)


#: What `settle` gets: pieces (cut into units again), the rank of each piece's text in order, and each piece's first place.
#: What it gives: for each piece, which of its windows start earlier too.
Settle = Callable[[list, np.ndarray, np.ndarray], list[np.ndarray]]


def settled(parts: DataFrame, units: Units, settle: Settle, block: int) -> DataFrame:
    """(key, print, start, n, h1, h2, done): removed runs (done), and windows that sister shards must compare (h1, h2 of the text)."""
    names = ["key", "print", "start", "n", "h1", "h2", "done"]
    dealt = parts.repartition("shard").sortWithinPartitions("shard", "key", "print", "start")

    def solve(x: pd.DataFrame) -> pd.DataFrame:
        contents = [units.of_piece(p) for p in x["piece"]]
        keys, marks, starts = (x[c].to_numpy(np.int64) for c in ("key", "print", "start"))
        order = np.lexsort((marks, keys))
        other = (np.diff(keys[order], prepend=keys[order[:1]]) != 0) | (np.diff(marks[order], prepend=marks[order[:1]]) != 0)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(other)
        out: list[tuple] = []
        for content, key, mark, start, crowded, gone in zip(contents, keys, marks, starts, x["dealt"], settle(contents, rank, starts)):
            edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            for a, b in edges.reshape(-1, 2).tolist():
                out.append((key, mark, start + a, b - a, key, start + a, True))
            if crowded:
                for a in np.flatnonzero(~gone).tolist():
                    h = xxhash.xxh3_128_digest(units.piece(content, a, a + units.width))
                    out.append((key, mark, start + a, 1, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), False))
        return pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for x in batches:
            ends = np.flatnonzero(np.concatenate((x["shard"].to_numpy()[1:] != x["shard"].to_numpy()[:-1], [True]))) + 1
            if held and held[-1]["shard"].iloc[-1] != x["shard"].iloc[0] and size >= block:
                yield solve(pd.concat(held))
                held, size = [], 0
            lengths, a = np.cumsum([len(p) for p in x["piece"]]), 0
            for b in ends.tolist():
                held.append(x.iloc[a:b])
                size += int(lengths[b - 1] - (lengths[a - 1] if a else 0))
                if size >= block and b < len(x):
                    yield solve(pd.concat(held))
                    held, size = [], 0
                a = b
        if held:
            yield solve(pd.concat(held))

    return dealt.select("shard", "dealt", "key", "print", "start", "piece").mapInPandas(
        run, "key long, print long, start int, n int, h1 long, h2 long, done boolean")


def removed_runs(rows: DataFrame, units: Units, settle: Settle, part: int, crowd: int, block: int) -> DataFrame:
    """(key, print, start, n): all windows that start earlier too, as runs; runs may overlap."""
    found = settled(pieces(rows, suspects(anchors(rows, units), part, crowd), units), units, settle, block)
    equal = Window.partitionBy("h1", "h2", "done")
    first = F.min(F.struct("key", "print", "start")).over(equal)
    return found.withColumn("first", first).filter("done or first <> struct(key, print, start)").select("key", "print", "start", "n")


def covered(n: int, listed: list, width: int) -> np.ndarray:
    """Which of n units removed windows cover."""
    mark = np.zeros(n + 1, np.int32)
    for r in listed:
        if r["start"] < n:
            mark[r["start"]] += 1
            mark[min(n, r["start"] + r["n"] + width - 1)] -= 1
    return np.cumsum(mark[:-1]) > 0


def _joined(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    lists = lists.select(F.col("key").alias("k"), F.col("print").alias("p"), "runs")
    here = (F.col("key") == F.col("k")) & (F.col("print") == F.col("p"))
    return rows.join(lists, here, how).select("doc_id", "key", "print", "text", "runs")


def with_removed(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """`rows` with `runs`, the removed runs of each text (null: none)."""
    return _joined(rows, removed.groupBy("key", "print").agg(F.collect_set(F.struct("start", "n")).alias("runs")), "left")
