"""SimHash near-duplicates by deletion variants.

Fingerprints that differ in at most `bits` bits are cut into bits // 2 + 1 segments, so that one segment differs in at most one
bit. Each fingerprint is indexed under every segment with one bit left open (64 rows for any number of segments); equal keys
meet, and the full distance is verified. Fingerprints stand for all their copies before they are indexed.

Within a key no pairs are listed: from one fingerprint the search takes all unclaimed ones near it, then goes on from those, and
gives one link for each fingerprint that it claims. A key with over `block` fingerprints is dealt in blocks, and every two of its
blocks meet in a task of their own, so no link is lost and no task sees the whole key.

Defined results: a null or empty text has fingerprint zero, linked like any other; repeated rows get equal results; a null id
is larger than any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ecoframe.llm.common import NO_ID, cut, marks, only_least, text_rows
from ecoframe.llm.components import connected

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
CHUNK = 1 << 16


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the hashes of the `width`-word shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    ends, digest = ends[width - 1:], xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, CHUNK):
        counts += set_bits(np.array([digest(joined[s:e], seed) for s, e in zip(starts[k:k + CHUNK].tolist(), ends[k:k + CHUNK].tolist())], np.uint64))
    return majority(counts, n)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many of the 64-bit hashes each bit is set, the highest bit first."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(octets) < 256:
        return np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return np.concatenate([np.bincount(octets[:, j], minlength=256) @ BITS for j in range(8)])


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint: the bits that are set in over half of n hashes."""
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, marked: bool = False) -> DataFrame:
    """doc_id, key, fp (the 64 bits as a signed long) of every row; of `marked` rows also print and row, which tell them apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp = np.array([fingerprint(t, width, seed) for t in x.pop("text")], np.uint64).view(np.int64)
            yield x.assign(fp=fp)

    if marked:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *marks(docs), F.coalesce("text", F.lit("")).alias("text"))
        return rows.mapInPandas(run, "doc_id long, key long, print long, row long, fp long")
    return text_rows(docs).select("doc_id", "key", "text").mapInPandas(run, "doc_id long, key long, fp long")


def segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, length) of the segments of which one differs in at most one bit."""
    n = bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def variants(prints: DataFrame, bits: int) -> DataFrame:
    """(variant, fp): each segment with one bit open; a variant is a string of bits and the place of the open one."""
    keys = []
    for lo, length in segments(bits):
        for j in range(length):
            rest = ((1 << length) - 1) & ~(1 << j)
            part = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(lo)).bitwiseAND(F.lit(rest).cast("long"))
            keys.append(F.struct(F.lit(lo + j).cast("byte").alias("open"), part.alias("rest")))
    return prints.select("fp", F.explode(F.array(*keys)).alias("v")).select("v.open", "v.rest", "fp")


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected at up to `bits` bits; each fingerprint is claimed once."""
    links, left = [], np.unique(fps)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                claimed = left[near]
                links += [(at, x) for x in claimed]
                front += list(claimed)
                left = left[~near]
    return links


def link(prints: DataFrame, bits: int = 4, block: int = 20_000) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within `bits` bits of each other."""
    key = Window.partitionBy("open", "rest")
    met = variants(prints, bits).select("open", "rest", "fp", *[f("fp").over(key).alias(n) for f, n in ((F.count, "n"), (F.min, "lo"), (F.max, "hi"))])
    met = met.filter((F.col("n") > 2) | ((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= bits)))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.least(own, o).cast("long") * (1 << 31) + F.greatest(own, o))
    dealt = met.select("open", "rest", F.explode(F.when(F.col("n") <= block, F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("pair"), "fp")
    dealt = dealt.repartition("open", "rest", "pair").sortWithinPartitions("open", "rest", "pair", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        names = ["open", "rest", "pair"]

        def links(x: pd.DataFrame) -> pd.DataFrame:
            starts = np.flatnonzero(np.concatenate(([True], (x[names].to_numpy()[1:] != x[names].to_numpy()[:-1]).any(1)))) if len(x) else []
            fps = x["fp"].to_numpy()
            out = [pair for part in np.split(fps, starts[1:]) if len(part) > 1 for pair in _forest(part, bits)] if len(x) else []
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        for x in batches:
            last = (x[names] == x[names].iloc[-1]).all(axis=1).to_numpy()
            whole = x[~last]
            if len(whole) or (held and (held[-1][names].iloc[-1] != x[names].iloc[-1]).any()):
                yield links(pd.concat([*held, whole]))
                held = []
            held.append(x[last])
        if held:
            yield links(pd.concat(held))

    return dealt.mapInPandas(run, "a long, b long").distinct()


def group(docs: DataFrame, bits: int = 4, width: int = 4, seed: int = 42, marked: bool = False) -> DataFrame:
    """The columns of fingerprints, component (the smallest key that links reach) and root (its own fingerprint) of every row of `docs`."""
    rows = cut(fingerprints(docs, width, seed, marked))
    prints = cut(rows.groupBy("fp").agg(F.min("key").alias("least")))
    roots = connected(link(prints.select("fp"), bits))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select(F.col("fp").alias("own"), "root", "component")
    return rows.join(named, rows["fp"] == named["own"]).drop("own")


def components(docs: DataFrame, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id."""
    component = F.when(F.col("component") != NO_ID, F.col("component"))
    return group(docs, bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def representatives(docs: DataFrame, bits: int = 4) -> DataFrame:
    """One row of `docs` for each component, that of the smallest id (then hash of the text, then of the row), with the columns of `docs`."""
    return only_least(docs, group(docs, bits, marked=True), "root")
