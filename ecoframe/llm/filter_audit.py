"""How five filters overlap: what each removes, repeats and loses in every order in which they can run.

1. One read of the texts gives each document the bits of the filters A to D and two hashes of its text.
2. Duplicate prepass: the hashes name two cells of a counting Bloom filter. Counts are summed over all tasks and saturate at two;
   the cells that two or more rows touch become bitmaps. A text with a cell of its own is unique for sure and moves no further.
3. Texts of the other rows (true copies, and about 1 % of the unique texts) are grouped by the whole text for the least id.
   A possible repeat fails E unless it is the row with that id.
4. Flags and labels give counts per (part, mask, labels). They add up, so all 120 orders are read from at most 128 counts a part.

The bitmaps are broadcast. They grow with the rows up to `MOST_CELLS` bits (32 MB) and no further: with more rows than cells more
unique texts reach step 3, and the result stays the same.

Defined results: a null text is empty, an empty text has no words, fails A alone of A to D and equals other empty texts; a null id
is larger than all others, so such a row fails E only if a row with an id has its text, and has no labels; rows equal in id and
text are no repeats of each other; a document with several label rows is good or toxic if any of them says so; a null source is
the part ''; an empty table gives no rows; columns beyond id, text and source are ignored. Texts of any length are read whole, one
Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecoframe.llm.common import NO_ID, cut

FILTERS = "ABCDE"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SPECIAL = b"#$%&*|"
CELLS_PER_ROW = 16
LEAST_CELLS, MOST_CELLS = 1 << 15, 1 << 28
#: Bits in one bitmap of Spark's bitmap functions.
BITMAP = 32768


def _texts(docs: DataFrame) -> DataFrame:
    """key, part, text and two hashes of the text that are computed apart from each other."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col("source"), F.lit("")).alias("part"),
        text.alias("text"), F.xxhash64(text).alias("h1"), (F.hash(text).cast("long") * F.lit(2**32) + F.crc32(text)).alias("h2"))


def _mask(text: bytes, points: int) -> int:
    """Bits of A to D; words end at the six ASCII blanks, as bytes.split() has it."""
    words = text.split()
    a = len(words) < 200
    b = 100 * len(set(words)) < 50 * len(words)
    c = 100 * (len(text) - len(text.translate(None, UPPER))) > 2 * points
    d = len(text.translate(None, SPECIAL)) < len(text)
    return a | b << 1 | c << 2 | d << 3


def measured(docs: DataFrame) -> DataFrame:
    """(key, part, h1, h2, mask, n): rows equal in all of it are one row that counts n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            text = x.column("text")
            masks = [_mask(t, n) for t, n in zip(text.cast(pa.binary()).to_pylist(), pc.utf8_length(text).to_pylist())]
            rest = [x.column(name) for name in ("key", "part", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(masks, pa.int32())], ["key", "part", "h1", "h2", "mask"])

    rows = _texts(docs).select("key", "part", "h1", "h2", "text").mapInArrow(run, "key long, part string, h1 long, h2 long, mask int")
    return rows.groupBy("key", "part", "h1", "h2", "mask").agg(F.count("*").alias("n"))


def cells_for(rows: int) -> int:
    """A power of two."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS_PER_ROW * rows).bit_length()))


def _cells(cells: int) -> list[Column]:
    return [F.col(h).bitwiseAND(F.lit(cells - 1)) for h in ("h1", "h2")]


def crowded(rows: DataFrame, cells: int) -> DataFrame:
    """(bucket, bits): the cells of the sketch that two rows or more touch, as bitmaps."""
    counts = rows.select("n", F.explode(F.array_distinct(F.array(*_cells(cells)))).alias("cell")).groupBy("cell").agg(F.sum("n").alias("n"))
    met = counts.filter("n > 1").select((F.col("cell") + 1).alias("cell"))
    return met.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def possible_repeats(rows: DataFrame, bitmaps: DataFrame, cells: int) -> DataFrame:
    """Rows of which every cell is crowded. `bitmaps` holds at most MOST_CELLS bits."""
    for i, cell in enumerate(_cells(cells)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"bucket{i}"), F.col("bits").alias(f"bits{i}")))
        place = F.pmod(cell, F.lit(BITMAP)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"bits{i}"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        rows = rows.join(side, F.bitmap_bucket_number(cell + 1) == F.col(f"bucket{i}")).filter(
            F.call_function("getbit", byte, F.pmod(place, F.lit(8))) == 1).drop(f"bucket{i}", f"bits{i}")
    return rows


def first_ids(docs: DataFrame, bitmaps: DataFrame, cells: int) -> DataFrame:
    """(h1, h2, least): the least id of every whole text that may repeat."""
    met = possible_repeats(_texts(docs).select("key", "text", "h1", "h2"), bitmaps, cells)
    return met.groupBy("h1", "h2", "text").agg(F.min("key").alias("least")).select("h1", "h2", "least")


def flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the filters that a document fails, bit 0 for A to bit 4 for E; n equal documents."""
    rows = cut(measured(docs))
    cells = cells_for(rows.count())
    bitmaps = cut(crowded(rows, cells))
    least = first_ids(docs, bitmaps, cells).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "least")
    # The cells are a function of the hashes, so a text is a possible repeat in both reads or in none.
    maybe = possible_repeats(rows, bitmaps, cells)
    here = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("key") == F.col("least"))
    later = maybe.join(least, here, "left_anti").select("key", "part", "h1", "h2", "mask", "n", F.lit(16).alias("e"))
    every = rows.withColumn("e", F.lit(0)).unionByName(later)
    # A row that fails E is there twice, once with the bit: the sum of the bits is its mask.
    joined = every.groupBy("key", "part", "h1", "h2", "mask", "n").agg(F.sum("e").alias("e"))
    return joined.select(F.when(F.col("key") < NO_ID, F.col("key")).alias("doc_id"), "part",
                         (F.col("mask") + F.col("e")).cast("int").alias("mask"), "n")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part with these failed filters and labels."""
    says = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = flags(docs).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    # Rows without an id have no label and are not sent to the join.
    with_id = rows.filter("doc_id is not null").join(says, F.col("doc_id") == F.col("id"), "left").select("part", "mask", "good", "toxic", "n")
    without = rows.filter("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    both = with_id.unionByName(without)
    no = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    return both.groupBy("part", "mask", no("good"), no("toxic")).agg(F.sum("n").alias("n"))


def _places() -> list[tuple[int, int, str, int]]:
    """(filters before, own filter, order, step) of every step of every order."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append((before, bit, order, step))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: counts of kept, removed, redundant and solely failing documents, losses, Shapley sums.

    What a step does depends on the set of filters before it, not on their order: 80 pairs (set, filter) are counted and written
    out to the 600 steps.
    """
    places = _places()
    pairs = sorted({(before, bit) for before, bit, _, _ in places})
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("bit")) for a, b in pairs]))
    rows = mask_counts(docs, labels).select("*", pair.alias("p")).select("*", "p.before", "p.bit")
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    n_if = lambda condition, name: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)
    counted = rows.groupBy("part", "before", "bit").agg(
        n_if(~earlier & ~fails, "kept"), n_if(~earlier & fails, "removed"), n_if(earlier & fails, "redundant"),
        n_if(F.col("mask") == F.col("bit"), "unique_fails"), n_if(~earlier & fails & F.col("good"), "good_lost"),
        n_if(~earlier & fails & F.col("toxic"), "toxic_lost"))
    # A set of k filters stands before a given filter in k! (4 - k)! of the orders.
    times = F.lit(0)
    for k in range(5):
        times = F.when(F.bit_count("before") == k, factorial(k) * factorial(4 - k)).otherwise(times)
    counted = counted.withColumn("shapley", F.sum(F.col("removed") * times).over(Window.partitionBy("part", "bit")))
    steps = docs.sparkSession.createDataFrame(places, "before int, bit int, filter_order string, step int")
    return counted.join(F.broadcast(steps), ["before", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
