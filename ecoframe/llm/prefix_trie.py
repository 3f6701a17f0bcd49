"""A trie over conversations: every distinct sequence of first turns is a node, with totals over its subtree.

1. A turn is known by the 128-bit MD5 of its role and text, so texts move no further than the task that reads them. The turns of
   a conversation pass in order through one task, which chains them: a node's id is the 128-bit hash of its parent's id and its
   own turn. Equal ids are taken as equal sequences.
2. Nodes with over `crowd` members in the first `CUT` levels form the upper tree: at most rows / crowd per level. Every other node
   belongs to the shard of its first ancestor (or itself) that is not crowded, so a first turn that a third of all conversations
   share is split by their later turns.
3. Time-forward processing: Spark sorts the nodes of a shard by falling depth (externally, on disk if need be); each node takes
   what its children have put into a priority queue and puts its own record in for its parent. The queue keeps `HELD` records in
   memory and merges the others from sorted runs on disk. A parent gives its children out with its own conversation.
4. The totals of the shards' roots are added up per parent and carried on over the upper tree in the same way.
5. Members that end at a node are hashed in order, one piece of `1 << PIECE` ids after the other.

A run on disk is an unnamed file of one task, as Spark's own spills are: it ends with the task, and a retry makes it anew.
Conversations are streamed, so a very long one holds its task, but not its memory. All ids and shards are functions of the data.

Defined results: rows without a conversation id belong to none and make no node; null turns come first; turns with equal numbers
are ordered by their hash, so that equal rows are two equal turns; null roles and texts are empty; negative ids have the base
id - id % 20 with the sign of the id, as SQL has it; an empty table has no conversations and gives no rows, not even a root;
further columns are ignored. Very long texts are hashed and counted whole, where they are read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ecoframe.llm.common import cut, words_of

ROOT = bytes(16)
#: Levels that the upper tree can have, members that make a node crowded: at least LEAST_CROWD, at most 1 / SHARES of all.
CUT, LEAST_CROWD, SHARES = 64, 500, 4096
HELD = 100_000
PIECE = 12
EMPTY_HASH = hashlib.sha256().hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, i, turn, words): part -1 is one row for the conversation itself, 0 the turns it takes from the conversation
    at the head of its twenty, 1 its own after as many; i orders them within a part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), F.unhex(mark).alias("turn"),
        F.size(words_of(F.col("text"))).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "turn")
    own = turns.select("conv_id", F.row_number().over(order).alias("i"), "turn", "words")
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4))
    ids = own.filter("i = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), shared.alias("h"))
    heads = own.filter("i <= 3 and conv_id % 20 = 0").withColumnRenamed("conv_id", "head")
    lent = ids.join(heads, (F.col("base") == F.col("head")) & (F.col("i") <= F.col("h"))).select(
        "conv_id", F.lit(0).alias("part"), "i", "turn", "words")
    kept = own.filter(F.col("i") > shared).select("conv_id", F.lit(1).alias("part"), "i", "turn", "words")
    none = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("i"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words"))
    return none.unionByName(lent).unionByName(kept)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words, last): the nodes of each conversation from the root on; last: it ends there."""
    shape = "conv_id long, depth long, node binary, parent binary, words long, last boolean"
    names = ["conv_id", "depth", "node", "parent", "words", "last"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for x in batches:
            out = []
            for conv, turn, words in zip(x["conv_id"].tolist(), x["turn"], x["words"].tolist()):
                # The row of the conversation itself comes first.
                begins = held is None or held[0] != conv
                if held is not None:
                    out.append((*held, begins))
                held = (conv, 0, ROOT, None, 0) if begins else (conv, held[1] + 1, xxhash.xxh3_128_digest(held[2] + turn), held[2], words)
            yield pd.DataFrame(out, columns=names)
        if held is not None:
            yield pd.DataFrame([(*held, True)], columns=names)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "i").select("conv_id", "turn", "words").mapInPandas(run, shape)


def nodes(steps: DataFrame, crowd: int) -> DataFrame:
    """(shard, node, parent, depth, words, conv, n_convs); the shard of crowded nodes of the first levels is null."""
    # At most CUT * members / crowd ids: a proven bound.
    upper = steps.filter(F.col("depth") < CUT).groupBy("node").count().filter(F.col("count") > crowd).select(F.col("node").alias("upper"))
    seen = steps.join(F.broadcast(upper), F.col("node") == F.col("upper"), "left")
    first = F.min(F.when(F.col("upper").isNull(), F.struct("depth", "node"))).over(Window.partitionBy("conv_id"))
    shard = F.when(F.col("upper").isNull(), first["node"]).alias("shard")
    return seen.select(shard, "node", "parent", "depth", "words", "conv_id").groupBy("shard", "node", "parent", "depth", "words").agg(
        F.min("conv_id").alias("conv"), F.count("*").alias("n_convs"))


class Queue:
    """Records for parents, least (level, node) first; beyond `held` of them, sorted runs on disk."""

    def __init__(self, held: int):
        self.held, self.heap, self.runs, self.count = held, [], [], 0

    def put(self, key: tuple, record: tuple) -> None:
        self.count += 1
        heapq.heappush(self.heap, (*key, self.count, record))
        if len(self.heap) > self.held:
            run = tempfile.TemporaryFile()
            for entry in sorted(self.heap):
                pickle.dump(entry, run)
            run.seek(0)
            heapq.heappush(self.runs, (pickle.load(run), len(self.runs), run))
            self.heap = []

    def take(self, key: tuple) -> Iterator[tuple]:
        """All records of the key; none before it are left."""
        while self.heap or self.runs:
            spilled = bool(self.runs) and (not self.heap or self.runs[0][0] < self.heap[0])
            entry = self.runs[0][0] if spilled else self.heap[0]
            if entry[:2] != key:
                return
            yield entry[3]
            if spilled:
                _, i, run = heapq.heappop(self.runs)
                try:
                    heapq.heappush(self.runs, (pickle.load(run), i, run))
                except EOFError:
                    run.close()
            else:
                heapq.heappop(self.heap)


RECORD = ["node", "depth", "conv", "n_convs", "n_children", "n_leaves", "saved_tokens"]
FORWARD = ("node binary, depth long, conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
           "parent binary, parent_conv long")


def time_forward(sorted_nodes: DataFrame, held: int = HELD) -> DataFrame:
    """One pass over nodes in falling depth. `n_children`, `n_leaves` and `below` of the input are what other shards add.

    A node whose parent is in its shard comes out with parent_conv, a root of a shard without it.
    """
    names = [*RECORD, "parent", "parent_conv"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue = Queue(held)
        for x in batches:
            out = []
            for root, node, parent, depth, words, conv, n_convs, children, leaves, below in zip(
                    x["root"], x["node"], x["parent"], x["depth"].tolist(), x["words"].tolist(), x["conv"].tolist(), x["n_convs"].tolist(),
                    x["n_children"].tolist(), x["n_leaves"].tolist(), x["below"].tolist()):
                saved = (n_convs - 1) * words + below
                for record in queue.take((-depth, node)):
                    children, leaves, saved = children + 1, leaves + record[5], saved + record[6]
                    out.append((*record, node, conv))
                record = (node, depth, conv, n_convs, children, leaves if children else 1, saved)
                if root:
                    out.append((*record, parent, None))
                else:
                    queue.put((1 - depth, parent), record)
                if len(out) >= 20_000:
                    yield _frame(out, names)
                    out = []
            yield _frame(out, names)

    columns = ["root", "node", "parent", "depth", "words", "conv", "n_convs", "n_children", "n_leaves", "below"]
    return sorted_nodes.select(*columns).mapInPandas(run, FORWARD)


def _frame(rows: list, names: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"parent_conv": "Int64"})


def ends(steps: DataFrame) -> DataFrame:
    """(end, ends_sha256): the hash of the members that end at a node, in order."""
    pieces = steps.filter("last").groupBy("node", F.shiftright("conv_id", PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for x in batches:
            out = []
            for node, ids in zip(x["node"], x["ids"]):
                if node == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["end", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["end", "ends_sha256"])

    dealt = pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids")
    return dealt.mapInPandas(run, "end binary, ends_sha256 string")


def trie(turns: DataFrame, crowd: int | None = None) -> DataFrame:
    """One row per node of the trie over `turns` (as `rebuilt` gives them)."""
    steps = cut(paths(turns))
    crowd = crowd or max(LEAST_CROWD, steps.filter("depth = 0").count() // SHARES)
    every = cut(nodes(steps, crowd))
    none = [F.lit(0).cast("long").alias(name) for name in ("n_children", "n_leaves", "below")]
    falling = F.col("depth").desc()
    shards = every.filter("shard is not null").select("*", (F.col("node") == F.col("shard")).alias("root"), *none)
    lower = cut(time_forward(shards.repartition("shard").sortWithinPartitions("shard", falling, "node")))
    inbox = lower.filter("parent_conv is null and parent is not null").groupBy(F.col("parent").alias("into")).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    upper = every.filter("shard is null").join(inbox, F.col("node") == F.col("into"), "left").select(
        "node", "parent", "depth", "words", "conv", "n_convs", F.col("parent").isNull().alias("root"),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in ("n_children", "n_leaves", "below")])
    # The upper tree is bounded by CUT * members / crowd.
    top = time_forward(upper.repartition(1).sortWithinPartitions(falling, "node"))
    known = every.filter("shard is null").select(F.col("node").alias("above"), F.col("conv").alias("above_conv"))
    below = lower.join(F.broadcast(known), F.col("parent") == F.col("above"), "left").select(
        *RECORD, F.coalesce("parent_conv", "above_conv").alias("parent_conv"))
    result = below.unionByName(top.select(*RECORD, "parent_conv"))
    return result.join(ends(steps), F.col("node") == F.col("end"), "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"))
