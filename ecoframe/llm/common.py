"""What the text operators share: word rules, row keys, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
#: A missing id sorts after all others.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, a key that is never null and the text that is never null, whatever other columns there are.

    `key` orders as the id does, nulls last; `print` tells apart rows that share an id but not a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"),
        F.xxhash64(text).alias("print"), text.alias("text"))


def marks(docs: DataFrame) -> list[Column]:
    """key and print as in text_rows, and row, a hash of all columns: together they tell apart all rows but equal ones."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"),
            F.xxhash64(*docs.columns).alias("row")]


def only_least(docs: DataFrame, named: DataFrame, component: str) -> DataFrame:
    """The row of `docs` with the least (key, print, row) of each component; `named` has these columns and the component of every row."""
    kept = named.groupBy(component).agg(F.min(F.struct("key", "print", "row")).alias("__least")).select("__least")
    rows = docs.withColumn("__own", F.struct(*marks(docs))).join(kept, F.col("__own") == F.col("__least"))
    return rows.dropDuplicates(["__own"]).select(*docs.columns)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ecoframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows in the shared folder, so that a lost executor doesn't recompute what led to them."""
    scratch(df.sparkSession)
    return df.checkpoint()


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an ordered array of structs."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
