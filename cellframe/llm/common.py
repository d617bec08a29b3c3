"""What the operators share: the shared folder, written intermediate tables, checked lookups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the six ASCII characters. It is also what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast up to this many rows (of bounded width; where rows hold lists, up to so many items); beyond, it is joined by shuffling.
BROADCAST_ROWS = 20_000
#: A key of over HOT rows is broadcast where keys are split, HOT_KEYS at most: those with most rows.
HOT = 1_000
HOT_KEYS = 20_000

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one of our own in local mode; on a cluster that would lose data, so it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="cellframe-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return _local["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: its lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(table: DataFrame, items: Column | None = None) -> bool:
    """Does a written table have BROADCAST_ROWS rows, and items in them, at most? Reads no more rows than that."""
    n, total = table.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.lit(1) if items is None else items)).first()
    return n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_ROWS


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left", items: Column | None = None) -> DataFrame:
    """df joined to a written table that has one row for each key (null keys meet). Broadcast if it is proven small, else dealt by the keys; adaptive execution splits keys that are skewed."""
    small = is_small(table, items)
    table = table.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in table.columns))
    on = None
    for c in keys:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        on = same if on is None else on & same
    return df.join(F.broadcast(table) if small else table, on, how).drop(*(f"_r_{c}" for c in keys))


def split_hot(rows: DataFrame, table: DataFrame, key: str, count: str) -> tuple[DataFrame, DataFrame]:
    """The inner join of rows to a written table of one row for each key, as two parts: the keys of most rows (HOT_KEYS at most, by the
    table's column of counts) are broadcast, so that none lands in a single task; the others are dealt by the key."""
    hot = written(table.filter(F.col(count) > HOT).orderBy(F.desc(count), key).limit(HOT_KEYS), "hot")
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key), rows.join(keys, key, "left_anti").join(table.join(keys, key, "left_anti"), key)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that columns of our own can't clash with them; row_back undoes it."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")


def row_back(columns: list[str], **fresh: Column) -> list[Column]:
    """The columns of whole_row, some of them replaced."""
    return [(fresh[c] if c in fresh else F.col("_row").getField(c)).alias(c) for c in columns]


def id_columns(column: str) -> list[Column]:
    """A whole-number id for Python workers, as doc_id and _no_id: numbers with nulls among them would arrive as floats."""
    c = F.col(column).cast("long")
    return [F.coalesce(c, F.lit(0)).alias("doc_id"), c.isNull().alias("_no_id")]


def ids_back(ids, missing) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.array(ids, dtype=np.int64), np.array(missing, dtype=bool))


def crc32_of(column: str) -> Column:
    """CRC-32 of the value as text; of the empty string if null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
