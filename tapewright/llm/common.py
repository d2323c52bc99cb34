"""Helpers shared by the training-data operators: shared-folder tables, words, gapless ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Regular expression of a word in Spark's dialect: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may fall back to a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_tapewright_dir"):
        spark._tapewright_dir = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return spark._tapewright_dir


#: Tables staged inside the innermost scratch() of the thread at hand; queries in other threads have their own.
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, lost executors don't matter.

    The shuffles behind df are of no use then. Spark deletes their files once the driver's JVM has
    collected what refers to them, which may be long after; so it is asked to collect now.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    df.sparkSession.sparkContext._jvm.System.gc()
    if (held := _SCRATCH.get()) is not None:
        held.append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Empties tables that staged() gave and that nothing reads any more; call it after what was made of them is staged too."""
    for t in tables:
        if path := getattr(t, "staged_at", None):
            t.sparkSession.createDataFrame([], t.schema).write.mode("overwrite").parquet(path)
            t.staged_at = None


@contextmanager
def scratch():
    """Releases the tables staged inside, but those that are taken out of the list it gives."""
    held: list[DataFrame] = []
    before = _SCRATCH.set(held)
    try:
        yield held
    finally:
        _SCRATCH.reset(before)
        release(*held)


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no taken one equals, whatever its case."""
    low, out = {t.lower() for t in taken}, []
    for w in wanted:
        while w.lower() in low:
            w += "_"
        low.add(w.lower())
        out.append(w)
    return out


def text_table(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of a documents table, whatever other columns it has."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def gapless_rank(df: DataFrame, group: list[str], order: list, buckets: int, name: str, few: bool = False) -> DataFrame:
    """Adds column `name`: 0, 1, 2, ... inside each group, without one task per group.

    Rows are dealt by hash of the order columns into `buckets` parts of each group. Ranks inside a
    part come from a window over (group, part); the parts' counts are summed into offsets. The table
    of counts has at most groups x buckets rows, and the groups are few (shards, classes). `few` says
    that their number has a fixed bound; then the rows themselves are shuffled once only.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    df = df.withColumn("_part", part)
    sizes = df.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(inside) - 1)
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    placed = ranked.join(F.broadcast(offsets) if few else offsets, [*same, F.col("_part") == F.col("_of")]).withColumn(name, F.col("_before") + F.col("_rank"))
    return placed.drop("_part", "_of", "_before", "_rank", *[f"_of_{g}" for g in group])
