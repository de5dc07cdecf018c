"""Pieces shared by the corpus operators: durable cuts, size-checked joins, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.session import shared_dir

#: ASCII white space, the only word separator of this subpackage. ``bytes.split()`` cuts at the same six bytes.
WS = r"[\x20\x09-\x0D]+"

#: Rows of two or three longs up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch while tables are cut: documents may be long, so batches of whole texts must be short.
BATCH_ROWS = 256


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder, so that a lost executor costs no earlier stage."""
    shared_dir(df.sparkSession)
    with _short_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """As durable(), as a compressed table whose columns can be read apart. Returns its path too, for discard()."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _short_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where the counted rows allow it; otherwise leave the join to shuffle (AQE splits hot keys)."""
    return F.broadcast(df) if rows <= limit else df


def hot_join(left: DataFrame, right: DataFrame, on: list[str], rows: int, by: Column, how: str = "inner", salts: int = 16, limit: int = BROADCAST_ROWS) -> DataFrame:
    """left joined with right, whose keys are distinct and which has `rows` rows, where one key may hold a third of left.

    Broadcasts within the bound. Beyond it, left is dealt by the keys and a salt hashed from `by`, and right is
    repeated for each salt, so that a hot key is spread over many tasks.
    """
    if rows <= limit:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("j_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("j_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, [*on, "j_salt"], how).drop("j_salt")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever extra columns it carries."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of other than ASCII white space, in order."""
    return F.array_remove(F.split(text, WS), "")


def shards_for(rows: int, per_shard: int) -> int:
    """How many shards keep each within per_shard rows; follows the data, never a fixed number."""
    return max(1, -(-rows // per_shard))
