"""Small planning helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame | None:
    """``broadcast(df)`` when it provably holds at most ``max_rows`` rows, else None.

    The check runs ``limit(max_rows + 1).count()``, which stops scanning as
    soon as the bound is exceeded, so it never materialises a large side.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else None


#: A side of a join is broadcast up to so many rows; beyond that Spark chooses the join.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``df``, written once and counted from the files' metadata: with a broadcast hint up to ``max_rows``
    (BROADCAST_ROWS) rows, plain beyond that.  The join's result is the same."""
    table = written(df, "side")
    return bounded_broadcast(table, BROADCAST_ROWS if max_rows is None else max_rows) or table


def with_group_stats(df: DataFrame, stats: DataFrame, group: list[str]) -> DataFrame:
    """``df`` with the columns of ``stats`` (one row per group); without a group its only row's values, as scalar subqueries."""
    if group:
        return df.join(stats, group)
    return df.withColumns({c: stats.select(c).scalar() for c in stats.columns})


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/spindle-io/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    What depends on the partition a row was dealt to (a bucket number) becomes
    plain data: later branches and retried tasks all read the same values.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder.

    Used by iterative learners so a lost executor recomputes from the last
    checkpoint, not from the first iteration.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
