"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import scratch_path

#: White space that separates words of the word-based operators.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (any store that Spark reaches)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: whatever reads the result later survives lost executors
    without recomputing it, and several readers don't recompute it either.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only.  A text of single-byte characters takes the fast built-in."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(ascii_only, F.lower(c)).otherwise(F.translate(c, upper, lower))


def split_words(text: Column, gap: str) -> Column:
    """Words between gaps.  ``split`` is linear in the text, unlike ``regexp_extract_all``, which copies it for each match."""
    return F.array_remove(F.split(text, gap, -1), "")


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "_k") -> DataFrame:
    """Add the column ``key``: one value per distinct (id, text), for joining a result back to its rows.

    Equal rows share a key and so get equal results; rows that share only the
    id stay apart.
    """
    k = F.concat_ws(
        "|",
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
        F.coalesce(F.xxhash64(F.col(text_col)).cast("string"), F.lit("null")),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")).cast("string"), F.lit("null")),
    )
    return df.withColumn(key, k)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` each (a single longer row stays whole)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        lens = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lens):
            if size and size + n > max_bytes:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        yield b.slice(start)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
