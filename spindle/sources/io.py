"""Sources and sinks.

Readers return lazy DataFrames; line numbers come from the file order
(file name, then position) through the range-partitioned ordinal index, not
a driver loop.  Writers never coalesce to one task: ordered outputs are
written as globally sorted part files whose name order is the line order.
Scratch output goes under the session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.util import scratch_path
from ..operators.windows import ordinal_index


# ---------------------------------------------------------------------------
# readers
# ---------------------------------------------------------------------------

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """#1 ``scan_lines``: text file(s) → (line_no, text), trailing whitespace trimmed.

    Order = (file name, position in file); ``monotonically_increasing_id``
    grows with the position inside a file, the ordinal index makes the
    numbers consecutive without a single-partition window."""
    df = spark.read.option("lineSep", "\n").text(path).select(
        F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_m"), F.rtrim("value").alias("text")
    )
    return ordinal_index(df, [F.col("_f"), F.col("_m")], out="line_no").select("line_no", "text")


def split_lines(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """#1 on a table: every row's text → (key, line_no, line) with trailing whitespace trimmed."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumn("line", F.rtrim("line"))


SPLIT_TEMPLATES: dict[str, str] = {}


def register_split_dataset(name: str, template: str) -> None:
    """Register ``{split}``-templated paths of a labelled dataset for ``read_split_tables``."""
    SPLIT_TEMPLATES[name] = template


def read_split_tables(spark: SparkSession, name: str, splits=("train", "valid", "test"), schema: str | None = None) -> DataFrame:
    """#2 ``scan_split_tables``: the CSV parts of a registered dataset with a ``split`` column."""
    if name not in SPLIT_TEMPLATES:
        raise ValueError(f"unknown dataset {name!r}; registered: {sorted(SPLIT_TEMPLATES)}")
    out = None
    for s in splits:
        part = read_headed_csv(spark, SPLIT_TEMPLATES[name].format(split=s), schema).withColumn("split", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


def read_headed_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """#3: CSV with a header row; an explicit schema avoids an inference pass."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def fragment_lists(df: DataFrame, col: str = "text", sep: str = ",") -> DataFrame:
    """#4: a comma-joined line → array<string> column ``fragments``."""
    return df.withColumn("fragments", F.split(F.col(col), sep))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """#5: vocabulary file → (token, id = line number); a duplicated token keeps its last line."""
    lines = read_lines(spark, path)
    return lines.groupBy(F.col("text").alias("token")).agg(F.max("line_no").cast("int").alias("id"))


# Field names of the API's records.
PAGE_SCHEMA = (
    "molecules array<struct<molecule_chembl_id:string, molecule_name:string, max_phase:string,"
    " molecule_properties:struct<full_molformula:string, full_mw:string>,"
    " molecule_structures:struct<canonical_smiles:string>>>"
)


def flatten_json_pages(pages: DataFrame, json_col: str = "json", schema: str = PAGE_SCHEMA) -> DataFrame:
    """#6: explode the page's records and pick nested fields; a missing struct or key gives 'N/A'."""
    p = pages.select(F.explode(F.from_json(F.col(json_col), schema)["molecules"]).alias("m"))

    def na(c):
        return F.coalesce(c.cast("string"), F.lit("N/A"))

    m = F.col("m")
    return p.select(
        na(m["molecule_chembl_id"]).alias("chembl_id"),
        na(m["molecule_name"]).alias("name"),
        na(m["max_phase"]).alias("max_phase"),
        na(m["molecule_properties"]["full_molformula"]).alias("formula"),
        na(m["molecule_properties"]["full_mw"]).alias("weight"),
        na(m["molecule_structures"]["canonical_smiles"]).alias("smiles"),
    )


def source_stats(df: DataFrame, key: str, file_prefix: str = "") -> DataFrame:
    """#7: rows retrieved per source id (for every id)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "file", F.concat(F.lit(file_prefix), F.col(key).cast("string"), F.lit(".csv"))
    )


# ---------------------------------------------------------------------------
# writers
# ---------------------------------------------------------------------------

def write_text_corpus(df: DataFrame, col: str, path: str) -> None:
    """#8: one string column → text lines."""
    df.select(F.col(col).cast("string").alias("value")).write.option("lineSep", "\n").mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str, fmt: str = "csv", split: str = "split") -> None:
    """#9: each split to its own folder (``split=<name>``), CSV with header or parquet."""
    w = df.write.mode("overwrite").partitionBy(split)
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """#10: tokens as lines in id order; a global sort writes part files whose
    name order is the id order (no single-task coalesce)."""
    vocab.orderBy("id").select("token").write.option("lineSep", "\n").mode("overwrite").text(path)


def append_results(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """#11: append result rows to a partitioned table (no read-modify-rewrite)."""
    df.write.mode("append").partitionBy(*partition_cols).parquet(path)


def save_model_table(df: DataFrame, path: str) -> None:
    """#12: persist a learned model table (merges, vocabulary, lexicon) as parquet."""
    df.write.mode("overwrite").parquet(path)


def load_model_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
