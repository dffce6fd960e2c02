"""Reading raw tables and shards: schema detection, tolerant loads, control tables; and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C


class SchemaError(ValueError):
    """All faults of a schema at once."""


def detect_field(columns: list[str], hints: list[str]) -> str | None:
    """The first column whose lower-cased name contains a hint."""
    return next((c for c in columns if any(h in c.lower() for h in hints)), None)


def inspect_schema(df: DataFrame, required: list[str]) -> dict[str, str | None]:
    """Column of each field by its hints; SchemaError lists every required field that is missing."""
    found = {field: detect_field(df.columns, hints) for field, hints in C.FIELD_HINTS.items()}
    missing = [f for f in required if found.get(f) is None]
    if missing:
        raise SchemaError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    return found


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def discover_shards(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Shard files in the order of their names; errors tell a missing folder, a non-folder and an empty one apart."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(folder)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, pattern))
    names = sorted(f.getPath().toString() for f in found)
    if not names:
        raise LookupError(f"no shard like {pattern} in {folder}")
    return names


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def load_shards(spark: SparkSession, folder: str, schema: T.StructType | str, column: str, fmt: str = "parquet", pattern: str = "*") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the shard they come from, count of rows without a value in `column` by shard, shards that gave no row).

    Corrupt and missing files are passed over; they are among the shards without a row, as empty ones are.
    """
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("pathGlobFilter", pattern)
    rows = reader.format(fmt).load(folder).withColumn("shard", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    rejected = rows.groupBy("shard").agg(F.count_if(F.col(column).isNull()).alias("n_rejected"))
    names = [name.rpartition("/")[2] for name in discover_shards(spark, folder, pattern)]
    every = spark.createDataFrame([(n,) for n in names if n[0] not in "._"], "shard string")
    return rows.filter(F.col(column).isNotNull()), rejected, every.join(rejected, "shard", "left_anti")


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of any content in the folder's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(content))
    stream.close()


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or an empty one where none has been written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def with_dimension(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Fails at run time on a vector of another dimension."""
    wrong = F.col(column).isNotNull() & (F.size(column) != dim)
    return df.withColumn(column, F.when(wrong, F.raise_error(F.lit(f"a vector of {column} has not {dim} values")).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def write_batch(df: DataFrame, path: str, batch_idx: int) -> None:
    """Writes one batch as its own partition; writing it again replaces it, so a retry changes nothing."""
    df.withColumn("batch_idx", F.lit(batch_idx)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_idx").parquet(path)
