"""Reading and writing of documents, manifests and tables, all by Spark, so any of its stores will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt"


def read_json(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = True) -> DataFrame:
    """Documents under a schema. One that is no valid JSON gives a row of nulls with its text in `_corrupt`."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return spark.read.schema(StructType(schema.fields).add(CORRUPT, "string")).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line with keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Parquet, ORC, CSV (with a header) or JSON."""
    if fmt not in ("parquet", "orc", "csv", "json"):
        raise ValueError(f"no format {fmt}; there are parquet, orc, csv and json")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def scan_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, checksums: bool = False) -> DataFrame:
    """A row per file: path, name, n_bytes, and its SHA-256 if asked for; without checksums the contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    columns = ["path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes")]
    return files.select(*columns, *([F.sha2("content", 256).alias("checksum")] if checksums else []))


def check_manifest(manifest: DataFrame, files: DataFrame, name: str = "name", checksum: str = "checksum") -> DataFrame:
    """Per row of the manifest its status: ok, missing_file, checksum_mismatch, duplicate or no_name."""
    counts = manifest.groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
    have = files.select(F.col("name").alias(name), F.col("checksum").alias("__sum"))
    joined = manifest.join(counts, name, "left").join(have, name, "left")
    status = (
        F.when(F.col(name).isNull() | (F.col(name) == ""), "no_name")
        .when(F.col("__n") > 1, "duplicate")
        .when(F.col("__sum").isNull(), "missing_file")
        .when(F.col(checksum).isNotNull() & (F.col(checksum) != F.col("__sum")), "checksum_mismatch")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).drop("__n", "__sum")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df`, whose rows raise an error where a required column is null."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing")).cast(dict(df.dtypes)[c])).otherwise(F.col(c)))
    return df
