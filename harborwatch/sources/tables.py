"""Feature, state, model and result tables: Parquet by default, CSV where people read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.schema import HISTORY_SCHEMA, SUBNET_HOSTS_SCHEMA, features_schema

FIRST_SEEN_SCHEMA = "port int, ext_ip string, timewindow int, first_day date"


# --- features ------------------------------------------------------------------

def sink_features(features: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per day (and variant); re-running a day replaces that day only."""
    parts = [c for c in ("variant", "day") if c in features.columns]
    writer = features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def scan_features(spark: SparkSession, path: str, days: list[str] | None = None, fmt: str = "parquet",
                  labelled: bool = False, variant: bool = False) -> DataFrame:
    """Features of the given days (all when None); only their folders are read."""
    reader = spark.read.schema(features_schema(labelled, variant))
    if fmt == "csv":
        reader = reader.option("header", True)
    table = reader.format(fmt).load(path)
    return table.filter(F.col("day").isin([F.lit(d).cast("date") for d in days])) if days else table


# --- state ---------------------------------------------------------------------

def sink_state(table: DataFrame, path: str) -> None:
    """History or subnet hosts, one folder per day."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def scan_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def scan_subnet_hosts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBNET_HOSTS_SCHEMA).parquet(path)


def first_seen_table(spark: SparkSession, name: str, path: str, buckets: int = 64) -> None:
    """Registers the table of first sightings kept at ``path`` as ``name``; a new one is empty.

    Every session that uses it registers it, with the number of buckets it was made with. A bucket should fit in a task:
    about 64 for 10^8 addresses.
    """
    # Makes the folder; a table without rows has no files.
    spark.createDataFrame([], FIRST_SEEN_SCHEMA).write.mode("append").partitionBy("first_day").parquet(path)
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} ({FIRST_SEEN_SCHEMA}) USING parquet
        OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY (first_day) CLUSTERED BY (port, ext_ip) INTO {buckets} BUCKETS LOCATION '{path}'""")
    spark.sql(f"MSCK REPAIR TABLE {name}")


def first_seen_buckets(spark: SparkSession, name: str) -> int:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter(F.col("col_name") == "Num Buckets")
    return int(described.first()["data_type"])


def sink_first_seen(sightings: DataFrame, days: list, name: str) -> None:
    """Replaces the folders of ``days``. A row without port and address marks each day as run, also one that found nothing."""
    spark = sightings.sparkSession
    marks = spark.createDataFrame([(None, None, None, d) for d in days], FIRST_SEEN_SCHEMA)
    own = sightings.select(*[F.col(f.name).cast(f.dataType) for f in marks.schema.fields])
    own.unionByName(marks).write.mode("overwrite").insertInto(name)


# --- importance ------------------------------------------------------------------

def sink_importance(importance: DataFrame, path: str) -> None:
    """``feature weight`` lines per port, largest first. At most one line per feature and port."""
    lines = importance.select("port", "weight", "feature", F.concat_ws(
        " ", F.rpad("feature", 24, " "), F.format_string("%.4f", "weight")).alias("value"))
    ordered = lines.repartition("port").sortWithinPartitions("port", F.desc("weight"), "feature")
    ordered.select("port", "value").write.mode("overwrite").partitionBy("port").text(path)


def scan_importance(spark: SparkSession, path: str) -> DataFrame:
    """Reads ``port22.csv`` style files and ``port=22`` folders; the file name, or the folder of a part file, names the port."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.regexp_extract(F.col("_metadata.file_path"), r"port=?(\d+)[^/]*(?:/part-[^/]*)?$", 1).cast("int").alias("port"))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.trim("value") != "").select(
        "port", parts[0].alias("feature"), parts[1].cast("double").alias("weight"))


# --- models and results -------------------------------------------------------------

def sink_model(table: DataFrame, path: str, model_id: str) -> None:
    """Model tables (scaler, bandwidths, support, trees) of several runs share one path."""
    (table.withColumn("model_id", F.lit(model_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(path))


def scan_model(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("model_id") == model_id).drop("model_id")


def sink_result(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """Scores, rankings, metrics, percentiles, confusion counts."""
    writer = table.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def scan_result(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)
