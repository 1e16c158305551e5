"""Connection logs: tab-separated text with ``#`` comment lines, and the tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborwatch.functions import fields as f
from harborwatch.operators.features import port_prefilter
from harborwatch.schema import ATTACK_FIELDS, CONN_FIELDS, Params, column_name, conn_schema, field_type


def parse_conn_lines(lines: DataFrame, fields: list[str] = CONN_FIELDS, drop_last: bool = True) -> DataFrame:
    """Lines (column ``value``) -> typed rows. Missing fields and ``-`` become NULL.

    With ``drop_last`` the last field of each line is ignored, as in the day-split background logs.
    """
    parts = F.split(F.col("value"), "\t")
    kept = F.slice(parts, F.lit(1), F.size(parts) - 1) if drop_last else parts
    rows = lines.filter(~F.col("value").startswith("#")).select(kept.alias("parts"))
    columns = []
    for i, name in enumerate(fields):
        value = f.null_dash(F.get("parts", F.lit(i)))
        kind = field_type(name)
        if not isinstance(kind, T.StringType):
            value = value.try_cast(kind)
        columns.append(value.alias(column_name(name)))
    return rows.select(*columns)


def scan_conn_log(spark: SparkSession, path: str) -> DataFrame:
    """Background logs of a folder: its ``*.log`` entries, each a file or a folder of part files."""
    return parse_conn_lines(spark.read.text(f"{path.rstrip('/')}/*.log"))


def scan_attack_log(spark: SparkSession, path: str) -> DataFrame:
    """Raw attack log with its preamble and closing comment; all 21 fields."""
    return parse_conn_lines(spark.read.text(path), ATTACK_FIELDS, drop_last=False)


def split_by_day(
    conns: DataFrame, p: Params, path: str, fmt: str = "parquet", shift_ts: bool = False, files_per_day: int = 16
) -> None:
    """Monitored rows, one partition per local day.

    Only the days present in ``conns`` are replaced. A day is written by ``files_per_day`` tasks. ``shift_ts`` stores
    the local wall clock as ts; readers of such a table must use the UTC zone.
    """
    with_day = port_prefilter(conns, p).withColumn("day", f.local_day(F.col("ts"), p.report_tz))
    if shift_ts:
        with_day = with_day.withColumn("ts", f.local_wallclock(F.col("ts"), p.report_tz))
    salt = F.pmod(F.xxhash64("ts", "orig_h", "resp_h"), F.lit(files_per_day))
    dealt = with_day.repartition("day", salt)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "-").csv(path)
    else:
        writer.format(fmt).save(path)


def scan_day(spark: SparkSession, path: str, days: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Day-split table; the day comes from the folder, so other days are not read."""
    schema = T.StructType([*conn_schema().fields, T.StructField("day", T.DateType())])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "-").option("enforceSchema", True)
    table = reader.format(fmt).load(path)
    return table.filter(F.col("day").isin([F.lit(d).cast("date") for d in days])) if days else table


def sink_prepared(trace: DataFrame, path: str) -> None:
    """Tab-separated trace with header, in the fixed field order, one folder per variant; other variants stay."""
    columns = [
        (F.col(column_name(n)) if column_name(n) in trace.columns else F.lit(None)).cast("string").alias(n)
        for n in ATTACK_FIELDS
    ]
    (trace.select("variant", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("variant").option("sep", "\t").option("header", True).option("nullValue", "-").csv(path))


def scan_prepared(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*conn_schema(ATTACK_FIELDS).fields, T.StructField("variant", T.StringType())])
    return (spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "-")
            .option("enforceSchema", True).csv(path))


def reindex_cols(trace: DataFrame) -> DataFrame:
    """The fixed 21 columns in order; absent ones as NULL."""
    return trace.select(*[
        F.col(column_name(n)) if column_name(n) in trace.columns
        else F.lit(None).cast(field_type(n)).alias(column_name(n))
        for n in ATTACK_FIELDS
    ])
