"""Connection tables derived from the driver's ``events`` table; every event becomes one record."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from harborwatch.schema import MODEL_FEATURES, Params

BASE_DAY = date(2024, 1, 1)
TEST_DAY = date(2024, 1, 30)
EPOCH = 1704067200  # 2024-01-01 00:00 UTC
# 30 days of events replayed in 25 minutes.
SPEEDUP = 1728

PARAMS_60 = Params()
PARAMS_3600 = Params(tw_seconds=3600)
PARAMS_OVERLAY = Params(tw_seconds=60, attackers=("192.168.1.114", "192.168.1.50"))

CONN_SQL = """
SELECT uid, ts, resp_p, duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts, conn_state,
       CASE WHEN event_id % 97 = 0 THEN 'fe80::1' WHEN event_id % 6 = 0 THEN ext ELSE inn END AS orig_h,
       CASE WHEN event_id % 6 = 0 THEN inn ELSE ext END AS resp_h
FROM (SELECT event_id, cast(event_id AS string) AS uid, {epoch} AS ts,
        CASE WHEN event_id % 29 = 0 THEN 8080 WHEN event_type = 'click' THEN 80 WHEN event_type = 'view' THEN 443
             WHEN event_type = 'purchase' THEN 22 WHEN event_type = 'signup' THEN 23 ELSE 445 END AS resp_p,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS duration,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast((event_id * 37) % 1500 AS double) END AS orig_bytes,
        CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN cast(0 AS double)
             ELSE cast((event_id * 91) % 9000 AS double) END AS resp_bytes,
        cast(1 + event_id % 17 AS double) AS orig_pkts,
        cast(event_id % 23 AS double) AS resp_pkts,
        CASE WHEN event_id % 41 = 0 THEN NULL
             ELSE split_part('S0,S1,SF,REJ,S2,S3,RSTO,RSTR,RSTOS0,RSTRH,SH,SHR,OTH', ',', cast(1 + event_id % 13 AS int))
             END AS conn_state,
        concat('147.32.', cast(event_id % 4 AS string), '.', cast(event_id % 50 AS string)) AS inn,
        concat('203.0.', cast(cast(floor(user_id / 250) AS bigint) AS string), '.', cast(user_id % 250 AS string)) AS ext
      FROM {events}) e
"""

ATTACK_SQL = """
SELECT CASE WHEN event_id IS NOT NULL THEN 'wannacry' END AS variant, cast(event_id AS string) AS uid, {relative} AS ts,
       CASE WHEN event_id % 10 = 9 THEN '192.168.1.50' ELSE '192.168.1.114' END AS orig_h,
       CASE WHEN event_id % 10 = 9 OR event_id % 3 = 0 THEN concat('192.168.1.', cast(event_id % 7 AS string))
            ELSE concat('198.51.', cast(event_id % 9 AS string), '.', cast(event_id % 61 AS string)) END AS resp_h,
       CASE WHEN event_id % 20 = 7 THEN 139 ELSE 445 END AS resp_p,
       CASE WHEN event_id % 4 = 0 THEN value ELSE NULL END AS duration,
       CASE WHEN event_id % 4 = 0 THEN cast(event_id % 300 AS double) ELSE NULL END AS orig_bytes,
       CASE WHEN event_id % 4 = 0 THEN cast(event_id % 2 AS double) ELSE NULL END AS resp_bytes,
       cast(1 AS double) AS orig_pkts, cast(event_id % 2 AS double) AS resp_pkts,
       CASE WHEN event_id % 4 = 0 THEN 'SF' WHEN event_id % 9 = 0 THEN 'REJ' ELSE 'S0' END AS conn_state
FROM {events}
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Event times carry no zone; they are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = "unix_micros(cast(ts AS timestamp))"
    return spark.sql(CONN_SQL.format(events="{events}", epoch=f"{micros} / 1e6"), events=events(spark, sf_dir))


def attack_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events again, replayed as one short attack trace."""
    micros = "unix_micros(cast(ts AS timestamp))"
    relative = f"cast({micros} - {EPOCH * 1000000} AS double) / {SPEEDUP}e6"
    return spark.sql(ATTACK_SQL.format(events="{events}", relative=relative), events=events(spark, sf_dir))


def importance(spark: SparkSession, ports=Params().ports) -> DataFrame:
    """Falling weights in model order, the same on every port."""
    rows = [(p, f, round((35 - i) / 630.0, 4)) for p in ports for i, f in enumerate(MODEL_FEATURES)]
    return spark.createDataFrame(rows, "port int, feature string, weight double")
