"""Fixed names, table schemas and the parameter record shared by all jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# They must equal the profiled data format.
MEASURES = ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"]
CONNECTION_STATES = [
    "S0", "S1", "SF", "REJ", "S2", "S3", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR", "OTH",
]
NOT_FAILED_STATES = ["S1", "SF"]
CONN_FIELDS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service",
    "duration", "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp",
    "missed_bytes", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
]
ATTACK_FIELDS = CONN_FIELDS + ["tunnel_parents"]
# Features that only repeat what num_conns already says.
REDUNDANT_FEATURES = ["min_orig_bytes", "min_resp_bytes", "min_orig_pkts", "min_resp_pkts"]
TOP_K = [
    10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 130, 140, 150, 160, 170, 180, 190, 200,
    250, 300, 350, 400, 450, 500, 550, 600, 650, 700, 750, 800, 900, 1000, 1100, 1200, 1300,
    1400, 1440,
]
PERCENTILES = [0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9] + [float(p) for p in range(1, 101)]
THINNING = [2, 4, 8, 16, 256, 1024]
# ---------------------------------------------------------------------------

STATISTICS = [f"{stat}_{m}" for m in MEASURES for stat in ("min", "max", "mean", "variance")]
STATE_COUNTS = [f"{state}_count" for state in CONNECTION_STATES]
COUNTS = ["external_ips", "new_external_ips", "num_conns", "internal_ips"]
OUTCOME_COUNTS = ["failed_conn_count", "zero_resp_bytes_count"]
FEATURES = COUNTS + STATISTICS + STATE_COUNTS + OUTCOME_COUNTS
MODEL_FEATURES = [f for f in FEATURES if f not in REDUNDANT_FEATURES]

_FIELD_TYPES = {
    "ts": T.DoubleType(), "id.orig_p": T.IntegerType(), "id.resp_p": T.IntegerType(),
    "duration": T.DoubleType(), "orig_bytes": T.DoubleType(), "resp_bytes": T.DoubleType(),
    "missed_bytes": T.DoubleType(), "orig_pkts": T.DoubleType(), "orig_ip_bytes": T.DoubleType(),
    "resp_pkts": T.DoubleType(), "resp_ip_bytes": T.DoubleType(),
}


def column_name(field: str) -> str:
    """Log field -> column name (``id.orig_h`` -> ``orig_h``)."""
    return field.removeprefix("id.")


def field_type(field: str) -> T.DataType:
    return _FIELD_TYPES.get(field, T.StringType())


def conn_schema(fields: list[str] = CONN_FIELDS) -> T.StructType:
    return T.StructType([T.StructField(column_name(f), field_type(f)) for f in fields])


def features_schema(labelled: bool = True, variant: bool = False) -> T.StructType:
    counts = set(COUNTS + STATE_COUNTS + OUTCOME_COUNTS)
    head = [T.StructField("variant", T.StringType())] if variant else []
    head += [T.StructField("day", T.DateType()), T.StructField("timewindow", T.IntegerType()),
             T.StructField("port", T.IntegerType())]
    body = [T.StructField(f, T.LongType() if f in counts else T.DoubleType()) for f in FEATURES]
    tail = [T.StructField("label", T.BooleanType())] if labelled else []
    return T.StructType(head + body + tail)


HISTORY_SCHEMA = "day date, port int, ext_ip string"
SUBNET_HOSTS_SCHEMA = "day date, subnet24 string, int_ip string"
IMPORTANCE_SCHEMA = "port int, feature string, weight double"
SCORES_SCHEMA = "day date, port int, timewindow int, score double, label boolean"
PERCENTILES_SCHEMA = "port int, percentile double, score double"


@dataclass(frozen=True)
class Params:
    """Everything a run may vary. Defaults follow the published configuration."""

    tw_seconds: int = 60
    ports: tuple[int, ...] = (22, 23, 80, 443, 445)
    model_ports: tuple[int, ...] = (22, 23, 80, 443)
    report_tz: str = "UTC"
    internal_prefix: str = "147.32"
    network: str = "147.32.0.0/16"
    attack_prefix: str = "192.168."
    attack_port: int = 445
    attackers: tuple[str, ...] = ("192.168.1.114",)
    attack_offset: float = 0.5
    drop_ipv6_resp: bool = False
    history_mode: str = "base_day"  # or "cumulative"
    scaler_bounded: bool = True
    scaler_max_factor: float = 5.0
    scaler_min: float = 0.0
    seed: str = "7"

    @property
    def tw_per_day(self) -> int:
        return 24 * 60 * 60 // self.tw_seconds

    @property
    def offset_tw(self) -> int:
        return int(self.attack_offset * self.tw_per_day)
