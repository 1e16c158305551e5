"""Small hand-written connection frames."""

from datetime import date

from harborwatch.schema import FEATURES

DAY0 = 1704067200.0  # 2024-01-01 00:00 UTC
DAY = 86400.0

CONN = ("ts double, uid string, orig_h string, resp_h string, resp_p int, duration double, orig_bytes double, "
        "resp_bytes double, orig_pkts double, resp_pkts double, conn_state string")


def conn_frame(spark, rows):
    """rows: dicts; unset fields get plain defaults."""
    base = {"ts": DAY0, "orig_h": "147.32.0.1", "resp_h": "203.0.0.1", "resp_p": 80, "duration": None, "orig_bytes": None,
            "resp_bytes": None, "orig_pkts": 1.0, "resp_pkts": 1.0, "conn_state": "SF"}
    full = [{**base, "uid": f"u{i:04d}", **r} for i, r in enumerate(rows)]
    names = [c.split()[0] for c in CONN.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], CONN)


def feature_frame(spark, rows):
    """rows: (day, timewindow, port, {feature: value}, label); unset features are 0."""
    from harborwatch.schema import features_schema

    schema = features_schema(labelled=True)
    kinds = {f.name: f.dataType.typeName() for f in schema.fields}
    data = [(day, tw, port, *[(float if kinds[f] == "double" else int)(values.get(f, 0)) for f in FEATURES], label)
            for day, tw, port, values, label in rows]
    return spark.createDataFrame(data, schema)


def day(n):
    return date(2024, 1, n)
