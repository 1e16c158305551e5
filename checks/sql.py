"""SQL building blocks for the comparison engine, written from the operators' definitions."""

from __future__ import annotations

from checks.fixtures import ATTACK_SQL, CONN_SQL, EPOCH, SPEEDUP
from harborwatch.functions.fields import NON_GLOBAL_RANGES
from harborwatch.functions.normal import HART_DENOMINATOR, HART_LIMIT, HART_NUMERATOR
from harborwatch.schema import CONNECTION_STATES, FEATURES, MEASURES, MODEL_FEATURES

PORTS = (22, 23, 80, 443, 445)
MODEL_PORTS = (22, 23, 80, 443)
DOUBLES = [f"{s}_{m}" for m in MEASURES for s in ("min", "max", "mean", "variance")]

CONN = CONN_SQL.format(events="events", epoch="epoch_us(ts) / 1e6")
ATTACK = ATTACK_SQL.format(
    events="events", relative=f"cast(epoch_us(ts) - {EPOCH * 1000000} AS double) / {SPEEDUP}e6")


def with_(ctes: list[tuple[str, str]], select: str, materialized: bool = False) -> str:
    """WITH chain; a name given twice is kept once, as first given."""
    seen: dict[str, str] = {}
    for name, body in ctes:
        seen.setdefault(name, body)
    kind = "MATERIALIZED " if materialized else ""
    return "WITH " + ",\n".join(f"{n} AS {kind}({b})" for n, b in seen.items()) + "\n" + select


def conn() -> list[tuple[str, str]]:
    return [("conn", CONN)]


def oriented(tw: int) -> list[tuple[str, str]]:
    body = f"""
      SELECT c.*, resp_p AS port, cast(moment AS date) AS day,
             cast(floor((hour(moment) * 3600 + minute(moment) * 60 + second(moment)) / {tw}) AS int) AS timewindow,
             CASE WHEN orig_h LIKE '147.32%' THEN orig_h ELSE resp_h END AS int_ip,
             CASE WHEN orig_h LIKE '147.32%' THEN resp_h ELSE orig_h END AS ext_ip
      FROM (SELECT *, make_timestamp(cast(round(ts * 1e6) AS bigint)) AS moment FROM conn) c
      WHERE resp_p IN {PORTS} AND orig_h NOT LIKE '%:%'"""
    return [*conn(), ("oriented", body)]


def traffic_aggregates() -> str:
    parts = ["count(*) AS num_conns"]
    for m in MEASURES:
        parts += [f"coalesce(min({m}), 0e0) AS min_{m}", f"coalesce(max({m}), 0e0) AS max_{m}",
                  f"coalesce(avg({m}), 0e0) AS mean_{m}", f"coalesce(var_pop({m}), 0e0) AS variance_{m}"]
    parts += [f"cast(sum(CASE WHEN conn_state = '{s}' THEN 1 ELSE 0 END) AS bigint) AS {s}_count" for s in CONNECTION_STATES]
    parts += ["cast(sum(CASE WHEN conn_state NOT IN ('S1', 'SF') THEN 1 ELSE 0 END) AS bigint) AS failed_conn_count",
              "cast(sum(CASE WHEN resp_bytes = 0 THEN 1 ELSE 0 END) AS bigint) AS zero_resp_bytes_count"]
    return ", ".join(parts)


def features(tw: int, mode: str = "base_day") -> list[tuple[str, str]]:
    """Sparse features of all days after 2024-01-01."""
    if mode == "base_day":
        known = "SELECT DISTINCT port, ext_ip, DATE '2024-01-01' AS since FROM oriented WHERE day = DATE '2024-01-01'"
    else:
        known = "SELECT port, ext_ip, min(day) AS since FROM oriented GROUP BY port, ext_ip"
    flagged = """
      SELECT d.*, CASE WHEN rn = 1 AND (k.since IS NULL OR k.since >= d.day) THEN 1 ELSE 0 END AS is_new
      FROM (SELECT o.*, row_number() OVER (PARTITION BY day, port, ext_ip ORDER BY ts, uid) AS rn FROM oriented o) d
      LEFT JOIN known k ON d.port = k.port AND d.ext_ip = k.ext_ip WHERE d.day > DATE '2024-01-01'"""
    body = f"""
      SELECT day, timewindow, port, count(DISTINCT ext_ip) AS external_ips,
             cast(sum(is_new) AS bigint) AS new_external_ips, count(DISTINCT int_ip) AS internal_ips,
             {traffic_aggregates()}
      FROM flagged GROUP BY day, timewindow, port"""
    return [*oriented(tw), ("known", known), ("flagged", flagged), ("features", body)]


def rounded_features(keys: str, source: str, label: bool = False) -> str:
    cols = ", ".join(f"round({c}, 6) AS {c}" if c in DOUBLES else c for c in FEATURES)
    return f"SELECT {keys}, {cols}{', label' if label else ''} FROM {source}"


# --- attack ----------------------------------------------------------------------

def in_cidr(number: str, cidr: str) -> str:
    address, bits = cidr.split("/")
    value = 0
    for octet in address.split("."):
        value = value * 256 + int(octet)
    shift = 32 - int(bits)
    return f"(({number}) >> {shift}) = {value >> shift}"


def random_ip(seed: str, src: str, dst: str) -> str:
    """The n-th of all global addresses, in order; the ranges are counted from the blocked ones in between."""
    place = f"cast(('0x' || substr(md5(concat_ws('|', '{seed}', {src}, {dst})), 1, 15)) AS bigint)"
    bounds = sorted(tuple(sum(int(o) << s for o, s in zip(r.split("/")[0].split("."), (24, 16, 8, 0))) + extra
                          for extra in (0, 1 << (32 - int(r.split("/")[1])))) for r in NON_GLOBAL_RANGES)
    steps, begin, total = [], 0, 0
    for low, after in [*bounds, (1 << 32, 1 << 32)]:
        if low > begin:
            steps.append((total, begin))
            total += low - begin
        begin = max(begin, after)
    cases = " ".join(f"WHEN n >= {least} THEN n - {least} + {first}" for least, first in reversed(steps))
    return f"(SELECT {ip_text('g')} FROM (SELECT CASE {cases} END AS g FROM (SELECT {place} % {total} AS n)))"


def ip_text(number: str) -> str:
    return " || '.' || ".join(f"cast((({number}) >> {s}) & 255 AS varchar)" for s in (24, 16, 8, 0))


def attack_raw() -> list[tuple[str, str]]:
    return [("attack_raw", ATTACK)]


def attack() -> list[tuple[str, str]]:
    """The prepared trace of both attackers."""
    return [
        *attack_raw(),
        ("monitored", "SELECT * FROM attack_raw WHERE orig_h IN ('192.168.1.114', '192.168.1.50') AND resp_p = 445"),
        ("outward", "SELECT * FROM monitored WHERE orig_h IN (SELECT orig_h FROM monitored WHERE resp_h NOT LIKE '192.168.%')"),
        ("pairs", f"""SELECT orig_h, resp_h, {random_ip('7', 'orig_h', 'resp_h')} AS public_ip
                      FROM (SELECT DISTINCT orig_h, resp_h FROM outward WHERE resp_h LIKE '192.168.%') d"""),
        ("attack", """SELECT a.* EXCLUDE (resp_h, ts), coalesce(p.public_ip, a.resp_h) AS resp_h,
                             a.ts - (SELECT min(ts) FROM outward) AS ts
                      FROM outward a LEFT JOIN pairs p ON a.orig_h = p.orig_h AND a.resp_h = p.resp_h"""),
    ]


def mapping(tw: int) -> list[tuple[str, str]]:
    subnet = "regexp_extract(int_ip, '^(\\d+\\.\\d+\\.\\d+\\.)', 1)"
    return [
        *oriented(tw),
        ("hosts", f"SELECT DISTINCT day, {subnet} AS subnet24, int_ip FROM oriented WHERE day = DATE '2024-01-30'"),
        ("sizes", "SELECT day, subnet24, count(*) AS n_ips FROM hosts GROUP BY day, subnet24"),
        ("chosen", """SELECT day, subnet24 FROM sizes WHERE subnet24 LIKE '147.32.%' AND n_ips >= 2
                      ORDER BY md5('7|' || subnet24), subnet24 LIMIT 1"""),
        ("mapping", """SELECT h.day, a.attacker_ip, h.int_ip
                       FROM (SELECT day, int_ip, row_number() OVER (ORDER BY md5('7|' || int_ip), int_ip) AS place
                             FROM hosts WHERE subnet24 = (SELECT subnet24 FROM chosen)) h
                       JOIN (VALUES (1, '192.168.1.114'), (2, '192.168.1.50')) a(place, attacker_ip) ON h.place = a.place"""),
    ]


def placed(tw: int) -> list[tuple[str, str]]:
    return [*attack(), *mapping(tw), ("placed", f"""
      SELECT cast(floor(floor(a.ts) / {tw}) AS bigint) AS seq,
             cast(floor((cast(floor(a.ts) AS bigint) % 86400) / {tw}) AS int) + {86400 // tw // 2} AS timewindow,
             m.int_ip, a.resp_h AS ext_ip, a.ts, a.uid, {', '.join('a.' + m for m in MEASURES)}, a.conn_state
      FROM attack a JOIN mapping m ON a.orig_h = m.attacker_ip""")]


def overlay(tw: int) -> list[tuple[str, str]]:
    """Dense, labelled features of 2024-01-30 with the trace on every port."""
    measures = ", ".join(MEASURES)
    ports = ", ".join(f"({p})" for p in PORTS)
    return [
        *placed(tw),
        ("ports", f"SELECT * FROM (VALUES {ports}) t(port)"),
        ("seen", "SELECT DISTINCT port, ext_ip FROM oriented WHERE day <= DATE '2024-01-30'"),
        ("base", "SELECT DISTINCT port, ext_ip FROM oriented WHERE day = DATE '2024-01-01'"),
        ("bg", """SELECT o.timewindow, o.port, o.int_ip, o.ext_ip, """ + ", ".join("o." + m for m in MEASURES) + """, o.conn_state,
                    CASE WHEN b.port IS NULL AND row_number() OVER (PARTITION BY o.port, o.ext_ip ORDER BY o.ts, o.uid) = 1
                         THEN 1 ELSE 0 END AS is_new
                  FROM oriented o LEFT JOIN base b ON o.port = b.port AND o.ext_ip = b.ext_ip
                  WHERE o.day = DATE '2024-01-30'"""),
        ("atk", f"""SELECT a.timewindow, p.port, a.int_ip, a.ext_ip, {', '.join('a.' + m for m in MEASURES)}, a.conn_state,
                    CASE WHEN s.port IS NULL AND a.rn = 1 THEN 1 ELSE 0 END AS is_new
                  FROM (SELECT *, row_number() OVER (PARTITION BY ext_ip ORDER BY ts, uid) AS rn FROM placed) a
                  CROSS JOIN ports p LEFT JOIN seen s ON s.port = p.port AND s.ext_ip = a.ext_ip"""),
        ("merged", f"""SELECT timewindow, port, count(DISTINCT ext_ip) AS external_ips,
                    cast(sum(is_new) AS bigint) AS new_external_ips, count(DISTINCT int_ip) AS internal_ips, {traffic_aggregates()}
                  FROM (SELECT timewindow, port, int_ip, ext_ip, {measures}, conn_state, is_new FROM bg
                        UNION ALL SELECT timewindow, port, int_ip, ext_ip, {measures}, conn_state, is_new FROM atk) u
                  GROUP BY timewindow, port"""),
        ("test", f"""SELECT 'wannacry' AS variant, DATE '2024-01-30' AS day, g.timewindow, g.port,
                    {', '.join(f'coalesce(m.{c}, 0) AS {c}' for c in FEATURES)},
                    g.timewindow IN (SELECT timewindow FROM placed) AS label
                  FROM (SELECT cast(w AS int) AS timewindow, port FROM range({86400 // tw}) r(w) CROSS JOIN ports) g
                  LEFT JOIN merged m ON g.timewindow = m.timewindow AND g.port = m.port"""),
    ]


# --- models ------------------------------------------------------------------------

def long(source: str, keys: str, columns: list[str] = MODEL_FEATURES) -> str:
    cast = ", ".join(f"cast({c} AS double) AS {c}" for c in columns)
    return f"SELECT {keys}, feature, x FROM (UNPIVOT (SELECT {keys}, {cast} FROM {source}) ON {', '.join(columns)} INTO NAME feature VALUE x)"


def train(tw: int, ports: tuple = MODEL_PORTS) -> list[tuple[str, str]]:
    """Training windows 2024-01-02 .. 29, their long form and the bounded scaler."""
    return [
        *features(tw),
        ("train", f"SELECT * FROM features WHERE day < DATE '2024-01-30' AND port IN {ports}"),
        ("train_long", long("train", "day, timewindow, port")),
        ("scaler", """SELECT port, feature, least(min(x), 0e0, 5 * max(x)) AS lo, greatest(max(x), 0e0, 5 * max(x)) AS hi
                      FROM train_long GROUP BY port, feature"""),
        ("train_z", """SELECT t.day, t.timewindow, t.port, t.feature,
                         (t.x - s.lo) / CASE WHEN s.hi = s.lo THEN 1e0 ELSE s.hi - s.lo END AS z
                       FROM train_long t JOIN scaler s ON t.port = s.port AND t.feature = s.feature"""),
        ("support", "SELECT port, feature, z, cast(count(*) AS double) AS w FROM train_z GROUP BY port, feature, z"),
        ("sizes_train", "SELECT port, cast(count(*) AS double) AS n FROM train GROUP BY port"),
    ]


def test_z(clip: bool = True, source: str = "test") -> list[tuple[str, str]]:
    x = "least(t.x, s.hi)" if clip else "t.x"
    return [
        ("test_long", long(source, "variant, day, timewindow, port, label")),
        ("test_z", f"""SELECT t.variant, t.day, t.timewindow, t.port, t.label, t.feature,
                        ({x} - s.lo) / CASE WHEN s.hi = s.lo THEN 1e0 ELSE s.hi - s.lo END AS z
                      FROM test_long t JOIN scaler s ON t.port = s.port AND t.feature = s.feature"""),
    ]


def densities(h: float, values: str = "test_z", name: str = "densities") -> list[tuple[str, str]]:
    """Density of every distinct value against every distinct training value."""
    return [(f"{name}_v", f"SELECT DISTINCT port, feature, z FROM {values}"), (name, f"""
      SELECT v.port, v.feature, v.z,
             sum(s.w * exp(-((v.z - s.z) / {h}) * ((v.z - s.z) / {h}) / 2)) / max(n.n) / {h} / sqrt(2 * pi()) AS density
      FROM {name}_v v JOIN support s ON v.port = s.port AND v.feature = s.feature JOIN sizes_train n ON n.port = v.port
      GROUP BY v.port, v.feature, v.z""")]


def scores(h: float) -> list[tuple[str, str]]:
    """Mean-ensemble scores of the overlay windows."""
    return [*test_z(), *densities(h), ("scores", """
      SELECT t.variant, t.day, t.timewindow, t.port, t.label, avg(d.density) AS score
      FROM test_z t JOIN densities d ON t.port = d.port AND t.feature = d.feature AND t.z = d.z
      GROUP BY t.variant, t.day, t.timewindow, t.port, t.label""")]


def training_scores(h: float) -> list[tuple[str, str]]:
    return [*densities(h, "train_z", "train_densities"), ("training_scores", """
      SELECT t.day, t.timewindow, t.port, avg(d.density) AS score
      FROM train_z t JOIN train_densities d ON t.port = d.port AND t.feature = d.feature AND t.z = d.z
      GROUP BY t.day, t.timewindow, t.port""")]


def importance() -> list[tuple[str, str]]:
    rows = ", ".join(f"('{f}', {round((35 - i) / 630.0, 4)}e0)" for i, f in enumerate(MODEL_FEATURES))
    ports = ", ".join(f"({p})" for p in PORTS)
    return [("importance", f"SELECT port, feature, weight FROM (VALUES {rows}) f(feature, weight) CROSS JOIN (VALUES {ports}) p(port)")]


def normal_cdf(z: str) -> str:
    a = f"least(abs({z}), 38e0)"

    def poly(coefficients: list[float]) -> str:
        text = "0e0"
        for c in coefficients:
            text = f"({text} * {a} + {c!r}e0)" if "e" not in repr(c) else f"({text} * {a} + {c!r})"
        return text

    rational = f"exp(-{a} * {a} / 2) * {poly(HART_NUMERATOR)} / {poly(HART_DENOMINATOR)}"
    fraction = f"({a} + 0.65e0)"
    for k in (4, 3, 2, 1):
        fraction = f"({a} + {k}e0 / {fraction})"
    tail = f"CASE WHEN {a} < {HART_LIMIT}e0 THEN {rational} ELSE exp(-{a} * {a} / 2) / {fraction} / sqrt(2 * pi()) END"
    return f"CASE WHEN {z} > 0 THEN 1 - ({tail}) ELSE {tail} END"
