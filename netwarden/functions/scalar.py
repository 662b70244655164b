"""Scalar column functions: every function returns a ``Column``."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from netwarden.schema import (
    CODE_POLICY, DEFAULT_PROTOCOL, PROTOCOL_NAMES, SEVERITY_ACTIONS, SEVERITY_ORDER,
    THREAT_LABELS, THREAT_NAMES, SeverityPolicy, POLICIES,
)

__all__ = [
    "ntz_micros", "ntz_as_utc",
    "sql_clip_confidence", "sql_classify_severity", "sql_recommend_action", "sql_threat_type_name",
    "sql_protocol_name", "sql_alert_id", "sql_str",
    "col_or", "map_literal", "clip_confidence", "classify_severity", "recommend_action",
    "severity_rank", "threat_type_name", "protocol_name", "percent_round", "alert_id",
    "threat_label", "anomaly_flag", "is_finite", "finite_or_null", "resolve_policy",
    "md5_key", "hash_unit",
]


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def resolve_policy(policy) -> SeverityPolicy:
    if policy is None:
        return CODE_POLICY
    if isinstance(policy, str):
        return POLICIES[policy]
    return policy


def clip_confidence(p) -> Column:
    """max(min(p, 1), 0.5): a missing probability (NULL, NaN) counts as 0.5 (isolation-only alert)."""
    known = F.nanvl(col_or(p).cast("double"), F.lit(None).cast("double"))
    return F.greatest(F.least(F.coalesce(known, F.lit(0.5)), F.lit(1.0)), F.lit(0.5))


def classify_severity(conf, policy=None) -> Column:
    """Confidence in [0, 1] -> CRITICAL / HIGH / MEDIUM / LOW."""
    pol = resolve_policy(policy)
    c = col_or(conf)
    return (F.when(c >= F.lit(pol.critical), "CRITICAL")
            .when(c >= F.lit(pol.high), "HIGH")
            .when(c >= F.lit(pol.medium), "MEDIUM")
            .otherwise("LOW"))


def recommend_action(severity) -> Column:
    return map_literal(SEVERITY_ACTIONS)[col_or(severity)]


def severity_rank(severity) -> Column:
    return map_literal({s: i for i, s in enumerate(SEVERITY_ORDER)})[col_or(severity)]


def threat_type_name(raw) -> Column:
    """Known code -> display name; unknown codes pass through; NULL -> Unknown's name."""
    r = F.coalesce(col_or(raw), F.lit("Unknown"))
    return F.coalesce(map_literal(THREAT_NAMES)[r], r)


def protocol_name(code) -> Column:
    """Truncated numeric protocol code -> name; unknown or missing -> TCP."""
    return F.coalesce(map_literal(PROTOCOL_NAMES)[col_or(code).cast("int")],
                      F.lit(DEFAULT_PROTOCOL))


def percent_round(p, digits: int = 2, half_even: bool = False) -> Column:
    x = col_or(p) * F.lit(100.0)
    return F.bround(x, digits) if half_even else F.round(x, digits)


def md5_key(key, seed=None) -> Column:
    """md5 hex of '<seed>:<key>' (or of the key alone): deterministic, retry-safe."""
    k = col_or(key).cast("string")
    if seed is not None:
        k = F.concat(F.lit(f"{seed}:"), k)
    return F.md5(k)


def hash_unit(key, seed) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of md5(seed:key)."""
    return F.conv(F.substring(md5_key(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def alert_id(row_id) -> Column:
    """8 upper-case hex characters derived from the row key (stable across retries)."""
    return F.upper(F.substring(F.md5(col_or(row_id).cast("string")), 1, 8))


def threat_label(final_prediction) -> Column:
    return map_literal(THREAT_LABELS)[col_or(final_prediction)]


def anomaly_flag(score) -> Column:
    """Decision score < 0 -> 1 (anomaly), else 0."""
    return (col_or(score) < F.lit(0.0)).cast("int")


def is_finite(c) -> Column:
    x = col_or(c)
    return ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def finite_or_null(c) -> Column:
    """NaN and +-Inf -> NULL (Spark keeps NaN apart from NULL; NaN > x is true)."""
    x = col_or(c)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


# ---------------------------------------------------------------------------
# The same functions as SQL text.  A plan built from text costs one Python->JVM
# call per column instead of one per literal, which matters when plans are
# wide or many; the expressions Catalyst receives are the same.
# ---------------------------------------------------------------------------
def sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_case(expr: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {sql_str(k) if isinstance(k, str) else k} THEN {sql_str(v)}"
                     for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default if default is not None else 'NULL'} END"


def sql_clip_confidence(p: str) -> str:
    return f"greatest(least(coalesce(nanvl(CAST({p} AS DOUBLE), CAST(NULL AS DOUBLE)), 0.5D), 1.0D), 0.5D)"


def sql_classify_severity(conf: str, policy=None) -> str:
    pol = resolve_policy(policy)
    return (f"CASE WHEN {conf} >= {pol.critical!r}D THEN 'CRITICAL' WHEN {conf} >= {pol.high!r}D THEN 'HIGH' "
            f"WHEN {conf} >= {pol.medium!r}D THEN 'MEDIUM' ELSE 'LOW' END")


def sql_recommend_action(sev: str) -> str:
    return _sql_case(sev, SEVERITY_ACTIONS)


def sql_threat_type_name(raw: str) -> str:
    r = f"coalesce({raw}, 'Unknown')"
    return _sql_case(r, THREAT_NAMES, r)


def sql_protocol_name(code: str) -> str:
    return _sql_case(f"CAST({code} AS INT)", PROTOCOL_NAMES, sql_str(DEFAULT_PROTOCOL))


def sql_alert_id(key: str) -> str:
    return f"upper(substring(md5(CAST({key} AS STRING)), 1, 8))"


# ---------------------------------------------------------------------------
# Event time without the session time zone.  TIMESTAMP_NTZ is a wall clock;
# casting it to TIMESTAMP goes through the session zone (shifted windows in
# half-hour zones, non-monotonic around DST changes).  Interval arithmetic from
# the epoch reads the wall clock as UTC instead, whatever the session zone.
# ---------------------------------------------------------------------------
def ntz_as_utc(c) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP at the same wall clock in UTC."""
    name = c if isinstance(c, str) else None
    if name is None:
        raise TypeError("pass the column name")
    return F.expr(f"timestamp_seconds(0) + (`{name}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def ntz_micros(c) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ (wall clock read as UTC)."""
    return F.unix_micros(ntz_as_utc(c))
