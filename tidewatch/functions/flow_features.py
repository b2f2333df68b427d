"""Derived flow features.

A step maps the columns a table has to ``{name: SQL text}`` for the features whose inputs are there.
The whole chain lands in one projection: no copies and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.functions.numbers import finite_test, fractional_columns, numeric_columns, quoted

# The divisor guard and the upper edges of the duration bands.
EPSILON = "1e-6"
DURATION_BANDS = [("1e0", "instant"), ("1e1", "short"), ("6e1", "medium"), ("3e2", "long")]
LAST_BAND = "persistent"
PRIVILEGE_INPUTS = ["root_shell", "su_attempted", "num_root", "num_shells", "num_compromised"]


def per(top: str, bottom: str) -> str:
    """``top / (bottom + EPSILON)`` in doubles; a divisor of exactly zero gives null."""
    return f"try_divide(cast({top} AS double), cast({bottom} AS double) + {EPSILON})"


def flag(condition: str) -> str:
    return f"cast(coalesce({condition}, false) AS tinyint)"


def duration_band(value: str = "duration") -> str:
    """Right-closed bands; a missing duration has no band."""
    whens = " ".join(f"WHEN {value} <= {edge} THEN '{name}'" for edge, name in DURATION_BANDS)
    return f"CASE WHEN {value} IS NULL OR isnan({value}) THEN NULL {whens} ELSE '{LAST_BAND}' END"


def _available(have: set[str], rules: dict[str, tuple[tuple[str, ...], str]]) -> dict[str, str]:
    return {name: text for name, (inputs, text) in rules.items() if have.issuperset(inputs)}


def traffic_rates(have: set[str]) -> dict[str, str]:
    ratio = per("src_bytes", "dst_bytes")
    return _available(have, {
        "src_byte_rate": (("src_bytes", "duration"), per("src_bytes", "duration")),
        "dst_byte_rate": (("dst_bytes", "duration"), per("dst_bytes", "duration")),
        "total_bytes": (("src_bytes", "dst_bytes"), "src_bytes + dst_bytes"),
        "byte_ratio": (("src_bytes", "dst_bytes"), ratio),
        "is_upload_heavy": (("src_bytes", "dst_bytes"), flag(f"{ratio} > 1e0 AND NOT isnan({ratio})")),
        "packet_rate": (("count", "duration"), per("count", "duration")),
        "srv_packet_rate": (("srv_count", "duration"), per("srv_count", "duration")),
    })


def connection_ratios(have: set[str]) -> dict[str, str]:
    return _available(have, {
        "srv_count_ratio": (("srv_count", "count"), per("srv_count", "count")),
        "dst_host_srv_ratio": (("dst_host_srv_count", "dst_host_count"), per("dst_host_srv_count", "dst_host_count")),
        "error_rate_total": (("serror_rate", "rerror_rate"), "serror_rate + rerror_rate"),
        "dst_host_error_rate_total": (
            ("dst_host_serror_rate", "dst_host_rerror_rate"), "dst_host_serror_rate + dst_host_rerror_rate"),
        "srv_diversity": (("diff_srv_rate", "same_srv_rate"), "diff_srv_rate - same_srv_rate"),
    })


def duration_features(have: set[str]) -> dict[str, str]:
    d = "cast(duration AS double)"
    return _available(have, {
        "duration_band": (("duration",), duration_band(d)),
        # greatest() skips null, so the null case is spelled out.
        "log_duration": (("duration",), f"CASE WHEN duration IS NOT NULL THEN log1p(greatest({d}, 0e0)) END"),
    })


def security_indicators(have: set[str]) -> dict[str, str]:
    out = {}
    inputs = [c for c in PRIVILEGE_INPUTS if c in have]
    if inputs:
        total = " + ".join(f"coalesce({c}, 0)" for c in inputs)
        out = {"privilege_activity": total, "has_privilege_activity": flag(f"{total} > 0")}
    out.update(_available(have, {
        "failed_login_flag": (("num_failed_logins",), flag("num_failed_logins > 0")),
        "suspicious_auth": (("num_failed_logins", "logged_in"), flag("num_failed_logins > 0 AND logged_in = 0")),
        "file_activity": (("num_file_creations", "num_access_files"), "num_file_creations + num_access_files"),
    }))
    return out


def interarrival_stats(have: set[str]) -> dict[str, str]:
    all_flows, same_service = per("duration", "count"), per("duration", "srv_count")
    return _available(have, {
        "mean_interarrival": (("duration", "count"), all_flows),
        "mean_srv_interarrival": (("duration", "srv_count"), same_service),
        "interarrival_gap": (("duration", "count", "srv_count"), f"abs({same_service} - {all_flows})"),
    })


STEPS = [traffic_rates, connection_ratios, duration_features, security_indicators, interarrival_stats]


def derived_names(have, steps=None) -> list[str]:
    return [name for step in steps or STEPS for name in step(set(have))]


def add_features(df: DataFrame, step) -> DataFrame:
    """Apply one step without zero-filling."""
    made = step(set(df.columns))
    kept = [quoted(c) for c in df.columns if c not in made]
    return df.selectExpr(*kept, *[f"{text} AS {quoted(name)}" for name, text in made.items()])


def engineer(df: DataFrame, steps=None, untouched=()) -> DataFrame:
    """All derived features, then zero in place of missing in every numeric column, raw ones too.

    ``untouched`` columns (ids, times) are passed through as they are.
    """
    have = set(df.columns) - set(untouched)
    wide = add_features(df, lambda _: {n: t for step in steps or STEPS for n, t in step(have).items()})
    fractional, numeric = set(fractional_columns(wide)), set(numeric_columns(wide, untouched))

    def filled(name: str) -> str:
        c = quoted(name)
        if name not in numeric:
            return c
        if name in fractional:
            return f"CASE WHEN {finite_test(c)} THEN {c} ELSE 0 END AS {c}"
        return f"coalesce({c}, 0) AS {c}"

    return wide.selectExpr(*[filled(c) for c in wide.columns])
