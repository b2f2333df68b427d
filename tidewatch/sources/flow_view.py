"""A labelled flow table made from the ``events`` table, column by column.

Test adapter, not a detection feature: the given tables carry no flows, so each flow column is a
row-wise expression of one event. The text means the same in Spark SQL and ANSI SQL, which lets a
query and its check read one definition. ``k`` is the integer inside ``props``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.functions.numbers import missing_to_null

LABEL = ("CASE event_type WHEN 'view' THEN 'normal' WHEN 'error' THEN 'dos' WHEN 'click' THEN 'probe' "
         "WHEN 'signup' THEN 'r2l' ELSE 'u2r' END")


def _when(kind: str, yes: str, no: str = "0") -> str:
    return f"CASE WHEN event_type = '{kind}' THEN {yes} ELSE {no} END"


def _gap(every: int, value: str) -> str:
    """``value``, missing in every ``every``-th event."""
    return f"CASE WHEN event_id % {every} = 0 THEN NULL ELSE {value} END"


def _share(value: str) -> str:
    return f"(({value}) % 101) / 1e2"


TEXT = {
    "protocol_type": "CASE WHEN user_id % 10 < 6 THEN 'tcp' WHEN user_id % 10 < 9 THEN 'udp' ELSE 'icmp' END",
    "service": "CASE (user_id + k) % 8 WHEN 0 THEN 'http' WHEN 1 THEN 'http' WHEN 2 THEN 'smtp' WHEN 3 THEN 'ftp' "
               "WHEN 4 THEN 'ssh' WHEN 5 THEN 'domain_u' WHEN 6 THEN 'private' ELSE 'other' END",
    "flag": _gap(61, "CASE WHEN event_type = 'error' AND k % 10 < 7 THEN 'S0' WHEN event_type = 'click' AND k % 10 < 5 "
                     "THEN 'REJ' WHEN k % 25 = 0 THEN 'RSTO' ELSE 'SF' END"),
    "label": LABEL,
}

WHOLE = {
    "src_bytes": "CASE WHEN event_id % 499 = 0 THEN 25000000 WHEN event_id % 7 = 0 THEN 0 ELSE "
                 + "k * (user_id % 97 + 1) * " + _when("view", "20", "3") + " END",
    "dst_bytes": "CASE WHEN event_id % 5 = 0 THEN 0 ELSE (k + 3) * (event_id % 61) * " + _when("error", "1", "9") + " END",
    "land": "CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END",
    "wrong_fragment": _gap(43, _when("error", "k % 4")),
    "urgent": "0",
    "hot": "k % 5",
    "num_failed_logins": _gap(37, _when("signup", "k % 6", "CASE WHEN k = 99 THEN 1 ELSE 0 END")),
    "logged_in": "(user_id + event_id) % 2",
    "num_compromised": _gap(53, _when("purchase", "k % 8")),
    "root_shell": _when("purchase", "CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END"),
    "su_attempted": _when("purchase", "CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END"),
    "num_root": _when("purchase", "k % 9", "k % 2"),
    "num_file_creations": _gap(41, _when("purchase", "k % 5")),
    "num_shells": _when("purchase", "k % 3"),
    "num_access_files": _when("signup", "k % 4"),
    "num_outbound_cmds": "0",
    "is_host_login": "0",
    "is_guest_login": _when("signup", "CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END"),
    "count": "1 + k * " + _when("error", "5", "1"),
    "srv_count": "1 + (k * 3 + user_id) % " + _when("error", "200", "40"),
    "dst_host_count": "1 + (user_id * 7 + k) % 255",
    "dst_host_srv_count": "1 + (user_id * 11 + k * 3) % " + _when("click", "30", "255"),
}

FRACTION = {
    "serror_rate": _when("error", _share("60 + k % 41"), _share("k % 20")),
    "srv_serror_rate": _when("error", _share("58 + k % 43"), _share("(k + 3) % 25")),
    "rerror_rate": _when("click", _share("50 + k % 51"), _share("k % 15")),
    "srv_rerror_rate": _when("click", _share("48 + k % 53"), _share("(k + 1) % 18")),
    "same_srv_rate": _when("view", _share("70 + k % 31"), _share("(k * 7 + event_id) % 80")),
    "diff_srv_rate": _when("click", _share("40 + (k * 3) % 60"), _share("(k + event_id) % 30")),
    "srv_diff_host_rate": _share("k * 13 + user_id"),
    "dst_host_same_srv_rate": _share("k * 5 + user_id * 3"),
    "dst_host_diff_srv_rate": _share("k + user_id"),
    "dst_host_same_src_port_rate": _share("k * 11"),
    "dst_host_srv_diff_host_rate": "CASE WHEN event_id % 97 = 0 THEN cast('Infinity' AS double) "
                                   "WHEN event_id % 89 = 0 THEN cast('NaN' AS double) ELSE " + _share("k * 17") + " END",
    "dst_host_serror_rate": _when("error", _share("55 + k % 46"), _share("(k * 3) % 30")),
    "dst_host_srv_serror_rate": _share("k * 2 + event_id"),
    "dst_host_rerror_rate": _when("click", _share("45 + k % 56"), _share("(k * 2) % 22")),
    "dst_host_srv_rerror_rate": _share("k * 19 + 7"),
}


def column_text() -> dict[str, str]:
    """Flow column -> SQL text over ``events`` plus ``k``."""
    text = {"flow_id": "event_id", "stream_key": "user_id % 16", "duration": "value"}
    text.update({c: f"cast({e} AS bigint)" for c, e in WHOLE.items()})
    text.update({c: f"cast({e} AS double)" for c, e in FRACTION.items()})
    text.update(TEXT)
    return text


def raw_flows_of(events: DataFrame) -> DataFrame:
    keyed = events.selectExpr(
        "event_id", "user_id", "event_type", "value",
        "cast(get_json_object(props, '$.k') AS bigint) AS k",
        "unix_micros(cast(ts AS timestamp)) AS ts_us",
    )
    return keyed.selectExpr("ts_us", *[f"{e} AS {c}" for c, e in column_text().items()])


def flows_of(events: DataFrame) -> DataFrame:
    """The flow view of an events table or stream."""
    return missing_to_null(raw_flows_of(events))


def raw_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The flow table as a capture would deliver it, NaN and infinities included."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return raw_flows_of(spark.read.parquet(f"{folder}/events.parquet"))


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """The flow table with null as its only missing marker."""
    return missing_to_null(raw_flows(spark, folder))
