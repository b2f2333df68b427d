"""The check SQL of each query: plain ANSI SQL over the given tables."""

from __future__ import annotations

from tidewatch.functions.columns import CATEGORICAL, CLASS_MIX, FEATURES, NUMERIC
from tidewatch.plans.queries import COARSE, IMPUTED, LINE_NUMBERS, RANKED, SCALED, ONE_DAY
from tidewatch.plans.scores import CLASSES, SCORES
from tidewatch.sources.flow_view import FRACTION, column_text

RAW = (
    "raw AS (SELECT epoch_us(ts) AS ts_us, " + ", ".join(f"{e} AS {c}" for c, e in column_text().items())
    + " FROM (SELECT *, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events))"
)
_CLEANED = [
    f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" if c in FRACTION or c == "duration" else c
    for c in ["ts_us", *column_text()]
]
FLOWS = f"{RAW}, flows AS (SELECT {', '.join(_CLEANED)} FROM raw)"


def _per(a, b):
    return f"{a} / ({b} + 1e-6)"


_FORMULAS = {
    "src_byte_rate": _per("src_bytes", "duration"),
    "dst_byte_rate": _per("dst_bytes", "duration"),
    "total_bytes": "src_bytes + dst_bytes",
    "byte_ratio": _per("src_bytes", "dst_bytes"),
    "is_upload_heavy": f"CASE WHEN {_per('src_bytes', 'dst_bytes')} > 1 THEN 1 ELSE 0 END",
    "packet_rate": _per("count", "duration"),
    "srv_packet_rate": _per("srv_count", "duration"),
    "srv_count_ratio": _per("srv_count", "count"),
    "dst_host_srv_ratio": _per("dst_host_srv_count", "dst_host_count"),
    "error_rate_total": "serror_rate + rerror_rate",
    "dst_host_error_rate_total": "dst_host_serror_rate + dst_host_rerror_rate",
    "srv_diversity": "diff_srv_rate - same_srv_rate",
    "duration_band": "CASE WHEN duration IS NULL THEN NULL WHEN duration <= 1 THEN 'instant' WHEN duration <= 10 THEN 'short' "
                     "WHEN duration <= 60 THEN 'medium' WHEN duration <= 300 THEN 'long' ELSE 'persistent' END",
    "log_duration": "ln(1 + greatest(duration, 0))",
    "privilege_activity": "coalesce(root_shell, 0) + coalesce(su_attempted, 0) + coalesce(num_root, 0) + coalesce(num_shells, 0) "
                          "+ coalesce(num_compromised, 0)",
    "has_privilege_activity": "CASE WHEN coalesce(root_shell, 0) + coalesce(su_attempted, 0) + coalesce(num_root, 0) "
                              "+ coalesce(num_shells, 0) + coalesce(num_compromised, 0) > 0 THEN 1 ELSE 0 END",
    "failed_login_flag": "CASE WHEN num_failed_logins > 0 THEN 1 ELSE 0 END",
    "suspicious_auth": "CASE WHEN num_failed_logins > 0 AND logged_in = 0 THEN 1 ELSE 0 END",
    "file_activity": "num_file_creations + num_access_files",
    "mean_interarrival": _per("duration", "count"),
    "mean_srv_interarrival": _per("duration", "srv_count"),
    "interarrival_gap": f"abs({_per('duration', 'srv_count')} - {_per('duration', 'count')})",
}
_WHOLE = {"total_bytes", "is_upload_heavy", "privilege_activity", "has_privilege_activity", "failed_login_flag", "suspicious_auth", "file_activity"}
_FILL = [f"coalesce({c}, 0) AS {c}" if c in NUMERIC else c for c in ["ts_us", *column_text()]]
ENG = (
    f"{FLOWS}, eng AS (SELECT {', '.join(_FILL)}, "
    + ", ".join(f"{e} AS {c}" if c == "duration_band" else f"coalesce({e}, 0) AS {c}" for c, e in _FORMULAS.items())
    + " FROM flows)"
)
SCORED = (
    f"{ENG}, z AS (SELECT *, " + ", ".join(f"cast({SCORES[c]} AS double) AS z_{c}" for c in CLASSES) + " FROM eng), "
    "ez AS (SELECT *, " + ", ".join(
        f"exp(z_{c} - greatest({', '.join('z_' + x for x in CLASSES)})) AS e_{c}" for c in CLASSES) + " FROM z), "
    "pz AS (SELECT *, " + ", ".join(f"e_{c} / ({' + '.join('e_' + x for x in CLASSES)}) AS p_{c}" for c in CLASSES) + " FROM ez), "
    f"best AS (SELECT *, greatest({', '.join('p_' + c for c in CLASSES)}) AS confidence FROM pz), "
    "named AS (SELECT *, CASE " + " ".join(f"WHEN p_{c} = confidence THEN '{c}'" for c in CLASSES) + " END AS predicted_class FROM best), "
    "det AS (SELECT *, predicted_class <> 'normal' AND confidence >= 0.7 AS is_attack, least(3, CASE WHEN confidence >= 0.95 THEN 3 "
    "WHEN confidence >= 0.85 THEN 2 WHEN confidence >= 0.7 THEN 1 ELSE 0 END + CASE WHEN predicted_class IN ('u2r', 'r2l') THEN 1 ELSE 0 END) "
    "AS severity_rank FROM named)"
)
ALERTS = (
    f"{SCORED}, cand AS (SELECT *, CASE severity_rank WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity "
    "FROM det WHERE is_attack), keyed AS (SELECT *, predicted_class || ':' || severity AS throttle_key FROM cand)"
)


def throttled(window_us: int, limit: int, where: str = "true") -> str:
    """The rate limit as a row-by-row recursion over each key, the log carried as a list."""
    return (
        "WITH RECURSIVE " + ALERTS + f", line AS (SELECT throttle_key, severity, flow_id, ts_us, row_number() OVER (PARTITION BY throttle_key "
        f"ORDER BY ts_us, flow_id) AS place FROM keyed WHERE {where}), "
        "fold AS (SELECT DISTINCT throttle_key, cast('' AS varchar) AS severity, cast(-1 AS bigint) AS flow_id, cast(0 AS bigint) AS place, "
        "cast([] AS bigint[]) AS log, false AS allowed, cast(0 AS bigint) AS count_in_window, cast(0 AS bigint) AS suppressed_total FROM line "
        "UNION ALL SELECT throttle_key, severity, flow_id, place, CASE WHEN len(kept) < {m} THEN list_append(kept, ts_us) ELSE kept END, "
        "len(kept) < {m}, CASE WHEN len(kept) < {m} THEN len(kept) + 1 ELSE len(kept) END, "
        "suppressed_total + CASE WHEN len(kept) < {m} THEN 0 ELSE 1 END FROM (SELECT line.*, fold.suppressed_total, "
        "list_filter(fold.log, lambda t: t >= line.ts_us - {w}) AS kept FROM fold JOIN line ON line.throttle_key = fold.throttle_key "
        "AND line.place = fold.place + 1)) ".replace("{m}", str(limit)).replace("{w}", str(window_us))
    )


def _hash(seed: int = 42, column: str = "flow_id") -> str:
    return f"md5('{seed}:' || cast({column} AS varchar))"


def _share_quota(counts: str, draws: str, name: str) -> str:
    """Largest-remainder shares of ``draws`` over ``counts(label, n)``."""
    return (
        f"{name}_x AS (SELECT label, n, cast(n AS double) / sum(n) OVER () * {draws} AS exact, {draws} AS draws FROM {counts}), "
        f"{name} AS (SELECT label, n, cast(floor(exact) AS bigint) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label) "
        f"<= draws - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_x)"
    )


SPLIT = (
    f"{FLOWS}, sizes AS (SELECT label, count(*) AS n FROM flows GROUP BY label), "
    + _share_quota("sizes", "(SELECT ceil(sum(n) * 15e-2) FROM sizes)", "tq")
    + ", rest AS (SELECT label, n - quota AS n FROM tq), "
    + _share_quota("rest", "(SELECT ceil(sum(n) * (15e-2 / (1e0 - 15e-2))) FROM rest)", "vq")
    + f", ranked AS (SELECT flow_id, label, row_number() OVER (PARTITION BY label ORDER BY {_hash()}) AS r FROM flows), "
    "split_rows AS (SELECT flow_id, ranked.label, CASE WHEN r <= tq.quota THEN 'test' WHEN r <= tq.quota + vq.quota THEN 'val' ELSE 'train' END "
    "AS split FROM ranked JOIN tq ON tq.label = ranked.label JOIN vq ON vq.label = ranked.label)"
)
_MIX_N = 500
_MIX = {k: max(1, int(_MIX_N * w / sum(CLASS_MIX.values()))) for k, w in CLASS_MIX.items()}
_MIX["normal"] += _MIX_N - sum(_MIX.values())


def _describe(table: str, columns, head: str) -> str:
    parts = [
        f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, "
        + ", ".join(f"round(quantile_cont({c}, {q}), 4) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))
        + f", round(max({c}), 4) AS max FROM (SELECT cast({c} AS double) AS {c} FROM {table})"
        for c in columns
    ]
    return head + " UNION ALL ".join(parts)


def _corr(a, b):
    return f"CASE WHEN isfinite(corr({a}, {b})) THEN corr({a}, {b}) ELSE 0 END"


def _pairs(columns, table):
    parts = [
        f"SELECT '{a}' AS column_i, '{b}' AS column_j, round({_corr(a, b)}, 6) AS r FROM {table}"
        for i, a in enumerate(columns) for b in columns[i + 1:]
    ]
    return " UNION ALL ".join(parts)


def _all_pairs(columns, table):
    """Every pair in one read of the table: one struct a pair, made rows afterwards."""
    pairs = [
        f"{{'column_i': '{a}', 'column_j': '{b}', 'r': round({_corr(a, b)}, 6)}}"
        for i, a in enumerate(columns) for b in columns[i + 1:]
    ]
    return f"SELECT unnest(pairs, recursive := true) FROM (SELECT [{', '.join(pairs)}] AS pairs FROM {table})"


_INDEX = "CASE label " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES)) + " END"
_SCORES_CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs({_corr(c, 'y')}) AS score FROM ix" for c in RANKED)
INDEXED = f"{ENG}, ix AS (SELECT *, cast({_INDEX} AS double) AS y FROM eng)"


def _mutual() -> str:
    edges = ", ".join(f"quantile_cont(cast({c} AS double), [{', '.join(str(i / 10) for i in range(1, 10))}]) AS {c}" for c in RANKED)
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, label, len(list_filter(list_distinct(e.{c}), lambda q: cast(ix.{c} AS double) > q)) AS bin FROM ix, edges e" for c in RANKED)
    return (
        f"WITH {INDEXED}, edges AS (SELECT {edges} FROM ix), cells AS ({cells}), cnt AS (SELECT feature, bin, label, count(*) AS n FROM cells GROUP BY ALL), "
        "tot AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS nc, "
        "sum(n) OVER (PARTITION BY feature) AS na FROM cnt) SELECT feature, round(greatest(sum(n / na * ln(cast(n AS double) * na / "
        "(cast(nb AS double) * nc))), 0), 6) AS score FROM tot GROUP BY feature"
    )


PAIRS = "prs AS (SELECT label AS truth, predicted_class AS predicted, count(*) AS n FROM det GROUP BY ALL)"


def _class_scores(name: str, pairs: str, classes: str) -> str:
    """Precision, recall and F1 for each class in ``classes(class)``."""
    return (
        f"{name} AS (SELECT class, CASE WHEN pn = 0 THEN 0 ELSE tp / pn END AS precision, CASE WHEN sn = 0 THEN 0 ELSE tp / sn END AS recall, "
        "CASE WHEN pn + sn = 0 THEN 0 ELSE 2 * tp / (pn + sn) END AS f1, cast(sn AS bigint) AS support FROM (SELECT class, "
        + ", ".join(
            f"cast(coalesce((SELECT sum(n) FROM {pairs} p WHERE {cond}), 0) AS double) AS {alias}"
            for cond, alias in (("p.truth = c.class AND p.predicted = c.class", "tp"), ("p.predicted = c.class", "pn"), ("p.truth = c.class", "sn")))
        + f" FROM {classes} c))"
    )


def _headline(pairs_sql: str, head: str) -> str:
    measures = ("precision", "recall", "f1")
    return (
        f"WITH {head}{pairs_sql}, seen AS (SELECT truth AS class FROM prs UNION SELECT predicted FROM prs), {_class_scores('cs', 'prs', 'seen')} "
        "SELECT 'accuracy' AS metric, round((SELECT sum(n) FROM prs WHERE truth = predicted) / cast((SELECT sum(n) FROM prs) AS double), 6) AS value "
        + "".join(f"UNION ALL SELECT '{m}_macro', round(avg({m}), 6) FROM cs " for m in measures)
        + "".join(f"UNION ALL SELECT '{m}_weighted', round(sum({m} * support) / sum(support), 6) FROM cs " for m in measures)
    )


GRID = "classes AS (SELECT unnest([{}]) AS class)"
_GRID5 = GRID.format(", ".join(f"'{c}'" for c in CLASSES))
_GRID6 = GRID.format(", ".join(f"'{c}'" for c in [*CLASSES, "worm"]))
GROUPS = (
    "sg AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS class, p_{c} AS score, sum(CASE WHEN label = '{c}' THEN 1 ELSE 0 END) AS pos, "
        f"sum(CASE WHEN label = '{c}' THEN 0 ELSE 1 END) AS neg FROM det GROUP BY p_{c}" for c in CLASSES)
    + "), sr AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY class) AS tp, "
    "sum(neg) OVER (PARTITION BY class) AS tn FROM sg WINDOW w AS (PARTITION BY class ORDER BY score)), "
    "auc AS (SELECT class, sum(cast(pos AS double) * (cn - neg / 2e0)) / (max(cast(tp AS double)) * max(cast(tn AS double))) AS auc FROM sr GROUP BY class)"
)
LAST = f"{SCORED}, win AS (SELECT * FROM det ORDER BY ts_us DESC, flow_id DESC LIMIT 500)"
_TREND = ("(SELECT predicted_class FROM win WHERE is_attack GROUP BY predicted_class ORDER BY count(*) DESC, min(ts_us) LIMIT 1)")
SUBMITTED = (
    f"{FLOWS}, sub AS (SELECT flow_id, coalesce(CASE WHEN flow_id % 11 = 0 THEN NULL ELSE duration END, 0) AS duration, protocol_type, "
    "CASE WHEN flow_id % 13 = 0 THEN '' ELSE service END AS service, coalesce(flag, 'SF') AS flag, "
    "CASE WHEN flow_id % 17 = 0 THEN -10 ELSE src_bytes END AS src_bytes FROM flows), chk AS (SELECT *, concat_ws('; ', "
    "CASE WHEN service = '' THEN 'service is empty' END, CASE WHEN src_bytes < 0 THEN 'src_bytes is negative' END) AS violations FROM sub)"
)


def _moments(columns, table, kind):
    if kind == "standard":
        pieces = [f"round((cast({c} AS double) - avg({c}) OVER ()) / CASE WHEN min({c}) OVER () = max({c}) OVER () THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in columns]
    else:
        pieces = [f"round((cast({c} AS double) - min({c}) OVER ()) / CASE WHEN min({c}) OVER () = max({c}) OVER () THEN 1 ELSE max({c}) OVER () - min({c}) OVER () END, 6) AS {c}" for c in columns]
    return f"SELECT flow_id, {', '.join(pieces)} FROM {table}"


# Category levels the flow view can produce.
LEVELS = {
    "protocol_type": ["icmp", "tcp", "udp"],
    "service": ["domain_u", "ftp", "http", "other", "private", "smtp", "ssh"],
    "flag": ["REJ", "RSTO", "S0", "SF"],
}


def _dummies(columns) -> list[tuple[str, str]]:
    out = []
    for c in columns:
        out += [(f"{c}_{v}", f"CASE WHEN {c} = '{v}' THEN 1e0 ELSE 0e0 END") for v in LEVELS[c]]
        listed = ", ".join(f"'{v}'" for v in LEVELS[c])
        out.append((f"{c}___unknown__", f"CASE WHEN {c} IN ({listed}) THEN 0e0 ELSE 1e0 END"))
    return out


def _imputed(c):
    return f"coalesce(cast({c} AS double), (SELECT quantile_cont(cast({c} AS double), 0.5) FROM flows))"


def _encoded() -> str:
    cells = [(c, _imputed(c)) for c in IMPUTED] + _dummies(["flag"])
    inner = ", ".join(f'{e} AS "{c}"' for c, e in cells)
    outer = ", ".join(
        f'round(("{c}" - avg("{c}") OVER ()) / CASE WHEN min("{c}") OVER () = max("{c}") OVER () THEN 1 ELSE stddev_pop("{c}") OVER () END, 6) AS "{c}"'
        for c, _ in cells)
    return f"WITH {FLOWS}, enc AS (SELECT flow_id, {inner} FROM flows) SELECT flow_id, {outer} FROM enc"


def _quality(extra: str) -> list[str]:
    return [f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing{extra.replace('@', c)} FROM flows" for c in [*FEATURES, "label"]]


def _round_for(c):
    return 2 if c in ("byte_ratio", "src_byte_rate", "dst_byte_rate") else 6


_CONST = " UNION ALL ".join(
    f"SELECT '{c}' AS feature FROM flows HAVING count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1" for c in FEATURES)
_THROTTLE = throttled(ONE_DAY * 1_000_000, 5)
_LABEL_PAIRS = "prs AS (SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL)"
_VARIED = [c for c in COARSE if c not in ("urgent", "num_outbound_cmds")]


def all_oracles() -> dict[str, str]:
    later = []
    for j, b in enumerate(RANKED):
        tests = [f"abs({_corr(a, b)}) > 0.9" for a in RANKED[:j]]
        later.append(f"SELECT '{b}' AS feature, {j} AS place, {' OR '.join(tests) if tests else 'count(*) < 0'} AS gone FROM ix")
    gone = " UNION ALL ".join(later)
    found = {
        "engineer_features": f"WITH {ENG} SELECT flow_id, " + ", ".join(
            c if c == "duration_band" else f"cast({c} AS bigint) AS {c}" if c in _WHOLE else f"round({c}, {_round_for(c)}) AS {c}" for c in sorted(_FORMULAS)) + " FROM eng",
        "zero_filled_inputs": f"WITH {ENG} SELECT flow_id, wrong_fragment, num_failed_logins, num_compromised, round(dst_host_srv_diff_host_rate, 6) AS dst_host_srv_diff_host_rate FROM eng",
        "duration_band_counts": f"WITH {ENG} SELECT duration_band, count(*) AS n FROM eng GROUP BY duration_band",
        "class_distribution": f"WITH {FLOWS} SELECT label AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM flows GROUP BY label",
        "class_counts_pct": f"WITH {FLOWS} SELECT label AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM flows GROUP BY label",
        "column_quality": f"WITH {FLOWS} " + " UNION ALL ".join(_quality(", round((count(*) - count(@)) * 1e2 / count(*), 3) AS missing_pct, count(DISTINCT @) AS distinct_values")),
        "most_missing": f"WITH {FLOWS} SELECT * FROM (" + " UNION ALL ".join(_quality("")) + ") ORDER BY missing DESC, feature LIMIT 15",
        "duplicate_count": f"WITH {FLOWS} SELECT cast(sum(n - 1) AS bigint) AS duplicate_rows FROM (SELECT count(*) AS n FROM flows GROUP BY {', '.join(COARSE)})",
        "duplicate_lineitems": "SELECT cast(sum(n - 1) AS bigint) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
        "describe_numeric": _describe("flows", NUMERIC, f"WITH {FLOWS} "),
        "describe_lineitem": _describe("lineitem", LINE_NUMBERS, ""),
        "clean_rows": f"WITH {FLOWS} SELECT DISTINCT {', '.join(_VARIED)} FROM flows WHERE label IS NOT NULL",
        "constant_columns": f"WITH {FLOWS} {_CONST}",
        "nonfinite_to_null": f"WITH {RAW} SELECT isnan(v) AS was_nan, isinf(v) AS was_inf, count(*) AS n, count(CASE WHEN isfinite(v) THEN 1 END) AS known "
                             "FROM (SELECT dst_host_srv_diff_host_rate AS v FROM raw) GROUP BY ALL",
        "numeric_coercion": f"WITH {FLOWS} SELECT flow_id, try_cast(CASE WHEN flow_id % 9 = 0 THEN cast(count AS varchar) || 'x' ELSE cast(count AS varchar) END AS double) AS number FROM flows",
        "record_violations": f"WITH {RAW} SELECT flow_id, concat_ws('; ', CASE WHEN flag IS NULL THEN 'flag is null' END, CASE WHEN wrong_fragment IS NULL THEN "
                             "'wrong_fragment is null' END, CASE WHEN num_failed_logins IS NULL THEN 'num_failed_logins is null' END, CASE WHEN NOT "
                             "isfinite(dst_host_srv_diff_host_rate) THEN 'dst_host_srv_diff_host_rate is not finite' END, 'payload_entropy is missing') AS violations FROM raw",
        "flow_contract_violations": f"WITH {SUBMITTED} SELECT flow_id, duration, protocol_type, service, flag, cast(1 AS bigint) AS srv_count, violations FROM chk",
        "quarantine_counts": f"WITH {SUBMITTED} SELECT CASE WHEN violations = '' THEN 'valid' ELSE 'quarantined' END AS part, count(*) AS n FROM chk GROUP BY ALL",
        "binary_labels": f"WITH {FLOWS} SELECT CASE WHEN label = 'normal' THEN 'normal' ELSE 'attack' END AS label, count(*) AS n FROM flows GROUP BY 1",
        "byte_cap": f"WITH {FLOWS} SELECT flow_id, least(src_bytes, 10000000) AS src_bytes, least(dst_bytes, 10000000) AS dst_bytes FROM flows",
        "unknown_labels": f"WITH {FLOWS} SELECT DISTINCT label FROM flows WHERE label NOT IN ('normal', 'dos', 'probe')",
        "medians": f"WITH {FLOWS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(coalesce(quantile_cont(cast({c} AS double), 0.5), 0), 6) AS median FROM flows" for c in NUMERIC),
        "modes": f"WITH {FLOWS} " + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, (SELECT {c} FROM flows WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode" for c in CATEGORICAL),
        "category_levels": f"WITH {FLOWS} " + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS feature, {c} AS level FROM flows WHERE {c} IS NOT NULL" for c in CATEGORICAL),
        "impute_median": f"WITH {FLOWS} SELECT flow_id, " + ", ".join(f"round({_imputed(c)}, 6) AS {c}" for c in IMPUTED) + " FROM flows",
        "one_hot": f"WITH {FLOWS} SELECT flow_id, " + ", ".join(f'{e} AS "{c}"' for c, e in _dummies(CATEGORICAL)) + " FROM flows",
        "standard_scale": f"WITH {FLOWS} " + _moments(SCALED, "flows", "standard"),
        "minmax_scale": f"WITH {FLOWS} " + _moments(SCALED, "flows", "minmax"),
        "encoded_matrix": _encoded(),
        "label_encode": f"WITH {FLOWS} SELECT flow_id, label, cast({_INDEX} AS bigint) AS label_index, label AS decoded FROM flows",
        "stratified_split": f"WITH {SPLIT} SELECT flow_id, label, split FROM split_rows",
        "split_sizes": f"WITH {SPLIT} SELECT split, label, count(*) AS n FROM split_rows GROUP BY ALL",
        "sample_random": f"WITH {FLOWS} SELECT flow_id, label FROM flows ORDER BY {_hash()} LIMIT 700",
        "sample_per_class": f"WITH {FLOWS} SELECT flow_id, label FROM flows QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_hash()}) <= 25",
        "sample_class_mix": f"WITH {FLOWS} SELECT flow_id, label FROM flows QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_hash()}) <= CASE label "
                            + " ".join(f"WHEN '{k}' THEN {q}" for k, q in _MIX.items()) + " ELSE 0 END",
        "shuffle_flows": f"WITH {FLOWS} SELECT flow_id, label, row_number() OVER (ORDER BY {_hash()}) - 1 AS place FROM flows",
        "kfold_assign": f"WITH {FLOWS} SELECT flow_id, label, (row_number() OVER (PARTITION BY label ORDER BY {_hash()}) - 1) % 5 AS fold FROM flows",
        "csv_round_trip": f"WITH {FLOWS} SELECT flow_id, service, src_bytes, label FROM flows",
        "parquet_built_once": f"WITH {FLOWS} SELECT flow_id, flag, dst_bytes, label FROM flows",
        "target_contract": f"WITH {FLOWS}, c AS (SELECT 'as it is' AS \"case\", label, TRUE AS here FROM flows UNION ALL SELECT 'gaps', CASE WHEN flow_id % 10 <> 0 THEN label END, TRUE FROM flows "
                           "UNION ALL SELECT 'one class', label, label = 'normal' FROM flows UNION ALL SELECT 'no rows', label, flow_id < 0 FROM flows) "
                           "SELECT \"case\", count(CASE WHEN here AND label IS NULL THEN 1 END) > 0 OR count(DISTINCT CASE WHEN here THEN label END) < 2 AS refused FROM c GROUP BY \"case\"",
        "split_single_row_class": f"WITH {FLOWS}, r AS (SELECT flow_id, row_number() OVER (ORDER BY {_hash()}) AS r, ceil(count(*) OVER () * 0.15) AS t, count(*) OVER () AS n FROM flows) "
                                  "SELECT flow_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil((n - t) * (0.15 / (1 - 0.15))) THEN 'val' ELSE 'train' END AS split FROM r",
        # Without num_compromised neither it nor the two privilege columns that need it can be had: three defaults.
        "saved_model_scores": "SELECT count(*) AS flows, cast(0 AS bigint) AS other_class, cast(0 AS bigint) AS other_confidence, cast(3 AS bigint) AS inputs_defaulted, "
                              "cast(0 AS bigint) AS without_time FROM events",
        "kfold_null_labels": f"WITH {FLOWS}, gaps AS (SELECT flow_id, CASE WHEN flow_id % 10 <> 0 THEN label END AS label FROM flows) "
                             f"SELECT flow_id, label, (row_number() OVER (PARTITION BY label ORDER BY {_hash()}) - 1) % 5 AS fold FROM gaps",
        "train_clean_rows": f"WITH {FLOWS} SELECT min(flow_id) AS flow_id, ts_us, duration, protocol_type, service, flag, src_bytes, dst_bytes, count, label "
                            "FROM (SELECT flow_id, ts_us, duration, protocol_type, service, flag, src_bytes, dst_bytes, count, label FROM flows UNION ALL "
                            "SELECT flow_id + 1000000000, ts_us, duration, protocol_type, service, flag, src_bytes, dst_bytes, count, label FROM flows WHERE flow_id % 3 = 0) GROUP BY ALL",
        "weight_shares": f"WITH {FLOWS} SELECT class, round((SELECT count(*) FROM flows WHERE label = class) / cast((SELECT count(*) FROM flows) AS double), 6) AS share "
                         "FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in [*CLASS_MIX, "worm"]) + "]) AS class)",
        "correlation_pairs": f"WITH {FLOWS} " + _all_pairs(NUMERIC, "flows"),
        "correlation_lineitem": _pairs(LINE_NUMBERS, "lineitem"),
        "drop_correlated": f"WITH {INDEXED} SELECT feature FROM ({gone}) WHERE NOT gone",
        "corr_score": f"WITH {INDEXED} SELECT feature, round(score, 6) AS score FROM ({_SCORES_CORR})",
        "mutual_info_binned": _mutual(),
        "topk_features": f"WITH {INDEXED} SELECT feature, round(score, 6) AS score FROM ({_SCORES_CORR}) ORDER BY score DESC, feature LIMIT 5",
        "select_features": f"WITH {INDEXED}, left_over AS (SELECT feature FROM ({gone}) WHERE NOT gone), sc AS (SELECT s.* FROM ({_SCORES_CORR}) s JOIN left_over USING (feature)) "
                           "SELECT feature, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, feature) AS rank, row_number() OVER (ORDER BY score DESC, feature) <= 6 AS selected FROM sc",
        "confusion_matrix": f"WITH {SCORED}, {PAIRS}, {_GRID5} SELECT a.class AS truth, b.class AS predicted, coalesce(n, 0) AS n FROM classes a CROSS JOIN classes b "
                            "LEFT JOIN prs ON truth = a.class AND predicted = b.class",
        "confusion_normalised": f"WITH {SCORED}, {PAIRS}, {_GRID5} SELECT a.class AS truth, b.class AS predicted, round(coalesce(n / nullif(cast(sum(n) OVER (PARTITION BY a.class) AS double), 0), 0), 6) AS share "
                                "FROM classes a CROSS JOIN classes b LEFT JOIN prs ON truth = a.class AND predicted = b.class",
        "headline_metrics": _headline(PAIRS, SCORED + ", "),
        "label_metrics": _headline(_LABEL_PAIRS, ""),
        "per_class_report": f"WITH {SCORED}, {PAIRS}, {_GRID6}, {_class_scores('cs', 'prs', 'classes')} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM cs "
                            "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) AS bigint) FROM cs "
                            "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), cast(sum(support) AS bigint) FROM cs",
        "auc_ovr": f"WITH {SCORED}, {GROUPS} SELECT class, round(auc, 6) AS auc FROM auc",
        "auc_macro": f"WITH {SCORED}, {GROUPS} SELECT round(avg(auc), 6) AS auc_roc FROM auc",
        "roc_points": f"WITH {SCORED}, {GROUPS} SELECT class, round(score, 6) AS threshold, round((tn - cn + neg) / cast(tn AS double), 6) AS fpr, round((tp - cp + pos) / cast(tp AS double), 6) AS tpr FROM sr "
                      "UNION ALL SELECT DISTINCT class, NULL, 0, 0 FROM sr",
        "roc_corners": f"WITH {SCORED}, {GROUPS}, turns AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM sr WINDOW w AS (PARTITION BY class ORDER BY score DESC)) "
                       "SELECT class, round(score, 6) AS threshold, round((tn - cn + neg) / cast(tn AS double), 6) AS fpr, round((tp - cp + pos) / cast(tp AS double), 6) AS tpr FROM turns "
                       "WHERE tp > 0 AND (np IS NULL OR pos * nn <> neg * np) UNION ALL SELECT DISTINCT class, NULL, 0, 0 FROM sr WHERE tp > 0",
        "hit_rate": f"WITH {SCORED} SELECT label AS class, count(*) AS n, count(CASE WHEN label = predicted_class THEN 1 END) AS hits, round(avg(CASE WHEN label = predicted_class THEN 1e0 ELSE 0e0 END), 6) AS rate FROM det GROUP BY label",
        "balanced_weights": f"WITH {FLOWS} SELECT label AS class, count(*) AS n, round(sum(count(*)) OVER () / cast(count(*) OVER () * count(*) AS double), 6) AS weight FROM flows GROUP BY label",
        "feature_by_class_percentiles": f"WITH {FLOWS} " + " UNION ALL ".join(
            f"SELECT label, '{c}' AS feature, cast({p} AS double) AS prob, round(quantile_cont(cast({c} AS double), {p}), 6) AS value FROM flows GROUP BY label"
            for c in ("duration", "src_bytes") for p in (0.05, 0.25, 0.5, 0.75, 0.95)),
        "histogram_by_class": f"WITH {FLOWS} SELECT label, cast(CASE WHEN duration >= 200 THEN 21 WHEN duration < 0 THEN 0 ELSE floor(duration / 2e2 * 20) + 1 END AS bigint) AS bin, count(*) AS n FROM flows WHERE duration IS NOT NULL GROUP BY ALL",
        "softmax_scores": f"WITH {SCORED} SELECT flow_id, " + ", ".join(f"round(p_{c}, 6) AS p_{c}" for c in CLASSES) + " FROM det",
        "detect_rows": f"WITH {SCORED} SELECT flow_id, predicted_class, round(confidence, 6) AS confidence, is_attack FROM det",
        "batch_summary": f"WITH {SCORED} SELECT count(*) AS flows, count(CASE WHEN is_attack THEN 1 END) AS attacks FROM det",
        "severity_grade": f"WITH {SCORED} SELECT flow_id, CASE WHEN is_attack THEN CASE severity_rank WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END END AS severity, "
                          "CASE WHEN is_attack THEN cast(severity_rank AS bigint) END AS severity_rank FROM det",
        "alert_messages": f"WITH {ALERTS} SELECT flow_id, substr(sha256(concat_ws('|', cast(flow_id AS varchar), cast(ts_us AS varchar), predicted_class)), 1, 12) AS alert_id, severity, throttle_key, "
                          "upper(predicted_class) || ' traffic detected with ' || format('{:.1f}', confidence * 100) || '% confidence [' || concat_ws(', ', 'protocol_type=' || protocol_type, 'service=' || service, "
                          "'flag=' || flag, 'src_bytes=' || src_bytes, 'dst_bytes=' || dst_bytes, 'count=' || count) || ']' AS message FROM keyed",
        "severity_counts": f"WITH {ALERTS} SELECT s.severity, (SELECT count(*) FROM keyed k WHERE k.severity = s.severity) AS n FROM (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS severity) s",
        "recent_alerts": f"WITH {ALERTS} SELECT flow_id, severity, predicted_class, round(confidence, 6) AS confidence FROM keyed ORDER BY ts_us DESC, flow_id DESC LIMIT 50",
        "minimum_severity": f"WITH {ALERTS} SELECT predicted_class, severity, count(*) AS n FROM keyed WHERE severity_rank >= 2 GROUP BY ALL",
        "alert_counters": f"WITH {ALERTS} SELECT 'flows_processed_total' AS name, '' AS label, count(*) AS value FROM det UNION ALL SELECT 'attacks_detected_total', '', count(*) FROM keyed UNION ALL "
                          "SELECT 'alerts_total', s, (SELECT count(*) FROM keyed WHERE severity = s) FROM (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS s)",
        "throttle_alerts": f"{_THROTTLE} SELECT flow_id, throttle_key, count_in_window FROM fold WHERE allowed",
        "stream_alerts": f"{_THROTTLE} SELECT flow_id, throttle_key, count_in_window FROM fold WHERE allowed",
        "throttle_decisions": f"{_THROTTLE} SELECT flow_id, throttle_key, allowed, count_in_window, suppressed_total FROM fold WHERE place > 0",
        "suppressed_totals": f"{_THROTTLE} SELECT throttle_key, count(*) AS candidates, count(CASE WHEN allowed THEN 1 END) AS allowed, count(CASE WHEN NOT allowed THEN 1 END) AS suppressed FROM fold WHERE place > 0 GROUP BY throttle_key",
        "alerts_sent": throttled(ONE_DAY * 1_000_000, 3, "severity_rank >= 1") + "SELECT s AS severity, (SELECT count(*) FROM fold WHERE allowed AND severity = s) AS n FROM (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS s)",
        "rolling_stats": f"WITH {LAST} SELECT count(*) AS processed, count(CASE WHEN is_attack THEN 1 END) AS attacks, round(avg(CASE WHEN is_attack THEN 1e0 ELSE 0e0 END), 4) AS attack_rate, "
                         f"round(avg(confidence), 4) AS mean_confidence, {_TREND} AS trending_class FROM win",
        "rolling_class_counts": f"WITH {LAST} SELECT predicted_class, count(*) AS n FROM win GROUP BY predicted_class",
        "trending_class": f"WITH {LAST} SELECT {_TREND} AS trending_class",
        "lifetime_stats": f"WITH {SCORED} SELECT count(*) AS total_processed, count(CASE WHEN is_attack THEN 1 END) AS total_attacks, round(avg(CASE WHEN is_attack THEN 1e0 ELSE 0e0 END), 4) AS lifetime_attack_rate FROM det",
        "running_totals": f"WITH {SCORED}, run AS (SELECT flow_id, count(*) OVER w AS total_processed, cast(sum(CASE WHEN is_attack THEN 1 ELSE 0 END) OVER w AS bigint) AS total_attacks FROM det WINDOW w AS (ORDER BY ts_us, flow_id)) "
                          "SELECT *, round(total_attacks / cast(total_processed AS double), 4) AS lifetime_attack_rate FROM run",
        "rolling_per_row": f"WITH {SCORED}, run AS (SELECT flow_id, count(*) OVER w AS processed, cast(sum(CASE WHEN is_attack THEN 1 ELSE 0 END) OVER w AS bigint) AS attacks, round(avg(confidence) OVER w, 4) AS mean_confidence "
                           "FROM det WINDOW w AS (ORDER BY ts_us, flow_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT *, round(attacks / cast(processed AS double), 4) AS attack_rate FROM run",
        "micro_batches": f"WITH {FLOWS} SELECT flow_id, (row_number() OVER (ORDER BY ts_us, flow_id) - 1) // 100 AS batch_no FROM flows",
    }
    # What is written and read back must equal what it was.
    found["report_read_back"] = found["class_distribution"]
    found["selection_read_back"] = found["topk_features"]
    found["alerts_json_lines"] = f"SELECT flow_id, alert_id, severity, throttle_key FROM ({found['alert_messages']})"
    return found
