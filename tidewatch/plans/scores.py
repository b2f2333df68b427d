"""A fixed linear scorer for flow tables: the decision-score path without a trained model.

Scores are SQL text over zero-filled features, then softmax and arg-max like any model without
probabilities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.flow_features import engineer
from tidewatch.functions.scoring import softmax
from tidewatch.operators.detect import THRESHOLD, shape_detections

CLASSES = ["dos", "normal", "probe", "r2l", "u2r"]

# One weight line per class.
SCORES = {
    "dos": "serror_rate * 9e0 + dst_host_serror_rate * 3e0 + wrong_fragment * 3e-1 - 6e0",
    "normal": "same_srv_rate * 6e0 - serror_rate * 2e0 - 15e-1",
    "probe": "rerror_rate * 9e0 + diff_srv_rate * 3e0 - 6e0",
    "r2l": "num_failed_logins * 9e-1 + is_guest_login * 12e-1 + num_access_files * 3e-1 - 2e-1",
    "u2r": "privilege_activity * 4e-1 + num_file_creations * 2e-1 - 1e0",
}

KEEP = ["flow_id", "ts_us", "label"]
SUMMARY = ["duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "count"]


def score_flows(flows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Detections of a flow table, with ``flow_id, ts_us, label`` and ``p_<class>`` columns in front."""
    ready = engineer(flows, untouched=KEEP)
    scores = F.array(*[F.expr(f"cast({SCORES[c]} AS double)") for c in CLASSES])
    scored = ready.select(*KEEP, *SUMMARY, scores.alias("_z"))
    shaped = shape_detections(scored, CLASSES, softmax(F.col("_z")), threshold=threshold, keep=KEEP, raw_columns=SUMMARY)
    return shaped.withColumns({f"p_{c}": F.col("class_probabilities")[c] for c in CLASSES})
