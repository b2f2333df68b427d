"""Score, probability and severity expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.functions.columns import ESCALATED_CLASSES, HARMLESS, SEVERITIES, SEVERITY_THRESHOLDS, SUMMARY_FIELDS


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def softmax(scores: Column) -> Column:
    """Probabilities of an array of decision scores; a single score ``s`` counts as ``(-s, s)``."""

    def shares(pair):
        raised = bind(F.array_max(pair), lambda top: F.transform(pair, lambda s: F.exp(s - top)))
        return bind(raised, lambda e: bind(
            F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total)))

    return bind(scores, lambda s: bind(F.when(F.size(s) == 1, F.array(-s[0], s[0])).otherwise(s), shares))


def computed_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` plus the computed columns, behind a one-element explode.

    Filters move below projections by copying the expressions they mention. A model's score mentioned
    by grading, alerting and throttling would be copied into each; a generator's output is not.
    """
    packed = F.explode(F.array(F.struct(*[v.alias(n) for n, v in columns.items()]))).alias("_once")
    return df.select(*keep, packed).select(*keep, *[F.col(f"_once.{n}").alias(n) for n in columns])


def best_class(probabilities: Column, classes: list[str]) -> Column:
    """Name of the largest entry, the first one on ties."""
    at = F.array_position(probabilities, F.array_max(probabilities)) - 1
    return F.get(F.array(*[F.lit(c) for c in classes]), at.cast("int"))


def probability_map(probabilities: Column, classes: list[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), probabilities)


def rounded_map(values: Column, places: int = 6) -> Column:
    return F.transform_values(values, lambda _, v: F.round(v, places))


def is_attack(predicted: Column, confidence: Column, threshold: float = 0.7) -> Column:
    return ~F.lower(predicted).isin(HARMLESS) & (confidence >= F.lit(threshold))


def flow_summary(columns: list[str]) -> Column:
    """Map of the summary fields the table has; values as text, null values left out on rendering."""
    entries = [part for c in SUMMARY_FIELDS if c in columns for part in (F.lit(c), F.col(c).cast("string"))]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")


def check_thresholds(thresholds: dict[str, float]) -> dict[str, float]:
    """The four thresholds as numbers; each step up needs at least the confidence of the one below."""
    steps = {name: float(thresholds.get(name, "nan")) for name in SEVERITY_THRESHOLDS}
    below = float("-inf")
    for name, step in steps.items():
        if not step >= below:
            raise FlowDataError(f"threshold {name!r} is absent or lower than the one below it: {thresholds}")
        below = step
    return steps


def severity_rank(confidence: Column, predicted: Column, thresholds: dict[str, float] | None = None) -> Column:
    """0 (LOW) .. 3 (CRITICAL); privilege and remote-access attacks count one level up."""
    t = check_thresholds(thresholds or SEVERITY_THRESHOLDS)
    base = F.when(confidence >= t["critical"], 3).when(confidence >= t["high"], 2).when(confidence >= t["medium"], 1).otherwise(0)
    lift = F.lower(predicted).isin(ESCALATED_CLASSES).cast("int")
    return F.least(base + F.coalesce(lift, F.lit(0)), F.lit(3))


def severity_name(rank: Column) -> Column:
    # get(), because element_at() answers a null index on a constant array with the last element.
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


def alert_message(predicted: Column, confidence: Column, summary: Column | None) -> Column:
    head = F.format_string("%s traffic detected with %.1f%% confidence", F.upper(predicted), confidence * 100)
    if summary is None:
        return head
    parts = F.transform(
        F.filter(F.map_entries(summary), lambda e: e["value"].isNotNull()),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    return F.when(F.size(parts) > 0, F.concat(head, F.lit(" ["), F.concat_ws(", ", parts), F.lit("]"))).otherwise(head)
