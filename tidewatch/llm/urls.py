"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs, here those that a rule decides, and see only the URL's own text: lengths,
depth, digit share, entropy, parameters, and how often labelled hosts of its suffix were blocked.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written

#: (verdict, host, path prefix), as stated for this table.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: At most so many labelled URLs train the trees: those with the smallest hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 42
#: Weight of the overall block rate in a suffix's rate, in URLs.
PRIOR = 10.0
FEATURES = [
    "n_chars", "host_chars", "path_chars", "host_labels", "depth", "digit_share", "host_digit_share", "entropy", "n_params",
    "has_fragment", "is_https", "n_hyphens", "longest_part", "extension", "suffix_rate_1", "suffix_rate_2",
]


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return _ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct ``rule``, ``verdict`` of the longest rule that fits, null if none does. A rule fits its host and all subdomains."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, prefix in reversed(ranked):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(at + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that a URL has by itself, from ``url``, ``host``, ``path``, and its suffixes of one and two labels."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    letters = F.filter(F.split(url, ""), lambda c: c != "")
    # Entropy by counting each distinct character once.
    bits = F.aggregate(
        F.array_distinct(letters), F.lit(0.0),
        lambda acc, c: acc - F.try_divide(n - F.length(F.replace(url, c, F.lit(""))), n) * F.log2(F.try_divide(n - F.length(F.replace(url, c, F.lit(""))), n)),
    )
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    share = lambda text: F.coalesce(F.try_divide(F.length(F.regexp_replace(text, "[^0-9]", "")), F.length(text)), F.lit(0.0))
    return urls.select(
        "*",
        n.cast("double").alias("n_chars"),
        F.length("host").cast("double").alias("host_chars"),
        F.length("path").cast("double").alias("path_chars"),
        F.size(labels).cast("double").alias("host_labels"),
        F.size(parts).cast("double").alias("depth"),
        share(url).alias("digit_share"),
        share(F.col("host")).alias("host_digit_share"),
        F.coalesce(bits, F.lit(0.0)).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")).alias("n_params"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith(_ascii_lower(url), F.lit("https:")).cast("double").alias("is_https"),
        (n - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("n_hyphens"),
        F.coalesce(F.array_max(F.transform(parts, lambda p: F.length(p))), F.lit(0)).cast("double").alias("longest_part"),
        F.rlike("path", F.lit(r"\.[A-Za-z0-9]+$")).cast("double").alias("extension"),
        F.element_at(labels, -1).alias("suffix_1"),
        F.concat_ws(".", F.slice(F.concat(F.array(F.lit(""), F.lit("")), labels), -2, 2)).alias("suffix_2"),
    )


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """One row ``id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` (chance of block) per row of ``pages``.

    Null and odd URLs have empty host and path, fit no rule and are judged by the trees like any other.
    Repeated rows are judged each. Where the labelled URLs are all of one verdict that verdict stands for
    the rest, and without any labelled URL the rest is allowed. An empty table gives an empty one.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.withColumn("host", host).withColumn("path", path)
    urls = lexical(urls.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)))
    urls = written(urls.withColumn("label", (F.col("own.verdict") == "block").cast("double")))
    few = urls.where("label is not null").orderBy(F.xxhash64(F.lit(SEED), "url"), "id").limit(train_rows)
    few = written(few.select("label", "suffix_1", "suffix_2", *FEATURES[:-2]))
    n, blocked = few.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    own = F.col("own.verdict")
    if blocked in (0, n):
        found = urls.withColumn("score", F.lit(1.0 if n and blocked == n else 0.0))
    else:
        rate = blocked / n
        suffixes = {}
        for k in ("suffix_1", "suffix_2"):
            # At most one row per training URL.
            stats = few.groupBy(k).agg(F.count(F.lit(1)).alias("m"), F.sum("label").alias("b"))
            suffixes[k] = stats.select(k, ((F.col("b") + PRIOR * rate) / (F.col("m") + PRIOR)).alias(f"suffix_rate_{k[-1]}"))

        def filled(rows: DataFrame) -> DataFrame:
            for k, stats in suffixes.items():
                rows = rows.join(F.broadcast(stats), k, "left")
            return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.fillna(rate, ["suffix_rate_1", "suffix_rate_2"]))

        model = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, cacheNodeIds=False).fit(filled(few).select("features", "label"))
        found = model.transform(filled(urls)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(own, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return found.select("id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "score")
