"""Evaluation score tables (EVL group). Scores of judged metrics are input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Metrics of the two suites, in order, with pass thresholds.
SUITE_METRICS = {
    "deepeval": {
        "faithfulness": 0.7,
        "answer_relevancy": 0.7,
        "contextual_precision": 0.6,
        "contextual_recall": 0.6,
        "hallucination": 0.4,
    },
    "ragas": {
        "faithfulness": 0.7,
        "answer_relevancy": 0.7,
        "context_precision": 0.6,
        "context_recall": 0.6,
    },
}
# Fixed value: metrics where a low score is good.
LOWER_IS_BETTER = ("hallucination",)
# How the second suite calls metrics of the first.
SAME_METRIC = {"context_precision": "contextual_precision", "context_recall": "contextual_recall"}
NO_RESULTS_NOTE = "There is no completed evaluation run."


def metrics_config(spark: SparkSession) -> DataFrame:
    """EVL10: (tool, metric, threshold, lower_is_better)."""
    rows = [
        (tool, metric, threshold, metric in LOWER_IS_BETTER)
        for tool, metrics in SUITE_METRICS.items()
        for metric, threshold in metrics.items()
    ]
    return spark.createDataFrame(rows, "tool string, metric string, threshold double, lower_is_better boolean")


def threshold(tool: Column, metric: Column) -> Column:
    """Pass threshold as an expression: nine constants need no join."""
    pairs = [
        x for t, metrics in SUITE_METRICS.items() for m, v in metrics.items() for x in (F.lit(f"{t}/{m}"), F.lit(v))
    ]
    return F.try_element_at(F.create_map(*pairs), F.concat(tool, F.lit("/"), metric))


def _meets(metric: Column, score: Column, limit: Column) -> Column:
    return F.when(metric.isin(*LOWER_IS_BETTER), score <= limit).otherwise(score >= limit)


def _maybe_round(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.bround(c, digits)


def select_samples(golden: DataFrame, category: str | None = None, n: int = 50) -> DataFrame:
    """EVL1: the first ``n`` golden samples, of one category if given, in file order."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if category:
        golden = golden.filter(F.col("category") == category)
    return golden.orderBy("pos").limit(n)


def resolve_answers(samples: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """EVL2: the live answer where there is one, else the ground truth; live contexts where not empty.

    ``live`` has (pos, answer, contexts). Adds ``answer`` and replaces ``contexts``.
    """
    if live is None:
        return samples.withColumn("answer", F.col("ground_truth"))
    found = live.select("pos", F.col("answer").alias("_answer"), F.col("contexts").alias("_contexts"))
    return (
        samples.join(found, "pos", "left")
        .withColumn("answer", F.coalesce("_answer", "ground_truth"))
        .withColumn("contexts", F.when(F.size("_contexts") > 0, F.col("_contexts")).otherwise(F.col("contexts")))
        .drop("_answer", "_contexts")
    )


def default_contexts(samples: DataFrame) -> DataFrame:
    """EVL3: empty or missing contexts become the ground truth (second suite)."""
    filled = F.when(F.size("contexts") > 0, F.col("contexts")).otherwise(F.array("ground_truth"))
    return samples.withColumn("contexts", filled)


def pass_flag(scores: DataFrame) -> DataFrame:
    """EVL4: adds ``threshold`` and ``passed``; a failed metric (null score) counts as 0.0, not passed."""
    limit = threshold(F.col("tool"), F.col("metric"))
    return scores.withColumns(
        {
            "threshold": limit,
            "passed": F.coalesce(_meets(F.col("metric"), F.col("score"), limit), F.lit(False)),
            "score": F.coalesce("score", F.lit(0.0)),
        }
    )


def aggregate_scores(scores: DataFrame, digits: int | None = 4) -> DataFrame:
    """EVL5: mean, min, max, pass rate and count per tool and metric. Input from `pass_flag`."""
    return scores.groupBy("tool", "metric").agg(
        _maybe_round(F.avg("score"), digits).alias("mean_score"),
        _maybe_round(F.min("score"), digits).alias("min_score"),
        _maybe_round(F.max("score"), digits).alias("max_score"),
        _maybe_round(F.avg(F.col("passed").cast("double")), digits).alias("pass_rate"),
        F.count(F.lit(1)).alias("sample_count"),
        F.first("threshold").alias("threshold"),
    )


def overall(aggregated: DataFrame, digits: int | None = 4) -> DataFrame:
    """EVL6: mean of metric means (a lower-is-better metric as 1 - mean) and of pass rates, per tool."""
    mean = F.when(F.col("metric").isin(*LOWER_IS_BETTER), 1.0 - F.col("mean_score")).otherwise(F.col("mean_score"))
    return aggregated.groupBy("tool").agg(
        _maybe_round(F.avg("pass_rate"), digits).alias("overall_pass_rate"),
        _maybe_round(F.avg(mean), digits).alias("overall_mean_score"),
    )


def suite_pass(scores: DataFrame, tool: str = "ragas", digits: int | None = 4) -> DataFrame:
    """EVL7: pass judged on the mean of each metric; overall pass is the share of metrics passing.

    One row per metric, the overall figures repeated on each.
    """
    from pyspark.sql.window import Window

    limit = threshold(F.col("tool"), F.col("metric"))
    means = (
        scores.filter(F.col("tool") == tool)
        .groupBy("tool", "metric")
        .agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("_mean"))
        .withColumn("threshold", limit)
        .withColumn("passed", _meets(F.col("metric"), F.col("_mean"), F.col("threshold")))
    )
    w = Window.partitionBy("tool")  # one row per metric
    return means.select(
        "tool",
        "metric",
        _maybe_round(F.col("_mean"), digits).alias("mean_score"),
        "threshold",
        "passed",
        F.col("passed").cast("double").alias("pass_rate"),
        _maybe_round(F.avg("_mean").over(w), digits).alias("overall_mean_score"),
        _maybe_round(F.avg(F.col("passed").cast("double")).over(w), digits).alias("overall_pass_rate"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """EVL8: the completed run with the latest ``ran_at`` (ties by job id), or a "no_results" row."""
    best = runs.filter(F.col("status") == "completed").agg(
        F.max_by(F.struct("job_id", "tool", "ran_at"), F.struct("ran_at", "job_id")).alias("r")
    )
    none = F.col("r").isNull()
    return best.select(
        F.col("r.job_id").alias("job_id"),
        F.col("r.tool").alias("tool"),
        F.col("r.ran_at").alias("ran_at"),
        F.when(none, "no_results").otherwise("completed").alias("status"),
        F.when(none, NO_RESULTS_NOTE).alias("note"),
    )


def compare_suites(scores: DataFrame) -> DataFrame:
    """EVL9: metric x suite means with threshold and pass marks; equal metrics share a row."""
    tools = list(SUITE_METRICS)
    names = F.create_map(*[F.lit(x) for pair in SAME_METRIC.items() for x in pair])
    common = F.coalesce(F.try_element_at(names, F.col("metric")), F.col("metric"))
    table = (
        scores.withColumn("metric", common)
        .groupBy("metric")
        .pivot("tool", tools)
        .agg(F.avg(F.coalesce("score", F.lit(0.0))))
        .withColumn("threshold", threshold(F.lit(tools[0]), F.col("metric")))
    )
    return table.withColumns({f"{t}_passed": _meets(F.col("metric"), F.col(t), F.col("threshold")) for t in tools})
