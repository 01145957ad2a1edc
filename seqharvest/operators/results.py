"""Tables of measured runs: sink, resume, audits, paired comparison."""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce
from math import erfc, sqrt

from pyspark.sql import DataFrame, SparkSession, functions as F

from .mine import Mined, Options

DONE = ("OK", "OOM", "OT")


def metrics(found: Mined, **labels) -> DataFrame:
    """One row on a search: labels, then theta, total, lists, extended, patterns, longest, cut_at."""
    hit = F.col("u") >= F.lit(found.theta) * F.col("len")
    goes_on = F.col("bound") >= F.lit(found.theta) * (F.col("len") + 1)
    number = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    return found.nodes().agg(
        *[F.lit(v).alias(k) for k, v in labels.items()],
        F.lit(found.theta).cast("double").alias("theta"),
        F.lit(found.total).cast("long").alias("total"),
        F.count("*").alias("lists"),
        number(goes_on).alias("extended"),
        number(hit).alias("patterns"),
        F.max(F.when(hit, F.col("len"))).alias("longest"),
        F.lit(found.cut_at).cast("int").alias("cut_at"),
    )


def config(options: Options, **labels) -> str:
    """A run's switches and labels as JSON, in order of name."""
    return json.dumps(asdict(options) | labels, sort_keys=True)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Append rows to a metrics table; a table of other columns or types is refused."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        stored = [(f.name, f.dataType) for f in spark.read.parquet(path).schema]
        if stored != [(f.name, f.dataType) for f in rows.schema]:
            raise ValueError(f"the metrics table at {path} has other columns")
    rows.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics file in CSV with a header; lines that start with # are remarks."""
    return spark.read.option("header", True).option("comment", "#").option("inferSchema", True).csv(path)


def pending(plan: DataFrame, results: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """The planned runs without a finished row; null keys match null keys."""
    done = results.where(F.col(status).isin(*DONE)).select(*keys).distinct()
    same = None
    for k in keys:
        test = plan[k].eqNullSafe(done[k])
        same = test if same is None else same & test
    return plan.join(done, same, "left_anti")


def audit(results: DataFrame, keys: list[str], trial: str, value: str, trials: int = 3) -> DataFrame:
    """Per configuration: rows, trials, repeated (trials with more than one row), short (fewer trials than wanted), mean, cv."""
    per = results.groupBy(*keys, trial).agg(F.count("*").alias("n"))
    counted = per.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("rows"),
        F.count("*").alias("trials"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("long").alias("repeated"),
        (F.count("*") < trials).alias("short"),
    )
    spread = results.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    return counted.join(spread, same).select(*keys, "rows", "trials", "repeated", "short", "mean", F.try_divide("sd", "mean").alias("cv"))


def holes(results: DataFrame, keys: list[str], arm: str) -> DataFrame:
    """(keys, arm) combinations without a row, of the configurations and arms that are seen; both are short lists, the arms broadcast as an array."""
    arms = [r[0] for r in results.select(arm).distinct().collect()]
    full = results.select(*keys).distinct().withColumn(arm, F.explode(F.array(*[F.lit(a) for a in arms])))
    return full.join(results.select(*keys, arm).distinct(), [*keys, arm], "left_anti")


def paired(results: DataFrame, keys: list[str], arm: str, trial: str, value: str, base: str, other: str) -> DataFrame:
    """(keys, base, other, ratio): means over trials of both arms, for configurations that have both."""
    means = results.groupBy(*keys, arm, trial).agg(F.sum(value).alias("v")).groupBy(*keys, arm).agg(F.avg("v").alias("v"))
    both = means.groupBy(*keys).agg(F.max(F.when(F.col(arm) == base, F.col("v"))).alias("base"), F.max(F.when(F.col(arm) == other, F.col("v"))).alias("other"))
    return both.where("base is not null and other is not null").withColumn("ratio", F.try_divide("other", "base"))


def medians(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, runs, median, sd): the exact median and the sample deviation over runs."""
    return results.groupBy(*keys).agg(F.count(value).alias("runs"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd"))


def signed_rank(differences: list[float]) -> float:
    """Two-sided p of the signed-rank test: exact without ties below 25 differences, else the normal form with tie correction.  Zeros go."""
    d = sorted((x for x in differences if x), key=abs)
    n = len(d)
    if not n:
        return 1.0
    ranks, groups, i = [], [], 0
    while i < n:
        j = i
        while j < n and abs(d[j]) == abs(d[i]):
            j += 1
        ranks += [(i + 1 + j) / 2] * (j - i)
        groups.append(j - i)
        i = j
    plus = sum(r for r, x in zip(ranks, d) if x > 0)
    low = min(plus, n * (n + 1) / 2 - plus)
    if n < 25 and max(groups) == 1:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for t in range(len(ways) - 1, r - 1, -1):
                ways[t] += ways[t - r]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - sum(g**3 - g for g in groups) / 48
    return erfc(abs(plus - mean) / sqrt(var) / sqrt(2)) if var else 1.0


def step_down(ps: list[float]) -> list[float]:
    """Holm's adjusted p values, in the order given."""
    out, most = [0.0] * len(ps), 0.0
    for left, i in zip(range(len(ps), 0, -1), sorted(range(len(ps)), key=ps.__getitem__)):
        most = max(most, min(1.0, left * ps[i]))
        out[i] = most
    return out
