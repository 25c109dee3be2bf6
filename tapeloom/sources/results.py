"""Sinks and reload of run results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Legacy column names, and defaults of columns that older results lack.
RENAMED = {"asset": "symbol", "commission": "fees"}
DEFAULTS = {"exit_reason": "signal", "entry_slippage": 0.0, "multiplier": 1.0, "status": "closed"}
#: Columns of a sweep's summary.
SUMMARY = ("num_trades", "total_return", "max_drawdown", "sharpe", "sortino", "calmar", "cagr", "win_rate", "profit_factor", "expectancy", "avg_trade", "final", "total_commission", "total_slippage")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a local temporary one if Spark runs in one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once to a scratch folder and read back: for tables that several branches of a job read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_result(tables: dict[str, DataFrame], path: str, include: list[str] | None = None, compression: str = "zstd") -> dict[str, str]:
    """Write each table as Parquet by run, metrics as JSON; name -> path."""
    out = {}
    for name in include or tables:
        out[name] = f"{path}/{name}"
        if name == "metrics":
            tables[name].write.mode("overwrite").json(out[name])
        else:
            tables[name].write.mode("overwrite").option("compression", compression).partitionBy("run_id").parquet(out[name])
    return out


def write_clustered(df: DataFrame, path: str, by: list[str], files: int | None = None, rows_in_group: int = 64_000) -> str:
    """df as files that hold ranges of ``by`` (such as asset and timestamp), sorted, in small row groups: filters on these columns read few of them.

    Rows are dealt out by ranges of sampled values of ``by``, all of it, so that a hot first column is split by the next one."""
    spread = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    wide = max(64, sum(8 if t not in ("string", "binary") else 24 for _, t in df.dtypes))
    spread.sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(max(1 << 16, rows_in_group * wide))).parquet(path)
    return path


def read_span(spark: SparkSession, path: str, assets: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a clustered table of some assets with start <= timestamp < end (each optional): plain comparisons, which reach the scan."""
    df = spark.read.parquet(path)
    if assets is not None:
        df = df.filter(F.col("asset").isin(assets))
    kind = dict(df.dtypes)["timestamp"]
    for bound, test in ((start, lambda c, b: c >= b), (end, lambda c, b: c < b)):
        if bound is not None:
            df = df.filter(test(F.col("timestamp"), F.lit(bound).cast(kind)))
    return df


def read_result(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table back, legacy names and missing columns of trades filled in."""
    df = spark.read.parquet(f"{path}/{name}")
    if name != "trades":
        return df
    for old, new in RENAMED.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(x)) if c in df.columns else F.lit(x) for c, x in DEFAULTS.items()})


def sweep_summary(metrics: DataFrame, params: DataFrame, csv: str | None = None) -> DataFrame:
    """One row per run: parameters and metrics (missing: 0), fractions also in percent; csv: a folder to write it to, too.

    An error if parameters and metrics are not of the same runs, one row each."""
    sides = params.select("run_id", F.lit(1).alias("p"), F.lit(0).alias("m")).unionByName(metrics.select("run_id", F.lit(0).alias("p"), F.lit(1).alias("m")))
    odd = sides.groupBy("run_id").agg(F.sum("p").alias("p"), F.sum("m").alias("m")).filter("p != 1 or m != 1").limit(5).collect()
    if odd:
        raise ValueError(f"runs without parameters or metrics, or with several: {[r['run_id'] for r in odd]}")
    have = metrics.select("run_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c != "num_trades" else F.coalesce(c, F.lit(0)).alias(c) for c in SUMMARY if c in metrics.columns), *(F.lit(0.0).alias(c) for c in SUMMARY if c not in metrics.columns))
    out = params.join(have, "run_id").withColumns({f"{c}_pct": F.col(c) * 100 for c in ("total_return", "max_drawdown")})
    if csv:
        out.write.mode("overwrite").option("header", True).csv(csv)
    return out


def best_runs(summary: DataFrame, metric: str, k: int) -> DataFrame:
    return summary.orderBy(F.desc(metric), "run_id").limit(k)


def metrics_report_json(summary: DataFrame, path: str) -> str:
    """One JSON record per run."""
    summary.write.mode("overwrite").json(path)
    return path
