"""Times headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tapeloom.jobs import registry, research_run

NAMES = ["B6_densify_panel", "D2_zscore", "D8_target_trace", "E8_resolve_limit_stop_orders", "F1_running_positions", "F5_mark_to_market", "G12_exit_rule_sweep", "H3_trade_stats_by", "H6_enrich_trades_with_signals", "I7_run_metrics", "J2_check_limits", "C10_resample_to_bars", "W1_research_run"]


#: The published shape: assets and daily bars of each, 1.26 M in all.
ASSETS, DAYS = 250, 5040


def wide_bars(spark, where: str):
    """Bars of ASSETS x DAYS from the order lines: each line's hash deals its price out to some assets and days; every cell has a bar."""
    lines = spark.read.parquet(f"{where}/lineitem.parquet").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("h"))
    dealt = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(F.pmod(F.xxhash64("h", "k"), F.lit(ASSETS * DAYS)).alias("cell"), "price")
    cells = spark.range(ASSETS * DAYS).withColumnRenamed("id", "cell").join(dealt.groupBy("cell").agg(F.avg("price").alias("price")), "cell", "left")
    close = F.coalesce("price", F.lit(1000.0))
    return cells.select(
        F.pmod("cell", F.lit(ASSETS)).cast("string").alias("asset"), (F.lit("1998-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.floor(F.col("cell") / ASSETS).cast("int"))).alias("timestamp"),
        (close * 0.999).alias("open"), (close * 1.01).alias("high"), (close * 0.99).alias("low"), close.alias("close"), (close - 1500).alias("score"),
    )


def published_shape(spark, where: str) -> float:
    """Seconds of the whole research run, files included, on ASSETS x DAYS stored bars."""
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    wide_bars(spark, where).write.mode("overwrite").parquet(f"{at}/bars")
    bars = spark.read.parquet(f"{at}/bars")
    began = time.time()
    out = research_run.research_run(bars.drop("score"), bars.select("asset", "timestamp", "score"), 25, 25, 0.001, 0.0005, 1e6, path=f"{at}/run")
    out["metrics"].write.format("noop").mode("overwrite").save()
    return time.time() - began


def main() -> None:
    where, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        began = time.time()
        registry.QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    took["W1_250x5040"] = round(published_shape(spark, where), 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(where)}))
    spark.stop()


if __name__ == "__main__":
    main()
