"""Shared inputs for the registered queries: table loading, the derived ``logs``
view (same SQL text in Spark and DuckDB) and output hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOGS_EXPRS = [
    "event_id AS row_id",
    "ts AS event_time",
    "user_id",
    "event_type",
    "value",
    "concat(CASE WHEN user_id % 5 = 0 THEN '8' ELSE '10' END, '.0.', CAST(user_id % 8 AS STRING), '.', "
    "CAST(user_id % 253 + 2 AS STRING)) AS source_ip",
    "CASE WHEN event_id % 25 = 0 THEN NULL ELSE concat('172.16.0.', CAST(event_id % 21 + 10 AS STRING)) END "
    "AS dest_ip",
    "(event_id * 37) % 65536 AS src_port",
    "CASE event_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 8080 WHEN 2 THEN 53 ELSE 51000 END AS dest_port",
    "CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'udp' ELSE 'icmp' END AS protocol",
    "CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 17 = 0 THEN 404 ELSE 200 END AS status_code",
    "CASE event_id % 4 WHEN 0 THEN '/login' WHEN 1 THEN '/api/admin/export?id=1' "
    "WHEN 2 THEN '/assets/app.js' ELSE 'https://h.example/a/b.html?x=1' END AS path",
    "CASE WHEN event_id % 10 = 0 THEN 'anomaly' ELSE 'normal' END AS label",
]

LOGS_SQL = "SELECT " + ",\n  ".join(LOGS_EXPRS) + "\nFROM events"
LOGS_CTE = f"logs AS (\n{LOGS_SQL}\n)"


INPUT_PARTITIONS = "spark.logweave.inputPartitions"


def prepare(spark: SparkSession) -> None:
    # naive (NTZ) driver timestamps are read as UTC wall clock
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # a caller who knows that the inputs are single small files asks for more partitions (bench.py does)
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*LOGS_EXPRS)


def round6(df: DataFrame) -> DataFrame:
    """Round every double/float column to 6 decimals (the oracle does the same)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # round(x * 1e6) / 1e6, half away from zero: the oracle engine's rounding
            x = F.col(f.name).cast("double")
            cols.append(F.when(F.isnan(x) | (F.abs(x) > 1e15), x)
                        .otherwise(F.round(x * 1e6, 0) / 1e6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def with_logs(sql: str) -> str:
    return f"WITH {LOGS_CTE}\n{sql}"
