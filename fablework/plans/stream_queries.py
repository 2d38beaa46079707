"""Status reports of the shop's clicks through the tracker, as a stream and as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..streaming import tracker as T

TASKS = ["metric_questeval", "metric_bookscore"]
ARGS = {"keys": ["chunk_id"], "tasks": TASKS, "report": "click_id", "at": "ts", "arrived": "arrived_at"}
#: Starts of the query on its checkpoint: each takes the reports of one more stretch of time.
STARTS = 3

TASK = f"CASE WHEN value < 50 THEN '{TASKS[0]}' WHEN value < 200 THEN '{TASKS[1]}' WHEN value IS NOT NULL THEN 'other' END"
STATUS = "CASE kind WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE kind END"


def _reports(clicks: DataFrame) -> DataFrame:
    return clicks.selectExpr("client_id AS chunk_id", f"{TASK} AS task", f"{STATUS} AS status", "click_id", "ts", "arrived_at")


def _known(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/clients.parquet").selectExpr("client_id AS chunk_id").where("chunk_id IS NOT NULL")


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("elapsed", F.round("elapsed", 6))


def _batch(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(T.tracked(_reports(spark.read.parquet(f"{d}/clicks.parquet")), _known(spark, d), **ARGS))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Feeds the clicks in the order of their arrival to a query that is stopped and started again on its checkpoint."""
    clicks, at = spark.read.parquet(f"{d}/clicks.parquet"), shared_folder(spark)
    low, high = clicks.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    place = F.coalesce((F.unix_seconds(F.col("arrived_at").cast("timestamp")) - F.lit(low.timestamp() if low else 0)) * STARTS / F.lit(max(1.0, (high - low).total_seconds() if low else 1.0)), F.lit(0))
    sliced = clicks.withColumn("slice", F.least(F.lit(STARTS - 1), F.floor(place)))
    for i in range(STARTS):
        sliced.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(f"{at}/in")
        arrived = spark.readStream.schema(clicks.schema).parquet(f"{at}/in")
        out = T.track(_reports(arrived), _known(spark, d), **ARGS, keep="3650 days")
        with T.rocks(spark):
            query = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return _rounded(spark.read.schema(out.schema).parquet(f"{at}/out"))


ORACLE = f"""
WITH r AS (
  SELECT client_id AS chunk_id, {TASK} AS task, CASE WHEN click_id IS NOT NULL AND arrived_at IS NOT NULL THEN {STATUS} END AS status, click_id, ts, arrived_at FROM clicks),
j AS (
  SELECT *, CASE WHEN chunk_id IS NULL OR task IS NULL OR status IS NULL OR task = 'other' OR status NOT IN ('started', 'completed', 'failed') THEN 400
    WHEN chunk_id NOT IN (SELECT client_id FROM clients WHERE client_id IS NOT NULL) THEN 404 ELSE 200 END AS code
  FROM r),
g AS (SELECT * FROM j WHERE code = 200 QUALIFY row_number() OVER (PARTITION BY chunk_id, task, click_id ORDER BY arrived_at) = 1),
w AS (SELECT *, lag(status) OVER x AS was, (epoch_us(ts) - lag(epoch_us(ts)) OVER x) / 1e6 AS took FROM g WINDOW x AS (PARTITION BY chunk_id, task ORDER BY arrived_at, click_id))
SELECT chunk_id, task, click_id AS report, status, was, CASE WHEN was = 'started' AND status IN ('completed', 'failed') THEN round(took, 6) END AS elapsed, code FROM w
UNION ALL SELECT chunk_id, task, click_id, status, NULL, NULL, code FROM j WHERE code <> 200
"""

QUERIES = {"tracker_batch": _batch, "tracker_stream": _stream}
ORACLES = {"tracker_batch": ORACLE, "tracker_stream": ORACLE}
