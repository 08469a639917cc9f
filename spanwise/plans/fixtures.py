"""Note, frame and grid tables, derived by Spark from the driver's tables; one real day counts as one second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per event; users are the samples."""
    e = table(spark, sf_dir, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH) / F.lit(86400000000.0)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("sample_id"),
        F.col("event_id").alias("note_seq"),
        start.alias("start_sec"),
        (start + 0.04 + (k % 10) * 0.04).alias("end_sec"),
        (36 + k % 49).cast("int").alias("pitch"),
        (1 + F.col("event_id") % 127).cast("int").alias("velocity"),
        ((F.col("event_id") * 37 % 101) / F.lit(100.0)).alias("confidence"),
        (F.col("event_type") != "error").alias("voiced"),
        F.when(F.col("event_type").isin("view", "click"), "vocal").otherwise("instrumental").alias("state"),
        "event_type",
    )


NOTES = f"""notes AS (
  SELECT user_id AS sample_id, event_id AS note_seq, (epoch_us(ts) - {EPOCH}) / 86400000000.0::DOUBLE AS start_sec,
         (epoch_us(ts) - {EPOCH}) / 86400000000.0::DOUBLE + 0.04::DOUBLE + (CAST(props->>'k' AS INT) % 10) * 0.04::DOUBLE AS end_sec,
         CAST(36 + CAST(props->>'k' AS INT) % 49 AS INT) AS pitch, CAST(1 + event_id % 127 AS INT) AS velocity,
         (event_id * 37 % 101) / 100.0::DOUBLE AS confidence, event_type <> 'error' AS voiced,
         CASE WHEN event_type IN ('view', 'click') THEN 'vocal' ELSE 'instrumental' END AS state, event_type
  FROM events
)"""


def expected(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("note_seq") % 3 != 0)


def predicted(notes: DataFrame) -> DataFrame:
    shift = (F.col("note_seq") % 7 - 3) * F.lit(0.02)
    return notes.where(F.col("note_seq") % 4 != 0).withColumns({"start_sec": F.col("start_sec") + shift, "end_sec": F.col("end_sec") + shift})


EXPECTED = "expected AS (SELECT * FROM notes WHERE note_seq % 3 <> 0)"
PREDICTED = """predicted AS (
  SELECT * REPLACE (start_sec + (note_seq % 7 - 3) * 0.02::DOUBLE AS start_sec, end_sec + (note_seq % 7 - 3) * 0.02::DOUBLE AS end_sec)
  FROM notes WHERE note_seq % 4 <> 0
)"""


def grid(notes: DataFrame, step: float = 0.5, points: int = 121) -> DataFrame:
    """Beats of every sample, `step` seconds apart; every fourth is a downbeat."""
    ids = notes.select("sample_id").distinct()
    return ids.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("idx")).select("sample_id", "idx", (F.col("idx") * F.lit(step)).alias("time_sec"), (F.col("idx") % 4 == 0).alias("is_downbeat"))


GRID = """grid AS (
  SELECT sample_id, CAST(idx AS INT) AS idx, idx * 0.5::DOUBLE AS time_sec, idx % 4 = 0 AS is_downbeat
  FROM (SELECT DISTINCT sample_id FROM notes), range(121) t(idx)
)"""
