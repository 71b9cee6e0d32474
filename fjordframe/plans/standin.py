"""Driver tables in the roles of simulation output, in Spark and as DuckDB subqueries.

A frame is an event: walker user_id % 6, t in hours since 2024-01-01, x the value, y the integer in props, weight
exp(-x / 100). Hills are the purchases, centred at their value. Structures are embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordframe.functions.binning import Axis

AX, AY, AT = Axis(0.0, 500.0, 50), Axis(0.0, 100.0, 20), Axis(0.0, 720.0, 72)
KBT, GAMMA = 2.494339, 10.0
CUTS = [144.0, 288.0, 432.0, 576.0, 720.0]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, walker, t, x, y, w, kind)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return e.select(
        F.col("event_id").alias("row"), (F.col("user_id") % 6).cast("int").alias("walker"), (micros / F.lit(3.6e9)).alias("t"), F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"), F.exp(-F.col("value") / 100.0).alias("w"), F.col("event_type").alias("kind"),
    )


FRAMES = """(SELECT event_id AS row, (user_id % 6)::INTEGER AS walker, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3.6e9::DOUBLE AS t,
value AS x, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::DOUBLE AS y, exp(-value / 100.0::DOUBLE) AS w, event_type AS kind FROM events)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) AS {name}"
