"""Records that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.nested import shred
from millrace.plans.records import RECORD


def flatten_stream(spark: SparkSession, source: str, target: str, state: str, type_: str) -> StreamingQuery:
    """Append the elements of one type from JSON lines that appear in a folder to a parquet table; each file once, whatever fails.

    Ends when all files there are read; start it again for later ones. Bad lines give no rows.
    """
    lines = spark.readStream.text(source).select(F.try_variant_get(F.try_parse_json("value"), "$.id", "bigint").alias("product_id"), "value")

    def append(batch: DataFrame, number: int) -> None:
        parts = shred(batch, "product_id", "value", RECORD).table(type_)
        parts.write.mode("overwrite").parquet(f"{target}/batch={number}")  # written again as a whole if the batch is

    return lines.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()
