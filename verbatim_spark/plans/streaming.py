"""A query over events as a stream, and the same as a batch in the oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.kept import shared_folder
from ..streaming import indicators

QUERIES, ORACLE = {}, {}


def streamed_indicators(spark, sf):
    place = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    windows = indicators.windowed(indicators.events_stream(spark, sf))
    indicators.run_once(windows, f"{place}/table", f"{place}/checkpoint")
    return spark.read.schema(windows.schema).parquet(f"{place}/table").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


QUERIES["streamed_indicators"] = streamed_indicators
ORACLE["streamed_indicators"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"
