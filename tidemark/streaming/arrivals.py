"""Arrival cells of a stream: rows by event month and lag, updated as files or messages come in.

The batch engine is the measure of completeness; this keeps its (month, lag) cells current between runs. Lateness is what is
measured, so no row is dropped for it: state is one row a cell, which months and the lag cap bound, and needs no watermark.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Probe
from tidemark.operators.cells import total
from tidemark.operators.classify import staging


def arrival_cells(stream: DataFrame, probe: Probe, as_of: datetime) -> DataFrame:
    """The same (month, lag) counts as the batch pass gives, for a streaming or a batch frame."""
    rows = staging(stream, probe, as_of)
    return rows.where("event_month is not null").groupBy("event_month", "lag_day").agg(F.count(F.lit(1)).alias("row_count"), total("is_eligible").alias("n_eligible"))


def start(stream: DataFrame, probe: Probe, as_of: datetime, checkpoint: str, name: str = "arrivals"):
    """Run over what is there, in complete mode into a memory table."""
    return arrival_cells(stream, probe, as_of).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
