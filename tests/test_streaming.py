from datetime import datetime

from tidemark.config import Probe
from tidemark.streaming.arrivals import arrival_cells, start

PROBE = Probe("s", "t", "load_time", event_time="event_time")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(datetime(2026, 1, 1 + i % 20), datetime(2026, 1, 3 + i % 25)) for i in range(200)]
    d = spark.createDataFrame(rows, "event_time timestamp_ntz, load_time timestamp_ntz")
    d.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    at = datetime(2026, 7, 1)
    start(stream, PROBE, at, str(tmp_path / "check")).awaitTermination()
    found = sorted(map(tuple, spark.table("arrivals").collect()))
    assert found == sorted(map(tuple, arrival_cells(d, PROBE, at).collect())) and sum(r[2] for r in found) == 200
