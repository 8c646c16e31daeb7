"""Apply fitted, row-wise steps to a stream and write the result."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mlframes.plans.storage import shared_path


def score_stream(stream: DataFrame, steps, path: str, format: str = "parquet", checkpoint: str | None = None,
                 trigger: dict | None = None) -> StreamingQuery:
    """Run ``steps`` (functions from DataFrame to DataFrame, such as a fitted ``Prep.transform`` or a model's
    ``score``) over a stream, append to ``path`` and keep progress in the shared folder."""
    out = reduce(lambda df, step: step(df), steps, stream)
    checkpoint = checkpoint or shared_path(stream.sparkSession, "stream")
    return (out.writeStream.format(format).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"availableNow": True})).start(path))
