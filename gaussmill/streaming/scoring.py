"""Scoring a stream of test points with a trained process."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gaussmill.plans.gaussian_process import GPModel
from gaussmill.runtime import checkpointed


def score_stream(model: GPModel, tests: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Give every micro-batch of test points (i, x0, ...) with its predicted mean to the sink.

    Prediction keeps no state, and the dual weights are written once, before the
    stream starts.  A batch that is run again gives the same rows, so a sink
    that writes by batch number delivers each once.
    """
    weights = checkpointed(model.weights())

    def batch(df: DataFrame, number: int) -> None:
        sink(model.predict(df, weights), number)

    writer = tests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
