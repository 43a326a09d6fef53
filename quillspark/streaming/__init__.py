"""Questions that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame


def answer_stream(engine, questions: DataFrame, sink, checkpoint: str):
    """Answer a streaming table (qid, question) batch by batch; ``sink`` gets (answers, batch number).

    Every batch reads the index version that is current when it starts.  A batch that is repeated
    after a failure has the same number, so a sink that keys on it is exact.
    """
    return questions.writeStream.foreachBatch(lambda batch, n: sink(engine.answers(batch), n)).option("checkpointLocation", checkpoint).start()
