"""Rows that arrive as Parquet files, answered batch by batch with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotate import annotate
from ..operators.judge import Judge
from ..plans.spec import Step
from ..sources.catalog import AnswerCache


def answer_incoming(spark: SparkSession, folder: str, schema: str, step: Step, judge: Judge, out: str, checkpoint: str, model: str = "rules-1", files_per_batch: int = 16, cache: AnswerCache | None = None) -> StreamingQuery:
    """Annotate the files that appear in `folder`; each batch's answers overwrite out/batch=<id>, so that a repeated batch changes nothing.

    Runs until all files that are there are answered; rows bring their _row_id. With a cache, a payload
    is asked about once in all batches. Fixed thresholds decide, as a cut by the scores needs
    all of them: questions of mode `auto` are to be calibrated over what was written.
    """

    def commit(rows: DataFrame, batch: int) -> None:
        made = annotate(rows, step, judge, model, cache=cache and cache.read())
        made.answers.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if cache is not None:
            cache.append(made.entries)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
