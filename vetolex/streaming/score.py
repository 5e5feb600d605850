"""``stream_score`` (§2.13): score arriving posts with frozen weights.

File source with an explicit schema → :func:`vetolex.operators.model.predict_sentiment`, which scores rows
where they are → parquet file sink.  The query is stateless and has no grouping or shuffle.  The source's
offsets and the commits are in the checkpoint and the sink's commit log names the files of every finished
batch, so a batch that was interrupted and runs again is in the sink once; readers see committed files only.

Weights too large to be sent to the tasks are joined instead, which a stream cannot do row by row: then each
micro-batch is scored by the batch plan and its folder overwritten on a replay.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.model import LinearTextModel, predict_sentiment

CONVERSATION_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])

KEY = ("conv_id", "turn")
#: Files of a micro-batch, so that a backlog is worked off in bounded steps.
MAX_FILES = 256


def score_batch(batch: DataFrame, model: LinearTextModel) -> DataFrame:
    """One micro-batch (or a whole table): key ``(conv_id, turn)``, the 8-field record."""
    rows = batch.select(F.struct(*KEY).alias("id"), "text")
    out = predict_sentiment(rows, model)
    return out.select("id.conv_id", "id.turn", *[c for c in out.columns if c != "id"])


def start_stream_score(spark: SparkSession, source_path: str, sink_path: str, checkpoint: str,
                       model: LinearTextModel, available_now: bool = True, max_files_per_trigger: int = MAX_FILES):
    reader = spark.readStream.schema(CONVERSATION_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    if os.path.isfile(source_path):
        # the file source lists directories: a single file is addressed as a glob in its folder
        d, name = os.path.split(source_path)
        source_path = os.path.join(d, name[:-1] + "[" + name[-1] + "]")
    stream = reader.parquet(source_path)
    if model.sent() is not None:
        writer = score_batch(stream, model).writeStream.format("parquet").outputMode("append").option("path", sink_path)
    else:
        def write(batch: DataFrame, epoch_id: int) -> None:
            score_batch(batch, model).write.mode("overwrite").parquet(os.path.join(sink_path, f"epoch={epoch_id}"))

        writer = stream.writeStream.foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def run_stream_score(spark: SparkSession, source_path: str, sink_path: str, checkpoint: str,
                     model: LinearTextModel, max_files_per_trigger: int = MAX_FILES) -> DataFrame:
    """Score what the source holds now and return the whole sink."""
    q = start_stream_score(spark, source_path, sink_path, checkpoint, model, True, max_files_per_trigger)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(sink_path)
