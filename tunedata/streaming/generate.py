"""Incremental generation with Structured Streaming.

Requests arriving as files are answered once: each micro-batch de-duplicates
its own request ids, anti-joins them against the response table already
written (the table is the state, so no state store grows with the data), runs
the backend and appends. Every row group of the table has a Bloom filter of its
ids, so a small batch reads the row groups that can hold its own. ``trigger(availableNow=True)`` drains what is there
and stops; the checkpoint records which input files were consumed, so a rerun
over the same input adds nothing. A replayed batch after a failure is also
harmless: the anti-join skips what a committed write already holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tunedata.operators.generate import (RESPONSE_SCHEMA, generate_responses, number_after,
                                         pending_requests)
from tunedata.session import materialize, table_exists


#: A batch of so many requests at most reads the response table through its
#: Bloom filters; a larger one meets nearly every row group anyway.
SOUGHT_IDS = 256


def _with_blooms(writer):
    """Parquet with a Bloom filter of the request ids in every row group."""
    return (writer.option("parquet.bloom.filter.enabled#request_id", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option("parquet.block.size", str(16 << 20)))


def answered_among(spark: SparkSession, sink: str, asked: DataFrame) -> DataFrame:
    """The rows of the response table at ``sink`` that can concern ``asked``.

    The ids of a small batch are sent to the scan: it skips the row groups
    whose range or Bloom filter holds none of them. A large batch reads the
    table's ids and joins."""
    done = spark.read.schema(RESPONSE_SCHEMA).parquet(sink)
    ids = [r["request_id"] for r in asked.select("request_id").limit(SOUGHT_IDS + 1).collect()]
    if len(ids) > SOUGHT_IDS:
        return done
    return done.where(F.col("request_id").isin(ids)) if ids else done.limit(0)


def stream_generate(spark: SparkSession, requests_dir: str, schema: ST.StructType,
                    sink: str, checkpoint: str, backend="rules",
                    max_files_per_trigger: int | None = None) -> int:
    """Answer every new request under ``requests_dir`` (parquet) into ``sink``.
    Returns the number of micro-batches run."""
    ran, exists = 0, table_exists(spark, sink)
    threshold = "spark.sql.parquet.pushdown.inFilterThreshold"

    def batch(df: DataFrame, epoch_id: int) -> None:
        nonlocal ran, exists
        ran += 1
        session = df.sparkSession
        session.conf.set(threshold, str(SOUGHT_IDS))       # of the stream's own session
        asked = df
        if exists:
            # by their ids alone: which requests are new, and of which the last attempt failed
            ids = materialize(df.select("request_id").distinct(), "stream-batch")
            seen = answered_among(session, sink, ids).select("request_id", "status", "attempt", F.when(
                F.col("response") == "", "").alias("response"))
            seen = materialize(seen.join(ids, "request_id", "left_semi"), "stream-seen")
            asked = pending_requests(df, seen)
        # texts are shuffled once: dealt out by ranges of ids, which also brings copies together
        columns = ["request_id", "stage", "kind", "text"] if backend == "rules" else ["request_id", "prompt"]
        asked = asked.select(*columns).repartitionByRange("request_id").dropDuplicates(["request_id"])
        new = generate_responses(asked, backend, unique=True)
        if exists:
            new = number_after(new, seen)
        if backend != "rules":                             # written as they came, so dealt out again
            new = new.repartitionByRange("request_id")
        # files with narrow ranges of ids, as many as the rows fill
        _with_blooms(new.sortWithinPartitions("request_id").write.mode("append")).parquet(sink)
        exists = True

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.parquet(requests_dir).writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return ran
