"""The Bloom-filtered response table, and retries that hold no task."""
import time

from pyspark.sql import functions as F

from tunedata.operators import generate as G
from tunedata.streaming import generate as SG


def requests(spark, low, high):
    df = spark.range(low, high).select(
        "id", F.concat(F.lit("Text number "), F.col("id"), F.lit(". It is short.")).alias("text"),
        F.lit("ambiguous").alias("kind"))
    return G.request_table(df.withColumn("prompt", F.col("text")), "rewrite").select(
        "request_id", "stage", "kind", "text", "prompt")


def rows_scanned(df):
    """Rows that the file scan hands on, once the query has run."""
    frame = df.select(F.count(F.lit(1)).alias("n"), F.max("response").alias("m"))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    text = [plan]
    while text:
        node = text.pop()
        name = node.nodeName()
        if name.startswith("Scan"):
            return node.metrics().get("numOutputRows").get().value()
        if name == "AdaptiveSparkPlan":
            text.append(node.executedPlan())
        elif hasattr(node, "plan") and name.endswith("QueryStage"):
            text.append(node.plan())
        children = node.children()
        text += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")


def test_small_batches_read_few_rows_of_the_table(spark, tmp_shared):
    src, sink, ck = tmp_shared("asked"), tmp_shared("answered"), tmp_shared("ck")
    schema = requests(spark, 0, 1).schema
    for k in range(6):                                     # a table of many batches
        requests(spark, 4000 * k, 4000 * (k + 1)).write.mode("append").parquet(src)
        assert SG.stream_generate(spark, src, schema, sink, ck) >= 1
    whole = spark.read.parquet(sink)
    assert whole.count() == 24_000 == whole.select("request_id").distinct().count()
    few = requests(spark, 4000, 4010)
    before = spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(SG.SOUGHT_IDS))
    try:
        near = SG.answered_among(spark, sink, few)
        assert near.count() == 10
        assert rows_scanned(near) < 24_000 / 3
        none = SG.answered_among(spark, sink, requests(spark, 10 ** 9, 10 ** 9 + 5))
        assert none.count() == 0 and rows_scanned(none) < 24_000 / 3
        many = SG.answered_among(spark, sink, requests(spark, 0, SG.SOUGHT_IDS))
        assert many.count() == SG.SOUGHT_IDS
    finally:
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", before)
    assert SG.answered_among(spark, sink, requests(spark, 0, SG.SOUGHT_IDS + 1)).count() == 24_000
    # the same requests once more, in a batch of their own: nothing is added
    requests(spark, 0, 50).write.mode("append").parquet(src)
    SG.stream_generate(spark, src, schema, sink, ck)
    assert spark.read.parquet(sink).count() == 24_000


def test_a_large_batch_is_written_by_more_tasks_than_sixteen(spark, tmp_shared):
    src, sink, ck = tmp_shared("asked"), tmp_shared("answered"), tmp_shared("ck")
    req = requests(spark, 0, 3000)
    req.write.parquet(src)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        SG.stream_generate(spark, src, req.schema, sink, ck)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(sink).select("_metadata.file_path").distinct().count()
    assert files == 40 and spark.read.parquet(sink).count() == 3000


def test_refused_requests_wait_outside_tasks(spark, tmp_shared):
    """A client that refuses the first call of every request: each is asked
    twice, and all wait together, not one after the other."""
    seen = tmp_shared("calls").removeprefix("file:")
    import os
    os.makedirs(seen)

    def client(prompt):
        import hashlib
        import os
        path = f"{seen}/{hashlib.md5(prompt.encode()).hexdigest()}"
        calls = os.path.getsize(path) if os.path.exists(path) else 0
        with open(path, "a") as f:
            f.write("x")
        if calls == 0:
            raise G.QuotaExceeded("429")
        return prompt.upper()

    req = requests(spark, 0, 40)
    start = time.time()
    out = G.generate_responses(req, client, retry_wait=3)
    rows = out.collect() + out.collect()                      # reading again asks nobody
    assert time.time() - start < 3 * 40 / 2
    assert len(rows) == 80 and {(r.status, r.attempt) for r in rows} == {("ok", 2)}
    assert [os.path.getsize(f"{seen}/{f}") for f in os.listdir(seen)] == [2] * 40
