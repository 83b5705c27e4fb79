"""Query batches as a stream: files of query lines dropped into a folder.

Each arriving file is a workload; its answers are appended as Parquet rows
``(workload, query_no, line, checksums)``.  Offsets live in the stream's
checkpoint, so a restarted driver neither skips nor repeats an answered file's
batch id; a repeated batch overwrites its own output folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.plans.batch import Engine


def answer_workloads(spark: SparkSession, engine: Engine, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    lines = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("workload"), "value")

    def answer(batch: DataFrame, batch_id: int) -> None:
        rows = []
        for workload, text in batch.orderBy("workload").collect():  # query texts: a driver-side input by nature
            asked = [x for x in text.splitlines() if x not in ("", "F")]
            rows += [(workload, n, line, got) for n, (line, got) in enumerate(zip(asked, engine.run(text.splitlines()), strict=True), 1)]
        frame = spark.createDataFrame(rows, "workload string, query_no long, line string, checksums string")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
