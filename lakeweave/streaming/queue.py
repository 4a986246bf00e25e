"""A durable queue of JSON files as a stream: each item handled once, failures tried again, hopeless ones set aside."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ITEM = "id string, payload string, retries int"


def enqueue(folder: str, payload: dict, retries: int = 0) -> str:
    """Writes an item beside the queue and moves it in, so that a reader never sees half of one. For folders on this machine's file system."""
    os.makedirs(folder, exist_ok=True)
    name = uuid.uuid4().hex
    hidden = os.path.join(folder, f".{name}.tmp")
    with open(hidden, "w", encoding="utf-8") as file:
        json.dump({"id": name, "payload": json.dumps(payload), "retries": retries}, file)
    os.rename(hidden, os.path.join(folder, f"{name}.json"))
    return name


def run(spark: SparkSession, folder: str, checkpoint: str, dead: str, done: str, handle: Callable[[DataFrame], DataFrame], most: int = 5, per_trigger: int = 1000) -> StreamingQuery:
    """Starts the queue over what is there and ends when that is done (availableNow); call again for what came since.

    ``handle`` takes a batch (id, payload, retries) and returns it with a column ok. Failed items go back with one more
    retry, after ``most`` of them to the dead letters. Results are written by batch number, so a batch that is replayed
    after a crash replaces what it had written. Spark's checkpoint remembers which files were handled.
    """

    def each(batch: DataFrame, number: int) -> None:
        got = handle(batch).select("id", "payload", "retries", F.coalesce("ok", F.lit(False)).alias("ok")).persist()
        got.filter("ok").write.mode("overwrite").json(f"{done}/batch={number}")
        bad = got.filter("not ok")
        bad.filter(F.col("retries") >= most).write.mode("overwrite").json(f"{dead}/batch={number}")
        again = bad.filter(F.col("retries") < most).select("id", "payload", (F.col("retries") + 1).alias("retries"))
        again.write.mode("overwrite").json(f"{folder}/retry-{number}")
        got.unpersist()

    stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
