"""Decision requests as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from decidra.sources import files
from decidra.sources.files import work_dir


#: Parts that a failing micro-batch is cut into, and how often.
PARTS, CUTS = 8, 3


def decide(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, dead: str, once: bool = True) -> StreamingQuery:
    """Answer every micro-batch and append it to out. Of a batch that fails the parts that don't fail are answered: it is cut by a
    hash into PARTS parts, a failing part again, CUTS times or down to one row; what still fails goes to dead with its reason,
    and the stream goes on. Batch ids name the folders, so a batch that is run again replaces its own output."""

    def run(batch: DataFrame, number: int) -> None:
        target, lost = f"{out}/batch={number}", f"{dead}/batch={number}"
        held = batch.persist()
        plain = [f.name for f in batch.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
        for folder in (target, lost):
            files.drop(batch.sparkSession, folder)

        def attempt(rows: DataFrame, cuts: int) -> None:
            try:
                answer(rows).write.mode("append").parquet(target)
            except Exception as problem:  # bad rows must not stop the stream
                if cuts == CUTS or rows.count() <= 1:
                    rows.withColumn("problem", F.lit(str(problem)[:500])).write.mode("append").parquet(lost)
                    return
                part = F.pmod(F.xxhash64(F.lit(cuts), *[F.col(f"`{c}`") for c in plain]), F.lit(PARTS))
                for i in range(PARTS):
                    attempt(rows.where(part == i), cuts + 1)

        try:
            attempt(held, 0)
        finally:
            held.unpersist()

    writer = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def windowed(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum by time window and key, with a watermark. An extension: the decision service itself has no
    event time."""
    at = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return at.groupBy(F.window("_ts", width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def drain(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over all that is there now, into files of the shared folder, and read those. In complete
    mode the last batch counts, in append mode all of them; a batch that is run again replaces its own files."""
    out = work_dir(spark, name)
    last = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    query = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], df.schema)
    found = spark.read.option("basePath", out).schema(df.schema).parquet(out if mode == "append" else f"{out}/batch={max(last)}")
    return found.select(*df.columns)


def in_steps(spark: SparkSession, rows: DataFrame, order: str, steps: int, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What make gives for rows as a stream that arrives in steps: each step (an equal range of the column order) is written
    to a folder, and a query started on it with the state of the one before, so every step is also a restart."""
    root, low, high = work_dir(spark, name), *rows.agg(F.min(order), F.max(order)).first()
    arrivals = spark.readStream.schema(rows.schema)
    rows.limit(0).write.parquet(f"{root}/in")
    out = make(arrivals.parquet(f"{root}/in"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/micro_batch_number={number}")

    for i in range(steps if low is not None else 0):
        step = F.least(F.floor((F.col(order) - low) * steps / (high - low + 1)), F.lit(steps - 1))
        rows.where(F.coalesce(step, F.lit(0)) == i).write.mode("append").parquet(f"{root}/in")
        query = out.writeStream.foreachBatch(put)
        query.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    if low is None:
        return spark.createDataFrame([], out.schema)
    return spark.read.option("basePath", f"{root}/out").schema(out.schema).parquet(f"{root}/out").select(*out.columns)


def admit(requests: DataFrame, order: list[str], queue: int = 256) -> DataFrame:
    """requests of a micro-batch with status: accepted for the first queue by order, else rejected (503, to be tried
    again). Only queue + 1 rows are ever sorted together: the place of the first one too many decides for the rest."""
    mark = requests.select(*order).orderBy(*order).limit(queue + 1).collect()
    if len(mark) <= queue:
        return requests.withColumn("status", F.lit("accepted")).withColumn("retry_after", F.lit(None).cast("int"))
    first = F.struct(*[F.lit(mark[-1][c]).cast(requests.schema[c].dataType).alias(c) for c in order])
    late = F.struct(*order) >= first
    return requests.withColumn("status", F.when(late, "rejected").otherwise("accepted")).withColumn("retry_after", F.when(late, 1))
