"""Run a stream over what is available and read its output table back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from ..sources.writers import replace_partitions


def to_table(stream: DataFrame, name: str, mode: str = "append", out: str | None = None, state: str | None = None) -> DataFrame:
    """Drive a stream to the end of its input into a parquet table. With `out` and `state` given, a later call goes on from
    where the last one ended; without them both are new folders in the shared folder."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, name)
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", state or scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def each_batch(stream: DataFrame, name: str, write, mode: str = "append", state: str | None = None) -> None:
    """Drive a stream through `write(df, batch_id)`; writers must be idempotent in the batch id. With `state` given, a later
    call goes on from where the last one ended."""
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", state or scratch_path(stream.sparkSession, f"{name}-state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def by_batch(out: str, transform=None):
    """A writer for `each_batch`: the rows of a micro-batch, after `transform`, become the partition batch=<id> of the table
    `out`. A batch that is repeated replaces its own partition and no other, so a restarted stream leaves each row once.
    The batch is written before it is transformed: a plan that reads it twice must not run the stream's state twice."""

    def write(df: DataFrame, batch_id: int) -> None:
        rows = (transform(materialise(df, "batch")) if transform else df).withColumn("batch", F.lit(batch_id).cast("bigint"))
        replace_partitions(rows, out, ["batch"])

    return write


def stream_of(df: DataFrame, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Store a table in the shared folder and open it as a stream."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-in")
    df.write.parquet(path)
    read = spark.readStream.schema(df.schema)
    if files_per_trigger:
        read = read.option("maxFilesPerTrigger", files_per_trigger)
    return read.parquet(path)
