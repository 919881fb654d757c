"""What happens to a stream's batches: results by key that later batches replace, topics with handlers of their own, late rows apart,
state that is written before anything acts on it. All is by batch id, so that a batch that runs again writes the same once more."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import names_in

Handler = Callable[[DataFrame, int], None]


def run(df: DataFrame, state: str, each: Handler, mode: str = "append") -> list[dict]:
    """Run on all there is now with ``each`` for a batch; ``state`` keeps what is done, so that another run goes on from there."""
    q = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def upserts(at: str) -> Handler:
    """Keep what each batch says of its keys; the last word counts when read."""
    return lambda df, batch: df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/b={batch}")


def last_words(spark: SparkSession, at: str, keys: list[str], schema) -> DataFrame:
    """One row a key: that of the latest batch which has it."""
    if not names_in(spark, at):
        return spark.createDataFrame([], schema)
    d = spark.read.parquet(at).drop("b")
    values = [c for c in d.columns if c not in keys and c != "_batch"]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")


def to_topics(at: str, topic: str, handlers: Mapping[str, Handler]) -> Handler:
    """Give each topic's rows of a batch to its handler. A handler that fails leaves a row of its failure and harms no other; topics
    without a handler are counted and kept."""

    def each(df: DataFrame, batch: int) -> None:
        seen, notes = df.persist(), []
        try:
            for name in sorted(handlers):
                try:
                    handlers[name](seen.filter(F.col(topic) == name), batch)
                    notes.append((name, "handled", None))
                except Exception as e:  # noqa: BLE001 - a handler may fail in any way
                    notes.append((name, "failed", type(e).__name__))
            rest = seen.filter(~F.col(topic).isin(*handlers)).groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("n"))
            spark = df.sparkSession
            notes_ = spark.createDataFrame(notes, "topic string, outcome string, error string").withColumn("n", F.lit(None).cast("long"))
            notes_.unionByName(rest.select("topic", F.lit("no handler").alias("outcome"), F.lit(None).cast("string").alias("error"), "n")).write.mode("overwrite").parquet(f"{at}/notes/b={batch}")
        finally:
            seen.unpersist()

    return each


def by_lateness(at: str, ts: str, delay: datetime.timedelta) -> Handler:
    """Rows behind the watermark of the batches before go to ``late``, the others to ``rows``. The watermark is read from what was written, so
    a restart knows it; it never goes back."""

    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = [n for n in names_in(spark, f"{at}/rows") if n.startswith("b=") and int(n[2:]) < batch]
        mark = spark.read.parquet(*(f"{at}/rows/{n}" for n in before)).agg(F.max(ts)).first()[0] if before else None
        late = F.col(ts) < F.lit(mark - delay) if mark is not None else F.lit(False)
        df.filter(~late).write.mode("overwrite").parquet(f"{at}/rows/b={batch}")
        df.filter(late).write.mode("overwrite").parquet(f"{at}/late/b={batch}")

    return each


def persist_then(at: str, act: Handler) -> Handler:
    """Write a batch's state first; act only on what can be read back. If writing fails nothing acts."""

    def each(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/state/b={batch}")
        act(df.sparkSession.read.parquet(f"{at}/state/b={batch}"), batch)

    return each
