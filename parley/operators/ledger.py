"""A ledger of model calls: every distinct input is answered once, and every later step reads the answer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.operators.ordered import key_digest
from parley.operators.predict import predict_column
from parley.sources.tables import is_whole


class Ledger:
    """Answers of one model in a folder that all executors share, keyed by a digest of what the model was given.

    Before a call the inputs that have an answer are taken out and repeated ones are joined to one; afterwards the new answers
    are appended by one committed job.  A lost executor costs the calls of its unfinished tasks; a failed job leaves the
    ledger as it was.  Only one job at a time may write to a ledger.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def answers(self) -> DataFrame | None:
        """(input binary, answer string), or None before the first call."""
        return self.spark.read.schema("input binary, answer string").parquet(self.path) if is_whole(self.spark, self.path) else None

    def predict(self, df: DataFrame, fn: Callable[..., Sequence], inputs: Sequence[str], out: str = "translated_text_model") -> DataFrame:
        """Add ``out`` = the answer of ``fn`` (see ``predict_column``) to each row, calling it once for each distinct input that is new.

        Rows with an equal input get the same answer.  Nulls are inputs of their own.
        """
        names = list(inputs)
        keyed = df.withColumn("_input", key_digest(*(F.col(c).cast("string") for c in names)))
        new = keyed.select("_input", *names)
        known = self.answers()
        if known is not None:
            new = new.join(known.select(F.col("input").alias("_input")), "_input", "left_anti")
        # the digest tells the inputs apart, so that their texts are no key
        once = new.groupBy("_input").agg(F.min_by(F.struct(*names), F.lit(0)).alias("_r")).select("_input", "_r.*")
        made = predict_column(once, fn, names, "_answer").select(F.col("_input").alias("input"), F.col("_answer").alias("answer"))
        made.write.mode("overwrite" if known is None else "append").parquet(self.path)
        return keyed.join(self.answers().select(F.col("input").alias("_input"), F.col("answer").alias(out)), "_input").drop("_input")
