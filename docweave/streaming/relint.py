"""Checking documents as they arrive: JSON envelopes as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Namespace
from ..plans.lint import check
from ..sources.config import Config
from ..sources.external import build_sources, envelopes


def stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Envelope lines (source, value) of files that appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).select(F.lit("stream").alias("source"), "value")


def relint(spark: SparkSession, folder: str, namespaces: list[Namespace], known: DataFrame | None, out: str, checkpoint: str):
    """A streaming query that checks each batch of envelopes and writes its diagnostics.

    Targets are the batch and ``known``, the docs table when the query starts:
    documents of earlier batches become targets only when the query is started
    anew with a table that holds them.  A batch that is run again writes its own
    folder again, so results are kept once.
    """
    config = Config(namespaces=namespaces)

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        corpus, messages = build_sources(spark, envelopes(batch), config, [], [])
        if known is not None:
            subjects = {n.name for n in namespaces}
            targets = known.withColumn("ns", F.col("ns"))
            corpus.tables["docs"] = corpus.docs.unionByName(targets.join(corpus.docs.select("doc_key"), "doc_key", "left_anti"))
            arrived = corpus.tables["_parsed"].select(F.col("location").alias("path"))
            found = check(corpus, [n for n in namespaces if n.name in subjects]).join(arrived.distinct(), "path", "left_semi")
        else:
            found = check(corpus, namespaces)
        messages = messages.withColumn("ns", F.lit(None).cast("string"))
        found.unionByName(messages).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
