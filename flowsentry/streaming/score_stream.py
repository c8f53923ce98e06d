"""Score arriving flow files with a saved configuration.

The deploy scorer is a stateless projection (impute, scale, two scores,
robust z, weighted fusion, threshold), so the same function serves a batch
DataFrame and a Structured Streaming DataFrame.  Learned scorers plug in as
any DataFrame -> DataFrame step (``mapInPandas`` works on streams).  The
sink is file based with a checkpoint under the shared checkpoint root, so a
restarted query resumes where it stopped.

Arriving capture CSVs (``score_csv_stream``) may differ in their headers, and
a CSV stream has one schema by position.  So the stream carries the paths of
new files only; each micro-batch reads its files by their own headers with the
batch scan, scores them with the bundle and writes one folder named by the
batch number, which a repeated batch overwrites: every file is scored once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_path
from ..sources.artifacts import Bundle, FusionConfig, expression_scorer  # noqa: F401  (the scorer is used from here)
from ..sources.flow_csv import read_flow_files

Scorer = Callable[[DataFrame], DataFrame]


def deploy(df: DataFrame, scorer: Scorer, cfg: FusionConfig, keep: list[str] = ("row_id",)) -> DataFrame:
    """F13 on any (batch or streaming) flow frame: keep columns + z + pred."""
    scored = scorer(df)
    z, pred = cfg.fused(F.col("svm_score"), F.col("ae_score"))
    return scored.select(*keep, z.alias("z"), pred.alias("pred"))


def run_available(spark: SparkSession, stream: DataFrame, name: str = "stream") -> str:
    """Drains everything available now into a parquet folder; returns its path."""
    root = shared_path(spark, name)
    q = (stream.writeStream.format("parquet")
         .option("path", f"{root}/data")
         .option("checkpointLocation", f"{root}/_checkpoint")
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return f"{root}/data"


FILES = "path string, modificationTime timestamp, length long, content binary"


def score_csv_stream(spark: SparkSession, folder: str, bundle: Bundle, out: str, checkpoint: str, key_col: str | None = None,
                     keep: tuple[str, ...] = ("row_id", "src_file"), glob: str = "*.csv", files_per_batch: int = 64,
                     trigger: dict | None = None) -> StreamingQuery:
    """Scores CSV files as they arrive below ``folder`` into ``out``/batch=N
    (``keep``, z, pred).  Labels are optional; files without a line are passed
    over; a micro-batch takes at most ``files_per_batch`` files, whose paths
    are all that the driver gets.  ``trigger``: as for ``writeStream``; by
    default whatever is there now, then the query ends."""
    paths = (spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path"))
    scorer = bundle.scorer()

    def score(batch: DataFrame, number: int) -> None:
        found = read_flow_files(spark, sorted(r[0] for r in batch.collect()), key_col, features=bundle.prep.features, need_label=False)
        if found:
            deploy(found[0], scorer, bundle.config, list(keep)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (paths.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
