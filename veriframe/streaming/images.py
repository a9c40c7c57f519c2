"""Classifying files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import schema as S
from ..operators import features as X
from ..operators import model as M
from ..sources import images as I

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """New image files of a folder, as a stream; uploads of another type or size have ``http_status`` 400."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", I._glob(S.EXTENSIONS)).option("maxFilesPerTrigger", max_files).load(folder)
    return I.uploads(files)


def classify_arriving(spark: SparkSession, folder: str, out: str, checkpoint: str, model: M.Model | None = None, max_files: int = 100) -> StreamingQuery:
    """Classify each micro-batch and write it below ``out`` by batch number, so that a batch that is run again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        good = [r.path for r in batch.where("http_status = 200").select("path").collect()]  # at most max_files
        if good:
            found = X.extract(I.scan_images(spark, good), X.tags(I.scan_files(spark, good)), tuple(g for g in S.GROUPS if model is not None or g != "drift"))
            M.classify(found, model).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, folder, max_files).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
