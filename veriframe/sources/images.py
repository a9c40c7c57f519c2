"""Image files as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema as S
from ..storage import hadoop_path, is_folder


def extension(path: str | Column) -> Column:
    """The lower-cased suffix without its dot; empty where there is none."""
    col = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(col, r"\.([^./\\]+)$", 1))


def validate_path(path: str) -> str:
    """The path if the file exists and has an image's suffix; FileNotFoundError or ValueError else.  For single local files."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"Image not found: {path}")
    if os.path.splitext(path)[1].lower().lstrip(".") not in S.EXTENSIONS:
        raise ValueError(f"Unsupported image format: {path}")
    return path


def _glob(extensions: tuple[str, ...]) -> str:
    """A glob that takes the suffixes in either case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def _uri(path: Column) -> Column:
    """Local paths in one spelling: the two file formats have different ones."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def scan_images(spark: SparkSession, path: str | list[str], ordered: bool = False) -> DataFrame:
    """``path, width, height, channels, data, status`` of the images in a folder (not below it), or of a file.

    ``data`` has the pixels row by row, blue first.  An undecodable file has
    status ``undecodable``, a kind without a decoder ``unsupported``, and null data.
    Files without a byte give no row, as Spark's file sources leave them out.
    ``ordered`` sorts the rows by path.
    """
    raw = spark.read.format("image").option("pathGlobFilter", _glob(S.EXTENSIONS)).option("recursiveFileLookup", "false").load(path)
    i = F.col("image")
    good = i["height"] > 0
    status = F.when(good, "ok").when(extension(i["origin"]).isin(*S.UNSUPPORTED), "unsupported").otherwise("undecodable")
    found = raw.select(_uri(i["origin"]).alias("path"), *(F.when(good, i[a]).alias(b) for a, b in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))), status.alias("status"))
    return found.orderBy("path") if ordered else found


def scan_files(spark: SparkSession, path: str | list[str], extensions: tuple[str, ...] = S.EXTENSIONS) -> DataFrame:
    """``path, length, modificationTime, content`` of the image files; filters on length and time reach the scan."""
    return spark.read.format("binaryFile").option("pathGlobFilter", _glob(extensions)).option("recursiveFileLookup", "false").load(path).withColumn("path", _uri(F.col("path")))


def file_names(spark: SparkSession, path: str, extensions: tuple[str, ...] = S.EXTENSIONS) -> DataFrame:
    """``path`` of the image files as they are listed, those without a byte among them."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", _glob(extensions)).option("recursiveFileLookup", "false").load(path).inputFiles()
    return spark.createDataFrame([(unquote(p),) for p in listed], "path string").select(_uri(F.col("path")).alias("path"))


def labelled_folders(spark: SparkSession, real: str, generated: str, extra_real: str | None = None, extra_generated: str | None = None) -> list[tuple[str, int]]:
    """The folders with their label, 0 (real) or 1 (generated); the extra ones (screenshots) count only if they exist, in whatever store."""
    return [(real, 0), (generated, 1), *((d, y) for d, y in ((extra_real, 0), (extra_generated, 1)) if d and is_folder(spark, d))]


def labelled(spark: SparkSession, real: str, generated: str, extra_real: str | None = None, extra_generated: str | None = None) -> DataFrame:
    """Images of the folders with ``label``."""
    parts = [scan_images(spark, d).withColumn("label", F.lit(y)) for d, y in labelled_folders(spark, real, generated, extra_real, extra_generated)]
    return reduce(DataFrame.unionByName, parts)


def uploads(files: DataFrame) -> DataFrame:
    """``files`` (``path``, ``length``) with ``http_status``: 400 for another type or more than 10 MiB, 200 else."""
    good = extension("path").isin(*S.UPLOAD_EXTENSIONS) & (F.col("length") <= S.UPLOAD_BYTES)
    return files.withColumn("http_status", F.when(good, 200).otherwise(400))


def copied(files: DataFrame, folder: str) -> DataFrame:
    """``target`` of each row of ``files`` (``content``, ``target``), once its bytes are in the folder under that name.  The tasks write, in whatever store pyarrow knows."""
    spark = files.sparkSession
    uri = hadoop_path(spark, folder)[1].makeQualified(hadoop_path(spark, folder)[0]).toUri().toString().replace("file:/", "file:///", 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for content, name in zip(batch.column("content"), batch.column("target").to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content.as_buffer())
            yield batch.select(["target"])

    return files.select("content", "target").mapInArrow(run, "target string")
