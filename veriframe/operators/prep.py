"""Preparing data sets: naming, sampling, splitting, verifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.images import extension
from ..storage import cut

#: Suffixes of the files that are taken in.
INGESTED = ("png", "jpg", "jpeg", "webp")


def ranked(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place (from 0) in ``order`` among those with equal ``by``.

    Rows are dealt by ranges, each is ranked by itself, and the rows of the ranges
    before are added: no task has a whole class.
    """
    dealt = cut(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and class
    lead = per.select(F.col("_range").alias("_r"), *(F.col(b).alias(f"_by{k}") for k, b in enumerate(by)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)) - 1)
    same = F.col("_range") == F.col("_r")
    for k, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_by{k}"))
    return own.join(lead, same).select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def source_label(name: Column, fallback: str = "misc") -> Column:
    """The generator that a file's name tells: kling, gemini or banana (images), else ``fallback`` (``video`` for videos)."""
    low = F.lower(name)
    out = F.when(low.contains("kling"), "kling").when(low.contains("gemini"), "gemini")
    return (out.when(low.contains("banana"), "banana") if fallback != "video" else out).otherwise(fallback)


def ingest_names(files: DataFrame, name: str = "name", by_source: bool = False) -> DataFrame:
    """The image files with ``source`` and ``target``: ``ai_{source}_img_{NNN}{suffix}``, numbered from 1 by name over all of them (``by_source``: within the source).  Numbers from 1000 on are written whole; the suffix stays as it is."""
    images = files.where(extension(name).isin(*INGESTED)).withColumn("source", source_label(F.col(name)))
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return ranked(images, ["source"] if by_source else [], [name], "_n").withColumn("target", F.concat(F.lit("ai_"), "source", F.lit("_img_"), F.format_string("%03d", F.col("_n") + 1), suffix)).drop("_n")


def frame_sample(frames: DataFrame, video: str, index: str, count: str | None = None, wanted: int = 30, unknown: int = 1000) -> DataFrame:
    """Every ``max(1, frames // wanted)``-th frame of a video, ``wanted`` at most.  A video whose count is null or not positive counts as ``unknown`` frames.

    The frame's number alone says whether it stays: the frames are the
    multiples of the step, so that nothing is sorted.
    """
    n = F.col(count) if count else F.lit(None).cast("long")
    n = F.when(n > 0, n).otherwise(F.lit(unknown))
    step = F.greatest(F.lit(1), F.floor(n / wanted))
    return frames.where((F.col(index) % step == 0) & (F.col(index) / step < wanted))


def mixed(key: Column, seed: int = 42) -> Column:
    """A scrambling of a whole number from 0 to 2**50 that any SQL engine can repeat."""
    high, low = F.floor(key / 1_000_003), F.pmod(key, F.lit(1_000_003))
    return F.pmod(low * F.lit(48_271) + high * F.lit(69_621) + F.lit(seed * 11), F.lit(2_147_483_647))


def holdout(df: DataFrame, label: str, key: str, n: int = 10, least: int = 0, seed: int = 42) -> DataFrame:
    """``df`` with ``is_test``: ``n`` of each class, or a fifth of a class that has fewer than ``n``; none of a class under ``least``.

    Which rows these are follows from key and seed.  Counts of a class come
    from one aggregate; each task ranks its own rows and passes on ``n`` of a class at most.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("_size")).withColumnRenamed(label, "_label")
    mixed_key = df.select(F.col(label).alias("_of"), F.col(key).alias("_key"), mixed(F.col(key), seed).alias("_mix"))
    first = mixed_key.withColumn("_rank", F.row_number().over(Window.partitionBy("_of").orderBy("_mix", "_key"))).where(F.col("_rank") <= n)
    take = F.when(F.col("_size") < least, 0).when(F.col("_size") < n, F.floor(F.col("_size") / 5)).otherwise(n)
    chosen = first.join(sizes, F.col("_of").eqNullSafe(F.col("_label"))).where(F.col("_rank") <= take).select("_key", F.lit(True).alias("_test"))
    return df.join(chosen, F.col(key) == F.col("_key"), "left").select(*df.columns, F.coalesce("_test", F.lit(False)).alias("is_test"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int | None = None) -> DataFrame:
    """``df`` with ``fold`` 0 to k - 1: each class is cut by key into k runs; k is 5, or a quarter of the rows if that is less (2 at least).

    A run is as long as the rows of the class are among every k-th row of all,
    sorted by class, so that the folds differ by one row at most.
    """
    if k is None:
        k = max(2, min(5, df.count() // 4))
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    before = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)  # a row a class
    start = sizes.select(F.col(label).alias("_label"), "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = ranked(df, [label], [key], "_rank").join(start, F.col(label).eqNullSafe(F.col("_label")))
    fold, end = F.lit(0), F.lit(0)
    for i in range(k - 1):
        end = end + F.floor((F.col("_start") + F.col("_n") - 1 - i) / k) - F.floor((F.col("_start") - 1 - i) / k)
        fold = fold + (F.col("_rank") >= end).cast("int")
    return joined.select(*df.columns, fold.alias("fold"))


def grouped_folds(df: DataFrame, group: Column, k: int = 5) -> DataFrame:
    """Folds by a hash of the source image, so that copies of one image are never on both sides; no shuffle."""
    return df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(k)).cast("int"))


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` for each key; rows are summed up before they are shuffled."""
    rest = [c for c in df.columns if c not in (key, order)]
    least = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return least.select(*(F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns))


def label_union(real: DataFrame, generated: DataFrame) -> DataFrame:
    return real.withColumn("label", F.lit(0)).unionByName(generated.withColumn("label", F.lit(1)))


def augment_fanout(df: DataFrame) -> DataFrame:
    """Each row four times, with ``kind`` orig, q70, q80 and small."""
    return df.withColumn("kind", F.explode(F.array(*map(F.lit, ("orig", "q70", "q80", "small")))))


def verify(files: DataFrame, folder: str = "dir", size: str = "length", width: str = "width", height: str = "height", name: str = "name", shown: int = 5) -> DataFrame:
    """``dir, n, corrupt, low_res, bad_files, passed``: empty or undecodable files fail a folder, sides under 512 only warn; the first ``shown`` bad names are listed."""
    corrupt = (F.col(size) == 0) | F.col(width).isNull() | (F.col(width) <= 0)
    low = ~corrupt & (F.least(width, height) < 512)
    per = files.groupBy(folder).agg(F.count("*").alias("n"), F.sum(corrupt.cast("int")).alias("corrupt"), F.sum(low.cast("int")).alias("low_res"))
    bad = files.where(corrupt).withColumn("_r", F.row_number().over(Window.partitionBy(folder).orderBy(name))).where(F.col("_r") <= shown)
    named = bad.groupBy(folder).agg(F.array_sort(F.collect_list(name)).alias("bad_files"))
    return per.join(named, folder, "left").withColumn("bad_files", F.coalesce("bad_files", F.array().cast("array<string>"))).withColumn("passed", F.col("corrupt") == 0)
