"""The engine's front: classify, train and evaluate image folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import schema as S
from .operators import evaluate as E
from .operators import features as X
from .operators import model as M
from .operators import prep as P
from .sources import images as I
from .storage import hadoop_path


def image_features(spark: SparkSession, path: str, groups: tuple[str, ...] = tuple(S.GROUPS), ordered: bool = False) -> DataFrame:
    """Feature columns of the images of a folder or of one file; ``ordered`` by path."""
    found = X.extract(I.scan_images(spark, path), X.tags(I.scan_files(spark, path)), groups)
    return found.orderBy("path") if ordered else found


def classify(spark: SparkSession, path: str, model_path: str | None = None, mode: str = "auto") -> DataFrame:
    """Predictions for a folder or a file, by the model at ``model_path`` or, where it can't be read, by the vote."""
    model = None
    if model_path:
        try:
            model = M.load(spark, model_path)
        except (FileNotFoundError, ValueError) as e:
            print(f"Warning: Could not load model ({e}), using fallback voting.")
    groups = tuple(g for g in S.GROUPS if model is not None or g != "drift")
    return M.classify(image_features(spark, path, groups), model, mode)


def train(spark: SparkSession, real: str, generated: str, model_path: str | None = None, extra_real: str | None = None, extra_generated: str | None = None, augment: bool = True, grouped: bool = True, zero_vectors: bool = False) -> M.Training:
    """Train on two folders; each image also counts as its three stored copies if ``augment``.

    ``grouped`` keeps the copies of an image in one fold.  ``zero_vectors`` keeps
    unreadable images as zero vectors instead of leaving them out.
    """
    scanned = I.labelled(spark, real, generated, extra_real, extra_generated)
    files = [I.scan_files(spark, d) for d, _ in I.labelled_folders(spark, real, generated, extra_real, extra_generated)]
    found = X.extract(scanned, X.tags(reduce(DataFrame.unionByName, files)), augment=augment)
    if zero_vectors:
        found = X.zero_filled(found)
    done = M.train(found, group="path" if grouped else None)
    if model_path:
        M.save(done.model, spark, model_path)
    return done


def evaluate(spark: SparkSession, real: str, generated: str, model_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Accuracy and report over two labelled folders."""
    parts = [classify(spark, d, model_path).withColumn("truth", F.lit(y)) for d, y in ((real, 0), (generated, 1))]
    return M.evaluate(parts[0].unionByName(parts[1]))


def batch_summary(spark: SparkSession, path: str, model_path: str | None = None) -> DataFrame:
    """Images of a folder by predicted label."""
    return E.summary(classify(spark, path, model_path))


def verify(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``dir, n, corrupt, low_res, bad_files, passed`` of image folders; files without a byte count as corrupt."""
    parts = []
    for d in folders:
        seen = I.scan_images(spark, d).select("path", "width", "height")
        files = I.scan_files(spark, d).select("path", "length")
        parts.append(I.file_names(spark, d).join(files, "path", "left").fillna(0, ["length"]).join(seen, "path", "left").withColumn("dir", F.lit(d)))
    files = reduce(DataFrame.unionByName, parts).withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    return P.verify(files)


def _image_files(spark: SparkSession, folder: str) -> DataFrame:
    return I.scan_files(spark, folder).select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"))


def split(spark: SparkSession, folder: str, test: str, n: int = 10, least: int = 0) -> int:
    """Move ``n`` images of a folder (a fifth of fewer, none of fewer than ``least``) to the test folder and tell how many.

    Nothing is moved if the test folder has ``n`` images already.
    """
    where, store = hadoop_path(spark, test)
    store.mkdirs(where)
    if _image_files(spark, test).count() >= n:
        return 0
    files = P.ranked(_image_files(spark, folder).withColumn("class", F.lit(0)), [], ["name"], "place")
    chosen = P.holdout(files, "class", "place", n, least=least).where("is_test").select("path", "name").collect()  # n at most
    for r in chosen:
        source, store = hadoop_path(spark, r.path)
        store.rename(source, hadoop_path(spark, f"{test.rstrip('/')}/{r.name}")[0])
    return len(chosen)


def ingest(spark: SparkSession, source: str, target: str) -> int:
    """Clear the target folder, copy the images of ``source`` to it under their new names, and tell how many."""
    where, store = hadoop_path(spark, target)
    store.delete(where, True)
    store.mkdirs(where)
    names = P.ingest_names(_image_files(spark, source)).select("path", "target")
    return I.copied(I.scan_files(spark, source).select("path", "content").join(names, "path"), target).count()
