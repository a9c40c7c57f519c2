"""One pass over decoded images: feature columns.

The kernel pass takes pixels to numbers in one Arrow trip; scores, vote and
texts are native projections over these (:mod:`..functions.scores`).  Only the
groups that are asked for are computed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions import scores
from ..functions.exif import read_exif
from ..functions.kernels import Raster, augmented, features, screen_inputs
from ..storage import cut

PIXEL_GROUPS = tuple(g for g in S.GROUPS if g != "metadata")
#: Turned images whose orientations are sent along; beyond that they are joined.
MAX_SENT = 200_000


def pixels(data: bytes | pa.Buffer, height: int, width: int, channels: int, turn: int = 1) -> np.ndarray:
    """Height x width x 3, blue first; gray is repeated, transparency left out, the EXIF orientation applied."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    a = np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]
    if turn in (2, 4, 5, 7):
        a = a[:, ::-1]
    turned = {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(turn, 0)
    return np.ascontiguousarray(np.rot90(a, turned))


def _kernel(groups: tuple[str, ...], keep: list[str], kinds: tuple[str, ...] | None):
    names = [n for g in groups if g != "metadata" for n in S.GROUPS[g]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("path", "height", "width", "channels", "status", "turn")}
                path = row["path"] or ""
                for kind in kinds or ("orig",):
                    status, values, extra, size = row["status"], [None] * len(names), (None, None), (row["width"], row["height"])
                    if status == "ok":
                        try:
                            bgr = pixels(batch.column("data")[k].as_buffer(), row["height"], row["width"], row["channels"], row["turn"] or 1)
                            suffix = path.lower().rsplit(".", 1)[-1]
                            r = Raster(augmented(bgr, kind), suffix == "png" and kind == "orig", suffix in ("jpg", "jpeg", "webp") or kind != "orig")
                            found = features(r, groups, zlib.crc32(path.encode()))
                            values, extra, size = [found[n] for n in names], screen_inputs(r), r.gray.shape[::-1]
                        except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
                            status = f"failed: {e}"
                    rows.append((kind, status, *map(lambda x: None if x is None else int(x), size), *values, *extra))
                    source.append(k)
            cols = list(zip(*rows, strict=True)) or [()] * (4 + len(names) + len(S.SCREEN))
            fixed = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())]
            own = batch.select(keep).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *fixed, *(pa.array(c, pa.float64()) for c in cols[4:])], names=[*keep, "kind", "status", "width", "height", *names, *S.SCREEN])

    return run, names


def tags(files: DataFrame) -> DataFrame:
    """``path, tags, gps, turn``: EXIF tags, GPS tags and orientation of ``binaryFile`` rows, which are read once."""

    @F.pandas_udf("tags map<string,string>, gps map<string,string>, turn int")
    def parse(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_exif(c) for c in content], columns=["tags", "gps", "turn"])

    return cut(files.select("path", parse("content").alias("e")).select("path", "e.tags", "e.gps", "e.turn"), "exif")


def extract(images: DataFrame, exif: DataFrame | None = None, groups: tuple[str, ...] = tuple(S.GROUPS), augment: bool = False) -> DataFrame:
    """Feature columns of :func:`..sources.images.scan_images` rows, with their other columns.

    ``exif`` (from :func:`tags`) gives metadata and orientation; without it
    images have no tags.  ``augment`` adds for each image the copies ``q70``,
    ``q80`` and ``small`` (column ``kind``), which carry no tags.  A row that isn't
    ``ok`` has null pixel features.
    """
    groups = tuple(g for g in S.GROUPS if g in groups)
    if exif is None:
        turned = images.withColumn("turn", F.lit(1))
    else:
        others = exif.where("turn <> 1").select("path", "turn")
        few = others.limit(MAX_SENT + 1).count() <= MAX_SENT
        turned = images.join(F.broadcast(others) if few else others, "path", "left")
    keep = [c for c in images.columns if c not in ("data", "width", "height", "channels", "status")]
    run, names = _kernel(groups, keep, ("orig", "q70", "q80", "small") if augment else None)
    fields = ", ".join([f"`{c}` {images.schema[c].dataType.simpleString()}" for c in keep] + ["kind string, status string, width int, height int"] + [f"{n} double" for n in (*names, *S.SCREEN)])
    out = turned.mapInArrow(run, fields)
    if "metadata" not in groups:
        return out
    if exif is None:
        out = out.withColumn("tags", F.lit(None).cast("map<string,string>"))
    else:
        out = out.join(exif.select("path", "tags"), "path", "left").withColumn("tags", F.when(F.col("kind") == "orig", F.col("tags")))
    out = out.withColumns(scores.metadata_features(scores.analyze_tags(F.col("tags")))).drop("tags")
    order = [n for g in groups for n in S.GROUPS[g]]
    return out.select(*keep, "kind", "status", "width", "height", *order, *S.SCREEN)


def zero_filled(features: DataFrame) -> DataFrame:
    """Missing values as zeros: images that can't be read stay in, as zero vectors."""
    return features.fillna(0.0, subset=[n for n in S.FEATURES if n in features.columns])
