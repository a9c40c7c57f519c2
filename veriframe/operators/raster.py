"""Analyzer features of small rasters as native plans.

Filters and transforms of small tiles run inside a row, over its array of
samples, without a shuffle.  Spectra of larger rasters are two sums over rows and
columns: the pixels are dealt out once by image, and all sums after that stay
within a partition.  Variances of blocks are summed in numpy, in SQL's order.
The kernels in :mod:`..functions.kernels` give the same numbers for images of any
size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import gaussian, zigzag_order


# ---------------------------------------------------------------- rasters


def levels(e: Column) -> Column:
    """A number around 0 as a gray level."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 256 * e.cast("double")).cast("double")))


def tiles(embeddings: DataFrame) -> DataFrame:
    """``img_id, a``: each vector of 64 as an 8 x 8 tile of gray levels, row by row."""
    return embeddings.select(F.col("vec_id").alias("img_id"), F.transform("embedding", levels).alias("a"))


def mosaics(embeddings: DataFrame) -> DataFrame:
    """``img_id, y, x, v``: four tiles in a row as a 16 x 16 raster."""
    rows = embeddings.select("vec_id", F.posexplode("embedding").alias("i", "e"))
    q = F.col("vec_id") % 4
    return rows.select((F.col("vec_id") / 4).cast("long").alias("img_id"), (8 * F.floor(q / 2) + F.floor(F.col("i") / 8)).cast("int").alias("y"), (8 * (q % 2) + F.col("i") % 8).cast("int").alias("x"), levels(F.col("e")).alias("v"))


def byteplot(documents: DataFrame) -> DataFrame:
    """``img_id, a``: the code of each character of a whole text, modulo 256."""
    codes = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c) % 256)
    return documents.select(F.col("doc_id").alias("img_id"), codes.alias("a"))


# ---------------------------------------------------------------- within a row


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a column expression that a lambda mentions is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _at(a: Column, y: Column, x: Column, n: int) -> Column:
    """The sample at (y, x), mirrored at the border samples."""

    def fold(k: Column) -> Column:
        p = F.abs(k) % (2 * n - 2)
        return F.when(p < n, p).otherwise(2 * n - 2 - p)

    return F.element_at(a, (fold(y) * n + fold(x) + 1).cast("int"))


def filtered(a: Column, n: int, taps: list[tuple[int, int, float]]) -> Column:
    """The n x n raster under a filter of (dy, dx, weight)."""

    def one(i: Column) -> Column:
        y, x = F.floor(i / n), i % n
        total = F.lit(0.0)
        for dy, dx, w in taps:
            total = total + w * _at(a, y + dy, x + dx, n)
        return total

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), one)


SOBEL_X = [(dy, dx, float(dx * (2 - abs(dy)))) for dy in (-1, 0, 1) for dx in (-1, 1)]
SOBEL_Y = [(dy, dx, float(dy * (2 - abs(dx)))) for dx in (-1, 0, 1) for dy in (-1, 1)]
LAPLACE = [(-1, -1, 2.0), (-1, 1, 2.0), (1, -1, 2.0), (1, 1, 2.0), (0, 0, -8.0)]


def residual(a: Column, n: int, sigma: float) -> Column:
    """The raster less its blur."""
    w = gaussian(sigma)
    taps = [(k - len(w) // 2, float(t)) for k, t in enumerate(w)]
    rows = filtered(a, n, [(0, d, t) for d, t in taps])
    blur = let(rows, lambda r: filtered(r, n, [(d, 0, t) for d, t in taps]))
    return F.zip_with(a, blur, lambda p, q: p - q)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    """Null of an empty array."""
    return F.try_divide(total(a), F.size(a))


def with_moments(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds mean, variance, skewness and kurtosis (3 taken off) of an array column; flat arrays have 0 for the last two."""
    power = lambda x, k: total(F.transform(x, lambda v: F.pow(v, F.lit(k)))) / F.size(x)
    sums = let(F.col(column), lambda a: let(centred(a), lambda x: F.struct(mean(a).alias("m"), power(x, 2).alias("p2"), power(x, 3).alias("p3"), power(x, 4).alias("p4"))))
    df = df.withColumn(f"_{prefix}", sums)
    m, v = F.col(f"_{prefix}"), F.col(f"_{prefix}.p2")
    flat = F.sqrt(v) < 1e-10
    return df.withColumns({f"{prefix}mean": m["m"], f"{prefix}variance": v, f"{prefix}skewness": F.when(flat, 0.0).otherwise(m["p3"] / F.pow(v, F.lit(1.5))), f"{prefix}kurtosis": F.when(flat, 0.0).otherwise(m["p4"] / (v * v) - 3.0)}).drop(f"_{prefix}")


def centred(a: Column) -> Column:
    return let(a, lambda x: let(mean(x), lambda m: F.transform(x, lambda v: v - m)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of two arrays; 0 if one is flat."""

    def of(x: Column, y: Column) -> Column:
        square = lambda z: total(F.transform(z, lambda v: v * v))
        n, vx, vy = F.size(x), square(x), square(y)
        flat = (F.sqrt(vx / n) < 1e-10) | (F.sqrt(vy / n) < 1e-10)
        return F.when(flat, 0.0).otherwise(total(F.zip_with(x, y, lambda p, q: p * q)) / F.sqrt(vx * vy))

    return let(centred(a), lambda x: let(centred(b), lambda y: of(x, y)))


def variance(a: Column) -> Column:
    return let(centred(a), lambda x: total(F.transform(x, lambda v: v * v)) / F.size(x))


def neighbours(a: Column, n: int, down: bool) -> tuple[Column, Column]:
    """All samples that have a neighbour to the right (or below), and these neighbours."""
    first = F.filter(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: (i < n * (n - 1)) if down else (i % n < n - 1))
    step = n if down else 1
    return F.transform(first, lambda i: F.element_at(a, (i + 1).cast("int"))), F.transform(first, lambda i: F.element_at(a, (i + 1 + step).cast("int")))


def dct(a: Column) -> Column:
    """The 64 coefficients of an 8 x 8 tile, row by row, by rows and then columns."""

    def basis(k: int, x: int) -> float:
        return math.cos((2 * x + 1) * k * math.pi / 16) * (math.sqrt(1 / 8) if k == 0 else 0.5)

    table = F.array(*(F.lit(basis(k, x)) for k in range(8) for x in range(8)))
    at = lambda c, i: F.element_at(c, (i + 1).cast("int"))

    def dot(one) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, j: s + one(j))

    places = F.sequence(F.lit(0), F.lit(63))
    rows = let(a, lambda s: F.transform(places, lambda i: dot(lambda j: at(s, F.floor(i / 8) * 8 + j) * at(table, (i % 8) * 8 + j))))
    return let(rows, lambda r: F.transform(places, lambda i: dot(lambda j: at(r, j * 8 + i % 8) * at(table, F.floor(i / 8) * 8 + j))))


# ---------------------------------------------------------------- features


def dct_features(blocks: DataFrame) -> DataFrame:
    """``img_id`` and six DCT features, from blocks ``img_id, c`` (64 coefficients each).

    Every block becomes a few sums before it meets the others of its image.
    """
    scan = zigzag_order().tolist()
    c = F.col("c")
    square = F.transform(c, lambda v: v * v)
    pick = lambda a, ks: sum((F.element_at(a, k + 1) for k in ks[1:]), F.element_at(a, ks[0] + 1))
    ac = F.slice(c, 2, 63)
    power = lambda k: F.aggregate(ac, F.lit(0.0), lambda s, v: s + F.pow(v, F.lit(k)))
    high = [8 * u + v for u in range(4, 8) for v in range(4, 8)]
    per = blocks.withColumn("_s", square).select(
        "img_id", F.element_at(c, 1).alias("dc"), F.element_at("_s", 1).alias("dc2"), total(F.col("_s")).alias("all2"), pick(F.col("_s"), high).alias("high2"),
        pick(F.col("_s"), scan[:16]).alias("first"), pick(F.col("_s"), scan[-16:]).alias("last"), *(power(k).alias(f"p{k}") for k in (1, 2, 3, 4)),
    )
    g = per.groupBy("img_id").agg(F.count("*").alias("n"), F.var_pop("dc").alias("dct_dc_variance"), *(F.sum(x).alias(x) for x in ("dc2", "all2", "high2", "first", "last", "p1", "p2", "p3", "p4")))
    n = F.col("n") * 63.0
    m = F.col("p1") / n
    v = F.col("p2") / n - m * m
    fourth = F.col("p4") / n - 4 * m * F.col("p3") / n + 6 * m * m * F.col("p2") / n - 3 * m * m * m * m
    all_n = F.col("n") * 64.0
    some = F.col("all2") >= 1e-10
    return g.select(
        "img_id",
        F.when(some, 1.0 - F.col("dc2") / F.col("all2")).otherwise(0.0).alias("dct_ac_energy_ratio"),
        F.when(some, F.col("high2") / F.col("all2")).otherwise(0.0).alias("dct_high_freq_energy"),
        F.when(v > 1e-20, fourth / (v * v) - 3.0).otherwise(0.0).alias("dct_coeff_kurtosis"),
        (F.col("p2") / all_n - F.pow(F.col("p1") / all_n, F.lit(2))).alias("dct_coeff_variance"),
        "dct_dc_variance",
        F.when(F.col("first") >= 1e-10, F.col("last") / F.col("first")).otherwise(0.0).alias("dct_zigzag_decay"),
    )


def spectrum(px: DataFrame, n: int, value: str = "v") -> DataFrame:
    """``img_id, ky, kx, magnitude, r``: magnitude of the discrete Fourier transform of n x n rasters; ``r`` is the distance from the zero frequency."""
    k = F.sequence(F.lit(0), F.lit(n - 1))
    turn = lambda f, x: 2 * math.pi * (f * x % n) / n
    dealt = px.repartition("img_id")
    rows = dealt.select("*", F.explode(k).alias("kx")).withColumn("t", turn(F.col("kx"), F.col("x")))
    rows = rows.groupBy("img_id", "y", "kx").agg(F.sum(F.col(value) * F.cos("t")).alias("re"), F.sum(-F.col(value) * F.sin("t")).alias("im"))
    both = rows.select("*", F.explode(k).alias("ky")).withColumn("t", turn(F.col("ky"), F.col("y")))
    re, im = F.col("re"), F.col("im")
    both = both.groupBy("img_id", "ky", "kx").agg(F.sum(re * F.cos("t") + im * F.sin("t")).alias("re"), F.sum(im * F.cos("t") - re * F.sin("t")).alias("im"))
    half = n // 2
    centred = lambda c: (F.col(c) + half) % n - half
    return both.select("img_id", "ky", "kx", F.sqrt(re * re + im * im).alias("magnitude"), F.sqrt((centred("ky") * centred("ky") + centred("kx") * centred("kx")).cast("double")).alias("r"))


def radial_profile(spectra: DataFrame, n: int) -> DataFrame:
    """``img_id, radius, mean_logmag``."""
    return spectra.where(F.floor("r") < n // 2).groupBy("img_id", F.floor("r").cast("int").alias("radius")).agg(F.avg(F.log1p("magnitude")).alias("mean_logmag"))


def profile_features(profile: DataFrame, n: int) -> DataFrame:
    """``img_id`` with slope, R2, share of the upper half, and falloff; the guards of short and flat profiles apply."""
    bins = n // 2
    r, p = F.col("radius"), F.col("mean_logmag")
    fit = (r >= 1) & (p > 0)
    x, y = F.when(fit, F.log(r)), F.when(fit, F.log(p))
    g = profile.groupBy("img_id").agg(
        F.count(x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.var_pop(y).alias("vy"), F.sum(p).alias("all"), F.sum(F.when(r >= bins // 2, p)).alias("upper"),
        F.avg(F.when(r >= 3 * bins // 4, p)).alias("far"), F.avg(F.when((r >= bins // 4) & (r < bins // 2), p)).alias("near"),
    )
    enough = F.col("n") >= 5
    return g.select(
        "img_id",
        F.when(enough, F.col("slope")).otherwise(0.0).alias("spectral_slope"),
        F.when(enough & (F.col("vy") > 0), F.col("r2")).otherwise(0.0).alias("slope_r_squared"),
        F.coalesce(F.try_divide("upper", "all"), F.lit(0.0)).alias("high_freq_ratio"),
        (F.coalesce(F.try_divide("far", "near"), F.lit(0.0)) if bins >= 8 else F.lit(0.0)).alias("spectral_falloff"),
    )


def band_ratios(spectra: DataFrame, n: int) -> DataFrame:
    top = n // 2
    m, r = F.col("magnitude"), F.col("r")
    share = lambda cond: F.coalesce(F.sum(F.when(cond, m)), F.lit(0.0)) / (F.sum(m) + 1e-10)
    g = spectra.groupBy("img_id").agg(share(r < 0.33 * top).alias("band_low_ratio"), share((r >= 0.33 * top) & (r < 0.66 * top)).alias("band_mid_ratio"), share((r >= 0.66 * top) & (r <= top)).alias("band_high_ratio"))
    return g.withColumn("band_mid_high_ratio", F.col("band_mid_ratio") + F.col("band_high_ratio"))


def spectral_entropy(spectra: DataFrame) -> DataFrame:
    """``img_id, spectral_entropy``: of the power over all frequencies that have some, in units of its maximum."""
    p = F.col("magnitude") * F.col("magnitude")
    g = spectra.where(p > 0).groupBy("img_id").agg(F.sum(p).alias("s"), F.sum(p * F.log2(p)).alias("w"), F.count("*").alias("n"))
    # -sum(p/s log2(p/s)) = log2 s - sum(p log2 p) / s
    return g.select("img_id", F.when((F.col("s") < 1e-10) | (F.col("n") < 2), 0.0).otherwise((F.log2("s") - F.col("w") / F.col("s")) / F.log2(F.col("n").cast("double"))).alias("spectral_entropy"))


def gradient_features(t: DataFrame, n: int = 8) -> DataFrame:
    gx, gy = filtered(F.col("a"), n, SOBEL_X), filtered(F.col("a"), n, SOBEL_Y)
    d = t.select("img_id", F.zip_with(gx, gy, lambda p, q: F.sqrt(p * p + q * q)).alias("g"), F.transform(filtered(F.col("a"), n, LAPLACE), F.abs).alias("l"))
    d = with_moments(with_moments(d, "g", "g_"), "l", "l_")
    return d.select("img_id", F.col("g_mean").alias("gradient_mean"), F.col("g_variance").alias("gradient_variance"), F.col("g_kurtosis").alias("gradient_kurtosis"), F.col("l_mean").alias("gradient_laplacian_mean"), F.col("l_variance").alias("gradient_laplacian_variance"))


def noise_features(t: DataFrame, n: int = 8, sigma: float = 1.0) -> DataFrame:
    """Moments of the residual and its mean correlation between neighbours."""
    d = with_moments(t.select("img_id", residual(F.col("a"), n, sigma).alias("e")), "e", "e_")
    across, down = (correlation(*neighbours(F.col("e"), n, way)) for way in (False, True))
    return d.select("img_id", F.col("e_variance").alias("noise_variance"), F.col("e_kurtosis").alias("noise_kurtosis"), F.col("e_skewness").alias("noise_skewness"), ((across + down) / 2).alias("noise_autocorrelation"))


def multiscale_ratio(t: DataFrame, n: int = 8, fine: float = 0.5, coarse: float = 1.0) -> DataFrame:
    d = t.select("img_id", residual(F.col("a"), n, fine).alias("f"), residual(F.col("a"), n, coarse).alias("c"))
    d = d.select("img_id", variance(F.col("f")).alias("vf"), variance(F.col("c")).alias("vc"))
    return d.select("img_id", F.when(F.col("vc") < 1e-10, 1.0).otherwise(F.least(F.lit(50.0), F.greatest(F.lit(0.0), F.col("vf") / F.col("vc")))).alias("noise_ms_ratio"))


def histogram_entropy(plots: DataFrame) -> DataFrame:
    """``img_id, entropy, n``: entropy in bits of an image's levels.  Levels are counted in the tasks before they are dealt out."""
    counts = plots.select("img_id", F.explode_outer("a").alias("v")).groupBy("img_id", "v").agg(F.count("v").alias("n"))
    g = counts.groupBy("img_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2(F.col("n").cast("double")))).alias("w"))
    return g.select("img_id", F.when(F.col("n") > 0, F.log2(F.col("n").cast("double")) - F.col("w") / F.col("n")).otherwise(0.0).alias("entropy"), "n")


def _spread(a: Column) -> Column:
    """Size, mean and variance of an array; zeros if it is empty or null."""
    some = lambda x: F.when(F.size(x) > 0, F.struct(F.size(x).alias("n"), mean(x).alias("mean"), variance(x).alias("variance")))
    none = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("variance"))
    return F.coalesce(let(a, some), none)


def boundary_features(plots: DataFrame, width: int = 32) -> DataFrame:
    """``img_id`` with the two ratios of steps across block boundaries, of rasters of whole rows; all within a row."""
    whole = (F.floor(F.size("a") / width) * width).cast("int")
    a = F.when(whole > 0, F.transform(F.slice("a", F.lit(1), whole), lambda v: v.cast("double")))

    def steps(x: Column, far: int) -> Column:
        left = F.greatest(F.size(x) - far, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), left), F.slice(x, F.lit(1 + far), left), lambda p, q: F.abs(q - p))

    d = plots.select("img_id", a.alias("a")).select("img_id", steps(F.col("a"), 1).alias("dx"), steps(F.col("a"), width).alias("dy"))
    part = lambda c, cond: _spread(F.filter(c, cond))
    g = d.select(
        "img_id",
        part("dx", lambda v, i: (i % 8 == 7) & (i % width != width - 1)).alias("hb"), part("dx", lambda v, i: i % 8 != 7).alias("hi"),
        part("dy", lambda v, i: F.floor(i / width) % 8 == 7).alias("vb"), part("dy", lambda v, i: F.floor(i / width) % 8 != 7).alias("vi"),
    )
    at_edge, within = (F.col("hb.mean") + F.col("vb.mean")) / 2, (F.col("hi.mean") + F.col("vi.mean")) / 2
    clip = lambda c, top: F.least(F.lit(top), F.greatest(F.lit(0.0), c))
    flat = (F.col("hb.n") < 2) | (F.col("hi.n") < 2) | (F.col("hi.variance") < 1e-10)
    return g.select("img_id", F.when(within < 1e-10, 1.0).otherwise(clip(at_edge / within, 5.0)).alias("dct_boundary_ratio"), F.when(flat, 1.0).otherwise(clip(F.col("hb.variance") / F.col("hi.variance"), 10.0)).alias("dct_boundary_var_ratio"))


def running_variances(samples: np.ndarray, first: np.ndarray, width: int, size: int) -> np.ndarray:
    """Population variance of the size x size blocks that start at ``first``, updated sample by sample in reading order (Welford, 1962).

    SQL's is made in the same way, so that the last bits are those of SQL over
    samples in this order.
    """
    m, squares = np.zeros(len(first)), np.zeros(len(first))
    for k in range(size * size):
        v = samples[first + k // size * width + k % size].astype(np.float64)
        d = v - m
        m += d / (k + 1)
        squares += (v - m) * d
    return squares / (size * size)


#: Samples of rasters whose blocks are summed at once; a larger raster comes alone.
SAMPLES = 1 << 20


def _block_variances(width: int, size: int):
    across = width // size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs = batch.column("a").offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + SAMPLES, side="right")) - 1)
                samples, head = batch.column("a").values.slice(offs[at], offs[to] - offs[at]).to_numpy(zero_copy_only=False), offs[at:to] - offs[at]
                n = np.diff(offs[at : to + 1]) // width // size * across
                ends = np.cumsum(n)
                b = np.arange(ends[-1]) - np.repeat(ends - n, n)
                scaled = running_variances(samples, np.repeat(head, n) + b // across * size * width + b % across * size, width, size) * 1e9
                whole = np.trunc(scaled)
                rounded = (whole + (scaled - whole >= 0.5)) / 1e9
                some = n > 0
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends[some]).astype(np.int32)), pa.array(rounded))
                yield pa.RecordBatch.from_arrays([batch.column("img_id").slice(at, to - at).filter(pa.array(some)), lists], names=["img_id", "variances"])
                at = to

    return run


def block_variances(plots: DataFrame, width: int = 32, size: int = 8) -> DataFrame:
    """``img_id, variances`` of the whole blocks, in order, of images that have any, to nine places.

    A quarter of all blocks of 64 whole gray levels have a variance half-way
    between two numbers of nine places, so its last bits decide, and the median
    splits at ties: blocks are summed as SQL sums them, and rounded as doubles.
    """
    kind = plots.schema["img_id"].dataType.simpleString()
    return plots.select("img_id", "a").mapInArrow(_block_variances(width, size), f"img_id {kind}, variances array<double>")


def block_variance_spread(blocks: DataFrame) -> DataFrame:
    return blocks.select("img_id", F.when(F.size("variances") >= 2, F.sqrt(variance(F.col("variances")))).otherwise(0.0).alias("noise_block_var_std"))


def _exact_mean(a: Column) -> Column:
    """Mean of numbers of nine places, as a decimal of units of 1e-9; null of an empty array.  Differences that lie on a rounding tie stay there."""
    units = F.aggregate(a, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + F.round(x * 1e9).cast("decimal(20,0)")).cast("decimal(38,0)"))
    return F.try_divide(units, F.size(a).cast("decimal(10,0)"))


def texture_split(blocks: DataFrame, least: int = 4) -> DataFrame:
    """``img_id`` with mean variance of rich (median or more) and poor blocks, and their difference; under ``least`` blocks zeros."""
    def split(v: Column) -> Column:
        at = lambda k: F.element_at(v, k.cast("int"))
        middle = (at(F.floor((F.size(v) + 1) / 2)) + at(F.floor(F.size(v) / 2) + 1)) / 2
        both = lambda m: F.struct(_exact_mean(F.filter(v, lambda x: x >= m)).alias("rich"), F.coalesce(_exact_mean(F.filter(v, lambda x: x < m)), F.lit(0)).alias("poor"))
        return let(middle, both)

    g = blocks.select("img_id", F.size("variances").alias("n"), let(F.array_sort("variances"), split).alias("s"))
    value = lambda c: F.when(F.col("n") >= least, c.cast("double") / 1e9).otherwise(0.0)
    return g.select("img_id", value(F.col("s.rich") - F.col("s.poor")).alias("texture_contrast"), value(F.col("s.rich")).alias("texture_rich_mean"), value(F.col("s.poor")).alias("texture_poor_mean"))


def channel_eigen(plots: DataFrame) -> DataFrame:
    """``img_id`` with the eigenvalues of the covariance of three channels, and their ratios.

    Characters in threes are pixels.  The eigenvalues of a symmetric 3 x 3 matrix
    have a closed form; they are rounded to 4 places, as the ratios of tiny ones
    would only show how sums were ordered.
    """
    n = F.floor(F.size("a") / 3)
    channel = lambda k: centred(F.transform(F.filter("a", lambda v, i: i % 3 == k), lambda v: v.cast("double")))
    whole = plots.select("img_id", n.alias("n"), F.slice("a", F.lit(1), (3 * n).cast("int")).alias("a"))
    d = whole.select("img_id", "n", *(channel(k).alias(x) for k, x in enumerate("rgb")))
    pairs = ("rr", "gg", "bb", "rg", "rb", "gb")
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    c = d.select("img_id", *(F.when(F.col("n") >= 2, product(p[0], p[1]) / (F.col("n") - 1)).otherwise(0.0).alias(p) for p in pairs))
    rr, gg, bb, rg, rb, gb = map(F.col, pairs)
    q = (rr + gg + bb) / 3
    c = c.withColumn("q", q).withColumn("p", F.sqrt((F.pow(rr - q, F.lit(2)) + F.pow(gg - q, F.lit(2)) + F.pow(bb - q, F.lit(2)) + 2 * (rg * rg + rb * rb + gb * gb)) / 6))
    x, y, z = rr - F.col("q"), gg - F.col("q"), bb - F.col("q")
    det = x * (y * z - gb * gb) - rg * (rg * z - gb * rb) + rb * (rg * gb - y * rb)
    c = c.withColumn("phi", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), det / (2 * F.pow("p", F.lit(3)))))) / 3))
    e1 = F.col("q") + 2 * F.col("p") * F.cos("phi")
    e3 = F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2 * math.pi / 3)
    c = c.withColumn("e1", F.round(F.abs(e1), 4)).withColumn("e3", F.round(F.abs(e3), 4)).withColumn("e2", F.round(F.abs(3 * F.col("q") - e1 - e3), 4))
    tiny = 1e-10
    return c.select("img_id", "e1", "e2", "e3", (F.col("e1") / (F.col("e2") + tiny)).alias("eig_ratio_1_2"), (F.col("e2") / (F.col("e3") + tiny)).alias("eig_ratio_2_3"), (F.col("e1") / (F.col("e3") + tiny)).alias("eig_condition_number"), (F.col("e1") / (F.col("e1") + F.col("e2") + F.col("e3") + tiny)).alias("eig_dominance"))
