"""Queries over the driver's tables, each with an equivalent SQL text where SQL can express it.

Rasters are made from the tables: vectors become 8 x 8 tiles, four of them a
16 x 16 mosaic, the characters of a whole text a byte plot.  Floats are rounded
to six places after a nudge of 1e-7, as sums over whole gray levels often lie on
a rounding tie, which the order of summation would decide; the nudge also leaves
no -0.0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions import scores
from ..functions.kernels import gaussian, zigzag_order
from ..operators import evaluate, model, prep, raster
from ..sources import images

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    return df.select(*keys, *(F.round(F.col(c) + 1e-7, places).alias(c) for c in df.columns if c not in keys))


def r6(*pairs: str) -> str:
    """SQL: each "expression AS name" rounded."""
    return ", ".join(f"round(({e}) + 1e-7, 6) AS {n}" for e, n in (p.rsplit(" AS ", 1) for p in pairs))


# ---------------------------------------------------------------- rasters in SQL

LEVEL = "least(255.0, greatest(0.0, floor(128 + 256 * embedding[i + 1]::DOUBLE)))"
TILES = f"tiles AS (SELECT vec_id AS img_id, i // 8 AS y, i % 8 AS x, {LEVEL} AS v FROM embeddings, range(64) t(i))"
MOSAIC = f"px AS (SELECT vec_id // 4 AS img_id, 8 * (vec_id % 4 // 2) + i // 8 AS y, 8 * (vec_id % 2) + i % 8 AS x, {LEVEL} AS v FROM embeddings, range(64) t(i))"
PLOT = "chars AS (SELECT doc_id AS img_id, unnest(range(length(coalesce(text, '')))) AS i, unnest(list_transform(string_split(text, ''), lambda c: unicode(c) % 256))::DOUBLE AS v FROM documents WHERE length(text) > 0)"
ROWS = "px AS (SELECT img_id, i // 32 AS y, i % 32 AS x, v, max(i) OVER (PARTITION BY img_id) + 1 AS n FROM chars)"


def mirrored(expr: str, n: int) -> str:
    p = f"(abs({expr}) % {2 * n - 2})"
    return f"CASE WHEN {p} < {n} THEN {p} ELSE {2 * n - 2} - {p} END"


def blurred(source: str, n: int, sigma: float, name: str) -> str:
    """SQL: ``name`` is ``source`` (img_id, y, x, v) less its blur."""
    taps = ", ".join(f"({k - len(gaussian(sigma)) // 2}, {float(w)!r}::DOUBLE)" for k, w in enumerate(gaussian(sigma)))
    return f"""{name}_t(d, w) AS (VALUES {taps}),
{name}_h AS (SELECT a.img_id, a.y, a.x, sum(b.v * w) AS v FROM {source} a CROSS JOIN {name}_t JOIN {source} b ON b.img_id = a.img_id AND b.y = a.y AND b.x = {mirrored('a.x + d', n)} GROUP BY ALL),
{name}_v AS (SELECT a.img_id, a.y, a.x, sum(b.v * w) AS v FROM {name}_h a CROSS JOIN {name}_t JOIN {name}_h b ON b.img_id = a.img_id AND b.x = a.x AND b.y = {mirrored('a.y + d', n)} GROUP BY ALL),
{name} AS (SELECT s.img_id, s.y, s.x, s.v - b.v AS v FROM {source} s JOIN {name}_v b USING (img_id, y, x))"""


def spectrum(source: str, n: int) -> str:
    c = lambda k: f"((({k} + {n // 2}) % {n}) - {n // 2})"
    return f"""sp_r AS (SELECT img_id, y, k AS kx, sum(v * cos(2 * pi() * (k * x % {n}) / {n})) AS re, -sum(v * sin(2 * pi() * (k * x % {n}) / {n})) AS im FROM {source}, range({n}) t(k) GROUP BY ALL),
sp_c AS (SELECT img_id, k AS ky, kx, sum(re * cos(2 * pi() * (k * y % {n}) / {n}) + im * sin(2 * pi() * (k * y % {n}) / {n})) AS re, sum(im * cos(2 * pi() * (k * y % {n}) / {n}) - re * sin(2 * pi() * (k * y % {n}) / {n})) AS im FROM sp_r, range({n}) t(k) GROUP BY ALL),
sp AS (SELECT img_id, ky, kx, sqrt(re * re + im * im) AS m, sqrt({c('ky')} * {c('ky')} + {c('kx')} * {c('kx')}) AS r FROM sp_c)"""


def central(v: str) -> str:
    return f"avg({v}) AS m1, avg({v} * {v}) AS m2, avg(power({v}, 3)) AS m3, avg(power({v}, 4)) AS m4"


VAR, SKEW = "(m2 - m1 * m1)", "(m3 - 3 * m1 * m2 + 2 * power(m1, 3))"

# ---------------------------------------------------------------- spectra, blocks, filters

BASIS = "cos((2 * {x} + 1) * {k} * pi() / 16) * (CASE WHEN {k} = 0 THEN sqrt(1 / 8) ELSE 0.5 END)"
ZIG = ", ".join(f"({p // 8}, {p % 8}, {k})" for k, p in enumerate(zigzag_order().tolist()))


@query(f"""WITH {TILES}, zig(u, w, z) AS (VALUES {ZIG}),
dct_r AS (SELECT img_id AS blk, y, k AS w, sum(v * {BASIS.format(x='x', k='k')}) AS c FROM tiles, range(8) t(k) GROUP BY ALL),
coef AS (SELECT blk, blk // 4 AS img_id, k AS u, w, sum(c * {BASIS.format(x='y', k='k')}) AS c FROM dct_r, range(8) t(k) GROUP BY ALL),
g AS (SELECT img_id, sum(c * c) AS t, coalesce(sum(c * c) FILTER (u = 0 AND w = 0), 0) AS d, coalesce(sum(c * c) FILTER (u >= 4 AND w >= 4), 0) AS h, kurtosis_pop(c) FILTER (u + w > 0) AS k,
 var_pop(CASE WHEN u + w > 0 THEN c ELSE 0 END) AS v, var_pop(c) FILTER (u + w = 0) AS dv, sum(c * c) FILTER (z < 16) AS a, sum(c * c) FILTER (z >= 48) AS b FROM coef JOIN zig USING (u, w) GROUP BY img_id)
SELECT img_id, {r6('CASE WHEN t >= 1e-10 THEN 1 - d / t ELSE 0 END AS dct_ac_energy_ratio', 'CASE WHEN t >= 1e-10 THEN h / t ELSE 0 END AS dct_high_freq_energy', 'coalesce(k, 0) AS dct_coeff_kurtosis', 'v AS dct_coeff_variance', 'dv AS dct_dc_variance', 'CASE WHEN a >= 1e-10 THEN b / a ELSE 0 END AS dct_zigzag_decay')} FROM g""")
def tile_dct_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = raster.tiles(table(spark, sf_dir, "embeddings")).select((F.col("img_id") / 4).cast("long").alias("img_id"), raster.dct(F.col("a")).alias("c"))
    return rounded(raster.dct_features(blocks), "img_id")


flagship = tile_dct_features


@query(f"WITH {MOSAIC}, {spectrum('px', 16)} SELECT img_id, ky::INT AS ky, kx::INT AS kx, {r6('ln(1 + m) AS log_magnitude')} FROM sp")
def tile_power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = raster.spectrum(raster.mosaics(table(spark, sf_dir, "embeddings")), 16)
    return rounded(sp.select("img_id", "ky", "kx", F.log1p("magnitude").alias("log_magnitude")), "img_id", "ky", "kx")


@query(f"WITH {MOSAIC}, {spectrum('px', 16)} SELECT img_id, floor(r)::INT AS radius, {r6('avg(ln(1 + m)) AS mean_logmag')} FROM sp WHERE floor(r) < 8 GROUP BY img_id, floor(r)")
def tile_radial_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.radial_profile(raster.spectrum(raster.mosaics(table(spark, sf_dir, "embeddings")), 16), 16), "img_id", "radius")


@query(f"""WITH {MOSAIC}, {spectrum('px', 16)}, pr AS (SELECT img_id, floor(r) AS r, avg(ln(1 + m)) AS p FROM sp WHERE floor(r) < 8 GROUP BY ALL),
g AS (SELECT img_id, count(*) FILTER (r >= 1 AND p > 0) AS n, regr_slope(ln(p), ln(r)) FILTER (r >= 1 AND p > 0) AS s, regr_r2(ln(p), ln(r)) FILTER (r >= 1 AND p > 0) AS r2, var_pop(ln(p)) FILTER (r >= 1 AND p > 0) AS vy,
 sum(p) AS t, sum(p) FILTER (r >= 4) AS u, avg(p) FILTER (r >= 6) AS f, avg(p) FILTER (r BETWEEN 2 AND 3) AS e FROM pr GROUP BY img_id)
SELECT img_id, {r6('CASE WHEN n >= 5 THEN s ELSE 0 END AS spectral_slope', 'CASE WHEN n >= 5 AND vy > 0 THEN r2 ELSE 0 END AS slope_r_squared', 'coalesce(u / nullif(t, 0), 0) AS high_freq_ratio', 'coalesce(f / nullif(e, 0), 0) AS spectral_falloff')} FROM g""")
def tile_spectral_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = raster.radial_profile(raster.spectrum(raster.mosaics(table(spark, sf_dir, "embeddings")), 16), 16)
    return rounded(raster.profile_features(profile, 16), "img_id")


@query(f"""WITH {MOSAIC}, {spectrum('px', 16)}, g AS (SELECT img_id, sum(m) + 1e-10 AS t, coalesce(sum(m) FILTER (r < 0.33 * 8), 0) AS l, coalesce(sum(m) FILTER (r >= 0.33 * 8 AND r < 0.66 * 8), 0) AS d, coalesce(sum(m) FILTER (r >= 0.66 * 8 AND r <= 8), 0) AS h FROM sp GROUP BY img_id)
SELECT img_id, {r6('l / t AS band_low_ratio', 'd / t AS band_mid_ratio', 'h / t AS band_high_ratio', '(d + h) / t AS band_mid_high_ratio')} FROM g""")
def tile_band_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.band_ratios(raster.spectrum(raster.mosaics(table(spark, sf_dir, "embeddings")), 16), 16), "img_id")


_N = ", ".join(f"max(b.v) FILTER (dy = {dy} AND dx = {dx}) AS p{dy + 1}{dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
NEAR = f"""near AS (SELECT a.img_id, a.y, a.x, {_N} FROM tiles a CROSS JOIN (SELECT d1.d AS dy, d2.d AS dx FROM (VALUES (-1), (0), (1)) d1(d), (VALUES (-1), (0), (1)) d2(d)) s
JOIN tiles b ON b.img_id = a.img_id AND b.y = {mirrored('a.y + dy', 8)} AND b.x = {mirrored('a.x + dx', 8)} GROUP BY ALL),
edge AS (SELECT img_id, sqrt(power(p02 + 2 * p12 + p22 - p00 - 2 * p10 - p20, 2) + power(p20 + 2 * p21 + p22 - p00 - 2 * p01 - p02, 2)) AS g, abs(2 * (p00 + p02 + p20 + p22) - 8 * p11) AS l FROM near)"""


@query(f"""WITH {TILES}, {NEAR} SELECT img_id, {r6('avg(g) AS gradient_mean', 'var_pop(g) AS gradient_variance', 'coalesce(CASE WHEN isfinite(kurtosis_pop(g)) THEN kurtosis_pop(g) END, 0) AS gradient_kurtosis')} FROM edge GROUP BY img_id""")
def tile_sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.gradient_features(raster.tiles(table(spark, sf_dir, "embeddings"))).select("img_id", "gradient_mean", "gradient_variance", "gradient_kurtosis"), "img_id")


@query(f"WITH {TILES}, {NEAR} SELECT img_id, {r6('avg(l) AS gradient_laplacian_mean', 'var_pop(l) AS gradient_laplacian_variance')} FROM edge GROUP BY img_id")
def tile_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.gradient_features(raster.tiles(table(spark, sf_dir, "embeddings"))).select("img_id", "gradient_laplacian_mean", "gradient_laplacian_variance"), "img_id")


@query(f"""WITH {TILES}, {blurred('tiles', 8, 1.0, 'e')}, c AS (SELECT e.*, v - avg(v) OVER (PARTITION BY img_id) AS d FROM e)
SELECT img_id, {r6('avg(d * d) AS noise_variance', 'CASE WHEN sqrt(avg(d * d)) < 1e-10 THEN 0 ELSE avg(power(d, 4)) / power(avg(d * d), 2) - 3 END AS noise_kurtosis', 'CASE WHEN sqrt(avg(d * d)) < 1e-10 THEN 0 ELSE avg(power(d, 3)) / power(avg(d * d), 1.5) END AS noise_skewness')} FROM c GROUP BY img_id""")
def tile_gaussian_residual_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.noise_features(raster.tiles(table(spark, sf_dir, "embeddings"))).drop("noise_autocorrelation"), "img_id")


@query(f"""WITH {TILES}, {blurred('tiles', 8, 1.0, 'e')},
h AS (SELECT a.img_id, corr(a.v, b.v) AS c, stddev_pop(a.v) AS s, stddev_pop(b.v) AS t FROM e a JOIN e b ON a.img_id = b.img_id AND a.y = b.y AND b.x = a.x + 1 GROUP BY ALL),
w AS (SELECT a.img_id, corr(a.v, b.v) AS c, stddev_pop(a.v) AS s, stddev_pop(b.v) AS t FROM e a JOIN e b ON a.img_id = b.img_id AND a.x = b.x AND b.y = a.y + 1 GROUP BY ALL)
SELECT img_id, {r6('((CASE WHEN h.s < 1e-10 OR h.t < 1e-10 THEN 0 ELSE h.c END) + (CASE WHEN w.s < 1e-10 OR w.t < 1e-10 THEN 0 ELSE w.c END)) / 2 AS noise_autocorrelation')} FROM h JOIN w USING (img_id)""")
def tile_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.noise_features(raster.tiles(table(spark, sf_dir, "embeddings"))).select("img_id", "noise_autocorrelation"), "img_id")


@query(f"""WITH {TILES}, {blurred('tiles', 8, 0.5, 'f')}, {blurred('tiles', 8, 1.0, 'c')}, a AS (SELECT img_id, var_pop(v) AS p FROM f GROUP BY img_id), b AS (SELECT img_id, var_pop(v) AS q FROM c GROUP BY img_id)
SELECT img_id, {r6('CASE WHEN q < 1e-10 THEN 1 ELSE least(50.0, greatest(0.0, p / q)) END AS noise_ms_ratio')} FROM a JOIN b USING (img_id)""")
def tile_multiscale_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.multiscale_ratio(raster.tiles(table(spark, sf_dir, "embeddings"))), "img_id")


@query(f"""WITH {TILES}, {blurred('tiles', 8, 1.0, 'e')}, {spectrum('e', 8)}, w AS (SELECT img_id, m * m AS p FROM sp WHERE m * m > 0), g AS (SELECT img_id, sum(p) AS s, sum(p * log2(p)) AS t, count(*) AS n FROM w GROUP BY img_id)
SELECT img_id, {r6('CASE WHEN s < 1e-10 OR n < 2 THEN 0 ELSE (log2(s) - t / s) / log2(n) END AS spectral_entropy')} FROM g""")
def tile_spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = raster.tiles(table(spark, sf_dir, "embeddings")).select("img_id", F.posexplode(raster.residual(F.col("a"), 8, 1.0)).alias("i", "v"))
    px = t.select("img_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v")
    return rounded(raster.spectral_entropy(raster.spectrum(px, 8)), "img_id")


@query(f"""WITH {PLOT}, px AS (SELECT img_id, i // 3 AS p, max(v) FILTER (i % 3 = 0) AS r, max(v) FILTER (i % 3 = 1) AS g, max(v) FILTER (i % 3 = 2) AS b FROM chars GROUP BY ALL HAVING count(*) = 3),
c AS (SELECT img_id, count(*) AS n, var_samp(r) AS rr, var_samp(g) AS gg, var_samp(b) AS bb, covar_samp(r, g) AS rg, covar_samp(r, b) AS rb, covar_samp(g, b) AS gb FROM px GROUP BY img_id),
z AS (SELECT doc_id AS img_id, coalesce(rr, 0) AS rr, coalesce(gg, 0) AS gg, coalesce(bb, 0) AS bb, coalesce(rg, 0) AS rg, coalesce(rb, 0) AS rb, coalesce(gb, 0) AS gb FROM documents LEFT JOIN c ON doc_id = img_id),
q AS (SELECT *, (rr + gg + bb) / 3 AS q FROM z),
p AS (SELECT *, sqrt((power(rr - q, 2) + power(gg - q, 2) + power(bb - q, 2) + 2 * (rg * rg + rb * rb + gb * gb)) / 6) AS p FROM q),
f AS (SELECT *, CASE WHEN p < 1e-9 THEN 0 ELSE acos(least(1.0, greatest(-1.0, ((rr - q) * ((gg - q) * (bb - q) - gb * gb) - rg * (rg * (bb - q) - gb * rb) + rb * (rg * gb - (gg - q) * rb)) / (2 * power(p, 3))))) / 3 END AS phi FROM p),
e AS (SELECT img_id, q, q + 2 * p * cos(phi) AS a, q + 2 * p * cos(phi + 2 * pi() / 3) AS c FROM f),
v AS (SELECT img_id, round(abs(a), 4) AS e1, round(abs(3 * q - a - c), 4) AS e2, round(abs(c), 4) AS e3 FROM e)
SELECT img_id, round(e1 + 1e-5, 3) AS e1, round(e2 + 1e-5, 3) AS e2, round(e3 + 1e-5, 3) AS e3, round(e1 / (e1 + e2 + e3 + 1e-10) + 1e-7, 5) AS eig_dominance FROM v""")
def channel_cov_eigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raster.channel_eigen(raster.byteplot(table(spark, sf_dir, "documents")))
    return e.select("img_id", *(F.round(F.col(c) + 1e-5, 3).alias(c) for c in ("e1", "e2", "e3")), F.round(F.col("eig_dominance") + 1e-7, 5).alias("eig_dominance"))


@query(f"""WITH {PLOT}, h AS (SELECT img_id, v, count(*) AS n FROM chars GROUP BY ALL), g AS (SELECT img_id, sum(n) AS n, sum(n * log2(n)) AS w FROM h GROUP BY img_id)
SELECT doc_id AS img_id, {r6('CASE WHEN n > 0 THEN log2(n) - w / n ELSE 0 END AS entropy')}, coalesce(n, 0)::BIGINT AS n FROM documents LEFT JOIN g ON doc_id = img_id""")
def plot_hist_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.histogram_entropy(raster.byteplot(table(spark, sf_dir, "documents"))), "img_id", "n")


@query(f"""WITH {PLOT}, {ROWS}, w AS (SELECT * FROM px WHERE y < n // 32),
h AS (SELECT a.img_id, a.x % 8 = 7 AS e, abs(b.v - a.v) AS d FROM w a JOIN w b ON a.img_id = b.img_id AND a.y = b.y AND b.x = a.x + 1),
k AS (SELECT a.img_id, a.y % 8 = 7 AS e, abs(b.v - a.v) AS d FROM w a JOIN w b ON a.img_id = b.img_id AND a.x = b.x AND b.y = a.y + 1),
hg AS (SELECT img_id, avg(d) FILTER (e) AS hb, avg(d) FILTER (NOT e) AS hi, var_pop(d) FILTER (e) AS v1, var_pop(d) FILTER (NOT e) AS v2, count(*) FILTER (e) AS n1, count(*) FILTER (NOT e) AS n2 FROM h GROUP BY img_id),
kg AS (SELECT img_id, avg(d) FILTER (e) AS vb, avg(d) FILTER (NOT e) AS vi FROM k GROUP BY img_id),
j AS (SELECT doc_id AS img_id, (coalesce(hb, 0) + coalesce(vb, 0)) / 2 AS b, (coalesce(hi, 0) + coalesce(vi, 0)) / 2 AS i, coalesce(v1, 0) AS v1, coalesce(v2, 0) AS v2, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM documents LEFT JOIN hg ON hg.img_id = doc_id LEFT JOIN kg ON kg.img_id = doc_id)
SELECT img_id, {r6('CASE WHEN i < 1e-10 THEN 1 ELSE least(5.0, greatest(0.0, b / i)) END AS dct_boundary_ratio', 'CASE WHEN n1 < 2 OR n2 < 2 OR v2 < 1e-10 THEN 1 ELSE least(10.0, greatest(0.0, v1 / v2)) END AS dct_boundary_var_ratio')} FROM j""")
def plot_boundary_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.boundary_features(raster.byteplot(table(spark, sf_dir, "documents"))), "img_id")


BLOCKS = "b AS (SELECT img_id, y // 8 AS by, x // 8 AS bx, round(var_pop(v), 9) AS variance FROM px WHERE y < n // 32 // 8 * 8 GROUP BY ALL)"


@query(f"WITH {PLOT}, {ROWS}, {BLOCKS} SELECT img_id, {r6('CASE WHEN count(*) >= 2 THEN stddev_pop(variance) ELSE 0 END AS noise_block_var_std')} FROM b GROUP BY img_id")
def plot_block_var_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.block_variance_spread(raster.block_variances(raster.byteplot(table(spark, sf_dir, "documents")))), "img_id")


@query(f"""WITH {PLOT}, {ROWS}, {BLOCKS}, m AS (SELECT *, median(variance) OVER (PARTITION BY img_id) AS m FROM b),
g AS (SELECT img_id, count(*) AS n, avg(variance) FILTER (variance >= m) AS r, coalesce(avg(variance) FILTER (variance < m), 0) AS p FROM m GROUP BY img_id)
SELECT img_id, {r6('CASE WHEN n >= 4 THEN r - p ELSE 0 END AS texture_contrast', 'CASE WHEN n >= 4 THEN r ELSE 0 END AS texture_rich_mean', 'CASE WHEN n >= 4 THEN p ELSE 0 END AS texture_poor_mean')} FROM g""")
def plot_texture_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.texture_split(raster.block_variances(raster.byteplot(table(spark, sf_dir, "documents")))), "img_id")


# ---------------------------------------------------------------- scores and decisions

#: Stand-ins for measured features, spread over the parts by key.
STAND_INS = {
    "spectral_slope": "-(k * 37 % 1009) / 251", "high_freq_ratio": "(k * 41 % 1009) / 1013", "spectral_falloff": "(k * 43 % 1009) / 811", "eig_dominance": "(k * 47 % 1009) / 1013",
    "patch_ratio_std": "(k * 53 % 1009) / 61", "band_high_ratio": "(k * 59 % 1009) / 2503", "eig_condition_number": "(k * 61 % 1009) / 3 + 0.5", "noise_spectral_entropy": "(k * 71 % 1009) / 1013",
    "noise_autocorrelation": "(k * 73 % 1009) / 1013 - 0.5", "noise_block_var_std": "(k * 79 % 1009) / 23", "dct_coeff_kurtosis": "(k * 83 % 1009) / 37", "dct_zigzag_decay": "(k * 89 % 1009) / 4001",
    "dct_high_freq_energy": "(k * 97 % 1009) / 15013", "ela_mean": "(k * 101 % 1009) / 53", "ela_uniformity": "(k * 103 % 1009) / 1013", "ela_block_inconsistency": "(k * 107 % 1009) / 151",
    "gradient_kurtosis": "(k * 109 % 1009) / 53", "gradient_variance": "(k * 113 % 1009) / 0.23", "gradient_laplacian_mean": "(k * 127 % 1009) / 19", "texture_contrast": "(k * 131 % 1009) / 2.3",
    "screen_noise_variance": "(k * 137 % 1009) / 151", "screen_entropy": "(k * 139 % 1009) / 127",
    "meta_camera_tags": "greatest(0, k * 7 % 15 - 4)", "meta_has_gps": "CASE WHEN k % 6 = 1 THEN 1 ELSE 0 END", "meta_has_timestamps": "CASE WHEN k % 5 IN (1, 2) THEN 1 ELSE 0 END", "meta_has_software": "CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END",
}


def _stand_ins(double: str) -> str:
    return ", ".join(f"CAST({e} AS {double}) AS {n}" for n, e in STAND_INS.items())


_WIDTH, _HEIGHT = "CAST(300 + k * 37 % 4001 AS INT) AS width", "CAST(200 + k * 61 % 2503 AS INT) AS height"
_PATH = "CASE WHEN k % 3 = 0 THEN concat('img_', k, '.PNG') ELSE concat('img_', k, '.jpg') END AS path"
FEATS = f"f0 AS (SELECT k_int AS img_id, {_stand_ins('DOUBLE')}, {_WIDTH}, {_HEIGHT}, {_PATH} FROM (SELECT p_partkey AS k_int, p_partkey AS k FROM part)), f AS (SELECT *, CAST(meta_camera_tags > 0 AS INT)::DOUBLE AS meta_has_camera, meta_camera_tags + meta_has_gps + meta_has_timestamps + meta_has_software AS meta_tag_count FROM f0)"


def stand_in_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    f = part.selectExpr("k AS img_id", *(f"CAST(CAST({e} AS DOUBLE) AS DOUBLE) AS {n}" for n, e in STAND_INS.items()), _WIDTH, _HEIGHT, _PATH)
    return f.withColumn("meta_has_camera", (F.col("meta_camera_tags") > 0).cast("int").cast("double")).withColumn("meta_tag_count", F.col("meta_camera_tags") + F.col("meta_has_gps") + F.col("meta_has_timestamps") + F.col("meta_has_software"))


def _clip(e: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"least(greatest({e}, {low}), {high})"


_PNG = "lower(path) LIKE '%.png'"
SCORE_SQL = {
    "fft_score": f"0.40 * {_clip('(-spectral_slope - 1) / 2')} + 0.35 * {_clip('1 - high_freq_ratio / 0.5')} + 0.25 * {_clip('1 - spectral_falloff')}",
    "eigenvalue_score": f"0.2 * {_clip('abs(eig_dominance - 0.65) / 0.35')} + 0.3 * {_clip('1 - patch_ratio_std / 10')} + 0.3 * {_clip('1 - band_high_ratio / 0.3')} + 0.2 * {_clip('(ln(1 + eig_condition_number) - 3) / 5')}",
    "metadata_score": _clip(f"0.5 - (CASE WHEN meta_has_camera > 0 THEN 0.3 + least(meta_camera_tags * 0.03, 0.15) ELSE 0 END) - 0.1 * meta_has_gps - 0.05 * meta_has_timestamps + (CASE WHEN meta_tag_count > 0 THEN 0 WHEN {_PNG} THEN 0.15 ELSE 0.35 END) + (CASE WHEN meta_has_software > 0 AND meta_has_camera = 0 THEN 0.15 ELSE 0 END)"),
    "noise_score": "0.35 * greatest(0, 1 - noise_spectral_entropy) + 0.35 * least(1, 2 * abs(noise_autocorrelation)) + 0.30 * greatest(0, 1 - least(1, noise_block_var_std / 30))",
    "dct_score": "0.40 * greatest(0, 1 - least(1, dct_coeff_kurtosis / 20)) + 0.30 * least(1, 5 * dct_zigzag_decay) + 0.30 * greatest(0, 1 - least(1, dct_high_freq_energy / 0.05))",
    "ela_score": f"(CASE WHEN {_PNG} THEN 0.3 * least(1, ela_mean / 20) ELSE 0.5 * least(1, ela_mean / 10) END) + 0.3 * ela_uniformity + 0.2 * greatest(0, 1 - least(1, ela_block_inconsistency / 5))",
    "gradient_score": f"0.50 * {_clip('1 - gradient_kurtosis / 15')} + 0.30 * {_clip('1 - gradient_variance / 3000')} + 0.20 * {_clip('1 - gradient_laplacian_mean / 40')}",
    "patchcraft_score": _clip("texture_contrast / 300"),
}
SCORED = f"{FEATS}, s AS (SELECT *, {', '.join(f'{_clip(e)} AS {n}' for n, e in SCORE_SQL.items())} FROM f)"
_TOTAL = " + ".join(f"{w} * {n}" for n, w in S.WEIGHTS.items())


def _score_query(name: str) -> None:
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(stand_in_features(spark, sf_dir).select("img_id", scores.all_scores()[name].alias(name)), "img_id")

    QUERIES[f"score_{name.removesuffix('_score')}"] = one
    ORACLES[f"score_{name.removesuffix('_score')}"] = f"WITH {SCORED} SELECT img_id, {r6(f'{name} AS {name}')} FROM s"


for _name in SCORE_SQL:
    _score_query(_name)


@query(f"WITH {SCORED}, t AS (SELECT img_id, {_TOTAL} AS w FROM s) SELECT img_id, {r6('w AS weighted_score', 'least(greatest(0.5 + abs(w - 0.5) * 2, 0.5), 1.0) AS confidence')}, CASE WHEN w > 0.5 THEN 'AI-Generated' ELSE 'Real' END AS label FROM t")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stand_in_features(spark, sf_dir).withColumns(scores.all_scores())
    w = scores.weighted_score()
    return rounded(s.select("img_id", scores.vote_label(w).alias("label"), w.alias("weighted_score"), scores.vote_confidence(w).alias("confidence")), "img_id", "label")


def _explanation_sql() -> str:
    q = lambda t: "'" + t.replace("'", "''") + "'"
    lines = ["'Classification: ' || label || ' (method: voting)'", "''", "'Individual Analysis Scores (0=Real, 1=AI):'"]
    lines += [f"'  {n}: ' || printf('%.3f', {n}) || CASE WHEN {n} > 0.6 THEN ' → likely AI' WHEN {n} < 0.4 THEN ' → likely Real' ELSE ' → uncertain' END" for n in S.WEIGHTS]
    lines += ["''", *(f"CASE WHEN {n} > 0.6 THEN {q(a)} WHEN {n} < 0.4 THEN {q(b)} END" for n, (a, b) in scores.INSIGHTS.items())]
    return f"WITH {SCORED}, t AS (SELECT *, CASE WHEN {_TOTAL} > 0.5 THEN 'AI-Generated' ELSE 'Real' END AS label FROM s) SELECT img_id, concat_ws(chr(10), {', '.join(lines)}) AS explanation FROM t"


@query(_explanation_sql())
def explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stand_in_features(spark, sf_dir).withColumns(scores.all_scores())
    return s.select("img_id", scores.explanation(scores.vote_label(scores.weighted_score()), F.lit("voting")).alias("explanation"))


_SCREEN = f"(len(list_filter([{', '.join(map(str, S.SCREEN_WIDTHS))}], lambda s: abs(width - s) / s <= 0.04 OR abs(height - s) / s <= 0.04)) > 0 OR len(list_filter([{', '.join(f'{r!r}::DOUBLE' for r in S.SCREEN_RATIOS)}], lambda r: abs(width / height - r) / r < 0.03)) > 0)"


@query(f"WITH {FEATS} SELECT img_id, width, height, {_SCREEN} AS matches FROM f")
def screen_resolution_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in_features(spark, sf_dir).select("img_id", "width", "height", scores.matches_screen(F.col("width"), F.col("height")).alias("matches"))


@query(f"""WITH {FEATS}, h AS (SELECT *, screen_noise_variance < 3 AS h1, screen_entropy < 6.8 AS h2, {_SCREEN} AS h3 FROM f),
c AS (SELECT *, h1::INT + h2::INT + h3::INT AS n, (CASE WHEN h1 THEN {_clip('1 - screen_noise_variance / 3')} ELSE 0 END) + (CASE WHEN h2 THEN {_clip('1 - screen_entropy / 6.8')} ELSE 0 END) + (CASE WHEN h3 THEN 0.5 ELSE 0 END) AS t FROM h)
SELECT img_id, n >= 2 AS is_screenshot, {r6(f'CASE WHEN n >= 2 THEN {_clip("t / n")} WHEN n = 1 THEN {_clip("t * 0.3")} ELSE 0 END AS confidence')},
 concat_ws('; ', CASE WHEN h1 THEN printf('H1: Near-zero sensor noise (variance=%.2f < 3.0)', screen_noise_variance) END, CASE WHEN h2 THEN printf('H2: Low pixel histogram entropy (%.2f < 6.8)', screen_entropy) END, CASE WHEN h3 THEN 'H3: Dimensions ' || width || '×' || height || ' match common screen resolution or aspect ratio' END) AS reasons FROM c""")
def screenshot_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stand_in_features(spark, sf_dir).withColumn("s", scores.screenshot(F.col("screen_noise_variance"), F.col("screen_entropy"), F.col("width"), F.col("height")))
    return s.select("img_id", "s.is_screenshot", F.round(F.col("s.confidence") + 1e-7, 6).alias("confidence"), F.concat_ws("; ", "s.reasons").alias("reasons"))


TAGS = (*S.CAMERA_TAGS, *S.SOFTWARE_TAGS, *S.CONTEXT_TAGS, "Orientation", "XResolution", "ColorSpace")
_TAG_LIST = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"
_IN = lambda g: "(" + ", ".join(f"'{t}'" for t in g) + ")"
EXIF = f"""t AS (SELECT DISTINCT user_id, {_TAG_LIST}[event_id % {len(TAGS)} + 1] AS tag FROM events WHERE event_type = 'click'),
u AS (SELECT DISTINCT user_id FROM events),
a AS (SELECT u.user_id, count(tag) AS tag_count, count(tag) FILTER (tag IN {_IN(S.CAMERA_TAGS)}) AS n_camera, count(tag) FILTER (tag = 'GPSInfo') > 0 AS has_gps, count(tag) FILTER (tag IN {_IN(S.CONTEXT_TAGS)}) > 0 AS has_timestamps, count(tag) FILTER (tag IN {_IN(S.SOFTWARE_TAGS)}) > 0 AS has_software,
 coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (tag IN {_IN(S.CAMERA_TAGS)}), '') AS camera_tags FROM u LEFT JOIN t ON t.user_id = u.user_id GROUP BY u.user_id)"""


def _tag_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of tags for each user: the tags that the user's clicks stand for."""
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("event_id") % len(TAGS) + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "click", tag).alias("tag"))
    names = e.groupBy("user_id").agg(F.collect_set("tag").alias("names"))  # no more than there are tags
    return names.select("user_id", F.map_from_arrays("names", "names").alias("tags"))


@query(f"WITH {EXIF} SELECT user_id, tag_count, n_camera, n_camera > 0 AS has_camera_data, has_gps, has_timestamps, has_software, camera_tags FROM a")
def exif_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _tag_maps(spark, sf_dir).withColumn("a", scores.analyze_tags(F.col("tags")))
    return a.select("user_id", F.col("a.tag_count").cast("long").alias("tag_count"), F.size("a.camera_tags_found").cast("long").alias("n_camera"), "a.has_camera_data", "a.has_gps", "a.has_timestamps", "a.has_software", F.concat_ws(",", F.array_sort("a.camera_tags_found")).alias("camera_tags"))


@query(f"""WITH {EXIF}, f AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'a.png' ELSE 'a.jpg' END AS path, tag_count AS meta_tag_count, n_camera AS meta_camera_tags, (n_camera > 0)::INT AS meta_has_camera, has_gps::INT AS meta_has_gps, has_timestamps::INT AS meta_has_timestamps, has_software::INT AS meta_has_software FROM a)
SELECT user_id, {r6(SCORE_SQL['metadata_score'] + ' AS metadata_score')} FROM f""")
def metadata_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _tag_maps(spark, sf_dir).withColumns(scores.metadata_features(scores.analyze_tags(F.col("tags")))).withColumn("path", F.when(F.col("user_id") % 2 == 0, "a.png").otherwise("a.jpg"))
    return rounded(a.select("user_id", scores.metadata_score().alias("metadata_score")), "user_id")


# ---------------------------------------------------------------- labels, splits, evaluation

JUDGED = "j AS (SELECT l.doc_id, quality AS truth, CASE WHEN n_chars % 7 < 5 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 7 < 5, 1).otherwise(0).alias("predicted"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth")).join(d, "doc_id")


@query(f"WITH {JUDGED}, b(label, p) AS (VALUES ('Real', 0), ('AI-Generated', 1)) SELECT label, count(doc_id) AS n FROM b LEFT JOIN j ON predicted = p GROUP BY label")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(judged(spark, sf_dir).select(F.when(F.col("predicted") == 1, S.LABELS[1]).otherwise(S.LABELS[0]).alias("label")))


@query(f"WITH {JUDGED} SELECT truth, predicted, count(*) AS n FROM j GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(judged(spark, sf_dir), "truth")


@query(f"WITH {JUDGED} SELECT {r6('avg((truth = predicted)::INT) AS accuracy')}, count(*) AS n, avg((truth = predicted)::INT) >= 0.7 AS meets_target FROM j")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.accuracy(judged(spark, sf_dir), "truth"), "n", "meets_target")


_REPORT = f"""WITH {JUDGED}, c(y, class) AS (VALUES (0, 'Real'), (1, 'AI-Generated')),
k AS (SELECT class, count(*) FILTER (truth = y AND predicted = y) AS tp, count(*) FILTER (predicted = y) AS pp, count(*) FILTER (truth = y) AS ap FROM j, c GROUP BY class),
p AS (SELECT class, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(ap, 0), 0) AS recall, ap AS support FROM k),
r AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p),
u AS (SELECT class, precision, recall, f1, support FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r)
SELECT class, {r6('precision AS precision', 'recall AS recall', 'f1 AS f1')}, support::BIGINT AS support FROM u"""


@query(_REPORT)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.report(judged(spark, sf_dir), "truth"), "class", "support")


def _fold_sql(k: int) -> str:
    """The folds of k runs in each class; ``c`` has a row's place, its class's rows, and the rows of the classes before."""
    size = lambda i: f"(floor((start + n - 1 - {i}) / {k}) - floor((start - 1 - {i}) / {k}))"
    return " + ".join(f"(place >= {' + '.join(size(j) for j in range(i + 1))})::INT" for i in range(k - 1))


@query(f"""WITH s AS (SELECT quality, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY quality ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM labels GROUP BY quality),
c AS (SELECT l.doc_id, l.quality, row_number() OVER (PARTITION BY l.quality ORDER BY l.doc_id) - 1 AS place, n::DOUBLE AS n, start::DOUBLE AS start FROM labels l JOIN s ON l.quality = s.quality) SELECT doc_id, quality, {_fold_sql(5)} AS fold FROM c""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.stratified_folds(table(spark, sf_dir, "labels"), "quality", "doc_id", 5).select("doc_id", "quality", F.col("fold").cast("int").alias("fold"))


def _holdout_sql(rows: str, label: str, least: int) -> str:
    return f"""WITH l AS ({rows}), m AS (SELECT doc_id, {label}, ((doc_id % 1000003) * 48271 + doc_id // 1000003 * 69621 + 462) % 2147483647 AS mix, count(*) OVER (PARTITION BY {label}) AS n FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY mix, doc_id) AS k FROM m)
SELECT doc_id, {label}, k <= (CASE WHEN n < {least} THEN 0 WHEN n < 10 THEN n // 5 ELSE 10 END) AS is_test FROM r"""


@query(_holdout_sql("SELECT doc_id, quality FROM labels", "quality", 0))
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.holdout(table(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality", "is_test")


def _small_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of some ten rows on the smaller tables."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("class"))


@query(_holdout_sql("SELECT doc_id, n_chars % 97 AS class FROM documents", "class", 0))
def holdout_small_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.holdout(_small_classes(spark, sf_dir), "class", "doc_id")


@query(_holdout_sql("SELECT doc_id, n_chars % 97 AS class FROM documents", "class", 10))
def holdout_at_least_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.holdout(_small_classes(spark, sf_dir), "class", "doc_id", least=10)


@query("SELECT user_id, event_id FROM events WHERE event_id % 33 = 0 AND event_id / 33 < 30")
def frame_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.frame_sample(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


_FILE = "concat(CASE doc_id % 5 WHEN 0 THEN 'Kling_' WHEN 1 THEN 'my-GEMINI-' WHEN 2 THEN 'nano_banana' ELSE 'other' END, lpad(CAST(doc_id AS STRING), 9, '0'), CASE doc_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.txt' ELSE '.webp' END)"
_FILES = f"f AS (SELECT doc_id, source AS dir, n_chars, {_FILE.replace('STRING', 'VARCHAR')} AS name FROM documents)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "source AS dir", "n_chars", f"{_FILE} AS name")


_LABEL = "CASE WHEN lower(name) LIKE '%kling%' THEN 'kling' WHEN lower(name) LIKE '%gemini%' THEN 'gemini' WHEN lower(name) LIKE '%banana%' THEN 'banana' ELSE 'misc' END"


@query(f"WITH {_FILES} SELECT {_LABEL} AS source, count(*) AS n, count(*) FILTER (lower(name) LIKE '%kling%' OR lower(name) LIKE '%gemini%') AS known_video FROM f GROUP BY ALL")
def source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    video = prep.source_label(F.col("name"), "video")
    return f.groupBy(prep.source_label(F.col("name")).alias("source")).agg(F.count("*").alias("n"), F.count(F.when(video != "video", 1)).alias("known_video"))


@query(f"WITH {_FILES}, k AS (SELECT name, {_LABEL} AS source, row_number() OVER (ORDER BY name) AS n FROM f WHERE lower(regexp_extract(name, '\\.[^.]+$')) IN ('.png', '.jpg', '.jpeg', '.webp')) SELECT name, source, 'ai_' || source || '_img_' || printf('%03d', n) || regexp_extract(name, '\\.[^.]+$') AS target FROM k")
def ingest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.ingest_names(_files(spark, sf_dir)).select("name", "source", "target")


@query(f"WITH {_FILES} SELECT doc_id, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext, lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN {_IN(S.EXTENSIONS)} AS is_image, CASE WHEN lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN {_IN(S.UPLOAD_EXTENSIONS)} AND n_chars * 10000 <= 10485760 THEN 200 ELSE 400 END AS http_status FROM f")
def upload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = images.uploads(_files(spark, sf_dir).select("doc_id", F.col("name").alias("path"), (F.col("n_chars") * 10_000).alias("length")))
    ext = images.extension("path")
    return f.select("doc_id", ext.alias("ext"), ext.isin(*S.EXTENSIONS).alias("is_image"), "http_status")


@query("SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, text FROM documents GROUP BY text")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.first_of(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text", "doc_id")


@query(f"""WITH {_FILES}, w AS (SELECT *, CASE WHEN doc_id % 17 = 3 THEN -1 ELSE 100 + doc_id * 29 % 2000 END AS width, CASE WHEN doc_id % 17 = 3 THEN -1 ELSE 100 + doc_id * 31 % 2000 END AS height, CASE WHEN doc_id % 23 = 5 THEN 0 ELSE n_chars END AS length FROM f),
b AS (SELECT *, length = 0 OR width <= 0 AS corrupt FROM w), k AS (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY name) AS r FROM b WHERE corrupt),
g AS (SELECT dir, count(*) AS n, sum(corrupt::INT)::BIGINT AS corrupt, sum((NOT corrupt AND least(width, height) < 512)::INT)::BIGINT AS low_res FROM b GROUP BY dir), x AS (SELECT dir, string_agg(name, ',' ORDER BY name) AS bad FROM k WHERE r <= 5 GROUP BY dir)
SELECT g.dir, n, corrupt, low_res, coalesce(bad, '') AS bad_files, corrupt = 0 AS passed FROM g LEFT JOIN x ON g.dir = x.dir""")
def dataset_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda k: F.when(F.col("doc_id") % 17 == 3, -1).otherwise(100 + F.col("doc_id") * k % 2000)
    f = _files(spark, sf_dir).withColumns({"width": side(29), "height": side(31), "length": F.when(F.col("doc_id") % 23 == 5, 0).otherwise(F.col("n_chars"))})
    return prep.verify(f).select("dir", "n", "corrupt", "low_res", F.concat_ws(",", "bad_files").alias("bad_files"), "passed")


@query("SELECT doc_id, 0 AS label FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, 1 FROM labels WHERE toxic = 1")
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return prep.label_union(d.where("toxic = 0"), d.where("toxic = 1")).select("doc_id", "label")


@query("SELECT doc_id, kind FROM labels, (VALUES ('orig'), ('q70'), ('q80'), ('small')) t(kind)")
def augment_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.augment_fanout(table(spark, sf_dir, "labels").select("doc_id")).select("doc_id", "kind")


_Z = [f"embedding[{k + 1}]::DOUBLE" for k in range(8)]


@query(f"SELECT vec_id, {r6(*(f'({z} - avg({z}) OVER ()) / coalesce(nullif(stddev_pop({z}) OVER (), 0), 1) AS z{k}' for k, z in enumerate(_Z)))} FROM embeddings")
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.element_at("embedding", k + 1).cast("double").alias(f"z{k}") for k in range(8)))
    return rounded(model.standard_scale(e, [f"z{k}" for k in range(8)]), "vec_id")


@query(f"WITH {SCORED}, t AS (SELECT *, {_TOTAL} AS w FROM s) SELECT img_id, CASE WHEN w > 0.5 THEN 'AI-Generated' ELSE 'Real' END AS label, round(100 * least(greatest(0.5 + abs(w - 0.5) * 2, 0.5), 1.0), 1) + 0.0 AS confidence, {', '.join(f'round({n}, 3) + 0.0 AS {n}' for n in S.WEIGHTS)} FROM t")
def json_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response's numbers, read back from its JSON."""
    s = stand_in_features(spark, sf_dir).withColumns({"status": F.lit("ok"), **{n: F.lit(0.0) for n in S.FEATURES if n not in STAND_INS and not n.startswith("meta_")}})
    out = model.response(model.classify(s))
    read = F.from_json("json", "label string, confidence double, scores struct<" + ", ".join(f"{n}: double" for n in S.WEIGHTS) + ">")
    img = F.regexp_extract("path", r"img_(\d+)", 1).cast("long")
    return out.select(img.alias("img_id"), read.alias("r")).select("img_id", "r.label", (F.col("r.confidence") + 0.0).alias("confidence"), *((F.col(f"r.scores.{n}") + 0.0).alias(n) for n in S.WEIGHTS))


# ---------------------------------------------------------------- kernels and models (no SQL twin)


def _gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 vectors as a gray image of 64 x 64; the last one may have fewer rows of tiles."""
    t = raster.tiles(table(spark, sf_dir, "embeddings"))
    g = t.groupBy((F.col("img_id") / 64).cast("long").alias("k")).agg(F.array_sort(F.collect_list(F.struct("img_id", "a"))).alias("t"))  # 64 tiles at most
    rows = F.floor(F.size("t") / 8).cast("int")
    line = lambda i: F.element_at(F.element_at(F.col("t"), (F.floor(i / 512) * 8 + F.floor(i % 64 / 8) + 1).cast("int"))["a"], (F.floor(i % 512 / 64) * 8 + i % 8 + 1).cast("int"))
    hexed = F.concat_ws("", F.transform(F.sequence(F.lit(0), rows * 512 - 1), lambda i: F.lpad(F.hex(line(i).cast("long")), 2, "0")))
    return g.where(rows >= 1).select(F.concat(F.lit("img_"), "k", F.lit(".png")).alias("path"), F.lit(64).alias("width"), (rows * 8).alias("height"), F.lit(1).alias("channels"), F.unhex(hexed).alias("data"), F.lit("ok").alias("status"))


def _kernel_query(groups: tuple[str, ...], augment: bool = False) -> Query:
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..operators.features import extract

        return extract(_gray_images(spark, sf_dir), groups=groups, augment=augment)

    return one


QUERIES["kernel_features"] = _kernel_query(tuple(S.GROUPS))
QUERIES["ela_features"] = _kernel_query(("ela",))
QUERIES["drift_features"] = _kernel_query(("drift",))
QUERIES["jpeg_augment"] = _kernel_query(("dct", "ela"), augment=True)


@query()
def classify_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import extract

    found = extract(_gray_images(spark, sf_dir), groups=tuple(g for g in S.GROUPS if g != "drift"))
    return model.classify(found)


def _svm_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[str, ...]]:
    names = tuple(f"e{k}" for k in range(64))
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("label") < 5).cast("int").alias("label"), *(F.element_at("embedding", k + 1).cast("double").alias(n) for k, n in enumerate(names))), names


@query()
def rbf_svm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _svm_rows(spark, sf_dir)
    return model.with_svm(rows, model.train(rows, names).model).select("vec_id", "label", "margin", "probability", "svm_label")


@query()
def linear_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear machine over Fourier features."""
    rows, names = _svm_rows(spark, sf_dir)
    return model.with_svm(rows, model.train_fourier(rows, names).model).select("vec_id", "label", "margin", "probability", "svm_label")
