"""Every query against its SQL on the smallest tables, and a few closed forms."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veriframe.functions import scores
from veriframe.functions.kernels import Raster, dct_features, gradient_features, zigzag_order
from veriframe.operators import model, prep, raster
from veriframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or x != x else float(x) if isinstance(x, (float, np.floating)) else bool(x) if isinstance(x, (bool, np.bool_)) else int(x) if isinstance(x, (int, np.integer)) else x
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_native_and_kernel_features_agree(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (6, 64)).astype(float)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(a)], "img_id long, a array<double>")
    grad = {r.img_id: r for r in raster.gradient_features(df).collect()}
    dct = {r.img_id: r for r in raster.dct_features(df.select("img_id", raster.dct(df.a).alias("c"))).collect()}
    for k, r in enumerate(a):
        k_raster = Raster(np.repeat(r.reshape(8, 8, 1), 3, 2).astype(np.uint8))
        assert np.allclose(list(grad[k])[1:], gradient_features(k_raster), atol=1e-6)
        assert np.allclose(list(dct[k])[1:], dct_features(k_raster)[:6], atol=1e-6)


def test_zigzag_starts_like_the_standard():
    assert zigzag_order()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_svm_separates_and_scales(spark):
    rng = np.random.default_rng(6)
    pts = rng.normal(size=(80, 2))
    y = (np.hypot(*pts.T) > 1).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(pts, y)], "x double, y double, label int")
    t = model.train(df, ("x", "y"))
    out = model.with_svm(df, t.model).toPandas()
    assert ((out.margin > 0) == (out.label == 1)).mean() > 0.9 and out.probability.between(0, 1).all()
    assert len(t.cv_scores) == 5 and t.cv_pooled > 0.8
    some = model.train(df, ("x", "y"), sample=40)
    assert some.counts == t.counts and len(some.cv_scores) == 5 and some.train_accuracy > 0.8
    wide = model.train_fourier(df.withColumn("image", df.x > 0), ("x", "y"), group="image")
    assert wide.train_accuracy > 0.8 and sum(wide.counts.values()) == 80 and len(wide.cv_scores) <= 2
    assert len(model.train_fourier(df, ("x", "y"), size=64).cv_scores) == 5
    with pytest.raises(ValueError):
        model.train(df.where("label = 0"), ("x", "y"))


def test_splits(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(100)], "id long, y int")
    test = prep.holdout(df, "y", "id").where("is_test").groupBy("y").count().collect()
    assert {r["count"] for r in test} == {10}
    few = prep.holdout(df.where("id < 15"), "y", "id").where("is_test").count()
    assert few == 3
    assert prep.grouped_folds(df, df.y).groupBy("y").agg({"fold": "min"}).count() == 3
    f = prep.frame_sample(df.withColumn("n", df.y * 0 + 60), "y", "id", "n", 30)
    assert f.count() == 30 and f.where("id % 2 = 1").count() == 0


def test_holdout_by_class_size(spark):
    df = spark.createDataFrame([(n * 1000 + k, n) for n in (4, 5, 9, 10, 11, 40) for k in range(n)] + [(7, None)], "id long, y int")
    count = lambda **more: {r.y: r.n for r in prep.holdout(df, "y", "id", **more).groupBy("y").agg(F.sum(F.col("is_test").cast("int")).alias("n")).collect()}
    assert count() == {4: 0, 5: 1, 9: 1, 10: 10, 11: 10, 40: 10, None: 0}
    assert count(least=10) == {4: 0, 5: 0, 9: 0, 10: 10, 11: 10, 40: 10, None: 0}
    assert prep.holdout(df.limit(0), "y", "id").count() == 0


@pytest.mark.parametrize("sizes", [(7, 13), (5, 5), (23, 4), (1, 2, 30)])
def test_folds_are_runs_of_the_classes(spark, sizes):
    """Folds as by dealing the rows, sorted by class, out in turn, and giving each class's rows in order to as many as each fold got."""
    y = [c for c, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(y)], "id long, y int")
    want = {}
    for c in range(len(sizes)):
        own = [k for k, x in enumerate(y) if x == c]
        dealt = [sum(y[j] == c for j in range(i, len(y), 5)) for i in range(5)]
        want |= dict(zip(own, (f for f, n in enumerate(dealt) for _ in range(n)), strict=True))
    assert {r.id: r.fold for r in prep.stratified_folds(df, "y", "id", 5).collect()} == want


def test_ranks_run_over_all_ranges(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 AS id", "CASE WHEN id % 7 < 4 THEN 'a' WHEN id % 7 = 4 THEN NULL ELSE 'b' END AS c")
    for by in ([], ["c"]):
        got = prep.ranked(df, by, ["id"], "r").toPandas().fillna("-")
        assert (got.r == (got.groupby("c") if by else got).id.rank().astype(int) - 1).all() and len(got) == 5000


def test_scores_by_hand(spark):
    """Each score of one image, computed by hand from the formulas."""
    values = {
        "spectral_slope": -2.0, "high_freq_ratio": 0.25, "spectral_falloff": 0.5, "eig_dominance": 0.825, "patch_ratio_std": 5.0, "band_high_ratio": 0.15, "eig_condition_number": float(np.e**4 - 1),
        "noise_spectral_entropy": 0.6, "noise_autocorrelation": -0.2, "noise_block_var_std": 15.0, "dct_coeff_kurtosis": 10.0, "dct_zigzag_decay": 0.1, "dct_high_freq_energy": 0.025,
        "ela_mean": 5.0, "ela_uniformity": 0.5, "ela_block_inconsistency": 2.5, "gradient_kurtosis": 7.5, "gradient_variance": 1500.0, "gradient_laplacian_mean": 20.0, "texture_contrast": 150.0,
        "meta_has_camera": 1.0, "meta_camera_tags": 2.0, "meta_has_gps": 1.0, "meta_has_timestamps": 0.0, "meta_tag_count": 4.0, "meta_has_software": 1.0,
    }
    want = {
        "fft_score": 0.4 * 0.5 + 0.35 * 0.5 + 0.25 * 0.5, "eigenvalue_score": 0.2 * 0.5 + 0.3 * 0.5 + 0.3 * 0.5 + 0.2 * 0.2, "metadata_score": 0.5 - 0.3 - 0.06 - 0.1,
        "noise_score": 0.35 * 0.4 + 0.35 * 0.4 + 0.3 * 0.5, "dct_score": 0.4 * 0.5 + 0.3 * 0.5 + 0.3 * 0.5, "ela_score": 0.5 * 0.5 + 0.3 * 0.5 + 0.2 * 0.5,
        "gradient_score": 0.25 + 0.15 + 0.1, "patchcraft_score": 0.5,
    }
    df = spark.createDataFrame([("a.jpg", *values.values())], "path string, " + ", ".join(f"{n} double" for n in values))
    got = df.select(*(c.alias(n) for n, c in scores.all_scores().items())).first().asDict()
    assert got == pytest.approx(want, abs=1e-9)
    flat = df.withColumn("eig_condition_number", F.lit(0.0)).select(scores.eigenvalue_score()).first()[0]
    assert flat == pytest.approx(0.4)  # ln(1 + 0) lies under 3


def test_ingest_takes_images_and_keeps_suffixes(spark):
    files = spark.createDataFrame([("b Kling.PNG",), ("a.webp",), ("c.txt",), ("d banana.JPeg",), ("e.gif",)], "name string")
    assert {r.name: r.target for r in prep.ingest_names(files).collect()} == {"a.webp": "ai_misc_img_001.webp", "b Kling.PNG": "ai_kling_img_002.PNG", "d banana.JPeg": "ai_banana_img_003.JPeg"}


def test_ingest_numbers_run_on_past_999(spark):
    files = spark.range(1, 1013).selectExpr("concat(CASE WHEN id % 2 = 0 THEN 'f' ELSE 'f_' END, lpad(cast(id AS string), 5, '0'), CASE WHEN id % 3 = 0 THEN '_kling' ELSE '' END, '.png') AS name")
    for by_source in (False, True):
        seen, want = {}, {}
        for name in sorted(r.name for r in files.collect()):
            source = "kling" if "kling" in name else "misc"
            seen[by_source and source] = n = seen.get(by_source and source, 0) + 1
            want[name] = f"ai_{source}_img_{n:03d}.png"
        got = {r.name: r.target for r in prep.ingest_names(files, by_source=by_source).collect()}
        assert got == want and len(set(got.values())) == 1012


def on_texts(spark, tmp_path, name, texts):
    """A query's rows over documents of these texts, and its SQL's."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    return rows(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()), rows(con.execute(catalog.ORACLES[name]).df())


def test_eigenvalues_of_texts_without_a_pixel(spark, tmp_path):
    got, want = on_texts(spark, tmp_path, "channel_cov_eigen", [None, "", "a", "ab", "abc", "abcdef", "abcdefgh"])
    assert len(got) == 7 and got == want


def test_blocks_of_one_variance_split_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(20):  # the same samples in each block, in other orders; 64 of them with a sum of 2 modulo 4
        cells = rng.integers(97, 123, 64)
        cells[0] += (2 - cells.sum()) % 4
        plot = np.stack([rng.permutation(cells) for _ in range(24)]).reshape(6, 4, 8, 8).transpose(0, 2, 1, 3)
        texts.append("".join(map(chr, plot.ravel().tolist())))
    for k, name in enumerate(("plot_texture_split", "plot_block_var_std")):
        got, want = on_texts(spark, tmp_path / str(k), name, [*texts, None, "", "a" * 255, "b" * 256])
        assert len(got) == 21 and got == want


def test_contrast_on_a_rounding_tie(spark):
    blocks = spark.createDataFrame([(1, [171.999863748, 229.944532028, 723.347347957, 859.222115862, 905.877785627, 930.779569444]), (2, [3.0, 3.0, 3.0, 3.0])], "img_id long, variances array<double>")
    got = {r.img_id: r for r in catalog.rounded(raster.texture_split(blocks), "img_id").collect()}
    assert got[1].texture_contrast == 523.529243
    assert (got[2].texture_rich_mean, got[2].texture_poor_mean) == (3.0, 0.0)
