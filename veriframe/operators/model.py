"""Scaler, RBF support-vector machine, calibration; training, prediction, evaluation, storage.

The machine is solved exactly by sequential minimal optimisation on a bounded sample
of the rows (``SAMPLE``; all rows of a smaller table).  Scaler, accuracy in all folds
and training accuracy come from all rows.  :func:`train_fourier` is another
trainer, which one asks for by name: random Fourier features (Rahimi and Recht,
2007) and a linear machine on all rows, fit distributed by Newton steps
(Chapelle, 2007).  Prediction is a column function either way: the model's size is
bounded by ``SAMPLE`` or by the number of Fourier features.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions import scores, sums
from ..operators import evaluate as E
from ..operators import prep
from ..storage import cut

COST = 10.0
#: Rows that the exact machine is fit on, about; rows whose held-out margins shape the calibration of the other one, about.
SAMPLE, CALIBRATION = 5_000, 100_000
#: Fourier features, and Newton steps at most.
FOURIER, STEPS = 512, 12


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


def solve(k: np.ndarray, y: np.ndarray, cost: float = COST, tolerance: float = 1e-3, most: int = 200_000) -> tuple[np.ndarray, float]:
    """Signed weights and bias of the dual problem, by the pair that violates most (Keerthi et al., 2001)."""
    n = len(y)
    alpha, grad = np.zeros(n), -np.ones(n)
    for _ in range(most):
        v = -y * grad
        up = ((y > 0) & (alpha < cost)) | ((y < 0) & (alpha > 0))
        low = ((y < 0) & (alpha < cost)) | ((y > 0) & (alpha > 0))
        i = int(np.argmax(np.where(up, v, -np.inf)))
        j = int(np.argmin(np.where(low, v, np.inf)))
        if not up.any() or not low.any() or v[i] - v[j] < tolerance:
            break
        curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = (v[i] - v[j]) / curve
        step = min(step, cost - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += step * y * (k[i] - k[j])
    v = -y * grad
    free = (alpha > 1e-8) & (alpha < cost - 1e-8)
    if free.any():
        bias = float(v[free].mean())
    else:
        up = ((y > 0) & (alpha < cost)) | ((y < 0) & (alpha > 0))
        low = ((y < 0) & (alpha < cost)) | ((y > 0) & (alpha > 0))
        bias = float((np.max(v[up], initial=-1.0) + np.min(v[low], initial=1.0)) / 2)
    return alpha * y, bias


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of class 1 over margins (Platt, 1999)."""
    up, down = int((y > 0).sum()), int((y < 0).sum())
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        q = np.maximum(p * (1 - p), 1e-12)
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        h = np.array([[(q * margin * margin).sum() + 1e-9, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    """What prediction needs.  ``vectors`` are support vectors with ``weights``, or none, with ``omega`` and ``phase`` of Fourier features."""

    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    gamma: float
    slope: float = 1.0
    shift: float = 0.0
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    omega: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    phase: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        if len(self.vectors):
            return rbf(z, self.vectors, self.gamma) @ self.weights + self.bias
        return fourier(z, self.omega, self.phase) @ self.weights + self.bias

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def fourier(z: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    return np.sqrt(2 / len(phase)) * np.cos(z @ omega + phase)


def standard_scale(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """``df`` with the columns centred and divided by their population deviation (constant columns: by 1).  The parameters come from one aggregate."""
    stats = df.agg(*(F.avg(c).alias(f"_m{k}") for k, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"_s{k}") for k, c in enumerate(columns)))
    out = df.crossJoin(F.broadcast(stats))  # one row
    for k, c in enumerate(columns):
        out = out.withColumn(c, (F.col(c) - F.col(f"_m{k}")) / F.when(F.col(f"_s{k}") > 0, F.col(f"_s{k}")).otherwise(1.0))
    return out.select(df.columns)


@dataclass
class Training:
    """The model, and what training reports: fold accuracies, pooled accuracy over folds, accuracy on the training rows, rows by class."""

    model: Model
    cv_scores: list[float]
    cv_pooled: float
    train_accuracy: float
    counts: dict[int, int]

    @property
    def cv_mean(self) -> float:
        return float(np.mean(self.cv_scores)) if self.cv_scores else 0.0

    @property
    def cv_std(self) -> float:
        return float(np.std(self.cv_scores)) if self.cv_scores else 0.0


def _fit_exact(x: np.ndarray, y: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray, float]:
    w, b = solve(rbf(x, x, gamma), y)
    used = np.abs(w) > 1e-9
    return x[used], w[used], b


@dataclass
class _Rows:
    """Training rows in the shared folder (``_id``, ``_fold``, ``_pick`` besides), their number by class, folds, mean and deviation of each column."""

    df: DataFrame
    sizes: dict[int, int]
    folds: int
    mean: np.ndarray
    scale: np.ndarray


def _prepared(df: DataFrame, columns: tuple[str, ...], label: str, group: str | None, sample: int) -> _Rows:
    rows = df.select(*columns, label, *([group] if group and group not in columns else [])).dropna().withColumn("_id", F.monotonically_increasing_id())
    rows = cut(rows, "training")
    sizes = {int(r[label]): int(r["n"]) for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        raise ValueError(f"training needs rows of both classes, found {sizes}")
    n = sum(sizes.values())
    k = max(1, min(5, n // 4))
    if group:
        rows = rows.withColumn("_fold", F.pmod(F.xxhash64(group), F.lit(k)))
    else:
        rows = prep.stratified_folds(rows, label, "_id", k).withColumnRenamed("fold", "_fold")
    share = min(1.0, sample / n)
    rows = cut(rows.withColumn("_pick", F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 40)) < int(share * (1 << 40))), "folded")
    stats = rows.agg(*(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)).first()
    mean, scale = np.array(stats[: len(columns)], float), np.array(stats[len(columns) :], float)
    scale[scale == 0] = 1.0
    return _Rows(rows, sizes, k, mean, scale)


def _judged(rows: _Rows, columns: tuple[str, ...], label: str, model: Model, folds: list[Model | None]) -> Training:
    """Accuracy over all rows, held-out margins from the models of their folds; calibrates ``model`` on those of the picked rows."""
    sent = rows.df.sparkSession.sparkContext.broadcast((model, folds))

    @F.pandas_udf("own double, held double")
    def margins(x: pd.DataFrame, fold: pd.Series) -> pd.DataFrame:
        model, folds = sent.value
        values, held = x.to_numpy(float), np.full(len(x), np.nan)
        for f, m in enumerate(folds):
            inside = (fold == f).to_numpy()
            if m is not None and inside.any():
                held[inside] = m.margins(values[inside])
        return pd.DataFrame({"own": model.margins(values), "held": held})

    y = F.when(F.col(label) == 1, 1.0).otherwise(-1.0)
    judged = cut(rows.df.select("_id", "_fold", "_pick", y.alias("y"), margins(F.struct(*columns), "_fold").alias("m")).select("_id", "_fold", "_pick", "y", "m.own", F.when(~F.isnan("m.held"), F.col("m.held")).alias("held")), "judged")
    right = lambda c: F.sum((F.signum(c) == F.col("y")).cast("long"))
    per = judged.groupBy("_fold").agg(F.count("*").alias("n"), F.count("held").alias("m"), right("own").alias("own"), right("held").alias("held")).orderBy("_fold").collect()
    cv = [r.held / r.m for r in per if r.m]
    pooled = sum(r.held or 0 for r in per) / max(1, sum(r.m for r in per))
    basis = judged.where("_pick").orderBy("_id").toPandas()
    done = basis["held"].notna().to_numpy()
    if done.any() and len(set(basis["y"][done])) == 2:
        model.slope, model.shift = platt(basis["held"][done].to_numpy(), basis["y"][done].to_numpy())
    else:
        model.slope, model.shift = platt(basis["own"].to_numpy(), basis["y"].to_numpy())
    return Training(model, cv, pooled, sum(r.own for r in per) / sum(r.n for r in per), rows.sizes)


def train(df: DataFrame, columns: tuple[str, ...] = S.FEATURES, label: str = "label", group: str | None = None, sample: int = SAMPLE) -> Training:
    """Fit scaler, machine and calibration on labelled feature rows; rows with a missing value or label are left out.

    The machines of the folds and the last one are fit to about ``sample`` rows,
    drawn by a hash; every row counts for the scaler and is judged by the machine
    of its fold.  With ``group`` folds keep all copies of a source image together.
    ValueError unless both classes occur.
    """
    rows = _prepared(df, columns, label, group, sample)
    pdf = rows.df.where("_pick").orderBy("_id").toPandas()
    y = np.where(pdf[label].to_numpy() == 1, 1.0, -1.0)
    if len(set(y)) < 2:
        raise ValueError(f"a sample of {sample} rows has one class only")
    x = (pdf[list(columns)].to_numpy(float) - rows.mean) / rows.scale
    gamma = 1.0 / (x.shape[1] * max(float(x.var()), 1e-12))

    def fitted(inside: np.ndarray) -> Model | None:
        if len(set(y[inside])) < 2:
            return None
        v, w, b = _fit_exact(x[inside], y[inside], gamma)
        return Model(tuple(columns), rows.mean, rows.scale, w, b, gamma, vectors=v)

    folds = [fitted(pdf["_fold"].to_numpy() != f) for f in range(rows.folds)] if rows.folds > 1 else [None]
    return _judged(rows, columns, label, fitted(np.ones(len(y), bool)), folds)


def _newton_sums(columns: tuple[str, ...], label: str, mean: np.ndarray, scale: np.ndarray, omega: np.ndarray, phase: np.ndarray, sent):
    """A pass over the rows: for each machine the loss, and products of the rows that are on the wrong side of its margin."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        d = len(phase) + 1
        total = np.zeros((len(weights), d * d + d + 2))
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
            z = np.hstack([fourier((x - mean) / scale, omega, phase), np.ones((len(x), 1))])
            y = np.where(batch.column(label).to_numpy(zero_copy_only=False) == 1, 1.0, -1.0)
            fold = batch.column("_fold").to_numpy(zero_copy_only=False)
            for k, w in enumerate(weights):
                short = 1 - y * (z @ w)
                at = np.flatnonzero((short > 0) & (fold != k))
                own = z[at]
                total[k, : d * d] += (own.T @ own).ravel()
                total[k, d * d : -2] += own.T @ y[at]
                total[k, -2:] += len(at), (short[at] ** 2).sum()
        for k in range(len(weights)):
            yield from sums.rows(f"{k}", total[k], sums.task_number())

    return run


def train_fourier(df: DataFrame, columns: tuple[str, ...] = S.FEATURES, label: str = "label", group: str | None = None, size: int = FOURIER, seed: int = 5) -> Training:
    """As :func:`train`, with a linear machine (squared hinge loss) over ``size`` random Fourier features, fit to all rows.

    Each Newton step is one pass over the rows for all folds at once, of which the
    driver gets the summed products of features.  Calibration takes about
    ``CALIBRATION`` rows, drawn by a hash.
    """
    rows = _prepared(df, columns, label, group, CALIBRATION)
    gamma = 1.0 / len(columns)
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(0, np.sqrt(2 * gamma), (len(columns), size)), rng.uniform(0, 2 * np.pi, size)
    d = size + 1
    many = rows.folds + 1 if rows.folds > 1 else 1  # the last one takes all rows: no row has its number as fold
    ridge = np.append(np.full(size, 1 / (2 * COST)), 1e-9)
    weights, step, best = np.zeros((many, d)), np.zeros((many, d)), np.full(many, np.inf)
    support = np.full(many, -1.0)
    needed = rows.df.select(*columns, label, (F.col("_fold") if many > 1 else F.lit(-1)).cast("int").alias("_fold"))
    for _ in range(STEPS):
        sent = df.sparkSession.sparkContext.broadcast(weights)
        found = sums.collect(needed.mapInArrow(_newton_sums(columns, label, rows.mean, rows.scale, omega, phase, sent), sums.SCHEMA), {f"{k}": d * d + d + 2 for k in range(many)}, "<f8")
        moved = False
        for k in range(many):
            total = found[f"{k}"]
            loss = float(ridge @ weights[k] ** 2 + total[-1])
            if loss > best[k] + 1e-9:  # too far: half the way back
                step[k] /= 2
                weights[k] -= step[k]
                moved = True
                continue
            if best[k] - loss < 1e-6 * max(1.0, loss) and total[-2] == support[k]:
                continue
            best[k], support[k], moved = loss, total[-2], True
            new = np.linalg.solve(total[: d * d].reshape(d, d) + np.diag(ridge), total[d * d : -2])
            step[k] = new - weights[k]
            weights[k] = new
        if not moved:
            break
    made = [Model(tuple(columns), rows.mean, rows.scale, w[:-1], float(w[-1]), gamma, omega=omega, phase=phase) for w in weights]
    return _judged(rows, columns, label, made[-1], made[:-1] or [None])


def with_svm(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with ``margin``, ``probability`` (of class 1) and ``svm_label``; null where a feature is."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("margin double, probability double")
    def judge(x: pd.DataFrame) -> pd.DataFrame:
        m = sent.value.margins(x.to_numpy(float))
        return pd.DataFrame({"margin": m, "probability": sent.value.probabilities(m)})

    whole = df.withColumn("_j", judge(F.struct(*(F.col(c) for c in model.features))))
    ok = ~F.isnan("_j.margin")
    out = whole.withColumns({"margin": F.when(ok, F.col("_j.margin")), "probability": F.when(ok, F.col("_j.probability"))}).drop("_j")
    return out.withColumn("svm_label", F.when(F.col("margin") > 0, S.LABELS[1]).when(F.col("margin").isNotNull(), S.LABELS[0]))


def classify(features: DataFrame, model: Model | None = None, mode: str = "auto") -> DataFrame:
    """Predictions from feature columns (:func:`..operators.features.extract`).

    ``label, confidence, method, scores, explanation`` and, where the screenshot rule
    fires or ``mode`` is ``screenshot``, ``screenshot_warning`` and
    ``screenshot_confidence``.  With a model its class counts and the larger
    probability is the confidence; without one the weighted vote decides.  Rows that
    couldn't be read have null results.
    """
    # least and greatest pass over nulls, so an unreadable row is told by its status
    df = features.withColumns({n: F.when(F.col("status") == "ok", c) for n, c in scores.all_scores("path").items()})
    if model is None:
        total = scores.weighted_score()
        df = df.withColumn("label", F.when(total.isNotNull(), scores.vote_label(total))).withColumn("confidence", F.when(total.isNotNull(), scores.vote_confidence(total))).withColumn("method", F.lit("voting"))
    else:
        df = with_svm(df, model).withColumn("label", F.col("svm_label")).withColumn("confidence", F.greatest(F.col("probability"), 1 - F.col("probability"))).withColumn("method", F.lit("svm"))
    shot = scores.screenshot(F.col("screen_noise_variance"), F.col("screen_entropy"), F.col("width"), F.col("height"))
    df = df.withColumn("_shot", shot).withColumn("explanation", F.when(F.col("label").isNotNull(), scores.explanation(F.col("label"), F.col("method"))))
    warning, sure = scores.screenshot_warning(F.col("_shot")), F.when(F.col("_shot.is_screenshot"), F.col("_shot.confidence"))
    if mode == "screenshot":
        warning, sure = F.coalesce(warning, F.lit("⚠ Screenshot mode: the result may be unreliable.")), F.lit(1.0)
    return df.select("path", *(c for c in ("label_true",) if c in df.columns), "status", "label", "confidence", "method", F.struct(*S.WEIGHTS).alias("scores"), "explanation", warning.alias("screenshot_warning"), sure.alias("screenshot_confidence"))


def response(predictions: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """``path, json``: confidence in per cent to one place, scores to three, details (feature columns by path) to four (metadata: one)."""
    df = predictions
    groups = []
    if details is not None:
        own = {g: [n for n in names if n in details.columns] for g, names in S.GROUPS.items() if g != "drift"}
        groups = [F.struct(*(F.round(n, 1 if g == "metadata" else 4).alias(n) for n in names)).alias(g) for g, names in own.items() if names]
        df = df.join(details.select("path", *(n for names in own.values() for n in names)), "path", "left")
    body = [F.col("label"), F.round(F.col("confidence") * 100, 1).alias("confidence"), F.struct(*(F.round(F.col(f"scores.{n}"), 3).alias(n) for n in S.WEIGHTS)).alias("scores")]
    if groups:
        body.append(F.struct(*groups).alias("details"))
    return df.select("path", F.to_json(F.struct(*body, F.col("screenshot_warning").alias("warning"))).alias("json"))


def evaluate(predictions: DataFrame, truth: str = "truth") -> tuple[DataFrame, DataFrame]:
    """Accuracy and report of predictions with a 0/1 column ``truth``; unreadable rows don't count."""
    df = predictions.where(F.col("label").isNotNull()).withColumn("_p", (F.col("label") == S.LABELS[1]).cast("int"))
    return E.accuracy(df, truth, "_p"), E.report(df, truth, "_p")


_ARRAYS = ("mean", "scale", "weights", "vectors", "omega", "phase")


def save(model: Model | None, spark: SparkSession, path: str) -> str:
    """Write the model as Parquet, which any Spark reads; RuntimeError without a model."""
    if model is None:
        raise RuntimeError("Cannot save: model has not been trained yet.")
    rows = [("features", list(model.features), None, None)]
    rows += [(n, None, [float(v) for v in np.ravel(getattr(model, n))], [int(v) for v in np.shape(getattr(model, n))]) for n in _ARRAYS]
    rows.append(("numbers", None, [model.bias, model.gamma, model.slope, model.shift], [4]))
    spark.createDataFrame(rows, "name string, words array<string>, numbers array<double>, shape array<long>").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load(spark: SparkSession, path: str, features: tuple[str, ...] = S.FEATURES) -> Model:
    """Read a model; FileNotFoundError if there is none, ValueError if it was trained on other features."""
    from pyspark.errors import AnalysisException

    try:
        rows = {r.name: r for r in spark.read.parquet(path).collect()}
    except AnalysisException as e:
        raise FileNotFoundError(f"Model file not found: {path}") from e
    names = tuple(rows["features"].words)
    if features is not None and names != tuple(features):
        raise ValueError("the model was trained on other features")
    a = {n: np.array(rows[n].numbers or [], float).reshape(rows[n].shape) for n in _ARRAYS}
    bias, gamma, slope, shift = rows["numbers"].numbers
    return Model(names, a["mean"], a["scale"], a["weights"], bias, gamma, slope, shift, a["vectors"], a["omega"], a["phase"])
