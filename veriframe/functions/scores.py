"""Scores, vote and texts as column expressions over feature columns.

All of it is native: nothing here leaves the JVM.  A score runs from 0 (real)
to 1 (generated).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import schema as S


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _sum(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def fft_score() -> Column:
    c = F.col
    return clip(_sum(0.40 * clip((-c("spectral_slope") - 1.0) / 2.0), 0.35 * clip(1.0 - c("high_freq_ratio") / 0.5), 0.25 * clip(1.0 - c("spectral_falloff"))))


def eigenvalue_score() -> Column:
    c = F.col
    tail = (F.log1p(c("eig_condition_number")) - 3.0) / 5.0
    return clip(_sum(0.2 * clip(F.abs(c("eig_dominance") - 0.65) / 0.35), 0.3 * clip(1.0 - c("patch_ratio_std") / 10.0), 0.3 * clip(1.0 - c("band_high_ratio") / 0.3), 0.2 * clip(tail)))


def metadata_score(path: str = "path") -> Column:
    c = F.col
    camera = c("meta_has_camera") > 0
    png = F.lower(c(path)).endswith(".png")
    return clip(
        _sum(
            F.lit(0.5),
            F.when(camera, -0.3 - F.least(c("meta_camera_tags") * 0.03, F.lit(0.15))).otherwise(0.0),
            F.when(c("meta_has_gps") > 0, -0.1).otherwise(0.0),
            F.when(c("meta_has_timestamps") > 0, -0.05).otherwise(0.0),
            F.when(c("meta_tag_count") == 0, F.when(png, 0.15).otherwise(0.35)).otherwise(0.0),
            F.when((c("meta_has_software") > 0) & ~camera, 0.15).otherwise(0.0),
        )
    )


def noise_score() -> Column:
    c = F.col
    return clip(_sum(0.35 * F.greatest(F.lit(0.0), 1.0 - c("noise_spectral_entropy")), 0.35 * F.least(F.lit(1.0), 2.0 * F.abs(c("noise_autocorrelation"))), 0.30 * F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), c("noise_block_var_std") / 30.0))))


def dct_score() -> Column:
    c = F.col
    return clip(_sum(0.40 * F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), c("dct_coeff_kurtosis") / 20.0)), 0.30 * F.least(F.lit(1.0), 5.0 * c("dct_zigzag_decay")), 0.30 * F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), c("dct_high_freq_energy") / 0.05))))


def ela_score(path: str = "path") -> Column:
    c = F.col
    png = F.lower(c(path)).endswith(".png")
    mean = F.when(png, 0.3 * F.least(F.lit(1.0), c("ela_mean") / 20.0)).otherwise(0.5 * F.least(F.lit(1.0), c("ela_mean") / 10.0))
    return clip(_sum(mean, 0.3 * c("ela_uniformity"), 0.2 * F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), c("ela_block_inconsistency") / 5.0))))


def gradient_score() -> Column:
    c = F.col
    return clip(_sum(0.50 * clip(1.0 - c("gradient_kurtosis") / 15.0), 0.30 * clip(1.0 - c("gradient_variance") / 3000.0), 0.20 * clip(1.0 - c("gradient_laplacian_mean") / 40.0)))


def patchcraft_score() -> Column:
    return clip(F.col("texture_contrast") / 300.0)


def all_scores(path: str = "path") -> dict[str, Column]:
    return {
        "fft_score": fft_score(), "eigenvalue_score": eigenvalue_score(), "metadata_score": metadata_score(path), "noise_score": noise_score(),
        "dct_score": dct_score(), "ela_score": ela_score(path), "gradient_score": gradient_score(), "patchcraft_score": patchcraft_score(),
    }


def weighted_score() -> Column:
    return _sum(*(w * F.col(n) for n, w in S.WEIGHTS.items()))


def vote_label(score: Column) -> Column:
    return F.when(score > 0.5, S.LABELS[1]).otherwise(S.LABELS[0])


def vote_confidence(score: Column) -> Column:
    return clip(0.5 + F.abs(score - 0.5) * 2.0, 0.5, 1.0)


#: Remarks on a high and on a low score.
INSIGHTS = {
    "fft_score": ("⚠ FFT: High-frequency spectrum shows anomalous drop-off", "✓ FFT: Frequency spectrum follows natural 1/f power law"),
    "eigenvalue_score": ("⚠ Eigenvalue: Color/texture statistics deviate from natural images", "✓ Eigenvalue: Color/texture statistics consistent with real images"),
    "metadata_score": ("⚠ Metadata: Missing or suspicious EXIF data", "✓ Metadata: Rich camera EXIF data present"),
    "noise_score": ("⚠ Noise: Residual noise pattern inconsistent with camera sensor", "✓ Noise: Natural sensor noise pattern detected"),
    "dct_score": ("⚠ DCT: Block coefficient distribution shows synthetic patterns", "✓ DCT: Coefficient distribution consistent with natural images"),
    "ela_score": ("⚠ ELA: Compression artifacts suggest non-camera origin", "✓ ELA: Compression history consistent with camera output"),
    "gradient_score": ("⚠ Gradient: Edge distribution too smooth/regular for a real photo", "✓ Gradient: Heavy-tailed edge distribution consistent with real scene"),
    "patchcraft_score": ("⚠ PatchCraft: Rich/poor texture contrast elevated (generative artifact)", "✓ PatchCraft: Texture richness contrast within natural range"),
}


def explanation(label: Column, method: Column) -> Column:
    """The report's lines: heading, a line a score, remarks on scores over 0.6 or under 0.4."""
    lines = [F.concat(F.lit("Classification: "), label, F.lit(" (method: "), method, F.lit(")")), F.lit(""), F.lit("Individual Analysis Scores (0=Real, 1=AI):")]
    for n in S.WEIGHTS:
        verdict = F.when(F.col(n) > 0.6, "→ likely AI").when(F.col(n) < 0.4, "→ likely Real").otherwise("→ uncertain")
        lines.append(F.concat(F.lit(f"  {n}: "), F.format_string("%.3f", F.col(n)), F.lit(" "), verdict))
    lines.append(F.lit(""))
    lines += [F.when(F.col(n) > 0.6, high).when(F.col(n) < 0.4, low) for n, (high, low) in INSIGHTS.items()]
    return F.concat_ws("\n", *lines)


def matches_screen(width: Column, height: Column) -> Column:
    """A side within 4 % of a screen's width, or an aspect within 3 % of a screen's."""
    known = F.array(*map(F.lit, S.SCREEN_WIDTHS))
    near = lambda side: F.exists(known, lambda s: F.abs(side - s) / s <= 0.04)
    shape = F.exists(F.array(*map(F.lit, S.SCREEN_RATIOS)), lambda r: F.abs(width / height - r) / r < 0.03)
    return near(width) | near(height) | F.when(height > 0, shape).otherwise(False)


def screenshot(noise: Column, entropy: Column, width: Column, height: Column) -> Column:
    """``is_screenshot``, ``confidence`` and ``reasons``: two of three signs make a screenshot.  Null inputs (an unreadable image) show none."""
    h1, h2, h3 = (F.coalesce(x, F.lit(False)) for x in (noise < S.SCREEN_NOISE, entropy < S.SCREEN_ENTROPY, matches_screen(width, height)))
    fired = h1.cast("int") + h2.cast("int") + h3.cast("int")
    total = F.when(h1, clip(1.0 - noise / S.SCREEN_NOISE)).otherwise(0.0) + F.when(h2, clip(1.0 - entropy / S.SCREEN_ENTROPY)).otherwise(0.0) + F.when(h3, 0.5).otherwise(0.0)
    confidence = F.when(fired >= 2, clip(total / fired)).when(fired == 1, clip(total * 0.3)).otherwise(0.0)
    reasons = F.array_compact(
        F.array(
            F.when(h1, F.concat(F.lit("H1: Near-zero sensor noise (variance="), F.format_string("%.2f", noise), F.lit(" < 3.0)"))),
            F.when(h2, F.concat(F.lit("H2: Low pixel histogram entropy ("), F.format_string("%.2f", entropy), F.lit(" < 6.8)"))),
            F.when(h3, F.concat(F.lit("H3: Dimensions "), width.cast("string"), F.lit("×"), height.cast("string"), F.lit(" match common screen resolution or aspect ratio"))),
        )
    )
    return F.struct((fired >= 2).alias("is_screenshot"), confidence.alias("confidence"), reasons.alias("reasons"))


def screenshot_warning(shot: Column) -> Column:
    return F.when(
        shot["is_screenshot"],
        F.concat(
            F.lit("⚠ Input appears to be a screenshot or screen-rendered image. Classification may be unreliable: screenshots share signal properties with AI-generated images (no camera noise, no EXIF, no JPEG grid). Screenshot confidence: "),
            F.format_string("%.0f%%", shot["confidence"] * 100.0), F.lit(". Reasons: "), F.concat_ws("; ", shot["reasons"]),
        ),
    )


def analyze_tags(tags: Column) -> Column:
    """What a map of EXIF tags shows: four flags, the tags found, the software, the count.  Null: no tags."""
    names = F.coalesce(F.map_keys(tags), F.array().cast("array<string>"))
    known = lambda group: F.array_intersect(F.array(*map(F.lit, group)), names)
    camera, context, software = known(S.CAMERA_TAGS), known(S.CONTEXT_TAGS), known(S.SOFTWARE_TAGS)
    return F.struct(
        (F.size(camera) > 0).alias("has_camera_data"),
        F.array_contains(names, "GPSInfo").alias("has_gps"),
        (F.size(context) > 0).alias("has_timestamps"),
        (F.size(software) > 0).alias("has_software"),
        camera.alias("camera_tags_found"),
        context.alias("context_tags_found"),
        F.coalesce(tags["ProcessingSoftware"], tags["Software"]).alias("software_info"),
        F.size(names).alias("tag_count"),
    )


def metadata_features(analysis: Column) -> dict[str, Column]:
    return {
        "meta_tag_count": analysis["tag_count"].cast("double"),
        "meta_camera_tags": F.size(analysis["camera_tags_found"]).cast("double"),
        "meta_has_camera": analysis["has_camera_data"].cast("double"),
        "meta_has_gps": analysis["has_gps"].cast("double"),
        "meta_has_timestamps": analysis["has_timestamps"].cast("double"),
        "meta_has_software": analysis["has_software"].cast("double"),
    }
