"""Names and fixed values of the feature vector, the scores and the vote."""

from __future__ import annotations

#: The feature vector, in order, by group.
GROUPS: dict[str, tuple[str, ...]] = {
    "fft": ("spectral_slope", "slope_r_squared", "high_freq_ratio", "spectral_falloff"),
    "eigen": ("eig_ratio_1_2", "eig_ratio_2_3", "eig_condition_number", "eig_dominance", "patch_ratio_mean", "patch_ratio_std", "patch_dominance_mean", "patch_dominance_std"),
    "bands": ("band_low_ratio", "band_mid_ratio", "band_high_ratio", "band_mid_high_ratio"),
    "metadata": ("meta_tag_count", "meta_camera_tags", "meta_has_camera", "meta_has_gps", "meta_has_timestamps", "meta_has_software"),
    "noise": ("noise_variance", "noise_kurtosis", "noise_skewness", "noise_spectral_entropy", "noise_autocorrelation", "noise_block_var_std", "noise_ms_ratio_1_5", "noise_ms_ratio_3_5", "noise_rg_corr", "noise_rb_corr", "noise_gb_corr"),
    "dct": ("dct_ac_energy_ratio", "dct_high_freq_energy", "dct_coeff_kurtosis", "dct_coeff_variance", "dct_dc_variance", "dct_zigzag_decay", "dct_boundary_ratio", "dct_boundary_var_ratio"),
    "ela": ("ela_mean", "ela_variance", "ela_max", "ela_uniformity", "ela_block_inconsistency"),
    "gradient": ("gradient_mean", "gradient_variance", "gradient_kurtosis", "gradient_laplacian_mean", "gradient_laplacian_variance"),
    "texture": ("texture_contrast", "texture_rich_mean", "texture_poor_mean"),
}
#: The features whose change under noise is a feature.
DRIFT = (
    "spectral_slope", "high_freq_ratio", "noise_variance", "noise_spectral_entropy", "noise_autocorrelation", "gradient_variance", "gradient_kurtosis", "gradient_laplacian_mean",
    "dct_coeff_kurtosis", "dct_zigzag_decay", "dct_ac_energy_ratio", "texture_contrast", "texture_rich_mean", "eig_condition_number", "eig_dominance",
)
GROUPS["drift"] = tuple(f"drift_{n}" for n in DRIFT)
FEATURES: tuple[str, ...] = tuple(n for names in GROUPS.values() for n in names)
#: Inputs of the screenshot rule, beside the vector.
SCREEN = ("screen_noise_variance", "screen_entropy")

#: Scores in order, and their weights in the vote.
WEIGHTS = {"fft_score": 0.12, "eigenvalue_score": 0.15, "metadata_score": 0.10, "noise_score": 0.15, "dct_score": 0.13, "ela_score": 0.10, "gradient_score": 0.13, "patchcraft_score": 0.12}
LABELS = ("Real", "AI-Generated")

#: Tags of a camera, of software, of time and place.
CAMERA_TAGS = ("Make", "Model", "FocalLength", "ExposureTime", "FNumber", "ISOSpeedRatings", "Flash", "MeteringMode", "WhiteBalance", "LensModel", "LensMake")
SOFTWARE_TAGS = ("Software", "ProcessingSoftware")
CONTEXT_TAGS = ("DateTime", "DateTimeOriginal", "DateTimeDigitized", "GPSInfo")

EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif")
UPLOAD_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
UPLOAD_BYTES = 10 * 1024 * 1024
#: Kinds that have no decoder in the JVM.
UNSUPPORTED = ("webp",)

#: Screen widths and aspect ratios, and the limits of the screenshot rule.
SCREEN_WIDTHS = (360, 375, 390, 393, 412, 414, 428, 667, 720, 750, 780, 812, 844, 896, 768, 800, 834, 1024, 1080, 1112, 1280, 1366, 1440, 1536, 1600, 1920, 2048, 2160, 2560, 2880, 3024, 3840, 4096)
SCREEN_RATIOS = (16 / 9, 9 / 16, 4 / 3, 3 / 4, 16 / 10, 10 / 16, 21 / 9)
SCREEN_NOISE, SCREEN_ENTROPY = 3.0, 6.8
