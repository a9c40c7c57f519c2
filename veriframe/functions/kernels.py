"""Numeric kernels over one decoded image.

:class:`Raster` holds an image and makes each intermediate result once: gray
levels, residuals by width of the blur, the spectrum.  Feature groups are
functions of a raster, so that a column group that isn't asked for costs nothing.
Images are height x width x 3, blue first.
"""

from __future__ import annotations

from functools import cache, cached_property

import numpy as np

from .schema import DRIFT, GROUPS

# ---------------------------------------------------------------- filters


@cache
def gaussian(sigma: float) -> np.ndarray:
    """Taps of a blur: an odd count of about six sigma, normalised."""
    n = int(6 * sigma) | 1
    x = np.arange(n) - n // 2
    w = np.exp(-(x * x) / (2.0 * sigma * sigma))
    return w / w.sum()


def mirrored(n: int, pad: int) -> np.ndarray:
    """Indices -pad .. n + pad - 1 mirrored at the border samples; repeatedly where the border is wider than the line."""
    if n == 1:
        return np.zeros(1 + 2 * pad, np.int64)
    k = np.abs(np.arange(-pad, n + pad)) % (2 * n - 2)
    return np.where(k < n, k, 2 * n - 2 - k)


def convolve(a: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    pad = len(taps) // 2
    n = a.shape[axis]
    wide = np.take(a, mirrored(n, pad), axis=axis)
    out = np.zeros_like(a, dtype=np.float64)
    for k, w in enumerate(taps):
        if w:
            out += w * (wide[:, k : k + n] if axis else wide[k : k + n])
    return out


def residual(a: np.ndarray, sigma: float) -> np.ndarray:
    taps = gaussian(sigma)
    a = a.astype(np.float64)
    return a - convolve(convolve(a, taps, 1), taps, 0)


def tiles(a: np.ndarray, size: int) -> np.ndarray:
    """Whole tiles, tile by tile: n x size x size (further axes stay)."""
    h, w = a.shape[0] // size, a.shape[1] // size
    cut = a[: h * size, : w * size]
    return cut.reshape(h, size, w, size, *a.shape[2:]).swapaxes(1, 2).reshape(h * w, size, size, *a.shape[2:])


def square(a: np.ndarray) -> np.ndarray:
    """The square of the shorter side at the centre."""
    side = min(a.shape[:2])
    y, x = (a.shape[0] - side) // 2, (a.shape[1] - side) // 2
    return a[y : y + side, x : x + side]


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target pixel is the mean of the area that it covers, weighted at the borders."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        low, high = edge[:-1, None], edge[1:, None]
        cell = np.arange(n)[None, :]
        over = np.clip(np.minimum(high, cell + 1) - np.maximum(low, cell), 0, None)
        return over / over.sum(1, keepdims=True)

    out = np.tensordot(weights(a.shape[0], height), a.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(weights(a.shape[1], width), out, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def resize_to_square(a: np.ndarray, side: int = 512) -> np.ndarray:
    """The whole image at ``side`` x ``side`` pixels, by areas; its shape is not kept."""
    return area_resize(a, side, side)


def central(x: np.ndarray, order: int) -> float:
    """The standardised central moment, 0 for a flat input; 3 is taken off the fourth."""
    d = x - x.mean()
    v = float((d * d).mean())
    if v < 1e-20:
        return 0.0
    return float((d**order).mean()) / v ** (order / 2) - (3.0 if order == 4 else 0.0)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.ravel() - a.mean(), b.ravel() - b.mean()
    sa, sb = np.sqrt((a * a).mean()), np.sqrt((b * b).mean())
    return float((a * b).mean() / (sa * sb)) if sa >= 1e-10 and sb >= 1e-10 else 0.0


# ---------------------------------------------------------------- transforms


@cache
def dct_basis() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)


@cache
def zigzag_order() -> np.ndarray:
    """Row-major places in zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


def block_dct(gray: np.ndarray) -> np.ndarray:
    d = dct_basis()
    return d @ tiles(gray.astype(np.float64), 8) @ d.T


#: The example tables of the JPEG standard, luma and chroma.
LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]).reshape(8, 8)
CHROMA = np.array([
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
]).reshape(8, 8)


def quality_table(base: np.ndarray, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255)


def _coded(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane through block DCT and quantisation; borders repeat to whole blocks."""
    h, w = plane.shape
    full = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    d = dct_basis()
    blocks = d @ tiles(full - 128.0, 8) @ d.T
    blocks = d.T @ (np.rint(blocks / table) * table) @ d
    rows, cols = full.shape[0] // 8, full.shape[1] // 8
    back = blocks.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(full.shape)
    return np.clip(np.rint(back + 128.0), 0, 255)[:h, :w]


def _upsampled(a: np.ndarray, axis: int) -> np.ndarray:
    a = np.moveaxis(a, axis, 0)
    before, after = np.concatenate([a[:1], a[:-1]]), np.concatenate([a[1:], a[-1:]])
    out = np.empty((2 * len(a), *a.shape[1:]))
    out[0::2], out[1::2] = (3 * a + before) / 4, (3 * a + after) / 4
    return np.moveaxis(out, 0, axis)


def jpeg_round_trip(bgr: np.ndarray, quality: int) -> np.ndarray:
    """What an image is after being stored as JPEG (4:2:0) and read again; entropy coding is lossless and left out."""
    b, g, r = (bgr[:, :, k].astype(np.float64) for k in range(3))
    y = np.rint(0.299 * r + 0.587 * g + 0.114 * b)
    cb = np.rint(128 - 0.168735892 * r - 0.331264108 * g + 0.5 * b)
    cr = np.rint(128 + 0.5 * r - 0.418687589 * g - 0.081312411 * b)
    luma, chroma = quality_table(LUMA, quality), quality_table(CHROMA, quality)
    h, w = y.shape
    y = _coded(y, luma)
    planes = []
    for c in (cb, cr):
        even = np.pad(c, ((0, h % 2), (0, w % 2)), mode="edge")
        small = np.floor((even[0::2, 0::2] + even[1::2, 0::2] + even[0::2, 1::2] + even[1::2, 1::2]) / 4 + 0.5)
        planes.append(np.floor(_upsampled(_upsampled(_coded(small, chroma), 0), 1) + 0.5)[:h, :w] - 128)
    cb, cr = planes
    out = np.stack([y + 1.772 * cb, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.402 * cr], 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- features


class Raster:
    def __init__(self, bgr: np.ndarray, png: bool = False, jpeg: bool = False) -> None:
        self.bgr, self.png, self.jpeg = bgr, png, jpeg
        self._residuals: dict[float, np.ndarray] = {}

    @cached_property
    def gray(self) -> np.ndarray:
        b, g, r = (self.bgr[:, :, k].astype(np.float64) for k in range(3))
        return np.rint(0.114 * b + 0.587 * g + 0.299 * r)

    def residual(self, sigma: float) -> np.ndarray:
        if sigma not in self._residuals:
            self._residuals[sigma] = residual(self.gray, sigma)
        return self._residuals[sigma]

    @cached_property
    def magnitude(self) -> np.ndarray:
        return np.abs(np.fft.fftshift(np.fft.fft2(square(self.gray))))

    @cached_property
    def radius(self) -> np.ndarray:
        n = len(self.magnitude)
        d = np.arange(n) - n // 2
        return np.sqrt(d[:, None] ** 2 + d[None, :] ** 2)


def radial_profile(spectrum: np.ndarray) -> np.ndarray:
    """Mean of each ring of whole radius below half the shorter side, around the centre."""
    h, w = spectrum.shape
    y, x = np.arange(h) - h // 2, np.arange(w) - w // 2
    ring = np.sqrt(y[:, None] ** 2 + x[None, :] ** 2).astype(np.int64)
    n = min(h // 2, w // 2)
    inside = ring < n
    total = np.bincount(ring[inside], weights=spectrum[inside], minlength=n)
    count = np.bincount(ring[inside], minlength=n)
    return np.divide(total, count, out=np.zeros(n), where=count > 0)


def spectral_slope(profile: np.ndarray) -> tuple[float, float]:
    """Slope and R2 of the line through log power over log radius; radius 0 and rings without power are left out, under five points give zeros."""
    r = np.arange(1, len(profile))
    p = profile[1:]
    r, p = r[p > 0], p[p > 0]
    if len(p) < 5:
        return 0.0, 0.0
    x, y = np.log(r), np.log(p)
    dx, dy = x - x.mean(), y - y.mean()
    slope = float((dx * dy).sum() / (dx * dx).sum())
    total = float((dy * dy).sum())
    left = float(((dy - slope * dx) ** 2).sum())
    return slope, 1 - left / total if total > 0 else 0.0


def high_frequency_ratio(profile: np.ndarray) -> float:
    total = float(profile.sum()) if len(profile) else 0.0
    return float(profile[len(profile) // 2 :].sum()) / total if total else 0.0


def spectral_falloff(profile: np.ndarray) -> float:
    n = len(profile)
    if n < 8:
        return 0.0
    low = float(profile[n // 4 : n // 2].mean())
    return float(profile[3 * n // 4 :].mean()) / low if low else 0.0


def fft_features(r: Raster) -> tuple[float, ...]:
    profile = radial_profile(np.log1p(r.magnitude))
    return (*spectral_slope(profile), high_frequency_ratio(profile), spectral_falloff(profile))


def band_features(r: Raster) -> tuple[float, ...]:
    top = len(r.magnitude) // 2
    total = r.magnitude.sum() + 1e-10
    low = float(r.magnitude[r.radius < 0.33 * top].sum() / total)
    mid = float(r.magnitude[(r.radius >= 0.33 * top) & (r.radius < 0.66 * top)].sum() / total)
    high = float(r.magnitude[(r.radius >= 0.66 * top) & (r.radius <= top)].sum() / total)
    return low, mid, high, mid + high


def covariances(pixels: np.ndarray) -> np.ndarray:
    """Sample covariance of each set of pixels: ... x n x 3 gives ... x 3 x 3."""
    d = pixels.astype(np.float64) - pixels.mean(axis=-2, keepdims=True)
    return d.swapaxes(-1, -2) @ d / max(1, pixels.shape[-2] - 1)


def eigenvalues(covariance: np.ndarray) -> np.ndarray:
    """Magnitudes, the largest first."""
    return np.sort(np.abs(np.linalg.eigvalsh(covariance)), axis=-1)[..., ::-1]


def eigen_ratios(values: np.ndarray) -> np.ndarray:
    """First over second, second over third, first over third, share of the first."""
    a, b, c = (values[..., k] for k in range(3))
    tiny = 1e-10
    return np.stack([a / (b + tiny), b / (c + tiny), a / (c + tiny), a / (a + b + c + tiny)], -1)


def eigen_features(r: Raster) -> tuple[float, ...]:
    whole = eigen_ratios(eigenvalues(covariances(r.bgr.reshape(-1, 3))))
    patches = tiles(r.bgr, 64).reshape(-1, 64 * 64, 3)
    patches = patches[patches.reshape(len(patches), -1).std(axis=1) >= 1.0] if len(patches) else patches
    if not len(patches):
        return (*map(float, whole), 0.0, 0.0, 0.0, 0.0)
    own = eigen_ratios(eigenvalues(covariances(patches)))
    ratio, share = own[:, 0], own[:, 3]
    return (*map(float, whole), float(ratio.mean()), float(ratio.std()), float(share.mean()), float(share.std()))


def spectral_entropy(a: np.ndarray) -> float:
    power = np.abs(np.fft.fft2(a)) ** 2
    total = power.sum()
    if total < 1e-10:
        return 0.0
    p = power[power > 0] / total
    return float(-(p * np.log2(p)).sum() / np.log2(len(p))) if len(p) > 1 else 0.0


def noise_features(r: Raster) -> tuple[float, ...]:
    n = r.residual(3.0)
    blocks = tiles(n, 32)
    spread = float(blocks.var(axis=(1, 2)).std()) if len(blocks) >= 2 else 0.0
    near = (correlation(n[:, :-1], n[:, 1:]) + correlation(n[:-1], n[1:])) / 2 if n.size >= 4 else 0.0
    ratios = [1.0, 1.0]
    if min(r.gray.shape) >= 64:
        wide = float(r.residual(5.0).var())
        if wide >= 1e-10:
            ratios = [float(np.clip(r.residual(s).var() / wide, 0, 50)) for s in (1.0, 3.0)]
    blue, green, red = (residual(r.bgr[:, :, k], 2.0) for k in range(3))
    flat = n.std() < 1e-10
    return (float(n.var()), 0.0 if flat else central(n, 4), 0.0 if flat else central(n, 3), spectral_entropy(n), near, spread, *ratios, correlation(red, green), correlation(red, blue), correlation(green, blue))


def _edges(n: int) -> np.ndarray:
    """Which of n - 1 steps between neighbours cross a boundary of 8-blocks."""
    return np.arange(n - 1) % 8 == 7


def boundary_features(gray: np.ndarray) -> tuple[float, float]:
    across, down = np.abs(np.diff(gray, axis=1)), np.abs(np.diff(gray, axis=0))
    col, row = _edges(gray.shape[1]), _edges(gray.shape[0])
    mean = lambda x: float(x.mean()) if x.size else 0.0
    at = (mean(across[:, col]) + mean(down[row])) / 2
    within = (mean(across[:, ~col]) + mean(down[~row])) / 2
    ratio = float(np.clip(at / within, 0, 5)) if within >= 1e-10 else 1.0
    a, b = across[:, col], across[:, ~col]
    if a.size < 2 or b.size < 2 or b.var() < 1e-10:
        return ratio, 1.0
    return ratio, float(np.clip(a.var() / b.var(), 0, 10))


def dct_features(r: Raster) -> tuple[float, ...]:
    """A side under 8 gives no block: the values of an image that can't be read, with the boundary features."""
    c = block_dct(r.gray).reshape(-1, 64)
    if not len(c):
        return (0.5, 0.0, 0.0, 0.0, 0.0, 0.0, *boundary_features(r.gray))
    energy = c * c
    total = float(energy.sum())
    high = (np.arange(64) // 8 >= 4) & (np.arange(64) % 8 >= 4)
    ac = c[:, 1:]
    bare = c.copy()
    bare[:, 0] = 0
    scan = energy.sum(0)[zigzag_order()]
    first = float(scan[:16].sum())
    return (
        1 - float(energy[:, 0].sum()) / total if total >= 1e-10 else 0.0,
        float(energy[:, high].sum()) / total if total >= 1e-10 else 0.0,
        central(ac, 4) if ac.std() >= 1e-10 else 0.0,
        float(bare.var()),
        float(c[:, 0].var()),
        float(scan[-16:].sum()) / first if first >= 1e-10 else 0.0,
        *boundary_features(r.gray),
    )


def ela_map(bgr: np.ndarray, quality: int = 95) -> np.ndarray:
    return np.abs(bgr.astype(np.float64) - jpeg_round_trip(bgr, quality)).mean(axis=2)


def ela_features(r: Raster) -> tuple[float, ...]:
    e = ela_map(r.bgr)
    top = float(e.max())
    blocks = tiles(e, 8)
    return float(e.mean()), float(e.var()), top, float(e.mean()) / top if top >= 1e-10 else 1.0, float(blocks.mean(axis=(1, 2)).std()) if len(blocks) >= 2 else 0.0


def gradient_features(r: Raster) -> tuple[float, ...]:
    step, smooth = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    gx, gy = convolve(convolve(r.gray, step, 1), smooth, 0), convolve(convolve(r.gray, smooth, 1), step, 0)
    edge = np.sqrt(gx * gx + gy * gy)
    # the corners twice, minus eight times the centre
    ends = np.array([1.0, 0.0, 1.0])
    curve = np.abs(2 * convolve(convolve(r.gray, ends, 1), ends, 0) - 8 * r.gray)
    return float(edge.mean()), float(edge.var()), central(edge, 4), float(curve.mean()), float(curve.var())


def texture_features(r: Raster) -> tuple[float, ...]:
    if min(r.gray.shape) < 256:
        return 0.0, 0.0, 0.0
    v = tiles(r.residual(3.0), 32).var(axis=(1, 2))
    rich = v >= np.median(v)
    high = float(v[rich].mean())
    low = float(v[~rich].mean()) if (~rich).any() else 0.0
    return high - low, high, low


KERNELS = {"fft": fft_features, "eigen": eigen_features, "bands": band_features, "noise": noise_features, "dct": dct_features, "ela": ela_features, "gradient": gradient_features, "texture": texture_features}


def noisy(r: Raster, seed: int) -> Raster:
    """The image with noise of deviation 2, clipped and cut to whole levels; a JPEG is stored anew, as its format would."""
    noise = np.random.default_rng(seed).normal(0, 2, r.bgr.shape)
    bgr = np.clip(r.bgr + noise, 0, 255).astype(np.uint8)
    return Raster(jpeg_round_trip(bgr, 95) if r.jpeg else bgr, r.png, r.jpeg)


def features(r: Raster, groups: tuple[str, ...], seed: int = 0) -> dict[str, float]:
    """The features of the groups, but those of metadata, which pixels don't have."""
    out: dict[str, float] = {}
    need = [g for g in KERNELS if g in groups or "drift" in groups and any(n in GROUPS[g] for n in DRIFT)]
    for g in need:
        out.update(zip(GROUPS[g], KERNELS[g](r), strict=True))
    if "drift" in groups:
        other: dict[str, float] = {}
        shaken = noisy(r, seed)
        for g in need:
            if any(n in GROUPS[g] for n in DRIFT):
                other.update(zip(GROUPS[g], KERNELS[g](shaken), strict=True))
        out.update({f"drift_{n}": abs(out[n] - other[n]) for n in DRIFT})
    return {n: out[n] for g in groups if g != "metadata" for n in GROUPS[g]}


def screen_inputs(r: Raster) -> tuple[float, float]:
    """Residual variance and entropy of gray levels in bits, which the screenshot rule looks at."""
    p = np.bincount(r.gray.astype(np.int64).ravel(), minlength=256) / max(1, r.gray.size)
    p = p[p > 0]
    return float(r.residual(2.0).var()), float(-(p * np.log2(p)).sum())


def augmented(bgr: np.ndarray, kind: str) -> np.ndarray:
    """``orig``, ``q70``, ``q80``, or ``small``: three quarters of each side (64 at least) stored at quality 85."""
    if kind == "orig":
        return bgr
    if kind == "small":
        h, w = bgr.shape[:2]
        return jpeg_round_trip(area_resize(bgr, max(64, int(h * 0.75)), max(64, int(w * 0.75))), 85)
    return jpeg_round_trip(bgr, int(kind[1:]))
