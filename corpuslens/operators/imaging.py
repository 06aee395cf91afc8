"""Page images: greyscale, contrast, median, adaptive and Otsu thresholds, deskew, morphology, profiles.

Pixel work is NumPy on one image at a time inside ``mapInPandas``; images keep Spark's image layout (BGR bytes,
row by row). Results follow the published definitions of the operations; they are not bit-exact with
any particular imaging library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.errors import InvalidImageError
from corpuslens.operators.tokens import image_errors

#: Fixed values of the preprocessing recipe.
CLIP_LIMIT, TILES, MEDIAN, WINDOW, OFFSET, LEAST_ANGLE = 2.0, 8, 3, 31, 15, 0.05
PROFILE_SCHEMA = "origin string, profile string, height int, width int, data binary, error string"


def validate_image(image: np.ndarray) -> np.ndarray:
    if not isinstance(image, np.ndarray) or image.ndim != 3 or image.shape[2] != 3 or image.dtype != np.uint8 or min(image.shape[:2]) < 3:
        raise InvalidImageError("a page must be a BGR uint8 image of at least 3 by 3 pixels")
    return image


def greyscale(bgr: np.ndarray) -> np.ndarray:
    """Rec. 601 luma in 14-bit fixed point."""
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def _windows(image: np.ndarray, size: int) -> np.ndarray:
    half = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, half, mode="edge"), (size, size))


def median_filter(image: np.ndarray, size: int = MEDIAN) -> np.ndarray:
    return np.median(_windows(image, size).reshape(*image.shape, -1), axis=2).astype(np.uint8)


def equalise(image: np.ndarray, clip: float = CLIP_LIMIT, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation with bilinear blending between tiles."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    area = th * tw
    limit = max(int(clip * area / 256), 1)
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.maximum(n - limit, 0).sum()
            n = np.minimum(n, limit) + over // 256
            extra = over % 256
            if extra:
                n[:: max(256 // extra, 1)][:extra] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(n) * 255.0 / area), 0, 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None, :], image]
    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    bottom = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.clip(np.rint(top * (1 - fy) + bottom * fy), 0, 255).astype(np.uint8)


def window_size(shape: tuple[int, ...], most: int = WINDOW) -> int:
    size = min(most, *shape[:2])
    size -= size % 2 == 0
    if size < 3:
        raise InvalidImageError("image is too small for an adaptive threshold")
    return size


def adaptive_threshold(image: np.ndarray, size: int, offset: float = OFFSET) -> np.ndarray:
    """255 where a pixel exceeds the Gaussian-weighted mean of its window less the offset."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    half = size // 2
    rows = np.apply_along_axis(np.convolve, 1, np.pad(image.astype(float), ((0, 0), (half, half)), mode="edge"), k, "valid")
    mean = np.apply_along_axis(np.convolve, 0, np.pad(rows, ((half, half), (0, 0)), mode="edge"), k, "valid")
    return np.where(image > np.rint(mean) - offset, 255, 0).astype(np.uint8)


def otsu_threshold(image: np.ndarray) -> np.ndarray:
    """Binary image at the grey level with the greatest variance between classes."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    below = np.cumsum(n)
    total, sums = below[-1], np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * below / total - sums) ** 2 / (below * (total - below))
    return np.where(image > int(np.argmax(np.nan_to_num(between, nan=-1.0, posinf=-1.0))), 255, 0).astype(np.uint8)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Hull of 2-D points, counter-clockwise (monotone chain over the extreme points of each row)."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    pts = points[order]

    def half(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts.tolist()) + half(pts[::-1].tolist()) or pts[:1].tolist(), float)


def skew_angle(binary: np.ndarray) -> float | None:
    """Degrees, in [-45, 45), by which the smallest rectangle around the ink is turned; None with too little ink."""
    rows = [(y, xs.min(), xs.max()) for y in range(binary.shape[0]) if len(xs := np.flatnonzero(binary[y] == 0))]
    if not rows or sum(1 + (a != b) for _, a, b in rows) < 2:
        return None
    points = np.array([(x, y) for y, a, b in rows for x in (a, b)], float)
    hull = convex_hull(np.unique(points, axis=0))
    if len(hull) < 2:
        return None
    sides = np.roll(hull, -1, axis=0) - hull
    angles = np.unique(np.mod(np.arctan2(sides[:, 1], sides[:, 0]), np.pi / 2))
    turned = [(hull @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]), a) for a in angles]
    best = min(turned, key=lambda x: np.prod(np.ptp(x[0], axis=0)))[1]
    return float((np.degrees(best) + 45.0) % 90.0 - 45.0)


def rotate(binary: np.ndarray, degrees: float) -> np.ndarray:
    """Turn about the centre by nearest neighbours; uncovered pixels are white."""
    h, w = binary.shape
    a = np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w]
    cx, cy = w / 2.0, h / 2.0
    sx = np.rint(np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx).astype(int)
    sy = np.rint(np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(binary, 255)
    out[inside] = binary[sy[inside], sx[inside]]
    return out


def deskew(binary: np.ndarray) -> np.ndarray:
    angle = skew_angle(binary)
    return binary.copy() if angle is None or abs(angle) < LEAST_ANGLE else rotate(binary, angle)


def _shift(mask: np.ndarray, dy: int, dx: int, fill: bool) -> np.ndarray:
    h, w = mask.shape
    out = np.full_like(mask, fill)
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


#: Offsets of the 2x2 ellipse: its lower row and the upper right pixel.
ELLIPSE = [(-1, 0), (0, -1), (0, 0)]


def close_gaps(binary: np.ndarray) -> np.ndarray:
    """Close small gaps in the ink: dilation, then erosion, by the 2x2 ellipse."""
    ink = binary == 0
    grown = np.any([_shift(ink, -dy, -dx, False) for dy, dx in ELLIPSE], axis=0)
    closed = np.all([_shift(grown, dy, dx, True) for dy, dx in ELLIPSE], axis=0)
    return np.where(closed, 0, 255).astype(np.uint8)


def remove_lines(binary: np.ndarray) -> np.ndarray:
    """Blank out horizontal ink runs of at least max(25, 8 % of the width) pixels."""
    w = binary.shape[1]
    least = min(w, max(25, round(w * 0.08)))
    ink = np.pad((binary == 0).astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(ink, axis=1)
    out = binary.copy()
    for y in np.flatnonzero((step != 0).any(1)):
        starts, ends = np.flatnonzero(step[y] == 1), np.flatnonzero(step[y] == -1)
        for a, b in zip(starts, ends, strict=True):
            if b - a >= least:
                out[y, a:b] = 255
    return out


def preprocess(bgr: np.ndarray) -> np.ndarray:
    """Binary page: greyscale, equalised, denoised, thresholded, deskewed, with small gaps closed."""
    grey = median_filter(equalise(greyscale(validate_image(bgr))))
    return close_gaps(deskew(adaptive_threshold(grey, window_size(grey.shape))))


def profiles(bgr: np.ndarray) -> dict[str, np.ndarray]:
    """The five variants of a page; steps that profiles share are done once."""
    grey = greyscale(validate_image(bgr))
    size = window_size(grey.shape)
    plain = adaptive_threshold(median_filter(grey), size)
    return {
        "grayscale": grey,
        "clahe_median_adaptive": adaptive_threshold(median_filter(equalise(grey)), size),
        "median_adaptive_no_clahe": plain,
        "otsu": otsu_threshold(grey),
        "adaptive_line_removal": remove_lines(plain),
    }


def resize_area(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Shrink by area averages (exact fractional pixel weights)."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        i = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i), 0, 1) * m / n

    flat = image.astype(float) if image.ndim == 3 else image[..., None].astype(float)
    out = np.einsum("yi,ijc,xj->yxc", weights(image.shape[0], height), flat, weights(image.shape[1], width), optimize=True)
    out = np.clip(np.rint(out), 0, 255).astype(np.uint8)
    return out if image.ndim == 3 else out[..., 0]


def preprocess_images(images: DataFrame, all_profiles: bool = False) -> DataFrame:
    """origin, profile, height, width, data, error of images (Spark's image source column ``image``).

    One row per image ("preprocessed"), or five with all_profiles; images that can't be used give one row with an error code.
    """
    rows = images.select(F.col("image.origin").alias("origin"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.data").alias("data"), image_errors(F.col("image")).alias("error"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.error is not None:
                    yield pd.DataFrame([(r.origin, None, None, None, None, r.error)], columns=["origin", "profile", "height", "width", "data", "error"])
                    continue
                page = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                made = profiles(page) if all_profiles else {"preprocessed": preprocess(page)}
                yield pd.DataFrame([(r.origin, k, v.shape[0], v.shape[1], v.tobytes(), None) for k, v in made.items()], columns=["origin", "profile", "height", "width", "data", "error"])

    return rows.mapInPandas(work, PROFILE_SCHEMA)
