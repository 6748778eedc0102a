"""Geometry of boxes as columns, and functions on gray images (bytes, one a pixel, row by row) as pandas UDFs (O-61 to O-65)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

# Gray from which a pixel is paper, size of the thumbnail, limits of boxes.
PAPER, THUMBNAIL, LEAST_INK = 244, 80, 0.02
MARGIN, BELONGS, FOREIGN, LEAST_AREA, IMAGE = 0.03, 0.45, 1.5, 0.55, 0.25
LEAST_CORRELATION = 0.35


def overlap(a: Column, b: Column) -> Column:
    """Share of box b that lies in box a; boxes are arrays x0, y0, x1, y1."""
    side = lambda i: F.greatest(F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]), F.lit(0.0))
    return side(0) * side(1) / F.greatest((b[2] - b[0]) * (b[3] - b[1]), F.lit(1e-9))


def with_images(box: Column, images: Column) -> Column:
    """The smallest box around a box and the images of which it holds at least a quarter (O-63)."""
    held = F.filter(images, lambda i: overlap(box, i) >= IMAGE)
    edge = lambda k, f: f(F.concat(F.array(box[k]), F.transform(held, lambda i: i[k])))
    return F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max))


def fit_box(box: list[float], texts: list[list[float]], largest: float = 0.9) -> list[float]:
    """A figure's box with a margin, moved so that it parts no text block (O-63). All blocks are judged at once by the box with its margin:
    those that lie in it for BELONGS and are not much larger than the figure are taken in; each other one that it touches is left
    out on the side where least of the box is lost. Where too little of the figure would stay, the box with its margin does."""
    b, t = np.array(box, dtype=float), np.array(texts, dtype=float).reshape(-1, 4)
    wide = np.concatenate([np.maximum(b[:2] - MARGIN, 0), np.minimum(b[2:] + MARGIN, 1)])
    size = t[:, 2:] - t[:, :2]
    common = np.maximum(np.minimum(wide[2:], t[:, 2:]) - np.maximum(wide[:2], t[:, :2]), 0)
    share = common.prod(axis=1) / np.maximum(size.prod(axis=1), 1e-9)
    parted = (share > 0) & (share < 0.999)
    own = parted & (share >= BELONGS) & (size <= FOREIGN * (b[2:] - b[:2])).all(axis=1)
    now = np.concatenate([np.vstack([wide, t[own]])[:, :2].min(axis=0), np.vstack([wide, t[own]])[:, 2:].max(axis=0)])
    other = t[parted & ~own]
    far = other[:, [2, 3, 0, 1]]
    lost = (far - now) * [1, 1, -1, -1]
    lost[((other - now) * [1, 1, -1, -1] >= 0) | (lost <= 0)] = np.inf
    way = np.where(np.isfinite(lost).any(axis=1), lost.argmin(axis=1), -1) if len(other) else np.zeros(0, int)
    for side, edge in ((k, far[way == k, k]) for k in range(4)):
        if len(edge):
            now[side] = max(now[side], edge.max()) if side < 2 else min(now[side], edge.min())
    area = np.maximum(now[2:] - now[:2], 0).prod()
    if area < LEAST_AREA * (b[2:] - b[:2]).prod():
        return wide.tolist()
    return [0.0, 0.0, 1.0, 1.0] if area > largest else np.clip(now, 0, 1).tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def fitted(box: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or any(x is None for x in b) else fit_box(list(b), [list(t) for t in (x if x is not None else [])]) for b, x in zip(box, texts, strict=True)])


def gray(content: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(content, np.uint8)[: width * height].reshape(height, width)


def _ink(a: np.ndarray) -> float:
    rows, cols = (np.arange(min(THUMBNAIL, n)) * n // min(THUMBNAIL, n) for n in a.shape)
    return float((a[np.ix_(rows, cols)] < PAPER).mean()) if a.size else 0.0


@F.pandas_udf(DoubleType())
def ink_ratio(content: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Share of dark pixels of a thumbnail; under LEAST_INK an image is blank (O-62)."""
    return pd.Series([_ink(gray(bytes(c), int(w), int(h))) for c, w, h in zip(content, width, height, strict=True)], dtype="float64")


@F.pandas_udf(ArrayType(IntegerType()))
def content_box(content: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """x0, y0, x1, y1 of what is not paper; null for a blank image (O-65)."""
    out = []
    for c, w, h in zip(content, width, height, strict=True):
        dark = gray(bytes(c), int(w), int(h)) < PAPER
        ys, xs = np.flatnonzero(dark.any(axis=1)), np.flatnonzero(dark.any(axis=0))
        out.append([int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1] if len(xs) else None)
    return pd.Series(out)


def located(page: np.ndarray, part: np.ndarray) -> tuple[int, int] | None:
    """x, y of the place of a part in its page by correlation of what deviates from the mean, by Fourier transform; null if it is under
    LEAST_CORRELATION of the part's with itself (O-64)."""
    if part.shape[0] > page.shape[0] or part.shape[1] > page.shape[1]:
        return None
    p, r = page - page.mean(), part - part.mean()
    own = float((r * r).sum())
    found = np.fft.irfft2(np.fft.rfft2(p) * np.conj(np.fft.rfft2(r, p.shape)), p.shape)[: p.shape[0] - r.shape[0] + 1, : p.shape[1] - r.shape[1] + 1]
    y, x = np.unravel_index(found.argmax(), found.shape)
    return (int(x), int(y)) if own > 0 and found[y, x] / own >= LEAST_CORRELATION else None
