"""Image similarity over pixel columns. Arrow UDFs: two-dimensional filters are beyond column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stabilisers of the structural similarity for eight-bit pixels.
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def _blur(image: np.ndarray, sigma: float = 1.5, size: int = 7) -> np.ndarray:
    """Gaussian blur with mirrored borders, rows then columns."""
    x = np.arange(size) - size // 2
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    for axis in (0, 1):
        wide = np.pad(image, [(size // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if image.shape[axis] > size // 2 else "edge")
        image = np.apply_along_axis(np.convolve, axis, wide, kernel, "valid")
    return image


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity of two grey images."""
    a, b = a.astype(float), b.astype(float)
    ma, mb = _blur(a), _blur(b)
    va, vb, vab = _blur(a * a) - ma**2, _blur(b * b) - mb**2, _blur(a * b) - ma * mb
    return float((((2 * ma * mb + C1) * (2 * vab + C2)) / ((ma**2 + mb**2 + C1) * (va + vb + C2))).mean())


def edges(image: np.ndarray) -> np.ndarray:
    """Gradient magnitude by 3 x 3 Sobel kernels."""
    p = np.pad(image.astype(float), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return np.hypot(gx, gy)


def ssim(a: Column, b: Column, width: int, over_edges: bool = False) -> Column:
    """Structural similarity of two pixel arrays of that width, or of their edge maps; null for null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        prepare = (lambda v: edges(np.asarray(v, float).reshape(-1, width))) if over_edges else (lambda v: np.asarray(v, float).reshape(-1, width))
        return pd.Series([None if u is None or v is None else similarity(prepare(u), prepare(v)) for u, v in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def edge_change(a: Column, b: Column, width: int) -> Column:
    """Mean absolute difference of two edge maps."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        shape = lambda v: edges(np.asarray(v, float).reshape(-1, width))
        return pd.Series([None if u is None or v is None else float(np.abs(shape(u) - shape(v)).mean()) for u, v in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def changes(a: Column, b: Column, width: int, shift: int = 4) -> Column:
    """struct<raw, norm, edge, edge_shifted> of two pixel arrays: mean absolute differences of pixels, of pixels in
    units of their deviation, of edge maps in units of their mean, and the least of the last over nine shifts."""

    @F.pandas_udf("raw double, norm double, edge double, edge_shifted double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for u, v in zip(x, y, strict=True):
            if u is None or v is None:
                rows.append((None,) * 4)
                continue
            p, q = (np.asarray(z, float).reshape(-1, width) for z in (u, v))
            scaled = [(z - z.mean()) / (z.std() + 1e-3) for z in (p, q)]
            e, f = (m / (m.mean() + 1e-3) for m in (edges(p), edges(q)))
            near = min(np.abs(np.roll(e, (dy, dx), (0, 1)) - f).mean() for dy in (-shift, 0, shift) for dx in (-shift, 0, shift))
            rows.append((np.abs(p - q).mean(), np.abs(scaled[0] - scaled[1]).mean(), np.abs(e - f).mean(), near))
        return pd.DataFrame(rows, columns=["raw", "norm", "edge", "edge_shifted"], dtype="float64")

    return run(a, b)
