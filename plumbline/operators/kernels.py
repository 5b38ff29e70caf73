"""Image and matrix kernels on numpy arrays, and their Arrow functions over image columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decoded(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """RGB pixels, height x width x 3, of Spark's image bytes (BGR or BGRA rows): grey repeated, alpha laid on white."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(x, 3, axis=2)
    rgb = x[:, :, 2::-1].astype(np.float64)
    if channels == 4:
        a = x[:, :, 3:].astype(np.float64) / 255
        rgb = rgb * a + 255 * (1 - a)
    return np.rint(rgb).astype(np.uint8)


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    at = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
    ys, xs = at(height, x.shape[0]), at(width, x.shape[1])
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    x = x.astype(np.float64)
    top, low = x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx, x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def resize_pad(x: np.ndarray, size: int, fill: float = 255.0) -> np.ndarray:
    """The image scaled to fit a square, centred on a plain ground, its aspect kept."""
    scale = size / max(x.shape[:2])
    h, w = max(1, round(x.shape[0] * scale)), max(1, round(x.shape[1] * scale))
    out = np.full((size, size, x.shape[2]), fill)
    top, left = (size - h) // 2, (size - w) // 2
    out[top : top + h, left : left + w] = resize(x, h, w)
    return out


def normalise(x: np.ndarray, mean: list[float], std: list[float]) -> np.ndarray:
    return (x / 255 - np.array(mean)) / np.array(std)


def denormalise(x: np.ndarray, mean: list[float], std: list[float]) -> np.ndarray:
    return (x * np.array(std) + np.array(mean)) * 255


def sampled(x: np.ndarray, u: np.ndarray, v: np.ndarray, fill: float = 255.0, cubic: bool = False) -> np.ndarray:
    """Values of an image at columns u and rows v, bilinear or bicubic (a = -0.5) between pixel centres; pixels beyond
    an edge repeat the edge, points beyond the image are `fill`."""
    h, w = x.shape[:2]
    inside = (u >= -0.5) & (u < w - 0.5) & (v >= -0.5) & (v < h - 0.5)
    out = np.full((*u.shape, x.shape[2]), float(fill))
    u, v = u[inside], v[inside]
    c, r = np.floor(u).astype(int), np.floor(v).astype(int)

    def weights(t: np.ndarray) -> list[tuple[int, np.ndarray]]:
        if not cubic:
            return [(0, 1 - t), (1, t)]
        near, far = (lambda d: 1.5 * d**3 - 2.5 * d**2 + 1), (lambda d: -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2)
        return [(-1, far(1 + t)), (0, near(t)), (1, near(1 - t)), (2, far(2 - t))]

    total = np.zeros((len(u), x.shape[2]))
    for i, a in weights(v - r):
        for j, b in weights(u - c):
            total += (a * b)[:, None] * x[np.clip(r + i, 0, h - 1), np.clip(c + j, 0, w - 1)]
    out[inside] = np.clip(total, 0, 255)
    return out


def affine(x: np.ndarray, angle: float, dx: float, dy: float, scale: float, fill: float = 255.0) -> np.ndarray:
    """Rotation by degrees about the centre, scaling and a shift in pixels, bilinear."""
    h, w = x.shape[:2]
    a = np.deg2rad(angle)
    yy, xx = np.mgrid[0:h, 0:w]
    u, v = xx - (w - 1) / 2 - dx, yy - (h - 1) / 2 - dy
    return sampled(x, (np.cos(a) * u + np.sin(a) * v) / scale + (w - 1) / 2, (-np.sin(a) * u + np.cos(a) * v) / scale + (h - 1) / 2, fill)


def random_affine(x: np.ndarray, key: str, seed: int = 42) -> np.ndarray:
    """affine() within 5 degrees, 3 % and 0.95 to 1.05, the same for the same key and seed."""
    r = np.random.default_rng([seed, *key.encode()])
    return affine(x, r.uniform(-5, 5), r.uniform(-0.03, 0.03) * x.shape[1], r.uniform(-0.03, 0.03) * x.shape[0], r.uniform(0.95, 1.05))


def tta(x: np.ndarray, fill: float = 255.0) -> list[np.ndarray]:
    """Five fixed views: as it is, turned by 3 degrees each way, moved by a pixel to the right and to the left."""
    edge = np.full((x.shape[0], 1, x.shape[2]), float(fill))
    return [x.astype(np.float64), *(affine(x, a, 0, 0, 1, fill) for a in (-3, 3)), np.concatenate((edge, x[:, :-1]), 1), np.concatenate((x[:, 1:], edge), 1)]


def ink_box(grey: np.ndarray, dark: int = 190) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of ink: rows with max(2, width // 500) dark pixels, then columns with 2 within these rows; an error without any."""
    d = grey < dark
    ys = np.flatnonzero(d.sum(1) >= max(2, grey.shape[1] // 500))
    xs = np.flatnonzero(d[ys[0] : ys[-1] + 1].sum(0) >= 2) if len(ys) else ys
    if not len(xs):
        raise ValueError("the image holds no ink")
    return int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1


def grey(x: np.ndarray) -> np.ndarray:
    """The luma of an image, by the weights of ITU-R BT.601; an image of one channel as it is."""
    return x[..., :3] @ np.array([0.299, 0.587, 0.114]) if x.shape[-1] >= 3 else x[..., 0]


def trim(x: np.ndarray, padding: float = 0.15) -> np.ndarray:
    """The image cut to its ink, with `padding` of the ink's extent around it on each axis, two pixels at least."""
    left, top, right, bottom = ink_box(grey(x))
    px, py = (max(2, round(n * padding)) for n in (right - left, bottom - top))
    return x[max(0, top - py) : bottom + py, max(0, left - px) : right + px]


def homography(points: list[tuple[float, float]], width: float, height: float) -> np.ndarray:
    """The eight coefficients that take a width x height rectangle to four corners, from the upper left clockwise."""
    rows, values = [], []
    for (u, v), (x, y) in zip([(0, 0), (width, 0), (width, height), (0, height)], points, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v]]
        values += [x, y]
    m = np.array(rows, np.float64)
    if np.linalg.matrix_rank(m, tol=1e-10) < 8:
        raise ValueError("the corners are no usable quadrilateral")
    return np.linalg.solve(m, np.array(values, np.float64))


def warp(x: np.ndarray, coefficients: np.ndarray, width: int, height: int, fill: float = 0.0) -> np.ndarray:
    """A width x height rectangle filled from an image by homography()'s coefficients, bicubic."""
    v, u = np.mgrid[0:height, 0:width] + 0.5
    a, b, c, d, e, f, g, h = coefficients
    w = g * u + h * v + 1
    return sampled(x, (a * u + b * v + c) / w - 0.5, (d * u + e * v + f) / w - 0.5, fill, cubic=True)


def grid_boxes(width: int, height: int, rows: int, columns: int = 8, label_band: float = 0.16, inner: float = 0.07) -> list[tuple[int, int, int, int]]:
    """The inside of each cell of a form, below its label band and within margins that are a part of the whole cell."""
    w, h = width / columns, height / rows
    mx, my, band = round(w * inner), round(h * inner), round(h * label_band)
    return [(round(j * w) + mx, round(i * h) + band + my, round((j + 1) * w) - mx, round((i + 1) * h) - my) for i in range(rows) for j in range(columns)]


def hsv(x: np.ndarray) -> np.ndarray:
    """Hue in degrees, saturation and value from 0 to 1, of RGB from 0 to 255."""
    x = x.astype(np.float64) / 255
    top, low = x.max(-1), x.min(-1)
    d = np.where(top > low, top - low, 1)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    h = np.select([top == low, top == r, top == g], [0, (g - b) / d % 6, (b - r) / d + 2], (r - g) / d + 4) * 60
    return np.stack((h, np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0), top), axis=-1)


def tensors(images: DataFrame, size: int, mean: list[float], std: list[float], image: str = "image") -> DataFrame:
    """images with `tensor` (3 x size x size, flat) and `error`: a corrupt image is a row with an error, never a failed job."""

    @F.pandas_udf("struct<tensor:array<float>,error:string>")
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data, h, w, c in zip(batch["data"], batch["height"], batch["width"], batch["nChannels"], strict=True):
                try:
                    if h is None or h < 1:
                        raise ValueError("the image cannot be decoded")
                    t = normalise(resize_pad(decoded(data, int(h), int(w), int(c)), size), mean, std)
                    out.append((t.transpose(2, 0, 1).astype(np.float32).ravel(), None))
                except (ValueError, TypeError) as e:
                    out.append((None, str(e)))
            yield pd.DataFrame(out, columns=["tensor", "error"])

    x = F.struct(*[F.col(f"{image}.{c}").alias(c) for c in ("data", "height", "width", "nChannels")])
    return images.withColumn("x", of(x)).select("*", "x.tensor", "x.error").drop("x")
