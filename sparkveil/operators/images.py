"""Operators over raw 8-bit images (h, w, pixels row by row), in Arrow batches with numpy. Files are not decoded here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def made(seed: Column, h: int, w: int) -> Column:
    """An image by a fixed rule: pixel (y, x) is (seed * 7 + y * 5 + x * 3) mod 256."""
    cycle = F.lit(bytes(3 * k % 256 for k in range(256 + w)))  # row y begins in it where its first pixel stands; 171 * 3 mod 256 is 1
    return F.concat(*[F.substring(cycle, (F.pmod((seed % 256) * 7 + y * 5, F.lit(256)) * 171 % 256 + 1).cast("int"), F.lit(w)) for y in range(h)])


def _each(images: DataFrame, f: Callable[[np.ndarray, dict], dict], columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """images with the columns that f gives for each image; null images give nulls."""
    names = images.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = part.to_pylist()
                out = [f(np.frombuffer(r["pixels"], np.uint8).reshape(r["h"], r["w"]), r) if r["pixels"] is not None and r["h"] and r["w"] else {} for r in rows]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([o.get(n) for o in out], t) for n, t, _ in columns]], names=[*names, *[n for n, _, _ in columns]])

    schema = images.withColumns({n: F.lit(None).cast(kind) for n, _, kind in columns}).schema
    return images.mapInArrow(run, schema)


def moments(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, mean, variance, top, bottom)."""
    names = images.columns
    kinds = [("mean", pa.float64(), "double"), ("variance", pa.float64(), "double"), ("top", pa.int32(), "int"), ("bottom", pa.int32(), "int")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pixels, h, w = (part.column(names.index(c)).to_pylist() for c in ("pixels", "h", "w"))
                out: list[tuple] = [(None,) * 4] * part.num_rows
                alike: dict[int, list[int]] = {}
                for i, p in enumerate(pixels):
                    if p is not None and h[i] and w[i]:
                        if len(p) != h[i] * w[i]:
                            raise ValueError(f"{len(p)} pixels for {h[i]} by {w[i]}")
                        alike.setdefault(len(p), []).append(i)
                for n, rows in alike.items():  # images of one size at once, by whole numbers
                    v = np.frombuffer(b"".join([pixels[i] for i in rows]), np.uint8).reshape(len(rows), n)
                    wide = v.astype(np.uint32)
                    total, squares = wide.sum(axis=1, dtype=np.int64).tolist(), (wide * wide).sum(axis=1, dtype=np.int64).tolist()
                    for i, s, q, top, bottom in zip(rows, total, squares, v.max(axis=1).tolist(), v.min(axis=1).tolist(), strict=True):
                        out[i] = (round(s / n, 6), round((n * q - s * s) / (n * n), 6), top, bottom)
                yield pa.RecordBatch.from_arrays([part.column(names.index(key)), *[pa.array(c, t) for c, (_, t, _) in zip(zip(*out, strict=True), kinds, strict=True)]], names=[key, *[k[0] for k in kinds]])

    return images.mapInArrow(run, f"{key} {images.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, _, k in kinds))


def painted(images: DataFrame) -> DataFrame:
    """images with their `boxes` painted black: `masked` (pixels), `total` (sum of its pixels) and `changed` (share of pixels that differ)."""

    def paint(p: np.ndarray, row: dict) -> dict:
        out = p.copy()
        for b in row["boxes"] or []:
            out[max(0, b["y1"]) : max(0, b["y2"]), max(0, b["x1"]) : max(0, b["x2"])] = 0
        return {"masked": out.tobytes(), "total": int(out.sum(dtype=np.int64)), "changed": round(float((out != p).mean()), 9)}

    return _each(images, paint, [("masked", pa.binary(), "binary"), ("total", pa.int64(), "long"), ("changed", pa.float64(), "double")])


def standardised(images: DataFrame, target: int) -> DataFrame:
    """images shrunk by whole blocks to fit a square of `target`, never grown: new h, w, `scaled` (the square, padded with 0), `total` and `pad` (rows above)."""

    def shrink(p: np.ndarray, row: dict) -> dict:
        k = max(1, -(-max(p.shape) // target))
        h, w = p.shape[0] // k, p.shape[1] // k
        small = (p[: h * k, : w * k].reshape(h, k, w, k).sum(axis=(1, 3), dtype=np.int64) // (k * k)).astype(np.uint8)
        top, left = (target - h) // 2, (target - w) // 2
        out = np.zeros((target, target), np.uint8)
        out[top : top + h, left : left + w] = small
        return {"scaled": out.tobytes(), "total": int(small.sum(dtype=np.int64)), "new_h": h, "new_w": w, "pad": top}

    got = _each(images, shrink, [("scaled", pa.binary(), "binary"), ("total", pa.int64(), "long"), ("new_h", pa.int32(), "int"), ("new_w", pa.int32(), "int"), ("pad", pa.int32(), "int")])
    return got.drop("h", "w").withColumnsRenamed({"new_h": "h", "new_w": "w"})


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    """Peak signal to noise of two images in decibels; infinite where they are equal."""
    wrong = float(((a.astype(np.float64) - b) ** 2).mean())
    return float("inf") if wrong == 0 else 10 * float(np.log10(255**2 / wrong))


def median_filter(p: np.ndarray) -> np.ndarray:
    """Median of 3 by 3 neighbours, the edges repeated."""
    padded = np.pad(p, 1, mode="edge")
    return np.median(np.stack([padded[i : i + p.shape[0], j : j + p.shape[1]] for i in range(3) for j in range(3)]), axis=0).astype(p.dtype)


def text_density(p: np.ndarray) -> float:
    """Share of pixels at strong edges."""
    g = p.astype(np.int32)
    return float(((np.abs(np.diff(g, axis=0))[:, :-1] + np.abs(np.diff(g, axis=1))[:-1]) > 100).mean()) if min(p.shape) > 1 else 0.0
