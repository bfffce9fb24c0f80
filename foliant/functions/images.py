"""What a scan's pixels say about it: sharpness, ink, contrast. Pixels come as bytes, grey or in three colors, row by row; no image reader is needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brightness from which a pixel is white; shares of the colors in grey.
WHITE = 240
GREY = np.array([0.299, 0.587, 0.114])


def sharpness(grey: np.ndarray) -> float:
    """The variance of the Laplacian, edges repeated beyond the border."""
    p = np.pad(grey, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey).var())


def split_level(counts: np.ndarray) -> int:
    """The level that parts a histogram best (Otsu): the greatest variance between what is up to it and what is above, the least among equals."""
    levels = np.arange(len(counts))
    below, sums = np.cumsum(counts), np.cumsum(counts * levels)
    above = below[-1] - below
    apart = sums / np.maximum(below, 1) - (sums[-1] - sums) / np.maximum(above, 1)
    return int(np.argmax(below * above * apart**2))


def contrast(grey: np.ndarray) -> float:
    """How much brighter paper is than ink, as means of the two sides of the best split; 0 where there is one side only."""
    counts = np.bincount(grey.astype(np.int64).ravel(), minlength=256).astype(np.float64)
    t, levels = split_level(counts), np.arange(len(counts))
    dark, light = counts[: t + 1], counts[t + 1 :]
    if not dark.sum() or not light.sum():
        return 0.0
    return float((light * levels[t + 1 :]).sum() / light.sum() - (dark * levels[: t + 1]).sum() / dark.sum())


def measures_of(data: bytes | None, width: int | None, height: int | None, white: int) -> dict | None:
    """sharpness, ink (percent of pixels that are not white) and contrast of an image; None where its bytes are not those of one of that size, in grey or three colors."""
    size = (width or 0) * (height or 0)
    if data is None or not size or len(data) not in (size, 3 * size):
        return None
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, -1).astype(np.float64)
    grey = pixels[:, :, 0] if pixels.shape[2] == 1 else np.rint(pixels @ GREY)
    return {"sharpness": sharpness(grey), "ink": float((pixels.mean(axis=2) < white).mean() * 100), "contrast": contrast(grey)}


def measured(pixels: Column, width: Column, height: Column, white: int = WHITE) -> Column:
    """(sharpness, ink, contrast) of images given as bytes; null for bytes that are no image of that size."""

    @F.arrow_udf("struct<sharpness:double,ink:double,contrast:double>")
    def run(data: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        out = [measures_of(None if d.as_py() is None else d.as_buffer(), x, y, white) for d, x, y in zip(data, w.to_pylist(), h.to_pylist(), strict=True)]
        return pa.array(out, pa.struct([("sharpness", pa.float64()), ("ink", pa.float64()), ("contrast", pa.float64())]))

    return run(pixels, width.cast("int"), height.cast("int"))
