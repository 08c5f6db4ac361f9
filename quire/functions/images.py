"""Kernels that make page images ready for an engine, over arrays of grey values; steps of cascade.prepared(), once a decoder of the caller's has made an array of the bytes.

They run inside the tasks that Spark gives the pages to, an image at a time or a stack of images of one size.
"""

from __future__ import annotations

import math

import numpy as np

#: The long edge that a model gets, at least and at most, and the most of another one; the weights of grey; block and offset of the adaptive threshold, edge of the closing square.
LONG_LEAST, LONG_MOST, EDGE_MOST = 896, 1280, 1024
GREY = (0.299, 0.587, 0.114)
BLOCK, OFFSET, CLOSING = 15, 8, 2


def grey(rgb: np.ndarray) -> np.ndarray:
    """Grey values of (..., height, width, 3), rounded half up."""
    return np.floor(rgb[..., :3].astype(np.float64) @ np.array(GREY) + 0.5).astype(np.uint8)


def otsu(image: np.ndarray) -> np.ndarray:
    """The threshold of each image of (..., height, width) that parts its grey values with the largest variance between the parts; the least of several. From cumulative sums of the histogram."""
    flat = image.reshape(-1, image.shape[-2] * image.shape[-1])
    counts = np.stack([np.bincount(x, minlength=256) for x in flat]).astype(np.float64)
    below, mass = np.cumsum(counts, axis=1), np.cumsum(counts * np.arange(256), axis=1)
    n, total = below[:, -1:], mass[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (total * below - mass * n) ** 2 / (below * (n - below))
    return np.nan_to_num(between, nan=-1.0, posinf=-1.0).argmax(axis=1).reshape(image.shape[:-2])


def binarised(image: np.ndarray) -> np.ndarray:
    """255 above the image's threshold, else 0."""
    return np.where(image > otsu(image)[..., None, None], 255, 0).astype(np.uint8)


def gaussian(size: int) -> np.ndarray:
    """Weights of a window of odd size, with the deviation that belongs to it."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return w / w.sum()


def _along(image: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted means along an axis; beyond the edge its value goes on."""
    r = len(weights) // 2
    pad = [(0, 0)] * image.ndim
    pad[axis] = (r, r)
    wide, n = np.pad(image, pad, mode="edge"), image.shape[axis]
    return sum(w * np.take(wide, range(k, k + n), axis=axis) for k, w in enumerate(weights))


def adaptive(image: np.ndarray, block: int = BLOCK, offset: float = OFFSET) -> np.ndarray:
    """255 where a value is above the weighted mean of its window less offset, else 0. The window is separable: two passes of block terms."""
    weights = gaussian(block)
    mean = np.floor(_along(_along(image.astype(np.float64), weights, -1), weights, -2) + 0.5)
    return np.where(image > mean - offset, 255, 0).astype(np.uint8)


def closed(image: np.ndarray, size: int = CLOSING) -> np.ndarray:
    """The greatest and then the least value of a square, its anchor right below its middle: dark specks that are smaller go."""
    before, after = size // 2, size - 1 - size // 2

    def extreme(x: np.ndarray, f, lead: int, trail: int, beyond: int) -> np.ndarray:
        for axis in (-1, -2):
            pad = [(0, 0)] * x.ndim
            pad[axis] = (lead, trail)
            wide, n = np.pad(x, pad, constant_values=beyond), x.shape[axis]
            x = f.reduce([np.take(wide, range(k, k + n), axis=axis) for k in range(size)])
        return x

    return extreme(extreme(image, np.maximum, before, after, 0), np.minimum, after, before, 255)


def page_image(image: np.ndarray) -> np.ndarray:
    """A page for an engine of its own machine: grey, adaptive threshold, closing."""
    return closed(adaptive(grey(image) if image.ndim > 2 and image.shape[-1] in (3, 4) else image))


def bounded_size(width: int, height: int, least: int = LONG_LEAST, most: int = LONG_MOST) -> tuple[int, int]:
    """Width and height whose longer one is between least and most, as text.resized() has them."""
    edge = max(width, height)
    if edge > most:
        aspect = width / max(height, 1)
        nearest = lambda x, key: max(min(math.floor(x), math.ceil(x), key=key), 1)
        if aspect > 1:
            return most, nearest(most / aspect, lambda n: 0 if n == 0 else abs(aspect - most / n))
        return nearest(most * aspect, lambda n: abs(aspect - n / most)), most
    if edge < least:
        scale = least / max(edge, 1)
        return math.floor(width * scale), math.floor(height * scale)
    return width, height


def _weights(old: int, new: int) -> np.ndarray:
    """A matrix (new, old) of triangular weights, as wide as the scale where it shrinks."""
    scale = old / new
    support = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    w = np.maximum(0.0, 1 - np.abs((np.arange(old) + 0.5)[None, :] - centre[:, None]) / support)
    return w / w.sum(axis=1, keepdims=True)


def resampled(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image (height, width[, channels]) in another size: two matrix products, one for each axis."""
    x = image.astype(np.float64)
    x = np.tensordot(_weights(x.shape[0], height), x, (1, 0))
    x = np.moveaxis(np.tensordot(_weights(x.shape[1], width), x, (1, 1)), 0, 1)
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def for_model(image: np.ndarray, least: int = LONG_LEAST, most: int = LONG_MOST) -> np.ndarray:
    """The image with its long edge between least and most; with (1, EDGE_MOST) it is only made smaller."""
    width, height = bounded_size(image.shape[1], image.shape[0], least, most)
    return image if (height, width) == image.shape[:2] else resampled(image, width, height)
