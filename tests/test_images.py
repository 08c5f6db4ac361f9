"""Image kernels against definitions written as loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import images as I
from quire.functions import text as T
from quire.plans.cascade import Engines, prepared, process_pages


def _otsu(x):
    best, at = -1.0, 0
    for t in range(256):
        a, b = x[x <= t].astype(float), x[x > t].astype(float)
        if len(a) and len(b) and (v := len(a) * len(b) * (a.mean() - b.mean()) ** 2) > best * (1 + 1e-12) + 1e-9:
            best, at = v, t
    return at


def _adaptive(x, block, offset):
    w, r = I.gaussian(block), block // 2
    out = np.zeros_like(x)
    for i in range(x.shape[0]):
        for j in range(x.shape[1]):
            mean = sum(w[a + r] * w[b + r] * float(x[min(max(i + a, 0), x.shape[0] - 1), min(max(j + b, 0), x.shape[1] - 1)]) for a in range(-r, r + 1) for b in range(-r, r + 1))
            out[i, j] = 255 if x[i, j] > math.floor(mean + 0.5) - offset else 0
    return out


def _closed(x):
    at = lambda y, i, j, beyond: int(y[i, j]) if 0 <= i < y.shape[0] and 0 <= j < y.shape[1] else beyond
    wide = np.array([[max(at(x, i - a, j - b, 0) for a in (0, 1) for b in (0, 1)) for j in range(x.shape[1])] for i in range(x.shape[0])])
    return np.array([[min(at(wide, i + a, j + b, 255) for a in (0, 1) for b in (0, 1)) for j in range(x.shape[1])] for i in range(x.shape[0])])


def test_kernels():
    r = np.random.default_rng(1)
    for h, w in ((1, 1), (5, 9), (20, 17)):
        x = r.integers(0, 256, (h, w), np.uint8)
        two = np.where(r.random((h, w)) < 0.5, r.integers(0, 60, (h, w)), r.integers(180, 256, (h, w))).astype(np.uint8)
        for y in (x, two, np.full((h, w), 7, np.uint8)):
            assert int(I.otsu(y)) == _otsu(y) or len(np.unique(y)) == 1
            assert (I.binarised(y) == np.where(y > I.otsu(y), 255, 0)).all()
            assert (I.adaptive(y) == _adaptive(y, 15, 8)).all() and (I.closed(y) == _closed(y)).all()
    stack = r.integers(0, 256, (4, 6, 8), np.uint8)
    assert I.otsu(stack).tolist() == [int(I.otsu(s)) for s in stack] and (I.adaptive(stack) == np.stack([I.adaptive(s) for s in stack])).all() and (I.closed(stack) == np.stack([I.closed(s) for s in stack])).all()
    assert I.grey(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8)).tolist() == [[76, 150, 29]]


def test_resampling():
    assert (I.resampled(np.full((30, 50), 9, np.uint8), 20, 70) == 9).all()
    line = np.repeat(np.arange(0, 200, dtype=np.uint8)[None, :], 10, axis=0)
    half = I.resampled(line, 100, 10)
    assert half.shape == (10, 100) and np.abs(half[:, 5:-5].astype(float) - (np.arange(100) * 2 + 0.5)[None, 5:-5]).max() <= 1
    assert I.resampled(np.zeros((4, 6, 3), np.uint8), 3, 2).shape == (2, 3, 3)


@pytest.mark.parametrize("least, most", [(I.LONG_LEAST, I.LONG_MOST)])
def test_sizes_are_those_of_the_column(spark, least, most):
    r = np.random.default_rng(2)
    sizes = [(int(a), int(b)) for a, b in r.integers(1, 4000, (300, 2))] + [(1, 4000), (4000, 1), (1280, 1280), (896, 1), (895, 895)]
    got = spark.createDataFrame(sizes, "w int, h int").select("w", "h", T.resized("w", "h").alias("r")).collect()
    assert [(x.r.width, x.r.height) for x in got] == [I.bounded_size(x.w, x.h) for x in got]
    assert max(I.for_model(np.zeros((700, 2000), np.uint8), 1, I.EDGE_MOST).shape) == I.EDGE_MOST


def test_engines_get_prepared_images(spark):
    """Pages of raw grey values, 40 by 60, through threshold, closing and resampling before an engine sees them."""
    raw = np.random.default_rng(3).integers(0, 256, (40, 60), np.uint8)
    seen = lambda x: f"an image of {x.shape[1]} by {x.shape[0]} with {len(np.unique(x))} values"
    load = lambda data: np.frombuffer(data, np.uint8).reshape(40, 60)
    pages = spark.createDataFrame([("d", 1, "", raw.tobytes())], "doc_id string, page_number int, text string, image binary")
    pages = pages.withColumns({"tables": F.lit(None).cast("array<array<array<string>>>"), "images": F.array().cast("array<struct<width:int,height:int>>")})
    first = process_pages(pages, Engines(prepared(seen, load, I.page_image))).first()
    model = process_pages(pages, Engines(model=prepared(seen, load, I.for_model))).first()
    assert (first.full_text, first.engine) == ("an image of 60 by 40 with 2 values", "surya") and model.full_text.startswith("an image of 896 by 597 with ")
    assert [(c.engine, c.attempt, c.failed) for c in model.calls] == [("ollama", 1, False)] and model.ms >= 0
