from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

import corpus_pipeline
from quire.llm import minhash

from .conftest import make, sentence


def _set(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _groups(rows):
    """Row numbers by group, from all pairs."""
    sets, root = [_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if not either or len(sets[i] & sets[j]) / either >= 0.8:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    out = defaultdict(list)
    for i, x in enumerate(root):
        out[x].append(i)
    return list(out.values())


def _edited(r, words, n):
    words = list(words)
    for at in r.sample(range(len(words)), n):
        words[at] = "w" + str(r.randrange(10**6))
    return " ".join(words)


def _rows():
    """Bases of 100 words and copies of them with 0 to 5 words changed; each change costs up to five shingles."""
    r = random.Random(8)
    rows = []
    for base in range(12):
        words = sentence(r, "aa", 100).split()
        rows += [(base * 10 + i, _edited(r, words, i % 6)) for i in range(8)]
    return rows


def test_stage_finds_copies_of_similarity_from_four_fifths_on(spark, odd_rows):
    rows = [*_rows(), *((1000 + (i or 0) if i is not None else None, t) for i, t in odd_rows)]
    groups = _groups(rows)
    assert 20 < sum(len(g) - 1 for g in groups) and len(groups) > 30
    got = corpus_pipeline.near_copies(spark, make(spark, rows), "").collect()
    gone = {rows[i][0] for g in groups for i in g if rows[i][0] != min((rows[j][0] for j in g if rows[j][0] is not None), default=None)}
    assert sorted((x.doc_id for x in got), key=repr) == sorted((i for i, _ in rows if i not in gone), key=repr)


def test_crowded_keys_keep_all_groups(spark):
    rows = _rows()
    want = {rows[i][0]: min(rows[j][0] for j in g) for g in _groups(rows) for i in g}
    for crowd, tile in ((1, 150), (1, 1 << 19), (3, 400)):
        assert {x.doc_id: x.component_id for x in minhash.near_copies(make(spark, rows), crowd=crowd, tile=tile).collect()} == want


def test_bands_meet_at_four_fifths():
    r = np.random.default_rng(9)
    for _ in range(300):
        x = np.unique(r.integers(0, 1 << 63, 100, np.uint64))
        y = np.unique(np.concatenate([x[:-11], r.integers(0, 1 << 63, 11, np.uint64)]))
        assert (minhash.band_keys(x) == minhash.band_keys(y)).any()


def test_near_copies_of_no_rows(odd):
    assert minhash.near_copies(odd.limit(0)).collect() == []
    assert minhash.keep_one(odd).columns == odd.columns
