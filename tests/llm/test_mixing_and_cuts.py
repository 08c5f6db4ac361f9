"""Token alignment, mixing and fill-in-the-middle against plain definitions."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import fill_middle, mixing, token_links
from quire.llm.queries import QUERIES, SQL

from .conftest import make, sentence

DATA = "/root/testdata/sf0.01"
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
HARD = ["<|endoftext|> x", "a <s></s> b", "▁mark", " lead", "trail ", "tab\tand\n\nlines  two", "\x00nul", "é ﬁ 😀 \U0001d400", "x" * 3000, "=" * 200, "don't it's 123456", "  　 wide"]


def _ids():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def _plain_alignment(texts):
    """Of each text, the groups and links, walked token by token."""
    first, second = _ids()
    letters = token_links._byte_letters()
    out = []
    for t in texts:
        a = b = []
        if t:
            a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
        a_bytes = [bytes(letters[c] for c in first.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append(([], [], [], []))
            continue
        ends = lambda own: np.cumsum([len(x) for x in own]).tolist()
        ea, eb = ends(a_bytes), ends(b_bytes)
        of_a, of_b = ({e: k for k, e in enumerate(x)} for x in (ea, eb))
        groups, i, j = [], 0, 0
        for c in sorted(set(ea) & set(eb)):
            k, m = of_a[c] + 1, of_b[c] + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        links = [(a[of_a[x]], b[of_b[x]]) for x in ea if x in of_b]
        out.append((a, b, groups, links))
    return out


def _plain_links(rows):
    found = _plain_alignment([t for _, t in rows])
    counts = Counter(x for *_, links in found for x in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, found):
        print_ = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(print_.encode()).hexdigest() if groups else ""))
    return out


def _texts():
    r = random.Random(5)
    own = [sentence(r, lang, r.randint(1, 40)) for lang in ("aa", "bb") for _ in range(30)]
    return own + ["".join(r.choice(" \t\nab😀é<>▁1'.,") for _ in range(r.randint(1, 50))) for _ in range(60)] + HARD


@pytest.mark.parametrize("hot", [1 << 19, 40, 1])
def test_linked_tokens_against_a_walk(spark, odd, odd_rows, hot):
    """With few hot pairs, most or all links meet their counts in the shuffle."""
    rows = [*odd_rows, *enumerate(_texts(), 100)]
    got = token_links.linked_tokens(odd.select("doc_id", "text").unionAll(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string")), hot_pairs=hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, _plain_links(rows)))
    assert token_links.linked_tokens(odd.limit(0)).collect() == []


def test_aligned_groups(spark):
    texts = _texts()
    got = {x.doc_id: x for x in token_links.align_documents(make(spark, list(enumerate(texts)))).collect()}
    for i, (a, b, groups, _) in enumerate(_plain_alignment(texts)):
        x = got[i]
        assert (x.a, x.b) == (a, b)
        at, made = (0, 0), []
        for g in x.groups:
            made.append((x.a[at[0] : g.a_upto], x.b[at[1] : g.b_upto]))
            at = g.a_upto, g.b_upto
        assert made == groups and (not groups or x.groups[-1].byte == len((" " + texts[i]).encode()))


def test_marks_rank_and_select():
    r = random.Random(6)
    for n in (1, 63, 64, 65, 200):
        for _ in range(20):
            a, b = (np.array(sorted(r.sample(range(n), r.randint(0, n))), np.int64) for _ in range(2))
            both = token_links.Marks.at(a, n) & token_links.Marks.at(b, n)
            assert both.select().tolist() == sorted(set(a.tolist()) & set(b.tolist()))
            assert token_links.Marks.at(a, n).rank(np.arange(n)).tolist() == [sum(a <= k) for k in range(n)]


def test_hot_pairs_are_as_few_as_said(spark):
    own = token_links.aligned_digests(make(spark, list(enumerate(_texts()))))
    counts = token_links.link_counts(own).collect()
    total = sum(x.n for x in counts)
    for most in (1, 7, 50):
        assert sum(x.n * most >= total for x in counts) <= most


def _plain_fill(i, t):
    t = t or ""
    own = re.findall(f"{SPACE}*{WORD}+|{SPACE}+", t)
    n, h = len(own), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(own[:low]), "".join(own[low:high]), "".join(own[high:])
    form = "plain" if t == "" or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
    out = {"plain": t, "spm": f"<S>{s}<P>{p}<M>{m}", "psm": f"<P>{p}<S>{s}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, n, form, *((None, None) if form == "plain" else (len(p), len(m))), sha(out), sha(t))


def test_fill_in_middle_against_a_regular_expression(spark, odd, odd_rows):
    r = random.Random(7)
    rows = [*odd_rows, *[(i, "".join(r.choice(" \t\nab😀é<>PSM　\x1c") for _ in range(r.randint(0, 60)))) for i in range(100, 1500)], (1600, "<P> a"), (1601, "a <S"), (1602, " a" * 50_000), (1603, "<" * 40)]
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string"))
    got = [tuple(x) for x in fill_middle.fill_digest(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr(_plain_fill(*x)) for x in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_digest(odd.limit(0)).collect() == []
    assert [tuple(x)[1:3] for x in fill_middle.fill_digest(make(spark, [(1, None), (2, "")])).collect()] == [(0, "plain")] * 2


def test_fill_in_middle_by_code_points_and_other_marks(spark, odd, odd_rows):
    made = fill_middle.fill_in_middle(odd, rate=100, unit="char", marks=("\x01p", "\x01s", "\x01m"), slice_bytes=64)
    got = made.withColumn("text", fill_middle.restored(marks=("\x01p", "\x01s", "\x01m"))).collect()
    assert sorted(repr((x.doc_id, x.text)) for x in got) == sorted(repr((i, t or "")) for i, t in odd_rows)
    assert all(x.n == len(x.text) and (x.form == "plain") == (x.text == "") for x in got)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(odd, marks=("aa", "ab", "ac"))
    for text in ("", "a", "é😀b", " x  ü"):
        data = np.frombuffer(text.encode(), np.uint8)
        runs = fill_middle.Runs.of(data, np.array([0, len(data)]), "char")
        assert [int(runs.cut(np.array([0]), np.array([k]))[0]) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]


def test_runs_hold_units_and_classes():
    data, bounds = np.frombuffer(b" a  bc d ", np.uint8), np.array([0, 3, 3, 9])
    runs = fill_middle.Runs.of(data, bounds)
    assert runs.end.tolist() == [1, 2, 3, 4, 6, 7, 8, 9] and runs.blank.tolist() == [True, False] * 0 + [True, False, True, True, False, True, False, True]
    assert runs.units.tolist() == [0, 1, 2, 2, 3, 3, 4, 5]
    assert np.diff(runs.before(bounds)).tolist() == [2, 0, 3]


@pytest.mark.parametrize("name", ["op12_mix_pareto", "op13_fill_middle"])
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_against_sql(spark, name):
    got = QUERIES[name](spark, DATA)
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = db.sql(SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def _mixed(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit("x").alias("target"), F.lit(1).alias("size"), F.lit(2).alias("cell"), F.lit(2).alias("odds"), F.lit(1).alias("u"))


def _sources(seed, n=800):
    r = random.Random(seed)
    names = ["b", "a", "é", "\U0001d400", "￿", "", None]
    return [(i, None if r.random() < 0.03 else sentence(r, "aa", int(r.paretovariate(0.8)) % 900), names[min(int(r.expovariate(0.7)), 6)]) for i in range(n)]


def _targets(words):
    """By source: the words of all, shared by weight until none is above twice its own."""
    order = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in words)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(words.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        level = (total - sum(2 * words[s] for s in full)) / max(sum(weight[s] for s in open_), 1)
        more = {s for s in open_ if 2 * words[s] <= weight[s] * level}
        if not more:
            return {s: 2.0 * words[s] if s in full else weight[s] * level for s in order}
        full |= more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rows = _sources(seed)
    docs = _mixed(spark, rows)
    got = mixing.mixed_sources(docs).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(f"{WORD}+", t or "")) for i, t, _ in rows}
    source, words = {i: s for i, _, s in rows}, Counter()
    for i, n in size.items():
        words[source[i]] += n
    want, taken = _targets(words), Counter()
    for x in got:
        assert (x.size, x.source_size) == (size[x.doc_id], words[source[x.doc_id]]) and 0 <= x.taken <= 2 * x.size
        assert x.target == pytest.approx(want[source[x.doc_id]], rel=1e-12)
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want) and sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), abs=len(want))
    # all but one document of a source give whole copies, and of one number or the next
    for s in want:
        own = [x for x in got if source[x.doc_id] == s and x.size]
        assert sum(x.taken % x.size != 0 for x in own) <= 1
        assert max((x.taken // x.size for x in own), default=0) - min((-(-x.taken // x.size) for x in own), default=0) <= 1
    again = mixing.mixed_sources(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    small = mixing.mix(docs, cell_rows=3).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, small)) == sorted(map(repr, got))


def test_mix_of_odd_rows_against_sql(spark, odd):
    rows = [*_sources(4, 200), (5, "same text here", "a"), (5, "same text here", "a"), (5, "other", "a"), (None, "no id", "z"), (None, None, "z"), (7, "  ", "blank"), *[(9, "one two three", "crowd")] * 40]
    docs = _mixed(spark, rows)
    got = mixing.mixed_sources(docs).collect()
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    want = db.sql(f"select doc_id, size, source_size, target, taken from ({SQL['op12_mix_pareto']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert mixing.mixed_sources(odd.limit(0)).collect() == [] and mixing.mixed_sources(odd).count() == odd.count()
    nothing = mixing.mixed_sources(_mixed(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(x.target, x.taken) for x in nothing] == [(0.0, 0)] * 2


def test_every_document_has_its_chance(spark):
    """Over many seeds a document is taken as often as its source's share says, whatever its size."""
    r = random.Random(8)
    docs = _mixed(spark, [(i, sentence(r, "aa", 1 + i % 20), "a" if i % 2 else "b") for i in range(60)]).cache()
    mean, target = Counter(), {}
    for seed in range(8):
        for x in mixing.mix(docs, seed=seed, weights=(1, 2), share=0.6).collect():
            mean[x.size] += x.taken / x.size
            target[x.source] = (x.target / x.source_size, x.source)
    shares = {s: v for s, (v, _) in target.items()}
    total = sum(mean.values()) / 8 / 60
    assert total == pytest.approx((shares["a"] + shares["b"]) / 2, abs=0.08)
    small, large = (sum(v for k, v in mean.items() if lo <= k < hi) / 8 / (3 * (hi - lo)) for lo, hi in ((1, 11), (11, 21)))
    assert abs(small - large) < 0.2


def test_favoured_documents_are_taken_more_often(spark):
    r = random.Random(9)
    docs = _mixed(spark, [(i, sentence(r, "aa", 10), "a") for i in range(300)]).withColumn("liking", F.when(F.col("doc_id") % 10 == 0, 50.0).when(F.col("doc_id") % 3 == 0, 3.0).otherwise(1.0))
    got = mixing.mix(docs, share=1.0, favour="liking").collect()
    assert abs(sum(x.taken for x in got) - got[0].target) <= 1 and all(x.taken <= 2 * x.size for x in got)
    by = defaultdict(list)
    for x in got:
        by[0 if x.doc_id % 10 == 0 else 1 if x.doc_id % 3 == 0 else 2].append(x.taken / x.size)
    means = [sum(by[k]) / len(by[k]) for k in range(3)]
    assert means[0] == 2 and means[0] > means[1] > means[2]
