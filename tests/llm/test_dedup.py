from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from quire.llm import decontam, exact_dedup, line_dedup, simhash
from quire.llm.components import components, forest

from .conftest import make, sentence

GONE = re.compile("[\x20\x09-\x0d]")


def test_exact_dedup_against_brute_force(odd, odd_rows):
    got = sorted(map(tuple, exact_dedup.exact_dedup(odd).collect()), key=repr)
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[GONE.sub("", t or "")].append((i, t or ""))
    want = []
    for text, own in groups.items():
        most = max(len(t) for _, t in own)
        keep = min((i for i, t in own if len(t) == most and i is not None), default=None)
        want += [(i, keep, len(own), i == keep and len(t) == most, hashlib.sha256(text.encode()).hexdigest()) for i, t in own]
    assert got == sorted(want, key=repr)


def test_exact_dedup_of_no_rows_and_kept_columns(spark, odd):
    assert exact_dedup.exact_dedup(odd.limit(0)).collect() == []
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {8, 9, 10, 13}
    assert not {6, 7} & {r.doc_id for r in kept.collect()}


def test_ids_of_other_types(spark, odd):
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert sorted(x.keep_id for x in exact_dedup.exact_dedup(named).collect() if x.doc_id == "d7") == ["d8"]
    least = spark.createDataFrame([(-(1 << 63), "x"), (5, "x")], "doc_id long, text string")
    assert {x.keep_id for x in exact_dedup.exact_dedup(least).collect()} == {-(1 << 63)}
    assert {x.component_id for x in simhash.near_dedup(named).collect() if x.doc_id in ("d6", "d7")} == {"d6"}
    assert line_dedup.line_dedup(named).count() == odd.count()
    assert [tuple(x) for x in decontam.leaks(named, spark.createDataFrame([("i", "one two")], "item_id string, text string")).collect()] == [("d5", "i", 1.0, 0)]


def test_chunks_are_local_to_an_edit(spark):
    r = random.Random(2)
    text = "".join(sentence(r, "aa", 4000).split())
    changed = text[:9000] + "zz" + text[9000:]
    rows = spark.createDataFrame([(text,), (changed,)], "t string").select(exact_dedup.chunks(exact_dedup.normalised("t")).alias("c")).collect()
    a, b = (row.c for row in rows)
    assert "".join(a) == text and len(a) > 10
    assert len(set(b) - set(a)) <= 2


def test_salts_change_when_an_identifier_stands_for_two_chunks(spark, monkeypatch):
    docs = make(spark, [(1, "a" * 900), (2, "b" * 900)])
    plain = exact_dedup.identifier
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "identifier", lambda c, salt: plain(c, salt) if salt else F.struct(F.lit(1).alias("a"), F.lit(1).alias("b")))
    assert exact_dedup.verified_salt(docs) == 2
    assert {r.group_size for r in exact_dedup.exact_dedup(docs).collect()} == {1}


def _fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _linked(fps: list[int]) -> list[int]:
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_dedup_against_brute_force(spark, odd_rows):
    r = random.Random(3)
    base = sentence(r, "aa", 300).split()
    near = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 300, 25)]
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(near))]
    got = simhash.near_dedup(make(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {i: _fingerprint(t) for i, t in rows if i is not None and i != 10}
    for row in got:
        if row.doc_id in want:
            assert int(row.fingerprint, 16) == want[row.doc_id] and len(row.fingerprint) == 16
    roots = _linked([int(row.fingerprint, 16) for row in got])
    for row, root in zip(got, roots):
        assert row.component_id == min((x.doc_id for x, y in zip(got, roots) if y == root and x.doc_id is not None), default=None)


def test_near_dedup_of_no_rows(odd):
    assert simhash.near_dedup(odd.limit(0)).collect() == []
    assert simhash.keep_one(odd).columns == odd.columns


def test_golay_keys_meet_within_one_bit():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 22, 5000)
    y = x ^ np.where(r.integers(0, 23, 5000) < 22, 1 << r.integers(0, 22, 5000), 0)
    (a, n), (b, _) = simhash.codewords(x), simhash.codewords(y)
    assert all(b[i, 0] in a[i, : n[i]] for i in range(5000))


def test_crowded_buckets_keep_all_links(spark):
    r = np.random.default_rng(1)
    centre = int(r.integers(0, 1 << 62))
    fps = sorted({centre ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 5)), replace=False)) for _ in range(250)})
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for crowd, tile in ((4, 16), (64, 2048)):
        label = {row.node: row.label for row in components(simhash.links(df, crowd=crowd, tile=tile)).collect()}
        roots = _linked(fps)
        groups = defaultdict(set)
        for f, root in zip(signed, roots):
            groups[root].add(label.get(f, f))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_forest_connects_what_is_near():
    a, b = forest(np.array([0, 1, 3, 1 << 40, 1 << 41], np.int64), 1)
    assert set(zip(a.tolist(), b.tolist())) == {(0, 1), (1, 3), (0, 1 << 40), (0, 1 << 41)}


def _lines_brute(rows, least):
    """Lines that a run of at least so many words covers that an earlier place has: by comparing every run with every other."""
    seqs = {i: [(k, x) for k, x in enumerate((t or "").split("\n")) if x.split()] for i, t in rows}
    runs = defaultdict(list)
    for i, lines in seqs.items():
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(len(x.split()) for _, x in lines[s:e]) >= least:
                    runs[tuple(x for _, x in lines[s:e])].append((i, s, [k for k, _ in lines[s:e]]))
    gone = defaultdict(set)
    for own in runs.values():
        for i, _, lines in sorted(own)[1:]:
            gone[i] |= set(lines)
    return gone


def test_line_dedup_against_brute_force(spark):
    r = random.Random(4)
    pool = [sentence(r, "aa", n) for n in (1, 2, 3, 4, 5, 6, 12, 15)] + ["", "  "]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.8 else sentence(r, "bb", 6) for _ in range(r.randint(1, 12)))) for i in range(60)]
    for least in (10, 5):
        gone = _lines_brute(rows, least)
        got = {x.doc_id: x for x in line_dedup.line_dedup(make(spark, rows), least).collect()}
        assert sum(map(len, gone.values())) > 40
        for i, t in rows:
            lines = t.split("\n")
            assert got[i].text == "\n".join(x for k, x in enumerate(lines) if k not in gone[i])
            assert (got[i].n_lines, got[i].n_deleted) == (len(lines), len(gone[i]))


def test_line_dedup_of_odd_rows(odd, odd_rows):
    got = line_dedup.line_dedup(odd).collect()
    assert len(got) == len(odd_rows)
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    assert by[1][0].text is None and by[2][0].text == "" and by[16][0].text == "\n"
    assert by[6][0].n_deleted == 0 and by[7][0].n_deleted == 2 and by[7][0].text == ""
    assert by[9][0] == by[9][1] and by[9][0].n_deleted == 0
    assert by[14][0].n_deleted == 1
    assert line_dedup.line_dedup(odd.limit(0)).collect() == []
    kept = line_dedup.keep_lines(odd)
    assert kept.columns == odd.columns and 7 not in {x.doc_id for x in kept.collect()}


def _shingles(t):
    w = (t or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def _leaks_brute(docs, items, similarity=0.8):
    from collections import Counter

    out = {}
    for i, t in docs:
        s = _shingles(t)
        for k, g in items:
            g = _shingles(g)
            if s and g:
                n = len(g)
                best = max(sum((Counter(s[a : a + n]) & Counter(g)).values()) / (len(s[a : a + n]) + n - sum((Counter(s[a : a + n]) & Counter(g)).values())) for a in range(max(1, len(s) - n + 1)))
                if best >= similarity:
                    out[i, k] = max(out.get((i, k), 0), best)
    return out


@pytest.fixture(scope="module")
def bench():
    r = random.Random(5)
    return [(k, sentence(r, "aa", 25 + 3 * k)) for k in range(8)] + [(8, "one"), (9, None), (10, ""), (11, " ".join(["again and"] * 20)), (12, "only three words")]


@pytest.mark.parametrize(("similarity", "broadcast"), [(0.8, 32 << 20), (0.8, 0), (0.5, 32 << 20), (0.3, 0), (1.0, 0)])
def test_decontamination_against_brute_force(spark, bench, monkeypatch, similarity, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", broadcast)
    r = random.Random(6)
    docs = [(1, None), (2, ""), (3, "one"), (4, "Only three WORDS"), (None, bench[0][1])]
    for i in range(10, 50):
        words = bench[i % 8][1].split()
        if i % 3 == 0:
            words[r.randrange(len(words))] = "other"
        if i % 7 == 0:
            words.insert(r.randrange(len(words)), "more")
        if i % 11 == 0:
            words = words[: len(words) * 9 // 10]
        docs.append((i, " ".join([sentence(r, "bb", r.randint(0, 40)), *words, sentence(r, "bb", r.randint(0, 40))]).strip().upper()))
    docs += [(60, " ".join(["again and"] * 33)), (61, bench[2][1] + " " + bench[2][1]), (62, " ".join(bench[3][1].split()[10:]) + " " + bench[3][1] + " " + bench[4][1])]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontam.leaks(make(spark, docs), items, similarity).collect()}
    want = _leaks_brute(docs, bench, similarity)
    assert len(want) > 12 and got == pytest.approx(want)
    if similarity != 0.8:
        return
    kept = decontam.keep_clean(make(spark, docs), items)
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_radius_follows_from_the_similarity():
    assert decontam.radius(0.8) == 23 and decontam.radius(1.0) == 0 and decontam.radius(0.5) > decontam.radius(0.6) > 23
    with pytest.raises(ValueError):
        decontam.radius(0.0)


def test_placed_shingles_are_the_arrays(spark, odd):
    got = decontam.placed_shingles(odd.select(F.monotonically_increasing_id().alias("k"), "text").cache()).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("s"))
    want = odd.select(F.monotonically_increasing_id().alias("k"), decontam.shingles("text").alias("s")).filter(F.size("s") > 0)
    assert {x.k: [y.x for y in x.s] for x in got.collect()} == {x.k: x.s for x in want.collect()}


def test_decontamination_of_no_rows(spark, odd, bench):
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert decontam.leaks(odd.limit(0), items).collect() == []
    assert decontam.leaks(odd, items.limit(0)).collect() == []


def test_native_simhash_is_the_majority(spark):
    r = random.Random(7)
    lists = [[r.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (0, 1, 2, 3, 44, 300)]
    got = [x.s for x in spark.createDataFrame([(i, h) for i, h in enumerate(lists)], "i int, h array<long>").orderBy("i").select(decontam.simhash(F.col("h")).alias("s")).collect()]
    for s, h in zip(got, lists):
        assert s & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_candidates_stay_few_where_items_share_stock_phrases(spark):
    """Many items of one length that share most of a passage: a document is compared with the items that it may hold, not with all."""
    r = random.Random(77)
    stock = [f"s{i}" for i in range(12)]
    items = [(f"i{k}", " ".join(stock[:8] + [f"w{k}x{j}" for j in range(20)] + stock[8:])) for k in range(400)]
    docs = [(k, " ".join([f"d{k}y{j}" for j in range(30)] + stock + [f"e{k}y{j}" for j in range(30)])) for k in range(200)]
    docs += [(1000 + k, " ".join([f"f{k}"] + items[k][1].split() + [f"g{k}"])) for k in range(0, 400, 40)]
    r.shuffle(docs)
    bench = spark.createDataFrame(items, "item_id string, text string")
    listed = bench.select(F.xxhash64("item_id").alias("g"), decontam.shingles("text").alias("goal")).withColumn("n", F.size("goal")).cache()
    known = listed.select(F.explode("goal").alias("h")).distinct()
    hits = decontam.placed_shingles(make(spark, docs).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text")).join(known, F.col("x") == F.col("h")).select("id", "t", "p", "x")
    assert hits.count() * 400 > 100_000 > 1000 > decontam.candidates(hits, listed, 0.8).count() == 10
    assert sorted((x.doc_id, x.item_id) for x in decontam.leaks(make(spark, docs), bench).collect()) == sorted((1000 + k, f"i{k}") for k in range(0, 400, 40))


def test_items_that_repeat_an_id_keep_their_own_lengths(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([("i", " ".join(words[:12])), ("i", " ".join(words[20:40])), ("j", " ".join(words[:12])), (None, " ".join(words[20:40]))], "item_id string, text string")
    got = decontam.leaks(make(spark, [(1, "x " + " ".join(words[:12]) + " y"), (2, " ".join(words[20:40]))]), items).collect()
    assert sorted((x.doc_id, x.item_id or "", x.similarity) for x in got) == [(1, "i", 1.0), (1, "j", 1.0), (2, "", 1.0), (2, "i", 1.0)]
