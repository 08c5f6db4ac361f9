from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quire.llm import byte_pieces, langid, rans, shard, spiece, token_files, toxicity, warc

from .conftest import LANGUAGES, make, sentence


def test_sharding_keeps_groups_and_balances(odd, odd_rows):
    got = shard.shard_documents(odd, shards=4).collect()
    assert len(got) == len(odd_rows)
    by_text, slots = defaultdict(set), defaultdict(list)
    texts = defaultdict(set)
    for i, t in odd_rows:
        texts[i].add(t)
    for x in got:
        slots[x.shard].append(x.slot)
        if len(texts[x.doc_id]) == 1:
            (t,) = texts[x.doc_id]
            by_text[t].add(x.shard)
            assert (x.size, x.text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(x.law, x.grown_shard) for x in got} == {("bytes", None)}
    assert shard.shard_documents(odd.limit(0), shards=4).collect() == []


def test_bytes_are_near_equal_and_capacity_is_kept(spark):
    r = random.Random(1)
    docs = make(spark, [(i, sentence(r, "aa", r.randint(1, 60))) for i in range(400)])
    total = Counter()
    for x in shard.shard_documents(docs, shards=16).collect():
        total[x.shard] += x.size
    assert len(total) == 16 and max(total.values()) - min(total.values()) <= 0.01 * max(total.values())
    total.clear()
    for x in shard.shard_documents(docs, shards=None, capacity=3000).collect():
        total[x.shard] += x.size
    assert max(total.values()) <= 3000 and len(total) <= sum(total.values()) / 3000 * 11 / 9 + 1


def test_rows_that_share_id_and_text_are_spread_and_sizes_rounded_up(spark):
    docs = spark.range(3000).selectExpr("1L as doc_id", "'same' as text")
    got = shard.shard_documents(docs, shards=4).collect()
    assert len({x.shard for x in got}) == 1 and sorted(x.slot for x in got) == list(range(3000))
    sizes = [1, 4095, 4096, 4097, 123_456_789, (1 << 40) + 1]
    up = [x.c for x in spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long").orderBy("i").select(shard.size_class(F.col("n")).alias("c")).collect()]
    assert up[:3] == sizes[:3] and all(n <= u <= n * (1 + 1 / 2048) for n, u in zip(sizes, up))
    kept = spark.createDataFrame([(4097,)], "n long").select(shard.size_class(F.col("n"), 4097).alias("c")).first().c
    assert kept == 4097


def test_best_fit_decreasing_against_a_plain_one():
    r = random.Random(2)
    for _ in range(40):
        sizes = [r.randint(1, 60) for _ in range(r.randint(1, 80))]
        rooms: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [i for i, x in enumerate(rooms) if x >= s]
            if fits:
                rooms[min(fits, key=lambda i: (rooms[i], i))] -= s
            else:
                rooms.append(100 - s)
        got: Counter = Counter()
        for s, n, b in shard.best_fit_decreasing(list(Counter(sizes).items()), 100):
            got[b] += s * n
        assert sorted(got.values()) == sorted(100 - x for x in rooms)


def test_groups_larger_than_a_share_have_bins_of_their_own():
    placed = shard.pack_into([(1000, 1), (10, 60)], 4)
    own = Counter()
    for s, n, b in placed:
        own[b] += s * n
    assert sorted(own.values()) == [200, 200, 200, 1000]


def test_language_is_found_in_held_out_texts(spark):
    r = random.Random(3)
    rows = [(i, sentence(r, lang, r.randint(3, 40)), lang) for i in range(200) for lang in [list(LANGUAGES)[i % 2]]]
    got = langid.language_id(make(spark, rows)).collect()
    truth = {i: lang for i, _, lang in rows}
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    held = [x for x in got if x.held_out]
    assert len(held) > 20 and sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.98 * len(held)
    assert all(0 <= x.score <= 1 for x in got)


def test_language_of_odd_rows(spark, odd, odd_rows):
    got = langid.language_id(odd).collect()
    assert len(got) == len(odd_rows)
    und = {x.doc_id for x in got if x.lang_pred == "und"}
    assert {1, 2, 3, 11, 15} - {15} <= und and 6 not in und
    assert langid.language_id(odd.limit(0)).collect() == []
    assert {x.lang_pred for x in langid.identify(odd, None).collect()} == {"und"}
    assert langid.keep_identified(odd).columns == odd.columns


def test_emoji_without_letters_have_no_language(spark):
    r = random.Random(31)
    rows = [(i, sentence(r, lang, 12), lang) for i in range(40) for lang in [list(LANGUAGES)[i % 2]]]
    got = {x.doc_id: x for x in langid.language_id(make(spark, [*rows, (100, "😀 123"), (101, "\U0001f600\U0001f680"), (102, "\U00010400")])).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101)] == [("und", 0.0)] * 2
    assert [len(x) for x in langid.presence(["😀 123"])] == [0, 0]
    assert got[102].lang_pred != "und" and (langid.presence(["\U00010400"])[1] == langid.presence(["\U00010428"])[1]).all()


def test_rare_languages_are_learned_too(spark):
    r = random.Random(32)
    own = {f"l{k:03d}": "".join(chr(0x4E00 + 20 * k + i) for i in range(20)) for k in range(203)}
    text = lambda lang: " ".join("".join(r.choice(own[lang]) for _ in range(4)) for _ in range(12))
    rows = [(i, text(lang), lang) for i, lang in enumerate([x for x in own for _ in range(6 if x < "l200" else 4)])]
    got = {x.doc_id: x for x in langid.language_id(make(spark, rows)).collect()}
    learned = {lang for i, _, lang in rows if not got[i].held_out}
    assert len(learned) > 200 and all(got[i].lang_pred == lang for i, _, lang in rows if lang in learned and not got[i].held_out)


def test_scores_are_the_kernel_against_each_landmark():
    r = random.Random(4)
    texts = [sentence(r, lang, 12) for lang in LANGUAGES for _ in range(6)]
    rows, buckets = langid.presence(texts)
    grams = [buckets[rows == i] for i in range(len(texts))]
    model = langid.fit(grams, ["aa"] * 6 + ["bb"] * 6, landmarks=3)
    marks = [0, 1, 2, 6, 7, 8]
    k = lambda i, j: len(set(grams[i]) & set(grams[j])) / (len(grams[i]) * len(grams[j])) ** 0.5
    k_nm = np.array([[k(i, j) for j in marks] for i in range(12)])
    y = np.repeat(np.eye(2), 6, axis=0)
    k_mm = np.array([[k(i, j) for j in marks] for i in marks])
    alpha = np.linalg.solve(k_nm.T @ k_nm + langid.RIDGE * 12 * (k_mm + 1e-6 * np.eye(6)), k_nm.T @ y)
    assert np.allclose(model.scores(texts)[0], k_nm @ alpha, atol=1e-3)


def _toxic(spark, n=700):
    """Toxic: an insult together with a group; neither alone."""
    r = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = sentence(r, "aa", 25).split()
        insult, group = r.random() < 0.5, r.random() < 0.5
        words += ["scoundrel"] * insult + ["martians"] * group
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    return make(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_pairs_decide_toxicity(spark):
    docs, labels = _toxic(spark)
    truth = {x.doc_id: x.toxic for x in labels.collect()}
    got = toxicity.score_toxicity(docs, labels).collect()
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and x.predicted == int(x.score >= 0.7) for x in got)
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held)


def test_the_machine_against_its_definition():
    r = np.random.default_rng(4)
    m = toxicity.Machine(np.arange(20, dtype=np.uint32), 0.3, r.normal(size=20), r.normal(size=(20, 5)))
    for n in (0, 1, 2, 7, 20):
        own = np.sort(r.choice(20, n, replace=False))
        z = m.bias + sum(m.weights[i] for i in own) + sum(float(m.vectors[i] @ m.vectors[j]) for a, i in enumerate(own) for j in own[a + 1 :])
        assert m.score(own) == pytest.approx(1 / (1 + np.exp(-z)))


def test_the_gradient_against_differences():
    r = np.random.default_rng(5)
    x, y = (r.random((30, 6)) < 0.4).astype(float), (r.random(30) < 0.5).astype(float)
    p = {"b": np.array([0.2]), "w": r.normal(size=6), "v": r.normal(size=(6, 3)) * 0.5}
    _, g = toxicity.gradient(x, y, p, 0.01)
    for k in p:
        for at in np.ndindex(p[k].shape):
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (toxicity.gradient(x, y, up, 0.01)[0] - toxicity.gradient(x, y, down, 0.01)[0]) / 2e-5
            assert g[k][at] == pytest.approx(slope, abs=1e-6)


def test_informative_terms_against_brute_force(spark):
    r = random.Random(9)
    rows = [(float(y), sorted(r.sample(range(40), 6) + [100] * y + [101] * (y and r.random() < 0.5))) for y in (int(r.random() < 0.3) for _ in range(200))]
    got = toxicity.informative(spark.createDataFrame(rows, "y double, terms array<long>"), most=5).tolist()

    def g(term):
        out, n = 0.0, len(rows)
        for has in (True, False):
            for y in (0.0, 1.0):
                seen = sum((term in t) == has and v == y for v, t in rows)
                expected = sum((term in t) == has for _, t in rows) * sum(v == y for v, _ in rows) / n
                out += seen * np.log(seen / expected) if seen else 0
        return round(out, 9)

    every = sorted({t for _, ts in rows for t in ts}, key=lambda t: (-g(t), t))
    assert got == sorted(t for t in every[:5] if g(t) >= toxicity.LEAST_G) and 100 in got


def test_toxicity_of_odd_rows(spark, odd, odd_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x.score for x in toxicity.score_toxicity(odd, none).collect()} == {0.0}
    some = spark.createDataFrame([(i, int(i == 6)) for i in range(1, 20)] + [(None, 1), (6, None), (6, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, some).collect()
    assert len(got) == len(odd_rows) and all(0 <= x.score <= 1 for x in got)
    assert toxicity.score_toxicity(odd.limit(0), some).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 31, 33, 1000, 50_000])
def test_rans_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (np.minimum(r.zipf(1.3, n), 50_000), np.full(n, 7), r.integers(0, 1 << 32, min(n, 2000))):
        ids = ids.astype("<u4")
        data = rans.encode(ids, block=4096)
        assert (rans.decode(data) == ids).all()
    if n == 50_000:
        ids = np.minimum(r.zipf(1.3, n), 50_000).astype("<u4")
        data = rans.encode(ids, block=4096)
        assert (rans.decode(data, (3, 5)) == ids[3 * 4096 : 5 * 4096]).all()
        broken = bytearray(data)
        broken[-9] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            rans.decode(bytes(broken))


def test_frequencies_sum_to_the_scale():
    for counts in ([1], [1, 10**9], [1] * 60_000, [3] * 65_536, [10**6, *[1] * 50_000]):
        f = rans.frequencies(np.array(counts, np.int64))
        assert f.sum() == rans.SCALE and f.min() >= 1


def test_token_files_against_the_library(spark, odd, odd_rows, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(odd, path, segment=1000)
    got = token_files.read_token_files(spark, path).collect()
    assert len(got) == len(odd_rows)
    start = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == start and len(x.ids) == 4 * x.n_tokens and zlib.crc32(x.ids) == x.ids_crc32
        start += x.n_tokens
    order = [x.doc_id for x in sorted(got, key=lambda x: x.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    want = Counter((i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in odd_rows)
    assert Counter((x.doc_id, bytes(x.ids)) for x in got) == want
    assert token_files.token_round_trip(odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_seams_don_t_change_ids(name, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    t, own = Tokenizer.from_file(path), byte_pieces.PieceEncoder(path, most=20)
    assert own.seamed == (name == "byte_bpe_50k.json")
    monkeypatch.setattr(byte_pieces, "SLICE_BYTES", 60)
    r = random.Random(6)
    parts = ["a", "I'll", "x,", "é.", "12", "?!", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x85", "\x1c", "<|endoftext|>", "<|end", "日本", "​", "'s", "b\nC", "😀", "Hello.", "\u0301", "foo.\nbar"]
    for k in range(300):
        texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 40 if k % 5 == 0 else 12))) for _ in range(r.randint(1, 6))] + [None] * (k % 3 == 0)
        got: list[list[int]] = [[] for _ in texts]
        for at, ids, sizes in own.encode(pa.array(["x", *texts], pa.string()).slice(1)):
            assert sizes.sum() == len(ids)
            for i, x in enumerate(np.split(ids, np.cumsum(sizes)[:-1]), at):
                got[i] += x.tolist()
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts], texts


def test_token_files_of_a_large_vocabulary_and_a_long_text(spark, tmp_path, monkeypatch):
    ids = np.arange(100_000, dtype="<u4") * 40_000
    assert (rans.decode(rans.encode(ids)) == ids).all() and (rans.decode(rans.encode(ids), (1, 3)) == ids[8192 : 3 * 8192]).all()
    text = " ".join(f"w{i * i % 9973}" for i in range(3_000_000))
    (a, found, n), *more = byte_pieces.piece_encoder(token_files.default_tokenizer()).encode(pa.array([text]))
    assert len(more) >= 1 and all(x[0] == a for x in more)
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(token_files.default_tokenizer()).encode(text[:200_000].rsplit(" ", 1)[0], add_special_tokens=False).ids
    assert found[: len(want)].tolist() == want


def test_rows_of_one_id_are_dealt_over_tasks(spark, tmp_path):
    docs = spark.range(4000).selectExpr("7L as doc_id", "if(id % 2 = 0, 'same', concat('text ', id)) as text").repartition(4)
    path = f"file://{tmp_path}/tokens"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [x.n for x in spark.read.parquet(path).groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(parts) == 4000 and len(parts) >= 3 and max(parts) < 2500


def test_pieces_against_the_library(spark, odd, odd_rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spiece.default_model())
    own = spiece.Encoder(spiece.encoder(spiece.default_model()).vocabulary, most=50, block=300)
    r = random.Random(7)
    parts = ["the", "straße", "e.g.", "1234", "()", " ", "   ", "\n", "\t", "日本語", "😀", "▁", "\x00", "ﬁ", "zzzzzzzz", "http://x.y"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 15))) for _ in range(300)] + ["ab" * 2000]
    texts += ["".join(r.choice("日本語abcdzé中文字") for _ in range(r.randint(290, 1200))) for _ in range(20)]  # longer than a block, without spaces
    for at in range(0, len(texts), 40):
        ids, sizes = own.encode(pa.array(["x", *texts[at : at + 40]]).slice(1))
        for text, found in zip(texts[at : at + 40], np.split(ids, np.cumsum(sizes)[:-1])):
            assert found.tolist() == sp.encode(text), repr(text)
            assert own.decode(found) == sp.decode(sp.encode(text))
    got = spiece.round_trip(odd).collect()
    assert len(got) == len(odd_rows) and all(x.same for x in got)
    want = Counter((i, len(sp.encode(t or ""))) for i, t in odd_rows)
    assert Counter((x.doc_id, x.n_ids) for x in got) == want
    assert spiece.round_trip(odd.limit(0)).collect() == []
    coded = spiece.encode_documents(odd)
    assert Counter((x.doc_id, x.text) for x in spiece.decode_documents(coded).collect()) == Counter((i, t or "") for i, t in odd_rows)


def test_unigram_is_the_best_path():
    pieces = [("<unk>", 0.0, spiece.UNKNOWN), ("▁", -2.0, 1), ("a", -2.5, 1), ("b", -2.6, 1), ("ab", -3.0, 1), ("▁ab", -4.5, 1), ("aba", -3.2, 1), ("bab", -9.0, 1)]
    v = spiece.Vocabulary(pieces, spiece.UNIGRAM)
    own = spiece.Encoder(v)
    scores = {p: (s, i) for i, (p, s, t) in enumerate(pieces) if t == 1}

    def best(text: str) -> float:
        if not text:
            return 0.0
        found = [scores[text[:n]][0] + best(text[n:]) for n in (1, 2, 3) if text[:n] in scores]
        return max(found or [v.scores[v.ids].min() - 10 + best(text[1:])])

    for text in ("abab", "aabbabab", "b a ab", "axb"):
        ids = own.encode(pa.array([text]))[0].tolist()
        got = sum(v.scores[i] if i else v.scores[v.ids].min() - 10 for i in ids)
        assert got == pytest.approx(best("▁" + text.replace(" ", "▁")))
    assert own.decode(own.encode(pa.array(["ab ab"]))[0]) == "ab ab"
    small = spiece.Encoder(v, block=7)
    for text in ("ab" * 20, "xx" * 9, "abxxab" * 5, "a" * 40):
        assert small.encode(pa.array([text]))[0].tolist() == own.encode(pa.array([text]))[0].tolist()


def test_a_long_text_without_spaces():
    import sentencepiece

    r = random.Random(20)
    text = "".join(r.choices("ABCDEFGHijklmnopqrstuvwxyz0123456789+/中文字", k=3_000_000))
    own = spiece.Encoder(spiece.encoder(spiece.default_model()).vocabulary)
    ids, sizes = own.encode(pa.array([text]))
    assert sizes.tolist() == [len(ids)] and own.decode(ids) == text
    assert ids[:50_000].tolist() == sentencepiece.SentencePieceProcessor(model_file=spiece.default_model()).encode(text[:200_000])[:50_000]


def test_vocabularies_of_many_characters():
    points = [*range(0x4E00, 0x9FFF), *range(0xAC00, 0xD7A3), *range(0x20000, 0x29000)]
    pieces = [("<unk>", 0.0, spiece.UNKNOWN), ("▁", -1.0, 1), *((chr(c), -2.0, 1) for c in points), ("中文", -1.5, 1)]
    v = spiece.Vocabulary(pieces, spiece.BPE)
    assert v.per == 2
    assert [pieces[i][0] for i in spiece.Encoder(v).encode(pa.array(["中文中 x" + chr(0x28FFF)]))[0]] == ["▁", "中文", "中", "▁", "<unk>", chr(0x28FFF)]


def test_suffix_array_finds_every_occurrence():
    v = spiece.Vocabulary([("<unk>", 0.0, 2), *((p, -1.0, 1) for p in ("a", "b", "ab", "aba", "abab", "ababab", "bb"))], spiece.BPE)
    text = "ababab\0bbab\0a\0"
    ranks = v.ranks(np.array([ord(c) for c in text], np.uint32))
    ranks[[i for i, c in enumerate(text) if c == "\0"]] = 0
    start, length, ids = spiece.edges(v, ranks)
    got = {(int(s), text[s : s + n]) for s, n in zip(start, length)}
    assert got == {(i, p) for i in range(len(text)) for p, _, t in v.pieces if t == 1 and text.startswith(p, i)}
    assert len(got) == len(ids)


URLS = ["http://www.A.com:80/x/?b=2&utm_source=q&a=1#top", "https://a.com/x?a=1&b=2", "//a.com", "ftp://u:p@h.org/", None, "nothing", "", "http://a.com/x.html?ref=z"]


def test_canonical_urls(spark):
    got = [r.c for r in spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i int, u string").orderBy("i").select(warc.canonical_url(F.col("u")).alias("c")).collect()]
    assert got == ["a.com/x?a=1&b=2", "a.com/x?a=1&b=2", "a.com/", "h.org/", None, None, None, "a.com/x.html"]


@pytest.mark.parametrize("crowd", [5, 1000])
def test_revisits_against_brute_force(spark, crowd):
    r = random.Random(8)
    rows = []
    for i in range(300):
        kind = r.choice(["response", "revisit"])
        headers = r.choice([None, {}, {"etag": f'"{r.randint(0, 1)}"', "content-length": "5", "age": str(i)}, {"etag": f'W/"{r.randint(0, 1)}"'}, {"last-modified": str(r.randint(0, 1))}])
        rows.append((i, kind, f"http://h.org/{0 if r.random() < 0.4 else r.randint(0, 9)}" if i % 29 else None, None if i % 41 == 5 else r.randint(0, 60), headers))
    got = {x.record_id: x for x in warc.resolve_revisits(spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, headers map<string,string>"), spans=7, crowd=crowd).collect()}
    place = lambda x: (x[3] is not None, x[3] or 0, x[1] == "revisit", x[0])
    assert len(got) == sum(x[1] == "revisit" for x in rows)
    for row in (x for x in rows if x[1] == "revisit"):
        x, before = got[row[0]], [y for y in rows if y[1] == "response" and y[2] == row[2] and place(y) < place(row)]
        if row[2] is None:
            assert x.status == "no_url"
            continue
        if not before:
            assert x.status == "missing"
            continue
        last = max(before, key=place)
        a, b = last[4] or {}, row[4] or {}
        if "etag" in a and "etag" in b:
            status = "resolved" if a["etag"].removeprefix("W/") == b["etag"].removeprefix("W/") else "mismatch"
        elif "last-modified" in a and "last-modified" in b:
            status = "resolved" if a["last-modified"] == b["last-modified"] else "mismatch"
        else:
            status = "unverified"
        assert x.status == status
        assert x.response_id == (None if status == "mismatch" else last[0])
        assert x.headers == (None if status == "mismatch" else a | {k: v for k, v in b.items() if k not in warc.UNMERGED})


def test_a_stray_time_leaves_the_spans_of_a_hot_url_even(spark):
    points = spark.range(20_000).selectExpr("'u' as canonical", "if(id = 0, 1, 1700000000 + id) as ts").unionAll(spark.range(10).selectExpr("concat('v', id)", "id"))
    crowded = spark.createDataFrame([("u",)], "of_ string")
    got = warc.in_spans(points, crowded, 16).groupBy("canonical", "span").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
    hot = sorted((x for x in got if x.canonical == "u"), key=lambda x: x.span)
    assert len(hot) == 16 and max(x.n for x in hot) < 1.2 * 20_000 / 16 and all(a.hi < b.lo for a, b in zip(hot, hot[1:]))
    assert all(x.span == 0 for x in got if x.canonical != "u")


def test_warc_bytes_round_trip(spark, tmp_path):
    rows = [(1, "response", "http://a.com/", 5, {"etag": '"x"', "content-type": "text/html"}, b"<p>\r\n\r\nbody"), (2, "revisit", None, None, None, None), (3, "response", "http://a.com/é", 6, {}, b"")]
    records = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, headers map<string,string>, payload binary")
    path = f"file://{tmp_path}/warc"
    warc.write_records(records, path)
    got = sorted(((x.record_id, x.kind, x.url, x.ts, x.headers, None if x.payload is None else bytes(x.payload)) for x in warc.read_records(spark, path).collect()), key=lambda x: x[0])
    assert got == [(*x[:4], x[4] or {}, x[5]) for x in rows]


def test_revisits_of_no_rows_and_odd_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.com/x", None), (2, None, "<p>"), (None, "http://a.com/x", "<p>"), (3, "http://a.com/x", "")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.resolved_pages(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {x.status for x in got} <= {"resolved", "mismatch", "no_url", "missing"}
    assert warc.resolve_revisits(warc.recrawl(pages.limit(0), 10)).collect() == []


def test_large_page_ids_and_ids_of_text(spark, tmp_path):
    big = [(1 << 53) + 1, (1 << 62) + 7, (1 << 63) - 1, -(1 << 63), 1000, 2000]
    spark.createDataFrame([(i, "http://a.b/c", "x") for i in big], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: x for x in warc.resolved_pages(spark, str(tmp_path)).collect()}
    assert set(got) == set(big) and all(x.status == "resolved" for x in got.values())
    assert [got[i].response_page for i in big] == [big[0], big[1], big[2], big[3], 2000, 2000]
    spark.createDataFrame([("p", "http://a.b/c", "x"), ("7", "http://a.b/d", "x")], "page_id string, url string, html string").write.parquet(f"{tmp_path}/t/pages.parquet")
    assert {(x.page_id, x.status) for x in warc.resolved_pages(spark, f"{tmp_path}/t").collect()} == {("p", "resolved"), ("7", "resolved")}


def test_a_language_of_one_id_is_learned_within_its_bound(spark):
    """Whatever the id's own hash is: 3000 texts of one id, or one row 3000 times."""
    r = random.Random(33)
    others = [(i, sentence(r, "bb", 12), "bb") for i in range(100, 160)]
    for one in (3, 4, 6, 8, 11):
        if zlib.crc32(str(one).encode()) % 5 == 0:
            continue
        rows = [(one, sentence(r, "aa", 8), "aa") for _ in range(1500)] + [(one, sentence(r, "aa", 8), "aa")] * 300 + others
        model = langid.learn(make(spark, rows), fit_rows=100)
        assert model.languages == ["aa", "bb"]
        asked = make(spark, [(i, sentence(r, "aa", 10)) for i in range(20)])
        assert {x.lang_pred for x in langid.identify(asked, model).collect()} == {"aa"}


def test_the_fit_takes_so_many_rows_of_each_language(spark, monkeypatch):
    r, seen = random.Random(34), []
    rows = [(i, sentence(r, lang, 6), lang) for i in range(900) for lang in [list(LANGUAGES)[i % 3 == 0]]]
    monkeypatch.setattr(langid, "fit", lambda grams, languages, *a: seen.append(languages))
    for docs in (make(spark, rows), make(spark, rows).repartition(5)):
        langid.learn(docs, fit_rows=40)
    assert seen[0] == seen[1] and {x: seen[0].count(x) for x in set(seen[0])} == {"aa": 40, "bb": 40}


def test_runs_of_bins_grow_with_sizes_and_not_with_groups():
    r = random.Random(35)
    sizes = r.sample(range(1, 9000), 3000)
    runs = {}
    for groups in (80_000, 1_000_000):
        histogram = [(s, groups // 3000 + r.randint(0, 5)) for s in sizes]
        found = shard.best_fit_runs(histogram, 10_000)
        runs[groups] = len(found)
        assert sum(n for _, n, _, _ in found) == sum(n for _, n in histogram)
        room: dict[int, int] = defaultdict(int)
        for s, n, first, each in found:
            for i in range(-(-n // each)):
                room[first + i] += s * min(each, n - i * each)
        assert max(room.values()) <= 10_000 and len(room) <= sum(room.values()) / 10_000 * 11 / 9 + 1 and sorted(room) == list(range(len(room)))
    assert runs[1_000_000] < 3 * 3000 and runs[1_000_000] < 1.5 * runs[80_000]


def test_capacity_with_many_groups(spark):
    """Groups of few sizes: their bins are computed from runs, and none is over its capacity."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    got = shard.shard_documents(docs, shards=None, capacity=1000).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("c"), F.max("slot").alias("s")).collect()
    total = sum(x.n for x in got)
    assert max(x.n for x in got) <= 1000 and sum(x.c for x in got) == 60_000 and all(x.s == x.c - 1 for x in got)
    assert len(got) <= total / 1000 * 11 / 9 + 1 and {x.shard for x in got} == set(range(len(got)))
