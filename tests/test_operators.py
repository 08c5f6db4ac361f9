from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quire import api
from quire.functions import correct as C
from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import corpus, documents, jobs, lexicon, report
from quire.operators import score as S
from quire.plans.cascade import Engines, Loaded, prepared, process_pages, retrying
from quire.sources import files, sinks, store
from quire.streaming import ingest as stream

DETECTIONS = "i int, d array<struct<text:string,conf:double,points:array<struct<x:double,y:double>>>>"


def blocks(spark, rows):
    """rows of (text, language, confidence)."""
    data = [([(i, "paragraph", l, t, c, None, False) for i, (t, l, c) in enumerate(rows, 1)],)]
    return spark.createDataFrame(data, f"b {B.BLOCKS}")


def test_paragraphs_and_runs(spark):
    df = spark.createDataFrame([(1, " a \n\n b\nc \n\n\n d"), (2, "a\n b \n"), (3, ""), (4, None)], "i int, t string").orderBy("i")
    got = [[(b.block_id, b.text) for b in r.b] for r in df.select(B.paragraphs("t").alias("b")).collect()]
    assert got == [[(1, "a"), (2, "b\nc"), (3, "d")], [(1, "a"), (2, "b")], [], []]
    got = [[b.text for b in r.b] for r in df.select(B.grouped_lines("t").alias("b")).collect()]
    assert got == [["a", "b\nc", "d"], ["a\nb"], [], []]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('```json\n{"content_blocks": 3, "blocks": [{"text": " x "}, {"text": ""}, 5, {"text": "y", "type": "header", "confidence": "0.5", "language": "bn"}]}\n```', [(1, "x", "paragraph", 0.9, "en"), (4, "y", "header", 0.5, "bn")]),
        ('[{"text": "z", "is_handwritten": true}]', [(1, "z", "paragraph", 0.9, "en")]),
        ('{"other": []}', [(1, '{"other": []}', "paragraph", 0.9, "en")]),
        ("plain\n\ntext", [(1, "plain", "paragraph", 0.9, "en"), (2, "text", "paragraph", 0.9, "en")]),
        ("", []),
    ],
)
def test_model_output(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "t string").select(B.model_blocks("t").alias("b")).first().b
    assert [(b.block_id, b.text, b.type, b.confidence, b.language) for b in got] == want


def det(text, x, y):
    return (text, 0.9, [(float(x), float(y)), (x + 5.0, y + 5.0)])


def test_tables_from_positions(spark):
    tops = [0, 10, 20, 29, 40]
    rows = [
        (1, [det(f"t{i}", 100 - i, y) for i, y in enumerate(tops)]),
        (2, [det("a", 0, 0), det("b", 1, 1)]),
        (3, [("a", 0.5, []), ("b", 0.5, [])]),
        (4, [det(str(k), j, i * 50) for i, n in enumerate((1, 2, 3, 4)) for j, k in enumerate(range(n))]),
        (5, []),
    ]
    df = spark.createDataFrame(rows, DETECTIONS)
    got = {r.i: r.t for r in df.select("i", B.scanned_table("d").alias("t")).collect()}
    assert got == {1: [["t1", "t0"], ["t3", "t2"], ["t4"]], 2: None, 3: None, 4: None, 5: None}
    box = df.filter("i = 2").select(B.detection_blocks("d").alias("b")).first().b
    assert (box[0].bbox.x1, box[0].bbox.y2, box[1].block_id) == (0.0, 5.0, 2)
    back = df.filter("i = 2").select(B.detection_blocks("d").alias("b")).select(B.block_detections("b").alias("d")).first().d
    assert [(p.x, p.y) for p in back[0].points] == [(0, 0), (5, 0), (5, 5), (0, 5)]


def test_table_confidence_and_cleaning(spark):
    from quire.functions.correct import clean_lines, clean_table, fix_table_numbers

    df = spark.createDataFrame([([["a", " "], ["b", "c"], ["d"]],), ([],)], "r array<array<string>>")
    assert [r.c for r in df.select(B.table_confidence("r").alias("c")).collect()] == [0.72, 0.0]
    t = spark.createDataFrame([([[" 1O ", None], ["x", "2"]], ["<b>HERE</b>", " seal", "kept <i>line</i>", ""])], "r array<array<string>>, l array<string>")
    row = t.select(clean_table("r").alias("c"), fix_table_numbers("r").alias("f"), clean_lines("l").alias("l")).first()
    assert row.c == [["1O", ""], ["x", "2"]] and row.f.rows == [[" 10 ", ""], ["x", "2"]] and row.f.discrepancies[0].original == "1O"
    assert row.l == "kept line"


def test_scores_and_gates(spark):
    en = blocks(spark, [("Gazette of the Republic", "en", 0.95), ("Part one of the notice of 2024", "en", 0.9)])
    score = en.select(S.page_score("b").alias("s")).first().s
    assert score == pytest.approx(0.35 * 0.925 + 0.10 + 0.16 + 0.15 + 0.10 + 0.10, abs=1e-4)
    assert blocks(spark, []).select(S.page_score("b").alias("s")).first().s == 0.0
    bn = blocks(spark, [("সরকার", "bn", 0.5), ("x", "en", 0.5)])
    assert bn.select(S.is_bangla("b").alias("x")).first().x
    assert bn.select(S.page_score("b", lexicon=["সরকার"]).alias("s")).first().s > bn.select(S.page_score("b").alias("s")).first().s
    gates = spark.createDataFrame([(0.45, True), (0.62, True), (0.6199, True), (0.55, False), (0.54, False)], "c double, b boolean")
    assert [r.g for r in gates.select(S.needs_fallback("c", "b").alias("g")).collect()] == [True, False, True, False, True]
    tiers = spark.createDataFrame([(0.9, True, None), (0.9, False, None), (0.5, True, None), (0.1, False, " GOLD "), (0.65, None, "")], "c double, v boolean, g string")
    assert [r.t for r in tiers.select(S.tier(F.col("c"), F.col("v"), F.col("g")).alias("t")).collect()] == ["gold", "silver", "bronze", "gold", "silver"]


def test_corpus(spark):
    pages = spark.createDataFrame(
        [("d1", 1, "এক two", "surya", 0.9, "govt"), ("d1", 2, None, "gemini", 0.7, None), ("d2", 1, "x", "surya", 0.3, "govt")], "doc_id string, page_number int, full_text string, engine string, confidence_score double, domain string"
    )
    votes = spark.createDataFrame([("d1", 1, False, 1), ("d1", 1, True, 2), ("d9", 1, True, 1)], "doc_id string, page_number int, verified boolean, at int")
    records = corpus.corpus_records(corpus.verify(pages, votes, "at"))
    got = {(r.doc_id, r.page_number): r for r in records.collect()}
    first = got["d1", 1]
    assert (first.confidence_tier, first.word_count, first.char_count, first.language_ratio_bn, first.verified) == ("gold", 2, 6, 0.3333, True)
    assert len(records.columns) == 14 and got["d1", 2].domain == "unknown" and got["d1", 2].full_text == ""
    s = corpus.corpus_stats(records).first()
    assert (s.total_records, s.by_domain, s.by_tier, s.by_engine) == (3, {"govt": 2, "unknown": 1}, {"gold": 1, "silver": 1, "bronze": 1}, {"surya": 2, "gemini": 1})
    assert s.avg_confidence == 0.6333 and s.total_words == 3 and s.total_chars == 7
    e = corpus.corpus_stats(records.limit(0)).first()
    assert (e.total_records, e.by_domain, e.avg_confidence, e.total_words) == (0, {}, 0.0, 0)


def test_documents(spark):
    pages = spark.createDataFrame([("a", 2, "two", "surya", 0.5), ("a", 1, "one", "ollama:q", 0.7), ("b", 1, "x", "PyMuPDF", 0.9)], "doc_id string, page_number int, full_text string, engine string, confidence_score double")
    roll = {r.doc_id: r for r in documents.document_rollup(pages).collect()}
    assert (roll["a"].pages, roll["a"].pages_local, roll["a"].pages_api, roll["a"].output_engine_tag) == (2, 1, 1, "mixed") and roll["b"].output_engine_tag == "digital"
    docs = spark.createDataFrame([("a", 4), ("b", 0), ("c", 2)], "doc_id string, total_pages int")
    cover = {r.doc_id: (r.expected_pages, r.missing, r.status) for r in documents.coverage(docs, pages).collect()}
    assert cover == {"a": (4, [3, 4], "Missing 2"), "b": (1, [], "Complete"), "c": (2, [1, 2], "Missing 2")}
    assert {(r.doc_id, r.page_number) for r in documents.missing_pages(docs, pages).collect()} == {("a", 3), ("a", 4), ("c", 1), ("c", 2)}
    assert {r.doc_id: r.text for r in documents.document_text(pages).collect()} == {"a": "one\n\ntwo", "b": "x"}
    whole = {r.doc_id: json.loads(r.json) for r in report.document_reports(docs, pages).collect()}
    assert [p["page_number"] for p in whole["a"]["pages"]] == [1, 2] and whole["a"]["document"]["total_pages"] == 4
    found = documents.languages(spark.createDataFrame([("a", "mixed"), ("b", "en"), ("c", None)], "doc_id string, language string"))
    assert {r.doc_id: r.languages for r in found.collect()} == {"a": ["bn", "en"], "b": ["en"], "c": ["unknown"]}
    d = spark.createDataFrame([("a", "K2", None), ("a", "K1", "error"), ("a", "K1", "info")], "doc_id string, keyword string, severity string")
    r = documents.decision_summary(d).first()
    assert (r.total_decisions, r.info, r.warning, r.error, r.keywords) == (3, 2, 0, 1, ["K1", "K2"])


def test_lexicon_join(spark):
    df = spark.createDataFrame([(1, "ক খ ক abc"), (2, "abc"), (3, None)], "id int, text string")
    lex = spark.createDataFrame([("ক",), ("ক",), (None,)], "word string")
    assert {r.id: (r.n_words, r.validity) for r in lexicon.word_validity(df, lex, "id").collect()} == {1: (3, pytest.approx(2 / 3)), 2: (0, 1.0), 3: (0, 1.0)}


def test_words_are_replaced_by_a_table(spark):
    df = spark.createDataFrame([(1, "ab,  x ab!\ncd"), (2, "zz  y"), (3, None), (None, "ab")], "id int, text string")
    table = spark.createDataFrame([("ab", "AB"), ("ab", "ZB"), ("cd", ""), ("x", None), (None, "n")], "wrong string, right string")
    got = {r.id: r.text for r in lexicon.replace_words(df, table, "id").collect()}
    assert got == {1: "AB, x AB! cd", 2: "zz y", 3: "", None: "AB"}


def _state(spark):
    d = spark.createDataFrame([("1", "u", "D1", "a.pdf", "processing", "govt", 4, 5), ("2", "u", "D2", "b.pdf", "done", "govt", 2, 9), ("3", "v", "D3", "c.pdf", "pending", "govt", 1, 1)], "id string, user_id string, doc_id string, filename string, status string, domain string, total_pages int, created_at int")
    j = spark.createDataFrame([("j1", "1", "processing", None, 1, None), ("j2", "2", "done", None, 1, 2)], "id string, document_id string, status string, error_msg string, started_at int, completed_at int")
    p = spark.createDataFrame([("D1", 1, 4, "processing", "", "t1"), ("D1", 3, 8, "processing", "", "t2")], files.PROGRESS_SCHEMA)
    pages = spark.createDataFrame([("D1", 1, "t", "surya", 0.9, "x")], "doc_id string, page_number int, full_text string, engine string, confidence_score double, domain string")
    votes = spark.createDataFrame([("D1", 1, False, 1), ("D1", 1, True, 3), ("D1", 1, False, 2)], "doc_id string, page_number int, verified boolean, at int")
    chunks = spark.createDataFrame([("k1", "1"), ("k2", "2")], "id string, document_id string")
    users = spark.createDataFrame([("A@x.y", "u")], "email string, id string")
    calls = spark.createDataFrame([("gemini", 5, False), ("gemini", 1, True)], "engine string, tokens int, failed boolean")
    return api.Tables(d, j, pages, p, votes, chunks, users=users, calls=calls)


def test_jobs_and_api(spark, tmp_path):
    t = _state(spark)
    assert api.job(t, "j1", "u").first().document.filename == "a.pdf"
    with pytest.raises(api.NotFound):
        api.job(t, "j1", "v")
    assert [(r.id, r.progress_percent, r.progress_status) for r in api.list_documents(t, "u").collect()] == [("2", 100, "done"), ("1", 38, "processing")]
    assert [(r.id, r.status, r.error_msg) for r in api.cancel(t, "D1", "u").collect()] == [("j1", "failed", "Canceled by user")]
    with pytest.raises(api.Conflict):
        api.cancel(t, "D2", "u")
    for name in ("merged/D1_mixed.json", "merged/D10_mixed.json", "texts/D1.txt", "uploads/D1.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).touch()
    left = api.delete(t, "D1", "u", api.Store("", "", "", "", str(tmp_path)))
    assert {k: v.count() for k, v in left.items()} == {"documents": 2, "jobs": 1, "pages": 0, "chunks": 1, "progress": 0, "verifications": 0}
    assert [p.name for p in tmp_path.rglob("*.*")] == ["D10_mixed.json"]
    one = api.stats(t).first()
    assert one.by_tier == {"gold": 1} and one.total_records == 1 and one.total_words == 1
    assert api.verify(t, "D1", 1).count() == 1
    assert api.register(t, " New@X.y ").first().email == "new@x.y" and api.call_stats(t).first().errors == 1
    with pytest.raises(api.Conflict):
        api.register(t, "a@X.Y")
    with pytest.raises(api.NotFound):
        api.verify(t, "D1", 7)
    assert json.loads(api.report(t, "D1", "u").first().json)["pages"][0]["extraction"]["engine"] == "surya"
    for doc, error in (("D3", api.Conflict), ("D2", api.NotFound), ("D9", api.NotFound)):
        with pytest.raises(error):
            api.report(t, doc)
    half = spark.createDataFrame([(1, 8)], "c int, t int").select(jobs.progress_percent(F.lit("x"), F.col("c"), F.col("t")).alias("p")).first().p
    assert half == 12  # 12.5, to the even number
    users = spark.createDataFrame([("A@x.y", 1)], "email string, id int")
    asked = spark.createDataFrame([(" a@X.y", 2), ("n@x.y", 4), ("N@x.y", 3)], "email string, id int")
    assert [(r.email, r.id) for r in jobs.new_users(users, asked).collect()] == [("n@x.y", 3)]
    f = spark.createDataFrame([("a.pdf", 1, 1, ""), ("a.pdf", 1, 1, ""), ("b.txt", 1, 1, "application/pdf"), ("c.txt", 1, 1, "text/plain")], "name string, size int, modified int, mime string")
    assert jobs.distinct_files(f).count() == 2


def _images(spark, texts):
    rows = [("d", i, t, t.encode(), None, []) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "doc_id string, page_number int, text string, image binary, tables array<array<array<string>>>, images array<struct<width:int,height:int>>")


def test_cascade_asks_each_engine_only_for_what_is_left(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def seen(name, b):
        (calls / f"{name}-{b.decode()[:6].strip()}").touch()

    def primary(b):
        seen("primary", b)
        return ["<b>found</b> by the first engine, long enough", " SEAL "] if b.startswith(b"one") else ""

    def quick(b):
        seen("quick", b)
        if b.startswith(b"boom"):
            raise RuntimeError
        return [("good clear words", 0.99, [(0, 0), (5, 5)])] if b.startswith(b"two") else [("?", 0.05, [])]

    def model(b):
        seen("model", b)
        return json.dumps([{"text": "the model reads this page well"}]) if b.startswith(b"three") else "short"

    pages = _images(spark, ["one", "two", "three", "four", "boom", "A digital page that is long enough to be taken."])
    got = {r.page_number: r for r in process_pages(pages, Engines(primary, quick, model, attempts=1)).collect()}
    assert {n: (r.method, r.engine) for n, r in got.items()} == {
        1: ("ocr_local", "surya"), 2: ("ocr_local", "easyocr"), 3: ("ocr_api", "ollama"), 4: ("ocr_local", "easyocr"), 5: ("ocr_local", "easyocr"), 6: ("digital", "PyMuPDF"),
    }
    assert {p.name for p in calls.iterdir()} == {*(f"primary-{x}" for x in ("one", "two", "three", "four", "boom")), *(f"quick-{x}" for x in ("two", "three", "four", "boom")), *(f"model-{x}" for x in ("three", "four", "boom"))}
    assert got[3].full_text == "the model reads this page well" and got[5].full_text == ""
    assert got[6].decisions[0].keyword == "FINAL_ENGINE" and got[1].steps[0] == "type:scanned"
    assert got[1].full_text == "found by the first engine, long enough" and got[1].steps[-1] == "surya:ok:38chars"
    assert "llm_chain:failed:none:ollama=no usable text" in got[5].steps and got[5].steps[-1].startswith("easyocr:score:")


def test_models_are_asked_in_turn(spark):
    pages = _images(spark, ["one", "two", "नमस्ते"])
    first = lambda b: "the first model's own answer" if b == b"one" else " too short "
    second = lambda b: "अबचदएफगहइजकलमनओपरसत अबचदएफ" if b.startswith("न".encode()) else "the second model's own answer"
    got = {r.page_number: r for r in process_pages(pages, Engines(model=first, model_name="ollama:q", more_models=(("gemini", second),))).collect()}
    assert {n: (r.method, r.engine) for n, r in got.items()} == {1: ("ocr_api", "ollama:q"), 2: ("ocr_api", "gemini"), 3: ("ocr_local", "none")}
    assert "llm_chain:script_mismatch:gemini" in got[3].steps


def test_engines_are_asked_again():
    tries = []

    def fails_once(image):
        tries.append(image)
        if len(tries) == 1:
            raise OSError
        return "x"

    assert retrying(fails_once, delay=0.0)(b"i") == "x" and len(tries) == 2
    with pytest.raises(ZeroDivisionError):
        retrying(lambda image: 1 / 0, delay=0.0)(b"i")


def test_a_page_in_the_wrong_script_falls_through(spark):
    page = "".join(map(chr, range(0x0915, 0x092F)))
    pages = _images(spark, ["wrong", "mixed"])
    primary = lambda b: page if b == b"wrong" else page + "\nand a line of plain words"
    got = {r.page_number: r for r in process_pages(pages, Engines(primary, model=lambda b: "what the model reads on it")).collect()}
    assert (got[1].engine, got[1].full_text) == ("ollama", "what the model reads on it") and "surya:empty_fallthrough" in got[1].steps
    assert (got[2].engine, got[2].full_text) == ("surya", "and a line of plain words")


def test_settings_switch_engines_off(spark):
    pages = _images(spark, ["one"])
    engines = Engines(lambda b: "what the first engine reads on it", model=lambda b: "what the model reads on the page", settings=files.Settings(surya_enabled=False))
    assert process_pages(pages, engines).first().engine == "ollama"
    engines.settings = files.Settings(surya_enabled=False, ollama_enabled=False)
    assert process_pages(pages, engines).first().engine == "none"


def test_slow_models_fail_and_decoders_get_the_resolution(spark):
    import time

    slow = lambda b: time.sleep(3) or "what the model reads, too late for anybody"
    engines = Engines(model=slow, more_models=(("gemini", lambda b: "what the second model reads on it"),), attempts=1, settings=files.Settings(ollama_timeout=0.2, gemini_enabled=True))
    got = process_pages(_images(spark, ["one"]), engines).first()
    assert got.engine == "gemini" and [(c.engine, c.failed) for c in got.calls] == [("ollama", True), ("gemini", False)]
    docs = spark.createDataFrame([("d", bytearray(b"x"))], "doc_id string, content binary")
    assert files.decode_pages(docs, lambda c, dpi: [{"text": str(dpi)}], 300).first().text == "300"


def test_engines_are_made_once_and_the_next_factory_is_tried(tmp_path):
    made = []

    def broken():
        made.append("broken")
        raise OSError

    def good():
        made.append("good")
        return lambda x: [x, len(made)]

    engine = Loaded(broken, good)
    assert engine(b"a") == [b"a", 2] and engine(b"b") == [b"b", 2] and made == ["broken", "good"]
    dead = Loaded(broken, recheck=1e9)
    for _ in range(2):
        with pytest.raises(RuntimeError):
            dead(b"x")
    assert made == ["broken", "good", "broken"] and not dead.available()
    assert prepared(lambda b: b, bytes.upper, lambda b: b + b"!")(b"x") == b"X!"


def test_doubtful_blocks_are_repaired_and_images_described(spark):
    text = "কখগঘ ঙচছজ ঝঞটঠ ডঢণত থদধন পফবভ মযরল"
    rows = [("d", 1, "", b"i", None, [(1, b"seal", "png", 100, 100), (2, b"", "png", 900, 100)]), ("d", 2, "", b"j", None, [])]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string, image binary, tables array<array<array<string>>>, images array<struct<xref:int,image_bytes:binary,ext:string,width:int,height:int>>")
    engines = Engines(quick=lambda b: [(text, 0.99, [])] if b == b"i" else [("plain words", 0.99, [])], repairer=lambda t: t + " ।", describers=(lambda b: b.decode(),))
    got = {r.page_number: r for r in process_pages(pages, engines, put=lambda d, n, x: f"{d}/{n}.png").collect()}
    assert got[1].full_text == text + " ।" and got[2].full_text == "plain words" and got[1].correction_applied and not got[2].correction_applied
    assert [(i.image_id, i.type, i.description, i.confidence) for i in got[1].images] == [(1, "seal", "seal", 0.8), (2, "table_or_chart", "table_or_chart (900x100px)", 0.5)]
    assert got[1].source_image_path == "d/1.png" and got[1].steps[-1] == "images:2"
    assert [C.repaired(text, f) for f in (lambda t: "x", lambda t: 1 / 0, lambda t: "")] == [text] * 3 and C.repaired("short", lambda t: "y" * 9) == "short"


def test_rounding_is_pythons(spark):
    values = [2.675, 0.5, 1.5, 2.5, 0.00005, 0.00015, 1.005, -2.5, -0.125, 0.125, 1e9 + 0.5, 0.1 + 0.2, 123.45675, 0.0] + [i / 8 for i in range(40)] + [i * 0.00125 for i in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 2, 4):
        assert [r[0] for r in df.select(T.rounded(F.col("v"), places)).collect()] == [round(v, places) for v in values]


def decoder(content: bytes):
    if content.startswith(b"bad"):
        raise ValueError("not a document")
    for line in content.decode().split("\n"):
        yield {"text": line, "image": line.encode()}


def test_files_sinks_and_streaming(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a b.pdf").write_bytes(b"page one is long enough to be digital\nshort")
    (inbox / "c.PDF").write_bytes(b"bad")
    (inbox / "d.txt").write_bytes(b"no")
    docs = files.read_documents(spark, str(inbox))
    pages = files.decode_pages(docs, decoder)
    rows = sorted((r.doc_id.rsplit("_", 1)[0], r.page_number, r.error) for r in pages.collect() if r.error is None)
    assert rows == [("a b", 1, None), ("a b", 2, None)] and pages.filter("error is not null").first().error == "ValueError: not a document"
    assert {r.page_type for r in files.route(pages.filter("error is null")).collect()} == {"digital", "scanned"}

    process = lambda df: files.decode_pages(df, decoder).filter("error is null").select("doc_id", "page_number", "text")
    for _ in range(2):
        stream.ingest(stream.inbox(spark, str(inbox)), process, f"{tmp_path}/rows", f"{tmp_path}/check").awaitTermination()
        assert sinks.read_page_rows(spark, f"{tmp_path}/rows").count() == 2
    (inbox / "e.pdf").write_bytes(b"x\ny\nz")
    gone = spark.createDataFrame([], "doc_id string")
    stream.ingest(stream.inbox(spark, str(inbox)), process, f"{tmp_path}/rows", f"{tmp_path}/check", lambda: gone).awaitTermination()
    rows = sinks.read_page_rows(spark, f"{tmp_path}/rows")
    assert rows.count() == 5
    last = rows.filter("doc_id like 'e%'").first().doc_id
    before = sorted(map(tuple, rows.collect()))
    sinks.fold_page_rows(spark, f"{tmp_path}/rows")
    assert sorted(map(tuple, sinks.read_page_rows(spark, f"{tmp_path}/rows").collect())) == before and not any((tmp_path / "rows" / "runs").glob("run=*"))
    sinks.write_page_rows(spark.createDataFrame([(last, 1, "new")], "doc_id string, page_number int, text string"), f"{tmp_path}/rows")
    assert sinks.read_page_rows(spark, f"{tmp_path}/rows").count() == 3
    (inbox / "f.pdf").write_bytes(b"x")
    canceled = files.read_documents(spark, f"{inbox}/f.pdf").select("doc_id")
    stream.ingest(stream.inbox(spark, str(inbox)), process, f"{tmp_path}/rows", f"{tmp_path}/check", lambda: canceled).awaitTermination()
    assert sinks.read_page_rows(spark, f"{tmp_path}/rows").count() == 3
    whole = api.submit(spark, str(inbox), decoder, Engines(model=lambda b: b.decode()), "govt", "u")
    assert {(r.doc_id.rsplit("_", 1)[0], r.status, r.total_pages) for r in whole["documents"].collect()} == {("a b", "done", 2), ("c", "failed", 0), ("e", "done", 3), ("f", "done", 1)}
    assert {(r.status, r.error_msg) for r in whole["jobs"].collect()} == {("done", None), ("failed", "ValueError: not a document")} and whole["pages"].count() == 6
    moves = whole["events"].groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("status") == "pending", 0).when(F.col("status") == "processing", 1).otherwise(2).alias("n"), "status"))), lambda x: x["status"]), ",").alias("m"))
    assert sorted(r.m for r in moves.collect()) == ["pending,processing,done"] * 3 + ["pending,processing,failed"]

    done = process_pages(pages.filter("error is null").drop("error"), Engines(model=lambda b: b.decode()))
    sinks.write_page_json(done, f"{tmp_path}/json")
    back = files.read_page_json(spark, f"{tmp_path}/json")
    assert back.count() == 2 and {tuple(r) for r in back.select("doc_id", "page_number", "engine", "full_text").collect()} == {tuple(r) for r in done.select("doc_id", "page_number", "engine", "full_text").collect()}
    doc = back.first().doc_id
    state = _state(spark)
    kept = api.Store(f"{tmp_path}/json", f"{tmp_path}/votes", f"{tmp_path}/corpus2", f"{tmp_path}/stats2")
    t = api.Tables(state.documents, state.jobs, back, state.progress, state.verifications)
    api.verify(t, doc, 1, False, kept, rebuild=False)
    assert not (tmp_path / "corpus2").exists()
    for verdict, tier in ((True, True), (False, False)):
        api.verify(t, doc, 1, verdict, kept)
        found = spark.read.parquet(kept.corpus).filter("page_number = 1").collect()
        assert [r.verified for r in found] == [tier] and spark.read.json(kept.stats).first().total_records == 2
    sinks.write_corpus(done, f"{tmp_path}/corpus")
    sinks.write_stats(spark.read.parquet(f"{tmp_path}/corpus"), f"{tmp_path}/stats")
    assert spark.read.json(f"{tmp_path}/stats").first().total_records == 2
    sinks.write_texts(done, f"{tmp_path}/texts")
    sinks.write_merged_json(docs.select("doc_id").distinct(), done, f"{tmp_path}/merged")
    assert "page one" in "".join(r.text for r in store.current(spark, f"{tmp_path}/texts", form="json").collect())
    assert {r.output_engine_tag for r in store.current(spark, f"{tmp_path}/merged", form="json").collect()} <= {"mixed", "digital", "easyocr", "surya", None}
    out = tmp_path / "export"
    out.mkdir()

    def put(name, content):
        at = out / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(content)

    assert [r.error for r in sinks.export_files(sinks.page_files(done), put).collect()] == [None, None]
    assert {(r.doc_id, r.page_number, r.full_text) for r in files.read_page_json(spark, str(out)).collect()} == {(r.doc_id, r.page_number, r.full_text) for r in done.collect()}
    assert [r.error for r in sinks.export_files(sinks.page_files(done), lambda n, c: 1 / 0).collect()] == ["division by zero"] * 2
    shots = sinks.save_images(pages.filter("error is null"), lambda d, n, x: 1 / 0 if n == 2 else f"{d}/{n}.png")
    assert sorted(r.source_image_path.rsplit("/", 1)[-1] for r in shots.collect()) == ["", "1.png"]


def test_small_sources(spark, tmp_path):
    (tmp_path / "words.txt").write_text("# note\nক\n\n খ \nক\n #kept\n", encoding="utf-8")
    assert {r.word for r in files.read_lexicon(spark, f"{tmp_path}/words.txt").collect()} == {"ক", "খ", "#kept"}
    (tmp_path / "D").mkdir()
    (tmp_path / "D" / "page_3_surya.json").write_text('{"full_text": "x"}')
    (tmp_path / "D" / "page_4.json").write_text('{"full_text": "y"}')
    got = {(r.doc_id, r.page_number, r.engine) for r in files.read_page_json(spark, str(tmp_path)).collect()}
    assert got == {("D", 3, "surya"), ("D", 4, None)}
    (tmp_path / "ollama.txt").write_text(" read it \n")
    assert files.Settings().prompt("ollama", str(tmp_path)) == "read it" and files.Settings().prompt("x", str(tmp_path)) == "Read all text of this page."
    sinks.append_progress(spark.createDataFrame([("D", 1, 3, "processing", "", "t1"), ("D", 2, 3, "processing", "", "t2")], files.PROGRESS_SCHEMA), f"{tmp_path}/progress")
    assert sinks.last_progress(spark, f"{tmp_path}/progress").first().current_page == 2
    s = files.Settings.load({"DPI": "300"}, "GEMINI_ENABLED=true\n#DPI=1\nOLLAMA_PROMPT='p'\n")
    assert (s.dpi, s.gemini_enabled, s.prompt("ollama"), s.prompt("x")) == (300, True, "p", "Read all text of this page.")
    assert files.Settings.load({"DATA_DIR": "/d/", "SURYA_ENABLED": "false"}).folders()["merged"] == "/d/merged_outputs" and files.Settings(surya_enabled=False).flow_mode == "skip_surya"
    assert api.store_of(files.Settings(data_dir="/d")).texts == "/d/output_texts"
    assert api.health(spark)["status"] == "ok" and api.parser().parse_args(["a", "b", "--decoder", "m:f"]).domain == "general"


def test_described_images(spark):
    df = spark.createDataFrame([(100, 100, None), (900, 100, "a chart")], "w int, h int, d string")
    got = [r.x for r in df.select(B.described_image(F.lit(1), F.col("w"), F.col("h"), F.col("d")).alias("x")).collect()]
    assert [(x.type, x.description, x.confidence) for x in got] == [("seal", "seal (100x100px)", 0.5), ("table_or_chart", "a chart", 0.8)]


def test_block_corrections(spark):
    b = blocks(spark, [("বাাংলা", "bn", 0.9), ("plain  text", "en", 0.9), ("क" * 15 + "\nকখ", "mixed", 0.9)])
    got = b.select(B.correct_blocks("b", "surya").alias("c")).first().c
    assert [x.text for x in got.blocks] == ["বাংলা", "plain  text", "কখ"] and got.changed
    assert not blocks(spark, [("x", "en", 0.9)]).select(B.correct_blocks("b", "surya").alias("c")).first().c.changed
    assert not b.select(S.script_mismatch("b").alias("m")).first().m  # the Bangla share is a tenth and more
    assert blocks(spark, [("क" * 15, "en", 0.9)]).select(S.script_mismatch("b").alias("m")).first().m


def test_a_table_over_jdbc(spark):
    url = "jdbc:derby:memory:quire;create=true"
    df = spark.range(100).selectExpr("id", "id * 2 as twice")
    try:
        df.write.format("jdbc").option("url", url).option("dbtable", "t").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no database here: {type(e).__name__}")
    got = files.read_table(spark, url, "t", "id", (0, 100), 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("twice")).first()[0] == 9900
