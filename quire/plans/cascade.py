"""Recognition of page images by a cascade: each engine sees only the pages that those before it didn't settle.

Engines are functions that the caller gives. They run in mapInPandas over the unsettled rows alone; what a tier says is written to the
shared folder before the next, so no engine runs twice for a page, and never inside a conditional expression, which Spark may evaluate for all rows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import correct as C
from ..functions import text as T
from ..operators import blocks as B
from ..operators import score as S
from ..sources.files import Settings
from ..sources.scratch import written

Text = Callable[[bytes], str | list[str]]
Detect = Callable[[bytes], list]
_DETECTIONS = "array<struct<text:string,conf:double,points:array<struct<x:double,y:double>>>>"
#: A log of what engines were asked: one element an attempt.
CALLS = "array<struct<engine:string,attempt:int,tokens:bigint,failed:boolean,ms:double>>"
#: Pages whose answers a worker holds at once.
BATCH_PAGES = 128
#: Characters of the least usable answer, and of an error that is shown.
LEAST_CHARS, ERROR_CHARS = 20, 180
#: What a page's log says of each step, and the engines' names and methods.
TYPE, DIGITAL_OK, REROUTED, IMAGES, FLOOR = "type:", "digital_ok:%dchars", "digital_corrupt_rerouting", "images:%d", "llm_floor:%.2f"
PRIMARY_FIRST, NO_PRIMARY = ("ocr_mode:surya_first", "surya:trying"), ("ocr_mode:skip_surya", "surya:skipped_by_env")
PRIMARY_OK, PRIMARY_EMPTY, QUICK_OK = "surya:ok:%dchars", "surya:empty_fallthrough", "llm:skipped_sufficient_local:"
MODELS, MODEL_OK, MODEL_CHARS, MODEL_MISMATCH, MODELS_FAILED = "llm_chain:trying", "llm_chain:ok:", ":%dchars", "llm_chain:script_mismatch:", "llm_chain:failed:none:"
LAST, LAST_FOUND, LAST_MISMATCH, LAST_SCORE, LAST_MISSING = "easyocr:trying", "easyocr:%ddetections", "easyocr:script_mismatch", "easyocr:score:", "easyocr:unavailable"
DIGITAL, LOCAL, API = "digital", "ocr_local", "ocr_api"
PDF_TEXT, PRIMARY, DETECTOR = "PyMuPDF", "surya", "easyocr"

_made: dict[str, tuple[float, Callable | None]] = {}


class Answer(str):
    """A text with the number of tokens that it has cost, for an engine that knows it."""

    tokens = 0

    def __new__(cls, text: str, tokens: int = 0) -> Answer:
        out = super().__new__(cls, text)
        out.tokens = tokens
        return out


class Loaded:
    """An engine that each worker process makes at first use and keeps. Factories are tried in turn until one works (say, for fewer languages).

    While none does, the engine isn't available and fails at once; after so many seconds it is tried again.
    """

    def __init__(self, *factories: Callable[[], Callable], recheck: float = 30.0) -> None:
        self.factories, self.recheck, self.key = factories, recheck, uuid.uuid4().hex

    def available(self) -> bool:
        at, engine = _made.get(self.key, (-1e18, None))
        if engine is None and time.monotonic() - at >= self.recheck:
            for factory in self.factories:
                try:
                    engine = factory()
                    break
                except Exception:  # noqa: BLE001  engines are foreign code
                    continue
            _made[self.key] = (time.monotonic(), engine)
        return _made[self.key][1] is not None

    def __call__(self, x):
        if not self.available():
            raise RuntimeError("engine unavailable")
        return _made[self.key][1](x)


def prepared(engine: Callable, *steps: Callable[[bytes], bytes]) -> Callable:
    """The engine over images that the steps have made ready: a decoder of the bytes, then kernels of functions.images, or any others."""

    def ask(image: bytes):
        for step in steps:
            image = step(image)
        return engine(image)

    return ask


def retrying(engine: Callable, attempts: int = 2, delay: float = 2.0) -> Callable:
    """An engine that is asked again when it fails, after a pause; an empty answer is an answer."""

    def ask(image: bytes):
        for left in range(attempts - 1, -1, -1):
            try:
                return engine(image)
            except Exception:  # noqa: BLE001  engines are foreign code
                if not left:
                    raise
                time.sleep(delay)
        return ""

    return ask


def limited(engine: Callable, seconds: float) -> Callable:
    """An engine that has failed if its answer isn't there after so many seconds; what it still does is not waited for."""

    def ask(x):
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(engine, x).result(seconds)
        except FutureTimeout:
            raise TimeoutError(f"no answer in {seconds:g} s") from None
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return ask


@dataclass
class Engines:
    """primary and model read a page to text or lines, quick and full to detections (text, confidence, points). A missing one is passed over. The model's engine is its name.

    more_models (name, function) are asked, in order, for what the model has no usable answer to; models that fail are asked attempts times. repairer makes
    a better text of a doubtful one; describers say, in turn, what an embedded image shows. settings, if given, switch engines off and set thresholds.
    """

    primary: Text | None = None
    quick: Detect | None = None
    model: Text | None = None
    full: Detect | None = None
    model_name: str = "ollama"
    more_models: tuple[tuple[str, Text], ...] = ()
    least_chars: int = LEAST_CHARS
    corrections: dict = field(default_factory=dict)
    repairer: Callable[[str], str] | None = None
    describers: tuple[Callable[[bytes], str], ...] = ()
    attempts: int = 2
    delay: float = 2.0
    settings: Settings | None = None

    @property
    def lexicon(self) -> Sequence[str]:
        return self.corrections.get("lexicon", ())

    def models(self) -> list[tuple[str, Text]]:
        """Those that the settings leave on, in turn, within the time that they have; each is asked attempts times."""
        s = self.settings
        off = lambda name: s is not None and (name.startswith("ollama") and not s.ollama_enabled or name.startswith("gemini") and not s.gemini_enabled)
        every = [(self.model_name, self.model)] * (self.model is not None) + list(self.more_models)
        timed = lambda name, ask: limited(ask, s.ollama_timeout) if s is not None and name.startswith("ollama") else ask
        return [(name, timed(name, ask)) for name, ask in every if not off(name)]

    def first(self) -> Text | None:
        return self.primary if self.settings is None or self.settings.surya_enabled else None


def _asked(name: str, engine: Callable, x, empty, calls: list, attempts: int = 1, delay: float = 0.0) -> tuple:
    """What the engine says, and the start of its last error; a page that it fails on is one that it finds nothing on. Each attempt is added to calls."""
    why = ""
    for attempt in range(1, attempts + 1):
        began = time.perf_counter()
        try:
            said, why = engine(bytes(x) if isinstance(x, (bytearray, memoryview)) else x) or empty, ""
        except Exception as e:  # noqa: BLE001  engines are foreign code
            said, why = empty, (str(e) or type(e).__name__).replace("\n", " ")[:ERROR_CHARS]
        calls.append({"engine": name, "attempt": attempt, "tokens": int(getattr(said, "tokens", 0)), "failed": bool(why), "ms": round((time.perf_counter() - began) * 1000, 3)})
        if not why:
            break
        if attempt < attempts:
            time.sleep(delay)
    return said, why


def _few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in parts, as what engines say of a page is many small objects until it is written."""
    for b in batches:
        for start in range(0, len(b), BATCH_PAGES):
            yield b.iloc[start : start + BATCH_PAGES]


def _read(pages: DataFrame, image: str, name: str, engine: Text, attempts: int = 1, delay: float = 0.0) -> DataFrame:
    """pages with said (lines joined by line feeds) and why (an error, or nothing), and the calls in their log."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _few(batches):
            logs = [[] for _ in range(len(b))]
            got = [_asked(name, engine, x, "", log, attempts, delay) for x, log in zip(b[image], logs)]
            yield b.assign(said=[x if isinstance(x, str) else "\n".join(x) for x, _ in got], why=[e for _, e in got], made=logs)

    return _logged(pages.mapInPandas(run, _with(pages, f"said string, why string, made {CALLS}")))


def _detect(pages: DataFrame, image: str, name: str, engine: Detect) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _few(batches):
            logs = [[] for _ in range(len(b))]
            rows = [[{"text": t, "conf": float(c), "points": [{"x": float(x), "y": float(y)} for x, y in p]} for t, c, p in _asked(name, engine, x, [], log)[0]] for x, log in zip(b[image], logs)]
            yield b.assign(seen=rows, made=logs)

    return _logged(pages.mapInPandas(run, _with(pages, f"seen {_DETECTIONS}, made {CALLS}")))


def _logged(pages: DataFrame) -> DataFrame:
    return pages.withColumn("calls", F.concat("calls", "made")).drop("made")


def _mapped(pages: DataFrame, column: str, out: str, f: Callable) -> DataFrame:
    """pages with the array f(value, calls) of strings or nulls as a column out, and the calls in their log."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _few(batches):
            logs = [[] for _ in range(len(b))]
            yield b.assign(**{out: [None if x is None else f(x, log) for x, log in zip(b[column], logs)]}, made=logs)

    return _logged(pages.mapInPandas(run, _with(pages, f"{out} array<string>, made {CALLS}")))


def _with(pages: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), more])


def _write(df: DataFrame) -> DataFrame:
    return written(df, "cascade")


def _log(*steps: str | Column) -> Column:
    return F.concat("steps", F.array(*[F.lit(s) if isinstance(s, str) else s for s in steps]))


def primary_text(said: str | Column, least_chars: int = LEAST_CHARS, devanagari_reject: float = 0.18, bangla_least: float = 0.12) -> Column:
    """The first engine's lines as one text: cleaned, without Devanagari lines; empty if it is too short or still in the wrong script."""
    clean = C.drop_devanagari_lines(C.clean_lines(F.split(T.col(said), "\n", -1)))
    good = lambda t: (F.length(T.strip(t)) >= least_chars) & ~T.wrong_script(t, bangla_least, devanagari_reject)
    return T.let(clean, lambda t: F.when(good(t), t).otherwise(""))


def recognise(pages: DataFrame, engines: Engines, image: str = "image") -> DataFrame:
    """pages with blocks, method, engine, correction_applied, confidence_score, steps and calls (what engines were asked for the page)."""
    pages = pages if "calls" in pages.columns else pages.withColumn("calls", F.array().cast(CALLS))
    kept = pages.columns
    settled: list[DataFrame] = []
    primary, s = engines.first(), engines.settings or Settings()
    limits = (s.ocr_min_bangla_ratio, s.ocr_devanagari_reject_threshold)
    rest = pages.withColumn("steps", F.array(*map(F.lit, PRIMARY_FIRST if primary else NO_PRIMARY)))
    shown = lambda x: F.format_string("%.3f", T.rounded(x, 3))

    def score(b: str) -> Column:
        return S.page_score(b, lexicon=engines.lexicon)

    def done(df: DataFrame, source: str, method: str, engine: str | Column, *steps: str | Column) -> DataFrame:
        df = df.withColumn("steps", _log(*steps)) if steps else df
        better = None
        if source == DETECTOR and engines.repairer is not None:
            # the model's stage, for the pages with a block that is due
            due = df.withColumn("due", B.repairable(F.col("blocks"), source, **engines.corrections))
            due = _write(due)
            told = F.exists("due", lambda x: x.isNotNull())
            ask = lambda t, calls: C.repaired(t, lambda x: _asked("repairer", engines.repairer, x, "", calls)[0])
            made = _mapped(due.filter(told), "due", "better", lambda own, calls: [None if t is None else ask(t, calls) for t in own])
            df, better = due.filter(~told).withColumn("better", F.lit(None).cast("array<string>")).unionByName(made).drop("due"), "better"
        fixed = df.withColumn("fixed", B.correct_blocks("blocks", source, repaired=better, **engines.corrections))
        return fixed.select(
            *kept, F.col("fixed.blocks").alias("blocks"), F.lit(method).alias("method"), (F.lit(engine) if isinstance(engine, str) else engine).alias("engine"),
            F.col("fixed.changed").alias("correction_applied"), "steps",
        )

    if primary:
        read = _write(_read(rest, image, PRIMARY, primary)).withColumn("said", primary_text("said", engines.least_chars, s.surya_devanagari_reject_threshold, s.surya_min_bangla_ratio))
        settled.append(done(read.filter("said <> ''").withColumn("blocks", B.paragraphs("said")), PRIMARY, LOCAL, PRIMARY, F.format_string(PRIMARY_OK, F.length("said"))))
        rest = read.filter("said = ''").drop("said", "why").withColumn("steps", _log(PRIMARY_EMPTY))
    if engines.quick:
        seen = _write(_detect(rest, image, DETECTOR, engines.quick)).withColumn("blocks", B.detection_blocks("seen"))
        seen = seen.withColumn("c", score("blocks")).withColumn("good", ~S.needs_fallback(F.col("c"), S.is_bangla("blocks")))
        settled.append(done(seen.filter("good"), DETECTOR, LOCAL, DETECTOR, F.concat(F.lit(QUICK_OK), shown(F.col("c")))))
        rest = seen.filter("not good").drop("seen", "blocks", "good", "c")
    if models := engines.models():
        rest = rest.withColumns({"steps": _log(MODELS), "reasons": F.array().cast("array<string>")})
        answered: list[DataFrame] = []
        for name, ask in models:
            read = _write(_read(rest, image, name, ask, engines.attempts, engines.delay)).withColumns({"by": F.lit(name), "said": T.strip("said")})
            usable = F.length("said") >= LEAST_CHARS
            answered.append(read.filter(usable))
            why = F.concat(F.lit(f"{name}="), F.when(F.col("why") == "", "no usable text").otherwise(F.col("why")))
            rest = read.filter(~usable).withColumn("reasons", F.concat("reasons", F.array(why))).drop("said", "by", "why")
        read = answered[0]
        for df in answered[1:]:
            read = read.unionByName(df)
        read = read.withColumns({"blocks": B.model_blocks("said"), "n": F.length("said")})
        tried = _write(done(read, "ollama", API, F.col("by"), F.concat(F.lit(MODEL_OK), "by", F.format_string(MODEL_CHARS, "n"))))
        wrong = S.script_mismatch("blocks", *limits)
        settled.append(tried.filter(~wrong))
        missed = tried.filter(wrong).select(*kept, F.concat(F.slice("steps", 1, F.size("steps") - 1), F.array(F.concat(F.lit(MODEL_MISMATCH), "engine"))).alias("steps"))
        rest = missed.unionByName(rest.withColumn("steps", _log(F.concat(F.lit(MODELS_FAILED), F.array_join("reasons", ";")))).select(*kept, "steps"))
    if last := engines.full or engines.quick:
        seen = _write(_detect(rest.withColumn("steps", _log(LAST)), image, DETECTOR, last)).withColumn("blocks", B.detection_blocks("seen"))
        found = done(seen.withColumn("n", F.size("seen")), DETECTOR, LOCAL, DETECTOR, F.format_string(LAST_FOUND, "n"))
        mismatch = F.when(S.script_mismatch("blocks", *limits), F.array(F.lit(LAST_MISMATCH))).otherwise(F.array().cast("array<string>"))
        n = F.size("steps")
        steps = F.concat(F.slice("steps", F.lit(1), n - 1), mismatch, F.slice("steps", n, F.lit(1)), F.array(F.concat(F.lit(LAST_SCORE), shown(score("blocks")))))
        settled.append(found.withColumn("steps", steps))
    else:
        settled.append(done(rest.withColumn("blocks", F.array().cast(B.BLOCKS)), "none", LOCAL, "none", LAST_MISSING))
    out = settled[0]
    for df in settled[1:]:
        out = out.unionByName(df)
    return out.withColumn("confidence_score", score("blocks"))


def described(pages: DataFrame, describers: Sequence[Callable[[bytes], str]] = ()) -> DataFrame:
    """pages with their embedded images as structs: image_id, type, detected_text, description, confidence. The first describer with an answer counts."""

    pages = pages if "calls" in pages.columns else pages.withColumn("calls", F.array().cast(CALLS))

    def say(images, calls: list) -> list[str | None]:
        def one(image) -> str | None:
            for n, ask in enumerate(describers, 1):
                said, _ = _asked(f"describer {n}", ask, image["image_bytes"], "", calls)
                if said.strip():
                    return said.strip()
            return None

        return [one(x) for x in images]

    pages = pages.withColumn("images", F.coalesce("images", F.array().cast(pages.schema["images"].dataType)))
    said = F.transform("images", lambda _: F.lit(None).cast("string"))
    if describers and "image_bytes" in pages.schema["images"].dataType.elementType.names:
        has = F.size("images") > 0
        pages = pages.filter(~has).withColumn("said", F.array().cast("array<string>")).unionByName(_mapped(pages.filter(has), "images", "said", say))
        said = F.col("said")
    numbered = lambda x, t: F.struct(x.alias("x"), t.alias("t"))
    made = F.transform(F.zip_with("images", said, numbered), lambda p, i: B.described_image(i + 1, p["x"]["width"], p["x"]["height"], p["t"]))
    return pages.withColumn("images", made).drop("said")


def process_pages(pages: DataFrame, engines: Engines, domain: str = "unknown", put: Callable[[str, int, bytes], str] | None = None) -> DataFrame:
    """The whole page pipeline. pages: doc_id, page_number, text, image, tables (arrays of rows, may be null) and images (width, height; image_bytes for describers).

    A digital page with a valid text becomes blocks after its numbers are fixed; every other page goes through the cascade and has its table rebuilt from positions.
    put saves the image of a page that is recognised and says where; it may fail. Of a page's log there are unicode_validation (of digital text, as JSON), calls (of engines), ms (what these took) and steps.
    """
    from ..functions.validate import validate
    from ..operators.documents import page_decisions
    from ..sources.sinks import with_saved_images

    kept = ["doc_id", "page_number", "tables", "images", "unicode_validation", "calls"]
    routed = pages.withColumn("kind", T.page_type("text")).withColumn("v", F.when(F.col("kind") == "digital", validate("text")))
    routed = routed.withColumns({"valid": F.coalesce("v.is_valid", F.lit(False)), "unicode_validation": F.to_json("v"), "calls": F.array().cast(CALLS)})
    # validated once; images of digital pages aren't needed any more
    routed = _write(routed.withColumns({"image": F.when(~F.col("valid"), F.col("image")), "text": F.when(F.col("valid"), F.col("text"))}).drop("v"))
    fixed = routed.filter("valid").withColumn("fixed", C.fix_numbers("text")["text"])
    digital = fixed.select(
        *kept, F.lit("").alias("source_image_path"), B.paragraphs("fixed").alias("blocks"), F.lit(DIGITAL).alias("method"), F.lit(PDF_TEXT).alias("engine"), F.lit(False).alias("correction_applied"),
        F.array(F.lit(TYPE + DIGITAL), F.format_string(DIGITAL_OK, F.length("fixed"))).alias("steps"),
    )
    digital = digital.withColumn("tables", C.digital_tables("tables")).withColumn("confidence_score", S.page_score("blocks", lexicon=engines.lexicon))
    seen = with_saved_images(routed.filter("not valid").select(*kept, "image", "kind"), put)
    scanned = recognise(seen, engines)
    began = F.concat(F.array(F.concat(F.lit(TYPE), F.col("kind"))), F.when(F.col("kind") == "digital", F.array(F.lit(REROUTED))).otherwise(F.array().cast("array<string>")))
    scanned = scanned.withColumn("steps", F.concat(began, F.col("steps"))).withColumn("table", B.scanned_table(B.block_detections("blocks")))
    one = F.struct(F.lit(1).alias("table_id"), B.table_confidence("table").alias("structure_confidence"), F.col("table").alias("rows"))
    scanned = scanned.withColumn("tables", F.when(F.col("table").isNotNull(), F.array(one)).otherwise(F.array().cast(C.TABLES))).select(digital.columns)
    out = described(digital.unionByName(scanned), engines.describers).withColumn("full_text", S.full_text("blocks"))
    log = F.concat("steps", F.when(F.size("images") > 0, F.array(F.format_string(IMAGES, F.size("images")))).otherwise(F.array().cast("array<string>")))
    floored = S.with_floor(F.col("confidence_score"), F.col("method"), S.is_bangla("blocks"), F.col("full_text"))
    out = out.withColumns({"raised": floored, "steps": log})
    raised = F.when(F.col("raised") != F.col("confidence_score"), F.array(F.lit(FLOOR % S.LLM_FLOOR))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns({"steps": F.concat("steps", raised), "confidence_score": F.col("raised")}).drop("raised")
    ms = F.aggregate("calls", F.lit(0.0), lambda total, c: total + c["ms"])
    more = {"verified": F.lit(False), "domain": F.lit(domain), "decisions": page_decisions(), "numeric_validation_passed": F.lit(True), "ms": T.rounded(ms, 1)}
    return out.withColumns(more).withColumn("confidence_tier", S.tier(F.col("confidence_score"), F.col("verified"), F.lit("")))


def call_log(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, engine, attempt, tokens, failed, ms: every call that was made for pages. Read it from where the pages were written, and a task that Spark ran twice counts once."""
    return pages.select("doc_id", "page_number", F.explode("calls").alias("c")).select("doc_id", "page_number", "c.*")
