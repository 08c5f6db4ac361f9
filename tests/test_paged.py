"""Documents whose pages are read in ranges."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.sources import files, paged


def count(content: bytes) -> int:
    if content.startswith(b"bad"):
        raise ValueError("not a\ndocument")
    return content.count(b"\n") + 1


def decode(content: bytes, first: int, last: int):
    for n, line in enumerate(content.decode().split("\n")[first - 1 : last], first):
        if line == "broken":
            raise OSError(f"no page {n}")
        yield {"text": line, "image": line.encode() * 3}


def load(path: str) -> bytes:
    from urllib.parse import unquote, urlparse

    with open(unquote(urlparse(path).path), "rb") as f:
        return f.read()


@pytest.mark.parametrize("way", ["rows", "source"])
def test_pages_in_ranges(spark, tmp_path, way):
    many = "\n".join("broken" if n == 900 else f"page {n}" for n in range(1, 2001))
    for name, content in (("many", many), ("one", "alone"), ("bad", "bad"), ("plain", "\n".join(f"p{n}" for n in range(64)))):
        (tmp_path / f"{name}.pdf").write_text(content)
    docs = files.read_documents(spark, str(tmp_path))
    read = (lambda: paged.read_pages(docs, count, decode, 100)) if way == "rows" else lambda: paged.read_paged_files(spark, docs, count, decode, load, 100, "test_pages")
    got = [(r.doc_id.split("_")[0], r.page_number, r.text, r.error) for r in read().select("doc_id", "page_number", "text", "error").collect()]
    own = {n: t for d, n, t, e in got if d == "many" and e is None}
    # a page that breaks costs what its range had left; the ranges after it are whole
    assert set(own) == {*range(1, 900), *range(901, 2001)} and all(t == f"page {n}" for n, t in own.items())
    assert [e for d, _, _, e in got if d == "many" and e] == ["page 900: OSError: no page 900"]
    assert [(n, t) for d, n, t, _ in got if d == "one"] == [(1, "alone")] and sorted(n for d, n, _, _ in got if d == "plain") == list(range(1, 65))
    assert [(n, e) for d, n, _, e in got if d == "bad"] == [(None, "ValueError: not a document")]
    if way == "source":
        assert read().rdd.getNumPartitions() == 20 + 1 + 1 + 1
    # read as one, a file keeps what came before its error
    whole = files.decode_pages(docs, lambda c: decode(c, 1, count(c)))
    assert whole.filter("error is null").count() == 899 + 1 + 64 and sorted(r.error for r in whole.filter("error is not null").collect()) == ["ValueError: not a document", "page 900: OSError: no page 900"]
    assert paged.read_pages(docs.limit(0), count, decode).collect() == []


def test_batches_hold_a_bounded_number_of_bytes():
    seen = []

    def pages():
        for n in range(50):
            seen.append(n)
            yield {"doc_id": "d", "page_number": n, "text": "x", "image": bytes(1 << 20), "tables": None, "images": None, "error": None}

    schema = pa.schema([("doc_id", pa.string()), ("page_number", pa.int32()), ("text", pa.string()), ("image", pa.binary())])
    batches = paged.batched(pages(), schema, 4 << 20)
    first = next(batches)
    assert first.num_rows <= 4 and len(seen) <= 5  # no more is decoded than a batch needs
    assert sum(b.num_rows for b in batches) + first.num_rows == 50
