"""Token-id records: an exact round trip against the library's own encoding of whole texts."""

import zlib

import numpy as np
import pytest

from docloom.llm import records as R

TEXTS = [(7, "The cat's paw.\nNext  line   here "), (3, None), (5, ""), (-2, "één über ñ 123 4567\t\n\n x"), (9, " lead"), (9, " lead"), (None, "no id"), (11, "word " * 3000), (12, "a<|endoftext|>b c"), (13, "\nx\n y\tz\r\nq \tw\t\t v\n"), (14, "a\n\n\nb"), (15, "\u00a0 a \u00a0b\u2003"), (16, " "), (17, "\n"), (18, "it's we'll 'tis\n's")]


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(R.tokenizer_path())
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, start string").repartition(3)
    got = sorted(map(tuple, R.token_records(docs).collect()), key=lambda r: r[1])
    assert got == brute(TEXTS)


def test_empty(spark):
    assert R.token_records(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_broken_record():
    data = bytearray(R.frame(b"some body"))
    assert R.parse(bytes(data), 0) == (b"some body", len(data))
    for at in (2, 14):
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            R.parse(bytes(bad), 0)


def test_table_against_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, R.token_records(docs).collect()), key=lambda r: r[1])
    assert got == brute(rows)


def test_many_shards_and_null_ids(spark, monkeypatch):
    """More shards than shuffle partitions, one task each; rows without an id are spread over several, in a fixed order."""
    monkeypatch.setattr(R, "SHARD_BYTES", 200)
    rows = [(None, f"null {k % 37} " * 5) for k in range(120)] + [(k % 300, f"text {k} " * 4) for k in range(350)] + [(7, "hot")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = R.new_folder(spark, "records")
    manifest = R.write_records(docs, folder).collect()
    assert len(manifest) > 40 and sum(m["records"] for m in manifest) == len(rows) and max(m["records"] for m in manifest if m["shard"] > 30) < 120
    first = R.read_records(spark, folder, manifest)
    got = [tuple(r) for r in first.orderBy("start").collect()]
    starts = [0]
    for r in got:
        assert r[1] == starts[-1]
        starts.append(r[1] + r[2])
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda i: (i is not None, i or 0))
    want = sorted((i, n, c) for i, _, n, c in brute(rows) if i is not None)
    assert sorted((r[0], r[2], zlib.crc32(bytes(r[3]))) for r in got if r[0] is not None) == want
    null = [zlib.crc32(bytes(r[3])) for r in got if r[0] is None]
    assert sum(m["shard"] < 20 for m in manifest) > 5 and sorted(null) == sorted(c for i, _, _, c in brute(rows) if i is None)
    again = R.new_folder(spark, "records")
    second = R.read_records(spark, again, R.write_records(docs.repartition(2), again).collect())
    assert [tuple(r) for r in second.orderBy("start").collect()] == got
