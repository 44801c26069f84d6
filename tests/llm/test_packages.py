"""Archive packages, sharding and the pipeline."""

import hashlib
import io
import zipfile
import zlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

from veilspark.llm import sharding, warczip


@pytest.fixture()
def pages(spark):
    big = "<p>é</p>" * 400
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big + "x"), (4, "u\r\nX: y", None), (5, "http://c", ""), (6, "http://d", "short"), (7, "http://d", "short"),
            (None, "http://e", big), (2, "http://b", big), (9, "http://f", "z" * 2_000_000), (10, "http://g", "WARC/1.1\r\n\r\n" * 200)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, type string, offset int")


def test_round_trip(pages, tmp_path):
    rows, frame = pages
    folder = f"file://{tmp_path}/p"
    got = warczip.archive_round_trip(frame, folder).collect()
    data = lambda h: (h or "").encode()
    top = {}
    for i, _, h in rows:
        if i is not None and len(data(h)) >= 1000:
            top[h] = max(top.get(h, i), i)
    want = Counter()
    for i, _, h in rows:
        revisit = i is not None and len(data(h)) >= 1000 and i < top[h]
        want[(i, len(data(h)), hashlib.sha1(data(h)).hexdigest(), "revisit" if revisit else "response", top[h] if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    for path in tmp_path.glob("p/*.wacz"):  # any other reader opens the packages too
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.namelist() == [warczip.DATA, warczip.INDEX]
    assert warczip.archive_round_trip(frame.limit(0), f"file://{tmp_path}/q").count() == 0


def test_payloads_come_back(pages, tmp_path):
    rows, frame = pages
    warczip.make_folder(f"file://{tmp_path}/p")
    packages = warczip.write_packages(frame, f"file://{tmp_path}/p", package_bytes=500)
    assert packages.count() > 1
    got = {r.page_id: r for r in warczip.read_packages(packages, f"file://{tmp_path}/p").collect() if r.type == "response"}
    assert bytes(got[9].payload) == b"z" * 2_000_000 and got[9].url == "http://f" and got[4].url == "u  X: y" and got[3].url is None


def test_directory_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"12345")
        z.writestr(zipfile.ZipInfo("b"), b"deflated" * 99, compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("c", b"6789")
        z.comment = b"PK\x05\x06 a comment that looks like the end of a directory....."
    data = out.getvalue()
    found = warczip.directory(lambda at, n: data[at : at + n], len(data))
    assert {n: data[a : a + k] for n, (a, k) in found.items()} == {"a": b"12345", "c": b"6789"}
    with pytest.raises(ValueError):
        warczip.directory(lambda at, n: data[at : at + n][:30], 30)


@pytest.mark.parametrize("per_range", [20_000, 7])
def test_shards(spark, docs_frame, per_range):
    rows = [(i if i % 17 else None, None if i % 13 == 0 else f"text {i % 50}" * (i % 7)) for i in range(503)] + [(3, "same")] * 40
    got = sharding.interleave(docs_frame(rows), shards=8, rows_per_range=per_range).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    mix = Counter((r.shard, r.source) for r in got)
    whole = Counter(r.source for r in got)
    assert all(abs(mix[(s, c)] - whole[c] / 8) <= 2 for s in by for c in whole)
    assert sharding.interleave(docs_frame([]), shards=8).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "pieces", "n_pieces", "restored"]
    assert 0 < out.count() < docs.count() and out.where("NOT restored").count() == 0


def test_stages_take_odd_rows(spark, sf, docs_frame):
    import corpus_pipeline

    odd = docs_frame([(None, "a b c"), (1, None), (2, ""), (3, "same text here now"), (3, "same text here now"), (4, "password=hunter2222 x"), (5, "long " * 20000)]).select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf)
            rows = out.collect()
            assert out.columns[:5] == odd.columns, name
            if name == "near_duplicates" and frame is odd:
                assert Counter(r.doc_id for r in rows) == Counter([None, 1, 2, 3, 4, 5])
            elif name == "secrets" and frame is odd:
                assert {r.text for r in rows if r.doc_id == 4} == {"[secret] x"}
            elif frame is odd:
                assert len(rows) == 7, name


def test_no_unique_text_is_lost_to_a_shared_id(spark, docs_frame, sf):
    import corpus_pipeline

    a, b, c = "the first text of some eight words here", "another text that nothing else is near to at all", "a third one without any id of its own here"
    left = corpus_pipeline.drop_near_duplicates(spark, docs_frame([(1, a), (5, a), (5, b), (5, b), (None, c), (None, c), (None, a), (7, None), (8, "")]), sf)
    assert sorted((str(r.doc_id), r.text) for r in left.select("doc_id", "text").where("text <> ''").collect()) == [("1", a), ("5", b), ("None", c)]
    assert left.where("text IS NULL OR text = ''").count() == 2
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs_frame([(3, a), (2, a), (4, b)]), sf).collect()) == [2, 4]
    assert corpus_pipeline.drop_near_duplicates(spark, docs_frame([]), sf).count() == 0


def test_stages_keep_columns_of_any_name(spark, docs_frame, sf):
    import corpus_pipeline

    names = ("_row", "_row_", "redacted", "pieces", "restored", "decoded", "_masked", "predicted", "kept", "n")
    rows = [(1, "token = abcdef0123 and more"), (2, None), (2, "plain words in a row"), (None, "")]
    docs = docs_frame(rows)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows_out = out.collect()
        assert len(rows_out) == 4, name
        if name != "sentencepiece":
            assert out.columns == docs.columns
        for n in names:
            if name != "sentencepiece" or n not in ("pieces", "restored"):
                assert {r[n] for r in rows_out} == {n}, (name, n)
    assert out.columns.count("pieces") == 1 and all(r.restored for r in rows_out)
