"""Dictionary search against plain searching, beyond every size that a list in the plan could have."""

import re

import pytest

from veilspark.operators import detect, dictionary


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "msg_id bigint, body string")


def places(text, value, word):
    if word:
        return [m.start() for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(value)}(?![A-Za-z0-9])", text, re.I | re.A)]
    return [i for i in range(len(text)) if text.startswith(value, i)]


@pytest.mark.parametrize("block", [1_000_000, 61])
def test_occurrences(spark, rng_words, monkeypatch, block):
    texts, entries = rng_words
    monkeypatch.setattr(dictionary, "BLOCK_BYTES", block)
    table = spark.createDataFrame([(f"e{i}", v, w) for i, (v, w) in enumerate(entries)], "entry string, value string, word boolean")
    got = dictionary.occurrences(frame(spark, texts), table, ["msg_id"]).collect()
    want = [(i, p, len(v), f"e{k}") for i, t in enumerate(texts) if t for k, (v, w) in enumerate(entries) if v for p in places(t, v, w)]
    assert sorted((r.msg_id, r.start, r.len, r.entry) for r in got) == sorted(want)
    assert all(r.original == texts[r.msg_id][r.start : r.start + r.len] for r in got)


@pytest.fixture(scope="module")
def rng_words():
    import random

    rng = random.Random(5)
    sign = "aAbB1 é日𝄞-."
    texts = ["".join(rng.choice(sign) for _ in range(rng.choice([0, 1, 3, 30, 300]))) for _ in range(60)] + [None, "aaaa" * 40]
    entries = {(v, bool(re.fullmatch("[A-Za-z0-9]+", v)) and rng.random() < 0.6) for v in ("".join(rng.choice(sign) for _ in range(rng.choice([1, 1, 2, 3, 4, 5]))) for _ in range(120))}
    entries |= {(texts[i][3 : 3 + n], False) for i in range(60) if texts[i] and len(texts[i]) > 100 for n in (8, 31, 32, 33, 64, 90)}
    return texts, [*sorted(entries), ("aaaa" * 9, False), ("", False), (None, False)]


def test_many_and_long_entries(spark):
    """Past the sizes at which lists were cut: 100 000 terms, a value of 100 000 characters, the 201st entry."""
    terms = spark.range(100_000).selectExpr("concat('term', id) AS term")
    texts = ["see TERM99999 and term500, not term5000000 or xterm7", "nothing"]
    got = dictionary.find_terms(frame(spark, texts), dictionary.clean_terms(terms), ["msg_id"]).collect()
    assert sorted((r.msg_id, r.start, r.term) for r in got) == [(0, 4, "term99999"), (0, 18, "term500")]
    long = "".join(chr(97 + i * i % 23) for i in range(100_000))
    rows = [(i, f"n{i}", f"value-{i:05}-x", "mask", True, "value") for i in range(300)] + [(900, "long", long, "block", True, "value"), (901, "off", "nothing", "mask", False, "value")]
    entries = spark.createDataFrame(rows, "pos bigint, name string, value string, action string, enabled boolean, kind string")
    texts = ["é" + long + " value-00299-x", long[1:], "nothing"]
    got = dictionary.find_values(frame(spark, texts), entries, ["msg_id"]).collect()
    assert sorted((r.msg_id, r.start, r.len, r.locker_entry, r.action) for r in got) == [(0, 1, 100_000, "long", "block"), (0, 100_002, 13, "n299", "mask")]
    assert sorted(r.entry for r in dictionary.entry_names(frame(spark, texts), entries, ["msg_id"]).collect()) == ["long", "n299"]


def test_terms_do_not_overlap_themselves(spark):
    terms = spark.createDataFrame([("哈哈",), (" 哈哈 ",), ("a-a",), ("Atlas",), ("ATLAS",), ("",), (None,)], "term string")
    clean = dictionary.clean_terms(terms)
    assert sorted(r.term for r in clean.collect()) == ["ATLAS", "a-a", "哈哈"]
    got = dictionary.find_terms(frame(spark, ["哈哈哈哈哈", "a-a-a-a", "atlas atlas2", None, ""]), clean, ["msg_id"]).collect()
    assert sorted((r.msg_id, r.start, r.len) for r in got) == [(0, 0, 2), (0, 2, 2), (1, 0, 3), (1, 4, 3), (2, 0, 5)]


def test_scan_with_tables(spark):
    terms = spark.createDataFrame([("13800138000 call",)], "term string")
    entries = spark.createDataFrame([(0, "k", "s3cret-value", "block", True, "value")], "pos bigint, name string, value string, action string, enabled boolean, kind string")
    texts = ["ring 13800138000 call or s3cret-value", "mail a@b.org", "plain"]
    both = dictionary.scan_with(frame(spark, texts), ["msg_id"], None, None, dictionary.clean_terms(terms), entries)
    got = {r.msg_id: [(h.tag, h.start, h.len, h.action) for h in r.hits] for r in both.collect()}
    assert got == {0: [("CUSTOM_TERM", 5, 16, "mask"), ("LOCKER", 25, 12, "block")], 1: [("EMAIL", 5, 7, "mask")], 2: []}
    plain = {r.msg_id: r.hits for r in dictionary.scan_with(frame(spark, texts), ["msg_id"]).collect()}
    assert plain == {r.msg_id: r.hits for r in detect.with_hits(frame(spark, texts)).collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "term string")
    assert dictionary.find_terms(frame(spark, ["a b"]), dictionary.clean_terms(none), ["msg_id"]).count() == 0
    one = spark.createDataFrame([("a",)], "term string")
    assert dictionary.find_terms(spark.createDataFrame([], "msg_id bigint, body string"), dictionary.clean_terms(one), ["msg_id"]).count() == 0
    assert dictionary.clean_terms(spark.createDataFrame([("abc",), ("b",)], "term string"), max_chars=2, max_count=1).count() == 1


def test_few_windows_pass_by_chance(spark):
    """Many entries of about one size: each window is tried at all their lengths, and what passes carries its string."""
    import random

    rng = random.Random(3)
    sign = "abcdefghij klmnop"
    value = lambda n: "".join(rng.choices(sign, k=n))
    entries = spark.createDataFrame([(f"e{n}", value(n), False) for n in range(1100, 2000)], "entry string, value string, word boolean")
    texts = frame(spark, [value(100_000), value(100_000), entries.where("entry = 'e1500'").first().value])
    found, _ = dictionary._candidates(texts, entries, ["msg_id"], "body", dictionary.MAX_BITS)
    assert found.count() < 50
    assert [(r.msg_id, r.entry, r.start, r.len) for r in dictionary.occurrences(texts, entries, ["msg_id"]).collect()] == [(2, "e1500", 0, 1500)]
