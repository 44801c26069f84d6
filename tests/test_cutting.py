"""Blocks of chunks against one state machine that reads a whole reply."""

import random

import pytest

from veilspark.functions.holdback import Frames, Utf8
from veilspark.operators import cutting
from veilspark.operators import frames as fr


def replies(rng):
    atoms = ["data: x", "\n", "\r\n", "\n\n", "\r\n\r\n", "é𝄞", "y", "\r", "", "\n\n\n"]
    out = {f"r{i}": "".join(rng.choice(atoms) for _ in range(rng.choice([0, 1, 20, 300]))) for i in range(25)}
    return out | {"ends": "\n" * 301, "lines": "a" + "\r\n" * 150, "long": "data: " + "z" * 5000, "late": "\n" * 90 + "b\n\nc"}


def cuts(rng, whole):
    at = 0
    while at < len(whole) or at == 0:
        n = rng.choice([0, 1, 1, 2, 3, 17])
        yield whole[at : at + n]
        at += n
        if not whole and n:
            return


@pytest.mark.parametrize("block", [1, 4, 256])
def test_frames(spark, block):
    rng = random.Random(block)
    texts = replies(rng)
    rows = [(c, i * 3, p) for c, t in texts.items() for i, p in enumerate(cuts(rng, t))]
    want = []
    for c, t in texts.items():
        whole = Frames(1 << 40)
        found = whole.push(t) + whole.finish()
        want += [(c, i, raw) for i, (raw, _) in enumerate(found)]
    got = cutting.cut_frames(spark.createDataFrame(rows + [("null", 0, None)], "conn string, seq bigint, text string").repartition(7), block).collect()
    assert sorted((r.conn, r.frame_no, r.raw) for r in got) == sorted(want)


@pytest.mark.parametrize("block", [2, 64])
def test_decode(spark, block):
    rng = random.Random(block)
    raw = {c: t.encode() + rng.choice([b"", b"\xe4\xbd", b"\xf0\x9d\x84"]) for c, t in replies(rng).items()} | {"bad": b"\xe4A\xff\xbd\xe4\xbd\xa0" * 40}
    rows = [(c, i, p) for c, b in raw.items() for i, p in enumerate(cuts(rng, b))]
    want = []
    for c in raw:
        one = Utf8()
        mine = [(i, one.push(p)) for k, i, p in rows if k == c]
        rest = one.finish()
        want += [(c, i, t) for i, t in mine] + ([(c, mine[-1][0] + 1, rest)] if rest else [])
    got = cutting.decode(spark.createDataFrame(rows, "conn string, seq bigint, chunk binary").repartition(5), block).collect()
    assert sorted((r.conn, r.seq, r.text) for r in got) == sorted(want)


def test_a_frame_of_two_megabytes_is_one_frame(spark):
    half = "data: " + "q" * 1_100_000
    rows = [("c", 0, half), ("c", 1, "r" * 1_000_000 + "\n"), ("c", 2, "\n"), ("c", 3, "data: [DONE]\n\n")]
    df = spark.createDataFrame(rows, "conn string, seq bigint, text string")
    fields = fr.frame_fields(fr.frames(df)).orderBy("frame_no").collect()
    assert [len(r.data) for r in fields] == [2_100_000, 6] and [r.kind for r in fields] == ["data", "done"] and not any(r.forced for r in fields)
    forced = fr.frames(df, max_backlog=1 << 20).collect()
    assert any(r.forced for r in forced)


def test_snapshot_drops_what_came_before(spark):
    delta = 'data: {"type":"response.output_text.delta","delta":"%s"}\n\n'
    rows = [("a", 0, delta % "partial PII:PHONE:8f"), ("a", 1, 'data: {"type":"response.output_text.done","text":"final text"}\n\n'), ("a", 2, delta % " and on"), ("b", 0, delta % "kept")]
    fields = fr.frame_fields(fr.frames(spark.createDataFrame(rows, "conn string, seq bigint, text string")))
    text = {r.conn: r.body for r in fr.channel_text(fr.slots(fields), ["conn", "channel"], ["frame_no", "slot_no"], resets=fr.snapshots(fields)).collect()}
    assert text == {"a": "final text and on", "b": "kept"}


@pytest.mark.parametrize("block, whole", [(1, 0), (4, 40), (256, 300)])
def test_long_replies_go_by_blocks_and_short_ones_whole(spark, block, whole):
    rng = random.Random(block)
    texts = replies(rng)
    rows = [(c, i * 3, p) for c, t in texts.items() for i, p in enumerate(cuts(rng, t))]
    want = [(c, i, raw) for c, t in texts.items() for one in [Frames(1 << 40)] for i, (raw, _) in enumerate(one.push(t) + one.finish())]
    got = cutting.cut_frames(spark.createDataFrame(rows + [("null", 0, None)], "conn string, seq bigint, text string").repartition(7), block, whole).collect()
    assert sorted((r.conn, r.frame_no, r.raw) for r in got) == sorted(want)


@pytest.mark.parametrize("whole", [0, cutting.WHOLE])
def test_a_frame_without_an_end_is_read_once(spark, whole):
    """Took time with the square of its length, hours for this one."""
    got = cutting.cut_frames(spark.createDataFrame([("c", 0, "a\n\n" + "r" * 4_000_000)], "conn string, seq bigint, text string"), whole=whole).collect()
    assert sorted((r.frame_no, len(r.raw)) for r in got) == [(0, 3), (1, 4_000_000)]
