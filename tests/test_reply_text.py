"""Replies read in one go against the way that asks Spark's parser for every event."""

import json
import random

from pyspark.sql import functions as F

from veilspark.functions import reply_text
from veilspark.operators import reply
from veilspark.operators import signals as sg
from veilspark.operators.frames import frame_fields, frames

BOOK = [("s", 'Ann "A"', "[[PII:NAME:0123abcd]]", "0123abcd"), ("s", "B1", "[[PII:NAME:aaaa0000]]", "aaaa0000"), ("s", "B2", "[[PII:NAME:aaaa0000]]", "aaaa0000"), ("s", "12345678", "[[PII:X:bbbb0000]]", "bbbb0000"),
        ("s", "see PII:NAME:0123abcd", "[[PII:X:cccc0000]]", "cccc0000"), ("s", None, "[[PII:X:eeee0000]]", "eeee0000"), ("t", "other", "[[PII:NAME:dddd0000]]", "dddd0000"), ("s", "own", "[[PII:MAIL:dddd0000]]", "dddd0000")]
CHUNK = "conn string, seq bigint, text string"


def event(**body):
    return "data: " + json.dumps(body, ensure_ascii=False) + "\n\n"


def said(text, at=0):
    return event(choices=[{"delta": {}}] * at + [{"index": at, "delta": {"content": text}}])


TOKENS = ["[[PII:NAME:0123abcd]]", "[[PII:name:0123ABCD]]", r"\[\[PII:NAME:0123abcd\]\]", " PII:NAME:aaaa0000 ", "[[PII:NAME:aaaa0000]]", "[[PII:PERSON:aaaa0000]]", "PII:X:[[PII:X:bbbb0000]]", "[[PII:X:cccc0000]]",
          "[[PII:X:eeee0000]]", "[[PII:NAME:dddd0000]]", "xPII:NAME:0123abcdy", "[PII:NAME:0123abcd]", "[[PII:NAME:99999999]]", "[[PI", "I:NA", "ME:0123abcd]]", "[", "\\", "é😀", "\n", "tokens", " "]
EVENTS = [
    event(model="m1", type="message_start", usage={"note": "secret"}), event(model=" ", message={"model": "no"}), event(message={"model": "m2"}), event(type="content_block_delta", index=1, delta={"text": "t[[PI", "partial_json": "p"}),
    event(type="content_block_start", content_block={"text": "I:NAME:0123abcd]]"}), event(type="response.output_text.done", text="whole [[PII:NAME:0123abcd]]"), event(type="response.output_text.delta", delta="d"), event(kind="k", body={"id": "i", "t": "leaf [[PII:NAME:0123abcd]]", "n": [1, 2.5, None]}),
    event(choices=[{"index": 0, "delta": {"tool_calls": [{"index": 0, "function": {"arguments": '{"n":"[[PII:NAME:0123abcd]]"}'}}]}}]), event(candidates=[{"content": {"parts": [{"text": "g"}]}}]), event(usage={"input_tokens": 3, "output_tokens": 7}),
    event(usage={"input_tokens": 4, "output_tokens": 5}), event(type="odd_kind"), event(signature_delta=" "), event(type=["x"], text="y"), event(choices=None), "event: strange\ndata: {\"w\":1}\n\n", "event: a\nevent: b\ndata: [1,2]\n\n",
    "data: [DONE]\n\n", "data: rest of it\n\n", "data: this\n\n", "data: true\n\n", "data: true story\n\n", "data: 12abc\n\n", "data: 12\n\n", "data: \"s\"\n\n", "data: {broken [[PII:NAME:0123abcd]]\n\n", "data: {\"type\":\"a\",\"type\":\"b\",\"text\":\"twice\"}\n\n", "data: {\"text\":NaN,\"type\":\"a\"}\n\n",
    "data: {\"type\":\"a\",\"text\":\"\\ud800 half\"}\n\n", "data: {\"type\":\"a\",\"text\":\"after\"} rest\n\n", "data: {\"type\":\"a\",\"text\":\"x\",\"n\":1e999}\n\n", "data: {\"type\":\"a\",\"text\":\"x\",\"n\":" + "9" * 70 + "}\n\n", "data: [ [1]\n\n", "data: [x]\n\n", "data:\n\n", "data:  \n\n", ": comment\n\n",
    "just text [[PII:NAME:0123abcd]]\n\n", "event: ping\n\n", "\n\n", "data: {\"choices\":\ndata: [{\"text\":\"two lines\"}]}\n\n", "data: {\"type\":\"a\",\"text\":\"cr\"}\r\n\r\n", "event: e\r\ndata:  {\"type\":\"a\",\"text\":\"blank\"}\r\n\n", "data: {\"m\\u006fdel\":\"m3\",\"t\":\"v\"}\n\n",
    "data: 你好\n\n", "data: '1'\n\n", "data: .5\n\n", "data: -\n\n", "data: nul\n\n", "data: NaN\n\n", "data: {}\n\n", "data: {\"a\":{\"b\":" + "[" * 250 + "]" * 250 + "}}\n\n", "data: \ufeff{}\n\n",
]


def book(spark):
    return spark.createDataFrame(BOOK, "session string, original string, placeholder string, suffix string")


def wires(rng):
    yield from ((f"e{i}", e) for i, e in enumerate(EVENTS))
    yield "usage", EVENTS[10] + EVENTS[11]
    for i in range(150):
        yield f"r{i}", "".join(rng.choice(EVENTS) if rng.random() < 0.3 else said("".join(rng.choice(TOKENS) for _ in range(rng.randint(1, 3))), rng.randint(0, 1)) for _ in range(rng.randint(0, 9))) + rng.choice(["", "data: cut", "\n"])


def rows_of(wires, rng):
    out = []
    for conn, text in wires:
        at = seq = 0
        while at < len(text):
            n = rng.choice([1, 7, 40, 400])
            out.append((conn, seq * 2, text[at : at + n]))
            at, seq = at + n, seq + 1
    rng.shuffle(out)
    return out


def told(spark, chunks, sessions):
    return sorted(tuple(r) for r in sg.sig_stream(reply._contexts(chunks, sessions, book(spark), 1 << 20, True)[1], ["conn"]).collect())


def test_same_rows_as_with_sparks_parser(spark):
    rng = random.Random(5)
    texts = list(wires(rng))
    chunks = spark.createDataFrame([*rows_of(texts, rng), ("null", 0, None), (None, 0, said("x")), ("nobody", 0, said("x"))], CHUNK).repartition(5).cache()
    sessions = spark.createDataFrame([(c, "t" if i % 11 == 3 else "s") for i, (c, _) in enumerate(texts)] + [("null", "s"), ("silent", None)], "conn string, session string").cache()
    fields = frame_fields(frames(chunks)).cache()
    order = ["conn", "session", "body", "response_model", "events", *reply.STAT_NAMES]
    want = {r.conn: tuple(r) for r in reply.reply_context(fields, sessions, book(spark)).select(*order).collect()}
    for whole in (1 << 20, 200):
        got = {r.conn: tuple(r) for r in reply.reply_contexts(chunks, sessions, book(spark), whole).select(*order).collect()}
        assert {c: (dict(texts).get(c), got.get(c), want[c]) for c in want if got.get(c) != want[c]} == {} and len(got) == len(want)
    events = fields.where("data IS NOT NULL").select("conn", F.col("frame_no").alias("seq"), F.coalesce("event_type", F.lit("")).alias("event_type"), "data")
    signals = sorted(tuple(r) for r in sg.sig_stream(events, ["conn"]).collect())
    assert told(spark, chunks, sessions) == signals and len({s[4] for s in signals}) == 4


def test_chunks_are_read_once(spark):
    """Frames and fields were worked out for the texts, the snapshots and the facts anew."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    wire = [("c%d" % i, j, t) for i in range(50) for j, t in enumerate([said("Hi [[PII:NA"), said("ME:0123abcd]]"), "data: rest\n\ndata: [DONE]\n\n"])]
    chunks = spark.createDataFrame(wire, CHUNK).mapInPandas(seen, CHUNK)
    sessions = spark.createDataFrame([("c%d" % i, "s") for i in range(50)], "conn string, session string")
    got = reply.reply_contexts(chunks, sessions, book(spark)).collect()
    assert {r.body for r in got} == {'Hi Ann "A"rest[DONE]'} and len(got) == 50 and read.value == 150


def test_common_events_need_no_other_parser():
    parser = reply_text.reader()
    text = EVENTS[0] + said("Hi [[PII:NAME:0123abcd]]") + said("x") * 300 + "data: rest of it\n\ndata: [DONE]\n\n"
    parts, asks, escapes, suffixes, model, events, told = reply_text.read_reply(text, parser)
    assert (parts, asks, escapes, suffixes, model, events, told[:1]) == (
        ["Hi [[PII:NAME:0123abcd]]", "x" * 300 + "rest of it[DONE]"], [0], [False], ["0123abcd"], "m1", 302, [{"seq": 302, "event_type": "", "data": "rest of it"}])


def test_requests_are_read_for_all_signals_at_once(spark):
    """Each signal joined requests and contexts anew, and by its bytes the result was searched by one task."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    shape = "conn string, session string, status int, headers string, req_text string, req_model string, req_body string, expected string, at long"
    tool = '{"messages":[{"role":"t\\u006fol","content":"rm -rf / now"}]}'
    rows = [("c%d" % i, "s", 401 if i % 2 else 200, "", "", "gpt-4o", tool if i == 4 else "{}", "", i) for i in range(30)]
    asked = spark.createDataFrame(rows, shape).mapInPandas(seen, shape).withColumn("ts", F.timestamp_seconds("at")).drop("at").withColumn("own_markers", F.array().cast("array<string>"))
    chunks = spark.createDataFrame([("c%d" % i, 0, said("key sk-abcdefghijklmnopqrst0123 and rm -rf / now")) for i in range(30)], CHUNK)
    found = reply.reply_audit(chunks, asked, book(spark), None, switches={"cross_request_pollution": True, "tool_call_rewrite": True})[1]
    kinds = {}
    for r in found.collect():
        kinds[r.signal] = kinds.get(r.signal, 0) + 1
    assert kinds["error_leak"] == 15 and kinds["dangerous_action"] == 15 and kinds["tool_call_injection"] == 1 and read.value <= 90


def test_tool_results_of_all_shapes_are_found(spark):
    """Bodies are parsed only for the shapes that they may have; letters may hide behind a backslash."""
    from veilspark.functions.json_text import tool_result_texts

    bodies = ['{"messages":[{"role":"tool","content":"a"},{"role":"function","content":"b"}]}', '{"messages":[{"role":"user","content":[{"type":"tool_result","content":"c"}]}]}',
              '{"contents":[{"role":"user","parts":[{"functionResponse":{"name":"n","response":{"x":1}}}]}]}', '{"messages":[{"role":"t\\u006fol","content":"d"},{"role":"user","content":[{"type":"tool\\u005fresult","content":"e"}]}]}',
              '{"contents":[{"role":"user","parts":[{"function\\u0052esponse":{"response":2}}]}]}', '{"messages":[{"role":"user","content":"x"}]}', "no", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "msg_id int, body string")
    assert sorted((r.msg_id, r.text) for r in tool_result_texts(df, ["msg_id"]).collect()) == [(0, "a"), (0, "b"), (1, "c"), (2, '{"x":1}'), (3, "d"), (3, "e"), (4, "2")]
