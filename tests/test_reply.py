"""The reply path on small wire texts."""

import json

from pyspark.sql import functions as F

from veilspark.operators import reply
from veilspark.operators import signals as sg
from veilspark.operators.frames import frame_fields, frames

VAULT = "session string, original string, tag string, placeholder string, suffix string"


def event(**body):
    return "data: " + json.dumps(body, ensure_ascii=False) + "\n\n"


def context(spark, chunks, session="s"):
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(chunks)], "conn string, seq bigint, text string")
    book = spark.createDataFrame([("s", 'Ann "A"', "NAME", "[[PII:NAME:0123abcd]]", "0123abcd")], VAULT)
    return reply.reply_context(frame_fields(frames(df)), spark.createDataFrame([("c", session)], "conn string, session string"), book).first()


def delta(text, at=0):
    return event(choices=[{"delta": {}}] * at + [{"index": at, "delta": {"content": text}}])


def test_placeholders_span_pushes_of_their_channel(spark):
    r = context(spark, [event(model="m1", type="message_start", usage={"note": "secret note"}), delta("Hi [[PII:NA"), delta("other", 1), delta("ME:0123abcd]], bye"), "data: [DO", "NE]\n\n"])
    assert r.body == 'Hi otherAnn "A", bye[DONE]' and (r.restored, r.unresolved, r.response_model, r.events) == (1, 0, "m1", 4)


def test_json_text_is_escaped_and_leaves_are_restored(spark):
    call = event(choices=[{"index": 0, "delta": {"tool_calls": [{"index": 0, "function": {"arguments": '{"n":"[[PII:NAME:0123abcd]]"}'}}]}}])
    r = context(spark, [call, event(kind="x", body={"title": "to [[PII:NAME:0123abcd]]", "id": "id", "usage": {"deep": ["no"]}})])
    assert r.body == '{"n":"Ann \\"A\\""}xto Ann "A"' and r.restored == 2


def test_what_is_no_json_and_what_is_no_event_stay(spark):
    r = context(spark, ["data: {broken [[PII:NAME:0123abcd]]\n\n", ": comment\n\n", "just text [[PII:NAME:0123abcd]]\n\n", "data: [1,2]\n\n", "event: ping\n\n"])
    assert r.body == '{broken Ann "A"just text Ann "A"\n\n' and r.response_model is None and r.events == 0


def test_a_long_reply_is_kept_whole(spark):
    r = context(spark, [delta("x" * 50_000) for _ in range(8)] + [event(type="response.output_text.done", text="y" * 300_000)])
    assert r.body == "y" * 300_000
    assert context(spark, []).body == ""


def test_a_marker_matters_only_for_its_time(spark):
    ts = lambda x: F.timestamp_seconds(F.lit(x))
    said = spark.createDataFrame([(i, t, "see MARK_1_0123abcd and zebra-7", own) for i, (t, own) in enumerate([(4000, []), (4000, ["MARK_1_0123abcd"]), (100, []), (9000, []), (7199, [])])],
                                 "resp_id int, at bigint, body string, own_markers array<string>").withColumn("ts", F.timestamp_seconds("at"))
    reg = spark.range(600).select(F.lit("MARK_1_0123abcd").alias("nonce"), F.timestamp_seconds(F.col("id") * 5 + 700).alias("ts"))
    assert sorted(r.resp_id for r in sg.sig_cross_request(said, reg, ["resp_id"]).collect()) == [0, 4]
    other = spark.range(501).select(F.concat(F.lit("name-"), "id").alias("nonce"), ts(0).alias("ts")).unionByName(spark.range(1).select(F.lit(" zebra-7 ").alias("nonce"), ts(3600).alias("ts")))
    assert sorted(r.resp_id for r in sg.sig_cross_request_any(said, other, ["resp_id"]).collect()) == [0, 1, 4]


def test_context_without_restore(spark):
    from veilspark.operators.frames import response_context

    chunks = [delta("a" * 200_000), delta("b" * 200_000), event(kind="k", usage={"note": "not content"}, body="end")]
    fields = frame_fields(frames(spark.createDataFrame([("c", i, t) for i, t in enumerate(chunks)], "conn string, seq bigint, text string")))
    r = response_context(fields).first()
    assert r.restored_text == "a" * 200_000 + "b" * 200_000 + "kend" and not r.truncated
    cut = response_context(fields, 256 * 1024).first()
    assert cut.truncated and cut.restored_text == "a" * 200_000 + "kend"


def test_nested_tool_results(spark):
    from veilspark.functions.json_text import tool_result_texts

    content = [{"type": "text", "text": "deepest"}]
    for _ in range(6):
        content = [{"type": "tool_result", "content": content}]
    body = json.dumps({"messages": [{"role": "tool", "content": content}]})
    df = spark.createDataFrame([(1, body)], "msg_id int, body string")
    assert [r.text for r in tool_result_texts(df, ["msg_id"]).collect()] == ["deepest"]
