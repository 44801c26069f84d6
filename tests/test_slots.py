"""Text places of reply events."""

import json

from veilspark.operators.frames import event_text, slots


def fields(spark, *events):
    return spark.createDataFrame([("c", i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)], "conn string, frame_no bigint, data string")


def found(df):
    return [(r.frame_no, r.slot_no, r.path, r.channel, r.text, r.escape) for r in df.orderBy("frame_no", "slot_no").collect()]


def test_places_in_their_order(spark):
    call = lambda at: {"index": at, "function": {"arguments": "{}"}}
    choice = {"text": "a", "delta": {"content": "b", "reasoning": "c", "tool_calls": [call(7), call("3"), call(2.0), call(None), 5]}, "message": {"content": "d", "reasoning_content": 1, "tool_calls": "no"}}
    got = found(slots(fields(spark, {"choices": [3, choice]})))
    at = "choices[1]."
    assert [(p, c, t, e) for _, _, p, c, t, e in got] == [
        (at + "text", "text:1", "a", False), (at + "delta.content", "content:1", "b", False), (at + "delta.reasoning", "reason:1", "c", False),
        *[(f"{at}delta.tool_calls[{j}].function.arguments", f"args:{n}", "{}", True) for j, n in enumerate([7, 3, 2, 3])], (at + "message.content", "content:1", "d", False)]
    assert [n for _, n, *_ in got] == list(range(8))


def test_other_shapes(spark):
    got = found(slots(fields(
        spark, {"type": "content_block_delta", "index": 2, "delta": {"text": "t", "partial_json": "p", "thinking": "k"}}, {"type": "content_block_start", "content_block": {"text": "s"}},
        {"type": "response.function_call_arguments.delta", "delta": "f"}, {"type": None, "text": "x"}, {"text": "no type"}, {"candidates": [{"content": {"parts": [{"text": "g"}, {}]}}]},
        "[1]", '{"type":"a","type":"b","text":"twice"}', '{"text":NaN,"type":"a"}', ' {"type":"a","text":"\\ud800 half"}', "{broken")))
    assert [(n, c, t, e) for n, _, _, c, t, e in got] == [
        (0, "content:2", "t", False), (0, "args:2", "p", True), (0, "think:2", "k", False), (1, "content:0", "s", False), (2, "args:0", "f", True), (3, "content:0", "x", False),
        (5, "gtext:0:0", "g", False), (9, "content:0", "? half", False)]


def test_content_of_unknown_events(spark):
    got = event_text(fields(spark, {"kind": "k", "usage": {"note": "n"}, "body": {"id": "i", "arguments": "a"}}, {"choices": [{"text": "known"}], "more": "m"}, "[\"no\"]"))
    assert [(r.frame_no, r.text) for r in got.orderBy("frame_no", "slot_no").collect()] == [(0, "k"), (0, "a"), (1, "known")]


def test_events_are_read_in_one_pass_on_arrow_batches(spark):
    plan = slots(fields(spark, "{}"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "schema_of_variant" not in plan


def test_a_snapshot_kind_is_found_also_in_escaped_letters(spark):
    from veilspark.operators.frames import reply_facts, snapshots

    df = fields(spark, '{"type":"response.output_text.\\u0064one","text":"w"}', '{"type":"response.output_text.delta","delta":"d","m\\u006fdel":"m1"}', '{"model":" "}', "[]")
    assert [tuple(r) for r in snapshots(df).collect()] == [("c", "content:0", 0)]
    assert [tuple(r) for r in reply_facts(df).collect()] == [("c", "m1", 3)]
