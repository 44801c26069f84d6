"""The JSON walk against Python's parser, and restored bodies against redacted ones."""

import json
import random

from pyspark.sql import functions as F

from veilspark.functions import json_text as jt
from veilspark.operators import detect, vault
from veilspark.operators.json_restore import restore_json


def frame(spark, bodies):
    return spark.createDataFrame([(i, f"s{i % 2}", i, b) for i, b in enumerate(bodies)], "msg_id int, session string, seq int, body string").withColumn("ts", F.timestamp_seconds("seq"))


def leaves(node, path="$"):
    if isinstance(node, str):
        yield path, node
    elif isinstance(node, list):
        for i, x in enumerate(node):
            yield from leaves(x, f"{path}[{i}]")
    elif isinstance(node, dict):
        for k, x in node.items():
            yield from leaves(x, f"{path}.{k}")


def any_json(rng, depth=0):
    kind = rng.randrange(8 if depth < 6 else 4)
    if kind < 2:
        return "".join(rng.choice('a"\\/[]{},:\n é日𝄞') for _ in range(rng.randrange(8)))
    if kind < 4:
        return rng.choice([1, -2.5e3, True, None, 0])
    if kind < 6:
        return [any_json(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {rng.choice(["a", "b", "a b", 'q"', "ключ", "x,", "y{"]) + str(i): any_json(rng, depth + 1) for i in range(rng.randrange(5))}


def test_walk_agrees_with_a_parser(spark):
    rng = random.Random(4)
    trees = [any_json(rng) for _ in range(300)]
    bodies = [json.dumps(t, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]), separators=rng.choice([None, (" , ", " :  ")])) for t in trees]
    bodies += ["", "not json", '{"a":', None, '"alone"', "[]", "{}", "[[],{},[[]]]", '[1,2,"x",[3,"y"],"z"]']
    want = [(i, p, v) for i, b in enumerate(bodies) for p, v in leaves(_loads(b))]
    got = jt.json_string_leaves(frame(spark, bodies), ["msg_id"]).collect()
    assert sorted((r.msg_id, r.path, r.value) for r in got) == sorted(want)
    odd = {r.msg_id: r.form for r in jt.json_problems(frame(spark, bodies), ["msg_id"]).collect()}
    assert odd == {300: "text", 301: "text", 302: "text", 303: "none"}


def _loads(body):
    try:
        return json.loads(body)
    except (TypeError, ValueError):
        return None


def nested(depth, leaf):
    return '{"d":[' * depth + json.dumps(leaf) + "]}" * depth


def test_restore_inverts_redact(spark):
    mail, phone = "mail ann@example.org now", "call 13800138000"
    bodies = [
        json.dumps({"a": mail, "list": [1, phone, {"k": [phone + "; " + mail]}], "ann@example.org": 7, "plain": "x \"q\" \\ y"}),
        nested(30, phone), nested(450, phone), nested(1500, mail), "text " + phone, '{"broken": "' + phone, None, "", '{"n": [1, 2', json.dumps(phone),
    ]
    df = frame(spark, bodies)
    found = jt.redact_json(df, detect.scan, lambda h: vault.placeholder(h["tag"], vault.suffix_of("salt", F.lit("s"), h["original"])))
    book = found.select(F.explode("hits").alias("h")).select(F.lit("s").alias("session"), F.col("h.original").alias("original"), F.col("h.tag").alias("tag")).distinct()
    book = book.withColumn("suffix", vault.suffix_of("salt", F.col("session"), F.col("original"))).withColumn("placeholder", vault.placeholder(F.col("tag"), F.col("suffix")))
    sent = found.select("msg_id", F.lit("s").alias("session"), F.col("body").alias("before"), F.col("redacted").alias("body"))
    got = {r.msg_id: r for r in restore_json(sent, book, ["msg_id"]).collect()}
    for i, b in enumerate(bodies):
        assert got[i].restored_body == b
    assert not any("13800138000" in got[i].body for i in (1, 2)) and "ann@" not in got[3].body and got[2].restored == 1
    assert [got[i].form for i in (0, 1, 2)] == ["json"] * 3
    assert [got[i].form for i in (3, 4, 5, 6, 7)] == ["deep", "text", "text", "none", "text"]


def test_values_inside_json_text_are_escaped_once_more(spark):
    book = spark.createDataFrame([("s", 'a "b" \\c', "NAME", "[[PII:NAME:0123abcd]]", "0123abcd")], "session string, original string, tag string, placeholder string, suffix string")
    args = json.dumps({"who": "[[PII:NAME:0123abcd]]"})
    body = json.dumps({"arguments": args, "list": {"partial_json": ["x", args]}, "text": "[[PII:NAME:0123ABCD]] and [[PII:NAME:99999999]]", "[[PII:NAME:0123abcd]]": 1})
    df = spark.createDataFrame([(1, "s", body)], "msg_id int, session string, body string")
    (r,) = restore_json(df, book, ["msg_id"]).collect()
    back = json.loads(r.restored_body)
    assert json.loads(back["arguments"]) == {"who": 'a "b" \\c'} and json.loads(back["list"]["partial_json"][1]) == {"who": 'a "b" \\c'}
    assert back["text"] == 'a "b" \\c and [[PII:NAME:99999999]]' and "[[PII:NAME:0123abcd]]" in back
    assert (r.restored, r.unresolved, r.degraded) == (3, 1, 1)


def test_bodies_are_walked_once(spark):
    """The restore reads its rows several times: the walk over the bodies must not be part of what it reads."""
    vault = spark.createDataFrame([("s", "[[PII:NAME:0a1b2c3d]]", "0a1b2c3d", 'o"ne')], "session string, placeholder string, suffix string, original string")
    body = '{"a":[{"b" : ["x","\\ud800 [[PII:NAME:0a1b2c3d]]"]}, 1.50]}'
    out = restore_json(spark.createDataFrame([(1, "s", body)], "msg_id bigint, session string, body string"), vault, ["msg_id"])
    assert "__nodes" not in out._jdf.queryExecution().toString()
    assert [r.restored_body for r in out.collect()] == ['{"a":[{"b" : ["x","? o\\"ne"]}, 1.50]}']


def test_a_body_is_masked_once(spark):
    from pyspark.sql import functions as F

    from veilspark.functions import json_text as jt

    rows = spark.createDataFrame([('{"a":"x","b":"y \\"z\\" "}',)], "body string").select(F.size(jt._value_tokens(F.col("body"))).alias("n"))
    assert rows.first().n == 2
    assert rows._jdf.queryExecution().analyzed().toString().count("replace(replace(") == 1
