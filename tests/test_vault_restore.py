import random

from pyspark.sql import functions as F

from veilspark.functions import json_text as jt
from veilspark.functions.holdback import Cooldown, Frames, Tail, Utf8
from veilspark.operators import detect as dt
from veilspark.operators import frames as fr
from veilspark.operators import restore as rs
from veilspark.operators import vault as vt

HITS = "session string, seq long, msg_id long, start int, tag string, original string, ts timestamp"


def hit_rows(spark, rows):
    return spark.createDataFrame([(s, q, q, 0, t, o, None) for s, q, t, o in rows], HITS)


def test_mint_first_tag_wins_and_sessions_differ(spark):
    rows = hit_rows(spark, [("a", 2, "B", "x"), ("a", 1, "A", "x"), ("b", 1, "A", "x")])
    got = {(r.session, r.original): r for r in vt.vault_mint(rows, "k").collect()}
    assert got[("a", "x")].tag == "A" and got[("a", "x")].remapped
    assert got[("a", "x")].suffix != got[("b", "x")].suffix
    assert not got[("b", "x")].remapped


def test_mint_collisions_get_other_slices(spark):
    rows = hit_rows(spark, [("a", i, "T", f"v{i}") for i in range(120)])
    got = vt.vault_mint(rows, "k", width=2).collect()
    assert len(got) == 120 and len({r.placeholder for r in got}) == 120
    assert any(r.remapped for r in got)


def test_mint_missing_keeps_known_pairs(spark):
    first = vt.vault_mint(hit_rows(spark, [("a", 1, "T", "x")]), "k")
    more = vt.mint_missing(hit_rows(spark, [("a", 2, "U", "x"), ("a", 3, "T", "y")]), first, "k")
    assert [r.original for r in more.collect()] == ["y"]


def test_round_trip_both_lookup_ways(spark):
    texts = ["mail a@b.com and a@b.com", "call 13800138000 now", "card 4242424242424242 a@b.com", "none"]
    df = spark.createDataFrame(
        [(i, f"s{i % 2}", i, None, t) for i, t in enumerate(texts)], "msg_id long, session string, seq long, ts timestamp, body string"
    )
    scanned = dt.with_hits(df)
    out, vault = vt.redact_sessions(scanned, "k")
    joined = vt.redact_with_vault(scanned, vault, "k")
    a = {r.msg_id: r.redacted for r in out.collect()}
    assert a == {r.msg_id: r.redacted for r in joined.collect()}
    assert not any("@" in t or "138" in t for t in a.values())
    back = rs.restore(out.select("msg_id", "session", F.col("redacted").alias("body")), vault, ["msg_id"])
    assert [r.restored_text for r in back.orderBy("msg_id").collect()] == texts


def test_no_original_stays_in_clear(spark):
    """Pairs that the vault lacks, one message id in two sessions, and a pair that the vault knows under another tag."""
    texts = [(1, "s0", "mail a@b.com"), (1, "s1", "call 13800138000 now"), (2, "s0", "mail c@d.org and a@b.com"), (None, "s0", "a@b.com")]
    df = spark.createDataFrame([(i, s, 0, None, t) for i, s, t in texts], "msg_id long, session string, seq long, ts timestamp, body string")
    known = spark.createDataFrame([("s0", "a@b.com", "[[PII:OLD:0123abcd]]", False)], "session string, original string, placeholder string, remapped boolean")
    got = {r.body: r.redacted for r in vt.redact_with_vault(dt.with_hits(df), known, "k").collect()}
    assert len(got) == 4 and not any("@" in t or "138" in t for t in got.values())
    assert got["mail a@b.com"] == "mail [[PII:OLD:0123abcd]]" and got["a@b.com"] == "[[PII:OLD:0123abcd]]"
    assert got["mail c@d.org and a@b.com"].endswith("[[PII:OLD:0123abcd]]") and got["call 13800138000 now"].startswith("call [[PII:PHONE:")


def vault_of(spark, rows):
    df = spark.createDataFrame(rows, "session string, original string, placeholder string")
    return df.withColumn("suffix", vt.placeholder_suffix(F.col("placeholder")))


def restored(spark, texts, vault, **kw):
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "msg_id int, session string, body string")
    return [
        (r.restored_text, r.restored, r.unresolved, r.degraded)
        for r in rs.restore(df, vault, ["msg_id"], **kw).orderBy("msg_id").collect()
    ]


def test_restore_forms(spark):
    v = vault_of(spark, [("s", "138", "[[PII:PHONE:8f3a2b1c]]"), ("t", "zz", "[[PII:NAME:11111111]]"),
                         ("s", "p", "[[PII:A:22222222]]"), ("t", "q", "[[PII:B:22222222]]")])
    texts = [
        "x [[PII:PHONE:8f3a2b1c]] y [[PII:PHONE:8f3a2b1c]]", "[[PII:phone:8F3A2B1C]]", r"\[\[PII:PHONE:8f3a2b1c\]\]",
        "bare PII:PHONE:8f3a2b1c.", "xPII:PHONE:8f3a2b1c", "[[PII:TEL:8f3a2b1c]]", "[[PII:NAME:11111111]]", "[[PII:C:22222222]]", "plain",
    ]
    assert restored(spark, texts, v) == [
        ("x 138 y 138", 2, 0, 0), ("138", 1, 0, 1), ("138", 1, 0, 1), ("bare 138.", 1, 0, 1), ("xPII:PHONE:8f3a2b1c", 0, 0, 0),
        ("138", 1, 0, 1), ("[[PII:NAME:11111111]]", 0, 1, 0), ("[[PII:C:22222222]]", 0, 1, 0), ("plain", 0, 0, 0),
    ]


def test_restore_escapes_inside_json(spark):
    v = vault_of(spark, [("s", 'a"b\n\\', "[[PII:X:8f3a2b1c]]")])
    df = spark.createDataFrame([(1, "s", "[[PII:X:8f3a2b1c]]", True), (2, "s", "[[PII:X:8f3a2b1c]]", False)], "msg_id int, session string, body string, esc boolean")
    got = {r.msg_id: r.restored_text for r in rs.restore(df, v, ["msg_id"], escape="esc").collect()}
    assert got == {1: 'a\\"b\\n\\\\', 2: 'a"b\n\\'}


def test_placeholder_parts(spark):
    df = spark.createDataFrame([("[[PII:PHONE:8f3a2b1c]]",), ("[[PII:BANKCARD:AB12CD34]]",), ("[[PII:PHONE:zzzzzzzz]]",)], "p string")
    assert [r[0] for r in df.select(vt.placeholder_suffix(F.col("p"))).collect()] == ["8f3a2b1c", "ab12cd34", None]


def test_chunk_cut_invariance(spark):
    """Any cut of a reply restores to the same text."""
    v = vault_of(spark, [("s", "V1", "[[PII:PHONE:8f3a2b1c]]")])
    text = r"a [[PII:PHONE:8f3a2b1c]], \[\[PII:PHONE:8f3a2b1c\]\] and [[PII:XX:00000000]] [x] end [[PII:PHONE:8f3a2b1c"
    rnd, rows = random.Random(7), []
    for conn in range(60):
        at, seq = 0, 0
        while at < len(text):
            n = rnd.randint(1, 12)
            rows.append(("s", conn, seq, text[at : at + n]))
            at, seq = at + n, seq + 1
    pieces = spark.createDataFrame(rows, "session string, conn int, seq int, text string")
    done = fr.restore_pieces(pieces, v, ["session", "conn"], ["seq"])
    out = fr.channel_text(done.withColumn("t", F.col("restored_text")), ["conn"], ["piece"], "t").collect()
    want = restored(spark, [text], v)[0][0]
    assert len(out) == 60 and {r.body for r in out} == {want}


def test_small_machines():
    t = Tail()
    assert [t.push("a [[PII:PH"), t.push("ONE:8f3a"), t.push("2b1c]] b")] == ["a ", "", "[[PII:PHONE:8f3a2b1c]] b"]
    assert Tail().push("a" * (2**20 + 1)) == "a" * (2**20 + 1)
    f = Frames(1024)
    assert f.push("data: a\n\ndata: b\r\n\r\nda") == [("data: a\n\n", False), ("data: b\r\n\r\n", False)]
    assert f.push("x" * 2000)[0][1] and f.finish() == []
    u, data = Utf8(), "中😀é".encode()
    assert "".join(u.push(data[i : i + 1]) for i in range(len(data))) + u.finish() == "中😀é"
    assert Utf8().push(b"a\xffb") == "ab"
    c = Cooldown(600)
    assert [c.use(t) for t in (0, 10, 20, 600)] == [[(1, 0, 0)], [], [], [(3, 0, 600)]]
    c = Cooldown(600)
    assert c.use(5, 3) == [(1, 5, 5)] and c.use(605) == [(3, 5, 605)]


def test_json_redaction_keeps_structure(spark):
    body = r'{"13800138000":"k", "a":["call 13800138000","q\"x@y.com\\",{"b":"plain"}], "n":13800138000, "e":"1 13900139000"}'
    df = spark.createDataFrame([(1, body), (2, "not json 13800138000")], "id int, body string")
    rows = {r.id: r for r in jt.redact_json(df, dt.scan, lambda h: F.concat(F.lit("<"), h["tag"], F.lit(">"))).collect()}
    assert rows[1].redacted == r'{"13800138000":"k", "a":["call <PHONE>","q\"<EMAIL>\\",{"b":"plain"}], "n":13800138000, "e":"1 <PHONE>"}'
    assert len(rows[1].hits) == 3
    assert rows[2].redacted == "not json 13800138000" and rows[2].hits == []


def test_partition_count_does_not_matter(spark):
    df = spark.createDataFrame(
        [(i, f"s{i % 3}", i, None, f"mail u{i % 7}@x.com card 4242424242424242") for i in range(60)],
        "msg_id long, session string, seq long, ts timestamp, body string",
    )
    got = []
    for n in (1, 7):
        out, _ = vt.redact_sessions(dt.with_hits(df.repartition(n)), "k")
        got.append(sorted((r.msg_id, r.redacted) for r in out.collect()))
    assert got[0] == got[1]


def test_a_caller_resolves_what_the_vault_lacks(spark):
    book = spark.createDataFrame([("s", "Ann", "NAME", "[[PII:NAME:0123abcd]]", "0123abcd")], "session string, original string, tag string, placeholder string, suffix string")
    df = spark.createDataFrame([(1, "s", "[[PII:NAME:0123abcd]] [[PII:MAIL:ffff0000]] (PII:mail:FFFF0000) [[PII:NAME:99999999]]"), (2, "t", "[[PII:MAIL:ffff0000]]")], "msg_id int, session string, body string")
    ask = lambda session, ph: F.when((session == "s") & F.startswith(ph, F.lit("[[PII:MAIL:")), F.concat(F.lit("<"), ph, F.lit(">")))
    got = {r.msg_id: (r.restored_text, r.restored, r.unresolved, r.degraded) for r in rs.restore(df, book, ["msg_id"], resolver=ask).collect()}
    assert got[2] == ("[[PII:MAIL:ffff0000]]", 0, 1, 0)
    assert got[1][0].startswith("Ann <[[PII:MAIL:ffff0000]]> (<[[PII:MAIL:ffff0000]]>)") and got[1][1:3] == (3, 1)
    more = spark.createDataFrame([("s", "[[PII:MAIL:ffff0000]]", "a@b.org"), ("s", "[[PII:MAIL:ffff0000]]", "z@b.org"), ("s", "[[PII:NAME:0123abcd]]", "not Ann")], "session string, placeholder string, original string")
    got = {r.msg_id: (r.restored_text, r.restored, r.unresolved) for r in rs.restore(df, book, ["msg_id"], resolver=more).collect()}
    assert got == {1: ("Ann a@b.org (a@b.org) [[PII:NAME:99999999]]", 3, 1), 2: ("[[PII:MAIL:ffff0000]]", 0, 1)}


def test_leftover_audit_counts_each_original(spark):
    """Two originals of a session under one placeholder: a renamed tag counts as often as the exact form does."""
    vault = spark.createDataFrame([("s", "[[PII:NAME:0a1b2c3d]]", "0a1b2c3d", "one"), ("s", "[[PII:NAME:0a1b2c3d]]", "0a1b2c3d", "two"), ("t", "[[PII:NAME:11111111]]", "11111111", "three")],
                                  "session string, placeholder string, suffix string, original string")
    replies = spark.createDataFrame([(1, "s", "[[PII:NAME:0a1b2c3d]]"), (2, "s", "[[PII:PERSON:0a1b2c3d]]"), (3, "s", "[[PII:NAME:99999999]]"), (4, "t", "[[PII:NAME:11111111]] [[PII:NAME:0a1b2c3d]]")],
                                    "msg_id bigint, session string, body string")
    got = rs.leftover_audit(replies, vault, ["msg_id"]).collect()
    assert sorted(tuple(r) for r in got) == [("s", 5, 3), ("t", 2, 1)]


def test_minting_reads_its_hits_once(spark):
    """The hits come from a scan of all texts, which costs by far most; it ran three times."""
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = hit_rows(spark, [("a", i, "T", f"v{i}") for i in range(120)]).mapInPandas(told, HITS)
    vault = vt.vault_mint(rows, "k", width=2)
    assert vault.count() == 120 and vault.where("remapped").count() > 0 and read.value == 120


def test_two_originals_of_one_placeholder_follow_the_sql(spark):
    """The SQL makes an edit for each original and puts the placeholder between them; it leaves the order of the two open."""
    import duckdb

    from veilspark.plans import vaulting as va

    texts = ["Dear [[PII:NAME:0a1b2c3d]], ready", "x [[PII:name:0A1B2C3D]] twice [[PII:NAME:0a1b2c3d]]", r"escaped \[\[PII:NAME:0a1b2c3d\]\] form", "bare PII:NAME:0a1b2c3d and (PII:NAME:0a1b2c3d)",
             "tag [[PII:PERSON:0a1b2c3d]] back", "one [[PII:NAME:11111111]] only", "[[PII:NAME:99999999]] stays", "none"]
    book = [("s", "A", "[[PII:NAME:0a1b2c3d]]", "0a1b2c3d"), ("s", "B", "[[PII:NAME:0a1b2c3d]]", "0a1b2c3d"), ("s", "C", "[[PII:NAME:11111111]]", "11111111")]
    con = duckdb.connect()
    con.execute("CREATE TABLE replies (msg_id BIGINT, session VARCHAR, body VARCHAR)")
    con.executemany("INSERT INTO replies VALUES (?, 's', ?)", list(enumerate(texts)))
    con.execute("CREATE TABLE book (session VARCHAR, original VARCHAR, placeholder VARCHAR, suffix VARCHAR)")
    con.executemany("INSERT INTO book VALUES (?, ?, ?, ?)", book)
    sql = va.SQL["restore_loose"].replace(f"({va.sd.REPLIES})", "(SELECT * FROM replies)").replace(f"({va.sd.VAULT})", "(SELECT * FROM book)")
    in_order = lambda t: t.replace("B[", "A[").replace("]A", "]B").replace(r"B\[", r"A\[").replace("BPII", "APII").replace("3dA", "3dB")
    want = sorted((i, in_order(t), *n) for i, t, *n in con.execute(sql).fetchall())
    got = restored(spark, texts, vault_of(spark, [(s, o, p) for s, o, p, _ in book]))
    assert [(i, *r) for i, r in enumerate(got)] == want
    assert got[0][0] == "Dear A[[PII:NAME:0a1b2c3d]]B, ready" and got[3][0] == "bare APII:NAME:0a1b2c3dB and (APII:NAME:0a1b2c3dB)"
