"""The restoring stream: its state is folded once a batch and by columns."""

import random

from pyspark.sql import functions as F

from veilspark.functions.holdback import Tail
from veilspark.streaming import jobs

PIECE = "session string, channel int, seq long, text string, final boolean"


def test_a_batch_is_folded_once_and_as_one_tail_would(spark, tmp_path):
    """The restore read its rows several times, and each time the state of all keys was folded anew."""
    rng = random.Random(3)
    atoms = ["a ", "[[PII:", "NAME:", "0123abcd]]", "[", "\\", "PII:NAME:0123abcd", " end", None, ""]
    rows = [("s", c, i, rng.choice(atoms), rng.random() < 0.1 or i == 79) for c in range(5) for i in range(80)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    path = str(tmp_path / "in")
    for at in (0, 40):
        spark.createDataFrame([r for r in rows if at <= r[2] < at + 40], PIECE).coalesce(1).write.mode("append").parquet(path)
    files = spark.readStream.schema(PIECE).option("maxFilesPerTrigger", 1).parquet(path).mapInPandas(seen, PIECE)
    book = spark.createDataFrame([("s", "Ann", "[[PII:NAME:0123abcd]]", "0123abcd")], "session string, original string, placeholder string, suffix string")
    jobs.stream_restore(files, book, ["session", "channel"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert read.value == len(rows)
    want = set()
    for c in range(5):
        tail = Tail()
        for n, (_, _, _, text, final) in enumerate(r for r in rows if r[1] == c):
            out = tail.push(text or "") + (tail.finish() if final else "")
            if out:
                want.add((c, n, len(out)))
    got = done.select("channel", "piece", F.length("restored_text").alias("n"), "restored").collect()
    assert {(r.channel, r.piece) for r in got} == {w[:2] for w in want} and len(got) == len(want) and sum(r.restored for r in got) > 0
    assert {(r.channel, r.piece, r.n) for r in got if not r.restored} <= want
