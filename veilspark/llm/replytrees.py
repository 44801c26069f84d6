"""Chat formatting of reply trees: paths from root to leaf by iterated self-joins, the best branches as one conversation each."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import cut

#: A turn is written ``<|role`` newline text ``</s>`` newline.
OPEN, CLOSE = "<|", "</s>\n"
#: First character, escapes and rest of every control string of this and of other common templates.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\||/?tool_call>|/?think>)"


def escaped(text: Column) -> Column:
    """``text`` without active control strings: each gets one backslash more after its first character."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    """Takes one backslash from each control string that has any."""
    return re.sub(CONTROL, lambda m: m[1] + m[2][1:] + m[3], text)


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables ``tree, node, up, gain, steps`` for 1, 2, 4, ... steps towards the root: each is the last one joined to itself.

    ``up`` is null once the root is passed; ``gain`` and ``steps`` are score and count of the rows passed.  The rounds end when every row
    is past its root, or after as many as the largest tree has binary digits: what then still goes up lies on a circle of
    replies or hangs on one.
    """
    exists = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    first = nodes.join(exists, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("_there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("gain"), F.lit(1).cast("bigint").alias("steps"))
    tables = [cut(first)]
    largest = tables[0].groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while 1 << (len(tables) - 1) < largest:
        now = tables[-1]
        far = now.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("gain").alias("_gain"), F.col("steps").alias("_steps"))
        gone = now.where("up IS NOT NULL").join(far, ["tree", "up"]).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("gain") + F.col("_gain")).alias("gain"), (F.col("steps") + F.col("_steps")).alias("steps"))
        tables.append(cut(gone.unionByName(now.where("up IS NULL"))))
        if tables[-1].where("up IS NOT NULL").isEmpty():
            break
    return tables


def best_branches(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, rank, branch_score, at, node``: all rows, from ``at`` = 1 down, of the best branches of each tree.

    ``nodes`` has ``tree, node, parent, score``, one row a node.  A branch leads from a row whose parent is not in the tree to a row
    without replies; its score is the mean of its rows' scores (null: 0).  Ties go to the longer branch, then to the smaller leaf.
    Rows on a circle of replies have no root and are on no branch.
    """
    tables = _jumps(nodes)
    inner = tables[0].where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    leaves = tables[-1].where("up IS NULL").join(inner, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), F.desc("steps"), "node")
    ranked = leaves.withColumn("branch_score", F.col("gain") / F.col("steps")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    path = ranked.select("tree", F.col("node").alias("leaf"), "rank", "branch_score", F.col("steps").alias("at"), "node")
    # Every distance from the leaf is one sum of powers of two, so each step doubles the path and no row comes twice.
    for k in reversed(range(len(tables) - 1)):
        up = tables[k].where("up IS NOT NULL").select("tree", "node", F.col("up").alias("_up"))
        path = cut(path)
        path = path.unionByName(path.join(up, ["tree", "node"]).select("tree", "leaf", "rank", "branch_score", (F.col("at") - (1 << k)).alias("at"), F.col("_up").alias("node")))
    return path


def _written(turns: DataFrame, learn: tuple[str, ...]) -> DataFrame:
    """Formats the ordered array ``turns`` of ``(at, turn(role, text))``."""
    heads = F.transform("turns", lambda t: F.concat(F.lit(OPEN), F.url_encode(t["turn"]["role"]), F.lit("\n")))
    out = turns.withColumn("heads", heads)
    whole = F.concat_ws("", F.zip_with("heads", "turns", lambda h, t: F.concat(h, t["turn"]["text"], F.lit(CLOSE))))
    parts = F.zip_with("heads", "turns", lambda h, t: F.struct(F.length(h).alias("head"), F.length(t["turn"]["text"]).alias("n"), t["turn"]["role"].isin(*learn).alias("learn")))
    # Running start of each text: one pass over the turns.
    spans = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + t["head"] + t["n"] + len(CLOSE)).alias("at"),
            F.when(t["learn"], F.array_append(s["spans"], F.struct((s["at"] + t["head"]).alias("start"), (s["at"] + t["head"] + t["n"]).alias("end")))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    return out.select("conv_id", "rank", "branch_score", F.size("turns").cast("bigint").alias("n_turns"), whole.alias("formatted"), spans.alias("loss_spans"))


def format_trees(rows: DataFrame, branches: int = 1, learn: tuple[str, ...] = ("assistant",), tree: str = "conv_id", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str = "score") -> DataFrame:
    """``conv_id, rank, branch_score, n_turns, formatted, loss_spans``: one row for each of the best ``branches`` of each tree.

    ``formatted`` writes each turn as ``<|role``, newline, text, ``</s>``, newline.  Control strings inside texts are escaped, and roles are
    written in URL form, so :func:`read_turns` gets back exactly what went in.  ``loss_spans`` are start and end (code points, end exclusive) of the
    texts whose role is in ``learn``: what a model learns to write, without marks.

    A null text, role or score counts as empty or 0.  A row whose parent is null or not in its tree is a root, so a tree may have several
    and their branches compete.  Of rows that share tree and node the one with the highest score stands (ties: smaller role, then text digest, then parent): they are
    alternatives of one turn, and equal ones are one.  A row without tree or node id is a conversation of its own.  Rows on circles are on no branch.
    Empty table: no rows.  Only the named columns are read.  Node ids are compared as text.  A conversation is one value, so the longest branch must
    fit a task; nothing else is gathered.
    """
    source = rows.select(F.col(tree).cast("bigint").alias("tree"), F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"),
                         F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                         F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
    turn = F.struct("role", escaped(F.col("text")).alias("text")).alias("turn")
    alone = F.col("tree").isNull() | F.col("node").isNull()
    single = source.where(alone).select(F.col("tree").alias("conv_id"), F.lit(1).alias("rank"), F.col("score").alias("branch_score"), F.array(F.struct(F.lit(1).cast("bigint").alias("at"), turn)).alias("turns"))
    version = F.struct((-F.col("score")).alias("s"), "role", F.sha2("text", 256).alias("digest"), F.coalesce("parent", F.lit("")).alias("parent")).alias("version")
    known = source.where(~alone)
    nodes = cut(known.select("tree", "node", "parent", "score", version).groupBy("tree", "node").agg(
        F.min_by("parent", "version").alias("parent"), F.max("score").alias("score"), F.min("version").alias("version")))
    path = best_branches(nodes.drop("version"), branches).join(nodes.select("tree", "node", "version"), ["tree", "node"])
    turns = path.join(known.select("tree", "node", version, turn), ["tree", "node", "version"])
    turns = turns.groupBy("tree", "leaf", "rank", "branch_score").agg(F.array_sort(F.collect_set(F.struct("at", "turn"))).alias("turns"))
    return _written(turns.select(F.col("tree").alias("conv_id"), "rank", "branch_score", "turns").unionByName(single), learn)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    from urllib.parse import unquote_plus

    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        head, text = part.split("\n", 1)
        turns.append((unquote_plus(head[len(OPEN):]), unescape(text)))
    return turns


def _read():
    schema = pa.schema([("conv_id", pa.int64()), ("rank", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for formatted, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turns = parse(formatted)
                loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                row = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(o, f.type) for o, f in zip(out, list(schema)[2:], strict=True))], schema=schema)

    return run


def read_turns(formatted: DataFrame) -> DataFrame:
    """``conv_id, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all read back from ``formatted`` and ``loss_spans``.

    The digests are over role, newline, text, newline of each turn and over the unescaped texts under the loss mask.  An empty table gives an empty result.
    """
    ddl = "conv_id bigint, rank int, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select("conv_id", "rank", "formatted", "loss_spans").mapInArrow(_read(), ddl)


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each row answers the row before it.

    Order is by turn (null last), then role, then text; rows with an equal turn follow each other and repeated rows are turns of
    their own.  Rows without conversation are conversations of one turn.
    """
    named = rows.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), F.lit(0.0).alias("score"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    known = named.where("conv_id IS NOT NULL").withColumn("node", F.row_number().over(order)).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    single = named.where("conv_id IS NULL").withColumn("node", F.lit(None).cast("int")).withColumn("parent", F.lit(None).cast("int"))
    return known.unionByName(single).drop("turn")
