"""Restoring JSON bodies: placeholders in string values give way to originals, all else stays as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.json_text import json_quote
from veilspark.functions.json_walk import json_form, json_nodes
from veilspark.functions.spans import compute_once
from veilspark.operators.redact import EDIT_TYPE, splice
from veilspark.operators.restore import STAT_NAMES, restore
from veilspark.sources.lineage import cut


def restore_json(messages: DataFrame, vault: DataFrame, keys: list[str], body: str = "body", out: str = "restored_body", loose: bool = True) -> DataFrame:
    """Adds ``out``, ``form`` and the counters of :func:`veilspark.operators.restore.restore`; ``keys`` must identify a row, which has a ``session``.

    In a JSON body each string value is restored, at any depth; under keys that hold JSON text the original is escaped once
    more.  Keys, numbers, order and spacing stay.  Only values with a placeholder leave their row, and only rewritten tokens are written anew.
    A body that is no JSON is restored as text: ``form`` is ``text`` then, ``deep`` where the nesting is beyond the parser, ``none`` for null.
    """
    rows = compute_once(messages, form=json_form(F.col(body)))
    has = F.contains(F.col("leaf"), F.lit("PII:"))
    asked = messages.where(F.contains(F.col(body), F.lit("PII:"))).select(*keys, "session", body)
    leaves = compute_once(asked, __nodes=json_nodes(F.col(body))).select(*keys, "session", F.inline("__nodes")).where(has)
    # The walk costs most by far and the restore reads its rows several times.
    leaves = cut(leaves.select(*keys, "session", "start", "len", "leaf", F.col("key").isin(*fx.JSON_TEXT_KEYS).alias("escape")))
    back = restore(leaves.select(*keys, "session", F.col("start").alias("__at"), F.col("len").alias("__size"), "leaf", "escape"), vault, [*keys, "__at"], "leaf", "__new", loose, "escape")
    edit = F.when(F.col("__new") != F.col("leaf"), F.struct(F.col("__at").alias("start"), F.col("__size").alias("len"), json_quote(F.col("__new")).alias("text")))
    per = back.groupBy(*keys).agg(F.array_sort(F.collect_list(edit)).cast(EDIT_TYPE).alias("__edits"), *(F.sum(s).alias(s) for s in STAT_NAMES))
    is_text = F.col("form") == "text"
    zero = F.lit(0).cast("bigint")
    trees = rows.where(~is_text).join(per, keys, "left")
    trees = trees.withColumn(out, F.when(F.size("__edits") > 0, splice(F.col(body), F.col("__edits"))).otherwise(F.col(body))).drop("__edits")
    trees = trees.withColumns({s: F.coalesce(F.col(s), zero) for s in STAT_NAMES})
    texts = restore(rows.where(is_text), vault, keys, body, out, loose)
    return trees.unionByName(texts)
