"""A corpus pipeline: toxic texts out, one of each near-duplicate group, benchmark leaks out, secrets masked, text encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontam, minhash, secrets, sentpiece, toxicity
from veilspark.llm.common import checkpoint_dir, table
from veilspark.llm.queries import bpe, model_file


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``docs`` has a column of that name (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text; rows with the same key have the same text, so they are judged alike."""
    key = _free(docs, "_row")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score as toxic go; a row without id is judged by its text like any other.

    Null and empty texts score like any text without words.  Repeated rows stay or go together; an empty table stays empty; columns of any name
    are kept.
    """
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows, key = _keyed(docs)
    bad = toxicity.score_toxicity(rows, machine, id_col=key).where("predicted = 1").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(bad, key, "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest id.

    Rows that share an id or have none are told apart by their text, so a text that no other row is near to stays whatever its id; they come after
    all rows with an id of their own.  Equal rows are one.  Texts without words are near to nothing.  An empty table stays empty; columns
    of any name are kept.
    """
    key = _free(docs, "_row")
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id")
    by_text = F.lit(1 << 62) + F.xxhash64("doc_id", "text").bitwiseAND((1 << 61) - 1)
    if shared.isEmpty():
        rows = docs.withColumn(key, F.col("doc_id").cast("bigint"))
    else:
        own = docs.join(shared, "doc_id", "left_anti").where("doc_id IS NOT NULL").withColumn(key, F.col("doc_id").cast("bigint"))
        known = docs.join(shared, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
        rows = own.unionByName(known.dropDuplicates(["doc_id", "text"]).withColumn(key, by_text))
    gone = minhash.near_duplicates(rows, id_col=key).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go; null and empty texts stay, repeated rows stay or go together, an empty table stays empty."""
    rows, key = _keyed(docs)
    leaks = decontam.template_leaks(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(leaks, key, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in a text are masked and its length is set anew; texts without any, null ones too, stay as they are.

    Repeated rows stay repeated; an empty table stays empty; columns of any name are kept.
    """
    rows, key = _keyed(docs)
    masked = _free(rows, "_masked")
    found = secrets.scan_secrets(rows, *bpe(), redact=True, id_col=key).where("redacted IS NOT NULL")
    found = found.select(F.col("doc_id").alias(key), F.col("redacted").alias(masked)).dropDuplicates([key])
    out = rows.join(found, key, "left").withColumn("n_chars", F.when(F.col(masked).isNotNull(), F.length(masked)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.coalesce(masked, "text")).select(docs.columns)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text as ``pieces``, their number and whether they decode to the text; columns of these names are replaced.

    A null text has no pieces and counts as restored like an empty one; every row stays.
    """
    own = ("pieces", "n_pieces", "restored")
    docs = docs.select([c for c in docs.columns if c.lower() not in own])
    back = _free(docs, "_decoded")
    coded = sentpiece.decode(sentpiece.encode(docs, model_file()), model_file(), to=back)
    return coded.select(*docs.columns, "pieces", F.size("pieces").alias("n_pieces"), (F.coalesce("text", F.lit("")) == F.col(back)).alias("restored"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("sentencepiece", encode_text),
]
#: The first stage learns a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    import uuid

    shared = checkpoint_dir(spark)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
