"""Language-model scores by stupid backoff: count tables partitioned by hash, joined to the n-grams of blocks of documents."""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import FirstSeen, checkpoint_dir, mix64
from veilspark.llm.secrets import tokenizer

CHUNK = r"\s*\S+|\s+"
BITS = 20
BLOCKS = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary())])
GRAMS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("grams", pa.binary()), ("times", pa.binary())])
SCORES = "doc_id bigint, n_tokens bigint, n_backoff bigint, log_score double"


def grams(ids: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that lie within one document, and the positions of their last tokens."""
    if len(ids) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(len(ids) - n + 1, np.int64)
    for j in range(n):
        key = (key << BITS) | (ids[j : len(ids) - n + 1 + j] + 1)
    inside = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    return key[inside], inside + n - 1


def _blocks(vocabulary: bytes, pattern: str, block_tokens: int):
    def run(batches):
        enc = tokenizer(vocabulary, pattern)
        find = re.compile(CHUNK).findall
        memo = FirstSeen(lambda w: array("i", enc.encode_ordinary(w)).tobytes())
        block = TaskContext.get().partitionId() << 32
        docs, parts, sizes = [], [], []

        def flush():
            ids = np.frombuffer(b"".join(parts), np.int32)
            packed = zlib.compress(ids.astype(np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32).tobytes(), 1)
            yield pa.RecordBatch.from_pylist([{"block": block, "docs": list(docs), "sizes": list(sizes), "tokens": packed}], schema=BLOCKS)

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = b"".join(map(memo.__getitem__, find(text))) if text else b""
                docs.append(doc_id), parts.append(raw), sizes.append(len(raw) // 4)
                held += len(raw) // 4
                if held >= block_tokens or len(docs) >= 20_000:
                    yield from flush()
                    block += 1
                    held = 0
                    docs, parts, sizes = [], [], []
        if docs:
            yield from flush()

    return run


def tokens_of(packed: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint32 if wide else np.uint16).astype(np.int64)


def gram_counts(ids: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of a block, shorter ones first, and their counts."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    found = [np.unique(grams(ids, doc, n)[0], return_counts=True) for n in range(1, order + 1)]
    return np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found])


def pack(x: np.ndarray) -> bytes:
    """Numbers as differences, a byte of all after the other."""
    return zlib.compress(np.ascontiguousarray(np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").ravel())


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams by part of the count table, and where each part begins."""
    part = (mix64(keys) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    by = np.argsort(part, kind="stable")
    return by, np.append(np.searchsorted(part[by], np.arange(parts, dtype=part.dtype)), len(keys))


def _count(order: int, wide: bool, parts: int):
    """The n-grams of each block and their counts, one row for each part of the count table."""

    def run(batches):
        for batch in batches:
            for block, sizes, tokens in zip(*(batch.column(i) for i in range(3)), strict=True):
                keys, times = gram_counts(tokens_of(tokens.as_py(), wide), np.array(sizes.as_py(), np.int64), order)
                by, ends = dealt(keys, parts)
                for p in np.flatnonzero(np.diff(ends)):
                    at = by[ends[p] : ends[p + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([block.as_py()]), pa.array([pack(keys[at])]), pa.array([pack(times[at])])], schema=GRAMS)

    return run


def elsewhere(t: pa.Table) -> pa.Table:
    """For each block of a part, the places in its list of the n-grams that other blocks have too, and how often these have them.

    The block can list its n-grams again, and places take far fewer bytes than n-grams.
    """
    blocks = t.column("block").to_pylist()
    each = [(unpack(k), unpack(n)) for k, n in zip(t.column("grams").to_pylist(), t.column("times").to_pylist(), strict=True)]
    name, inverse = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
    times = np.concatenate([n for _, n in each])
    rest = np.bincount(inverse, times, len(name)).astype(np.int64)[inverse] - times
    out: list[list] = [[], [], [], []]
    at = 0
    for block, (keys, _) in zip(blocks, each, strict=True):
        more = rest[at : at + len(keys)]
        at += len(keys)
        keep = more > 0
        if keep.any():
            out[0].append(t.column("part")[0].as_py()), out[1].append(block), out[2].append(pack(np.flatnonzero(keep))), out[3].append(pack(more[keep]))
    return pa.table([pa.array(o, f.type) for o, f in zip(out, GRAMS, strict=True)], schema=GRAMS)


def backoff_scores(ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, counts: np.ndarray, total: int, order: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Summed log scores and backoffs of each document of a block, leaving out the document's own counts.

    ``keys`` is sorted; an n-gram that isn't in it occurs nowhere else.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    rest = np.maximum(total - sizes, 1).astype(float)[doc]  # tokens of the other documents
    others = []
    for n in range(1, order + 1):
        key, at = grams(ids, doc, n)
        name, inverse = np.unique(key, return_inverse=True)
        place = np.minimum(np.searchsorted(keys, name), max(len(keys) - 1, 0))
        everywhere = np.where(keys[place] == name, counts[place], 0) if len(keys) else np.zeros(len(name), np.int64)
        own_key, own = np.unique(doc[at] * max(len(name), 1) + inverse, return_inverse=True)
        here = np.bincount(own, minlength=len(own_key))[own]
        f = np.zeros(len(ids), np.int64)
        f[at] = np.maximum(everywhere[inverse] - here, 0)
        others.append(f)
    score = np.log(weight) - np.log(rest)  # a token that no other document has
    seen = others[0] > 0
    score[seen] = np.log(others[0][seen]) - np.log(rest[seen])
    steps = (~seen).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])[doc] if len(ids) else np.zeros(0, np.int64)
    depth = np.arange(len(ids)) - start
    for n in range(2, order + 1):
        can = np.flatnonzero(depth >= n - 1)
        hit = can[others[n - 1][can] > 0]
        miss = can[others[n - 1][can] == 0]
        score[miss] += np.log(weight)
        steps[miss] += 1
        # The context's own count is that of the lower order, one token earlier.
        score[hit] = np.log(others[n - 1][hit]) - np.log(others[n - 2][hit - 1])
        steps[hit] = 0
    return np.bincount(doc, score, len(sizes)), np.bincount(doc, steps, len(sizes)).astype(np.int64)


def _score(total: int, order: int, weight: float, wide: bool, parts: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_backoff", pa.int64()), ("log_score", pa.float64())])

    def run(_, blocks, replies):
        heard = [(p, unpack(k), unpack(n)) for p, k, n in zip(*(replies.column(c).to_pylist() for c in ("part", "grams", "times")), strict=True)]
        out = []
        for b in blocks.to_pylist():
            ids, sizes = tokens_of(b["tokens"], wide), np.array(b["sizes"], np.int64)
            keys, counts = gram_counts(ids, sizes, order)
            by, ends = dealt(keys, parts)
            for p, k, n in heard:
                counts[by[ends[p] : ends[p + 1]][k]] += n
            score, steps = backoff_scores(ids, sizes, keys, counts, total, order, weight)
            out.append(pa.table([pa.array(b["docs"], pa.int64()), pa.array(sizes), pa.array(steps), pa.array(score)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return lambda key, blocks, replies: run(key, blocks, replies)


def stupid_backoff(docs: DataFrame, vocabulary: bytes, token_pattern: str, order: int = 3, weight: float = 0.4, block_tokens: int = 2_500_000, part_tokens: int = 500_000, folder: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_backoff, log_score, mean_log_score`` of each whole text under the counts of all other rows.

    Tokens are those of a public byte-level vocabulary.  Each task packs its documents into blocks and lists the
    distinct n-grams of a block with their counts, dealt by hash into packed parts.  A part sums them and answers each block only for the
    n-grams that other blocks have too, by their places, with the others' counts; the block adds its own, and its documents are summed there.  A document's own counts are taken off:
    an n-gram found nowhere else backs off to the shorter one, times ``weight``; a token found nowhere else counts as
    ``weight`` occurrences.  A very common n-gram is one entry per block.

    A null or empty text has no tokens, score 0 and a null mean.  Repeated rows score each other; a null id stays null.
    Other columns are not read; an empty table gives an empty result.  Blocks are kept in ``folder``, by default
    beside the session's checkpoints.
    """
    if not 1 <= order <= 3:
        raise ValueError("order is 1, 2 or 3")
    spark = docs.sparkSession
    base = folder or checkpoint_dir(spark)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    path = f"{base.rstrip('/')}/blocks-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(_blocks(vocabulary, token_pattern, block_tokens), "block bigint, docs array<bigint>, sizes array<bigint>, tokens binary").write.parquet(path)
    blocks = spark.read.parquet(path)
    total = blocks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, n: a + n)), F.lit(0))).first()[0]
    wide = tokenizer(vocabulary, token_pattern).n_vocab > 1 << 16
    schema = "part bigint, block bigint, grams binary, times binary"
    parts = total // part_tokens + 16
    asked = blocks.select("block", "sizes", "tokens").mapInArrow(_count(order, wide, parts), schema)
    replies = asked.groupBy("part").applyInArrow(elsewhere, schema)
    scored = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(total, order, weight, wide, parts), SCORES)
    return scored.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))
