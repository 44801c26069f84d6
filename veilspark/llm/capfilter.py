"""Embedding near-duplicates by spherical caps: product codes list-decode each vector to its filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import cut
from veilspark.llm.graph import components


#: Below so many components caps at this scale hold few filters or none: all vectors of a label are compared.
LEAST_DIM = 64


class ProductCode:
    """Filter directions (c_i, c_j) / sqrt(2): all pairs of ``words`` unit vectors in the two halves of a rotated space.

    The directions of one code depend on each other, so ``tables`` codes with rotations of their own are used: that
    a near pair shares no filter of one code hardly tells about the next.
    """

    def __init__(self, dim: int, words: int, cap: float, tables: int, seed: int):
        self.half, self.words = (dim + 1) // 2, words
        self.cap = cap * np.sqrt(2 * 64 / max(dim, 2))
        self.codes = []
        for t in range(tables):
            rng = np.random.default_rng([seed, dim, t])
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            books = []
            for d in (self.half, dim - self.half):
                c = rng.standard_normal((words, max(d, 1)))
                books.append((c / np.linalg.norm(c, axis=1, keepdims=True)).astype(np.float32).T)
            self.codes.append((turn, *books))

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """All filters that each vector exceeds.  Only code words that can still reach the cap are combined."""
        if unit.shape[1] < LEAST_DIM:
            return [np.zeros(1, np.int64) for _ in unit]
        out: list[list] = [[] for _ in unit]
        for t, (turn, left, right) in enumerate(self.codes):
            x = (unit @ turn).astype(np.float32)
            rest = x[:, self.half :] if x.shape[1] > self.half else np.zeros((len(x), 1), np.float32)
            a, b = x[:, : self.half] @ left, rest @ right
            most_a, most_b = a.max(1), b.max(1)
            for i in range(len(x)):
                ia = np.flatnonzero(a[i] >= self.cap - most_b[i])
                ib = np.flatnonzero(b[i] >= self.cap - most_a[i])
                p, q = np.nonzero(a[i][ia][:, None] + b[i][ib][None, :] >= self.cap)
                out[i].append((t * self.words + ia[p].astype(np.int64)) * self.words + ib[q])
        return [np.sort(np.concatenate(o)) for o in out]


def _prepare():
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("unit", pa.binary())])

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = None if v is None or label is None or None in v else np.array(v, float)
                norm = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else np.linalg.norm(x / (m if (m := np.abs(x).max()) > 0 else 1))
                if not norm:
                    for o in out:
                        o.append(None)
                    continue
                x = x / np.abs(x).max()
                raw = (x / np.linalg.norm(x) + 0.0).tobytes()
                d = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64)
                out[0].append(int(d[0])), out[1].append(int(d[1])), out[2].append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], schema=schema)

    return run


def _decode(words: int, cap: float, tables: int, seed: int):
    schema = pa.schema([("label", pa.int64()), ("rep", pa.int64()), ("dim", pa.int64()), ("filters", pa.list_(pa.int64()))])

    def run(batches):
        codes = {}
        for batch in batches:
            raws = batch.column(2).to_pylist()
            dims = np.array([len(r) // 8 for r in raws], np.int64)
            lists: list = [None] * len(raws)
            for dim in np.unique(dims):
                code = codes.get(dim) or codes.setdefault(dim, ProductCode(int(dim), words, cap, tables, seed))
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), 500):
                    part = at[lo : lo + 500]
                    found = code.decode(np.stack([np.frombuffer(raws[i], float) for i in part]))
                    for i, f in zip(part, found, strict=True):
                        lists[i] = f
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

    return run


def _verify(least: float):
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def counted_before(lists, at_filter, n):
        """True for pairs that share a smaller filter, where they have been counted."""
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists])
        who = np.repeat(np.arange(n), [len(x) for x in lists])
        keep = flat < at_filter
        flat, who = flat[keep], who[keep]
        names, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.zeros((n, n), bool)
        useful = np.flatnonzero(times > 1)
        for lo in range(0, len(useful), 1024):
            cols = useful[lo : lo + 1024]
            place = np.full(len(names), -1)
            place[cols] = np.arange(len(cols))
            ok = place[column] >= 0
            inc = np.zeros((n, len(cols)), np.float32)
            inc[who[ok], place[column[ok]]] = 1
            shared |= inc @ inc.T > 0
        return shared

    def run(batches):
        # A few groups at a time: as Python objects they take several times their size.
        for batch in (whole.slice(lo, 16) for whole in batches for lo in range(0, whole.num_rows, 16)):
            out = [[], [], []]
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for flt, left, right, members in zip(*cols, strict=True):
                n = len(members)
                x = np.stack([np.frombuffer(m["unit"], float) for m in members])
                reps = np.array([m["rep"] for m in members], np.int64)
                times = np.array([m["copies"] for m in members], np.int64)
                block = np.array([m["block"] for m in members])
                ok = (x @ x.T >= least) & ~np.eye(n, dtype=bool)
                if left != right:
                    ok &= block[:, None] != block[None, :]
                if not ok.any():
                    continue
                rows = np.flatnonzero(ok.any(1))
                ok = ok[np.ix_(rows, rows)]
                low = reps[rows]  # least row that links reach within this group
                while True:
                    lower = np.minimum(low, np.where(ok, low[None, :], np.iinfo(np.int64).max).min(1))
                    if (lower == low).all():
                        break
                    low = lower
                ok &= ~counted_before([members[i]["filters"] for i in rows], flt, len(rows))
                out[0] += reps[rows].tolist()
                out[1] += (ok @ times[rows]).tolist()
                out[2] += low.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], schema=schema)

    return run


def cap_links(vectors: DataFrame, least: float = 0.93, words: int = 4096, cap: float = 0.54, tables: int = 6, seed: int = 7, block: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each vector; links join vectors of one label with cosine >= ``least``.

    Each distinct vector is decoded to every filter direction whose cap holds it; vectors of one label that share
    a filter meet there, and the cosine is computed in double precision.  A pair is counted in the smallest filter
    it shares, so pairs are never written out.  A filter with more than ``block`` vectors is
    dealt in blocks, and each pair of blocks is a group of its own.  Equal directions are one node
    with a count, so copies don't meet at all.  ``cap`` is the least inner product in 64 dimensions and is scaled
    for more; shorter vectors are all in one filter, which is exact and quadratic in the vectors of a label and length.  It fixes the number of filters a vector has, whatever the number of vectors.  With the defaults that is about 200
    in 64 dimensions, and a pair of cosine 0.93 shares none of them with probability below 1e-4.

    Vectors that are null, empty, zero or hold null or non-finite numbers, or whose label is null, link with nothing and are
    kept; so are rows without id.  Vectors of different length are never compared.  Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("bigint").alias("label"))
    ready = cut(rows.mapInArrow(_prepare(), "vec_id bigint, label bigint, d1 bigint, d2 bigint, unit binary"))
    valid = ready.where("unit IS NOT NULL AND vec_id IS NOT NULL")
    reps = cut(valid.groupBy("label", "d1", "d2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")))
    coded = cut(reps.select("label", "rep", "unit").mapInArrow(_decode(words, cap, tables, seed), "label bigint, rep bigint, dim bigint, filters array<bigint>"))
    held = coded.select("label", "dim", "rep", F.explode("filters").alias("filter"))
    size = held.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = held.join(size, ["label", "dim", "filter"])
    shared = met.groupBy("label", "rep").agg(F.array_sort(F.collect_list("filter")).alias("filters"))
    parts = F.ceil(F.col("n") / block).cast("int")
    other = (
        met.withColumn("parts", parts).withColumn("block", F.expr("cast(pmod(xxhash64(rep), parts) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("label", "dim", "filter", "rep", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    )
    full = other.join(reps.select("label", "rep", "copies", "unit").join(shared, ["label", "rep"]), ["label", "rep"])
    groups = full.groupBy("label", "dim", "filter", "left", "right").agg(F.collect_list(F.struct("rep", "copies", "block", "filters", "unit")).alias("members"))
    found = cut(groups.select("filter", "left", "right", "members").mapInArrow(_verify(least), "rep bigint, links bigint, low bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts_of = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct())
    nodes = reps.select("label", "d1", "d2", "rep", "copies").join(links, "rep", "left").join(parts_of.withColumnRenamed("node", "rep"), "rep", "left")
    nodes = nodes.select("label", "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    placed = valid.select("vec_id", "label", "d1", "d2").join(nodes, ["label", "d1", "d2"]).select("vec_id", "n_links", "component_id")
    rest = ready.where("unit IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
