"""Product codes of vectors: codebooks of integer entries, nearest entries found by Orchard's search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integer components are held within these bounds, so that squares and their sums over a vector fit 64 bits.
BOUND = 1 << 26


class Orchard:
    """Nearest entries of a codebook by squared Euclidean distance, ties to the lower index; all in exact integers.

    Every entry has the list of the others by distance from it.  A search walks the list of the best entry so far, jumps to
    the list of any better entry it meets, marks what it has measured, and ends when the next entry of the list lies beyond twice the
    best distance: by the triangle inequality no later one can be nearer or as near.  Many vectors walk side by side.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        gap = self.entries[:, None, :] - self.entries[None, :, :]
        apart = (gap * gap).sum(2)
        self.lists = np.argsort(apart, axis=1, kind="stable").astype(np.int32)
        self.apart = np.take_along_axis(apart, self.lists.astype(np.int64), 1)
        # Where a walk begins does not matter to its end: the entry whose component sum is next to the vector's.
        self.sums = self.entries.sum(1)
        self.by_sum = np.argsort(self.sums, kind="stable")

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row."""
        k, n = len(self.entries), len(parts)
        at = np.searchsorted(self.sums[self.by_sum], parts.sum(1)).clip(0, k - 1)
        best = self.by_sum[at].astype(np.int64)
        dist = self._measure(parts, best)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), best] = True
        place = np.zeros(n, np.int64)
        going = np.arange(n)
        while len(going):
            near = best[going]
            going = going[self.apart[near, place[going]] <= 4 * dist[going]]
            near = best[going]
            other = self.lists[near, place[going]].astype(np.int64)
            place[going] += 1
            fresh = ~seen[going, other]
            rows, other = going[fresh], other[fresh]
            seen[rows, other] = True
            d = self._measure(parts[rows], other)
            better = (d < dist[rows]) | ((d == dist[rows]) & (other < best[rows]))
            moved = rows[better]
            best[moved], dist[moved], place[moved] = other[better], d[better], 0
            going = going[place[going] < k]
        return best, dist

    def _measure(self, parts: np.ndarray, which: np.ndarray) -> np.ndarray:
        gap = parts - self.entries[which]
        return (gap * gap).sum(1)


def _kept(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows with a vector of finite components, and these vectors."""
    col = batch.column(column).cast(pa.list_(pa.float64()))
    flat = col.flatten()
    length = np.asarray(col.value_lengths().fill_null(0))
    values = np.asarray(flat.fill_null(np.nan), float)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(length)
    ok = np.asarray(col.is_valid()) & (bad[ends] == bad[ends - length])
    return np.flatnonzero(ok), [values[e - m : e] for e, m, good in zip(ends, length, ok, strict=True) if good]


def _integers(vectors: list[np.ndarray], parts: int, width: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` by vector, part and position; shorter vectors as if followed by zeros."""
    out = np.zeros((len(vectors), parts * width))
    same = {len(v) for v in vectors}
    if len(same) == 1:
        out[:, : same.pop()] = np.stack(vectors)
    else:
        for row, v in zip(out, vectors, strict=True):
            row[: len(v)] = v
    with np.errstate(over="ignore"):
        return np.floor(out * scale).clip(-BOUND, BOUND).astype(np.int64).reshape(len(vectors), parts, width)


def _quantised(parts: int, width: int, scale: int):
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows, vectors = _kept(batch, 1)
            ints = _integers(vectors, parts, width, scale).reshape(len(rows), parts * width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(list(ints), pa.list_(pa.int64()))], schema=schema)

    return run


def _sums(books: list[np.ndarray], width: int, scale: int):
    """Per task and entry: number of parts assigned to it and their component sums."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def run(batches):
        searches = [Orchard(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            _, vectors = _kept(batch, 0)
            if not vectors:
                continue
            ints = _integers(vectors, len(books), width, scale)
            for p, search in enumerate(searches):
                best, _ = search.nearest(ints[:, p])
                count[p] += np.bincount(best, minlength=len(books[p]))
                np.add.at(total[p], best, ints[:, p])
        found = [(p, e) for p in range(len(books)) for e in np.flatnonzero(count[p])]
        yield pa.RecordBatch.from_arrays([
            pa.array([p for p, _ in found], pa.int32()), pa.array([int(e) for _, e in found], pa.int32()),
            pa.array([int(count[p][e]) for p, e in found], pa.int64()), pa.array([total[p][e].tolist() for p, e in found], pa.list_(pa.int64()))], schema=schema)

    return run


def _codes(books: list[np.ndarray], width: int, scale: int):
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches):
        searches = [Orchard(b) for b in books]
        for batch in batches:
            rows, vectors = _kept(batch, 2)
            if not vectors:
                continue
            ints = _integers(vectors, len(books), width, scale)
            found = [s.nearest(ints[:, p]) for p, s in enumerate(searches)]
            code = np.stack([b for b, _ in found], 1).astype(np.uint8)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([c.tobytes().hex() for c in code], pa.string()),
                                              pa.array(np.sum([d for _, d in found], 0), pa.int64())], schema=schema)

    return run


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> list[np.ndarray]:
    """One codebook of integer entries per part position.

    It starts with the parts of the ``entries`` rows of smallest id (rows that share an id: of smallest vector; rows without an id last)
    and is moved ``rounds`` times to the floors of the means of all parts assigned to each entry.  Every row counts in each
    round; tasks send one sum per entry, so the driver sees at most ``parts * entries`` rows whatever the input.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = rows.mapInArrow(_quantised(parts, width, scale), "vec_id bigint, v array<bigint>").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = [np.array([r.v[p * width : (p + 1) * width] for r in first], np.int64).reshape(len(first), width) for p in range(parts)]
    if not first:
        return books
    for _ in range(rounds):
        part_sums = rows.select("v").mapInArrow(_sums(books, width, scale), "part int, entry int, n bigint, total array<bigint>")
        sums = part_sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)))
        for r in sums.collect():
            books[r.part][r.entry] = [int(r[f"t{i}"]) // r.n for i in range(width)]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", salts: int = 32) -> DataFrame:
    """``vec_id, label, code, error, label_error`` of each row with a vector; see :func:`compress`."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vec_col).alias("v"))
    if not len(books[0]):
        return rows.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"))
    coded = rows.mapInArrow(_codes(books, books[0].shape[1], scale), "vec_id bigint, label bigint, code string, error bigint")
    coded = coded.withColumn("_none", F.col("label").isNull()).withColumn("_key", F.coalesce("label", F.lit(0)))
    # A label's sum is laid beside a share of its rows, so a label with a large part of all rows isn't one task.
    sums = coded.groupBy("_none", "_key").agg(F.sum("error").alias("label_error")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int")).join(sums, ["_none", "_key", "_salt"]).select("vec_id", "label", "code", "error", "label_error")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of each row whose vector has only finite components.

    Components become ``floor(scale * x)`` (within +-2^26) and vectors ``parts`` equal consecutive parts, each replaced by the index
    of its nearest codebook entry, two hex digits.  ``error`` is the sum of the squared distances, ``label_error`` its sum over the rows of equal
    label (no label: together).

    Rows whose vector is null or holds null, NaN or infinite components are left out.  Vectors whose length is no multiple of ``parts``
    or that are shorter than the longest count as followed by zeros.  With fewer rows than ``entries`` the codebooks are smaller; repeated rows
    are each coded (and each may start an entry); ties go to the lower index.  A null id stays null.  Other columns are not read; an empty table gives an
    empty result.
    """
    books = train(vectors, parts, entries, rounds, scale, id_col, vec_col)
    return encode(vectors, books, scale, id_col, vec_col, label_col).withColumn("codebooks_sha256", F.lit(digest(books)))


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = 256, code_col: str = "code") -> DataFrame:
    """Adds ``restored``, the vector of the entries that a code names; null for a null code."""
    def entry(i, book):
        which = F.conv(F.substring(F.col(code_col), 2 * i + 1, 2), 16, 10).cast("int")
        return F.get(F.array(*(F.array(*(F.lit(float(x) / scale) for x in e)) for e in book)), which)

    return codes.withColumn("restored", F.when(F.col(code_col).isNotNull(), F.concat(*(entry(i, b) for i, b in enumerate(books)))))
