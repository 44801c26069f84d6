"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import FirstSeen, binary_column, cut, cut_dealt, mix64
from veilspark.llm.graph import components

ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53,
       0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter sequence counts as one shingle."""
    n = len(words)
    if not n:
        return words
    width = min(n, k)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            h += words[i : n - width + 1 + i] * np.uint64(ODD[i])
    return np.unique(mix64(h))


def signature(s: np.ndarray, bins: int) -> np.ndarray:
    """Least hash of each bin (by the leading bits); an empty bin borrows from a full one.

    The donor is drawn anew for each empty bin and attempt by a hash of both, the same for all sets, so that two
    sets borrow alike wherever their full bins agree.
    """
    shift = np.uint64(64 - bins.bit_length() + 1)
    starts = np.searchsorted(s, np.arange(bins, dtype=np.uint64) << shift)
    ends = np.append(starts[1:], len(s))
    full = starts < ends
    out = np.where(full, s[np.minimum(starts, len(s) - 1)], np.uint64(0))
    need = np.flatnonzero(~full)
    attempt = 1
    while len(need):
        donor = (mix64(need.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        ok = full[donor]
        out[need[ok]] = out[donor[ok]]
        need = need[~ok]
        attempt += 1
    return out


def band_values(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    sig = sig.reshape(bands, rows)
    with np.errstate(over="ignore"):
        h = np.arange(bands, dtype=np.uint64) * np.uint64(ODD[-1])
        for i in range(rows):
            h = mix64(h + sig[:, i] * np.uint64(ODD[i]))
    return h.view(np.int64)


def word_hashes():
    return FirstSeen(lambda w: xxhash.xxh3_64_intdigest(w))


def set_of(text: bytes | None, k: int, memo: dict) -> np.ndarray:
    # Lower-casing and splitting bytes touches ASCII only: A-Z, and the six white-space characters.
    words = text.lower().split() if text else []
    return shingles(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), k)


def _sign(k: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        memo = word_hashes()
        for batch in batches:
            out = [[], [], [], []]
            for text in binary_column(batch, 1):
                s = set_of(text, k, memo)
                out[0].append(len(s))
                if len(s):
                    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    sig = signature(s, bands * rows)
                    out[1].append(int(d[0])), out[2].append(int(d[1])), out[3].append(band_values(sig, bands, rows))
                else:
                    out[1].append(None), out[2].append(None), out[3].append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.list_(pa.int64()))], schema=schema)

    return run


def _sets(k: int):
    schema = pa.schema([("_node", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        memo = word_hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([set_of(t, k, memo).view(np.int64) for t in binary_column(batch, 1)], pa.list_(pa.int64()))], schema=schema)

    return run


def _prints(bands: int, rows: int):
    """Band values and one byte of each bin, from a set."""
    schema = pa.schema([("rep", pa.int64()), ("size", pa.int64()), ("bands", pa.binary()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for hashes in batch.column(1):
                s = hashes.values.to_numpy().view(np.uint64)
                sig = signature(s, bands * rows)
                out[0].append(len(s)), out[1].append(band_values(sig, bands, rows).tobytes()), out[2].append((sig & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], schema=schema)

    return run


def by_group(batches):
    """Tables of the rows that agree in the first three columns; the rows come sorted by them."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        starts = np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)), [batch.num_rows]])
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            part = batch.slice(lo, hi - lo)
            if held and any(held[0].column(i)[0] != part.column(i)[0] for i in range(3)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def agreement(x: np.ndarray) -> np.ndarray:
    """In how many columns each two rows agree."""
    if len(x) <= 64:
        return (x[:, None, :] == x[None, :, :]).sum(2)
    out = np.zeros((len(x), len(x)), np.int32)
    for column in x.T:
        out += column[:, None] == column[None, :]
    return out


def _promising(percent: int, bands: int, rows: int):
    """The members of a group that some other one in it may be linked with and shares no earlier band with."""
    schema = pa.schema([("bucket", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("rep", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for t in by_group(batches):
            at, size = t.column("at").to_numpy(), t.column("size").to_numpy()
            names = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.int64).reshape(-1, bands)
            least = np.minimum(size[:, None], size[None, :])
            ok = (at[:, None] != at[None, :]) & (np.maximum(size[:, None], size[None, :]) * percent <= least * 100)
            column = int(np.flatnonzero((names == t.column("bucket")[0].as_py()).any(0))[0])
            own = names[:, column] == t.column("bucket")[0].as_py()
            ok &= own[:, None] & own[None, :]
            if column and ok.any():
                ok &= agreement(names[:, :column]) == 0
            if ok.any():
                few = agreement(np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(len(at), -1)) < bands * rows * (percent / 100 - 0.3)
                ok &= ~(few & (least >= 2 * bands * rows))
            keep = pa.array(np.flatnonzero(ok.any(1)))
            if len(keep):
                yield from t.select(schema.names).take(keep).cast(schema).to_batches()

    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets."""
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    useful = times > 1
    place = np.where(useful, np.cumsum(useful) - 1, -1)[column]
    by = np.argsort(place, kind="stable")
    place, who = place[by], who[by]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(useful.sum()), 2048):
        a, b = np.searchsorted(place, [lo, lo + 2048])
        inc = np.zeros((len(sets), 2048), np.float32)
        inc[who[a:b], place[a:b] - lo] = 1
        out += inc @ inc.T
    return out


def _linked(percent: int):
    """Links between components of a group, on the full sets: each component to the least one it is linked with."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in by_group(batches):
            at = t.column("at").to_numpy()
            sets = [h.values.to_numpy() for h in t.column("hashes")]
            size = np.array([len(s) for s in sets])
            both = common(sets)
            ok = (at[:, None] != at[None, :]) & (both * 100 >= percent * (size[:, None] + size[None, :] - both))
            x, y = np.nonzero(ok)
            if len(x):
                # All links of the group, as pairs of components: there are at most as many as components that they join.
                ends = np.unique(np.stack([np.maximum(at[x], at[y]), np.minimum(at[x], at[y])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], schema=schema)

    return run


def _rest(here: DataFrame, sets: DataFrame, percent: int, bands: int, rows: int, block: int, most: int) -> DataFrame:
    """Links ``(a, b)`` of components, from all pairs that share a bucket and lie in different components.

    A bucket is dealt in blocks of ``block`` members or ``most`` hashes, and two blocks meet in a group.  A component that fills blocks of
    its own doesn't meet itself.  No pair is written out: a group first drops the members that have no partner left
    by size and bins, then counts what the full sets of the others have in common.
    """
    cells = here.groupBy("bucket", "at").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    # A bucket of two was compared in the first round.
    open_ = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("all")).where("parts > 1 AND all > 2").select("bucket")
    here = cut(here.join(open_, "bucket"))
    if here.isEmpty():
        return here.select(F.col("at").alias("a"), F.col("at").alias("b"))
    large = F.when((F.col("c") > block) | (F.col("w") > most), F.col("at")).alias("own")
    cells = here.groupBy("bucket", "at").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).select("bucket", "at", "c", "w", large)
    parts = F.greatest(F.ceil(F.sum("c") / block), F.ceil(F.sum("w") / most)).cast("int")
    dealt = cells.groupBy("bucket", "own").agg(parts.alias("parts"))
    blocks = dealt.select("bucket", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("bucket", "own", F.xxhash64("own", "part").alias("part"))
    other = blocks.select("bucket", F.col("own").alias("own2"), F.col("part").alias("part2"))
    met = blocks.join(other, "bucket").where("part <= part2 AND NOT coalesce(own = own2, false)").select("bucket", F.col("part").alias("left"), F.col("part2").alias("right"))
    met = met.withColumn("part", F.explode(F.array_distinct(F.array("left", "right"))))
    # The few large cells and the pools of the others are joined on, so each member knows its block.
    placed = here.join(cells.where("own IS NOT NULL").select("bucket", "at", "own"), ["bucket", "at"], "left")
    same = (placed.bucket == dealt.bucket) & placed.own.eqNullSafe(dealt.own)
    placed = placed.join(dealt, same).select(placed.bucket, "rep", "at", F.xxhash64(placed.own, F.expr("cast(pmod(xxhash64(rep), parts) as int)")).alias("part"))
    key = ["bucket", "left", "right"]
    prints = sets.join(here.select(F.col("rep").alias("_node")).distinct(), "_node", "left_semi").mapInArrow(_prints(bands, rows), "rep bigint, size bigint, bands binary, bytes binary")
    grouped = placed.join(met, ["bucket", "part"]).select(*key, "rep", "at").join(prints, "rep").select(*key, "rep", "at", "size", "bands", "bytes")
    chosen = cut(grouped.repartition(*key).sortWithinPartitions(*key).mapInArrow(_promising(percent, bands, rows), "bucket bigint, left bigint, right bigint, rep bigint, at bigint"))
    full = chosen.distinct().join(sets.withColumnRenamed("_node", "rep"), "rep").select(*key, "rep", "at", "hashes")
    return full.repartition(*key).sortWithinPartitions(*key).mapInArrow(_linked(percent), "a bigint, b bigint").distinct()


def _placed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members of buckets with the component each is in."""
    if labels is None:
        return members.withColumn("at", F.col("rep"))
    return members.join(labels, members.rep == labels.node, "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("at"))


def _moved(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components after new links, which join whole components, so only the components' names are searched anew."""
    merged = components(found)
    if labels is None:
        return merged
    names = merged.select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = labels.join(names, labels.component == names.old, "left").select("node", F.coalesce("new", "component").alias("component"))
    return cut(moved.unionByName(merged.join(labels.select("node"), "node", "left_anti")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, block: int = 512, block_hashes: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Two texts are linked if ``100 * |A ∩ B| >= percent * |A ∪ B|`` for their sets of k-word shingles (words split at
    ASCII white space, A-Z lower-cased; a shorter text is one shingle).  Equal sets are one node.  A bucket (equal
    values of one band) proposes only edges to one centre, so pairs stay linear in the rows.  Each edge is
    confirmed on the full sets.  Then buckets that still hold several components propose again, with
    another centre, while at least one in twenty of a round's edges is a link.  Last, all pairs of the buckets that still hold several components are
    compared in blocks (see ``_rest``), so every pair that shares a bucket is linked, or compared, or excluded.  With the
    defaults a pair of similarity 0.8 shares no bucket with probability 5e-8, and one of large sets is excluded by its bins
    with probability below 1e-8.

    A null or empty text, or one of white space, has no shingles and links with nothing.  A row without id links
    with nothing and is kept.  Repeated rows are nodes of their own that link as equal texts.  No other column is
    read.  An empty table gives an empty result.
    """
    if k > len(ODD):
        raise ValueError(f"k is at most {len(ODD)}")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(narrow.mapInArrow(_sign(k, bands, rows), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"))
    nodes = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = nodes.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # All rows of a set have the same bands, so they come from the row that stands for the set.
    alone = nodes.join(reps, ["d1", "d2"]).where("doc_id = rep").dropDuplicates(["rep", "d1", "d2"])
    members = alone.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1").select("bucket")
    members = cut(members.join(shared, "bucket"))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    # A repeated id with several texts would be ambiguous here; each of its texts is confirmed by its own set.  Equal rows go before
    # the hashes are made.  The sets are dealt by id once, so that no round moves all of them again.
    texts = narrow.join(wanted, "doc_id", "left_semi").distinct()
    sets = cut_dealt(texts.mapInArrow(_sets(k), "_node bigint, hashes array<bigint>").repartition("_node"))

    labels, tested, step = None, None, 0
    while True:
        here = _placed(members, labels)
        # Later rounds draw another centre for each bucket that still holds more than one component.
        order = F.col("rep") if step == 0 else F.xxhash64("rep", F.lit(step))
        centres = here.groupBy("bucket").agg(F.min("at").alias("x"), F.max("at").alias("y"), F.min_by(F.struct("rep", "n", "at"), F.struct(order, F.col("rep"))).alias("c")).where("x <> y")
        star = (
            here.join(centres.select("bucket", "c"), "bucket").where((F.col("at") != F.col("c.at")) & (F.greatest("n", "c.n") * percent <= F.least("n", "c.n") * 100))
            .groupBy(F.greatest("rep", F.col("c.rep")).alias("a"), F.least("rep", F.col("c.rep")).alias("b"))
            .agg(F.max(F.col("c.rep") > F.col("rep")).alias("turned"), F.min(F.least("at", F.col("c.at"))).alias("low"), F.max(F.greatest("at", F.col("c.at"))).alias("high"))
        )
        # A pair that an earlier round refused is not compared again; one that it confirmed is within a component.
        star = cut(star if tested is None else star.join(tested, ["a", "b"], "left_anti"))
        pairs = star.select("a", "b")
        tested = pairs if tested is None else tested.unionByName(pairs)
        # A row has few centres, so it meets its set where that lies; a centre may have very many rows, so the two sides are dealt anew.
        sided = star.select("low", "high", F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("m"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("c"))
        left = sided.join(sets.select(F.col("_node").alias("m"), F.col("hashes").alias("hm")), "m")
        right = cut(sets.join(sided.select(F.col("c").alias("_node")).distinct(), "_node", "left_semi").select(F.col("_node").alias("c"), F.col("hashes").alias("hc")))
        both = F.size(F.array_intersect("hm", "hc"))
        found = cut(
            left.join(right, "c").select("low", "high", both.alias("both"), (F.size("hm") + F.size("hc")).alias("all"))
            .where(F.col("both") * 100 >= percent * (F.col("all") - F.col("both"))).select(F.col("high").alias("a"), F.col("low").alias("b"))
        )
        links = found.count()
        if links:
            labels = _moved(labels, found)
        # Stars pay while they join components; what they no longer find is left to the blocks, which compare all pairs.
        if links * 20 < star.count() or not links:
            break
        step += 1
    found = cut(_rest(_placed(members, labels), sets, percent, bands, rows, block, block_hashes))
    if not found.isEmpty():
        labels = _moved(labels, found)
    out = signed.join(reps.where("copies > 1").select("d1", "d2", "rep"), ["d1", "d2"], "left")
    out = out.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    if labels is not None:
        out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    else:
        out = out.withColumn("component_id", F.col("rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
