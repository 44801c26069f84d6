"""Near duplicates of texts and vectors against brute force."""

import numpy as np
import pytest

from veilspark.llm import capfilter, graph, minhash
from veilspark.llm.common import cut_dealt


def closure(nodes, links):
    low = {n: n for n in nodes}
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def shingle_sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs_frame, rng, k):
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            other = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other[: len(other) - rng.randrange(2)]))
    texts += ["", None, " \t\n", "one", "ONE", "one two", "Ünd é", "ünd é", "x " * 20000, "x y z", "x y z"]
    rows = list(enumerate(texts))
    sets = {i: shingle_sets(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_frame(rows), k=k).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


@pytest.mark.parametrize("block", [512, 100])
def test_near_duplicates_in_a_family_of_alike_texts(docs_frame, rng, block):
    """Texts that share a long passage, about 0.68 alike, hide pairs of 0.87; no text of the family but those is linked."""
    passage = [f"p{i}" for i in range(140)]
    tails = [[f"t{i}_{j}" for j in range(30)] for i in range(1000)]
    order = rng.sample(range(1000), 40)
    for a, b in zip(order[:20], order[20:], strict=True):
        tails[b] = tails[a][:24] + tails[b][24:]
    rows = [(i, " ".join(passage + t)) for i, t in enumerate(tails)]
    want = closure(range(1000), list(zip(order[:20], order[20:], strict=True)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_frame(rows), k=4, block=block).collect()}
    assert got == want


def test_near_duplicates_odd_rows(docs_frame):
    assert minhash.near_duplicates(docs_frame([])).count() == 0
    rows = minhash.near_duplicates(docs_frame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "A b c")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("5", "5", True), ("5", "5", True), ("7", "5", False), ("None", "None", True)]


def test_signature_of_small_sets_agrees():
    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64))
    same = np.mean([(minhash.signature(a, 128) == minhash.signature(a[np.arange(40) != i], 128)).mean() for i in range(40)])
    assert same > 0.95


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {k: v for k, v in closure(nodes | {30}, edges).items() if k in nodes}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("block", [256, 5])
def test_cap_links(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(64)
        for j in range(int(rng.integers(1, 12))):
            rows.append((centre + (0 if j < 2 else 0.28) * np.linalg.norm(centre) / 8 * rng.standard_normal(64), int(c % 3)))
    data = [(i, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    n = len(data)
    extra = [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, [1.0, None], 1), (n + 4, data[0][1], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1),
             (n + 7, [2.0, 4.0], 1), (None, data[0][1], 0), (n + 8, [1e300] * 3, 2), (n + 9, [1e-300] * 3, 2)]
    frame = spark.createDataFrame([(*r, "x", 3) for r in data + extra], "vec_id bigint, embedding array<double>, label int, rep string, filter int")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in data}
    label = {i: lab for i, _, lab in data}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    links += [(n + 6, n + 7), (n + 8, n + 9)]
    ids = [r[0] for r in data + extra if r[0] is not None]
    want, degree = closure(ids, links), {i: sum(i in e for e in links) for i in ids}
    got = {r.vec_id: r for r in capfilter.cap_links(frame, block=block).collect()}
    assert got[None].n_links == 0 and got[None].kept
    missed = [i for i in ids if (got[i].n_links, got[i].component_id) != (degree[i], want[i])]
    assert not missed
    assert capfilter.cap_links(frame.limit(0)).count() == 0


def test_cap_links_of_short_vectors(spark):
    rng = np.random.default_rng(8)
    data = []
    for dim in (4, 16, 32):
        for _ in range(20):
            centre = rng.standard_normal(dim)
            data += [centre + 0.25 * rng.standard_normal(dim) for _ in range(3)]
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>, label int")
    near = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93
    links = [(i, j) for i in range(len(data)) for j in range(i) if near(data[i], data[j])]
    want = closure(range(len(data)), links)
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilter.cap_links(frame, block=16).collect()}
    assert got == {i: (sum(i in e for e in links), want[i]) for i in want}


def test_cap_recall_at_the_threshold():
    """Pairs of a cosine just above the threshold share a filter."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((600, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.931 * x + np.sqrt(1 - 0.931**2) * y
    code = capfilter.ProductCode(64, 4096, 0.54, 6, 7)
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(z), strict=True)]
    assert np.mean(met) >= 0.998, np.mean(met)


def test_cut_dealt_keeps_how_rows_lie(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    held = cut_dealt(spark.range(100).selectExpr("id % 7 AS k", "id").repartition("k"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    counts = held.groupBy("k").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sum(r["count"] for r in counts.collect()) == 100
