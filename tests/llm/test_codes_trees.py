"""Vector codes against a plain search in Python integers, reply trees against enumeration."""

import hashlib
import math

import numpy as np
import pytest

from pyspark.sql import functions as F
from veilspark.llm import replytrees, veccodes

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error bigint, _key int, v int"


def plain_codes(rows, parts, entries, rounds, scale):
    """Row index -> code and error, and the codebooks, all in Python integers."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max([len(r[1]) for r in rows if r[1] is not None], default=0) // parts))
    ints = {i: [math.floor(float(np.float32(x)) * scale) for x in r[1]] + [0] * (parts * width - len(r[1])) for i, r in kept}
    first = sorted(kept, key=lambda t: (t[1][0] is None, t[1][0] or 0, ints[t[0]]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[i], p) for i, _ in first] for p in range(parts)]

    def best(w, book):
        return min((sum((a - b) ** 2 for a, b in zip(w, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for i, _r in kept:
                groups.setdefault(best(cut(ints[i], p), book)[1], []).append(cut(ints[i], p))
            for k, members in groups.items():
                book[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = {i: [best(cut(ints[i], p), books[p]) for p in range(parts)] for i, _ in kept}
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}, books


@pytest.mark.parametrize("parts,entries,dim", [(4, 8, 12), (16, 64, 64), (3, 5, 7)])
def test_codes(spark, rng, parts, entries, dim):
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([None, 1, 2]), "x", 1, 1, 1) for i in rng.sample(range(1000), 250)]
    rows += [(5000, rows[0][1], 1, "x", 1, 1, 1)] * 3 + [(5001, None, 1, "", 1, 1, 1), (5002, [0.1, None], 1, "", 1, 1, 1), (5003, [float("nan")] * dim, 1, "", 1, 1, 1), (5004, [float("inf")] * dim, 1, "", 1, 1, 1)]
    rows += [(None, rows[1][1], None, "", 1, 1, 1), (6000, [], 1, "", 1, 1, 1), (6001, [-0.25], 2, "", 1, 1, 1)]
    want, books = plain_codes(rows, parts, entries, 2, 256)
    sums = {}
    for i, (_, e) in want.items():
        sums[rows[i][2]] = sums.get(rows[i][2], 0) + e
    got = veccodes.compress(spark.createDataFrame(rows, VECTORS).repartition(5), parts=parts, entries=entries).collect()
    assert sorted((str(rows[i][0]), str(rows[i][2]), *want[i], sums[rows[i][2]]) for i in want) == sorted((str(r.vec_id), str(r.label), r.code, r.error, r.label_error) for r in got)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


def test_search_measures_few_entries_and_breaks_ties_to_the_lower_index():
    entries = np.array([[0, 0], [10, 0], [10, 0], [0, 10], [40, 40], [41, 40]])
    search = veccodes.Orchard(entries)
    points = np.array([[5, 0], [5, 5], [10, 0], [40, 40], [-3, -3], [100, 100]])
    best, dist = search.nearest(points)
    want = [min((int(((p - e) ** 2).sum()), k) for k, e in enumerate(entries)) for p in points]
    assert list(zip(dist.tolist(), best.tolist(), strict=True)) == want
    measured = []
    plain = search._measure
    search._measure = lambda p, w: measured.append(len(p)) or plain(p, w)
    grid = np.random.default_rng(3).integers(-500, 500, (64, 2))
    search.__init__(grid)
    search.nearest(grid[:50] + 1)
    assert sum(measured) < 50 * 32


def test_codes_of_odd_tables(spark):
    assert veccodes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert veccodes.compress(spark.createDataFrame([(1, None, 1, "", 1, 1, 1)], VECTORS)).count() == 0
    huge = veccodes.compress(spark.createDataFrame([(1, [3e38] * 16, 1, "", 1, 1, 1), (2, [-3e38] * 16, 1, "", 1, 1, 1)], VECTORS), entries=1).collect()
    assert all(r.error >= 0 for r in huge) and len(huge) == 2


def test_codes_are_restored(spark):
    rows = [(i, [i / 4.0, -i / 8.0], 1, "", 1, 1, 1) for i in range(5)]
    df = spark.createDataFrame(rows, VECTORS)
    books = veccodes.train(df, parts=2, entries=8)
    back = {r.vec_id: r.restored for r in veccodes.decode(veccodes.encode(df, books), books).collect()}
    assert back == {i: [i / 4.0, -i / 8.0] for i in range(5)}


NODES = "conv_id bigint, node string, parent string, role string, text string, score double, tree string, leaf int, formatted string, turns int"


def nodes_frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "f", 1) for r in rows], NODES)


def plain_branches(rows):
    """All branches of each tree from best to worst: mean score, length, leaf."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == c}
        inner = {r[2] for r in mine.values() if r[2] in mine}
        for leaf in set(mine) - inner:
            path, at = [], leaf
            while at in mine and at not in path:
                path.append(at)
                at = mine[at][2]
            if at in path:
                continue
            out.setdefault(c, []).append((-sum(mine[x][5] or 0 for x in path) / len(path), -len(path), leaf, path[::-1]))
        out.get(c, []).sort()
    return out


def test_best_branches_of_random_trees(spark, rng):
    rows = []
    for c in range(12):
        for i in range(rng.choice([1, 2, 9, 40])):
            rows.append((c, f"n{i:03}", None if i == 0 or rng.random() < 0.05 else f"n{rng.randrange(max(0, i - 6), i):03}", rng.choice(["user", "assistant"]), f"text {c} {i}", float(rng.randrange(4))))
    rows += [(c, f"n{i:03}", f"n{i - 1:03}", "user", f"deep {i}", 1.0) for c in (20,) for i in range(300)]
    rows += [(21, "a", "b", "user", "circle", 1.0), (21, "b", "a", "user", "circle", 1.0), (21, "c", "a", "user", "hangs on it", 1.0), (21, "d", "gone", "user", "orphan", 0.0)]
    want = plain_branches(rows)
    texts = {(r[0], r[1]): (r[3], r[4]) for r in rows}
    got = replytrees.format_trees(nodes_frame(spark, rows).repartition(7), branches=3).collect()
    assert sorted((r.conv_id, r["rank"], replytrees.parse(r.formatted)) for r in got) == sorted((c, k + 1, [texts[c, n] for n in b[3]]) for c, bs in want.items() for k, b in enumerate(bs[:3]))
    for r in got:
        spans = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert spans == [replytrees.unescape(t) for role, t in replytrees.parse(r.formatted) if role == "assistant"]


def test_control_strings_come_back(spark, rng):
    atoms = ["<", "[", "\\", "/", "s>", "INST]", "|", "<s>", "</s>", "\n", "[/INST]", "<|user\n", "<think>", "a", "é𝄞", "", "</s>\n"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "x" * 200_000, "</s>" * 5000]
    roles = ["assistant", "user", "a b\n<|%+", None]
    rows = [(i // 6, i % 6, rng.choice(roles), t) for i, t in enumerate(texts)]
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = replytrees.format_trees(replytrees.chains(talks)).collect()
    for r in out:
        mine = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert replytrees.parse(r.formatted) == mine and r.n_turns == len(mine)
        assert "".join(replytrees.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans) == "".join(t for role, t in mine if role == "assistant")
        assert r.formatted.count("</s>") == len(mine) and "[INST]" not in r.formatted and r.formatted.count("<|") == len(mine)
    read = replytrees.read_turns(replytrees.format_trees(replytrees.chains(talks))).collect()
    assert sorted((r.conv_id, r.formatted_chars) for r in read) == sorted((r.conv_id, len(r.formatted)) for r in out)


def test_odd_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, node string, score string"
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, None, None), (None, 0, "user", "q"), (None, 0, "user", "q")]
    got = replytrees.read_turns(replytrees.format_trees(replytrees.chains(spark.createDataFrame([(*r, "n", "s") for r in rows], schema)))).collect()
    assert sorted((str(r.conv_id), r.n_turns) for r in got) == [("1", 4), ("None", 1), ("None", 1)]
    assert replytrees.format_trees(replytrees.chains(spark.createDataFrame([], schema))).count() == 0
    twice = [(1, "a", None, "user", "q", 0.0), (1, "b", "a", "assistant", "worse", 1.0), (1, "b", "a", "assistant", "better", 2.0), (1, "b", "a", "assistant", "better", 2.0), (1, None, "a", "user", "alone", 5.0)]
    got = sorted(replytrees.parse(r.formatted) for r in replytrees.format_trees(nodes_frame(spark, twice)).select(F.col("formatted")).collect())
    assert got == [[("user", "alone")], [("user", "q"), ("assistant", "better")]]
