"""Toxicity by a subsequence string kernel: a support vector machine on Nyström features of words.

The kernel of two strings sums over all triples of characters that occur in order in both, within ``SPAN`` places, each
weighted by ``DECAY`` to the power of its spread; it is normalised to 1 for equal strings.  So an inserted or missing character
changes an insult's value little.  The landmarks' feature map is linear in those triples, so the trained machine is also a
table with one weight per triple, which scores a word without meeting the landmarks again.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import Words, cut

ORDER, SPAN, DECAY = 3, 6, 0.6
SIZE = 64
BEGIN = 37
#: Bits that number the triples of one piece: at most 10 for each of 25 first characters.
SHIFT = 9
LONGEST = 24
SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
EDGE = " \t\n\r.,;:!?\"'()[]{}<>|/\\*_~`=+-–—…«»„“”‘’"
# Signs that are read as letters within a word.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
LETTER_SIGNS = str.maketrans({k: v for k, v in LOOKS_LIKE.items() if not k.isalnum()})


def _alphabet() -> np.ndarray:
    """Codes of characters: 0 is a gap, letters a-z have their own, other letters share what is left."""
    table = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if "a" <= ch <= "z":
            table[c] = c - 96
        elif ch in LOOKS_LIKE:
            table[c] = ord(LOOKS_LIKE[ch]) - 96
        elif ch.isdigit():
            table[c] = 27 + int(ch) if ch.isascii() else 36
        elif ch.isalpha():
            table[c] = 38 + c % 26
    return table


class Kernel:
    """Triples of words, for many words of one length at once."""

    def __init__(self):
        self.table = _alphabet()
        self.plans: dict = {}

    def plan(self, length: int):
        if length not in self.plans:
            at = [c for c in itertools.combinations(range(length), ORDER) if c[-1] - c[0] < SPAN]
            at = np.array(at, np.int64).reshape(-1, ORDER)
            self.plans[length] = at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32) if len(at) else np.zeros(0, np.float32)
        return self.plans[length]

    def codes(self, words: list[str]) -> np.ndarray:
        """Codes of words of one length, after a mark for the beginning."""
        u = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        c = np.where(u < len(self.table), self.table[np.minimum(u, len(self.table) - 1)], (38 + u % 26).astype(np.uint8))
        return np.hstack([np.full((len(words), 1), BEGIN, np.uint8), c])

    def triples(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the triples of each row, and their weights scaled to a row of norm 1."""
        at, weight = self.plan(codes.shape[1])
        n, m = len(codes), len(at)
        if not m:
            return np.zeros((n, 0), np.int32), np.zeros((n, 0), np.float32)
        c = codes.astype(np.int32).T
        packed = np.empty((m, n), np.int32)  # key and, in the low bits, which triple it is
        for i, (x, y, z) in enumerate(at):
            packed[i] = (((c[x] * SIZE + c[y]) * SIZE + c[z]) << SHIFT) | i
        if (codes == 0).any():
            for i, places in enumerate(at):
                packed[i][(c[places] == 0).any(0)] = -1  # a gap is part of no triple
        packed = np.sort(packed.T, axis=1)
        value = np.append(weight, np.float32(0))[np.where(packed < 0, m, packed & ((1 << SHIFT) - 1))]
        key = np.maximum(packed, 0) >> SHIFT
        new = np.ones(key.shape, bool)
        new[:, 1:] = key[:, 1:] != key[:, :-1]
        starts = np.flatnonzero(new.ravel())
        sums = np.add.reduceat(value.ravel(), starts)  # equal triples of a row count together
        norm = np.sqrt(np.bincount(starts // m, sums * sums, n))
        return key, value / np.maximum(norm, 1e-12)[:, None].astype(np.float32)

    def pieces(self, words: list[str]) -> dict[int, tuple[list[str], list[int]]]:
        """Words by length; a long one is cut into overlapping pieces."""
        by: dict = defaultdict(lambda: ([], []))
        for i, w in enumerate(words):
            w = plain(w)
            if 2 <= len(w) <= LONGEST:
                group = by[len(w)]
                group[0].append(w)
                group[1].append(i)
                continue
            for lo in range(0, max(1, len(w) - LONGEST // 2), LONGEST // 2):
                p = w[lo : lo + LONGEST]
                if len(p) >= 2:
                    by[len(p)][0].append(p)
                    by[len(p)][1].append(i)
        return by

    def rows(self, words: list[str]):
        """``(index of the word, keys, values)`` in chunks; a long word comes in several pieces."""
        for pieces, at in self.pieces(words).values():
            for lo in range(0, len(pieces), 4000):
                yield np.array(at[lo : lo + 4000]), *self.triples(self.codes(pieces[lo : lo + 4000]))

    def dense(self, words: list[str], columns: np.ndarray) -> np.ndarray:
        """Feature rows over the chosen triples; of a long word the first piece."""
        place = np.full(SIZE**ORDER, -1)
        place[columns] = np.arange(len(columns))
        out = np.zeros((len(words), len(columns) + 1), np.float32)
        done = np.zeros(len(words), bool)
        for at, key, value in self.rows(words):
            first = ~done[at]
            done[at] = True
            r = np.repeat(at[first], key.shape[1])
            np.add.at(out, (r, place[key[first]].ravel()), value[first].ravel())
        return out[:, :-1]


def plain(word: str) -> str:
    """A word without the signs around it and between its letters."""
    word = word.strip(EDGE)
    if word.isalnum():
        return word
    return "".join(filter(str.isalnum, word.translate(LETTER_SIGNS)))


def units(text: str) -> list[str]:
    """Words in lower case, and runs of spaced single characters as one word."""
    low = text.lower()
    out = low.split()
    if any(len(w) == 1 for w in out):
        out += [m[0].replace(" ", "") for m in SPACED.finditer(low)]
    return out


class Machine:
    """The trained scorer: weight per triple, bias, and the calibration of a document's largest value."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weight, self.bias, self.slope, self.shift = weight, bias, slope, shift

    def values(self, words: list[str], kernel: Kernel) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for at, key, value in kernel.rows(words):
            np.maximum.at(out, at, np.einsum("ij,ij->i", self.weight[key], value).astype(float) + self.bias)
        return out

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -500, 500)))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 30) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on the rows within the margin; the last entry is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        on = y * (x @ w) < 1
        a = x[on] * (c * weight[on])[:, None]
        new = np.linalg.solve(ridge + a.T @ x[on], a.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def train(positive: dict[str, float], negative: list[str], landmarks: int, kernel: Kernel, seed: int) -> Machine:
    """Nyström features from landmarks of both sides, then the linear machine, folded into one weight per triple."""
    rng = np.random.default_rng(seed)
    half = landmarks // 2
    weights, positive = np.array(list(positive.values())), list(positive)
    marks = positive[:half] + [negative[i] for i in rng.permutation(len(negative))[:half]]
    columns = np.unique(np.concatenate([k[v > 0] for _, k, v in kernel.rows(marks)] or [np.zeros(0, np.int32)]))
    z = kernel.dense(marks, columns).astype(float)
    vals, vecs = np.linalg.eigh(z @ z.T)
    keep = vals > 1e-6 * max(vals.max(), 1e-12)
    root = vecs[:, keep] / np.sqrt(vals[keep])
    words = positive + negative
    feats = np.vstack([kernel.dense(words[lo : lo + 2000], columns).astype(float) @ z.T @ root for lo in range(0, len(words), 2000)])
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    w = svm(feats, y, np.concatenate([weights, np.ones(len(negative))]))
    weight = np.zeros(SIZE**ORDER, np.float32)
    weight[columns] = z.T @ (root @ w[:-1])
    return Machine(weight, float(w[-1]))


def calibrate(top: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, towards softened targets so that clean separation stays finite."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(toxic, np.sqrt(len(toxic) / (2 * max(n1, 1))), np.sqrt(len(toxic) / (2 * max(n0, 1))))
    x = np.stack([top, np.ones(len(top))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (weight * (p - target)) + 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(w[0], 1e-6)), float(w[1])


def _unit_counts():
    schema = pa.schema([("unit", pa.string()), ("p", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({w for u in units(text or "") if 2 <= len(w := plain(u)) <= LONGEST})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][w] for w in names], pa.int64()), pa.array([counts[0][w] for w in names], pa.int64())], schema=schema)

    return run


def _top(machine: Machine, with_unit: bool):
    """Largest value of each text's words, and the word that has it."""

    def run(batches):
        kernel = Kernel()
        memo = Words(lambda words: machine.values(words, kernel).tolist(), 250_000)
        # A few texts at a time: their words as objects take many times the text's size.
        for batch in (whole.slice(lo, 500) for whole in batches for lo in range(0, whole.num_rows, 500)):
            texts = [units(t) if t else [] for t in batch.column(1).to_pylist()]
            memo.ensure(w for ws in texts for w in ws)
            top = [max(map(memo.__getitem__, ws), default=machine.bias) for ws in texts]
            if with_unit:
                unit = [plain(max(ws, key=memo.__getitem__, default=""))[:LONGEST] for ws in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.float64()), pa.array(unit, pa.string())], ["toxic", "top", "unit"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.float64()), pa.array(machine.probability(np.array(top, float)))], ["doc_id", "top", "score"])

    return run


def witnesses(ratio: dict[str, float], texts: list[set[str]], least: int) -> dict[str, float]:
    """Words that account for the toxic texts, each with a weight.

    The word that explains most texts is taken first and its texts are set aside, so that other words of the same texts
    gain nothing from them; then all words that at least ``least`` texts hold are added.  Words that are left with
    one text count only if hardly anything explains more.
    """
    whole = Counter(w for t in texts for w in t)
    left, by = Counter(whole), defaultdict(list)
    for i, t in enumerate(texts):
        for w in t:
            by[w].append(i)
    open_, out = set(range(len(texts))), {}
    while open_ and left:
        word = max(left, key=lambda w: (left[w] * ratio[w], w))
        n = left.pop(word)
        if n < 1 or (n < 2 and len(out) >= 20):
            break
        out[word] = whole[word]
        for i in by[word]:
            if i in open_:
                open_.discard(i)
                for w in texts[i]:
                    if w in left:
                        left[w] -= 1
    out |= {w: n for w, n in whole.items() if n >= least}
    return {w: 1 + float(np.log(n)) for w, n in sorted(out.items(), key=lambda x: (-x[1], x[0]))}


def inserted(word: str, seed: int, times: int = 2) -> list[str]:
    """Variants of a word with a letter put in between, which the machine is to take for the word."""
    if len(word) < 5:
        return []
    draw = [xxhash.xxh32_intdigest(word, seed + i) for i in range(times)]
    return [word[: (at := 1 + d % (len(word) - 1))] + chr(97 + d // 64 % 26) + word[at:] for d in draw]


def _held(words: set[str]):
    """The wanted words that a text holds, and the least hash of its word triples, which copies of a text share."""

    def run(batches):
        for batch in batches:
            found, marks = [], []
            for text in batch.column(0).to_pylist():
                us = units(text or "")
                found.append(sorted({w for u in us if (w := plain(u)) in words}))
                marks.append(min(xxhash.xxh64_intdigest(" ".join(us[i : i + 3])) >> 1 for i in range(max(1, len(us) - 2))))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), pa.array(marks, pa.int64())], ["units", "mark"])

    return run


def fold(id_col: str = "doc_id"):
    """Remainder of the id's CRC-32 by three; remainder 1 is held out."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3


def fit(docs: DataFrame, labels: DataFrame, positives: int = 3000, negatives: int = 6000, words: int = 3000, landmarks: int = 256, rounds: int = 2, seed: int = 3,
        id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Learns from labelled texts outside the held-out fold.

    At most ``positives`` and ``negatives`` labelled ids are taken, in the order of a hash of the id.  A text's label holds for
    some of its words, so the positives are words that toxic texts hold far more often than others and that together
    account for them; negatives are words of clean texts, and each round adds the strongest word of every clean text.
    At most ``words`` words of each kind reach the driver.  A row that is labelled both ways, without a
    label, or without text is not learned from.
    """
    lab = labels.where(F.col("toxic").isin(0, 1)).where(fold() != 1).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = lab.where("toxic = 1").orderBy(*order).limit(positives).unionByName(lab.where("toxic = 0").orderBy(*order).limit(negatives))
    # Bounded by the two limits.
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    sample = cut(texts.join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    constant = Machine(np.zeros(SIZE**ORDER, np.float32), 0.0, 0.0, float(np.log((n1 + 1) / (n0 + 9))))
    if not n1 or not n0:
        return constant
    stats = cut(sample.mapInArrow(_unit_counts(), "unit string, p bigint, n bigint").groupBy("unit").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    ratio = F.log(((F.col("p") + 0.1) / n1) / ((F.col("n") + 0.1) / n0))
    scored = stats.where("p > 0").withColumn("ratio", ratio).withColumn("gain", F.col("p") * F.col("ratio"))
    found = {r.unit: (r.p, r.ratio) for r in scored.where("ratio > 2").orderBy(F.desc("gain"), "unit").limit(words).collect()}
    common = stats.where("n > 0").where(ratio < 1)
    negative = [r.unit for r in common.orderBy(F.desc("n"), "unit").limit(words).collect()] + [r.unit for r in common.orderBy(F.xxhash64("unit"), "unit").limit(words).collect()]
    held = sample.where("toxic = 1").mapInArrow(_held(set(found)), "units array<string>, mark bigint").limit(4 * positives).collect()
    copies = {r.mark: set(r.units) for r in sorted(held, key=lambda r: (r.mark, r.units))}  # copies count once
    positive = witnesses({w: r for w, (_, r) in found.items()}, list(copies.values()), max(4, n1 // 100))
    if not positive or not negative:
        return constant
    positive |= {v: 0.25 * w for u, w in positive.items() for v in inserted(u, seed) if v not in found}
    kernel, hard = Kernel(), []
    machine = train(positive, negative, landmarks, kernel, seed)
    for step in range(rounds + 1):
        rows = sample.select("toxic", "text").mapInArrow(_top(machine, True), "toxic int, top double, unit string").limit(4 * (positives + negatives)).collect()
        value, toxic = np.array([r.top for r in rows]), np.array([r.toxic == 1 for r in rows])
        if step == rounds:
            machine.slope, machine.shift = calibrate(value, toxic)
            break
        hard = list(dict.fromkeys(hard + sorted({r.unit for r in rows if not r.toxic and r.unit} - positive.keys())))
        machine = train(positive, list(dict.fromkeys(negative + hard)), landmarks, kernel, seed)
    return machine


def score_toxicity(docs: DataFrame, machine: Machine, cut_at: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, top, score, predicted, held_out`` of each whole text.

    The score is that of the text's most toxic word.  Null and empty texts and texts without letters get the score of a word unlike any;
    repeated rows give repeated rows; a null id is not held out.  Other columns are not read; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_top(machine, False), "doc_id bigint, top double, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut_at).cast("int")).withColumn("held_out", F.coalesce(fold() == 1, F.lit(False)))
