"""SentencePiece encoding and decoding: best segmentation by a Viterbi search over many words at once."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import Words, mix64

MARK = 0x2581
#: A literal mark in a text is no space: it stands outside the pieces and becomes bytes.
LITERAL_MARK = 0x110000
BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN_PENALTY = 10.0
CELLS = 200_000


def load_pieces(model_file: str) -> dict:
    """Pieces, scores and special ids of a SentencePiece file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.get_piece_size()
    kinds = ["byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece" for i in range(n)]
    return {"pieces": [m.id_to_piece(i) for i in range(n)], "scores": [m.get_score(i) for i in range(n)], "kinds": kinds, "unknown": m.unk_id()}


class Viterbi:
    """Encodes words; equal-length words advance together."""

    def __init__(self, model: dict):
        pieces, scores = model["pieces"], np.array(model["scores"], float)
        real = [i for i, k in enumerate(model["kinds"]) if k == "piece"]
        self.floor = scores[real].min() - UNKNOWN_PENALTY
        self.bytes = {int(pieces[i][1:-1], 16): i for i, k in enumerate(model["kinds"]) if k == "byte"}
        self.unknown, self.scores = model["unknown"], scores
        by = defaultdict(list)
        for i in real:
            by[len(pieces[i])].append(i)
        self.longest = max(by)
        with np.errstate(over="ignore"):
            self.powers = BASE ** np.arange(self.longest + 1, dtype=np.uint64)
            self.tables = {}
            for k, ids in by.items():
                codes = np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint64)
                h = mix64(self.prefixes(codes)[:, -1])
                order = np.argsort(h)
                marks = np.zeros(1 << 18, bool)
                marks[h >> np.uint64(46)] = True
                self.tables[k] = (h[order], np.array(ids, np.int32)[order], marks)
        # What a piece stands for when it is decoded.
        self.pieces = pa.array([bytes([int(p[1:-1], 16)]) if k == "byte" else p.replace("▁", " ").encode() if k == "piece" else b"" for p, k in zip(pieces, model["kinds"], strict=True)], pa.binary())

    @staticmethod
    def prefixes(codes: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes: column e is that of the first e characters."""
        h = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                h[:, j + 1] = h[:, j] * BASE + codes[:, j] + np.uint64(1)
        return h

    def probe(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """For each length k the piece at each start, or -1."""
        found = {}
        with np.errstate(over="ignore"):
            for k, (keys, ids, marks) in self.tables.items():
                if k < h.shape[1]:
                    key = mix64(h[:, k:] - h[:, :-k] * self.powers[k])
                    # Few substrings are pieces: the leading bits tell most of the others before any search.
                    maybe = np.nonzero(marks[key >> np.uint64(46)])
                    sought = key[maybe]
                    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
                    found[k] = np.full(key.shape, -1, np.int32)
                    found[k][maybe] = np.where(keys[at] == sought, ids[at], -1)
        return found

    def best(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentation of each row, on end, and their number; -1 - code for a character that no piece covers.

        Of equal sums the one whose last piece is longest wins, at each end.
        """
        n, length = codes.shape
        found = self.probe(self.prefixes(codes.astype(np.uint64)))
        total = np.full((n, length + 1), -np.inf)
        total[:, 0] = 0
        step = np.zeros((n, length + 1), np.int32)
        ident = np.zeros((n, length + 1), np.int64)
        for e in range(1, length + 1):
            starts = [k for k in range(min(self.longest, e), 0, -1) if k in found]
            ids = np.stack([found[k][:, e - k] for k in starts], 1) if starts else np.zeros((n, 0), np.int32)
            value = np.where(ids >= 0, self.scores[ids], -np.inf)
            if not starts or starts[-1] != 1:
                starts, ids, value = [*starts, 1], np.hstack([ids, np.full((n, 1), -1, np.int32)]), np.hstack([value, np.full((n, 1), -np.inf)])
            lone = ids[:, -1] < 0
            value[lone, -1] = self.floor
            value += total[:, [e - k for k in starts]]
            pick = value.argmax(1)
            rows = np.arange(n)
            total[:, e], step[:, e] = value[rows, pick], np.array(starts, np.int32)[pick]
            chosen = ids[rows, pick].astype(np.int64)
            ident[:, e] = np.where(chosen >= 0, chosen, -1 - codes[:, e - 1].astype(np.int64))
        return self.trace(step, ident)

    def best_long(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word: all its substrings are probed at once, then ends advance one by one."""
        found = self.probe(self.prefixes(codes[None].astype(np.uint64)))
        length = len(codes)
        cand: list[list] = [[] for _ in range(length + 1)]
        for k in sorted(found, reverse=True):
            row = found[k][0]
            for s in np.flatnonzero(row >= 0).tolist():
                cand[s + k].append((k, int(row[s])))
        total, step, ident, scores = [0.0] * (length + 1), np.zeros((1, length + 1), np.int32), np.zeros((1, length + 1), np.int64), self.scores.tolist()
        for e in range(1, length + 1):
            top, pick = -np.inf, None
            for k, i in cand[e]:
                if (v := total[e - k] + scores[i]) > top:
                    top, pick = v, (k, i)
            if (not cand[e] or cand[e][-1][0] != 1) and (v := total[e - 1] + self.floor) > top:
                top, pick = v, (1, -1 - int(codes[e - 1]))
            total[e], (step[0, e], ident[0, e]) = top, pick
        return self.trace(step, ident)

    @staticmethod
    def trace(step: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = step.shape
        back = np.zeros((n, width - 1), np.int64)
        at, used, rows = np.full(n, width - 1), np.zeros(n, np.int64), np.arange(n)
        while len(rows):
            back[rows, used[rows]] = ident[rows, at[rows]]
            used[rows] += 1
            at[rows] -= step[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return back[:, ::-1][(np.arange(width - 1) < used[:, None])[:, ::-1]], used

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as packed 32-bit integers."""
        groups = defaultdict(list)
        for i, w in enumerate(words):
            groups[len(w)].append(i)
        out: list = [b""] * len(words)
        for length, rows in groups.items():
            if not length:
                continue
            for lo in range(0, len(rows), max(1, CELLS // length)):
                part = rows[lo : lo + max(1, CELLS // length)]
                codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                codes = np.where(codes == MARK, np.uint32(LITERAL_MARK), np.where(codes == 32, np.uint32(MARK), codes))
                for rows_of, (ids, used) in [([i], self.best_long(c)) for i, c in zip(part, codes, strict=True)] if length > 64 else [(part, self.best(codes))]:
                    for i, packed in zip(rows_of, self.pack(ids, used), strict=True):
                        out[i] = packed
        return out

    def pack(self, ids: np.ndarray, used: np.ndarray) -> list[bytes]:
        """The ids of each word as bytes; only words with a character that no piece covers are gone through one by one."""
        raw, ends = ids.astype(np.int32).tobytes(), np.cumsum(used)
        out = [raw[a:b] for a, b in zip((4 * (ends - used)).tolist(), (4 * ends).tolist(), strict=True)]
        for w in np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), "right")).tolist():
            own = ids[ends[w] - used[w] : ends[w]].tolist()
            out[w] = np.array([x for i in own for x in ([i] if i >= 0 else self.fallback(-1 - i))], np.int32).tobytes()
        return out

    def fallback(self, code: int) -> list[int]:
        raw = chr(MARK if code == LITERAL_MARK else code).encode()
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_all(self, ids: pa.ListArray) -> list[str | None]:
        """The text of each list of ids; null for null."""
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.pieces.take(ids.flatten()), mask=ids.is_null()), b"")
        texts = [None if raw is None else raw.decode("utf-8", "replace") for raw in joined.to_pylist()]
        return [t[1:] if t and t[0] == " " else t for t in texts]


WORD = r" +[^ ]*"


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(_column(batch, n) for n in names), values], [*names, name])


def _encode(model: dict, text_col: str, to: str, rows: int):
    def run(batches):
        viterbi = Viterbi(model)
        find, memo = re.compile(WORD).findall, Words(viterbi.words, 200_000)
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                out = []
                words = [find(" " + t) if t else [] for t in _column(batch, text_col).to_pylist()]
                memo.ensure(w for ws in words for w in ws)
                out = [b"".join(map(memo.__getitem__, ws)) for ws in words]
                ends = np.cumsum([0] + [len(x) // 4 for x in out])
                values = pa.array(np.frombuffer(b"".join(out), np.int32))
                yield _with(batch, to, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))

    return run


def encode(docs: DataFrame, model_file: str, text_col: str = "text", to: str = "pieces") -> DataFrame:
    """All columns of ``docs`` and the ids of the best segmentation as ``to`` (array of int; it replaces a column of that name).

    The model's scores are summed and the largest sum wins; spaces become the word mark, one is put before the text,
    and pieces never cross from a word into the next one's mark, so words are searched once each and their ids joined.  Characters without
    a piece become byte pieces.  Null and empty texts have no pieces; any text is decoded to itself.  Repeated rows
    and null ids pass through; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c != to]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{to}` array<int>"])
    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(_encode(load_pieces(model_file), text_col, to, 300), schema)


def _decode(model: dict, ids_col: str, to: str):
    def run(batches):
        viterbi = Viterbi(model)
        for batch in (whole.slice(lo, 300) for whole in batches for lo in range(0, whole.num_rows, 300)):
            yield _with(batch, to, pa.array(viterbi.decode_all(_column(batch, ids_col)), pa.string()))

    return run


def decode(pieces: DataFrame, model_file: str, ids_col: str = "pieces", to: str = "decoded") -> DataFrame:
    """All columns and the text of the ids as ``to``; null ids give a null text, no ids an empty one."""
    kept = [c for c in pieces.columns if c != to]
    schema = ", ".join([*(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept), f"`{to}` string"])
    return pieces.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(_decode(load_pieces(model_file), ids_col, to), schema)
