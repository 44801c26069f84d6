"""Phrase collocations: every n-gram by its Rabin-Karp fingerprint, only frequent phrases as text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import cut, mix64

#: Characters that end a piece of text; spaces and tabs end words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
GAP, END = np.uint8(0x20), np.uint8(0x0A)
_BREAKS = np.zeros(256, np.uint8)
_BREAKS[[0x20, 0x09]] = 1
_BREAKS[list(PIECE_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Entries of n-grams: fingerprint, second fingerprint, count, key of a text that holds the n-gram.
ENTRY = np.dtype([("print", "<u8"), ("check", "<u4"), ("n", "<u4"), ("key", "<i8")])
#: Bytes of a fingerprint where only its count matters, and of the key of a text; what shares them is told apart later.
SHORT, KEY_BYTES = 6, 5


def _planes(x: np.ndarray, size: int) -> bytes:
    """The ``size`` low bytes of unsigned numbers, byte by byte: planes of zeros vanish in the shuffle's compression."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unplanes(raw: np.ndarray, size: int, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :size] = raw.reshape(size, count).T
    return out.view("<u8")[:, 0]


def _pack(sorted_prints: np.ndarray, n: np.ndarray, *columns: tuple[np.ndarray, int]) -> bytes:
    """Fingerprints as steps from one to the next, then the other columns, in planes."""
    steps = np.diff(sorted_prints, prepend=np.uint64(0))
    return _planes(steps, 8) + _planes(n, 4) + b"".join(_planes(c, size) for c, size in columns)


def _unpack(packed, *sizes: int) -> list[np.ndarray]:
    raw = np.frombuffer(packed.as_buffer(), np.uint8)
    widths = (8, 4, *sizes)
    count = len(raw) // sum(widths)
    at = np.cumsum((0, *widths)) * count
    out = [_unplanes(raw[a:b], w, count) for a, b, w in zip(at, at[1:], widths)]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _parts(prints: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Edges of the parts in sorted fingerprints of ``bits`` bits: equal ranges of a power of two of parts."""
    step = np.uint64(bits - (parts.bit_length() - 1))
    return np.searchsorted(prints >> step if parts > 1 else np.zeros(len(prints), np.uint64), np.arange(parts + 1).astype(np.uint64))


class Prints:
    """Fingerprints of all n-grams of a block from prefix sums of two polynomials modulo 2^64.

    A base is odd, so it has an inverse: the sum over a span times the inverse power of its start depends on the span's bytes alone.
    ``bits`` keeps so many bits of the first fingerprint, so that tests meet collisions.
    """

    def __init__(self, longest: int, bits: int = 64, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.longest, self.drop = longest, np.uint64(64 - bits)
        self.values = rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bases = [int(b) | 1 for b in rng.integers(1 << 61, 1 << 63, 2, dtype=np.uint64)]
        self.powers = self.inverse = np.zeros((2, 0), np.uint64)

    def _grow(self, size: int) -> None:
        if self.powers.shape[1] < size:
            def series(base):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                return np.cumprod(steps)

            self.powers = np.stack([series(b) for b in self.bases])
            self.inverse = np.stack([series(pow(b, -1, 1 << 64)) for b in self.bases])

    def words(self, raw: np.ndarray):
        """The block with one byte between words, and each word's start and end there, its place in the block and its piece."""
        kind = _BREAKS[raw]
        word = kind == 0
        begins = np.empty(len(raw), bool)
        begins[:1] = True
        begins[1:] = word[1:] != word[:-1]
        gap_at = np.flatnonzero(begins & ~word)
        ends = np.cumsum(kind == 2)
        keep = word | (begins & ~word)
        text = _LOWER[raw]
        if len(gap_at):
            run_end = np.append(np.flatnonzero(begins), len(raw))
            run_end = run_end[np.searchsorted(run_end, gap_at, side="right")]
            closes = ends[run_end - 1] - ends[gap_at] + (kind[gap_at] == 2) > 0
            text[gap_at] = np.where(closes, END, GAP)
        place = np.flatnonzero(keep)
        text, word = text[place], word[place]
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.cumsum(text == END)[start]
        return text, start, stop, place[start], piece

    def sums(self, text: np.ndarray) -> list[np.ndarray]:
        self._grow(len(text) + 1)
        out = []
        for values, powers in zip(self.values, self.powers, strict=True):
            s = np.zeros(len(text) + 1, np.uint64)
            np.cumsum(values[text] * powers[: len(text)], out=s[1:])
            out.append(s)
        return out

    def spans(self, sums: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First (64 bits) and second fingerprint (32 bits) of the bytes from ``start`` to ``stop``."""
        a, b = ((s[stop] - s[start]) * inv[start] for s, inv in zip(sums, self.inverse, strict=True))
        return mix64(a) >> self.drop, (mix64(b) >> np.uint64(32)).astype(np.uint32)

    def ngrams(self, raw: np.ndarray, own: int, often=None):
        """For each n: text, place, span and fingerprints of all n-grams that begin before byte ``own`` and lie in one piece.

        ``often`` tells by fingerprint which words and pairs may be frequent; then only n-grams made of such are given.
        """
        text, start, stop, place, piece = self.words(raw)
        sums = self.sums(text)
        count = int(np.searchsorted(place, own))
        good = None
        for n in range(1, self.longest + 1):
            first = np.arange(max(0, len(start) - n + 1))
            first = first[piece[first] == piece[first + n - 1]]
            if good is not None:
                first = first[good[first] & good[first + 1]]
            fp, check = self.spans(sums, start[first], stop[first + n - 1])
            if often is not None:
                keep = often(fp >> np.uint64(64 - 8 * SHORT)) if n <= 2 else np.ones(len(fp), bool)
                first, fp, check = first[keep], fp[keep], check[keep]
                # What a longer n-gram begins and goes on with.
                good = np.zeros(len(start), bool)
                good[first] = True
            mine = first < count
            first, fp, check = first[mine], fp[mine], check[mine]
            yield n, text, place[first], start[first], stop[first + n - 1], fp, check


def segments(raw: bytes, size: int, longest: int):
    """Cuts a long text: pieces of about ``size`` bytes, each with the words that n-grams need beyond its own end."""
    words = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % (longest - 1))
    brk = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
    at = 0
    while len(raw) - at > size:
        found = brk.search(raw, at + size)
        if not found:
            break
        end = found.start()
        yield raw[at : words.match(raw, end).end()], end - at
        at = end
    yield raw[at:], len(raw) - at


def _blocks(batches, size: int, longest: int):
    """Groups the texts of batches ``lang, key, text`` to blocks of one language and about ``size`` bytes."""
    held: dict[str, list] = {}
    weight: dict[str, int] = {}
    for batch in batches:
        langs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            raw = batch.column(2)[i].as_buffer()
            raw = raw.to_pybytes() if raw is not None else b""
            for part, own in segments(raw, size, longest):
                held.setdefault(langs[i], []).append((keys[i], part, own, i))
                weight[langs[i]] = weight.get(langs[i], 0) + len(part) + 1
                if weight[langs[i]] >= size:
                    yield langs[i], held.pop(langs[i])
                    weight[langs[i]] = 0
    for lang, rows in held.items():
        yield lang, rows


def _joined(rows):
    """One array of a block's texts, where each begins, and the place before which each one's n-grams begin."""
    raw = np.frombuffer(b"\n".join(r[1] for r in rows), np.uint8)
    begins = np.cumsum([0] + [len(r[1]) + 1 for r in rows[:-1]])
    return raw, begins, begins + np.array([r[2] for r in rows])


def _same_as_first(text: np.ndarray, start: np.ndarray, stop: np.ndarray, group: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True for spans whose bytes equal those of the first span of their group; ``group`` numbers the sorted spans, ``first`` names each group's first."""
    head = first[group]
    same = (stop - start) == (stop[head] - start[head])
    todo = np.flatnonzero(same & (head != np.arange(len(start))))
    # Eight bytes at a time; what lies beyond the end of a span is masked.
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    wide = np.lib.stride_tricks.as_strided(padded, (len(text) + 1, 8), (1, 1))
    off = 0
    while len(todo):
        left = stop[todo] - start[todo] - off
        a = np.ascontiguousarray(wide[start[todo] + off]).view(np.uint64)[:, 0]
        b = np.ascontiguousarray(wide[start[head[todo]] + off]).view(np.uint64)[:, 0]
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.clip(left, 0, 7) * 8).astype(np.uint64)) - np.uint64(1))
        equal = ((a ^ b) & mask) == 0
        same[todo[~equal]] = False
        todo = todo[equal & (left > 8)]
        off += 8
    return same


def _entries(prints: Prints, rows, often) -> list[np.ndarray]:
    """Counted n-grams of a block for each n, made of words and pairs that may be frequent.

    Occurrences of one fingerprint are compared with each other's text; one that differs from the first of its group
    is an entry of its own and meets its like later.
    """
    raw, begins, until = _joined(rows)
    keys = np.array([r[0] for r in rows], np.int64)
    out = []
    for _n, text, place, start, stop, fp, check in prints.ngrams(raw, len(raw), often):
        doc = np.searchsorted(begins, place, side="right") - 1
        mine = place < until[doc]
        start, stop, fp, check, doc = start[mine], stop[mine], fp[mine], check[mine], doc[mine]
        order = np.argsort(fp, kind="stable")
        fp, check, start, stop, key = fp[order], check[order], start[order], stop[order], keys[doc[order]]
        new = np.ones(len(fp), bool)
        new[1:] = fp[1:] != fp[:-1]
        first = np.flatnonzero(new)
        same = _same_as_first(text, start, stop, np.cumsum(new) - 1, first)
        entry = np.empty(len(first) + int((~same).sum()), ENTRY)
        if len(first):
            e = entry[: len(first)]
            e["print"], e["check"] = fp[first], check[first]
            e["n"] = np.add.reduceat(same.astype(np.uint32), first)
            e["key"] = np.minimum.reduceat(np.where(same, key, np.iinfo(np.int64).max), first)
            odd = np.flatnonzero(~same)
            e = entry[len(first) :]
            e["print"], e["check"], e["n"], e["key"] = fp[odd], check[odd], 1, key[odd]
        out.append(entry)
    return out


def _merged(entries: np.ndarray) -> np.ndarray:
    """Entries by fingerprint; neighbours that agree in both fingerprints become one with the smallest key."""
    if not len(entries):
        return entries
    entries = entries[np.argsort(entries["print"], kind="stable")]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["print"][1:] != entries["print"][:-1]) | (entries["check"][1:] != entries["check"][:-1])
    first = np.flatnonzero(new)
    out = entries[first]
    total = np.add.reduceat(entries["n"].astype(np.int64), first)
    out["key"] = np.minimum.reduceat(entries["key"], first)
    out["n"] = np.minimum(total, 0xFFFFFFFF)
    if (total > 0xFFFFFFFF).any():
        # A count that passes its four bytes is carried by several entries.
        rest = [out]
        for i in np.flatnonzero(total > 0xFFFFFFFF):
            left = int(total[i]) - 0xFFFFFFFF
            while left > 0:
                e = out[i : i + 1].copy()
                e["n"] = min(left, 0xFFFFFFFF)
                rest.append(e)
                left -= 0xFFFFFFFF
        out = np.concatenate(rest)
        out = out[np.argsort(out["print"], kind="stable")]
    return out


def _summed(fp: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint once with its count, at most ``most``."""
    order = np.argsort(fp, kind="stable")
    fp, n = fp[order], n[order]
    new = np.ones(len(fp), bool)
    new[1:] = fp[1:] != fp[:-1]
    first = np.flatnonzero(new)
    return fp[first], np.minimum(np.add.reduceat(n.astype(np.int64), first), most).astype(np.uint32) if len(first) else n[:0]


def _prints_only(longest: int, parts: int, size: int, hold: int, bits: int, least: int):
    """Counts of the words' and pairs' fingerprints by language and part, no higher than the threshold, and the number of words."""
    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("words", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        prints = Prints(min(longest, 2), bits)
        held: dict[str, list] = {}
        words: dict[str, int] = {}
        total = 0

        def flush():
            for lang, pairs in held.items():
                fp, n = _summed(np.concatenate([f for f, _ in pairs]), np.concatenate([c for _, c in pairs]), least)
                edges = _parts(fp, 8 * SHORT, parts)
                some = np.flatnonzero(edges[1:] > edges[:-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array([words.pop(lang, 0)] + [0] * (len(some) - 1), pa.int64()),
                    pa.array([_pack(fp[edges[p] : edges[p + 1]], n[edges[p] : edges[p + 1]]) for p in some], pa.binary())], schema=schema)
            held.clear()

        for lang, rows in _blocks(batches, size, longest):
            raw, begins, until = _joined(rows)
            for n, _text, place, _start, _stop, fp, _check in prints.ngrams(raw, len(raw)):
                fp = fp[place < until[np.searchsorted(begins, place, side="right") - 1]] >> np.uint64(64 - 8 * SHORT)
                if n == 1:
                    words[lang] = words.get(lang, 0) + len(fp)
                if len(fp):
                    held.setdefault(lang, []).append(_summed(fp, np.ones(len(fp), np.uint32), least))
                    total += len(held[lang][-1][0])
            if total >= hold:
                # Put together what is held; it leaves only if that doesn't make it small.
                for k, pairs in held.items():
                    held[k] = [_summed(np.concatenate([f for f, _ in pairs]), np.concatenate([c for _, c in pairs]), least)]
                total = sum(len(v[0][0]) for v in held.values())
                if total >= hold * 3 // 4:
                    yield from flush()
                    total = 0
        yield from flush()

    return run


def _frequent_prints(least: int):
    """Fingerprints of a part with ``least`` occurrences (place in a bitmap from 0 on), and the number of words in a row with null."""
    names = ("lang", "print", "words")

    def run(key, table):
        packed = [_unpack(x) for x in table.column("packed")]
        fp, n = _summed(np.concatenate([x[0] for x in packed]), np.concatenate([x[1] for x in packed]), least)
        fp = fp[n >= least]
        words = sum(table.column("words").to_pylist())
        return pa.table([pa.array([key[0].as_py()] * (len(fp) + 1), pa.string()), pa.array([None, *fp.view(np.int64).tolist()], pa.int64()), pa.array([words] + [0] * len(fp), pa.int64())], names=names)

    return run


class Often:
    """Tells which fingerprints may be frequent: a filter of three bits each in a bitmap of bounded size.

    Of others one in 200 passes while the bitmap has room (16 bits each, 8 million fingerprints); beyond that more pass, never less.
    """

    SHIFTS = (0, 10, 21)

    def __init__(self, numbers: DataFrame, max_bits: int = 1 << 27):
        """``numbers`` has one column ``at`` of numbers from 0 on."""
        rows = numbers.where("at IS NOT NULL")
        self.bits, goal = 1 << 15, min(16 * rows.count(), max_bits)
        while self.bits < goal:
            self.bits *= 2
        at = F.explode(F.array(*(F.shiftrightunsigned("at", k).bitwiseAND(self.bits - 1) + 1 for k in self.SHIFTS)))
        maps = rows.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
        self.map = np.zeros(self.bits // 8, np.uint8)
        for r in maps:
            self.map[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.map, np.uint8)

    def __call__(self, fp: np.ndarray) -> np.ndarray:
        out = np.ones(len(fp), bool)
        fp = fp.astype(np.uint64)
        for k in self.SHIFTS:
            at = ((fp >> np.uint64(k)) & np.uint64(self.bits - 1)).astype(np.int64)
            out &= (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _count(longest: int, parts: int, size: int, hold: int, bits: int, often: Often):
    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("n", pa.int32()), ("packed", pa.binary())])

    def run(batches):
        prints = Prints(longest, bits)
        held: dict[str, list[list[np.ndarray]]] = {}
        total = 0

        def flush():
            for lang, by_n in held.items():
                for n in (n for n in range(longest) if by_n[n]):
                    entries = _merged(np.concatenate(by_n[n]))
                    by_n[n] = []
                    edges = _parts(entries["print"], 64, parts)
                    some = np.flatnonzero(edges[1:] > edges[:-1])
                    if len(some):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array([n + 1] * len(some), pa.int32()),
                            pa.array([_pack(e["print"], e["n"], (e["check"], 4), (e["key"], KEY_BYTES)) for e in (entries[edges[p] : edges[p + 1]] for p in some)], pa.binary())], schema=schema)
            held.clear()

        for lang, rows in _blocks(batches, size, longest):
            by_n = held.setdefault(lang, [[] for _ in range(longest)])
            for n, entries in enumerate(_entries(prints, rows, often)):
                by_n[n].append(entries)
                total += len(entries)
            if total >= hold:
                for parts_of in held.values():
                    parts_of[:] = [[_merged(np.concatenate(x))] if x else [] for x in parts_of]
                total = sum(len(x[0]) for parts_of in held.values() for x in parts_of if x)
                if total >= hold * 3 // 4:
                    yield from flush()
                    total = 0
        yield from flush()

    return run


def _entry(prints, n, check, key) -> np.ndarray:
    out = np.empty(len(prints), ENTRY)
    out["print"], out["n"], out["check"], out["key"] = prints, n, check, key
    return out


def _wanted_only(wanted: Often):
    """Lets texts pass whose key may be asked for."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted(np.asarray(batch.column(1)))))

    return run


def _frequent(least: int):
    """Entries of a part whose fingerprint occurs ``least`` times."""
    names = ("lang", "n", "print", "check", "times", "key")

    def run(key, table):
        lang = key[0].as_py()
        order = np.asarray(table.column("n"))
        packed = table.column("packed")
        out = []
        for n in np.unique(order):
            entries = _merged(np.concatenate([_entry(*_unpack(packed[int(i)], 4, KEY_BYTES)) for i in np.flatnonzero(order == n)]))
            new = np.ones(len(entries), bool)
            new[1:] = entries["print"][1:] != entries["print"][:-1]
            # All entries of a fingerprint count towards the threshold: with a collision that is more than any one phrase has.
            some = np.add.reduceat(entries["n"].astype(np.int64), np.flatnonzero(new)) >= least
            e = entries[some[np.cumsum(new) - 1]]
            out.append(pa.table([pa.array([lang] * len(e), pa.string()), pa.array(np.full(len(e), n, np.int32)), pa.array(e["print"].astype(np.int64)),
                                 pa.array(e["check"].astype(np.int64)), pa.array(e["n"].astype(np.int64)), pa.array(e["key"].astype(np.int64))], names=names))
        return pa.concat_tables(out)

    return run


def _materialise(longest: int, size: int, bits: int):
    """Reads the wanted n-grams of each text from the text."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("times", pa.int64())])

    def run(batches):
        prints = Prints(longest, bits)
        for batch in batches:
            wanted = batch.column(3)
            whole = {name: np.asarray(pc.struct_field(wanted.flatten(), name)) for name in ("n", "print", "check", "times")}
            edges = np.concatenate([[0], np.cumsum(np.asarray(wanted.value_lengths()))])
            found = np.zeros(edges[-1], bool)
            for lang, rows in _blocks([batch], size, longest):
                raw, begins, _ = _joined(rows)
                ask = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in sorted({r[3] for r in rows})])
                ask = ask[~found[ask]]
                for n, text, _place, start, stop, fp, check in prints.ngrams(raw, len(raw)):
                    want = ask[whole["n"][ask] == n]
                    if not len(want) or not len(fp):
                        continue
                    order = np.lexsort((check, fp))
                    fp, check = fp[order], check[order]
                    # First place with the fingerprint; within its run, first with the second one.
                    goal, second = whole["print"][want].view(np.uint64), whole["check"][want]
                    at = np.searchsorted(fp, goal)
                    for _ in range(len(fp)):
                        inside = at < len(fp)
                        safe = np.where(inside, at, 0)
                        step = inside & (fp[safe] == goal) & (check[safe] < second)
                        if not step.any():
                            break
                        at = at + step
                    hit = inside & (fp[safe] == goal) & (check[safe] == second)
                    want, at = want[hit], order[safe[hit]]
                    found[want] = True
                    if len(want):
                        plain = text.tobytes()
                        yield pa.RecordBatch.from_arrays([
                            pa.array([lang] * len(want), pa.string()), pa.array(np.full(len(want), n, np.int32)),
                            pa.array([plain[s:e].decode() for s, e in zip(start[at].tolist(), stop[at].tolist(), strict=True)], pa.string()),
                            pa.array(whole["times"][want].astype(np.int64))], schema=schema)
            if not found.all():
                raise RuntimeError("an n-gram is not in the text it was counted in")

    return run


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3, lang_col: str = "lang", text_col: str = "text", parts: int | None = None, block_bytes: int = 1_000_000, hold: int = 2_500_000, bits: int = 64) -> DataFrame:
    """``lang, n, phrase, times``: all phrases of 1 to ``longest`` words that occur at least ``least`` times in their language, and a row with ``n`` = 0, null ``phrase`` and all word occurrences.

    First the fingerprints of all words and pairs are counted, bare; those of frequent ones become a bitmap of bounded size.
    Then each task fingerprints its n-grams again, keeps those all of whose pairs may be frequent, compares the occurrences of a fingerprint
    with each other's text, and sends one packed entry per n-gram and part of the fingerprints' space: fingerprint, second fingerprint, count, and the key of a
    text that holds it.  Entries meet their like by part; those of frequent fingerprints alone are read from the text they point to,
    and are counted by their text.  Phrases that share a fingerprint differ in the second one and stay apart; two different phrases from
    different tasks count as one only if both agree, 96 bits (chance about 1e-29 for a pair).
    """
    key = F.xxhash64(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string")).bitwiseAND((1 << 8 * KEY_BYTES) - 1)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if parts is None:
        # About half a byte for a byte of text, 16 MB a part; as numbers in memory four times that.
        bytes_of_text = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        parts = max(8, -(-bytes_of_text // 32_000_000))
    parts = 1 << (parts - 1).bit_length()
    bare = texts.mapInArrow(_prints_only(longest, parts, block_bytes, hold, bits, least), "lang string, part int, words bigint, packed binary")
    frequent = cut(bare.groupBy("lang", "part").applyInArrow(_frequent_prints(least), "lang string, print bigint, words bigint"))
    words = frequent.groupBy("lang").agg(F.sum("words").alias("times")).select("lang", F.lit(0).alias("n"), F.lit(None).cast("string").alias("phrase"), "times")
    packed = texts.mapInArrow(_count(longest, parts, block_bytes, hold, bits, Often(frequent.select(F.col("print").alias("at")))), "lang string, part int, n int, packed binary")
    often = cut(packed.groupBy("lang", "part").applyInArrow(_frequent(least), "lang string, n int, print bigint, check bigint, times bigint, key bigint"))
    wanted = often.groupBy("lang", "key").agg(F.collect_list(F.struct("n", "print", "check", "times")).alias("wanted"))
    # A text with very many copies is one row of each task before it moves; texts that share a key answer together.
    asked_for = texts.mapInArrow(_wanted_only(Often(often.select(F.col("key").alias("at")).distinct())), "lang string, key bigint, text string")
    sent = asked_for.groupBy("lang", "key").agg(F.array_join(F.collect_set("text"), "\n").alias("text"))
    asked = sent.join(wanted, ["lang", "key"]).select("lang", "key", "text", "wanted")
    read = asked.mapInArrow(_materialise(longest, block_bytes, bits), "lang string, n int, phrase string, times bigint")
    counts = read.groupBy("lang", "n", "phrase").agg(F.sum("times").alias("times")).where(F.col("times") >= least)
    return counts.unionByName(words)


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, inside: int = 50, lang_col: str = "lang", text_col: str = "text", **how) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to ``longest`` words of each language (null: ``und``).

    A-Z are lower-cased, texts are cut into pieces at ``.,;:!?`` and line ends and into words at spaces and tabs.  ``a`` is how often a phrase
    occurs in pieces, ``l`` and ``r`` how often the parts on both sides of a cut do; the cut with the lowest ``floor(1000000 * a * a / (l * r))`` counts
    (ties: the first), in exact decimals.  Phrases within a longer one that has ``inside`` percent of their occurrences are left out.  Rows
    with equal score and ``a`` are ordered by phrase, in bytes.

    Null and empty texts have no words; repeated rows count each time; a language without frequent phrases has no row.  Very long texts
    are cut into blocks with the words that n-grams need beyond them.  Other columns are not read; an empty table gives an empty result.
    """
    counts = cut(phrase_counts(docs, least, longest, lang_col, text_col, **how))
    table = counts.where("n > 0").select("lang", F.col("phrase").alias("part"), F.col("times").alias("found"))
    words = F.split("phrase", " ")

    def run(first, size):
        return F.array_join(F.slice("words", first, size), " ")

    covered = counts.where("n > 2").withColumn("words", words)
    subs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: run(i, m))))
    longer = covered.select("lang", "times", F.explode(F.array_distinct(subs)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("times").alias("longer"))
    # What a longer phrase covers needs no score.
    free = counts.where("n > 1").join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {inside} * times")
    candidates = free.select("lang", "phrase", "n", F.col("times").alias("a"), words.alias("words"))
    sides = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit("l").alias("side"), run(F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit("r").alias("side"), run(k + 1, F.col("n") - k).alias("part")))))
    split = candidates.select("lang", "phrase", "a", F.explode(sides).alias("s")).select("lang", "phrase", "a", "s.*").join(table, ["lang", "part"])
    # One row a phrase: its cuts with both counts, then the lowest score.
    cuts = split.groupBy("lang", "phrase", "a").agg(F.array_sort(F.collect_list(F.struct("k", "side", "found"))).alias("c"))
    value = "cast((cast(1000000 as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(c[2 * i].found as decimal(19,0)) * cast(c[2 * i + 1].found as decimal(19,0))) as bigint)"
    scored = cuts.withColumn("best", F.expr(f"array_min(transform(sequence(0, size(c) div 2 - 1), i -> struct({value} as score, i as at, c[2 * i].found as l, c[2 * i + 1].found as r)))"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = counts.where("n = 0").select("lang", F.col("times").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
