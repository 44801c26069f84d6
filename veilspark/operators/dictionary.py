"""Dictionaries of any size: terms and protected values come as a table and are joined to the texts.

A text isn't compared with the entries.  All its windows are hashed at once, at the power of two below an entry's length and, where such a window
is known, at the lengths that entries of that size have.  What is left meets the entries by hash in one join, which
compares the strings.  Tasks get two bitmaps of bounded size, never the entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.rolling import Windows
from veilspark.functions.spans import HITS_TYPE, compute_once, empty, fold_emit, let, resolve_overlaps

TERM_PRI, VALUE_PRI = 10_010, 20_000
#: Bits of a bitmap at most: 16 MB.  With many million entries more windows pass that no entry has; results stay the same.
MAX_BITS = 1 << 27
#: An entry sets a bit at each of these shifts of its hash.  A bitmap has at least BITS_EACH bits an entry, so that about one in
#: 75 000 windows passes by chance: a window is tried at every length of its size, and each pass carries its string.
SHIFTS, BITS_EACH = (0, 18, 37), 128
BLOCK_BYTES = 1_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ALNUM = np.zeros(257, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _entry_prints():
    """Bytes, hash of the leading window and hash of the whole of the key that comes first; the other columns stay."""
    def run(batches):
        windows = Windows()
        for batch in batches:
            keys = batch.column(0).cast(pa.large_binary()).to_pylist()
            out = np.zeros((3, len(keys)), np.int64)
            for i, key in enumerate(keys):
                sums = windows.sums(np.frombuffer(key, np.uint8))
                at, head = np.zeros(1, np.int64), 1 << (len(key).bit_length() - 1)
                out[:, i] = len(key), *(windows.of(sums, at, size).view(np.int64)[0] for size in (head, len(key)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(o) for o in out)], names=[*batch.schema.names[1:], "_bytes", "_head", "_whole"])

    return run


def _bitmaps(prints: DataFrame, names: list[str], bits: int) -> list[np.ndarray]:
    """A bitmap of ``bits`` bits for each column as bytes: made by the tasks, at most :data:`MAX_BITS` bits each for the driver."""
    # Numbered from 1, so that every bucket has the same size.
    places = [F.struct(F.lit(i).alias("of"), (F.shiftrightunsigned(F.col(name), shift).bitwiseAND(bits - 1) + 1).alias("at")) for i, name in enumerate(names) for shift in SHIFTS]
    rows = prints.select(F.inline(F.array(*places))).groupBy("of", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
    out = [np.zeros(bits // 8, np.uint8) for _ in names]
    for r in rows:
        lo = (r.bucket - 1) * 4096
        out[r["of"]][lo : lo + 4096] |= np.frombuffer(r.map, np.uint8)
    return out


def _known(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the bitmap lets pass."""
    some = np.arange(len(hashes))
    for shift in SHIFTS:
        at = ((hashes[some] >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64)
        some = some[(bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return some


def _pieces(row: int, text: bytes, reach: int):
    """``row, bytes, from, to, chars``: a text or, if it is long, overlapping pieces; windows begin from ``from`` to before ``to``."""
    chars = 0
    for lo in range(0, len(text), BLOCK_BYTES):
        # One byte more on either side tells what touches a window.
        first = min(lo, 1)
        piece = text[lo - first : lo + BLOCK_BYTES + reach + 1]
        yield row, piece, first, min(first + BLOCK_BYTES, len(piece)), chars
        # The next piece begins one byte before its own first place.
        own = np.frombuffer(text[lo - first : lo + BLOCK_BYTES - 1], np.uint8)
        chars += int(((own & 0xC0) != 0x80).sum())


def _windows_of_texts(n_ids: int, lengths: dict[bool, dict[int, list[int]]], heads: np.ndarray, wholes: np.ndarray, bits: int):
    """Windows of each text that an entry may have: place in characters, hash and string."""
    windows = Windows()
    reach = max((n for by_head in lengths.values() for sizes in by_head.values() for n in sizes), default=0)
    names = ["folded", "whole", "start", "len", "free", "original"]

    def rows_of(block):
        raw = np.frombuffer(b"\0".join(b[1] for b in block), np.uint8)
        size = np.array([len(b[1]) for b in block])
        begin = np.cumsum(size + 1) - size - 1
        end, first, until, before = begin + size, *(np.array([b[i] for b in block]) for i in (2, 3, 4))
        owner = np.repeat(np.arange(len(block)), size + 1)[: len(raw)]
        lead = (raw & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(lead)])
        around = np.concatenate([raw, [0]]).astype(np.int64)
        place = np.arange(len(raw)) - begin[owner]
        starts = np.flatnonzero(lead & (place >= first[owner]) & (place < until[owner]))
        data, ends = raw.tobytes(), np.append(lead, True)
        for folded, by_head in lengths.items():
            sums = windows.sums(_FOLD[raw] if folded else raw)
            for head, sizes in by_head.items():
                at = starts[starts + head <= end[owner[starts]]]
                at = at[_known(heads, bits, windows.of(sums, at, head))]
                for n in sizes:
                    full = at[at + n <= end[owner[at]]]
                    if not len(full):
                        # Sizes ascend: no longer entry fits either.
                        break
                    whole = windows.of(sums, full, n)
                    some = _known(wholes, bits, whole)
                    some = some[ends[full[some] + n]]
                    full, whole = full[some], whole[some]
                    if len(full):
                        of = owner[full]
                        left = (full > begin[of]) & _ALNUM[around[full - 1]]
                        right = (full + n < end[of]) & _ALNUM[around[full + n]]
                        yield of, [
                            pa.array(np.full(len(full), folded)), pa.array(whole.view(np.int64)), pa.array((before[of] + chars[full] - chars[begin[of]]).astype(np.int32)),
                            pa.array((chars[full + n] - chars[full]).astype(np.int32)), pa.array(~left & ~right), pa.array([data[a : a + n].decode() for a in full.tolist()], pa.string())]

    def run(batches):
        for batch in batches:
            ids = [batch.column(i) for i in range(n_ids)]
            block: list = []
            weight = 0

            def flush(block, ids=ids, names_of=tuple(batch.schema.names[:n_ids])):
                index = np.array([b[0] for b in block])
                for of, columns in rows_of(block):
                    take = pa.array(index[of])
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in ids), *columns], names=[*names_of, *names])

            for i, text in enumerate(batch.column(n_ids).cast(pa.large_binary()).to_pylist()):
                for piece in _pieces(i, text or b"", reach):
                    block.append(piece)
                    weight += len(piece[1])
                    if weight >= BLOCK_BYTES:
                        yield from flush(block)
                        block, weight = [], 0
            if block:
                yield from flush(block)

    return run


def _candidates(texts: DataFrame, spread: DataFrame, keys: list[str], text: str, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Windows of the texts whose hashes pass the bitmaps of the entries, and the entries with their hashes."""
    key = F.when(F.col("word"), F.lower("value")).otherwise(F.col("value"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema.fields)
    keyed = spread.select(key.alias("_key"), *spread.columns).mapInArrow(_entry_prints(), f"{fields}, _bytes bigint, _head bigint, _whole bigint")
    sizes = keyed.groupBy(F.col("word").alias("_folded"), "_bytes").agg(F.count(F.lit(1)).alias("n")).collect()
    lengths: dict[bool, dict[int, list[int]]] = {}
    for r in sorted(sizes, key=lambda r: r["_bytes"]):
        lengths.setdefault(r["_folded"], {}).setdefault(1 << (r["_bytes"].bit_length() - 1), []).append(r["_bytes"])
    bits = 1 << 15
    while bits < min(BITS_EACH * sum(r.n for r in sizes), max_bits):
        bits *= 2
    known = texts.select(*keys, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields[: len(keys)])
    found = known.mapInArrow(
        _windows_of_texts(len(keys), lengths, *_bitmaps(keyed, ["_head", "_whole"], bits), bits),
        f"{kinds}, folded boolean, whole bigint, start int, len int, free boolean, original string")
    return found.where("free OR NOT folded"), keyed


def occurrences(texts: DataFrame, entries: DataFrame, keys: list[str], text: str = "body", max_bits: int = MAX_BITS) -> DataFrame:
    """``keys, start, len, original`` and the columns of ``entries`` for every occurrence of every entry, overlapping ones too.

    ``entries`` has ``value`` and ``word``.  Where ``word`` is set, the value is found in any case of A-Z and only where no letter A-Z or
    digit touches it; other values are found as they stand.  Places are counted in characters.  Equal values with other columns are
    entries of their own; null and empty values and texts have no occurrence.  Neither length nor number of entries is limited: the
    driver sees the lengths that occur and two bitmaps of at most ``max_bits`` bits.
    """
    spread = entries.where("value IS NOT NULL AND value <> ''")
    found, keyed = _candidates(texts, spread, keys, text, max_bits)
    key = F.when(F.col("word"), F.lower("value")).otherwise(F.col("value"))
    same = (F.col("whole") == F.col("_whole")) & (F.col("folded") == F.col("word")) & (F.when(F.col("folded"), F.lower("original")).otherwise(F.col("original")) == key)
    return found.join(keyed, same).select(*keys, "start", "len", "original", *entries.columns)


def clean_terms(terms: DataFrame, term: str = "term", max_chars: int | None = None, max_count: int | None = None) -> DataFrame:
    """``term, value, word`` of a table of terms: trimmed, blanks dropped, of terms equal in any case the smallest.

    ``max_chars`` drops longer terms and ``max_count`` keeps the first by name; both are off by default.
    """
    value = F.trim(F.col(term))
    rows = terms.select(value.alias("term")).where("term <> ''")
    if max_chars is not None:
        rows = rows.where(F.length("term") <= max_chars)
    rows = rows.groupBy(F.lower("term").alias("_same")).agg(F.min("term").alias("term"))
    if max_count is not None:
        rows = rows.orderBy("_same").limit(max_count)
    return rows.select("term", F.col("term").alias("value"), F.col("term").rlike("^[A-Za-z0-9]+$").alias("word"))


def _leftmost(places: Column) -> Column:
    """Of places ``(start, len, original)`` in order those that start where the last kept one has ended."""
    kind = "array<struct<start:int,len:int,original:string>>"

    def step(state: Column, x: Column) -> Column:
        keep = x["start"] >= state["until"]
        return F.struct(F.struct(F.when(keep, x["start"] + x["len"]).otherwise(state["until"]).alias("until")).alias("state"), F.when(keep, F.array(x)).otherwise(empty(kind)).alias("out"))

    return let(F.array_sort(places), lambda xs: fold_emit(xs, F.struct(F.lit(0).alias("until")), step, kind))


def find_terms(texts: DataFrame, terms: DataFrame, keys: list[str], text: str = "body") -> DataFrame:
    """``keys, start, len, tag, term, original`` for each term of :func:`clean_terms`; one term's occurrences don't overlap each other."""
    found = occurrences(texts, terms, keys, text)
    # Only a term that isn't a word can overlap itself.
    words = found.where("word").select(*keys, "start", "len", F.lit("CUSTOM_TERM").alias("tag"), "term", "original")
    others = found.where("NOT word").groupBy(*keys, "term").agg(F.collect_list(F.struct("start", "len", "original")).alias("places"))
    return words.unionByName(others.select(*keys, "term", F.inline(_leftmost(F.col("places")))).select(*keys, "start", "len", F.lit("CUSTOM_TERM").alias("tag"), "term", "original"))


def find_values(texts: DataFrame, entries: DataFrame, keys: list[str], text: str = "body") -> DataFrame:
    """``keys, start, len, action, locker_entry, pos, original`` for each enabled value of a cleaned entry table ``(pos, name, value, action, enabled, kind)``."""
    active = entries.where("enabled AND kind = 'value'").select("pos", "name", "value", "action", F.lit(False).alias("word"))
    return occurrences(texts, active, keys, text).select(*keys, "start", "len", "action", F.col("name").alias("locker_entry"), "pos", "original")


def entry_names(texts: DataFrame, entries: DataFrame, keys: list[str], text: str = "body") -> DataFrame:
    """``keys, entry``: names whose first entry's value occurs in the text, each once."""
    first = entries.where("enabled AND kind = 'value'").groupBy("name").agg(F.min_by("value", "pos").alias("value")).select("name", "value", F.lit(False).alias("word"))
    return occurrences(texts, first, keys, text).select(*keys, F.col("name").alias("entry")).distinct()


def term_hits() -> Column:
    """A hit of the scan for a row of :func:`find_terms`."""
    return _hit(F.lit(TERM_PRI), F.lit("CUSTOM_TERM"), F.lit("mask"), F.lit(""), F.lit(None).cast("string"))


def value_hits() -> Column:
    """A hit of the scan for a row of :func:`find_values`."""
    return _hit(F.least(F.lit(VALUE_PRI) + F.col("pos"), F.lit(2_000_000_000)).cast("int"), F.lit("LOCKER"), F.when(F.col("action") == "block", "block").otherwise("mask"), F.lit("locker"), F.col("locker_entry"))


def _hit(pri: Column, tag: Column, action: Column, rule: Column, entry: Column) -> Column:
    return F.struct(F.col("start"), (-F.col("len")).alias("neg_len"), pri.alias("pri"), F.col("len"), tag.alias("tag"), action.alias("action"), rule.alias("rule_id"), F.lit(1).alias("min_confirm"),
                    F.lit(False).alias("validated"), entry.alias("locker_entry"), F.col("original"))


def add_hits(scanned: DataFrame, keys: list[str], *found: tuple[DataFrame, Column], hits: str = "hits") -> DataFrame:
    """``scanned`` with the occurrences of dictionaries among its hits, overlaps resolved anew.

    ``found`` are pairs of occurrence rows and the hit they give.  Only narrow rows are gathered, by text; ``scanned``
    should hold all hits of its own, since one that lost to a third hit before can't come back.
    """
    more = None
    for rows, hit in found:
        part = rows.select(*keys, hit.alias("_h"))
        more = part if more is None else more.unionByName(part)
    gathered = more.groupBy(*keys).agg(F.collect_list("_h").alias("_more"))
    both = F.concat(F.col(hits), F.coalesce(F.col("_more"), empty(HITS_TYPE)))
    joined = scanned.join(gathered, keys, "left").withColumn("_both", both).drop(hits, "_more")
    return compute_once(joined, **{hits: resolve_overlaps(F.col("_both"))}).drop("_both")


def scan_with(messages: DataFrame, keys: list[str], rules=None, semantic=None, terms: DataFrame | None = None, entries: DataFrame | None = None, text: str = "body") -> DataFrame:
    """``messages`` with resolved hits of rules, heuristics, a term table and an entry table of any size; ``keys`` name a message."""
    from veilspark.operators.detect import builtin_rules, rule_matchers
    from veilspark.operators.semantic import semantic_matchers
    from veilspark.functions.matching import find

    matchers = rule_matchers(builtin_rules() if rules is None else list(rules)) + (semantic_matchers(semantic) if semantic else [])
    scanned = compute_once(messages, hits=find(F.col(text), matchers))
    found = []
    if terms is not None:
        rows = find_terms(messages, terms, keys, text)
        found.append((rows, term_hits()))
    if entries is not None:
        rows = find_values(messages, entries, keys, text)
        found.append((rows, value_hits()))
    return add_hits(scanned, keys, *found) if found else compute_once(scanned.withColumnRenamed("hits", "_all"), hits=resolve_overlaps(F.col("_all"))).drop("_all")
