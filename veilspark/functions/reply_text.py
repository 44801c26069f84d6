"""The wire text of a reply read in one go, on Arrow batches in the tasks: frames, text places, held placeholder starts, facts.

What JSON is decides Spark's own parser.  Texts on which the parser used here might differ from it are not read but named, so that the caller
asks Spark (see :class:`Unsure`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa

from veilspark import fixed_values as fx
from veilspark.functions.holdback import BOUNDARY, held_chars
from veilspark.functions.slots import _content, _known

#: Data of more characters is left to Spark.
MOST = 40_000
FIELDS = ("data:", "event:", "id:", "retry:", ":")
#: White space as ``trim_space`` has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
HALF = re.compile(r"\\u[dD][89a-fA-F]")
LONG_NUMBER = re.compile(r"[0-9]{60}")
SUFFIX = re.compile(r"PII:[A-Za-z0-9_]{1,32}:([0-9a-fA-F]{8})")
STRICT, LOOSE = re.compile(fx.STRICT_PLACEHOLDER), re.compile(fx.LOOSE_PLACEHOLDER)
WORD = re.compile(r"[A-Za-z0-9_]")

SAID = "conn string, unsure boolean, parts array<string>, asks array<int>, escapes array<boolean>, suffixes array<string>, response_model string, events bigint, told array<struct<seq:bigint,event_type:string,data:string>>"
TOLD = pa.list_(pa.struct([("seq", pa.int64()), ("event_type", pa.string()), ("data", pa.string())]))
SAID_TYPES = [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.string()), pa.string(), pa.int64(), TOLD]
SAID_NAMES = [c.split()[0] for c in SAID.split(", ")]


class Unsure(Exception):
    """Spark's parser has to decide."""


def _unique(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise Unsure
    return found


def _fraction(text: str) -> Decimal:
    if "e" in text or "E" in text:
        raise Unsure
    return Decimal(text)


def _no(_):
    raise Unsure


def reader() -> json.JSONDecoder:
    """Made in the task, as it can't be sent there."""
    return json.JSONDecoder(parse_float=_fraction, parse_constant=_no, object_pairs_hook=_unique)


def as_object(data: str, parser: json.JSONDecoder) -> dict | None:
    """The JSON object, or None for what surely is no JSON."""
    head = data if data[:1] == "{" else data.lstrip(" \t\r\n")
    first = head[:1]
    if first == "{":
        size = len(head)
        if size > MOST or size > 60 and LONG_NUMBER.search(head) or size > 200 and head.count("{") + head.count("[") > 200 or "\\u" in head and HALF.search(head):
            raise Unsure
        try:
            found, end = parser.scan_once(head, 0)
        except (ValueError, RecursionError, StopIteration):
            raise Unsure from None
        if end < size and head[end:].strip(" \t\r\n"):
            raise Unsure
        return found
    if first == "[":
        first = head[1:].lstrip(" \t\r\n")[:1]
        sure = first != "" and first not in '{["]-0123456789tfn'
    elif first in ("t", "f", "n"):
        sure = not head.startswith(("true", "false", "null"))
    else:
        sure = first not in '"-0123456789\ufeff'
    if not sure:
        raise Unsure
    return None


def _named(found: dict) -> str | None:
    if isinstance(found.get("model"), str):
        return found["model"]
    for key in ("message", "response"):
        holder = found.get(key)
        if isinstance(holder, dict) and isinstance(holder.get("model"), str):
            return holder["model"]
    return None


def _tells(found: dict, data: str) -> bool:
    """False for an event of an open shape without usage and signature, which gives the stream signals nothing; letters hide only behind ``\\u``."""
    if "token" in data or "signature" in data or "\\u" in data:
        return True
    return found.get("choices") is None and found.get("delta") is None and found.get("usage") is None and found.get("system_fingerprint") is None


def _frames(text: str) -> list[str]:
    if "\r" not in text:
        found = text.split("\n\n")
        rest = found.pop()
        found = [f + "\n\n" for f in found]
    else:
        ends = [m.end() for m in BOUNDARY.finditer(text)]
        found = [text[a:b] for a, b in zip([0, *ends], ends)]
        rest = text[ends[-1] :] if ends else text
    return [*found, rest] if rest else found


def _lines(raw: str) -> list[str]:
    if "\r" in raw:
        return [s for s in (s[:-1] if s[-1:] == "\r" else s for s in raw.split("\n")) if s]
    body = raw.strip("\n")
    return [s for s in body.split("\n") if s] if "\n" in body or not body else [body]


def read_reply(text: str, parser: json.JSONDecoder, tell: bool = True) -> tuple:
    """``parts, asks, escapes, suffixes, response_model, events, told`` of a whole reply.

    Joined, the parts are the reply's text; those at ``asks`` may hold placeholders with one of ``suffixes``, and each lies in one part.
    ``told`` holds the events that may matter for the stream signals, if ``tell``.
    """
    pushes: list[tuple] = []
    last: dict[str, int] = {}
    model, events, told = None, 0, []
    for no, raw in enumerate(_frames(text)):
        lines = _lines(raw)
        given = [s[6:] if s[5:6] == " " else s[5:] for s in lines if s[:5] == "data:"]
        data = (given[0] if len(given) == 1 else "\n".join(given)) if given else None
        found = None
        if data is None or not data.strip(WHITE):
            if not lines or not all(s.startswith(FIELDS) for s in lines):
                pushes.append((no, 0, "text", raw, False))
        else:
            found = as_object(data, parser)
            if found is None:
                pushes.append((no, 0, "text", data, False))
            else:
                events += 1
                if model is None:
                    name = _named(found)
                    model = name if name and name.strip(WHITE) else None
                kind = found.get("type")
                if isinstance(kind, str) and kind in fx.SNAPSHOT_CHANNELS:
                    last[fx.SNAPSHOT_CHANNELS[kind]] = no
                for i, (_, channel, t, escape) in enumerate(_known(found) or _content(data)):
                    if t:
                        pushes.append((no, i, channel, t, escape))
        if tell and data is not None and (found is None or _tells(found, data)):
            told.append({"seq": no, "event_type": next((s[6:].strip(" ") for s in lines if s.startswith("event:")), ""), "data": data})
    return (*_parts(pushes, last), model, events, told)


def _parts(pushes: list[tuple], last: dict[str, int]) -> tuple:
    """The possible start of a placeholder at the end of a push moves to the next push of its channel; a rest comes last."""
    held: dict[str, list] = {}
    pieces: list[tuple] = []
    for no, slot, channel, text, escape in pushes:
        if last and no < last.get(channel, 0):
            continue
        state = held.get(channel)
        if state is None:
            state = held[channel] = ["", ()]
        elif state[0]:
            text = state[0] + text
        n = held_chars(text)
        state[0], state[1] = text[len(text) - n :] if n else "", (no, slot, channel, escape)
        if n < len(text):
            pieces.append((text[: len(text) - n] if n else text, escape))
    pieces += [(held[channel][0], escape) for _, _, channel, escape in sorted(s[1] for s in held.values() if s[0])]
    parts: list[str] = []
    asks: list[int] = []
    escapes: list[bool] = []
    suffixes: set[str] = set()
    for text, escape in pieces:
        if "PII:" in text:
            asks.append(len(parts))
            escapes.append(escape)
            suffixes.update(s.lower() for s in SUFFIX.findall(text))
        elif parts and (not asks or asks[-1] != len(parts) - 1):
            parts[-1] += text
            continue
        parts.append(text)
    return parts, asks, escapes, sorted(suffixes)


def _runs(conns: pa.Array) -> tuple[list, list[int]]:
    """Each conn of a sorted batch and where its rows end."""
    runs = conns.dictionary_encode(null_encoding="encode")
    codes = runs.indices.to_numpy(zero_copy_only=False)
    ends = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes))
    return runs.dictionary.take(pa.array(codes[ends - 1])).to_pylist(), ends.tolist()


def _texts(texts: pa.Array, ends: list[int]) -> list[str]:
    """The joined texts up to each end: they lie one after the other in the batch."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1]
    places = [int(at[0]), *at[ends].tolist()]
    raw = memoryview(data) if data is not None else b""
    return [str(raw[a:b], "utf-8") for a, b in zip(places, places[1:])]


def said(whole: int, tell: bool):
    """For ``mapInArrow`` over ``conn, text`` in the order of the stream, the rows of a conn one after the other, texts without nulls: rows of ``SAID``.

    A reply of more than ``whole`` characters is not kept, only named as unsure.
    """

    def row(parser, conn, texts: list[str] | None) -> tuple:
        try:
            if texts is not None:
                return conn, False, *read_reply("".join(texts), parser, tell)
        except Unsure:
            pass
        return conn, True, [], [], [], [], None, 0, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, current = reader(), None
        for batch in batches:
            out: list[tuple] = []
            if batch.num_rows:
                conns, ends = _runs(batch.column(0))
                for conn, text in zip(conns, _texts(batch.column(1), ends)):
                    if current is None or conn != current[0]:
                        if current is not None:
                            out.append(row(parser, *current[:2]))
                        current = [conn, [], 0]
                    current[2] += len(text)
                    if current[2] > whole:
                        current[1] = None
                    elif current[1] is not None:
                        current[1].append(text)
            if out:
                yield _batch(out)
        if current is not None:
            yield _batch([row(parser, *current[:2])])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SAID_TYPES)], names=SAID_NAMES)


def _put(text: str, loose: bool, book: dict[str, list], escape: bool, counts: list[int]) -> str:
    out: list[str] = []
    at = 0
    for found in (LOOSE if loose else STRICT).finditer(text):
        token, start, end = found[0], found.start(), found.end()
        if loose:
            bare = token.replace("\\", "")
            if bare.startswith("[[") and bare.endswith("]]") or start and WORD.match(text[start - 1]) or WORD.match(text[end : end + 1]):
                continue
        suffix = found[2].lower()
        canonical = f"[[PII:{found[1].upper()}:{suffix}]]"
        if suffix not in book:
            raise Unsure
        matches = [v for v in book[suffix] if v[0] == canonical or v[3]]
        known = sorted((escaped if escape else original, placeholder != canonical) for placeholder, original, escaped, _ in matches if original is not None)
        counts[0] += len(known)
        counts[1] += len(matches) - len(known) if matches else 1
        counts[2] += sum(loose or other or token != canonical for _, other in known)
        for i, (value, _) in enumerate(known):
            out += [text[at:start] if not i else token, value]
            at = end
    return "".join(out) + text[at:] if out else text


def restore_parts(parts: list[str], asks: list[int], escapes: list[bool], book: dict[str, list]) -> tuple:
    """``body, restored, unresolved, degraded``; ``book`` has the vault rows ``(placeholder, original, escaped, unique_suffix)`` of each suffix looked up.

    Unsure where a restored text names a suffix that was not.
    """
    counts = [0, 0, 0]
    for i, escape in zip(asks, escapes):
        parts[i] = _put(_put(parts[i], False, book, escape, counts), True, book, escape, counts)
    return "".join(parts), *counts


RESTORED = "conn string, session string, unsure boolean, body string, response_model string, events bigint, restored bigint, unresolved bigint, degraded bigint"


def _values(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over ``conn, session, response_model, events, unsure, parts, asks, escapes, suffixes, found``, lists without nulls: rows of ``RESTORED``."""
    kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = [batch.column(i) for i in range(5, 10)]
        parts, asks, escapes, suffixes = (_values(c.flatten()) for c in lists[:4])
        suffix, *rows = (_values(c) for c in lists[4].flatten().flatten())
        rows = list(zip(*rows))
        ends = [(c.offsets.to_numpy() - c.offsets[0].as_py()).tolist() for c in lists]
        out = []
        for i, unsure in enumerate(_values(batch.column(4))):
            (p0, p1), (a0, a1), _, (s0, s1), (f0, f1) = ((e[i], e[i + 1]) for e in ends)
            try:
                if unsure:
                    raise Unsure
                if a0 == a1:
                    out.append((False, "".join(parts[p0:p1]), 0, 0, 0))
                    continue
                book: dict[str, list] = {s: [] for s in suffixes[s0:s1]}
                for at in range(f0, f1):
                    book[suffix[at]].append(rows[at])
                out.append((False, *restore_parts(parts[p0:p1], asks[a0:a1], escapes[a0:a1], book)))
            except Unsure:
                out.append((True, "", 0, 0, 0))
        unsure, body, *counts = (pa.array(c, k) for c, k in zip(zip(*out), kinds))
        conn, session, model, events = (batch.column(i) for i in range(4))
        yield pa.RecordBatch.from_arrays([conn, session, unsure, body, model, events, *counts], names=[c.split()[0] for c in RESTORED.split(", ")])
