"""Secret scans: fixed shapes, and strings that a public vocabulary cannot shorten."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed shapes: kind, pattern, group whose length counts, least length.  Letters of names are spelled in both cases,
# because case-blind matching would also take letters beyond ASCII.
SHAPES = [
    (
        "assign",
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1, 6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
KINDS = ["assign", "access", "hex", "dense"]
# Strings that look random and are none: digests by their lengths in hex digits, UUIDs, serial numbers, and the like.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z]+(?:[_/-][A-Za-z0-9]+)+|[0-9_/+=-]+|[A-Za-z][a-z]*(?:[A-Z][a-z]+)*[0-9]{0,4}"
# Words as parts of identifiers, the length from which their tokens decide, and the least length of what is left.
WORD = r"[A-Za-z][a-z]*(?:[A-Z][a-z]+)*[0-9]{0,4}|[A-Z]+[0-9]{0,4}"
LONG_PART, LEAST_LEFT = 12, 16
WINDOW = 4096


def tokenizer(vocabulary: bytes, pattern: str):
    """A byte-level BPE encoder from the lines ``base64-token rank``."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def known(string: str) -> bool:
    """True for digests, UUIDs and identifiers made of words, which are no secrets."""
    if re.fullmatch(r"[0-9a-fA-F]+", string):
        return len(string) in DIGEST_LENGTHS or string.isdigit()
    return bool(re.fullmatch(IDENTIFIER, string))


def part_known(part: str, count, most: float) -> bool:
    """True for the parts of identifiers that are words, numbers or digests; a part of some length must also be as short in tokens as words are."""
    if re.fullmatch(r"[0-9+=]*", part) or (re.fullmatch(r"[0-9a-fA-F]+", part) and len(part) in DIGEST_LENGTHS):
        return True
    if len(part) < LONG_PART:
        return bool(re.fullmatch(WORD, part))
    return len(part) >= most * weight(part, count)


def weight(s: str, count) -> int:
    # A very long string is weighed in pieces, because merging is slower than linear in the length.
    return sum(count(s[i : i + WINDOW]) for i in range(0, len(s), WINDOW))


def dense(s: str, count, most: float) -> bool:
    """True if a string, or what is left of it without its known parts, needs a token for each ``most`` characters or fewer."""
    parts = [p for p in re.split("[_/-]", re.sub(UUID, "-", s)) if not part_known(p, count, most)]
    left = sum(map(len, parts))
    if left >= LEAST_LEFT and left < most * sum(weight(p, count) for p in parts):
        return True
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)) or known(s) or re.search(UUID, s):
        return False
    return len(s) < most * weight(s, count)


def dense_spans(text: str, count, most: float) -> list[tuple[int, int]]:
    """Strings of 20 characters or more that are dense."""
    return [m.span() for m in re.finditer(CANDIDATE, text) if dense(m[0], count, most)]


def uncovered(span: tuple[int, int], taken) -> list[tuple[int, int]]:
    """The parts of a span that no sorted span of ``taken`` covers."""
    at, out = span[0], []
    for a, b in taken:
        if b > at and a < span[1]:
            if a > at:
                out.append((at, a))
            at = b
    return [*out, (at, span[1])] if at < span[1] else out


def base_spans(text: str, shapes) -> list[tuple[int, int, int]]:
    """``(start, kind, end)``; leftmost matches without overlap for each kind, failing ones dropped after matching."""
    found = []
    for kind, (pattern, group, least) in enumerate(shapes):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(vocabulary: bytes, token_pattern: str, most: float):
    schema = pa.schema([("row", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_dense", pa.int64()),
                        ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])

    def run(batches, redact):
        enc = tokenizer(vocabulary, token_pattern)
        # Runs of hex digits shorter than the least length are as many as words; a bounded pattern finds the same long runs.
        shapes = [(re.compile(p if k != "hex" else f"[0-9a-f]{{{n},}}"), g, n) for k, p, g, n in SHAPES]
        count = lambda s: len(enc.encode_ordinary(s))
        for batch in batches:
            out: list[dict] = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text, shapes)
                taken = sorted((a, b) for a, _, b in base)
                every = sorted(base + [(a, 3, b) for span in dense_spans(text, count, most) for a, b in uncovered(span, taken)])
                kinds = [k for _, k, _ in every]
                out.append({
                    "row": row, "n_assign": kinds.count(0), "n_access": kinds.count(1), "n_hex": kinds.count(2), "n_dense": kinds.count(3),
                    "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(every), "redacted": mask(text, every) if redact and every else None,
                })
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def mask(text: str, spans) -> str:
    """Spans replaced by ``[secret]``; overlapping ones become one."""
    parts, at = [], 0
    for a, _, b in spans:
        if a >= at:
            parts += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


OUT = "n_assign bigint, n_access bigint, n_hex bigint, n_dense bigint, base_sha256 string, spans string, redacted string"


def scan_secrets(docs: DataFrame, vocabulary: bytes, token_pattern: str, most: float = 2.0, redact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts per kind, ``base_sha256``, ``spans`` and, with ``redact``, the masked text (null if nothing was found).

    The kinds assign, access and hex are fixed shapes.  Kind dense is the token-efficiency test: strings of at
    least 20 characters whose characters per token under the vocabulary lie below ``most``, whole or without those parts (cut at _ / -) that are
    words, numbers, digests or UUIDs; of a string that a fixed shape covers in part the rest is dense.  A null text is empty and an empty one has no span;
    repeated rows give repeated rows; a null id stays null.  Texts are scanned whole; other columns are not read.
    """
    scan = _scan(vocabulary, token_pattern, most)
    rows = docs.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: scan(batches, redact), f"row bigint, {OUT}").withColumnRenamed("row", "doc_id")
