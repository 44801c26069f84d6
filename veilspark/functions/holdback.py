"""Small text state machines shared by batch walks and streams: bytes, frames, held tails, cooldowns."""

from __future__ import annotations

import codecs
import re
import string

from veilspark import fixed_values as fx

# The start of a placeholder without brackets and backslashes; after ``[[`` it may lack only its last bracket.
PARTIAL = re.compile(r"|P|PI|PII|PII:[A-Za-z0-9_]*(?::[0-9a-fA-F]{0,8})?")
ALMOST_CLOSED = re.compile(r"\[\[PII:[A-Za-z0-9_]{1,32}:[0-9a-fA-F]{8}\]")
RUN = "[\\]:_" + string.ascii_letters + string.digits
BOUNDARY = re.compile(r"\r\n\r\n|\n\n")


def held_chars(text: str, limit: int = fx.PLACEHOLDER_MAX_LEN) -> int:
    """How many characters at the end may be the start of a placeholder."""
    end = text[-max(limit, 32):]
    if "[" not in end and "P" not in end and "\\" not in end:
        return 0
    tail = end[len(end.rstrip(RUN)):]
    if not tail or tail.lstrip("[\\")[:1] not in ("", "P"):
        return 0
    bare = tail.replace("\\", "")
    if bare.startswith("[[") and bare.endswith("]]"):
        return 0
    partial = PARTIAL.fullmatch(bare.replace("[", "")) or ALMOST_CLOSED.fullmatch(bare)
    return len(tail) if partial else 0


class Tail:
    """The held end of one channel: never longer than the start of a placeholder, however long a piece is."""

    def __init__(self, held: str = ""):
        self.held = held

    def push(self, text: str) -> str:
        buf = self.held + text
        cut = len(buf) - held_chars(buf)
        self.held = buf[cut:]
        return buf[:cut]

    def finish(self) -> str:
        out, self.held = self.held, ""
        return out


class Frames:
    """Frame cutter: complete frames leave at a blank line; a too long unfinished one is forced out."""

    def __init__(self, max_backlog: int, held: str = ""):
        self.held, self.max_backlog = held, max(max_backlog, 1024)

    def push(self, text: str) -> list[tuple[str, bool]]:
        self.held += text
        out, at = [], 0
        for m in BOUNDARY.finditer(self.held):
            out.append((self.held[at : m.end()], False))
            at = m.end()
        self.held = self.held[at:]
        if len(self.held.encode()) > self.max_backlog:
            out.append((self.held, True))
            self.held = ""
        return out

    def finish(self) -> list[tuple[str, bool]]:
        out = [(self.held, False)] if self.held else []
        self.held = ""
        return out


class Utf8:
    """Incremental decoder: characters cut between chunks are put together, invalid bytes are dropped."""

    def __init__(self, pending: bytes = b""):
        self.pending = pending

    def push(self, data: bytes) -> str:
        decoder = codecs.getincrementaldecoder("utf-8")(errors="ignore")
        out = decoder.decode(self.pending + data)
        self.pending = decoder.getstate()[0]
        return out

    def finish(self) -> str:
        out = self.pending.decode("utf-8", errors="replace")
        self.pending = b""
        return out


class Cooldown:
    """Anchored cooldown: the first event notifies; later ones once per period after the last notice."""

    def __init__(self, period: float, next_ts: float | None = None, count: int = 0, first_ts: float = 0.0):
        self.period, self.next_ts, self.count, self.first_ts = period, next_ts, count, first_ts

    def use(self, ts: float, n: int = 1) -> list[tuple[int, float, float]]:
        """Notices ``(count, first_ts, notice_ts)`` caused by n events at the same time."""
        if self.next_ts is None:
            self.first_ts = ts
        if self.next_ts is not None and ts < self.next_ts:
            self.count += n
            return []
        notice = (self.count + 1, self.first_ts, ts)
        self.next_ts, self.count, self.first_ts = ts + self.period, n - 1, ts
        return [notice]
