"""Matchers: many patterns over one text with a single span kernel.

Each pattern only contributes its gaps and matches; one shared walk turns them into offsets, applies the
check of the matcher and builds the hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.checks import id_card_ok, ipv4_ok, luhn_ok
from veilspark.functions.spans import HITS_TYPE, PART_TYPE, digit_adjacent, empty, match_parts, walk_parts

META = (
    "pri:int,tag:string,check:string,action:string,rule_id:string,min_confirm:int,validated:boolean,"
    "entry:string,value:string"
)
PARTS_TYPE = f"array<struct<{PART_TYPE},meta:struct<{META}>>>"
BEHIND, AHEAD = 8, 3


@dataclass(frozen=True)
class Matcher:
    """A pattern and what its hits look like.

    ``guard`` names a cheap test shared by several matchers.  ``needle`` is a literal that must occur, for
    dictionaries.  ``value`` replaces the matched text when the pattern only marks a place.
    """

    pattern: str
    tag: str
    pri: int
    check: str = ""
    guard: str = ""
    action: str = "mask"
    rule_id: str = ""
    min_confirm: int = 1
    validated: bool = False
    needle: str | None = None
    any_case: bool = False
    entry: str | None = None
    value: str | None = None

    def meta_sql(self) -> str:
        def text(v):
            if v is None:
                return "cast(null as string)"
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

        return (
            f"named_struct('pri', {self.pri}, 'tag', {text(self.tag)}, 'check', {text(self.check)}, 'action', {text(self.action)},"
            f" 'rule_id', {text(self.rule_id)}, 'min_confirm', {self.min_confirm}, 'validated', {str(self.validated).lower()},"
            f" 'entry', {text(self.entry)}, 'value', {text(self.value)})"
        )


DIGIT_RUN = r"(?=\p{Nd})\p{Nd}{11}"
DOTTED_PAIR = r"(?=\p{Nd})\p{Nd}{1,3}\.\p{Nd}{1,3}\."


def _guard(key: str, text: Column) -> Column:
    if key == "at":
        return F.contains(text, F.lit("@"))
    if key == "key":
        return F.contains(text, F.lit("sk-")) | F.contains(text, F.lit("AKIA"))
    return F.rlike(text, F.lit({"dots": DOTTED_PAIR, "digits": DIGIT_RUN, "han": "[一-龥]"}[key]))


def _checks():
    from veilspark.operators.semantic import area_ok, entropy_ok, org_ok, person_ok

    return {
        "idcard": lambda s: id_card_ok(s["text"]) & ~digit_adjacent(s),
        "phone": lambda s: ~digit_adjacent(s),
        "bankcard": lambda s: luhn_ok(s["text"]) & ~digit_adjacent(s),
        "ip": lambda s: ipv4_ok(s["text"]),
        "entropy": lambda s: entropy_ok(s["text"]),
        "person": person_ok,
        "org": org_ok,
        "area": area_ok,
    }


def _check(meta: Column, s: Column, used: list[str]) -> Column:
    table = _checks()
    test = None
    for name in used:
        cond = meta["check"] == name
        test = F.when(cond, table[name](s)) if test is None else test.when(cond, table[name](s))
    return F.lit(True) if test is None else test.otherwise(F.lit(True))


def _hit(meta: Column, s: Column) -> Column:
    """Field order is resolution order: start, longest, source order."""
    text = F.coalesce(meta["value"], s["text"])
    return F.struct(
        s["start"].alias("start"),
        (-F.length(text)).alias("neg_len"),
        meta["pri"].alias("pri"),
        F.length(text).alias("len"),
        meta["tag"].alias("tag"),
        meta["action"].alias("action"),
        meta["rule_id"].alias("rule_id"),
        meta["min_confirm"].alias("min_confirm"),
        meta["validated"].alias("validated"),
        meta["entry"].alias("locker_entry"),
        text.alias("original"),
    )


def _dictionary(text: Column, matchers: list[Matcher]) -> Column:
    """Parts of literal matchers; only literals contained in the text are searched for offsets."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m.needle).alias("needle"), F.lit(m.any_case).alias("any_case"), F.lit(m.pattern).alias("pattern"),
                F.expr(m.meta_sql()).alias("meta"),
            )
            for m in matchers
        ]
    )
    present = F.filter(
        rows, lambda r: F.contains(F.when(r["any_case"], F.lower(text)).otherwise(text), r["needle"])
    )
    parts = F.transform(present, lambda r: match_parts(text, r["pattern"], r["meta"].alias("meta")))
    return F.flatten(F.filter(parts, lambda p: p.isNotNull()))


def find(text: Column, matchers: list[Matcher]) -> Column:
    """All hits of all matchers, not yet resolved."""
    none = F.array().cast(PARTS_TYPE)
    groups: dict[str, list[Column]] = {}
    for m in matchers:
        if m.needle is None:
            part = F.coalesce(match_parts(text, m.pattern, F.expr(m.meta_sql()).alias("meta")), none)
            groups.setdefault(m.guard, []).append(part)
    sources = groups.pop("", [])
    for key, parts in groups.items():
        sources.append(F.when(_guard(key, text), F.concat(*parts)).otherwise(none))
    literal = [m for m in matchers if m.needle is not None]
    if literal:
        sources.append(_dictionary(text, literal))
    if not sources:
        return empty(HITS_TYPE)
    used = sorted({m.check for m in matchers if m.check})
    hits = F.flatten(
        F.transform(
            F.concat(*sources),
            lambda p: F.transform(
                F.filter(walk_parts(p, BEHIND, AHEAD), lambda s: _check(p["meta"], s, used)),
                lambda s: _hit(p["meta"], s),
            ),
        )
    )
    return F.coalesce(hits, empty(HITS_TYPE))
