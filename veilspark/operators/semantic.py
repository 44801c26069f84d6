"""Heuristic detectors: high-entropy tokens, person names, organisations, addresses, custom terms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.checks import shannon_bits
from veilspark.functions.matching import Matcher
from veilspark.functions.spans import let

PRI_BASE = 10_000
HAN = "[一-龥]"


@dataclass(frozen=True)
class SemanticConfig:
    """Switches of the heuristic layer; only addresses are on by default."""

    entropy: bool = False
    person: bool = False
    org: bool = False
    address: bool = True
    terms: tuple[str, ...] = field(default_factory=tuple)


def clean_terms(terms, max_chars: int | None = None, max_count: int | None = None) -> tuple[str, ...]:
    """Trim, drop blanks, keep the first of equal (case-insensitive) terms.

    Longer terms and terms beyond a number are dropped only if asked for.  A long list belongs in a table
    (``operators.dictionary``): each term given here is a pattern in the plan.
    """
    seen: dict[str, str] = {}
    for raw in terms:
        t = raw.strip()
        if t and (max_chars is None or len(t) <= max_chars):
            seen.setdefault(t.lower(), t)
    return tuple(list(seen.values())[:max_count])


def _alt(words) -> str:
    return "(?:" + "|".join(words) + ")"


def entropy_ok(t: Column) -> Column:
    """Mixed character classes, enough entropy, and neither a bare hex digest nor a UUID shape."""
    classes = sum(
        (F.rlike(t, F.lit(c)).cast("int") for c in ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0)
    )
    uuid_like = (F.length(t) == 36) & (F.substring(t, 9, 1) == "-")
    return (
        ~uuid_like
        & (classes >= fx.ENTROPY_MIN_CLASSES)
        & ~F.rlike(t, F.lit("^[0-9A-Fa-f]+$"))
        & (shannon_bits(t) >= fx.ENTROPY_MIN_BITS)
    )


PERSON_PATTERN = _alt([*fx.COMPOUND_SURNAMES, *fx.SINGLE_SURNAMES]) + HAN + "{1,2}"
AREA_PATTERN = _alt(fx.REGIONS) + HAN + "{0,8}" + _alt(fx.AREA_UNITS)
ORG_PATTERN = "[一-龥A-Za-z0-9]{2,14}" + _alt(fx.ORG_SUFFIXES)


def person_ok(s: Column) -> Column:
    """Not a common word or place; a title follows or a context word precedes."""
    return ~s["text"].isin(*fx.PERSON_BLOCKLIST, *fx.REGIONS) & (
        F.rlike(s["after"], F.lit("^" + _alt(fx.TITLES_AFTER))) | F.rlike(s["before"], F.lit(_alt(fx.CONTEXT_BEFORE)))
    )


def org_ok(s: Column) -> Column:
    """What is left without suffix and leading function words is a name of its own."""
    core = F.regexp_replace(
        F.regexp_replace(s["text"], _alt(fx.ORG_SUFFIXES) + r"\z", ""), f"^[{fx.ORG_LEADING}]+", ""
    )
    return let(
        core,
        lambda c: (F.length(c) >= 2) & ~F.rlike(c, F.lit(_alt(fx.ORG_BLOCKLIST))) & ~F.rlike(c, F.lit("^[0-9]+$")),
    )


def area_ok(s: Column) -> Column:
    return ~F.rlike(s["after"], F.lit(f"^[{fx.AREA_BAD_NEXT}]")) & ~F.endswith(s["text"], F.lit("区间"))


def _quote(word: str) -> str:
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def term_matchers(terms) -> list[Matcher]:
    """One matcher per dictionary term; plain words match whole words in any case."""
    out = []
    for i, t in enumerate(clean_terms(terms)):
        word = t.isascii() and t.isalnum()
        pattern = f"(?iU)(?<![A-Za-z0-9]){_quote(t)}(?![A-Za-z0-9])" if word else _quote(t)
        out.append(Matcher(pattern, "CUSTOM_TERM", PRI_BASE + 10 + i, needle=t.lower() if word else t, any_case=word))
    return out


def semantic_matchers(cfg: SemanticConfig) -> list[Matcher]:
    out = []
    if cfg.entropy:
        out.append(Matcher(fx.ENTROPY_TOKEN, "HIGH_ENTROPY", PRI_BASE, check="entropy"))
    if cfg.person:
        out.append(Matcher(PERSON_PATTERN, "PERSON", PRI_BASE + 1, check="person", guard="han"))
    if cfg.org:
        out.append(Matcher(ORG_PATTERN, "ORG", PRI_BASE + 2, check="org", guard="han"))
    if cfg.address:
        out.append(Matcher(AREA_PATTERN, "ADDRESS", PRI_BASE + 3, check="area", guard="han"))
        out.append(Matcher(fx.STREET_PATTERN, "ADDRESS", PRI_BASE + 4, guard="han"))
    return out + term_matchers(cfg.terms)
