"""Rule-based detection: built-in and custom regex rules with validators, presets, dry runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.matching import Matcher, find
from veilspark.functions.spans import compute_once, let, once_per_session, resolve_overlaps, spans, uni

VALIDATORS = {"IDCARD", "BANKCARD", "IP"}


@dataclass(frozen=True)
class Rule:
    """A detection rule.  ``tag`` selects the validator, so a custom rule may reuse a built-in one."""

    id: str
    tag: str
    regex: str
    action: str = "mask"
    enabled: bool = True
    builtin: bool = False
    min_confirm: int = 1

    def __post_init__(self):
        tag = self.tag.strip().upper()
        if not tag:
            raise ValueError(f"rule {self.id}: the tag is empty")
        action = self.action if self.action in ("block", "warn") else "mask"
        need = max(self.min_confirm, 2) if action == "block" and tag in VALIDATORS else self.min_confirm
        object.__setattr__(self, "tag", tag)
        object.__setattr__(self, "action", action)
        object.__setattr__(self, "min_confirm", need)

    @property
    def validated(self) -> bool:
        return self.tag in VALIDATORS


def builtin_rules() -> list[Rule]:
    return [Rule(i, t, p, enabled=on, builtin=True) for i, t, p, on in fx.BUILTIN_RULES]


def preset_rules(preset: str, rules: list[Rule] | None = None) -> list[Rule]:
    """Switch the built-in rules to a preset; custom rules keep their settings."""
    table = fx.PRESETS.get(preset, fx.PRESETS["balanced"])
    out = []
    for r in rules if rules is not None else builtin_rules():
        if r.builtin and r.id in table:
            enabled, action = table[r.id]
            r = replace(r, enabled=enabled, action=action, min_confirm=r.min_confirm)
        out.append(r)
    return out


def preset_of(rules: list[Rule]) -> str:
    """The preset whose built-in (enabled, action) pairs all match, else ``custom``."""
    have = {r.id: (r.enabled, r.action) for r in rules}
    for name, table in fx.PRESETS.items():
        if all(have.get(i) == pair for i, pair in table.items()):
            return name
    return "custom"


BUILTIN_PATTERNS = {i: p for i, _, p, _ in fx.BUILTIN_RULES}

# Same matches as the built-in e-mail pattern, but a search starts only where a run of local-part
# characters starts (or where the last match ended), which keeps long words cheap.
FAST_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _java_pattern(rule: Rule) -> str:
    if rule.regex == BUILTIN_PATTERNS["builtin.email"]:
        return FAST_EMAIL
    return uni(rule.regex)


def _guard_key(rule: Rule) -> str:
    """Rules with the same key share one cheap test that is true whenever they can match."""
    if rule.regex != BUILTIN_PATTERNS.get(rule.id):
        return ""
    return {"EMAIL": "at", "APIKEY": "key", "IP": "dots"}.get(rule.tag, "digits")


def rule_matchers(rules: list[Rule]) -> list[Matcher]:
    checks = {"IDCARD": "idcard", "PHONE": "phone", "BANKCARD": "bankcard", "IP": "ip"}
    return [
        Matcher(
            _java_pattern(r), r.tag, i, check=checks.get(r.tag, ""), guard=_guard_key(r), action=r.action,
            rule_id=r.id, min_confirm=r.min_confirm, validated=r.validated,
        )
        for i, r in enumerate(rules)
        if r.enabled
    ]


def scan(text: Column, rules: list[Rule] | None = None, semantic=None, locker=None) -> Column:
    """Resolved hits of all sources for one text: rules, then semantic detectors, then locker values."""
    from veilspark.operators.locker import locker_matchers
    from veilspark.operators.semantic import semantic_matchers

    matchers = rule_matchers(builtin_rules() if rules is None else rules)
    if semantic is not None:
        matchers += semantic_matchers(semantic)
    if locker:
        matchers += locker_matchers(locker)
    return resolve_overlaps(find(text, matchers))


@once_per_session
def _scan_of(text: str, rules, semantic, locker) -> Column:
    return scan(F.col(text), rules, semantic, locker)


@once_per_session
def _find_of(text: str, matchers) -> Column:
    return find(F.col(text), list(matchers))


def with_hits(
    messages: DataFrame, rules=None, semantic=None, locker=None, text: str = "body", out: str = "hits"
) -> DataFrame:
    """Add the resolved hit array; one narrow pass over the text, no shuffle."""
    rules = None if rules is None else tuple(rules)
    return compute_once(messages, **{out: _scan_of(text, rules, semantic, tuple(locker or ()))})


def hits_long(scanned: DataFrame, keys: list[str], hits: str = "hits", originals: bool = False) -> DataFrame:
    """One row per hit.  The matched text is left out unless a vault needs it."""
    names = ["start", "len", "tag", "action", "rule_id", "min_confirm", "validated", "locker_entry"]
    if originals:
        names.append("original")
    return scanned.select(*keys, F.explode(hits).alias("h")).select(
        *keys, *[F.col(f"h.{n}").alias(n) for n in names]
    )


def detect(messages: DataFrame, rule: Rule, keys: list[str], text: str = "body") -> DataFrame:
    """Hit rows of one rule, whether or not it is switched on."""
    return find_long(messages, rule_matchers([replace(rule, enabled=True)]), keys, text)


def find_long(messages: DataFrame, matchers: list[Matcher], keys: list[str], text: str = "body") -> DataFrame:
    """Hit rows of some matchers, overlaps included."""
    return hits_long(compute_once(messages.select(*keys, text), hits=_find_of(text, tuple(matchers))), keys)


def regex_spans(messages: DataFrame, pattern: str, keys: list[str], text: str = "body") -> DataFrame:
    """Every match of a pattern with its character offset and length."""
    return (
        messages.select(*keys, F.explode(spans(F.col(text), uni(pattern))).alias("s"))
        .select(*keys, F.col("s.start").alias("start"), F.col("s.len").alias("len"), F.col("s.text").alias("text"))
    )


def rule_dry_run(messages: DataFrame, patterns: dict[str, str], text: str = "body") -> DataFrame:
    """Try candidate patterns on a corpus: messages and matches per pattern, without validators."""
    for p in patterns.values():
        re.compile(p)
    counts = [F.regexp_count(F.col(text), F.lit(uni(p))).alias(f"c{i}") for i, p in enumerate(patterns.values())]
    aggs = []
    for i in range(len(patterns)):
        aggs.append(F.count_if(F.col(f"c{i}") > 0).alias(f"n{i}"))
        aggs.append(F.coalesce(F.sum(F.col(f"c{i}")), F.lit(0)).cast("bigint").alias(f"s{i}"))
    totals = messages.select(*counts).agg(*aggs)
    rows = [
        F.struct(F.lit(name).alias("rule"), F.col(f"n{i}").alias("messages"), F.col(f"s{i}").alias("matches"))
        for i, name in enumerate(patterns)
    ]
    return totals.select(F.inline(F.array(*rows)))


def rule_samples(messages: DataFrame, patterns: dict[str, str], key: str, k: int = 10, text: str = "body") -> DataFrame:
    """``rule, messages, matches, samples``: a dry run that also shows up to ``k`` matches ``(key, start, len)`` of each pattern.

    Each match falls by its hash into one of ``k`` places, which keeps the least hash; so the sample is the same on every run, is spread over
    the corpus, and is put together like a minimum: one scan, one narrow aggregate.
    """
    for p in patterns.values():
        re.compile(p)

    def row(name: str, pattern: str) -> Column:
        hits = F.transform(spans(F.col(text), uni(pattern)), lambda s: F.struct(
            F.md5(F.concat_ws(":", F.lit(name), F.col(key).cast("string"), s["start"].cast("string"))).alias("h"), s["start"].alias("start"), s["len"].alias("len")))
        place = lambda h: F.conv(F.substring(h["h"], 1, 8), 16, 10).cast("bigint") % k
        least = let(hits, lambda hs: F.struct(
            F.lit(name).alias("rule"), F.size(hs).cast("bigint").alias("n"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.array_min(F.filter(hs, lambda h: place(h) == i))).alias("least")))
        return least

    rows = compute_once(messages.select(key, text), __rows=F.array(*[row(n, p) for n, p in patterns.items()])).select(key, F.inline("__rows"))
    chosen = [F.min(F.when(F.get("least", F.lit(i)).isNotNull(), F.struct(F.get("least", F.lit(i)).alias("m"), F.col(key).alias("key")))).alias(f"p{i}") for i in range(k)]
    per = rows.groupBy("rule").agg(F.count_if(F.col("n") > 0).alias("messages"), F.sum("n").alias("matches"), *chosen)
    found = F.filter(F.array(*[F.col(f"p{i}") for i in range(k)]), lambda x: x.isNotNull())
    return per.select("rule", "messages", "matches", F.transform(F.array_sort(found), lambda x: F.struct(x["key"].alias("key"), x["m"]["start"].alias("start"), x["m"]["len"].alias("len"))).alias("samples"))


def preset_compare(messages: DataFrame, text: str = "body", presets=("conservative", "balanced", "aggressive")) -> DataFrame:
    """Messages masked and blocked under each preset, from one scan of the corpus."""
    per = []
    for p in presets:
        hits = let(
            _scan_of(text, tuple(preset_rules(p)), None, ()),
            lambda hs: F.struct(
                F.lit(p).alias("preset"), (F.size(hs) > 0).alias("hit"), block_gate(hs).alias("blocked")
            ),
        )
        per.append(hits)
    return (
        messages.select(F.inline(F.array(*per)))
        .groupBy("preset")
        .agg(
            F.count_if(F.col("hit") & ~F.col("blocked")).alias("masked"),
            F.count_if("blocked").alias("blocked"),
            F.count_if(~F.col("hit")).alias("clean"),
        )
    )


def block_gate(hits: Column) -> Column:
    """True when some blocking rule has at least its number of confirmations in this hit list."""
    blocking = F.filter(hits, lambda h: h["action"] == "block")
    return let(
        blocking,
        lambda bs: F.exists(
            F.array_distinct(F.transform(bs, lambda b: F.struct(b["rule_id"].alias("r"), b["min_confirm"].alias("m")))),
            lambda k: F.size(F.filter(bs, lambda b: b["rule_id"] == k["r"])) >= F.greatest(k["m"], F.lit(1)),
        ),
    )
