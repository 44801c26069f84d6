"""Risk signals: read-only findings ``(keys, pos, signal, severity, kind, evidence)``.

Text signals are column expressions over one row, so a whole audit is one narrow pass; only
de-duplication and the joins with requests or markers shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.checks import shannon_bits
from veilspark.functions.json_text import tool_result_texts, vget, vstr
from veilspark.functions.spans import let, uni
from veilspark.functions.text import (
    clip,
    code_fence_strip,
    model_family,
    redact_evidence,
    severity_rank,
    short_hash,
    trim_space,
)

FINDING = "struct<signal:string,severity:string,kind:string,evidence:string>"
FINDINGS = f"array<{FINDING}>"


def finding(signal: str, severity, kind, evidence: Column) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        F.lit(signal).alias("signal"), col(severity).alias("severity"), col(kind).alias("kind"), evidence.alias("evidence")
    )


def none() -> Column:
    return F.array().cast(FINDINGS)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(uni(pattern)), F.lit(group))


def findings_long(df: DataFrame, keys: list[str], findings: Column) -> DataFrame:
    """One row per finding, with its position in the response."""
    return df.select(*keys, F.posexplode(findings).alias("pos", "f")).select(*keys, "pos", "f.*")


def dedupe_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Equal (kind, evidence) of one response become one row with a count; the first position is kept."""
    return (
        findings.groupBy(*keys, "kind", "evidence")
        .agg(
            F.min("pos").alias("pos"),
            F.min_by(F.struct("signal", "severity"), "pos").alias("f"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            *keys, "pos", "f.signal", "f.severity", "kind",
            F.when(F.col("n") > 1, F.concat(F.col("evidence"), F.lit(" (x"), F.col("n").cast("string"), F.lit(")")))
            .otherwise(F.col("evidence")).alias("evidence"),
        )
    )


# --- error replies ------------------------------------------------------------------------------


def _any_contains(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _redacted(signal: str, severity: str, kind: str):
    """Match to finding with kind, length and hash."""
    return lambda m: finding(signal, severity, kind, redact_evidence(m, kind))


def _quoted(signal: str, severity: str, kind: str, limit: int):
    """Match to finding with the start of the match."""
    return lambda m: finding(signal, severity, kind, F.concat(F.lit(kind + ": "), F.left(m, F.lit(limit))))


def leak_credentials(hay: Column) -> Column:
    out = []
    for pattern, kind, severity in fx.LEAK_CREDENTIALS:
        kept = F.filter(all_matches(hay, pattern), lambda s: ~_any_contains(F.lower(s), fx.SELF_CHECK_MARKERS))
        out.append(F.transform(kept, _redacted("error_leak", severity, kind)))
    return F.concat(*out)


def leak_env(hay: Column) -> Column:
    """``NAME_KEY=value`` with a long, mixed value.  The value may be part of the next match's text."""
    stop = "".join("\\" + c if c in "]}" else c for c in fx.ENV_VALUE_END)
    pattern = uni(fx.ENV_CREDENTIAL) + f"(?=([^{stop}]*))"
    pairs = F.arrays_zip(
        F.regexp_extract_all(hay, F.lit(pattern), F.lit(0)).alias("name"),
        F.regexp_extract_all(hay, F.lit(pattern), F.lit(1)).alias("value"),
    )
    runs = fx.ORDERED_RUNS + [r[::-1] for r in fx.ORDERED_RUNS]
    kept = F.filter(
        pairs,
        lambda p: (F.length(p["value"]) >= fx.ENV_VALUE_MIN_CHARS)
        & (shannon_bits(p["value"]) >= fx.ENV_VALUE_MIN_BITS)
        & ~_any_contains(F.lower(p["value"]), runs),
    )
    return F.transform(
        kept, lambda p: finding("error_leak", "HIGH", "env_var", F.concat(F.lit("env_var: "), F.left(p["name"], F.lit(60))))
    )


def leak_paths(hay: Column) -> Column:
    out = []
    for pattern, kind in fx.LEAK_PATHS:
        out.append(F.transform(all_matches(hay, pattern), _quoted("error_leak", "LOW", kind, 60)))
    return F.concat(*out)


def error_haystack(body: Column, headers: Column) -> Column:
    return F.concat(F.coalesce(body, F.lit("")), F.lit("\n"), F.coalesce(headers, F.lit("")))


def sig_error_leak(responses: DataFrame, keys: list[str], parts=(leak_credentials, leak_env, leak_paths)) -> DataFrame:
    """Leaks in replies with status 400 and above; needs ``status, body, headers``."""
    bad = responses.where("status >= 400").withColumn("hay", error_haystack(F.col("body"), F.col("headers")))
    return dedupe_findings(findings_long(bad, keys, F.concat(*[p(F.col("hay")) for p in parts])), keys)


# --- request against reply ------------------------------------------------------------------------


def sig_identity_swap(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Model family asked for against the one that answered; both must be known."""
    a, b = model_family(F.col("req_model")), model_family(F.col("resp_model"))
    ev = F.concat(
        F.lit("model_mismatch: req="), F.left("req_model", F.lit(60)), F.lit(" resp="), F.left("resp_model", F.lit(60))
    )
    hit = pairs.where((a != "") & (b != "") & (a != b))
    return hit.select(
        *keys, F.lit(0).alias("pos"), F.lit("identity_swap").alias("signal"), F.lit("HIGH").alias("severity"),
        F.lit("model_mismatch").alias("kind"), ev.alias("evidence"),
    )


def _echo_core(s: Column) -> Column:
    t = trim_space(s)
    fenced = F.startswith(t, F.lit("```"))
    body = F.when(fenced & F.contains(t, F.lit("\n")), F.regexp_replace(t, r"(?s)^[^\n]*\n", "")).otherwise(t)
    cut = F.when(
        fenced & F.contains(body, F.lit("```")), F.regexp_extract(body, r"(?s)^(.*)```", 1)
    ).otherwise(body)
    return F.regexp_replace(cut, "^[ >#$`\"']+|[ >#$`\"']+\\z", "")


def classify_tool_echo(expected: Column, actual: Column) -> Column:
    """``exact``, ``whitespace`` or ``substituted``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def words(c: Column) -> Column:
        return F.regexp_replace(trim_space(c), r"(?U)\s+", " ")

    return let(
        F.struct(_echo_core(expected).alias("e"), _echo_core(actual).alias("a")),
        lambda p: F.when(p["e"] == p["a"], "exact")
        .when(
            (words(p["e"]) == words(p["a"]))
            | (F.translate(p["e"], upper, lower) == F.translate(p["a"], upper, lower)),
            "whitespace",
        )
        .otherwise("substituted"),
    )


def sig_tool_echo(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A fixed command that had to be repeated word by word; needs ``expected, actual``."""
    df = pairs.where("expected <> '' AND actual <> ''").withColumn(
        "verdict", classify_tool_echo(F.col("expected"), F.col("actual"))
    )
    ev = F.concat(
        F.lit("expected='"), F.left("expected", F.lit(40)), F.lit("' actual='"), F.left("actual", F.lit(40)),
        F.lit("' verdict="), F.col("verdict"),
    )
    return df.where("verdict <> 'exact'").select(
        *keys, F.lit(0).alias("pos"), F.lit("tool_call_rewrite").alias("signal"),
        F.when(F.col("verdict") == "whitespace", "LOW").otherwise("MEDIUM").alias("severity"),
        F.lit("tool_echo").alias("kind"), ev.alias("evidence"),
    )


# --- stream events ----------------------------------------------------------------------------------


def event_facts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Small facts per stream event ``(seq, event_type, data)``.

    The cap is part of the signal, and it also bounds what one reply can send to one task.
    """
    v = F.col("v")
    usage = F.coalesce(vget(v, "$.usage"), vget(v, "$.message.usage"), vget(v, "$.response.usage"))

    def tokens(*names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(F.col("u"), f"$.{n}", "bigint") for n in names])

    facts = events.withColumn("v", F.try_parse_json("data")).withColumn("u", usage).select(
        *keys,
        "seq",
        F.coalesce(vstr(v, "$.type"), F.col("event_type")).alias("etype"),
        F.coalesce(
            vget(v, "$.choices"), vget(v, "$.delta"), vget(v, "$.usage"), vget(v, "$.system_fingerprint")
        ).isNotNull().alias("open_shape"),
        tokens("input_tokens", "prompt_tokens").alias("input"),
        tokens("output_tokens", "completion_tokens").alias("output"),
        F.coalesce(F.trim(vstr(v, "$.signature_delta")) == "", F.lit(False)).alias("blank_signature"),
    )
    return facts


def sig_stream(events: DataFrame, keys: list[str], kinds=None) -> DataFrame:
    """Unknown event types, falling output counts, changing input counts, blank signatures."""
    facts = event_facts(events, keys)
    unknown = F.col("etype").isNotNull() & ~F.col("etype").isin(*fx.KNOWN_STREAM_EVENTS) & ~F.col("open_shape")
    order = W.partitionBy(*keys).orderBy("seq")
    prev = F.last("output", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    per = (
        facts.withColumn("prev", prev)
        .groupBy(*keys)
        .agg(
            F.count_if(unknown).alias("n_unknown"),
            F.min_by(F.when(unknown, F.left("etype", F.lit(40))), F.when(unknown, F.col("seq"))).alias("sample"),
            F.min(
                F.when(F.col("output") < F.col("prev"), F.struct("seq", "prev", "output"))
            ).alias("drop"),
            F.count("input").alias("n_input"),
            F.min_by("input", F.when(F.col("input").isNotNull(), F.col("seq"))).alias("first_input"),
            (F.min("input") != F.max("input")).alias("changing"),
            F.count_if("blank_signature").alias("n_blank"),
        )
    )

    def text(c) -> Column:
        return F.col(c).cast("string")

    rows = F.array(
        F.when(
            F.col("n_unknown") > 0,
            finding("sse_anomaly", "LOW", "unknown_event",
                    F.concat(F.lit("unknown_event: "), F.col("sample"), F.lit(" (count="), text("n_unknown"), F.lit(")"))),
        ),
        F.when(
            F.col("drop").isNotNull(),
            finding("sse_anomaly", "LOW", "usage_regress",
                    F.concat(F.lit("output_tokens_regress: "), text("drop.prev"), F.lit(" -> "), text("drop.output"))),
        ),
        F.when(
            F.col("changing"),
            finding("sse_anomaly", "LOW", "usage_inconsistent",
                    F.concat(F.lit("input_tokens_inconsistent: first=Some("), text("first_input"), F.lit(") samples="), text("n_input"))),
        ),
        F.when(
            F.col("n_blank") > 0,
            finding("sse_anomaly", "LOW", "empty_signature", F.concat(F.lit("empty_signature_delta: "), text("n_blank"))),
        ),
    )
    out = findings_long(per, keys, rows).where("signal IS NOT NULL")
    return out if kinds is None else out.where(F.col("kind").isin(*kinds))


# --- reply text -----------------------------------------------------------------------------------------


def hidden_unicode(text: Column) -> Column:
    def tier(pattern: str, least: int, severity: str, note: str) -> Column:
        def build(ms: Column) -> Column:
            sample = F.array_join(
                F.transform(F.slice(ms, 1, 5), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))), ","
            )
            ev = F.concat(
                F.lit("hidden_unicode: "), sample, F.lit(" (count="), F.size(ms).cast("string"), F.lit(f") [{note}]")
            )
            return F.when(F.size(ms) >= least, F.array(finding("response_poison", severity, "hidden_unicode", ev))).otherwise(none())

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)

    any_hidden = F.rlike(text, F.lit("[" + fx.BIDI_CHARS[1:-1] + fx.ZERO_WIDTH_CHARS[1:-1] + "]"))
    both = F.concat(
        tier(fx.BIDI_CHARS, 1, "HIGH", fx.BIDI_NOTE),
        tier(fx.ZERO_WIDTH_CHARS, fx.ZERO_WIDTH_MIN, "MEDIUM", fx.ZERO_WIDTH_NOTE),
    )
    return F.when(any_hidden, both).otherwise(none())


def exfil_urls(text: Column) -> Column:
    """Auto-loaded addresses outside code fences that carry a long query value."""

    def build(plain: Column) -> Column:
        urls = F.concat(all_matches(plain, fx.MARKDOWN_IMAGE, 1), all_matches(plain, fx.HTML_SRC, 1))
        carried = F.filter(urls, lambda u: F.regexp_extract(u, uni(fx.QUERY_PAYLOAD), 1) != "")

        def one(u: Column) -> Column:
            host = F.left(F.regexp_extract(u, r"^[^:]*://([^/?]*)", 1), F.lit(120))
            payload = F.length(F.regexp_extract(u, uni(fx.QUERY_PAYLOAD), 1)).cast("string")
            ev = F.concat(
                F.lit("exfil_url host="), host, F.lit(" len="), F.length(u).cast("string"), F.lit(" sha256="), short_hash(u),
                F.lit(" [渲染即自动请求，query 载荷 "), payload, F.lit(" 字符]"),
            )
            return finding("response_poison", "HIGH", "exfil_url", ev)

        return F.transform(carried, one)

    return F.when(F.contains(text, F.lit("http")), let(code_fence_strip(text), build)).otherwise(none())


def credential_echoes(text: Column, request_text: Column) -> Column:
    out = []
    for pattern, kind in fx.CREDENTIAL_ECHOES:
        fresh = F.filter(
            all_matches(text, pattern), lambda m: ~F.contains(F.coalesce(request_text, F.lit("")), m)
        )
        out.append(F.transform(fresh, _redacted("response_poison", "MEDIUM", kind)))
    return F.concat(*out)


def response_poison(text: Column, request_text: Column) -> Column:
    return F.concat(hidden_unicode(text), exfil_urls(text), credential_echoes(text, request_text))


COMMAND_WORD = (
    r"(?iU)\b(?:rm|del|erase|format|Remove-Item|dd|mkfs|drop|truncate|delete|update|git|kubectl|terraform|aws|curl|wget)\b|:\(\)"
)


def _by_kind(rows) -> dict[str, list]:
    kinds: dict[str, list] = {}
    for r in rows:
        kinds.setdefault(r[1], []).append(r)
    return kinds


def _command_test(asked: Column, check: str | None):
    """A match counts if its form check holds and the request did not contain it."""
    return lambda m: _command_ok(m, check) & ((trim_space(m) == "") | ~F.contains(asked, trim_space(m)))


def _command_ok(m: Column, check: str | None) -> Column:
    if check == "no_where":
        return ~F.contains(F.lower(m), F.lit("where"))
    if check == "forced_push":
        lone = F.rlike(m, F.lit(r"(?<![A-Za-z0-9_-])-f(?![A-Za-z0-9_-])"))
        return ~F.contains(m, F.lit("--force-with-lease")) & (F.contains(m, F.lit("--force")) | lone)
    return F.lit(True)


def dangerous_actions(text: Column, request_text: Column) -> Column:
    """One finding per kind: the first match, in pattern order, that the request did not contain."""
    asked = F.coalesce(request_text, F.lit(""))
    out = []
    for kind, rows in _by_kind(fx.COMMANDS).items():
        firsts = []
        for pattern, _, desc, check in rows:
            fresh = F.filter(all_matches(text, pattern), _command_test(asked, check))
            firsts.append(F.concat(F.lit(desc + ": "), clip(F.get(fresh, F.lit(0)))))
        ev = F.coalesce(*firsts)
        out.append(F.when(ev.isNotNull(), finding("dangerous_action", "LOW", kind, ev)))
    return F.when(F.rlike(text, F.lit(COMMAND_WORD)), F.array_compact(F.array(*out))).otherwise(none())


def tool_injections(slot: Column, text: Column) -> Column:
    """Command shapes and forged chat labels inside one tool result."""
    t = text
    out = []

    def first(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(t, uni(pattern), 0), F.lit(""))

    for kind, rows in _by_kind(fx.COMMANDS).items():
        ev = F.coalesce(*[F.concat(F.lit(desc + ": "), clip(first(p))) for p, _, desc, _ in rows])
        out.append(
            F.when(
                ev.isNotNull(),
                finding("tool_call_injection", "MEDIUM", kind, F.concat(F.lit("["), slot, F.lit("] "), ev)),
            )
        )
    commands = F.when(F.rlike(t, F.lit(COMMAND_WORD)), F.array_compact(F.array(*out))).otherwise(none())
    label = F.coalesce(*[first(p) for p in fx.FORGED_LABELS])
    forged = F.when(
        label.isNotNull(),
        F.array(
            finding("tool_call_injection", "LOW", "forged_system_label",
                    F.concat(F.lit("["), slot, F.lit(f"] {fx.FORGED_NOTE}: "), clip(label)))
        ),
    ).otherwise(none())
    return F.concat(commands, forged)


def sig_tool_injection(requests: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Findings in tool results of request bodies; each kind once per body, first slot first."""
    texts = tool_result_texts(requests, keys, body)
    rows = texts.select(
        *keys, "ord", F.posexplode(tool_injections(F.col("slot"), F.col("text"))).alias("p", "f")
    ).select(*keys, "ord", "p", "f.*")
    return (
        rows.groupBy(*keys, "kind")
        .agg(F.min_by(F.struct("signal", "severity", "evidence"), F.struct("ord", "p")).alias("f"))
        .select(*keys, F.lit(0).alias("pos"), "f.signal", "f.severity", "kind", "f.evidence")
    )


def path_needles(path: str) -> list[str]:
    """Strings whose presence in a text means the protected path is referred to."""
    v = path.strip()
    if not v:
        return []
    if "*" in v:
        tail = v.split("*", 1)[1]
        return [tail] if len(tail) >= 2 else []
    segs = [s for s in v.replace("\\", "/").split("/") if s]
    if not segs:
        return []
    out = [] if len(segs) == 1 else [segs[-2] + "\\" + segs[-1], segs[-2] + "/" + segs[-1]]
    return out + ([segs[-1]] if len(segs[-1]) >= 3 else [])


def locker_access(text: Column, key_names=(), paths=()) -> Column:
    """Protected object shapes, named keys and protected paths; each kind once."""
    def first(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, uni(pattern), 0), F.lit(""))

    out = []
    for kind, rows in _by_kind(fx.PROTECTED_OBJECTS).items():
        ev = F.coalesce(
            *[F.concat(F.lit(desc + ": "), F.left(first(p), F.lit(fx.SNIPPET_CHARS))) for p, _, desc in rows]
        )
        out.append(F.when(ev.isNotNull(), finding("locker_access", "MEDIUM", kind, ev)))
    names = [k for k in key_names if len(k) >= 4]
    if names:
        named = F.get(F.filter(F.array(*[F.lit(k) for k in names]), lambda k: F.contains(text, k)), F.lit(0))
        out.append(
            F.when(named.isNotNull(), finding("locker_access", "MEDIUM", "locker_key", F.concat(F.lit(fx.LOCKER_KEY_NOTE + ": "), named)))
        )
    table = [(p, path_needles(p)) for p in paths]
    rows = [
        F.struct(F.lit(p).alias("path"), F.array(*[F.lit(n) for n in ns]).alias("needles")) for p, ns in table if ns
    ]
    if rows:
        seen = F.get(
            F.filter(F.array(*rows), lambda r: F.exists(r["needles"], lambda n: F.contains(text, n))), F.lit(0)
        )["path"]
        out.append(
            F.when(seen.isNotNull(), finding("locker_access", "MEDIUM", "protected_path", F.concat(F.lit(fx.LOCKER_PATH_NOTE + ": "), seen)))
        )
    return F.array_compact(F.array(*out))


def sig_text(responses: DataFrame, keys: list[str], findings: Column, dedupe: bool = False) -> DataFrame:
    rows = findings_long(responses, keys, findings)
    return dedupe_findings(rows, keys) if dedupe else rows


def _recurs() -> list[Column]:
    return [F.lit(0).alias("pos"), F.lit("cross_request_pollution").alias("signal"), F.lit("HIGH").alias("severity"), F.lit("prior_marker").alias("kind"),
            F.concat(F.lit("prior_marker_recur: "), F.left("nonce", F.lit(40))).alias("evidence")]


def _registered_before(found: DataFrame, markers: DataFrame) -> DataFrame:
    """Rows ``nonce, ts`` for which the marker was registered before, within the time limit.

    Time is cut into slots as long as the limit; of a marker's registrations in a slot only the first and the last matter, so a reply
    meets two rows however often the marker was registered.
    """
    ttl = fx.MARKER_TTL_SECONDS
    slot = F.floor(F.unix_timestamp("ts") / ttl).cast("bigint")
    per = markers.select("nonce", "ts").groupBy("nonce", slot.alias("slot")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    both = found.withColumn("slot", F.explode(F.array(slot, slot - 1))).withColumn("own_slot", F.col("slot") == slot)
    in_time = F.when(F.col("own_slot"), F.col("first") < F.col("ts")).otherwise(F.unix_timestamp("ts") - F.unix_timestamp("last") < ttl)
    return both.join(per, ["nonce", "slot"]).where(in_time)


def sig_cross_request(responses: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """Markers registered by earlier requests that turn up in a reply.

    ``responses`` needs ``ts, body, own_markers``; ``markers`` is ``(nonce, ts)``.  Tokens of the marker
    form are extracted and equi-joined, so no text is compared with every marker.
    """
    found = responses.where(F.contains("body", F.lit("MARK_"))).select(
        *keys, "ts", "own_markers",
        F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(fx.MARKER_PATTERN), F.lit(0)))).alias("nonce"),
    )
    hit = _registered_before(found.where(~F.array_contains("own_markers", F.col("nonce"))), markers)
    return hit.groupBy(*keys, "nonce").agg(F.lit(1).alias("one")).select(*keys, *_recurs())


def sig_cross_request_any(responses: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """Like ``sig_cross_request`` for markers of any form and number: they are searched as a dictionary."""
    from veilspark.operators.dictionary import occurrences

    names = markers.select(F.trim("nonce").alias("value")).where("value <> ''").distinct().withColumn("word", F.lit(False))
    found = occurrences(responses, names, keys, "body").select(*keys, F.col("value").alias("nonce")).distinct()
    facts = found.join(responses.select(*keys, "ts", "own_markers"), keys).where(~F.array_contains("own_markers", F.col("nonce")))
    hit = _registered_before(facts, markers.withColumn("nonce", F.trim("nonce")))
    return hit.groupBy(*keys, "nonce").agg(F.lit(1).alias("one")).select(*keys, *_recurs())


def sig_cross_request_names(responses: DataFrame, nonces: list[str], keys: list[str]) -> DataFrame:
    """Like ``sig_cross_request`` for a short list of active markers of any form; a table of them goes to ``sig_cross_request_any``."""
    if not nonces:
        nonces = [""]
    seen = F.filter(
        F.array(*[F.lit(n) for n in nonces]),
        lambda n: (n != "") & F.contains(F.col("body"), n) & ~F.array_contains(F.col("own_markers"), n),
    )
    found = F.transform(
        seen,
        lambda n: finding(
            "cross_request_pollution", "HIGH", "prior_marker", F.concat(F.lit("prior_marker_recur: "), F.left(n, F.lit(40)))
        ),
    )
    return findings_long(responses, keys, found)


def signal_gate(findings: DataFrame, enabled: bool = True, switches: dict[str, bool] | None = None, floor: str = "MEDIUM") -> DataFrame:
    """Keep findings of switched-on signals at or above the severity floor."""
    on = [s for s, impl in fx.SIGNALS if (dict(fx.SIGNALS) | (switches or {}))[s]]
    if not enabled or not on:
        return findings.where(F.lit(False))
    need = {s: i + 1 for i, s in enumerate(fx.SEVERITIES)}.get(floor.upper(), 2)
    return findings.where(F.col("signal").isin(*on) & (severity_rank(F.col("severity"), 1) >= need))


def run_audit(
    pairs: DataFrame,
    events: DataFrame | None,
    markers: DataFrame | None,
    keys: list[str],
    key_names=(),
    paths=(),
    switches: dict[str, bool] | None = None,
    floor: str = "MEDIUM",
    tool_body: str | None = None,
    expected: str | None = None,
) -> DataFrame:
    """All signals over request and reply pairs, gated.

    ``tool_body`` names the request body whose tool results are searched, ``expected`` the command that a probe's
    reply should repeat.

    ``pairs``: keys and ``status, headers, body, req_text, req_model, resp_model, ts, own_markers``.
    Replies with an error status are searched for leaks, the others for the text signals.
    """
    good = pairs.where("status IS NULL OR status < 400")
    poison = sig_text(good, keys, response_poison(F.col("body"), F.col("req_text")), dedupe=True)
    rest = sig_text(
        good, keys,
        F.concat(dangerous_actions(F.col("body"), F.col("req_text")), locker_access(F.col("body"), key_names, paths)),
    )
    out = sig_error_leak(pairs, keys).unionByName(sig_identity_swap(good, keys)).unionByName(poison).unionByName(rest)
    if events is not None:
        out = out.unionByName(sig_stream(events, keys))
    if markers is not None:
        out = out.unionByName(sig_cross_request(good, markers, keys))
    if tool_body is not None:
        out = out.unionByName(sig_tool_injection(pairs, keys, tool_body))
    if expected is not None:
        out = out.unionByName(sig_tool_echo(good.select(*keys, F.col(expected).alias("expected"), F.trim("body").alias("actual")), keys))
    return signal_gate(out, switches=switches, floor=floor)
