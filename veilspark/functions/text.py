"""Scalar helpers on hosts, sessions, hashes, models, severities and report text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.spans import fold_emit, let, uni


def _strip_port(host: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(host, ":"), 1)))


def normalize_host(host: Column) -> Column:
    """Drop scheme, path and port; trim and lower."""
    bare = F.regexp_replace(F.trim(host), r"^(?s).*?//", "")
    return _strip_port(F.element_at(F.split(bare, "/"), 1))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain of it, longest first."""
    return let(
        F.split(host, "[.]"),
        lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")),
    )


def guarded_host_class(host: Column, custom_hosts: list[str] | None = None) -> Column:
    """``exact`` for a listed host, ``suffix`` for a (sub)domain of a registered domain, else ``none``."""
    h = _strip_port(host)
    exact = h.isin(*fx.GUARDED_HOSTS)
    if custom_hosts:
        exact = exact | normalize_host(host).isin(*custom_hosts)
    suffix = F.arrays_overlap(host_suffixes(h), F.array(*[F.lit(s) for s in fx.GUARDED_SUFFIXES]))
    return F.when(exact, "exact").when(suffix, "suffix").otherwise("none")


def domain_matches(pattern: Column, host: Column) -> Column:
    """Host equals the pattern or is below it, ports and case ignored."""
    p, h = F.lower(F.trim(pattern)), _strip_port(host)
    return (p != "") & (h != "") & ((h == p) | F.endswith(h, F.concat(F.lit("."), p)))


def process_path_matches(pattern: Column, exe: Column) -> Column:
    """Whole path, folder prefix, or bare file name behind a backslash; case ignored."""
    p = F.lower(F.trim(pattern))
    cut = F.regexp_replace(p, r"[\\/]+$", "")
    e = F.lower(F.trim(exe))
    bare = ~F.contains(cut, F.lit("\\")) & ~F.contains(cut, F.lit("/"))
    return (
        (p != "")
        & (e != "")
        & (
            (e == cut)
            | F.startswith(e, F.concat(cut, F.lit("\\")))
            | F.startswith(e, F.concat(cut, F.lit("/")))
            | (bare & F.endswith(e, F.concat(F.lit("\\"), cut)))
        )
    )


def short_hash(value: Column) -> Column:
    """First 16 hex characters of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 16)


def truncate_sample(value: Column, max_bytes: int) -> Column:
    """Keep short texts; cut longer ones to a quarter of the byte limit in characters."""
    return F.when(F.octet_length(value) > max_bytes, F.left(value, F.lit(max_bytes // 4))).otherwise(value)


def model_family(model: Column) -> Column:
    last = F.element_at(F.split(F.lower(F.trim(model)), "/"), -1)
    return F.regexp_extract(last, "[a-z][a-z0-9]*", 0)


def severity_rank(severity: Column, unknown: int = 0) -> Column:
    s = F.upper(severity)
    return reduce(
        lambda w, i: w.when(s == fx.SEVERITIES[i], i + 1),
        range(1, len(fx.SEVERITIES)),
        F.when(s == fx.SEVERITIES[0], 1),
    ).otherwise(unknown)


def redact_evidence(snippet: Column, kind: Column | str) -> Column:
    """Kind, length and hash only; no part of the value."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(k, F.lit(" len="), F.length(snippet).cast("string"), F.lit(" sha256="), short_hash(snippet))


def clip(snippet: Column, limit: int = fx.SNIPPET_CHARS) -> Column:
    t = trim_space(snippet)
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit - 3)), F.lit("..."))).otherwise(t)


def trim_space(value: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")


def safe_text(value: Column, limit: int = 0) -> Column:
    """Replace credential and personal-data shapes, then cut."""
    out = reduce(lambda c, pr: F.regexp_replace(c, uni(pr[0]), pr[1]), fx.REPORT_CLEANUP, value)
    return F.left(out, F.lit(limit)) if limit else out


def safe_target(value: Column) -> Column:
    """Keep scheme, host, port and path of a web address; clean anything else as text."""
    raw = F.trim(value)
    scheme = F.lower(F.regexp_extract(raw, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(raw, r"(?s)^.*?://(.*)\z", 1)
    authority = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    host_port = F.element_at(F.split(authority, "@"), -1)
    path = F.regexp_extract(rest, r"(?s)^[^/]*([^?#]*)", 1)
    kept = safe_text(F.concat(scheme, F.lit("://"), host_port, path), fx.REPORT_TARGET_CHARS)
    return (
        F.when(raw == "", "")
        .when(~scheme.isin("http", "https"), safe_text(raw, fx.REPORT_OTHER_TARGET_CHARS))
        .when(host_port == "", "<redacted-target>")
        .otherwise(kept)
    )


def derive_session(host: Column, body: Column, headers: Column, client: Column) -> Column:
    """Session key: body id field, then session header, then hashed authorization, then client address.

    ``headers`` is a map with lower-case names.
    """

    def filled(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    def from_body(v: Column) -> Column:
        found = []
        for key in fx.SESSION_BODY_KEYS:
            path = f"$.{key}"
            text = F.when(
                F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING",
                F.try_variant_get(v, path, "string"),
            )
            found.append(filled(text))
        return F.coalesce(*found)

    conv = let(F.try_parse_json(body), from_body)
    header = F.coalesce(*[filled(F.try_element_at(headers, F.lit(h))) for h in fx.SESSION_HEADERS])
    auth = F.try_element_at(headers, F.lit("authorization"))
    return F.coalesce(
        F.concat(F.lit("conv:"), host, F.lit(":"), conv),
        F.concat(F.lit("hdr:"), host, F.lit(":"), header),
        F.when(F.trim(auth) != "", F.concat(F.lit("key:"), host, F.lit(":"), short_hash(auth))),
        client,
    )


def host_from_session(session: Column) -> Column:
    parts = F.split(session, ":")
    return F.when(F.element_at(parts, 1).isin("conv", "hdr", "key"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).otherwise("")


def json_escape_inside(value: Column) -> Column:
    """The value as it must look inside a JSON string, without the outer quotes."""
    js = F.to_json(F.struct(value.alias("v")))
    return F.substring(js, F.lit(7), F.length(js) - 8)


def code_fence_strip(text: Column) -> Column:
    """Remove fenced blocks with their fence lines; an unclosed fence runs to the end."""

    def build(lines: Column) -> Column:
        items = F.transform(
            lines,
            lambda ln, i: F.struct(
                F.when(i < F.size(lines) - 1, F.concat(ln, F.lit("\n"))).otherwise(ln).alias("raw"),
                F.rlike(ln, F.lit(r"(?U)^\s*```")).alias("fence"),
            ),
        )

        def step(state: Column, x: Column) -> Column:
            return F.struct(
                F.struct((state["open"] != x["fence"]).alias("open")).alias("state"),
                F.when(~state["open"] & ~x["fence"], F.array(x["raw"]))
                .otherwise(F.array().cast("array<string>"))
                .alias("out"),
            )

        return F.array_join(
            let(items, lambda xs: fold_emit(xs, F.struct(F.lit(False).alias("open")), step, "array<string>")), ""
        )

    return F.when(F.contains(text, F.lit("```")), let(F.split(text, "\n"), build)).otherwise(text)


def response_gate(content_type: Column, content_encoding: Column) -> Column:
    """True for plain JSON, event-stream, ndjson and text replies without compression."""
    enc = F.lower(F.trim(F.coalesce(content_encoding, F.lit(""))))
    ct = F.lower(content_type)
    kinds = reduce(lambda a, b: a | b, [F.contains(ct, F.lit(k)) for k in fx.RESTORABLE_TYPES])
    return enc.isin("", "identity") & kinds
