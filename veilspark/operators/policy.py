"""Host lists and the request decision.  Suffix and folder tests become equi-joins on exploded keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.spans import compute_once, let
from veilspark.functions.text import _strip_port, guarded_host_class, host_suffixes, normalize_host
from veilspark.operators.detect import block_gate
from veilspark.sources.lineage import fits
from veilspark.sources.messages import json_gate


def clean_hosts(hosts: DataFrame, max_hosts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean a host table ``(pos, host)`` into ``(pos, host)`` and a reject table ``(pos, host, reason)``.

    All hosts are kept unless ``max_hosts`` is given.
    """
    n = hosts.select("pos", normalize_host(F.col("host")).alias("host")).where("host <> ''")
    reason = (
        F.when(F.length("host") > fx.CUSTOM_HOST_MAX_CHARS, "too_long")
        .when(~F.rlike("host", F.lit("^[A-Za-z0-9._-]+$")), "illegal_character")
        .when(~F.contains("host", F.lit(".")), "no_dot")
    )
    n = n.withColumn("reason", reason)
    good = n.where("reason IS NULL").groupBy("host").agg(F.min("pos").alias("pos")).select("pos", "host")
    if max_hosts is not None:
        good = good.orderBy("pos").limit(max_hosts)
    return good, n.where("reason IS NOT NULL")


def _domain_hits(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, entry columns) for each distinct host and each domain entry at or above it."""
    pats = entries.where("kind = 'domain'").withColumn("key", F.lower(F.trim("pattern"))).where("key <> ''")
    keys = hosts.select("host").distinct().select("host", F.explode(host_suffixes(_strip_port(F.col("host")))).alias("key"))
    return keys.join(pats, "key").drop("key")


def _exe_keys(exe: Column) -> Column:
    """All strings a process pattern may equal: the path, its folders, its name behind a backslash."""
    e = F.lower(F.trim(exe))
    folders = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(e), F.lit(1))), lambda i: F.substring(e, i, F.lit(1)).isin("\\", "/")),
        lambda i: F.substring(e, F.lit(1), i - 1),
    )
    name = F.when(F.contains(e, F.lit("\\")), F.element_at(F.split(e, r"\\"), -1))
    return F.array_distinct(F.filter(F.concat(folders, F.array(e, name)), lambda k: k.isNotNull() & (k != "")))


def _process_hits(exes: DataFrame, entries: DataFrame) -> DataFrame:
    pats = (
        entries.where("kind = 'process'")
        .withColumn("key", F.regexp_replace(F.lower(F.trim("pattern")), r"[\\/]+$", ""))
        .where("key <> ''")
    )
    keys = exes.select("exe").where("exe IS NOT NULL").distinct().select("exe", F.explode(_exe_keys(F.col("exe"))).alias("key"))
    return keys.join(pats, "key").drop("key")


#: Lists of at most so many entries are searched within the row; longer ones are joined.
LIST_IN_ROW = 100_000


def _found(table: Column, key: Column) -> Column:
    """The value of ``key`` in an array of ``(key, value)`` sorted by key, by bisection."""
    def halve(s: Column, _i: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        less = F.get(table, mid)["key"] < key
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~less, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(table) + 1)).cast("int"))
    at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(table).alias("hi")), halve, lambda s: s["lo"])
    return let(F.get(table, at), lambda e: F.when(e["key"] == key, e["value"]))


def _least(table: Column, keys: Column) -> Column:
    """The least value of all ``keys`` that the table has, null if none."""
    hits = F.filter(F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: _found(table, k)), lambda v: v.isNotNull())
    return F.array_min(hits)


def _in_row(entries: DataFrame, value: Column) -> tuple[Column, Column]:
    """Domain and process entries as sorted arrays, each one constant of the plan: requests meet them without moving.

    The caller has checked the number of entries.
    """
    kind = entries.select(value.alias("value")).schema["value"].dataType.simpleString()

    def table(name: str, key: Column) -> Column:
        rows = entries.where(F.col("kind") == name).select(key.alias("key"), value.alias("value")).where("key <> ''")
        least = rows.groupBy("key").agg(F.min("value").alias("value")).select("key", F.to_json(F.struct("key", "value"), {"ignoreNullFields": "false"}).alias("entry")).collect()
        text = "[" + ",".join(r.entry for r in sorted(least, key=lambda r: r.key.encode())) + "]"
        return F.from_json(F.lit(text), f"array<struct<key:string,value:{kind}>>")

    return table("domain", F.lower(F.trim("pattern"))), table("process", F.regexp_replace(F.lower(F.trim("pattern")), r"[\\/]+$", ""))


def _lookups(requests: DataFrame, entries: DataFrame, value: Column) -> DataFrame:
    """Adds ``_domain`` and ``_process``: the least value of the domain and the process entries that match."""
    domain, process = _in_row(entries, value)
    return compute_once(requests, _domain=_least(domain, host_suffixes(_strip_port(F.col("host")))), _process=_least(process, _exe_keys(F.col("exe"))))


def blocklist_match(requests: DataFrame, blocklist: DataFrame, matched_entry: bool = False, in_row: int = LIST_IN_ROW) -> DataFrame:
    """Add ``block_action``: first matching domain entry in list order, else the process action.

    A process match yields the action of the first process entry of the list, as observed in the
    engine this follows; ``matched_entry=True`` uses the entry that matched.  Up to ``in_row`` entries the list is searched within the
    row, so no request moves.
    """
    if fits(blocklist, in_row):
        rows = _lookups(requests, blocklist, F.struct("pos", "action"))
        process = F.col("_process")["action"]
        if not matched_entry:
            lead = F.lit(blocklist.where("kind = 'process'").agg(F.min_by("action", "pos")).first()[0])
            process = F.when(F.col("_process").isNotNull(), lead)
        return rows.withColumn("block_action", F.coalesce(F.col("_domain")["action"], process)).drop("_domain", "_process")
    domain = _domain_hits(requests, blocklist).groupBy("host").agg(F.min_by("action", "pos").alias("domain_action"))
    proc = _process_hits(requests, blocklist)
    if matched_entry:
        process = proc.groupBy("exe").agg(F.min_by("action", "pos").alias("process_action"))
    else:
        lead = blocklist.where("kind = 'process'").groupBy("kind").agg(F.min_by("action", "pos").alias("process_action"))
        process = proc.select("exe", "kind").distinct().join(lead, "kind").drop("kind")
    return (
        requests.join(domain, "host", "left")
        .join(process, "exe", "left")
        .withColumn("block_action", F.coalesce("domain_action", "process_action"))
        .drop("domain_action", "process_action")
    )


def allowlist_match(requests: DataFrame, allowlist: DataFrame, matched_entry: bool = False, in_row: int = LIST_IN_ROW) -> DataFrame:
    """Add ``allowed`` and ``allow_scrub``.

    ``allow_scrub`` is true if any entry of a kind that matched asks for scrubbing (or, with
    ``matched_entry=True``, any entry that matched itself).  Lists are searched as in :func:`blocklist_match`.
    """
    if fits(allowlist, in_row):
        # The least of the negated flag is false if any matching entry scrubs.
        rows = _lookups(requests, allowlist, ~F.col("scrub"))
        def scrub(side: str) -> Column:
            if matched_entry:
                return ~F.col(f"_{side}")
            return F.when(F.col(f"_{side}").isNotNull(), F.lit(bool(allowlist.where(F.col("kind") == side).agg(F.bool_or("scrub")).first()[0])))

        rows = rows.withColumn("allowed", F.col("_domain").isNotNull() | F.col("_process").isNotNull())
        asks = F.coalesce(scrub("domain"), F.lit(False)) | F.coalesce(scrub("process"), F.lit(False))
        return rows.withColumn("allow_scrub", ~F.col("allowed") | asks).drop("_domain", "_process")
    by_kind = allowlist.groupBy("kind").agg(F.bool_or("scrub").alias("kind_scrub"))

    def side(hits: DataFrame, key: str, out: str) -> DataFrame:
        if matched_entry:
            return hits.groupBy(key).agg(F.bool_or("scrub").alias(out))
        return hits.select(key, "kind").distinct().join(by_kind, "kind").select(key, F.col("kind_scrub").alias(out))

    domain = side(_domain_hits(requests, allowlist), "host", "domain_scrub")
    process = side(_process_hits(requests, allowlist), "exe", "process_scrub")
    hit = F.col("domain_scrub").isNotNull() | F.col("process_scrub").isNotNull()
    return (
        requests.join(domain, "host", "left")
        .join(process, "exe", "left")
        .withColumn("allowed", hit)
        .withColumn(
            "allow_scrub",
            ~F.col("allowed") | F.coalesce("domain_scrub", F.lit(False)) | F.coalesce("process_scrub", F.lit(False)),
        )
        .drop("domain_scrub", "process_scrub")
    )


def needs_scan(custom_hosts: list[str] | None = None) -> Column:
    """True where a decision depends on the hits of the body; other bodies need not be read."""
    listed = F.coalesce(F.col("block_action") == "block", F.lit(False))
    free = F.col("block_action").isNull() & F.col("allowed") & ~F.col("allow_scrub")
    return (guarded_host_class(F.col("host"), custom_hosts) == "exact") & ~listed & ~free & F.coalesce(json_gate(F.col("content_type")), F.lit(False))


def decide(requests: DataFrame, custom_hosts: list[str] | None = None) -> DataFrame:
    """Add ``host_class``, ``decision`` and ``kinds``.

    Needs ``host, content_type, body, hits, block_action, allowed, allow_scrub``.  Decisions:
    ``pass`` (host not guarded), ``passthrough``, ``block``, ``mask``.
    """
    forced = F.col("block_action").isNotNull()
    allowed = F.col("allowed") & ~forced
    force_mask = forced | (allowed & F.col("allow_scrub"))
    json_body = json_gate(F.col("content_type")) & F.try_parse_json(F.col("body")).isNotNull()
    n_hits = F.size("hits")
    df = requests.withColumn("host_class", guarded_host_class(F.col("host"), custom_hosts))
    df = df.withColumn(
        "decision",
        F.when(F.col("host_class") == "none", "pass")
        .when(F.col("host_class") == "suffix", "passthrough")
        .when(F.col("block_action") == "block", "block")
        .when(allowed & ~F.col("allow_scrub"), "passthrough")
        .when(~json_body, "passthrough")
        .when(~force_mask & block_gate(F.col("hits")), "block")
        .when(n_hits == 0, "passthrough")
        .otherwise("mask"),
    )
    tags = F.transform("hits", lambda h: h["tag"])
    listed = F.array(F.lit("BLACKLIST"))
    none = F.array().cast("array<string>")
    scanned = json_body & ~(allowed & ~F.col("allow_scrub")) & (n_hits > 0)
    return df.withColumn(
        "kinds",
        F.when(F.col("host_class") != "exact", none)
        .when(F.col("block_action") == "block", listed)
        .when(~scanned, none)
        .otherwise(F.concat(tags, F.when(forced, listed).otherwise(none))),
    )


def hit_summary(scanned: DataFrame, keys: list[str], hits: str = "hits") -> DataFrame:
    """Per message: kinds with repeats, distinct rule ids, distinct locker names, hit count."""
    h = F.col(hits)
    return scanned.select(
        *keys,
        F.transform(h, lambda x: x["tag"]).alias("kinds"),
        F.array_distinct(
            F.filter(F.transform(h, lambda x: x["rule_id"]), lambda r: (r != "") & (r != "locker"))
        ).alias("rule_ids"),
        F.array_distinct(F.filter(F.transform(h, lambda x: x["locker_entry"]), lambda e: e.isNotNull())).alias("locker_entries"),
        F.size(h).alias("hits"),
    )


def passthrough_credentials(decided: DataFrame, entries, keys: list[str], max_bytes: int | None = None) -> DataFrame:
    """Allow-listed bodies passed through unchanged that carry protected values in clear.

    ``entries`` is a short list or a cleaned entry table of any size.  ``max_bytes`` skips longer bodies; off by default.
    """
    from veilspark.operators.dictionary import entry_names
    from veilspark.operators.locker import locker_entry_names

    rows = decided.where((F.col("decision") == "passthrough") & F.col("allowed") & ~F.col("allow_scrub"))
    if max_bytes is not None:
        rows = rows.where(F.octet_length("body") <= max_bytes)
    if isinstance(entries, DataFrame):
        return entry_names(rows, entries, keys)
    return rows.select(*keys, F.explode(locker_entry_names(F.col("body"), entries)).alias("entry"))
