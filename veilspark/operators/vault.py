"""The vault: one placeholder per (session, original), and redaction of whole sessions with it.

Placeholders come from a keyed hash, so a retried task, a second run or a stream mints the same
value.  The vault table ``(session, original, tag, placeholder, suffix, remapped, created_ts)`` is the
only place that holds originals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.operators.redact import replace_hits
from veilspark.sources.lineage import cut

SUFFIX_CHARS = 8
DIGEST_CHARS = 64


def _digest(salt: str, session: Column, original: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), session, original), 256)


def suffix_of(salt: str, session: Column, original: Column, width: int = SUFFIX_CHARS) -> Column:
    return F.substring(_digest(salt, session, original), 1, width)


def placeholder(tag: Column, suffix: Column) -> Column:
    return F.concat(F.lit("[[PII:"), tag, F.lit(":"), suffix, F.lit("]]"))


def placeholder_tag(ph: Column) -> Column:
    return F.nullif(F.regexp_extract(ph, r"^\[\[PII:(.*):[0-9a-fA-F]+\]\]$", 1), F.lit(""))


def placeholder_suffix(ph: Column) -> Column:
    """The lower-case hex suffix of a placeholder, NULL for anything else."""
    return F.nullif(F.lower(F.regexp_extract(ph, r"^\[\[PII:.*:([0-9a-fA-F]+)\]\]$", 1)), F.lit(""))


def vault_mint(hit_rows: DataFrame, salt: str, width: int = SUFFIX_CHARS) -> DataFrame:
    """Mint the vault from hit rows ``(session, seq, msg_id, start, tag, original, ts)``.

    The first tag in message order wins.  If two originals of a session get the same placeholder, the
    smaller original keeps it and the other takes the first free slice of its own digest.
    """
    first = hit_rows.groupBy("session", "original").agg(
        F.min_by("tag", F.struct("seq", "msg_id", "start")).alias("tag"),
        (F.min("tag") != F.max("tag")).alias("several_tags"),
        F.min("ts").alias("created_ts"),
    )
    base = first.withColumn("suffix", suffix_of(salt, F.col("session"), F.col("original"), width))
    slot = W.partitionBy("session", "tag", "suffix").orderBy("original")
    # The scan of the texts costs by far most, and the pairs are read for winners, losers and what is taken.
    ranked = cut(base.withColumn("rank", F.row_number().over(slot)))

    winners = ranked.where("rank = 1").withColumn("collided", F.lit(False)).drop("rank")
    losers = ranked.where("rank > 1").drop("rank", "suffix")
    slices = F.transform(
        F.sequence(F.lit(1), F.lit(DIGEST_CHARS // width - 1)),
        lambda k: F.substring(_digest(salt, F.col("session"), F.col("original")), k * width + 1, F.lit(width)),
    )
    claims = losers.select("session", "tag", "original", F.posexplode(slices).alias("k", "suffix"))
    taken = winners.select("session", "tag", "suffix")
    free = claims.join(taken, ["session", "tag", "suffix"], "left_anti")
    turn = W.partitionBy("session", "tag", "suffix").orderBy("k", "original")
    picked = (
        free.withColumn("turn", F.row_number().over(turn)).where("turn = 1")
        .groupBy("session", "original").agg(F.min_by("suffix", "k").alias("suffix"))
    )
    moved = losers.join(picked, ["session", "original"], "left").withColumn(
        "suffix", F.coalesce("suffix", F.raise_error(F.lit("no free placeholder suffix in this session")))
    ).withColumn("collided", F.lit(True))
    return winners.unionByName(moved).select(
        "session",
        "original",
        "tag",
        placeholder(F.col("tag"), F.col("suffix")).alias("placeholder"),
        "suffix",
        (F.col("several_tags") | F.col("collided")).alias("remapped"),
        "created_ts",
    )


def mint_missing(hit_rows: DataFrame, vault: DataFrame, salt: str) -> DataFrame:
    """Vault rows for pairs the vault does not hold yet; suffixes already used in a session stay taken."""
    fresh = hit_rows.join(vault.select("session", "original"), ["session", "original"], "left_anti")
    minted = cut(vault_mint(fresh, salt))
    used = vault.select("session", "tag", "suffix", F.lit(True).alias("used"))
    clash = minted.join(used, ["session", "tag", "suffix"], "left")
    slices = F.transform(
        F.sequence(F.lit(1), F.lit(DIGEST_CHARS // SUFFIX_CHARS - 1)),
        lambda k: F.substring(
            _digest(salt, F.col("session"), F.col("original")), k * SUFFIX_CHARS + 1, F.lit(SUFFIX_CHARS)
        ),
    )
    bad = clash.where("used").select("session", "tag", "original", F.posexplode(slices).alias("k", "suffix"))
    all_taken = used.drop("used").unionByName(minted.select("session", "tag", "suffix"))
    turn = W.partitionBy("session", "tag", "suffix").orderBy("k", "original")
    picked = (
        bad.join(all_taken, ["session", "tag", "suffix"], "left_anti")
        .withColumn("turn", F.row_number().over(turn)).where("turn = 1")
        .groupBy("session", "original").agg(F.min_by("suffix", "k").alias("new_suffix"))
    )
    out = clash.join(picked, ["session", "original"], "left").withColumn(
        "suffix",
        F.when(
            F.col("used"),
            F.coalesce("new_suffix", F.raise_error(F.lit("no free placeholder suffix in this session"))),
        ).otherwise(F.col("suffix")),
    )
    return out.withColumn("remapped", F.col("remapped") | F.col("new_suffix").isNotNull()).withColumn(
        "placeholder", placeholder(F.col("tag"), F.col("suffix"))
    ).select("session", "original", "tag", "placeholder", "suffix", "remapped", "created_ts")


def redact_with_vault(
    scanned: DataFrame,
    vault: DataFrame,
    salt: str,
    key: str = "msg_id",
    text: str = "body",
    out: str = "redacted",
    complete: bool = False,
) -> DataFrame:
    """Replace every hit by its placeholder; a pair that the vault has under another placeholder keeps that one.

    Nearly every placeholder is a function of (salt, session, original, tag) and is computed in place, also for pairs the
    vault lacks, so no original stays.  Only hits for which the vault's placeholder differs are looked up: their
    pairs come back as one small map per message, and the join's kind is left to the run-time sizes.
    ``complete`` says that the vault was minted from these very hits, so that only its remapped rows can differ.
    """
    known = (vault.where("remapped") if complete else vault).select("session", "original", "placeholder")

    def local(h: Column) -> Column:
        return placeholder(h["tag"], suffix_of(salt, F.col("session"), h["original"]))

    if complete and known.isEmpty():
        return scanned.withColumn(out, replace_hits(F.col(text), F.col("hits"), local))
    hits = scanned.select(key, "session", F.explode("hits").alias("h")).where("h.action <> 'warn'")
    hits = hits.select(key, "session", F.col("h.original").alias("original"), local(F.col("h")).alias("__local")).distinct()
    kept = (
        hits.join(known, ["session", "original"]).where("placeholder <> __local")
        .groupBy("session", key, "original").agg(F.min("placeholder").alias("placeholder"))
        .groupBy(F.col("session").alias("__session"), F.col(key).alias("__key"))
        .agg(F.map_from_entries(F.collect_list(F.struct("original", "placeholder"))).alias("__kept"))
    )
    joined = scanned.join(kept, (F.col("session") == F.col("__session")) & F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.withColumn(
        out,
        replace_hits(F.col(text), F.col("hits"), lambda h: F.coalesce(F.try_element_at(F.col("__kept"), h["original"]), local(h))),
    ).drop("__kept", "__session", "__key")


def session_hits(scanned: DataFrame) -> DataFrame:
    """Hit rows in the form the vault mint takes."""
    return (
        scanned.select("session", "seq", "msg_id", "ts", F.explode("hits").alias("h"))
        .where("h.action <> 'warn'")
        .select("session", "seq", "msg_id", "ts", F.col("h.start").alias("start"), F.col("h.tag").alias("tag"),
                F.col("h.original").alias("original"))
    )


def redact_sessions(scanned: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """Mint and redact: returns the redacted messages and the vault (checkpointed, as it is read twice)."""
    vault = cut(vault_mint(session_hits(scanned), salt))
    return redact_with_vault(scanned, vault, salt, complete=True), vault


def vault_purge(vault: DataFrame, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The vault without the given sessions (without anything if none are given), and the purged count."""
    if sessions is None:
        return vault.limit(0), vault.agg(F.count(F.lit(1)).alias("purged"))
    gone = sessions.select("session").distinct()
    return (
        vault.join(gone, "session", "left_anti"),
        vault.join(gone, "session", "left_semi").agg(F.count(F.lit(1)).alias("purged")),
    )


def vault_counts(vault: DataFrame) -> DataFrame:
    return vault.groupBy("session").agg(F.count(F.lit(1)).alias("placeholders"))


def sessions_containing(vault: DataFrame, placeholders: DataFrame) -> DataFrame:
    """(placeholder, session) for every session that holds one of the given placeholders."""
    return placeholders.select("placeholder").distinct().join(vault.select("placeholder", "session"), "placeholder")


def known_originals(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """Rows ``(session, text)`` whose text is an original of the same session."""
    known = vault.select("session", F.col("original").alias("text"))
    return texts.join(known, ["session", "text"], "left_semi")
