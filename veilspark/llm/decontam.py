"""Benchmark decontamination by templates: typed placeholders, window hash join, slot consistency.  Native only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import cut

# Words that stand for a number, and units of measure.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy "
    "eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm dm km kg mg ml kw mw gb mb kb hz mph kmh usd eur gbp cent cents dollar dollars euro euros pound pounds percent meter meters metre metres mile miles inch inches "
    "foot feet yard yards gram grams kilogram kilograms kilometer kilometers kilometre kilometres litre litres liter liters second seconds minute minutes hour hours day days week "
    "weeks month months year years degree degrees"
).split()
LETTERS = r"[\p{L}\p{M}]"
FIGURE = r"\p{N}+(?:[.,]\p{N}+)*"
SIGNS = "[%$€£°]"
NUMBER, UNIT, NAME = "#", "~", "@"
#: Windows that begin in one piece of a text.
PIECE = 256


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{LETTERS}+|{FIGURE}|{SIGNS}"), F.lit(0))


def template(token: Column) -> Column:
    """Placeholder of a number, a unit or a name (a word that begins with a capital); other words in lower case."""
    low = F.lower(token)
    return (
        F.when(token.rlike(r"^\p{N}") | low.isin(NUMBER_WORDS), F.lit(NUMBER))
        .when(token.rlike(f"^{SIGNS}") | low.isin(UNITS), F.lit(UNIT))
        .when(token.rlike(r"^\p{Lu}"), F.lit(NAME))
        .otherwise(low)
    )


def template_words(text: Column) -> Column:
    """The templates of all tokens of a text, by four passes over the whole text instead of one step per token."""

    def words(of: list[str]) -> str:
        return f"(?<!{LETTERS})(?i:{'|'.join(sorted(of, key=lambda w: (-len(w), w)))})(?!{LETTERS})"

    text = F.regexp_replace(F.translate(text, NUMBER + UNIT + NAME, "   "), f"{FIGURE}|{words(NUMBER_WORDS)}", f" {NUMBER} ")
    text = F.regexp_replace(text, f"{SIGNS}|{words(UNITS)}", f" {UNIT} ")
    text = F.regexp_replace(text, rf"(?<!{LETTERS})\p{{Lu}}{LETTERS}*", NAME)
    return F.filter(F.split(F.lower(text), rf"[^\p{{L}}\p{{M}}{NUMBER}{UNIT}{NAME}]+"), lambda w: w != "")


def _hashes(words: Column, width: int, step: int) -> Column:
    """Hashes of every ``step``-th window.  The words are bound to a variable, or each window would make them anew."""

    def of(ws: Column) -> Column:
        n = F.size(ws) - (width - 1)
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n, F.lit(step)), lambda i: F.xxhash64(F.slice(ws, i, width))))

    return F.element_at(F.transform(F.array(words), of), 1)


def _windows(texts: DataFrame, keep: list[str], width: int, literals: int, whole: bool = False) -> DataFrame:
    """``keep``, ``at``, ``vals`` (the tokens), ``kinds`` (the templates), ``h``, ``raw`` (hashes of the templates and of the lower-case tokens) and ``lit``
    (enough plain words) of all windows; with ``whole`` only of texts that are one window.

    A text is cut into overlapping pieces of bounded length first, so that no row holds more than the windows of one piece.
    Each step stands behind a generator, so that it is worked out once for a piece and not once for a window.
    """
    size = F.size("all")
    raw = texts.select(*keep, F.explode(F.array(tokens(F.col("text")))).alias("all")).where(size == width if whole else size >= width)
    pieces = F.transform(F.sequence(F.lit(0), F.size("all") - width, F.lit(PIECE)), lambda j: F.slice("all", j + 1, PIECE + width - 1))
    cut_up = raw.select(*keep, F.posexplode(pieces).alias("piece", "raw"))
    shaped = cut_up.select(*keep, "piece", "raw", F.explode(F.array(F.transform("raw", template))).alias("shape"))
    windows = F.transform(F.sequence(F.lit(1), F.size("raw") - (width - 1)), lambda i: F.struct(i.alias("i"), F.slice("raw", i, width).alias("vals"), F.slice("shape", i, width).alias("kinds")))
    each = shaped.select(*keep, "piece", F.explode(windows).alias("w"))
    out = each.select(*keep, (F.col("piece") * PIECE + F.col("w.i")).alias("at"), F.transform("w.vals", F.lower).alias("vals"), "w.kinds", F.xxhash64("w.kinds").alias("h"))
    enough = F.size(F.filter("kinds", lambda k: ~k.isin(NUMBER, UNIT, NAME))) >= literals
    return out.withColumn("raw", F.xxhash64("vals")).withColumn("lit", enough)


def _both(windows: DataFrame) -> DataFrame:
    """One row for each hash of a window: that of the templates if it has enough plain words, and that of the tokens."""
    return windows.withColumn("h", F.explode(F.when(F.col("lit") & (F.col("h") != F.col("raw")), F.array("h", "raw")).otherwise(F.array("raw"))))


def template_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, step: int = 1, literals: int = 4, coverage: float = 0.5, run: int = 20, broadcast_bytes: int = 16 << 20,
                   id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_windows, item_windows, coverage, n_slots, n_changed``: one row for each document and item it holds.

    Numbers, units and capitalised words become typed placeholders, other words lower case; windows of ``width`` templates are joined by
    hash, and so are windows of lower-case tokens, which finds verbatim runs in any case.  The documents are searched at every ``step``-th window (all by
    default) against all windows of the items; documents that hit are then joined at all windows.  An item counts by its windows with at least ``literals`` plain
    words, or, if it has none, by all, which then are found verbatim.  An item of fewer than ``width`` tokens is one window of its own length.  On each alignment
    the slots are checked: an item's value must stand for one value of the document throughout (one in five
    may differ).  A document holds an item if consistent alignments cover at least ``coverage`` of its windows or ``run`` tokens on end, be
    the values the same or changed (``n_changed``).  A copy in another case whose names were changed too is not found.

    Null and empty texts hold nothing.  Rows without id
    are reported with a null id.  Repeated documents or items are reported once for each pair of ids.  No other column is read;
    an empty table on either side gives an empty result.  The items' windows are broadcast only if they stay
    below ``broadcast_bytes``; beyond it the same join is shuffled.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    b = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")).distinct()

    size = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    small = size * 2 * (width + 1) <= broadcast_bytes  # a window repeats each word at most width times, for two hashes
    near = F.broadcast if small else (lambda x: x)

    short = sorted(r[0] for r in b.select(F.size(tokens(F.col("text"))).alias("n")).where((F.col("n") > 0) & (F.col("n") < width)).distinct().collect())
    plain = F.transform(tokens(F.col("text")), F.lower)
    all_hashes = [(template_words(F.col("text")), width), (plain, width), *((w, n) for n in short for w in (template_words(F.col("text")), plain))]

    listed = _windows(b, ["item_id"], width, literals)
    for n in short:
        listed = listed.unionByName(_windows(b, ["item_id"], n, literals, whole=True))
    listed = cut(listed)
    rich = listed.groupBy("item_id").agg(F.max("lit").alias("rich"))
    counted = listed.join(rich, listed.item_id.eqNullSafe(rich.item_id)).where("lit = rich").drop(rich.item_id)
    items = cut(_both(counted).select("item_id", F.col("at").alias("iat"), F.col("vals").alias("ivals"), "h"))
    sizes = items.groupBy("item_id").agg(F.countDistinct("iat").alias("item_windows"))
    sought = items.select("h").distinct()
    probes = d.select("key", F.explode(F.flatten(F.filter(F.array(*(_hashes(w, n, step) for w, n in all_hashes)), lambda x: x.isNotNull()))).alias("h"))
    hit = cut(probes.join(near(sought), "h", "left_semi").select("key").distinct())
    held = d.join(hit, "key", "left_semi")
    spots = _both(_windows(held, ["key", "doc_id"], width, literals))
    for n in short:
        spots = spots.unionByName(_both(_windows(held, ["key", "doc_id"], n, literals)))
    hits = cut(
        spots.join(near(items), "h")
        .select("key", "doc_id", "item_id", "iat", (F.col("at") - F.col("iat")).alias("line"),
                F.filter(F.zip_with(F.arrays_zip("kinds", "ivals"), "vals", lambda i, v: F.struct(i["kinds"].alias("k"), i["ivals"].alias("i"), v.alias("v"))),
                         lambda s: s["k"].isin(NUMBER, UNIT, NAME)).alias("slots"))
    )
    # Values of one alignment: windows overlap, so each slot comes up to ``width`` times; the distinct pairs matter.
    pairs = hits.select("key", "item_id", "line", F.explode("slots").alias("s")).select("key", "item_id", "line", F.col("s.k").alias("k"), F.col("s.i").alias("i"), F.col("s.v").alias("v")).distinct()
    each = pairs.groupBy("key", "item_id", "line", "k", "i").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("i") != F.col("v")).cast("int")).alias("changed"))
    slots = each.groupBy("key", "item_id", "line").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("pairs"), F.sum("changed").alias("changed"))
    lines = hits.groupBy("key", "doc_id", "item_id", "line", "iat").agg(F.lit(1).alias("one")).drop("one").join(slots, ["key", "item_id", "line"], "left")
    good = lines.where(F.coalesce((F.col("pairs") - F.col("values")) * 5 <= F.col("values"), F.lit(True)))
    cover = good.groupBy("key", "doc_id", "item_id").agg(
        F.countDistinct("iat").alias("n_windows"), F.max(F.coalesce("values", F.lit(0))).alias("n_slots"), F.max(F.coalesce("changed", F.lit(0))).alias("n_changed"))
    # Hits of one alignment that overlap or touch make a run.
    along = Window.partitionBy("key", "item_id", "line").orderBy("iat")
    runs = good.withColumn("new", (F.col("iat") - F.lag("iat").over(along) > width).cast("int")).withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(along))
    longest = runs.groupBy("key", "item_id", "line", "part").agg((F.max("iat") - F.min("iat") + width).alias("run")).groupBy("key", "item_id").agg(F.max("run").alias("run"))
    out = cover.join(near(sizes), "item_id").join(longest, ["key", "item_id"]).withColumn("coverage", F.col("n_windows") / F.col("item_windows")).where((F.col("coverage") >= coverage) | (F.col("run") >= run))
    return (
        out.groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("n_windows", "item_windows", "coverage", "n_slots", "n_changed"), F.struct("coverage", "n_slots", "n_changed", "key")).alias("x"))
        .select("doc_id", "item_id", "x.*")
    )
