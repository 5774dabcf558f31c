"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash.  A source that has to give a part of its words takes the rows
whose hash is below a threshold.  To find it, words are summed by source and the top bits of
the hash; the bucket in which the budget runs out is cut again by the next bits, and so on
until the hash is used up.  Each pass is one aggregation that gives at most `2^BITS` rows per
source, whatever the number of rows, and no row is ever sorted.  Thresholds nest: a larger
budget takes the same rows and some more.

Targets: sources in the order of their code points, null last, weigh 5, 2, 1, 5, 2, 1 ...;
they share all words; a target stops at three times its source's words and the rest goes to the
others by weight, again until none is above.  A target of r whole sources and a part takes all
rows r times and the rows below the threshold once more.

Rows without a text or with an empty one have size 0 and take nothing.  A null source is a
source.  The hash covers id and text, so repeated ids with different texts are told apart; rows
equal in both share a hash and are taken or left together.  Empty tables give empty results;
extra columns are kept out of the way by selecting what is needed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import WORD

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
HASH_BITS = 60
BITS = 12


def sample_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text, as a long."""
    key = F.concat_ws(
        "\n", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    )
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """source, source_size, weight, target for a table of (source, size).

    Sources are ranked in two steps (ranges of names, then inside a range), so no task holds
    them all; only sums of weights and words reach the driver.
    """
    per = cut_lineage(
        sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    )
    first = F.coalesce(F.substring(F.hex(F.encode("source", "UTF-8")), 1, 4), F.lit("~"))
    by_head = per.groupBy(first.alias("head")).count()
    # At most 65,537 heads (two bytes of a name), so one task can add them up.
    before = by_head.withColumn(
        "before", F.sum("count").over(Window.orderBy("head")) - F.col("count")
    )
    # UTF-8 bytes sort as code points do.
    inside = F.row_number().over(
        Window.partitionBy("head").orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    )
    kinds = F.array(*[F.lit(w) for w in weights])
    ranked = cut_lineage(
        per.withColumn("head", first).withColumn("inside", inside).join(before, "head")
        .withColumn("at", F.col("before") + F.col("inside") - 1)
        .select("source", "source_size", F.get(kinds, (F.col("at") % len(weights)).cast("int")).alias("weight"))
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    # A source once at its limit stays there: each pass gives the others more.
    rate, bound = 0.0, F.lit(float(most)) * F.col("source_size")
    while True:
        held = bound <= F.col("weight") * F.lit(rate)
        now = ranked.agg(
            F.sum(F.when(held, bound)).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("open"),
        ).first()
        if not now["open"]:
            break
        share = (total - (now["held"] or 0.0)) / now["open"]
        if share <= rate:
            break
        rate = share
    return ranked.withColumn(
        "target", F.least(bound, F.col("weight") * F.lit(rate)).cast("double")
    )


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int = BITS) -> DataFrame:
    """source and `below`: rows of a source with a hash below it sum nearest to its budget.

    `rows` has source, size and h; `budgets` has source and a budget of words.
    """
    # prefix: the hash bits fixed so far; left: words still to take inside that bucket.
    state = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    used = 0
    while used < HASH_BITS:
        step = min(bits, HASH_BITS - used)
        rest = HASH_BITS - used - step
        inside = (
            rows.select(F.col("source").alias("s"), "size", "h")
            .join(state, F.col("s").eqNullSafe(F.col("source")))
            .filter(F.shiftright("h", HASH_BITS - used) == F.col("prefix"))
        )
        cells = inside.groupBy("source", "prefix", "left", F.shiftright("h", rest).alias("cell")).agg(
            F.sum("size").alias("words")
        )
        to = Window.partitionBy("source").orderBy("cell")
        sums = cells.withColumn("upto", F.sum("words").over(to))
        # The first cell that reaches what is left holds the boundary.
        state = cut_lineage(
            sums.filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("words") < F.col("left")))
            .groupBy("source")
            .agg(F.min_by(F.struct("cell", (F.col("left") - F.col("upto") + F.col("words")).alias("more"), "words"), "cell").alias("b"))
            .select("source", F.col("b.cell").alias("prefix"), F.col("b.more").alias("left"), F.col("b.words").alias("words"))
        )
        used += step
        last = state
        state = state.select("source", "prefix", "left")
    # One hash value is left; it is taken too where that comes nearer to the budget.
    return last.select(
        "source", (F.col("prefix") + F.when(2 * F.col("left") > F.col("words"), 1).otherwise(0)).alias("below")
    )


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
) -> DataFrame:
    """Every row with its share in the mix.

    Columns: doc_id, h, source, size, source_size, target, copies (how often the row is
    taken) and taken = copies * size.
    """
    sized = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        sample_hash(F.col(doc_id), F.col(text)).alias("h"),
        _size(F.col(text)).alias("size"),
    ))
    known = plan(sized, weights, most)
    return (
        sized.join(known, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", _copies())
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "h", "source", "size", "source_size", "target", "copies", "taken")
    )


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _copies() -> Column:
    part = F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return F.when(F.col("size") > 0, F.col("whole") + part).otherwise(0).cast("int")


def plan(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """s, source_size, target, whole and below for each source of a written table of source, h, size."""
    targets = cut_lineage(
        source_targets(sized, weights, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    partly = targets.filter((F.col("budget") > 0) & (F.col("whole") < most)).select("source", "budget")
    cut = thresholds(sized.filter("size > 0"), partly)
    return cut_lineage(
        targets.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
        .select(
            F.col("t.source").alias("s"), "source_size", "target", "whole",
            F.coalesce("below", F.lit(0)).alias("below"),
        )
    )


def repeat_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES,
) -> DataFrame:
    """The rows, with all their columns, each as often as the mix takes it.

    Copies follow from a row's own source, size and hash, so texts are not shuffled but by the
    join with the few sources.
    """
    sized = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"), sample_hash(F.col(doc_id), F.col(text)).alias("h"),
        _size(F.col(text)).alias("size"),
    )
    known = plan(cut_lineage(sized.select("source", "h", "size")), weights, most)
    return (
        sized.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies())
        .filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
    )
