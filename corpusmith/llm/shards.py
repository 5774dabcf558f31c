"""Minimax contiguous partition of a corpus into shards.

Equal texts are one atomic group.  Groups are put in the order of their MD5 and gathered into
`2^CELL_BITS` cells by its first bits, so a group is never cut and the search looks at a table
of a fixed size whatever the corpus.  The smallest shard capacity is found by binary search:
a capacity is feasible if filling shards greedily in that order needs no more shards than there
are.  Cells are cut there.  With fewer texts than cells a cell is nearly always one group; with
more, a cell is a few ten-thousandths of a shard.

Only the cells' sums reach the driver (at most `2^CELL_BITS` rows); rows are numbered inside a
cell, and a cell with many rows (a group of copies) is split by a hash of the id into parts of
about `part_rows` rows that are numbered apart, so no task holds a hot group.

Law: `bytes`.  A null text is worth no bytes but counts with the empty text's group; its CRC is
null.  Rows equal in everything are numbered in any order, which changes no row.  An empty
table gives an empty result; fewer groups than shards leave shards empty.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SHARDS = 40
ROW_BYTES = 16
CELL_BITS = 17
PART_ROWS = 500


def greedy_cuts(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where greedy filling cuts (past the last of each shard), None if it needs more shards.

    `sums` are running sums of the sizes.
    """
    cuts, at, filled = [], 0, 0
    while at < len(sums):
        if len(cuts) == shards:
            return None
        end = bisect_right(sums, filled + capacity, lo=at)
        if end == at:
            return None
        cuts.append(end)
        at, filled = end, sums[end - 1]
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cuts of the contiguous partition whose largest shard is as small as it can be."""
    if not sizes:
        return []
    sums = list(accumulate(sizes))
    low, high = max(max(sizes), -(-sums[-1] // shards)), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sums, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return greedy_cuts(sums, low, shards)


_MADE = ("size", "text_crc32", "shard", "slot")


def _kept_name(column: str, keep: list[str]) -> str:
    """A kept column's name in the result: its own, unless the operator makes one of that name."""
    if column.lower() not in _MADE:
        return column
    taken = {c.lower() for c in (*keep, *_MADE)}
    name = f"{column}_input"
    while name.lower() in taken:
        name += "_"
    return name


def assign_shards(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    keep: list[str] | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Every row with its shard and its slot (from 0, without holes) in it.

    Columns: those of `keep`, doc_id, size, text_crc32, shard, slot.  A kept column named like
    one of the last four keeps its values under that name with `_input` added (and more `_` until
    no column has it), so no name appears twice.
    """
    if shards < 1:
        raise ValueError(f"shards must be positive, not {shards}")
    raw = F.col(text).cast("binary")
    digest = F.md5(F.coalesce(raw, F.lit(b"")))
    rows = docs.select(
        *[F.col(c).alias(f"keep_{c}") for c in keep or []],
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.shiftright(F.conv(F.substring(digest, 1, 5), 16, 10).cast("long"), 20 - CELL_BITS).cast("int").alias("cell"),
        digest.alias("digest"),
    )
    if not keep:
        rows = cut_lineage(rows)
    cells = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    cells.sort(key=lambda r: r["cell"])
    cuts = minimax_cuts([r["size"] for r in cells], shards)
    firsts = [cells[end]["cell"] for end in cuts[:-1]]
    offset, start, of_cell = 0, 0, []
    for end in cuts:
        offset = 0
        for r in cells[start:end]:
            of_cell.append((r["cell"], offset, max(1, -(-r["n"] // part_rows))))
            offset += r["n"]
        start = end
    spark = docs.sparkSession
    # One row per cell: at most 2^CELL_BITS.
    known = spark.createDataFrame(of_cell, "cell int, before long, parts long") if of_cell else spark.createDataFrame([], "cell int, before long, parts long")
    shard = F.lit(0)
    if firsts:
        bounds = F.array(*[F.lit(f) for f in firsts])
        shard = F.size(F.filter(bounds, lambda b: b <= F.col("cell")))
    placed = rows.join(F.broadcast(known), "cell").withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    )
    counts = placed.groupBy("cell", "part").count()
    hot = cut_lineage(
        counts.join(F.broadcast(known.filter("parts > 1")), "cell")
        .withColumn("more", F.sum("count").over(Window.partitionBy("cell").orderBy("part")) - F.col("count"))
        .select("cell", "part", "more")
    )
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("digest", "doc_id"))
    return (
        placed.join(hot, ["cell", "part"], "left")
        .withColumn("slot", F.col("before") + F.coalesce("more", F.lit(0)) + rank - 1)
        .select(
            *[F.col(f"keep_{c}").alias(_kept_name(c, keep)) for c in keep or []],
            *([] if keep and doc_id in keep else ["doc_id"]),
            "size", "text_crc32", shard.cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        )
    )
