"""Prefix trie of conversations, with subtree sums by the Euler-tour technique.

Every conversation is rebuilt first (`rebuilt_turns`): the first h turns of its base conversation
(conv_id - conv_id mod 20), then its own turns after its first h, where h = crc32(decimal conv_id)
mod 4.  Every distinct sequence of a rebuilt conversation's first d turns (role, text) is a node of
depth d; the root (d = 0) has no text, and all conversations, even turnless ones, are its members.

1. Nodes.  A prefix is named by its depth and two sums of 64-bit hashes of (place, role, text) over
   its turns, made by a running sum over each conversation, so nodes come from one aggregation of
   member rows: smallest member, members, ends.  Parent and children counts are joins by name.
2. Owner chains.  The nodes whose smallest member is conversation c lie on one path, from where c
   leaves all smaller conversations down to its end.  These chains form a tree of their own, at
   most one chain per conversation.
3. Euler tour.  Each chain has an enter and an exit arc.  After enter(x) comes enter of x's first
   child chain, else exit(x); after exit(x) comes enter of x's next sibling, else exit of its
   parent.  Siblings are ordered by a distributed sort (ranges of the key, counts per part), not
   by grouping under the parent, so a chain with very many children is spread over tasks.  The
   tour is list-ranked by pointer jumping (each arc learns the sums from itself to the end of the
   tour; log2 of the tour rounds, each one join of written tables).  A chain's subtree sum is the
   difference of the sums at its enter and exit arcs.
4. Nodes again.  A node's subtree is its own chain from it downwards plus the subtrees of chains
   hung below it on that chain: a running sum over the chain, deepest first.

Leaves are nodes without children; a node's saving is (members - 1) times the words
`[^\\x20\\x09-\\x0D]+` of its last text.  Turns are ordered by turn (null first), then role and text,
so ties and repeated rows have a fixed order and repeated rows are turns of their own.  Null role
or text is empty; rows with a null conv_id take no part.  `c mod 20` is taken as the non-negative
remainder.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Fixed values of the rebuild: conversations are based on the one at a multiple of BASE, sharing
# up to crc32(decimal id) mod SHARED of its first turns.
BASE = 20
SHARED = 4
WORDS = r"[^\x20\x09-\x0D]+"

_KEY = "struct<d:bigint,s1:decimal(38,0),s2:decimal(38,0)>"


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, j, role, text) of every rebuilt conversation, and (conv_id, n) of every conv_id."""
    t = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = cut_lineage(t.withColumn("i", F.row_number().over(order) - 1).drop("turn"))
    convs = t.groupBy("c").agg(F.count("*").alias("n_own")).withColumns({
        "h": F.crc32(F.col("c").cast("string").cast("binary")) % SHARED,
        "p": F.col("c") - F.pmod(F.col("c"), F.lit(BASE)),
    })
    # A base lends at most SHARED - 1 turns, and each base serves at most BASE conversations.
    lent = t.filter(F.col("i") < SHARED - 1).select(F.col("c").alias("p"), "i", "role", "text")
    has = lent.groupBy("p").agg(F.count("*").alias("n_lent"))
    convs = cut_lineage(convs.join(has, "p", "left").withColumn(
        "m", F.least(F.col("h"), F.coalesce(F.col("n_lent"), F.lit(0)))
    ).select("c", "h", "p", "m"))
    borrowed = convs.join(lent, "p").filter(F.col("i") < F.col("h")).select("c", F.col("i").alias("j"), "role", "text")
    own = t.join(convs, "c").filter(F.col("i") >= F.col("h")).select(
        "c", (F.col("i") - F.col("h") + F.col("m")).alias("j"), "role", "text"
    )
    return borrowed.unionByName(own), convs.select("c")


def _hash(*cols: Column) -> Column:
    """A 64-bit hash as a non-negative decimal, so that sums of any length never overflow."""
    return (F.xxhash64(*cols).cast("decimal(38,0)") + F.lit(str(2**63)).cast("decimal(38,0)")).cast("decimal(38,0)")


def _key(d: Column, s1: Column, s2: Column) -> Column:
    return F.struct(d.cast("long").alias("d"), s1.cast("decimal(38,0)").alias("s1"), s2.cast("decimal(38,0)").alias("s2"))


def nodes(conversations: DataFrame) -> DataFrame:
    """key, pkey, conv_id, depth, n_convs, words, ends_sha256 of every node."""
    turns, convs = rebuilt_turns(conversations)
    x1, x2 = _hash(F.col("j"), F.col("role"), F.col("text")), _hash(F.col("text"), F.col("role"), F.col("j"), F.lit("2"))
    upto = Window.partitionBy("c").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.select("c", "j", x1.alias("x1"), x2.alias("x2"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    turns = turns.withColumns({"s1": F.sum("x1").over(upto), "s2": F.sum("x2").over(upto)})
    length = turns.groupBy("c").agg(F.count("*").alias("n"))
    length = convs.join(length, "c", "left").select("c", F.coalesce("n", F.lit(0)).alias("n"))
    members = turns.join(length, "c").select(
        "c", _key(F.col("j") + 1, F.col("s1"), F.col("s2")).alias("key"),
        _key(F.col("j"), F.col("s1") - F.col("x1"), F.col("s2") - F.col("x2")).alias("pkey"),
        "words", (F.col("j") + 1 == F.col("n")).alias("end"),
    )
    zero = F.lit(0).cast("decimal(38,0)")
    root = length.select(
        "c", _key(F.lit(0), zero, zero).alias("key"), F.lit(None).cast(_KEY).alias("pkey"),
        F.lit(0).cast("long").alias("words"), (F.col("n") == 0).alias("end"),
    )
    ends = F.array_sort(F.collect_list(F.when(F.col("end"), F.col("c"))))
    return cut_lineage(
        members.unionByName(root).groupBy("key").agg(
            F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.first("pkey").alias("pkey"),
            F.first("words").alias("words"),
            F.sha2(F.array_join(F.transform(ends, lambda v: v.cast("string")), ",").cast("binary"), 256).alias("ends_sha256"),
        ).withColumn("depth", F.col("key.d"))
    )


def _ordered(df: DataFrame, *order: str) -> DataFrame:
    """df with `idx`: its place from 0 in `order`, by ranges of the key and counts per part."""
    parts = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    )
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))
    # One row per part of the sort: a table of the size of the shuffle's part count.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return parts.join(F.broadcast(offsets), "_p").withColumn(
        "idx", F.col("_off") + F.col("_m") - F.col("_m0")
    ).drop("_p", "_m", "_n", "_m0", "_off")


def _rank_tour(arcs: DataFrame) -> DataFrame:
    """arc, cnt, leaves, saved: sums from each arc to the end of its list, by pointer jumping."""
    arcs = cut_lineage(arcs)
    while not arcs.filter(F.col("nxt").isNotNull()).isEmpty():
        a, b = arcs.alias("a"), arcs.alias("b")
        arcs = cut_lineage(a.join(b, F.col("a.nxt") == F.col("b.arc"), "left").select(
            F.col("a.arc").alias("arc"), F.col("b.nxt").alias("nxt"),
            *[(F.col(f"a.{v}") + F.coalesce(F.col(f"b.{v}"), F.lit(0))).alias(v) for v in ("cnt", "leaves", "saved")],
        ))
    return arcs.drop("nxt")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = nodes(conversations)
    kids = found.filter(F.col("pkey").isNotNull()).groupBy(F.col("pkey").alias("key")).agg(F.count("*").alias("n_children"))
    parents = found.select(F.col("key").alias("pkey"), F.col("conv_id").alias("parent_conv_id"))
    found = cut_lineage(
        found.join(kids, "key", "left").join(parents, "pkey", "left").select(
            "key", "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"), "ends_sha256",
            (F.coalesce("n_children", F.lit(0)) == 0).cast("long").alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("save"),
        )
    )
    # Chains: the nodes of one smallest member; hung below their top node's parent.
    chains = cut_lineage(found.groupBy(F.col("conv_id").alias("x")).agg(
        F.min_by("parent_conv_id", "depth").alias("up"), (F.min("depth") - 1).alias("at"),
        F.sum("leaf").alias("leaves"), F.sum("save").alias("saved"),
    ))
    hung = _ordered(chains.filter(F.col("up").isNotNull()).select("up", "x"), "up", "x")
    nxt = hung.alias("a").join(hung.alias("b"), (F.col("b.idx") == F.col("a.idx") + 1) & (F.col("a.up") == F.col("b.up")), "left").select(
        F.col("a.x").alias("x"), F.col("b.x").alias("sibling")
    )
    first = hung.groupBy(F.col("up").alias("x")).agg(F.min("x").alias("child"))
    links = chains.join(first, "x", "left").join(nxt, "x", "left")
    enter, leave = F.col("x") * 2, F.col("x") * 2 + 1
    arcs = links.select(
        enter.alias("arc"), F.coalesce(F.col("child") * 2, leave).alias("nxt"),
        F.lit(1).cast("long").alias("cnt"), F.col("leaves").cast("long").alias("leaves"), F.col("saved").cast("long").alias("saved"),
    ).unionByName(links.select(
        leave.alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("up") * 2 + 1).alias("nxt"),
        F.lit(1).cast("long").alias("cnt"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
    ))
    ranked = _rank_tour(arcs)
    at_enter = ranked.filter(F.col("arc") % 2 == 0).select((F.col("arc") / 2).cast("long").alias("x"), F.col("leaves").alias("l_in"), F.col("saved").alias("s_in"))
    at_exit = ranked.filter(F.col("arc") % 2 != 0).select(((F.col("arc") - 1) / 2).cast("long").alias("x"), F.col("leaves").alias("l_out"), F.col("saved").alias("s_out"))
    # A chain's subtree sums: the difference of the sums at its enter and exit arcs.
    tour = chains.join(at_enter, "x").join(at_exit, "x")
    hung_sums = tour.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.sum(F.col("l_in") - F.col("l_out")).alias("l_hung"), F.sum(F.col("s_in") - F.col("s_out")).alias("s_hung")
    )
    # A node's subtree: its chain from it down, and whatever hangs below it on the chain.
    down = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = found.join(hung_sums, ["conv_id", "depth"], "left").withColumns({
        "n_leaves": F.sum(F.col("leaf") + F.coalesce("l_hung", F.lit(0))).over(down),
        "saved_tokens": F.sum(F.col("save") + F.coalesce("s_hung", F.lit(0))).over(down),
    })
    return out.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.col("parent_conv_id").cast("long").alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"),
        F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"), "ends_sha256",
    )
