"""Spelling variants: words one edit apart, grouped under their far more frequent form.

1. Words.  Maximal runs of `[A-Za-z\\u00C0-\\u00FF]` are taken from whole texts and A-Z lower-cased.
   Let h be the unsigned crc32 of `<doc_id>:<run>`; where 31 divides h, the run loses its code
   point h mod length.  Words are the distinct results of at least MIN_LENGTH code points that
   occur at least MIN_COUNT times over all documents (one aggregation, combined before the shuffle).
2. Asymmetric q-chunks.  A word s of length L gives two disjoint chunks that cover it: s[0:L//2]
   at place 0 and s[L//2:] at place L//2.  One insertion, deletion or replacement changes at most
   one of them, and leaves the other in the partner t where it was (the first chunk) or moved by
   at most one (the second).  So t gives, for each length L' within one of its own, its grams at
   exactly those places: the first chunk's at 0, the second's at L'//2 - 1, L'//2 and L'//2 + 1.
   Chunks meet grams by an equi-join on (L', which chunk, text, and the first or else the last code
   point of what the chunk leaves of the word: that rest is one edit apart at most and at least two
   code points long, so one of its ends is the same).  Each candidate is checked by an edit
   distance bounded at one where the join meets it.
3. Forms.  A word's form is its near word of largest n (ties: smallest by code points) where that n
   is at least RATIO times its own; a form has a larger n than the word, so forms never loop.
   Roots follow forms by pointer jumping.

Null texts have no runs; a null doc_id hashes as the empty string.  Extra columns are ignored.
An empty table, or one without words, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Fixed values of the contract: runs, the deletion rule, word limits and the form ratio.
RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETE_MOD = 31
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10


def _cut(word: Column, start: Column, length: Column | None = None) -> Column:
    """Code points of `word` from `start` (from 0), `length` of them or to the end."""
    return F.substring(word, start + 1, length if length is not None else F.lit(1 << 30))


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: every distinct word of at least MIN_LENGTH code points, seen at least MIN_COUNT times."""
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUNS), 0)).alias("r"),
    ).select("d", F.translate("r", UPPER, LOWER).alias("r"))
    h = F.crc32(F.concat(F.col("d"), F.lit(":"), F.col("r")).cast("binary"))
    at = h % F.char_length("r")
    word = F.when(h % DELETE_MOD == 0, F.concat(_cut(F.col("r"), F.lit(0), at), _cut(F.col("r"), at + 1))).otherwise(F.col("r"))
    return (
        runs.select(word.alias("word")).filter(F.char_length("word") >= MIN_LENGTH)
        .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)
    )


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(s, t): every ordered pair of distinct words one edit apart, found by chunks and grams."""
    length = F.char_length("word")
    half = (length / 2).cast("int")
    last = F.substring("word", -1, 1)
    # Each chunk with the first and the last code point of what it leaves of the word.
    chunks = vocab.select(
        "word", length.alias("len"),
        F.explode(F.array(
            F.struct(F.lit(1).alias("which"), _cut(F.col("word"), F.lit(0), half).alias("piece"),
                     F.substring("word", half + 1, 1).alias("first"), last.alias("last")),
            F.struct(F.lit(2).alias("which"), _cut(F.col("word"), half).alias("piece"),
                     F.substring("word", 1, 1).alias("first"), F.substring("word", half, 1).alias("last")),
        )).alias("c"),
    ).select(F.col("word").alias("s"), "len", "c.which", "c.piece", "c.first", "c.last")
    # For each partner length L' within one: the first chunk's gram at 0, the second's near L'//2.
    grams = vocab.select(
        "word", length.alias("own"),
        F.explode(F.array(*[
            F.struct(F.lit(d).alias("dl"), F.lit(which).alias("which"), F.lit(shift).alias("shift"))
            for d in (-1, 0, 1) for which, shift in ((1, 0), (2, -1), (2, 0), (2, 1))
        ])).alias("g"),
    ).select(F.col("word").alias("t"), "own", (F.col("own") + F.col("g.dl")).alias("len"), "g.which", "g.shift")
    other_half = (F.col("len") / 2).cast("int")
    start = F.when(F.col("which") == 1, F.lit(0)).otherwise(other_half + F.col("shift"))
    size = F.when(F.col("which") == 1, other_half).otherwise(F.col("len") - other_half)
    rest_first = F.when(F.col("which") == 1, F.substring("t", other_half + 1, 1)).otherwise(F.substring("t", 1, 1))
    rest_last = F.when(F.col("which") == 1, F.substring("t", -1, 1)).otherwise(F.substring("t", start, 1))
    grams = grams.filter((F.col("len") >= MIN_LENGTH) & (start >= 0) & (start + size <= F.col("own"))).select(
        "t", "len", "which", _cut(F.col("t"), start, size).alias("piece"), rest_first.alias("first"), rest_last.alias("last")
    )
    # The rest of the word besides the kept chunk is at least two code points long on both sides
    # and one edit apart at most, so its first or its last code point is the same in both.
    # Rows of the join are a word and one 64-bit key of (length, chunk, text, end): a collision
    # only adds a candidate, which the check of the edit distance takes out again.
    ends = lambda df, word: df.select(
        word, F.explode(F.array(
            F.xxhash64("len", "which", "piece", F.lit("<"), "first"), F.xxhash64("len", "which", "piece", F.lit(">"), "last"),
        )).alias("key"),
    )
    found = ends(chunks, "s").join(ends(grams, "t"), "key")
    # Verified where the join meets them, so only true pairs reach the shuffle that makes them one.
    found = found.filter((F.col("s") != F.col("t")) & (F.levenshtein("s", "t", 1) == 1))
    return found.select("s", "t").dropDuplicates()


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    vocab = cut_lineage(words(docs, doc_id, text))
    pairs = cut_lineage(near_pairs(vocab))
    counted = pairs.join(vocab.select(F.col("word").alias("t"), F.col("n").alias("tn")), "t")
    best = counted.groupBy(F.col("s").alias("word")).agg(
        F.count("*").alias("n_near"),
        # Largest n first, then the smallest word: the least of (-n, word).
        F.min(F.struct((-F.col("tn")).alias("neg"), F.col("t").alias("t"))).alias("b"),
    )
    rows = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("b.neg") >= RATIO * F.col("n"), F.col("b.t")).alias("form"),
        F.when(-F.col("b.neg") >= RATIO * F.col("n"), -F.col("b.neg")).alias("form_n"),
    )
    rows = cut_lineage(rows)
    # Roots by pointer jumping: each round follows the form of the present root.
    up = rows.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        step = up.alias("a").join(up.alias("b"), F.col("a.root") == F.col("b.word")).select(
            F.col("a.word").alias("word"), F.col("b.root").alias("root"), (F.col("a.root") != F.col("b.root")).alias("moved")
        )
        step = cut_lineage(step)
        if step.filter("moved").isEmpty():
            up = step.drop("moved")
            break
        up = step.drop("moved")
    return rows.join(up, "word").select(
        "word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", F.col("form_n").cast("long").alias("form_n")
    )
