"""Exact similarity join of documents on sets of word n-grams.

Two documents link if the Jaccard similarity of their sets of `gram` consecutive words (A-Z
lowered) reaches `percent` / 100.  The result is the component of every document.

1. Frequencies.  n-grams that are frequent anywhere are counted over all documents; those above
   1 / 2^FREQUENT_BITS of all n-grams (so at most 2^FREQUENT_BITS of them) are broadcast.  Rare ones
   come first in the order of a set, frequent ones last by their counts.  Any order gives the
   same links; this one makes the candidates few.
2. Prefixes.  A set of n needs its first n - ceil(n * percent) + 1 n-grams only: linked sets share
   one of them.  Equal sets are one set from here on.  Prefix n-grams of one set alone go.
3. Candidates pass a length filter, a positional filter (what can still be common behind the
   places of the shared n-gram) and a suffix filter: sets are counted by ranges of the hash, and
   the differences of two sets' counts bound how far apart the sets are from below, first by
   the parities of 256 ranges inside the join, then by the counts of 512.  A pair is verified
   once, on the whole sets, made anew from the two texts.
4. Rather than all pairs of a group of near copies, each set is first tried against the hub of
   an n-gram it shares: the set in whose order that n-gram comes first, so that least is its
   own.  Components grow from those links, and then only sets in different components meet:
   those outside an n-gram's largest component against the rest.  No link between components
   is lost.

n-grams are compared by 64-bit hashes and sets by 64 bits of their n-grams.  A document of
fewer than `gram` words is one n-gram; one without words links with nothing and is its own
component.  Null texts have no words.  Rows with a null id belong to components but name
none; alone, their component is null.  Repeated rows and ids are fine.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .words import batch_hashes, lower, mix, pieces, signed, texts_of, window_hashes

GRAM = 5
PERCENT = 80
FREQUENT_BITS = 20
RANGES = 512
PARITY_LONGS = 8
# n-grams looked at together when frequent ones are sought, and how often one has to come there.
BLOCK_GRAMS = 2_000_000
OFTEN = 3
# Texts to verify are found by a broadcast of so many requests at most, else by a shuffle.
SMALL_REQUESTS = 400_000
PAIRS_PER_SALT = 500
# Ids that go are broadcast up to this many, else the texts are shuffled to meet them.
SMALL_IDS = 2_000_000


def _sets(texts: list[bytes], gram: int) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    words, at = batch_hashes([lower(t) for t in texts])
    grams = window_hashes(words, gram)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= gram:
            yield np.unique(grams[a:b - gram + 1])
        elif b > a:
            # The number of words keeps short texts apart from n-grams.
            yield mix(window_hashes(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.empty(0, dtype=np.uint64)


def _frequent_rows(gram: int):
    """(hash, documents) for n-grams that come often in a block; all n-grams under a null hash."""

    def out(sets: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        kinds, n = np.unique(every, return_counts=True)
        often = n >= OFTEN
        h = pa.array([None, *signed(kinds[often]).tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([h, pa.array([len(every), *n[often].tolist()], pa.int64())], ["h", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0
        for batch in pieces(batches, "text"):
            for s in _sets(texts_of(batch), gram):
                sets.append(s)
                size += len(s)
            if size >= BLOCK_GRAMS:
                yield out(sets)
                sets, size = [], 0
        yield out(sets)

    return rows


def _prefix_rows(gram: int, percent: int, shared):
    """Per document a row about it (pos -1, a spread-out token); per set the n-grams of its prefix.

    A set that comes again in a task sends its prefix once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        seen: set[int] = set()
        for batch in pieces(batches, "text", 2 << 20):
            sids, sizes, ranges, owners, prefixes = [], [], [], [], []
            for i, s in enumerate(_sets(texts_of(batch), gram)):
                n = len(s)
                sid = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)
                sids.append(sid)
                sizes.append(n)
                if not n:
                    ranges.append(None)
                    continue
                counts = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=RANGES)
                ranges.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
                if sid in seen:
                    continue
                seen.add(sid)
                often_here = np.zeros(n, dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    often_here[hit] = often[at[hit]]
                first = n - -(-n * percent // 100) + 1
                order = np.argsort(often_here, kind="stable")[:first] if often_here.any() else slice(0, first)
                owners.append(i)
                prefixes.append(signed(s[order]))
            lengths = np.array([len(p) for p in prefixes], dtype=np.int64)
            owner = np.repeat(np.array(owners, dtype=np.int64), lengths)
            pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            sid, size, n = np.array(sids, dtype=np.int64), np.array(sizes, dtype=np.int32), len(sids)
            doc = pa.StructArray.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), pa.array(ranges, pa.binary())], ["doc_id", "k1", "ranges"]
            )
            token = signed(mix(sid.view(np.uint64) + np.arange(n, dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(sid), pa.array(size), pa.array(np.full(n, -1, dtype=np.int32)), doc],
                ["token", "sid", "n", "pos", "doc"],
            )
            if len(owner):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(prefixes)), pa.array(sid[owner]), pa.array(size[owner]),
                     pa.array(pos.astype(np.int32)), pa.nulls(len(owner), doc.type)],
                    ["token", "sid", "n", "pos", "doc"],
                )

    return rows


def _verify_rows(gram: int, percent: int):
    """Streams of one text (`b` null) and those to hold against it: the pairs that link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base = None, np.empty(0, dtype=np.uint64)
        for batch in pieces(batches, "text"):
            links: list[tuple[int, int]] = []
            asked = (batch.column(c).to_pylist() for c in ("a", "b"))
            for a, b, s in zip(*asked, _sets(texts_of(batch), gram)):
                if b is None:
                    key, base = a, s
                    continue
                if key != a:
                    raise ValueError("a text to verify against is missing")
                both = len(base) + len(s) - len(np.union1d(base, s))
                if 100 * both >= percent * (len(base) + len(s) - both):
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"]
                )

    return rows


def _parity_rows():
    """Adds the parities of the counts by range, two ranges to a bit, as longs p0, p1 ..."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("ranges").to_pylist()), dtype=np.uint8).reshape(-1, RANGES)
            folded = raw.reshape(len(raw), -1, RANGES // (64 * PARITY_LONGS)).astype(np.int64).sum(axis=2)
            # A saturated count has no known parity; it is taken as even in every set.
            odd = (folded & 1).astype(bool) & ~(raw == 255).reshape(folded.shape + (-1,)).any(axis=2)
            longs = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sid"), *[pa.array(np.ascontiguousarray(longs[:, i])) for i in range(PARITY_LONGS)]],
                ["sid", *[f"p{i}" for i in range(PARITY_LONGS)]],
            )

    return rows


def _suffix_rows(percent: int):
    """Pairs whose sets' counts by range allow the overlap that is needed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, RANGES).astype(np.int32)
                for c in ("ra", "rb")
            )
            apart = np.abs(x - y).sum(axis=1)
            total = batch.column("total").to_numpy()
            # overlap <= (total - apart) / 2 and overlap >= percent / (100 + percent) * total
            keep = (100 + percent) * (total - apart) >= 2 * percent * total
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return rows


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length and positional filter for a shared n-gram at places p1 and p2 (from 0).

    It is taken as the first that the sets share, so all they share starts there.  Linked
    sets pass at their first one at least.
    """
    sizes = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    return sizes & ((100 + percent) * F.least(n1 - p1, n2 - p2) >= percent * (n1 + n2))


class Join:
    """One similarity join: the tables that its steps share."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, gram: int, percent: int):
        if gram < 1 or not 0 < percent <= 100:
            raise ValueError("gram must be positive and percent lie in (0, 100]")
        self.gram, self.percent = gram, percent
        spark = docs.sparkSession
        plain = F.coalesce(F.col(text), F.lit(""))
        self.rows = docs.select(F.col(doc_id).alias("doc_id"), plain.alias("text"), F.xxhash64(plain).alias("k1"))
        counts = cut_lineage(
            self.rows.select("text").mapInArrow(_frequent_rows(gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        )
        total = counts.filter("h is null").agg(F.sum("n")).first()[0] or 0
        often = counts.filter((F.col("h").isNotNull()) & (F.col("n") >= max(8, total >> FREQUENT_BITS))).toArrow()
        known = often.column("h").to_numpy().view(np.uint64)
        order = np.argsort(known)
        shared = spark.sparkContext.broadcast((known[order], often.column("n").to_numpy()[order]))
        id_type = self.rows.schema["doc_id"].dataType.simpleString()
        found = self.rows.mapInArrow(
            _prefix_rows(gram, percent, shared),
            f"token long, sid long, n int, pos int, doc struct<doc_id:{id_type},k1:bigint,ranges:binary>",
        )
        # Each set once per n-gram, n-grams of several sets only; documents' own rows pass.
        whole = Window.partitionBy("token")
        to = whole.orderBy("pos", "n", "sid")
        hub = F.first(F.struct("sid", "n", "pos")).over(to)
        found = cut_lineage(
            found.withColumn("hub", hub).withColumn("again", F.lag("sid").over(to).eqNullSafe(F.col("sid")))
            .withColumn("several", F.min("sid").over(whole) != F.max("sid").over(whole))
            .filter("doc is not null or (several and not again)").drop("again", "several")
        )
        self.sets = found.filter("doc is not null").select("sid", "n", "doc.*")
        self.tokens = found.filter("doc is null").select("token", "sid", "n", "pos", "hub")
        # One document stands for each set.
        self.stands = cut_lineage(
            self.sets.filter("n > 0").groupBy("sid").agg(F.min(F.struct("k1", "doc_id", "n", "ranges")).alias("d")).select("sid", "d.*")
        )

    def to_hubs(self) -> DataFrame:
        """For every set the hub it shares most first n-grams with: a, b."""
        ok = _may_link(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), self.percent)
        return (
            self.tokens.filter(F.col("sid") != F.col("hub.sid")).filter(ok)
            .groupBy("sid", F.col("hub.sid").alias("other")).agg(F.count("*").alias("times"))
            .groupBy("sid").agg(F.max_by("other", F.struct("times", "other")).alias("other"))
            .select(F.col("other").alias("a"), F.col("sid").alias("b"))
        )

    def across(self, roots: DataFrame) -> DataFrame:
        """Every pair of sets of one n-gram in different components that passes the filters."""
        tokens = (
            self.tokens.select("token", "sid", "n", "pos").join(roots.withColumnRenamed("id", "sid"), "sid", "left")
            .withColumn("root", F.coalesce("root", "sid"))
            # Two sets that also share the n-gram before this one have met there.
            .withColumn("before", F.lag("token").over(Window.partitionBy("sid").orderBy("pos")))
        )
        parts = tokens.groupBy("token", "root").agg(F.count("*").alias("times"))
        # The component with most sets of an n-gram, where there are several.
        main = parts.groupBy("token").agg(
            F.max_by("root", F.struct("times", "root")).alias("main"), F.count("*").alias("parts")
        ).filter("parts > 1").drop("parts")
        names = [f"p{i}" for i in range(PARITY_LONGS)]
        parity = self.stands.select("sid", "ranges").mapInArrow(
            _parity_rows(), "sid long, " + ", ".join(f"{p} long" for p in names)
        )
        mixed = cut_lineage(tokens.join(main, "token").join(parity, "sid"))
        x, y = mixed.filter("root <> main").alias("x"), mixed.alias("y")
        once = (F.col("y.root") == F.col("y.main")) | (F.col("x.sid") < F.col("y.sid"))
        once &= ~F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False))
        ok = _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), self.percent)
        apart = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in names), F.lit(0))
        total = F.col("x.n") + F.col("y.n")
        near = (100 + self.percent) * (total - apart) >= 2 * self.percent * total
        return x.join(
            y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & once & ok & near
        ).select(F.col("y.sid").alias("a"), F.col("x.sid").alias("b"))

    def verify(self, pairs: DataFrame, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The pairs (each once, none of `done`) after the suffix filter, and which of them link."""
        pairs = pairs.dropDuplicates()
        if done is not None:
            for a, b in (("a", "b"), ("b", "a")):
                pairs = pairs.join(done.select(F.col(a).alias("a"), F.col(b).alias("b")), ["a", "b"], "left_anti")
        about = self.stands.select("sid", "n", "ranges")
        pairs = cut_lineage(
            cut_lineage(pairs)
            .join(about.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("ranges").alias("ra")), "a")
            .join(about.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("ranges").alias("rb")), "b")
            .select("a", "b", "ra", "rb", (F.col("na") + F.col("nb")).alias("total"))
            .mapInArrow(_suffix_rows(self.percent), "a long, b long")
        )
        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_SALT).alias("salts"))
        # One copy of a base for each part of those to hold against it.
        bases = salts.select(
            "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
            F.lit(None).cast("long").alias("b"), F.col("a").alias("sid"),
        )
        others = pairs.join(salts, "a").select(
            "a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b", F.col("b").alias("sid")
        )
        asked = cut_lineage(
            bases.unionByName(others).join(self.stands.select("sid", "k1", F.col("doc_id").alias("id")), "sid").drop("sid")
        )
        if asked.count() <= SMALL_REQUESTS:
            asked = F.broadcast(asked)
        texts = self.rows.alias("d").join(
            asked.alias("q"), (F.col("d.k1") == F.col("q.k1")) & F.col("doc_id").eqNullSafe(F.col("id"))
        )
        links = (
            texts.select("a", "salt", "b", "text").repartition("a", "salt")
            .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
            .select("a", "b", "text").mapInArrow(_verify_rows(self.gram, self.percent), "a long, b long")
        )
        return pairs, cut_lineage(links.dropDuplicates())

    def links(self) -> DataFrame:
        """Verified links (a, b) that give the components."""
        done, links = self.verify(self.to_hubs())
        more = self.verify(self.across(cut_lineage(components(links))), done)[1]
        return links.unionByName(more)

    def members(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id."""
        roots = components(self.links())
        rows = self.sets.select("doc_id", "sid", F.col("n").cast("long").alias("n_shingles"))
        rows = rows.join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        some = F.col("n_shingles") > 0
        names = rows.filter(some).groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return (
            rows.withColumn("root", F.when(some, F.col("root"))).join(names, "root", "left")
            .select("doc_id", "n_shingles", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        )


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id it reaches)."""
    return Join(docs, doc_id, text, gram, percent).members()


def _unused(columns: list[str], stem: str) -> str:
    """A column name that none of `columns` has, whatever their case."""
    taken = {c.lower() for c in columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of similar documents, with all its columns unchanged.

    Every row is a document, whatever its id: rows are numbered once (a written table, so the
    numbers hold when a task is run again) and joined by number.  A group keeps the row with the
    smallest (null id last, id, 64-bit hash of the text, row number); every other row of it goes,
    so two rows with one id and unlike texts both stay, and a copy of a smaller id goes even where
    its own id repeats.  Rows with a null id are grouped like all others.  Texts without words
    link with nothing and stay.  Extra columns of any name pass through; the private ones get
    names no column has.  An empty table gives an empty one.
    """
    row = _unused(docs.columns, "__row")
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    members = similar_documents(
        numbered.select(F.col(row).alias("doc_id"), F.col(text).alias("text"))
    ).select(F.col("doc_id").alias("r"), F.col("component_id").alias("c"))
    order = F.struct(
        F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"),
        F.xxhash64(F.col(text)).alias("h"), F.col(row).alias("r"),
    )
    keys = numbered.select(F.col(row).alias("r"), order.alias("k"))
    # Partial minima before the shuffle: a group of any size is a few rows per task.
    chosen = cut_lineage(
        members.join(keys, "r").groupBy("c").agg(F.min("k").alias("k")).select(F.col("k.r").alias(row))
    )
    # Row numbers are 8 bytes each, so a broadcast of SMALL_IDS of them stays below 16 MB.
    if chosen.count() <= SMALL_IDS:
        chosen = F.broadcast(chosen)
    return numbered.join(chosen, row, "left_semi").drop(row)
