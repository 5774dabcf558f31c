"""URL filters by the ratio of two character language models.

Rules with hosts and paths decide some URLs.  What they allow and what they block trains
two smoothed Markov models of variable order; every other URL is judged by the difference
of its log-likelihoods, divided by its length, against a threshold that is calibrated on
labelled URLs held out of the training.

Models: contexts of up to ORDER characters.  A context is kept if it makes up at least
`min_share` of all characters of its class, so a model has at most 1 / min_share contexts of
each length whatever the corpus; probabilities interpolate down to the longest shorter context
(Witten-Bell), at the end to equal shares of the 96 symbols.  Counts are sums over all
labelled URLs, combined before the shuffle; only kept contexts reach the driver.

Calibration: held-out scores go into a histogram of fixed bins; the threshold is the bin edge
with the best mean of both classes' hit rates, the one nearest to zero among equals.

Null URLs and those without :// have empty host and path; an empty text scores 0.  If a
class has no URL to train on, there is no ratio: what the rules leave open is allowed.  Rows are
judged one by one, repeated rows alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ORDER = 4
MIN_SHARE = 1e-4
HOLD_OUT = 5
ALPHABET = 96
BIN = 0.01
BINS = 500

ALLOW, BLOCK = "allow", "block"
RULES = (
    (ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"), (BLOCK, "com/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lowered) and the path of a URL; both empty without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The verdict and string of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    # The longest is looked at last and so stands outermost.
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _shown(url: Column) -> Column:
    """What the models read: the URL behind ://, A-Z lowered, odd characters as one symbol."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.coalesce(url, F.lit("")))
    return F.regexp_replace(F.translate(rest, _UPPER, _LOWER), r"[^\x21-\x7E]", "\x7f")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of grams of 1 to ORDER + 1 characters by class."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([counts[k] for k in keys], pa.int64())], ["good", "gram", "n"],
        )
        counts.clear()
        return batch

    for batch in batches:
        for good, text in zip(batch.column("good").to_pylist(), batch.column("shown").to_pylist()):
            for size in range(1, ORDER + 2):
                counts.update([(good, text[i:i + size]) for i in range(len(text) - size + 1)])
            if len(counts) > 500_000:
                yield out()
    if counts:
        yield out()


class Markov:
    """One class's model: log-probabilities of characters after kept contexts."""

    def __init__(self, rows: list[tuple[str, int]]):
        after: dict[str, dict[str, int]] = defaultdict(dict)
        for gram, n in rows:
            after[gram[:-1]][gram[-1]] = n
        self.log: dict[str, dict[str, float]] = {}
        self.rest: dict[str, float] = {}
        for context in sorted(after, key=len):
            seen = after[context]
            total, kinds = sum(seen.values()), len(seen)
            self.log[context] = {
                c: math.log((n + kinds * math.exp(self.score(context[1:], c) if context else -math.log(ALPHABET))) / (total + kinds))
                for c, n in seen.items()
            }
            self.rest[context] = math.log(kinds / (total + kinds))

    def score(self, context: str, c: str) -> float:
        """The log-probability of c after the longest kept end of a context."""
        back = 0.0
        while True:
            known = self.log.get(context)
            if known is not None:
                found = known.get(c)
                if found is not None:
                    return back + found
                back += self.rest[context]
            if not context:
                return back - math.log(ALPHABET)
            context = context[1:]

    def of_text(self, text: str) -> float:
        return sum(self.score(text[max(0, i - ORDER):i], c) for i, c in enumerate(text))


def train(labelled: DataFrame, min_share: float = MIN_SHARE) -> tuple[Markov, Markov] | None:
    """The models of good and of bad URLs, from a table of good (boolean) and shown."""
    grams = cut_lineage(
        labelled.select("good", "shown").mapInArrow(_count, "good boolean, gram string, n long")
        .groupBy("good", "gram").agg(F.sum("n").alias("n"))
    )
    grams = grams.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    totals = {r["good"]: r["n"] for r in grams.filter("length(gram) = 1").groupBy("good").agg(F.sum("n").alias("n")).collect()}
    if not (totals.get(True) and totals.get(False)):
        return None
    least = F.when(F.col("good"), min_share * totals[True]).otherwise(min_share * totals[False])
    contexts = (
        grams.groupBy("good", "context").agg(F.sum("n").alias("of_context"))
        .filter((F.col("context") == "") | (F.col("of_context") >= least))
    )
    rows = grams.join(contexts, ["good", "context"]).select("good", "gram", "n").collect()
    return tuple(Markov([(r["gram"], r["n"]) for r in rows if r["good"] == side]) for side in (True, False))


def with_scores(rows: DataFrame, models: tuple[Markov, Markov]) -> DataFrame:
    """Adds score: difference of the log-likelihoods per character, 0 for an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    from pyspark.sql import types as T

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = shared.value
        for batch in batches:
            texts = batch.column("shown").to_pylist()
            values = [(good.of_text(t) - bad.of_text(t)) / max(1, len(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, "score"]
            )

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def calibrate(scored: DataFrame) -> float:
    """The threshold for held-out rows with good and score."""
    place = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-BINS)), F.lit(BINS))
    cells: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for r in scored.groupBy(place.alias("cell"), "good").count().collect():
        cells[r["cell"]][r["good"]] += r["count"]
    bad, good = (sum(c[i] for c in cells.values()) for i in (0, 1))
    if not (bad and good):
        return 0.0
    best, below = [], [0, 0]
    for edge in range(-BINS, BINS + 2):
        # Everything below the edge is blocked.
        hits = below[0] / bad + 1 - below[1] / good
        best.append((-round(hits, 12), abs(edge), edge))
        below = [b + c for b, c in zip(below, cells.get(edge, [0, 0]))]
    return min(best)[2] * BIN


def judge_urls(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """One row per URL: page_id, host, path, rule, verdict, score (null without models)."""
    host, path = host_and_path(F.col(url))
    rows = cut_lineage(
        pages.select(
            F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), _shown(F.col(url)).alias("shown")
        ).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", "shown", "fit.rule", F.col("fit.verdict").alias("ruled"))
        .withColumn("held_out", F.crc32(F.encode("shown", "UTF-8")) % HOLD_OUT == 0)
    )
    labelled = rows.filter("ruled is not null").withColumn("good", F.col("ruled") == ALLOW)
    models = train(labelled.filter("not held_out"), min_share)
    if models is None:
        scored, threshold = rows.withColumn("score", F.lit(None).cast("double")), 0.0
    else:
        threshold = calibrate(with_scores(labelled.filter("held_out").select("good", "shown"), models))
        scored = with_scores(rows, models)
    judged = F.when(F.coalesce(F.col("score") >= F.lit(threshold), F.lit(True)), ALLOW).otherwise(BLOCK)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
