"""Quality rules: how far a document's distributions are from its language's.

Two histograms are compared with references by the Jensen-Shannon distance (base 2, so it lies
between 0 and 1): classes of characters, and the most common words of the language.  The
references are the mean shares over all documents of the language, each document counting once, so
that one long document does not make its own reference; the common words are those in COMMON.

A comparison needs enough to compare: fewer than `min_chars` characters or `min_words` words
leave it out (a guard, not a failure).  Documents of a language without listed words are
compared by characters alone.  Null language: a language of its own.  Null, empty and blank
texts have no words, so the base rule on the number of words rejects them.  Rows are judged one
by one, so repeated rows get the same verdict; empty tables give empty results.

Everything is built from DataFrame functions; nothing is shuffled but the sums of the
references, one row per language and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import word_array

MIN_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

MIN_CHARS = 500
MIN_COMPARED_WORDS = 100
MOST_CHAR_DISTANCE = 0.28
MOST_WORD_DISTANCE = 0.25

# Frequent words of each language (fixed values).
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
}
# Classes of characters, each taken out of what the ones before left; the rest is the last class.
CLASSES = [r"[a-z]+", r"[\x20\x09-\x0D]+", r"[^\x00-\x7F]+", r"[A-Z]+", r"[.,;:?'()\x22-]+", r"[0-9]+"]
BLANK_CLASS = 1


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of one length; null if one is all zero."""
    n_p = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    n_q = F.aggregate(q, F.lit(0.0), lambda a, x: a + x)

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    total = F.aggregate(
        F.zip_with(
            F.transform(p, lambda x: x / n_p), F.transform(q, lambda x: x / n_q),
            lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2,
        ),
        F.lit(0.0), lambda s, x: s + x,
    )
    return F.when((n_p > 0) & (n_q > 0), F.sqrt(F.greatest(total, F.lit(0.0))))


def _common_places(words: str, lang: str) -> Column:
    """Places in the language's list of those words that are listed; null without a list."""
    def found(listed: list[str]) -> Column:
        known = F.array(*[F.lit(w) for w in listed])
        return F.filter(
            F.transform(F.col(words), lambda w: F.array_position(known, F.lower(w))), lambda i: i > 0
        )

    out = F.lit(None).cast("array<long>")
    for code, listed in COMMON.items():
        out = F.when(F.col(lang) == code, found(listed)).otherwise(out)
    return out


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return F.size(lines) - F.size(F.array_distinct(lines))


def _doubled(column: str, gap: int) -> Column:
    """Hashes of twice as many words, from those of `gap` words."""
    c = F.col(column)
    n = F.greatest(F.size(c) - gap, F.lit(0))
    return F.zip_with(
        F.slice(c, F.lit(1), n), F.slice(c, F.lit(1 + gap), n), lambda a, b: F.xxhash64(a, b)
    )


def _with_repeats(rows: DataFrame) -> DataFrame:
    """q_n_repeat_words: words in windows of WINDOW words that come twice or more.

    Windows are compared by 64-bit hashes made in three doublings.  Only texts that have a
    repeated window are sorted: by hash, then places of equal neighbours in order; a place covers
    up to the next one, WINDOW words at most.
    """
    rows = rows.withColumn("q_h1", F.transform("q_words", lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):
        rows = rows.withColumn(f"q_h{2 * k}", _doubled(f"q_h{k}", k))
    some = F.size(F.array_distinct("q_h8")) < F.size("q_h8")
    placed = F.array_sort(F.transform("q_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("q_sorted", F.when(some, placed))
    n = F.size("q_sorted") - 1
    equal = F.zip_with(
        F.slice("q_sorted", F.lit(1), n), F.slice("q_sorted", F.lit(2), n),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    rows = rows.withColumn(
        "q_places", F.when(F.col("q_sorted").isNotNull(), F.array_sort(F.array_distinct(F.flatten(equal))))
    )
    m = F.size("q_places") - 1
    steps = F.zip_with(
        F.slice("q_places", F.lit(1), m), F.slice("q_places", F.lit(2), m),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    covered = F.aggregate(steps, F.lit(WINDOW), lambda s, g: s + g)
    return rows.withColumn("q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


STEPS = ["q_words", "q_h1", "q_h2", "q_h4", "q_h8", "q_sorted", "q_places", "q_found"] + [
    f"q_rest{i}" for i in range(len(CLASSES) + 1)
]
MEASURES = [
    "q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words", "q_chars", "q_common"
]


def measure(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents with the columns MEASURES: counts for the base rules and two histograms."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("q_words", word_array(F.col(text))).withColumn("q_rest0", t)
    for i, pattern in enumerate(CLASSES):
        rows = rows.withColumn(f"q_rest{i + 1}", F.regexp_replace(f"q_rest{i}", pattern, ""))
    taken = [F.length(f"q_rest{i}") - F.length(f"q_rest{i + 1}") for i in range(len(CLASSES))]
    chars = F.array(*[c.cast("double") for c in [*taken, F.length(f"q_rest{len(CLASSES)}")]])
    rows = _with_repeats(rows).withColumn("q_found", _common_places("q_words", lang))
    n_words = F.size("q_words")
    most = max(map(len, COMMON.values()))

    def times(k: int) -> Column:
        return F.size(F.filter("q_found", lambda i: i == k)).cast("double")

    common = F.array(
        *[times(k) for k in range(1, most + 1)],
        (n_words - F.size("q_found")).cast("double"),
    )
    return rows.withColumns({
        "q_n_words": n_words.cast("long"),
        "q_word_chars": (F.length(t) - taken[BLANK_CLASS]).cast("long"),
        "q_n_symbols": F.regexp_count(f"q_rest{len(CLASSES)}", F.lit(SYMBOLS)).cast("long"),
        "q_n_dup_lines": _duplicate_lines(t).cast("long"),
        "q_chars": F.when(F.length(t) >= MIN_CHARS, chars),
        "q_common": F.when((n_words >= MIN_COMPARED_WORDS) & F.col("q_found").isNotNull(), common),
    }).drop(*STEPS)


def references(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """One row per language: r_lang, r_chars, r_common, the mean shares over its documents.

    Every document that is long enough to be compared counts once.
    """
    def shares(name: str, n: int) -> list[Column]:
        whole = F.aggregate(F.col(name), F.lit(0.0), lambda a, x: a + x)
        return [F.avg(F.col(name)[i] / whole).alias(f"{name}{i}") for i in range(n)]

    n_chars, n_common = len(CLASSES) + 1, max(map(len, COMMON.values())) + 1
    sums = measured.groupBy(F.col(lang).alias("r_lang")).agg(*shares("q_chars", n_chars), *shares("q_common", n_common))

    def gathered(name: str, n: int) -> Column:
        return F.array(*[F.coalesce(f"{name}{i}", F.lit(0.0)) for i in range(n)])

    return cut_lineage(sums.select(
        "r_lang", gathered("q_chars", n_chars).alias("r_chars"), gathered("q_common", n_common).alias("r_common")
    ))


def judge(measured: DataFrame, refs: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds base_failed, char_distance, word_distance (null: not compared) and kept."""
    joined = measured.join(refs, F.col(lang).eqNullSafe(F.col("r_lang")), "left").drop("r_lang")
    base = (F.col("q_n_words") < MIN_WORDS) | (
        100 * F.col("q_n_repeat_words") > MOST_REPEATED * F.col("q_n_words")
    )
    near = (
        F.coalesce(F.col("char_distance") <= MOST_CHAR_DISTANCE, F.lit(True))
        & F.coalesce(F.col("word_distance") <= MOST_WORD_DISTANCE, F.lit(True))
    )
    return (
        joined.withColumn("char_distance", js_distance(F.col("q_chars"), F.col("r_chars")))
        .withColumn("word_distance", js_distance(F.col("q_common"), F.col("r_common")))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & near)
        .drop("r_chars", "r_common")
    )


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document with measures, distances and the verdict; texts are read once."""
    measured = cut_lineage(
        measure(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")))
        .drop("text")
    )
    names = {m: m.removeprefix("q_") for m in MEASURES}
    return judge(measured, references(measured)).withColumnsRenamed(names).withColumnRenamed("chars", "char_histogram").withColumnRenamed("common", "word_histogram")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, with all their columns, that the rules keep.

    Texts are read twice (references first) instead of being shuffled.
    """
    given = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    refs = references(measure(given.drop("row")))
    # A numbered row keeps the filter above the measures, which are then worked out once.
    measured = measure(given).withColumn("q_row", F.monotonically_increasing_id())
    return judge(measured, refs).filter("kept and q_row >= 0").select("row.*")
