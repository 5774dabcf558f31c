"""Line dedup by a line's frequency within its site.

Pages are grouped by host.  For each line the pages of the host that hold it are divided
by the host's pages; a line above `ratio` is boilerplate and goes from every page of that
host.  Hosts with fewer than `min_pages` pages are left alone, as are pages without a host.

Pages are parsed once and written as (page, host, lines).  Counting is a sum by host and 64-bit
line hash, combined before the shuffle, so a hot host is spread over tasks.  At most 1 / ratio
times a page's mean number of lines can be boilerplate of a host, so the hashes of a host fit one
row.  The tables of one row per host (page totals, flagged hashes) are measured in bytes and
broadcast up to BROADCAST_BYTES, so pages are not moved by host at all; a larger table is
joined by host, where adaptive execution splits a skewed host.  No page is taken apart and put
together again.

Lines of HTML: scripts, styles and comments go, tags of blocks end a line, other tags go, blanks
around a line go, blank lines do not count.  A null or empty page has no lines (kept text
empty); repeated pages count as pages of their own; a line counts once per page.  Empty tables
give empty results; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

RATIO = 0.5
MIN_PAGES = 5
BROADCAST_BYTES = 64 << 20

HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK = (
    r"(?i)</?(?:html|head|body|title|article|section|header|footer|nav|main|aside|div|p|h[1-6]|ul|ol|li|"
    r"table|tr|td|th|br|hr|pre|blockquote|form)\b[^>]*>"
)
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? or #, A-Z lowered; null without it."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    text = F.regexp_replace(html, HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    lines = F.transform(F.split(text, r"[\r\n]+"), lambda s: F.trim(F.regexp_replace(s, r"[ \t]+", " ")))
    return F.coalesce(F.array_remove(lines, ""), F.array().cast("array<string>"))


def _small(per_host: DataFrame) -> DataFrame:
    """A written table of one row per host, marked for broadcast where its bytes allow."""
    size = per_host.agg(F.sum(F.length("host") + 32 + (
        8 * F.size("flagged") if "flagged" in per_host.columns else F.lit(8)
    ))).first()[0] or 0
    return F.broadcast(per_host) if size <= BROADCAST_BYTES else per_host


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, flagged: hashes of its boilerplate lines; for a table of host and lines."""
    known = pages.filter(F.col("host").isNotNull())
    totals = _small(cut_lineage(
        known.groupBy("host").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    ))
    counts = (
        known.select("host", F.explode(F.array_distinct(F.transform("lines", lambda s: F.xxhash64(s)))).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("n"))
    )
    return (
        counts.join(totals, "host").filter(F.col("n") > ratio * F.col("n_pages"))
        .groupBy("host").agg(F.collect_list("line").alias("flagged"))
    )


def drop_boilerplate(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped and kept_text (lines joined by \\n)."""
    if not 0 < ratio <= 1:
        raise ValueError(f"ratio must lie in (0, 1], not {ratio}")
    rows = cut_lineage(pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), html_lines(F.col(html)).alias("lines")
    ))
    flagged = _small(cut_lineage(boilerplate(rows.select("host", "lines"), ratio, min_pages)))
    kept = F.when(
        F.col("flagged").isNull(), F.col("lines")
    ).otherwise(F.filter("lines", lambda s: ~F.array_contains(F.col("flagged"), F.xxhash64(s))))
    return (
        rows.join(flagged, "host", "left").withColumn("kept", kept)
        .select(
            "page_id", "host", F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
            F.array_join("kept", "\n").alias("kept_text"),
        )
    )
