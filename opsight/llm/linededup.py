"""Line dedup by site-relative frequency.

Pages are grouped by host; a line's frequency on a host is the number of that host's pages that contain it over all pages of
the host. Lines over the boilerplate ratio are dropped from every page of that host, and stay on hosts where they are rare.
Lines are compared trimmed, by the MD5 of the trimmed text; blank lines are never boilerplate.

Counts are pre-aggregated: a page gives each of its distinct lines once, partial counts are made before the shuffle,
so a very common line or host is a few rows by then. Page totals are a count by host, joined
to the line counts after they are aggregated.

Edge cases: null hosts are a host of their own; a null text stays null and counts as a page of its host; a page whose lines all
go keeps an empty text; repeated rows are pages of their own; tables may be empty; other columns stay, and an
input column named like an output column is replaced. Lines are separated by \\n alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialise

RATIO, MIN_PAGES = 0.05, 2  # one page can't show that a line repeats; beyond that the ratio decides


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def n_words(line: Column) -> Column:
    return F.size(F.split(F.trim(line), r"\s+"))


def boilerplate(df: DataFrame, host_col: str, text_col: str, ratio: float | dict[int, float] = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_key, pages, host_pages) of the lines on more than `ratio` of a host's pages and on min_pages at least.

    A dict gives the ratio of lines of so many words and more; lines with fewer words than any key stay.
    """
    pages = df.select(F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{text_col}`").cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    lines = F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != "")
    by, limit = ["host", "line_key"], F.lit(ratio)
    if isinstance(ratio, dict):
        by, limit = [*by, "ratio"], F.col("ratio")
        steps = sorted(ratio.items(), reverse=True)
        own = lambda x: F.coalesce(*[F.when(n_words(x) >= n, F.lit(float(r))) for n, r in steps])
        keys = F.transform(lines, lambda x: F.struct(line_key(x).alias("line_key"), own(x).alias("ratio")))
        dealt = pages.select("host", F.explode(F.array_distinct(keys)).alias("key")).select("host", "key.*").where("ratio is not null")
    else:
        dealt = pages.select("host", F.explode(F.array_distinct(F.transform(lines, line_key))).alias("line_key"))
    counts = dealt.groupBy(*by).agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return (counts.join(totals, counts["host"].eqNullSafe(totals["host"])).drop(totals["host"])
            .where(F.col("pages") > F.col("host_pages") * limit).drop("ratio"))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float | dict[int, float] = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """df with its boilerplate lines removed from text_col, and n_lines and dropped_lines (counts of lines)."""
    cols = [c for c in df.columns if c not in ("n_lines", "dropped_lines")]
    common = materialise(boilerplate(df, host_col, text_col, ratio, min_pages).select("host", "line_key"), "boilerplate")
    # A line on more than `ratio` of the pages is one of at most 1/ratio times the lines of an average page: a short list by host.
    drop_, host_, kept_ = free_names(cols, "drop", "host", "kept")
    lists = common.groupBy("host").agg(F.collect_set("line_key").alias(drop_)).withColumnRenamed("host", host_)
    host, text = F.col(f"`{host_col}`").cast("string"), F.col(f"`{text_col}`")
    met = df.select(*[F.col(f"`{c}`") for c in cols]).join(lists, host.eqNullSafe(F.col(host_)), "left")
    lines = lines_of(text.cast("string"))
    kept = F.when(F.col(drop_).isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(drop_), line_key(x))))
    met = met.withColumn(kept_, kept)
    gone = F.coalesce(F.size(lines) - F.size(kept_), F.lit(0))
    new_text = F.when(text.isNull() | (gone == 0), text).otherwise(F.array_join(kept_, "\n"))
    return met.select(*[(new_text if c == text_col else F.col(f"`{c}`")).alias(c) for c in cols],
                      F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.when(text.isNull(), 0).otherwise(gone).alias("dropped_lines"))


def page_lines(html: Column) -> Column:
    """The text of a page, a line for each block: scripts, styles and comments go, block tags end a line, other tags vanish."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"[\r\n]+", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|article|section|header|footer|title|head|body|html|table|tr|td|th|main|aside|blockquote|pre)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; null if it has none."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(rest != "", F.lower(rest))
