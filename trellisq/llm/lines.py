"""Line dedup by how frequent a line is within its site.  DataFrame operations only.

Of the pages of a host, those that hold a line are counted (once a page); a
line held by more than ``percent`` of the host's pages is boilerplate and goes
from all of them.  Hosts with fewer than ``min_pages`` pages have too little to
compare (by default a single page) and keep everything.

Counts are pre-aggregated by (host, 128-bit hash of the line).  A host has at
most (lines a page) * 100 / percent boilerplate lines on average, so they come
back as one short list a host.  Lists that take few bytes, as measured, are broadcast; else
pages are joined to them by host, which Spark may split where one host has very many
pages.  Pages are never exploded again.  Names that begin with _ln_ are reserved.

Edge cases: a null or unreadable URL belongs to the host ''; a null page has no
lines; lines are trimmed and empty ones are no lines; rows equal in all columns
are one page, which a page stored twice is, so it is not compared with itself
(with ``repeats`` they count as pages of their own, as in the SQL twin); all rows are
returned; no rows give no rows; columns of the input named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, joined_small, stored

COLUMNS = ("host", "lines", "n_lines", "n_removed", "kept_text")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
HIDDEN = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BREAKS = r"</?(?:p|div|li|ul|ol|nav|br|h[1-6]|title|article|header|footer|section|table|tr|td|th|head|body)(?:[ /][^>]*)?>"
TAGS = r"<[^>]*>"
BLANKS = r"[ \t\r]+"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def html_lines(html: Column) -> Column:
    """The trimmed lines of text of a page, broken at block tags and newlines; blanks within a line are one space."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), BREAKS, "\n"), TAGS, "")
    lines = F.transform(F.split(F.regexp_replace(text, BLANKS, " "), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def _print(*of: Column) -> Column:
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit("line"), *of).alias("b"))


def _row_print(df: DataFrame) -> Column:
    """The hash of a whole row: xxhash64 skips nulls, so where they are is hashed too, and takes no maps, so they are written out."""
    columns = [F.col(c).cast("string") if "map<" in kind else F.col(c) for c, kind in df.dtypes]
    return _print(*columns, *(x.isNull() for x in columns))


def without_boilerplate(pages: DataFrame, group: Column, lines: Column, percent: int = 50, min_pages: int = 2, repeats: bool = False) -> DataFrame:
    """pages with host (the group), lines, n_lines, n_removed and kept_text (the lines that stay, joined by newlines).

    repeats: rows equal in all columns are pages of their own.
    """
    read = pages.withColumns({"_ln_host": group, "_ln_lines": lines})
    prints = F.array_distinct(F.transform("_ln_lines", lambda x: _print(x)))
    once = read if repeats else read.select("_ln_host", prints.alias("_ln_prints"), _row_print(pages).alias("_ln_row")).dropDuplicates(["_ln_row"])
    totals = once.groupBy("_ln_host").agg(F.count("*").alias("_ln_pages")).where(F.col("_ln_pages") >= min_pages)
    counts = (
        once.select("_ln_host", F.explode(prints if repeats else F.col("_ln_prints")).alias("line"))
        .groupBy("_ln_host", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") * 100 > min_pages * percent)
    )
    frequent = counts.join(totals, "_ln_host").where(F.col("n") * 100 > F.col("_ln_pages") * percent).groupBy("_ln_host").agg(F.collect_set("line").alias("_ln_bad"))
    both = joined_small(read, stored(frequent), ["_ln_host"], "left")
    kept = F.when(F.col("_ln_bad").isNull(), F.col("_ln_lines")).otherwise(F.filter("_ln_lines", lambda x: ~F.array_contains("_ln_bad", _print(x))))
    out = both.withColumn("_ln_kept", kept)
    names = [c for c in pages.columns if c not in COLUMNS]
    return out.select(
        *names, F.col("_ln_host").alias("host"), F.col("_ln_lines").alias("lines"), F.size("_ln_lines").cast("long").alias("n_lines"),
        (F.size("_ln_lines") - F.size("_ln_kept")).cast("long").alias("n_removed"), F.array_join("_ln_kept", "\n").alias("kept_text"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = without_boilerplate(pages, host_of(F.col("url")), html_lines(F.col("html")), repeats=True)
    return out.select("page_id", "host", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_LINES = f"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
    '{HIDDEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g'), '{BLANKS}', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"""

OP10_SQL = f"""
WITH read AS (
  SELECT row_number() OVER () AS r, page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host, {_LINES} AS lines FROM pages
), totals AS (SELECT host, count(*) AS n FROM read GROUP BY host),
counts AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT r, host, unnest(lines) AS line FROM read) GROUP BY host, line),
bad AS (
  SELECT c.host, list(c.line) AS bad FROM counts c JOIN totals t USING (host) WHERE t.n >= 2 AND c.n * 100 > t.n * 50 GROUP BY c.host
), kept AS (
  SELECT r.*, list_filter(r.lines, lambda x: NOT list_contains(coalesce(b.bad, []), x)) AS kept FROM read r LEFT JOIN bad b USING (host)
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM kept
"""
