"""Line dedup by site-relative frequency.

Per host, the pages that hold a line are divided by all pages of the host; a
line above ``ratio`` (and on at least ``min_pages`` pages) is boilerplate and
every copy of it is dropped from that host's pages. Blank lines are kept.

Copies count as pages of their own: where copies of one page are more than
``ratio`` of a host's pages (and ``min_pages`` at least), each of its lines is
boilerplate by this rule, and all the copies keep blank lines only.

Scale: lines are counted as 8-byte hashes, once per page, with partial
aggregation (a hot host is split over its lines). A host has at most
``mean lines per page / ratio`` boilerplate lines, so its set is a small array;
pages look their host's set up in place and are never exploded again.

Cases: a null text has no lines and stays null; a null host is the site "";
an empty table gives an empty result; repeated rows are pages of their own;
texts may be of any length; added columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BROADCAST_LINES = 2_000_000       # hashes of 8 bytes: at most 16 MB are broadcast


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """One row per host with boilerplate: ``host``, ``lines`` (array of hashes)."""
    named = pages.select(F.coalesce(host, F.lit("")).alias("host"), text.alias("text"))
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    counts = (named.select("host", F.explode(lines).alias("line"))
              .groupBy("host", F.xxhash64("line").alias("line")).agg(F.count("*").alias("n"))
              .where(F.col("n") >= min_pages))
    totals = named.groupBy("host").agg(F.count("*").alias("total"))
    return (counts.join(totals, "host").where(F.col("n") / F.col("total") > ratio)
            .groupBy("host").agg(F.collect_set("line").alias("lines")))


def line_dedup(pages: DataFrame, *, host: str | Column = "source", text_col: str = "text",
               ratio: float = 0.1, min_pages: int = 4) -> DataFrame:
    """``pages`` with ``text_col`` cleaned, plus ``n_lines`` and ``n_dropped``."""
    host = F.col(host) if isinstance(host, str) else host
    sets = written(boilerplate(pages, host, F.col(text_col), ratio, min_pages), "boilerplate")
    total = sets.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    sets = sets.select(F.col("host").alias("__host"), F.col("lines").alias("__drop"))
    keep = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    keyed = pages.select(*keep, F.coalesce(host, F.lit("")).alias("__host"))
    joined = keyed.join(F.broadcast(sets) if total <= BROADCAST_LINES else sets, "__host", "left")
    joined = joined.withColumn("__lines", F.split(text_col, "\n"))
    kept = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(
        F.filter("__lines", lambda x: (F.trim(x) == "") | ~F.array_contains("__drop", F.xxhash64(x))))
    joined = joined.withColumn("__kept", kept)
    size = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    return joined.select(
        *[F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(c) for c in keep],
        size("__lines").alias("n_lines"), (size("__lines") - size("__kept")).alias("n_dropped"))


def line_dedup_sql(ratio: float = 0.1, min_pages: int = 4) -> str:
    """The digest query over ``documents`` in DuckDB."""
    return f"""
WITH pages AS (SELECT doc_id, coalesce(source, '') AS host, string_split(text, chr(10)) AS lines FROM documents),
 seen AS (SELECT host, unnest(list_distinct(lines)) AS line FROM pages),
 counts AS (SELECT host, line, count(*) AS n FROM seen WHERE trim(line) <> '' GROUP BY host, line HAVING count(*) >= {min_pages}),
 totals AS (SELECT host, count(*) AS total FROM pages GROUP BY host),
 sets AS (SELECT host, list(line) AS drops FROM counts JOIN totals USING (host)
          WHERE CAST(n AS DOUBLE) / total > {ratio} GROUP BY host),
 kept AS (SELECT doc_id, lines, CASE WHEN drops IS NULL THEN lines
                 ELSE [x FOR x IN lines IF NOT list_contains(drops, x)] END AS kept
          FROM pages LEFT JOIN sets USING (host))
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
 CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
 sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM kept"""
