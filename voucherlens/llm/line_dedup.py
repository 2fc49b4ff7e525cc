r"""Line dedup by site-relative frequency, in DataFrame functions only.

A line that many pages of one host carry is boilerplate there: navigation, licence, footer. Per
host and line the pages that contain the line are counted (a page counts once, however often it
repeats the line), divided by the pages of the host, and lines above ``max_ratio`` are dropped
from every page of that host, all their occurrences. Other lines keep their order and text.

Scale: the pages' distinct lines are counted per (host, line) with a combine before the shuffle,
so a host with a third of all pages, or a line on all of them, is a counter per map task. What
joins back is only the dropped lines, one array per host: on a host, fewer than
(mean lines a page) / max_ratio lines can be above the ratio. That table is staged, so Spark
knows its size and broadcasts it when small; else the join is one that AQE can split.

Copies. By default every row is a page, as ``OP3_SQL`` has it. Then a text with copies on more
than ``max_ratio`` of a host's pages counts as boilerplate line by line, and nothing of it is left
on any of them. With ``spare_copies``, as the pipeline calls it, copies of one text are one page,
in the counts of lines and of pages alike. Near copies differ in their texts, so in addition no
text goes for good: of the pages of a host that would lose more than half of their characters by
the same set of lines, the one with the least hash stays whole, with its copies. Pages with the
same menu lose it but for that one; near copies that differ within a line lose different sets and
all stay, for near-dedup to find. The texts cross the network once more, combined by hash first.

Edge cases: a null host is a host of its own; a null text stays null and has no lines; lines
without anything but spaces are never counted or dropped; a line counts only on at least
``min_pages`` pages, so that hosts with a few pages lose nothing; a ratio equal to the limit
keeps the line; repeated rows are pages of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import table
from voucherlens.staging import Stage

MAX_RATIO = 0.05
MIN_PAGES = 5


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def page_hash(text: Column) -> Column:
    return F.struct(F.xxhash64(text), F.crc32(text.cast("binary")))


def boilerplate_lines(pages: DataFrame, stage: Stage, max_ratio: float = MAX_RATIO,
                      min_pages: int = MIN_PAGES, spare_copies: bool = False) -> DataFrame:
    """``_site`` and the array of its lines above the ratio, from ``_site`` and ``_text``."""
    if spare_copies:
        pages = pages.withColumn("_page", page_hash(F.col("_text"))).dropDuplicates(["_site", "_page"])
    lines = pages.select("_site", F.explode(F.array_distinct(lines_of(F.col("_text")))).alias("_line"))
    counts = (lines.where(F.trim("_line") != "")
              .groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("_pages"))
              .where(F.col("_pages") >= min_pages))
    totals = (pages.groupBy("_site").agg(F.count(F.lit(1)).alias("_total"))
              .withColumnRenamed("_site", "_of"))
    common = (stage(counts, "line_counts")
              .join(stage(totals, "site_totals"), F.col("_site").eqNullSafe(F.col("_of")))
              .where(F.col("_pages") / F.col("_total") > F.lit(max_ratio)))
    return stage(common.groupBy("_site").agg(F.collect_set("_line").alias("_drop"))
                 .withColumnRenamed("_site", "_of"), "boilerplate")


def spared_pages(pages: DataFrame, stage: Stage) -> DataFrame:
    """Per set of lines that makes up most of a page, the hash of the page that keeps them.

    ``pages``: ``_site``, ``_text``, ``_lines`` and ``_kept``.
    """
    return stage(pages.where(_loses_most()).groupBy(_loss().alias("_of_loss"))
                 .agg(F.min(page_hash(F.col("_text"))).alias("_whole")), "spared_pages")


def _characters(lines: Column) -> Column:
    return F.length(F.regexp_replace(F.array_join(lines, ""), " ", ""))


def _loses_most() -> Column:
    return (F.size("_kept") < F.size("_lines")) & (
        2 * _characters(F.col("_kept")) < _characters(F.col("_lines")))


def _loss() -> Column:
    """The host and the set of lines a page loses, as a hash; null if these are not most of it."""
    lost = F.array_sort(F.array_except("_lines", "_kept"))
    return F.when(_loses_most(), F.struct(F.xxhash64("_site", lost), F.crc32(
        F.array_join(lost, "\n").cast("binary"))))


def site_line_dedup(docs: DataFrame, site_col: str = "source", text_col: str = "text",
                    max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                    stage: Stage | None = None, spare_copies: bool = False,
                    counts: tuple[str, str] | None = ("_n_lines", "_n_dropped")) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col``.

    All columns come back as they were, but for the text, whatever their names; the lines before
    and the lines dropped are added under the names ``counts``, which must be new, or left out if
    that is None. With ``spare_copies`` a text that is there many times is not boilerplate for
    that.
    """
    stage = stage or Stage(docs.sparkSession)
    if counts and set(counts) & set(docs.columns):
        raise ValueError(f"{', '.join(counts)}: choose other names for the counts, or None")
    site = F.col(f"`{site_col}`").cast("string").alias("_site")
    text = F.col(f"`{text_col}`").alias("_text")
    pages = docs.select(site, text)
    drop = boilerplate_lines(pages, stage, max_ratio, min_pages, spare_copies)
    lines = lines_of(F.col("_text"))
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains("_drop", x)))

    def split(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.join(drop, F.col("_site").eqNullSafe(F.col("_of")), "left").select(
            *columns, lines.alias("_lines"), kept.alias("_kept"))

    # The row travels as one struct, so that its columns cannot clash with those made here.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        site, text)
    done = split(whole, "_row", "_site", "_text")
    if spare_copies:
        spared = spared_pages(split(pages, "_site", "_text"), stage)
        stays = F.col("_whole") == page_hash(F.col("_text"))
        # Rows that lose little meet nothing; hashes of their own spread them in the join.
        own = F.xxhash64(*[F.col(f"_row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
        spread = F.struct(own, F.lit(-1).cast("bigint"))
        done = (done.withColumn("_loss", F.coalesce(_loss(), spread))
                .join(spared, F.col("_loss") == F.col("_of_loss"), "left")
                .select("_row", "_lines", F.when(stays, F.col("_lines")).otherwise(
                    F.col("_kept")).alias("_kept")))
    n_lines, n_kept = (F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
                       for c in ("_lines", "_kept"))
    out = [F.array_join("_kept", "\n").alias(c) if c == text_col else F.col(f"_row.`{c}`")
           for c in docs.columns]
    if counts:
        out += [n.cast("long").alias(c) for n, c in zip((n_lines, n_lines - n_kept), counts)]
    return done.select(*out)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the lines dropped that are boilerplate of its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return (site_line_dedup(docs)
            .select("doc_id", "source", F.col("_n_lines").alias("n_lines"),
                    F.col("_n_dropped").alias("n_dropped"), "text"))


OP3_SQL = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
seen AS (SELECT source, unnest(list_distinct(lines)) AS line FROM pages),
counts AS (SELECT source, line, count(*) AS n FROM seen WHERE trim(line) <> '' GROUP BY ALL
           HAVING count(*) >= {MIN_PAGES}),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
dropped AS (SELECT c.source, list(c.line) AS drop FROM counts c
            JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
            WHERE c.n / t.total > {MAX_RATIO}::DOUBLE GROUP BY c.source),
done AS (SELECT p.doc_id, p.source, p.text, p.lines,
                list_filter(p.lines, lambda x: NOT list_contains(coalesce(d.drop, []), x)) AS kept
         FROM pages p LEFT JOIN dropped d ON p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines,
       (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text
FROM done
"""
