"""Lines that many pages of one site share; DataFrame functions only.

A page is a distinct text of a site: copies of one text count once, so they
do not make their own lines look like boilerplate.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tipoff.limits import Limits
from tipoff.operators.joins import join_dimension
from tipoff.session import materialize, materialize_counted

LIMITS = Limits(broadcast_rows=20_000, match_rows=500_000)
SITE, PAGE, COPIES, DROPPED = "__site", "__page", "__copies", "__dropped"


def with_page(rows: DataFrame, source: Column, text: Column) -> DataFrame:
    """Add the keys of site (null is a site of its own) and page (null text is an empty page)."""
    site = F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))
    return rows.withColumns({SITE: site, PAGE: F.xxhash64(F.coalesce(text, F.lit("")))})


def mark_shared(
    rows: DataFrame, hashes: Column, over: Callable[[Column, Column], Column], spread: str, limits: Limits = LIMITS
) -> DataFrame:
    """``rows`` with ``__dropped``: hashes of lines that are too frequent on the row's site (null for none).

    ``rows`` comes from :func:`with_page`; ``hashes`` is the array of its
    distinct line hashes; ``over(n, pages)`` says whether a line on n of a
    site's pages is too frequent. What is shuffled to count is one row per
    distinct line of a page. Frequent lines that are counted to be few are
    broadcast, a list per site; otherwise they are joined to the lines of each
    page, and what is found to the rows. Lines on very many pages and pages
    with very many copies are spread over tasks there, by ``spread``.
    """
    keyed = rows.select(SITE, PAGE, hashes.alias("__hashes"))
    lines = materialize(keyed.select(SITE, PAGE, F.explode("__hashes").alias("h")).distinct())
    sites = rows.select(SITE, PAGE).distinct().groupBy(SITE).agg(F.count("*").alias("pages"))
    # A line on a single page is never frequent; leaving it out keeps the join small.
    counts = lines.groupBy(SITE, "h").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    frequent, found = materialize_counted(
        join_dimension(counts, sites.withColumn("__rows", F.col("pages")), [SITE], rows="__rows", spread="h", limits=limits)
        .where(over(F.col("n"), F.col("pages"))).select(SITE, "h", "n")
    )
    if found <= limits.broadcast_rows:
        lists = frequent.groupBy(SITE).agg(F.collect_list("h").alias(DROPPED))
        return rows.join(F.broadcast(lists), SITE, "left")
    here = join_dimension(lines, frequent, [SITE, "h"], rows="n", spread=PAGE, limits=limits)
    copies = rows.groupBy(SITE, PAGE).agg(F.count("*").alias(COPIES))
    dropped = here.groupBy(SITE, PAGE).agg(F.collect_set("h").alias(DROPPED)).join(copies, [SITE, PAGE])
    return join_dimension(rows, dropped, [SITE, PAGE], rows=COPIES, spread=spread, how="left", limits=limits)
