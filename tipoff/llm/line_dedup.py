"""Removing a site's boilerplate lines; DataFrame functions only."""

from pyspark.sql import Column, DataFrame, functions as F

from tipoff.limits import Limits
from tipoff.llm.common import Positions
from tipoff.llm.site_lines import DROPPED, LIMITS, mark_shared, with_page

MAX_RATIO = 0.01
MIN_PAGES = 5
BLANK = " \t\n\x0b\x0c\r"
TEXT, ROW = "__text", "__row"


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANK)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) != ""


def drop_boilerplate(
    docs: DataFrame, *, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, site_col: str = "source",
    text_col: str = "text", id_col: str = "doc_id", counts: tuple[str, str] | None = None, limits: Limits = LIMITS,
) -> DataFrame:
    """``docs`` with lines removed that stand on too many pages of their site.

    A line (compared without white space at its ends) is dropped where at least
    ``min_pages`` of the site's distinct pages have it and they are more than
    ``max_ratio`` of all its pages. Blank lines stay. All rows and columns stay,
    repeated rows too; null texts stay null, and a text may become empty. Null
    is a site of its own. ``counts`` names two columns to add: lines that are
    not blank, and those dropped.
    """
    own = Positions(docs)
    source = own[text_col]
    rows = with_page(own.frame.withColumn(TEXT, source), own[site_col], source)
    distinct = F.array_distinct(F.transform(F.filter(_lines(F.col(TEXT)), _filled), _hash))
    over = lambda n, pages: (n >= min_pages) & (n > max_ratio * pages)
    joined = mark_shared(rows.withColumn(ROW, F.xxhash64(own[id_col])), distinct, over, ROW, limits)
    gone = lambda line: _filled(line) & F.array_contains(DROPPED, _hash(line))
    kept = F.array_join(F.filter(_lines(F.col(TEXT)), lambda line: ~gone(line)), "\n")
    text = F.when(F.col(DROPPED).isNull() | F.col(TEXT).isNull(), F.col(TEXT)).otherwise(kept)
    out = [text.alias(c) if name == text_col else F.col(c) for name, c in zip(own.names, own.own)]
    if not counts:
        return joined.select(*out).toDF(*own.names)
    n_dropped = F.when(F.col(DROPPED).isNull(), 0).otherwise(F.size(F.filter(_lines(F.col(TEXT)), gone)))
    out += [F.size(F.filter(_lines(F.col(TEXT)), _filled)).cast("long"), n_dropped.cast("long")]
    return joined.select(*out).toDF(*own.names, *counts)


ORACLE = rf"""
WITH rows AS (
    SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(text, '') AS page FROM documents
), lines AS (
    SELECT r, source, page, unnest(string_split(page, chr(10))) AS line,
           generate_subscripts(string_split(page, chr(10)), 1) AS i FROM rows
), cleaned AS (
    SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS norm FROM lines
), sites AS (
    SELECT source, count(DISTINCT page) AS pages FROM rows GROUP BY source
), frequent AS (
    SELECT c.source, norm FROM cleaned c JOIN sites s ON c.source IS NOT DISTINCT FROM s.source
    WHERE norm <> '' GROUP BY c.source, norm, pages
    HAVING count(DISTINCT page) >= {MIN_PAGES} AND count(DISTINCT page) > {MAX_RATIO} * pages
), marked AS (
    SELECT c.*, f.norm IS NOT NULL AS gone
    FROM cleaned c LEFT JOIN frequent f ON c.source IS NOT DISTINCT FROM f.source AND c.norm = f.norm
), folded AS (
    SELECT r, count(*) FILTER (norm <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
    FROM marked GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, CASE WHEN text IS NOT NULL THEN md5(kept) END AS kept_md5
FROM rows JOIN folded USING (r)
"""
