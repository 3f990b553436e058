"""Rules on a document's own words and on lines it shares with its site; DataFrame functions only."""

from pyspark.sql import Column, DataFrame, functions as F

from tipoff.limits import Limits
from tipoff.llm.common import SPACE, let, words
from tipoff.llm.site_lines import DROPPED, LIMITS, PAGE, SITE, mark_shared, with_page
from tipoff.session import materialize

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MIN_PAGES = 5
MAX_SHARE = 0.02
MIN_LEFT_PERCENT = 30
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0000000000"


def _lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != "")


def _normal(line: Column) -> Column:
    """A line with A-Z lower, digits as zeros and single spaces."""
    return F.btrim(F.regexp_replace(F.translate(line, UPPER, LOWER), SPACE, " "))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more; neighbours in sorted order tell."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(ordered):
        again = F.filter(
            ordered,
            lambda w, j: F.coalesce(w["h"] == F.get(ordered, j - 1)["h"], F.lit(False))
            | F.coalesce(w["h"] == F.get(ordered, j + 1)["h"], F.lit(False)),
        )
        return F.array_sort(F.transform(again, lambda w: w["i"]))

    def total(at):
        gains = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gains, F.lit(0), lambda a, b: a + b)

    return let(let(placed, places), total)


def repeated_words(found: Column) -> Column:
    """Words of the array ``found`` in 5-word windows that occur twice or more in it."""

    def windows(hashes):
        one = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), one)

    def count(hashes):
        unique = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))
        return F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(let(windows(hashes), unique))

    return let(F.transform(found, lambda w: F.xxhash64(w)), count)


def quality_rules(
    docs: DataFrame, *, min_pages: int = MIN_PAGES, max_share: float = MAX_SHARE, min_left_percent: int = MIN_LEFT_PERCENT,
    id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", limits: Limits = LIMITS,
) -> DataFrame:
    """Counts and a verdict for every row; texts are only read.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are the
    text's own. base_failed: fewer than 10 words, or more than 20 % of them in
    repeated windows. Then lines, normalised and hashed, are counted over the
    distinct pages of a site (null is a site of its own); one on at least
    ``min_pages`` of them and on more than ``max_share`` of all is taken out.
    n_left is the number of words that remain. A document with fewer than 10,
    or fewer than ``min_left_percent`` of its words, is depleted; kept is false
    for it. Null texts have no words and fail. Repeated rows give repeated
    results; other columns are ignored. Texts are read once: what is written
    and shuffled has a hash and a word count per line.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_page(docs.select(F.col(id_col).alias("id"), text.alias("text"), F.col(site_col).alias("site")), F.col("site"), F.col("text"))
    text = F.col("text")
    line = lambda value: F.struct(
        F.xxhash64(value).alias("h"),
        (F.length(value) - F.length(F.translate(value, " ", "")) + 1).alias("w"),
    )
    measured = rows.select(
        "id", SITE, PAGE,
        let(words(text), lambda found: F.struct(F.size(found).cast("long").alias("n_words"), repeated_words(found).cast("long").alias("n_repeat_words"))).alias("of_words"),
        F.length(F.translate(text, BLANK, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(_lines(text), lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        F.transform(_lines(text), lambda value: let(_normal(value), line)).alias("lines"),
    )
    measured = materialize(measured)
    over = lambda n, pages: (n >= min_pages) & (n > max_share * pages)
    hashes = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    joined = mark_shared(measured.withColumn("__row", F.xxhash64("id")), hashes, over, "__row", limits)
    n_words, n_repeat = F.col("of_words.n_words"), F.col("of_words.n_repeat_words")
    gone = F.aggregate(
        F.filter("lines", lambda x: F.array_contains(DROPPED, x["h"])), F.lit(0), lambda total, x: total + x["w"]
    )
    left = n_words - F.when(F.col(DROPPED).isNull(), 0).otherwise(gone)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    depleted = (left < MIN_WORDS) | (100 * left < min_left_percent * n_words)
    return joined.select(
        F.col("id").alias(id_col), n_words.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        n_repeat.alias("n_repeat_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        left.cast("long").alias("n_left"),
    )


ORACLE = rf"""
WITH rows AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS page FROM documents
), worded AS (
    SELECT *, list_filter(regexp_split_to_array(page, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM rows
), windows AS (
    SELECT r, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS w
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM worded)
), repeated AS (
    SELECT r, count(DISTINCT place) AS n FROM (
        SELECT r, unnest(range(i, i + 5)) AS place
        FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS times FROM windows) WHERE times > 1
    ) GROUP BY r
), lines AS (
    SELECT r, source, page, line,
           trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
    FROM (SELECT r, source, page, unnest(string_split(page, chr(10))) AS line FROM rows)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), sites AS (
    SELECT source, count(DISTINCT page) AS pages FROM rows GROUP BY source
), frequent AS (
    SELECT l.source, norm FROM lines l JOIN sites s ON l.source IS NOT DISTINCT FROM s.source
    GROUP BY l.source, norm, pages
    HAVING count(DISTINCT page) >= {MIN_PAGES} AND count(DISTINCT page) > {MAX_SHARE} * pages
), by_line AS (
    SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines,
           coalesce(sum(len(string_split(l.norm, ' '))) FILTER (f.norm IS NOT NULL), 0) AS gone
    FROM lines l LEFT JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY r
), measured AS (
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(array_to_string(ws, '')) AS word_chars,
           length(page) - length(translate(page, '{SYMBOLS}', '')) AS n_symbols,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
           CAST(len(ws) - coalesce(gone, 0) AS BIGINT) AS n_left
    FROM worded w LEFT JOIN by_line b ON w.r = b.r LEFT JOIN repeated p ON w.r = p.r
), judged AS (
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_left >= {MIN_WORDS} AND 100 * n_left >= {MIN_LEFT_PERCENT} * n_words AS kept, n_left
FROM judged
"""
