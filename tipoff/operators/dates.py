"""Dates written in more than one way: formats chosen by what they can read, and unreadable texts kept aside.

All of it works on one row per game (or any rows with a weight), in one pass
over them; plays are never read again.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tipoff.session import materialize

BAD = ("error", "null", "quarantine")


def _read(text: Column, fmt: str) -> Column:
    return F.try_to_date(text, fmt)


def date_coverage(rows: DataFrame, formats: list[str], column: str = "DateKey", weight: str | None = None) -> DataFrame:
    """Per format: position in the list, rows it reads, rows that only it reads, and rows that another reads as another date.

    A last row with a null format counts the texts that none reads. ``weight``:
    how many rows one stands for.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    read = [_read(F.col(column), f) for f in formats]
    known = F.array(*read)
    # Written, so that every text is read once, not once per count.
    counted = materialize(rows.where(F.col(column).isNotNull()).select(n.cast("long").alias("n"), known.alias("read")))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    readers = F.size(F.array_compact("read"))
    dates = F.size(F.array_distinct(F.array_compact("read")))
    cells = []
    for i, f in enumerate(formats):
        here = F.col("read")[i].isNotNull()
        cells.append(F.struct(
            F.lit(f).alias("format"), F.lit(i).alias("position"), total(here).alias("readable"),
            total(here & (readers == 1)).alias("only"), total(here & (dates > 1)).alias("ambiguous"),
        ))
    none = total(readers == 0)
    cells.append(F.struct(
        F.lit(None).cast("string").alias("format"), F.lit(len(formats)).alias("position"), none.alias("readable"),
        none.alias("only"), F.lit(0).cast("long").alias("ambiguous"),
    ))
    return counted.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def preferred(coverage: DataFrame) -> list[str]:
    """Formats by how much they read, in the order given where that is equal. One row per format is fetched."""
    found = coverage.where(F.col("format").isNotNull()).collect()
    return [r.format for r in sorted(found, key=lambda r: (-r.readable, r.position))]


def read_dates(rows: DataFrame, formats: list[str], column: str = "DateKey", out: str = "Date", *, bad: str = "error") -> DataFrame:
    """``rows`` with the date of ``column`` by the first format that reads it.

    A text that none reads is an error when its row is computed, or ``null``.
    A null text is a null date.
    """
    text = F.col(column)
    date = F.coalesce(*[_read(text, f) for f in formats])
    if bad == "error":
        fail = F.raise_error(F.concat(F.lit("unreadable date "), text)).cast("date")
        date = F.when(text.isNotNull() & date.isNull(), fail).otherwise(date)
    return rows.withColumn(out, date)


@dataclass(frozen=True)
class Dates:
    """How to read the dates of a log: one format or several, and what to do with texts that none reads.

    ``error`` stops at the first one, ``null`` leaves the date empty (days of
    rest are then 0), ``quarantine`` leaves the game out and writes it, with
    its number of plays, to ``aside`` where that is given. Several formats are
    tried in the order of how much they read.
    """

    formats: tuple[str, ...] = ("yyyy-MM-dd",)
    bad: str = "error"
    aside: str | None = None

    def __post_init__(self):
        if self.bad not in BAD:
            raise ValueError(f"unknown treatment of bad dates {self.bad!r}")

    def settled(self, games: DataFrame, weight: str = "Plays") -> "Dates":
        """With its formats in the order they are used for these games; bad ones are written aside now."""
        formats = self.formats
        if len(formats) > 1:
            formats = tuple(preferred(date_coverage(games, list(formats), weight=weight)))
        if self.bad == "quarantine" and self.aside is not None:
            read_dates(games, list(formats), bad="null").where("Date IS NULL").drop("Date").write.parquet(self.aside)
        return Dates(formats, self.bad, None)

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``Date``; without those that are left out."""
        dated = read_dates(rows, list(self.formats), bad="error" if self.bad == "error" else "null")
        return dated.where("Date IS NOT NULL") if self.bad == "quarantine" else dated


def dates_of(date_format) -> Dates:
    """A :class:`Dates` from a format, a list of formats, or itself."""
    if isinstance(date_format, Dates):
        return date_format
    return Dates((date_format,) if isinstance(date_format, str) else tuple(date_format))
