"""Small helpers that the operators of this package share."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: a word is a run of anything but these six white-space characters
SPACE = r"[\x20\x09-\x0D]+"
HELD_OUT_FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % HELD_OUT_FOLDS == 0


class Positions:
    """A table under plain names c0, c1, …, whatever its own are: reserved, dotted, or alike but for their case.

    Internal columns then clash with none; :meth:`restored` gives the names back.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.own = [f"c{i}" for i in range(len(self.names))]
        self.frame = docs.toDF(*self.own)

    def __getitem__(self, name: str) -> Column:
        return F.col(self.own[self.names.index(name)])

    def restored(self, rows: DataFrame, **replaced: Column) -> DataFrame:
        """The original columns of ``rows`` (some replaced by a column of it), under their own names."""
        places = {self.own[self.names.index(name)]: value for name, value in replaced.items()}
        return rows.select(*[places.get(c, F.col(c)).alias(c) for c in self.own]).toDF(*self.names)
