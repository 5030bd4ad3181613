"""Functions for SQL, registered in a session: an aggregate, and table functions of a value and of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class GreedyGroups:
    """packed(TABLE(t), most): rows (section, place, size) of t in groups, section by section in the order of places; a
    group ends before the row that would make it larger than most. (section, group, first, last, rows, size), groups from 1.

    The function itself asks for its table's partitions and order. A section is read row by row, and nothing of it is
    held but the group's sums. Null sizes count as zero; null sections are one.
    """

    def __init__(self) -> None:
        self.held: list | None = None  # section, group, first, last, rows, size

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("packed() takes a table first")
        if not most.isConstantExpression or not isinstance(most.value, int) or most.value < 1:
            raise ValueError("packed() takes a positive number second")
        fields = {f.name: f for f in rows.dataType.fields}
        missing = {"section", "place", "size"} - set(fields)
        if missing:
            raise ValueError(f"packed() misses {', '.join(sorted(missing))}")
        place = fields["place"].dataType
        schema = StructType([StructField("section", fields["section"].dataType), StructField("group", LongType()), StructField("first", place), StructField("last", place), StructField("rows", LongType()), StructField("size", LongType())])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("section")], orderBy=[OrderingColumn("place"), OrderingColumn("size")])

    def eval(self, row: Row, most: int) -> Iterator[tuple]:
        size = row["size"] or 0
        h = self.held
        if h is not None and (h[5] + size <= most or h[5] == 0):
            h[3], h[4], h[5] = row["place"], h[4] + 1, h[5] + size
            return
        if h is not None:
            yield tuple(h)
        self.held = [row["section"], 1 if h is None else h[1] + 1, row["place"], row["place"], 1, size]

    def terminate(self) -> Iterator[tuple]:
        if self.held is not None:
            yield tuple(self.held)


def register(spark: SparkSession) -> None:
    """harmonic_mean(x): aggregate over Arrow batches of a group; letters_of(text): a row (place, letter) for each character;
    packed(TABLE(t), most): see GreedyGroups."""

    @F.pandas_udf("double")
    def harmonic_mean(x: pd.Series) -> float:
        x = x[x > 0]
        return float(len(x) / (1 / x).sum()) if len(x) else 0.0

    @F.udtf(returnType="place int, letter string")
    class LettersOf:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            yield from enumerate(text or "")

    spark.udf.register("harmonic_mean", harmonic_mean)
    spark.udtf.register("letters_of", LettersOf)
    spark.udtf.register("packed", F.udtf(GreedyGroups))
