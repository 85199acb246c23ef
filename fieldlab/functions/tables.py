"""Table functions for SQL: one row to many.

`expand_folds(TABLE(rows), place => 'column', total => n, train => .., check => .., test => .., step => .., expanding => ..)`
gives each row once for every fold it is in, with all its columns, fold and part. `expand_values(TABLE(rows), columns =>
'a,b')` gives each row once for every named column, as name and value, without them. Both take what columns the table has;
PARTITION BY and ORDER BY of the table are the caller's. A place or value that is null gives no fold, and a null value."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class ExpandFolds:
    @staticmethod
    def analyze(rows: AnalyzeArgument, place: AnalyzeArgument, total: AnalyzeArgument, train: AnalyzeArgument, check: AnalyzeArgument, test: AnalyzeArgument, step: AnalyzeArgument, expanding: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not place.isConstantExpression or place.value not in rows.dataType.fieldNames():
            raise ValueError("expand_folds needs a table and the name of its column of places")
        return AnalyzeResult(StructType([*rows.dataType.fields]).add("fold", IntegerType()).add("part", StringType()))

    def eval(self, rows: Row, place: str, total: int, train: int, check: int, test: int, step: int, expanding: bool):
        at, count = rows[place], max(0, (total - train - check - test) // step + 1)
        if at is None:
            return
        first = max(0, -(-(at + 1 - train - check - test) // step))
        last = count - 1 if expanding else min(count - 1, at // step)
        for k in range(first, last + 1):
            end = train + k * step
            yield (*rows, k, "train" if at < end else "validation" if at < end + check else "test")


@udtf
class ExpandValues:
    @staticmethod
    def analyze(rows: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        names = (columns.value or "").split(",")
        if not rows.isTable or not set(names) <= set(rows.dataType.fieldNames()):
            raise ValueError("expand_values needs a table and names of its columns")
        return AnalyzeResult(StructType([f for f in rows.dataType.fields if f.name not in names]).add("name", StringType()).add("value", DoubleType()))

    def eval(self, rows: Row, columns: str):
        names = columns.split(",")
        kept = [v for k, v in rows.asDict().items() if k not in names]
        for name in names:
            yield (*kept, name, None if rows[name] is None else float(rows[name]))


def register(spark: SparkSession) -> None:
    spark.udtf.register("expand_folds", ExpandFolds)
    spark.udtf.register("expand_values", ExpandValues)
