"""Preparation of feature rows as one fitted artifact: missing values, categories, scaling, and the vector of a row.

`Preparer` is a pyspark.ml Estimator, `Prepared` its Model; both are written and read with their folders. All statistics are
of the rows that fit is given (the train rows) and reach the driver as a few numbers for each feature.

A missing number (null or NaN) becomes zero, a constant, the mean or the median of the known ones (0 without any), or stays
missing (`preserve`: NaN in the vector). A category is a number by falling count, then by name (`index`), a column for each
(`one_hot`), or a bucket of its hash (`hash`); one that fit has not seen, or null, is -1 or no column (`zero`), or an
error (`error`). Rows may repeat; a table without rows fits to zeros and gives no rows.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.operators.ranks import medians, value_at, value_places

IMPUTE, SCALE, ENCODE, UNKNOWN = ("zero", "constant", "mean", "median", "preserve"), ("standard", "robust", "min_max", "none"), ("index", "one_hot", "hash"), ("zero", "error")


class _Settings(Params):
    numbers = Param(Params._dummy(), "numbers", "numeric columns", TypeConverters.toListString)
    categories = Param(Params._dummy(), "categories", "category columns", TypeConverters.toListString)
    impute = Param(Params._dummy(), "impute", f"one of {IMPUTE}", TypeConverters.toString)
    constant = Param(Params._dummy(), "constant", "value for impute=constant", TypeConverters.toFloat)
    scale = Param(Params._dummy(), "scale", f"one of {SCALE}", TypeConverters.toString)
    encode = Param(Params._dummy(), "encode", f"one of {ENCODE}", TypeConverters.toString)
    unknown = Param(Params._dummy(), "unknown", f"one of {UNKNOWN}", TypeConverters.toString)
    buckets = Param(Params._dummy(), "buckets", "buckets for encode=hash", TypeConverters.toInt)
    most = Param(Params._dummy(), "most", "categories of a column that may reach the driver; more are an error", TypeConverters.toInt)
    output = Param(Params._dummy(), "output", "name of the vector", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(numbers=[], categories=[], impute="mean", constant=0.0, scale="standard", encode="index", unknown="zero", buckets=64, most=10_000, output="features")

    def value(self, name: str):
        return self.getOrDefault(name)

    def settings(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in self.params}


class _Writer(MLWriter):
    def __init__(self, instance) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        held = {"settings": self.instance.settings(), "fitted": getattr(self.instance, "fitted", None)}
        self.sparkSession.createDataFrame([(json.dumps(held),)], "held string").coalesce(1).write.mode("overwrite" if self.shouldOverwrite else "error").text(path)


class _Reader(MLReader):
    def __init__(self, kind) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        held = json.loads(SparkSession.active().read.text(path).first()[0])
        out = self.kind(**({} if held["fitted"] is None else {"fitted": held["fitted"]}))
        return out._set(**held["settings"])


class _Kept(MLWritable, MLReadable):
    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)


def _number(name: str) -> Column:
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


class Preparer(Estimator, _Settings, _Kept):
    """fit(train rows) gives the Prepared."""

    @keyword_only
    def __init__(self, *, numbers=None, categories=None, impute=None, constant=None, scale=None, encode=None, unknown=None, buckets=None, most=None, output=None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        for name, allowed in (("impute", IMPUTE), ("scale", SCALE), ("encode", ENCODE), ("unknown", UNKNOWN)):
            if self.value(name) not in allowed:
                raise ValueError(f"{name} is one of {allowed}")

    def _fit(self, dataset: DataFrame) -> Prepared:
        names, how = self.value("numbers"), self.value("impute")
        fill = {n: self.value("constant") if how == "constant" else 0.0 for n in names}
        if how in ("mean", "median") and names:
            fill |= self._middle(dataset, names, how)
        filled = dataset.select(*[(_number(n) if how == "preserve" else F.coalesce(_number(n), F.lit(fill[n]))).alias(n) for n in names])
        center, scale = self._spread(filled, names) if names and self.value("scale") != "none" else (dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0))
        seen = {} if self.value("encode") == "hash" else {c: self._seen(dataset, c) for c in self.value("categories")}
        out = Prepared(fitted={"fill": fill, "center": center, "scale": scale, "seen": seen})
        return out._set(**self.settings())

    def _middle(self, rows: DataFrame, names: list[str], how: str) -> dict[str, float]:
        if how == "mean":
            found = rows.agg(*[F.avg(_number(n)).alias(n) for n in names]).first().asDict()
        else:
            long = rows.select(*[_number(n).alias(n) for n in names]).unpivot([], names, "feature", "value")
            found = {r.feature: r.x for r in medians(long, ["feature"], "value", "x").collect()}
        return {n: found.get(n) or 0.0 for n in names}

    def _spread(self, rows: DataFrame, names: list[str]) -> tuple[dict[str, float], dict[str, float]]:
        """Center and scale; a scale of 1e-12 and less is 1. Quartiles are values at whole places."""
        how = self.value("scale")
        if how == "robust":
            last = F.col("total") - 1
            at = lambda place: value_at("value", place)
            middle, wide = (at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2, at(F.floor(last * 0.75)) - at(F.floor(last * 0.25))
            long = value_places(rows.unpivot([], names, "feature", "value"), ["feature"], "value").groupBy("feature")
            found = {r.feature: (r.c, r.s) for r in long.agg(middle.alias("c"), wide.alias("s")).collect()}
        else:
            c, s = (F.avg, F.stddev_pop) if how == "standard" else (F.min, lambda x: F.max(x) - F.min(x))
            row = rows.agg(*[F.struct(c(n).alias("c"), s(n).alias("s")).alias(n) for n in names]).first()
            found = {n: (row[n].c, row[n].s) for n in names}
        value = lambda n, k: found.get(n, (None, None))[k]
        scale = {n: value(n, 1) if value(n, 1) is not None and abs(value(n, 1)) > 1e-12 else 1.0 for n in names}
        return {n: value(n, 0) or 0.0 for n in names}, scale

    def _seen(self, rows: DataFrame, name: str) -> list[str]:
        counted = rows.groupBy(F.col(f"`{name}`").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v IS NOT NULL")
        found = counted.orderBy(F.desc("n"), "v").limit(self.value("most") + 1).collect()
        if len(found) > self.value("most"):
            raise ValueError(f"{name} has more than {self.value('most')} categories: encode them by hash")
        return [r.v for r in found]


class Prepared(Model, _Settings, _Kept):
    """transform(rows) adds the vector; names() says what its places hold."""

    def __init__(self, fitted: dict | None = None) -> None:
        super().__init__()
        self.fitted = fitted or {"fill": {}, "center": {}, "scale": {}, "seen": {}}

    def names(self) -> list[str]:
        wide = self.value("encode") == "one_hot"
        return [*self.value("numbers"), *[x for c in self.value("categories") for x in ([f"{c}={v}" for v in self.fitted["seen"][c]] if wide else [c])]]

    def columns(self) -> list[Column]:
        """The numbers of the vector, in order."""
        f, how = self.fitted, self.value("impute")
        out = []
        for n in self.value("numbers"):
            x = _number(n) if how == "preserve" else F.coalesce(_number(n), F.lit(f["fill"][n]))
            out.append(F.coalesce((x - f["center"][n]) / f["scale"][n], F.lit(float("nan"))))
        for c in self.value("categories"):
            text = F.col(f"`{c}`").cast("string")
            if self.value("encode") == "hash":
                out.append(F.when(text.isNull(), -1.0).otherwise(F.pmod(F.xxhash64(text), F.lit(self.value("buckets"))).cast("double")))
                continue
            seen = F.array(*[F.lit(v) for v in f["seen"][c]]).cast("array<string>")
            place = F.coalesce(F.array_position(seen, text), F.lit(0))
            if self.value("unknown") == "error":
                place = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit(f"{c} has an unknown category "), F.coalesce(text, F.lit("null")))).cast("long"))
            out += [(place - 1).cast("double")] if self.value("encode") == "index" else [(place == k + 1).cast("double") for k in range(len(f["seen"][c]))]
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.value("output"), array_to_vector(F.array(*self.columns()).cast("array<double>")))
