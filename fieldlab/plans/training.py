"""Training data: configured features of strictly earlier games, labels, splits, scaling fitted on train, reports and audits."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.operators.history import GAME, exponential_means, with_history
from fieldlab.operators.ranks import medians, value_at, value_places
from fieldlab.plans.ladders import SUSPICIOUS, TARGETS, game_outcomes, target_columns
from fieldlab.sources.shared import dealt, stage, with_position
from fieldlab.sources.tables import GAME_LOG_SQL, game_log

RATES = {
    "batting_average": ("hits", "at_bats"), "on_base_percentage": ("times_on_base", "plate_appearances"), "slugging_percentage": ("total_bases", "at_bats"),
    "home_run_rate": ("home_runs", "plate_appearances"), "walk_rate": ("walks", "plate_appearances"), "strikeout_rate": ("strikeouts", "plate_appearances"),
    "extra_base_hit_rate": ("extra_base_hits", "plate_appearances"), "rbi_rate": ("rbi", "plate_appearances"), "run_rate": ("runs", "plate_appearances"),
    "stolen_base_rate": ("stolen_bases", "times_on_base"), "pitcher_strikeout_rate": ("pitcher_strikeouts", "batters_faced"), "pitcher_walk_rate": ("pitcher_walks", "batters_faced"),
    "pitcher_home_run_rate": ("pitcher_home_runs", "batters_faced"), "whip_component_rate": ("walks_hits_allowed", "innings_pitched"), "earned_run_rate_component": ("earned_runs", "innings_pitched"),
}


@dataclass(frozen=True)
class FeatureConfig:
    """What features are built: windows of games, rates by numerator and denominator, counted fields, half-lives."""

    windows: tuple[int, ...] = (3, 5, 10, 15, 30)
    rates: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(RATES))
    counts: tuple[str, ...] = ("hits", "home_runs")
    half_lives: tuple[float, ...] = (3, 7, 14)
    sufficient: int = 50


DEFAULT = FeatureConfig()


def counted(log: DataFrame) -> DataFrame:
    """The log with all fields that the rates stand on; a game against a left hand counts for the pitching ones."""
    c = F.col
    left = lambda x: F.when(c("pitcher_throws") == "L", x).otherwise(0)
    extra = c("doubles") + c("triples") + c("home_runs")
    return log.withColumns({
        "times_on_base": c("hits") + c("walks"), "extra_base_hits": extra, "total_bases": c("hits") + c("doubles") + 2 * c("triples") + 3 * c("home_runs"),
        "stolen_bases": F.least("rbi", "walks"), "pitcher_strikeouts": left(c("strikeouts")), "pitcher_walks": left(c("walks")), "pitcher_home_runs": left(c("home_runs")),
        "batters_faced": left(c("plate_appearances")), "walks_hits_allowed": left(c("walks") + c("hits")), "earned_runs": left(c("rbi")), "innings_pitched": left(c("plate_appearances") / 3.0),
    })


def rate(num: Column | str, den: Column | str) -> Column:
    """0 where the denominator is 0 or unknown."""
    return F.round(F.coalesce(F.try_divide(num, F.when(F.abs(den) > 1e-12, F.col(den) if isinstance(den, str) else den)), F.lit(0.0)), 6)


def rolling(log: DataFrame, config: FeatureConfig = DEFAULT) -> DataFrame:
    """Sum, mean, deviation and trend of the counted fields over the last n earlier games, for all windows: one shuffle and
    one sort."""
    log = log.withColumn("__at", F.row_number().over(GAME.order))
    columns = {}
    for n in config.windows:
        for c in config.counts:
            columns |= {f"{c}_sum_{n}": GAME.last(n, F.sum(c)), f"{c}_mean_{n}": GAME.last(n, F.avg(c)), f"{c}_std_{n}": GAME.last(n, F.stddev_pop(c)), f"{c}_trend_{n}": GAME.last(n, F.regr_slope(c, "__at"))}
    found = with_history(log, columns)
    return found.select(*[x for x in log.columns if x != "__at"], *[(F.round(F.coalesce(c, F.lit(0)).cast("double"), 6) + 0.0).alias(c) for c in columns])


def window_rates(log: DataFrame, config: FeatureConfig = DEFAULT) -> DataFrame:
    """Every rate over the last n earlier games, for all windows. Fields of whole numbers have one running sum each, and each
    window what it was n games before: their difference is exact. Other fields are summed once a window."""
    fields = sorted({f for pair in config.rates.values() for f in pair})
    whole = [f for f in fields if log.schema[f].dataType.typeName() in ("byte", "short", "integer", "long")]
    so_far = F.struct(*[F.coalesce(GAME.last(None, F.sum(F.coalesce(F.col(f).cast("long"), F.lit(0)))), F.lit(0)).alias(f) for f in whole])
    rows = log.withColumn("__sums", so_far)
    before = {f"__before_{n}": F.lag("__sums", n).over(GAME.order) for n in config.windows}
    rows = with_history(rows, before | {f"__{f}_{n}": GAME.last(n, F.sum(f)) for n in config.windows for f in fields if f not in whole})
    rows = GAME.settle(rows, ["__sums"])
    earlier = lambda f, n: F.coalesce(F.col(f"__before_{n}")[f], F.lit(0))
    last = lambda f, n: F.col("__sums")[f] - earlier(f, n) if f in whole else F.col(f"__{f}_{n}")
    return rows.select(*log.columns, *[rate(last(a, n), last(b, n)).alias(f"{name}_{n}") for n in config.windows for name, (a, b) in config.rates.items()])


def feature_rows(log: DataFrame, config: FeatureConfig = DEFAULT) -> DataFrame:
    """The point-in-time table: a row a game with all features of strictly earlier games, the calendar, the sample and its
    uncertainty. The log is staged and counted, and dealt out by player over as many tasks as its rows ask for. The exponential means run over
    it with all its columns, then all frames share one such partitioning: nothing is joined back."""
    log = stage(log, "log")
    n = log.count()
    by_player = lambda df: dealt(df, n, "player_id")
    log = exponential_means(by_player(log.repartition("player_id")), "hits", list(config.half_lives), keep=log.columns)
    rows = window_rates(rolling(counted(by_player(log)), config), config)
    expanding = {"prior_games": GAME.last(None, F.count("game_id")), "prior_pa": GAME.last(None, F.sum("plate_appearances")), "volatility": GAME.last(None, F.stddev_pop("hits"))}
    rows = with_history(rows, expanding).fillna(0, ["prior_pa"]).fillna(0.0, ["volatility"])
    day = F.dayofyear("game_date")
    rows = rows.withColumns({
        "certainty": F.round(1 - F.exp(-F.col("prior_pa") / 100), 6), "sufficient": (F.col("prior_pa") >= config.sufficient).cast("double"), "volatility": F.round("volatility", 6),
        "month_sin": F.round(F.sin(2 * F.pi() * F.month("game_date") / 12), 6) + 0.0, "season_progress": F.round(F.least(F.greatest((day - 80) / 210, F.lit(0.0)), F.lit(1.0)), 6),
        "is_home": (F.col("home_away") == "home").cast("double"),
    })
    return rows.withColumns({f"ewm_{h:g}": F.round(F.coalesce(f"ewm_{h:g}", F.lit(0.0)), 6) for h in config.half_lives})


def feature_names(config: FeatureConfig = DEFAULT) -> list[str]:
    rolled = [f"{c}_{k}_{n}" for n in config.windows for c in config.counts for k in ("sum", "mean", "std", "trend")]
    rated = [f"{name}_{n}" for n in config.windows for name in config.rates]
    return [*rolled, *rated, "prior_games", "prior_pa", "volatility", "certainty", "sufficient", "month_sin", "season_progress", "is_home", *[f"ewm_{h:g}" for h in config.half_lives]]


def split_rows(rows: DataFrame, train: float = 0.70, check: float = 0.15) -> DataFrame:
    """rows with `part`, by place in time, player and game; cuts are whole numbers of rows. The rows are staged and
    counted, so their features are made once, and there are as many ranges as they ask for."""
    rows = stage(rows, "features")
    placed = with_position(rows, ["game_date", "player_id", "game_id"], "__place", rows.count())
    total = placed.agg(F.count(F.lit(1)).alias("__n"))
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * check)
    part = F.when(F.col("__place") < a, "train").when(F.col("__place") < a + b, "validation").otherwise("test")
    return placed.join(F.broadcast(total)).withColumn("part", part).drop("__place", "__n")


@dataclass(frozen=True)
class Scaler:
    """Center and scale of each feature, fitted on some rows and applied to any; goes to JSON and back as a table row."""

    center: dict[str, float]
    scale: dict[str, float]

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f: F.round((F.col(f) - self.center[f]) / self.scale[f], 6) + 0.0 for f in self.center})

    def undo(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f: F.col(f) * self.scale[f] + self.center[f] for f in self.center})


def fit_scaler(rows: DataFrame, names: list[str], strategy: str = "standard") -> Scaler:
    """Standard (population deviation), robust (median, quartiles at whole places), min_max or none; a scale of 1e-12 and
    less is 1. The driver gets a few numbers for each feature."""
    if strategy == "none":
        return Scaler(dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0))
    long = rows.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "feature", "value")
    if strategy == "robust":
        last = F.col("total") - 1
        at = lambda place: value_at("value", place)
        low, high = at(F.floor(last * 0.25)), at(F.floor(last * 0.75))
        stats = value_places(long, ["feature"], "value").groupBy("feature").agg(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("center"), (high - low).alias("scale"))
    elif strategy == "min_max":
        stats = long.groupBy("feature").agg(F.min("value").alias("center"), (F.max("value") - F.min("value")).alias("scale"))
    elif strategy == "standard":
        stats = long.groupBy("feature").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("scale"))
    else:
        raise ValueError(f"no scaling {strategy}")
    found = {r.feature: r for r in stats.collect()}
    value = lambda n, k, default: default if n not in found or found[n][k] is None else found[n][k]
    scale = {n: value(n, "scale", 1.0) for n in names}
    return Scaler({n: value(n, "center", 0.0) for n in names}, {n: s if abs(s) > 1e-12 else 1.0 for n, s in scale.items()})


def fit_imputer(rows: DataFrame, names: list[str], strategy: str = "mean", constant: float = 0.0) -> dict[str, float]:
    """What stands for a missing value of each feature: zero, constant, mean, median, or nothing (preserve)."""
    if strategy in ("zero", "constant"):
        return dict.fromkeys(names, 0.0 if strategy == "zero" else constant)
    if strategy == "preserve":
        return {}
    long = rows.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "feature", "value")
    stats = medians(long, ["feature"], "value", "x") if strategy == "median" else long.groupBy("feature").agg(F.avg("value").alias("x"))
    found = {r.feature: r.x for r in stats.collect()}
    return {n: 0.0 if found.get(n) is None else found[n] for n in names}


def training_dataset(log: DataFrame, config: FeatureConfig = DEFAULT, scaling: str = "standard", least: int = 100) -> tuple[DataFrame, Scaler, DataFrame]:
    """(rows, scaler, manifest): games with features, all targets and their part, staged; the scaler fitted on train; and a
    row of counts and times. Fewer rows than `least` are an error."""
    rows = stage(split_rows(feature_rows(game_outcomes(log), config)).withColumns({k: v for k, v in zip(TARGETS, target_columns(TARGETS))}), "dataset")
    n = rows.count()
    if n < least:
        raise ValueError(f"{n} rows are too few to learn from")
    scaler = fit_scaler(rows.where("part = 'train'"), feature_names(config), scaling)
    count = lambda p: F.count_if(F.col("part") == p).alias(p)
    manifest = rows.agg(F.count(F.lit(1)).alias("n"), count("train"), count("validation"), count("test"), F.count_distinct("player_id").alias("players"), F.min("game_date").alias("first"), F.max("game_date").alias("last"))
    return rows, scaler, manifest


def export_dataset(rows: DataFrame, scaler: Scaler, manifest: DataFrame, path: str) -> None:
    """The dataset under a folder: rows as Parquet by part, scaler and manifest as one JSON row each."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    spark.createDataFrame([(k, scaler.center[k], scaler.scale[k]) for k in scaler.center], "feature string, center double, scale double").coalesce(1).write.mode("overwrite").json(f"{path}/scaler")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_scaler(spark: SparkSession, path: str) -> Scaler:
    rows = spark.read.json(f"{path}/scaler").collect()
    return Scaler({r.feature: r.center for r in rows}, {r.feature: r.scale for r in rows})


# --- queries


def rolling_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and home runs over the last 3, 5, 10, 15 and 30 earlier games: sum, mean, deviation and trend."""
    names = [f"{c}_{k}_{n}" for n in DEFAULT.windows for c in DEFAULT.counts for k in ("sum", "mean", "std", "trend")]
    return rolling(game_log(spark, sf_dir)).select("player_id", "game_id", *names)


def window_rates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen rates over five windows of earlier games."""
    return window_rates(counted(game_log(spark, sf_dir))).select("player_id", "game_id", *[f"{r}_{n}" for n in DEFAULT.windows for r in RATES])


def career_rates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen rates of whole careers, and those that follow from them: OPS, ISO, BABIP, ERA, WHIP, K/9, BB/9, HR/9."""
    fields = sorted({f for pair in RATES.values() for f in pair})
    t = counted(game_log(spark, sf_dir)).groupBy("player_id").agg(*[F.sum(f).alias(f) for f in fields])
    c = F.col
    own = {name: rate(a, b) for name, (a, b) in RATES.items()}
    nine = lambda x: rate(9 * c(x), c("innings_pitched"))
    more = {
        "ops": F.round(own["on_base_percentage"] + own["slugging_percentage"], 6), "iso": rate(c("total_bases") - c("hits"), c("at_bats")),
        "babip": rate(c("hits") - c("home_runs"), c("at_bats") - c("strikeouts") - c("home_runs")), "era": nine("earned_runs"), "whip": rate("walks_hits_allowed", "innings_pitched"),
        "k_9": nine("pitcher_strikeouts"), "bb_9": nine("pitcher_walks"), "hr_9": nine("pitcher_home_runs"),
    }
    return t.select("player_id", *[v.alias(k) for k, v in (own | more).items()])


#: A smaller configuration, as a user may have it, which the dataset queries build.
SMALL = FeatureConfig(windows=(5, 15), rates={k: RATES[k] for k in ("batting_average", "slugging_percentage", "walk_rate")}, counts=("hits",))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point-in-time table of a configuration of two windows, three rates and one counted field."""
    return feature_rows(game_log(spark, sf_dir), SMALL).select("player_id", "game_id", *feature_names(SMALL))


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_rows(game_outcomes(game_log(spark, sf_dir)), SMALL)
    return split_rows(rows).withColumns({k: v for k, v in zip(TARGETS, target_columns(TARGETS))})


def model_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows with their features in fixed order, scaled by statistics of the train rows, beside a label; the
    vector as text, for the comparison."""
    names = sorted(["hits_mean_5", "batting_average_15", "prior_pa", "ewm_7"])
    rows = stage(_dataset(spark, sf_dir).select("player_id", "game_id", "part", "target_hit", *names), "matrix")
    scaled = fit_scaler(rows.where("part = 'train'"), names).apply(rows).where("part = 'validation'")
    return scaled.select("player_id", "game_id", F.size(F.array(*names)).alias("width"), F.round(reduce(lambda a, b: a + b, [F.col(n) * (k + 1) for k, n in enumerate(names)]), 6).alias("weighted"), F.element_at(F.array(*names), 1).alias("first"), "target_hit")


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plate appearances and earlier hits by median and quartiles of the train rows, on all rows."""
    rows = stage(_dataset(spark, sf_dir).select("player_id", "game_id", "part", F.col("plate_appearances").cast("double").alias("pa"), F.col("hits_sum_15").alias("hits")), "robust")
    return fit_scaler(rows.where("part = 'train'"), ["pa", "hits"], "robust").apply(rows)


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the dataset: repeated keys, rows out of order, constant features, suspicious names, balance, and status."""
    rows = stage(_dataset(spark, sf_dir).select("player_id", "game_id", "game_date", "target_hit", *feature_names(SMALL)), "report")
    names = feature_names(SMALL)
    order = Window.partitionBy("player_id").orderBy("game_id")
    games = dealt(rows.select("player_id", "game_id", "game_date"), rows.count(), "player_id")
    late = games.withColumn("late", F.col("game_date") < F.lag("game_date").over(order)).agg(F.count_if("late").alias("out_of_order"))
    keys = games.groupBy("player_id", "game_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    flat = rows.agg(*[(F.var_pop(n) <= 1e-12).cast("int").alias(n) for n in names]).select(reduce(lambda a, b: a + b, [F.col(n) for n in names]).alias("constant"))
    odd = sum(any(s in n for s in SUSPICIOUS) for n in names)
    base = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target_hit") >= 0.5).alias("positive"))
    status = F.when((F.col("n") < 100) | (F.col("repeated") > 0) | (F.col("suspicious") > 0), "blocked").when((F.col("out_of_order") > 0) | (F.col("constant") > 0), "degraded").otherwise("ready")
    return base.join(late).join(keys).join(flat).withColumn("suspicious", F.lit(odd)).withColumn("status", status)


def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games whose history, as told, holds rows at or after their date (told here: the player's games up to the next day),
    by how many; a feature set without them gives none."""
    log = game_log(spark, sf_dir).select("player_id", "game_id", "game_date")
    told = Window.partitionBy("player_id").orderBy(F.unix_seconds(F.col("game_date").cast("timestamp"))).rangeBetween(0, 86_400 * 30)
    return log.withColumn("future_rows", F.count(F.lit(1)).over(told) - 1).where("future_rows > 0").select("player_id", "game_id", "future_rows")


#: What a registry knows of features: required, and the risk of a leak.
REGISTRY = [("hits", True, "high"), ("plate_appearances", True, "low"), ("game_date", True, "low"), ("walks", False, "low"), ("target_hit", True, "high"), ("runs", False, "high")]


def registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the log against the registry: unknown ones, required ones that are missing, and known ones of high risk."""
    log = game_log(spark, sf_dir)
    have = spark.createDataFrame([(c,) for c in log.columns], "name string")
    known = spark.createDataFrame(REGISTRY, "name string, required boolean, risk string")
    both = have.withColumn("here", F.lit(True)).join(known, "name", "full_outer")
    problem = F.when(F.col("required").isNull(), "unknown").when(F.col("here").isNull() & F.col("required"), "missing").when(F.col("here") & (F.col("risk") == "high"), "high_risk")
    rows = log.agg(F.count(F.lit(1)).alias("rows"))
    return both.select("name", problem.alias("problem")).where("problem is not null").join(rows)


def batch_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature maps of lines against the reference set of names: lines that lack one, have another, or hold no number."""
    c = F.col
    features = F.map_filter(
        F.create_map(F.lit("quantity"), c("l_quantity"), F.lit("discount"), F.when(c("l_discount") > 0.01, c("l_discount")), F.lit("tax"), F.when(c("l_tax") == 0.08, F.lit(float("nan"))).otherwise(c("l_tax")), F.lit("extra"), F.when(c("l_quantity") > 49, c("l_quantity"))),
        lambda k, v: v.isNotNull(),
    )
    wanted = F.array(*[F.lit(n) for n in ("quantity", "discount", "tax")])
    rows = game_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", features.alias("f"))
    lacks, more = F.array_except(wanted, F.map_keys("f")), F.array_except(F.map_keys("f"), wanted)
    odd = F.exists(F.map_values("f"), lambda v: F.isnan(v))
    found = rows.select("l_orderkey", "l_linenumber", F.array_join(lacks, ",").alias("lacks"), F.array_join(more, ",").alias("more"), odd.alias("not_a_number"))
    return found.where("lacks <> '' or more <> '' or not_a_number")


def game_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def fold_bounds(total: Column, train: Column, check: Column, test: Column, step: Column, expanding: bool) -> Column:
    """Folds as an array of structs: fold, first row of train, of validation, of test, and the end."""
    folds = F.greatest(F.floor((total - train - check - test) / step) + 1, F.lit(0)).cast("int")
    one = lambda k: F.struct(k.alias("fold"), (F.lit(0) if expanding else k * step).cast("long").alias("a"), (train + k * step).cast("long").alias("b"), (train + k * step + check).cast("long").alias("c"), (train + k * step + check + test).cast("long").alias("d"))
    return F.when(folds > 0, F.transform(F.sequence(F.lit(0), folds - 1), one))


def sliding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds over games in time: a train block of four tenths that slides on by a tenth, then a tenth each of validation and
    test. A row is expanded into the folds it is in; there is no join of rows and folds by range."""
    placed = with_position(game_log(spark, sf_dir).select("game_id", "game_date"), ["game_date", "game_id"], "place")
    total = placed.agg(F.count(F.lit(1)).alias("n"))
    tenth = F.floor(F.col("n") / 10)
    bounds = F.broadcast(total.select(fold_bounds(F.col("n"), 4 * tenth, tenth, tenth, tenth, False).alias("folds")))
    rows = placed.join(bounds).select("game_id", "place", F.explode(F.filter("folds", lambda f: (F.col("place") >= f["a"]) & (F.col("place") < f["d"]))).alias("f"))
    part = F.when(F.col("place") < F.col("f.b"), "train").when(F.col("place") < F.col("f.c"), "validation").otherwise("test")
    return rows.select("game_id", F.col("f.fold").alias("fold"), part.alias("part"))


def pruned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in order of name with the one that made each redundant: |r| of 0.999 and more with one that is kept; unknown
    values count as 0, an undefined r is 0. One pass over the rows for all pairs; the k x k result is pruned in the driver."""
    c = F.col
    cols = {"a_quantity": c("l_quantity"), "b_price": c("l_extendedprice"), "c_double": c("l_quantity") * 2 + 1, "d_tax": c("l_tax"), "e_negative": -c("l_extendedprice"), "f_constant": F.lit(1.0), "g_discount": F.when(c("l_discount") > 0.03, c("l_discount"))}
    rows = game_lines(spark, sf_dir).select(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in cols.items()])
    names = sorted(cols)
    pairs = [(a, b) for k, b in enumerate(names) for a in names[:k]]
    pearson = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    r = rows.agg(*[F.coalesce(pearson(a, b), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs])
    found = r.first()  # one number for each pair of columns
    twins: dict[str, str | None] = {}
    for b in names:
        twins[b] = next((a for a in names if a < b and twins[a] is None and abs(found[f"{a}|{b}"]) >= 0.999), None)
    return spark.createDataFrame([(n, t is None, t) for n, t in twins.items()], "feature string, kept boolean, twin string")


def multiclass_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss and entropy of forecasts of how a line ends (returned, kept, new): shares by quantity, normalised first."""
    q = F.col("l_quantity") / 50
    raw = [0.2 + q, F.lit(0.5), 1.2 - q]
    total = reduce(lambda a, b: a + b, raw)
    p = [F.least(F.greatest(x / total, F.lit(1e-12)), F.lit(1 - 1e-12)) for x in raw]
    hit = F.when(F.col("l_returnflag") == "R", p[0]).when(F.col("l_returnflag") == "A", p[1]).otherwise(p[2])
    entropy = reduce(lambda a, b: a + b, [-x * F.log2(x) for x in p])
    return game_lines(spark, sf_dir).groupBy("l_linestatus").agg(F.round(F.avg(-F.log(hit)), 6).alias("log_loss"), F.round(F.avg(entropy), 6).alias("entropy"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    rolling_all, window_rates_all, career_rates_all, feature_table, model_matrix, robust_scale, quality_report, leakage_audit, registry_check, batch_schema, sliding_folds, pruned_features, multiclass_scores,
)}

_PAST = f"""WITH {GAME_LOG_SQL}, past AS (SELECT c.player_id, c.game_id AS game, c.game_date AS day0, h.*, row_number() OVER (PARTITION BY c.game_id ORDER BY h.game_date DESC, h.game_id DESC) AS back
    FROM log c LEFT JOIN log h ON h.player_id = c.player_id AND h.game_date < c.game_date)"""
_SUM = {
    "batting_average": ("hits", "at_bats"), "on_base_percentage": ("hits + walks", "plate_appearances"), "slugging_percentage": ("hits + doubles + 2 * triples + 3 * home_runs", "at_bats"),
    "home_run_rate": ("home_runs", "plate_appearances"), "walk_rate": ("walks", "plate_appearances"), "strikeout_rate": ("strikeouts", "plate_appearances"),
    "extra_base_hit_rate": ("doubles + triples + home_runs", "plate_appearances"), "rbi_rate": ("rbi", "plate_appearances"), "run_rate": ("runs", "plate_appearances"),
    "stolen_base_rate": ("least(rbi, walks)", "hits + walks"), "pitcher_strikeout_rate": ("strikeouts * l", "plate_appearances * l"), "pitcher_walk_rate": ("walks * l", "plate_appearances * l"),
    "pitcher_home_run_rate": ("home_runs * l", "plate_appearances * l"), "whip_component_rate": ("(walks + hits) * l", "plate_appearances * l / 3e0"), "earned_run_rate_component": ("rbi * l", "plate_appearances * l / 3e0"),
}
_LEFT = "(pitcher_throws = 'L')::INT"


def _rate(name: str, upto: str = "") -> str:
    a, b = (x.replace("* l", f"* {_LEFT}") for x in _SUM[name])
    return f"round(coalesce(sum({a}){upto} / nullif(sum({b}){upto}, 0), 0), 6)"


def _rolled(c: str, n: int) -> str:
    f = f"FILTER (back <= {n})"
    slope = f"CASE WHEN count(game_id) {f} < 2 THEN 0 ELSE coalesce(regr_slope({c}, -back) {f}, 0) END"
    return f"coalesce(sum({c}) {f}, 0)::DOUBLE AS {c}_sum_{n}, round(coalesce(avg({c}) {f}, 0), 6) AS {c}_mean_{n}, round(coalesce(stddev_pop({c}) {f}, 0), 6) AS {c}_std_{n}, round({slope}, 6) + 0 AS {c}_trend_{n}"


_EWM = ", ".join(f"round(coalesce(CASE WHEN len(xs) > 0 THEN list_reduce(xs, lambda m, x: m * {0.5 ** (1 / h)!r} + x * {1 - 0.5 ** (1 / h)!r}) END, 0), 6) AS ewm_{h}" for h in (3, 7, 14))
_FEATURES = f"""{_PAST}, f0 AS (SELECT player_id, game AS game_id, any_value(day0) AS day0, {_rolled('hits', 5)}, {_rolled('hits', 15)}, {', '.join(f"{_rate(r, f' FILTER (back <= {n})')} AS {r}_{n}" for n in (5, 15) for r in SMALL.rates)},
    count(game_id) AS prior_games, coalesce(sum(plate_appearances), 0)::BIGINT AS prior_pa, round(coalesce(stddev_pop(hits), 0), 6) AS volatility, list(hits::DOUBLE ORDER BY back DESC) FILTER (hits IS NOT NULL) AS xs FROM past GROUP BY 1, 2),
    feats AS (SELECT * EXCLUDE (xs, day0), round(1 - exp(-prior_pa / 100e0), 6) AS certainty, (prior_pa >= 50)::INT::DOUBLE AS sufficient, round(sin(2 * pi() * month(day0) / 12), 6) + 0 AS month_sin,
    round(least(greatest((dayofyear(day0) - 80) / 210e0, 0), 1), 6) AS season_progress, (game_id % 2 = 0)::INT::DOUBLE AS is_home, {_EWM} FROM f0)"""
_PARTED = f"""{_FEATURES}, parted AS (SELECT feats.*, hits, plate_appearances, game_date, row_number() OVER (ORDER BY game_date, player_id, game_id) - 1 AS place, count(*) OVER () AS total FROM feats JOIN log USING (player_id, game_id)),
    d AS (SELECT *, CASE WHEN place < floor(total * 0.7) THEN 'train' WHEN place < floor(total * 0.7) + floor(total * 0.15) THEN 'validation' ELSE 'test' END AS part FROM parted)"""
_SCALED = ", ".join(f"({c} - (SELECT avg({c}) FROM d WHERE part = 'train')) / (SELECT stddev_pop({c}) FROM d WHERE part = 'train') AS z{k}" for k, c in enumerate(("batting_average_15", "ewm_7", "hits_mean_5", "prior_pa")))
ORACLE_SQL = {
    "rolling_all": f"{_PAST} SELECT player_id, game AS game_id, {', '.join(_rolled(c, n) for n in (3, 5, 10, 15, 30) for c in ('hits', 'home_runs'))} FROM past GROUP BY 1, 2",
    "window_rates_all": f"{_PAST} SELECT player_id, game AS game_id, {', '.join(f'{_rate(r, f' FILTER (back <= {n})')} AS {r}_{n}' for n in (3, 5, 10, 15, 30) for r in _SUM)} FROM past GROUP BY 1, 2",
    "career_rates_all": f"""WITH {GAME_LOG_SQL} SELECT player_id, {', '.join(f'{_rate(r)} AS {r}' for r in _SUM)}, round({_rate('on_base_percentage')} + {_rate('slugging_percentage')}, 6) AS ops,
        round(coalesce(sum(doubles + 2 * triples + 3 * home_runs) / nullif(sum(at_bats), 0), 0), 6) AS iso, round(coalesce(sum(hits - home_runs) / nullif(sum(at_bats - strikeouts - home_runs), 0), 0), 6) AS babip,
        round(coalesce(27e0 * sum(rbi) FILTER (pitcher_throws = 'L') / sum(plate_appearances) FILTER (pitcher_throws = 'L'), 0), 6) AS era, round(coalesce(3e0 * sum(hits + walks) FILTER (pitcher_throws = 'L') / sum(plate_appearances) FILTER (pitcher_throws = 'L'), 0), 6) AS whip,
        round(coalesce(27e0 * sum(strikeouts) FILTER (pitcher_throws = 'L') / sum(plate_appearances) FILTER (pitcher_throws = 'L'), 0), 6) AS k_9, round(coalesce(27e0 * sum(walks) FILTER (pitcher_throws = 'L') / sum(plate_appearances) FILTER (pitcher_throws = 'L'), 0), 6) AS bb_9,
        round(coalesce(27e0 * sum(home_runs) FILTER (pitcher_throws = 'L') / sum(plate_appearances) FILTER (pitcher_throws = 'L'), 0), 6) AS hr_9 FROM log GROUP BY 1""",
    "feature_table": f"{_FEATURES} SELECT * FROM feats",
    "model_matrix": f"{_PARTED}, z AS (SELECT *, {_SCALED} FROM d) SELECT player_id, game_id, 4 AS width, round(round(z0, 6) + 2 * round(z1, 6) + 3 * round(z2, 6) + 4 * round(z3, 6), 6) AS weighted, round(z0, 6) + 0 AS first, (hits > 0)::INT::DOUBLE AS target_hit FROM z WHERE part = 'validation'",
    "robust_scale": f"""{_PARTED}, t AS (SELECT list(plate_appearances ORDER BY plate_appearances) AS a, list(hits_sum_15 ORDER BY hits_sum_15) AS b FROM d WHERE part = 'train'),
        s AS (SELECT (a[(len(a) - 1) // 2 + 1] + a[len(a) // 2 + 1]) / 2e0 AS ca, a[floor((len(a) - 1) * 0.75)::INT + 1] - a[floor((len(a) - 1) * 0.25)::INT + 1] AS sa, (b[(len(b) - 1) // 2 + 1] + b[len(b) // 2 + 1]) / 2e0 AS cb, b[floor((len(b) - 1) * 0.75)::INT + 1] - b[floor((len(b) - 1) * 0.25)::INT + 1] AS sb FROM t)
        SELECT player_id, game_id, part, round((plate_appearances - ca) / CASE WHEN sa = 0 THEN 1 ELSE sa END, 6) + 0 AS pa, round((hits_sum_15 - cb) / CASE WHEN sb = 0 THEN 1 ELSE sb END, 6) + 0 AS hits FROM d, s""",
    "quality_report": f"""{_FEATURES}, l AS (SELECT count(*) FILTER (game_date < before) AS out_of_order FROM (SELECT game_date, lag(game_date) OVER (PARTITION BY player_id ORDER BY game_id) AS before FROM log)),
        k AS (SELECT {' + '.join(f'(var_pop({c}) <= 1e-12)::INT' for c in feature_names(SMALL))} AS constant FROM feats) SELECT count(*) AS n, count(*) FILTER (hits > 0) AS positive, any_value(out_of_order) AS out_of_order, 0 AS repeated, any_value(constant)::INT AS constant, 0 AS suspicious,
        CASE WHEN count(*) < 100 THEN 'blocked' WHEN any_value(out_of_order) > 0 OR any_value(constant) > 0 THEN 'degraded' ELSE 'ready' END AS status FROM log, l, k""",
    "leakage_audit": f"WITH {GAME_LOG_SQL} SELECT a.player_id, a.game_id, count(*) AS future_rows FROM log a JOIN log b ON b.player_id = a.player_id AND b.game_id <> a.game_id AND b.game_date >= a.game_date AND b.game_date <= a.game_date + INTERVAL 30 DAY GROUP BY 1, 2",
    "registry_check": f"""WITH {GAME_LOG_SQL} SELECT name, problem, (SELECT count(*) FROM log) AS rows FROM (VALUES ('player_id', 'unknown'), ('game_id', 'unknown'), ('season', 'unknown'), ('team_id', 'unknown'), ('home_away', 'unknown'), ('pitcher_throws', 'unknown'), ('day_night', 'unknown'),
        ('at_bats', 'unknown'), ('doubles', 'unknown'), ('triples', 'unknown'), ('home_runs', 'unknown'), ('strikeouts', 'unknown'), ('rbi', 'unknown'), ('hits', 'high_risk'), ('runs', 'high_risk'), ('target_hit', 'missing')) v(name, problem)""",
    "batch_schema": """SELECT * FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0.01 THEN 'discount' ELSE '' END AS lacks, CASE WHEN l_quantity > 49 THEN 'extra' ELSE '' END AS more, l_tax = 0.08 AS not_a_number FROM lineitem) WHERE lacks <> '' OR more <> '' OR not_a_number""",
    "sliding_folds": f"""WITH {GAME_LOG_SQL}, p AS (SELECT game_id, row_number() OVER (ORDER BY game_date, game_id) - 1 AS place, count(*) OVER () // 10 AS s, count(*) OVER () AS n FROM log), f AS (SELECT *, unnest(range(0, ((n - 6 * s) // s + 1)::BIGINT))::INT AS fold FROM p)
        SELECT game_id, fold, CASE WHEN place < (fold + 4) * s THEN 'train' WHEN place < (fold + 5) * s THEN 'validation' ELSE 'test' END AS part FROM f WHERE place >= fold * s AND place < (fold + 6) * s""",
    "pruned_features": """SELECT * FROM (VALUES ('a_quantity', true, NULL), ('b_price', (SELECT abs(corr(l_quantity, l_extendedprice)) < 0.999 FROM lineitem), (SELECT CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.999 THEN 'a_quantity' END FROM lineitem)), ('c_double', false, 'a_quantity'), ('d_tax', true, NULL),
        ('e_negative', false, 'b_price'), ('f_constant', true, NULL), ('g_discount', true, NULL)) v(feature, kept, twin)""",
    "multiclass_scores": """WITH x AS (SELECT l_linestatus, l_returnflag, (0.2e0 + l_quantity / 50) / 1.9e0 AS a, 0.5e0 / 1.9e0 AS b, (1.2e0 - l_quantity / 50) / 1.9e0 AS c FROM lineitem)
        SELECT l_linestatus, round(avg(-ln(CASE l_returnflag WHEN 'R' THEN a WHEN 'A' THEN b ELSE c END)), 6) AS log_loss, round(avg(-(a * log2(a) + b * log2(b) + c * log2(c))), 6) AS entropy, count(*) AS n FROM x GROUP BY 1""",
}
