"""CSV exports: all-string scans with lineage, cleaning, and the category of a file by its name and header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Missing-value tokens, as fixed values.
NULLS = ("", "nan", "none", "null", "n/a", "--")


def list_csv(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """path, size, header (as it stands) of every CSV file below the paths. Lines are read of each file's
    first block only, one at a time, whatever the file's size; a header is one line.
    Spark lists no files of no bytes; `expected` of load_with_log finds them missing."""
    options = {"pathGlobFilter": "*.csv", "recursiveFileLookup": recursive}
    files = spark.read.format("binaryFile").options(**options).load(paths).select("path", F.col("length").alias("size"))
    lines = spark.read.format("text").options(**options).load(paths)
    first = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), "value").where("start = 0")
    found = _by_path(files, first.groupBy("path").agg(F.min_by("value", "line").alias("header")))
    return found.select("path", "size", F.regexp_replace(F.coalesce("header", F.lit("")), "[\\r\ufeff]", "").alias("header"))


def header_names(header: Column) -> Column:
    """The names of a CSV header: commas within double quotes belong to a name, doubled quotes are one."""
    parts = F.split(header, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    tidy = lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.transform(parts, tidy)


def scan_csv(spark: SparkSession, paths: list[str], by_path: bool = False) -> DataFrame:
    """Every value a string, no inference, columns without a name dropped, the file's name kept as `source_file` (its whole
    path, with by_path, which tells files of equal names in different folders apart). Files are
    read by header: those of one header together, then all of them under the union of their names (null where a file lacks
    one). The driver sees each distinct header with its files' paths."""
    groups = {r.header: r.files for r in list_csv(spark, paths).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("files")).collect()}
    parts = []
    for header, files in sorted(groups.items()):
        if not header.strip():
            continue
        rows = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(files)
        named = [F.col(f"`{c}`") for c in rows.columns if c.strip() and not c.startswith("_c")]
        parts.append(rows.select(*named, F.col("_metadata.file_path" if by_path else "_metadata.file_name").alias("source_file")))
    if not parts:
        return spark.createDataFrame([], "source_file string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _by_path(files: DataFrame, other: DataFrame) -> DataFrame:
    """A left join on the path, however the two readers write a local one."""
    plain = F.regexp_replace("path", "^file:/+", "/")
    return files.withColumn("__at", plain).join(other.withColumn("__at", plain).drop("path"), "__at", "left").drop("__at")


def preflight(spark: SparkSession, paths: list[str], rules: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """A row for each file: path, name, size, columns, rows, and its category with the score, the second score and the gap."""
    files = list_csv(spark, paths).select("path", "size", F.size(header_names(F.col("header"))).alias("columns"))
    return _by_path(files, classify_files(spark, paths, rules))


def load_with_log(
    rows: DataFrame, mapping: dict[str, tuple[list[str], str]], required: list[str], target: DataFrame | None = None, keys: list[str] | None = None, expected: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(loaded, quarantine, log): typed rows that have all required values, those that lack one with the names of what they
    lack, and a row for each file: seen, inserted, updated, unchanged, skipped, status (completed, failed, missing).

    With a target and its keys, a row counts as inserted where the target lacks its key, else as updated or unchanged by the
    columns that both have; of rows of one key each counts. `expected` (source_file) names files that should be there:
    those without rows are in the log too, as missing."""
    typed = typed_load(rows, mapping, ["source_file"])
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    marked = typed.withColumn("lacks", lacks)
    good = F.size("lacks") == 0
    if target is None:
        marked = marked.withColumn("__state", F.lit("inserted"))
    else:
        fields = sorted(c for c in target.columns if c in mapping and c not in keys)
        held = target.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(F.lit(1).alias("__there"), *fields).alias("__held")).dropDuplicates([f"__k_{k}" for k in keys])
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
        same = reduce(lambda a, b: a & b, [F.col("__held")[c].eqNullSafe(F.col(c)) for c in fields], F.lit(True))
        state = F.when(F.col("__held").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
        marked = marked.join(held, on, "left").withColumn("__state", state).select(*marked.columns, "__state")
    count = lambda s: F.count_if(good & (F.col("__state") == s)).alias(f"rows_{s}")
    log = marked.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows_seen"), *map(count, ("inserted", "updated", "unchanged")), F.count_if(~good).alias("rows_skipped"))
    if expected is not None:
        log = expected.select("source_file").unionByName(log.select("source_file")).distinct().join(log, "source_file", "left").fillna(0)
    status = F.when(F.col("rows_seen") == 0, "missing").when(F.col("rows_seen") > F.col("rows_skipped"), "completed").otherwise("failed")
    marked = marked.drop("__state")
    return marked.where("size(lacks) = 0").drop("lacks"), marked.where("size(lacks) > 0"), log.withColumn("status", status)


#: Typed loads of the seven metric tables: target column, its aliases in the exports, and the kind of value.
_WHO = {"player_id": (["player_id", "mlb_player_id", "id"], "int"), "name": (["player_name", "name", "last_name,_first_name"], "text"), "season": (["year", "season"], "int")}
METRIC_TABLES: dict[str, dict[str, tuple[list[str], str]]] = {
    "percentiles": _WHO | {k: ([k], "int") for k in ("xwoba", "xba", "xslg", "exit_velocity", "hard_hit_percent", "barrel_percent")},
    "batted_ball": _WHO | {k: ([k, f"{k}_rate", f"{k}_percent"], "rate") for k in ("gb", "air", "fb", "ld", "pu", "pull", "straight", "oppo")},
    "stance": _WHO | {"side": (["side", "bat_side"], "text"), "depth": (["avg_batter_y_position"], "number"), "stance_angle": (["avg_stance_angle"], "number")},
    "home_runs": _WHO | {"home_runs": (["hr_total", "hr"], "int"), "expected": (["xhr"], "number"), "no_doubters": (["no_doubters", "no_doubter"], "int")},
    "advanced_batting": _WHO | {"pa": (["pa"], "int"), "woba": (["woba"], "number"), "k_rate": (["k_percent", "k%"], "rate"), "bb_rate": (["bb_percent", "bb%"], "rate")},
    "tempo": _WHO | {"median_seconds_empty": (["median_seconds_empty"], "number"), "median_seconds_onbase": (["median_seconds_onbase"], "number"), "pitches": (["total_pitches"], "int")},
    "team_discipline": {"team": (["team", "team_name"], "text"), "season": (["year", "season"], "int"), "zone_rate": (["zone_percent", "zone%"], "rate"), "chase_rate": (["chase_percent", "oz_swing_percent"], "rate")},
}


def clean_text(c: Column) -> Column:
    """Trimmed; tokens for a missing value are null."""
    return F.when(F.lower(F.trim(c)).isin(*NULLS), None).otherwise(F.trim(c))


def clean_number(c: Column) -> Column:
    """A double without thousands commas and percent signs; what is no finite number is null."""
    x = F.regexp_replace(clean_text(c), "[,%]", "").try_cast("double")
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None).otherwise(x)


def clean_int(c: Column) -> Column:
    return F.when(clean_number(c) >= 0, F.floor(clean_number(c))).otherwise(F.ceil(clean_number(c))).cast("long")


def clean_rate(c: Column) -> Column:
    """'45%' is 0.45; above 1 and up to 100 is a percentage; else as it is."""
    x = clean_number(c)
    return F.when(F.contains(c, F.lit("%")) | ((x > 1) & (x <= 100)), x / 100).otherwise(x)


def clean_name(name: str) -> str:
    """A column name in lower case with single underscores for blanks, hyphens and dots."""
    out = name.strip().lower()
    for c in "- .":
        out = out.replace(c, "_")
    return out.replace("(", "").replace(")", "").replace("__", "_")


def typed_load(rows: DataFrame, mapping: dict[str, tuple[list[str], str]], keep: list[str] | None = None) -> DataFrame:
    """Target columns from the first non-missing of their aliases; kinds: text, int, number, rate. The row itself stays as
    JSON in raw_json, and the columns in `keep` as they are."""
    clean = {"text": clean_text, "int": clean_int, "number": clean_number, "rate": clean_rate}
    known = {clean_name(c): c for c in rows.columns}
    out = []
    for target, (aliases, kind) in mapping.items():
        found = [clean[kind](F.col(f"`{known[clean_name(a)]}`")) for a in aliases if clean_name(a) in known]
        none = F.lit(None).cast({"text": "string", "int": "long"}.get(kind, "double"))
        out.append((F.coalesce(*found) if found else none).alias(target))
    return rows.select(*(keep or []), *out, F.to_json(F.struct("*")).alias("raw_json"))


def classify_files(spark: SparkSession, paths: list[str], rules: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """The best category of each file: name patterns (equal 100, start 70, inside 50), 10 for each known name in its own
    header, 150 where it has all of a category's; with the second score and the gap to it, and the file's rows."""
    header = header_names(F.col("header"))
    plain = lambda c: F.regexp_replace(F.translate(F.lower(c), "- .()", "___"), "__", "_")
    names = F.transform(header, plain)
    stem = F.regexp_replace(F.lower("source_file"), r"\.csv$", "")
    scores = []
    for category, (patterns, signals) in rules.items():
        met = F.size(F.array_intersect(names, F.array(*[F.lit(s) for s in signals]).cast("array<string>")))
        score = 10 * met + F.when((met == len(set(signals))) & (met > 1), 150).otherwise(0)
        for p in patterns:
            score = score + F.when(stem == p, 100).when(stem.startswith(p), 70).when(F.contains(stem, F.lit(p)), 50).otherwise(0)
        scores.append(F.struct(score.alias("score"), F.lit(category).alias("category")))
    counted = scan_csv(spark, paths, True).groupBy(F.col("source_file").alias("path")).agg(F.count(F.lit(1)).alias("rows_seen"))
    files = list_csv(spark, paths).select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), "header")
    ranked = _by_path(files.withColumn("ranked", F.sort_array(F.array(*scores), asc=False)), counted)
    best, second = F.col("ranked")[0], F.coalesce(F.get("ranked", F.lit(1))["score"], F.lit(0))
    confidence = F.when(best["score"] >= 150, "very_high").when(best["score"] >= 90, "high").when(best["score"] >= 50, "medium").when(best["score"] > 0, "low").otherwise("none")
    return ranked.select(
        "path", "source_file", F.coalesce("rows_seen", F.lit(0)).alias("rows_seen"), best["category"].alias("category"), best["score"].alias("score"), confidence.alias("confidence"),
        second.alias("second_score"), (best["score"] - second).alias("gap"),
    )
