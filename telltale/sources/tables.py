"""Readers: semicolon tables with decimal commas, merged and yearly tables, free-text reports, column roles and time columns."""

import json
import re
from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: Time formats that are tried in this order (fixed values).
FORMATS = ("dd.MM.yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")
#: Column roles by name (fixed values).
ROLES = {"pressure": r"press_\d+", "flow": r"flow_\d+", "level": r"t\d+", "demand": r"n\d+", "label": r"pipe_\d+_bin"}


def parse_time(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in FORMATS]).cast("timestamp_ntz")


def read_semicolon(spark: SparkSession, path: str, ts: str = "Timestamp") -> DataFrame:
    """`;`-separated text with decimal commas; header names are trimmed, values that don't parse become null."""
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return raw.select(parse_time(F.col(ts)).alias(ts), *[F.regexp_replace(F.trim(c), ",", ".").try_cast("double").alias(c) for c in raw.columns if c != ts])


def natural_key(name: str) -> list:
    return [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", name)]


def roles(columns: list[str]) -> dict[str, list[str]]:
    """Columns of each role, in natural order (press_2 before press_10)."""
    return {role: sorted((c for c in columns if re.fullmatch(p, c, re.IGNORECASE)), key=natural_key) for role, p in ROLES.items()}


def find_time_column(df: DataFrame, share: float = 0.8) -> str:
    """A column named after time or date, else the first, if at least `share` of its values parse; one aggregate for all."""
    names = [c for c in df.columns if re.search("time|date", c, re.IGNORECASE)] or df.columns[:1]
    got = df.agg(*[F.avg(parse_time(F.col(c).cast("string")).isNotNull().cast("double")).alias(c) for c in names]).first()
    for c in names:
        if (got[c] or 0) >= share:
            return c
    raise ValueError("no column holds times")


def drop_empty(df: DataFrame) -> DataFrame:
    """Without columns that are null in every row (NaN counts as null); one aggregate."""
    clean = df.select(*[F.nanvl(c, F.lit(None)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    n = clean.agg(*[F.count(c).alias(c) for c in clean.columns]).first()
    return clean.select(*[c for c in clean.columns if n[c]])


def leak_report(spark: SparkSession, path: str) -> DataFrame:
    """Closed intervals of a day around each ISO time found in free text, sorted."""
    found = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?"), F.lit(0))).alias("t"))
    t = found.select(F.coalesce(*[F.try_to_timestamp(F.replace("t", F.lit("T"), F.lit(" ")), F.lit(f)) for f in FORMATS[1:]]).cast("timestamp_ntz").alias("t")).where("t is not null")
    return t.select((F.col("t") - F.expr("INTERVAL 1 DAY")).alias("start_ts"), (F.col("t") + F.expr("INTERVAL 1 DAY")).alias("end_ts")).orderBy("start_ts")


def label_columns(df: DataFrame, pipes: list[str]) -> DataFrame:
    """Binary columns, total magnitude, count and any-leak flag from magnitudes; null is 0."""
    v = [F.coalesce(F.col(c), F.lit(0.0)) for c in pipes]
    count = sum(((x > 0).cast("int") for x in v), F.lit(0))
    return df.select("*", *[(x > 0).cast("int").alias(f"{c}_bin") for c, x in zip(pipes, v, strict=True)], sum(v, F.lit(0.0)).alias("leak_mag_total"), count.alias("leak_count"), (count > 0).cast("int").alias("leak_binary"))


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Parquet, csv (with header) or json, in parts."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).format(form).save(path)


def numeric_columns(df: DataFrame, ts: str) -> DataFrame:
    """The time and the columns of a numeric type."""
    return df.select(ts, *[f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != ts])


def read_scada(spark: SparkSession, path: str, ts: str | None = None) -> DataFrame:
    """A comma-separated table with inferred types: the time (found if not given, named `ts`) and its numeric columns."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    ts = ts or find_time_column(raw)
    return numeric_columns(raw.withColumn("ts", parse_time(F.col(ts).cast("string"))).drop(*({ts} - {"ts"})), "ts")


def read_merged(spark: SparkSession, path: str, ts: str | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """A merged table (csv or parquet): every column as a number, columns without any value left out; and the roles of the columns."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    ts = ts or find_time_column(raw)
    t = raw.select(parse_time(F.col(ts).cast("string")).alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in raw.columns if c != ts])
    t = drop_empty(t)
    return t, column_groups(t.columns)


def read_parsed(spark: SparkSession, path: str, ts: str = "Timestamp") -> DataFrame:
    """A table as it is, with its time parsed and named `ts`; neither coerced nor freed of duplicates. Order is for who writes it."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return raw.withColumn("ts", parse_time(F.col(ts).cast("string"))).drop(*({ts} - {"ts"}))


def read_split(spark: SparkSession, root: str, year: int, how: str = "full", parts=("Pressures", "Flows", "Levels", "Demands")) -> DataFrame:
    """The tables of a year (<year>_SCADA_<part>.csv) that are there, each with its first row of a time, aligned on the time."""
    from telltale.operators import panel

    found = []
    for part in parts:
        try:
            t = read_semicolon(spark, f"{root.rstrip('/')}/{year}_SCADA_{part}.csv").withColumnRenamed("Timestamp", "ts")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        values = [c for c in t.columns if c != "ts"]
        # rows of one time: the one that lies first in the file
        first = t.withColumn("__at", F.monotonically_increasing_id()).groupBy("ts").agg(F.min_by(F.struct(*values), "__at").alias("x"))
        found.append(first.select("ts", "x.*"))
    if not found:
        raise ValueError(f"no table of {year} under {root}")
    return panel.align(found, "ts", how)


def prepare(df: DataFrame, ts: str, order: list) -> DataFrame:
    """One row for each time (the first by `order`), all other columns as numbers, those without any value left out."""
    from telltale.operators import panel

    t = panel.dedupe_first(df, [ts], order)
    return drop_empty(t.select(ts, *[F.col(c).try_cast("double").alias(c) for c in df.columns if c != ts]))


def column_groups(columns: list[str], given: dict[str, list[str]] | None = None, noted: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Columns of each role: as given, else as noted with the data, else by name. Pressures and flows must be there, and all named columns too."""
    found = roles(columns)
    out = {role: list((given or {}).get(role) or (noted or {}).get(role) or found[role]) for role in ROLES}
    missing = [c for cs in out.values() for c in cs if c not in columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    for role in ("pressure", "flow"):
        if not out[role]:
            raise ValueError(f"no {role} columns")
    return out


def role_of(name: Column) -> Column:
    """A column's role by its name, `other` where none fits."""
    role = F.lit(None).cast("string")
    for known, pattern in ROLES.items():
        role = F.coalesce(role, F.when(name.rlike(f"(?i)^(?:{pattern})$"), known))
    return F.coalesce(role, F.lit("other"))


def role_table(spark: SparkSession, columns: list[str]) -> DataFrame:
    """name, role of columns."""
    return spark.createDataFrame([(c,) for c in columns], "name string").select("name", role_of(F.col("name")).alias("role"))


def detail_columns(sensors: list[str], columns: list[str]) -> dict[str, str]:
    """The column of a wide evidence table that tells of each sensor: its own name, else the shortest (then the first by name) that has the name in it.

    If fewer than half of the sensors find one, only columns of the very names count.
    """
    found = {}
    for sensor in sensors:
        like = [c for c in columns if sensor in c]
        if like:
            found[sensor] = min(like, key=lambda c: (c != sensor, len(c), c))
    if len(found) >= max(1, len(sensors) // 2):
        return found
    return {c: c for c in columns if c in sensors}


def evidence_long(wide: DataFrame, sensors: list[str]) -> DataFrame:
    """series, ts, evidence of a wide evidence table, whose columns are found by the sensors' names."""
    told = detail_columns(sensors, [c for c, kind in wide.dtypes if c != "ts" and kind not in ("string", "boolean")])
    rows = F.array(*[F.struct(F.lit(s).alias("series"), F.col(f"`{c}`").cast("double").alias("evidence")) for s, c in sorted(told.items())])
    return wide.select("ts", F.explode(rows.cast("array<struct<series:string,evidence:double>>")).alias("x")).select("x.series", "ts", "x.evidence")


def renamed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Columns by their place: <prefix>_1, <prefix>_2 and so on; those in `keep` stay."""
    n, names = 0, []
    for c in df.columns:
        n += c not in keep
        names.append(c if c in keep else f"{prefix}_{n}")
    return df.toDF(*names)


def pipe_names(bits: Column, names: list[str]) -> Column:
    """Names whose bit is 1, joined by commas; `no_leak` if none is."""
    on = F.filter(F.array(*[F.when(F.substring(bits, i, 1) == "1", F.lit(n)) for i, n in enumerate(names, 1)]), lambda x: x.isNotNull())
    return F.when(F.size(on) > 0, F.array_join(on, ", ")).otherwise("no_leak")


def any_leak(df: DataFrame, pipes: list[str]) -> Column:
    """Whether a row has a real leak: by the pipes, the count or the magnitude, whatever of them there is; by leak_binary only if none is."""
    known = []
    if pipes:
        known.append(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in pipes), F.lit(0.0)) > 0)
    known += [F.coalesce(F.col(c), F.lit(0)) > 0 for c in ("leak_count", "leak_mag_total") if c in df.columns]
    if not known:
        known = [F.coalesce(F.col("leak_binary"), F.lit(0)) > 0] if "leak_binary" in df.columns else [F.lit(False)]
    out = known[0]
    for k in known[1:]:
        out = out | k
    return out


def known_intervals(df: DataFrame, pipes: list[str], min_rows: int = 1, pad_seconds: tuple[int, int] = (0, 0)) -> DataFrame:
    """Closed intervals of the rows with a real leak, padded."""
    from telltale.operators import sequence

    marked = df.select("ts", any_leak(df, pipes).cast("int").alias("leak")).withColumn("series", F.lit("all"))
    return sequence.islands(marked, "leak", min_rows, pad_seconds)


def in_year(df: DataFrame, year: int) -> DataFrame:
    """Rows of a year, as a range of times, which reaches the scan."""
    return df.where((F.col("ts") >= F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")) & (F.col("ts") < F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp_ntz")))


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from start to end, both inclusive."""
    return df.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are numbers: neither null, NaN nor infinite."""
    out = df
    for c in columns:
        x = F.col(c).cast("double")
        out = out.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return out


def require_rows(df: DataFrame, least: int, otherwise: DataFrame | None = None) -> DataFrame:
    """df if it has `least` rows, else the other frame, else an error."""
    if df.limit(least).count() >= least:
        return df
    if otherwise is None:
        raise ValueError(f"fewer than {least} rows")
    return otherwise


def settings_from_json(path_or_text: str, base, spark: SparkSession | None = None):
    """Settings with the values that a JSON object gives; other keys are an error. With Spark the first argument is a path, in any store that Spark reads."""
    text = "".join(r[0] for r in spark.read.text(path_or_text, wholetext=True).collect()) if spark else path_or_text
    given = json.loads(text)
    known = {f.name for f in fields(base)}
    if extra := sorted(set(given) - known):
        raise ValueError(f"unknown settings: {extra}")
    return replace(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def candidate_summaries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All *_summary.json and *_memory.csv of a folder, each row with its file's name; an error if there are none."""
    try:
        s = spark.read.option("multiLine", True).json(f"{folder.rstrip('/')}/*_summary.json")
        m = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder.rstrip('/')}/*_memory.csv")
    except AnalysisException as e:
        raise ValueError(f"no summaries in {folder}") from e
    name = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
    return s.select("*", name), m.select("*", name)


def first_path(spark: SparkSession, candidates: list[str]) -> str:
    """The first path that is there, in whatever store it names."""
    for path in candidates:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(str(candidates))


#: Published figures of the full two-stage detector that compact forms are compared with (fixed values; others are given by a JSON object).
BASELINE = {"precision": 0.0, "recall": 0.0}


def baseline_metrics(spark: SparkSession, path: str | None = None) -> DataFrame:
    """metric, value: the figures of a JSON object, or none known (zeros) without one."""
    given = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) if path else BASELINE
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(given.items()) if isinstance(v, (int, float))], "metric string, value double")
