"""What a run leaves: tables, JSON, text and C headers under one folder, with a manifest of all of them."""

import dataclasses
import json
from datetime import date, datetime
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.operators import export


def plain(value):
    """What JSON has no form for: dataclasses, times, paths, and numbers of other libraries."""
    if dataclasses.is_dataclass(value):
        return dataclasses.asdict(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (PurePath, set, frozenset)):
        return str(value) if isinstance(value, PurePath) else sorted(value)
    if hasattr(value, "tolist"):
        return value.tolist()
    raise TypeError(type(value).__name__)


def markdown(df: DataFrame, rows: int = 50) -> str:
    """The first rows of a table (a report, not data) as Markdown."""
    show = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.limit(rows).collect()]) + "\n"


class Run:
    """A folder of artifacts in any store that Spark writes to; each is noted in a manifest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), []

    def note(self, name: str, kind: str, about: str) -> None:
        self.made.append((name, kind, about))

    def table(self, df: DataFrame, name: str, about: str = "", form: str = "parquet", report: bool = False) -> None:
        """A table in parts (parquet, csv or json), with a Markdown twin of its first rows if it is a report."""
        df.write.mode("overwrite").option("header", True).format(form).save(f"{self.folder}/{name}")
        self.note(name, form, about)
        if report:
            self.text(markdown(df), f"{name}.md", about)

    def text(self, text: str, name: str, about: str = "") -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}")
        self.note(name, "text", about)

    def json(self, value, name: str, about: str = "") -> None:
        self.text(json.dumps(value, default=plain, indent=2, sort_keys=True), name, about)

    def read_text(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/{name}", wholetext=True).collect())

    def manifest(self) -> DataFrame:
        """name, kind, about: in order of names."""
        return self.spark.createDataFrame(sorted(self.made), "name string, kind string, about string")

    def close(self, title: str, sections: dict[str, str]) -> None:
        """Writes the report (sections one after the other) and the manifest."""
        self.text(f"# {title}\n\n" + "\n".join(f"## {k}\n\n{v}\n" for k, v in sections.items()), "report.md", "what was done")
        m = self.manifest()
        m.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{self.folder}/manifest")


def parameters(fitted) -> dict:
    """All that a compact detector needs to run: slot tables, scales, pair lines, thresholds and settings. A few rows for each series."""
    tables: dict = {}
    for r in fitted.profile.orderBy("series", "slot").collect():
        tables.setdefault(r["series"], []).append(r["location"])
    lines = [r.asDict() for r in fitted.models.orderBy("target", "anchor").select("target", "anchor", "slope", "intercept", "sigma").collect()]
    return {"settings": dataclasses.asdict(fitted.settings), "tables": tables, "scales": {r["series"]: r["scale"] for r in fitted.scales.collect()}, "pairs": lines, "thresholds": fitted.thresholds}


def metadata(fitted) -> dict:
    """Settings, thresholds and the columns that were used."""
    return {"settings": dataclasses.asdict(fitted.settings), "thresholds": fitted.thresholds, "allowance": fitted.allowance, "series": sorted(r[0] for r in fitted.profile.select("series").distinct().collect())}


def stage1_header(fitted) -> str:
    """A C header: each series' slot table as 16-bit integers with its scale, and the thresholds."""
    q = export.quantise(fitted.profile, "series", "location")
    parts = ["#pragma once", "#include <stdint.h>"]
    for r in q.select("series").distinct().orderBy("series").collect():
        one = q.where(F.col("series") == r["series"])
        parts.append(export.c_array(one, "slot", "q", f"table_{r['series']}").first()["text"])
        parts.append(f"static const float table_{r['series']}_scale = {one.first()['scale']:.9g}f;")
    parts += [f"static const float threshold_{k} = {v:.9g}f;" for k, v in sorted(fitted.thresholds.items())]
    return "\n".join(parts) + "\n"


def stage2_header(heads: dict[str, tuple[list[str], list[float], float]]) -> str:
    """A C header of linear heads: name to (features, raw coefficients, intercept)."""
    parts = ["#pragma once"]
    for name, (features, weights, intercept) in sorted(heads.items()):
        parts.append(f"/* {name}: {', '.join(features)} */")
        parts.append(f"static const float {name}_w[{len(weights)}] = {{{', '.join(f'{w:.9g}f' for w in weights)}}};")
        parts.append(f"static const float {name}_b = {intercept:.9g}f;")
    return "\n".join(parts) + "\n"
