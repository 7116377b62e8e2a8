"""Record files: CSV, JSON and YAML in any mixture, read by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys under which a file may keep its list of records.
WRAPPERS = ("records", "items", "data", "courses", "faq")
RECORD = "source string, position int, record string"


def sniff(name: str, head: str) -> str:
    """csv, json or yaml by suffix, else by the first characters."""
    suffix = name.rsplit(".", 1)[-1].lower()
    known = {"csv": "csv", "json": "json", "yaml": "yaml", "yml": "yaml"}
    if suffix in known:
        return known[suffix]
    head = head.lstrip("﻿ \t\r\n")
    return "json" if head[:1] in ("[", "{") else "yaml" if head[:1] == "-" or ":" in head.split("\n", 1)[0] and "," not in head.split("\n", 1)[0] else "csv"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header lowered and trimmed, values trimmed, rows without title and slug dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, escape='"')
    df = df.toDF(*[c.strip("﻿ ").lower() for c in df.columns])
    named = [F.nullif(F.col(c), F.lit("")) for c in ("title", "slug") if c in df.columns]
    return df.filter(F.coalesce(*named).isNotNull()) if named else df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, plain or under one of the wrapper keys."""
    df = spark.read.json(path, multiLine=True)
    for key in WRAPPERS:
        if df.columns == [key] or (key in df.columns and dict(df.dtypes)[key].startswith("array<struct")):
            return df.select(F.explode(key).alias("r")).select("r.*")
    return df


def records_of(name: str, content: bytes, kind: str | None = None) -> list[dict]:
    import csv
    import io
    import json

    text = content.decode("utf-8-sig")
    kind = kind or sniff(name, text[:200])
    if kind == "csv":
        out = []
        for row in csv.DictReader(io.StringIO(text)):
            clean = {(k or "").strip().lower(): (v or "").strip() for k, v in row.items() if isinstance(v, str) or v is None}
            if clean.get("title") or clean.get("slug"):
                out.append(clean)
        return out
    if kind == "json":
        loaded = json.loads(text)
    else:
        try:
            import yaml
        except ModuleNotFoundError as missing:
            raise RuntimeError("reading YAML needs the yaml package") from missing
        loaded = yaml.safe_load(text)
    if isinstance(loaded, dict):
        loaded = next((loaded[k] for k in WRAPPERS if isinstance(loaded.get(k), list)), [loaded])
    return [r for r in loaded or [] if isinstance(r, dict)]


def read_folder(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Every file below a folder, sorted: source (`seed:` and name), position, record as JSON. `kind` names a format.

    A file that can't be read gives one row with position -1 and its error, and does not stop the rest.
    """
    import json

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for full, content in zip(batch.path, batch.content, strict=True):
                name = full.rsplit("/", 1)[-1]
                try:
                    found = records_of(name, bytes(content), kind)
                    rows += [(f"seed:{name}", i, json.dumps(r, sort_keys=True, default=str, ensure_ascii=False)) for i, r in enumerate(found)]
                except (ValueError, RuntimeError) as bad:
                    rows.append((f"seed:{name}", -1, json.dumps({"error": str(bad)[:200]})))
            yield pd.DataFrame(rows, columns=["source", "position", "record"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(work, RECORD).orderBy("source", "position")


def write_csv(df: DataFrame, path: str) -> None:
    """Flat export: arrays joined by ;, booleans as words."""
    columns = [F.array_join(c, ";").alias(c) if kind.startswith("array") else F.col(c).cast("string").alias(c) for c, kind in df.dtypes]
    df.select(columns).write.csv(path, header=True, escape='"')
