"""Records with structured fields as flat text columns, for CSV, and back.

A field is (column, path, kind): `path` names a column of the record, or a place `structured.a.b` inside its VARIANT;
kind is text, int, float, bool or list. Flat values are text: lists joined by `;`, booleans as true and false, missing
values empty. `unflatten` turns them back and leaves empty ones out, so a record whose values are set survives the way
through a CSV file. Texts that hold `;` in a list, or that are empty, cannot be told apart afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"text": "string", "int": "bigint", "float": "double", "bool": "boolean", "list": "array<string>"}
ROOT = "structured"


def _value(path: str, kind: str) -> Column:
    if not path.startswith(f"{ROOT}."):
        return F.col(path)
    return F.try_variant_get(ROOT, "$." + path.split(".", 1)[1], KINDS[kind])


def flatten(records: DataFrame, fields: list[tuple[str, str, str]]) -> DataFrame:
    """A text column for each field, empty where the record has none."""
    shown = lambda v, kind: F.array_join(v, ";") if kind == "list" else v.cast("string")
    return records.select(*[F.coalesce(shown(_value(path, kind), kind), F.lit("")).alias(name) for name, path, kind in fields])


def _typed(name: str, kind: str) -> Column:
    text = F.nullif(F.trim(F.col(name)), F.lit(""))
    if kind == "list":
        return F.when(text.isNotNull(), F.filter(F.transform(F.split(text, ";"), F.trim), lambda x: x != ""))
    return F.lower(text).try_cast("boolean") if kind == "bool" else text.try_cast(KINDS[kind])


def unflatten(rows: DataFrame, fields: list[tuple[str, str, str]]) -> DataFrame:
    """Records again: plain columns by their kind, places under `structured` as one VARIANT."""
    plain = [_typed(name, kind).alias(path) for name, path, kind in fields if not path.startswith(f"{ROOT}.")]
    tree: dict = {}
    for name, path, kind in fields:
        if path.startswith(f"{ROOT}."):
            *way, leaf = path.split(".")[1:]
            at = tree
            for step in way:
                at = at.setdefault(step, {})
            at[leaf] = _typed(name, kind)

    def built(node: dict) -> Column:
        return F.struct(*[(built(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    whole = [F.parse_json(F.to_json(built(tree), {"ignoreNullFields": "true"})).alias(ROOT)] if tree else []
    return rows.select(*plain, *whole)


def template(spark: SparkSession, fields: list[tuple[str, str, str]]) -> DataFrame:
    """One example row: what each column takes."""
    example = {"text": "text", "int": "4", "float": "1.5", "bool": "true", "list": "one;two"}
    return spark.createDataFrame([[example[kind] for _, _, kind in fields]], ", ".join(f"`{name}` string" for name, _, _ in fields))
