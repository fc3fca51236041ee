"""The graph contract as a JSON file: entity types, and the types that each relation joins."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_CONTRACT = "struct<entity_types:map<string,struct<vertex_type:string>>,relationships:map<string,struct<source_type:string,target_type:string>>>"


class BadContract(ValueError):
    pass


def to_json(types, relations: dict[str, tuple[str, str]]) -> str:
    return json.dumps({"entity_types": {t: {"vertex_type": t} for t in types}, "relationships": {r: {"source_type": s, "target_type": t} for r, (s, t) in relations.items()}})


def load(spark: SparkSession, path: str) -> tuple[tuple[str, ...], dict[str, tuple[str, str]]]:
    """(entity types, relations) of a contract, one JSON object in one file.

    A file that is no such object, has no types or no relations, a type without a vertex type and a relation
    that joins a type which isn't there are errors.
    """
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", _CONTRACT).alias("c")).select("c.*").head(2)
    if len(rows) != 1 or not rows[0].entity_types or not rows[0].relationships:
        raise BadContract(f"{path} must define entity_types and relationships")
    types, relations = rows[0].entity_types, rows[0].relationships
    for name, kind in types.items():
        if kind is None or not kind.vertex_type:
            raise BadContract(f"{name} has no vertex type")
    for name, ends in relations.items():
        if ends is None or ends.source_type not in types or ends.target_type not in types:
            raise BadContract(f"{name} joins unknown types")
    return tuple(types), {name: (ends.source_type, ends.target_type) for name, ends in relations.items()}
