"""Registries for what users add: parsers, recognizers, fusions, embedders, sources, schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


class Plugins:
    """Named entries in order of registration; a name is taken once unless `overwrite` is given."""

    def __init__(self, kind: str):
        self.kind = kind
        self._entries: dict[str, Any] = {}

    def register(self, name: str, entry: Any, overwrite: bool = False) -> Any:
        if not overwrite and name in self._entries:
            raise ValueError(f"{self.kind} registered twice: {name}")
        self._entries[name] = entry
        return entry

    def get(self, name: str) -> Any:
        if name not in self._entries:
            raise KeyError(f"unknown {self.kind}: {name}; known: {', '.join(self._entries)}")
        return self._entries[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def __contains__(self, name: str) -> bool:
        return name in self._entries


parsers, recognizers, fusions, embedders, sources, schemas = (Plugins(k) for k in ("parser", "recognizer", "fusion", "embedder", "source", "schema"))


def recognize(files: DataFrame, names: list[str] | None = None) -> DataFrame | None:
    """Union of what the recognizers find in files, each over all of them, in order."""
    found: DataFrame | None = None
    for name in names or list(recognizers):
        part = recognizers.get(name)(files)
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def embed(df: DataFrame, name: str, text: str, into: str = "vector") -> DataFrame:
    """Vectors by a registered embedder (Column -> Column), each different text once."""
    from pyspark.sql import functions as F

    embedder: Callable = embedders.get(name)
    distinct = df.select(text).distinct().withColumn(into, embedder(F.col(text)))
    return df.join(distinct, text, "left")


def register_schema(name: str, schema: StructType) -> StructType:
    return schemas.register(name, schema)


def _defaults() -> None:
    from lodestrand.functions.chunking import hashed_vector
    from lodestrand.functions.syntax import PARSERS
    from lodestrand.operators.search import FUSIONS
    from lodestrand.sources import files

    for name in ("routes", "injections", "queried_objects", "imported_names", "class_bases"):
        recognizers.register(name, getattr(files, name))
    for name, fusion in FUSIONS.items():
        fusions.register(name, fusion)
    embedders.register("hashed", hashed_vector)
    for name, parser in PARSERS.items():
        parsers.register(name, parser)


_defaults()
