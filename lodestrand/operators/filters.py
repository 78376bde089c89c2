"""Filter trees, compiled to Spark columns so that Catalyst pushes them into the scan."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
}
SIGNS = {"=": "eq", "==": "eq", "!=": "ne", "<>": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "LIKE": "like", "ILIKE": "ilike", "IN": "in", "NOT IN": "not_in", "IS NULL": "is_null", "IS NOT NULL": "is_not_null"}
_FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")
_SAFE_PATTERN = re.compile(r"\([^()]*[+*][^()]*\)[+*{]")


def checked_field(name: str) -> str:
    """The name, if it consists of dotted identifiers."""
    if not isinstance(name, str) or not _FIELD.fullmatch(name):
        raise ValueError(f"not a field name: {name!r}")
    return name


def checked_value(value: Any) -> Any:
    if value is not None and not isinstance(value, (str, int, float, bool)):
        raise TypeError(f"a filter compares with strings, numbers, booleans or None, not {type(value).__name__}")
    return value


@dataclass(frozen=True)
class Filter:
    """A node: a comparison of `field`, or a conjunction, disjunction or negation of `parts`.

    Comparisons follow SQL's three-valued logic: a null field makes them unknown. An empty `in` is false and an empty
    `not_in` true. Conjunctions and disjunctions of nothing are true and false.
    """

    op: str
    field: str | None = None
    value: Any = None
    parts: tuple[Filter, ...] = ()

    def __post_init__(self) -> None:
        if self.op in ("and", "or", "not"):
            if self.field is not None or not all(isinstance(p, Filter) for p in self.parts) or (self.op == "not" and len(self.parts) != 1):
                raise ValueError(f"{self.op} takes filters only")
            return
        checked_field(self.field)
        if self.op in ("in", "not_in"):
            for v in self.value:
                checked_value(v)
        elif self.op in ("is_null", "is_not_null"):
            if self.value is not None:
                raise ValueError(f"{self.op} takes no value")
        elif self.op in COMPARISONS:
            checked_value(self.value)
            if self.value is None or (self.op in ("like", "ilike") and not isinstance(self.value, str)):
                raise ValueError(f"{self.op} can't compare with {self.value!r}")
        else:
            raise ValueError(f"unknown operator: {self.op!r}")

    def column(self, two_valued: bool = False) -> Column:
        """As a Column; two_valued: unknown comparisons count as false, before any negation around them."""
        if self.op == "and":
            return reduce(lambda a, b: a & b, (p.column(two_valued) for p in self.parts), F.lit(True))
        if self.op == "or":
            return reduce(lambda a, b: a | b, (p.column(two_valued) for p in self.parts), F.lit(False))
        if self.op == "not":
            return ~self.parts[0].column(two_valued)
        field = F.col(self.field)
        if self.op == "is_null":
            return field.isNull()
        if self.op == "is_not_null":
            return field.isNotNull()
        if self.op in ("in", "not_in"):
            inside = field.isin(list(self.value)) if self.value else F.lit(False)
            test = inside if self.op == "in" else ~inside
        else:
            test = COMPARISONS[self.op](field, self.value)
        return F.coalesce(test, F.lit(False)) if two_valued else test

    def __and__(self, other: Filter) -> Filter:
        return all_of(self, other)

    def __or__(self, other: Filter) -> Filter:
        return any_of(self, other)

    def __invert__(self) -> Filter:
        return Filter("not", parts=(self,))


def where(field: str, sign: str, value: Any = None) -> Filter:
    """A comparison by SQL sign or operator name."""
    op = SIGNS.get(sign.upper() if isinstance(sign, str) else sign, sign)
    return Filter(op, field, tuple(value) if op in ("in", "not_in") else value)


def all_of(*filters: Filter | None) -> Filter:
    """Conjunction; None parts are left out, nested conjunctions flattened."""
    parts = [q for f in filters if f is not None for q in (f.parts if f.op == "and" else (f,))]
    return parts[0] if len(parts) == 1 else Filter("and", parts=tuple(parts))


def any_of(*filters: Filter | None) -> Filter:
    parts = [q for f in filters if f is not None for q in (f.parts if f.op == "or" else (f,))]
    return parts[0] if len(parts) == 1 else Filter("or", parts=tuple(parts))


def from_dict(spec: dict[str, Any] | Filter | None) -> Filter:
    """A filter written as a dict: keys joined by and; value None tests for null, a list for membership, a tuple
    (sign, value) compares; keys AND and OR take lists of dicts, NOT a dict."""
    if isinstance(spec, Filter):
        return spec
    parts = []
    for key, value in (spec or {}).items():
        if key.upper() in ("AND", "OR"):
            inner = [from_dict(v) for v in (value if isinstance(value, (list, tuple)) else [value])]
            parts.append(Filter(key.lower(), parts=tuple(inner)))
        elif key.upper() == "NOT":
            parts.append(~from_dict(value))
        elif value is None:
            parts.append(Filter("is_null", key))
        elif isinstance(value, (list, set, frozenset)):
            parts.append(where(key, "IN", list(value)))
        elif isinstance(value, tuple):
            parts.append(where(key, *value))
        else:
            parts.append(Filter("eq", key, value))
    return all_of(*parts)


def escaped_like(text: str) -> str:
    """A LIKE pattern that matches the text itself."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def safe_pattern(pattern: str, longest: int = 200) -> bool:
    """Whether a regular expression is short, valid and free of nested repetition."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return len(pattern) <= longest and not _SAFE_PATTERN.search(pattern)


def in_project(df: DataFrame, projects: str | Iterable[str]) -> DataFrame:
    """Rows of one or several projects; naming none gives none."""
    names = [projects] if isinstance(projects, str) else list(projects)
    return df.filter(where("project_id", "IN", names).column())


def query(df: DataFrame, filters: dict | Filter | None = None, projects: str | Iterable[str] | None = None, order: list[str] | None = None, limit: int | None = None, offset: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Filter, sort (field or -field), offset, limit, project: in that order, so a limit cuts sorted rows.

    With a limit or an offset ties are broken by id, so that the same rows come out each time.
    """
    if projects is not None:
        df = in_project(df, projects)
    df = df.filter(from_dict(filters).column())
    keys = [F.col(checked_field(k.lstrip("-"))).desc_nulls_last() if k.startswith("-") else F.col(checked_field(k)).asc_nulls_first() for k in order or []]
    if limit is not None or offset:
        if (limit is not None and limit < 0) or offset < 0:
            raise ValueError("limit and offset can't be negative")
        names = {k.lstrip("-") for k in order or []}
        keys += [F.col("id")] if "id" in df.columns and "id" not in names else []
    if keys:
        df = df.orderBy(*keys)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    if columns:
        df = df.select(*dict.fromkeys((["id"] if "id" in df.columns else []) + [checked_field(c) for c in columns]))
    return df


def path_matches(path: Column, wanted: str) -> Column:
    """Whether a path equals, ends with or contains `wanted`, slashes evened out."""
    plain = F.regexp_replace(path, r"\\", "/")
    wanted = wanted.replace("\\", "/").strip("/")
    return (plain == wanted) | plain.endswith("/" + wanted) | plain.contains(wanted)


def name_matches(name: Column, pattern: str) -> Column:
    """Glob (with * or ?), anchored regular expression (^ or $), or substring, without regard to case."""
    if pattern.startswith("^") or pattern.endswith("$"):
        if not safe_pattern(pattern):
            raise ValueError(f"unsafe pattern: {pattern!r}")
        return name.rlike("(?i)" + pattern)
    if "*" in pattern or "?" in pattern:
        return F.lower(name).like(escaped_like(pattern.lower()).replace("*", "%").replace("?", "_"))
    return F.lower(name).contains(pattern.lower())


def list_entities(entities: DataFrame, projects: str | Iterable[str] | None = None, kind: str | None = None, path: str | None = None, pattern: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of entities, one row per id, ordered by name and id, each with the total before paging (total, has_more)."""
    df = in_project(entities, projects) if projects is not None else entities
    if kind is not None:
        df = df.filter(F.lower(F.trim("type")) == kind.lower())
    if path:
        df = df.filter(path_matches(F.col("file_path"), path))
    if pattern:
        df = df.filter(name_matches(F.col("name"), pattern))
    df = df.groupBy("id").agg(F.min(F.struct("name", F.lower(F.trim("type")).alias("type"), "file_path", "project_id")).alias("e")).select("id", "e.*")
    total = df.agg(F.count("*").alias("total"))
    page = df.orderBy("name", "id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # total is one row


def fetch(tables: list[DataFrame], ids: list[str], content: bool = True) -> DataFrame:
    """Up to 100 ids looked up in several tables, the first table that has an id wins; unknown ids come out with found false."""
    ids = list(dict.fromkeys(ids))
    if not 0 < len(ids) <= 100:
        raise ValueError("between 1 and 100 ids")
    spark = tables[0].sparkSession
    wanted = spark.createDataFrame([(x,) for x in ids], "id string")
    rows = None
    for place, df in enumerate(tables):
        text = F.col("content") if content and "content" in df.columns else F.lit(None).cast("string")
        part = df.filter(F.col("id").isin(ids)).select("id", F.lit(place).alias("place"), "file_path", "project_id", text.alias("content"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("id").agg(F.min(F.struct("place", "file_path", "project_id", "content")).alias("r"))
    return wanted.join(best, "id", "left").select("id", F.col("r").isNotNull().alias("found"), "r.place", "r.file_path", "r.project_id", "r.content")
