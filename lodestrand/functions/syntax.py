"""Parsing source files and documents into elements, a batch of files at a time.

Python is parsed by its own grammar, languages with braces by a tokenizer that knows strings, comments and nesting, Markdown
by its headings; anything else is text. A file that can't be parsed falls back to text.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts up to so many characters stay whole when nothing is known about them.
WHOLE, WINDOW = 8_192, 80
_SIGNATURE = re.compile(
    r"^[ \t]*(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|pub(?:\([^)]*\))?|unsafe|const|open|suspend)\s+)*"
    r"(?:(?P<kind>class|interface|struct|enum|trait|impl)\s+(?P<type>[A-Za-z_]\w*)|(?:(?:function\*?|func|fn|def|fun)\s+(?:\([^)]*\)\s*)?|(?:[\w<>\[\],.?&*:]+\s+)+)(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\([^;{}]*\)[^;{}=]*\{)",
    re.M,
)
_SKIP = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/', re.S)
_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*\s*\.\s*)*[A-Za-z_]\w*)\s*\(")
_NO_CALL = frozenset("if for while switch catch return function def class elif with assert and or not in print super match".split())

Element = tuple[str, str, int, int, str, str]  # type, name, first and last line, text, parent


def python_elements(text: str) -> list[Element]:
    lines = text.split("\n")
    out: list[Element] = []

    def visit(node: ast.AST, parent: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parent and out and isinstance(node, ast.ClassDef) else "function"
                out.append((kind, child.name, first, child.end_lineno or first, "\n".join(lines[first - 1 : child.end_lineno]), parent))
                visit(child, child.name)
            else:
                visit(child, parent)

    visit(ast.parse(text), "")
    return out


def braced_elements(text: str) -> list[Element]:
    plain = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    lines, out, open_ends = text.split("\n"), [], []
    for m in _SIGNATURE.finditer(plain):
        name = m.group("type") or m.group("name")
        if name in _NO_CALL:
            continue
        start = plain.find("{", m.end() - 1)
        if start < 0:
            continue
        depth, at = 0, start
        for b in re.finditer(r"[{}]", plain[start:]):
            depth += 1 if b.group() == "{" else -1
            at = start + b.start()
            if not depth:
                break
        first, last = plain.count("\n", 0, m.start() + len(m.group()) - len(m.group().lstrip())) + 1, plain.count("\n", 0, at) + 1
        open_ends = [(n, k, e) for n, k, e in open_ends if e > m.start()]
        parent, around = (open_ends[-1][0], open_ends[-1][1]) if open_ends else ("", "")
        kind = "class" if m.group("type") else "method" if around == "class" else "function"
        out.append((kind, name, first, last, "\n".join(lines[first - 1 : last]), parent))
        open_ends.append((name, kind, at))
    return out


def markdown_elements(text: str) -> list[Element]:
    """A section for each heading, its parent the headings above it; text before the first has no name."""
    out, path, lines, start, name, fenced = [], [], text.split("\n"), 1, "", False

    def close(last: int) -> None:
        body = "\n".join(lines[start - 1 : last])
        if body.strip():
            out.append(("section", name, start, last, body, " > ".join(t for _, t in path[:-1])))

    for i, line in enumerate(lines, 1):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else re.match(r"(#{1,6})\s+(.*)", line)
        if m:
            close(i - 1)
            path = [p for p in path if p[0] < len(m.group(1))] + [(len(m.group(1)), m.group(2).strip("# \r"))]
            start, name = i, path[-1][1]
    close(len(lines))
    return out


def text_elements(text: str) -> list[Element]:
    """The whole text, or windows of lines where it is long."""
    lines = text.split("\n")
    if len(text) <= WHOLE:
        return [("text", "", 1, len(lines), text, "")] if text.strip() else []
    return [("text", "", i + 1, min(i + WINDOW, len(lines)), "\n".join(lines[i : i + WINDOW]), "") for i in range(0, len(lines), WINDOW)]


PARSERS: dict[str, Callable[[str], list[Element]]] = {"python": python_elements, "markdown": markdown_elements} | dict.fromkeys(("javascript", "typescript", "java", "go", "rust", "c", "cpp", "csharp", "kotlin", "swift", "php", "scala", "apex"), braced_elements)


def calls_of(text: str) -> list[str]:
    """Names called in a text, in order, each once; a receiver stays with its name."""
    plain = re.sub(r"#[^\n]*", "", _SKIP.sub('""', text))
    return [c for c in dict.fromkeys(re.sub(r"\s", "", m) for m in _CALL.findall(plain)) if c not in _NO_CALL]


_SCHEMA = "path string, element_type string, element_name string, line_start int, line_end int, content string, parent string, calls array<string>"


def _parser(parsers: dict[str, Callable[[str], list[Element]]]):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.list_(pa.string())]
        for batch in batches:
            out: list[tuple] = []
            for path, text, language in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = text or ""
                try:
                    found = parsers.get((language or "").lower(), text_elements)(text) or text_elements(text)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    found = text_elements(text)
                out += [(path, *e, [c for c in calls_of(e[4]) if c != e[1] or len(re.findall(rf"\b{re.escape(c)}\s*\(", e[4])) > 1] if e[0] in ("function", "method") else []) for e in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

    return parse


def elements(files: DataFrame, parsers: dict[str, Callable[[str], list[Element]]] | None = None) -> DataFrame:
    """Elements of files (path, text, language): path, element_type, element_name, line_start, line_end, content, parent, calls.

    parsers: more or other parsers by language. Null and blank texts have no elements; names and calls aren't resolved here."""
    return files.select("path", "text", "language").mapInArrow(_parser(PARSERS | (parsers or {})), _SCHEMA)


def grouped(rows: DataFrame, gap: int = 5, most: int = 5) -> DataFrame:
    """Elements with the group they belong to: neighbours of a file less than `gap` lines apart or with one parent, `most` at
    most to a group. The rule depends on what a group already holds, so each file's list is folded; a file is one list."""
    item = F.struct("line_start", "line_end", "element_name", "parent")
    lists = rows.groupBy("path").agg(F.sort_array(F.collect_list(item)).alias("x"))
    begin = F.struct(F.lit(0).alias("g"), F.lit(0).alias("n"), F.lit(-1_000_000).alias("end"), F.lit("").alias("parent"), F.array().cast("array<struct<g:int,line_start:int,element_name:string>>").alias("out"))

    def step(s, e):
        near = (s["n"] > 0) & (s["n"] < most) & ((e["line_start"] - s["end"] < gap) | ((e["parent"] != "") & (e["parent"] == s["parent"])))
        g = F.when(near, s["g"]).otherwise(s["g"] + 1)
        return F.struct(g.alias("g"), F.when(near, s["n"] + 1).otherwise(1).alias("n"), e["line_end"].alias("end"), e["parent"].alias("parent"), F.concat(s["out"], F.array(F.struct(g.alias("g"), e["line_start"].alias("line_start"), e["element_name"].alias("element_name")))).alias("out"))

    return lists.select("path", F.explode(F.aggregate("x", begin, step, lambda s: s["out"])).alias("e")).select("path", F.col("e.g").alias("group"), "e.line_start", "e.element_name")
