"""Functions paired with their documentation.

Each source is parsed to a syntax tree: Python by its own grammar, languages with braces by a tokenizer that knows
strings, comments and nesting, so that a function node has its name, exact source range and attached documentation.
Nodes meet the entities of their file by name and line. A function counts by the comment attached to its node, provided its
docstring, which its parser took from the source, says so too; where there is no node or the comment is torn, by the
docstring alone. Documentation is cleaned of
comment signs, markup, tags, parameter lists and tool directives; a sentence counts only by words that are neither the
function's own name nor filler, and a function none of whose sentences counts is dropped.
"""

from __future__ import annotations

import ast
import html
import re
import textwrap
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.sources.tables import current_rows

# ---- fixed values: words that say nothing about a function by themselves
FILLER = frozenset(
    """a an and any are as at be been by can code comment comments constructor contents created def default deprecated desc
    describe described describes description do doc docs docstring document documentation documented does doing done dummy
    empty etc example explanatory fill fixme following for from func function functions generated getter go goes has have
    helper here hereby implement implementation implements in inherit inheritdoc inherited init initializer insert internal
    into ipsum is it its itself just later lorem main me method methods missing more my na name named need needed needs no
    none not nothing now obvious of on or our placeholder please provide provided purpose remark routine same say says see
    self setter should simple simply some something stub summary tbd test text that the thing things this to todo undefined
    undocumented unknown until up update usage used uses util utility value void what which will wip with write xxx yet you
    above below auto autogenerated automatically date author version since copyright there needs explain explains
    self-explanatory trivial work works run runs call calls return returns execute executes perform performs handle handles
    noch nichts keine beschreibung fehlt todo sin descripcion pendiente""".split()
)
# ---- fixed values: comments addressed to tools
DIRECTIVE = re.compile(
    r"""(?ix) ^ \s* (?: noqa\b | type:\s*ignore | pylint\s*: | pyright\s*: | mypy\s*: | flake8\s*: | ruff\s*: | isort\s*: | fmt\s*: | yapf\s*:
    | nosec\b | nosonar\b | nolint | golint | lint: | eslint | tslint | jshint | jscs | prettier | istanbul | c8\s+ignore | v8\s+ignore
    | @ts- | @?suppresswarnings | checkstyle | pragma\b | coverage\s*: | go: | \+build | clang-format | rustfmt | sourcemappingurl
    | region\b | endregion\b | -\*- | vim?: | swiftlint | rubocop | phpcs | codespell | spell-?checker | cspell ) .* $"""
)
SECTION = re.compile(
    r"(?i)^\s*(args|arguments|parameters|params|other parameters|attributes|keyword args|keyword arguments|returns?|yields?|raises?|throws?|exceptions?|warns|see also|references|todo)\s*:?\s*$"
)
TAG = re.compile(r"^\s*(?:[@\\][A-Za-z][\w.-]*|:[A-Za-z]+(?:\s+[^:\n]*)?:)")
KEEPING_TAG = re.compile(r"(?i)^\s*[@\\](?:brief|summary|description|desc|remarks?|details|note)\b")
# ----


def words_of(name: str) -> list[str]:
    """The words of an identifier, lower-cased: at underscores, other signs and changes of case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+", name or "")]


def _stem(word: str) -> str:
    word = word.lower()
    for ending in ("ing", "ies", "ed", "es", "s"):
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            word = word[: -len(ending)]
            break
    return word.rstrip("eyi") or word


def _uncomment(doc: str) -> list[str]:
    text = doc.replace("\r\n", "\n").replace("\r", "\n").strip()
    text = re.sub(r'^[rRuUbBfF]{0,2}("""|\'\'\')|("""|\'\'\')$', "", text)
    text = re.sub(r"^\s*(/\*+!?|<!--+|\{-\|?|\(\*+)|(\*+/|--+>|-\}|\*+\))\s*$", "", text)
    lines = []
    for line in text.split("\n"):
        line = re.sub(r"^\s*(?:///?!?|#+!?|\*+(?!\w)|--|;+|%+|'(?=\s))\s?", "", line)
        lines.append(re.sub(r"\s*\*+/\s*$", "", line).rstrip())
    return lines


def _unmarked(text: str) -> str:
    text = re.sub(r"\{@(?:link|linkplain|code|literal|value)\s+([^}]*)\}", r"\1", text)
    text = re.sub(r"\{@\w+[^}]*\}", " ", text)
    text = re.sub(r"</?[A-Za-z][^<>]*>", " ", text)
    text = html.unescape(text)
    text = re.sub(r":[a-z]+:`([^`]*)`", r"\1", text)
    return re.sub(r"[`*_~=\-]{3,}|`|\*\*", " ", text)


def clean_documentation(doc: str | None) -> str:
    """Prose of a documentation comment: comment signs, markup, tags with what follows them, parameter sections and tool
    directives are set aside; paragraphs are kept apart by line feeds. '' if nothing is left or doc is null."""
    if not doc:
        return ""
    kept: list[str] = []
    section = None  # indentation of the section we are in
    lines = _uncomment(doc)
    for i, line in enumerate(lines):
        indent = len(line) - len(line.lstrip())
        rule = i + 1 < len(lines) and re.fullmatch(r"\s*[-=~^]{3,}\s*", lines[i + 1])
        if SECTION.match(line) and (line.rstrip().endswith(":") or rule):
            section = indent
            continue
        if section is not None:
            if not line.strip():
                following = next((x for x in lines[i + 1 :] if x.strip()), "")
                if len(following) - len(following.lstrip()) <= section and not re.match(r"\s*[-*]?\s*\w+\s*(\([^)]*\))?\s*:", following):
                    section = None
                kept.append("")
                continue
            continue
        if KEEPING_TAG.match(line):
            line = KEEPING_TAG.sub("", line)
        elif TAG.match(line):
            section = indent if indent else -1
            section = None if indent == 0 else section
            continue
        if DIRECTIVE.match(line):
            continue
        kept.append(line.strip())
    text = _unmarked("\n".join(kept))
    text = re.sub(r"[ \t]+", " ", text)
    return re.sub(r"\s*\n\s*\n\s*", "\n", re.sub(r"(?<!\n)\n(?!\n)", " ", text)).strip()


def telling_sentences(text: str, name: str | None, parameters: set[str] = frozenset()) -> list[str]:
    """Sentences of cleaned documentation with at least two words that are neither filler nor taken from the name."""
    own = {_stem(w) for w in words_of(name or "")} | {re.sub(r"\W|_", "", (name or "").lower())}
    told = []
    for sentence in re.split(r"(?<=[.!?;])\s+|\n", text):
        if DIRECTIVE.match(sentence) or re.match(r"(?i)\s*(todo|fixme|xxx|hack|tbd|wip)\b", sentence):
            continue
        telling = set()
        for token in re.findall(r"[^\W\d_][\w'-]*", sentence):
            if token in parameters or re.sub(r"\W|_", "", token.lower()) in own:
                continue
            telling |= {w for w in words_of(token) if len(w) > 1 and w not in FILLER and _stem(w) not in own}
        if len(telling) >= 2:
            told.append(sentence.strip())
    return told


# --------------------------------------------------------------------- syntax

_TOKEN = re.compile(
    r"""(?P<doc>/\*.*?(?:\*/|\Z)|//[^\n]*|\#(?!\[|!\[)[^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*')|(?P<name>[A-Za-z_$][\w$]*)|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<end>;)|(?P<other>\S)""",
    re.S | re.X,
)


def _python_functions(source: str) -> list[dict]:
    text = textwrap.dedent(source.expandtabs())
    tree = ast.parse(text)
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            top = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append({"name": node.name, "from": top, "to": node.end_lineno, "doc": ast.get_docstring(node, clean=False)})
    return out


def _braced_functions(source: str) -> list[dict]:
    """Function nodes of a language with braces: a name, a bracketed list, then a block that isn't a control statement's.

    A source that begins inside a comment (a piece of a file may) has it as a comment. Documentation is the last block
    comment before the node, or else the comment lines before it.
    """
    if (sign := re.search(r"/\*|\*/", source)) and sign.group() == "*/":
        source = "/*" + source
    tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(source)]
    line_of = lambda at: source.count("\n", 0, at) + 1
    control = {"if", "for", "while", "switch", "catch", "match", "return", "else", "do", "try", "with", "synchronized", "new", "function", "func", "fn"}
    closing: dict[int, int] = {}
    stack: list[int] = []
    for i, (kind, *_rest) in enumerate(tokens):
        if kind == "open":
            stack.append(i)
        elif kind == "close" and stack:
            closing[stack.pop()] = i
    out, fresh, docs = [], 0, []
    for i, (kind, text, at, _end) in enumerate(tokens):
        if kind == "doc":
            docs.append(i)
            continue
        if kind == "end" or text in "{}":
            fresh, docs = i + 1, []
        if kind != "open" or text != "(" or i not in closing:
            continue
        before = [t for t in tokens[fresh:i] if t[0] != "doc"]
        if before and before[-1][1] == ">":  # type parameters between name and list
            depth = 0
            while before:
                last = before.pop()
                depth += (last[1] == ">") - (last[1] == "<")
                if not depth:
                    break
        if not before or before[-1][0] != "name" or before[-1][1] in control:
            continue
        j = closing[i] + 1
        while j < len(tokens) and not (tokens[j][1] in "{;}" or (tokens[j][0] == "name" and tokens[j][1] in control)):
            j = closing.get(j, j) + 1 if tokens[j][0] == "open" else j + 1
        if j < len(tokens) and tokens[j][1] == "{":
            stop = tokens[closing[j]][3] if j in closing else len(source)
            own = [tokens[d][1] for d in docs]
            blocks = [d for d in own if d.startswith("/*")]
            out.append({"name": before[-1][1], "from": line_of(before[0][2]), "to": line_of(stop - 1), "doc": blocks[-1] if blocks else "\n".join(own) or None})
    return out


def functions_of(source: str | None, language: str | None) -> list[dict]:
    """Function nodes (name, first and last line from 1, documentation) of a source text; none where it can't be parsed."""
    if not source or not source.strip():
        return []
    if (language or "").lower() in ("python", "py") or re.match(r"\s*(@|async def |def |class )", source):
        try:
            return _python_functions(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            if (language or "").lower() in ("python", "py"):
                return []
    return _braced_functions(source)


# ------------------------------------------------------------------- operator

_NODE = "doc_id string, name string, place int, chunk_id string, at int, whole boolean, language string, code string, attached string, line_start int, line_end int"
_TOLD = "id string, name string, doc_id string, documentation string, stands int"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Function nodes of every chunk; where a chunk's own function isn't among them, the whole chunk under its name."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            source, first = row["content"] or "", row["line_start"] if (row["line_start"] or 0) > 0 else None
            lines = source.split("\n")
            key = row["doc_id"], row["place"], row["chunk_id"], row["language"]
            found = functions_of(source, row["language"])
            for node in found:
                span = (first + node["from"] - 1, first + node["to"] - 1) if first else (None, None)
                code = "\n".join(lines[node["from"] - 1 : node["to"]])
                out.append((key[0], node["name"], key[1], key[2], node["from"], False, key[3], code, clean_documentation(node["doc"]), *span))
            if row["name"] and all(node["name"] != row["name"] for node in found):
                out.append((key[0], row["name"], key[1], key[2], 0, True, key[3], source, None, first, row["line_end"]))
        yield _batch(out, _NODE)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([(row["id"], row["name"], row["doc_id"], clean_documentation(row["docstring"]), row["stands"]) for row in batch.to_pylist()], _TOLD)


def _basis(name: pd.Series, attached: pd.Series, documentation: pd.Series) -> pd.Series:
    """attached where the comment at the node and the docstring both tell something, docstring where only that one does
    (the node is missing, or its comment torn by an edit), null where the docstring doesn't: it has the last word."""
    return pd.Series([("attached" if a and telling_sentences(a, n) else "docstring") if telling_sentences(d, n) else None for n, a, d in zip(name, attached, documentation)], dtype=object)


def documented_functions(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Functions and methods among entities (id, type, name, doc_id, docstring, line_start) with code and documentation.

    One row per id: id, name, language, code, documentation, attached, basis, line_start, line_end. type counts lower-cased, without outer
    blanks and a leading `code_`. Rows of one id agree but for ranking columns, so any serves. Code comes from the current
    rows of chunks (id, doc_id, indexed_at, element_type, element_name, content, language, chunk_index, line_start,
    line_end) that hold functions: the node of the entity's name in its doc_id, of several the one nearest to the entity's line
    (then the first), with its own lines and the documentation attached to it, cleaned. Where a chunk
    of that element_name doesn't parse, the whole chunk is the code and attached is null; where the file has neither, code is null.
    Functions whose docstring is null, empty or says nothing are dropped; null ids and names drop out too.
    """
    kind = F.regexp_replace(F.lower(F.trim("type")), "^code_", "")
    chosen = entities.filter(kind.isin("function", "method") & F.col("id").isNotNull() & F.col("name").isNotNull() & (F.trim("docstring") != ""))
    chosen = chosen.groupBy("id").agg(F.min(F.struct("name", "doc_id", "docstring", F.col("line_start").alias("stands"))).alias("e")).select("id", "e.*")
    told = chosen.mapInArrow(_cleaned, _TOLD)

    # a row of another kind may be the current one of its id, but its content needn't travel
    holds = F.coalesce(F.col("element_type") == "function", F.lit(False))
    code = chunks.select(
        F.col("id").alias("chunk_id"), "doc_id", "indexed_at", holds.alias("holds"), F.col("element_name").alias("name"), F.when(holds, F.col("content")).alias("content"), "language",
        F.coalesce("chunk_index", F.lit(0)).cast("int").alias("place"), F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"),
    )
    code = current_rows(code, "chunk_id").filter("holds and doc_id <> ''").drop("indexed_at", "holds")
    nodes = code.mapInArrow(_nodes, _NODE)
    away = F.coalesce(F.abs(F.col("line_start") - F.when(F.col("stands") > 0, F.col("stands"))), F.lit(1 << 30))
    nearest = F.min(F.struct(F.col("at").isNull().alias("none"), "whole", away.alias("away"), "place", "chunk_id", "at", "language", "code", "attached", "line_start", "line_end")).alias("n")
    # grouped as joined: no further shuffle
    best = told.join(nodes, ["doc_id", "name"], "left").groupBy("doc_id", "name", "id").agg(F.first("documentation").alias("documentation"), nearest)
    best = best.withColumn("basis", F.pandas_udf(_basis, "string")("name", "n.attached", "documentation")).filter("basis is not null")
    return best.select("id", "name", "n.language", "n.code", "documentation", "n.attached", "basis", "n.line_start", "n.line_end")
