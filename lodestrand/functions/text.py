"""Text functions as columns: words, names, paths, content tests. No Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: word lists and patterns
# stop words of keywords (memory), of the terms that raise scores (search) and of the tokens of a question (recall)
STOP_WORDS = """the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would
should could may might must can this that these those i you he she it we they what which who when where why how all each every both few
more most other some such no nor not only own same so than too very""".split()
BOOST_STOP_WORDS = """a an the is are was were be been do does did have has had how what when where which who this that and or but if for of
to in on at by with from it its can will not no""".split()
RECALL_STOP_WORDS = """the and for with that this from are was were has have not but you your how what which does did can its into over than then
them they who why when where will just also about after before""".split()
CODE_WORDS = """abstract async await break case catch class const continue def default delete do elif else enum except export extends
false final finally for from function if implements import in instanceof interface is lambda let new none not null or package pass
private protected public raise return self static super switch this throw true try typeof var void while with yield""".split()
EXTENSION_LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sql": "sql", "sh": "bash", "bash": "bash", "md": "markdown",
    "rst": "restructuredtext", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "html": "html", "css": "css", "tf": "terraform", "cls": "apex", "trigger": "apex",
}
FILE_LANGUAGES = {"dockerfile": "dockerfile", "makefile": "makefile", "jenkinsfile": "groovy", "gemfile": "ruby", "rakefile": "ruby", "cmakelists.txt": "cmake"}
LAYERS = [
    ("ui", ["component", "view", "template", "page", "form", ".tsx", ".jsx", ".vue", ".html", ".jsp"]),
    ("controller", ["controller", "handler", "endpoint", "resource", "router", "@restcontroller", "@requestmapping"]),
    ("service", ["service", "manager", "facade", "orchestrator"]),
    ("repository", ["repository", "dao", "mapper", "store"]),
    ("entity", ["entity", "model", "domain", "base", "__tablename__"]),
    ("database", ["table", "column", "schema", "migration", ".sql"]),
]
PERSONAL = "email phone ssn address name password credit_card dob birth social_security passport license".split()
OVERVIEW_QUERIES = [
    r"\b(readme|overview|architecture|getting[.\-_\s]?started)\b",
    r"\b(what\s+(does|is)|how\s+(does|to|do)|purpose|intro(duction)?)\b",
    r"\b(documentation|docs|guide|tutorial|manual)\b",
    r"\b(project\s+structure|codebase|explain|describe)\b",
]
IMPORTANT_FILES = [
    ("config", r"(?i)(config|settings|\.env|\.yaml|\.yml|\.toml|\.json|Makefile|Dockerfile|docker-compose)"),
    ("entry_point", r"(?i)(main\.|index\.|app\.|server\.|__main__|manage\.py|wsgi|asgi)"),
    ("test", r"(?i)(test_|_test\.|\.test\.|spec\.|\.spec\.)"),
]
OVERVIEW_FILES = ["readme", "index", "main", "overview", "introduction"]
INVERSE_TYPES = {
    "calls": "called_by", "called_by": "calls", "imports": "imported_by", "imported_by": "imports", "contains": "contained_in", "contained_in": "contains", "inherits": "inherited_by", "inherited_by": "inherits",
    "references": "referenced_by", "referenced_by": "references", "defines": "defined_in", "defined_in": "defines", "tests": "tested_by", "tested_by": "tests", "similar_to": "similar_to",
}
# ----


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def first_case(cases: list[tuple[Column, str | Column]], otherwise: str | None) -> Column:
    """The value of the first true condition."""
    column = None
    for condition, value in cases:
        column = F.when(condition, F.lit(value)) if column is None else column.when(condition, F.lit(value))  # lit leaves columns as they are
    return column.otherwise(F.lit(otherwise))


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once, however often it is used inside functions on arrays."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keywords(text: Column, shortest: int = 3) -> Column:
    """Runs of a-z in the lower-cased text that aren't joined to other word signs, at least `shortest` long, no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))
    return F.filter(found, lambda w: (F.length(w) >= shortest) & w.rlike("^[a-z]+$") & ~w.isin(STOP_WORDS))


def top_keywords(text: Column, most: int = 10, shortest: int = 3) -> Column:
    """The most frequent keywords, ties in alphabetical order: runs of equal words in the sorted list are counted."""
    begin = F.array().cast("array<struct<n:int,w:string>>")

    def count(done: Column, word: Column) -> Column:
        last = F.element_at(done, -1)
        again = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct((last["n"] - 1).alias("n"), word.alias("w"))))
        return F.when((F.size(done) > 0) & (last["w"] == word), again).otherwise(F.concat(done, F.array(F.struct(F.lit(-1).alias("n"), word.alias("w")))))

    counted = F.aggregate(F.sort_array(keywords(text, shortest)), begin, count)
    return F.transform(F.slice(F.array_sort(counted), 1, most), lambda x: x["w"])


def keyword_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word arrays; 0 if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(F.lit(0.0))


def words_of_name(name: Column) -> Column:
    """Lower-case words of an identifier: parted at underscores, hyphens, dots and changes of case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[\s_.\-]+"), lambda w: w != "")


def camel_expanded(name: Column) -> Column:
    """Identifier with blanks at changes of case."""
    return F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def snake(name: Column) -> Column:
    """snake_case of an identifier, underscores collapsed and trimmed."""
    cased = F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(cased, "-", "_")), "_+", "_"), "^_+|_+$", "")


def external_name(name: Column) -> Column:
    """Name of an external symbol: separators to underscores, at most 100 characters, hashed beyond; never empty."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), "_+", "_"), "^_+|_+$", "")
    short = F.when(F.length(plain) > 100, F.concat(F.substring(plain, 1, 50), F.lit("_"), F.substring(F.md5(name), 1, 16))).otherwise(plain)
    return F.when(short == "", "unnamed").otherwise(short)


def module_path(path: Column) -> Column:
    """Dotted module of a file: suffix and leading source folder dropped, package files named by their folder."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "^(src|lib|app)/", "")
    return F.regexp_replace(F.regexp_replace(plain, "/(__init__|index)$", ""), "/", ".")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/?[^/]*$", ""), "^$", ".")


def language(path: Column) -> Column:
    """Language by full file name, else by suffix, else null."""
    names = first_case([(F.lower(file_name(path)) == k, v) for k, v in FILE_LANGUAGES.items()], None)
    by_language: dict[str, list[str]] = {}
    for suffix, name in EXTENSION_LANGUAGES.items():
        by_language.setdefault(name, []).append(suffix)
    return F.coalesce(names, first_case([(extension(path).isin(v), k) for k, v in by_language.items()], None))


def content_type(path: Column) -> Column:
    """MIME-like kind of a file by its suffix."""
    suffix = extension(path)
    return first_case(
        [
            (suffix.isin("md", "rst", "txt", "adoc"), "text/document"),
            (suffix.isin("json", "yaml", "yml", "toml", "ini", "conf", "xml"), "text/config"),
            (suffix.isin("html", "css"), "text/web"),
            (suffix.isin("pdf", "docx", "pptx"), "application/document"),
            (suffix.isin(*EXTENSION_LANGUAGES), "text/code"),
        ],
        "application/octet-stream",
    )


def file_priority(path: Column) -> Column:
    """0 documentation, 1 source code, 2 configuration, 3 others."""
    low = F.lower(path)
    ends = lambda suffixes: reduce(lambda a, b: a | b, (low.endswith(s) for s in suffixes))
    return (
        F.when(contains_any(low, ["readme", "doc", "guide", "tutorial"]), 0)
        .when(ends([".py", ".js", ".ts", ".java", ".cpp", ".c", ".go", ".rs"]), 1)
        .when(ends([".yaml", ".yml", ".json", ".toml", ".ini", ".conf"]), 2)
        .otherwise(3)
    )


def importance(path: Column) -> Column:
    """Class of a changed file: config, entry_point or test, the first that fits, else null."""
    return first_case([(path.rlike(pattern), kind) for kind, pattern in IMPORTANT_FILES], None)


def layer(name: Column, kind: Column, path: Column) -> Column:
    """Architectural layer by the first list, in order, with a part in name, type and path; unknown if none has."""
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(kind, F.lit("")), F.coalesce(path, F.lit(""))))
    return first_case([(contains_any(text, parts), label) for label, parts in LAYERS], "unknown")


def personal(name: Column) -> Column:
    return contains_any(F.lower(name), PERSONAL)


def entity_type(kind: Column) -> Column:
    """Type without case, outer blanks and a leading code_."""
    return F.regexp_replace(F.lower(F.trim(kind)), "^code_", "")


def inverse_type(kind: Column) -> Column:
    return first_case([(F.lower(F.trim(kind)) == k, v) for k, v in INVERSE_TYPES.items()], None)


def complexity(text: Column) -> Column:
    """1 and the number of branching words, 10 at most."""
    count = lambda part: F.regexp_count(text, F.lit(part))
    return F.least(F.lit(10), 1 + reduce(lambda a, b: a + b, (count(p) for p in ("if ", "for ", "while ", "switch ", "case "))))


def token_estimate(text: Column) -> Column:
    """A token for every four characters."""
    return F.floor(F.length(text) / 4).cast("int")


def query_tokens(text: Column) -> Column:
    """Distinct words of at least three letters, digits and underscores, lower-cased, without stop words, in order."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]{3,})")), lambda w: F.lower(w))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(RECALL_STOP_WORDS)))


def token_overlap(text: Column, needles: Column) -> Column:
    low = F.lower(text)
    return F.size(F.filter(needles, lambda w: low.contains(w)))


def fts_text(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def code_fts_text(symbols: Column, text: Column, most: int = 1000) -> Column:
    """Distinct search words of code: symbols, their parts, and the identifiers of the text that aren't keywords."""
    names = F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"))
    every = F.concat(symbols, F.flatten(F.transform(symbols, words_of_name)), F.filter(names, lambda w: ~F.lower(w).isin(CODE_WORDS)))
    return F.array_join(F.slice(F.array_distinct(every), 1, most), " ")


def sanitized(query: Column) -> Column:
    """Full-text query with special signs blanked and boolean words in lower case."""
    plain = F.regexp_replace(query, r'[+\-!(){}\[\]^"~*?:\\/&|]', " ")
    for word in ("AND", "OR", "NOT"):
        plain = F.regexp_replace(plain, rf"\b{word}\b", word.lower())
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def typo_variants(term: Column, most: int = 10) -> Column:
    """Deletions, then transpositions of neighbours, without the term itself: the first ten."""
    n = F.length(term)
    places = F.sequence(F.lit(1), n)
    deleted = F.transform(places, lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, n)))
    swapped = F.transform(
        F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.lit(1)), F.substring(term, i, F.lit(1)), F.substring(term, i + 2, n)),
    )
    every = F.filter(F.array_distinct(F.concat(deleted, swapped)), lambda w: (w != term) & (w != ""))
    return F.when(n > 0, F.slice(every, 1, most)).otherwise(F.array().cast("array<string>"))


def name_from_id(identifier: Column) -> Column:
    """Last part of an id of four or more parts, else the id."""
    parts = F.split(identifier, "::")
    return F.when(F.size(parts) >= 4, F.element_at(parts, -1)).otherwise(identifier)


def project_id(name: Column) -> Column:
    """Lower-cased project id, null unless 1 to 64 letters, digits, underscores and hyphens."""
    return F.when(name.rlike("^[A-Za-z0-9_-]{1,64}$"), F.lower(name))


def overview_query(query: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(query).rlike(p) for p in OVERVIEW_QUERIES))


def route_path(base: Column, sub: Column) -> Column:
    """Two parts of a route joined by one slash, with a leading and without a trailing one."""
    joined = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(base, F.lit("")), F.lit("/"), F.coalesce(sub, F.lit(""))), "/+", "/")
    return F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, "/$", ""))


def port(text: Column) -> Column:
    """Container port of a mapping such as 8080:80."""
    return F.regexp_extract(text, r":?(\d+)(?:/[a-z]+)?$", 1).try_cast("int")


def session_header(text: Column) -> Column:
    """The first lines, two at most, that are Session: or Date: headers."""
    lines = F.slice(F.split(text, "\n"), 1, 2)
    return F.array_join(F.filter(lines, lambda x: x.rlike("^(Session|Date):")), "\n")


def fuzzy_score(query: str, name: Column) -> Column:
    """Likeness of a name to a query: 1 for equal, 0.8 up for containing, 0.7 for contained, 0.5 up for common words, 0.4 for
    words within words, else 0."""
    q = query.lower()
    low = F.lower(name)
    part = lambda c: F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "_", " ")), r"\s+"), lambda w: F.length(w) > 1)
    mine, theirs = F.array_distinct(part(F.lit(query))), F.array_distinct(part(name))
    common = F.size(F.array_intersect(mine, theirs))
    within = F.exists(mine, lambda a: F.exists(theirs, lambda b: F.contains(b, a) | F.contains(a, b)))
    return (
        F.when(low == q, 1.0)
        .when(low.contains(q), 0.8 + 0.1 * len(q) / F.length(low))
        .when(F.contains(F.lit(q), low), 0.7)
        .when(common > 0, 0.5 + 0.4 * common / F.greatest(F.size(mine), F.size(theirs)))
        .when(within, 0.4)
        .otherwise(0.0)
    )


def sanitized_with_wildcards(query: Column) -> Column:
    """sanitized, but * and ? stay."""
    held = F.translate(query, "*?", "\u0001\u0002")
    return F.translate(sanitized(held), "\u0001\u0002", "*?")


def truncated(text: Column, tokens: int) -> Column:
    """Text of at most so many tokens of four characters, with three dots where it was cut."""
    return F.when(F.length(text) > 4 * tokens, F.concat(F.substring(text, 1, 4 * tokens), F.lit("..."))).otherwise(text)


def source_unit(kind: Column, path: Column, start: Column, end: Column, text: Column) -> Column:
    """Identity of a piece of context: evidence by its place where that is known, else by its path and a digest of its text; a
    memory by the digest. Case and white space don't count in a digest."""
    digest = F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), 256), 1, 16)
    place = F.concat_ws(":", F.lit("evidence"), path, start.cast("string"), F.coalesce(end, start).cast("string"))
    evidence = F.when((path != "") & start.isNotNull(), place).when(path != "", F.concat_ws(":", F.lit("evidence"), path, digest)).otherwise(F.concat(F.lit("evidence:"), digest))
    return F.when(kind == "evidence", evidence).otherwise(F.concat(F.lit("memory:"), digest))
