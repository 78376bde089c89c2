import pytest
from pyspark.sql import functions as F

from lodestrand.llm.documented import clean_documentation, documented_functions, functions_of, telling_sentences

TRIVIAL = [
    ("load_rows", "Load rows."), ("loadRows", "/** Loads the rows */"), ("load_rows", "# Function load_rows"), ("x", '""""""'), ("x", "// ----"),
    ("run", ":param a:\n:returns:"), ("run", "Args:\n    a:\n    b:\n\nReturns:\n"), ("run", "Parameters\n----------\na\nb"), ("f", "TODO: write docs"),
    ("f", "noqa: D103"), ("f", "eslint-disable-next-line no-eval"), ("f", "{@inheritDoc}"), ("f", "Lorem ipsum"), ("getName", "Gets the name."),
    ("f", "@param a\n@throws Exception"), ("f", "Auto-generated method stub"), ("f", "See code."), ("f", "   "), ("Parser", "Constructor."),
    ("fetch_all", "This method will fetch all."), ("f", "Created on 2024-03-01"), ("entries", "Returns the entries."), ("copies", "Copies"),
]
TELLING = [
    ("load", "Reads a table and caches it on disk.", "Reads a table and caches it on disk."),
    ("f", "/**\n * Waits until the lock is free.\n * @param lock the lock\n */", "Waits until the lock is free."),
    ("f", "<p>Wandelt einen Eintrag in das neue Format um.</p>", "Wandelt einen Eintrag in das neue Format um."),
    ("f", "TODO: split this up. Estimates how much memory is needed.", "Estimates how much memory is needed."),
    ("f", "Merges {@link Foo} with older entries.\n\nArgs:\n    a: first\n", "Merges Foo with older entries."),
]


@pytest.mark.parametrize("name,doc", TRIVIAL)
def test_trivial(name, doc):
    assert telling_sentences(clean_documentation(doc), name) == []


@pytest.mark.parametrize("name,doc,sentence", TELLING)
def test_telling(name, doc, sentence):
    assert telling_sentences(clean_documentation(doc), name) == [sentence]


def test_python_nodes():
    source = '# head\nclass A:\n    @wraps(x)\n    def f(self, a):\n        """Doc."""\n        def inner():\n            pass\n        return a\n'
    nodes = {n["name"]: n for n in functions_of(source, "python")}
    assert (nodes["f"]["from"], nodes["f"]["to"], nodes["f"]["doc"]) == (3, 8, "Doc.") and (nodes["inner"]["from"], nodes["inner"]["to"]) == (6, 7)
    assert functions_of("def broken(:\n  pass", "python") == [] == functions_of(None, "go") == functions_of("", None)


def test_braced_nodes():
    source = '/** Adds. */\npublic int add(int a, int b) {\n  if (a > 0) { return "}{"; }\n  for (;;) { call(x); }\n}\n// Next one\nfunc (s *T) Next(a map[string]int) (int, error) {\n  s.go(a)\n}\nfn two<T>(a: &str) -> Vec<u8> { x }'
    nodes = [(n["name"], n["from"], n["to"], n["doc"]) for n in functions_of(source, "java")]
    assert nodes == [("add", 2, 5, "/** Adds. */"), ("Next", 7, 9, "// Next one"), ("two", 10, 10, None)]


def test_operator(spark):
    e = [
        ("1", "Code_Function", "f", "d", "Waits until a lock is free."), ("1", "Code_Function", "f", "d", "Waits until a lock is free."),
        ("2", " METHOD", "g", "d", "g"), ("3", "class", "C", "d", "Holds many open locks."), ("4", "function", "h", "", "Reads entries from disk."),
        ("5", "function", None, "d", "Reads entries from disk."), ("6", None, "f", "d", "Reads entries from disk."), ("7", "method", "f", None, None), (None, "method", "f", "d", "Reads entries from disk."),
    ]
    entities = spark.createDataFrame(e, "id string, type string, name string, doc_id string, docstring string").withColumn("content", F.lit("clash")).withColumn("line_start", F.lit(1))
    c = [
        ("c1", "d", "2024-01-01T00:00:00Z", "function", "f", "def f():\n    old", "python", 1, 5, 6),
        ("c1", "d", "2024-01-02T00:00:00+00:00", "function", "f", "# note\ndef f():\n    pass\n", "python", 1, 5, 8),
        ("c2", "d", "2024-01-02T00:00:00+00:00", "block", "f", "x", "python", 0, 1, 2),
    ]
    chunks = spark.createDataFrame(c, "id string, doc_id string, indexed_at string, element_type string, element_name string, content string, language string, chunk_index int, line_start int, line_end int")
    got = {r.id: r for r in documented_functions(entities, chunks).collect()}
    assert set(got) == {"1", "4"}
    assert (got["1"].code, got["1"].line_start, got["1"].line_end) == ("def f():\n    pass", 6, 7)
    assert got["4"].code is None and got["4"].documentation == "Reads entries from disk."
    assert documented_functions(entities.filter("false"), chunks.filter("false")).count() == 0


def test_nodes_meet_entities_by_name_and_line(spark):
    told = "Waits until a lock is free."
    e = [("a", "method", "run", "d", told, 40), ("b", "method", "run", "d", told, 11), ("c", "function", "lost", "d", told, 70), ("d", "function", "torn", "d", told, -1), ("e", "function", "gone", "d", told, 1), ("f", "function", "lost", "d", "Lost.", 70)]
    entities = spark.createDataFrame(e, "id string, type string, name string, doc_id string, docstring string, line_start int")
    day, later = "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"
    lost = '# note\ndef lost():\n    """Frees the oldest lock."""'
    c = [
        ("c1", "d", day, "function", "run", "def run(a):\n    one", "python", 1, 10, 12), ("c2", "d", day, "function", "run", "def run(b):\n    two", "python", 2, 41, 42),
        ("c3", "d", day, "function", "", lost, "python", 3, 70, 72), ("c4", "d", day, "function", "torn", "def torn(:\n", "python", 4, 80, 81),
        ("c5", "d", day, "function", "gone", "def gone(): pass", "python", 5, 90, 90), ("c5", "d", later, "block", "gone", "gone = 1", "python", 5, 90, 90),
    ]
    chunks = spark.createDataFrame(c, "id string, doc_id string, indexed_at string, element_type string, element_name string, content string, language string, chunk_index int, line_start int, line_end int")
    got = {r.id: (r.code, r.attached, r.basis, r.line_start) for r in documented_functions(entities, chunks).collect()}
    assert got == {
        "a": ("def run(b):\n    two", "", "docstring", 41), "b": ("def run(a):\n    one", "", "docstring", 10), "c": (lost[7:], "Frees the oldest lock.", "attached", 71),
        "d": ("def torn(:\n", None, "docstring", 80), "e": (None, None, "docstring", None),
    }


def test_source_that_begins_in_a_comment():
    assert functions_of("memo\n * Waits.\n */\nfunction f(a) {\n}\n", "javascript") == [{"name": "f", "from": 4, "to": 5, "doc": "/*memo\n * Waits.\n */"}]
