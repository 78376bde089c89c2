from pyspark.sql import functions as F

from lodestrand.functions import prompts as P
from lodestrand.functions.syntax import braced_elements, calls_of, elements, grouped, markdown_elements, python_elements
from lodestrand.operators import retrieval as T


def short(found):
    return [(k, n, a, b, p) for k, n, a, b, _, p in found]


def test_python():
    text = "import os\n\n@wraps\ndef f(a):\n    def g():\n        return h.i(a)\n    return g\n\nclass C(Base):\n    async def m(self):\n        pass\n"
    assert short(python_elements(text)) == [("function", "f", 3, 7, ""), ("function", "g", 5, 6, "f"), ("class", "C", 9, 11, ""), ("method", "m", 10, 11, "C")]


def test_braces():
    text = 'public class Box<T> {\n  // if (x) {\n  int size(String s) {\n    if (s == "}") { return 1; }\n    return go(s);\n  }\n}\nfunc (b *Box) Open(n int) error {\n}\nexport async function load(a) {\n}\npub fn run(a: &str) -> u8 {\n}\n'
    assert short(braced_elements(text)) == [("class", "Box", 1, 7, ""), ("method", "size", 3, 6, "Box"), ("function", "Open", 8, 9, ""), ("function", "load", 10, 11, ""), ("function", "run", 12, 13, "")]


def test_markdown_and_calls():
    text = "intro\n# One\ntext\n## Two\n```\n# no heading\n```\n# Three\n"
    assert short(markdown_elements(text)) == [("section", "", 1, 1, ""), ("section", "One", 2, 3, ""), ("section", "Two", 4, 7, "One"), ("section", "Three", 8, 9, "")]
    assert calls_of('x = a.b (c(1), "d(2)")  # e(3)\nif (f(4)): a.b()') == ["a.b", "c", "f"]


def test_elements_and_groups(spark):
    rows = [("a.py", "def f():\n    g()\n", "python"), ("bad.py", "def f(:\n", "python"), ("n.txt", "some text", None), ("none", None, "python"), ("blank", " \n", "go"), ("long.txt", "line\n" * 3000, "")]
    df = elements(spark.createDataFrame(rows, "path string, text string, language string")).cache()
    got = {(r.path, r.element_type, r.element_name) for r in df.collect()}
    assert got == {("a.py", "function", "f"), ("bad.py", "text", ""), ("n.txt", "text", ""), ("long.txt", "text", "")}
    assert df.filter("path = 'long.txt'").count() == 38 and df.filter("path = 'a.py'").collect()[0].calls == ["g"]
    e = spark.createDataFrame([("p", 1, 3, "a", ""), ("p", 5, 6, "b", ""), ("p", 50, 60, "c", "C"), ("p", 90, 95, "d", "C")] + [("q", i, i, f"e{i}", "") for i in range(1, 8)], "path string, line_start int, line_end int, element_name string, parent string")
    assert {(r.path, r.element_name): r.group for r in grouped(e).collect()} == {("p", "a"): 1, ("p", "b"): 1, ("p", "c"): 2, ("p", "d"): 2} | {("q", f"e{i}"): 1 + (i > 5) for i in range(1, 8)}
    assert elements(spark.createDataFrame([], "path string, text string, language string")).count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([("pytest -q", "how does src/a.py work?", '{"lang": "Go", "x": 1}'), ("git log", "hi", "broken")], "c string, p string, m string")
    r = df.select(P.command_kind(F.col("c")), P.json_fields(F.col("m"), ["lang", "y"])).collect()
    assert [tuple(x) for x in r] == [("test", {"lang": "Go"}), ("general", {})]
    assert P.budget_shares(10_001, "code") == {"code": 7000, "docs": 3000} and P.budget_shares(10, "balanced") == {"code": 5, "docs": 5}
    first = ["README.md", "a/b/Readme", "x/setup.py", "cli.py", "API/x.py", "src/x.py", "x/api/y.py", "src.py", ""]
    paths = spark.createDataFrame([(i, p) for i, p in enumerate(first)], "i int, p string").orderBy("i")
    assert [(r[0], r[1]) for r in paths.select(P.indexing_priority(F.col("p")), P.fast_path(F.col("p"))).collect()] == [(1, True), (1, False), (2, True), (3, True), (4, True), (5, True), (100, False), (100, False), (100, False)]
    values = spark.createDataFrame([('{"tags": ["Go", "x"], "type": null, "domain": "db"}',), ('{"subject": "nothing"}',), ('{"other": 1}',), ("broken",), (None,), ('{"type": ""}',)], "m string")
    assert [round(r[0], 6) for r in values.select(P.metadata_score(F.col("m"), F.lit("a GO question on db"))).collect()] == [0.666667, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_prompt_signals_by_hand(spark):
    told = [
        ("Fix the parseRows function in src/core/lock.py, it is urgent", 55, "RELATED_LINKS", "CODE", ["src/core/lock.py"]),  # 25 + 20 + 10: lower camel case is no entity
        ("Implement LockManager as we decided earlier in lock.py", 90, "FULL_PACKET", "CODE", ["lock.py"]),  # 30 + 25 + 20 + 15
        ("The ERROR_CODE of the crash", 30, "MEMORY_ONLY", "DEBUG", []),  # 30, and nothing for debugging
        ("hello there", 0, "NONE", "GENERAL", []),
        ("<note>urgent src/a.py</note>hello<br/>", 0, "NONE", "GENERAL", []),
        (None, 0, "NONE", "GENERAL", []),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(told)], "i int, p string").orderBy("i")
    got = [r[0] for r in df.select(P.prompt_signals(F.col("p"))).collect()]
    assert [(g.score, g.tier, g.intent, g.file_paths) for g in got] == [r[1:] for r in told]
    assert got[0].entities == [] and got[1].entities == ["LockManager"] and got[2].entities == ["ERROR_CODE"]
    one = df.limit(1)
    assert one.select(P.prompt_signals(F.lit("hello"), F.lit(True))).collect()[0][0].score == 15
    assert one.select(P.pivoted(F.array(F.lit("a")), F.array(F.lit("b"))), P.pivoted(F.array(F.lit("a")), F.array(F.lit("a"))), P.pivoted(F.array(F.lit("a")), F.array().cast("array<string>"))).collect()[0] == (True, False, False)
    kinds = spark.createDataFrame([("pytest -q", 0), ("npm run build", 1), ("npm run build", 0), ("git commit", 0), ("git log", 1), ("kubectl get", None)], "c string, x int")
    assert [tuple(r) for r in kinds.select(P.command_kind(F.col("c")), P.command_captured(F.col("c"), F.col("x"))).collect()] == [("test", True), ("build", True), ("build", False), ("git", True), ("general", False), ("deploy", True)]


def test_retrieval(spark):
    chunks = spark.createDataFrame([("c1", "d1", "a.py", "CODE", "python", ["loadRow"], "f", [1.0, 0.0], "x" * 40), ("c2", "d2", "README.md", "PROSE", "markdown", [], "", [0.0, 1.0], "y" * 400)], "id string, doc_id string, file_path string, content_type string, language string, symbols array<string>, element_name string, vector array<float>, content string")
    entities = spark.createDataFrame([("e1", "loadRow", "a.py", "d1", [1.0, 0.0]), ("e2", "loadRows", "b.py", "d2", [0.0, 1.0]), ("e3", "other", "README.md", "", [-1.0, 0.0])], "id string, name string, file_path string, doc_id string, vector array<float>")
    edges = spark.createDataFrame([("e1", "e2", "calls")], "source_id string, target_id string, type string")
    seeds = spark.createDataFrame([("e1",)], "node string")
    assert T.within_graph(chunks, edges, entities, seeds, 1).count() == 2
    assert [r.id for r in T.code_only(chunks, "python", "loadr").collect()] == ["c1"] and [r.id for r in T.docs_only(chunks).collect()] == ["c2"]
    found = T.find_similar(entities, chunks, "loadRow", F.array(F.lit(1.0), F.lit(0.0))).collect()
    assert [(r.id, r["pass"]) for r in found][0] == ("e1", 1) and {r.id for r in found} == {"e1", "e2", "e3"}
    scored = chunks.withColumn("score", F.lit(1.0))
    assert [r.id for r in T.context({"code": scored}, 100).collect()] == ["c1"]
    assert T.vector_clusters(chunks, 2).count() == 2
    assert [r.layer for r in T.layer_gaps(spark.createDataFrame([("ui",)], "layer string"), ["ui", "service"]).collect()] == ["service"]
