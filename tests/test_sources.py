import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestrand import plugins
from lodestrand.sources import files as S
from lodestrand.sources.sinks import SnapshotTable, checked, expire_branches, last_of_key, merged, prune_branches, updated, with_sentinels, without_entities, without_files
from lodestrand.sources.tables import current_rows, instant


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_listing_hashes_and_ignore_rules(spark, tmp_path):
    for name in ("a.py", "b/c.md", "b/node_modules/x.js", "build/y.py", "logo.png", "keep/build.txt", "x/deep/skip.log", "x/keep.log"):
        write(tmp_path, name, f"text of {name}")
    rules = ["# comment", "node_modules/", "/build/", "*.log", "!keep.log", "x/**/none"]
    rows = S.hashed(S.list_files(spark, str(tmp_path), rules, content=True)).collect()
    assert {r.path for r in rows} == {"a.py", "b/c.md", "keep/build.txt", "x/keep.log"}
    one = next(r for r in rows if r.path == "a.py")
    assert (one.text, one.language, one.kind, one.size) == ("text of a.py", "python", "text/code", 12) and len(one.content_hash) == 64


def test_changes(spark):
    schema = "project_id string, file_path string, content_hash string, last_updated timestamp"
    t = lambda d: f"2024-01-0{d} 00:00:00"
    old = spark.createDataFrame([("p", "a", "1", None), ("p", "b", "1", None), ("p", "c", None, None), ("p", "d", "1", None)], schema)
    new = spark.createDataFrame([("p", "a", "1", None), ("p", "b", "2", None), ("p", "c", None, None), ("p", "e", "1", None)], schema)
    assert {(r.file_path, r.change) for r in S.changes(old, new).collect()} == {("b", "changed"), ("c", "changed"), ("d", "deleted"), ("e", "added")}
    states = spark.createDataFrame([("p", "a", "1", t(1)), ("p", "a", "2", t(3)), ("p", "a", None, t(2))], "project_id string, file_path string, content_hash string, t string")
    assert S.latest_states(states.withColumn("last_updated", F.col("t").cast("timestamp"))).collect()[0].content_hash == "2"


def test_recognizers(spark):
    rows = [
        ("A.java", "java", '@Service\npublic class Orders extends Base {\n @Autowired private Store store;\n @GetMapping("/orders")\n @RequestMapping(value = "x") }\nimport java.util.List;'),
        ("a.py", "python", "from shop.cart import add\n@router.post('/pay')\nclass Cart(Base):\n    pass"),
        ("a.ts", "typescript", "import { x } from './y';\n@Get('list')\nrouter.get('/z', f);"),
        ("Q.cls", "apex", "List<Account> a = [SELECT Id FROM Account WHERE x = 1];"),
    ]
    df = spark.createDataFrame(rows, "path string, language string, text string")
    assert {(r.path, r.kind, r.method, r.route) for r in S.routes(df).collect()} == {("A.java", "spring", "get", "/orders"), ("A.java", "spring", "any", "/x"), ("a.py", "fastapi", "post", "/pay"), ("a.ts", "nest", "get", "/list"), ("a.ts", "express", "get", "/z")}
    assert {(r.kind, r.name) for r in S.injections(df).collect()} == {("bean", "Orders"), ("field", "Store")}
    assert [r.name for r in S.queried_objects(df).collect()] == ["Account"]
    assert {(r.path, r.name) for r in S.imported_names(df).collect()} == {("A.java", "java.util.List"), ("A.java", "List"), ("a.py", "shop.cart"), ("a.py", "add"), ("a.ts", "./y"), ("a.ts", "x")}
    more = [("b.py", "python", "import os.path as p, sys\nfrom a import (\n  b as c,  # why\n  d,\n)\nx = 1"), ("b.js", "javascript", "import main, { one as two,\n three } from \"./m\";\nimport only from 'only';\nimport './side';"), ("b.go", "go", 'import (\n\t"fmt"\n\tx "net/http"\n)\nimport "a/b"')]
    got = {(r.path, r.name) for r in S.imported_names(spark.createDataFrame(more, "path string, language string, text string")).collect()}
    want = {"b.py": "os.path sys a b d", "b.js": "./m one three ./only".replace("./only", "only"), "b.go": "fmt net/http http a/b b"}
    assert got == {(p, n) for p, names in want.items() for n in names.split()}
    assert {(r.name, r.base) for r in S.class_bases(df).collect()} == {("Orders", "Base"), ("Cart", "Base")}
    assert plugins.recognize(df, ["routes", "injections"]).count() == 7


def test_services(spark):
    compose = 'version: "3"\nservices:\n  orders:\n    image: shop/orders:1\n    ports:\n      - "80:8080"\n  db:\n    image: postgres:16\nvolumes:\n  x:\n'
    df = spark.createDataFrame([("compose.yml", "yaml", compose), ("orders/app.py", "python", "os.environ['DB_URL'], OTHER_HOST")], "path string, language string, text string")
    services = S.merged_services(S.compose_services(df))
    assert {(r.name, r.port, r.technology) for r in services.collect()} == {("orders", 8080, "service"), ("db", None, "database")}
    assert [tuple(r) for r in S.service_mentions(df, services).collect()] == [("orders", "db", "orders/app.py")]


def test_snapshot_table(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    table.upsert(rows(("a", 1), ("b", 1)))
    table.upsert(spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 3, 1)], "id string, v int, n int"), order="n")
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 3), ("c", 3)]
    table.append(rows(("a", 9), ("d", 4)))
    assert table.delete(F.col("v") == 3) == 2 and table.delete(F.col("v") == 77) == 0
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("d", 4)]
    table.compact()
    assert table.statistics().count() == 1 and len(table.versions()) == 5
    table.rollback()
    assert table.expire(2) == 2 and sorted(map(tuple, table.read().collect())) == [("a", 1), ("d", 4)]
    assert sorted(map(tuple, table.read(0).collect())) == [("a", 1), ("b", 3), ("c", 3), ("d", 4)]


def test_rows_of_tables(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 1)], "id string, v int, n int")
    assert {(r.id, r.v) for r in last_of_key(df, ["id"], "n").collect()} == {("a", 2), (None, 3)}
    new = spark.createDataFrame([(None, 9, 9), ("z", 5, 5)], df.schema)
    assert sorted((str(r.id), r.v) for r in merged(df, new, ["id"]).collect()) == [("None", 9), ("a", 1), ("a", 2), ("z", 5)]
    assert [r.v for r in updated(df, F.col("n") == 1, {"v": F.lit(0)}).orderBy("v").collect()] == [0, 0, 2]
    assert [r.id for r in with_sentinels(df, {"id": ""}).orderBy("id").collect()] == ["", "a", "a"]
    e = spark.createDataFrame([("a",), ("b",)], "id string")
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source_id string, target_id string")
    left, links = without_entities(e, r, e.filter("id = 'b'"))
    assert left.count() == 1 and [tuple(x) for x in links.select("source_id", "target_id").collect()] == [("c", "d")]
    f = spark.createDataFrame([("p", "x"), ("p", None), ("q", "x")], "project_id string, file_path string")
    assert without_files(f, ["x"], "p").count() == 2
    b = spark.createDataFrame([("main", True, None), ("old", True, None)], "branch string, is_active boolean, expired_at timestamp")
    b = expire_branches(b, ["main"], F.lit("2024-01-01").cast("timestamp"))
    assert {(x.branch, x.is_active) for x in b.collect()} == {("main", True), ("old", False)}
    assert prune_branches(b, F.lit("2024-02-01").cast("timestamp")).count() == 1


def test_checked(spark):
    schema = StructType([StructField("id", StringType(), False), StructField("n", LongType(), True)])
    assert checked(spark.createDataFrame([("a",)], "id string"), schema).collect()[0].n is None
    for columns in ("n long", "id string, entity_id string", "id string, other int"):
        with pytest.raises(ValueError):
            checked(spark.createDataFrame([], columns), schema)
    with pytest.raises(Exception, match="required column id"):
        checked(spark.createDataFrame([(None, 1)], "id string, n long"), schema).collect()


def test_current_rows(spark):
    rows = [("a", "2024-01-01T00:00:00Z", 1), ("a", "2024-01-01T01:00:00+00:00", 2), ("a", "2024-01-01T00:30:00.5+00:00", 3), ("b", "no time", 4), ("b", None, 5), (None, "2024-01-01", 6)]
    df = spark.createDataFrame(rows, "id string, indexed_at string, v int")
    assert {(r.id, r.v) for r in current_rows(df).collect()} == {("a", 2), ("b", 4), (None, 6)}
    assert df.filter(instant("indexed_at").isNull()).count() == 2


def test_plugins():
    box = plugins.Plugins("thing")
    box.register("a", 1)
    assert box.get("a") == 1 and "a" in box and list(box) == ["a"]
    with pytest.raises(ValueError):
        box.register("a", 2)
    box.register("a", 3, overwrite=True)
    assert box.get("a") == 3
    with pytest.raises(KeyError):
        box.get("b")


def test_all_bases_of_a_class(spark):
    from lodestrand.sources import files

    rows = [("a.py", "class A(B, m.C[int, str], D(x, y), metaclass=E):\n  pass\nclass F(\n    G,\n    H,\n):\n", "python"), ("a.java", "class A<T> extends B<C, D<E>> implements F<G>, H {}\nclass I implements J {}", "java")]
    got = {(r.path, r.name, r.base) for r in files.class_bases(spark.createDataFrame(rows, "path string, text string, language string")).collect()}
    assert got == {("a.py", "A", "B"), ("a.py", "A", "m.C"), ("a.py", "A", "D"), ("a.py", "F", "G"), ("a.py", "F", "H"), ("a.java", "A", "B"), ("a.java", "A", "F"), ("a.java", "A", "H"), ("a.java", "I", "J")}
