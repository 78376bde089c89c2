import random

import pytest
from pyspark.sql import functions as F

from lodestrand.llm.provenance import Facts, _clusters, provenance, source_files
from lodestrand.plans.scratch import Scratch

rng = random.Random(11)
WORDS = "alpha beta gamma delta river stone cloud paper engine signal basket candle window mirror pocket ladder".split()


def name():
    return "_".join(rng.sample(WORDS, 2))


def hand(n=12):
    forms = ["{a} = load({b}, {n})", "if {a} > {n}:\n        {b}.push({a})", "for x in {a}.items():\n        {b}(x, '{a}')", "{a}['{b}'] = {b} + {a} * {n}", "return {a}({b})", "assert {a} is not {b}", "with {a}.open() as {b}:\n        {b}.read()", "log.info('%s {a}', {b})", "{a}, {b} = {b}.split('-')"]
    body = "".join(f"def {name()}({name()}):\n" + "".join("    " + rng.choice(forms).format(a=name(), b=name(), n=rng.randrange(99)) + "\n" for _ in range(8)) for _ in range(n))
    return f"import {name()}\n" + body


GENERATED = "K = 1\n" + "".join(f"def get_{name()}(self): return self._fields[{i}]\ndef set_{name()}(self, v): self._fields[{i}] = v\n" for i in range(60))
MINIFIED = ";".join(f"var {c}=a.{d}B({i}),e={i}" for i, (c, d) in enumerate(zip("bcdfghjk" * 40, "mnpqrstv" * 40)))
DATA = "T = [\n" + ",\n".join(str([rng.random() for _ in range(6)]) for _ in range(60)) + "]\n"


@pytest.mark.parametrize(
    "line,generated,vendored",
    [
        ("# Code generated by foo. DO NOT EDIT.", True, False), ("// @generated from x.idl", True, False), ("// <auto-generated>", True, False), ("# This file was automatically produced from a.schema;", True, False),
        ("// Dieses Modul wurde maschinell aus a.xsd erzeugt, bitte nicht von Hand ändern.", True, False), ("# -*- machine written by foo, source: a.def -*-", True, False), ("// Built by foo on 2024-01-01; edit a.tmpl instead of this output.", True, False),
        ("# used to be generated by foo, maintained by hand since release 3", False, False), ("// generated ids must stay unique", False, False), ("# tests that files marked auto-generated by foo are left out", False, False),
        ("// drives the writer whose output is code generated by foo; this file itself is edited freely", False, False), ("// do not edit while the migration is running", False, False), ('"""Auto-generated method stub"""', False, False),
        ("// Vendored from upstream foo at 1.2.3; local patches: none", False, True), ("# upstream: foo@1.2.3", False, True), ("// foo v1.2.3 | (c) the foo authors | redistributed under its own licence", False, True),
        ("# This is a bundled copy of foo 1.2, kept here to avoid a network install.", False, True), ("# Copied verbatim from the foo project (release 1.2). Report problems there.", False, True),
        ("# copied from nowhere: this is our own take on it", False, False), ("// wraps the foo library, which is installed from the registry", False, False), ("# talks to the vendor portal", False, False), ("# the third party feed is optional here", False, False),
    ],
)
def test_statements(line, generated, vendored):
    facts = Facts("src/a.py", line + "\n" + hand(3))
    assert (facts.says_generated, facts.says_vendored) == (generated, vendored)


def test_statements_anywhere_but_in_regions():
    long, line = hand(20), "# Code generated by foo. DO NOT EDIT.\n"
    assert long.count("\n") > 160
    says = lambda text: Facts("src/a.py", text).says_generated
    assert says(long + line) and says(hand(3) + line) and says(long + line + long)
    assert Facts("src/a.py", long + "# upstream: foo@1.2.3\n").says_vendored
    for begin, end in (("# ---- begin table (1/1) ----\n", "# ---- end table ----\n"), ("# region table\n", "# endregion\n"), ("#region\n", "#endregion\n")):
        assert not says(long + begin + line + long + end + long) and not says(begin + line + end)
        assert says(begin + long + end + line) and says(begin + line)  # after the region; a region that never ends is none


def test_verdicts(spark):
    shared = hand(20)
    rows = [
        ("hand", "p", "src/vendors/tool.py", hand()), ("gen", "p", "src/a.py", GENERATED), ("min", "p", "web/a.js", MINIFIED), ("data", "p", "src/b.py", DATA), ("vend", "p", "third_party/foo/a.py", hand()),
        ("copy1", "p", "src/c.py", shared), ("copy2", "q", "lib/c.py", shared.replace("import ", "import os, ")), ("own1", "p", "src/d.py", hand() + "TABLE = " + str(list(range(30)))),
        ("empty", "p", "src/e.py", ""), ("none", None, None, None), ("blank", "p", "x.py", " \n\t\n"), ("gen", "p", "src/a.py", GENERATED),
    ]
    df = spark.createDataFrame(rows, "doc_id string, project_id string, file_path string, text string").withColumn("family", F.lit(1)).withColumn("words", F.lit(2)).repartition(3)
    got = {r.doc_id: r.verdict for r in provenance(df).collect()}
    assert got == {"hand": None, "gen": "generated", "min": "minified", "data": "data", "vend": "vendored", "copy1": "vendored", "copy2": "vendored", "own1": None, "empty": None, "none": None, "blank": None}


def test_hot_family_and_empty_table(spark):
    rows = [(f"d{i:04}", f"p{i % 3}", "src/a.py", GENERATED.replace("alpha", f"a{i}")) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id string, project_id string, file_path string, text string")
    got = provenance(df).collect()
    assert len(got) == 120 and {(r.family, r.family_files, r.family_projects) for r in got} == {("d0000", 40, 3)}
    assert provenance(df.filter("false")).count() == 0


def test_family_decides(spark):
    # three files of one generator, without a statement, a folder or a counter, among longer stretches written by hand
    piece = "".join(f"def get_{name()}(self, key): return self.store[key].value(self.kind).strip()\n" for _ in range(40))
    files = [hand(2) + "".join(line.replace("value", name()) + "\n" for line in piece.splitlines()) for _ in range(3)]
    rows = [(f"g{i}", "p", f"src/m{i}.py", text) for i, text in enumerate(files)] + [(f"h{i}", "p", f"src/h{i}.py", hand()) for i in range(5)]
    got = {r.doc_id: (r.verdict, r.evidence, r.family_size) for r in provenance(spark.createDataFrame(rows, "doc_id string, project_id string, file_path string, text string")).collect()}
    assert got == {f"g{i}": ("generated", "family", 3) for i in range(3)} | {f"h{i}": (None, None, 1) for i in range(5)}


def test_pairs_of_a_bucket_beyond_its_first_files(spark):
    # 40 sets of one bucket, unlike each other but for the last two: no leader before them finds that link
    sets = [list(range(1_000 * i, 1_000 * i + 50)) for i in range(39)] + [list(range(38_001, 38_051))]
    rows = [(f"{i:02}", f"{i:02}".encode(), s, [1]) for i, s in enumerate(sets)]
    facts = spark.createDataFrame(rows, "doc_id string, alike binary, shingles array<long>, bands array<long>")
    got = {bytes(r.alike).decode(): r.cluster for r in _clusters(Scratch(spark), facts, "family", "alike", "shingles", "bands").collect()}
    assert got == {f"{i:02}": f"{min(i, 38):02}" for i in range(40)}


def test_sketches_tell_what_is_alike():
    from lodestrand.llm.provenance import DIFFERENT, bands
    from lodestrand.llm.words import mix
    import numpy as np

    every = mix(np.arange(1, 60_000, dtype=np.uint64))
    apart = lambda a, b: sum(bin((x ^ y | (x ^ y) >> 1) & 0x5555555555555555).count("1") for x, y in zip(bands(a)[1].tolist(), bands(b)[1].tolist()))
    counts = [apart(every[i * 290 : i * 290 + 180], every[i * 290 + 20 : i * 290 + 200]) for i in range(200)]  # similarity 0.8
    assert max(counts) <= DIFFERENT and 44 < np.mean(counts) < 52
    counts = [apart(every[i * 290 : i * 290 + 150], every[i * 290 + 50 : i * 290 + 200]) for i in range(200)]  # 0.5
    assert np.mean([c > DIFFERENT for c in counts]) > 0.99


def test_every_pair_of_a_bucket_counts(spark):
    own = lambda a, b: list(range(a, b))
    sets = {"a": own(0, 100), "b": own(40, 140), "c": own(41, 141), "d": own(200, 300), "e": own(210, 310), "f": own(220, 320), "g": own(500, 600)}
    # in one bucket: b and c are alike, the first is not; e is like d and f, which are not alike
    rows = [(k, k.encode(), v, [1, 2] if k in "abc" else [3]) for k, v in sets.items()]
    facts = spark.createDataFrame(rows, "doc_id string, alike binary, shingles array<long>, bands array<long>")
    got = {bytes(r.alike).decode(): r.cluster for r in _clusters(Scratch(spark), facts, "family", "alike", "shingles", "bands").collect()}
    assert got == {"a": "a", "b": "b", "c": "b", "d": "d", "e": "d", "f": "d", "g": "g"}


def test_source_files(spark):
    rows = [
        ("c0", "d", "p", "a.py", "python", "one", 0, "2024-01-01T00:00:00Z"), ("c0", "d", "p", "a.py", "python", "newer", 0, "2024-01-01T00:00:01+00:00"), ("c1", "d", "p", "a.py", "", "two", 1, "2024-01-01T00:00:00Z"),
        ("m0", "m", "p", "a.md", "", "text", 0, "2024-01-01T00:00:00Z"), ("m1", "n", "p", "a", "Markdown ", "text", 0, "2024-01-01T00:00:00Z"), ("x", None, "p", "a.py", "python", "x", 0, None), ("y", "e", "p", None, None, None, None, "bad"),
    ]
    df = spark.createDataFrame(rows, "id string, doc_id string, project_id string, file_path string, language string, content string, chunk_index int, indexed_at string")
    assert {r.doc_id: r.text for r in source_files(df).collect()} == {"d": "newer\ntwo", "e": ""}
