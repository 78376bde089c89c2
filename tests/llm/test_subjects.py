import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm.subjects import BEFORE, SubjectModel, fit_curve, fit_middles

SUBJECTS = ["software", "law", "music"]
JARGON = {"software": ["mutex", "parser", "linker", "cache"], "law": ["tort", "lien", "écrit", "clause"], "music": ["fugue", "chord", "tempo", "sonata"]}
PLAIN = "the of and we see for note once keeps row last since until each".split()


def text(rng, *parts):
    words = []
    for subject, n in parts:
        for _ in range(n):
            words += [rng.choice(JARGON[subject])] + rng.choices(PLAIN, k=3)
    words += rng.choices(PLAIN, k=8)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng, docs, truth = random.Random(4), [], {}
    for i in range(900):
        a = rng.choice(SUBJECTS)
        b = rng.choice([s for s in SUBJECTS if s != a])
        kind = rng.random()
        if kind < 0.7:
            docs.append((i, text(rng, (a, 6))))
            truth[i] = {a}
        elif kind < 0.85:
            docs.append((i, text(rng, (a, 9), (b, 1))))
            truth[i] = {a}
        else:
            docs.append((i, text(rng, (a, 5), (b, 5))))
            truth[i] = {a, b} - {"software"}
    labels = [(i, rng.choice(SUBJECTS) if rng.random() < 0.05 else rng.choice(sorted(truth[i]))) for i in truth if i % 5 == 0]
    labels = [(i, rng.choice([s, s.upper(), f" {s} "])) for i, s in labels] + [(1, "astrology"), (10_000, "law")]
    return docs, labels, truth


def chosen(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit("clash")).withColumn("words", F.lit(1)).repartition(4)
    model = SubjectModel(d, spark.createDataFrame(labels, "doc_id long, subject string"), SUBJECTS)
    out = {}
    for r in model.chosen().collect():
        out.setdefault(r.doc_id, set()).add(r.subject)
    return out, model


def test_accuracy_on_unlabelled_documents(spark, corpus):
    docs, labels, truth = corpus
    extra = [(2001, None), (2002, " \t\n "), (2003, "the of and we see"), (2004, text(random.Random(1), ("law", 30_000)))]
    got, model = chosen(spark, docs + extra, labels)
    held = [i for i in truth if i % 5]
    assert np.mean([got[i] == truth[i] for i in held]) > 0.95
    assert 2001 not in got and 2002 not in got and got[2003] == {"software"} and got[2004] == {"law"}
    top = {r.doc_id: r.posterior for r in model.posteriors().filter("subject = 'law'").collect()}
    assert top[2004] > 0.9


def test_repeated_rows_no_labels_and_empty_tables(spark, corpus):
    docs, labels, truth = corpus
    got, _ = chosen(spark, docs[:40] + docs[:40], labels)
    assert set(got) == {i for i, _ in docs[:40]}
    assert set(map(frozenset, chosen(spark, docs[:20], [])[0].values())) == {frozenset({"software"})}
    assert chosen(spark, [], [])[0] == {}


def test_curve_is_recovered():
    rng = np.random.default_rng(3)
    share = rng.uniform(0.02, 0.5, 4000)
    x = np.log(share / (1 - share))
    labelled = rng.random(4000) < 0.6 / (1 + np.exp(-6 * (x - np.log(0.25 / 0.75))))
    limit, _, middle = fit_curve(share, labelled)
    assert abs(limit - 0.6) < 0.1 and abs(1 / (1 + np.exp(-middle)) - 0.25) < 0.03


def test_curves_without_labels_and_by_subject():
    assert fit_curve(np.zeros(0), np.zeros(0, bool)) == BEFORE
    rng = np.random.default_rng(8)
    share, subject = rng.uniform(0.02, 0.6, 9000), rng.integers(0, 3, 9000)
    own = np.array([-1.4, -0.8, -1.1])
    x = np.log(share / (1 - share))
    labelled = rng.random(9000) < 0.7 / (1 + np.exp(-8 * (x - own[subject])))
    few = (subject != 2) | (np.arange(9000) < 20)  # hardly any labels of the third: it stays with all
    curve = fit_curve(share[few], labelled[few])
    got = fit_middles(share[few], labelled[few], subject[few], 4, curve)
    assert abs(got[0] - own[0]) < 0.12 and abs(got[1] - own[1]) < 0.12 and abs(got[2] - curve[2]) < 0.2 and abs(got[3] - curve[2]) < 1e-9
