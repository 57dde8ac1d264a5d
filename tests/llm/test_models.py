"""Learnt operators, searches and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from hearthgrid.llm import toxicity as tox
from hearthgrid.llm.decontamination import Myers, contaminated, drop_contaminated, plain
from hearthgrid.llm.embeddings import embedding_components
from hearthgrid.llm.licenses import LEAST_RUN, TEMPLATES, Scanner, scan_licences, terms
from hearthgrid.llm.quality import forward, passage_features, score_quality, train

from .helpers import corpus, frame
from .test_dedup import components

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=240, seed=3):
    """Toxic texts hold an invented word start, poor ones repeat themselves."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        toxic, poor = k % 4 == 0, k % 3 == 0
        w = [f"{rng.choice('abcdeghk')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(rng.randrange(40, 300))]
        if poor:
            w = [x for x in w[:20] for _ in range(8)]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["zorgle", "fipnar"]) + rng.choice(["a", "en", "isch"])
        rows.append((k, " ".join(w).replace("a ", "a. ")))
        labels.append((k, int(not poor), int(toxic)))
    rows += [(n, ""), (n + 1, None), (None, "zorglea zorglea")]
    labels += [(None, 1, 1), (n + 5, None, None), (1, None, 0), (0, 0, 1)]
    return frame(spark, rows), spark.createDataFrame(labels, LABELS), {l[0]: l for l in labels[:n]}


def test_toxicity(spark):
    docs, labels, known = labelled(spark)
    got = tox.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert 30 < len(held) < 90
    assert all(r["predicted"] == known[r["doc_id"]][2] for r in held if r["doc_id"] in known)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}


def test_labels_are_not_inputs(spark):
    docs, labels, _ = labelled(spark)
    from hearthgrid.llm.common import crc32_of
    from pyspark.sql import functions as F
    flipped = labels.withColumn("toxic", F.when(crc32_of(F.col("doc_id")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs, flipped).collect()}


def test_grammar():
    insults, lengths = {"zorg": 2.0}, (4,)
    weigh = lambda clause: tox.clause_weight(clause, insults, lengths)
    assert weigh("a calm clause") == 0
    assert weigh("some zorgle thing") == 2.0
    assert weigh("you zorgle") == weigh("zorgle you") == 2.0 * tox.NEAR_TARGET
    assert weigh("not a zorgle") == 2.0 * tox.NEGATED
    assert weigh("he was then said zorgle") == 2.0 * tox.REPORTED
    assert weigh('the word "zorgle" here') == 2.0 * tox.REPORTED
    assert weigh("kill") == tox.THREAT_WEIGHT
    finder = tox._finder(insults)
    text = "fine. you zorgle! fine"
    f = tox.clause_features(text, insults, finder)
    w = 2.0 * tox.NEAR_TARGET
    assert np.allclose(f, [math.log1p(w), math.log1p(w), math.log1p(100 * w / 4)])


def test_quality(spark):
    docs, labels, known = labelled(spark)
    got = score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 25 and all(r["predicted"] == known[r["doc_id"]][1] for r in held)


def test_one_class_and_empty(spark):
    docs, labels, _ = labelled(spark, 20)
    for op in (score_quality, tox.score_toxicity):
        assert op(docs, labels.filter("false")).count() == docs.count()
        assert op(docs.filter("false"), labels).count() == 0
        assert len({r["score"] for r in op(docs, labels.filter("quality = 1 and toxic = 0")).collect()}) == 1


def test_attention_gradient_and_bags():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    sizes, y = np.array([1, 4, 5, 10, 20]), np.array([0, 1, 0, 1, 0.0])
    m = train(x, sizes, y, epochs=120)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    f = forward(x, starts, m)
    assert np.allclose(np.add.reduceat(f["a"], starts), 1) and (np.abs(f["p"] - y) < 0.5).all()
    assert len(passage_features(b"")) == 1 and len(passage_features(b"w " * 250)) == 3


def vectors(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                           T.StructField("key", T.StringType()), T.StructField("n", T.StringType()), T.StructField("cell", T.StringType())])
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], schema).repartition(3)


@pytest.mark.parametrize("cell,block", [(40, 4096), (60, 32)])
def test_embeddings(spark, cell, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(260, 16))
    x = [*base]
    for k in range(60):  # a third of all rows in one tight group, and looser ones
        x.append(base[0] + rng.normal(size=16) * 0.1)
        x.append(base[k] + rng.normal(size=16) * 0.3)
    x += [base[3] * 4, base[3], base[3]]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [None] + [1.0] * 15), (1003, [float("nan")] * 16), (1004, []), (1005, [1.0, 2.0]), (1006, [2.0, 4.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_components(
        vectors(spark, rows + odd), cell_size=cell, block=block, margin=0.3).collect()}
    u = np.stack(x)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    cos = u @ u.T
    near = [(a, b) for a, b in zip(*np.nonzero(cos >= 0.9)) if a < b]
    n = (cos >= 0.9).sum(axis=1) - 1
    comp = components(range(len(x)), near)
    found = sum(got[k][0] for k in range(len(x)))
    assert found >= 0.98 * n.sum() and all(got[k][0] <= n[k] for k in range(len(x)))
    assert sum(got[k][1] != comp[k] for k in range(len(x))) <= 2
    assert all(got[i] == (0, i, True) for i in range(1000, 1005))
    assert got[1005] == (1, 1005, True) and got[1006] == (1, 1005, False)


def test_embeddings_null_id_and_empty(spark):
    got = embedding_components(vectors(spark, [(None, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [1.0, 0.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got) == [(0, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert embedding_components(vectors(spark, [(1, None)])).count() == 1
    assert embedding_components(vectors(spark, [(1, None)]).filter("false")).count() == 0


def least_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for k, d in enumerate(item, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (c != d))
        best = min(best, row[-1])
    return best


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(k, " ".join(f"q{rng.randrange(900)}" for _ in range(rng.randrange(4, 40)))) for k in range(12)]
    items += [(20, "Tiny"), (21, None), (None, "null id"), (22, "  "), (23, items[0][1])]
    rows = corpus(5, 20)
    for k, (i, t) in enumerate(items[:12]):
        s = list(t.upper() if k % 2 else t)
        for _ in range(k % 5 * len(s) // 60):  # some within the budget, some beyond
            at = rng.randrange(len(s))
            s[at:at + 1] = rng.choice([[], ["#"], [s[at], "+"]])
        rows.append((500 + k, "before it " + "".join(s).replace(" ", "\n ", 3) + " after it"))
    rows += [(700, "a tiny one"), (None, items[1][1]), (701, items[2][1] + " and " + items[2][1][:30])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, rows)
    want = set()
    for i, t in rows:
        for k, b in items:
            if k is not None and b and plain(b):
                b = plain(b)
                d = least_distance(b, plain(t or ""))
                if d <= int(0.05 * len(b)):
                    want.add((i, k, d))
    for size in (4_000_000, 300):
        got = [tuple(r) for r in contaminated(df, bench, block_chars=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    dirty = {i for i, _, _ in want}
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - dirty
    assert contaminated(df.filter("false"), bench).count() == 0 and contaminated(df, bench.filter("false")).count() == 0
    assert any(d > 0 for _, _, d in want)


def test_myers():
    rng = random.Random(9)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert Myers(p).least(t) == least_distance(p, t)


def test_licences(spark):
    notice = {k: v[0] for k, v in TEMPLATES.items()}
    files = [
        (1, "LICENSE", notice["MIT"] + "\nmore words " * 30), (2, "src/a.c", "int main"), (3, "src/lib/b.c", "x\n" + notice["Apache-2.0"] + "\ny"),
        (4, "src/vendor/COPYING.txt", notice["GPL-3.0"]), (5, "src/vendor/deep/er/c.c", "code"), (6, "src/vendor/d.c", None), (7, None, "nothing"),
        (8, "other/only.txt", notice["CC-BY-NC-4.0"]), (9, "other/e.c", ""), (10, "/abs/LICENCE", notice["MPL-2.0"]), (11, "/abs/x/f.c", "f"),
        (12, None, notice["MIT"]), (2, "src/a.c", "int main"), (13, "src/long.c", "w " * 5000 + "\n" + notice["BSD-3-Clause"])]
    df = spark.createDataFrame([(i, p, t, "x", "y") for i, p, t in files], "doc_id long, path string, text string, directory string, licence string")
    got = {r["id"]: (r["licence"], r["origin"], r["directory"]) for r in scan_licences(df, df["path"]).collect()}
    assert got == {
        1: ("MIT", "own", ""), 2: ("MIT", "inherited", ""), 3: ("Apache-2.0", "own", "src/lib"), 4: ("GPL-3.0", "own", "src/vendor"),
        5: ("GPL-3.0", "inherited", "src/vendor"), 6: ("GPL-3.0", "inherited", "src/vendor"), 7: (None, None, None), 8: ("CC-BY-NC-4.0", "own", "other"),
        9: ("CC-BY-NC-4.0", "inherited", "other"), 10: ("MPL-2.0", "own", "/abs"), 11: ("MPL-2.0", "inherited", "/abs"), 12: ("MIT", "own", None),
        13: ("BSD-3-Clause", "own", "src")}
    assert scan_licences(df, df["path"]).count() == len(files)
    assert scan_licences(df.filter("false"), df["path"]).count() == 0


def test_scanner_prefilter_is_lossless():
    """The sparse search finds what the cosine of a text, and of all its runs as long as a template, with every template finds."""
    rng = random.Random(3)
    every = sorted({t for v in TEMPLATES.values() for x in v for t in terms(x)})
    df = {t: rng.choice([0, 1, 5, 900]) for t in every}
    scanner = Scanner(TEMPLATES, df, 1000, 0.7)
    idf = lambda t: math.log(1001 / (1 + df.get(t, 1))) + 1
    vectors = [{t: n * idf(t) for t, n in terms(x).items()} for v in TEMPLATES.values() for x in v]
    lengths = [sum(terms(x).values()) for v in TEMPLATES.values() for x in v]

    def cosines(text):
        v = {t: n * idf(t) for t, n in terms(text).items()}
        return [sum(x * u.get(t, 0) for t, x in v.items()) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values())) for u in vectors]

    def runs(w):
        """Largest cosine of the runs that match the template they are as long as."""
        for k, n in enumerate(lengths):
            for s in range(len(w) - n + 1 if n >= LEAST_RUN else 0):
                if (all_ := cosines(" ".join(w[s:s + n])))[k] >= 0.7:
                    yield max(all_)

    units = [" ".join(rng.sample(x.split(), max(1, int(len(x.split()) * rng.uniform(0.5, 1)))) + ["zz"] * rng.randrange(3))
             for v in TEMPLATES.values() for x in v for _ in range(3)]
    for unit in units:
        w = [t for x in unit.split() for t in terms(x)]
        best = max([*cosines(unit), *runs(w)])
        found = scanner.scan(unit)
        assert (found[1] is not None) == (best >= 0.7) or abs(best - 0.7) < 1e-9
        assert found[1] is None or abs(found[0] - best) < 1e-9


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in p.STAGES:
        out = stage(spark, now, sf).cache()
        assert 0 < out.count() <= now.count()
        if name != p.STAGES[-1][0]:
            assert out.schema.names == docs.schema.names
        now = out
    got = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in now.collect()}
    assert got == {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in p.run(spark, sf).collect()}
    assert all(n == len(i) for n, i in got.values())


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names
