import numpy as np
import pytest

from tickloom.llm import common, features, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean()).item()


def labels_of(spark, name):
    return {r["doc_id"]: r[name] for r in common.table(spark, SF, "labels").collect()}


def test_interactions_by_the_identity():
    fm = quality.FactorisationMachine(50, 4, seed=1)
    fm.w[:] = np.arange(50) / 50
    slots, x = np.array([3, 8, 20, 4]), np.array([1.0, 0.5, 2.0, -1.0], np.float32)
    direct = fm.w0 + (fm.w[slots] * x).sum() + sum(fm.v[slots[i]] @ fm.v[slots[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert fm.logits(slots, x, np.array([0]))[0] == pytest.approx(direct, abs=1e-5)


def test_a_step_follows_the_gradient():
    """The first step of every parameter, against finite differences of the loss."""
    rng = np.random.default_rng(5)
    rows = [(rng.choice(12, 5, replace=False), rng.normal(0, 1, 5).astype(np.float32)) for _ in range(20)]
    y = np.array([0.0, 1.0] * 10)
    start = quality.FactorisationMachine(12, 3, seed=2)
    start.w0 = 0.0
    moved = quality.FactorisationMachine(12, 3, seed=2).fit(rows, y, epochs=1, seed=1) if len(rows) <= quality.BATCH else None
    slots, x, starts = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.arange(0, 100, 5)

    def loss(w0, w, v):
        m = quality.FactorisationMachine(1, 1)
        m.w0, m.w, m.v = w0, w.astype(float), v.astype(float)
        z = m.logits(slots, x.astype(float), starts)
        return np.mean(np.log1p(np.exp(z)) - y * z) + quality.DECAY / 2 * ((w.astype(float) ** 2).sum() + (v.astype(float) ** 2).sum())

    def slope(change):
        return (loss(*change(1e-5)) - loss(*change(-1e-5))) / 2e-5

    def step(g):
        return -quality.RATE * g / np.sqrt(1e-3 + g * g)

    at = start.w0, start.w, start.v
    assert moved.w0 == pytest.approx(step(slope(lambda e: (at[0] + e, at[1], at[2]))), abs=1e-4)
    for i in range(12):
        one = np.eye(12)[i]
        assert moved.w[i] == pytest.approx(step(slope(lambda e: (at[0], at[1] + e * one, at[2]))), abs=1e-4)
        for f in range(3):
            unit = np.outer(one, np.eye(3)[f])
            assert moved.v[i, f] - start.v[i, f] == pytest.approx(step(slope(lambda e: (at[0], at[1], at[2] + e * unit))), abs=1e-4)


def test_no_row_sees_its_own_label_out_of_fold(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(500, 20, replace=False)), np.ones(20, int), np.zeros(1)) for _ in range(60)]
    toxic = (rng.random(60) < 0.4).astype(int)
    seen = []
    fit, design = toxicity.Linear.fit, toxicity.Linear.design
    monkeypatch.setattr(toxicity.Linear, "fit", lambda self, r, y, e: (seen.append(("fit", {id(x) for x in r})), fit(self, r, y, e))[1])
    monkeypatch.setattr(toxicity.Linear, "design", lambda self, r: (seen.append(("design", {id(x) for x in r})), design(self, r))[1])
    toxicity.fit_chain(rows, toxic)
    fitted, tested = set(), 0
    for what, ids in seen:
        if what == "fit":
            fitted = ids
        elif ids != fitted:
            tested += len(ids)
            assert not ids & fitted
    assert tested == len(rows) * len(toxicity.CHAIN)


@pytest.mark.parametrize("kind", ["string", "double", "date", "array<int>", "struct<x:int>", "boolean", "decimal(38,2)"])
def test_n_chars_of_any_kind(spark, kind):
    marks = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    value = {"string": "'many'", "double": "double('NaN')", "date": "date'2020-01-01'", "array<int>": "array(1)", "struct<x:int>": "named_struct('x', 1)", "boolean": "true", "decimal(38,2)": "cast(1e35 as decimal(38,2))"}[kind]
    docs = odd(spark).drop("n_chars").selectExpr("*", f"{value} AS n_chars")
    assert quality.quality_scores(docs, marks).count() == 4 == toxicity.toxicity(docs, marks).count()
    assert all(0 <= r["fm_score"] <= 1 for r in quality.quality_scores(docs, marks).collect())


def test_quality_on_held_out_documents(spark):
    truth = labels_of(spark, "quality")
    rows = [r for r in queries.op4_quality(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth]
    y, s = [truth[r["doc_id"]] for r in rows], [r["score"] for r in rows]
    assert len(rows) > 500 and auc(y, s) > 0.95
    assert np.mean([r["predicted"] == t for r, t in zip(rows, y)]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_toxicity_on_held_out_documents(spark):
    truth = labels_of(spark, "toxic")
    rows = [r for r in queries.op10_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth]
    y = np.array([truth[r["doc_id"]] for r in rows])
    found = np.array([r["toxic"] for r in rows])
    assert auc(y, [r["p_toxic"] for r in rows]) > 0.9
    assert found[y == 1].mean() > 0.8 and found[y == 0].mean() < 0.01


def odd(spark):
    rows = [(1, None, None, 0.5), (2, "", 0, 1.0), (2, "idiot " * 3000, None, 2.0), (None, "a b", 3, 3.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars int, score double")


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 0), (2, 0, 1), (2, None, None), (None, 1, 1), (9, 0, 0)]])
def test_odd_rows(spark, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for docs in (odd(spark), odd(spark).limit(0), odd(spark).drop("n_chars")):
        n = docs.count()
        got = quality.quality_scores(docs, marks).collect()
        assert len(got) == n and all(0 <= r["fm_score"] <= 1 and r["score"] is not None for r in got)
        got = toxicity.toxicity(docs, marks).collect()
        assert len(got) == n and all(0 <= r["p_toxic"] <= 1 for r in got)
        if not labels:
            assert not any(r["toxic"] for r in got)


def test_clashing_columns(spark):
    marks = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    docs = odd(spark).selectExpr("*", "1 AS __text", "2 AS __n_chars", "3 AS FM_TEXT", "4 AS fm_score", "5 AS fm_chars")
    got = quality.quality_scores(docs, marks)
    assert got.columns == ["doc_id", "text", "n_chars", "score", "__text", "__n_chars", "FM_TEXT", "fm_chars", "fm_score", "fm_held_out", "fm_predicted"]
    assert all((r["__text"], r["FM_TEXT"], r["fm_chars"]) == (1, 3, 5) and 0 <= r["fm_score"] <= 1 for r in got.collect())


def test_statistics_bins_stay_in_range():
    words = features.WordSlots(100)
    for text in (None, "", "A" * 100_000, "\n" * 5000, "1 " * 70_000, "é%!|\n"):
        bins = features.features(text, 1 << 40, words)[2] - 100
        assert (bins // features.BINS == np.arange(len(features.STATS))).all()
