"""Held-out accuracy of the classifiers, raking, and the pipeline's stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from cabledger.llm import mixing, quality, queries, toxicity
from llm_fixtures import SF, docs_of  # noqa: F401

def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize("name, column, sf, least", [("op7_quality", "quality", "sf0.01", 0.95), ("op4_toxicity", "toxic", "sf0.1", 0.88)])
def test_held_out_order(spark, name, column, sf, least):
    folder = f"/root/testdata/{sf}"
    scored = queries.QUERIES[name](spark, folder)
    assert {"doc_id", "held_out", "score", "predicted"} <= set(scored.columns)
    held = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert auc(held.score.to_numpy(), held[column].to_numpy()) >= least


def odd(docs_of):
    return docs_of([(None, None), (1, ""), (2, " \n"), (3, "é漢😀"), (4, "same"), (4, "same"), (5, "long text " * 30_000)] +
                   [(i, f"plain words in a row number {'abcdefgh'[i % 8] * 3}. And more of them.") for i in range(10, 40)] +
                   [(i, "idiot trash " * 3 + "!!! ### ***") for i in range(40, 60)])


@pytest.mark.parametrize("score, column", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_on_odd_rows(docs_of, spark, score, column):
    docs = odd(docs_of)
    labels = spark.createDataFrame([(i, int(40 <= i)) for i in range(10, 60)] + [(None, 1), (10, None), (99, 0)],
                                   f"doc_id bigint, {column} int")
    out = score(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    one_class = score(docs, labels.filter(f"{column} = 0")).collect()
    assert {r.score for r in one_class} == {0.0}
    assert {r.score for r in score(docs, labels.limit(0)).collect()} <= {0.0, 1.0}
    assert score(docs.limit(0), labels).count() == 0


def test_machine_equals_all_pairs():
    machine = quality.FactorisationMachine(size=20, rank=3, seed=1)
    machine.w0, machine.w = 0.3, np.arange(20) / 10
    index, value = np.array([1, 4, 7, 2, 9]), np.array([0.5, 1.0, 2.0, -1.0, 0.3])
    got, _ = machine.margins(index, value, np.array([0, 3]))
    for row, part in enumerate((slice(0, 3), slice(3, 5))):
        i, x = index[part], value[part]
        pairs = sum(machine.v[i[a]] @ machine.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert got[row] == pytest.approx(0.3 + machine.w[i] @ x + pairs)


def test_models_share_what_neither_class_knows():
    model = toxicity.KneserNey([{"good": 3, "fine": 2}, {"nasty": 4, "fine": 2}],
                               {g: 5 for g in "gofinedasty\x03"} | {"\x02g": 2, "\x02f": 2, "\x02n": 2})
    assert model.log_ratio("nasty") > 1 and model.log_ratio("good") < -1 and abs(model.log_ratio("zzz")) < 0.5
    step = model.log_ratio("z" * 51) - model.log_ratio("z" * 50)   # a word is one spelling, however long
    assert model.log_ratio("z" * 500) == pytest.approx(model.log_ratio("z" * 50) + 450 * step)


@pytest.fixture
def cells(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", l, str(t), float(rng.integers(1, 1000))) for i in range(6) for l in ("de", "en", "") for t in range(3) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")


def test_raking_meets_its_targets(cells, spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 12)
    targets = {d: mixing.tempered(cells, d, 2.0) for d in mixing.DIMENSIONS}
    here = mixing.raked(cells, targets).toPandas()
    there = mixing.raked(cells, targets, driver_cells=0).toPandas()
    keys = list(mixing.DIMENSIONS)
    assert np.allclose(here.sort_values(keys).weight, there.sort_values(keys).weight, atol=1e-9)
    for d in keys:
        goal = here.groupby(d).tokens.sum() ** 0.5
        assert np.allclose(here.groupby(d).weight.sum(), goal / goal.sum(), atol=1e-3)
    only = {**targets, "lang": spark.createDataFrame([("en", 1.0), ("xx", 1.0)], "value string, share double")}
    assert set(mixing.raked(cells, only).filter("weight > 0").toPandas().lang) == {"en"}


def test_mixing_odd_rows(docs_of):
    docs = odd(docs_of).withColumns({"source": F.when(F.col("doc_id") > 20, "a"), "lang": F.lit("en"), "weight": F.lit("x")})
    out = mixing.mix(docs, share=2.0).toPandas()
    assert len(out) == docs.count() and (out.copies >= 0).all()
    assert (out.weight * out.tokens).sum() == pytest.approx(2.0 * out.tokens.sum())
    assert set(out[out.doc_id == 4].copies.value_counts()) == {2}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_draws_follow_the_targets(spark):
    out = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), share=1.0).toPandas()
    got = (out.copies * out.tokens).groupby(out.lang).sum()
    goal = out.groupby("lang").tokens.sum() ** 0.5
    assert np.allclose(got / got.sum(), goal / goal.sum(), atol=0.03)


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id: r for r in docs.collect()}
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        pairs = [(d, r.text) for d, r in before.items()]
        if name == "quality_classifier":
            good = {r.doc_id for r in queries.QUERIES["op7_quality"](spark, SF).filter("predicted = 1").collect()}
            assert set(after) == good
        if name == "line_dedup":
            assert {d: r.text for d, r in after.items()} == dict(brute.dedup_lines(pairs))
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "simhash_near_dedup":
            assert set(after) == {c for _, _, c in brute.simhash_groups(pairs)}
        if name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {d for d, _, hit, _ in brute.contamination(pairs, items) if not hit}
        if name == "mix_sources":
            drawn = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(str(tmp_path / str(i - 1)))).collect()}
            assert {d: r.copies for d, r in after.items()} == {d: c for d, c in drawn.items() if c}
        assert all(after[d].text == before[d].text for d in after) or name == "line_dedup"


def test_stages_on_odd_rows(docs_of, spark, tmp_path):
    docs = odd(docs_of).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_registered_sql_agrees(spark, duck_con):
    from checks.compare import check
    for name, sql in queries.ORACLE_SQL.items():
        assert check(spark, duck_con, SF, queries.QUERIES[name], sql) is None
