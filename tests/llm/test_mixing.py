import pytest

from florilege.llm import mixing
from florilege.llm.mixing import SourcePlan, demand, mix_sources, plan_mix


def test_position_inverts_demand(spark):
    from pyspark.sql import functions as F

    for tilt in (-0.9, 0.0, 0.4, 1.0):
        plan = SourcePlan("s", 1, 1, 0.5, 0.5, 1, 1000.0, tilt)
        times = [0.0, 0.1, 0.5, 0.77, 1.0]
        df = spark.createDataFrame([(demand(t, plan) / plan.wanted,) for t in times], "u double")
        got = [r["t"] for r in df.select(mixing.position(F.col("u"), F.lit(tilt)).alias("t")).collect()]
        assert got == pytest.approx(times, abs=1e-9)


def test_plan():
    totals = {"a": (1000, 10), "b": (100, 5), "zero": (0, 0)}
    plans = {p.source: p for p in plan_mix(totals, [("a", 0.5, 1), ("b", 0.3, 4), ("zero", 0.1, 2), ("absent", 0.1, 1), (None, 0.1, 1)])}
    assert set(plans) == {"a", "b"} and plans["a"].mix_share == pytest.approx(0.625)
    assert plans["b"].wanted == pytest.approx(400) and sum(p.mix_share * p.tilt for p in plans.values()) == pytest.approx(0)
    assert plan_mix({}, [("a", 1.0, 1)]) == []
    assert sum(p.wanted for p in plan_mix(totals, [("a", 0.5, 1), ("b", 0.5, 1)], total_tokens=50)) == pytest.approx(50)
    with pytest.raises(ValueError, match="fill 200"):
        plan_mix(totals, [("a", 0.5, 1), ("b", 0.5, 1)], total_tokens=201)


@pytest.fixture
def words_as_tokens(monkeypatch):
    """Sizes by words, so that the test needs no vocabulary."""
    from pyspark.sql import functions as F

    count = lambda df, _: df.select("doc_id", "source", F.when(F.length(F.trim("text")) > 0, F.size(F.split(F.trim("text"), " "))).otherwise(0).cast("bigint").alias("n_tokens"))
    monkeypatch.setattr(mixing, "token_counts", count)


def test_mix(spark, words_as_tokens, monkeypatch):
    rows = [(i, "a", "w " * (3 + i % 7)) for i in range(900)] + [(1000 + i, "b", "w " * 4) for i in range(40)] + [(2000, None, "w"), (2001, "other", "w"), (2002, "a", None), (2003, "a", "")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, source string, text string, position double")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.2, 3), ("none", 0.2, 2)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 100)
    mix, report = mix_sources(docs, targets)
    got = mix.collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got) and 0 <= got[0]["position"] <= got[-1]["position"] <= 1
    shares = {r["source"]: r for r in report.collect()}
    assert shares["a"]["actual_share"] == pytest.approx(0.75, abs=0.01) and shares["b"]["actual_share"] == pytest.approx(0.25, abs=0.01) and shares["none"]["actual_share"] == 0
    uses = {}
    for r in got:
        uses[r["doc_id"]] = max(uses.get(r["doc_id"], 0), r["use_no"])
    assert len({(r["doc_id"], r["use_no"]) for r in got}) == len(got) and max(uses.values()) == 3 and {r["source"] for r in got} == {"a", "b"}
    half = [r for r in got if r["position"] < 0.5]
    tokens = lambda rs, s: sum(r["n_tokens"] for r in rs if r["source"] == s)
    plan = {p.source: p for p in plan_mix({"a": (sum(3 + i % 7 for i in range(900)), 900), "b": (160, 40)}, [("a", 0.6, 1), ("b", 0.2, 3), ("none", 0.2, 2)])}
    for s in "ab":
        assert tokens(half, s) == pytest.approx(demand(0.5, plan[s]), abs=12)
    assert [tuple(r) for r in mix_sources(docs, targets)[0].collect()] == [tuple(r) for r in got]


def test_empty_tables(spark, words_as_tokens):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(docs, targets)
    assert mix.count() == 0 and report.first()["actual_share"] == 0
    assert mix_sources(spark.createDataFrame([(1, "a", "w")], "doc_id bigint, source string, text string"), targets.limit(0))[0].count() == 0


def test_token_counts(spark):
    from pathlib import Path

    if not Path(mixing.TOKENIZER).exists():
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([(1, "s", "hello world"), (2, None, None), (3, "s", ""), (4, "s", "a" * 100_000)], "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000
