from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from florilege.operators.tree_aggregate import State, species_profile, tree_aggregate

SCHEMA = "species string, compound_name string, evidence_tier string, retrieved_at timestamp, species_key string, __fl_node int"


def rows():
    out = []
    for i in range(900):
        species = "Hot one" if i % 3 else f"cold-{i % 50}"
        out.append((species if i % 7 else species.upper() + "!", f"c {i % 40}", "direct_species_database" if i % 2 else " Odd ", datetime(2024, 1, 1 + i % 20), "x", 1))
    return out + [(None, None, None, None, None, None), ("", " ", "", None, "y", 2)]


def test_profile_equals_plain_aggregation_at_any_fan_in(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(7)
    want = defaultdict(lambda: [0, set(), 0])
    for s, c, t, *_ in rows():
        key = " ".join(sorted("".join(x if x.isalnum() else " " for x in (s or "").lower()).split()))
        name = " ".join(sorted((c or "").split()))
        want[key][0] += 1
        want[key][1] |= {name} - {""}
        want[key][2] += (t or "").strip().lower() == "direct_species_database"
    for chunk, fan_in in ((5, 2), (1000, 16), (1, 3)):
        got = {r["species_key"]: (r["n_rows"], r["n_compounds"], r["n_tier_1"]) for r in species_profile(df, chunk_rows=chunk, fan_in=fan_in).collect()}
        assert got == {k: (n, len(c), t) for k, (n, c, t) in want.items()}


def test_empty_table_and_null_keys(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert tree_aggregate(empty, {"k": F.col("k")}, [State("s", F.col("v"))]).count() == 0
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", None)], "k string, v int")
    got = {r["k"]: r["s"] for r in tree_aggregate(df, {"k": F.col("k")}, [State("s", F.col("v"))], chunk_rows=1, fan_in=2).collect()}
    assert got == {None: 3, "a": None}


def test_no_node_gets_more_than_fan_in_states(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k")).repartition(10)
    out = tree_aggregate(df, {"k": F.col("k")}, [State("n", F.lit(1))], chunk_rows=10, fan_in=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") >= 3  # 100 chunks need at least four rounds of four; the first is written before
    assert [tuple(r) for r in out.collect()] == [("hot", 1000)]


def test_cold_keys_leave_the_tree_after_the_first_round(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("k")).repartition(9)
    got = {r["k"]: r["n"] for r in tree_aggregate(df, {"k": F.col("k")}, [State("n", F.lit(1))], chunk_rows=5, fan_in=3).collect()}
    assert got[None] == got["hot"] == 1000 and len(got) == 1002 and sum(got.values()) == 3000
