import random

import numpy as np
from pyspark.sql import functions as F

from florilege.operators import enrichment, gcms, providers, selection, traits
from florilege.operators.exact import collapse_first_seen, exact_percentiles
from florilege.session import _STAGED, stage, staging


def test_percentiles_equal_numpy_for_keys_of_any_size(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([rnd.uniform(-5, 5), 0.0, 1e300, -1e-300, 7.0, 7.0])) for _ in range(3000)] + [(f"k{i % 9}", rnd.gauss(0, 1e6)) for i in range(100)] + [(None, 4.0), (None, 1.0), ("null", None), ("one", -2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["m"], r["p"]) for r in exact_percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.95}).collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        assert np.allclose(got[k], np.percentile(vs, [50, 95]), rtol=1e-12), k
    assert exact_percentiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_collapse_in_first_seen_order(spark):
    rows = [("a", i, ["x", None, " ", "y ", "x", "z"][i % 6], "t" if i % 2 else None) for i in range(600)] + [("b", 1, None, None), (None, 1, "n", None)]
    df = spark.createDataFrame(rows, "k string, o int, u string, v string")
    got = {r["k"]: (r["u"], r["v"]) for r in collapse_first_seen(df, ["k"], ["u", "v"], "o").collect()}
    assert got == {"a": ("x; y; z", "t"), None: ("n", None)}
    out = {r["k"]: (r["n_rows"], r["u"]) for r in enrichment.dedupe_by_key(df, ["k"], "o", ["u"]).collect()}
    assert out == {"a": (600, "x; y; z"), "b": (1, None), "<NA>": (1, "n")}


def test_spaced_rows_of_a_stratum_that_holds_nearly_all(spark):
    rows = [("hot", i) for i in range(500)] + [("b", 7), ("b", 8), (None, 1)]
    got = sorted((r["s"] or "", r["o"]) for r in selection.spaced_pick(spark.createDataFrame(rows, "s string, o int").repartition(7), "s", "o", 5).collect())
    assert got == sorted([("hot", x) for x in (0, 100, 200, 300, 400)] + [("b", 7), ("b", 8), ("", 1)])


def test_targets_inside_the_row_equal_the_join(spark, monkeypatch):
    rnd = random.Random(5)
    names = [f"t{i}" for i in range(12)]
    targets = [(n, None if i == 5 else 90.0 + 10 * i, [n, f"{n} syn"], rnd.sample(range(40, 60), 8) if i != 3 else []) for i, n in enumerate(names)]
    peaks = []
    for i in range(400):
        rt = rnd.uniform(1, 20)
        peaks.append((i, rt, rnd.choice([0.0, None, rnd.uniform(1, 99)]), rnd.uniform(50, 100), f"f{i % 6}", rnd.choice([*names, "t1 syn", "other", "odd"]), [rnd.randrange(40, 60) for _ in range(rnd.choice([0, 2, 3]))], rt * 10 + rnd.uniform(-3, 3)))
    p = spark.createDataFrame(peaks, "peak_id bigint, component_rt double, component_area double, match_factor double, file_name string, compound_name string, mz array<int>, mass double")
    t = spark.createDataFrame(targets, "compound string, mass double, names array<string>, mz array<int>")
    key = lambda r: (r["compound"], r["file_name"], round(r["area"] or -1, 6), round(r["mean_rt"] or -1, 9), r["n_peaks"])
    want = sorted(map(key, gcms.extract_targets(p, t, decontaminate=False).collect()))
    for bound in ("MAX_BROADCAST_TARGETS", "MAX_BROADCAST_VALUES"):
        with monkeypatch.context() as m:
            m.setattr(gcms, bound, 1)
            assert sorted(map(key, gcms.extract_targets(p, t, decontaminate=False).collect())) == want
    assert len(want) > 40 and len({(c, f) for c, f, *_ in want}) == len(want)
    assert gcms.extract_targets(p, t.limit(0)).count() == 0


def test_index_lookup_with_a_limit_equals_the_whole_lookup(spark):
    rnd = random.Random(8)
    species = [f"aa s{i}" for i in range(5)] + [f"bb s{i}" for i in range(3)]
    records = [(f"r{i:04}", "aa s0" if i % 3 else rnd.choice(species), f"c{rnd.randrange(40):02}", "S") for i in range(600)]
    taxa = [(s, s[:2], "fam") for s in species]
    index = providers.build_index(spark.createDataFrame(records, "record_id string, species string, compound_id string, source string"), spark.createDataFrame([(f"c{i:02}", f"n{i % 7}", None) for i in range(40)], "compound_id string, name string, inchikey string"), spark.createDataFrame(taxa, "species_key string, genus string, family string"))
    plants = spark.createDataFrame([(i, s, s[:2], "fam") for i, s in enumerate([*species, "aa new", "zz"])], "plant_id int, species string, genus string, family string")
    ranks = ("species", "genus", "family")
    whole = {}
    for r in providers.query_index(plants, index, ranks).collect():
        whole.setdefault(r["plant_id"], []).append((ranks.index(r["matched_rank"]), r["name"], r["record_id"], r["compound_id"], r["species_key"], r["source"]))
    for most in (1, 7, 50):
        got = {}
        for r in providers.query_index(plants, index, ranks, most).collect():
            got.setdefault(r["plant_id"], []).append((ranks.index(r["matched_rank"]), r["name"], r["record_id"], r["compound_id"], r["species_key"], r["source"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:most] for k, v in whole.items()}


def test_similar_sets_and_neighbours_equal_brute_force(spark):
    rnd = random.Random(2)
    sets = {f"q{i:02}": set(rnd.sample([f"k{j}" for j in range(14)], rnd.choice([1, 3, 5, 6]))) for i in range(45)}
    sets |= {"t1": {"k1", "k2"}, "t2": {"k1", "k2"}, "t3": {"k1", "k2"}, "t4": {"k1", "k2"}, "t5": {"k1", "k2"}, "lone": {"only"}, "lone2": {"only"}, "alone": {"none"}}
    df = spark.createDataFrame([(q, k) for q, ks in sets.items() for k in ks], "query string, matrix_key string")
    reps = {}
    for q, ks in sorted(sets.items()):
        reps.setdefault(frozenset(ks), q)
    jaccard = lambda a, b: len(a & b) / len(a | b)
    for least in (0.0, 0.5, 0.8):
        want = {(a, b) for x, a in reps.items() for y, b in reps.items() if a < b and x & y and jaccard(x, y) >= least}
        got = [(r["a"], r["b"]) for r in traits.trait_similarity(df, least=least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    near = {}
    for r in traits.nearest_neighbours(df, k=3).collect():
        near.setdefault(r["query"], {})[r["place"]] = r["neighbour"]
    for q, ks in sets.items():
        others = sorted((-jaccard(ks, o), -len(ks & o), n) for n, o in sets.items() if n != q and ks & o)[:3]
        assert [near.get(q, {}).get(i + 1) for i in range(len(others))] == [n for *_, n in others] and len(near.get(q, {})) == len(others), q


def test_staged_tables_go(spark):
    key = spark.sparkContext.applicationId
    before = len(_STAGED.get(key, []))
    with staging(spark):
        df = stage(spark.range(3), "test")
        assert df.agg(F.sum("id")).first()[0] == 3 and len(_STAGED[key]) == before + 1
    assert len(_STAGED[key]) == before
