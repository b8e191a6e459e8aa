"""Queries against brute force over the whole input, where their SQL could share a cut."""

import math
from itertools import combinations
from pathlib import Path

import pyarrow.parquet as pq

import pytest

from florilege.queries import registry


def rows_of(folder, name):
    return pq.read_table(Path(folder, f"{name}.parquet")).to_pylist()


def test_tanimoto_pairs_holds_every_pair_from_a_half_on(spark, small):
    first = {}
    for r in sorted(rows_of(small, "embeddings"), key=lambda r: r["vec_id"]):
        first.setdefault(sum(1 << i for i, x in enumerate(r["embedding"]) if x > 0), r["vec_id"])
    scored = ((min(i, j), max(i, j), (p & q).bit_count() / (p | q).bit_count()) for (p, i), (q, j) in combinations(((p, i) for p, i in first.items() if p), 2))
    want = {(a, b) for a, b, t in scored if t >= 0.5}
    got = {(r.a, r.b) for r in registry.queries()["tanimoto_pairs"](spark, small).collect()}
    assert want and got == want


def test_entry_takes_each_file_as_a_sample(spark, tmp_path, monkeypatch):
    import __spark_entry__

    spark.createDataFrame([("aa", "C10H16"), ("pircevanal", "C6H12")], "compound_name string, molecular_formula string").write.parquet(f"{tmp_path}/plant_compounds.parquet")
    spark.createDataFrame([("aa", None), ("pircevanal", None)], "compound string, also_called string").write.parquet(f"{tmp_path}/chemical_library.parquet")
    peak = lambda i, rt, area, mz, name, file: (i, rt, area, mz, name, 90.0, file)
    peaks = [peak(1, 5.0, 100.0, 93.2, "aa", "Mix_00_1.D"), peak(2, 3.0, 50.0, 56.1, "pircevanal", "Mix_00_1.D"), peak(3, 4.95, 30.0, 93.4, "zz", " Mix_00_2.D "), peak(4, 3.0, 10.0, 56.1, "pircevanal", "Mix_00_2.D")]
    spark.createDataFrame(peaks, "peak_id bigint, component_rt double, component_area double, base_peak_mz double, compound_name string, match_factor double, file_name string").write.parquet(f"{tmp_path}/standard_data.parquet")
    asked = registry.queries()
    monkeypatch.setattr(__spark_entry__.registry, "queries", lambda: {name: lambda s, _, f=f: f(s, str(tmp_path)) for name, f in asked.items()})
    got = {tuple(r) for r in __spark_entry__.entry(spark).collect()}
    assert got == {("aa", "Mix_00_1.D", 100.0, 381.0), ("aa", "Mix_00_2.D", 30.0, 571.5)}  # the second is tentative: its own file has no exact peak


def test_every_evidence_id_of_a_trait_is_kept(spark):
    from florilege.operators import traits

    cols = "query string, cid bigint, trait_type string, trait_group string, trait_value string, source string, confidence string, evidence_id string, extraction_rule string"
    rows = [("a", None, "use", "odor", "Citrus", "x", "high", e, None) for e in ("e1", "e2", "e2", " ", None, "e3")] + [("b", 1, "use", "odor", "mint", "x", "high", None, None)]
    built = traits.build_traits(spark.createDataFrame(rows, cols))
    got = {(r.query, r.evidence_id) for r in traits.trait_evidence(traits.dedupe_traits(built), links=traits.evidence_links(built)).collect()}
    assert got == {("a", "e1"), ("a", "e2"), ("a", "e3"), ("b", None)}


def test_every_exact_prefix_and_contained_name_is_found(spark, small):
    library = [(r["library_id"], [x.strip(" ").lower() for x in ";".join(filter(None, (r["compound"], r["also_called"]))).split(";") if x.strip(" ")], 0 if (r["compound_type"] or "").startswith("class") else 1) for r in rows_of(small, "chemical_library")]

    def score(q, parts):
        return 0 if q in parts else 1 if any(x.startswith(q) for x in parts) else 2 if any(q in x for x in parts) else 3

    got = {}
    for r in registry.queries()["name_matches"](spark, small).collect():
        got.setdefault(r.query, {})[r.match_rank] = (r.score, r.library_id)
    seen = 0
    for query in {r["compound_name"].lower() for r in rows_of(small, "standard_data") if r["compound_name"] is not None}:
        q = " ".join(query.split())
        best = sorted((score(q, parts), r, i) for i, parts, r in library if q)
        want = [(s, i) for s, _, i in best if s < 3][:3]
        mine = got.get(query, {})
        assert [mine[k + 1] for k in range(len(want))] == want
        seen += bool(want)
    assert seen > 20


def test_signature_sees_repeated_rows(spark):
    from florilege.operators.quality import table_signature

    of = lambda *rows: table_signature(spark.createDataFrame([(x,) for x in rows], "a string")).first()["signature"]
    assert of("x", "x", "z") != of("y", "y", "z")
    assert of("x", "y") == of("y", "x") and of("x", "x") != of()


def test_all_aliases_and_the_signature_are_returned(spark, tmp_path):
    spark.createDataFrame([("Aa bb (L.) Mill. 1768", "Aa cc")], "species string, accepted_species_name string").write.parquet(f"{tmp_path}/plant_metadata.parquet")
    spark.createDataFrame([("x",)], "a string").write.parquet(f"{tmp_path}/plant_compounds.parquet")
    spark.createDataFrame([(1, "Acacia Erioloba")], "list_id bigint, species string").write.parquet(f"{tmp_path}/plant_list.parquet")
    ask = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.alias, r.alias_type) for r in ask("species_aliases")} == {("Aa cc", "accepted_name"), ("Aa bb (L.) Mill. 1768", "typed_name"), ("Aa bb", "core_name")}
    assert [r.core_name for r in ask("taxon_names")] == ["Acacia erioloba"]
    assert ask("table_signature")[0].signature != 0


def test_large_amounts_are_kept(spark, tmp_path):
    area = lambda q: 3 + 2 * math.log(q)
    rows = [("c", f"Cal_{q}", area(q), 10.0 * q) for q in range(1, 9)] + [("x", "Mix_1", area(1e7), 50.0), ("y", "Mix_1", 0.0, 50.0)]
    spark.createDataFrame(rows, "compound_name string, file_name string, component_area double, match_factor double").write.parquet(f"{tmp_path}/standard_data.parquet")
    got = {r.compound: (r.model, r.amount) for r in registry.queries()["gcms_external_standard"](spark, str(tmp_path)).filter("file_name = 'Mix_1'").collect()}
    assert got["x"] == ("log", pytest.approx(1e7, rel=1e-6)) and got["y"] == ("log", None)
