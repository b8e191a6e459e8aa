from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from florilege.functions import extract, rules, text
from florilege.operators import evidence, gcms, olfaction, providers, quality, similarity, traits
from florilege.sources import records, tables


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first()["r"]


def test_text_rules(spark):
    assert one(spark, text.squish, " a\t b\r\n ") == "a b"
    assert [one(spark, text.known, v) for v in ("NA", " None ", "", None, "x")] == [False, False, False, False, True]
    assert one(spark, text.words_key, "-Beta, αB 2​x!") == "2 beta x αb"
    assert one(spark, text.words_key, None) == one(spark, text.words_key, " ?") == ""
    assert one(spark, text.words_key, "x" * 100_000) == "x" * 100_000
    assert one(spark, text.slug, "__a b--C__") == "a_b_C"
    assert one(spark, text.key_value, None) == "<NA>"


def test_rules(spark):
    assert one(spark, rules.formula_mass, "C6H12O6") == 180.063388
    assert one(spark, rules.formula_mass, "Xx2") is None and one(spark, rules.formula_mass, "c6") is None
    assert one(spark, lambda c: rules.formula_has(c, "N"), "C7H5NO") is False  # a single atom before another is not seen
    assert one(spark, rules.property_name, "XLogP3") == "logp"
    assert one(spark, rules.unit_name, "°C") == "C"
    assert one(spark, rules.value_relation, "about 3 to 7 mg") == "range" and one(spark, rules.value_relation, None) == "equal"
    assert [one(spark, rules.mw_bin, v, "double") for v in (149.9, 150.0, 750.0, None)] == ["small_<150_Da", "medium_150_350_Da", "very_large_>=750_Da", None]
    assert rules.confidence_threshold("medium") == 0.65 and rules.confidence_threshold("x") == 0 and rules.confidence_threshold(7) == 1


def test_standard_measurements(spark):
    df = spark.createDataFrame([("Boiling point", 212.0, "deg F", "212 F"), ("solubility", 2.0, "g/L", "< 2"), (None, None, None, None), ("density", 900.0, "kg/m3", "ca. 900")], "p string, v double, u string, t string")
    got = [(r["standard_value"], r["standard_unit"], r["bin"], r["relation"]) for r in rules.standardize_measurements(df, F.col("p"), F.col("v"), F.col("u"), F.col("t")).collect()]
    assert got[0] == (100.0, "C", "volatile_boiling_point_100_200_C", "equal")
    assert got[1] == (2000.0, "mg/L", "high_solubility_ge_1000_mg_L", "less_than")
    assert got[2][0] is None and got[3] == (0.9, "g/mL", "water_like_density_0_8_1_2_g_mL", "approximate")


def test_identifiers_and_reactions(spark):
    df = spark.createDataFrame([(1, "CAS 64-17-5, ChEBI: 123 PMID 99 H319 doi 10.1234/ab.c C00031"), (2, None), (3, "")], "id int, t string")
    got = {(r["identifier_type"], r["identifier"]) for r in extract.extract_identifiers(df, "id", "t").collect()}
    assert {("CAS", "64-17-5"), ("ChEBI", "CHEBI:123"), ("PubMed", "PMID:99"), ("GHS", "H319"), ("KEGG", "C00031"), ("DOI", "10.1234/ab.c")} <= got
    eq = spark.createDataFrame([(1, "C00031 + 2 C00002 <=> C00103", "Glucose + 2 ATP <=> G1P"), (2, None, None), (3, "none", "")], "id int, e string, d string")
    rows = [tuple(r) for r in extract.reaction_participants(eq, "id", "e", "d").orderBy("side", "place").collect()]
    assert rows == [(1, "product", 0, "C00103", "G1P"), (1, "substrate", 0, "C00031", "Glucose"), (1, "substrate", 1, "C00002", "ATP")]


def test_taxon_names(spark):
    names = ["Acacia Erioloba", "Artocarpus Sp.", "Acer", "Vitis Berlandieri X Riparia", None, " 'TIRCELIA RINTLURANA'"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [(r["c"], r["s"]) for r in df.select("i", providers.taxon_core_name(F.col("n")).alias("c"), providers.name_status(F.col("n")).alias("s")).orderBy("i").collect()]
    assert got[0] == ("Acacia erioloba", "parsed_species") and got[1][1] == got[2][1] == "name_needs_review" and got[4][1] == "blank" and got[5][0] == "Tircelia rintlurana"


def test_fingerprints_against_numpy(spark):
    rng = np.random.default_rng(3)
    bits = rng.random((60, 130)) < 0.3
    bits[7] = bits[3]
    bits[9] = False
    df = spark.createDataFrame([(i, [bool(x) for x in b]) for i, b in enumerate(bits)], "id bigint, b array<boolean>").select("id", similarity.pack_bits(F.col("b")).alias("words"))
    assert [r["n"] for r in df.select("id", similarity.popcount(F.col("words")).alias("n")).orderBy("id").collect()] == bits.sum(1).tolist()
    got = {(r["a"], r["b"]): r["tanimoto"] for r in similarity.similar_pairs(df, "id", "words", 0.3).collect()}
    want = {}
    for i in range(60):
        for j in range(i + 1, 60):
            u = (bits[i] | bits[j]).sum()
            t = round(float((bits[i] & bits[j]).sum() / u), 6) if u else 0
            if t >= 0.3 and 7 not in (i, j):
                want[i, j] = t
    assert got == want
    classes = {r["id"]: r["representative"] for r in similarity.fingerprint_classes(df, "id", "words").collect()}
    assert classes[7] == 3 and classes[5] == 5


def test_base64_fingerprints(spark):
    import base64

    raw = bytes(4) + bytes(range(1, 112))
    df = spark.createDataFrame([(base64.b64encode(raw).decode().rstrip("="),), ("AAAA",), (None,)], "t string")
    got = [r["n"] for r in df.select(similarity.popcount(similarity.unpack_base64(F.col("t"))).alias("n")).collect()]
    assert got[0] == sum(bin(x).count("1") for x in raw) and got[1] is None


def test_grades_of_four_rows(spark):
    cols = "occurrence_id bigint, species string, compound_name string, compound_name_clean string, compound_id string, source_database string, source_record_id string, evidence_tier string, matched_rank string, occurrence_status string, confidence string, smiles string, inchikey string, cid bigint, comparable_for_matrix string, comparison_scope string, curation_flag string"
    row = lambda i, tier, rank, name="n": (i, "s", name, name, "c" if name else None, "DB", f"r{i}", tier, rank, "reported", "high", "C", None, None, "Yes", "volatiles", None)
    df = spark.createDataFrame([row(1, "direct_species_database", "species"), row(2, "direct_species_database", "species"), row(3, "pubtator_candidate", None), row(4, None, None, None)], cols)
    review = spark.createDataFrame([(2, None, None, None, None, "exclude")], "occurrence_id bigint, species string, compound_name_clean string, source_database string, source_record_id string, decision string")
    got = [r["evidence_grade"] for r in evidence.grade_evidence(df, review).orderBy("occurrence_id").collect()]
    assert got == ["direct_species_database_record", "excluded_by_review", "pubtator_pubmed_candidate_only", "unresolved_or_review_required"]
    assert evidence.grade_evidence(df.limit(0)).count() == 0


def test_features_keep_the_universe(spark):
    df = spark.createDataFrame([("A", "c1", "x y", "high"), ("A", "c2", "x y", "low"), ("B", "c1", "z", None), ("B", None, "NA", None)], "species string, compound_id string, f string, confidence string")
    uni = spark.createDataFrame([("B",), ("A",), ("C",)], "species string")
    wide = {r["species"]: (r["f__x_y"], r["f__z"]) for r in evidence.feature_matrix(evidence.feature_long(df, "f"), uni, ["f__x_y", "f__z"]).collect()}
    assert wide == {"A": (2.0, 0.0), "B": (0.0, 1.0), "C": (0.0, 0.0)}
    assert {r["value"] for r in evidence.feature_long(df.filter("species = 'A'"), "f", "confidence").collect()} == {1.25}


def test_traits(spark):
    cols = "query string, cid bigint, trait_type string, trait_group string, trait_value string, source string, confidence string, evidence_id string, extraction_rule string"
    rows = [("a", 1, "hazard", "hazard_code", "H319", "PubChem", "high", "e1", "ghs"), ("a", 1, "hazard", "hazard_code", " h319 ", "KEGG", "low", None, None), ("b", None, "use", "odor", "citrus", "x", None, None, None), ("b", None, "use", "odor", None, "x", None, None, None)]
    got = traits.dedupe_traits(traits.build_traits(spark.createDataFrame(rows, cols))).orderBy("query").collect()
    assert [(r["matrix_key"], r["confidence_score"], r["n_rows"]) for r in got] == [("hazard__hazard_code__h319", 1.0, 2), ("use__odor__citrus", 0.65, 1)]
    term, group, conf = traits.term_lookup(F.col("c"))
    looked = [tuple(r) for r in spark.createDataFrame([("Lemon peel",), (" H319 ",), ("h290",), ("odd Thing",), (None,)], "c string").select(term, group, conf).collect()]
    assert looked == [("citrus", "citrus", "high"), ("h319", "eye_damage_irritation", "high"), ("h290", "hazard_code", "high"), ("odd thing", "odd thing", "medium"), (None, None, "low")]


def test_standards(spark):
    areas = spark.createDataFrame([("IS", "f1", 100.0), ("x", "f1", 50.0), ("x", "f2", 50.0), ("IS", "f2", 0.0), ("x", "f3", 1.0)], "compound string, file_name string, area double")
    got = {r["file_name"]: r["amount"] for r in gcms.internal_standard(areas, "IS").collect()}
    assert got == {"f1": 95.25, "f2": None, "f3": None}
    assert {tuple(r) for r in gcms.standard_problems(areas, "IS").collect()} == {("f2", "zero"), ("f3", "missing")}
    cal = spark.createDataFrame([(float(q), 3.0 + 2.0 * q) for q in range(1, 9)], "quantity double, component_area double")
    out = {r["area"]: (r["model"], r["amount"]) for r in gcms.external_standard(areas, cal).collect()}
    assert out[50.0] == ("linear", 23.5) and out[0.0][1] is None


def test_flat_records_links_and_json(spark):
    body = "ENTRY       C00001\nNAME        Water;\n            H2O\n///\n"
    df = spark.createDataFrame([(1, body, '{"a": 1, "b": null}'), (2, None, "broken{"), (3, "", None)], "id int, body string, js string")
    assert [tuple(r) for r in records.flat_record_fields(df, "id", "body").orderBy("field", "place").collect()] == [(1, "ENTRY", 1, "C00001"), (1, "NAME", 1, "Water"), (1, "NAME", 2, "H2O")]
    assert [tuple(r) for r in records.json_scalars(df, "id", "js").collect()] == [(1, "a", "1")]
    nested = '{"Record": {"Section": [{"TOCHeading": "Safety", "Section": [{"TOCHeading": "GHS", "Information": [{"Name": "Code", "ReferenceNumber": 7, "Value": {"StringWithMarkup": [{"String": "H319"}]}}]}]}]}}'
    got = records.nested_sections(spark.createDataFrame([(1, nested), (2, None), (3, "bad{")], "id int, d string"), "id", "d").collect()
    assert [(r["path"], r["text"], r["reference"]) for r in got] == [("Safety > GHS", "H319", 7)]
    links = spark.createDataFrame([(1, "cpd:C1\tpath:map001\ncpd:C1\tpath:map001")], "id int, b string")
    assert [tuple(r)[1:] for r in records.link_lines(links, "id", "b").collect()] == [("cpd:C1", "path", "map001")]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\n c', None), (2, "", "x")], "id int, t string, u string")
    tables.write_bundle({"one": df, "none": df.limit(0)}, str(tmp_path / "b"))
    checks = {tuple(r) for r in tables.validate_bundle(spark, str(tmp_path / "b"), {"one": ["id", "missing"]}).collect()}
    assert ("one", "signature", "pass") in checks and ("one", "required_columns", "fail") in checks and ("none", "row_count", "pass") in checks
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "t.csv"))
    assert {r["t"] for r in tables.read_table(spark, str(tmp_path / "t.csv")).collect()} >= {'a "b"\n c'}
    assert tables.snake_names(spark.createDataFrame([(1, 2)], "`A b` int, `a_B` int")).columns == ["a_b", "a_b_2"]


def test_olfaction_shares(spark):
    df = spark.createDataFrame([("t", "a", 98.0), ("t", "b", 1.5), ("t", "c", 0.5), ("z", "a", 0.0)], "treatment string, compound string, abundance double")
    got = {r["compound"]: r["relative_abundance"] for r in olfaction.relative_abundance(df, 0.01).collect()}
    assert set(got) == {"a", "b"} and abs(sum(got.values()) - 1) < 1e-12


def test_quality_of_an_empty_and_a_bad_table(spark):
    rows = (quality.ColumnRule("id", "integer", True), quality.ColumnRule("gone", required=True), quality.ColumnRule("c", allowed=("x",)))
    df = spark.createDataFrame([("1", "x"), ("q", "y"), (None, " ")], "id string, c string")
    assert {tuple(r) for r in quality.table_issues(df, rows).collect()} == {("id", "blank_required", 1), ("id", "bad_value", 1), ("c", "bad_value", 1), ("gone", "missing_column", 0)}
    assert quality.table_quality(df.limit(0), rows).first()["status"] == "empty"


def test_orphan_stream_goes_on_after_a_restart_and_takes_a_replay(spark, tmp_path):
    from florilege.streaming.incremental import OrphanStream

    t = datetime(2024, 1, 1)
    schema = "ref_key string, at timestamp_ntz, row_id bigint, d_active int, d_begun int"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    source = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    seen = []
    new = lambda: OrphanStream(spark, str(tmp_path / "state"), lambda i, settled: seen.extend((i, *tuple(r)[1:]) for r in settled.collect()))
    put("a", [("k", t, 1, 0, 0), ("q", t, 2, 0, 0)])
    new().start(source(), str(tmp_path / "cp")).awaitTermination()
    assert seen == [] and new().finished() == [0] and new().state_of(0)[1].count() == 2
    put("b", [("k", datetime(2024, 2, 1), None, 1, 1)])
    new().start(source(), str(tmp_path / "cp")).awaitTermination()  # another object, as after a restart
    assert seen == [(1, 1, "late")] and new().state_of(1)[0].pending.count() == 1
    again = spark.createDataFrame([("k", datetime(2024, 2, 1), None, 1, 1)], schema)
    new().batch(again, 1)  # the same batch again: the same rows and the same state
    assert seen == [(1, 1, "late")] * 2
    assert {tuple(r) for r in new().state_of(1)[0].index.collect()} == {("k", 1, 1, 1), ("q", 0, 0, 1)}
    new().batch(spark.createDataFrame([("k", datetime(2024, 3, 1), None, -1, 0), ("k", datetime(2024, 3, 2), 3, 0, 0)], schema), 2)
    assert seen[2:] == [(2, 3, "deleted")] and new().finished() == [1, 2]


def test_context_vectors(spark):
    from florilege.operators import context

    parts = {None: "unknown", "root exudate": "exudate_rhizosphere", "root and leaf": "root_belowground", "foliar tissue": "leaf", "stem": "stem_shoot", "bark": "bark_wood", "flower": "flower", "seedling seed": "whole_plant", "seed": "fruit_seed", "aerial tissue": "aerial", "whole plant": "whole_plant", "vascular tissue": "vascular", "secretory gland": "secretory", "epidermis": "epidermal", "endophytic microbial community": "microbial", "callus culture": "whole_plant", "essential oil": "extract_unspecified", "not a biological context": "other"}
    methods = {None: "unknown", "GC-MS": "gc_ms", "LC-MS": "lc_ms", "UPLC": "hplc", "NMR": "nmr", "mass spectrometry": "mass_spectrometry", "chromatography": "chromatography", "infrared spectroscopy": "spectroscopy", "literature curation": "literature_curation", "provider record": "database_record", "unclassified assay": "other"}
    for rule, vectors in ((context.plant_part, parts), (context.method, methods)):
        df = spark.createDataFrame([(k,) for k in vectors], "c string")
        assert [r["r"] for r in df.select(rule(F.col("c")).alias("r")).collect()] == list(vectors.values())
    names = ["α-carotene", "β-carotene", "(+)-limonene", "(-)-limonene", "β alanine", "alanine", " ", None]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert [r["r"] for r in df.select(context.clean_compound(F.col("c")).alias("r")).collect()] == ["alpha_carotene", "beta_carotene", "plus_limonene", "minus_limonene", "beta_alanine", "alanine", None, None]
    compounds = {"salicin": "specialized_metabolites", "caffeine": "specialized_metabolites", "glucose": "primary_metabolites", "linoleic acid": "lipids_fatty_acids", "unknownoid": "unknown", "abscisic acid": "plant_hormone_signaling"}
    df = spark.createDataFrame([(n,) for n in compounds], "c string")
    none = F.lit(None).cast("string")
    assert [r["r"] for r in df.select(context.comparability(none, none, F.col("c"), F.lit(False))[0].alias("r")).collect()] == list(compounds.values())


def test_text_context_needs_the_species_in_the_sentence(spark):
    from florilege.operators import context

    df = spark.createDataFrame([(1, "Salix nigra leaf by GC-MS. The bark too.", "Salix nigra"), (2, None, "x"), (3, "", None)], "id int, t string, s string")
    got = {(r["kind"], r["value"]) for r in context.text_context(df, "id", "t", "s").collect()}
    assert got == {("plant_part", "leaf"), ("method", "gc_ms")}


def test_index_with_fallback(spark):
    records = spark.createDataFrame([("r1", "Aa bb", "c1", "S"), ("r2", "aa cc", "c2", "S"), ("r2", "aa cc", "c2", "S"), ("r3", None, "c3", "S")], "record_id string, species string, compound_id string, source string")
    compounds = spark.createDataFrame([("c1", "caffeine", None), ("c2", "epicatechin", "K")], "compound_id string, name string, inchikey string")
    taxa = spark.createDataFrame([("aa bb", "Aa", "Fam")], "species_key string, genus string, family string")
    index = providers.build_index(records, compounds, taxa)
    plants = spark.createDataFrame([(1, "aa BB", None, None), (2, "", None, None)], "plant_id int, species string, genus string, family string")
    got = {(r["matched_rank"], r["name"]) for r in providers.query_index(plants, index).collect()}
    assert got == {("species", "caffeine"), ("genus", "epicatechin")}
    assert providers.query_index(plants, index, max_records=1).first()["name"] == "caffeine"
