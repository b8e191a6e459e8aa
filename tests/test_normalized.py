import json

import pytest
from pyspark.sql import functions as F

from florilege.operators import context, normalized, olfaction, quality, record_tables, traits
from florilege.sources import records, tables


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_classes_of_every_source(spark):
    df = lambda data, schema: spark.createDataFrame(data, "query string, cid bigint, " + schema)
    out = normalized.chemical_classes(
        reactive=df([("a", 1, "Acids, weak"), ("a", 1, "None"), ("a", 1, None)], "value string"), natural=df([("a", 1, "L1", "Alkaloid; lignan"), ("b", None, None, "")], "record string, product_classes string"),
        paths=df([("a", 1, 7, "Terpenoids > Mono > Menthane"), ("b", None, 8, "Lipids"), ("c", 2, 9, None)], "hnid bigint, path string"), subjects=df([("a", 1, "D02.455; A1.2", "Antioxidants"), ("b", 2, None, "x")], "tree_numbers string, label string"),
        pathways=df([("a", 1, "map1", "Sugar", "Carbohydrate metabolism"), ("a", 1, "map2", "y", None)], "id string, name string, pathway_group string"), enzymes=df([("a", 1, "1.1.1.1", "ADH", "Oxidoreductases")], "ec_number string, name string, enzyme_class string"),
    )
    got = rows(out, "query", "class_type", "class_name", "class_group")
    assert {("a", "reactive_group", "Acids, weak", "acids weak"), ("a", "natural_product_class", "Alkaloid", "alkaloid"), ("a", "natural_product_superclass", "Terpenoids", "terpenoids"), ("a", "natural_product_class", "Mono", "terpenoids"), ("a", "natural_product_subclass", "Menthane", "terpenoids")} <= got
    assert ("b", "natural_product_superclass", "Lipids", "lipids") in got and ("a", "mesh_tree_category", "Antioxidants", "Chemicals and Drugs") in got and ("a", "mesh_tree_category", "Antioxidants", "Anatomy") in got and ("b", "mesh_tree_category", "x", None) in got
    assert ("a", "pathway_group", "Sugar", "Carbohydrate metabolism") in got and ("a", "enzyme_class", "ADH", "Oxidoreductases") in got and len(got) == 12
    assert normalized.chemical_classes(reactive=df([], "value string")).count() == 0


def test_hazards_and_uses(spark):
    texts = spark.createDataFrame([("a", 1, "Danger: H319, h225 in rat; eye"), ("b", None, "LD50 oral 1200 mg/kg (mouse), LD50 5 g/kg; toxic"), ("c", None, "sugar"), ("d", None, None), ("e", None, "")], "query string, cid bigint, text string")
    out = normalized.chemical_hazards(texts)
    assert rows(out, "query", "hazard_code", "hazard_group", "toxicity_metric", "toxicity_value") == {
        ("a", "H319", "eye_damage_irritation", None, None), ("a", "H225", "flammability_reactivity", None, None), ("b", None, "acute_toxicity", None, None), ("b", None, "acute_toxicity", "LD50", 1200.0), ("b", None, "acute_toxicity", "LD50", 5.0),
    }
    flavours = spark.createDataFrame([("a", 1, "sweet; Lemon", "GRAS"), ("a", 1, "lemon|", None)], "query string, cid bigint, descriptors string, gras string")
    assert rows(normalized.chemical_uses(flavours=flavours), "use_domain", "use_term", "use_group") == {("sensory", "sweet", "sweet"), ("sensory", "Lemon", "citrus"), ("sensory", "lemon", "citrus"), ("regulatory", "GRAS", "flavor_regulatory")}


def test_traits_of_many_tables(spark):
    df = lambda schema, *data: spark.createDataFrame(data, "query string, cid bigint, " + schema)
    out = normalized.all_traits({
        "hazards": df("hazard_code string, target_organ string, confidence string, extraction_rule string", ("a", 1, "H319", "eye; skin", "high", "ghs")), "uses": df("use_type string, use_term string, use_group string, source_table string", ("a", 1, "odor", "citrus", "citrus", "FEMAProfile")),
        "measurements": df("property string, value double, confidence string", ("a", 1, "XLogP", 2.0, "high"), ("a", 1, "odd", 2.0, "high")), "taxonomy": df("genus string, natural_product_class string, taxonomy_id string", ("a", 1, "Salix", "alkaloid; lignan", "77")),
        "participants": df("participant_id string, participant_name string", ("a", 1, "C00001", "Water")), "terms": df("term_type string, term string", ("a", 1, "x", "word")), "classes": df("class_type string, class_name string, class_group string, class_system string, class_id string", ("b", None, "mesh_tree_category", None, "Anatomy", "MeSH", "A1")),
    })
    done = traits.dedupe_traits(traits.build_traits(out))
    got = {(r["trait_type"], r["trait_group"], r["trait_value_clean"]): r for r in done.collect()}
    assert set(got) == {
        ("hazard", "hazard_code", "h319"), ("hazard", "target_organ", "eye"), ("hazard", "target_organ", "skin"), ("use", "odor", "citrus"), ("use", "use_group", "citrus"), ("property", "xlogp_bin", "balanced xlogp 0 3"), ("taxonomy", "genus", "salix"),
        ("taxonomy", "natural_product_class", "alkaloid"), ("taxonomy", "natural_product_class", "lignan"), ("reaction", "participant_id", "c00001"), ("reaction", "participant_name", "water"), ("vocabulary", "x", "word"), ("chemical_class", "mesh_tree_category", "anatomy"),
    }
    assert got["reaction", "participant_name", "water"]["matrix_key"] is None and got["vocabulary", "x", "word"]["matrix_key"] is None and got["hazard", "hazard_code", "h319"]["evidence_id"] == "H319" and got["use", "odor", "citrus"]["source_database"] == "FEMA"
    onto = {r["ontology_term"]: (r["ontology_id"], r["ontology_id_source"]) for r in traits.trait_ontology(done).collect()}
    assert onto["h319"] == ("H319", "GHS") and onto["salix"] == ("77", "NCBI Taxonomy") and onto["c00001"] == ("C00001", "KEGG COMPOUND")
    with pytest.raises(ValueError):
        normalized.all_traits({"odd": done})


def test_profile_of_73_columns(spark):
    df = lambda schema, *data: spark.createDataFrame(data, "query string, " + schema)
    out = normalized.derived_profile(df("x int", ("a", 1), ("a", 2), ("b", 3)), {
        "properties": df("cid bigint, molecular_formula string, molecular_weight double, exact_mass double, xlogp double, tpsa double, h_bond_donor_count double", ("a", 7, "C7H5NO2", 137.1, 137.0, 1.0, 50.0, 1.0)), "coverage": df("source string, n_records bigint", ("a", "LOTUS", 2), ("a", "FEMA", 0)),
        "occurrences": df("organism string, kingdom string, family string, genus string", ("a", "S n", "Plantae", "F1", "S"), ("a", "S m", "Plantae", "F1", "S"), ("a", "T m", "Fungi", "F2", "T")),
        "bioassays": df("aid bigint, activity_class string, target_name string, value double, unit string", ("a", 1, "active", "x", 2.0, "uM"), ("a", 2, "inactive", "y", 40.0, "µM"), ("a", 3, "active", "x", 9.0, "nM")), "pathways": df("pathway_group string", ("a", "Lipid metabolism")),
    })
    assert len(out.columns) == 73
    a, b = (r.asDict() for r in out.orderBy("query").collect())
    assert (a["organism_count"], a["dominant_kingdom"], a["taxonomic_breadth"], a["is_fungal_occurring"], a["is_natural_product"], a["is_flavor_ingredient"]) == (3, "Plantae", "multi_kingdom", True, True, False)
    assert (a["bioassay_count"], a["active_target_count"], a["min_potency_um"], a["median_potency_um"], a["potent_activity_count"]) == (3, 1, 2.0, 21.0, 1)
    assert (a["polarity_bin"], a["volatility_proxy"], a["oxygenated"], a["nitrogenous"], a["confidence_score"]) == ("moderate_TPSA_40_90", "more_volatile_proxy", True, False, 0.75)
    assert b["occurrence_count"] == 0 and b["taxonomic_breadth"] == "none" and not b["has_bioactivity"] and b["confidence_score"] == 0.0


def test_sections_of_any_depth(spark):
    inner = {"TOCHeading": "leaf", "Information": [{"Name": "n", "ReferenceNumber": 3, "Value": {"Number": [1.5], "Unit": "g"}}]}
    for k in range(9):
        inner = {"TOCHeading": f"s{k}", "Section": [inner]}
    got = records.nested_sections(spark.createDataFrame([(1, json.dumps({"Record": {"Section": [inner]}}))], "id int, d string"), "id", "d").collect()
    assert [(r["path"].count(" > "), r["path"].endswith("leaf"), r["numbers"], r["unit"]) for r in got] == [(9, True, [1.5], "g")]
    long = "x" * 1_200_000
    assert records.flat_record_fields(spark.createDataFrame([(1, "NAME        " + long)], "id int, b string"), "id", "b").first()["value"] == long


def test_parsed_responses(spark):
    one = lambda text: spark.createDataFrame([(1, text), (2, None), (3, "{bad")], "id int, d string")
    props = records.property_table(one(json.dumps({"PropertyTable": {"Properties": [{"CID": 5, "XLogP": 1.2, "Title": None}]}})), "id", "d")
    assert rows(props, "cid", "name", "value") == {(5, "XLogP", "1.2")}
    assert rows(records.synonym_rows(one(json.dumps({"InformationList": {"Information": [{"CID": 5, "Synonym": ["a", " a ", "b", ""]}]}})), "d"), "cid", "synonym") == {(5, "a"), (5, "b")}
    assert [r["x"] for r in spark.createDataFrame([("CID: 12",), ("cid 7",), ("x cid 7",), (None,)], "t string").select(records.alias_cid(F.col("t")).alias("x")).collect()] == [12, 7, None, None]
    nodes = [{"NodeID": "n2", "ParentID": ["n1"], "Information": {"Name": "Mono", "HNID": 2}}, {"NodeID": "n3", "ParentID": ["n2"], "Information": {"Name": "Menthane", "HNID": 3, "Match": True}}, {"NodeID": "n1", "ParentID": ["root"], "Information": {"Name": "Terpenes", "HNID": 1}}, {"NodeID": "n4", "ParentID": ["n4"], "Information": {"Name": "loop", "HNID": 4, "Match": True}}]
    trees = {"Hierarchies": {"Hierarchy": [{"SourceName": "LOTUS", "Information": {"Name": "T"}, "Node": nodes}]}}
    assert rows(records.classification_paths(one(json.dumps(trees)), "id", "d"), "class_name", "path", "hnid") == {("Menthane", "Terpenes > Mono > Menthane", 3), ("loop", "loop", 4)}
    assay = {"PC_AssayContainer": [{"assay": {"descr": {"aid": {"id": 9}, "name": "A", "target": [{"name": "COX", "mol_id": {"protein_accession": "P1", "gene_id": 4}, "organism": {"org": {"taxname": "Homo sapiens"}}}], "results": [{"name": "IC50"}, {"name": "Ki"}]}}}]}
    assert rows(records.assay_details(one(json.dumps(assay)), "id", "d"), "aid", "targets", "genes", "organisms", "endpoints", "n_endpoints") == {(9, "COX", "4", "Homo sapiens", "IC50; Ki", 2)}
    assert rows(records.key_values(spark.createDataFrame([(1, "lead\nspecies: A b\nmore\nTissue:\nnote: x: y"), (2, None)], "id int, t string"), "id", "t"), "name", "value") == {("species", "A b more"), ("note", "x: y")}


def test_record_tables_without_ids(spark):
    recs = spark.createDataFrame([(1, "REACTION", "R00001 R00002"), (1, "REACTION", "none"), (1, "ENZYME", "1.2.3.4"), (1, "MODULE", "M00009  The path")], "record int, field string, value string")
    links = spark.createDataFrame([(2, "enzyme", "2.1.1.1"), (2, "reaction", None)], "record int, target_db string, target_id string")
    meta = spark.createDataFrame([("reaction", "R00001", "name", "d", "C00001 <=> C00002"), ("reaction", "R00001", None, None, None)], "db string, id string, name string, definition string, equation string")
    assert rows(record_tables.reactions(recs, links, meta), "record", "reaction_id", "name", "evidence") == {(1, "R00001", "name", "record"), (1, "R00002", None, "record"), (1, None, None, "record"), (2, None, None, "link")}
    assert rows(record_tables.enzymes(recs, links, meta), "ec_number", "enzyme_class") == {("1.2.3.4", "Oxidoreductases"), ("2.1.1.1", "Transferases")}
    assert rows(record_tables.modules(recs, links, meta), "module_id", "name") == {("M00009", "The path")}
    assert rows(record_tables.link_targets(links), "target_db", "target_id") == {("enzyme", "2.1.1.1")}
    profile = record_tables.record_profile(recs, links, meta, recs.limit(0).selectExpr("record", "field as pathway_group", "value as name"))
    assert rows(profile["participants"], "reaction_id", "side", "participant_id") == {("R00001", "substrate", "C00001"), ("R00001", "product", "C00002")}


def test_context_is_merged_and_applied(spark):
    ev = [("Aa bb", "x", "r1", "tissue", "root", "low", "No", "t1", "m"), ("AA bb", "X", "r1", "tissue", "root", "medium", "No", "t2", None), ("Aa bb", "x", None, "tissue", "leaf", "high", "No", None, None), ("Aa bb", "x", None, "tissue", "bark", "low", "No", None, None), ("Aa bb", "x", "r9", "method", "NMR", "high", "Yes", None, None), ("Aa bb", "x", "r1", "method", "unknown", "high", "No", None, None)]
    merged = context.merge_context(spark.createDataFrame(ev, "species string, compound string, record string, kind string, value string, confidence string, review string, text string, rule string"))
    assert {(r["value"], r["confidence"], r["review"], r["texts"], r["n_rows"]) for r in merged.collect() if r["value"] == "root"} == {("root", "medium", "No", "t1; t2", 2)}
    occ = [(1, "Aa bb", "x", "r1", None, "unknown", None), (2, "Aa bb", "x", "r2", None, None, None), (3, "Aa bb", "x", "r1", None, "stem", None), (4, None, None, None, None, None, None)]
    got = rows(context.apply_context(spark.createDataFrame(occ, "occurrence_id int, species string, compound string, record string, plant_part string, tissue string, method string"), merged), "occurrence_id", "tissue", "method")
    assert got == {(1, "root", None), (2, "leaf", None), (3, "stem", None), (4, None, None)}


def test_identity_review_conflicts_change_nothing(spark):
    df = spark.createDataFrame([(1, "n", "OLD"), (2, "m", None), (3, "k", "K")], "occurrence_id int, compound_name_clean string, inchikey string")
    review = spark.createDataFrame([("n", "Accept", " new "), ("m", "accept", "A"), ("m", "accept", "B"), ("k", "reject", None)], "compound_name_clean string, decision string, reviewed_inchikey string")
    assert rows(quality.apply_identity_review(df, review), "occurrence_id", "inchikey", "identity_decision") == {(1, "NEW", "accepted"), (2, None, "conflicting"), (3, "K", "rejected")}


def test_files_in_and_out(spark, tmp_path):
    df = spark.range(7).selectExpr("id", "cast(id as string) as t")
    assert tables.write_counted(df, str(tmp_path / "w"), 7, 2) == 7 and len(list((tmp_path / "w").glob("*.parquet"))) >= 4
    with pytest.raises(ValueError, match="7 rows written, 8 expected"):
        tables.write_counted(df, str(tmp_path / "v"), 8, formats="csv")
    assert not (tmp_path / "v").exists()
    (tmp_path / "cache" / "kegg").mkdir(parents=True)
    (tmp_path / "cache" / "kegg" / "a.json").write_text("{}")
    (tmp_path / "cache" / "b.json").write_text("{...}")
    files = tables.cached_files(spark, str(tmp_path / "cache"))
    assert rows(files, "provider", "file", "n_bytes") == {("kegg", "kegg/a.json", 2), ("(none)", "b.json", 5)} and tables.cache_summary(files).count() == 2
    (tmp_path / "x.csv").write_text("Species,Name\nAa bb,n1\nAa bb,n1\n")
    (tmp_path / "y.jsonl").write_text('{"taxon": "Cc dd", "compound": "n2"}\n')
    many = tables.read_many(spark, [str(tmp_path / "x.csv"), str(tmp_path / "y.jsonl")], {"species": ["taxon", "species"], "compound": ["compound", "name"]})
    assert rows(many, "species", "compound", "source_file") == {("Aa bb", "n1", "x.csv"), ("Cc dd", "n2", "y.jsonl")}


def test_treatments_are_aligned_or_named():
    assert olfaction.align_treatments(["Mix  1", "Ext"], ["mix 1", "Extract"], {"extract": "Ext"}) == [("Mix 1", "Mix  1", "mix 1"), ("Ext", "Ext", "Extract")]
    with pytest.raises(ValueError, match="without a counterpart"):
        olfaction.align_treatments(["a"], ["b"])
    with pytest.raises(ValueError, match="twice"):
        olfaction.align_treatments(["a", "A "], ["a"])
