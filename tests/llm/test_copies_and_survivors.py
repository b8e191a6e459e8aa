import random
from collections import defaultdict
from datetime import datetime, timedelta

from florilege.functions.text import GREEK  # noqa: F401 - the core is importable beside the subpackage
from florilege.llm import copies, survivors

T0 = datetime(2024, 1, 1)
COLS = "occurrence_id bigint, species string, compound_name string, compound_name_clean string, v string, w double, retrieved_at timestamp, loaded_at timestamp, withdrawn_at timestamp, __fl_salt int"


def words(x):
    return tuple(sorted("".join(c if c.isalnum() else " " for c in (x or "").lower()).split()))


def make(n=600):
    rnd = random.Random(1)
    out = []
    for i in range(n):
        hot = i % 3 == 0
        species = rnd.choice(["Aa bb", "BB-aa", " aa  BB!"]) if hot else rnd.choice(["Cc", "cc?", "dd ee", None, ""])
        out.append((i + 1, species, rnd.choice(["x,y", "Y x"]) if hot else rnd.choice(["p", "P.", "q"]), "c", None if hot else rnd.choice([None, "", "1"]), rnd.choice([None, 1.5]) if not hot else 2.0, T0 + timedelta(i), T0, None, 1))
    return out


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[words(r[1]), words(r[2]), r[4], r[5], r[9]].append(r[0])
    return out


def test_links_and_collapse_equal_brute_force(spark, monkeypatch):
    rows = make()
    df = spark.createDataFrame(rows, COLS)
    want = {(min(g), x) for g in groups(rows).values() for x in g if x != min(g)}
    for least in (20, 50_000):  # with hot keys and without
        monkeypatch.setattr(copies, "hot_threshold", lambda n, least=least: least)
        got = [tuple(r) for r in copies.copy_links(df, "occurrence_id", copies.COMPOUND_WORDED, copies.COMPOUND_IGNORED).collect()]
        assert len(got) == len(want) and set(got) == want
        one = {r["occurrence_id"]: r["n_copies"] for r in copies.collapse_copies(df, "occurrence_id", copies.COMPOUND_WORDED, copies.COMPOUND_IGNORED).collect()}
        assert one == {min(g): len(g) for g in groups(rows).values()}


def test_empty_table_long_texts_and_nulls(spark):
    df = spark.createDataFrame(make(), COLS)
    assert copies.copy_links(df.limit(0), "occurrence_id", copies.COMPOUND_WORDED, copies.COMPOUND_IGNORED).count() == 0
    long = "word " * 50_000
    rows = [(1, long, None, *make(1)[0][3:]), (2, long.upper(), "", *make(1)[0][3:]), (3, None, None, *[None] * 7)]
    got = copies.copy_links(spark.createDataFrame(rows, COLS), "occurrence_id", copies.COMPOUND_WORDED, copies.COMPOUND_IGNORED).collect()
    assert [tuple(r) for r in got] == [(1, 2)]


S_COLS = "occurrence_id bigint, species string, inchikey string, citation_or_url string, evidence_tier string, confidence string, source_database string, compound_id string, retrieved_at timestamp, trust_rank int, row_id string"


def test_survivors_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(500):
        rows.append((i + 1, rnd.choice(["Aa b", "b AA", "c", None, "!"]), rnd.choice(["K1", "K2", None, " "]), rnd.choice(["u1", "u1", "u2", None]), rnd.choice([" Direct_Species_Database", "genus_database_fallback", "odd", None]), rnd.choice(["HIGH", "low ", "None", None]), rnd.choice(["p1", "P2 ", "new", None]), rnd.choice([None, "", "c1"]), rnd.choice([None, T0, T0 + timedelta(i % 5)]), 99, "x"))
    providers = [("P1", 1, "k"), ("p2", 2, "k"), (None, 3, "k")]
    trust = {"p1": 1, "p2": 2}

    def rank(r):
        place = lambda x, order: order.index(x.strip().lower()) if x and x.strip().lower() in order else len(order)
        return (place(r[4], list(survivors.TIER_ORDER)), place(r[5], list(survivors.CONFIDENCE_ORDER)), trust.get((r[6] or "").strip().lower(), 10**9), 0 if (r[7] or "").strip() else 1, -(r[8].timestamp() if r[8] else -1e18), r[0])

    by = defaultdict(list)
    for r in rows:
        if words(r[1]) and (r[2] or "").strip() and (r[3] or "").strip():
            by[words(r[1]), r[2], r[3]].append(r)
    want = {(min(x[0] for x in g), min(g, key=rank)[0]) for g in by.values() if len(g) > 1}
    df, pr = spark.createDataFrame(rows, S_COLS), spark.createDataFrame(providers, "source_database string, trust_rank int, provider_kind string")
    got = [tuple(r) for r in survivors.best_of_findings(df, pr).collect()]
    assert len(got) == len(want) and set(got) == want
    golden = survivors.golden_records(df, pr).collect()
    assert sum(r["n_rows"] for r in golden) == sum(map(len, by.values()))
    for r in golden:
        g = next(x for x in by.values() if min(y[0] for y in x) == r["first_id"])
        assert r["compound_id"] == ("c1" if any(x[7] for x in g) else None)
    assert survivors.best_of_findings(df.limit(0), pr).count() == 0
    assert survivors.best_of_findings(df, pr.limit(0)).count() == len(want)
