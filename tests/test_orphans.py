import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from florilege.operators import orphans
from florilege.operators.orphans import find_orphans, open_references, parent_events, plant_orphans, play_history, reference_events, step_ends

T0 = datetime(2020, 1, 1)


def truth(refs, parents):
    out = set()
    for row, key, at in refs:
        if key is None:
            continue
        mine = [(b, e) for k, b, e in parents if k == key]
        if at is not None and any(b is not None and b <= at and (e is None or e > at) for b, e in mine):
            continue
        out.add((row, "missing" if not mine else "deleted" if at is not None and any(b is not None and b <= at for b, _ in mine) else "late"))
    return out


def run(spark, refs, parents, months):
    r = spark.createDataFrame(refs, "row_id bigint, k string, at timestamp_ntz")
    p = spark.createDataFrame(parents, "k string, b timestamp_ntz, e timestamp_ntz")
    found = find_orphans(reference_events(r, F.col("k"), F.col("row_id"), F.col("at")), parent_events(p, F.col("k"), F.col("b"), F.col("e")), period_months=months)
    rows = [(x["row_id"], x["reason"]) for x in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_state_equals_looking_at_everything(spark):
    rnd = random.Random(4)
    day = lambda: T0 + timedelta(days=rnd.randrange(0, 1200))
    keys = ["hot"] * 6 + list("abcdefgh")
    refs = [(i, rnd.choice([*keys, "never", None]), rnd.choice([day(), day(), day(), None]) if i % 9 == 0 else day()) for i in range(400)]
    parents = []
    for _ in range(40):
        b = day()
        parents.append((rnd.choice(keys), b, rnd.choice([None, b + timedelta(days=rnd.randrange(-3, 200)), b])))
    parents += [("null_begin", None, None), (None, T0, None)]
    refs += [(1000, "null_begin", T0), (1001, "a", parents[0][1]), (1002, parents[0][0], parents[0][1])]
    assert run(spark, refs, parents, 7) == truth(refs, parents)
    assert run(spark, refs, parents, 60) == truth(refs, parents)


def test_empty_tables(spark):
    assert run(spark, [], [], 12) == set()
    assert run(spark, [(1, "a", T0)], [], 12) == {(1, "missing")}
    assert run(spark, [], [("a", T0, None)], 12) == set()


def test_clashing_columns_and_repeated_rows(spark):
    compounds = spark.createDataFrame([(1, "Aa bb", "C1", T0, None, "x", 1), (2, "!!", None, T0, None, "x", 1), (3, "zz", " c1 ", None, None, None, None)], "occurrence_id bigint, species string, compound_id string, retrieved_at timestamp_ntz, withdrawn_at timestamp_ntz, ref_key string, slot int")
    meta = spark.createDataFrame([(1, "BB-aa", T0, None), (2, "bb AA", T0, None)], "metadata_id bigint, species string, valid_from timestamp_ntz, withdrawn_at timestamp_ntz")
    pairs = spark.createDataFrame([(1, "c1 ", T0), (2, "c2", T0), (3, None, T0)], "pair_id bigint, compound_id_a string, computed_at timestamp_ntz")
    listed = spark.createDataFrame([(1, "other")], "list_id bigint, species string")
    got = {tuple(r) for r in plant_orphans(compounds, meta, pairs, listed).collect()}
    assert got == {("plant_compounds", 3, "missing"), ("plant_compound_pair_tanimoto", 2, "missing"), ("plant_metadata", 1, "missing"), ("plant_metadata", 2, "missing")}


def events(spark, refs, parents):
    r = spark.createDataFrame(refs, "row_id bigint, k string, at timestamp_ntz")
    p = spark.createDataFrame(parents, "k string, b timestamp_ntz, e timestamp_ntz")
    return reference_events(r, F.col("k"), F.col("row_id"), F.col("at")), parent_events(p, F.col("k"), F.col("b"), F.col("e"))


def test_deletions_reopen_references(spark):
    day = lambda n: T0 + timedelta(days=n)
    refs, parents = events(spark, [(1, "a", day(5)), (2, "b", day(5)), (3, "c", day(5)), (4, "d", day(1)), (5, "d", day(3))], [("a", day(0), day(400)), ("b", day(0), None), ("d", day(2), day(800))])
    state, settled = play_history(refs, parents, period_months=6)
    assert {(r["ref_key"], r["reason"]) for r in settled.collect()} == {("c", "missing"), ("d", "late")}
    got = {(r["row_id"], r["status"]) for r in open_references(refs, state.index).collect()}
    assert got == {(1, "gone"), (3, "waiting"), (4, "gone"), (5, "gone")}  # 1 and 5 had a parent, 4 was resolved; deletions reopened them


def test_a_key_with_half_of_the_rows_at_one_instant(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HOT_LEAST", 50)
    monkeypatch.setattr(orphans, "hot_threshold", lambda rows: max(50, rows // 4))
    refs = [(i, "hot", T0) for i in range(300)] + [(1000 + i, f"k{i % 30}", T0 + timedelta(hours=i)) for i in range(300)]
    parents = [("hot", T0 + timedelta(days=1), None), *[(f"k{i}", T0, None if i % 2 else T0 + timedelta(hours=9)) for i in range(20)]]
    assert run(spark, refs, parents, 1) == truth(refs, parents)


def test_a_calendar_of_any_length_is_played_in_few_steps(spark, monkeypatch):
    assert step_ends({3: 1, 5: 9}) == [3, 5]
    ends = step_ends({p: 1 for p in range(1000)}, 10)
    assert len(ends) == 10 and ends[-1] == 999
    monkeypatch.setattr(orphans, "MAX_STEPS", 3)
    monkeypatch.setattr(step_ends, "__defaults__", (3,))
    refs = [(i, "a" if i % 2 else "b", datetime(1 + 37 * i, 1, 1)) for i in range(60)]
    parents = [("a", datetime(700, 1, 1), datetime(1500, 1, 1)), ("b", None, None)]
    assert run(spark, refs, parents, 12) == truth(refs, parents)
