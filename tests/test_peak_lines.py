import re

from hypothesis import given, settings
from hypothesis import strategies as st

from florilege.sources.peak_lines import PEAK_COLUMNS, TYPE_COST, Column_, align, broken_lines, loaded_peaks, parse_line

FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'
LINE = re.compile(rf"{FIELD}(?:,{FIELD})*", re.S)
GOOD = '10.5,76.7,,137.1,"2,7-x ""trace""",94.1,S1,S1.D'


def plain(line):
    """The rule as it is stated."""
    if not LINE.fullmatch(line):
        return "quoting"
    fields, cur, inside = [], "", False
    for c in line:
        inside ^= c == '"'
        if c == "," and not inside:
            fields.append(cur)
            cur = ""
        else:
            cur += c
    fields.append(cur)
    if len(fields) != 8:
        return "column_count"
    values = [(f[1:-1].replace('""', '"') if f[:1] == '"' else f).strip() for f in fields]
    return "invalid_value" if not all(c.accepts(v) for c, v in zip(PEAK_COLUMNS, values)) else None


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet='",a1 .', max_size=24) | st.lists(st.sampled_from(['"', ",", '""', "1.5", "x", " ", '"a"', ",,"]), max_size=16).map("".join))
def test_reason_equals_the_stated_rule(line):
    assert parse_line(line)[0] == plain(line)


@settings(max_examples=500, deadline=None)
@given(st.integers(0, len(GOOD)), st.sampled_from(['"', ",", "x", ""]), st.integers(0, 3))
def test_damaged_good_lines(at, put, cut):
    line = GOOD[:at] + put + GOOD[at + cut :]
    assert parse_line(line)[0] == plain(line)


def test_edits_say_what_is_wrong():
    assert parse_line(GOOD)[:3] == (None, 0, [])
    reason, cost, edits, values = parse_line('1.5,2,3,4,"name,50,S,F.D')
    assert (reason, int(cost // 1000)) == ("quoting", 1) and "delete quote" in edits[0] and values[4] == "name"
    reason, cost, edits, values = parse_line("1.5,2,3,4,name,50,F.D")
    assert reason == "column_count" and edits[0] == "insert delimiter for sample_name"
    assert parse_line("1.5,2,3,4,a,b,50,S,F.D")[2][0] == "delete 1 delimiter(s) in compound_name"
    assert parse_line("130,2,3,4,name,50,S,F.D")[2] == ["invalid component_rt"]
    assert parse_line(None)[0] == parse_line("")[0] == "column_count"
    assert parse_line("x" * 200_000 + '"')[0] == "quoting"


def test_loading(spark):
    rows = [(1, GOOD), (2, None), (3, "1,2"), (4, GOOD), (5, "1.5,2,,4, n ,5e1,,F")]
    df = spark.createDataFrame([(i, x, "c", "r") for i, x in rows], "line_id bigint, raw_line string, reason string, fields string")
    assert {tuple(r) for r in broken_lines(df).collect()} == {(2, "column_count"), (3, "column_count")}
    got = {r["line_id"]: r for r in loaded_peaks(df).collect()}
    assert set(got) == {1, 4, 5} and got[5]["match_factor"] == 50.0 and got[5]["sample_name"] is None and got[5]["compound_name"] == "n"
    assert got[1]["compound_name"] == '2,7-x "trace"'
    assert broken_lines(df.limit(0)).count() == 0


SMALL = (Column_("n", True, 120, False), Column_("t", may_be_empty=False), Column_("m", True), Column_("s"))


def plain_align(values, columns):
    """All ways to give every column a run of fields."""
    n = len(values)
    best = {0: 0.0}
    for c in columns:
        after = {}
        for i, x in best.items():
            for take in range(n - i + 1):
                y = x + (1 if take == 0 else take - 1) + (0 if c.accepts("".join(values[i : i + take])) else TYPE_COST)
                if y < after.get(i + take, 1e9):
                    after[i + take] = y
        best = after
    return best[n]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["", "1", "2.5", "x", "0", "300", "1e", "-"]), max_size=9))
def test_alignment_is_the_cheapest(values):
    cost, out, _ = align(values, SMALL)
    assert abs(cost - plain_align(values, SMALL)) < 1e-9 and len(out) == 4 and "".join(out) == "".join(values)


def test_long_lines_take_time_in_proportion():
    import time

    for line in ("," * 20_000, "1," * 10_000, "x," * 10_000):
        began = time.perf_counter()
        assert parse_line(line)[0] == "column_count"
        assert time.perf_counter() - began < 15


def test_the_quote_edit_that_fits_the_columns_is_taken():
    reason, cost, edits, values = parse_line('1.5,2,3,4,"a,b,50,S,F.D')
    assert reason == "quoting" and int(cost // 1000) == 1 and cost % 1000 < 1 and values[4] == "a,b"
