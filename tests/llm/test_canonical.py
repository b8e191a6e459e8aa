from collections import defaultdict
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from florilege.llm import canonical
from florilege.llm.canonical import NameIndex, bounded_distance, build_index, match_by_join, match_rows, name_parts, slip_cost, slips_between, unmatched_names

LIBRARY = [(1, "cis-acetyl abcdeate", None), (2, "trans-acetyl abcdeate", "old name; x 4 extract"), (3, "α-pinene", None), (4, "2,7-dimethoxyfoo", " "), (5, "abcd efgh", None), (6, None, "orphan alias"), (7, "abxd efgh", None)]


def distance(a, b):
    """Unrestricted Damerau-Levenshtein distance, straight from its definition."""
    last, d, most = defaultdict(int), {}, len(a) + len(b)
    d[-1, -1] = most
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = most, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = most, j
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, m, cost = last[b[j - 1]], at, 1
            if a[i - 1] == b[j - 1]:
                cost, at = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=8))
def test_distance_up_to_two(a, b):
    d = distance(a, b)
    assert bounded_distance(a, b, 2) == (d if d <= 2 else None)


def nearest(value):
    numbers, words = name_parts(value)
    best = {}
    for entry, compound, others in LIBRARY:
        for name in [compound or "", *(others or "").split(";")]:
            n, w = name_parts(name)
            if w and words and n == numbers:
                d = min(distance("".join(p), "".join(q)) for p in permutations(words) for q in permutations(w))
                best[entry] = min(d, best.get(entry, 9))
    least = min(best.values(), default=9)
    return {e for e, d in best.items() if d == least and d <= 2}


@settings(max_examples=600, deadline=None)
@given(st.sampled_from([c for _, c, _ in LIBRARY if c] + ["old name", "x 4 extract", "orphan alias"]), st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["del", "add", "swap", "sub", "space"])), max_size=3), st.randoms(use_true_random=False))
def test_meaning_equals_brute_force(name, slips, rnd):
    text = list(name)
    for at, kind in slips:
        at %= max(1, len(text))
        if kind == "del":
            del text[at : at + 1]
        elif kind == "swap" and at + 1 < len(text):
            text[at], text[at + 1] = text[at + 1], text[at]
        elif kind in ("add", "space"):
            text.insert(at, "q" if kind == "add" else " ")
        elif at < len(text):
            text[at] = "z"
    parts = "".join(text).split()
    rnd.shuffle(parts)
    value = rnd.choice([str.upper, str.lower, str.title])(" ".join(parts))
    index = build_index(LIBRARY)
    got = index.meaning(value)
    want = set() if value in index.exact else nearest(value)
    assert (got in want) if want else got is None


def test_many_words_and_merged_words():
    index = build_index([(1, "abc def ghi", None)])
    assert index.meaning("g h i a b c d e f") == 1  # one-letter words in another order
    assert index.meaning("ghiabcdef") == 1
    assert slips_between(tuple("abcdefghijk"), ("kjihgfedcba",)) == 0
    nine = build_index([(1, "one two three for five six sevn ate nin", None), (2, "one two three for five six sevn ate nine z", None)])
    assert nine.meaning("nin ate sevn six fve for threee two one") == 1 and nine.meaning("z nine ate sevn six fivefor three two one") == 2
    assert nine.meaning("one two three for five six sevn") is None
    assert NameIndex().meaning("x") is None and index.meaning(None) is None and index.meaning("12") is None


def test_rows_join_and_misses(spark):
    library = spark.createDataFrame([(*x, "t") for x in LIBRARY], "library_id bigint, compound string, also_called string, name string")
    values = ["Α-PINENE!", "alpha pinene", "pinene", "2,7-dimethoxyfoo", "7 dimethoxyfoo 2", "2-dimethoxyfoo", "acetyl cis abcdeat", None, "", "x" * 50_000, "Extract x4", "extract 4 x", "old nmae", "α-pinene"]
    named = spark.createDataFrame([("t", i, v, 1) for i, v in enumerate(values * 2)], "src_table string, row_id bigint, name string, library_id int")
    rows = sorted(tuple(r) for r in match_rows(named, library).collect())
    assert {i % len(values): e for _, i, e in rows} == {0: 3, 1: 3, 4: 4, 6: 1, 11: 2, 12: 2} and len(rows) == 12
    assert sorted(tuple(r) for r in match_by_join(named, library).collect()) == rows
    assert {r["name"] for r in unmatched_names(named, library).collect()} == {"pinene", "2-dimethoxyfoo", None, "", "x" * 50_000, "Extract x4"}
    assert match_rows(named.limit(0), library).count() == match_rows(named, library.limit(0)).count() == 0


def lettered(words):
    """Letters of words in their order, each with the letter before it in its word."""
    return [(c, w[k - 1] if k else "") for w in words for k, c in enumerate(w)]


def plain_cost(a, b):
    """Weighted distance of two orders by the stated costs, any number of slips."""
    inf = 10**6
    d = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    d[0][0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            x, y = [c for c, _ in a[:i]], [c for c, _ in b[:j]]
            best = d[i][j]
            if i and j:
                best = min(best, d[i - 1][j - 1] + (0 if x[-1] == y[-1] else 8 if {x[-1], y[-1]} <= set("aeiouy") else 10))
            if i:
                best = min(best, d[i - 1][j] + (7 if a[i - 1][1] == x[-1] else 10))
            if j:
                best = min(best, d[i][j - 1] + (7 if b[j - 1][1] == y[-1] else 10))
            if i > 1 and j > 1 and x[-2] == y[-1] != x[-1] == y[-2]:
                best = min(best, d[i - 2][j - 2] + 7)
            if i > 2 and j > 1 and x[-3] == y[-1] and x[-1] == y[-2]:
                best = min(best, d[i - 3][j - 2] + 17)
            if i > 1 and j > 2 and y[-3] == x[-1] and y[-1] == x[-2]:
                best = min(best, d[i - 2][j - 3] + 17)
            d[i][j] = best
    return d[-1][-1]


WORDS = st.lists(st.text(alphabet="abe", min_size=1, max_size=4), min_size=1, max_size=3)


@settings(max_examples=500, deadline=None)
@given(WORDS, WORDS, st.integers(0, 2))
def test_cost_and_slips_over_all_orders(words, target, limit):
    pairs = [(p, q) for p in permutations(words) for q in permutations(target)]
    cost = min(plain_cost(lettered(p), lettered(q)) for p, q in pairs)
    slips = min(distance("".join(p), "".join(q)) for p, q in pairs)
    assert slip_cost(tuple(words), tuple(target), limit) == (cost if slips <= limit else None)
    assert slips_between(tuple(words), tuple(target), limit) == (slips if slips <= limit else None)
    assert slips > 2 or -(-cost // 10) == slips


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abcdefgh", min_size=1, max_size=5), min_size=5, max_size=8), st.randoms(use_true_random=False), st.integers(0, 2))
def test_names_of_many_words(words, rnd, n):
    other = list(words)
    rnd.shuffle(other)
    text = list(" ".join(other))
    for _ in range(n):
        at = rnd.randrange(len(text))
        text[at : at + 1] = rnd.choice([[], ["z", text[at]], ["z"]])
    value = tuple("".join(text).split())
    assert slip_cost(value, tuple(words)) is not None or sum(map(len, value)) < sum(map(len, words)) - 2


def test_join_equals_dictionary_on_ties_and_beyond_the_bounds(spark, monkeypatch):
    library = spark.createDataFrame([(1, "abcd", "x"), (2, "abce", None), (3, "abcf", "one two three for five six sevn ate nin"), (4, "a a", None), (5, "aa", None), (6, "b", "c; d; e"), (7, "abce", None)], "library_id bigint, compound string, also_called string")
    values = ["abcz", "abco", "zabcd", "abdc", "nin ate sevn six fve for threee two one", "a-a!", "aab", "f", "g h", "i", "", None, "abce", "abcd", "abcd", "A B", "acbd", "1 b", "b 1"] + [f"{c}{k}" for k in "?!;." for c in "fghijklmnop"]
    named = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "src_table string, row_id bigint, name string")
    want = sorted(tuple(r) for r in match_rows(named, library).collect())
    assert len(want) > 30 and {i: e for _, i, e in want}[0] == 1  # twice as frequent as the others
    assert sorted(tuple(r) for r in match_by_join(named, library).collect()) == want
    monkeypatch.setattr(canonical, "hot_threshold", lambda n: 5)  # keys of short values are salted
    for bound in ("MAX_BROADCAST_NAMES", "MAX_BROADCAST_KEYS"):
        with monkeypatch.context() as m:
            m.setattr(canonical, bound, 1)
            assert not canonical.fits_broadcast(library)
            assert sorted(tuple(r) for r in match_rows(named, library).collect()) == want


def test_ties_go_to_the_more_frequent_entry():
    index = build_index(LIBRARY, {5: 3, 7: 9})
    assert index.meaning("abzd efgh") == 7 and build_index(LIBRARY).meaning("abzd efgh") == 5
    assert slip_cost(("abcd",), ("abdc",)) < slip_cost(("abcd",), ("abxd",))
