import random

from florilege.llm.leakage import MIN_RUN, ItemIndex, find_leaks, words_of

VOCAB = [f"w{i}" for i in range(40)]


def make(seed=5):
    rnd = random.Random(seed)
    items = [(i, " ".join(rnd.choices(VOCAB, k=rnd.choice([5, 12, 30])))) for i in range(25)] + [(25, None), (26, "")]
    items.append((27, items[0][1]))
    docs = []
    for i in range(150):
        words = rnd.choices(VOCAB, k=rnd.choice([0, 10, 60, 300]))
        if i % 2:
            source = (rnd.choice(items)[1] or "").split()
            k = rnd.choice([11, 12, 13, 30])
            at = rnd.randrange(0, max(1, len(source) - k + 1))
            cut = rnd.randrange(0, len(words) + 1)
            words[cut:cut] = [w.upper() for w in source[at : at + k]]
        docs.append((i, rnd.choice([" ", ", ", "-"]).join(words)))
    return items, docs + [(1000, None), (1001, ""), (1002, " ".join(["filler"] * 100_000) + " " + items[2][1])]


def brute(items, docs):
    out = set()
    for d, text in docs:
        t = " " + " ".join(words_of(text)) + " "
        for i, item in items:
            w = words_of(item)
            if any(f" {' '.join(w[k : k + MIN_RUN])} " in t for k in range(len(w) - MIN_RUN + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    items, docs = make()
    got = [tuple(r) for r in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(items, docs)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    import florilege.llm.leakage as leakage

    items, docs = make(6)
    docs += [(2000, "\u0130stanbul x " + items[1][1] + " y"), (2001, " ".join([items[2][1], "z " * 90, items[2][1]]))]
    for name, bound in (("MAX_INDEX_ITEMS", 4), ("MAX_INDEX_CHARS", 200)):
        with monkeypatch.context() as m:
            m.setattr(leakage, name, bound)
            got = [tuple(r) for r in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")).collect()]
            assert len(got) == len(set(got)) and set(got) == brute(items, docs)


def test_search_finds_all_above_the_threshold():
    rnd = random.Random(9)
    index = ItemIndex([(i, " ".join(rnd.choices(VOCAB[:15], k=20))) for i in range(60)])
    for _ in range(200):
        terms = set(rnd.sample(sorted(index.terms), 40))
        score = [0.0] * len(index.ids)
        for t in terms:
            for i, x in zip(index.terms[t].items, index.terms[t].impacts):
                score[i] += x
        for threshold in (0.2, 0.5, 1.0):
            assert sorted(index.search(terms, threshold)) == [i for i, s in enumerate(score) if s >= threshold]


def test_empty_tables(spark):
    items, docs = make()
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    assert find_leaks(d.limit(0), i).count() == find_leaks(d, i.limit(0)).count() == 0
