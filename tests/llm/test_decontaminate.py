"""Edit matching against dynamic programming, and documents with planted items."""

import random

from eddyline.llm import decontaminate as D


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row), row.index(min(row))


def test_myers_against_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(500):
        p = "".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 90)))
        t = "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 120)))
        assert D.Myers(p).best(t) == distance(p, t)


def edited(rnd, text, n, letters):
    x = list(text)
    for _ in range(n):
        q = rnd.randrange(len(x) + 1)
        kind = rnd.randrange(3)
        if kind == 0:
            x.insert(q, rnd.choice(letters))
        elif q < len(x):
            x[q : q + 1] = [] if kind == 1 else [rnd.choice(letters)]
    return "".join(x)


def test_all_items_within_the_budget_are_found():
    rnd = random.Random(2)
    for _ in range(1500):
        letters = "abcdefgh"[: rnd.choice([3, 8])]
        item = "".join(rnd.choice(letters) for _ in range(rnd.randint(5, 80)))
        budget = int(len(item) * 0.15)
        noise = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        text = noise() + edited(rnd, item, rnd.randint(0, budget + 2), letters) + noise()
        least = D.Myers(item).best(text)[0]
        found = D.Matcher([(7, item)], 0.15).find(text)
        assert bool(found) == (least <= budget)
        if found:
            _, d, a, b = found[0]
            assert d == least and distance(item, text[a:b])[0] == d


def test_frames(spark):
    item = "the quick brown fox jumps over the lazy dog near the river"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (5, item + " and another one follows here")], "item_id long, text string")
    rows = [(1, f"Before. THE quick  brown\nfox jumps over the lazy dog near the rivr; after", "k"), (2, "nothing of it", "k"), (3, None, "k"), (4, "", "k"), (5, "the quick brown fox short", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = [(r["doc_id"], r["item_id"], r["distance"]) for r in D.find_leaks(docs, items).collect()]
    assert sorted(got) == [(1, 1, 1), (5, 4, 0)]  # items of fewer than 24 characters are found exactly
    assert sorted(r["doc_id"] for r in D.drop_leaks(docs, items).collect()) == [2, 3, 4, 5]
    small = D.find_leaks(docs, items, block_chars=10)  # one item a block
    assert sorted((r["doc_id"], r["item_id"]) for r in small.collect()) == [(1, 1), (5, 4)]
    assert D.find_leaks(docs.where("false"), items).count() == 0 and D.find_leaks(docs, items.where("false")).count() == 0
    assert D.drop_leaks(docs, items.where("false")).count() == 5
