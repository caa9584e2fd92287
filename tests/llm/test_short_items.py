import datetime
import random

import pytest

from ledgerfield.llm import decontaminate
from tests.llm.test_others import edit_distance


def test_short_items_match_whole_words(spark):
    items = [(1, "capital of"), (2, "中国的首都是哪里"), (3, "Who wrote Hamlet?"), (4, "iron"),
             (5, "日本"), (6, "..."), (7, None)]
    texts = ["The CAPITAL, of France", "the capital often moves", "请问中国的首都是哪里？谢谢",
             "q: who wrotte hamlet", "who wrote hamlets", "knowwho wrote hamlet", "the environment",
             "an iron bar", "私は日本人です", None, "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:3] for r in decontaminate.matches(spark, docs, bench).collect()}
    assert got == {(0, 1, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1), (7, 4, 0), (8, 5, 0)}
    clean = decontaminate.without_matches(spark, docs, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 5, 6, 9, 10]


def test_short_items_against_all_stretches_of_words():
    rng = random.Random(4)
    for _ in range(300):
        item = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 23)))
        item = decontaminate.normal(item) or "a"
        noisy = list(item)
        for _ in range(rng.randint(0, 2)):
            noisy[rng.randrange(len(noisy))] = rng.choice(["", "a", "b ", " "])
        text = decontaminate.normal(f"ab {''.join(noisy)}{rng.choice(['', 'a', ' b'])} ba")
        budget = int(0.1 * len(item))
        edges = [k for k in range(len(text) + 1) if k in (0, len(text)) or " " in text[k - 1:k + 1]]
        whole = [whole_distance(item, text[s:e]) for s in edges for e in edges if s <= e]
        found = decontaminate.Items([(0, item)], 0.1).search(text)
        assert [d for _, d, _ in found] == ([min(whole)] if min(whole) <= budget else [])


def whole_distance(item, text):
    """Distance to all of the text: marks at both ends cannot be left out."""
    mark = "\0" * (len(item) + len(text) + 1)
    return edit_distance(mark + item + mark, mark + text + mark)


@pytest.mark.parametrize("kind, ids", [("smallint", (3, 4)), ("string", ("x", "y")), ("double", (0.5, 1.5)),
                                       ("date", (datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)))])
def test_ids_of_any_type(spark, kind, ids):
    text = "which of the following rivers is the longest in the whole of Africa"
    docs = spark.createDataFrame([(ids[0], f"see here: {text} indeed"), (ids[1], "nothing")], f"d {kind}, text string")
    items = spark.createDataFrame([(ids[1], text)], f"i {kind}, text string")
    got = decontaminate.matches(spark, docs, items, id_col="d", item_col="i").collect()
    assert [(r["d"], r["i"], r["distance"]) for r in got] == [(ids[0], ids[1], 0)]
