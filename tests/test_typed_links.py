"""Links of several kinds, their forest, and groups over whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import grouping, typed_links
from textloom.operators import similarity as sim


def kruskal(edges):
    """A maximum spanning forest: strongest first, then by kind and ends, largest first."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for a, b, kind, score in sorted(edges, key=lambda e: (float("inf") if e[3] is None else e[3], e[2], e[0], e[1]), reverse=True):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b, kind, score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_equals_kruskal(spark, seed):
    r = random.Random(seed)
    edges = {}
    for _ in range(160):
        a, b = sorted(r.sample(range(90), 2))
        kind = r.choice(typed_links.KINDS)
        edges[(a, b, kind)] = None if kind in ("persona", "declared_group") else r.choice([0.9, 0.91, 0.95, 1.0, r.random()])
    edges |= {(k, k + 1, "near"): 0.5 for k in range(200, 230)}  # a chain of equal links
    rows = [(*k, s) for k, s in edges.items()]
    df = spark.createDataFrame(rows, "a long, b long, kind string, score double").repartition(5)
    assert sorted((tuple(x) for x in typed_links.spanning_forest(df).collect()), key=repr) == kruskal(rows)


def test_no_links(spark):
    df = spark.createDataFrame([(1, 1, "near", 0.9), (None, 2, "near", 0.9)], "a long, b long, kind string, score double")
    assert typed_links.spanning_forest(df).collect() == []


def test_groups_over_whole_texts_and_their_weakest_links(spark):
    base = " ".join(f"Sentence {w} tells a tale of the {w} and of its {w[::-1]}." for w in "house garden river mountain valley castle forest village market harbour".split())
    rows = [
        (1, "X" * 61 + " " + base),
        (2, "Y" * 61 + " " + base + "tail"),  # near 1, but begins otherwise
        (3, "Y" * 61 + " " + base + "tail"),
        (4, "Quite another text stands here, without a word of these."),
        (5, None),
        (6, None),
    ]
    found = typed_links.text_links(spark.createDataFrame(rows, "id long, text string"), 0.8)
    got = sorted((x["a"], x["b"], x["kind"]) for x in found.collect())
    assert got == [(1, 2, "near"), (1, 3, "near"), (2, 3, "exact")]
    forest = typed_links.spanning_forest(found)
    records = spark.createDataFrame([(k,) for k, _ in rows], "id long")
    grouped = grouping.groups(records, forest, "id")
    assert sorted(tuple(x) for x in grouped.collect()) == [(1, "group_1"), (2, "group_1"), (3, "group_1"), (4, "group_4"), (5, "group_5"), (6, "group_6")]
    weakest = typed_links.weakest_links(grouped, forest, "id").collect()
    assert [(x["group_id"], x["kind"], x["rank"]) for x in weakest] == [("group_1", "near", 1), ("group_1", "exact", 2)]


def talk(conv, *texts):
    return [(conv, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]


def test_links_between_conversations(spark):
    long = "Where can I find the {} near the old market of our town today? I have looked for it since morning."
    reply = "You will find the {} behind the church, where the narrow street meets the river and the bridge."
    rows = (
        talk(1, long.format("baker"), reply.format("baker"))
        + talk(2, long.format("baker"), reply.format("baker"))  # exact
        + talk(3, long.format("bakers"), reply.format("bakery"))  # near
        + talk(4, "Please tell me what the weather will be tomorrow in the hills.", "It will rain over all of the hills until noon, they say.", "And what about the day after that one, may I ask?", "Sunny with a few clouds over the western valleys, as far as I know.")
        + talk(5, "And what about the day after that one, may I ask?", "Sunny with a few clouds over the western valleys, as far as I know.", "Please tell me what the weather will be tomorrow in the hills.", "It will rain over all of the hills until noon, they say.")  # moved
        + talk(6, "hi", "hello")
        + talk(7, "hey", "good day")
    )
    messages = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    records = spark.createDataFrame([(4, "Ann", None), (6, "Ann", "g1"), (7, "", "g1"), (1, None, None)], "conv_id long, persona string, split_group string")
    got = {(x["a"], x["b"], x["kind"]) for x in typed_links.conversation_links(messages, records).collect()}
    assert got >= {(1, 2, "exact"), (1, 3, "near"), (4, 5, "overlap"), (4, 6, "persona"), (6, 7, "declared_group")}
    assert {k for _, _, k in got} == {"exact", "near", "overlap", "persona", "declared_group"}  # what is linked makes no paraphrase


def test_paraphrases_of_unlinked_pairs_alone(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.4), (3, 4, 0.6)], "a long, b long, jaccard double")
    linked = spark.createDataFrame([(2, 1), (9, 4)], "a long, b long")
    classes = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (9, 3)], "conv_id long, class_id long")
    assert sorted(x["a"] for x in typed_links.unlinked(pairs, linked).collect()) == [2, 3]
    assert [x["a"] for x in typed_links.unlinked(pairs, linked, classes).collect()] == [2]
