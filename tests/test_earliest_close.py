"""The earliest close text of each text: few pairs asked for, and rows that travel once to be numbered."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from textloom.operators.text_pairs import earliest_close
from textloom.operators.windows import numbered


def test_a_group_of_near_copies_asks_for_few_pairs(spark):
    """in a group of near copies not every pair is matched, and the earliest is found for each."""
    r = random.Random(1)
    base = "".join(r.choice("abcdefghij klmnop") for _ in range(150))
    texts = {k: base[:p] + r.choice("xyz") * r.randrange(1, 4) + base[p:] for k in r.sample(range(1000), 60) for p in [r.randrange(150)]}
    texts = {k: t for t, k in {t: k for k, t in texts.items()}.items()}
    asked = spark.sparkContext.accumulator(0)

    def ratio(a, b):
        asked.add(1)
        return SequenceMatcher(None, a, b, autojunk=False).ratio()

    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = earliest_close(df, 0.9, False, ratio).groupBy("b_id").agg(F.min("a_id").alias("a")).collect()
    close = lambda a, b: SequenceMatcher(None, texts[a], texts[b], autojunk=False).ratio() >= 0.9
    known = {b: min(a for a in texts if a < b and close(a, b)) for b in texts if any(a < b and close(a, b) for a in texts)}
    assert {x["b_id"]: x["a"] for x in got} == known
    assert 0 < asked.value < len(texts) * (len(texts) - 1) / 4


def test_rows_are_numbered_where_they_were_sorted(spark):
    """one exchange deals rows by range; numbering makes no second one."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("id"), F.lit("x").alias("text")).repartition(3)
    out = numbered(df, ["id"], "at")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = sorted((x["id"], x["at"]) for x in out.collect())
    assert [x[1] for x in rows] == list(range(1, 5001))
