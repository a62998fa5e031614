"""Links of several kinds between records in one graph, and the forest of the strongest that hold groups together.

A link is (a, b, kind, score) with a < b; structural links (persona, declared
group) have no score and are stronger than any that has one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import similarity
from textloom.operators.components import connected_components
from textloom.session import dealt, materialise

KINDS = ("exact", "near", "overlap", "paraphrase", "sample_overlap", "name_swap", "persona", "declared_group")


def links(found: DataFrame, kind: str, a: str = "a", b: str = "b", score: str | None = None) -> DataFrame:
    """Links of one kind from pairs in any order."""
    s = F.lit(None).cast("double") if score is None else F.col(score).cast("double")
    return found.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(kind).alias("kind"), s.alias("score"))


def structural(records: DataFrame, key: str, column: str, kind: str) -> DataFrame:
    """Links of all records of a persona or declared group to the first of them; null and empty names link nothing."""
    named = records.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(key).alias("a"), column)
    first = named.groupBy(column).agg(F.min("a").alias("b"))
    return links(named.join(first, column), kind)


def text_links(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Links of (id, text) over whole texts: exact, near by ratio, and overlap of sentences in other places."""
    exact = similarity.exact_duplicates(docs.where("text IS NOT NULL")).withColumn("score", F.lit(1.0))
    near = materialise(similarity.near_duplicates(docs, threshold).where("ratio < 1"), "near_links")
    return reduce(DataFrame.union, [links(exact, "exact", "id", "kept_id", "score"), links(near, "near", "id", "kept_id", "ratio"), overlap_links(docs)])


def overlap_links(docs: DataFrame) -> DataFrame:
    """Links of (id, text) that share sentences in other places; the score is the shorter text's share of them.

    They are few beside what finds them and read several times, so they are found once and written.
    """
    met = similarity.sentence_overlap(dealt(docs.select("id", "text")))
    return materialise(links(met.withColumn("score", F.least(F.lit(1.0), F.col("shared") / F.col("fewest"))), "overlap", score="score"), "overlaps")


def conversation_links(messages: DataFrame, records: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """Links between conversations of (conv_id, turn, role, text).

    exact: equal messages in normal form; near: above 0.90 message by message;
    overlap: moved messages; paraphrase: stems, of pairs that none of these links
    (a rule for single pairs: members of a class count through its first). With
    ``records`` (conv_id, persona, split_group) persona and declared_group; with
    ``samples`` (see ``sample_findings``) sample_overlap of exact samples that aren't
    short and of near ones.
    """
    classes = materialise(similarity.conversation_classes(messages), "classes")
    exact = links(classes.withColumn("score", F.lit(1.0)), "exact", "conv_id", "class_id", "score")
    near = links(similarity.near_conversations(messages).where("status IN ('reject', 'review')"), "near", score="score")
    met = similarity.message_overlap(messages)
    total = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    met = met.join(total.toDF("a", "na"), "a").join(total.toDF("b", "nb"), "b").withColumn("score", F.least(F.lit(1.0), F.col("shared") / F.least("na", "nb")))
    done = materialise(reduce(DataFrame.union, [exact, near, links(met, "overlap", score="score")]), "links")
    out = [done, links(unlinked(paraphrases(messages, classes), done, classes), "paraphrase", score="jaccard")]
    if samples is not None:
        owner = samples.select("id", "owner", F.length(T.normalise(F.col("question"))).alias("q"), F.length(T.normalise(F.col("answer"))).alias("r"))
        found = similarity.sample_findings(samples).where("type IN ('sample_exact', 'sample_near')")
        sides = found.join(owner.toDF("a", "oa", "qa", "ra"), "a").join(owner.toDF("b", "ob", "qb", "rb"), "b")
        long = F.least(F.col("qa") + F.col("ra"), F.col("qb") + F.col("rb")) >= 60
        kept = sides.where(long & F.col("status").isin("reject", "review")).groupBy("oa", "ob").agg(F.max("score").alias("score"))
        out.append(links(kept, "sample_overlap", "oa", "ob", "score"))
    if records is not None:
        out += [structural(records, "conv_id", "persona", "persona"), structural(records, "conv_id", "split_group", "declared_group")]
    return reduce(DataFrame.union, out)


def paraphrases(messages: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, jaccard) of the first conversations of their classes whose stems overlap."""
    first = classes.where("conv_id = class_id").select("conv_id")
    return similarity.stem_jaccard(messages.join(first, "conv_id", "left_semi").select(F.col("conv_id").alias("id"), "text"))


def unlinked(pairs: DataFrame, linked: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Those of ``pairs`` (a, b, ..) that ``linked`` (a, b, ..) doesn't hold in either order.

    With ``classes`` (conv_id, class_id) a link of a member is one of its class.
    """
    done = linked.select("a", "b")
    if classes is not None:
        of = classes.select("conv_id", "class_id")
        done = done.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    done = done.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b")).distinct()
    return pairs.join(done, (F.least("a", "b") == F.col("__a")) & (F.greatest("a", "b") == F.col("__b")), "left_anti")


def spanning_forest(graph: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(a, b, kind, score) of a maximum spanning forest of links: with it alone all groups hold, and each is cut first at its weakest link.

    Boruvka rounds: every component takes its strongest link to another, ties by
    kind and ends, so the forest is one and the same however rows are dealt;
    taken links join components by star contraction. Components at least halve
    with each round; what a round leaves is written to the shared folder, with
    links inside components left out.
    """
    strength = F.struct(F.coalesce("score", F.lit(float("inf"))).alias("s"), "kind", "a", "b")
    best = graph.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b", "kind", "score", strength.alias("w"))
    now = best.groupBy(F.least("a", "b").alias("ca"), F.greatest("a", "b").alias("cb")).agg(F.max_by(F.struct("a", "b", "kind", "score"), "w").alias("e"), F.max("w").alias("w"))
    now = materialise(now, "links")
    taken: list[DataFrame] = []
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        both = now.select(F.col("ca").alias("c"), "ca", "cb", "e", "w").union(now.select("cb", "ca", "cb", "e", "w"))
        strongest = both.groupBy("c").agg(F.max_by(F.struct("ca", "cb", "e"), "w").alias("x")).select("x.*").distinct()
        strongest = materialise(strongest, "taken")
        taken.append(strongest.select("e.*"))
        roots = materialise(connected_components(strongest, "ca", "cb"), "roots")
        moved = now.join(roots.toDF("ca", "ra"), "ca").join(roots.toDF("cb", "rb"), "cb").where("ra <> rb")
        # of several links between two components the strongest alone can be taken
        now = materialise(moved.groupBy(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb")).agg(F.max_by("e", "w").alias("e"), F.max("w").alias("w")), "links")
    else:
        raise RuntimeError("the forest did not settle")
    if not taken:
        return graph.select("a", "b", "kind", "score").where("false")
    return reduce(DataFrame.union, taken)


def weakest_links(grouped: DataFrame, forest: DataFrame, key: str, n: int = 3) -> DataFrame:
    """(group_id, a, b, kind, score, rank): the links by which groups hang together most weakly; structural ones have no score and aren't named."""
    from textloom.operators.windows import top_k

    inside = forest.where("score IS NOT NULL").join(grouped.select(F.col(key).alias("a"), "group_id"), "a")
    return top_k(inside, ["group_id"], [F.asc("score"), F.asc("a"), F.asc("b")], n).select("group_id", "a", "b", "kind", "score", "rank")
