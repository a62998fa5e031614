"""Near-duplicate documents by an n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its five-word shingles, each as a 64-bit XXH64 value.
Two sets of Jaccard 0.8 share at least ceil(0.8 n) values, n the larger size. In
one order of all values, rarest first, the prefix of level l has
n - ceil(0.8 n) + l values, and two such sets share at least min(l, l') values of
their prefixes of levels l and l'. Each document chooses its level by the
estimated cost of its candidates: a longer prefix posts more values and is hit
more often, but a candidate must then share as many values, so fewer are
verified (``choose_level``). Frequencies, which set the order and the estimate,
come from counts of all documents' values in a table of ``BUCKETS`` cells; the
order is total whatever the counts are, so results don't depend on them.

Equal sets are folded into one class before anything is paired. A posting longer
than ``LONG_POSTING`` is first reduced: its members are verified against one of
them, then, joined with what all such postings have found, those outside its
largest component against another member of that component. Only then are pairs
made, and only between different components: of every posting all members
outside the largest component with all members. A large group of near copies
thus costs rows in proportion to its members, and no link between components is
lost. A pair is made at those shared values that can be its first, by what
follows them in both sets; its prefixes are then tallied, and pairs that share as
many values as the lower of their levels are verified on their whole sets.

Defined results: null and empty texts have no shingles and link with nothing;
fewer than five words are one shingle; rows that repeat an id are rows of their
own, and a component carries the smallest id of all its rows; rows without id
take the component of equal sets that have one, else null, and link nothing
themselves; an empty table gives an empty table. Texts are read whole. Shingles
of one document that differ but share their 64 bits count once. Only the named
columns are read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.components import connected_components
from textloom.session import materialise

WORDS = 5
#: Similarity, in hundredths.
SHARE = 80
BUCKETS = 1 << 18
#: Levels that a document can choose from.
LEVELS = 8
LONG_POSTING = 64
#: Cost of a posted value, of a hit, and of verifying one value of a candidate.
POST_COST, HIT_COST, VERIFY_COST = 4.0, 1.0, 0.125
#: Values gathered before a batch is handed on.
FLUSH = 1 << 19


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text, as ascending signed longs."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, cut at U+0020 and U+0009 to U+000D
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < WORDS:
        found = [xxhash.xxh64_intdigest(b" ".join(words))]
    else:
        digest = xxhash.xxh64_intdigest
        found = [digest(s) for s in map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def _cells(values: np.ndarray) -> np.ndarray:
    return (values & (BUCKETS - 1)).astype(np.int64)


def needed(n: int, share: int = SHARE) -> int:
    """How many values a set of n shares with any that is as similar, at least."""
    return -(-share * n // 100)


def choose_level(hits: np.ndarray, first: int, levels: int = LEVELS) -> int:
    """The level of least cost; ``hits`` are the estimated other documents of each value in order, ``first`` the prefix of level 1.

    Level l posts first + l - 1 values, meets the hits of all of them, and
    verifies no more candidates than hits / l.
    """
    best, cost_of_best = 1, np.inf
    met = np.cumsum(hits[: first + levels - 1], dtype=np.float64)
    for level in range(1, levels + 1):
        length = first + level - 1
        if length > len(hits):
            break
        cost = POST_COST * length + met[length - 1] * (HIT_COST + VERIFY_COST * len(hits) / level)
        if cost < cost_of_best:
            best, cost_of_best = level, cost
    return best


def frequencies(docs: DataFrame) -> np.ndarray:
    """How many values of all texts fall into each cell: one number a cell, whatever the size of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(BUCKETS, np.int64)
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(_cells(shingles(text.as_py())))
                size += len(held[-1])
                if size >= FLUSH:
                    cells += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            cells += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], names=["cell", "n"])

    out = np.zeros(BUCKETS, np.int64)
    got = docs.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def marked(docs: DataFrame, counts: np.ndarray, share: int = SHARE, levels: int = LEVELS) -> DataFrame:
    """(id, key, n, digest, level, prefix) of (id, key, text): size and digest of each set, and its prefix in order."""
    given = docs.sparkSession.sparkContext.broadcast(counts)
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "key", "n", "digest", "level", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = given.value
        typical = np.median(cells)
        background = typical + 3 * np.sqrt(typical)  # of chance meetings in a cell
        for batch in batches:
            start, size = 0, 0
            rows: list[tuple] = []

            def out(end: int) -> pa.RecordBatch:
                n, digest, level, prefix = zip(*rows, strict=True)  # noqa: B023
                part = batch.slice(start, end - start)  # noqa: B023
                columns = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(level, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))]
                return pa.RecordBatch.from_arrays(columns, names=names)

            for at, text in enumerate(batch.column(2)):
                values = shingles(text.as_py())
                n = len(values)
                if not n:
                    rows.append((0, None, 1, []))
                else:
                    often = cells[_cells(values)]
                    order = np.lexsort((values, often))
                    first = n - needed(n, share) + 1
                    level = choose_level(np.maximum(0.0, often[order] - background), first, levels)
                    digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                    rows.append((n, digest, level, values[order[: first + level - 1]]))
                    size += len(rows[-1][3])
                if size >= FLUSH:
                    yield out(at + 1)
                    start, size, rows = at + 1, 0, []
            if rows:
                yield out(batch.num_rows)

    return docs.select("id", "key", "text").mapInArrow(run, f"id {kind}, key string, n bigint, digest binary, level int, prefix array<bigint>")


def _alike(both: Column, na: Column, nb: Column, share: int) -> Column:
    return 100 * both >= share * (na + nb - both)


class Verifier:
    """Verifies pairs of classes on their whole sets; texts of classes in pairs alone are fetched."""

    def __init__(self, docs: DataFrame, classes: DataFrame, share: int) -> None:
        self.docs, self.share = docs.where("id IS NOT NULL").select("id", "key", "text"), share
        self.rows = classes.select("node", F.col("first").alias("id"), "key")

    def texts(self, pairs: DataFrame) -> DataFrame:
        """(node, text) of all classes in ``pairs``, a written table."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # written, so that Spark knows its size: few classes are broadcast to the documents, many are joined by shuffles
        wanted = materialise(self.rows.join(nodes, "node"), "wanted")
        return materialise(self.docs.join(wanted, ["id", "key"]).groupBy("node").agg(F.first("text").alias("text")), "texts", "zstd")

    def verified(self, pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) that are similar; ``pairs`` is a written table. Texts travel, which are smaller than their shingles."""
        texts = self.texts(pairs) if texts is None else texts
        ta, tb = texts.toDF("a", "ta"), texts.toDF("b", "tb")
        share = self.share

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, mine = None, None
            for batch in batches:
                a, b, keep = batch.column(0).to_pylist(), batch.column(1), []
                for at, (node, x, y) in enumerate(zip(a, batch.column(2), batch.column(3), strict=True)):
                    if node != last:
                        last, mine = node, shingles(x.as_py())
                    other = shingles(y.as_py())
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * both >= share * (len(mine) + len(other) - both):
                        keep.append(at)
                some = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), b.take(some)], names=["a", "b"])

        return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _labelled(postings: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Postings with the component that each node has over ``edges``."""
    if edges is None:
        return postings.withColumn("comp", F.col("node"))
    roots = connected_components(edges, "a", "b")
    return postings.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _main(labelled: DataFrame) -> DataFrame:
    """(value, main) of the values whose members are of several components: main is the largest of them."""
    size = labelled.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("size"))
    return size.groupBy("value").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("value", "main")


def links(met: DataFrame, verifier: Verifier, share: int = SHARE, long_posting: int = LONG_POSTING, rounds: int = 2) -> DataFrame:
    """Edges (a, b) that join all sets as similar as ``share``; ``met`` has value, node, n, level, at and size of the posting."""
    similar = lambda x, y: 100 * F.least(x, y) >= share * F.greatest(x, y)
    edges = None
    long = met.where(F.col("size") > long_posting)
    for turn in range(rounds if not long.isEmpty() else 0):
        if turn:
            labelled = materialise(_labelled(long, edges), "labelled")
            main = _main(labelled)
            whole = labelled.join(main, "value")
            # another member of the largest component each time
            centre = whole.where("comp = main").groupBy("value").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(turn))).alias("c"))
            members = whole.where("comp <> main")
        else:
            # the member with the fewest values that no other has before this one
            centre = long.groupBy("value").agg(F.min_by(F.struct("node", "n"), F.struct("at", "node")).alias("c"))
            members = long
        pairs = members.join(centre, "value").where((F.col("node") != F.col("c.node")) & similar(F.col("n"), F.col("c.n")))
        pairs = materialise(pairs.select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct(), "stars")
        found = verifier.verified(pairs)
        edges = materialise(found if edges is None else edges.union(found), "edges")
    labelled = materialise(_labelled(met, edges), "labelled")
    apart = materialise(labelled.join(_main(labelled), "value"), "apart")
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / share)) + 1e-9).cast("int")
    side = lambda df, p: df.select("value", F.struct("node", "n", "at").alias(p), F.col("comp").alias(f"{p}_comp"), (F.col("comp") == F.col("main")).alias(f"{p}_main"), bucket.alias(f"{p}_bucket"))
    rest, every = side(apart.where("comp <> main"), "x"), side(apart, "y")
    rest = rest.withColumn("y_bucket", F.explode(F.array(*[F.col("x_bucket") + k for k in (-1, 0, 1)])))
    once = F.col("y_main") | (F.col("x.node") < F.col("y.node"))
    # a pair meets at its first shared value: what follows in both must be enough
    follows = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    both = rest.join(every, ["value", "y_bucket"]).where((F.col("x_comp") != F.col("y_comp")) & once & _alike(follows, F.col("x.n"), F.col("y.n"), share))
    met_once = materialise(both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "candidates")
    # shared values of both prefixes, counted up to the lower of the two levels
    held = met.groupBy("node").agg(F.first("n").alias("n"), F.first("level").alias("level"), F.collect_list(F.struct("at", "value")).alias("values"))
    ca, cb = (held.select(F.col("node").alias(p), F.col("n").alias(f"n{p}"), F.col("level").alias(f"l{p}"), F.col("values").alias(f"v{p}")) for p in "ab")
    tally = met_once.join(ca, "a").join(cb, "b").withColumn("l", F.least("la", "lb"))
    first = lambda p: F.col(f"n{p}") - F.ceil(F.col(f"n{p}") * share / F.lit(100)) + 1
    upto = lambda p: F.transform(F.filter(f"v{p}", lambda v: v["at"] < first(p) + F.col("l") - 1), lambda v: v["value"])
    enough = F.size(F.array_intersect(upto("a"), upto("b"))) >= F.col("l")
    pairs = materialise(tally.where(enough).select("a", "b"), "pairs")
    # one pair of each class first: most others then lie within a component
    texts = verifier.texts(pairs)
    first = materialise(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    found = materialise(verifier.verified(first, texts), "edges")
    edges = found if edges is None else edges.union(found)
    roots = materialise(connected_components(edges, "a", "b"), "roots")
    of = lambda p: roots.toDF(p, f"r{p}")
    apart = pairs.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").where(~F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)))
    return edges.union(verifier.verified(materialise(apart.select("a", "b"), "apart"), texts))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, levels: int = LEVELS, long_posting: int = LONG_POSTING) -> DataFrame:
    """(id column, n_shingles, component_id) of every row: component_id is the smallest id reachable over links."""
    docs = df.select(F.col(id_col).alias("id"), F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("key"), F.col(text_col).alias("text"))
    rows = materialise(marked(docs, frequencies(docs), share, levels), "prefixes")
    known = rows.where("digest IS NOT NULL AND id IS NOT NULL")
    # the first row of a class of equal sets stands for it
    classes = known.groupBy("digest").agg(F.min(F.struct("id", "key")).alias("f"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("f.id").alias("first"), F.col("f.key").alias("key")), "classes")
    stands = classes.select("node", F.col("digest").alias("d"), F.col("first").alias("i"), F.col("key").alias("k"))
    heads = known.join(stands, (F.col("digest") == F.col("d")) & (F.col("id") == F.col("i")) & (F.col("key") == F.col("k")))
    postings = heads.select("node", F.posexplode("prefix").alias("at", "value"))
    # copies count here too, which costs less than dealing prefixes out twice; then only what classes share stays
    shared = known.select(F.explode("prefix").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("value")
    met = materialise(postings.join(shared, "value").distinct(), "shared")
    size = met.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = materialise(heads.select("node", "n", "level").distinct(), "sizes")
    met = materialise(met.join(size, "value").join(sizes, "node"), "postings")
    roots = connected_components(links(met, Verifier(docs, classes, share), share, long_posting), "a", "b")
    linked = roots.join(classes.select("node", "digest", "first"), "node")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = linked.join(least, "root").select("node", "component_id")
    component = classes.select("node", "digest", "first").join(moved, "node", "left").select(F.col("digest").alias("d"), F.coalesce("component_id", "first").alias("component_id"))
    component = materialise(component, "components")  # a join of two plain tables can be split where many rows have equal sets
    out = rows.select("id", "n", "digest").join(component, F.col("digest") == F.col("d"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
