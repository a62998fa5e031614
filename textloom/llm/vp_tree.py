"""Hard negatives by a vantage-point tree over norm-augmented vectors.

Vectors x get one more component, sqrt(M^2 - |x|^2), with M the largest norm, so
that all have the norm M; an anchor gets a zero. The squared distance of anchor
a and x is then |a|^2 + M^2 - 2 a.x: larger scores are smaller distances, and a
window of scores is an annulus around the anchor. Scores are whole numbers and
decide exactly; distances only order and prune, with a margin for rounding.

The tree has two levels of building. Its top is fitted to at most
``SAMPLE_ROWS`` vectors, a documented bound, and routes every row to a leaf;
leaves are dealt into blocks of about ``BLOCK_ROWS`` rows, hot leaves into many,
and each block grows the rest of the tree over its own rows, down to buckets of
``BUCKET_ROWS``. Blocks are the rows of the index, so no task holds a leaf and
their number grows with the table.

A query walks each block that its annulus meets: nodes and rows wait in one
queue, nearest first (bounds of nodes, exact distances of rows), rows outside the
annulus or of an unwanted label are left out, and the walk ends as soon as k
rows have left the queue. The best of all blocks are merged by Spark. A floor
known beforehand, the k-th best row of the sample, ends walks that can't add
anything. Positives are found in the same way in an annulus without bounds.

Anchors are numbered and go in blocks of ``QUERY_BLOCK``, which is what is
broadcast at a time. Equal vectors of one label are one point with the smallest
ids, as many as a result can take, cut before the shuffle: a vector that a third
of all rows share is one point, and no row is lost.

Defined results: rows without id, label or vector, or with null or non-finite
components, take no part; a component a shorter vector lacks is zero; rows that
repeat id, label and vector are one row, rows that repeat an id with another
vector or label are rows of their own, but no positives of that anchor; ties go
to the smaller id; a negative positive score leaves an empty window; scores are
exact while squared norms stay below 2^53, rows with a component beyond
``LARGEST`` in size take no part; an empty table gives an empty table. Only the
named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.int_vectors import matrix, padded, whole_vectors
from textloom.operators.windows import numbered
from textloom.session import materialise, scratch_path

SAMPLE_ROWS = 8192
BLOCK_ROWS = 4096
BUCKET_ROWS = 256
MAX_LEAVES = 1024
BLOCKS_A_TASK = 16
QUERY_BLOCK = 2048
LARGEST = 2**20
INDEX = "n int, d int, ids binary, owner binary, labels binary, x binary, nodes binary, bounds binary"
FOUND = "q bigint, id bigint, score bigint"
#: Margin of distances for rounding, in parts of M.
MARGIN = 1e-9


def augmented(x: np.ndarray, m2: int) -> np.ndarray:
    """x with the component that brings every norm to sqrt(m2)."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(axis=1)))[:, None]])


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


@dataclass
class Top:
    """The upper tree: node i splits at distance radius[i] of vantage[i]; its children are 2i+1 (inside) and 2i+2."""

    vantage: np.ndarray
    radius: np.ndarray
    depth: int

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            away = np.sqrt(((points - self.vantage[node]) ** 2).sum(axis=1))
            node = 2 * node + 1 + (away > self.radius[node])
        return node - (2**self.depth - 1)


def fit_top(points: np.ndarray, depth: int, seed: int = 3) -> Top:
    """Vantage points are those farthest from a random one; radii are medians."""
    rng, count = np.random.default_rng(seed), 2**depth - 1
    vantage, radius = np.zeros((max(1, count), points.shape[1])), np.zeros(max(1, count))
    held = {0: np.arange(len(points))}
    for node in range(count):
        rows = held.pop(node)
        if len(rows):
            start = points[rows[rng.integers(len(rows))]]
            vantage[node] = points[rows[_distances(points[rows], start).argmax()]]
        away = _distances(points[rows], vantage[node])
        radius[node] = np.median(away) if len(rows) else 0.0
        inside = away <= radius[node]
        held[2 * node + 1], held[2 * node + 2] = rows[inside], rows[~inside]
    return Top(vantage, radius, depth)


@dataclass
class Block:
    """A tree over some rows: node = (first row, end, vantage row, inner child, outer child), children -1 in buckets.

    ``bounds`` has the least and the largest distance of a node's rows from its
    parent's vantage point (for the root, from its own).
    """

    ids: np.ndarray
    owner: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    nodes: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def build(ids: list[list[int]], labels: np.ndarray, x: np.ndarray, m2: int) -> Block:
        points = augmented(x, m2)
        order = np.arange(len(x))
        nodes: list[list[int]] = []
        bounds: list[tuple[float, float]] = []

        def add(start: int, end: int, low: float, high: float) -> int:
            nodes.append([start, end, -1, -1, -1])
            bounds.append((low, high))
            return len(nodes) - 1

        work = [add(0, len(x), 0.0, 0.0)]
        while work:
            at = work.pop()
            start, end = nodes[at][:2]
            if end - start <= BUCKET_ROWS:
                continue
            rows = order[start:end]
            seen = _distances(points[rows], points[rows[0]])
            vantage = int(rows[seen.argmax()])
            away = _distances(points[rows], points[vantage])
            by = np.argsort(away, kind="stable")
            order[start:end], away = rows[by], away[by]
            half = (end - start) // 2
            nodes[at][2] = vantage
            nodes[at][3] = add(start, start + half, float(away[0]), float(away[half - 1]))
            nodes[at][4] = add(start + half, end, float(away[half]), float(away[-1]))
            work += nodes[at][3:5]
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        table = np.array(nodes, np.int64)
        has = table[:, 2] >= 0
        table[has, 2] = place[table[has, 2]]
        some = [ids[i] for i in order]
        owner = np.repeat(np.arange(len(x)), [len(s) for s in some])
        block = Block(np.concatenate([np.array(s, np.int64) for s in some]), owner, labels[order], x[order], table, np.array(bounds))
        root = _distances(points, points[order[block.root_vantage()]])
        block.bounds[0] = root.min(), root.max()
        return block

    def root_vantage(self) -> int:
        return int(self.nodes[0, 2]) if self.nodes[0, 2] >= 0 else 0

    def row(self) -> dict:
        names = ("ids", "owner", "labels", "x", "nodes")
        return {"n": len(self.x), "d": self.x.shape[1]} | {c: getattr(self, c).astype("<i8").tobytes() for c in names} | {"bounds": self.bounds.astype("<f8").tobytes()}

    @staticmethod
    def read(r: dict) -> Block:
        whole = {c: np.frombuffer(r[c], "<i8") for c in ("ids", "owner", "labels", "x", "nodes")}
        return Block(whole["ids"], whole["owner"], whole["labels"], whole["x"].reshape(r["n"], r["d"]), whole["nodes"].reshape(-1, 5), np.frombuffer(r["bounds"], "<f8").reshape(-1, 2))


class Walk:
    """Nearest-first walks of one block by the queries of one anchor."""

    def __init__(self, block: Block, points: np.ndarray, firsts: np.ndarray, anchor: np.ndarray, m2: int) -> None:
        self.block, self.points, self.firsts = block, points, firsts
        self.nodes, self.bounds = block.nodes.tolist(), block.bounds.tolist()
        self.a = np.append(anchor.astype(np.float64), 0.0)
        self.total = float((self.a * self.a).sum() + m2)
        self.margin = MARGIN * (1.0 + float(np.sqrt(m2)) + float(np.sqrt((self.a * self.a).sum())))
        self.scores: dict[int, np.ndarray] = {}
        self.away: dict[int, float] = {}

    def distance(self, score: float) -> float:
        return float(np.sqrt(max(0.0, self.total - 2.0 * score)))

    def to(self, row: int) -> float:
        if row not in self.away:
            self.away[row] = float(np.sqrt(((self.points[row] - self.a) ** 2).sum()))
        return self.away[row]

    def bucket(self, node: int) -> np.ndarray:
        if node not in self.scores:
            start, end = self.nodes[node][:2]
            self.scores[node] = self.points[start:end] @ self.a  # the anchor's last component is zero; exact below 2^53
        return self.scores[node]

    def nearest(self, k: int, label: int, same: bool, not_id: int | None, low: float, high: float, floor: float) -> list[tuple[int, int]]:
        """(score, id) of the k best rows with low <= score <= high and score >= floor, best first, ties to smaller ids."""
        b = self.block
        low = max(low, floor)
        if low > high:
            return []
        inner = self.distance(high) if np.isfinite(high) else 0.0
        outer = self.distance(low) if np.isfinite(low) else np.inf
        delta = self.to(b.root_vantage())

        def bound(node: int, delta: float) -> tuple[float, float]:
            near, far = self.bounds[node]
            return max(delta - far, near - delta, 0.0), delta + far

        queue: list[tuple[float, int, int]] = []  # (distance, 0, node): nodes before rows at the same distance
        rows: list[tuple[float, int]] = []  # (-score, id)
        least, most = bound(0, delta)
        if least <= outer + self.margin and most >= inner - self.margin:
            heapq.heappush(queue, (least, 0))
        out: list[tuple[int, int]] = []
        while len(out) < k and (queue or rows):
            # rows leave while no node can hold a nearer one, or one as near of a smaller id
            while rows and len(out) < k and (not queue or self.distance(-rows[0][0]) < queue[0][0] - self.margin):
                score, i = heapq.heappop(rows)
                out.append((int(-score), i))
            if len(out) == k or not queue:
                continue
            _, node = heapq.heappop(queue)
            start, end, vantage, *children = self.nodes[node]
            if children[0] < 0:
                score = self.bucket(node)
                labelled = b.labels[start:end] == label if same else b.labels[start:end] != label
                fits = np.flatnonzero((score >= low) & (score <= high) & labelled)
                if len(fits) > k + 1:
                    # the best of a bucket, and one more for the anchor's own row; ties all stay
                    fits = fits[score[fits] >= np.partition(score[fits], len(fits) - k - 1)[len(fits) - k - 1]]
                for at in fits.tolist():
                    for i in b.ids[self.firsts[start + at] : self.firsts[start + at + 1]].tolist():
                        if i != not_id:
                            heapq.heappush(rows, (-float(score[at]), i))
                continue
            delta = self.to(vantage)
            for child in children:
                least, most = bound(child, delta)
                if least <= outer + self.margin and most >= inner - self.margin:
                    heapq.heappush(queue, (least, child))
        return out


def points_of(df: DataFrame, keep: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(x, label, ids): distinct vectors of each label with their ``keep`` smallest ids, labels as they are after the change."""
    rows = whole_vectors(df, vector_col, {"id": id_col, "label": label_col}).where("id IS NOT NULL AND label IS NOT NULL")
    rows = rows.where(F.forall("x", lambda v: F.abs(v) <= LARGEST)).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "x")
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", label)
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = padded(rows, longest)
    rank = F.dense_rank().over(Window.partitionBy("x", "label").orderBy("id"))
    few = rows.withColumn("at", rank).where(F.col("at") <= keep)
    return few.groupBy("x", "label").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def anchors_of(df: DataFrame, every: int, id_col: str, label_col: str, vector_col: str, d: int) -> DataFrame:
    """(q, id, label, x) of the anchors, numbered from 1."""
    rows = whole_vectors(df, vector_col, {"id": id_col, "label": label_col}).where("id IS NOT NULL AND label IS NOT NULL")
    rows = rows.where((F.col("id") % every == 0) & F.forall("x", lambda v: F.abs(v) <= LARGEST)).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "x")
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return numbered(padded(rows, d).distinct(), ["id", "label", "x"], "q")


@dataclass
class Index:
    blocks: DataFrame
    m2: int
    d: int
    sample_x: np.ndarray
    sample_labels: np.ndarray
    sample_ids: list[list[int]]


def build_index(points: DataFrame, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> Index | None:
    """The index of all points, one row a block; None without points."""
    spark = points.sparkSession
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v)
    count, m2, d = points.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("x"))).first()
    if not count:
        return None
    hashed = F.xxhash64("x", "label")
    # about a quarter more than wanted are sorted, not the table
    some = points.where(F.pmod(hashed, F.lit(1 << 32)) <= int(min(1.0, (1.25 * sample_rows + 64) / count) * 2**32))
    drawn = some.orderBy(hashed, "x", "label").limit(sample_rows).toArrow()
    sample = matrix(drawn["x"].combine_chunks(), d)
    depth = max(0, min(int(np.log2(MAX_LEAVES)), int(np.ceil(np.log2(max(1.0, count / block_rows))))))
    top = fit_top(augmented(sample, m2), depth)
    given = spark.sparkContext.broadcast(top)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = given.value.leaf(augmented(matrix(batch.column(0), d), m2)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["x", "label", "ids", "leaf"])

    routed = materialise(points.mapInArrow(route, "x array<bigint>, label bigint, ids array<bigint>, leaf bigint"), "routed")
    # one number a leaf, MAX_LEAVES at most
    cuts = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("cuts"))
    dealt = routed.join(F.broadcast(cuts), "leaf").withColumn("cut", F.pmod(F.xxhash64("x", "label"), F.col("cuts")))

    def grow(table: pa.Table) -> pa.Table:
        block = Block.build(table["ids"].to_pylist(), table["label"].to_numpy(), matrix(table["x"].combine_chunks(), d), m2)
        return pa.Table.from_pylist([block.row()], schema=pa.schema([("n", pa.int32()), ("d", pa.int32()), *[(c, pa.binary()) for c in ("ids", "owner", "labels", "x", "nodes", "bounds")]]))

    blocks = materialise(dealt.groupBy("leaf", "cut").applyInArrow(grow, INDEX), "blocks")
    blocks = blocks.repartition(max(spark.sparkContext.defaultParallelism, -(-blocks.count() // BLOCKS_A_TASK)))
    return Index(blocks, m2, d, sample, drawn["label"].to_numpy(), drawn["ids"].to_pylist())


def _floors(index: Index, queries: list[dict], k: int) -> list[float]:
    """The k-th best score that the sample has for each query: no worse row can be among its k best."""
    out = []
    sample = index.sample_x.astype(np.float64)
    a, score = None, None
    for q in queries:
        if q["x"] is not a:
            a = q["x"]
            score = sample @ np.array(a, np.float64)
        fits = ((index.sample_labels == q["label"]) == q["same"]) & (score >= q["low"]) & (score <= q["high"])
        best = np.sort(score[fits])[::-1][: k + 1]
        # a point can be the anchor's own id, so one more is asked for
        out.append(float(best[k]) if len(best) > k else -np.inf)
    return out


def search(index: Index, queries: list[dict], k: int) -> DataFrame:
    """(q, id, score): the k best of every block for each query; at most a block of queries at a time.

    A query is a dict of q, x, label, same, not_id, low and high; those of one
    anchor stand together and share x.
    """
    spark = index.blocks.sparkSession
    m2 = index.m2
    given = spark.sparkContext.broadcast([q | {"floor": f, "x": np.array(q["x"], np.int64)} for q, f in zip(queries, _floors(index, queries, k), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block.read(r)
                points = augmented(block.x, m2)
                firsts = np.searchsorted(block.owner, np.arange(len(block.x) + 1))
                out: tuple[list, list, list] = ([], [], [])
                walk, last = None, None
                for q in given.value:
                    if walk is None or q["anchor"] != last:
                        walk, last = Walk(block, points, firsts, q["x"], m2), q["anchor"]
                    for score, i in walk.nearest(k, q["label"], q["same"], q["not_id"], q["low"], q["high"], q["floor"]):
                        out[0].append(q["q"])
                        out[1].append(i)
                        out[2].append(score)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["q", "id", "score"])

    return index.blocks.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.select("q", "id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, every: int = 100, positives: int = 5, k: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    ``share`` = (p, q) sets the window p/q positive <= negative <= positive.
    """
    spark = df.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    points = materialise(points_of(df, max(positives + 1, k), id_col, label_col, vector_col), "points")
    index = build_index(points, sample_rows, block_rows)
    if index is None:
        return spark.createDataFrame([], schema)
    anchors = anchors_of(df, every, id_col, label_col, vector_col, index.d)
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], schema).write.parquet(path)
    for first in range(0, anchors.count(), query_block):
        block = anchors.where((F.col("q") > first) & (F.col("q") <= first + query_block)).orderBy("q").collect()
        asked = [{"q": a["q"], "anchor": a["q"], "x": a["x"], "label": a["label"], "same": True, "not_id": a["id"], "low": -np.inf, "high": np.inf} for a in block]
        near = _best(search(index, asked, positives), positives).collect()  # a few rows for each of a bounded block of anchors
        by = {a["q"]: a for a in block}
        wanted = [{"anchor": r["q"], "positive": r["id"], "score": r["score"], "x": by[r["q"]]["x"]} for r in sorted(near, key=lambda r: (r["q"], r["rank"]))]
        asked = [
            {"q": n, "anchor": w["anchor"], "x": w["x"], "label": by[w["anchor"]]["label"], "same": False, "not_id": None, "low": float(-(-share[0] * w["score"] // share[1])), "high": float(w["score"])}
            for n, w in enumerate(wanted)
        ]
        if not asked:
            continue
        names = spark.createDataFrame([(n, by[w["anchor"]]["id"], w["positive"], w["score"]) for n, w in enumerate(wanted)], "q bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        best = _best(search(index, asked, k), k).join(F.broadcast(names), "q")
        best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
