"""Language-model scores by context-tree weighting.

A text is its lower-cased (A-Z) words, each followed by a space but the last,
which is followed by the end (a line feed). Every byte is decomposed into eight
binary decisions; each decision has a context tree over the bytes before it, up
to ``depth`` of them (three to six). In each node zeros and ones are counted over
the training texts and estimated by Krichevsky-Trofimov; a node's weighted
probability is half its own estimate and half the product of its children's.
Scoring mixes the estimates of all depths along a context's path with the weights
that the training texts gave them, and sums logarithms: the code length of the
text.

Nothing that grows with the corpus is broadcast or collected. Texts are written
once in blocks of about ``BLOCK_BYTES``. Each block asks once for every different
word and every different (context, byte) it holds, as packed sorted keys, dealt
by the three nearest bytes (words: by their hash). Counts are summed over the
corpus in those groups, trees are weighted there, and the answers go back to the
blocks. Only sums for nodes of at most two bytes of context (256 x 256 x 255 rows
at the very most, as many as the texts have byte pairs) and the totals N and V
pass the driver.

Words are keyed by 64-bit hashes. Defined results: null and empty texts are the
end alone; texts are read whole; rows that repeat are scored, and counted in
training, as often as they occur; rows without id are not held out and do train;
an empty table gives an empty table. Only the named columns are read, so extra
columns never clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.labelled import remainder
from textloom.session import materialise, shuffles_removed

DEPTH = 6
#: Groups of (three nearest bytes), and of words.
GROUPS, WORD_GROUPS = 256, 64
END = b"\n"
SEED = 0
#: Bytes of normalised text in one block, but for a longer last text.
BLOCK_BYTES = 24 << 20
#: Bytes of text, or keys, that are worked on at a time.
PIECE = 4 << 20
LOG2 = float(np.log(2.0))
#: Counts whose logarithms of gamma are kept.
KEPT = 4096


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series, shifted by eight."""
    x = np.asarray(x, np.float64)
    y = x + 8
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    s = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + s - np.log(product)


HALVES, WHOLES = log_gamma(np.arange(KEPT) + 0.5), log_gamma(np.arange(KEPT) + 1.0)


def _log_gamma_of(n: np.ndarray, kept: np.ndarray, shift: float) -> np.ndarray:
    out = kept[np.minimum(n, KEPT - 1)]
    large = n >= KEPT
    out[large] = log_gamma(n[large] + shift)
    return out


def kt_evidence(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-probability that Krichevsky-Trofimov gives to so many zeros and ones."""
    return _log_gamma_of(zeros, HALVES, 0.5) + _log_gamma_of(ones, HALVES, 0.5) - _log_gamma_of(zeros + ones, WHOLES, 1.0) - np.log(np.pi)


def mixed(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability of a node, and the weight of its own estimate."""
    own = kt_evidence(zeros, ones)
    both = np.logaddexp(own, children) - LOG2
    return both, np.exp(own - LOG2 - both)


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split()) + END


def word_keys(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))


def stream_codes(streams: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """(context, byte) codes of the bytes of all streams; before a stream are ends.

    The nearest byte of the context is the most significant, the byte itself the
    least: codes in order have contexts in order.
    """
    pad = END * depth
    a = np.frombuffer(b"".join([pad + s for s in streams]), np.uint8).astype(np.int64)
    code = a[depth:].copy()
    for k in range(1, depth + 1):
        code |= a[depth - k : len(a) - k] << (8 * (depth + 1 - k))
    # codes[i] is of byte i + depth of the buffer; those of pads go
    starts = np.cumsum([0, *(len(s) + depth for s in streams[:-1])])
    keep = np.ones(len(a), bool)
    keep[(starts[:, None] + np.arange(depth)).ravel()] = False
    return code[keep[depth:]]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Places at which any of the keys changes."""
    change = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def _owner(starts: np.ndarray, n: int) -> np.ndarray:
    """Number of the run that each of ``n`` places belongs to."""
    out = np.zeros(n, np.int64)
    out[starts[1:]] = 1
    return np.cumsum(out)


class Decision:
    """The trees of one of the eight binary decisions of a byte, over sorted codes.

    ``levels`` go from the deepest to three bytes of context: own estimate of a
    one, its weight, and the place of each code's leaf or each node's parent.
    ``pair``, ``node``, ``zeros``, ``ones`` and ``below`` (log-probability of the
    children) are of the nodes two bytes deep.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int, k: int):
        byte = code & 255
        node = ((1 << k) | (byte >> (8 - k))).astype(np.uint8)
        # contexts are in order already and stay so
        self.order = np.argsort(node, kind="stable")
        self.bit = ((byte >> (7 - k)) & 1)[self.order]
        m, node, context = n[self.order], node[self.order], (code >> 8)[self.order]
        first = _starts(node, context)
        ones = np.add.reduceat(m * self.bit, first)
        zeros = np.add.reduceat(m, first) - ones
        self.levels = [(_one(zeros, ones), None, _owner(first, len(code)))]
        node, context, log = node[first], context[first], kt_evidence(zeros, ones)
        for level in range(depth - 1, 1, -1):
            context = context >> 8
            first = _starts(node, context)
            up = _owner(first, len(node))
            zeros, ones, below = (np.add.reduceat(x, first) for x in (zeros, ones, log))
            node, context = node[first], context[first]
            if level > 2:
                log, weight = mixed(zeros, ones, below)
                self.levels.append((_one(zeros, ones), weight, up))
        self.up, self.pair, self.node, self.zeros, self.ones, self.below = up, context, node.astype(np.int64), zeros, ones, below

    def deep(self) -> tuple[np.ndarray, np.ndarray]:
        """For each leaf, the mix of all estimates from its depth to three bytes, and its place among the nodes two bytes deep."""
        p = self.levels[0][0]
        place = np.arange(len(p))
        for estimate, weight, up in self.levels[1:]:
            place = up[place]
            w = weight[place]
            p = w * estimate[place] + (1 - w) * p
        return p, self.up[place]


def _one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def weigh_group(code: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> dict[str, np.ndarray]:
    """Nodes two bytes deep: pair (nearest byte first), node, zeros, ones and log-probability of their children among the codes.

    ``code`` is sorted; codes that agree in their three nearest bytes must be together.
    """
    out: dict[str, list] = {k: [] for k in ("pair", "node", "zeros", "ones", "below")}
    for k in range(8):
        d = Decision(code, n, depth, k)
        for name, x in out.items():
            x.append(getattr(d, name))
    return {k: np.concatenate(x) for k, x in out.items()}


class Top:
    """Weights and estimates of all nodes of at most two bytes of context."""

    def __init__(self, nodes: dict[str, np.ndarray]):
        key = nodes["pair"] * 256 + nodes["node"]
        order = np.argsort(key)
        self.key = key[order]
        zeros, ones, below = (nodes[k][order] for k in ("zeros", "ones", "below"))
        log, self.weight = mixed(zeros, ones, below)
        self.estimate = _one(zeros, ones)
        at = (self.key >> 16) * 256 + (self.key & 255)
        zeros, ones = (np.bincount(at, x, 1 << 16).astype(np.int64).reshape(256, 256) for x in (zeros, ones))
        log, self.weight1 = mixed(zeros, ones, np.bincount(at, log, 1 << 16).reshape(256, 256))
        self.estimate1 = _one(zeros, ones)
        zeros, ones = zeros.sum(0), ones.sum(0)
        self.weight0, self.estimate0 = mixed(zeros, ones, log.sum(0))[1], _one(zeros, ones)

    def mix(self, pair: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rest, share): the probability of a one is rest + share times that of the deeper nodes."""
        place = np.searchsorted(self.key, pair * 256 + node)
        near = pair >> 8
        w2, w1, w0 = self.weight[place], self.weight1[near, node], self.weight0[node]
        rest = w0 * self.estimate0[node] + (1 - w0) * (w1 * self.estimate1[near, node] + (1 - w1) * w2 * self.estimate[place])
        return rest, (1 - w0) * (1 - w1) * (1 - w2)


def score_group(code: np.ndarray, n: np.ndarray, top: Top, depth: int = DEPTH) -> np.ndarray:
    """Natural log-probability of each (sorted) code's byte after its context."""
    total = np.zeros(len(code))
    for k in range(8):
        d = Decision(code, n, depth, k)
        p, two = d.deep()
        rest, share = top.mix(d.pair, d.node)
        p = (rest[two] + share[two] * p)[d.levels[0][2]]
        total[d.order] += np.log(np.where(d.bit == 1, p, 1 - p))
    return total


def pack(x: np.ndarray) -> bytes:
    """Numbers by significance of their bytes, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(sorted_keys: np.ndarray) -> bytes:
    return pack(np.diff(sorted_keys.view(np.uint64), prepend=np.uint64(0)))


def unpack_keys(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64, n), dtype=np.uint64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, held_out, block, s): normalised texts in blocks of about ``BLOCK_BYTES``."""
    block, size = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        of, streams = [], []
        for t in batch.column(2):
            s = normalised(t.as_py())
            if size >= BLOCK_BYTES:
                block, size = block + 1, 0
            size += len(s)
            of.append(block)
            streams.append(s)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of, pa.int64()), pa.array(streams, pa.binary())], names=["id", "held_out", "block", "s"])


def _pieces(streams: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, streams) of runs of about ``PIECE`` bytes together; one text may be longer."""
    first, held, size = 0, [], 0
    for k, s in enumerate(streams):
        s = s.as_py()
        held.append(s)
        size += len(s)
        if size >= PIECE:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted tables of keys and counts as one."""
    if len(parts) < 2:
        return parts
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")  # runs are sorted already
    key = key[order]
    first = _starts(key)
    return [(key[first], np.add.reduceat(n[order], first))]


class Questions:
    """Different words and codes of one block, with their counts in training texts."""

    def __init__(self, block: int, depth: int):
        self.block, self.depth = block, depth
        self.counted: Counter = Counter()
        self.asked: set[bytes] = {END}
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, streams: list[bytes], train: np.ndarray) -> None:
        for s, counts in zip(streams, train.tolist(), strict=True):
            if counts:
                self.counted.update(s.split())
                self.counted[END] += 1
            else:
                self.asked.update(s.split())
        for counts in (True, False):
            some = [s for s, x in zip(streams, train.tolist(), strict=True) if x == counts]
            if some:
                code, n = np.unique(stream_codes(some, self.depth), return_counts=True)
                self.grams.append((code, n if counts else np.zeros(len(code), np.int64)))
        if sum(len(c) for c, _ in self.grams[1:]) > PIECE:
            self.grams = summed(self.grams)

    def rows(self) -> Iterator[pa.RecordBatch]:
        rest = [w for w in self.asked if w not in self.counted]
        keys = word_keys([*self.counted, *rest])
        n = np.concatenate([np.fromiter(self.counted.values(), np.int64, len(self.counted)), np.zeros(len(rest), np.int64)])
        ((keys, n),) = summed([(keys, n), (keys[:0], n[:0])])
        yield from self._dealt(keys, n, GROUPS + (keys % np.uint64(WORD_GROUPS)).astype(np.int64))
        ((code, n),) = summed(self.grams) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        near = code >> (8 * (self.depth - 2))
        yield from self._dealt(code.view(np.uint64), n, ((near * 0x9E3779B1) >> 15) % GROUPS)

    def _dealt(self, keys: np.ndarray, n: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(group.astype(np.uint16), kind="stable")
        keys, n, group = keys[order], n[order], group[order]
        at = [*_starts(group), len(keys)] if len(keys) else []
        rows = [(self.block, int(group[a]), b - a, pack_keys(keys[a:b]), pack(n[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
        if rows:
            columns = zip(("block", "g", "n", "keys", "counts"), zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)
            names, values, kinds = zip(*columns, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=list(names))


ASKED = "block bigint, g int, n int, keys binary, counts binary"


def _ask(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """The questions of each block; a block that is read in two parts asks twice."""
    now = None
    for batch in batches:
        blocks, train = batch.column(1).to_numpy(), ~np.array(batch.column(0).to_pylist(), bool)
        for first, streams in _pieces(batch.column(2)):
            here = blocks[first : first + len(streams)]
            for b in np.unique(here).tolist():
                if now and now.block != b:
                    yield from now.rows()
                    now = None
                now = now or Questions(b, depth)
                some = np.flatnonzero(here == b)
                now.add([streams[i] for i in some], train[first + some])
    if now:
        yield from now.rows()


def _tables(asked: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n, keys, counts in zip(asked["n"], asked["keys"], asked["counts"], strict=True):
        yield unpack_keys(keys.as_py(), n.as_py()), unpack(counts.as_py(), np.int64, n.as_py())


def total_of(asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a group and their counts over all blocks."""
    parts, size = [], 0
    for keys, n in _tables(asked):
        parts.append((keys, n))
        size += len(keys)
        if size > PIECE:
            parts, size = summed(parts), 0
    return summed(parts)[0]


def _answers(asked: pa.Table, value: np.ndarray, keys: np.ndarray, word: bool) -> pa.Table:
    """(block, word, n, keys, answers) for the questions of a group."""
    out = []
    for n, packed in zip(asked["n"], asked["keys"], strict=True):
        mine = unpack_keys(packed.as_py(), n.as_py())
        out.append(pack(value[np.searchsorted(keys, mine)]))
    return pa.table({"block": asked["block"], "word": pa.array([word] * len(out)), "n": asked["n"], "keys": asked["keys"], "answers": pa.array(out, pa.binary())})


ANSWERED = "block bigint, word boolean, n int, keys binary, answers binary"


def _known(answers: pa.Table, word: bool, kind: type) -> tuple[pd.Index, np.ndarray]:
    mine = answers.filter(pa.compute.equal(answers["word"], word))
    keys, values = [], []
    for n, k, v in zip(mine["n"], mine["keys"], mine["answers"], strict=True):
        keys.append(unpack_keys(k.as_py(), n.as_py()))
        values.append(unpack(v.as_py(), kind, n.as_py()))
    index, value = pd.Index(np.concatenate(keys)), np.concatenate(values)
    if not index.is_unique:  # the block was read in two parts
        first = ~index.duplicated()
        index, value = index[first], value[first]
    return index, value


def _score(docs: pa.Table, answers: pa.Table, depth: int) -> pa.Table:
    """Scores of one block's documents from the answers to its questions."""
    words, counts = _known(answers, True, np.int64)
    grams, logs = _known(answers, False, np.float32)
    of: dict[bytes, int] = {}
    out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "n_bytes", "base", "score")}
    for _, streams in _pieces(docs["s"]):
        lists = [s.split() for s in streams]
        new = list({END, *(w for t in lists for w in t)} - of.keys())
        of.update(zip(new, counts[words.get_indexer(word_keys(new))].tolist(), strict=True))
        value = logs[grams.get_indexer(stream_codes(streams, depth).view(np.uint64))].astype(np.float64)
        lengths = np.array([len(s) for s in streams])
        out["n_bytes"] += lengths.tolist()
        out["score"] += np.add.reduceat(value, np.cumsum([0, *lengths[:-1]])).tolist()
        for t in lists:
            c = np.fromiter(map(of.__getitem__, t), np.float64, len(t))
            out["n_tokens"].append(len(t) + 1)
            out["n_known"].append(int((c > 0).sum()) + int(of[END] > 0))
            out["base"].append(float(np.log10(c + 0.5).sum() + np.log10(of[END] + 0.5)))
    kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "n_bytes": pa.int64(), "base": pa.float64()}
    score = pa.array(np.array(out["score"], np.float64) / np.log(10))
    return pa.table({"id": docs["id"], "held_out": docs["held_out"], **{k: pa.array(out[k], t) for k, t in kinds.items()}, "score": score})


def score_documents(docs: DataFrame, held_out: int = 1, fold: int = 5, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Model and unigram log10 probabilities of every whole text.

    Trained on the rows whose crc32(id) mod ``fold`` isn't ``held_out``. Returns
    the id column, held_out, n_tokens, n_known, train_tokens, base_score, score
    and bits_per_byte (code length by bytes of the normalised text).
    """
    if not 3 <= depth <= 6:
        raise ValueError("contexts have three to six bytes")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(remainder(id_col, fold) == held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("t"))
    rows = materialise(rows.mapInArrow(_cut, f"id {kind}, held_out boolean, block bigint, s binary"), "blocks", compression="zstd")
    asked = materialise(rows.select("held_out", "block", "s").mapInArrow(lambda batches: _ask(batches, depth), ASKED), "asked", compression="none")

    def weigh(table: pa.Table) -> pa.Table:
        keys, n = total_of(table)
        return pa.table(weigh_group(keys.view(np.int64), n, depth))

    def count(table: pa.Table) -> pa.Table:
        n = total_of(table)[1]
        return pa.table({"n": [int(n.sum())], "v": [int((n > 0).sum())]})

    is_word = F.col("g") >= GROUPS
    # the questions of the codes are dealt again for the answers: what was dealt for the sums takes no disk then
    with shuffles_removed(docs.sparkSession):
        n, v = asked.where(is_word).groupBy("g").applyInArrow(count, "n bigint, v bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        nodes = asked.where(~is_word).groupBy("g").applyInArrow(weigh, "pair bigint, node bigint, zeros bigint, ones bigint, below double")
        sums = nodes.groupBy("pair", "node").agg(*[F.sum(k).alias(k) for k in ("zeros", "ones", "below")]).toArrow()
    top = Top({k: sums[k].to_numpy() for k in sums.column_names})

    def answer(table: pa.Table) -> pa.Table:
        keys, n = total_of(table)
        word = table["g"][0].as_py() >= GROUPS
        return _answers(table, n if word else score_group(keys.view(np.int64), n, top, depth).astype(np.float32), keys, word)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, depth)

    answers = asked.groupBy("g").applyInArrow(answer, ANSWERED)
    scored = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, n_bytes bigint, base double, score double"
    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, scored)
    normaliser = float(np.log10(n + 0.5 * (v + 1)))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(normaliser)).alias("base_score"),
        "score",
        (F.col("score") / F.lit(-float(np.log10(2.0))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
