"""Exact merge-type encoding of a sentencepiece BPE model by backtracking.

A piece sequence is the merge result of a text exactly when every piece is the
merge result of itself and every two adjacent pieces are the merge result of
their concatenation. The encoder walks a text with the longest pieces that an
Aho-Corasick automaton finds at each position, checks each new piece against
its left neighbour by re-merging the two, falls back to shorter pieces, and
marks positions from which no continuation exists in a bitfield so that none
is tried twice.

Texts are cut where no merge can reach: before a space that follows another
character (no piece holds a space behind one) and around characters that occur
in no piece. The encoding of each distinct segment is kept in a bounded cache.

Defined results: a null text is encoded as the empty text, which has no ids;
characters outside the vocabulary become byte pieces; texts are always
processed whole; repeated rows give repeated results; an empty table gives an
empty table. Only the named id and text columns are read, so extra columns
never clash.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Entries, and characters in them, that one generation of a worker's segment cache holds at most.
CACHE_ENTRIES = 250_000
CACHE_CHARS = 8_000_000
#: Longer segments are encoded each time.
CACHED_CHARS = 1_000
PAIR_ENTRIES = 200_000
#: Marks that often follow a word; a segment is cut before them where no piece holds both neighbours.
MARKS = ".,;:!?*%&$#|)"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a BPE model; its size is that of the model file."""

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: tuple[int, ...]


def load_vocabulary(model_path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    scores, ids, byte_ids = {}, {}, [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            piece = piece.replace(SPACE, " ")
            scores[piece], ids[piece] = sp.get_score(i), i
    return Vocabulary(scores, ids, tuple(byte_ids))


def merge(text: str, scores: dict[str, float], log: list[tuple[str, str]] | None = None) -> list[str]:
    """Merge adjacent symbols, best score first and leftmost among equals; ``log`` gets each merge."""
    n = len(text)
    symbol = list(text)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (s := scores.get(both := symbol[i] + symbol[j])) is not None:
            heapq.heappush(heap, (-s, i, j, both))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if not symbol[i] or not symbol[j] or right[i] != j or symbol[i] + symbol[j] != both:
            continue
        if log is not None:
            log.append((symbol[i], symbol[j]))
        symbol[i], symbol[j] = both, ""
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i], i)
        offer(i, right[i])
    return [s for s in symbol if s]


class Encoder:
    """Encodes segments of text; one per worker process."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        self.v = vocabulary
        scores = vocabulary.scores
        self.automaton = ahocorasick.Automaton()
        chars: set[str] = set()
        #: Place of a piece in the order of merges; characters come before all merges.
        self.rank = {p: i if len(p) > 1 else -1 for i, p in enumerate(sorted(scores, key=lambda p: -scores[p]))}
        self.split: dict[str, tuple[str, str]] = {}
        for piece in scores:
            chars.update(piece)
            log: list[tuple[str, str]] = []
            if len(piece) == 1 or merge(piece, scores, log) == [piece]:
                self.automaton.add_word(piece, len(piece))
                if log:
                    self.split[piece] = log[-1]
        self.automaton.make_automaton()
        self.chars = chars
        # equal scores decide by place, which pairs alone don't show; such runs are merged directly
        seen: dict[float, int] = {}
        for s in scores.values():
            seen[s] = seen.get(s, 0) + 1
        self.tied = {p for p, s in scores.items() if seen[s] > 1}
        self.tie_free = all(set(p) == {" "} for p in self.tied)
        # if each piece is merged after both its parts, undoing the latest merges replays the order of merging
        self.ordered = all(self.rank[p] > max(self.rank[a], self.rank[b]) for p, (a, b) in self.split.items() if p not in self.tied)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.adjacent = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.surface = {i: p.encode() for p, i in vocabulary.ids.items()} | {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        #: Two generations, so that frequent segments outlive a full cache.
        self.cache: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.held = 0
        self.last: tuple[str | None, tuple[str, str]] = ("", ("", ""))

    def remerges(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` gives ``a`` and ``b`` again.

        The last merges are undone one by one, the latest first. The two parts
        that then meet at the border would have been merged across it if their
        union came before the merge just undone.
        """
        if not self.ordered:
            return merge(a + b, self.v.scores) == [a, b]
        rank, split, limit = self.rank, self.split, len(self.rank)
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, split[a][1]  # of equal merges the left one comes first: a's own before the border's
            else:
                limit, b = rb + 1, split[b][0]

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            known = self.remerges(a, b)
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def pieces(self, text: str) -> list[str]:
        """The merge result of ``text``, found by backtracking."""
        if not text:
            return []
        if (self.tied and "  " in text) or not self.tie_free:
            return merge(text, self.v.scores)
        n = len(text)
        ending: list[list[int]] = [[1] for _ in range(n)]  # lengths of the pieces that start here, ascending; a character outside the vocabulary stands alone
        for end, length in self.automaton.iter(text):
            if length > 1:
                ending[end - length + 1].append(length)
        failed = bytearray(n // 8 + 1)
        out: list[tuple[int, int]] = []  # (start, place in ending[start])
        at, choice = 0, len(ending[0]) - 1
        while at < n:
            before = text[out[-1][0] : at] if out else ""
            while choice >= 0:
                end = at + ending[at][choice]
                if not (failed[end >> 3] >> (end & 7)) & 1 and (not out or self.compatible(before, text[at:end])):
                    break
                choice -= 1
            if choice >= 0:
                out.append((at, choice))
                at = end
                choice = len(ending[at]) - 1 if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no merge sequence")
                at, choice = out.pop()
                choice -= 1
        return [text[s : s + ending[s][c]] for s, c in out]

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            known = self.v.ids.get(piece)
            out.extend([known] if known is not None else [self.v.byte_ids[b] for b in piece.encode()])
        return out

    def segment(self, key: str) -> tuple[str, str]:
        """Joined ids and the text they decode to, of one segment, which is cached."""
        value = self.older.get(key)
        if value is None:
            core = key.rstrip(MARKS)
            at = len(core)
            if core and at < len(key) and core[-1] != " " and key[at - 1 : at + 1] not in self.adjacent:
                # no piece reaches from the word into the marks behind it
                a, b = self.cache.get(core) or self.segment(core), self.cache.get(key[at:]) or self.segment(key[at:])
                value = (f"{a[0]},{b[0]}", a[1] + b[1])
            else:
                ids = self.ids(key)
                value = (",".join(map(str, ids)), self.decode(ids))
        if len(key) <= CACHED_CHARS:
            if len(self.cache) >= CACHE_ENTRIES or self.held >= CACHE_CHARS:
                self.older, self.cache, self.held = self.cache, {}, 0
            self.cache[key] = value
            self.held += len(key)
        return value

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")

    def segments(self, text: str) -> list[str]:
        """Cut ``text``, with the space that the model puts before it, where no merge can reach."""
        text = (" " + text).replace(SPACE, " ")
        if "  " not in text and "\n" not in self.chars:
            # one space before every segment but those after a line end, which keep that
            words = text[1:].replace("\n", " \n").split(" ")
            return [w if w[:1] == "\n" else " " + w for w in words]
        return re.findall(r" *[^ ]+| +", text)

    def encode(self, text: str | None) -> tuple[str, str]:
        """Comma-joined ids of a whole text, and what they decode to."""
        if not text:
            return "", ""
        if text == self.last[0]:  # copies of a text follow each other in a mix
            return self.last[1]
        segment = self.segment
        found = [self.cache.get(s) or segment(s) for s in self.segments(text)]
        # the first piece starts with the space that the model had put there
        self.last = text, (",".join([x[0] for x in found]), "".join([x[1] for x in found])[1:])
        return self.last[1]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    key = hash((len(vocabulary.ids), vocabulary.byte_ids, sum(vocabulary.scores.values())))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encode_documents(
    df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False
) -> DataFrame:
    """Token ids of every whole text, and the digest of ids and decoded text.

    Returns the id column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``;
    with ``with_ids`` also ``ids`` (array of int), with ``with_text`` also
    ``decoded``. The model's vocabulary, as large as its file, is all that is
    broadcast.
    """
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(model_path))
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(3 + with_ids + with_text)]
            for text in batch.column(1):
                ids, decoded = encoder.encode(text.as_py())
                row = [ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                row += [[int(i) for i in ids.split(",")] if ids else []] * with_ids + [decoded] * with_text
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids + [pa.string()] * with_text
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, out, types)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_text,
            )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
