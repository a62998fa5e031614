"""Similarity joins over short texts by character overlap, word stems and shared messages."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.text_pairs import close_pairs, earliest_close, id_array, in_order, matcher_ratio, meet, shared, windows
from textloom.operators.windows import first_by, numbered
from textloom.session import discard, materialise


def ratio_column(a: Column, b: Column, junk: bool = False) -> Column:
    """2 M / (|a| + |b|) of the matched blocks of a and b; the measure depends on their order.

    ``junk`` leaves frequent characters of long texts out, as the matcher does
    by default.
    """

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0.0 if not p or not q else SequenceMatcher(None, p, q, autojunk=junk).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


#: Rows of a block whose pairs are results in great part.
PAIR_TEXTS = 2048


def common_letters(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts."""

    @F.pandas_udf("int")
    def length(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            letters, every = np.frombuffer(q.encode("utf-32-le"), np.uint32), (1 << len(q)) - 1
            at = {c: int.from_bytes(np.packbits(letters == ord(c), bitorder="little").tobytes(), "little") for c in set(p) & set(q)}
            v = every
            for c in p:
                u = v & at.get(c, 0)
                v = (v + u | v - u) & every
            out.append(len(q) - v.bit_count())
        return pd.Series(out, dtype="int32")

    return length(a, b)


def bounded_pairs(left: DataFrame, right: DataFrame, threshold: float, block: list[str] | None = None, same: bool = True, places: str | None = None) -> DataFrame:
    """Pairs (a_id, b_id) whose lengths and common multisets of letters allow a ratio of ``threshold``.

    ``left`` and ``right`` have id and text, and the columns of ``block`` on
    which pairs must agree. With ``same`` the pairs are of one table, the
    smaller id first. Counts of letters meet block by block (see ``meet``); texts
    themselves don't travel. Null and empty texts make no pairs. ``places`` names a
    column (k, l) of the lengths of a text's parts: parts of equal k must have as many
    letters in common too, at most; where it is null, nothing is asked of it.
    """
    floor = threshold / (2 - threshold)

    def side(df: DataFrame) -> DataFrame:
        # null agrees with nothing
        agree = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in block or []], F.lit(True))
        low = df.where((F.length("text") > 0) & agree).select("id", F.length("text").alias("n"), F.to_json(F.struct(*block)).alias("g") if block else F.lit("").alias("g"), F.lower("text").alias("t"), *([places] if places else []))
        return low.select("id", "n", "g", *([F.col(places).alias("p")] if places else []), T.letter_counts(F.col("t")).alias("c"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = a.schema.field("id").type, b.schema.field("id").type
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if a.num_rows and b.num_rows:
            own = same and a["i"][0] == b["j"][0]
            a, b = in_order(a), in_order(b)
            x, y, xs, ys = a["n"].to_numpy(), b["n"].to_numpy(), id_array(a), id_array(b)
            gx, gy = np.array(a["g"].to_pylist(), object), np.array(b["g"].to_pylist(), object)
            counts = np.array(a["c"].to_pylist(), np.int32)
            letters = np.ascontiguousarray(np.array(b["c"].to_pylist(), np.int32).T)
            if places:
                px, py = a["p"].to_pylist(), b["p"].to_pylist()
                column = {k: c for c, k in enumerate(sorted({e["k"] for v in py for e in v or ()}))}
                lengths = np.zeros((len(column) + 1, len(py)), np.int32)
                for j, v in enumerate(py):
                    lengths[-1, j] = v is None
                    for e in v or ():
                        lengths[column[e["k"]], j] = e["l"]
            for i, low, high in windows(x, y, floor, own):
                n = y[low:high]
                used = [(int(k), int(counts[i, k])) for k in np.flatnonzero(counts[i])]
                both = threshold * (x[i] + n)
                keep = (2.0 * np.minimum(x[i], n) >= both) & (2.0 * shared(used, letters, slice(low, high)) >= both)
                if places and px[i] is not None:
                    parts = [(column[e["k"]], e["l"]) for e in px[i] if e["k"] in column]
                    keep &= (2.0 * shared(parts, lengths, slice(low, high)) >= both - 1e-9) | (lengths[-1, low:high] > 0)
                if block:
                    keep &= gy[low:high] == gx[i]
                met = ys[low:high][keep]
                mine = np.full(len(met), xs[i], xs.dtype)
                if same:
                    first = met < mine
                    mine, met = np.where(first, met, mine), np.where(first, mine, met)
                    other = mine != met
                    mine, met = mine[other], met[other]
                found.append((mine, met))
        columns = [np.concatenate(c) if found else [] for c in (zip(*found, strict=True) if found else ((), ()))]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a_id", "b_id"])

    kinds = [df.schema["id"].dataType.simpleString() for df in (left, right)]
    return meet(side(left), side(right), floor, compare, f"a_id {kinds[0]}, b_id {kinds[1]}", same, PAIR_TEXTS)


def near_duplicates(df: DataFrame, threshold: float = 0.9, later_first: bool = True, lineage: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept_id, ratio): for each row the first earlier row that is as similar as ``threshold``.

    ``lineage`` names columns of ``df``, such as file and line, that come along
    for both rows, those of the kept row as kept_<name>.

    A row that is itself a duplicate stays in the comparison, so this isn't
    clustering. ``later_first`` compares with the later text first and without
    frequent characters, as single rows are compared; else the earlier one
    comes first and all characters count, as conversations are compared.
    Texts of any length take part; null and empty ones have no ratio. Copies of
    one text are compared once.
    """
    full = df.where(F.length("text") > 0).select("id", "text")
    digest = F.sha2("text", 256).alias("digest")
    if later_first:
        ratio = lambda a, b: matcher_ratio(b, a)
    else:
        ratio = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    # each text goes to the blocks once and is written there alone; what comes back is ids
    found = materialise(earliest_close(full.groupBy("text").agg(F.min("id").alias("id")), threshold, later_first, ratio), "close")
    earliest = found.groupBy("b_id").agg(F.min_by(F.struct("a_id", "ratio"), "a_id").alias("x")).select("b_id", F.col("x.a_id").alias("kept_id"), F.col("x.ratio").alias("ratio"))
    # a copy's first earlier match is its text's first row, or one that is earlier still
    known = full.select("id", digest).groupBy("digest").agg(F.min("id").alias("first")).join(earliest, F.col("first") == F.col("b_id"), "left")
    rows = full.select("id", F.sha2("text", 256).alias("digest")).join(known, "digest")
    kept = F.when(F.col("id") == F.col("first"), F.col("kept_id")).otherwise(F.least("first", F.coalesce("kept_id", "first")))
    score = F.when(kept == F.col("first"), F.lit(1.0)).otherwise(F.col("ratio"))
    out = rows.select("id", kept.alias("kept_id"), score.alias("ratio")).where("kept_id IS NOT NULL")
    if not lineage:
        return out
    own = df.select("id", *lineage)
    return out.join(own, "id").join(own.toDF("kept_id", *[f"kept_{c}" for c in lineage]), "kept_id").select("id", "kept_id", "ratio", *lineage, *[f"kept_{c}" for c in lineage])


def corpus_duplicates(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(category, row_number, kept, similarity, id, source_file, line_no, kept_id, kept_source_file, kept_line_no) over a whole corpus.

    ``rows`` has row_number, running on over all files (see ``number_lines``),
    source_file, line_no, id, instruction, input and output. Repeated ids are
    compared as they are; tasks are instruction and input, both stripped, with
    two bars between; similarities of tasks and outputs have three places.
    A row that repeats an earlier one stays in the comparison.
    """
    r = rows.withColumn("task", F.concat_ws(" || ", T.strip(F.coalesce("instruction", F.lit(""))), T.strip(F.coalesce("input", F.lit(""))))).withColumn("answer", T.strip(F.coalesce("output", F.lit(""))))
    r = materialise(r.select("row_number", "source_file", "line_no", "id", "task", "answer"), "rows")
    first = r.where("id IS NOT NULL").groupBy(F.col("id").alias("same")).agg(F.min("row_number").alias("kept"))
    found = r.join(first, F.col("id") == F.col("same")).where("row_number <> kept").select(F.lit("id_duplicates").alias("category"), "row_number", "kept", F.lit(None).cast("double").alias("similarity"))
    for category, text in (("instruction_duplicates", "task"), ("output_duplicates", "answer")):
        held = r.select(F.col("row_number").alias("id"), F.when(F.translate(text, " |", "") != "", F.col(text)).alias("text")) if text == "task" else r.select(F.col("row_number").alias("id"), F.col(text).alias("text"))
        near = near_duplicates(held, threshold).select(F.lit(category).alias("category"), F.col("id").alias("row_number"), F.col("kept_id").alias("kept"), F.round("ratio", 3).alias("similarity"))
        found = found.unionByName(near)
    own = r.select("row_number", "source_file", "line_no", "id")
    kept = own.toDF("kept", "kept_source_file", "kept_line_no", "kept_id")
    return found.join(own, "row_number").join(kept, "kept").select("category", "row_number", "kept", "similarity", "id", "source_file", "line_no", "kept_id", "kept_source_file", "kept_line_no")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """(id, kept_id): rows whose text an earlier row has; null is a text like any other."""
    first = df.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("id").alias("kept_id"))
    return df.select("id", F.sha2("text", 256).alias("g")).join(first, F.col("g").eqNullSafe(F.col("h"))).where("id <> kept_id").select("id", "kept_id")


def decide(score: Column, inclusive: bool = False) -> Column:
    """reject above 0.95, review above 0.90; null below. Inclusive counts the limits themselves."""
    above = (lambda x: score >= x) if inclusive else (lambda x: score > x)
    return F.when(above(0.95), "reject").when(above(0.90), "review")


def stem_jaccard(df: DataFrame, threshold: float = 0.35, min_words: int = 15) -> DataFrame:
    """(a, b, jaccard) of records whose content-word stems overlap by ``threshold``.

    ``df`` has id and text. Stems are numbered, and sets of numbers meet block by
    block (see ``meet``), where neither may be too large for the other. A task lists
    the sets of one block by stem and counts what each set of the other block shares
    with them, so a pair that fails is never written, and none is joined to its sets.
    Rows without id make no pairs.
    """
    sets = df.where("id IS NOT NULL").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(T.content_words(T.normalise(F.col("text")))))).alias("stems")).where(F.size("stems") >= min_words)
    each = materialise(sets.select("id", F.explode("stems").alias("stem")), "stems")
    rank = numbered(each.groupBy("stem").agg(F.count(F.lit(1)).alias("df")), ["df", "stem"], "k")
    ordered = each.join(rank.select("stem", "k"), "stem").groupBy("id").agg(F.collect_list("k").alias("s"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        kind = a.schema.field("id").type
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if a.num_rows and b.num_rows:
            own = a["i"][0] == b["j"][0]
            a, b = in_order(a), in_order(b)
            x, y, xs, ys = a["n"].to_numpy(), b["n"].to_numpy(), id_array(a), id_array(b)
            stems = b["s"].combine_chunks().flatten().to_numpy()
            by_stem = np.argsort(stems, kind="stable")
            holder = np.repeat(np.arange(len(y), dtype=np.int32), y)[by_stem]
            known, start = np.unique(stems[by_stem], return_index=True)
            end = np.append(start[1:], len(stems))
            mine = a["s"].combine_chunks().flatten().to_numpy()
            at = np.append(0, np.cumsum(x))
            for i, low, high in windows(x, y, threshold, own):
                asked = mine[at[i] : at[i + 1]]
                place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                place = place[known[place] == asked]
                if not len(place):
                    continue
                common = np.bincount(np.concatenate([holder[start[p] : end[p]] for p in place]), minlength=len(y))[low:high]
                jaccard = common / (x[i] + y[low:high] - common)
                keep = np.flatnonzero(jaccard >= threshold)
                met = ys[low + keep]
                same = np.full(len(met), xs[i], xs.dtype)
                first = met < same
                found.append((np.where(first, met, same), np.where(first, same, met), jaccard[keep]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (kind, kind, pa.float64()), strict=True)], names=["a", "b", "jaccard"])

    sized = ordered.select("id", F.size("s").cast("long").alias("n"), "s")
    kind = df.schema["id"].dataType.simpleString()
    return meet(sized, sized, threshold, compare, f"a {kind}, b {kind}, jaccard double")


def conversation_classes(messages: DataFrame) -> DataFrame:
    """(conv_id, class_id, class_size): conversations whose messages are equal in normal form, role and order are one class.

    A class is named by its first conversation. Copies are folded before pairs are made.
    """
    return _classes(messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), T.normalise(F.col("text")).alias("norm")))


def _classes(m: DataFrame) -> DataFrame:
    """``conversation_classes`` of messages in normal form."""
    line = F.struct("turn", "role", "norm")
    whole = m.groupBy("conv_id").agg(F.sha2(F.to_json(F.transform(F.sort_array(F.collect_list(line)), lambda m: F.struct(m["role"], m["norm"]))), 256).alias("h"))
    size = whole.groupBy("h").agg(F.min("conv_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return whole.join(size, "h").select("conv_id", "class_id", "class_size")


def _whole(kinds: Column) -> Column:
    """Digest of (role, digest) of messages in order."""
    return F.unhex(F.sha2(F.to_json(F.transform(kinds, lambda m: F.struct(m["role"], m["h"]))), 256))


def _folded(messages: DataFrame, min_chars: int) -> DataFrame:
    """(conv_id, n, whole, kept): messages of a conversation, a digest of all and the digests of the longer ones with their places."""
    norm = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), T.normalise(F.col("text")).alias("norm"))
    line = F.struct("turn", "role", F.unhex(F.md5("norm")).alias("h"), (F.length("norm") >= min_chars).alias("long"))
    rows = norm.groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("m"))
    kept = F.transform(F.filter("m", lambda x: x["long"]), lambda x: F.struct(x["turn"].cast("long").alias("turn"), x["role"].alias("role"), x["h"].alias("h")))
    return rows.select("conv_id", F.size("m").cast("long").alias("n"), _whole(F.col("m")).alias("whole"), kept.alias("kept"))


def _folded_sentences(docs: DataFrame, min_chars: int) -> DataFrame:
    """``_folded`` of (id, text), whose sentences are messages in turn: no sentence leaves its row but as a digest."""
    norm = docs.select(F.col("id").alias("conv_id"), F.transform(T.sentence_pieces(T.composed(F.col("text"))), lambda x: T.normalise(x, compose=False)).alias("s"))
    role = lambda i: F.when(i % 2 == 0, "user").otherwise("assistant")
    lines = F.transform("s", lambda x, i: F.struct(i.cast("long").alias("turn"), role(i).alias("role"), F.unhex(F.md5(x)).alias("h"), (F.length(x) >= min_chars).alias("long")))
    m = norm.where(F.size("s") > 0).select("conv_id", lines.alias("m"))
    kept = F.transform(F.filter("m", lambda x: x["long"]), lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["h"].alias("h")))
    rows = m.select("conv_id", F.size("m").cast("long").alias("n"), _whole(F.col("m")).alias("whole"), kept.alias("kept"))
    if docs.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        return rows
    # rows that share an id are one
    one = rows.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("whole")).alias("w"), F.flatten(F.collect_list("kept")).alias("kept"))
    return one.select("conv_id", "n", F.when(F.size("w") == 1, F.col("w")[0]).otherwise(F.unhex(F.sha2(F.to_json("w"), 256))).alias("whole"), "kept")


#: Conversations of one message that meet in one task.
MEETING = 2048


def _overlaps(folded: DataFrame) -> DataFrame:
    """(a, b, shared, same_pos, cross_role, moved, fewest) of ``_folded`` conversations; fewest is the shorter one's number of messages.

    What is shared counts pairs of places: a message said twice by both counts
    four times. Messages are looked up from the rarest on. What a conversation
    can still share from a message on is bounded by its own places times the
    most that any other has of each message, so the shorter of a pair, whose need
    is known, is looked up by few messages: those from which this bound reaches
    the need. Where two meet, the message itself counts as it is.
    """
    # the first of equal conversations alone goes on, and travels once
    folded = materialise(first_by(folded, ["whole"], ["conv_id"]).drop("whole"), "digests")
    m = folded.select("conv_id", "n", F.explode("kept").alias("x")).select("conv_id", "n", "x.turn", "x.role", "x.h")
    same = Window.partitionBy("h")
    m = m.withColumns({"lo": F.min("conv_id").over(same), "hi": F.max("conv_id").over(same)}).where("lo < hi")
    role = F.when(F.col("role") == "user", "u").when(F.col("role") == "assistant", "a").otherwise(F.concat(F.lit(":"), "role"))
    kinds = m.select("conv_id", "n", "h", "turn", role.alias("role")).groupBy("h", "conv_id", "n").agg(F.collect_list(F.concat(F.col("turn").cast("string"), "role")).alias("places"), F.collect_list("role").alias("roles"))
    kinds = materialise(kinds.withColumn("times", F.size("places").cast("long")), "kinds")
    discard(folded)
    often = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.max("times").alias("mt"))
    often = materialise(often.withColumn("k", F.monotonically_increasing_id()), "often")
    kinds = materialise(kinds.join(often, "h").drop("h"), "numbered")
    later = Window.partitionBy("conv_id").orderBy(F.desc("df"), F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    most = F.col("times") * F.col("mt")
    index = kinds.select("conv_id", "n", "k", "times", "df", F.sum(most).over(later).alias("reach"), most.alias("most")).where("reach >= 2")
    need = lambda n: F.greatest(F.lit(2).cast("long"), F.floor((3 * F.col(n) + 4) / 5))
    parts = F.floor(F.col("df") / MEETING) + 1
    x = index.where(F.col("reach") >= need("n")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    y = index.withColumn("part", F.pmod(F.xxhash64("conv_id"), parts))
    x, y = (t.select(F.col("conv_id").alias(p), "k", "part", F.col("n").alias(f"n{p}"), F.col("times").alias(f"t{p}"), (F.col("reach") - F.col("most")).alias(f"r{p}")) for t, p in ((x, "x"), (y, "y")))
    shorter = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    enough = F.col("tx") * F.col("ty") + F.least("rx", "ry") >= need("nx")
    pairs = x.join(y, ["k", "part"]).where(shorter & enough).select("x", "y", F.col("nx").alias("fewest")).distinct()
    kx, ky = (kinds.select(F.col("conv_id").alias(p), "k", F.col("places").alias(f"p{p}"), F.col("roles").alias(f"r{p}"), F.col("times").alias(f"t{p}")) for p in "xy")
    met = pairs.join(kx, "x").join(ky, ["y", "k"])
    both = F.array_intersect("px", "py")
    times = lambda c, v: F.size(F.filter(c, lambda p: p == v)).cast("long")
    twice = F.aggregate(both, F.lit(0).cast("long"), lambda n, v: n + times("px", v) * times("py", v))
    single = (F.size(F.array_distinct("px")) == F.col("tx")) & (F.size(F.array_distinct("py")) == F.col("ty"))
    alike = F.aggregate(F.array_distinct("rx"), F.lit(0).cast("long"), lambda n, v: n + times("rx", v) * times("ry", v))
    met = met.select("x", "y", "fewest", (F.col("tx") * F.col("ty")).alias("shared"), F.when(single, F.size(both).cast("long")).otherwise(twice).alias("same_pos"), alike.alias("alike"))
    out = met.groupBy("x", "y", "fewest").agg(F.sum("shared").alias("shared"), F.sum("same_pos").alias("same_pos"), F.sum("alike").alias("alike"))
    out = out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "same_pos", (F.col("shared") - F.col("alike")).alias("cross_role"), (F.col("alike") - F.col("same_pos")).alias("moved"), "fewest")
    elsewhere = F.col("cross_role") + F.col("moved")
    return out.where((F.col("shared") >= need("fewest")) & (elsewhere >= F.greatest(F.lit(2), F.ceil(F.col("shared") / 4))))


def _moved(found: DataFrame) -> DataFrame:
    kind = F.when(F.col("cross_role") >= F.col("moved"), "roles_swapped_messages").otherwise("messages_reordered").alias("type")
    return found.select("a", "b", "shared", "same_pos", "cross_role", "moved", kind, "fewest")


def message_overlap(messages: DataFrame, min_chars: int = 20) -> DataFrame:
    """(a, b, shared, same_pos, cross_role, moved, type) of conversation classes that share moved messages.

    Longer messages are compared in normal form. A pair counts if it shares two
    messages and 60 % of the shorter conversation's, and if two of these, and a
    quarter, are in another place or role. Conversations of equal messages are
    represented by the first (see ``conversation_classes``). No text is shuffled
    but once, to fold each conversation.
    """
    return _moved(_overlaps(_folded(messages, min_chars))).drop("fewest")


def sentence_overlap(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """``message_overlap`` of (id, text) as conversations of their sentences, with the shorter text's number of sentences as fewest."""
    return _moved(_overlaps(_folded_sentences(docs, min_chars)))


def positional_score(messages: DataFrame, pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, score): matched characters of messages at equal places and in equal roles, over all characters.

    With ``least``, pairs are first measured by common subsequences, which no
    match exceeds, and only those that can reach it are matched.
    """
    m = messages.select("conv_id", "turn", "role", T.normalise(F.col("text")).alias("norm"))
    total = m.groupBy("conv_id").agg(F.sum(F.length("norm")).alias("n"))
    x = m.select(F.col("conv_id").alias("a"), "turn", "role", F.col("norm").alias("x"))
    y = m.select(F.col("conv_id").alias("b"), "turn", "role", F.col("norm").alias("y"))
    na, nb = total.select(F.col("conv_id").alias("a"), F.col("n").alias("na")), total.select(F.col("conv_id").alias("b"), F.col("n").alias("nb"))

    def scored(some: DataFrame, matched) -> DataFrame:  # noqa: ANN001
        got = some.select("a", "b").join(x, "a").join(y, ["b", "turn", "role"]).select("a", "b", matched(F.col("x"), F.col("y")).alias("m"))
        out = got.groupBy("a", "b").agg(F.sum("m").alias("m")).join(na, "a").join(nb, "b")
        return out.select("a", "b", F.coalesce(F.try_divide(2 * F.col("m"), F.col("na") + F.col("nb")), F.lit(0.0)).alias("score"))

    if least > 0:
        pairs = materialise(scored(pairs, common_letters).where(F.col("score") >= least - 1e-9), "possible")
    return scored(pairs, lambda p, q: ratio_column(p, q) * (F.length(p) + F.length(q)) / 2)


def _near_texts(texts: DataFrame, threshold: float) -> DataFrame:
    """(x, y, ratio) in both orders for near texts of (id, text), and every text with itself; x comes first in the ratio."""
    near = materialise(close_pairs(texts, texts, threshold).select("a_text", "b_text"), "near")
    forth = near.select(F.col("a_text").alias("x"), F.col("b_text").alias("y"), ratio_column(F.col("a_text"), F.col("b_text")).alias("ratio"))
    back = near.select(F.col("b_text").alias("x"), F.col("a_text").alias("y"), ratio_column(F.col("b_text"), F.col("a_text")).alias("ratio"))
    own = texts.where("text <> ''").select(F.col("text").alias("x"), F.col("text").alias("y"), F.lit(1.0).alias("ratio"))
    return materialise(forth.union(back).where(F.col("ratio") >= threshold).union(own), "ratios")


def aligned_contexts(a: Column, b: Column) -> Column:
    """Ratio of two contexts, arrays of (role, text) of the messages before a question: matched from the last message back.

    Both empty: 1; one empty: 0. Messages at equal distance from the question and
    of equal role are matched, as in ``positional_score``; all others count in
    full as unmatched.
    """

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = list(p if p is not None else ()), list(q if q is not None else ())
            if not len(p) or not len(q):
                out.append(float(len(p) == len(q)))
                continue
            whole = sum(len(m["text"] or "") for m in p) + sum(len(m["text"] or "") for m in q)
            met = 0
            for m, n in zip(reversed(p), reversed(q), strict=False):
                if m["role"] == n["role"] and m["text"] and n["text"]:
                    met += sum(k.size for k in SequenceMatcher(None, m["text"], n["text"], autojunk=False).get_matching_blocks())
            out.append(2.0 * met / whole if whole else 1.0)
        return pd.Series(out, dtype="float64")

    return ratio(a, b)


def context_messages(rendered: Column) -> Column:
    """(role, text) of the messages of a rendered context (lines that begin with User: or AI:), texts in normal form."""
    parts = F.filter(F.split(T.composed(F.coalesce(rendered, F.lit(""))), r"(?m)^(?=User: |AI: )"), lambda m: m != "")
    return F.transform(parts, lambda m: F.struct(F.when(m.startswith("AI: "), "assistant").otherwise("user").alias("role"), T.normalise(F.regexp_replace(m, "^(User|AI): ", ""), compose=False).alias("text")))


def sample_findings(samples: DataFrame, inclusive: bool = False) -> DataFrame:
    """(a, b, type, status, score) of training samples that repeat each other.

    ``samples`` has id, owner (its conversation), question, answer and context (a
    rendering, see ``context_messages``). Questions and answers are compared in
    normal form, contexts message by message from the last one back, the earlier
    sample first. Equal samples are folded into classes, whose members are linked
    to the first (sample_exact, rejected whatever their length). Classes whose
    questions and answers both reach 0.90 are compared pair by pair; the score is
    the least of the three ratios, and texts below 60 characters are reviewed
    instead of decided. Classes that share a question but not an answer are
    information: they are linked to the first class of their question, and first
    classes of near questions to each other, so a frequent question makes no
    pairs of its own members.
    """
    n = lambda c: T.normalise(F.col(c))
    s = samples.select("id", "owner", n("question").alias("q"), n("answer").alias("a"), context_messages(F.col("context")).alias("c"))
    classes = materialise(s.groupBy("q", "a", "c").agg(F.min_by(F.struct("id", "owner"), "id").alias("f")).select("q", "a", "c", F.col("f.id").alias("id"), F.col("f.owner").alias("owner")), "samples")
    same = s.join(classes.withColumnsRenamed({"id": "first", "owner": "first_owner"}), ["q", "a", "c"]).where("id <> first AND owner <> first_owner AND q <> ''")
    exact = same.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit("sample_exact").alias("type"), F.lit("reject").alias("status"), F.lit(1.0).alias("score"))
    texts = lambda c: classes.groupBy(F.col(c).alias("text")).agg(F.min("id").alias("id")).where("text <> ''")
    questions = _near_texts(texts("q"), 0.90).toDF("x", "y", "rq")
    answers = _near_texts(texts("a"), 0.90).toDF("u", "v", "ra")
    l = classes.select(F.col("id").alias("ia"), F.col("owner").alias("oa"), F.col("q").alias("x"), F.col("a").alias("u"), F.col("c").alias("ca"))  # noqa: E741
    r = classes.select(F.col("id").alias("ib"), F.col("owner").alias("ob"), F.col("q").alias("y"), F.col("a").alias("v"), F.col("c").alias("cb"))
    strong = l.join(questions, "x").join(answers, "u").join(r, ["y", "v"]).where("ia < ib AND oa <> ob")
    # classes of one question to its first, first classes of near questions to each other
    heads = classes.groupBy("q").agg(F.min("id").alias("head"))
    hx, hy = heads.toDF("x", "ia"), heads.toDF("y", "ib")
    weak = hx.join(questions.where("x <> y"), "x").join(hy, "y").select("ia", "ib", "rq").union(classes.join(heads, "q").where("id <> head AND q <> ''").select("head", "id", F.lit(1.0)))
    weak = weak.where("ia < ib").join(l, "ia").join(r, "ib").where("oa <> ob")
    # all near answers are known: what isn't among them is below 0.90
    weak = weak.join(answers.select("u", "v"), ["u", "v"], "left_anti").withColumn("ra", F.lit(0.0))
    columns = ["ia", "ib", "x", "y", "u", "v", "ca", "cb", "rq", "ra"]
    return exact.union(_judged(strong.select(columns).union(weak.select(columns)), inclusive))


def _judged(met: DataFrame, inclusive: bool) -> DataFrame:
    """(a, b, type, status, score) of pairs (ia, ib) with their questions x and y, answers u and v, contexts and the first two ratios."""
    met = met.withColumn("rc", aligned_contexts(F.col("ca"), F.col("cb")))
    score = F.least("rq", "ra", "rc")
    short = F.least(F.length("x") + F.length("u"), F.length("y") + F.length("v")) < 60
    close = (F.col("rc") >= 0.90) & (F.col("ra") >= 0.90)
    above = (score >= 0.90) if inclusive else (score > 0.90)
    long = (F.length("x") >= 30) & (F.length("y") >= 30)
    kind = (
        F.when(close & ~above, "sample_at_boundary")
        .when(close & short, "sample_near_short")
        .when(close, "sample_near")
        .when(long & (F.col("rc") < 0.90) & (F.col("ra") >= 0.90), "same_qa_different_context")
        .when(long & (F.col("rc") < 0.90), "same_question_different_context")
        .when(long, "same_question_context_different_answer")
    )
    status = F.when(kind == "sample_near", decide(score, inclusive)).when(kind == "sample_near_short", "review").otherwise("info")
    return met.select(F.col("ia").alias("a"), F.col("ib").alias("b"), kind.alias("type"), status.alias("status"), F.when(close, score).otherwise(F.col("rq")).alias("score")).where("type IS NOT NULL")


def _near_between(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(x, y, ratio) of texts of two tables of (id, text), equal ones included; x is of the first table."""
    near = materialise(close_pairs(left, right, threshold, same=False).select(F.col("a_text").alias("x"), F.col("b_text").alias("y")), "near")
    return materialise(near.withColumn("ratio", ratio_column(F.col("x"), F.col("y"))).where(F.col("ratio") >= threshold), "ratios")


def export_findings(samples: DataFrame, export: DataFrame, inclusive: bool = False) -> DataFrame:
    """(record, row, type, status, score): training samples that repeat rows of an export, as ``sample_findings`` judges them.

    Both tables have id, question, answer and context; ``samples`` also has owner,
    the record that is returned. Equal samples of either table are one class:
    every member is linked to the other table's first, so that copies on both
    sides make no squares. Classes of near questions and answers are compared;
    classes of near questions alone meet through the first class of the other
    table's question.
    """
    n = lambda c: T.normalise(F.col(c))
    side = lambda df: df.select("id", n("question").alias("q"), n("answer").alias("a"), context_messages(F.col("context")).alias("c"))
    mine, theirs = side(samples), side(export)
    folded = lambda df: materialise(df.where("q <> ''").groupBy("q", "a", "c").agg(F.min("id").alias("id")), "classes")
    s, e = folded(mine), folded(theirs)
    texts = lambda df, c: df.groupBy(F.col(c).alias("text")).agg(F.min("id").alias("id")).where("text <> ''")
    questions = _near_between(texts(s, "q"), texts(e, "q"), 0.90).toDF("x", "y", "rq")
    answers = _near_between(texts(s, "a"), texts(e, "a"), 0.90).toDF("u", "v", "ra")
    l = s.select(F.col("id").alias("ia"), F.col("q").alias("x"), F.col("a").alias("u"), F.col("c").alias("ca"))  # noqa: E741
    r = e.select(F.col("id").alias("ib"), F.col("q").alias("y"), F.col("a").alias("v"), F.col("c").alias("cb"))
    columns = ["ia", "ib", "x", "y", "u", "v", "ca", "cb", "rq", "ra"]
    strong = l.join(questions, "x").join(answers, "u").join(r, ["y", "v"]).select(columns)
    first_l, first_r = l.groupBy("x").agg(F.min("ia").alias("ia")).join(l, ["x", "ia"]), r.groupBy("y").agg(F.min("ib").alias("ib")).join(r, ["y", "ib"])
    weak = l.join(questions, "x").join(first_r, "y").select(columns[:-1]).union(first_l.join(questions, "x").join(r, "y").select(columns[:-1])).distinct()
    # all near answers are known: what isn't among them is below 0.90
    weak = weak.join(answers.select("u", "v"), ["u", "v"], "left_anti").withColumn("ra", F.lit(0.0)).select(columns)
    same = (F.col("x") == F.col("y")) & (F.col("u") == F.col("v")) & (F.col("ca") == F.col("cb"))
    both = strong.union(weak)
    judged = _judged(both.where(~same), inclusive)
    exact = both.where(same).select(F.col("ia").alias("a"), F.col("ib").alias("b"), F.lit("sample_exact").alias("type"), F.lit("reject").alias("status"), F.lit(1.0).alias("score"))
    found = materialise(judged.union(exact), "found")
    # members of a class: each side's with the other side's first
    members = lambda df, classes, name: df.join(classes.withColumnRenamed("id", "first"), ["q", "a", "c"]).select(F.col("first").alias(name), F.col("id").alias(f"{name}_member"))
    wide = found.join(members(mine, s, "a"), "a").select("a_member", F.col("b").alias("b_member"), "type", "status", "score")
    long = found.join(members(theirs, e, "b"), "b").select(F.col("a").alias("a_member"), "b_member", "type", "status", "score")
    owner = samples.select(F.col("id").alias("a_member"), F.col("owner").alias("record"))
    return wide.union(long).distinct().join(owner, "a_member").groupBy("record", F.col("b_member").alias("row"), "type", "status").agg(F.max("score").alias("score"))


def shared_answers(samples: DataFrame) -> DataFrame:
    """(a, b, score): equal or nearly equal longer answers (0.95) to different questions (below 0.90).

    Samples of one answer are linked to the first that gives it, samples of near
    answers to each other's first: an answer that many questions have makes as
    many rows as it has samples. Equal (question, answer) are one sample.
    """
    n = lambda c: T.normalise(F.col(c))
    s = samples.select("id", "owner", n("question").alias("q"), n("answer").alias("a")).where(F.length("a") >= 60)
    classes = s.groupBy("q", "a").agg(F.min_by(F.struct("id", "owner"), "id").alias("f")).select("q", F.col("a").alias("x"), F.col("f.id").alias("id"), F.col("f.owner").alias("owner"))
    classes = materialise(classes, "answers")
    heads = classes.groupBy("x").agg(F.min_by(F.struct("id", "owner", "q"), "id").alias("h"))
    near = _near_texts(heads.select(F.col("h.id").alias("id"), F.col("x").alias("text")), 0.95)
    met = classes.join(near, "x").join(heads.select(F.col("x").alias("y"), "h"), "y").where("id <> h.id AND owner <> h.owner")
    far = ratio_column(F.when(F.col("id") < F.col("h.id"), F.col("q")).otherwise(F.col("h.q")), F.when(F.col("id") < F.col("h.id"), F.col("h.q")).otherwise(F.col("q"))) < 0.90
    return met.where(far).groupBy(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).agg(F.max("ratio").alias("score"))


def masked_findings(samples: DataFrame, masked: DataFrame, named: DataFrame, decided: DataFrame, inclusive: bool = False) -> DataFrame:
    """(a, b, type, status, score): findings that only texts without names show, for review.

    ``masked`` are the samples with names masked, ``named`` the ids of those that
    had any. Pairs of which neither side has names, and pairs that already have a
    decision (``decided``: a, b, status), are left out; what is left is
    ``sample_name_swapped``, to be reviewed. ``samples`` gives the owners.
    """
    ids = named.select("id").distinct()
    found = sample_findings(masked, inclusive).where(F.col("status").isin("reject", "review"))
    sided = found.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").select(found.columns).union(found.join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select(found.columns)).distinct()
    done = decided.where(F.col("status").isin("reject", "review")).select("a", "b").distinct()
    left = sided.join(done, ["a", "b"], "left_anti")
    known = samples.select("id")
    left = left.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    return left.select("a", "b", F.lit("sample_name_swapped").alias("type"), F.lit("review").alias("status"), "score")


def near_conversations(messages: DataFrame, info: float = 0.80) -> DataFrame:
    """(a, b, score, status) of conversation classes that are near each other, message by message.

    Candidates are conversations whose whole texts can reach ``info`` by length
    and letters, and by the lengths of messages of equal place and role; the score matches messages of equal place and role. Above 0.95
    is rejected, above 0.90 reviewed, the rest is information.
    """
    first = conversation_classes(messages).where("conv_id = class_id").select("conv_id")
    mine = messages.join(first, "conv_id", "left_semi")
    norm = mine.select("conv_id", "turn", "role", T.normalise(F.col("text")).alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "t"))), lambda m: m["t"]), "").alias("text")
    # a message without turn or role meets none
    part = F.when(F.col("turn").isNotNull() & F.col("role").isNotNull(), F.struct(F.concat_ws("|", F.col("turn").cast("string"), "role").alias("k"), F.length("t").alias("l")))
    whole = norm.groupBy(F.col("conv_id").alias("id")).agg(text, F.collect_list(part).alias("parts"))
    # two messages of one place and role meet each of another's, so their lengths bound nothing
    once = F.size(F.array_distinct(F.col("parts.k"))) == F.size("parts")
    whole = whole.select("id", "text", F.when(once, F.col("parts")).alias("parts"))
    pairs = materialise(bounded_pairs(whole, whole, info, places="parts"), "pairs").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    scored = positional_score(mine, pairs, info).where(F.col("score") >= info)
    return scored.select("a", "b", "score", F.coalesce(decide(F.col("score")), F.lit("info")).alias("status"))
