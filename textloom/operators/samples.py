"""Training samples: exploded conversations, renderings, blocks, encodings, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.windows import numbered

PROMPT_USER, PROMPT_REPLY = 80, 120
MAX_SAMPLE, MIN_SAMPLE, CONTEXT = 4096, 2, 64
BYTES_PER_CHAR = 20


def by_turn() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn")


def samples(messages: DataFrame) -> DataFrame:
    """One sample for each assistant turn that follows a user turn: question, answer, context of the exchange before."""
    w = by_turn()
    out = messages.withColumns({f"{c}{k}": F.lag(c, k).over(w) for k in (1, 2, 3) for c in ("role", "text")})
    paired = (F.col("role3") == "user") & (F.col("role2") == "assistant")
    context = F.when(paired, F.concat(F.lit("User: "), F.col("text3"), F.lit("\nAI: "), F.col("text2"))).otherwise(F.lit(""))
    return out.where("role = 'assistant' AND role1 = 'user'").select("conv_id", "turn", F.col("text1").alias("question"), F.col("text").alias("answer"), context.alias("context"))


def full_history(messages: DataFrame) -> DataFrame:
    """Every assistant turn with all that was said before, and the offsets of its own text in the rendering."""
    label = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "AI: ").otherwise(F.concat(F.initcap("role"), F.lit(": ")))
    line = messages.withColumn("line", F.concat(label, "text"))
    so_far = F.array_join(F.collect_list("line").over(by_turn().rowsBetween(Window.unboundedPreceding, 0)), "\n")
    out = line.withColumn("rendered", so_far).where("role = 'assistant'")
    end = F.length("rendered")
    return out.select("conv_id", "turn", "rendered", (end - F.length("text")).alias("target_start"), end.alias("target_end"))


def last_exchange(messages: DataFrame) -> DataFrame:
    """The rendering that is used when answering: the last exchange alone, cut, then the question."""
    w = by_turn()
    out = messages.withColumns({f"{c}{k}": F.lag(c, k).over(w) for k in (1, 2, 3) for c in ("role", "text")}).where("role = 'assistant' AND role1 = 'user'")
    paired = (F.col("role3") == "user") & (F.col("role2") == "assistant")
    u, a = T.trim_to(F.col("text3"), PROMPT_USER), T.trim_to(F.col("text2"), PROMPT_REPLY)
    used = F.coalesce(paired & (u != "") & (a != ""), F.lit(False))
    lost = F.when(used, F.greatest(F.length(T.strip(F.col("text3"))) - PROMPT_USER, F.lit(0)) + F.greatest(F.length(T.strip(F.col("text2"))) - PROMPT_REPLY, F.lit(0))).otherwise(0)
    rendered = F.concat(F.when(used, F.concat(F.lit("User: "), u, F.lit("\nAI: "), a, F.lit("\n\n"))).otherwise(F.lit("")), F.lit("User: "), "text1", F.lit("\nAI: "), "text")
    return out.select("conv_id", "turn", rendered.alias("rendered"), used.alias("has_context"), lost.cast("long").alias("lost_chars"), (lost == 0).alias("lossless"))


def block_reasons(instruction: Column, input_: Column, output: Column) -> Column:
    """Why a row can't be carried as a text block without loss; empty if it can."""
    fields = {"instruction": instruction, "input": input_, "output": output}
    label = r"(?i)(^|\n)\s*(user|ai)\s*:"
    rules = [
        *((f"field_not_string:{k}", v.isNull()) for k, v in fields.items()),
        ("empty_instruction", T.blank(instruction)),
        ("empty_output", T.blank(output)),
        ("whitespace_only_input", (input_ != "") & T.blank(input_)),
    ]
    for k, v in fields.items():
        rules += [
            (f"carriage_return:{k}", v.contains("\r")),
            (f"control_character:{k}", F.regexp_replace(v, "[\n\t\r]", "").rlike("[\\p{Cc}  ]")),
            (f"blank_line:{k}", v.contains("\n\n")),
            (f"edge_newline:{k}", v.startswith("\n") | v.endswith("\n")),
        ]
    rules += [
        ("multiline_instruction", instruction.contains("\n")),
        ("role_label_at_line_start:input", input_.rlike(label)),
        ("role_label_at_line_start:output", output.rlike(r"(?i)\n\s*(user|ai)\s*:")),
    ]
    return T.flags(rules)


def block_flags(instruction: Column, input_: Column, output: Column) -> Column:
    inline = r"(?i)(^|[^a-z0-9])(user|ai)\s*:"
    return T.flags(
        [
            ("inline_role_label", instruction.rlike(inline) | input_.rlike(inline) | output.rlike(inline)),
            ("multiline_input", input_.contains("\n")),
            ("multiline_output", output.contains("\n")),
            ("has_input", input_ != ""),
        ]
    )


def render_block(instruction: Column, input_: Column, output: Column) -> Column:
    return F.concat(F.lit("User: "), instruction, F.when(input_ != "", F.concat(F.lit("\n"), input_)).otherwise(F.lit("")), F.lit("\nAI: "), output)


def parse_block(block: Column) -> Column:
    """struct(instruction, input, output) of a block; the first answer line is the border."""
    border = F.locate("\nAI: ", block)
    user = F.substring(block, F.lit(7), border - 7)
    line = F.locate("\n", user)
    return F.when(
        block.startswith("User: ") & (border > 0),
        F.struct(
            F.when(line > 0, F.substring(user, F.lit(1), line - 1)).otherwise(user).alias("instruction"),
            F.when(line > 0, F.substring(user, line + 1, F.length(user))).otherwise(F.lit("")).alias("input"),
            F.substring(block, border + 5, F.length(block)).alias("output"),
        ),
    )


def char_vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    """(ch, id): different characters in the order of their code points, ids from 0.

    Characters are at most as many as Unicode has, so the numbering window sees
    a bounded table whatever the corpus holds.
    """
    chars = df.select(F.explode(F.array_distinct(F.split(text_col, ""))).alias("ch")).where("ch <> ''").distinct()
    return chars.select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).alias("id"))


def encode(text: Column, vocabulary: Column, unknown: Column | int) -> Column:
    """Ids of all characters; ``vocabulary`` is a map, what it lacks becomes ``unknown``."""
    unk = unknown if isinstance(unknown, Column) else F.lit(unknown)
    return F.transform(F.array_remove(F.split(text, ""), ""), lambda c: F.coalesce(F.try_element_at(vocabulary, c), unk))


def target_mask(length: Column, start: Column, end: Column) -> Column:
    """Of the shifted pairs, 1 where the predicted place is in [start, end)."""
    zero, size = F.lit(0), F.greatest(length - 1, F.lit(0))
    # pair i predicts place i + 1; runs in place of a look at each place
    low = F.least(F.greatest(start - 1, zero), size)
    high = F.greatest(F.least(end - 1, size), low)
    run = lambda v, n: F.array_repeat(F.lit(v), n.cast("int"))
    return F.concat(run(0, low), run(1, high - low), run(0, size - high))


def mask_sum(mask: Column) -> Column:
    """Sum of a mask; where all are 0 or 1, ones are counted, which takes no step of its own for each place."""
    others = F.array_remove(mask, F.lit(1))
    binary = F.size(F.array_remove(others, F.lit(0))) == 0
    return F.when(binary, F.size(mask) - F.size(others)).otherwise(F.aggregate(mask, F.lit(0), lambda a, x: a + x))


def length_class(length: Column) -> Column:
    """Why a sample is withheld: too_long, too_short, or null if it is kept."""
    return F.when(length > MAX_SAMPLE, "too_long").when(length < MIN_SAMPLE, "too_short")


def floor_rank_percentiles(df: DataFrame, value: str, percents: tuple[int, ...] = (90, 99)) -> DataFrame:
    """One row: count, min, max, mean, median and percentiles at the lower rank int(p / 100 (n - 1)).

    Values are counted first, so ranks come from a table of different values.
    """
    counts = df.groupBy(F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    n = F.col("n")
    half = (at(F.floor((n - 1) / 2)) + at(F.ceil((n - 1) / 2))) / 2
    return ranked.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        half.alias("median"),
        *[at(F.floor(F.lit(p) / 100.0 * (n - 1))).alias(f"p{p}") for p in percents],
    )


def batches(df: DataFrame, order: list[str], length: str, size: int) -> DataFrame:
    """(batch, padded length, padding) of batches of ``size`` rows in order."""
    rows = numbered(df, order, "__number")
    out = rows.select(F.floor((F.col("__number") - 1) / size).alias("batch"), F.col(length).alias("n"))
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.max("n").cast("long").alias("padded_to"), (F.max("n") * F.count(F.lit(1)) - F.sum("n")).cast("long").alias("padding"))


# What makes a conversation hard, and the bands of its exchanges.
HARD_FAMILIES, HARD_DEPTH = ("F4", "F7"), 2


def length_band(exchanges: Column) -> Column:
    return F.when(exchanges.between(3, 4), "3-4").when(exchanges.between(5, 6), "5-6").when(exchanges.between(7, 8), "7-8").otherwise("other")


def is_hard(family: Column, depends: Column) -> Column:
    """A conversation that goes back two exchanges or more, or is of a hard family."""
    deepest = F.array_max(F.transform(depends, lambda d: d["depth"]))
    return F.coalesce(family.isin(*HARD_FAMILIES), F.lit(False)) | F.coalesce(deepest >= HARD_DEPTH, F.lit(False))


def task_text(instruction: Column, input_: Column) -> Column:
    """Instruction and input as one text, by which tasks of one template are told apart."""
    return F.concat(T.strip(F.coalesce(instruction, F.lit(""))), F.lit(" || "), T.strip(F.coalesce(input_, F.lit(""))))


def pseudo_samples(rows: DataFrame) -> DataFrame:
    """(id, owner, question, answer, context) of exported rows, to be compared with training samples; they have no context."""
    more = F.when(F.coalesce("input", F.lit("")) != "", F.concat(F.lit(" "), "input")).otherwise(F.lit(""))
    question = F.concat(F.coalesce("instruction", F.lit("")), more)
    return rows.select("id", F.col("id").alias("owner"), question.alias("question"), F.coalesce("output", F.lit("")).alias("answer"), F.lit("").alias("context"))


def parse_rendered(rendered: Column) -> Column:
    """Messages (role, text) of a rendering in blocks ``User: ...``, ``AI: ...``, parted by empty lines; null if it isn't one.

    It reads what is written, not how it was made, so it can check a rendering.
    """
    blocks = F.transform(F.split(rendered, "\n\n"), lambda b: F.split(b, "\n"))
    good = F.forall(blocks, lambda x: (F.size(x) == 2) & F.get(x, F.lit(0)).startswith("User: ") & F.get(x, F.lit(1)).startswith("AI: "))
    message = lambda role, line, label: F.struct(F.lit(role).alias("role"), F.substring(line, F.lit(len(label) + 1), F.length(line)).alias("text"))
    pairs = F.transform(blocks, lambda x: F.array(message("user", F.get(x, F.lit(0)), "User: "), message("assistant", F.get(x, F.lit(1)), "AI: ")))
    return F.when(good, F.flatten(pairs))


def assemble(messages: DataFrame, depends: DataFrame) -> DataFrame:
    """Training samples with what their rendering keeps of the conversation.

    ``depends`` has conv_id, turn, on (places that the turn goes back to) and
    depth. Of each assistant turn: sample_id (``conversation#R2#turn``), the
    rendering of the last exchange, whether a declared dependency is covered by
    what is rendered and which places are missing, the messages that were cut
    and by how much (``history_truncation``), and ``lossless``: nothing cut and
    no dependency missing.
    """
    w = by_turn()
    cut = lambda k, most: F.greatest(F.length(T.strip(F.col(f"text{k}"))) - most, F.lit(0))
    rendered = last_exchange(messages)
    back = messages.select("conv_id", "turn", *[F.lag("text", k).over(w).alias(f"text{k}") for k in (2, 3)])
    out = rendered.join(back, ["conv_id", "turn"]).join(depends.select("conv_id", "turn", "on", "depth"), ["conv_id", "turn"], "left")
    present = F.when(F.col("has_context"), F.array(F.col("turn") - 3, F.col("turn") - 2, F.col("turn") - 1)).otherwise(F.array(F.col("turn") - 1))
    missing = F.when(F.col("on").isNotNull(), F.sort_array(F.array_except(F.transform("on", lambda x: x.cast("long")), present)))
    part = lambda k, role, most: F.when(
        F.col("has_context") & (cut(k, most) > 0), F.struct((F.col("turn") - k).alias("turn"), F.lit(role).alias("role"), F.length(F.col(f"text{k}")).alias("original_chars"), cut(k, most).alias("lost_chars"))
    )
    truncation = F.array_compact(F.array(part(3, "user", PROMPT_USER), part(2, "assistant", PROMPT_REPLY)))
    covered = F.when(missing.isNotNull(), F.size(missing) == 0)
    return out.select(
        F.concat_ws("#", F.col("conv_id").cast("string"), F.lit("R2"), F.col("turn").cast("string")).alias("sample_id"),
        "conv_id",
        "turn",
        "rendered",
        covered.alias("covered"),
        missing.alias("missing"),
        truncation.alias("history_truncation"),
        ((F.size(truncation) == 0) & F.coalesce(covered, F.lit(True))).alias("lossless"),
    )


def with_depends(messages: DataFrame, depends: DataFrame) -> DataFrame:
    """Samples whose context holds the exchange before and all messages that the turn depends on, in order, but the question."""
    base = samples(messages).drop("context")
    before = base.select("conv_id", "turn", F.explode(F.array(F.col("turn") - 3, F.col("turn") - 2)).alias("at"))
    named = depends.select("conv_id", "turn", F.explode(F.transform("on", lambda x: x.cast("long"))).alias("at"))
    wanted = before.union(named.join(base.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")).where("at <> turn - 1 AND at >= 0").distinct()
    said = messages.select("conv_id", F.col("turn").alias("at"), "role", "text")
    label = F.when(F.col("role") == "user", "User: ").otherwise("AI: ")
    context = wanted.join(said, ["conv_id", "at"]).groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.concat(label, F.coalesce("text", F.lit(""))).alias("l")))), lambda x: x["l"]), "\n").alias("context"))
    return base.join(context, ["conv_id", "turn"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def mask_is_right(mask: Column, start: Column, end: Column, length: Column) -> Column:
    """An independent check of a target mask: its length, its sum, and where its ones begin and end."""
    ones = mask_sum(mask)
    first, last = F.array_position(mask, F.lit(1)), F.size(mask) - F.array_position(F.reverse(mask), F.lit(1)) + 1
    most = F.greatest(F.least(end, length) - F.greatest(start, F.lit(1)), F.lit(0))
    here = F.when(most == 0, ones == 0).otherwise((first == F.greatest(start, F.lit(1))) & (last == F.least(end, length) - 1))
    return (F.size(mask) == F.greatest(length - 1, F.lit(0))) & (ones == most) & here
