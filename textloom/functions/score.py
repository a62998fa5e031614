"""Rule scorers: a hundred points less a penalty for each rule that fires."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T

MIN_WORDS = 3
MAX_CHARS = 1500
#: Words of an answer are counted up to here: no rule asks for more.
MOST_WORDS = 8

# Penalties of the three scorers.
ROW_PENALTIES = {
    "too_short": 25,
    "too_long": 10,
    "garbled_token": 35,
    "repeated_char_run": 30,
    "english_mixing": 15,
    "overclaiming": 25,
    "no_terminal_punctuation": 5,
    "generic_template": 15,
    "low_instruction_overlap": 10,
}
REPLY_PENALTIES = {
    "empty_or_fallback": 60,
    "leaked_label": 30,
    "duplicate_sentence": 20,
    "too_short": 15,
    "garbled_token": 30,
    "repeated_char_run": 25,
    "sentence_count_mismatch": 25,
    "deterministic_fix_applied": 10,
}
STYLE_PENALTIES = {
    "had_duplicate_sentences": 15,
    "too_short_after_styling": 20,
    "missing_end_punctuation": 10,
    "excessive_repeated_punctuation": 5,
}

# Word and phrase lists of the rules.
ENGLISH_WORDS = "the are was were and you what how this that with have will would should please thanks hello yes".split()
TECHNICAL_WORDS = (
    "python html css json jsonl api function class import javascript js http https url id app flask git github markdown csv log ai llm"
).split()
OVERCLAIMS = (
    "olyan okos, mint a chatgpt",
    "emberi szintű intelligencia",
    "tökéletesen ért mindent",
    "mindent tudok",
    "sosem tévedek",
    "jobb vagyok, mint bármelyik ai",
    "öntudatra ébredtem",
    "valódi érzéseim vannak",
    "élő lény vagyok",
)
GENERIC_PHRASES = ("erről egyelőre nem tudok ennél pontosabb választ adni", "erről nem tudok többet mondani")
PERSONAL_PATTERNS = (
    ("email", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"),
    ("phone", r"(^|[^\p{L}\p{N}_])(\+?\p{Nd}{1,3}[\s-]?)?(\p{Nd}{2,4}[\s-]?){3,4}($|[^\p{L}\p{N}_])"),
    ("birth_date", r"(?i)(^|[^\p{L}\p{N}_])\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}([^\p{L}\p{N}_][^\n]{0,19})?(szület|birth)"),
)
DANGER_PATTERNS = (
    ("credential", r"(?i)(^|[^\p{L}\p{N}_])(api[_-]?key|secret[_-]?key|jelszó|password|access[_-]?token)\s*[:=]\s*\S+"),
    ("aws_key", r"(?i)(^|[^\p{L}\p{N}_])AKIA[0-9A-Z]{16}($|[^\p{L}\p{N}_])"),
    ("private_key", r"(?i)-----BEGIN (RSA |EC )?PRIVATE KEY-----"),
)


#: Letters of a run, and those of them that are no vowels. × and ÷ are in the range of the letters.
RUN = "A-Za-zÀ-ÿ"
_VOWELS = "".join(sorted(set(T.VOWELS + T.VOWELS.upper()) - set("őűŐŰ")))
GARBLED = f"(?<![{RUN}])[{RUN}&&[^{_VOWELS}]]{{5,}}(?![{RUN}])"


def garbled(c: Column) -> Column:
    """A run of five letters or more without a vowel (ő and ű part runs)."""
    return c.rlike(GARBLED)


def repeated_run(c: Column) -> Column:
    """One character four times in a row."""
    return c.rlike(r"(?d)(.)\1{3,}")


#: A listed word that is no technical term, between other characters than letters. The Kelvin sign is a k in lower case.
ENGLISH = r"(?i)(?<!\p{L})(" + "|".join(w for w in ENGLISH_WORDS if w not in TECHNICAL_WORDS).replace("k", "[k\u212a]") + r")(?!\p{L})"


def english(c: Column) -> Column:
    """Whether a word is on the English list and no technical term."""
    return c.rlike(ENGLISH)


def english_word(c: Column) -> Column:
    """The first such word in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(c, ENGLISH, 0)), F.lit(""))


def overclaims(c: Column) -> Column:
    return T.once(F.lower(c), lambda low: T.contains_any(low, OVERCLAIMS))


_INNER = r"\p{L}\p{N}_"
# What is asked before a pattern, in less time: what no match lacks (in small letters), then a form that holds wherever the
# pattern does. What stands before a match is looked at behind its first letter, and ends of any length are one letter.
QUICK = {
    "email": (("@",), rf"[{_INNER}.+-]@[{_INNER}-]+\.[{_INNER}.-]"),
    "phone": ((), rf"(?=[+\p{{Nd}}])(?<![{_INNER}])(\+?\p{{Nd}}{{1,3}}[\s-]?)?(\p{{Nd}}{{2,4}}[\s-]?){{3,4}}(?![{_INNER}])"),
    "birth_date": (("szület", "birth"), rf"(?i)(?=\p{{Nd}})(?<![{_INNER}])\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}([^{_INNER}][^\n]{{0,19}})?(szület|birth)"),
    "credential": (("key", "jelsz", "password", "token"), rf"(?i)(?=[asjp])(?<![{_INNER}])(api[_-]?key|secret[_-]?key|jelszó|password|access[_-]?token)\s*[:=]\s*\S"),
    "aws_key": (("akia",), rf"(?i)(?=a)(?<![{_INNER}])AKIA[0-9A-Z]{{16}}(?![{_INNER}])"),
    "private_key": (("-----begin",), DANGER_PATTERNS[2][1]),
}


def held(c: Column, label: str, pattern: str) -> Column:
    """Whether a text holds a pattern; only texts that pass its ``QUICK`` form, if it has one, are searched for it."""
    if label not in QUICK or (label, pattern) not in PERSONAL_PATTERNS + DANGER_PATTERNS:
        return c.rlike(pattern)
    needed, quick = QUICK[label]
    found = c.rlike(quick) & c.rlike(pattern)
    return T.contains_any(F.lower(c), needed) & found if needed else found


def first_label(c: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Label of the first pattern that a text holds; null if none."""
    return F.coalesce(*[F.when(held(c, label, p), F.lit(label)) for label, p in patterns])


def penalised(names: Column, penalties: dict[str, int]) -> Column:
    lost = reduce(lambda a, b: a + b, [F.when(F.array_contains(names, k), v).otherwise(0) for k, v in penalties.items()])
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost))


#: What the rules of rows and the scorer of rows both ask of an answer.
MEASURES = ("answer", "n_words", "too_long", "garbled", "repeated", "english", "overclaims")


def measures(output: Column) -> dict[str, Column]:
    """The measures of an answer by name; as columns of one projection they are evaluated once for all rules on them."""
    o = T.strip(F.coalesce(output, F.lit("")))
    found = (o, T.few_words(o, MOST_WORDS), F.length(o) > MAX_CHARS, garbled(o), repeated_run(o), english(o), overclaims(o))
    return dict(zip(MEASURES, found, strict=True))


def row_flags(output: Column, instruction: Column | None = None, known: dict[str, Column] | None = None) -> Column:
    """Flags of an answer; an empty answer has that flag alone. ``known`` are its measures where they are columns already."""
    m = known or measures(output)
    o, n = m["answer"], m["n_words"]
    rules = [
        ("too_short", n < MIN_WORDS),
        ("too_long", m["too_long"]),
        ("garbled_token", m["garbled"]),
        ("repeated_char_run", m["repeated"]),
        ("english_mixing", m["english"]),
        ("overclaiming", m["overclaims"]),
        ("no_terminal_punctuation", ~o.rlike(r"[.!?…]$")),
        ("generic_template", T.contains_any(F.lower(o), GENERIC_PHRASES)),
    ]
    if instruction is not None:
        i = T.strip(F.coalesce(instruction, F.lit("")))
        bag = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-záéíóöőúüű0-9]+"), F.lit(0))
        rules.append(("low_instruction_overlap", (i != "") & n.between(MIN_WORDS, 6) & ~F.arrays_overlap(F.concat(bag(i), F.array(F.lit(" "))), bag(o))))
    return F.when(o == "", F.array(F.lit("empty_output"))).otherwise(T.flags(rules))


def row_score(names: Column) -> Column:
    return F.when(F.array_contains(names, "empty_output"), 0).otherwise(penalised(names, ROW_PENALTIES))


def repeats_sentence(c: Column) -> Column:
    s = F.transform(T.sentences(c), F.lower)
    return (F.size(s) > 1) & (F.size(s) != F.size(F.array_distinct(s)))


def reply_flags(reply: Column, requested: Column | None = None, actual: Column | None = None, fixed: Column | None = None) -> Column:
    """Flags of a chat reply; the counts matter for replies to requests of a number of sentences."""
    r = F.coalesce(reply, F.lit(""))
    s = T.strip(r)
    n = F.size(T.words(s))
    rules = [
        ("empty_or_fallback", (s == "") | (s == "...")),
        ("leaked_label", r.contains("\nUser:") | r.contains("\nAI:") | s.startswith("User:") | s.startswith("AI:")),
        ("duplicate_sentence", repeats_sentence(r)),
        ("too_short", (n > 0) & (n < MIN_WORDS)),
        ("garbled_token", garbled(s)),
        ("repeated_char_run", repeated_run(s)),
    ]
    if requested is not None:
        rules += [("sentence_count_mismatch", F.coalesce(requested != actual, F.lit(False))), ("deterministic_fix_applied", F.coalesce(fixed, F.lit(False)))]
    return T.flags(rules)


def style_flags(original: Column, styled: Column, min_words: int = 4) -> Column:
    o = F.coalesce(original, F.lit(""))
    s = T.strip(o)
    return T.flags(
        [
            ("had_duplicate_sentences", repeats_sentence(o)),
            ("too_short_after_styling", F.size(T.words(F.coalesce(styled, F.lit("")))) < min_words),
            ("missing_end_punctuation", (s != "") & ~s.rlike(r"[.!?…]$")),
            ("excessive_repeated_punctuation", o.rlike(r"([!?])\1+")),
        ]
    )
