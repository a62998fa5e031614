"""DuckDB expressions that mean the same as the column functions."""

from __future__ import annotations

from textloom.functions import score as S
from textloom.functions import text as T

WS = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return ", ".join(map(lit, items))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"


def fold(x: str) -> str:
    return strip(f"regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[{WS}]+', ' ', 'g')")


def trim_to(x: str, n: int) -> str:
    s = strip(f"coalesce({x}, '')")
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE regexp_replace(substr({s}, 1, {n - 3}), '[{WS}]+$', '') || '...' END"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '[^.!?]*[.!?]'), lambda s: {strip('s')}), lambda s: s <> '')"


def normalise(x: str) -> str:
    # list marks need a look-behind; runs of them are taken one after another
    t = f"replace(translate(nfc_normalize(coalesce({x}, '')), '„”“‘’–—', '\"\"\"''''--'), '…', '...')"
    for _ in range(2):
        t = f"regexp_replace({t}, '(^|[{WS}])(?:[0-9]{{1,2}}[.)]|[-•*])([{WS}]+[^{WS}])', '\\1 \\2', 'g')"
    return strip(f"regexp_replace(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}{WS}]', ' ', 'g'), '[{WS}]+', ' ', 'g')")


def any_of(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in phrases) + ")"


def all_of(x: str, phrases) -> str:
    return "(" + " AND ".join(f"contains({x}, {lit(p)})" for p in phrases) + ")"


def match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def flags(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {lit(name)} END" for name, cond in pairs) + "], lambda x: x IS NOT NULL)"


def garbled(x: str) -> str:
    return f"len(list_filter(regexp_extract_all({x}, '[A-Za-zÀ-ÿ]+'), lambda w: length(w) >= 5 AND NOT regexp_matches(lower(w), '[{T.VOWELS}]'))) > 0"


def repeated_run(x: str) -> str:
    c = f"string_split({x}, '')"
    return f"len(list_filter(list_zip({c}, {c}[2:], {c}[3:], {c}[4:]), lambda z: z[1] = z[2] AND z[2] = z[3] AND z[3] = z[4] AND z[1] <> chr(10))) > 0"


def english(x: str) -> str:
    known = listed(w for w in S.ENGLISH_WORDS if w not in S.TECHNICAL_WORDS)
    return f"len(list_intersect(list_distinct(list_transform(regexp_extract_all({x}, '\\p{{L}}+'), lambda w: lower(w))), [{known}])) > 0"


def personal(x: str) -> str:
    return "(" + " OR ".join(match(x, p) for _, p in S.PERSONAL_PATTERNS) + ")"


def dangerous(x: str) -> str:
    return "(" + " OR ".join(match(x, p) for _, p in S.DANGER_PATTERNS) + ")"


def penalised(names: str, penalties: dict[str, int]) -> str:
    lost = " + ".join(f"CASE WHEN list_contains({names}, {lit(k)}) THEN {v} ELSE 0 END" for k, v in penalties.items())
    return f"CAST(greatest(0, least(100, 100 - ({lost}))) AS INTEGER)"


def content_flags(raw: str, o: str) -> list[tuple[str, str]]:
    has = f"{o} <> ''"
    return [
        ("output_too_short", f"{has} AND len({words(o)}) < {S.MIN_WORDS}"),
        ("output_too_long", f"{has} AND length({o}) > {S.MAX_CHARS}"),
        ("repeated_char_run", f"{has} AND {repeated_run(o)}"),
        ("garbled_output", f"{has} AND {garbled(o)}"),
        ("english_mixing", f"{has} AND {english(o)}"),
        ("overclaiming", f"{has} AND {any_of(f'lower({o})', S.OVERCLAIMS)}"),
        ("personal_data_suspected", personal(raw)),
        ("dangerous_content_suspected", dangerous(raw)),
    ]


def row_flags(o: str) -> str:
    low = f"lower({o})"
    rules = [
        ("too_short", f"len({words(o)}) < {S.MIN_WORDS}"),
        ("too_long", f"length({o}) > {S.MAX_CHARS}"),
        ("garbled_token", garbled(o)),
        ("repeated_char_run", repeated_run(o)),
        ("english_mixing", english(o)),
        ("overclaiming", any_of(low, S.OVERCLAIMS)),
        ("no_terminal_punctuation", f"NOT regexp_matches({o}, '[.!?…]$')"),
        ("generic_template", any_of(low, S.GENERIC_PHRASES)),
    ]
    return f"CASE WHEN {o} = '' THEN ['empty_output'] ELSE {flags(rules)} END"


def reply_flags(r: str) -> str:
    s, low = strip(r), f"list_transform({sentences(r)}, lambda x: lower(x))"
    return flags(
        [
            ("empty_or_fallback", f"{s} = '' OR {s} = '...'"),
            ("leaked_label", f"contains({r}, chr(10) || 'User:') OR contains({r}, chr(10) || 'AI:') OR starts_with({s}, 'User:') OR starts_with({s}, 'AI:')"),
            ("duplicate_sentence", f"len({low}) > 1 AND len({low}) <> len(list_distinct({low}))"),
            ("too_short", f"len({words(s)}) > 0 AND len({words(s)}) < {S.MIN_WORDS}"),
            ("garbled_token", garbled(s)),
            ("repeated_char_run", repeated_run(s)),
        ]
    )


def first_group(x: str, groups: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, phrases)} THEN {lit(name)}" for name, phrases in groups.items()) + " END"
