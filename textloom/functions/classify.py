"""Ordered classifiers over short texts: the first group that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T

# Keyword groups of the classifiers; all but the first block are matched in folded text.
GOODBYES = ("viszlát", "viszontlátásra", "jó éjszakát", "pá")
GREETINGS = ("szia", "helló", "hello", "jó napot", "üdv", "üdvözöllek")
NUMERALS = {"egy": 1, "két": 2, "kettő": 2, "három": 3, "négy": 4, "öt": 5, "hat": 6, "hét": 7, "nyolc": 8, "kilenc": 9, "tíz": 10}
BACK_REFERENCES = (
    ("amit", "mondtam"),
    ("amit", "irtam"),
    ("folytasd",),
    ("folytassuk",),
    ("elozo",),
    ("korabban", "mondtam"),
    ("mint", "az", "elobb"),
    ("visszaterve",),
)
CONTEXT_REFERENCES = (
    ("folytasd",),
    ("folytassuk",),
    ("az", "elozo"),
    ("ezt", "javitsd"),
    ("javitsd", "ki"),
    ("amit", "mondtam"),
    ("amit", "irtam"),
    ("akkor", "masik"),
    ("korabban", "mondtam"),
    ("mint", "az", "elobb"),
)
DEICTIC_WORDS = "az ez azt ezt arrol errol azzal ezzel annak ennek".split()
GUARD_CATEGORIES = {
    "identity": ["ki vagy", "mi vagy", "kicsoda vagy", "bemutatkoz"],
    "age": ["hany eves", "mennyi idos", "eletkorod", "hany eve letezel", "mikor szulettel", "milyen regi vagy", "miota letezel", "oreg vagy"],
    "memory": ["emlekszel", "emlekezeted", "van memoriad", "elmentetted", "meg tudod jegyezni", "hosszu tavu memoria"],
    "preference": ["kedvenc film", "kedvenc mozid", "szoktal filmet nezni", "milyen filmeket szeretsz", "film amit imadsz", "szereted a filmeket", "mit szoktal nezni"],
    "capability": ["tudsz verset", "irnal nekem egy verset", "megy a verseles", "kolto is vagy", "tudsz rimelni", "irj egy rovid verset", "erzeked a kolteszethez", "irni egy verset", "szoktal verset irni"],
    "explanation": [
        "miert valaszolsz", "miert furcsak", "miert van hogy furan", "felreertelek", "fura dolgokat mondasz", "miert hibazol", "nem mindig erthetoek",
        "csuszik el neha", "kulonbseg kozted", "miben kulonbozol", "olyan vagy mint a chatgpt", "mennyivel vagy gyengebb", "miert nem vagy olyan okos",
        "mi kulonboztet meg", "hasonlitasz egy nagy ai", "miben mas vagy",
    ],
    "smalltalk": ["hogy vagy", "hogy s mint", "hogy erzed magad", "mizu", "mi ujsag", "mi a helyzet", "hogy telik a napod", "jol vagy", "minden rendben van veled", "mi van veled mostanaban", "erdekes ujdonsag", "mesel valami erdekes"],
}
TOPIC_KEYWORDS = {
    "identity": ["ai vagyok", "program vagyok", "gép vagyok"],
    "age": ["életkor", "program vagyok", "nincs"],
    "memory": ["emlék", "memór"],
    "preference": ["film", "nem néztem", "nincs kedvenc"],
    "capability": ["verset", "tanulom", "nem tudok"],
    "explanation": ["tanuló modell", "furán", "karakterenként", "hibázik", "kicsi", "különbség", "nagy"],
    "smalltalk": ["programnak", "hangulat", "készen áll", "újdonság", "élek", "beszélgetünk"],
}
IDENTITY_SIGNATURE = ("nulláról tanított", "saját, nulláról")
RESPONSE_TYPES = {
    "step_by_step": ["lepesekben", "lepesrol lepesre", "lepesenkent", "hogyan csinaljam", "mi a menete", "milyen lepesek", "lepeseket"],
    "list": ["sorolj fel", "listazd", "milyen fajtai vannak", "adj egy listat", "sorold fel", "milyen tipusai vannak"],
    "summary": ["foglald ossze", "foglaljad ossze", "roviden osszefoglalva", "egy mondatban", "tomoren", "dedd meg tomoren"],
    "code_help": ["kodot", "kod hiba", "programozz", "fuggvenyt", "szintaxis", "debug", "programkod", "kodban"],
    "decision_help": ["melyiket valasszam", "mit javasolsz", "segits dontani", "erdemes e", "melyik jobb", "melyiket ajanlod"],
    "explanation": ["magyarazd el", "miert van az hogy", "mi az oka", "hogyan mukodik", "fejtsd ki", "mit jelent", "magyarazatot"],
}
CASUAL_HINTS = ["hogy vagy", "mizu", "szia", "mi ujsag", "hogy s mint", "helyes", "koszonom", "hali"]
TARGET_LENGTHS = {"short_answer": "short", "explanation": "long", "step_by_step": "medium", "list": "medium", "summary": "short", "code_help": "medium", "decision_help": "medium", "casual_chat": "short"}
MEMORY_CANDIDATES = {
    "user_preference": ["szeretem", "nem szeretem", "utalom", "kedvelem", "a kedvencem", "imadom"],
    "current_goal": ["a celom", "azon dolgozom", "szeretnek elerni", "kovetkezo lepesem"],
    "correction": ["helyesbitek", "nem ugy van", "tevedtel", "javitsd ki", "nem ezt mondtam"],
    "project_fact": ["ez a projekt", "ez a rendszer", "ebben a repoban", "ez a kodbazis"],
    "user_fact": ["a nevem", "abban dolgozom", "abban lakom", "en egy", "foglalkozasom"],
}
SAVE_TRIGGERS = (r"jegyezd\s+meg", r"jegyezd\s+fel", r"ne\s+felejtsd\s+el", r"eml[ée]kezz\s+r[áa]", r"fontos\s+hogy\s+tudd")
SEARCH_TRIGGERS = (
    r"keress\s+r[aá]", r"keress\s+ut[aá]na", r"n[eé]zz\s+ut[aá]na", r"n[eé]zzel?\s+ut[aá]na", r"googlezd\s+meg", r"googlizd\s+meg", r"keresd\s+meg", r"kutass\s+ut[aá]na", r"j[aá]rj\s+ut[aá]na",
)


def first_group(folded: Column, groups: dict[str, list[str]]) -> Column:
    """Name of the first group of which a phrase occurs; null if none."""
    return F.coalesce(*[F.when(T.contains_any(folded, phrases), F.lit(name)) for name, phrases in groups.items()])


def requested_sentences(c: Column) -> Column:
    """Number of sentences that a message asks for, 1 to 10; null if it doesn't."""
    named = "|".join(NUMERALS)
    token = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])([0-9]+|{named})\s*mondat", 1))
    word = F.coalesce(*[F.when(token == w, F.lit(n)) for w, n in NUMERALS.items()])
    digits = F.regexp_replace(token, "^0+(?=[0-9])", "")
    # a number of three digits or more is over the limit anyway
    number = F.when(digits.rlike("^[0-9]+$"), F.when(F.length(digits) > 2, 10).otherwise(digits.try_cast("int")))
    asked = F.coalesce(word, number)
    return F.when(asked.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), asked)))


def intent(c: Column) -> Column:
    s = T.strip(F.coalesce(c, F.lit("")))
    w = T.words(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_\s]", " "))
    joined, few = F.array_join(w, " "), F.size(w) <= 2
    return (
        F.when(s == "", "general_chat")
        .when(s.startswith("/"), "command")
        .when(F.regexp_like(s, F.lit(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])([0-9]+|{'|'.join(NUMERALS)})\s*mondat")), "sentence_request")
        .when(few & T.contains_any(joined, GOODBYES), "goodbye")
        .when(few & T.contains_any(joined, GREETINGS), "greeting")
        .otherwise("general_chat")
    )


def follow_up(c: Column, groups: tuple[tuple[str, ...], ...] = BACK_REFERENCES, max_words: int = 5) -> Column:
    """Why a message refers back: explicit_backreference, short_deictic_followup, or null."""
    f = T.fold(c)
    w = T.words(F.regexp_replace(f, r"[^\p{L}\p{N}_\s]", " "))
    explicit = F.lit(False)
    for g in groups:
        explicit |= T.contains_all(f, g)
    short = F.size(w).between(1, max_words) & F.exists(w, lambda x: x.isin(*DEICTIC_WORDS))
    return F.when(explicit, "explicit_backreference").when(short, "short_deictic_followup")


def response_type(c: Column) -> Column:
    """Kind of answer that a message asks for; its folded and plain forms are made once for all phrases."""

    def of(f: Column) -> Column:
        plain = T.strip(F.regexp_replace(F.regexp_replace(f, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
        kind = lambda p: F.coalesce(
            first_group(p, RESPONSE_TYPES),
            F.when(T.contains_any(p, CASUAL_HINTS), "casual_chat"),
            F.when(F.size(T.words(p)) <= 4, "short_answer").otherwise("casual_chat"),
        )
        return F.when(f == "", "casual_chat").otherwise(T.once(plain, kind))

    return T.once(T.fold(c), of)


def response_plan(kind: Column) -> Column:
    """Target length and wanted form of a response type."""
    length = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in TARGET_LENGTHS.items()])
    return F.struct(
        length.alias("target_length"), (kind == "step_by_step").alias("wants_steps"), (kind == "list").alias("wants_list"), (kind == "summary").alias("wants_summary"), (kind == "casual_chat").alias("wants_casual_tone")
    )


def guard_category(c: Column) -> Column:
    return T.once(T.fold(c), lambda f: first_group(f, GUARD_CATEGORIES))


def on_topic(category: Column, reply: Column) -> Column:
    low = F.lower(F.coalesce(reply, F.lit("")))
    return F.coalesce(*[F.when(category == k, T.contains_any(low, v)) for k, v in TOPIC_KEYWORDS.items()], F.lit(False))


def identity_bleed(category: Column, reply: Column, signature: tuple[str, ...] = IDENTITY_SIGNATURE) -> Column:
    return ~category.eqNullSafe(F.lit("identity")) & T.contains_any(F.lower(F.coalesce(reply, F.lit(""))), signature)


def failure_reason(topic: Column, bleed: Column, names: Column) -> Column:
    parts = F.array_compact(
        F.array(F.when(bleed, "identity_bleed"), F.when(~topic, "category_mismatch"), F.when(F.size(names) > 0, F.concat(F.lit("structural_flags:"), F.array_join(names, ","))))
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "+"))


def memory_candidate(c: Column) -> Column:
    return T.once(T.fold(c), lambda f: first_group(f, MEMORY_CANDIDATES))


def after_trigger(c: Column, triggers: tuple[str, ...], ending: str) -> Column:
    """What follows the first trigger, cleaned; null without trigger or rest."""
    t = F.coalesce(c, F.lit(""))
    found = []
    for p in triggers:
        rest = F.regexp_extract(t, rf"(?is){p}(.*)$", 1)
        rest = F.regexp_replace(F.regexp_replace(rest, r"(?U)^[\s,:-]+", ""), r"(?iU)^hogy\b[\s,]*", "")
        rest = T.strip(F.regexp_replace(T.strip(rest), f"[{ending}]+$", ""))
        found.append(F.when(rest != "", rest))
    return F.coalesce(*found)


def explicit_save(c: Column) -> Column:
    return after_trigger(c, SAVE_TRIGGERS, ".!")


def search_query(c: Column) -> Column:
    return after_trigger(c, SEARCH_TRIGGERS, ".!?")
