"""English stems and stop words as Column expressions, after the published Porter2 (Snowball English) rules.

Words are lower-case letters and digits.  A word's regions are kept as places: ``r1`` and ``r2`` are where they start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulspark.functions.shapes import let

# Words and endings of the published rules, and the usual English stop words of full text search.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same "
    "so than too very s t can will just don should now"
).split()
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = "inning outing canning herring earring proceed exceed succeed".split()
STEP2 = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT_END = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


def _ends(w: Column, suffix: str) -> Column:
    return w.endswith(suffix)


def _without(w: Column, n: int, more: str = "") -> Column:
    left = F.substring(w, F.lit(1), F.char_length(w) - n)
    return F.concat(left, F.lit(more)) if more else left


def _in(w: Column, suffix: str, region: Column) -> Column:
    """Whether an ending lies within a region."""
    return F.char_length(w) - len(suffix) >= region


def _regions(w: Column) -> tuple[Column, Column]:
    """Where the regions start: behind the first other letter after a vowel, and the same again from there."""
    head = F.regexp_extract(w, "^(gener|commun|arsen)", 1)
    first = F.when(F.char_length(head) > 0, F.char_length(head)).otherwise(F.coalesce(F.nullif(F.char_length(F.regexp_extract(w, f"^.*?{VOWEL}{OTHER}", 0)), F.lit(0)), F.char_length(w)))
    return first, F.lit(0)


def _second(w: Column, r1: Column) -> Column:
    rest = F.substring(w, r1 + 1, F.char_length(w))
    return F.coalesce(r1 + F.nullif(F.char_length(F.regexp_extract(rest, f"^.*?{VOWEL}{OTHER}", 0)), F.lit(0)), F.char_length(w))


def _replace(w: Column, table: dict[str, str], region: Column, more: Callable[[Column], Column] | None = None) -> Column:
    """The longest ending of the table replaced, if it lies within the region."""
    out = None
    for suffix in sorted(table, key=len, reverse=True):
        new = F.when(_in(w, suffix, region), _without(w, len(suffix), table[suffix])).otherwise(w)
        out = F.when(_ends(w, suffix), new) if out is None else out.when(_ends(w, suffix), new)
    return out.otherwise(more(w) if more else w)


def _step1a(w: Column) -> Column:
    short = F.char_length(w) > 4
    return (
        F.when(_ends(w, "sses"), _without(w, 2)).when(_ends(w, "ied") | _ends(w, "ies"), F.when(short, _without(w, 2)).otherwise(_without(w, 1))).when(_ends(w, "us") | _ends(w, "ss"), w)
        .when(w.rlike(f"{VOWEL}.+s$"), _without(w, 1)).otherwise(w)
    )


def _step1b(w: Column, r1: Column) -> Column:
    def mended(left: Column) -> Column:
        small = left.rlike(SHORT_END) & (F.char_length(left) <= r1)
        return F.when(left.rlike("(at|bl|iz)$"), F.concat(left, F.lit("e"))).when(left.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(left, 1)).when(small, F.concat(left, F.lit("e"))).otherwise(left)

    ee = lambda n, s: F.when(_in(w, s, r1), _without(w, n)).otherwise(w)
    end = F.regexp_extract(w, "(ingly|edly|ing|ed)$", 1)
    left = F.substring(w, F.lit(1), F.char_length(w) - F.char_length(end))
    return F.when(_ends(w, "eedly"), ee(3, "eedly")).when(_ends(w, "eed"), ee(1, "eed")).when((F.char_length(end) > 0) & left.rlike(VOWEL), let(left, mended)).otherwise(w)


def _step5(w: Column, r1: Column, r2: Column) -> Column:
    n = F.char_length(w)
    return F.when(_ends(w, "e") & ((n > r2) | (n > r1) & ~_without(w, 1).rlike(SHORT_END)), _without(w, 1)).when(_ends(w, "ll") & (n > r2), _without(w, 1)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters stay."""

    def body(w: Column) -> Column:
        return let(_regions(w)[0], lambda r1: let(_second(w, r1), lambda r2: steps(w, r1, r2)))

    def steps(w: Column, r1: Column, r2: Column) -> Column:
        li = lambda v: F.when(v.rlike("[cdeghkmnrt]li$") & _in(v, "li", r1), _without(v, 2)).when(_ends(v, "logi") & _in(v, "ogi", r1), _without(v, 1)).otherwise(v)
        ative = lambda v: F.when(_ends(v, "ative") & _in(v, "ative", r2), _without(v, 5)).otherwise(v)
        ion = lambda v: F.when(v.rlike("[st]ion$") & _in(v, "ion", r2), _without(v, 3)).otherwise(v)
        rest = lambda v: let(_step1b(v, r1), lambda b: let(F.when(b.rlike("^.+[^aeiouy][yY]$"), _without(b, 1, "i")).otherwise(b), lambda c: let(_replace(c, STEP2, r1, li), lambda d: let(
            _replace(d, STEP3, r1, ative), lambda e: let(_replace(e, dict.fromkeys(STEP4, ""), r2, ion), lambda f: _step5(f, r1, r2))))))
        return let(_step1a(w), lambda a: F.when(a.isin(KEPT), a).otherwise(rest(a)))

    def chosen(w: Column) -> Column:
        special = F.when(F.char_length(w) <= 2, w)
        for k, v in WHOLE.items():
            special = special.when(w == k, F.lit(v))
        marked = F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y")
        return special.otherwise(F.lower(let(marked, body)))

    return let(word, chosen)


def stems(text: Column) -> Column:
    """(stem, pos) of the words of a text that are no stop words; words are numbered from 1, stop words too."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("pos")))
    return F.transform(F.filter(numbered, lambda x: ~x["w"].isin(STOP)), lambda x: F.struct(stem(x["w"]).alias("stem"), x["pos"].alias("pos")))
