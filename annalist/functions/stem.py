"""English stems of words (the published Porter2 rules) as native expressions.

A step of the rules reads its word several times, so each binds what it reads: the expression grows with the number of steps, not with its power.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words with stems of their own, words that stay as they are, and those that stay once a plural is cut
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
INVARIANT = "sky news howe atlas cosmos bias andes".split()
INVARIANT_SINGULARS = "inning outing canning herring earring proceed exceed succeed".split()
# fixed values: suffixes of the second to the fourth step and what replaces them
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = r"^([^aeiouy]*[aeiouy]+[^aeiouy])"
_FIRST_REGION = r"^(gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy])"
_SHORT_SYLLABLE = r"([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _step(word: Column, suffixes: list[str], change: Callable[[Column, Column, Column], Column]) -> Column:
    """A word after a step: `change` of the word, the longest of the suffixes that it ends with, and what is before that; as it is where it ends with none."""
    pattern = f"({'|'.join(suffixes)})$"

    def changed(w: Column) -> Column:
        return _let(F.regexp_extract(w, pattern, 1), lambda cut: F.when(cut == "", w).otherwise(_let(F.left(w, F.length(w) - F.length(cut)), lambda base: change(w, cut, base))))

    return _let(word, changed)


def _put(base: Column, cut: Column, rules: dict[str, str]) -> Column:
    return F.concat(base, F.element_at(F.create_map(*(F.lit(x) for rule in rules.items() for x in rule)), cut))


def _mended(base: Column, r1: Column) -> Column:
    """What a cut past or progressive form leaves, as a word again."""
    return (
        F.when(base.rlike("(at|bl|iz)$"), F.concat(base, F.lit("e")))
        .when(base.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.left(base, F.length(base) - 1))
        .when((r1 >= F.length(base)) & base.rlike(_SHORT_SYLLABLE), F.concat(base, F.lit("e")))
        .otherwise(base)
    )


def _regular(word: Column, r1: Column, r2: Column) -> Column:
    """All steps; r1 and r2 are where the two regions begin in which suffixes are cut."""

    def plural(w: Column, cut: Column, base: Column) -> Column:
        return (
            F.when(cut == "sses", F.concat(base, F.lit("ss")))
            .when(cut.isin("ied", "ies"), F.concat(base, F.when(F.length(w) > 4, F.lit("i")).otherwise(F.lit("ie"))))
            .when((cut == "s") & w.rlike("[aeiouy].+s$"), base)
            .otherwise(w)
        )

    def past(w: Column, cut: Column, base: Column) -> Column:
        present = F.when(F.length(base) >= r1, F.concat(base, F.lit("ee"))).otherwise(w)
        return F.when(cut.isin("eed", "eedly"), present).when(base.rlike("[aeiouy]"), _mended(base, r1)).otherwise(w)

    def second(w: Column, cut: Column, base: Column) -> Column:
        stays = (F.length(base) < r1) | ((cut == "ogi") & ~base.endswith("l")) | ((cut == "li") & ~base.rlike("[cdeghkmnrt]$"))
        return F.when(stays, w).otherwise(_put(base, cut, STEP_2))

    def third(w: Column, cut: Column, base: Column) -> Column:
        return F.when((F.length(base) < r1) | ((cut == "ative") & (F.length(base) < r2)), w).otherwise(_put(base, cut, STEP_3))

    def fourth(w: Column, cut: Column, base: Column) -> Column:
        return F.when((F.length(base) < r2) | ((cut == "ion") & ~base.rlike("[st]$")), w).otherwise(base)

    def last(w: Column, cut: Column, base: Column) -> Column:
        e = (cut == "e") & ((F.length(base) >= r2) | ((F.length(base) >= r1) & ~base.rlike(_SHORT_SYLLABLE)))
        return F.when(e | ((cut == "l") & (F.length(base) >= r2) & base.endswith("l")), base).otherwise(w)

    def after_plural(w: Column) -> Column:
        x = F.regexp_replace(_step(w, ["eedly", "eed", "edly", "ed", "ingly", "ing"], past), "^(.+[^aeiouy])[yY]$", "$1i")
        for suffixes, change in ((list(STEP_2), second), (list(STEP_3), third), (STEP_4, fourth), (["e", "l"], last)):
            x = _step(x, suffixes, change)
        return F.when(w.isin(INVARIANT_SINGULARS), w).otherwise(F.lower(x))

    return _let(_step(word, ["sses", "ied", "ies", "us", "ss", "s"], plural), after_plural)


def stem(word: Column) -> Column:
    """The stem of a lower-case word. Words of up to two letters, with other signs than a to z, or null stay as they are."""

    def of(w: Column) -> Column:
        irregular = F.element_at(F.create_map(*(F.lit(x) for rule in IRREGULAR.items() for x in rule)), w)
        # a consonant y is written Y until the end
        marked = F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y")
        regular = _let(marked, lambda m: _let(_begin(m, F.lit(0), _FIRST_REGION), lambda r1: _let(_begin(m, r1, _REGION), lambda r2: _regular(m, r1, r2))))
        return F.when(~w.rlike("^[a-z]{3,}$") | w.isin(INVARIANT), w).when(w.isin(list(IRREGULAR)), irregular).otherwise(regular)

    return _let(word, of)


def _begin(word: Column, start: Column, region: str) -> Column:
    """Where a region begins that is sought from `start`; the word's length if there is none."""
    return _let(F.length(F.regexp_extract(F.substr(word, start + 1), region, 1)), lambda n: F.when(n == 0, F.length(word)).otherwise(start + n))


def stemmed(rows: DataFrame, column: str, out: str = "stem") -> DataFrame:
    """`rows` with the stem of each word in `column`."""
    return rows.withColumn(out, stem(F.col(column)))
