"""Text analysis for search: word boundaries, accent folding, Porter stems.

Words, folds and stems are built-in expressions.  Where all words of all mails are stemmed, expressions cost more than all else, as
each occurrence is worked out anew; :func:`term_of` is the same stem of one word, for workers that remember the words they have met.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions.text import let

MAX_TOKEN_CHARS = 255

# Words after the Unicode word-boundary rules: letters, digits, marks and low lines; a full stop, apostrophe,
# colon or middle dot joins two letters, a full stop, comma, semicolon or apostrophe joins two digits.
# Ideographs and hiragana stand alone.
_SINGLE = r"[\p{IsHan}\p{IsHiragana}]"
_WORD = r"[\p{L}\p{N}\p{M}_&&[^\p{IsHan}\p{IsHiragana}]]"
_JOINT = r"(?:(?<=\p{L}|\p{M})[.:·'’‘․](?=\p{L})|(?<=\p{N})[.,;'’‘․](?=\p{N}))"
# Tests of script and category are dear: plain letters are met first, other ASCII never gets to them, and what is behind a joint
# is looked at only where there is one.
_RUN = rf"(?:[A-Za-z0-9_]++|(?![\x00-\x7f]){_WORD})++"
_JOINED = rf"(?=[.:·,;'’‘․]){_JOINT}{_RUN}"
TOKEN = rf"{_RUN}(?:{_JOINED})*+|(?![\x00-\x7f]){_SINGLE}\p{{M}}*"

# Letters whose plain form is not their decomposition (fixed values of the folding table).
_SPECIAL = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D",
    "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T",
    "ŋ": "n", "Ŋ": "N", "ĸ": "q", "ŀ": "l", "Ŀ": "L", "’": "'", "‘": "'",
}


def _folding_table() -> tuple[str, str]:
    """One-to-one folds of the Latin blocks, from canonical decomposition."""
    source, target = [], []
    for low, high in ((0xC0, 0x24F), (0x1E00, 0x1EFF)):
        for code in range(low, high + 1):
            letter = chr(code)
            base = unicodedata.normalize("NFKD", letter)[0]
            if letter not in _SPECIAL and base.isascii() and base.isalpha():
                source.append(letter)
                target.append(base)
    for letter, plain in _SPECIAL.items():
        if len(plain) == 1:
            source.append(letter)
            target.append(plain)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _folding_table()


def fold(value: Column) -> Column:
    """Latin letters without their accents; pure ASCII values are passed through untouched."""
    folded = F.regexp_replace(F.translate(value, FOLD_FROM, FOLD_TO), r"(?<=[A-Za-z])\p{Mn}+", "")
    for letter, plain in _SPECIAL.items():
        if len(plain) > 1:
            folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.when(F.octet_length(value) > F.char_length(value), folded).otherwise(value)


def surface_tokens(text: Column) -> Column:
    """Words as written; a word over 255 characters is cut into pieces of that length."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def cut(words: Column) -> Column:
        pieces = F.flatten(F.transform(words, lambda t: F.transform(
            F.sequence(F.lit(1), F.length(t), F.lit(MAX_TOKEN_CHARS)),
            lambda at: F.substring(t, at, F.lit(MAX_TOKEN_CHARS)))))
        return F.when(F.exists(words, lambda t: F.length(t) > MAX_TOKEN_CHARS), pieces).otherwise(words)

    return let(found, cut)


def tokens(text: Column) -> Column:
    return surface_tokens(F.lower(text))


# ---- Porter stemming (Porter 1980, with the author's later revisions) -------------------------------------
# Inside the steps a consonantal y is written Y, so a vowel is simply one of aeiouy.
_V, _C = "[aeiouy]", "[^aeiouy]"
_M_POSITIVE = f"^{_C}*{_V}+{_C}"
_M_ABOVE_ONE = f"^{_C}*{_V}+{_C}+{_V}+{_C}"
_SHORT_END = f"{_C}{_V}[^aeiouywxY]$"
_SHORT_WORD = f"^{_C}+{_V}[^aeiouywxY]$"

# Suffix rewriting of steps two and three, and suffixes removed in step four.
_STEP_TWO = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
_STEP_THREE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_FOUR = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
)


def _without(word: Column, count) -> Column:
    return F.left(word, F.length(word) - count)


def _ends_in(word: Column, suffixes) -> Column:
    """Cheap first test: do the last two letters belong to any of the suffixes?"""
    return F.substring(word, -2, 2).isin(sorted({suffix[-2:] for suffix in suffixes}))


def _rewrite(word: Column, rules: dict[str, str]) -> Column:
    # Anchored at the end, the leftmost match is the longest suffix.
    table = F.create_map(*[F.lit(x) for rule in rules.items() for x in rule])

    def with_suffix(suffix: Column) -> Column:
        base = _without(word, F.length(suffix))
        return F.when((suffix != "") & base.rlike(_M_POSITIVE), F.concat(base, F.try_element_at(table, suffix))).otherwise(word)

    found = let(F.regexp_extract(word, f"({'|'.join(rules)})$", 1), with_suffix)
    return F.when(_ends_in(word, rules), found).otherwise(word)


def _mark_y(word: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiou])y", "$1Y"), "yy", "yY")
    return F.when(F.contains(word, F.lit("y")), marked).otherwise(word)


def _plural(word: Column) -> Column:
    return F.when(word.endswith("s"), F.regexp_replace(word, "(?:(ss)es|(i)es|([^s])s)$", "$1$2$3")).otherwise(word)


def _past(word: Column) -> Column:
    """Past and progressive forms; what remains may get an e back or lose a doubled consonant."""
    def repaired(rest: Column) -> Column:
        last_two = F.lower(F.right(rest, F.lit(2)))
        doubled = (F.length(rest) > 1) & (F.left(last_two, F.lit(1)) == F.right(last_two, F.lit(1)))
        fixed = (
            F.when(rest.rlike("(?:at|bl|iz)$"), F.concat(rest, F.lit("e")))
            .when(doubled & rest.rlike(f"{_C}$"), F.when(rest.rlike("[lsz]$"), rest).otherwise(_without(rest, 1)))
            .when(rest.rlike(_SHORT_WORD), F.concat(rest, F.lit("e")))
            .otherwise(rest)
        )
        return F.when(rest.rlike(_V), fixed).otherwise(word)

    ending = F.when(word.endswith("ed"), 2).otherwise(3)
    return (
        F.when(word.endswith("eed"), F.when(_without(word, 3).rlike(_M_POSITIVE), _without(word, 1)).otherwise(word))
        .when(word.endswith("ed") | word.endswith("ing"), let(_without(word, ending), repaired))
        .otherwise(word)
    )


def _final_y(word: Column) -> Column:
    last = word.endswith("y") | word.endswith("Y")
    return F.when(last & word.rlike(f"{_V}.*[yY]$"), F.regexp_replace(word, "[yY]$", "i")).otherwise(word)


def _step_two(word: Column) -> Column:
    return _rewrite(word, _STEP_TWO)


def _step_three(word: Column) -> Column:
    return _rewrite(word, _STEP_THREE)


def _step_four(word: Column) -> Column:
    def without(suffix: Column) -> Column:
        base = _without(word, F.length(suffix))
        removable = (suffix != "") & ((suffix != "ion") | base.rlike("[st]$")) & base.rlike(_M_ABOVE_ONE)
        return F.when(removable, base).otherwise(word)

    found = let(F.regexp_extract(word, f"({'|'.join(_STEP_FOUR)})$", 1), without)
    return F.when(_ends_in(word, _STEP_FOUR), found).otherwise(word)


def _final_e(word: Column) -> Column:
    base = _without(word, 1)
    drop = base.rlike(_M_ABOVE_ONE) | (base.rlike(_M_POSITIVE) & ~base.rlike(_SHORT_END))
    return F.when(word.endswith("e"), F.when(drop, base).otherwise(word)).otherwise(word)


def _final_l(word: Column) -> Column:
    return F.when(word.endswith("ll") & word.rlike(_M_ABOVE_ONE), _without(word, 1)).otherwise(word)


_STEPS = (_mark_y, _plural, _past, _final_y, _step_two, _step_three, _step_four, _final_e, _final_l)


def _for_long(step):
    return lambda word: F.when(F.col("_long"), step(word)).otherwise(word)


def with_stem(rows: DataFrame, token: str, term: str = "term") -> DataFrame:
    """Add ``term``: the folded, stemmed form of the lower-case word in ``token``; two letters or fewer stay as they are.

    One projection per step keeps analysis of the plan short, and as each step names its input once, projections
    collapse, and filters pass through them, without repeating it.
    """
    out = rows.withColumn(term, fold(F.col(token))).withColumn("_long", F.length(term) > 2)
    for step in _STEPS:
        out = out.withColumn(term, let(F.col(term), _for_long(step)))
    return out.withColumn(term, F.translate(F.col(term), "Y", "y")).drop("_long")


# ---- The same for one word -------------------------------------------------------------------------------------

REMEMBERED = 1 << 18  # words of which a worker keeps the term

_ACCENTS = str.maketrans(FOLD_FROM, FOLD_TO)
_LONG_FOLDS = [(letter, plain) for letter, plain in _SPECIAL.items() if len(plain) > 1]
_HAS_MEASURE, _HAS_TWO, _HAS_VOWEL = (re.compile(p) for p in (_M_POSITIVE, _M_ABOVE_ONE, _V))
_ENDS_SHORT, _IS_SHORT, _ENDS_CONSONANT = (re.compile(p) for p in (_SHORT_END, _SHORT_WORD, f"{_C}$"))
_TWO, _THREE, _FOUR = (re.compile(f"({'|'.join(rules)})$") for rules in (_STEP_TWO, _STEP_THREE, _STEP_FOUR))
_ENDS_TWO, _ENDS_THREE = tuple(_STEP_TWO), tuple(_STEP_THREE)


def _fold_word(word: str) -> str:
    """As :func:`fold`."""
    if word.isascii():
        return word
    word, kept = word.translate(_ACCENTS), []
    if word.isascii():
        return word
    for letter in word:
        # A mark after a plain letter goes, and so does each mark behind it.
        mark = unicodedata.category(letter) == "Mn" or letter == "\u1734"  # the latter in Java's tables
        if not (mark and kept and kept[-1].isascii() and kept[-1].isalpha()):
            kept.append(letter)
    folded = "".join(kept)
    for letter, plain in _LONG_FOLDS:
        folded = folded.replace(letter, plain)
    return folded


def _past_word(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _HAS_MEASURE.search(word[:-3]) else word
    if not word.endswith(("ed", "ing")):
        return word
    rest = word[:-2] if word.endswith("ed") else word[:-3]
    if not _HAS_VOWEL.search(rest):
        return word
    last_two = rest[-2:].lower()
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if len(rest) > 1 and last_two[0] == last_two[-1] and _ENDS_CONSONANT.search(rest):
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if _IS_SHORT.search(rest) else rest


def _rewritten(word: str, pattern: re.Pattern, rules: dict[str, str], endings: tuple[str, ...]) -> str:
    if not word.endswith(endings):  # most words; far cheaper than the search
        return word
    found = pattern.search(word)
    if found and _HAS_MEASURE.search(word[:found.start()]):
        return word[:found.start()] + rules[found[1]]
    return word


def _stem_word(word: str) -> str:
    if "y" in word:
        word = re.sub("yy", "yY", re.sub("([aeiou])y", r"\1Y", re.sub("^y", "Y", word)))
    if word.endswith("s"):
        word = re.sub("(?:(ss)es|(i)es|([^s])s)$", lambda m: m[1] or m[2] or m[3], word)
    word = _past_word(word)
    if word.endswith(("y", "Y")) and _HAS_VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    word = _rewritten(_rewritten(word, _TWO, _STEP_TWO, _ENDS_TWO), _THREE, _STEP_THREE, _ENDS_THREE)
    found = _FOUR.search(word) if word.endswith(_STEP_FOUR) else None
    if found:
        base = word[:found.start()]
        if (found[1] != "ion" or base.endswith(("s", "t"))) and _HAS_TWO.search(base):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _HAS_TWO.search(base) or (_HAS_MEASURE.search(base) and not _ENDS_SHORT.search(base)):
            word = base
    if word.endswith("ll") and _HAS_TWO.search(word):
        word = word[:-1]
    return word.replace("Y", "y")


@lru_cache(REMEMBERED)
def term_of(token: str, stem: bool = True) -> str:
    """The term that :func:`with_stem` gives a lower-case word, or without ``stem`` the one that :func:`fold` gives."""
    word = _fold_word(token)
    return (_stem_word(word) if len(word) > 2 else word.replace("Y", "y")) if stem else word
