"""Stems, tokens and folding against small plain-Python versions."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from mailweave.functions import analysis
from mailweave.functions.analysis import fold, tokens, with_stem


class Porter:
    """Letter-index formulation of the published algorithm, for comparison."""

    def __init__(self, word):
        self.w = word

    def consonant(self, i, w=None):
        w = self.w if w is None else w
        if w[i] in "aeiou":
            return False
        return i == 0 or not self.consonant(i - 1, w) if w[i] == "y" else True

    def measure(self, w):
        kinds = [self.consonant(i, w) for i in range(len(w))]
        return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)

    def vowel(self, w):
        return any(not self.consonant(i, w) for i in range(len(w)))

    def cvc(self, w):
        n = len(w)
        return n >= 3 and self.consonant(n - 1, w) and not self.consonant(n - 2, w) and self.consonant(n - 3, w) \
            and w[-1] not in "wxy"

    def stem(self):
        w = self.w
        if len(w) <= 2:
            return w
        for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(suffix):
                w = w[:len(w) - len(suffix)] + new
                break
        if w.endswith("eed"):
            if self.measure(w[:-3]) > 0:
                w = w[:-1]
        else:
            for suffix in ("ed", "ing"):
                if w.endswith(suffix) and self.vowel(w[:-len(suffix)]):
                    w = w[:-len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and self.consonant(len(w) - 1, w):
                        if w[-1] not in "lsz":
                            w = w[:-1]
                    elif self.measure(w) == 1 and self.cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and self.vowel(w[:-1]):
            w = w[:-1] + "i"
        two = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
               "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
               "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
               "iviti": "ive", "biliti": "ble", "logi": "log"}
        three = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
        for rules in (two, three):
            for suffix in sorted(rules, key=len, reverse=True):
                if w.endswith(suffix):
                    if self.measure(w[:-len(suffix)]) > 0:
                        w = w[:-len(suffix)] + rules[suffix]
                    break
        for suffix in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(),
                             key=len, reverse=True):
            if w.endswith(suffix):
                base = w[:-len(suffix)]
                if suffix == "ion" and not base.endswith(("s", "t")):
                    continue
                if self.measure(base) > 1:
                    w = base
                break
        if w.endswith("e"):
            m = self.measure(w[:-1])
            if m > 1 or m == 1 and not self.cvc(w[:-1]):
                w = w[:-1]
        if w.endswith("ll") and self.measure(w) > 1:
            w = w[:-1]
        return w


WORDS = """caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping
tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer
conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness
hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful
goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment
dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll
roll yes yyes say saying enjoyed toyed yy yyy by ying flying dying apology geology oed ing s is eed ed ly
user1 2024 3.14 example.com running runner ran s's national nationalization ion nion tion stion""".split()


def test_stems_match_the_letter_version(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    corpus = documents.select(F.explode(tokens(F.col("text"))).alias("t")).distinct()
    listed = spark.createDataFrame([(w,) for w in WORDS], "t string")
    suffixes = spark.createDataFrame([(a + b,) for a in ("t", "tr", "tre", "trest", "oat", "happ", "buyy", "xall")
                                      for b in ("ation", "izing", "ement", "ational", "ies", "eed", "ying", "ed", "logi",
                                                "iviti", "yed", "alism", "ful", "ness", "e", "ll", "lles", "sion")],
                                     "t string")
    rows = with_stem(listed.union(suffixes).union(corpus).distinct(), "t").select("t", "term", fold(F.col("t")).alias("f"))
    rows = rows.collect()
    assert len(rows) > 3000
    wrong = [(r.t, r.term, Porter(r.f).stem()) for r in rows if r.term != Porter(r.f).stem()]
    assert not wrong, wrong[:20]


def test_known_stems(spark):
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "falling": "fall",
             "filing": "file", "generalizations": "gener", "enjoy": "enjoi", "controlled": "control"}
    rows = with_stem(spark.createDataFrame([(w,) for w in pairs], "w string"), "w").collect()
    assert {r.w: r.term for r in rows} == pairs


def test_token_boundaries(spark):
    cases = {
        "Don't stop user1@Example.com, 3.14 and 1,000!": ["don't", "stop", "user1", "example.com", "3.14", "and", "1,000"],
        "a.b c. .d e:f x_y 1.a": ["a.b", "c", "d", "e:f", "x_y", "1", "a"],
        "日本 ひら abc": ["日", "本", "ひ", "ら", "abc"], "": [], "--": [],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tokens(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == cases
    long = spark.createDataFrame([("x" * 600,)], "t string").select(tokens(F.col("t")).alias("w")).first().w
    assert [len(w) for w in long] == [255, 255, 90]


def test_folding_drops_accents(spark):
    letters = [chr(c) for c in range(0xC0, 0x17F) if chr(c).isalpha()]
    rows = spark.createDataFrame([(c,) for c in letters], "c string").select("c", fold(F.col("c")).alias("f")).collect()
    for row in rows:
        base = "".join(x for x in unicodedata.normalize("NFKD", row.c) if not unicodedata.combining(x))
        if re.fullmatch("[A-Za-z]", base):
            assert row.f == base, row
    special = spark.createDataFrame([("straße Æon œuvre café é",)], "c string").select(fold(F.col("c"))).first()[0]
    assert special == "strasse AEon oeuvre cafe e"


def test_words_are_cut_as_by_the_plain_rule(spark):
    """The pattern tests plain letters first; the rule without that gives the same words."""
    plain = (rf"{analysis._SINGLE}\p{{M}}*|{analysis._WORD}++(?:{analysis._JOINT}{analysis._WORD}++)*+")
    pick = random.Random(5)
    letters = "ab1_.:·,;'’‘․ -\n\t\u0301\u0308éßøÆ漢ひカ한Ж١²ªⅣ\U0001d400\U0001f600\u200d\u00ad"
    texts = ["".join(pick.choices(letters, k=pick.randint(0, 30))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    both = rows.select("text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for n, p in (("old", plain), ("new", analysis.TOKEN))])
    assert [r for r in both.collect() if r.old != r.new] == []
