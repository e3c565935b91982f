"""From raw documents to token ids: quality, repeated lines, near copies, source mix, encoding.

Every stage takes what its predecessor kept, and all but the last return the columns of ``documents``:

1. quality: documents that the positive-unlabelled classifier rejects go;
2. lines: lines found in several documents stay in the first of them only;
3. copies: of documents that share 80 % of their 5-word shingles, directly or through others, the one with the smallest id stays;
4. mix: nine tenths of the tokens, in the target mix of domains, languages and sources, every document once at most and whole;
5. encode: digests of every document's token ids and of the text decoded from them.

Cases, for the whole of it: a null text is as an empty one for every decision, and null, empty and very long texts are judged, cut, compared, counted
and encoded whole.  Rows that share an id, or have none, are documents of their own where their texts differ; equal rows under one id
are one from the copies stage on.  Equal places and equal documents are settled by ids, then by hashes of texts, never by where a row
lies.  An empty table gives an empty result.  Further columns are carried along, whatever their names.

SQL can express neither the classifier nor the encoding, so the whole is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm import bpe_automaton, line_dedup, ngram_join, pu_quality, source_mix
from mailweave.llm.common import read, write_scratch

SHINGLE_WORDS, PERCENT = 5, 80
BUDGET = "all * 9 div 10"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_quality.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.rewritten(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_component(docs, SHINGLE_WORDS, PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.keep_mix(docs, source_mix.domain_of_source(), source_mix.WEIGHTS, F.expr(BUDGET))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(docs, bpe_automaton.tokenizer_file())


STAGES = [("quality", quality), ("lines", lines), ("copies", copies), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
