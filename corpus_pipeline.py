"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

A document that toxicity rejects goes; one document of each group of near copies stays; one that holds a benchmark
passage goes; the rest is mixed to target weights, some documents more than once; what was taken is written
as token ids. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, mixing, ngram_join, toxicity, wavelet
from quillon.llm.queries import tokenizer_path
from quillon.llm.shared import table, written


def _aside(docs: DataFrame, *taken: str):
    """docs with columns named like an operator's own out of the way, and a function that gives a result docs' columns back."""
    new = {c: f"{c}_of_{len(docs.columns)}_columns" for c in docs.columns if c in taken}
    back = {v: k for k, v in new.items()}
    return docs.withColumnsRenamed(new), lambda out: out.drop(*taken).withColumnsRenamed(back).select(*(f"`{c}`" for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1, op5: documents with a score under 0.5 stay. The classifier is fitted on labelled rows of these docs that are not held out; without any, all stay.

    Null and empty texts have a score too, as empty ones. Repeated rows and rows of one doc_id are judged by their texts alone, so equal texts stay or go
    together. Columns stay as they are, whatever their names; no rows give no rows.
    """
    own, back = _aside(docs, "toxic_score")
    scored = toxicity.scored(own, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return back(scored.filter(F.col("toxic_score") < 0.5))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2, op3: one row of each class of near copies stays, that of the smallest doc_id (a null one last).

    Different texts under one doc_id both stay, a repeated row stays once; null and empty texts are copies of nothing and stay, once for each doc_id and all without one.
    """
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3, op7: documents in which no window of the benchmark occurs stay; so do null and empty texts. Repeated rows are judged alike; an empty benchmark drops nothing."""
    own, back = _aside(docs, "n_words", "hit_spans", "item_ids")
    found = decontam.decontaminate(own, table(spark, sf_dir, "benchmark"))
    return back(found.filter(F.size("hit_spans") == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4, op10: every row as often as the mix takes it, none, once or up to three times. A null source is one more source; a row without words gets the whole
    part of its source's rate; repeated rows and rows without a doc_id are taken separately."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5, op9: the texts as token ids in wavelet matrices, read back: doc_id, start, n_tokens, ids_crc32, one row for each row of docs, in order of doc_id (a null
    one first). A null or empty text is the end id alone."""
    return wavelet.read_shards(wavelet.write_shards(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark passages", drop_contaminated),
    ("mixing", mix_sources),
    ("token ids", write_tokens),
]

#: A fitted classifier comes first, so SQL can express none of the stages' rows; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written under the shared folder and reread as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
