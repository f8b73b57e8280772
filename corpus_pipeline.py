"""From raw documents to token files, in five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontam, mixing, near_dedup, token_files, toxicity
from voxloom.llm.scratch import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; one narrow pass after the fit.

    Null and empty texts have the score of no terms, so they stay unless nearly all labels are toxic.
    Rows with a null id stay or go by their text, repeated rows each by theirs; an empty table stays empty.
    """
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_scores(docs, machine).where(F.col("toxicity_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the smallest id.

    Null and empty texts are linked with nothing and stay, as do rows with a null id. Rows that repeat
    an id stay or go together. An empty table stays empty.
    """
    dropped = near_dedup.near_duplicates(docs, near_dedup.CONTRACT).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none. Each row goes by its own text, whatever its id; without a benchmark
    all stay.
    """
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hit_spans") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken, not at all up to twice.

    Null and empty texts count no words; a null source is one of its own. Rows with the same id share a
    hash, so they are taken alike. An empty table stays empty.
    """
    return mixing.mixed(docs).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; returns what they hold of each document, a row for each taken copy.

    Null counts as empty: such a document has the end id alone. Rows of equal ids follow one another.
    """
    return token_files.token_report(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("tokens", to_tokens)]

#: Toxicity and token ids can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
