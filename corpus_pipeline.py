"""From raw documents to tokens: language, near duplicates, secrets, mixture, encoding.

Every stage takes and returns a DataFrame; between stages the rows are written and read again, so
that a stage which loses executors is repeated alone.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import bpe, langid, minhash, mixing, secrets
from taproot.llm.common import table, written

MIXTURE = {"clean": 0.9, "junk": 0.08, "toxic": 0.02}
MIN_SCORE = 0.4  # of the predicted language; four equal languages would give 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them) and those whose language
    is a guess.  Without any labelled document there is no model, and only the former go."""
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs.select(F.struct(*docs.columns).alias("row_"), "text"), model, keep=("row_",))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("row_.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each component of five-word-shingle similarity 0.8.

    Rows that repeat id and text count once; a row of null id stays.  Whole rows are dealt once, by a
    digest of id and text: repeated rows meet inside the tasks that read them, and the join with the
    digests of what is kept needs no further shuffle of texts.
    """
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.concat(F.lit("+"), "text"), F.lit("-")))
    digest = F.unhex(F.sha2(own, 256))
    kept = minhash.near_duplicates(docs, n=5, percent=80, tag=digest).where("kept").select(F.col("tag").alias("digest")).distinct()
    once = docs.select(digest.alias("digest"), F.struct(*docs.columns).alias("row")).dropDuplicates(["digest"])
    return once.join(kept, "digest", "left_semi").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; keeps all rows."""
    out = secrets.redacted(docs, switches=True)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops rows so that domain tokens match ``MIXTURE``; clean documents all stay."""
    labels = mixing.labelled_domains(table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, labels, MIXTURE, hold="clean", stretch=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, ids: bool = False) -> DataFrame:
    """Tokens of every row, digests of the ids and of the decoded bytes and, if asked for, the ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), ids=ids)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: Trained models, MinHash components and merges can't be said in SQL.  Tests hold near_duplicates and secrets
#: against brute force as stages, and the other stages' operators against brute force or a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; the rows hold the token ids."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir, ids=True)
