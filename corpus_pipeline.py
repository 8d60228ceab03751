"""A training-data pipeline: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import best_fit, cotraining, language_bitmask, lsh_forest, mixing
from corpusloom.llm.common import part_count, staged, table

LEAST_COVERAGE = 0.2  # share of a text's n-grams its language must know
ROWS_EACH = 1 << 14  # rows of texts that a task reads where texts are dealt
READ = ("doc_id", "text", "lang", "source", "n_chars")  # the columns that stages look at

ORACLE_SQL = None  # trained models, hashes and packing: SQL cannot express them


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` with every column that no stage reads under a name that no stage uses."""
    return docs.toDF(*[c if c in READ else f"__own{i}" for i, c in enumerate(docs.columns)])


def restored(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with their names, of rows of ``apart(docs)``."""
    return kept.select(*apart(docs).columns).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    A null or empty text is judged by its metadata and an empty text's features; a null source,
    language or length is a value of its own.  Rows are judged one by one: repeated and tied rows
    alike.  Columns that the stage does not read are kept as they are, whatever their names.
    Without labels of both kinds, and on an empty table, nothing is rejected.
    """
    found = cotraining.classify(apart(docs), table(spark, sf_dir, "labels"))
    return restored(found.where("keep"), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that was learned, go.

    So do null and empty texts.  Rows with a null language teach nothing and are judged like all
    others; repeated rows alike; ties between languages fall to the first name, which keeps the
    row either way.  Other columns are kept as they are.  An empty table stays empty.
    """
    rows = apart(docs)
    filters = language_bitmask.train(language_bitmask.training_rows(rows))
    found = language_bitmask.identify(rows, filters)
    kept = (F.col("lang_pred") != language_bitmask.UNKNOWN) & (F.col("coverage") >= LEAST_COVERAGE)
    return restored(found.where(kept), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word Jaccard similarity of 0.8 or more, directly or over others,
    one stays: that with the smallest id (null ids last), then the smallest hash of the text.

    Of rows that repeat both one stays, whatever their other columns hold; those are kept as they
    are.  Documents without words (null, empty, blank) are linked to nothing: of each id and text
    one stays.  An empty table stays empty.
    """
    rows = apart(docs)
    classes = staged(lsh_forest.near_duplicates(rows).select("doc_id", "text_hash", "class_no"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    kept = classes.where("class_no is not null").groupBy("class_no").agg(first).select("first.doc_id", "first.text_hash")
    kept = kept.unionByName(classes.where("class_no is null").select("doc_id", "text_hash").distinct())
    kept = kept.select(F.xxhash64("doc_id", "text_hash").alias("__key"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"))
    parts = part_count(spark, classes.count(), ROWS_EACH)
    hashed = rows.withColumn("__text_hash", F.xxhash64(F.col("text").cast("string")))
    hashed = hashed.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), "__text_hash")).repartition(parts, "__key")
    same = hashed["doc_id"].cast("long").eqNullSafe(kept["__id"]) & hashed["__text_hash"].eqNullSafe(kept["__h"])
    found = hashed.join(kept, (hashed["__key"] == kept["__key"]) & same, "left_semi")
    return restored(found.dropDuplicates(["__key", "doc_id", "__text_hash"]), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: a document stands as often as it was drawn, up to twice.

    A null or empty text has size 0 and is drawn like any other of its source; a null source is a
    source of its own; repeated rows are drawn each; rows of equal size stand by id, then text.
    Other columns are kept as they are.  An empty table stays empty.
    """
    return restored(mixing.emitted(mixing.mix(apart(docs))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences.

    A null or empty text is one piece holding the end id; a null id stays null; repeated rows are
    packed each.  Returns the pieces' columns only.  An empty table has no pieces.
    """
    return best_fit.pack(best_fit.token_pieces(docs))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
