"""The test tables in the shapes that the engine's operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions import numeric as N
from reqloom.functions.plan import let, once
from reqloom.operators import preprocess, review, sentences, topics
from reqloom.scratch import written
from reqloom.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, post_id, message, lang, source."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("post_id"), F.col("text").alias("message"), "lang", "source")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, distinct, English documents that are long enough. The language is the table's own."""
    return preprocess.preprocess(documents(spark, sf_dir), "doc_id", language=F.col("lang")).drop("message_raw").persist()


def corpus_sentences(spark: SparkSession, sf_dir: str, contexts: bool = False) -> DataFrame:
    docs = corpus(spark, sf_dir).withColumn("product_category", F.col("source"))
    return sentences.build_sentences(docs, check=False, contexts=contexts)


def usable(spark: SparkSession, sf_dir: str, contexts: bool = False) -> DataFrame:
    return sentences.usable(corpus_sentences(spark, sf_dir, contexts))


def _byte(digest, at):
    """A byte of a digest in hexadecimal."""
    return F.conv(F.substr(digest, 2 * F.lit(at) + 1, F.lit(2)), 16, 10).cast("double")


def _weights(digest, first: int, last: int, least: int):
    """Bytes ``first`` to ``last`` of a digest as weights, those under ``least`` as 0, summing to one."""
    return N.normalised(F.transform(F.sequence(F.lit(first), F.lit(last - 1)), lambda i: let(_byte(digest, i), lambda x: F.when(x < least, F.lit(0.0)).otherwise(x))))


def weighed(rows: DataFrame) -> DataFrame:
    """Sentences with made-up topic weights (four bytes of a digest, those under 100 taken as 0), so that topic operators can be checked without a model."""
    made = once(rows, "made", let(F.md5("sent_id"), lambda d: F.struct(_weights(d, 0, 4, 100).alias("weights"), _weights(d, 4, 7, 120).alias("local"))))
    out = topics.assign(made.withColumn("weights", F.col("made.weights")))
    return out.withColumn("local_topic_distribution", F.col("made.local")).withColumn("local_topic_id", N.dominant(F.col("made.local"))).drop("made")


def evidence(
    spark: SparkSession, sf_dir: str, chosen: tuple[int, ...] = (0, 2, 3), lexicon: dict | None = None, check: bool = False, contexts: bool = False, of: DataFrame | None = None
) -> DataFrame:
    """Evidence of the made-up topics, with cues from a lexicon that the test corpus does have.

    Contexts are null unless asked for: they are three times as long as sentences.
    ``of``: the corpus's sentences, where the caller has them.
    """
    held = sentences.usable(corpus_sentences(spark, sf_dir, contexts) if of is None else of)
    held = weighed(held if "context" in held.columns else held.withColumn("context", F.lit(None).cast("string")))
    rows = held.select("sent_id", "post_id", "sentence", "context", "product_category", "topic_id", "topic_weight", "local_topic_id", "local_topic_distribution")
    rows = written(rows, "weighed")
    global_rows = rows.select("sent_id", "post_id", "sentence", "context", "product_category", "topic_id", "topic_weight")
    local_rows = rows.where(F.col("topic_id").isin(*chosen)).select(
        "sent_id", "post_id", "sentence", "context", "product_category", F.col("topic_weight").alias("global_topic_weight"), F.col("topic_id").alias("global_topic_id"), "local_topic_id", "local_topic_distribution"
    )
    global_terms = spark.createDataFrame([(t, f"global {t}") for t in range(4)], "topic_id int, top_terms string")
    local_terms = spark.createDataFrame([(g, t, f"local {g} {t}") for g in chosen for t in range(3)], "global_topic_id int, topic_id int, top_terms string")
    held = review.load_evidence(global_rows, local_rows, global_terms, local_terms, list(chosen), check=check)
    return review.score_lexicon(held, lexicon or TEST_LEXICON)


#: Cues that do occur in the test corpus' invented prose.
TEST_LEXICON = {"pedido": (r"\bthis\b", r"\bfor the\b"), "queixa": (r"\bwas\b", r"\bnot\b", r"\bwhich\w*\b")}


def annotations(spark: SparkSession, sf_dir: str, origin: DataFrame) -> DataFrame:
    """(review_id, requirement_candidate): a label for each reviewed sentence, by a digest of its id."""
    byte = _byte(F.md5("sent_id"), 7)
    return origin.select("review_id", F.when(byte < 100, "sim").when(byte < 200, "nao").otherwise("incerto").alias("requirement_candidate"))
