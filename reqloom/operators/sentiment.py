"""Sentence sentiment: each distinct sentence scored once, cached, summarised, exported."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.contracts import ContractError, require_columns
from reqloom.functions import numeric as N
from reqloom.functions import text as T
from reqloom.functions.plan import let, once
from reqloom.scratch import delete_path, written_at
from reqloom.sources.cache import KeyedCache

#: A batch function: texts in, for each a list of {"label", "score"} out.
Classifier = Callable[[list[str]], list[list[dict]]]
SCORES = "sentiment STRING, score DOUBLE, score_positiva DOUBLE, score_neutra DOUBLE, score_negativa DOUBLE"
#: Cue words of the built-in classifier; parameters of it.
POSITIVE = "good great excellent amazing love best nice perfect beautiful fast solid impressive comfortable bright smooth sharp happy better".split()
NEGATIVE = "bad poor terrible awful hate worst ugly slow cheap disappointing annoying uncomfortable dim weak noisy broken worse problem issue".split()


def lexicon_scores(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(label, score) of the three labels by counts of cue words, each count and the neutral one plus one, summing to one."""
    entry = lambda label, x: F.struct(F.lit(label).alias("label"), x.alias("score"))
    hits = lambda words, cues: F.size(F.filter(words, lambda w: w.isin(list(cues))))

    def scores(n: Column) -> Column:
        base = F.lit(1.0) + n["pos"] * 2 + n["neg"] * 2 + 1
        return F.array(entry("positive", (n["pos"] * 2 + 0.5) / base), entry("neutral", 1.0 / base), entry("negative", (n["neg"] * 2 + 0.5) / base))

    counts = lambda words: F.struct(hits(words, positive).alias("pos"), hits(words, negative).alias("neg"))
    return let(let(T.tokens(text), counts), scores)


def to_record(scores: Column) -> Column:
    """The columns of SCORES, as a struct, from (label, score) pairs; scores rounded half to even to four places, missing ones 0."""
    named = F.transform(scores, lambda s: F.struct(N.sentiment_label(s["label"]).alias("label"), F.bround(s["score"], 4).alias("score")))
    of = lambda held, label: F.coalesce(F.array_max(F.transform(F.filter(held, lambda s: s["label"] == label), lambda s: s["score"])), F.lit(0.0))
    whole = lambda held, best: F.struct(best["label"].alias("sentiment"), best["score"].alias("score"), *(of(held, x).alias(f"score_{x.lower()}") for x in N.SENTIMENT_LABELS))
    return let(named, lambda held: let(N.best_label(held), lambda best: whole(held, best)))


def _by_batches(texts: DataFrame, classifier: Classifier, batch: int) -> DataFrame:
    """(key, scores): texts of like length come together, so batches pad little."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"key": part["key"], "scores": classifier(part["sentence"].tolist())})

    ordered = texts.withColumn("size", F.length("sentence")).repartitionByRange("size", "key").sortWithinPartitions("size", "key")
    return ordered.select("key", "sentence").mapInPandas(run, "key string, scores array<struct<label:string,score:double>>")


def classify(rows: DataFrame, classifier: Classifier | None = None, cache: KeyedCache | None = None, version: int = 0, column: str = "sentence", batch: int = 32, chunk: int = 2_000_000) -> DataFrame:
    """``rows`` with sentiment, score and the three scores.

    Each distinct text is scored once, and only if the cache lacks it. A
    classifier's new scores are added to the cache after every ``chunk`` texts or
    so, so that an interrupted run goes on from there. Without a classifier the
    cue words score; without a cache too, each row scores its own text, which
    costs less than a shuffle to find equal ones. Null counts as empty text.
    """
    require_columns(rows, [column])
    if classifier is None and cache is None:
        scored = once(rows, "cue_record", to_record(lexicon_scores(F.coalesce(column, F.lit("")))))
        return scored.select("*", "cue_record.*").drop("cue_record")
    keyed = rows.withColumn("text_key", F.sha2(F.coalesce(column, F.lit("")), 256))
    texts = keyed.groupBy(F.col("text_key").alias("key")).agg(F.first(F.coalesce(column, F.lit(""))).alias("sentence"))

    def record_of(missing: DataFrame) -> DataFrame:
        scored = missing.select("key", lexicon_scores(F.col("sentence")).alias("scores")) if classifier is None else _by_batches(missing, classifier, batch)
        return once(scored, "record", to_record(F.col("scores"))).select("key", "record.*")

    if cache is None:
        record = record_of(texts)
    elif classifier is None:
        cache.put(record_of(cache.missing(texts)), version)
        record = cache.read()
    else:
        missing, path = written_at(cache.missing(texts), "missing-texts")
        parts = -(-missing.count() // chunk)
        for part in range(parts):
            cache.put(record_of(missing.where(F.pmod(F.crc32("key"), F.lit(parts)) == part)), version)
        delete_path(rows.sparkSession, path)
        record = cache.read()
    return keyed.join(record, keyed["text_key"] == record["key"], "left").drop("text_key", "key")


def summarise(rows: DataFrame, *keys: str) -> DataFrame:
    """n, a count and a share for each label, and ``saldo`` (positive less negative share), by keys. Null keys are left out."""
    labels = N.SENTIMENT_LABELS
    held = rows.dropna(subset=list(keys))
    out = held.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col("sentiment") == x).alias(x) for x in labels))
    out = out.withColumns({f"frac_{x.lower()}": F.bround(F.col(x) / F.col("n"), 4) for x in labels})
    return out.withColumn("saldo", F.bround(F.col("frac_positiva") - F.col("frac_negativa"), 4))


EXPORTED = (
    "sent_id", "post_id", "sent_idx", "sentence", "context", "punctuation_restored", "n_words", "is_fragment", "is_dup_exact",
    "upload_date", "year", "channel", "source", "product_category",
)


def export(sentences: DataFrame, sentiment: DataFrame, global_topics: DataFrame | None = None, local_topics: DataFrame | None = None, check: bool = True) -> DataFrame:
    """One wide row a sentence: its columns (whole transcripts left out), topics where there are some, and sentiment.

    ``global_topics`` and ``local_topics``: sent_id and what is to be added.
    ``tema_selecionado`` tells whether a sentence is among the local topics'.
    A sentence without sentiment is an error.
    """
    out = sentences.select(*(c for c in EXPORTED if c in sentences.columns))
    if global_topics is not None:
        added = [c for c in global_topics.columns if c != "sent_id"]
        out = out.join(global_topics, "sent_id", "left")
        if local_topics is not None:
            out = out.join(local_topics.withColumn("of_local", F.lit(True)), "sent_id", "left").withColumn("tema_selecionado", F.col("of_local").isNotNull()).drop("of_local")
            local_columns = [c for c in local_topics.columns if c != "sent_id"]
        else:
            out = out.withColumn("tema_selecionado", F.lit(False))
            local_columns = []
        at = added.index("global_topic_id") + 1 if "global_topic_id" in added else 0
        front = [c for c in out.columns if c not in added and c not in local_columns and c != "tema_selecionado"]
        out = out.select(*front, *added[:at], "tema_selecionado", *added[at:], *local_columns)
    elif local_topics is not None:
        out = out.join(local_topics, "sent_id", "left")
    renamed = sentiment.select("sent_id", F.col("sentiment").alias("sentimento"), F.col("score").alias("confianca_sentimento"), "score_positiva", "score_neutra", "score_negativa")
    out = out.join(renamed, "sent_id", "left")
    if check and out.where("sentimento is null").limit(1).count():
        raise ContractError("sentences without sentiment")
    return out
