"""The stages from sentences to the final export, each a stamped run whose manifest names the runs it came from."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.contracts import ContractError, require_count, require_unique
from reqloom.functions import numeric as N
from reqloom.operators import nmf, review, sentences, sentiment, terms, topics
from reqloom.sources.runs import Run


def run_global_topics(
    spark: SparkSession, corpus: DataFrame, folder: str | Path, ks: Sequence[int] = (20,), seed: int = 42, text: str = "sentence", min_df: int = 20, max_df: float = 0.5, max_features: int = 12_000, rounds: int = 300,
) -> list[Run]:
    """A run for each k over the usable sentences of ``corpus``; the term matrix is made once."""
    needed = dict.fromkeys(("sent_id", "post_id", "sentence", "context", "product_category", text))  # not each sentence's whole document
    rows = require_unique(sentences.usable(corpus).select(*needed), ["sent_id"], "sentences").persist()
    n = rows.count()
    held = terms.term_rows(rows, text=text)
    vocab = terms.vocabulary(held, n, min_df, max_df, max_features).persist()
    listed = [r["term"] for r in vocab.orderBy("term_id").collect()]  # at most max_features
    matrix = nmf.as_rows(terms.tfidf(held, vocab, n), "sent_id").persist()
    active = matrix.count()
    out = []
    for k in ks:
        h, losses = nmf.fit(matrix, len(listed), k, seed, rounds)
        weighed = rows.join(nmf.weights(matrix, h), "sent_id", "left").withColumn("weights", F.coalesce("weights", F.array_repeat(F.lit(0.0), k)))
        assigned = topics.assign(weighed).persist()
        words = spark.createDataFrame(nmf.topic_terms(h, listed, 20), "topic_id int, words array<string>, shares array<double>")
        sizes = topics.sizes(assigned, words)
        run = Run.begin(folder, f"nmf_global_k{k:02d}")
        run.write("nmf_results", assigned.select("sent_id", "post_id", "sentence", "context", "product_category", "topic_id", "topic_weight"))
        run.write("topic_weights", assigned.select("sent_id", "weights"))
        run.write("topics", words.join(sizes, "topic_id").select("topic_id", "n_sentences", "n_videos", "pct_frases", F.array_join("words", ", ").alias("top_terms")))
        run.write("strong_examples", topics.examples(assigned, seed=seed))
        run.write("random_examples", topics.examples(assigned, by="random", seed=seed))
        run.write("model", spark.createDataFrame([(t, [float(x) for x in row]) for t, row in enumerate(h)], "topic_id int, weights array<double>"))
        run.write("vocabulary", vocab)
        run.finish({"seed": seed, "k": k, "text_column": text, "min_df": min_df, "max_df": max_df, "n_sentences": n, "n_active": active, "n_terms": len(listed), "losses": losses})
        out.append(run)
    return out


def run_local_topics(spark: SparkSession, global_run: Run, chosen: Sequence[int], expected: int | None = None, ks: Sequence[int] = (2, 3, 4, 5, 6), seed: int = 42, rounds: int = 60, no_below: int = 5, no_above: float = 0.5) -> None:
    """Local topics of the chosen global ones, as tables of the global run. Topics that are there already are left as they are."""
    manifest = global_run.manifest()
    if not chosen or len(set(chosen)) != len(chosen) or not set(chosen) <= set(range(manifest["k"])):
        raise ContractError(f"chosen topics must be different ones below {manifest['k']}: {list(chosen)}")
    results = global_run.read(spark, "nmf_results").where(F.col("topic_id").isin(list(chosen)))
    if expected is not None:
        require_count(results, expected, name="selected sentences")
    for topic in chosen:
        name = f"local_topic{topic:02d}"
        if global_run.marked(name):
            continue
        rows = results.where(F.col("topic_id") == topic).withColumnsRenamed({"topic_id": "global_topic_id", "topic_weight": "global_topic_weight"}).persist()
        fitted = topics.local_grid(rows.select("sent_id", "global_topic_id", "sentence"), ks, seed, no_below=no_below, no_above=no_above, rounds=rounds).persist()
        if fitted.isEmpty():
            raise ContractError(f"topic {topic} has no term that is neither too rare nor too common")
        grid = topics.score_grid(rows, fitted).persist()
        best = topics.choose_k(grid).select(F.lit(topic).alias("global_topic_id"), "k").persist()
        placed = topics.local_topics(rows.select("sent_id", "global_topic_id", "sentence"), fitted, best).drop("global_topic_id", "k")
        words = topics.grid_words(fitted.join(best, ["global_topic_id", "k"]))
        for part, table in (
            ("grid", grid),
            ("nmf_results", rows.join(placed, "sent_id")),
            ("topics", words.select("global_topic_id", "topic_id", F.array_join("words", ", ").alias("top_terms"))),
        ):
            global_run.write(f"{name}_{part}", table, "overwrite")
        global_run.mark(name)
        rows.unpersist()


def _local(spark: SparkSession, run: Run, chosen: Sequence[int], part: str) -> DataFrame:
    out = None
    for topic in chosen:
        table = run.read(spark, f"local_topic{topic:02d}_{part}")
        out = table if out is None else out.unionByName(table)
    return out


def run_review(spark: SparkSession, global_run: Run, chosen: Sequence[int], folder: str | Path, expected: int | None = None, top_k: int = 50, n_random: int = 100, seed: int = 42) -> Run:
    """Evidence, cues, rankings, the blind sample and its origin, and signals by topic. A review is never overwritten."""
    if global_run.manifest()["text_column"] != "sentence":
        raise ContractError("reviews need topics of sentences, not contexts")
    held = review.load_evidence(global_run.read(spark, "nmf_results"), _local(spark, global_run, chosen, "nmf_results"), global_run.read(spark, "topics"), _local(spark, global_run, chosen, "topics"), chosen)
    evidence = review.score_lexicon(held).persist()
    if expected is not None:
        require_count(evidence, expected, name="evidence")
    ranked = review.rankings(evidence, seed).persist()
    blind, origin = review.blind_sample(evidence, ranked, top_k, n_random, seed)
    run = Run.begin(folder, "review")
    tables = {
        "evidence": evidence, "rankings": ranked, "blind_sample": blind, "sample_origin": origin,
        "signals_by_local_topic": review.signals(evidence, "global_topic_id", "local_topic_id"), "signals_by_global_topic": review.signals(evidence, "global_topic_id"),
    }
    for name, table in tables.items():
        run.write(name, table)
    counts = evidence.agg(F.count("*").alias("n"), F.count_if("lex_hit").alias("hits"), F.count_if(F.col("local_topic_id") == -1).alias("unplaced")).first()
    run.finish({"global_run": str(global_run.path), "topics": list(chosen), "seed": seed, "top_k": top_k, "n_random": n_random, "n_evidence": counts["n"], "n_lex_hit": counts["hits"], "n_unassigned": counts["unplaced"]})
    return run


def score_review(spark: SparkSession, run: Run, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(precision of the rankings, confirmed by topic) of a finished annotation."""
    manifest, origin = run.manifest(), run.read(spark, "sample_origin")
    return review.precision(annotations, origin, manifest["top_k"], manifest["n_random"]), review.confirmed_by_topic(annotations, origin)


def run_sentiment(spark: SparkSession, corpus: DataFrame, review_run: Run, folder: str | Path, classifier: sentiment.Classifier | None = None) -> Run:
    """Sentiment of every sentence, and its summaries: of all sentences by source, of usable ones by category, of evidence by topic, local topic and cue."""
    scored = sentiment.classify(corpus, classifier).persist()
    evidence = review_run.read(spark, "evidence").select("sent_id", "global_topic_id", "local_topic_id", "lex_hit", "intent_hint", "topic_score")
    placed = evidence.join(scored.select("sent_id", "sentiment", "score"), "sent_id", "left").persist()
    if placed.where("sentiment is null").limit(1).count():
        raise ContractError("evidence without sentiment")
    run = Run.begin(folder, "sentiment")
    kept = scored.where("not is_fragment and not is_dup_exact")
    run.write("sentences_sentiment", scored)
    run.write("evidence_sentiment", placed)
    for name, rows, keys in (
        ("summary_by_source", scored, ["source"]), ("summary_by_category", kept, ["product_category"]), ("summary_by_topic", placed, ["global_topic_id"]),
        ("summary_by_local_topic", placed, ["global_topic_id", "local_topic_id"]), ("summary_by_cue", placed, ["lex_hit"]),
    ):
        run.write(name, sentiment.summarise(rows, *keys))
    spread = {name: {r["sentiment"]: r["n"] for r in rows.groupBy("sentiment").agg(F.count("*").alias("n")).collect()} for name, rows in (("distribution_all", scored), ("distribution_filtered", kept))}
    spread = {name: {label: n.get(label, 0) for label in N.SENTIMENT_LABELS} for name, n in spread.items()}
    texts = scored.agg(F.count("*").alias("n"), F.countDistinct("sentence").alias("kinds")).first()
    run.finish({"review_run": str(review_run.path), "n_sentences": texts["n"], "n_unique_sentences": texts["kinds"], "n_filtered": kept.count(), "n_evidence": placed.count(), **spread})
    return run


def run_export(spark: SparkSession, corpus: DataFrame, sentiment_run: Run) -> DataFrame:
    """The final wide table; topics are found through the manifests: sentiment -> review -> global run."""
    reviewed = sentiment_run.source("review_run")
    global_run = reviewed.source("global_run")
    global_topics = global_run.read(spark, "nmf_results").select("sent_id", F.col("topic_id").alias("global_topic_id"), F.col("topic_weight").alias("global_topic_weight"))
    names = global_run.read(spark, "topics").select(F.col("topic_id").alias("global_topic_id"), F.col("top_terms").alias("global_top_terms"))
    local = reviewed.read(spark, "evidence").select("sent_id", "local_topic_id", "local_topic_weight", "local_top_terms", "topic_score")
    return sentiment.export(corpus, sentiment_run.read(spark, "sentences_sentiment"), global_topics.join(names, "global_topic_id", "left"), local)
