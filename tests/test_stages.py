import pytest
from pyspark.sql import functions as F

from reqloom.contracts import ContractError
from reqloom.operators import sentences
from reqloom.plans import stages


def corpus(spark):
    """Two product vocabularies, each with two aspects, as short documents."""
    parts = ["the battery charger lasts {} hours with charging cable", "the display panel shows bright colors number {}", "the kitchen knife cuts bread slice {}", "the oven bakes warm bread loaf {} with flour"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{parts[(2 * (i % 2) + j) % 4].format(letters[i % 26] * 2 + letters[j] * 2)}." for i in range(40) for j in range(2)]
    docs = [(f"d{i:02d}", " ".join(texts[2 * i : 2 * i + 2]).replace("lasts", "lasts unfortunately" if i == 4 else "lasts"), "whisper", "laptop", "2024-01-01", 2024, "c") for i in range(40)]
    df = spark.createDataFrame(docs, "post_id string, message string, source string, product_category string, upload_date string, year int, channel string")
    return sentences.build_sentences(df).persist()


def test_all_stages(spark, tmp_path):
    rows = corpus(spark)
    (two, three) = stages.run_global_topics(spark, rows, tmp_path, ks=(2, 3), min_df=2, max_df=0.9, rounds=30)
    assert two.manifest()["k"] == 2 and three.read(spark, "model").count() == 3
    results = two.read(spark, "nmf_results")
    chosen = sorted(r.topic_id for r in results.select("topic_id").distinct().collect() if r.topic_id >= 0)
    stages.run_local_topics(spark, two, chosen, expected=results.where("topic_id >= 0").count(), ks=(2, 3), rounds=15, no_below=2, no_above=0.95)
    stages.run_local_topics(spark, two, chosen, ks=(2, 3))
    with pytest.raises(ContractError):
        stages.run_local_topics(spark, three, [0, 1, 2], no_below=100)
    with pytest.raises(ContractError):
        stages.run_local_topics(spark, two, [0, 0])
    with pytest.raises(ContractError):
        stages.run_local_topics(spark, two, chosen, expected=1)
    run = stages.run_review(spark, two, chosen, tmp_path, top_k=5, n_random=5)
    assert run.manifest()["n_lex_hit"] >= 1
    origin = run.read(spark, "sample_origin")
    labels = origin.select("review_id", F.lit("sim").alias("requirement_candidate"))
    scores, confirmed = stages.score_review(spark, run, labels)
    assert {r.precision for r in scores.collect()} == {1.0}
    assert confirmed.agg(F.sum("n_sim")).first()[0] == origin.count()
    felt = stages.run_sentiment(spark, rows, run, tmp_path)
    assert felt.read(spark, "summary_by_source").first().n == rows.count()
    assert felt.read(spark, "summary_by_category").first().n == rows.where("not is_fragment and not is_dup_exact").count()
    by_cue = {r.lex_hit: r.n for r in felt.read(spark, "summary_by_cue").collect()}
    assert by_cue[True] == run.manifest()["n_lex_hit"] and sum(by_cue.values()) == run.manifest()["n_evidence"]
    assert sum(felt.manifest()["distribution_all"].values()) == rows.count()
    videos = {r.topic_id: (r.n_sentences, r.n_videos) for r in two.read(spark, "topics").collect()}
    assert videos[chosen[0]] == (results.where(F.col("topic_id") == chosen[0]).count(), results.where(F.col("topic_id") == chosen[0]).select("post_id").distinct().count())
    out = stages.run_export(spark, rows, felt)
    assert out.count() == rows.count() and out.where("sentimento is null").count() == 0
    assert out.where("tema_selecionado").count() == results.where(F.col("topic_id").isin(chosen)).count()


def test_commands(spark, tmp_path):
    """The same chain from the shell, with settings from a file."""
    from reqloom import cli
    from reqloom.sources import files
    from reqloom.sources.runs import Run, latest

    rows = corpus(spark)
    rows.write.parquet(f"{tmp_path}/sentences")
    runs = ["--runs", f"{tmp_path}/runs"]
    settings = tmp_path / "settings.yaml"
    settings.write_text(f"topics:\n  runs: {tmp_path}/runs\n  min-df: 2\n  max-df: 0.9\n  rounds: 20\nunknown: {{}}\n")
    table = ["--input", f"{tmp_path}/sentences"]
    cli.main(["--settings", str(settings), "topics", *table, "--k", "2"])
    cli.main(["local-topics", *runs, "--k", "2", "--topics", "0", "1", "--local-k", "2", "--rounds", "10", "--no-below", "2", "--no-above", "0.95"])
    cli.main(["review", *runs, "--k", "2", "--topics", "0", "1", "--top-k", "5", "--n-random", "5"])
    reviewed = Run(latest(f"{tmp_path}/runs", "review"))
    labels = reviewed.read(spark, "sample_origin").select("review_id", F.lit("sim").alias("requirement_candidate"), F.lit("x").alias("note"))
    files.write_csv(labels, f"{tmp_path}/labels")
    cli.main(["score", *runs, "--input", f"{tmp_path}/labels"])
    assert {r.precision for r in reviewed.read(spark, "precision").collect()} == {1.0}
    cli.main(["summaries", *runs, *table])
    cli.main(["export", *runs, *table, "--output", f"{tmp_path}/export"])
    assert spark.read.parquet(f"{tmp_path}/export").count() == rows.count()
