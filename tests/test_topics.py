import numpy as np
from pyspark.sql import functions as F

from reqloom.operators import nmf, topics


def blocks(spark, copies=30):
    """Rows of two separate vocabularies."""
    rows = [(f"r{i:03d}", "alpha beta gamma delta" if i % 2 else "red green blue yellow") for i in range(copies)]
    return spark.createDataFrame(rows, "sent_id string, sentence string").withColumn("post_id", F.col("sent_id"))


def test_global_topics(spark):
    assigned, words, losses = topics.global_topics(blocks(spark), k=2, min_df=2, max_df=0.9, rounds=40)
    found = {(r.topic_id, int(r.sent_id[1:]) % 2) for r in assigned.collect()}
    assert len(found) == 2 and len({t for t, _ in found}) == 2
    assert losses == sorted(losses, reverse=True)
    for r in words.collect():
        assert abs(sum(r.shares) - 1) < 1e-9 and min(r.shares) >= 0
    assert assigned.where("abs(aggregate(weights, 0d, (a, x) -> a + x) - 1) > 1e-9").count() == 0
    again = topics.global_topics(blocks(spark), k=2, min_df=2, max_df=0.9, rounds=40)[2]
    assert again == losses


def test_spread_fit_agrees(spark):
    rng = np.random.default_rng(3)
    low = rng.random((60, 3)) @ rng.random((3, 12))
    rows = spark.createDataFrame([(f"{i:02d}", list(range(12)), [float(x) for x in r]) for i, r in enumerate(low)], "sent_id string, idx array<int>, val array<double>").repartition(3)
    h, losses = nmf.fit_spread(rows, 12, 3, rounds=60)
    assert losses == sorted(losses, reverse=True)
    assert losses[-1] < 0.05 * np.linalg.norm(low)
    one, single = nmf.fit(rows, 12, 3, rounds=60)
    assert single[-1] < 0.05 * np.linalg.norm(low)
    assert h.min() >= 0 and one.min() >= 0


def test_no_terms(spark):
    assigned, _, losses = topics.global_topics(blocks(spark, 4), k=2, min_df=20)
    assert losses == [] and {r.topic_id for r in assigned.collect()} == {-1}


def test_local(spark):
    rows = blocks(spark, 40).withColumn("global_topic_id", F.lit(7)).select("sent_id", "global_topic_id", "sentence")
    rows = rows.unionByName(spark.createDataFrame([("none", 7, "qq")], rows.schema))
    fitted = topics.local_grid(rows, (2, 3), no_below=2, no_above=0.9, rounds=20).persist()
    scores = topics.score_grid(rows, fitted)
    assert {r.k for r in scores.collect()} == {2, 3}
    out = topics.local_topics(rows, fitted, scores.where("k = 2"))
    found = {r.sent_id: (r.local_topic_id, r.local_topic_distribution) for r in out.collect()}
    assert found["none"] == (-1, [0.0, 0.0])
    assert found["r000"][0] != found["r001"][0] and abs(sum(found["r000"][1]) - 1) < 1e-9
    spread = topics.local_grid(rows, (2,), no_below=2, no_above=0.9, small=1)
    assert spread.count() == 1


def test_coherence(spark):
    texts = spark.createDataFrame([(["a", "b"],), (["a", "b"],), (["c"],), (["d"],)], "tokens array<string>")
    words = spark.createDataFrame([(0, ["a", "b"]), (1, ["c", "d"])], "topic_id int, words array<string>")
    counts, n = topics.window_counts(texts, words.select(F.explode("words").alias("word")), 10)
    value = {r.topic_id: r.npmi for r in topics.npmi(counts, n, words).collect()}
    assert value[0] > 0.99 and value[1] < -0.85
    deep = topics.c_v(counts, n, {0: ["a", "b"], 1: ["c", "d"]})
    assert deep[0] > deep[1]


def test_window_counts_by_brute_force(spark):
    """Texts of all lengths around the window's, two parts with lists of their own, repeated and unlisted words."""
    from collections import Counter
    from random import Random

    draw = Random(2)
    texts = [(draw.randint(0, 2), draw.choices("abcdefgh", k=draw.choice([0, 1, 2, 9, 10, 11, 25]))) for _ in range(300)]
    listed = {0: ["d", "a", "c"], 1: ["b", "h"]}
    want = Counter()
    for part, words in texts:
        for s in range(max(1, len(words) - 9) if words else 0):
            held = sorted(set(words[s : s + 10]) & set(listed.get(part, [])))
            want.update([(part, None, None), *((part, x, y) for i, x in enumerate(held) for y in held[i:])])
    rows = spark.createDataFrame(texts, "part int, tokens array<string>").repartition(3)
    found = topics.grouped_window_counts(rows, spark.createDataFrame([(p, w) for p, own in listed.items() for w in own], "part int, word string"))
    assert {(r.part, r.a, r.b): r.n for r in found.collect() if r.n} == dict(want)
    one = rows.where("part = 1").select("tokens")
    counts, n = topics.window_counts(one, spark.createDataFrame([("b",), ("h",)], "word string"))
    assert {(r.a, r.b): r.n for r in counts.collect()} == {(a, b): x for (p, a, b), x in want.items() if p == 1 and a} and n.first()[0] == want[1, None, None]


def test_window_counts_read_their_texts_once(spark):
    """What is made of the counts reads a stored table, not the texts again."""
    texts = spark.createDataFrame([(["a", "b"],), (["c"],)], "tokens array<string>")
    words = spark.createDataFrame([(0, ["a", "b"])], "topic_id int, words array<string>")
    counts, n = topics.window_counts(texts, words.select(F.explode("words").alias("word")), 10)
    plan = topics.npmi(counts, n, words)._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" not in plan and "parquet" in plan


def test_fits_share_their_rounds(spark):
    """Fits of two parts together are those of each alone, and take no more jobs than the longest."""
    rng = np.random.default_rng(4)
    rows = []
    for part, width in ((0, 12), (5, 9)):
        low = rng.random((40, 3)) @ rng.random((3, width))
        rows += [(part, list(range(width)), [float(x) for x in r]) for r in low]
    held = spark.createDataFrame(rows, "part int, idx array<int>, val array<double>").repartition(3).persist()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fits", "fits")
    made = nmf.fit_parts(held, {0: 12, 5: 9}, (2, 3), rounds=15, tol=0)
    jobs = len(tracker.getJobIdsForGroup("fits"))
    spark.sparkContext.setJobGroup("other", "other")
    assert set(made) == {(0, 2), (0, 3), (5, 2), (5, 3)} and jobs <= 2 * (15 + 3)
    for (part, k), (h, losses) in made.items():
        alone, of_alone = nmf.fit_spread(held.where(F.col("part") == part), 12 if part == 0 else 9, k, rounds=15, tol=0)
        assert np.allclose(h, alone) and np.allclose(losses, of_alone)


def test_local_topics_carry_no_model_in_rows(spark):
    """Rows go to the workers without H and the list of terms, which are as large for each row as for all."""
    rows = blocks(spark, 40).withColumn("global_topic_id", F.lit(7)).select("sent_id", "global_topic_id", "sentence")
    fitted = topics.local_grid(rows, (2,), no_below=2, no_above=0.9, rounds=5)
    plan = topics.local_topics(rows, fitted, fitted.select("global_topic_id", "k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "h#" not in plan


def test_queries_fit_with_the_operators_defaults(spark, tables, monkeypatch):
    from reqloom.plans import queries

    for name, operator in (("nmf_grid", "local_grid"), ("local_nmf", "local_grid"), ("global_nmf", "global_topics")):
        seen = []

        def stop(rows, *args, seen=seen, **settings):
            seen.append((args, settings))
            raise InterruptedError

        monkeypatch.setattr(queries.topics, operator, stop)
        try:
            getattr(queries, name)(spark, tables)
        except InterruptedError:
            pass
        assert seen == [((), {})]
