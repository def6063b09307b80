import json
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reqloom.contracts import ContractError, require, require_columns, require_count, require_same_keys, require_unique
from reqloom.functions import numeric as N
from reqloom.operators import ingest, preprocess, reports, review, sentences, sentiment, terms, topics
from reqloom.sources import files, metadata, schemas
from reqloom.sources.cache import KeyedCache
from reqloom.sources.runs import Run, file_sha256, latest


def raw(**change):
    meta = {"id": "abcdefghijk", "channel": "Dave2D", "upload_date": "20240620", "view_count": 1000, "like_count": 50, "comment_count": 7, "language": "en"}
    meta.update(change.pop("meta", {}))
    record = {"url": "u", "titulo": "Dell XPS 13 Review", "duracao": "10:00", "transcricao": "word " * 50, "fonte": "whisper", "youtube_metadata": meta}
    record.update(change)
    return record


def test_runs_in_a_store(spark, tmp_path):
    """Runs live in any folder Spark reaches, not only in the driver's."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./runs", f"file://{tmp_path}")
    run = Run.begin("viewfs://store/runs", "nmf", datetime(2024, 1, 1))
    run.write("t", spark.range(3))
    assert not run.marked("t")
    run.mark("t")
    with pytest.raises(FileNotFoundError):
        run.manifest()
    run.finish({"from": run.path, "name": "é"})
    found = Run(latest("viewfs://store/runs", "nmf"))
    assert found.marked("t") and found.manifest()["name"] == "é" and found.source("from").read(spark, "t").count() == 3
    assert (tmp_path / "nmf_20240101_000000" / "manifest.json").exists()
    with pytest.raises(FileExistsError):
        Run.begin("viewfs://store/runs", "nmf", datetime(2024, 1, 1))


def records(spark, *rows):
    return files.parse_json_array(spark.createDataFrame([("\ufeffjunk" + json.dumps(rows),)], "value string"), "value")


def test_documents(spark):
    found = ingest.build_documents(records(spark, raw(), raw(transcricao=" ", meta={"id": "b"}), raw(youtube_metadata=None)))
    assert found.columns == schemas.columns_of(schemas.DOCUMENT)
    row = found.first()
    assert (found.count(), row.upload_date, row.year, row.title_has_review, row.product_category, row.view_count) == (1, "2024-06-20", 2024, True, "laptop", 1000)
    with pytest.raises(ContractError, match="abcdefghijk"):
        ingest.build_documents(records(spark, raw(), raw()))


def test_overrides(spark, tmp_path):
    assert files.read_overrides(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "o.csv").write_text("post_id,product_category\nabcdefghijk,tv\n,x\nabcdefghijk,phone\nempty,\n")
    own = files.read_overrides(spark, str(tmp_path / "o.csv"))
    made = ingest.build_documents(records(spark, raw(titulo="Glass is glass"), raw(titulo="Pixel 8", meta={"id": "empty"})), own)
    assert {r.post_id: r.product_category for r in made.collect()} == {"abcdefghijk": "phone", "empty": "phone"}


def test_metadata(spark):
    rows = records(spark, raw(), raw(url="bad", meta={"id": "b"}))
    assert "title" not in ingest.drop_repeated_metadata(rows).schema["youtube_metadata"].dataType.fieldNames()
    assert json.loads(ingest.metadata_json(rows).first().metadata_json)["channel"] == "Dave2D"

    def fetch(url):
        if url == "bad":
            raise RuntimeError("x" * 600)
        return {"id": "new", "view_count": 5}

    done = metadata.fetch_metadata(rows, fetch)
    state = {r.url: (r.metadata_status, r.youtube_metadata and r.youtube_metadata.id, len(r.metadata_error or "")) for r in done.collect()}
    assert state == {"u": ("ok", "new", 0), "bad": ("error", None, 500)}
    assert metadata.pending(done).count() == 1
    merged = ingest.merge_metadata(done, done.where("url = 'u'").select(F.lit("bad").alias("url"), "youtube_metadata"))
    assert {r.url: r.metadata_status for r in merged.collect()} == {"u": "ok", "bad": "ok"}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('id,text\n1,NA\n2,"two\nlines, ""q"""\n')
    (tmp_path / "in/b.csv").write_text("id,text\n3,\n")
    rows = files.read_csv_folder(spark, str(tmp_path / "in"), "id int, text string").orderBy("row_file", "row_order").collect()
    assert [(r.id, r.text) for r in rows] == [(1, "NA"), (2, 'two\nlines, "q"'), (3, None)]
    (tmp_path / "s.json").write_text(json.dumps([raw()]))
    assert files.read_json_array(spark, str(tmp_path / "s.json"), strict=True).count() == files.read_json_array(spark, str(tmp_path / "s.json")).count() == 1
    (tmp_path / "p.yaml").write_text("a:\n  b: 3\n")
    settings = files.load_settings(tmp_path / "p.yaml")
    assert files.settings_section(settings, "a")["b"] == 3
    with pytest.raises(ContractError):
        files.settings_section(settings, "a", "c")
    files.write_csv(spark.createDataFrame([(1, "é")], "id int, t string"), str(tmp_path / "out"), bom=True)
    assert next((tmp_path / "out").glob("*.csv")).read_bytes().startswith("\ufeffid,t".encode())


def test_runs(spark, tmp_path):
    old, new = Run.begin(tmp_path, "nmf", datetime(2024, 1, 1)), Run.begin(tmp_path, "nmf", datetime(2025, 1, 1))
    (tmp_path / "nmf_other").mkdir()
    new.write("t", spark.range(3))
    with pytest.raises(FileNotFoundError):
        new.manifest()
    new.finish({"global_run": str(old.path), "n": 3})
    assert latest(tmp_path, "nmf") == new.path
    assert new.source("global_run").path == old.path
    assert new.read(spark, "t").count() == 3
    with pytest.raises(FileExistsError):
        Run.begin(tmp_path, "nmf", datetime(2025, 1, 1))
    assert len(file_sha256(new.path / "manifest.json")) == 64


def test_preprocess(spark):
    rows = spark.createDataFrame([(1, "a " * 300, "en"), (0, "a " * 300, "en"), (2, " \n", "en"), (3, "b " * 300, None), (4, None, "en"), (5, "short", "en")], "n int, message string, lang string")
    done = preprocess.preprocess(rows, "n", language=F.col("lang"))
    assert [(r.n, r.message_raw == r.message + " ") for r in done.collect()] == [(0, True)]
    assert preprocess.reshape(rows, {"n": "m"}, ["lang", "none"], {"platform": "youtube", "message": "x"}).columns == ["m", "message", "platform"]
    assert [r.post_id for r in preprocess.with_ids(rows, "n").orderBy("n").limit(2).collect()] == ["post_0000", "post_0001"]
    with pytest.raises(ContractError):
        preprocess.with_ids(spark.createDataFrame([(None,)], "k string"), "k", "k")
    sample = preprocess.stratified_sample(spark.range(100).select("id", (F.col("id") % 3).alias("c")), "c", "id", 4)
    assert sample.groupBy("c").count().where("count <> 4").count() == 0
    assert preprocess.date_category(spark.createDataFrame([("2024-05-01",), ("x",)], "d string"), "d").select("category").collect() == [("2024-05",), (None,)]
    assert preprocess.first_columns(rows, "lang").columns == ["lang", "n", "message"]


def docs(spark, *texts, source="whisper"):
    return spark.createDataFrame([(f"d{i}", t, source, "laptop", "2024-01-01", 2024, "c") for i, t in enumerate(texts)], "post_id string, message string, source string, product_category string, upload_date string, year int, channel string")


def test_sentences(spark):
    found = sentences.build_sentences(docs(spark, "First document. Last document.", "Other document. Final other document.")).orderBy("sent_id")
    assert found.columns == schemas.columns_of(schemas.SENTENCE)
    assert [r.context for r in found.collect()] == ["First document. Last document."] * 2 + ["Other document. Final other document."] * 2
    flags = sentences.build_sentences(docs(spark, "Okay. Same repeated sentence.", "Same repeated sentence.")).collect()
    assert sum(r.is_dup_exact for r in flags) == 2
    assert {r.sentence: r.is_fragment for r in flags} == {"Okay.": True, "Same repeated sentence.": True}
    assert sentences.build_sentences(docs(spark, "x").limit(0)).count() == 0
    with pytest.raises(ContractError):
        sentences.build_sentences(docs(spark, "a").drop("message"))


def test_repeats_by_brute_force(spark):
    """Flags, contexts and word counts of random documents; a document's id comes twice, another's text as well."""
    from collections import Counter
    from random import Random

    draw = Random(5)
    texts = [" ".join(f"{' '.join(draw.choices('abcd', k=draw.randint(1, 4)))}." for _ in range(draw.randint(0, 9))) for _ in range(40)] + [""]
    rows = [(str(i if i != 7 else 3), t, "whisper") for i, t in enumerate(texts)] + [("copy", texts[9], "whisper")]
    split = {(p, t): [s + "." for s in t[:-1].split(". ")] if t else [] for p, t, _ in rows}
    times = Counter(s for p, t, _ in rows for s in split[p, t])
    want = Counter((p, i, s, " ".join(all_[max(0, i - 1) : i + 2]), len(s.split()), times[s] > 1) for p, t, _ in rows for all_ in [split[p, t]] for i, s in enumerate(all_))
    held = spark.createDataFrame(rows, "post_id string, message string, source string").repartition(5)
    found = sentences.build_sentences(held, check=False)
    assert Counter(tuple(r) for r in found.select("post_id", "sent_idx", "sentence", "context", "n_words", "is_dup_exact").collect()) == want
    bare = sentences.build_sentences(held, check=False, contexts=False)
    assert bare.columns == [c for c in found.columns if c != "context"] and bare.count() == sum(want.values())


def test_captions(spark):
    captions = docs(spark, "first sentence second sentence", source="legenda")
    with pytest.raises(ContractError):
        sentences.build_sentences(captions)
    found = sentences.build_sentences(captions, lambda texts: texts.map(lambda _: "First sentence. Second sentence.")).collect()
    assert [(r.sentence, r.message_raw, r.punctuation_restored) for r in sorted(found, key=lambda r: r.sent_idx)] == [
        ("First sentence.", "first sentence second sentence", True), ("Second sentence.", "first sentence second sentence", True)
    ]


def test_punctuation_windows():
    text = " ".join(f"w{i}" for i in range(500)) + " 3.5, end."
    for overlap, expected in ((False, 502), (True, 502 + 10)):
        restored = sentences.windowed_punctuation(lambda ws: ["."] * len(ws), overlap=overlap)(pd.Series([text]))[0]
        assert len(restored.split()) == expected
    assert "3.5." in restored


def test_terms(spark):
    rows = spark.createDataFrame([(str(i), "The batteries last hours and the battery charges fast.") for i in range(6)] + [("s", "The screen is bright.")], "sent_id string, sentence string")
    held = terms.lemma_rows(rows, extra=("fast",))
    words = {r.term for r in terms.dictionary(held, 7, 3, 1.0).collect()}
    assert "battery" in words and not words & {"fast", "screen", "batteries"}
    assert [terms.lemma(w) for w in ("noisy", "stopped", "glasses", "people", "boxes", "batteries")] == ["noisy", "stop", "glass", "person", "box", "battery"]
    table = terms.term_rows(rows)
    scores = terms.tfidf(table, terms.vocabulary(table, 7, 1, 1.0), 7)
    assert scores.groupBy("sent_id").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_a_dictionary_may_have_all_terms(spark):
    held = spark.createDataFrame([(f"s{i}", f"t{j}", 1) for i in range(2) for j in range(4)], "sent_id string, term string, tf long")
    assert terms.dictionary(held, 4, 1, 1.0, keep=3).count() == 3
    whole = terms.dictionary(held, 4, 1, 1.0, keep=None)
    assert whole.count() == 4 and terms.bags(held, whole, bounded=False).count() == 8


def test_diversity(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "topic_id int, words array<string>")
    value = lambda d, k: topics.diversity(frame(d), k).first()[0]
    assert value({0: ["a", "b"], 1: ["c", "d"]}, 2) == 1.0
    assert value({0: ["a", "b"], 1: ["a", "b"]}, 2) == 0.5
    assert value({-1: ["x", "y"], 0: ["a", "b"], 1: [""]}, 2) == 1.0
    assert value({0: ["a", "b"]}, 10) == 0.2
    assert topics.diversity(spark.createDataFrame([], "topic_id int, words array<string>"), 10).first()[0] == 0.0


def test_choose_k(spark):
    grid = spark.createDataFrame([(2, 0.1, 0.9), (3, 0.2, 0.5), (4, 0.2, 0.5), (5, 0.05, 0.4)], "k int, npmi double, diversity double")
    assert {r.k for r in topics.pareto(grid).collect()} == {2, 3, 4}
    assert topics.choose_k(grid).first().k == 3


def evidence(spark, rows):
    return spark.createDataFrame([(s, s, s, "c", 1, 0, float(x), h, n, "outro") for s, x, h, n in rows], "sent_id string, sentence string, context string, product_category string, global_topic_id int, local_topic_id int, topic_score double, lex_hit boolean, lex_n int, intent_hint string")


def test_rankings(spark):
    ranked = review.rankings(evidence(spark, [("a", 0.9, False, 0), ("b", 0.6, True, 1), ("c", 0.7, True, 1)]))
    first = {r.ranking: r.sent_id for r in ranked.where("rank = 1").collect()}
    assert (first["topico"], first["topico_lexical"]) == ("a", "c")
    ties = review.rankings(evidence(spark, [(x, 1.0, False, 0) for x in "abcdefgh"]))
    order = [r.sent_id for r in ties.where("ranking = 'topico'").orderBy("rank").collect()]
    assert sorted(order) == list("abcdefgh") != order
    top = review.top_of_rankings(evidence(spark, [(x, 1.0, False, 0) for x in "abcdefgh"]), 3)
    assert [r.sent_id for r in top.where("ranking = 'topico'").orderBy("rank").collect()] == order[:3]
    with pytest.raises(ContractError):
        review.rankings(evidence(spark, [("a", 1, True, 1), ("a", 1, True, 1)]))


def test_sample_and_precision(spark):
    rows = evidence(spark, [(f"v_{i}", 1 - i / 10, i in (2, 3), int(i in (2, 3))) for i in range(8)])
    ranked = review.rankings(rows)
    blind, origin = review.blind_sample(rows, ranked, 2, 2)
    assert set(blind.columns) == {"review_id", "sentence", "context", "product_category", "requirement_candidate", "aspect_ref", "review_notes"}
    found = origin.orderBy("review_id").collect()
    assert [r.review_id for r in found] == list(range(1, len(found) + 1))
    top = {r.sent_id for r in ranked.where("rank <= 2 and ranking <> 'aleatoria'").collect()}
    assert {r.sent_id for r in found if r.selection_source == "aleatoria"}.isdisjoint(top)
    assert {r.sent_id: r.selection_source for r in found}["v_0"] == "topico"
    with pytest.raises(ContractError):
        review.blind_sample(rows, ranked, 9, 1)
    made = spark.createDataFrame([(1, "topico", 1, 2, 3, 4, 0), (2, "lexical", 2, 1, 2, 4, 1), (3, "aleatoria", 3, 3, 4, 5, 0)], "review_id int, selection_source string, rank_topico int, rank_lexical int, rank_topico_lexical int, global_topic_id int, local_topic_id int")
    made = made.withColumn("rank_topico_lexical", F.when(F.col("review_id") == 1, 1).otherwise(9)).withColumn("rank_aleatoria", F.lit(1))
    labels = spark.createDataFrame([(1, "sim"), (2, "nao"), (3, "sim")], "review_id int, requirement_candidate string")
    scores = {r.ranking: r for r in review.precision(labels, made, 1, 1).collect()}
    assert {k: v.precision for k, v in scores.items()} == {"topico": 1.0, "lexical": 0.0, "topico_lexical": 1.0, "aleatoria": 1.0}
    assert 0.2 < scores["topico"].ci_low < 0.21 and scores["topico"].ci_high == pytest.approx(1.0)
    assert {r.global_topic_id: r.n_sim for r in review.confirmed_by_topic(labels, made).groupBy("global_topic_id").agg(F.sum("n_sim").alias("n_sim")).collect()} == {4: 1, 5: 1}
    with pytest.raises(ContractError):
        review.precision(labels.limit(2), made, 1, 1)


def test_load_evidence(spark):
    base = "sent_id string, post_id string, sentence string, context string, product_category string"
    global_rows = spark.createDataFrame([("a", "p", "s", "c", "x", 1, 0.6), ("b", "p", "s", "c", "x", 2, 0.5)], f"{base}, topic_id int, topic_weight double")
    terms_of = spark.createDataFrame([(1, "t"), (2, "u")], "topic_id int, top_terms string")
    local_terms = spark.createDataFrame([(1, 0, "l0"), (1, 1, "l1")], "global_topic_id int, topic_id int, top_terms string")
    local = lambda weights, topic: spark.createDataFrame([("a", "p", "s", "c", "x", 0.6, 1, topic, weights)], f"{base}, global_topic_weight double, global_topic_id int, local_topic_id int, local_topic_distribution string")
    row = review.load_evidence(global_rows, local("[0.25, 0.75]", 1), terms_of, local_terms, [1]).first()
    assert (row.topic_score, row.local_top_terms, row.global_top_terms) == (pytest.approx(0.45), "l1", "t")
    none = review.load_evidence(global_rows, local("[0, 0]", -1), terms_of, local_terms, [1]).first()
    assert (none.topic_score, none.local_top_terms) == (0.0, None)
    for weights, topic in (("[0.5, 0.6]", 1), ("[1.0]", 0), ("[0.5, 0.5]", -1), ("[-0.5, 1.5]", 1)):
        with pytest.raises(ContractError):
            review.load_evidence(global_rows, local(weights, topic), terms_of, local_terms, [1])
    with pytest.raises(ContractError):
        review.load_evidence(global_rows, local("[1, 0]", 0), terms_of, local_terms, [1, 2])


def test_evidence_moves_no_texts_to_compare_them(spark):
    """Sentences and contexts are compared by digests: the join's right side has none of them."""
    from reqloom.plans import adapt

    rows = spark.createDataFrame([(f"s{i}", "p", f"a {i}", f"a {i} b", "c", False, False, 9) for i in range(40)], "sent_id string, post_id string, sentence string, context string, product_category string, is_fragment boolean, is_dup_exact boolean, n_words int")
    found = adapt.evidence(spark, "", check=True, of=rows)
    joined = found.select("sent_id", "topic_score")._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0 and "sentence#" not in joined.split("Join Inner")[-1].split("Relation")[0]
    plain = sentiment.classify(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan_of(plain) and "Aggregate" not in plan_of(plain)


def plan_of(text):
    return text.split("LogicalRDD")[0]


def test_sentiment(spark, tmp_path):
    calls = []

    def classifier(texts):
        calls.extend(texts)
        return [[{"label": "positive", "score": p}, {"label": "neutral", "score": u}, {"label": "negative", "score": n}] for p, u, n in ((0.8, 0.1, 0.1) if "great" in t else (0.1, 0.2, 0.7) for t in texts)]

    rows = spark.createDataFrame([("0", "great screen"), ("1", "bad battery"), ("2", "great screen"), ("3", None)], "sent_id string, sentence string")
    cache = KeyedCache(spark, f"file://{tmp_path}/cache", sentiment.SCORES)
    found = {r.sent_id: r.sentiment for r in sentiment.classify(rows, classifier, cache).collect()}
    assert found == {"0": "Positiva", "1": "Negativa", "2": "Positiva", "3": "Negativa"}
    assert cache.read().count() == 3
    assert cache.missing(rows.select(F.sha2("sentence", 256).alias("key")).dropna()).count() == 0
    small = KeyedCache(spark, f"file://{tmp_path}/small", sentiment.SCORES)
    puts = []
    small.put = lambda df, version, put=small.put: (puts.append(version), put(df, version))
    assert {r.sent_id: r.sentiment for r in sentiment.classify(rows, classifier, small, chunk=1).collect()} == found and len(puts) == 3
    tied = spark.createDataFrame([("k", "Neutra", 0.1), ("k", "Positiva", 0.0)], "key string, sentiment string, score double")
    kept = KeyedCache(spark, f"file://{tmp_path}/tied", "sentiment STRING, score DOUBLE")
    kept.put(tied, 1)
    assert tuple(kept.read().first()) == ("k", "Positiva", 0.0)
    plain = {r.sent_id: r.sentiment for r in sentiment.classify(rows).collect()}
    assert plain == {"0": "Positiva", "1": "Negativa", "2": "Positiva", "3": "Neutra"}
    frame = spark.createDataFrame([("a", "Positiva"), ("a", "Negativa"), ("a", "Neutra"), ("b", "Negativa"), (None, "Neutra")], "k string, sentiment string")
    summary = {r.k: r for r in sentiment.summarise(frame, "k").collect()}
    assert (summary["a"].n, summary["a"].saldo, summary["b"].frac_negativa, len(summary)) == (3, 0.0, 1.0, 2)


def test_export(spark):
    rows = spark.createDataFrame([("a_0", "a", 0, "x"), ("a_1", "a", 1, "y"), ("b_0", "b", 0, "z")], "sent_id string, post_id string, sent_idx int, sentence string")
    scored = sentiment.classify(rows)
    topics_of = spark.createDataFrame([("a_0", 11), ("b_0", 3)], "sent_id string, global_topic_id int")
    local = spark.createDataFrame([("b_0", 0)], "sent_id string, local_topic_id int")
    out = sentiment.export(rows, scored, topics_of, local).orderBy("sent_id").collect()
    assert [(r.global_topic_id, r.tema_selecionado, r.local_topic_id) for r in out] == [(11, False, None), (None, False, None), (3, True, 0)]
    assert "global_topic_id" not in sentiment.export(rows, scored).columns
    with pytest.raises(ContractError):
        sentiment.export(rows, scored.where("sent_id <> 'a_1'"))


def test_reports_and_contracts(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), (None, 4.0)], "k string, x double")
    assert [tuple(r) for r in reports.value_counts(rows, "k").collect()] == [("a", 2), ("b", 1)]
    assert reports.histogram(rows, "x", 3).agg(F.sum("n")).first()[0] == 4
    assert reports.reduction(rows, rows.limit(1)).first().frac_removed == 0.75
    assert {r.field: r.n_present for r in reports.profile(rows).collect()} == {"k": 3, "x": 4}
    assert [r.k for r in reports.crosstab(rows.withColumn("v", F.lit("q")), "k", "v", ["q"]).collect()][-1] == "base"
    for broken in (lambda: require_columns(rows, ["z"]), lambda: require_unique(rows, ["k"]), lambda: require(rows, {"x small": F.col("x") < 3}), lambda: require_count(rows, 9), lambda: require_same_keys(rows, rows.limit(1), ["k"])):
        with pytest.raises(ContractError):
            broken()


def test_numeric(spark):
    w = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, 0.0, 0.0],)], "w array<double>")
    assert [tuple(r) for r in w.select(N.dominant(F.col("w")), F.array_max(N.normalised(F.col("w")))).collect()] == [(1, pytest.approx(3 / 7)), (-1, 0.0)]
