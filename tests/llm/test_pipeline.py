import collections

import corpus_pipeline
from llm_rows import TEXTS, table_of
from test_decontaminate import expected as overlapping
from test_decontaminate import has_whole_window, whole_windows, words
from test_simhash import slow_components, slow_set, slow_similar
from test_tokens_and_packing import pieces_of

import __spark_entry__
from reqloom.llm import quality


def brute_force(spark, tables):
    """All stages but the classifier and the tokeniser by plain Python."""
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    last = {}
    for i, t in rows:
        last[t or ""] = max(i, last.get(t or "", i))
    rows = [(i, t) for i, t in rows if last[t or ""] == i]
    sets = [slow_set(t) for _, t in rows]
    root = slow_components(range(len(rows)), lambda a, b: slow_similar(sets[a], sets[b]))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(i, least.get(root[k], i))
    rows = [(i, t) for k, (i, t) in enumerate(rows) if least[root[k]] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    whole = whole_windows(items)
    rows = [(i, t) for i, t in rows if not has_whole_window(t, whole)]
    short = [(i, t) for i, t in items if len(words(t)) < 13]
    share = {x[0] for x in overlapping(rows, short) if x[-1]}
    return [(i, t) for i, t in rows if i not in share]


def test_run(spark, tables):
    found = corpus_pipeline.run(spark, tables).collect()
    left = brute_force(spark, tables)
    assert left
    assert collections.Counter(tuple(r)[:5] for r in found) == collections.Counter(pieces_of(left, 4096))
    assert len({r.sequence_id for r in found}) == -(-sum(r.length for r in found) // 4096)


def test_stages(spark, tables):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = table_of(spark, list(enumerate(TEXTS)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tables)
        assert after.columns == docs.columns
        assert stage(spark, docs.limit(0), tables).count() == 0
        assert after.join(docs, "doc_id", "left_anti").count() == 0


def test_registered(spark):
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
