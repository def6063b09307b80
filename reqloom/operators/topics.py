"""Topic assignments, examples, diversity, coherence, and the choice of how many topics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions import numeric as N
from reqloom.functions import text as T
from reqloom.functions.plan import once
from reqloom.operators import nmf, terms
from reqloom.scratch import written
from reqloom.shipping import ship


def assign(weighed: DataFrame, column: str = "weights") -> DataFrame:
    """Adds ``topic_id`` (the first heaviest, -1 without weight) and ``topic_weight``."""
    return once(weighed, "topic_id", N.dominant(F.col(column))).withColumn("topic_weight", F.when(F.col("topic_id") >= 0, F.get(F.col(column), F.col("topic_id"))).otherwise(F.lit(0.0)))


def hash_order(seed: int, key: str) -> Column:
    """A reproducible shuffle's sort key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def examples(assigned: DataFrame, n: int = 5, by: str = "weight", seed: int = 42, topic: str = "topic_id", weight: str = "topic_weight") -> DataFrame:
    """Up to ``n`` sentences a topic from distinct documents: the heaviest, or hash-ordered ones (``by="random"``).

    The best sentence of each (topic, document) is an aggregate; only these are ranked.
    """
    order = F.struct((-F.col(weight)).alias("o"), F.col("sent_id")) if by == "weight" else F.struct(F.md5(F.concat(F.lit(seed).cast("string"), F.lit("+"), F.col(topic).cast("string"), F.lit(":"), F.col("sent_id"))).alias("o"), F.col("sent_id"))
    kept = assigned.where(F.col(topic) >= 0)
    best = kept.groupBy(topic, "post_id").agg(F.min(F.struct(order.alias("rank"), F.col(weight).alias("weight"))).alias("best"))
    place = Window.partitionBy(topic).orderBy("best.rank")
    ranked = best.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)
    return ranked.select(topic, "place", "post_id", F.col("best.rank.sent_id").alias("sent_id"), F.col("best.weight").alias("weight"))


def sizes(assigned: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(topic_id, n_sentences, n_videos, pct_frases): a topic's sentences, its documents, and its share of all sentences in per cent.

    Shares are of all rows, those of topic -1 too, which has no row itself.
    ``topics`` (topic_id): also those that no sentence has.
    """
    total = assigned.agg(F.count("*").alias("of_all"))
    each = assigned.where("topic_id >= 0").groupBy("topic_id").agg(F.count("*").alias("n_sentences"), F.countDistinct("post_id").alias("n_videos"))
    if topics is not None:
        each = topics.select("topic_id").join(each, "topic_id", "left").fillna(0, ["n_sentences", "n_videos"])
    shares = each.crossJoin(F.broadcast(total))  # one row
    return shares.select("topic_id", "n_sentences", "n_videos", F.when(F.col("of_all") > 0, F.round(100 * F.col("n_sentences") / F.col("of_all"), 1)).alias("pct_frases"))


def top_terms(weights: DataFrame, n: int = 20) -> DataFrame:
    """(topic_id, top_terms): the heaviest terms of (topic_id, term, weight), joined by commas; ties by term."""
    place = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term")
    ranked = weights.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)
    listed = ranked.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    return listed.select("topic_id", F.array_join(F.transform("t", lambda t: t["term"]), ", ").alias("top_terms"))


def diversity(words: DataFrame, top: int = 10) -> DataFrame:
    """(diversity): distinct words over ``top`` times the topics of (topic_id, words).

    Topic -1 and topics with fewer than two words don't count; 0 if none does.
    """
    real = F.filter(F.slice("words", 1, top), lambda w: F.trim(w) != "")
    valid = words.where("topic_id <> -1").select("topic_id", real.alias("w")).where(F.size("w") >= 2)
    each = valid.select("topic_id", F.explode("w").alias("word"))
    return each.agg(F.countDistinct("word").alias("kinds"), F.countDistinct("topic_id").alias("topics")).select(F.when(F.col("topics") > 0, F.col("kinds") / (F.col("topics") * top)).otherwise(F.lit(0.0)).alias("diversity"))


def _pairs_in_windows(flat: np.ndarray, sizes: np.ndarray, size: int, n_words: int) -> tuple[np.ndarray, int]:
    """(how many windows hold words i and j, how many windows there are) for texts of ``sizes`` numbers laid end to end, -1 for unlisted words."""
    sizes = sizes[sizes > 0]
    room = np.maximum(sizes, size)  # a short text is filled up to one window
    ends = np.cumsum(room)
    laid = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
    laid[np.arange(len(flat)) + np.repeat(ends - room - (np.cumsum(sizes) - sizes), sizes)] = flat
    windows = room - size + 1
    starts = np.arange(int(windows.sum())) + np.repeat(ends - room - (np.cumsum(windows) - windows), windows)
    total = np.zeros((n_words, n_words), np.int64)
    step = max(256, (4 << 20) // max(1, n_words * size))
    for at in range(0, len(starts), step):
        mine = starts[at : at + step]
        part = laid[mine[0] : mine[-1] + size]
        seen = np.zeros((len(part), n_words), bool)
        where = np.flatnonzero(part >= 0)
        seen[where, part[where]] = True
        wide = 1  # places that a row of ``seen`` covers: doubled, then brought to ``size`` by rows that overlap
        while wide < size:
            further = min(wide, size - wide)
            seen = seen[: len(seen) - further] | seen[further:]
            wide += further
        held = seen[mine - mine[0]].astype(np.float32)  # counts of a step stay far below 2^24
        total += (held.T @ held).astype(np.int64)
    return total, len(starts)


def grouped_window_counts(texts: DataFrame, words: DataFrame, size: int = 10) -> DataFrame:
    """(part, a, b, n): as :func:`window_counts` for each part of (part, tokens) with its own (part, word), stored; a part's windows are in a row without words.

    One pass over the texts. Spark has no sliding windows within a row but by
    lambdas that are interpreted, so they are counted in Arrow batches.
    """
    ship(texts.sparkSession)
    listed: dict[int, list[str]] = {}
    for r in words.select("part", "word").distinct().collect():  # topics times top words
        listed.setdefault(r["part"], []).append(r["word"])
    listed = {part: sorted(own) for part, own in listed.items()}
    schema = pa.schema([("part", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])

    def run(batches):
        counts = {part: [np.zeros((len(own), len(own)), np.int64), 0] for part, own in listed.items()}
        for batch in batches:
            of = batch.column("part").to_numpy(zero_copy_only=False)
            for part in np.unique(of):
                mine = batch.column("tokens") if (of == part).all() else batch.column("tokens").filter(pa.array(of == part))
                own = listed.get(int(part), [])
                flat = pc.fill_null(pc.index_in(mine.flatten(), value_set=pa.array(own, pa.string())), -1).to_numpy(zero_copy_only=False)
                pairs, windows = _pairs_in_windows(flat, pc.fill_null(pc.list_value_length(mine), 0).to_numpy(zero_copy_only=False), size, len(own))
                held = counts.setdefault(int(part), [np.zeros((len(own), len(own)), np.int64), 0])
                held[0] += pairs
                held[1] += windows
        for part, (pairs, windows) in counts.items():
            own = [*listed.get(part, []), None]
            i, j = np.nonzero(np.triu(pairs))
            yield pa.RecordBatch.from_pydict({"part": [part] * (len(i) + 1), "a": [*(own[x] for x in i), None], "b": [*(own[x] for x in j), None], "n": [*pairs[i, j].tolist(), windows]}, schema=schema)

    found = texts.select("part", "tokens").mapInArrow(run, "part int, a string, b string, n long")
    return written(found.groupBy("part", "a", "b").agg(F.sum("n").alias("n")), "window-counts")


def window_counts(texts: DataFrame, words: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """How many sliding windows of ``size`` tokens hold a word or two: ((a, b, n) with a <= b, (windows)).

    ``texts``: (tokens array); a text shorter than the window is one window. ``words``: (word), a bounded list.
    """
    one = F.lit(0).alias("part")
    return _of_part(grouped_window_counts(texts.select(one, "tokens"), words.select(one, "word"), size), 0)


def _of_part(counts: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    mine = counts.where(F.col("part") == part)
    return mine.where("a is not null").select("a", "b", "n"), mine.where("a is null").agg(F.sum("n").alias("windows"))


def npmi(counts: DataFrame, windows: DataFrame, words: DataFrame, top: int = 10, epsilon: float = 1e-12) -> DataFrame:
    """(topic_id, npmi): the mean over pairs of each topic's ``top`` words (topic_id, words)."""
    placed = words.select("topic_id", F.posexplode(F.slice("words", 1, top)).alias("i", "word"))
    left = placed.select("topic_id", F.col("i"), F.col("word").alias("x"))
    right = placed.select(F.col("topic_id").alias("t2"), F.col("i").alias("j"), F.col("word").alias("y"))
    pairs = left.join(right, (F.col("topic_id") == F.col("t2")) & (F.col("i") < F.col("j"))).select("topic_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    single = counts.where("a = b").select(F.col("a").alias("word"), F.col("n").alias("own"))
    total = windows.select(F.col("windows").cast("double").alias("total"))
    joined = pairs.join(counts.select("a", "b", "n"), ["a", "b"], "left")
    joined = joined.join(single.select(F.col("word").alias("a"), F.col("own").alias("na")), "a", "left").join(single.select(F.col("word").alias("b"), F.col("own").alias("nb")), "b", "left")
    held = joined.crossJoin(F.broadcast(total))  # one row
    both = F.coalesce("n", F.lit(0)) / F.col("total")
    apart = (F.coalesce("na", F.lit(0)) / F.col("total")) * (F.coalesce("nb", F.lit(0)) / F.col("total"))
    value = F.when(apart > 0, F.log((both + epsilon) / apart) / -F.log(both + epsilon)).otherwise(F.lit(0.0))
    return held.groupBy("topic_id").agg(F.avg(value).alias("npmi"))


def c_v(counts: DataFrame, windows: DataFrame, words: dict[int, list[str]], top: int = 10, epsilon: float = 1e-12) -> dict[int, float]:
    """C_v of each topic (Roeder, Both and Hinneburg 2015) from counts of windows of 110 tokens.

    Each word's NPMI with its topic's words is a vector; the mean cosine with the sum of all vectors is the coherence.
    """
    total = windows.first()[0] or 0
    n = {(r["a"], r["b"]): r["n"] for r in counts.collect()}  # pairs of listed words only
    out = {}
    for topic, listed in words.items():
        w = listed[:top]
        own = [n.get((x, x), 0) / total if total else 0 for x in w]
        m = np.zeros((len(w), len(w)))
        for i, x in enumerate(w):
            for j, y in enumerate(w):
                both = n.get((min(x, y), max(x, y)), 0) / total if total else 0
                if own[i] > 0 and own[j] > 0:
                    m[i, j] = np.log((both + epsilon) / (own[i] * own[j])) / -np.log(both + epsilon) if both + epsilon < 1 else 1.0
        whole = m.sum(axis=0)
        norms = np.linalg.norm(m, axis=1) * np.linalg.norm(whole)
        out[topic] = float(np.mean(np.divide(m @ whole, norms, out=np.zeros(len(w)), where=norms > 0))) if len(w) else 0.0
    return out


def pareto(grid: DataFrame, x: str = "npmi", y: str = "diversity") -> DataFrame:
    """The rows that no other is at least as good as in both and better in one. A grid is a handful of rows."""
    other = grid.select(F.col(x).alias("ox"), F.col(y).alias("oy"))
    better = (F.col("ox") >= F.col(x)) & (F.col("oy") >= F.col(y)) & ((F.col("ox") > F.col(x)) | (F.col("oy") > F.col(y)))
    return grid.join(F.broadcast(other), better, "left_anti")


def choose_k(grid: DataFrame) -> DataFrame:
    """The one row of the front with the highest coherence, then diversity, then the least k."""
    return pareto(grid).orderBy(F.desc("npmi"), F.desc("diversity"), "k").limit(1)


def global_topics(sentences: DataFrame, k: int = 20, seed: int = 42, text: str = "sentence", min_df: int = 20, max_df: float = 0.5, max_features: int = 12_000, rounds: int = 300) -> tuple[DataFrame, DataFrame, list[float]]:
    """(sentences with topic_id, topic_weight and weights; (topic_id, words, shares); losses) of the whole table, which is read several times.

    Sentences without a term of the vocabulary have topic -1.
    """
    rows = terms.term_rows(sentences, text=text)
    n = sentences.count()
    vocab = terms.vocabulary(rows, n, min_df, max_df, max_features).persist()
    listed = [r["term"] for r in vocab.orderBy("term_id").collect()]  # at most max_features
    matrix = nmf.as_rows(terms.tfidf(rows, vocab, n), "sent_id").persist()
    h, losses = nmf.fit(matrix, len(listed), k, seed, rounds)
    spark = sentences.sparkSession
    topics = spark.createDataFrame([(t, w, s) for t, w, s in nmf.topic_terms(h, listed, 20)], "topic_id int, words array<string>, shares array<double>")
    weighed = nmf.weights(matrix, h)
    none = F.array_repeat(F.lit(0.0), k)
    out = sentences.join(weighed, "sent_id", "left").withColumn("weights", F.coalesce("weights", none))
    return assign(out), topics, losses


def local_grid(
    assigned: DataFrame, ks: Sequence[int] = (2, 3, 4, 5, 6), seed: int = 42, no_below: int = 5, no_above: float = 0.5, rounds: int = 60, top: int = 10, small: int = nmf.SMALL,
) -> DataFrame:
    """(global_topic_id, k, words_of, h): a factorisation of each topic's bags for each k, all in parallel.

    ``assigned``: (sent_id, global_topic_id, sentence). One task fits one (topic, k);
    a topic with more than ``small`` counts is fitted spread over its rows instead.
    """
    spark = assigned.sparkSession
    sizes = assigned.groupBy("global_topic_id").agg(F.count("*").alias("n_rows"))
    df = terms.lemma_rows(assigned, ("sent_id", "global_topic_id")).groupBy("global_topic_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    kept = df.join(F.broadcast(sizes), "global_topic_id").where((F.col("df") >= no_below) & (F.col("df") <= no_above * F.col("n_rows")))  # a row a topic
    listed: dict[int, list[str]] = {}
    per_topic: dict[int, int] = {}
    for r in kept.select("global_topic_id", "term", "df").collect():  # the driver keeps H, topics times these terms
        listed.setdefault(r["global_topic_id"], []).append(r["term"])
        per_topic[r["global_topic_id"]] = per_topic.get(r["global_topic_id"], 0) + r["df"]
    listed = {topic: sorted(own) for topic, own in listed.items()}
    schema = "global_topic_id int, k int, terms array<string>, h binary"
    if not listed:
        return spark.createDataFrame([], schema)
    matrix = bag_matrix(assigned.where(F.col("global_topic_id").isin(list(listed))), listed).where("size(idx) > 0").persist()
    few = [t for t, n in per_topic.items() if n <= small]
    many = sorted(set(per_topic) - set(few))
    widths = {topic: len(own) for topic, own in listed.items()}

    def fit_one(group: pa.Table) -> pa.Table:
        part, k = group.column("part")[0].as_py(), group.column("k")[0].as_py()
        h, _ = nmf.fit_local(nmf.sparse(group.sort_by("sent_id"), widths[part]), k, seed, rounds)
        return pa.table({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "h": pa.array([h.tobytes()], pa.binary())})

    made = []
    if few:
        each_k = matrix.where(F.col("part").isin(few)).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
        done = each_k.groupBy("part", "k").applyInArrow(fit_one, "part int, k int, h binary").collect()  # a model for each topic and k
        made += [(r["part"], r["k"], listed[r["part"]], r["h"]) for r in done]
    if many:
        done = nmf.fit_parts(matrix.where(F.col("part").isin(many)), {t: widths[t] for t in many}, ks, seed, rounds)
        made += [(topic, k, listed[topic], bytearray(h.tobytes())) for (topic, k), (h, _) in done.items()]
    matrix.unpersist()
    return spark.createDataFrame(made, schema)


def bag_matrix(assigned: DataFrame, listed: dict[int, list[str]]) -> DataFrame:
    """(part, sent_id, idx, val): each sentence's lemmas by their places in its topic's list, with counts; nothing is shuffled."""
    ship(assigned.sparkSession)
    held = assigned.sparkSession.sparkContext.broadcast(listed)
    stops = frozenset(terms.STOP_WORDS)

    def run(batches):
        at = {topic: {t: i for i, t in enumerate(own)} for topic, own in held.value.items()}
        for batch in batches:
            topics = batch.column("part").to_pylist()
            idx, val = [], []
            for topic, words in zip(topics, terms.lemmas_of(batch.column("tokens").to_pylist(), stops), strict=True):
                known = at[topic]
                bag = sorted(Counter(i for w in words if (i := known.get(w)) is not None).items())
                idx.append([i for i, _ in bag])
                val.append([float(n) for _, n in bag])
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("sent_id"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float64()))], ["part", "sent_id", "idx", "val"])

    rows = assigned.select(F.col("global_topic_id").cast("int").alias("part"), "sent_id", T.tokens(F.col("sentence")).alias("tokens"))
    return rows.mapInArrow(run, "part int, sent_id string, idx array<int>, val array<double>")


def grid_words(fitted: DataFrame, top: int = 10) -> DataFrame:
    """(global_topic_id, k, topic_id, words) of fitted grids."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                h = np.frombuffer(r.h).reshape(r.k, len(r.terms))
                rows += [(r.global_topic_id, r.k, t, w) for t, w, _ in nmf.topic_terms(h, list(r.terms), top)]
            yield pd.DataFrame(rows, columns=["global_topic_id", "k", "topic_id", "words"])

    return fitted.mapInPandas(run, "global_topic_id int, k int, topic_id int, words array<string>")


def score_grid(assigned: DataFrame, fitted: DataFrame, top: int = 10, window: int = 10) -> DataFrame:
    """(global_topic_id, k, npmi, diversity) of each factorisation; coherence is counted in the topic's own sentences."""
    words = grid_words(fitted, top).persist()
    as_lemmas = F.pandas_udf(lambda lists: pd.Series(lemma_lists(lists), index=lists.index, dtype=object), "array<string>")
    parts = sorted(r[0] for r in words.select("global_topic_id").distinct().collect())
    texts = assigned.where(F.col("global_topic_id").isin(parts)).select(F.col("global_topic_id").cast("int").alias("part"), as_lemmas(T.tokens(F.col("sentence"))).alias("tokens"))
    every = grouped_window_counts(texts, words.select(F.col("global_topic_id").alias("part"), F.explode("words").alias("word")), window) if parts else None
    out = None
    for topic in parts:
        mine = words.where(F.col("global_topic_id") == topic)
        keyed = mine.select((F.col("k") * 1000 + F.col("topic_id")).alias("topic_id"), "words")
        coherent = npmi(*_of_part(every, topic), keyed, top).groupBy(F.floor(F.col("topic_id") / 1000).cast("int").alias("k")).agg(F.avg("npmi").alias("npmi"))
        varied = mine.select("k", "topic_id", F.explode("words").alias("word")).groupBy("k").agg((F.countDistinct("word") / (F.countDistinct("topic_id") * top)).alias("diversity"))
        # topics of a single word have no pairs, so no coherence
        scored = varied.join(coherent, "k", "left").select(F.lit(topic).alias("global_topic_id"), "k", F.coalesce("npmi", F.lit(0.0)).alias("npmi"), "diversity")
        out = scored if out is None else out.unionByName(scored)
    spark: SparkSession = assigned.sparkSession
    return out if out is not None else spark.createDataFrame([], "global_topic_id int, k int, npmi double, diversity double")


def lemma_lists(lists) -> list[list[str]]:
    """Each list's words as lemmas, all of them; a word's lemma is made once."""
    known: dict[str, str] = {}
    return [[known[w] if w in known else known.setdefault(w, terms.lemma(w)) for w in words] for words in lists]


def local_topics(assigned: DataFrame, fitted: DataFrame, chosen: DataFrame) -> DataFrame:
    """(sent_id, global_topic_id, k, local_topic_id, local_topic_distribution) by the chosen k of each topic.

    A sentence without a term of its topic's dictionary has local topic -1 and no weight anywhere.
    """
    held = fitted.join(chosen.select("global_topic_id", "k"), ["global_topic_id", "k"]).collect()  # a model a topic
    models = {r["global_topic_id"]: (r["k"], np.frombuffer(bytes(r["h"])).reshape(r["k"], len(r["terms"]))) for r in held}
    model = assigned.sparkSession.sparkContext.broadcast(models)
    matrix = bag_matrix(assigned.where(F.col("global_topic_id").isin(list(models))), {r["global_topic_id"]: r["terms"] for r in held})

    def run(batches):
        for batch in batches:
            of = batch.column("part").to_numpy(zero_copy_only=False)
            for topic in np.unique(of):
                k, h = model.value[int(topic)]
                mine = batch.filter(pa.array(of == topic))
                w = nmf.shares(nmf.solve_weights(nmf.sparse(mine, h.shape[1]), h, 30))
                best = np.where(w.sum(axis=1) > 0, w.argmax(axis=1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [mine.column("sent_id"), mine.column("part"), pa.array(np.full(len(w), k, np.int32)), pa.array(best), nmf.as_lists(w)],
                    ["sent_id", "global_topic_id", "k", "local_topic_id", "local_topic_distribution"],
                )

    return matrix.mapInArrow(run, "sent_id string, global_topic_id int, k int, local_topic_id int, local_topic_distribution array<double>")
