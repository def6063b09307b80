"""Requirement evidence: joining topics, cues, rankings, blind samples, precision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqloom.contracts import ContractError, require, require_same_keys, require_unique
from reqloom.functions import numeric as N
from reqloom.functions import text as T
from reqloom.functions.plan import once
from reqloom.operators.ordering import numbered
from reqloom.operators.topics import hash_order
from reqloom.scratch import written

RANKINGS = ("topico", "lexical", "topico_lexical", "aleatoria")
TOP_RANKINGS = RANKINGS[:3]
LABELS = ("sim", "nao", "incerto")


def load_evidence(global_rows: DataFrame, local_rows: DataFrame, global_terms: DataFrame, local_terms: DataFrame, topics: Sequence[int], check: bool = True) -> DataFrame:
    """The selected topics' sentences with global and local weights, their product and the topics' terms.

    ``global_rows``: sent_id, post_id, sentence, context, product_category,
    topic_id, topic_weight. ``local_rows``: sent_id, post_id, sentence, context,
    product_category, global_topic_weight, global_topic_id, local_topic_id,
    local_topic_distribution (an array, or JSON of one). ``global_terms``:
    topic_id, top_terms. ``local_terms``: global_topic_id, topic_id, top_terms,
    one row for each of a topic's local topics.
    """
    if not topics or len(set(topics)) != len(topics):
        raise ContractError("the selected topics must be some, each once")
    selected = global_rows.where(F.col("topic_id").isin(list(topics)))
    terms = global_terms.select(F.col("topic_id").alias("of_topic"), F.col("top_terms").alias("global_top_terms"))
    selected = selected.join(terms, selected["topic_id"] == terms["of_topic"]).drop("of_topic")
    if local_rows.schema["local_topic_distribution"].dataType.simpleString() == "string":
        local_rows = local_rows.withColumn("local_topic_distribution", F.from_json("local_topic_distribution", "array<double>"))
    sizes = local_terms.groupBy(F.col("global_topic_id").alias("sized")).agg(F.count("*").cast("int").alias("k"))
    local = local_rows.join(F.broadcast(sizes), local_rows["global_topic_id"] == sizes["sized"], "left").drop("sized")  # a row a topic
    weight, sound = N.local_weight(F.col("local_topic_distribution"), F.col("local_topic_id"), F.col("k"))
    local = local.withColumn("local_topic_weight", weight).withColumn("sound", sound)
    names = local_terms.select(F.col("global_topic_id").alias("g"), F.col("topic_id").alias("l"), F.col("top_terms").alias("local_top_terms"))
    local = local.join(names, (local["global_topic_id"] == names["g"]) & (local["local_topic_id"] == names["l"]), "left").drop("g", "l")
    shared = ("post_id", "sentence", "context", "product_category")
    # texts are compared by digests, so that the join moves none of the right side's, and the left's only if they are asked for
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("string")))
    if check:
        local = local.withColumns({f"{c}_local": digest(c) for c in shared})
        selected = selected.withColumns({f"{c}_global": digest(c) for c in shared})
    right = selected.select("sent_id", *(f"{c}_global" for c in shared if check), F.col("topic_id").alias("topic_global"), F.col("topic_weight").alias("weight_global"), "global_top_terms")
    joined = local.join(right, "sent_id")
    if check:
        require_unique(global_rows, ["sent_id"], "global topics")
        require_unique(local_rows, ["sent_id"], "local topics")
        require_same_keys(selected.select("sent_id"), local_rows.select("sent_id"), ["sent_id"], "local and selected global sentences")
        missing = set(topics) - {r["topic_id"] for r in global_terms.where(F.col("topic_id").isin(list(topics))).collect()}
        if missing:
            raise ContractError(f"selected topics without terms: {sorted(missing)}")
        rules: Mapping[str, Column] = {
            "global weight within 0 and 1": F.col("weight_global").between(0, 1),
            "local distribution as its topic says": F.col("sound"),
            "same topic": F.col("global_topic_id") == F.col("topic_global"),
            "same weight": N.close_to(F.col("global_topic_weight"), F.col("weight_global")),
            **{f"same {c}": F.col(f"{c}_local").eqNullSafe(F.col(f"{c}_global")) for c in shared},
        }
        require(joined, rules, "evidence")
    kept = [c for c in local_rows.columns]
    return joined.select(*kept, "local_topic_weight", "local_top_terms", "global_top_terms", (F.col("global_topic_weight") * F.col("local_topic_weight")).alias("topic_score"))


def score_lexicon(rows: DataFrame, lexicon: Mapping[str, Sequence[str]] = T.LEXICON, column: str = "sentence") -> DataFrame:
    """Adds lex_hit, lex_n (distinct patterns that occur) and intent_hint."""
    counted = once(rows, "lex_counts", F.struct(*(n.alias(kind) for kind, n in T.lexicon_counts(F.col(column), lexicon).items())))
    counts = {kind: F.col(f"lex_counts.`{kind}`") for kind in lexicon}
    total = sum(counts.values(), F.lit(0))
    return counted.withColumns({"lex_hit": total > 0, "lex_n": total.cast("int"), "intent_hint": T.lexicon_hint(counts)}).drop("lex_counts")


def signals(rows: DataFrame, *keys: str) -> DataFrame:
    """n, n_lex_hit and frac_lex_hit by keys; a null key is a group."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("lex_hit").alias("n_lex_hit"), F.avg(F.col("lex_hit").cast("int")).alias("frac_lex_hit"))


def _orders(seed: int) -> dict[str, list[Column]]:
    tie = [hash_order(seed, "sent_id"), F.col("sent_id")]
    cue = [F.desc("lex_hit"), F.desc("lex_n")]
    topic = [F.desc_nulls_last("topic_score")]
    return {"topico": [*topic, *tie], "lexical": [*cue, *tie], "topico_lexical": [*cue, *topic, *tie], "aleatoria": tie}


def rankings(evidence: DataFrame, seed: int = 42, check: bool = True) -> DataFrame:
    """(ranking, rank, sent_id): all sentences in the four orders, ties by a seeded hash.

    A full ranking is a total order, numbered without gathering it: rows are
    range-partitioned by the order, numbered in each partition, and moved by the
    sizes of the partitions before.
    """
    if check:
        require_unique(evidence, ["sent_id"], "evidence")
    rows = evidence.select("sent_id", "lex_hit", "lex_n", "topic_score")
    out = None
    for name, order in _orders(seed).items():
        ranked = numbered(rows, order, "rank").select(F.lit(name).alias("ranking"), "rank", "sent_id")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def top_of_rankings(evidence: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(ranking, rank, sent_id) up to rank ``k`` in the three top rankings: bounded sorts, no full ranking."""
    rows = evidence.select("sent_id", "lex_hit", "lex_n", "topic_score")
    out = None
    for name in TOP_RANKINGS:
        order = _orders(seed)[name]
        best = rows.orderBy(*order).limit(k)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.lit(name).alias("ranking"), "rank", "sent_id")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def blind_sample(evidence: DataFrame, ranked: DataFrame, top_k: int = 50, n_random: int = 100, seed: int = 42, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(blind, origin): what annotators see, and where each row comes from.

    The first ``top_k`` of the three top rankings, each sentence once under the
    first ranking that has it, and ``n_random`` of the random ranking that none
    of them has; shuffled by a seeded hash and numbered from 1.
    """
    if top_k < 1 or n_random < 1:
        raise ContractError("sample sizes must be positive")
    priority = F.create_map(*(F.lit(x) for i, name in enumerate(TOP_RANKINGS) for x in (name, i)))
    top = ranked.where(F.col("ranking").isin(*TOP_RANKINGS) & (F.col("rank") <= top_k))
    chosen = top.groupBy("sent_id").agg(F.min_by("ranking", F.element_at(priority, F.col("ranking"))).alias("selection_source"))
    rest = ranked.where("ranking = 'aleatoria'").join(F.broadcast(chosen.select("sent_id")), "sent_id", "left_anti")  # at most 3 top_k rows
    drawn = rest.orderBy("rank").limit(n_random).select("sent_id", F.lit("aleatoria").alias("selection_source"))
    selected = written(chosen.unionByName(drawn), "selected")
    if check:
        counts = {r["ranking"]: r["n"] for r in top.groupBy("ranking").agg(F.count("*").alias("n")).collect()}
        short = [name for name in TOP_RANKINGS if counts.get(name, 0) != top_k]
        if short:
            raise ContractError(f"rankings with fewer than {top_k} sentences: {short}")
        if selected.where("selection_source = 'aleatoria'").count() != n_random:
            raise ContractError("too few sentences for the random part")
    review = selected.withColumn("review_id", F.row_number().over(Window.orderBy(hash_order(seed + 1, "sent_id"), "sent_id")))
    detail = evidence.join(F.broadcast(review), "sent_id")  # 3 top_k + n_random rows at most
    nothing = {c: F.lit(None).cast("string") for c in ("requirement_candidate", "aspect_ref", "review_notes")}
    blind = detail.select("review_id", "sentence", "context", "product_category").withColumns(nothing)
    ranks = ranked.join(F.broadcast(review.select("sent_id")), "sent_id", "left_semi").groupBy("sent_id").pivot("ranking", sorted(RANKINGS)).agg(F.max("rank"))
    ranks = ranks.withColumnsRenamed({name: f"rank_{name}" for name in RANKINGS})
    origin = detail.drop("sentence", "context").join(ranks, "sent_id")
    rest_columns = [c for c in evidence.columns if c not in ("sent_id", "sentence", "context")]
    return blind, origin.select("review_id", "sent_id", *rest_columns, *(f"rank_{r}" for r in sorted(RANKINGS)), "selection_source")


def _labelled(annotations: DataFrame, origin: DataFrame) -> DataFrame:
    return origin.join(annotations.select("review_id", "requirement_candidate"), "review_id", "left")


def precision(annotations: DataFrame, origin: DataFrame, top_k: int = 50, n_random: int = 100, check: bool = True) -> DataFrame:
    """(ranking, n, positives, precision, ci_low, ci_high) of the four rankings, in one aggregation.

    The random ranking's items are the random part's first ``n_random`` by review_id.
    """
    labelled = _labelled(annotations, origin)
    if check:
        require_unique(annotations, ["review_id"], "annotations")
        require_unique(origin, ["review_id"], "origin")
        require(labelled, {"a label for each item": F.col("requirement_candidate").isin(*LABELS)}, "annotations")
    drawn = F.row_number().over(Window.partitionBy("selection_source").orderBy("review_id"))  # the review sample only
    numbered_rows = labelled.withColumn("drawn", drawn)
    chosen = {name: F.col(f"rank_{name}") <= top_k for name in TOP_RANKINGS}
    chosen["aleatoria"] = (F.col("selection_source") == "aleatoria") & (F.col("drawn") <= n_random)
    sizes = {name: n_random if name == "aleatoria" else top_k for name in RANKINGS}
    each = numbered_rows.select("requirement_candidate", F.explode(F.array(*(F.when(chosen[name], F.lit(name)) for name in RANKINGS))).alias("ranking")).where("ranking is not null")
    counted = each.groupBy("ranking").agg(F.count("*").alias("n"), F.count_if(F.col("requirement_candidate") == "sim").alias("positives"))
    if check:
        expected = F.element_at(F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)), F.col("ranking"))
        require(counted, {"as many items as the ranking's k": F.col("n") == expected}, "annotated sample")
    p, low, high = N.wilson(F.col("positives"), F.col("n"))
    return counted.select("ranking", "n", "positives", p.alias("precision"), low.alias("ci_low"), high.alias("ci_high"))


def confirmed_by_topic(annotations: DataFrame, origin: DataFrame) -> DataFrame:
    """n_reviewed and n_sim by topic (and by topic names, where there are some)."""
    keys = ["global_topic_id", "local_topic_id", *(c for c in ("global_topic_name", "local_topic_name") if c in origin.columns)]
    return _labelled(annotations, origin).groupBy(*keys).agg(F.count("*").alias("n_reviewed"), F.count_if(F.col("requirement_candidate") == "sim").alias("n_sim"))
