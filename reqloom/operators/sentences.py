"""Documents to sentences with their neighbours, and windows over conversations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqloom.contracts import ContractError, require_columns, require_unique
from reqloom.functions import text as T
from reqloom.scratch import written
from reqloom.sources import schemas

#: A batch function: texts in, restored texts out.
Punctuator = Callable[[pd.Series], pd.Series]
#: The source whose transcripts come without punctuation.
CAPTIONS = "legenda"
_MARKS = re.compile(r"(?<!\d)[.,;:!?]|[.,;:!?](?!\d)")


def windowed_punctuation(label: Callable[[list[str]], list[str]], size: int = 230, step: int = 225, overlap: bool = False) -> Punctuator:
    """A punctuator from a model that labels words in windows of ``size``.

    ``label`` gives each word's closing mark or "". Marks in the text (but those
    between digits) are dropped first. Words that two windows share are taken
    from the first; ``overlap`` keeps both, as some exports have it.
    """

    def restore(text: str) -> str:
        words = _MARKS.sub("", text).split()
        out: list[str] = []
        for at in range(0, len(words), step):
            window = words[at : at + size]
            marked = [w + m for w, m in zip(window, label(window), strict=True)]
            out += marked if overlap or not at else marked[size - step :]
            if not overlap and at + size >= len(words):
                break
        return " ".join(out)

    return lambda texts: texts.map(restore)


def punctuate(docs: DataFrame, punctuator: Punctuator | None, source: str = CAPTIONS) -> DataFrame:
    """Adds ``message_punctuated`` and ``punctuation_restored``: captions restored by the model, other texts as they are."""
    captions = F.coalesce(F.col("source") == source, F.lit(False))
    if punctuator is None:
        if docs.where(captions).limit(1).count():
            raise ContractError(f"documents of source {source} need a punctuation model")
        return docs.withColumns({"message_punctuated": F.col("message"), "punctuation_restored": F.lit(False)})
    schema = f"{docs._jdf.schema().toDDL()}, message_punctuated STRING"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(message_punctuated=punctuator(batch["message"]) if len(batch) else batch["message"])

    restored = docs.where(captions).mapInPandas(run, schema).withColumn("punctuation_restored", F.lit(True))
    plain = docs.where(~captions).withColumns({"message_punctuated": F.col("message"), "punctuation_restored": F.lit(False)})
    return plain.unionByName(restored)


def _key(*columns: str | Column) -> tuple[Column, Column]:
    """A key of 128 bits as two numbers, which aggregates keep without objects; nulls have one too."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def split_sentences(docs: DataFrame, window: int = 1, text: str = "message_punctuated", singles: str | None = None, contexts: bool = True) -> DataFrame:
    """A row a sentence: ``sent_idx``, ``sentence`` and ``context`` (up to ``window`` neighbours on either side).

    Neighbours are taken from the document's own array of sentences, so there
    is no shuffle and a context never leaves its document. ``singles``: a column
    with the places of sentences that occur once; then ``is_dup_exact`` tells the
    others. Without ``contexts`` there is no such column.
    """
    rows = docs.withColumn("all_sentences", T.sentences(T.collapse_space(F.col(text))))
    held = F.col("all_sentences")

    def piece(i: Column, repeated: bool | None = None) -> Column:
        fields = [i.alias("sent_idx"), F.get(held, i).alias("sentence")]
        if contexts:
            fields.append(F.array_join(F.slice(held, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)) + 1 + window), " ").alias("context"))
        return F.struct(*fields, *([] if repeated is None else [F.lit(repeated).alias("is_dup_exact")]))

    if singles is None:
        pieces = F.transform(held, lambda _, i: piece(i))
    else:
        once = F.coalesce(singles, F.array().cast("array<int>"))
        places = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.size(held) - 1))
        pieces = F.concat(F.transform(once, lambda i: piece(i, False)), F.transform(F.array_except(places, once), lambda i: piece(i, True)))
        rows = rows.where(F.size(held) > 0)
    return rows.withColumn("piece", F.explode(pieces)).select("*", "piece.*").drop("piece", "all_sentences", *([singles] if singles else []))


def single_places(docs: DataFrame, keys: list[str], text: str = "message_punctuated") -> DataFrame:
    """(keys, singles): for each document the places of its sentences that occur nowhere else in the whole table.

    One aggregation by the sentence's key finds them: a sentence that is counted
    once has one document and one place, so their minima are these. Counting is
    partially aggregated, so no task gathers a sentence's copies, and texts stay
    where they are.
    """
    each = docs.select(*keys, F.posexplode(T.sentences(T.collapse_space(F.col(text)))).alias("at", "sentence"))
    a, b = _key("sentence")
    counted = each.groupBy(a.alias("key_a"), b.alias("key_b")).agg(F.count("*").alias("times"), *(F.min(c).alias(c) for c in (*keys, "at")))
    return counted.where("times = 1").groupBy(*keys).agg(F.collect_list("at").alias("singles"))


def build_sentences(docs: DataFrame, punctuator: Punctuator | None = None, window: int = 1, least_words: int = 5, check: bool = True, contexts: bool = True) -> DataFrame:
    """The sentence table. ``docs`` needs post_id (unique), message and source; it is read twice, so hand in a stored table.

    Which sentences are repeated is found out at once and stored as places in
    their documents; the sentences themselves are only split, not joined.
    Without ``contexts`` their column is left out.
    """
    require_columns(docs, ["post_id", "message", "source"])
    if check:
        require_unique(docs, ["post_id"], "documents")
    keys = ["of_post", "of_message"]
    known = punctuate(docs, punctuator).withColumns({"of_post": F.xxhash64("post_id"), "of_message": F.xxhash64("message")})
    singles = written(single_places(known, keys), "single-sentences")
    rows = split_sentences(known.join(singles, keys, "left").drop(*keys), window, singles="singles", contexts=contexts)
    n_words = F.size(F.split("sentence", " "))  # sentences have single spaces
    rows = rows.withColumns({"sent_id": F.concat_ws("_", "post_id", "sent_idx"), "message_raw": F.col("message"), "n_words": n_words}).withColumn("is_fragment", F.col("n_words") < least_words)
    out = schemas.conform(rows, schemas.SENTENCE)
    return out if contexts else out.drop("context")


def usable(sentences: DataFrame, least_words: int = 5) -> DataFrame:
    """Sentences for topic models: no fragments, no repeats, nothing missing. ``context`` may be left out of the table."""
    kept = sentences.where(~F.col("is_fragment") & ~F.col("is_dup_exact") & (F.col("n_words") >= least_words))
    return kept.dropna(subset=[c for c in ("sent_id", "post_id", "sentence", "context", "n_words") if c in sentences.columns])


def conversation_context(turns: DataFrame, window: int = 1) -> DataFrame:
    """(conv_id, turn, context): each turn's text with its neighbours', in turn order."""
    near = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-window, window)
    return turns.select("conv_id", "turn", F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(near), " ").alias("context"))
