"""Terms, vocabularies, TF-IDF and bags of words as long tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqloom.functions import text as T
from reqloom.functions.plan import let

STOP_WORDS = (*T.STOP_WORDS, *T.EXTRA_STOP_WORDS)
#: Words whose lemma no rule makes.
IRREGULAR: Mapping[str, str] = {"children": "child", "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth", "mice": "mouse", "people": "person", "better": "good", "best": "good", "worse": "bad", "worst": "bad", "went": "go", "gone": "go", "made": "make", "said": "say", "bought": "buy", "thought": "think", "felt": "feel", "kept": "keep", "left": "leave", "broke": "break", "broken": "break"}


def lemma(word: str, irregular: Mapping[str, str] = IRREGULAR) -> str:
    """A rule lemma of a lower-case English word: plurals, -ing and -ed are undone."""
    if word in irregular:
        return irregular[word]
    for end, put in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x")):
        if word.endswith(end) and len(word) > len(end) + 1:
            return word[: -len(end)] + put
    if word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 3:
        return word[:-1]
    for end in ("ing", "ed"):
        stem = word[: -len(end)]
        if word.endswith(end) and len(stem) > 2 and any(c in "aeiouy" for c in stem):
            if len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if stem[-1] in "cgvz" or (stem[-1] == "s" and stem[-2] in "aeiou") else stem
    return word


def term_rows(rows: DataFrame, key: str = "sent_id", text: str = "sentence", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(key, term, tf) of each row's words; keys are unique, so a row counts its own words and nothing is shuffled."""
    return _counted(rows, key, T.tokens(F.col(text), stop_words))


def _counted(rows: DataFrame, key: str | Sequence[str], words: Column) -> DataFrame:
    """(key, term, tf) of an array of words: in the sorted array a word's count is the way to the next one's first place."""
    counts = lambda held, kinds, first: F.transform(kinds, lambda t, i: F.struct(t.alias("term"), (F.coalesce(F.get(first, i + 1), F.size(held) + 1) - F.get(first, i)).cast("bigint").alias("tf")))
    placed = lambda held, kinds: let(F.transform(kinds, lambda t: F.array_position(held, t)), lambda first: counts(held, kinds, first))
    each = let(F.sort_array(words), lambda held: let(F.array_distinct(held), lambda kinds: placed(held, kinds)))
    keys = [key] if isinstance(key, str) else list(key)
    return rows.select(*keys, F.explode(each).alias("t")).select(*keys, "t.term", "t.tf")


def lemmas_of(lists: Iterable[Sequence[str]], stops: frozenset[str], lemmatize: Callable[[str], str] = lemma) -> list[list[str]]:
    """Each list's lemmas of more than two letters; stop words are dropped before and after. A word's lemma is made once."""
    known: dict[str, str | None] = {}

    def kept(word: str) -> str | None:
        if word not in known:
            made = None if word in stops else lemmatize(word)
            known[word] = made if made is not None and len(made) > 2 and made not in stops else None
        return known[word]

    return [[x for w in words if (x := kept(w)) is not None] for words in lists]


def lemma_rows(rows: DataFrame, key: str | Sequence[str] = "sent_id", text: str = "sentence", stop_words: Sequence[str] = STOP_WORDS, extra: Sequence[str] = (), lemmatize: Callable[[str], str] = lemma) -> DataFrame:
    """(key, term, tf) of each row's lemmas of more than two letters; stop words are dropped before and after."""
    stops = frozenset(stop_words) | frozenset(extra)
    as_lemmas = F.pandas_udf(lambda lists: pd.Series(lemmas_of(lists, stops, lemmatize), index=lists.index, dtype=object), "array<string>")
    return _counted(rows, key, as_lemmas(T.tokens(F.col(text))))


def vocabulary(terms: DataFrame, n_rows: int, min_df: int = 20, max_df: float = 0.5, max_features: int | None = 12_000) -> DataFrame:
    """(term, term_id, df, tf): terms in enough and not too many rows, the most frequent of them; ids by term order.

    At most ``max_features`` rows come together to be numbered.
    """
    counts = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_rows))
    if max_features is not None:
        counts = counts.orderBy(F.desc("tf"), "term").limit(max_features)
    return counts.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"), "df", "tf")


def dictionary(terms: DataFrame, n_rows: int, no_below: int = 5, no_above: float = 0.5, keep: int | None = 100_000) -> DataFrame:
    """As :func:`vocabulary` with the limits of a bag-of-words dictionary; the commonest ``keep`` terms by rows are kept (None: all)."""
    counts = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where((F.col("df") >= no_below) & (F.col("df") <= no_above * n_rows))
    return counts if keep is None else counts.orderBy(F.desc("df"), "term").limit(keep)


def tfidf(terms: DataFrame, vocab: DataFrame, n_rows: int, key: str = "sent_id") -> DataFrame:
    """(key, term, term_id, tfidf): (1 + ln tf) (ln((1 + N) / (1 + df)) + 1), rows of length one.

    The vocabulary has a bounded number of rows, so it is broadcast.
    """
    held = terms.select(key, "term", "tf").join(F.broadcast(vocab.select("term", "term_id", "df")), "term")
    raw = (1 + F.log("tf")) * (F.log((1.0 + n_rows) / (1 + F.col("df"))) + 1)
    weighed = held.select(key, "term", "term_id", raw.alias("raw"))
    # a row's terms are few: grouping them once costs one shuffle, where a sum joined back would take two
    grouped = weighed.groupBy(key).agg(F.sum(F.col("raw") * F.col("raw")).alias("square"), F.collect_list(F.struct("term", "term_id", "raw")).alias("terms"))
    return grouped.select(key, F.sqrt("square").alias("norm"), F.explode("terms").alias("t")).select(key, "t.term", "t.term_id", (F.col("t.raw") / F.col("norm")).alias("tfidf"))


def bags(terms: DataFrame, vocab: DataFrame, key: str = "sent_id", bounded: bool = True) -> DataFrame:
    """(key, term, n) of the vocabulary's terms. One without a limit isn't ``bounded``, so it isn't broadcast unless Spark finds it small."""
    held = vocab.select("term")
    return terms.join(F.broadcast(held) if bounded else held, "term").select(key, "term", F.col("tf").alias("n"))
