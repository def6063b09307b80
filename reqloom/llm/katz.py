"""Katz backoff language model: counts, discounts, normalised weights, scores.

A bigram model over words of whitespace-cut text and an end token:

    P(w|h) = d(c) c(hw) / c(h)        if c(hw) > 0
           = alpha(h) P(w)            otherwise
    P(w)   = d(c) c(w) / N            if c(w) > 0
           = P(unknown)               otherwise, one class that all unseen words share

with Good-Turing discounts d for counts up to ``K`` (Katz 1987), and alpha(h)
such that the probabilities after h sum to one exactly. All bigrams that occur
are kept.

Words are counted first. The most frequent ones (``TOP_WORDS`` at most) go to
all tasks in arrays of bounded size and are known by their place there; all
others by a 64-bit hash, and what they are worth is joined. Bigrams are counted
and looked up in partitions by history, where a frequent history is dealt into
shares. They travel and are stored packed: sorted, as differences, compressed.

Scores are sums, so each token's recursion becomes lookups whose values add up:
a word's probability, its weight as a history, and what a bigram that occurs
adds to its backed-off score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import crc_mod, delete_path, free_shuffles, ship, table, written, written_at

K = 7
#: Words, at most, that go to every task.
TOP_WORDS = 1 << 20
#: Tokens that are counted, or asked for, together.
BLOCK_TOKENS, ASK_TOKENS = 3 << 20, 1 << 19
#: Words a worker remembers at most, bigrams that are merged at a time, and stored documents to a partition of bigrams.
REMEMBERED, MERGE_ROWS, PARTITION_BYTES = 400_000, 1 << 20, 8 << 20
#: A history with the N-th part of all tokens is dealt into up to SHARES / N shares, so that no task has all of a frequent word's bigrams.
SHARES, MOST_SHARES = 4096, 1024

#: Hashes that no word has but by a chance of 2**-64: marks, not words.
END, BEGIN = 1, 2
#: Kinds of packed rows.
COUNTS, GAINS, OWN, ASKED, ANSWER, RARE = range(6)


class Vocabulary(defaultdict):
    """Numbers words as they come: word -> small number; ``ids[number]`` is the word's 64-bit hash."""

    def __init__(self):
        super().__init__(count(2).__next__)
        self._ids = np.array([END, BEGIN], np.int64)

    @property
    def n(self) -> int:
        return 2 + len(self)

    @property
    def ids(self) -> np.ndarray:
        """Hashes of all words so far; those that came since the last call are made now."""
        fresh = self.n - len(self._ids)
        if fresh:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, islice(self, len(self) - fresh, None)), np.uint64, fresh)
            self._ids = np.concatenate([self._ids, (hashes ^ np.uint64(1 << 63)).view(np.int64)])
        return self._ids

    def numbers(self, text: bytes | None) -> np.ndarray:
        """The words' numbers, A-Z lower-cased, then 0 for the end."""
        words = text.lower().split() if text else []
        out = np.zeros(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out


def _before(ends: np.ndarray, tokens: np.ndarray, begin: int) -> np.ndarray:
    """Each token's predecessor; ``ends``: one past each text's last token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[0] = begin
    before[ends[:-1]] = begin
    return before


_zstd = pa.Codec("zstd", compression_level=1)


def _width(c: np.ndarray) -> int:
    """Bytes, 1, 2, 4 or 8, that hold each number of a 64-bit column."""
    most = max(-int(c.min()) - 1, int(c.max())) if len(c) else 0
    return next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - 1)


def pack(columns: list[np.ndarray]) -> bytes:
    """64-bit columns as one compressed value, each in as few bytes as hold its numbers, these by significance; columns may differ in length."""
    widths = list(map(_width, columns))
    parts = [np.array([len(columns), *map(len, columns), *widths], np.int64).tobytes()]
    parts += [np.ascontiguousarray(c.astype(f"<i{w}")).view(np.uint8).reshape(-1, w).T.tobytes() for c, w in zip(columns, widths, strict=True)]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + _zstd.compress(raw, asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = _zstd.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, widths = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n).tolist()
    out, at = [], 8 * (2 * n + 1)
    for size, width in zip(sizes, widths, strict=True):
        narrow = np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size).T).view(f"<i{width}").ravel()
        out.append(narrow.astype(np.int64))
        at += width * size
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.int64(0))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pack_pairs(h: np.ndarray, w: np.ndarray, *more: np.ndarray) -> bytes:
    """Rows sorted by (h, w)."""
    return pack([_steps(h), _steps(w), *more])


def unpack_pairs(packed: bytes) -> list[np.ndarray]:
    h, w, *more = unpack(packed)
    return [np.cumsum(h), np.cumsum(w), *more]


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The most frequent words: sorted hashes and counts. A word's id is its place here, else its hash; ``begin`` is the id of a text's begin."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, texts: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], np.append(counts[order], texts)
        self.tokens, self.begin = tokens, len(hashes)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not self.begin:
            return np.where(hashes == BEGIN, self.begin, _far(hashes))
        order = np.argsort(hashes)  # searching in order is many times faster than at random
        at = np.empty(len(hashes), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hashes, hashes[order]), self.begin - 1)
        return np.where(self.hashes[at] == hashes, at, np.where(hashes == BEGIN, self.begin, _far(hashes)))

    def top(self, ids: np.ndarray) -> np.ndarray:
        return (ids >= 0) & (ids <= self.begin)

    def parts(self, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """The partition of each bigram."""
        own = self.counts[np.where(self.top(h), h, 0)] * self.top(h)
        shares = np.minimum(MOST_SHARES, 1 + own * SHARES // max(1, self.tokens)).astype(np.uint64)
        return (_mixed((_mixed(h) + _mixed(w) % shares).view(np.int64)) % np.uint64(n)).astype(np.int64)


def _far(hashes: np.ndarray) -> np.ndarray:
    """Hashes moved out of the range of places."""
    return np.where(np.abs(hashes) <= TOP_WORDS, hashes + (1 << 40), hashes)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n) of blocks of texts."""
    words = Vocabulary()
    counts = np.zeros(0, np.int64)

    def block() -> pa.RecordBatch:
        seen = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(words.ids[seen]), pa.array(counts[seen])], ["w", "n"])

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            every = [words.numbers(x.as_py()) for x in batch.column(0).slice(lo, 256).cast(pa.binary())]
            found = np.bincount(np.concatenate(every), minlength=words.n)
            found[: len(counts)] += counts
            counts = found
            if words.n > REMEMBERED:
                yield block()
                words, counts = Vocabulary(), counts[:0]
    if len(counts):
        yield block()


def _by_part(words: Words, h: np.ndarray, w: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, rows) of bigrams; a part's rows keep their order."""
    part = words.parts(h, w, n)
    order = np.argsort(part.astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")  # 16 bits are sorted by radix
    first = _starts(part[order])
    for lo, hi in zip(first, np.append(first[1:], len(order)), strict=True):
        yield int(part[order[lo]]), order[lo:hi]


def _pair_counts(batches: Iterator[pa.RecordBatch], words: Words, n_parts: int) -> Iterator[pa.RecordBatch]:
    """(part, packed (h, w, n)) of blocks of texts."""
    known = Vocabulary()
    held: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        tokens = np.concatenate(held)
        ids = words.ids(known.ids)
        ordered, place = _in_order(ids)
        pairs = (place[_before(np.cumsum([len(x) for x in held]), tokens, 1)] << 32) | place[tokens]
        pairs.sort()
        new = _starts(pairs)
        h, w, n = ordered[pairs[new] >> 32], ordered[pairs[new] & 0xFFFFFFFF], np.diff(np.append(new, len(pairs)))
        rows = [(part, pack_pairs(h[at], w[at], n[at])) for part, at in _by_part(words, h, w, n_parts)]
        return _rows(rows)

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            held.append(known.numbers(text.as_py()))
            size += len(held[-1])
            if size >= BLOCK_TOKENS or known.n > REMEMBERED:
                yield block()
                held, size = [], 0
                if known.n > REMEMBERED:
                    known = Vocabulary()
    if held:
        yield block()


def _in_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids sorted, each id's place there): pairs of places sort as pairs of ids do."""
    order = np.argsort(ids)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    return ids[order], place


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    parts, packed = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], ["part", "packed"])


def _merged(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """[h, w, n] of blocks, sorted, n summed over equal (h, w)."""
    h, w, n = (np.concatenate(x) for x in zip(*blocks, strict=True))
    small = len(h) and min(h.min(), w.min()) >= 0 and max(h.max(), w.max()) < 1 << 31
    order = np.argsort((h << 31) | w, kind="stable") if small else np.lexsort((w, h))  # sorted runs merge fast
    h, w, n = h[order], w[order], n[order]
    new = _starts(h, w)
    return [h[new], w[new], np.add.reduceat(n, new)]


def _summed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(part, few, packed (h, w, c)) of rows sorted by part; ``few``: how many bigrams have the counts 0 to k + 1."""
    part, blocks, rows, whole = None, [], 0, 0

    def summed() -> Iterator[pa.RecordBatch]:
        h, w, c = _merged(blocks)
        for lo in range(0, len(h), MERGE_ROWS // 4):
            at = slice(lo, lo + MERGE_ROWS // 4)
            few = np.bincount(c[at][c[at] <= k + 1], minlength=k + 2).tolist()
            columns = [pa.array([part], pa.int32()), pa.array([few], pa.list_(pa.int64())), pa.array([pack_pairs(h[at], w[at], c[at])], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "few", "packed"])

    for batch in batches:
        for of, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if of != part and blocks:
                yield from summed()
                blocks, rows, whole = [], 0, 0
            part = of
            blocks.append(unpack_pairs(packed.as_py()))
            rows += len(blocks[-1][0])
            if rows > max(MERGE_ROWS, 2 * whole):
                blocks = [_merged(blocks)]
                rows = whole = len(blocks[0][0])
    if blocks:
        yield from summed()


def _partitions(docs: DataFrame) -> int:
    """Shuffle partitions such that one has the pairs of about PARTITION_BYTES of the stored tables below ``docs``."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    known = sum(x for x in sizes if x < 1 << 60)  # what isn't stored says a size near 2**63
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // PARTITION_BYTES + 1)


def discounts(counts: dict[int, int], k: int = K) -> dict[int, float]:
    """Katz's d for counts 1 to k from counts of counts; (r - 0.5) / r where these give none within (0, 1)."""
    n = [0.0, *(float(counts.get(r, 0)) for r in range(1, k + 2))]
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _discounted(count: str, d: dict[int, float]):
    """d(c) c as an expression."""
    c = F.col(count)
    factor = F.lit(1.0)
    for r, x in d.items():
        factor = F.when(c == r, F.lit(x)).otherwise(factor)
    return c * factor


def _discount(c: np.ndarray, d: dict[int, float]) -> np.ndarray:
    """d(c) c."""
    factors = np.ones(max(d, default=0) + 2)
    factors[list(d)] = list(d.values())
    return c * factors[np.minimum(c, len(factors) - 1)]


class Model:
    """The model's arrays of frequent words, its tables, and its constants.

    ``p``, ``den`` and ``alpha`` go by the ids of ``words``. Tables: ``packed``
    (part, few, packed) has all bigrams' counts, ``rare`` (w, c, p, alpha, den)
    the other words, ``rare_pairs`` (h, w, gain) the bigrams with one of these;
    both are None where all words are among the frequent ones.
    """

    def __init__(self, words: Words, d2: dict[int, float], n_parts: int, packed: DataFrame, tokens: int, types: int, p_unknown: float):
        self.words, self.d2, self.n_parts, self.packed, self.tokens, self.types = words, d2, n_parts, packed, tokens, types
        self.base_unknown = float(-np.log10(tokens + types + 1))
        self.unknown = float(np.log10(p_unknown)) if tokens else self.base_unknown
        self.p = self.den = self.alpha = np.ones(words.begin + 1)
        self.rare: DataFrame | None = None
        self.rare_pairs: DataFrame | None = None

    @property
    def bigrams(self) -> DataFrame:
        """(h, w, c) of all bigrams, by their words' ids."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packed in batch.column(0):
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, unpack_pairs(packed.as_py()))), ["h", "w", "c"])

        return self.packed.select("packed").mapInArrow(rows, "h long, w long, c long")

    def gains(self, h: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """What bigrams of frequent words add to their backed-off log10 scores."""
        return np.log10(_discount(c, self.d2) / (self.den[h] * self.alpha[h] * self.p[w]))

    def arrays(self) -> Model:
        """Without the tables, for tasks."""
        out = Model(self.words, self.d2, self.n_parts, None, self.tokens, self.types, 1.0)
        out.unknown, out.p, out.den, out.alpha = self.unknown, self.p, self.den, self.alpha
        return out


def _weights(total, taken, below):
    """(den, alpha) of a history by its count, the discounted counts after it, and what these words have by themselves."""
    den = np.where(total - taken > 1e-9 * total, total, total + 1.0)  # where nothing is left (all counts above k), one more count is
    return den, (1 - taken / den) / (1 - below)


def train(docs: DataFrame, text_col: str = "text", k: int = K, top_words: int = TOP_WORDS) -> Model:
    """The model of all texts of ``docs``. Null counts as empty; without rows nothing is known and all words score alike."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    counted, counted_path = written_at(texts.mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("c")), "words")
    free_shuffles(spark)
    facts = counted.agg(F.sum("c").alias("N"), F.count("*").alias("V"), *(F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, k + 2)), F.max(F.when(F.col("w") == END, F.col("c"))).alias("texts")).first()
    tokens, types = int(facts["N"] or 0), facts["V"]
    d1 = discounts({r: facts[f"n{r}"] for r in range(1, k + 2)}, k)
    mass = counted.agg(F.sum(_discounted("c", d1)).alias("m")).first()["m"] or 0.0
    whole = tokens if tokens - mass > 1e-9 * max(tokens, 1) else tokens + 1  # leave something for unknown words
    least = _threshold(counted, top_words)
    known = counted.where(F.col("c") >= least).toArrow()  # at most top_words rows
    words = Words(known.column("w").to_numpy(), known.column("c").to_numpy(), tokens, int(facts["texts"] or 0))
    n_parts = _partitions(docs)
    held = spark.sparkContext.broadcast(words)

    pairs = texts.mapInArrow(lambda b: _pair_counts(b, held.value, n_parts), "part int, packed binary")
    dealt = pairs.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part")
    packed = written(dealt.mapInArrow(lambda b: _summed(b, k), "part int, few array<long>, packed binary"), "bigrams")
    free_shuffles(spark)
    few = packed.select(F.posexplode("few").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()  # k + 2 rows
    model = Model(words, discounts({r["r"]: r["n"] for r in few}, k), n_parts, packed, tokens, types, 1 - mass / whole if whole else 1.0)
    model.p = np.append(_discount(words.counts[:-1], d1) / max(whole, 1), 1.0)

    held_model = spark.sparkContext.broadcast(model.arrays())
    masses = packed.select("packed").mapInArrow(lambda b: _masses(b, held_model.value), "h long, taken double, below double, w long")
    far = F.when(F.abs("w") <= TOP_WORDS, F.col("w") + (1 << 40)).otherwise(F.col("w"))
    rare_words = counted.where(F.col("c") < least).select(far.alias("of"), F.col("c").alias("count"), (_discounted("c", d1) / float(max(whole, 1))).alias("p"))
    has_rare = types > words.begin
    if has_rare:
        masses, masses_path = written_at(masses, "masses")
        masses = masses.join(rare_words, F.col("w") == F.col("of"), "left").withColumn("below", F.coalesce("below", "p"))
    left = masses.groupBy("h").agg(F.sum("taken").alias("taken"), F.sum("below").alias("below"))
    if has_rare:
        left, left_path = written_at(left, "histories")
        delete_path(spark, masses_path)
    own = left.where(F.col("h").between(0, words.begin)).toArrow()  # at most top_words + 1 rows
    h = own.column("h").to_numpy()
    model.den, model.alpha = np.ones(words.begin + 1), np.ones(words.begin + 1)
    model.den[h], model.alpha[h] = _weights(words.counts[h].astype(float), own.column("taken").to_numpy(), own.column("below").to_numpy())
    if has_rare:
        total, taken = F.col("count").cast("double"), F.col("taken")
        den = F.when(total - taken > 1e-9 * total, total).otherwise(total + 1)
        weighed = rare_words.join(left, F.col("of") == F.col("h"), "left").withColumn("den", F.coalesce(den, total))
        alpha = F.coalesce((1 - F.col("taken") / F.col("den")) / (1 - F.col("below")), F.lit(1.0))
        model.rare = written(weighed.select(F.col("of").alias("w"), F.col("count").alias("c"), "p", "den", alpha.alias("alpha")), "rare-words")
        held_model = spark.sparkContext.broadcast(model.arrays())
        odd = packed.select("packed").mapInArrow(lambda b: _odd_pairs(b, held_model.value), "h long, w long, dc double, p double, weight double")
        by_w = odd.join(model.rare.select(F.col("w").alias("of_w"), F.col("p").alias("p_w")), F.col("w") == F.col("of_w"), "left")
        both = by_w.join(model.rare.select(F.col("w").alias("of_h"), (F.col("den") * F.col("alpha")).alias("weight_h")), F.col("h") == F.col("of_h"), "left")
        gain = F.log10(F.col("dc") / (F.coalesce("p", "p_w") * F.coalesce("weight", "weight_h")))
        model.rare_pairs = written(both.select("h", "w", gain.alias("gain")), "rare-bigrams")
        delete_path(spark, left_path)
    delete_path(spark, counted_path)
    free_shuffles(spark)
    return model


def _masses(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(h, taken, below, w): discounted counts after h, and what their words have by themselves; each other word w in a row of its own."""
    for batch in batches:
        for packed in batch.column(0):
            h, w, c = unpack_pairs(packed.as_py())
            taken, top = _discount(c, model.d2), model.words.top(w)
            for rows in (np.flatnonzero(top), np.flatnonzero(~top)):
                first = _starts(h[rows]) if len(rows) and top[rows[0]] else np.arange(len(rows))
                if not len(rows):
                    continue
                known = bool(top[rows[0]])
                below = np.add.reduceat(model.p[w[rows]], first) if known else np.zeros(len(rows))
                columns = [pa.array(h[rows][first]), pa.array(np.add.reduceat(taken[rows], first)), pa.array(below, mask=np.full(len(first), not known)), pa.array(w[rows][first], mask=np.full(len(first), known))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "taken", "below", "w"])


def _odd_pairs(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(h, w, dc, p, weight) of bigrams with a word that isn't among the frequent ones; null is what that word must bring."""
    for batch in batches:
        for packed in batch.column(0):
            h, w, c = unpack_pairs(packed.as_py())
            top_h, top_w = model.words.top(h), model.words.top(w)
            odd = np.flatnonzero(~(top_h & top_w))
            if not len(odd):
                continue
            h, w, c, top_h, top_w = h[odd], w[odd], c[odd], top_h[odd], top_w[odd]
            at_h, at_w = np.where(top_h, h, 0), np.where(top_w, w, 0)
            columns = [pa.array(h), pa.array(w), pa.array(_discount(c, model.d2)), pa.array(model.p[at_w], mask=~top_w), pa.array(model.den[at_h] * model.alpha[at_h], mask=~top_h)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "w", "dc", "p", "weight"])


def _threshold(counted: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` rows have it or more; reads counts of counts only."""
    n, least = 0, 1 << 62
    rows = counted.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator()
    for row in rows:
        n += row["count"]
        if n > most:
            break
        least = row["c"]
    return least


_PACKED = "part int, kind int, block long, packed binary"


def _row(part: int, kind: int, block: int, packed: bytes) -> tuple[int, int, int, bytes]:
    return part, kind, block, packed


def _packed_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "kind", "block", "packed"])


def _asking(batches: Iterator[pa.RecordBatch], model: Model, has_rare: bool) -> Iterator[pa.RecordBatch]:
    """For each block of texts what the frequent words give (OWN), its bigrams by part (ASKED), and its other words (RARE)."""
    from pyspark import TaskContext

    words, number = model.words, TaskContext.get().partitionId() << 33
    known, ids = Vocabulary(), np.zeros(0, np.int64)
    top = np.zeros(0, bool)
    log_p, log_alpha, log_c = np.log10(model.p), np.log10(model.alpha), np.log10(words.counts + 1.0)
    held: list[tuple[int | None, np.ndarray]] = []

    def block() -> pa.RecordBatch:
        nonlocal ids, top
        fresh = words.ids(known.ids[len(ids) :])
        ids, top = np.concatenate([ids, fresh]), np.concatenate([top, words.top(fresh)])
        sizes = np.array([len(x) for _, x in held])
        tokens = np.concatenate([x for _, x in held])
        text = np.repeat(np.arange(len(held)), sizes)
        before = _before(np.cumsum(sizes), tokens, 1)
        per_text = lambda x: np.bincount(text, x, len(held))
        w, here = np.where(top, ids, 0), top
        word_score = np.where(here, log_p[w] if words.begin else 0.0, model.unknown)
        word_base = np.where(here, log_c[w], 0.0)
        history = np.where(here, log_alpha[w], 0.0)
        own = [
            np.array([i or 0 for i, _ in held], np.int64), np.array([i is not None for i, _ in held], np.int64), sizes.astype(np.int64), per_text(here[tokens]).astype(np.int64),
            (per_text(word_base[tokens]) + sizes * model.base_unknown).view(np.int64), (per_text(word_score[tokens]) + per_text(history[before])).view(np.int64),
        ]
        rows = [_row(number % model.n_parts, OWN, number, pack(own))]
        if has_rare and len(odd := np.flatnonzero(~here[tokens])):
            rows.append(_row(number % model.n_parts, RARE, number, pack([ids[tokens[odd]], text[odd]])))
        may = np.flatnonzero(here[tokens] & here[before]) if not has_rare else np.arange(len(tokens))
        ordered, place = _in_order(ids)
        pairs = (place[before[may]] << 32) | place[tokens[may]]
        order = np.argsort(pairs, kind="stable")
        pairs, of = pairs[order], text[may][order]
        new = _starts(pairs)
        n = np.diff(np.append(new, len(pairs)))
        h, w = ordered[pairs[new] >> 32], ordered[pairs[new] & 0xFFFFFFFF]
        for part, at in _by_part(words, h, w, model.n_parts):
            many = n[at]
            places = np.repeat(new[at] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
            rows.append(_row(part, ASKED, number, pack_pairs(h[at], w[at], many, of[places])))
        return _packed_rows(rows)

    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            held.append((doc_id, known.numbers(text.as_py())))
            size += len(held[-1][1])
            if size >= ASK_TOKENS or known.n > REMEMBERED:
                yield block()
                number += 1
                held, size = [], 0
                if known.n > REMEMBERED:
                    known, ids, top = Vocabulary(), ids[:0], top[:0]
    if held:
        yield block()


def _answering(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and kind: a part's bigrams come first, then OWN rows, which pass as RARE ones do, and ASKED ones, which become ANSWER rows (texts, sums)."""
    part, keys, gains, odd = None, [np.zeros(0, np.int64)], [np.zeros(0)], {}
    place = model.words.begin + 1
    for batch in batches:
        rows = []
        for of, kind, block, packed in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
            if of != part:
                part, keys, gains, odd = of, [np.zeros(0, np.int64)], [np.zeros(0)], {}
            if kind in (OWN, RARE):
                rows.append(_row(of, kind, block, packed.as_py()))
            elif kind == GAINS:
                h, w, gain = unpack_pairs(packed.as_py())
                odd.update(zip(zip(h.tolist(), w.tolist(), strict=True), gain.view(np.float64).tolist(), strict=True))
            elif kind == COUNTS:
                h, w, c = unpack_pairs(packed.as_py())
                both = model.words.top(h) & model.words.top(w)
                keys.append(h[both] * place + w[both])
                gains.append(model.gains(h[both], w[both], c[both]))
            else:
                if len(keys) > 1:  # the parts' slices come in any order
                    order = np.argsort(merged := np.concatenate(keys), kind="stable")
                    keys, gains = [merged[order]], [np.concatenate(gains)[order]]
                h, w, n, text = unpack_pairs(packed.as_py())
                both = model.words.top(h) & model.words.top(w)
                found = np.zeros(len(h))
                if len(keys[0]):
                    asked = h[both] * place + w[both]
                    at = np.minimum(np.searchsorted(keys[0], asked), len(keys[0]) - 1)
                    found[both] = np.where(keys[0][at] == asked, gains[0][at], 0.0)
                if odd:
                    rest = np.flatnonzero(~both)
                    found[rest] = [odd.get(x, 0.0) for x in zip(h[rest].tolist(), w[rest].tolist(), strict=True)]
                sums = np.bincount(text, np.repeat(found, n))
                some = np.flatnonzero(sums)
                if len(some):
                    rows.append(_row(of, ANSWER, block, pack([_steps(some), sums[some].view(np.int64)])))
        if rows:
            yield _packed_rows(rows)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and kind: OWN, then ANSWER and RARE ones."""
    own: list[np.ndarray] | None = None

    def done() -> pa.RecordBatch:
        ids, named, sizes, known, base, score = own
        columns = [pa.array(ids, mask=named == 0), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        for kind, packed in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
            columns = unpack(packed.as_py())
            if kind == OWN:
                if own is not None:
                    yield done()
                own = [*columns[:4], columns[4].view(np.float64).copy(), columns[5].view(np.float64).copy()]
                own[3] = own[3].copy()
            elif kind == ANSWER:
                own[5][np.cumsum(columns[0])] += columns[1].view(np.float64)
            else:
                texts, known, base, score = columns[0], columns[1], columns[2].view(np.float64), columns[3].view(np.float64)
                np.add.at(own[3], texts, known)
                np.add.at(own[4], texts, base)
                np.add.at(own[5], texts, score)
    if own is not None:
        yield done()


def _rare_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, packed in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            w, text = unpack(packed.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.full(len(w), block)), pa.array(text)], ["asked", "block", "text"])


def _rare_answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, text, known, base, score) packed by block."""
    for batch in batches:
        block, text, known, base, score = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        order = np.argsort(block, kind="stable")
        first = _starts(block[order])
        rows = []
        for lo, hi in zip(first, np.append(first[1:], len(order)), strict=True):
            at = order[lo:hi]
            rows.append(_row(0, RARE, int(block[at[0]]), pack([text[at], known[at], base[at].view(np.int64), score[at].view(np.int64)])))
        if rows:
            yield _packed_rows(rows)


def _gain_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            h, w, gain = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.lexsort((w, h))
            h, w, gain = h[order], w[order], gain[order]
            yield _packed_rows([_row(part, GAINS, -1, pack_pairs(h[at], w[at], gain[at].view(np.int64))) for part, at in _by_part(model.words, h, w, model.n_parts)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), one row for each row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    has_rare = model.rare is not None
    held = spark.sparkContext.broadcast(model.arrays())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = rows.mapInArrow(lambda b: _asking(b, held.value, has_rare), _PACKED)
    stored = model.packed.select("part", F.lit(COUNTS).alias("kind"), F.lit(-1).cast("long").alias("block"), "packed")
    if has_rare:
        stored = stored.unionByName(model.rare_pairs.mapInArrow(lambda b: _gain_rows(b, held.value), _PACKED))
    dealt = stored.unionByName(asked).repartitionById(model.n_parts, F.col("part")).sortWithinPartitions("part", "kind", "block")
    answers = dealt.mapInArrow(lambda b: _answering(b, held.value), _PACKED)
    if has_rare:
        answers = written(answers, "answers")
        free_shuffles(spark)
        each = answers.where(F.col("kind") == RARE).mapInArrow(_rare_asked, "asked long, block long, text long").join(model.rare, F.col("asked") == F.col("w"))
        worth = F.log10("p") - model.unknown + F.log10("alpha")
        summed = each.groupBy("block", "text").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("c") + 1.0)).alias("base"), F.sum(worth).alias("score"))
        answers = answers.where(F.col("kind") != RARE).unionByName(summed.mapInArrow(_rare_answered, _PACKED))
    return answers.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_finished, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    The model learns from the rows whose crc32(doc_id as text) modulo ``folds``
    isn't ``held_fold``. Null text is empty: one token, the end. A null id has
    no remainder: it is scored, not held out, and nothing is learnt from it.
    Repeated rows count and score each time. An empty table gives an empty one.
    Other columns aren't read.
    """
    model = train(docs.where(crc_mod(id_col, folds) != held_fold), text_col)
    scores = score(docs, model, id_col, text_col)
    held = F.coalesce(crc_mod("doc_id", folds) == held_fold, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole ``documents`` table."""
    return language_model_scores(table(spark, sf_dir, "documents"))


