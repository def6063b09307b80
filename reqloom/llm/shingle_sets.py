"""Near-duplicates by exact Jaccard similarity of word-shingle sets: a prefix-filtered self-join.

All sets are sorted in one order, rare shingles first. Two sets of similarity
t or more share a shingle among the first n - ceil(t n) + 1 of each, so only
these prefixes are dealt into buckets; sizes and positions rule out most pairs
there, and what is left is verified on the whole sets. The order may be any, as
long as it is the same for all: frequencies are taken from a sample, which bears
on the work, not on the result.

A pair is first compared by parities: bit i of a set's parities tells whether an
odd number of its hashes fall on i. Two sets differ in at least as many shingles
as their parities do in bits, so a pair that differs in too many can't be
similar. Whole sets are made and compared for the pairs that are left.

A group of near copies has far more pairs than it needs to be connected. So
the pairs that the caller found by other means (close SimHashes) are compared
first, and then buckets are read in rounds, from neighbours to all pairs; a
round compares only what isn't connected yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqloom.llm.common import delete_path, free_shuffles, if_few, ship, slices, written, written_at
from reqloom.llm.components import components

SIMILARITY = 0.8
SHINGLE = 5
SEED = 42
#: Of so many sets one is sampled for the frequencies, of which the largest go to all tasks.
SAMPLED, MOST_KNOWN = 16, 1 << 18
#: Distances within a bucket, sorted by size, that a round compares; None: all further ones.
ROUNDS: tuple[tuple[int, int | None], ...] = ((1, 2), (3, 32), (33, None))
SLACK = 1e-9

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted. Up to ``shingle`` words are one shingle; null or no words: zero alone."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(1, np.int64)
    n = max(1, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(_hash, parts), np.uint64, n).view(np.int64))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, the lowest first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def set_simhash(found: np.ndarray) -> int:
    """A set's SimHash, as a signed integer: a bit is 1 if set in over half the hashes."""
    return int(np.packbits(bit_counts(found) * 2 > len(found), bitorder="little").view("<i8")[0])


def digest(found: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def parities(found: np.ndarray) -> bytes:
    """A bit for each of at least as many places as the set has shingles (64 or a higher power of two)."""
    places = max(64, 1 << (len(found) - 1).bit_length())
    odd = np.bincount(found & (places - 1), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which parities differ; longer ones are folded to the shorter length."""
    x, y = (int.from_bytes(v, "little") for v in (a, b))
    width, least = 8 * max(len(a), len(b)), 8 * min(len(a), len(b))
    while width > least:
        width //= 2
        x, y = ((v >> width) ^ (v & ((1 << width) - 1)) if 8 * len(own) > least else v for v, own in ((x, a), (y, b)))
    return (x ^ y).bit_count()


def _ordered(found: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in the order that all sets share: rare shingles first, then by hash."""
    if not len(keys):
        return found
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return found[np.argsort(np.where(keys[at] == found, counts[at], 0), kind="stable")]


def _keyed(batches: Iterator[pa.RecordBatch], shingle: int, keys: np.ndarray, counts: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp, simhash, n, prefix, parities) of each text: ``fp`` stands for its set of ``n`` shingles."""
    for batch in batches:
        for part in slices(batch, 1, 1 << 20):
            found = [shingle_set(x.as_py(), shingle) for x in part.column(1).cast(pa.binary())]
            prefixes = [_ordered(x, keys, counts)[: len(x) - math.ceil(least * len(x) - SLACK) + 1] for x in found]
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
            columns = [
                part.column(0), pa.array(map(digest, found), pa.int64()), pa.array(map(set_simhash, found), pa.int64()), pa.array(map(len, found), pa.int32()), held,
                pa.array(map(parities, found), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "simhash", "n", "prefix", "parities"])


def _listed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(x.as_py(), shingle) for x in part.column(0).cast(pa.binary())]))], ["key"])


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """A stored table (doc_id, fp, simhash, n, prefix, parities), one row for each row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text_col).alias("text")
    sampled = docs.select(text).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).mapInArrow(lambda b: _listed(b, shingle), "key long")
    common = sampled.groupBy("key").count().where("count > 1").orderBy(F.desc("count"), "key").limit(MOST_KNOWN).toArrow()  # bounded by MOST_KNOWN
    keys, counts = common.column("key").to_numpy(), common.column("count").to_numpy()
    order = np.argsort(keys)
    held = spark.sparkContext.broadcast((keys[order], counts[order]))
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    return written(pair.mapInArrow(lambda b: _keyed(b, shingle, *held.value, least), "doc_id long, fp long, simhash long, n int, prefix array<long>, parities binary"), "shingle-prefixes")


#: Bytes of a shingle's hash that sets are compared by: two sets of 10,000 meet by chance in one of 2,800,000 pairs.
KEPT_BYTES = 6


def _packed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(fp, s): whole sets, each hash cut to KEPT_BYTES."""
    for batch in batches:
        for part in slices(batch, 0, 1 << 20):
            found = [shingle_set(x.as_py(), shingle) for x in part.column(0).cast(pa.binary())]
            cut = [x.view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, found), pa.int64()), pa.array(cut, pa.binary())], ["fp", "s"])


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // KEPT_BYTES, 8), np.uint8)
    out[:, :KEPT_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, KEPT_BYTES)
    return np.sort(out.view(np.int64).ravel())


def _may_be_similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, b, n, m, x, y) whose parities x and y allow that the sets are similar."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
        mask = pa.array([differing(x, y) <= (1 - least) / (1 + least) * (n + m) + SLACK for n, m, x, y in zip(*columns, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, x, b, y) whose sets' Jaccard similarity is ``least`` or more."""
    for batch in batches:
        a, x, b, y = (batch.column(c) for c in ("a", "x", "b", "y"))
        kept = np.zeros(batch.num_rows, bool)
        last, held = None, None
        for k in range(batch.num_rows):
            if b[k] != last:  # rows come sorted by b
                last, held = b[k], _unpacked(y[k].as_py())
            own = _unpacked(x[k].as_py())
            both = np.concatenate([own, held])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            kept[k] = shared >= least * (len(own) + len(held) - shared) - SLACK
        mask = pa.array(kept)
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by their first one, never cut within a bucket."""
    rest: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        now = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield tuple(x[:cut] for x in now)
        rest = tuple(x[cut:] for x in now)
    if rest is not None:
        yield rest


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, once for each set, of keys that two or more sets have."""
    for key, n, fp, place in _whole_buckets(batches):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
        key, n, fp, place = key[new], n[new], fp[new], place[new]
        same = key[1:] == key[:-1]
        kept = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (key, n, fp, place)], ["key", "n", "fp", "place"])


def _pairs(batches: Iterator[pa.RecordBatch], nearest: int, furthest: int | None, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b) that may be similar and have different roots, from rows sorted by key, size and set."""
    for key, n, fp, place, root in _whole_buckets(batches):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(start, len(key)))
        mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
        sizes = np.repeat(np.where(mixed, sizes, 0), sizes)
        lag = nearest
        left, right = [], []
        while furthest is None or lag <= furthest:
            kept = sizes > lag
            if not kept.any():
                break
            key, n, fp, place, root, sizes = (x[kept] for x in (key, n, fp, place, root, sizes))
            small, large = slice(None, -lag), slice(lag, None)
            together = (key[large] == key[small]) & (n[small] >= least * n[large] - SLACK)
            if furthest is None and not together.any():
                break  # sizes grow with the distance
            room = 1 + np.minimum(n[small] - place[small], n[large] - place[large]) - 1
            needed = np.ceil(least / (1 + least) * (n[small].astype(np.int64) + n[large]) - SLACK)
            found = together & (root[small] != root[large]) & (room >= needed)
            left.append(fp[small][found])
            right.append(fp[large][found])
            lag += 1
        if left and sum(map(len, left)):
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def set_links(docs: DataFrame, keyed: DataFrame, close: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) between distinct sets of ``docs`` that connect what a similarity of ``least`` connects.

    ``keyed``: :func:`keyed_texts` of ``docs``. ``close``: pairs (a, b) of sets
    to compare first; those of them that are similar are edges. Whole sets are
    made again, and stored, of those texts alone that a pair in question has.
    """
    spark = docs.sparkSession
    ship(spark)
    counted = keyed.groupBy(F.col("fp").alias("of")).agg(F.count("*").alias("k"), F.min("doc_id").alias("least_id"))
    repeated = if_few(written(counted.where("k > 1").select("of", "least_id"), "repeated-sets"))
    one = keyed.join(repeated, F.col("fp") == F.col("of"), "left").where("of is null or doc_id <=> least_id")
    dealt = one.select("n", "fp", F.posexplode("prefix").alias("place", "key")).select("key", "n", "fp", "place").repartition("key").sortWithinPartitions("key", "n", "fp")
    buckets, buckets_path = written_at(dealt.mapInArrow(_shared, "key long, n int, fp long, place int"), "shingle-buckets")
    free_shuffles(spark)
    row_id, found = F.col(id_col).cast("long"), None
    for distances in (None, *ROUNDS):
        if distances is not None:
            roots = written(components(found), "set-roots")
            labelled = buckets.join(if_few(roots), buckets["fp"] == roots["node"], "left").select("key", "n", "fp", "place", F.coalesce("root", "fp").alias("root"))
            again = labelled.repartition("key").sortWithinPartitions("key", "n", "fp")
            close = again.mapInArrow(lambda b, d=distances: _pairs(b, *d, least), "a long, b long").distinct()
        near = written(close, "set-pairs")
        if near.isEmpty():
            found = near if found is None else found
            continue
        asked = if_few(written(near.select(F.explode(F.array("a", "b")).alias("asked")).distinct(), "sets-asked"))
        odd, odd_path = written_at(one.select("fp", "n", "parities").join(asked, F.col("fp") == F.col("asked"), "left_semi").dropDuplicates(["fp"]), "parities")
        compared = near.join(odd.select(F.col("fp").alias("a"), "n", F.col("parities").alias("x")), "a").join(odd.select(F.col("fp").alias("b"), F.col("n").alias("m"), F.col("parities").alias("y")), "b")
        pairs = written(compared.select("a", "b", "n", "m", "x", "y").mapInArrow(lambda b: _may_be_similar(b, least), "a long, b long"), "set-candidates")
        delete_path(spark, odd_path)
        if pairs.isEmpty():
            found = pairs if found is None else found
            continue
        wanted = pairs.select(F.col("a").alias("of")).unionByName(pairs.select(F.col("b").alias("of"))).distinct()
        ids = keyed.join(if_few(written(wanted, "sets-wanted")), F.col("fp") == F.col("of")).groupBy("of").agg(F.min("doc_id").alias("of_id"))
        ids = if_few(written(ids, "texts-wanted"))
        texts = docs.select(row_id.alias("id"), F.col(text_col).alias("text")).join(ids.select("of_id").distinct(), F.col("id").eqNullSafe(F.col("of_id")), "left_semi")
        made = texts.select("text").mapInArrow(lambda b: _packed(b, shingle), "fp long, s binary")
        sets, sets_path = written_at(made.join(ids.select("of"), F.col("fp") == F.col("of"), "left_semi").dropDuplicates(["fp"]), "candidate-sets")
        both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b")
        checked = written(both.select("a", "x", "b", "y").mapInArrow(lambda b: _similar(b, least), "a long, b long"), "set-links")
        delete_path(spark, sets_path)
        free_shuffles(spark)
        found = checked if found is None else found.unionByName(checked)
    delete_path(spark, buckets_path)
    return found
