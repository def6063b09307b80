"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at Hamming distance d meet at every variant that lies on a
shortest way between them, so it is enough that each emits its ball of half
the radius. With an odd radius 2h+1 both halves can't be whole; so the 64 bits
are cut into ``blocks`` blocks, and once for each block that block is left out
of the key: dropping a block that holds a differing bit leaves a distance of at
most 2h, which balls of radius h bridge. A bucket then holds fingerprints whose
kept bits lie within h of the bucket's variant, and the links in it are
verified on all 64 bits.

For the radius of 3 (h = 1, 4 blocks) a fingerprint emits 4 x 49 variants.
Copies share a fingerprint and emit once. No bucket can hold more than
49 x 2**16 fingerprints, whatever the corpus; small buckets compare within
themselves, large ones look up the 696 neighbours of each dropped-block value
in a table, so work stays linear. What leaves a task is a spanning forest, not
the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.llm.common import free_shuffles, fresh_name, if_few, ship, table, written
from reqloom.llm.components import components
from reqloom.llm.shingle_sets import bit_counts, digest, keyed_texts, set_links, shingle_set

RADIUS = 3
BLOCKS = 4
SHINGLE = 3
SEED = 42
#: Fingerprints a bucket may hold and still be compared within itself.
SMALL_BUCKET = 192
#: Fingerprints turned into variants at a time.
EMIT_ROWS = 1024

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash, as a signed integer. Null or no words: 0.

    A-Z are lower-cased, words are runs of other than 0x20 and 0x09-0x0D.
    A bit is 1 if set in over half the shingles' hashes.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        total = 1
    else:
        total = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    ones = np.zeros(64, np.int64)
    left = total
    while left:
        part = min(left, 1 << 15)
        hashes = np.fromiter(map(_hash, (s for _, s in zip(range(part), shingles, strict=False))), dtype="<u8", count=part)
        ones += bit_counts(hashes)
        left -= part
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        made = pa.array((fingerprint(x.as_py(), shingle) for x in texts), pa.int64(), size=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row."""
    ship(docs.sparkSession)
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pair.mapInArrow(lambda b: _fingerprints(b, shingle), "doc_id long, fp long")


def _block_masks(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=4)
def _variants(blocks: int, half: int) -> list[np.ndarray]:
    """For each block left out, the bits to flip for each variant within ``half`` of the kept bits."""
    out = []
    for shift, width in _block_masks(blocks):
        kept = [np.uint64(1) << np.uint64(i) for i in range(64) if not shift <= i < shift + width]
        ball = [np.uint64(0)]
        ring = [(np.uint64(0), -1)]
        for _ in range(half):
            ring = [(m | b, j) for m, last in ring for j, b in enumerate(kept) if j > last]
            ball += [m for m, _ in ring]
        out.append(np.array(ball, np.uint64))
    return out


def _emit(batches: Iterator[pa.RecordBatch], radius: int, blocks: int) -> Iterator[pa.RecordBatch]:
    half = radius // 2
    layout = _block_masks(blocks)
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at in range(0, len(every), EMIT_ROWS):
            fps = every[at : at + EMIT_ROWS]
            keys, own = [], []
            for k, ((shift, width), flips) in enumerate(zip(layout, _variants(blocks, half), strict=True)):
                low = np.uint64((1 << shift) - 1)
                variant = fps[:, None] ^ flips[None, :]
                # the kept bits, closed up, below the block's number
                packed = (variant & low) | ((variant >> np.uint64(shift + width)) << np.uint64(shift) if shift + width < 64 else np.uint64(0))
                keys.append((packed | np.uint64(k << (64 - width))).ravel())
                own.append(np.repeat(fps, len(flips)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(own).view(np.int64))], ["key", "fp"])


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, least member) that connect what the given edges connect."""
    nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    u, v = index[: len(left)], index[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, label[u], least)
        np.minimum.at(after, label[v], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


@lru_cache(maxsize=4)
def _near(width: int, radius: int) -> list[np.ndarray]:
    """Masks of 1, 2, ... ``radius`` bits of a block."""
    bits = [1 << i for i in range(width)]
    rings, ring = [], [(0, -1)]
    for _ in range(radius):
        ring = [(m | b, j) for m, last in ring for j, b in enumerate(bits) if j > last]
        rings.append(np.array([m for m, _ in ring], np.int64))
    return rings


def _large_bucket(fps: np.ndarray, key: int, radius: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within distance ``radius`` connect in one bucket.

    Kept bits of two members differ in at most the sum of their distances to the
    bucket's variant. Members of one dropped-block value are linked if that sum
    is within the radius; so each (value, distance) is one class.
    """
    half = radius // 2
    width = 64 // blocks
    shift = _block_masks(blocks)[(key & ((1 << 64) - 1)) >> (64 - width)][0]
    low = np.uint64((1 << shift) - 1)
    packed = (fps & low) | ((fps >> np.uint64(shift + width)) << np.uint64(shift) if shift + width < 64 else np.uint64(0))
    centre = np.uint64(key & ((1 << (64 - width)) - 1))
    away = np.bitwise_count(packed ^ centre).astype(np.int64)
    value = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
    rep = np.full((half + 1, 1 << width), -1, np.int64)  # a member of each class
    where = np.arange(len(fps))
    for r in range(half + 1):
        rep[r][value[away == r]] = where[away == r]
    left, right = [where], [rep[away, value]]
    for r1 in range(half + 1):
        have = np.flatnonzero(rep[r1] >= 0)
        for r2 in range(r1, half + 1):
            room = radius - r1 - r2
            rings = [np.zeros(1, np.int64), *_near(width, max(room, 0))][: room + 1]
            for ring in rings:
                for mask in ring:
                    other = rep[r2][have ^ mask]
                    ok = other >= 0
                    left.append(rep[r1][have[ok]])
                    right.append(other[ok])
    a, b = np.concatenate(left), np.concatenate(right)
    keep = a != b
    return fps[a[keep]], fps[b[keep]]


def _links(batches: Iterator[pa.RecordBatch], radius: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a bucket may go on in the next batch."""
    rest_k = np.zeros(0, np.int64)
    rest_f = np.zeros(0, np.uint64)

    def solve(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) < 2:
            return
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        left, right = [], []
        for s, n in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
            a, b = _large_bucket(np.unique(fps[s : s + n]), int(keys[s]), radius, blocks)
            left.append(a)
            right.append(b)
        small = np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes)
        k, f = keys[small], fps[small]
        lag = 1
        while len(k) > lag:
            same = k[lag:] == k[:-lag]
            if not same.any():
                break
            a, b = f[lag:][same], f[:-lag][same]
            near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
            left.append(a[near])
            right.append(b[near])
            lag += 1
        if left and sum(map(len, left)):
            member, root = _forest(np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_arrays([pa.array(member.view(np.int64)), pa.array(root.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([rest_k, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        yield from solve(keys[:cut], fps[:cut])
        rest_k, rest_f = keys[cut:], fps[cut:]
    yield from solve(rest_k, rest_f)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links within ``radius`` connect."""
    if radius % 2 == 0 or 64 % blocks or blocks < 2:
        raise ValueError("an odd radius and a number of blocks that divides 64 are needed")
    ship(fps.sparkSession)
    keyed = fps.select("fp").mapInArrow(lambda b: _emit(b, radius, blocks), "key long, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda b: _links(b, radius, blocks), "a long, b long").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, radius: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Each row's (doc_id, fp), and for each fingerprint its (of_fp, root, component_id)."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = _nodes(fps)
    return fps, _placed(nodes, components(links(nodes, radius)))


def _nodes(fps: DataFrame) -> DataFrame:
    return written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), "fingerprint-nodes")


def _placed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    member = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_doc")
    least = member.groupBy(F.col("root").alias("of_root")).agg(F.min("least_doc").alias("component_id"))
    return member.join(least, member["root"] == least["of_root"]).select(F.col("fp").alias("of_fp"), "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    ``component_id`` is the least doc_id reachable over links of at most
    ``radius`` differing bits. Null and empty texts have fingerprint zero and
    link as any other. Repeated rows give repeated rows. A null doc_id keeps its
    row and never is a component's id, unless the component has no other (null).
    An empty table gives an empty one. Other columns aren't read.
    """
    fps, by_fp = _classes(docs, id_col, text_col, radius, shingle)
    # copies make single fingerprints hot here; AQE splits both sides of this sort-merge join
    return fps.join(by_fp, fps["fp"] == by_fp["of_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` but one for each component: the one with the least id. Columns stay as they are.

    Of rows repeated under that id, the one with the least fingerprint among
    those in the component stays, once. A component without any id keeps one
    row. Null texts form a component as any other equal texts do.
    """
    return _one_of_each(docs, id_col, text_col, *_classes(docs, id_col, text_col, radius, shingle), lambda x: fingerprint(x, shingle))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = 5) -> DataFrame:
    """As :func:`drop_near_duplicates`, of components over pairs whose shingle sets have a Jaccard similarity of ``least`` or more.

    Candidates are first the sets whose SimHashes meet in balls of half the
    radius, as there; an exact check follows. Similar sets whose SimHashes lie
    further apart are found by an exact join of what isn't connected by then.
    """
    keyed = keyed_texts(docs, id_col, text_col, shingle, least)
    by_fp = _placed(_nodes(keyed), components(set_links(docs, keyed, close_sets(keyed), id_col, text_col, shingle, least)))
    return _one_of_each(docs, id_col, text_col, keyed, by_fp, lambda x: digest(shingle_set(x, shingle)))


def close_sets(keyed: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (a, b) of sets of :func:`keyed_texts` that connect all whose SimHashes are equal or linked within ``radius``."""
    sets = written(keyed.groupBy("fp").agg(F.first("simhash").alias("simhash")), "set-simhashes")  # a set has one SimHash
    first = written(sets.groupBy("simhash").agg(F.min("fp").alias("first")), "simhash-nodes")
    near = written(links(first.select(F.col("simhash").alias("fp")), radius, blocks), "simhash-links")
    free_shuffles(keyed.sparkSession)
    a, b = (first.select(F.col("simhash").alias(f"at_{x}"), F.col("first").alias(x)) for x in "ab")
    between = near.withColumnsRenamed({"a": "at_a", "b": "at_b"}).join(a, "at_a").join(b, "at_b").select("a", "b")
    return between.unionByName(sets.join(first, "simhash").where("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b")))


def _one_of_each(docs: DataFrame, id_col: str, text_col: str, fps: DataFrame, by_fp: DataFrame, to_key: Callable[[bytes | None], int]) -> DataFrame:
    fps, by_fp = fps.select("doc_id", "fp"), written(by_fp, "fingerprint-classes")
    placed = fps.join(by_fp, fps["fp"] == by_fp["of_fp"])
    mine = fresh_name(docs.columns, "of_id")
    counts = placed.groupBy(F.col("doc_id").alias(mine)).agg(F.count("*").alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("least"))
    row_id = F.col(id_col).cast("long")
    # ids that go, and those that need a closer look: few beside those that stay, so texts needn't be shuffled
    gone = written(counts.where(f"`{mine}` is not null and not (n = 1 and least)").select(mine, (F.col("least") & (F.col("n") > 1)).alias("odd")), "fingerprint-ids")
    plain = docs.where(F.col(id_col).isNotNull()).join(if_few(gone.select(mine)), row_id == F.col(mine), "left_anti")
    nameless = written(by_fp.where("component_id is null").select("root").distinct(), "nameless-components")
    odd = gone.where("odd").select(mine)
    if nameless.isEmpty() and odd.isEmpty():
        return plain
    odd = odd.unionByName(nameless.limit(1).select(F.lit(None).cast("long").alias(mine)))
    fp, root, first, known_fp, known_id = (fresh_name(docs.columns, x) for x in ("row_fp", "row_root", "row_number", "known_fp", "known_id"))
    to_fp = F.pandas_udf(lambda texts: texts.map(lambda x: to_key(None if x is None else x.encode())).astype("int64"), "long")
    again = docs.join(if_few(written(odd, "odd-ids")), row_id.eqNullSafe(F.col(mine)), "left_semi").withColumn(fp, to_fp(F.col(text_col)))
    known = by_fp.select(F.col("of_fp").alias(known_fp), F.col("root").alias(root), F.col("component_id").alias(known_id))
    again = again.join(known, F.col(fp) == F.col(known_fp)).where(row_id.eqNullSafe(F.col(known_id)))
    again = again.withColumn(first, F.row_number().over(Window.partitionBy(root).orderBy(fp))).where(F.col(first) == 1)
    return plain.unionByName(again.select(*[again[f"`{c}`"] for c in docs.columns]))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the whole ``documents`` table."""
    return near_duplicates(table(spark, sf_dir, "documents"))
