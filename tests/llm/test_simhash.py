import collections
import random

import numpy as np
import pytest
import xxhash

from reqloom.llm import shingle_sets, simhash
from reqloom.llm.components import components
from llm_rows import table_of


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    listed = sorted(nodes)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def expected(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = slow_components(set(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return collections.Counter((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True))


def test_messy(messy, messy_rows):
    assert collections.Counter(map(tuple, simhash.near_duplicates(messy).collect())) == expected(messy_rows)


def test_whole_table(spark, tables):
    found = simhash.op1_simhash(spark, tables).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert collections.Counter(map(tuple, found)) == expected(rows)


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing).columns == nothing.columns


def test_stage_keeps_one_of_each(spark, messy, messy_rows):
    kept = simhash.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    fps = [slow_fingerprint(t) for _, t in messy_rows]
    root = slow_components(set(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted(root[slow_fingerprint(t)] for _, t in rows) == sorted(set(root.values()))
    plain = table_of(spark, [(1, "a b c d"), (2, "a b c d"), (3, "quite another text")], False)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(plain).collect()) == [1, 3]


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("small", [simhash.SMALL_BUCKET, 2])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, small):
    """Dense clouds of fingerprints; with a bucket limit of 2 all buckets take the table path."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(fps)[:6]:
        fps |= {near(rng, centre, rng.randint(1, 5)) for _ in range(60)}
        fps |= {centre ^ (0b111 << s) for s in (0, 7, 13, 14, 30, 61)}  # three differing bits in one block or over two
    keys, values = [], []
    for batch in simhash._emit(iter([_batch(fps)]), 3, 4):
        keys.append(batch.column(0).to_numpy())
        values.append(batch.column(1).to_numpy())
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys, kind="stable")
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    import pyarrow as pa

    pieces = [pa.RecordBatch.from_arrays([pa.array(keys[order][i : i + 997]), pa.array(values[order][i : i + 997])], ["key", "fp"]) for i in range(0, len(keys), 997)]
    edges = {(a, b) for batch in simhash._links(iter(pieces), 3, 4) for a, b in zip(*(c.to_numpy().view(np.uint64).tolist() for c in batch.columns), strict=True)}
    expected_roots = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    found = slow_components_of_edges(fps, edges)
    assert found == expected_roots


def _batch(fps):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(np.array(sorted(fps), np.uint64).view(np.int64))], ["fp"])


def slow_components_of_edges(nodes, edges):
    near_by = collections.defaultdict(set)
    for a, b in edges:
        near_by[a].add(b)
        near_by[b].add(a)
    out = {}
    for start in sorted(nodes):
        if start not in out:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = start
                    todo += near_by[x]
    return out


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def slow_similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_similar_texts_drop_at_any_hamming_distance(spark):
    """Copies with some words changed, of which most are beyond 3 of 64 bits; a hub of near copies and a common line."""
    rng = random.Random(3)
    line = "all of these texts have this very line in common"
    texts = []
    for k in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 30, 120, 400]))] + line.split()
        for _ in range(60 if k == 0 else 3):
            copy = list(words)
            for _ in range(rng.randint(0, len(copy) // 40)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    sets = {i: slow_set(t) for i, t in rows}
    root = slow_components(set(sets), lambda a, b: slow_similar(sets[a], sets[b]))
    kept = simhash.drop_similar(table_of(spark, rows, False).repartition(3)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root.values()))
    assert len(kept) < simhash.drop_near_duplicates(table_of(spark, rows, False)).count()


def slow_set_simhash(found):
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in found]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def lightly_edited(rng, n):
    """Texts and copies of theirs with some other words at the end."""
    rows = []
    for _ in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 150, 400]))]
        rows += [" ".join(words), " ".join([*words[: -rng.randint(1, 4)], f"x{rng.randrange(5000)}"])]
    return list(enumerate(rows))


def test_stage_finds_close_simhashes_by_balls(spark, monkeypatch):
    """Without the join's rounds just the similar sets within 3 bits are linked, by ball hashing; with them all are."""
    rows = lightly_edited(random.Random(11), 40)
    docs, sets = table_of(spark, rows, False), {i: slow_set(t) for i, t in rows}
    marks = {i: slow_set_simhash(s) for i, s in sets.items()}
    close = lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 3 and slow_similar(sets[a], sets[b])
    balls = sorted(set(slow_components(sets, close).values()))
    every = sorted(set(slow_components(sets, lambda a, b: slow_similar(sets[a], sets[b])).values()))
    assert len(every) < len(balls) < len(rows)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == every
    monkeypatch.setattr(shingle_sets, "ROUNDS", ())
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == balls


def test_close_pairs_are_checked(spark, monkeypatch):
    """Pairs that are given are links only if their sets are similar."""
    monkeypatch.setattr(shingle_sets, "ROUNDS", ())
    docs = table_of(spark, lightly_edited(random.Random(12), 4), False)
    keyed = shingle_sets.keyed_texts(docs, "doc_id", "text")
    fps = {r.doc_id: r.fp for r in keyed.collect()}
    sets = {fps[r.doc_id]: slow_set(r.text) for r in docs.collect()}
    pairs = [(a, b) for a in sorted(sets) for b in sorted(sets) if a < b]
    found = shingle_sets.set_links(docs, keyed, spark.createDataFrame(pairs, "a long, b long"), "doc_id", "text").collect()
    similar = sorted(p for p in pairs if slow_similar(sets[p[0]], sets[p[1]]))
    assert 0 < len(similar) < len(pairs) and sorted(map(tuple, found)) == similar


def test_similar_keeps_one_of_each_messy(messy, messy_rows, nothing):
    sets = [slow_set(t) for _, t in messy_rows]
    root = slow_components(set(range(len(sets))), lambda a, b: slow_similar(sets[a], sets[b]))
    kept = simhash.drop_similar(messy)
    assert kept.columns == messy.columns
    of = {s: root[i] for i, s in enumerate(sets)}
    assert sorted(of[slow_set(r.text)] for r in kept.collect()) == sorted(set(root.values()))
    assert simhash.drop_similar(nothing).count() == 0


def test_parities_never_say_more_than_sets_differ():
    rng = np.random.default_rng(5)
    for n, m, shared in [(1, 1, 0), (1, 1, 1), (64, 65, 50), (300, 500, 250), (1000, 1030, 900), (5, 700, 3)]:
        every = rng.integers(-(1 << 63), (1 << 63) - 1, n + m - shared)
        a, b = every[:n], every[n - shared :]
        assert len(b) == m
        assert shingle_sets.differing(shingle_sets.parities(a), shingle_sets.parities(b)) <= n + m - 2 * shared
    assert shingle_sets.differing(shingle_sets.parities(a), shingle_sets.parities(a)) == 0
