import collections
import hashlib

from llm_rows import table_of

from reqloom.llm import exact_dedup as m


def expected(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    seen, out = set(), []
    for i, t in rows:
        t = t or ""
        stays = i == keep[t] and t not in seen
        seen |= {t} if stays else set()
        out.append((i, keep[t], len(groups[t]), stays, hashlib.sha256(t.encode()).hexdigest()))
    return collections.Counter(out)


def test_messy(messy, messy_rows):
    assert collections.Counter(map(tuple, m.exact_duplicates(messy).collect())) == expected(messy_rows)


def test_empty(nothing):
    assert m.exact_duplicates(nothing).count() == 0
    assert m.drop_exact_duplicates(nothing).count() == 0


def test_stage(messy, messy_rows):
    kept = m.drop_exact_duplicates(messy)
    assert kept.columns == messy.columns
    want = collections.Counter({(i, s): n for (i, _, _, stays, s), n in expected(messy_rows).items() if stays})
    assert collections.Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()) == want


def test_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = table_of(spark, [(1, "a"), (2, "a"), (3, "b"), (4, None)], False)
    index = m.DigestIndex(spark, path, 4)
    assert {r.doc_id for r in m.exact_duplicates(first, index).collect() if r.kept} == {2, 3, 4}
    index.close()
    again = m.DigestIndex(spark, path)
    assert again.buckets == 4
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in m.exact_duplicates(table_of(spark, [(5, "a"), (6, "c"), (7, ""), (8, "c")], False), again).collect()}
    assert found == {5: (2, 2, False), 6: (8, 2, False), 7: (4, 1, False), 8: (8, 2, True)}
    assert again.read().count() == 4
    groups = m._groups(m._pairs(table_of(spark, [(9, "z")], False), "doc_id", "text"))
    plan = groups.join(again.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    scan = next(k for k, line in enumerate(plan.splitlines()) if "Bucketed: true" in line)
    above = plan.splitlines()[:scan]
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    level, path = depth(plan.splitlines()[scan]), []
    for line in reversed(above):
        if depth(line) < level:
            level = depth(line)
            path.append(line)
    assert path and not any("Exchange" in line for line in path)
    again.delete()


def test_batch_run_again_gives_the_same_rows(spark, tmp_path):
    """Also if the first run died after its digests were appended, and after other batches."""
    index = m.DigestIndex(spark, f"file://{tmp_path}/again", 4)
    first, second = table_of(spark, [(1, "a"), (2, "a"), (3, "b")], False), table_of(spark, [(4, "b"), (5, "c"), (None, "d")], False)
    rows = lambda df: collections.Counter(map(tuple, m.exact_duplicates(df, index).collect()))
    one = rows(first)
    assert rows(first) == one and sum(r[3] for r in one.elements()) == 2
    two = rows(second)
    assert rows(first) == one and rows(second) == two and {r[0] for r in two if r[3]} == {5, None}
    assert sorted(r.doc_id for r in m.drop_exact_duplicates(first, index).collect()) == [2, 3]
    assert index.read().count() == 4
    index.delete()


def test_no_table_is_left_in_the_catalog(spark, messy):
    before = {t.name for t in spark.catalog.listTables()}
    m.exact_duplicates(messy).count()
    m.drop_exact_duplicates(messy).count()
    assert {t.name for t in spark.catalog.listTables()} == before
    assert m.DigestIndex(spark, m.scratch_path(spark, "wide"), expected_rows=10**12).buckets == m.MOST_BUCKETS
