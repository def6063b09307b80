import collections
import hashlib
import re

import pytest
from llm_rows import table_of

from reqloom.llm import decontaminate as m

SENTENCE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def expected(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        windows += [(item, w[s : s + size]) for s in range(len(w) - size + 1)] if w else []
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, window in windows:
            for s in range(len(w) - len(window) + 1):
                if w[s : s + len(window)] == window:
                    hit |= set(range(s, s + len(window)))
                    found |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return collections.Counter(out)


ITEMS = [(1, SENTENCE), (10, SENTENCE[6:]), (2, "One-Two"), (3, "É"), (4, None), (5, "..."), (None, "quick brown fox jumps over"), (1, SENTENCE), (6, "x y x y x y x y x y x y x y x")]
DOCS = [
    (0, SENTENCE), (1, "start " * 30 + SENTENCE.upper() + " end" * 300), (2, " ".join(SENTENCE.split()[:12])), (3, "one two, ONE two"), (4, "É é É"), (5, None), (6, ""),
    (7, "the quick brown fox jumps over it"), (8, "x y " * 40), (9, SENTENCE.replace("kappa", "KAPPA!")), (10, SENTENCE.replace(" ", "\n--")), (0, SENTENCE), (None, "one two"), (12, "alpha beta gamma " * 10),
]


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id bigint, text string, shingle string, row int")


@pytest.mark.parametrize("in_place", [m.IN_PLACE, 2])
def test_brute_force(spark, monkeypatch, in_place):
    monkeypatch.setattr(m, "IN_PLACE", in_place)
    monkeypatch.setattr(m, "BROADCAST_ROWS", m.BROADCAST_ROWS if in_place > 2 else 0)
    found = m.decontamination(table_of(spark, DOCS).repartition(3), benchmark(spark, ITEMS))
    assert collections.Counter(map(tuple, found.collect())) == expected(DOCS, ITEMS)


def test_messy(spark, messy, messy_rows):
    items = [(7, "one two three four"), (8, "日本語"), (9, "same text here")]
    found = m.decontamination(messy, benchmark(spark, items))
    assert collections.Counter(map(tuple, found.collect())) == expected(messy_rows, items)


def test_empty(spark, messy, nothing):
    assert m.decontamination(nothing, benchmark(spark, ITEMS)).count() == 0
    assert m.decontamination(messy, benchmark(spark, [])).where("contaminated or n_hit > 0").count() == 0
    assert m.drop_contaminated(messy, benchmark(spark, [])).count() == messy.count()


def whole_windows(items, size=13):
    return {tuple(v[s : s + size]) for _, t in items for v in [words(t)] for s in range(len(v) - size + 1)}


def has_whole_window(text, windows, size=13):
    """Whether ``size`` consecutive words of some item occur in the text."""
    w = words(text)
    return any(tuple(w[s : s + size]) in windows for s in range(len(w) - size + 1))


def test_stage(spark):
    docs = table_of(spark, DOCS)
    kept = m.drop_contaminated(docs, benchmark(spark, ITEMS))
    assert kept.columns == docs.columns
    share = {(d, n) for (d, n, *_, f) in expected(DOCS, ITEMS) if f}
    bad = [(d, len(words(t))) in share or has_whole_window(t, whole_windows(ITEMS)) for d, t in DOCS]
    assert bad[1] and (1, len(words(DOCS[1][1]))) in share
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for (d, _), b in zip(DOCS, bad, strict=True) if not b)


def test_stage_drops_a_window_in_a_long_text(spark):
    """A passage of 13 words goes even if it is less than the twentieth part of the text; a passage of 12 stays."""
    long = [(1, "filler " * 2000 + " ".join(SENTENCE.split()[2:15]) + " more" * 2000), (2, "filler " * 2000 + " ".join(SENTENCE.split()[:12])), (3, "clean " * 50)]
    assert not any(f for *_, f in expected(long, ITEMS[:1]))
    kept = m.drop_contaminated(table_of(spark, long), benchmark(spark, ITEMS[:1])).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3]


def test_native(spark, tables):
    plan = m.op2_decontamination(spark, tables)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
