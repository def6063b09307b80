import collections
import math
import re
import zlib

import numpy as np
import xxhash
from llm_rows import table_of

from reqloom.llm import katz, quality, secrets_scan


def test_quality(spark, tables):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    rows = quality.op7_quality(spark, tables).collect()
    assert len(rows) == spark.read.parquet(f"{tables}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9


def test_quality_learns_from_other_folds_only(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    scores = lambda x: {r.doc_id: round(r.score, 9) for r in quality.classify(docs, x).collect()}
    assert scores(labels) == scores(flipped)


def test_quality_edges(spark, messy, nothing):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (6, 1), (15, 0)], "doc_id bigint, quality int")
    assert quality.classify(messy, labels).where("score is null or not score between 0 and 1").count() == 0
    assert quality.classify(messy, labels).count() == messy.count()
    assert {r.score for r in quality.classify(messy, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.classify(messy, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.classify(nothing, labels).count() == 0
    assert quality.drop_low_quality(nothing, labels).count() == 0
    kept = quality.drop_low_quality(messy, labels)
    assert kept.columns == messy.columns
    assert kept.count() == quality.classify(messy, labels).where("predicted = 1").count()


def test_blocks_of_passages_agree(monkeypatch):
    model = quality.AttentionModel(quality.N_SHAPE + quality.HASHED)
    texts = ["a b c " * 500, "", None, "X! " * 90, "word"]
    whole = model.predict(texts)
    monkeypatch.setattr(quality, "BLOCK", 3)
    assert np.allclose(whole, model.predict(texts))


def test_gradients():
    rng = np.random.default_rng(0)
    model = quality.AttentionModel(5)
    x, of, y, weight = rng.normal(size=(7, 5)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def cost():
        code, _, _, logits = model.forward(x)
        e = np.exp(logits)
        z = np.stack([(e[of == k, None] * code[of == k]).sum(0) / e[of == k].sum() for k in range(3)])
        p = model.scores(z @ model.p["c"] + model.p["b"][0])
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    found = model._step(x, of, y, weight)
    for name, values in model.p.items():
        at = tuple(0 for _ in values.shape)
        values[at] += 1e-5
        high = cost()
        values[at] -= 2e-5
        low = cost()
        values[at] += 1e-5
        assert abs((high - low) / 2e-5 - found[name][at]) < 1e-6


def slow_katz(train, texts, k=katz.K):
    """Katz' bigram model as its definition reads: (scores, sums of probabilities after each history)."""
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    uni, bi, hist = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        w = tok(t)
        uni.update(w)
        for h, x in zip(["<s>", *w[:-1]], w, strict=True):
            bi[h, x] += 1
            hist[h] += 1
    d1 = katz.discounts(collections.Counter(uni.values()), k)
    d2 = katz.discounts(collections.Counter(bi.values()), k)
    n = sum(uni.values())
    mass = sum(d1.get(c, 1.0) * c for c in uni.values())
    whole = n if n - mass > 1e-9 * n else n + 1
    low = lambda w: d1.get(uni[w], 1.0) * uni[w] / whole if uni[w] else 1 - mass / whole
    kept = bi
    after = collections.defaultdict(list)
    for (h, w), c in kept.items():
        after[h].append((w, c))
    den, alpha = {}, {}
    for h, followers in after.items():
        taken = sum(d2.get(c, 1.0) * c for _, c in followers)
        den[h] = hist[h] if hist[h] - taken > 1e-9 * hist[h] else hist[h] + 1
        alpha[h] = (1 - taken / den[h]) / (1 - sum(low(w) for w, _ in followers))
    prob = lambda h, w: d2.get(kept[h, w], 1.0) * kept[h, w] / den[h] if (h, w) in kept else alpha.get(h, 1.0) * low(w)
    scores = [sum(math.log10(prob(h, w)) for h, w in zip(["<s>", *tok(t)[:-1]], tok(t), strict=True)) for t in texts]
    sums = [sum(prob(h, w) for w in uni) + prob(h, "unseen word") for h in [*after, "unseen history"]]
    return scores, sums


def corpus():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    return [(i, " ".join(rng.choice(words, size=rng.integers(0, 40), p=p / p.sum()))) for i in range(150)]


def test_katz(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    rows = [*corpus(), (500, None), (501, "never seen words"), (500, None), (None, "w1 w2")]
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    scores, sums = slow_katz(train, [t for _, t in rows])
    assert np.allclose(sums, 1)
    docs = table_of(spark, rows).repartition(3)
    monkeypatch.setattr(katz, "ASK_TOKENS", 200)
    for top in (0, 25, 1 << 20):  # all words joined, some, none
        model = katz.train(docs.where("doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 7) <> 2"), top_words=top)
        assert (model.rare is None) == (top > 100)
        found = katz.score(docs, model).collect()
        want = sorted((str(i), round(s, 6)) for (i, _), s in zip(rows, scores, strict=True))
        assert sorted((str(r.doc_id), round(r.score, 6)) for r in found) == want
    out = katz.language_model_scores(docs).collect()
    uni = collections.Counter(w for t in train for w in [*(t or "").split(), None])
    n, v = sum(uni.values()), len(uni)
    tok = lambda t: [*(t or "").split(), None]
    want = sorted((str(i), len(tok(t)), sum(w in uni for w in tok(t)), n, round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want


def test_katz_packs_numbers_in_as_few_bytes_as_hold_them():
    edges = np.array([0, 1, -1, 127, -128, 128, -129, 32767, -32768, 32768, -32769, (1 << 31) - 1, -(1 << 31), 1 << 31, -(1 << 31) - 1, (1 << 63) - 1, -(1 << 63)])
    columns = [edges[:0], *(edges[:k] for k in range(1, len(edges) + 1)), np.array([0.1, -np.inf]).view(np.int64)]
    assert all(a.dtype == np.int64 and np.array_equal(a, b) for a, b in zip(katz.unpack(katz.pack(columns)), columns, strict=True))
    assert [katz._width(c) for c in (edges[:0], edges[:5], edges[:6], edges[:9], edges[:13], edges[:14], edges)] == [1, 1, 2, 2, 4, 8, 8]


def test_katz_vocabulary():
    words = katz.Vocabulary()
    first = words.numbers(b"B a b ")
    assert first.tolist() == [2, 3, 2, 0] and len(words.ids) == words.n == 4
    assert words.numbers(b"c a").tolist() == [4, 3, 0] and words.numbers(None).tolist() == [0]
    assert words.ids.tolist() == [katz.END, katz.BEGIN, *(xxhash.xxh64_intdigest(w) - (1 << 63) for w in (b"b", b"a", b"c"))]


def test_katz_keeps_bigrams_seen_once(spark):
    docs = table_of(spark, [(1, "a b c"), (2, "a b d"), (3, "e")], False)
    assert sorted(r.c for r in katz.train(docs).bigrams.collect()) == [1, 1, 1, 1, 1, 1, 2, 2]


def test_katz_edges(messy, nothing):
    out = katz.language_model_scores(messy).collect()
    assert len(out) == messy.count() and all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert katz.language_model_scores(nothing).count() == 0


def test_secrets(spark):
    digest = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    rows = [
        (1, f'some text token = "{digest}" after it'), (2, f"commit {digest} by nobody"), (3, "an anbletitionthtionbletion word"), (4, None), (5, ""), (6, "x" * 100_000),
        (7, "plain text only " * 1000 + f"API_KEY: {digest[:32]}###"), (1, f'some text token = "{digest}" after it'), (None, 'password="ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5"'),
        (8, f"{digest}|{digest}"),
    ]
    found = secrets_scan.secret_findings(table_of(spark, rows), secrets_scan.labelled_findings(spark))
    by = collections.defaultdict(list)
    for r in found.collect():
        by[r.doc_id].append(r)
    assert [r.is_secret for r in by[1]] == [True, True] and by[1][0].word_index == 4
    assert not by[2][0].is_secret and not by[3][0].is_secret and not by[6][0].is_secret
    assert by[7][0].is_secret and by[7][0].candidate == digest[:32]
    assert by[None][0].is_secret and 4 not in by and 5 not in by
    assert [r.nth for r in sorted(by[8], key=lambda r: r.nth)] == [0, 1]
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def slow_candidates(text):
    """(word_index, nth, candidate) by hand: words one by one, keys looked for from each place of the text before a value."""
    words, out = re.split(r"[ \t\n\x0b\f\r]+", text or ""), []
    key = re.compile(rf"(?:{secrets_scan._KEY_NAMES})[A-Za-z0-9_.-]{{0,40}}[\"'`\]]{{0,3}} ?(?::=|=>|=|:) ?[\"'`]?", re.I | re.A)
    for i, word in enumerate(words):
        found = re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", word)
        context = (" ".join(words[max(0, i - 2) : i]))[-100:] + " " + word
        for start in range(len(context)):
            named = key.match(context, start)
            value = named and re.match(r"[^ \"'`,;<>()\[\]{}]{8,}", context[named.end() :])
            if value and " " not in context[named.end() :]:
                if not re.search(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", value[0]):
                    found.append(value[0])
                break
        out += [(i, nth, c) for nth, c in enumerate(found)]
    return out


SHORT_TEXTS = [
    ('set password = "Tr0ub4dor&3x9" now', "Tr0ub4dor&3x9", True), ("api_key: 9f86d081884c7d65", "9f86d081884c7d65", True), ("DB_PASSWORD=hV7#kQ2!mZp9", "hV7#kQ2!mZp9", True),
    ('{"client_secret": "q8Zr4LmT2x"}', "q8Zr4LmT2x", True), ("the password: undefined-value here", "undefined-value", False), ("secret = getuser", "getuser", None),
    ("token: //imagething.com", "//imagething.com", False), ("PASSWORD=$GET_THINGTION", "$GET_THINGTION", False), ("pwd = ********", "********", False), ("hV7#kQ2!mZp9 alone", None, None),
]


def test_secrets_shorter_than_twenty(spark):
    found = secrets_scan.secret_findings(table_of(spark, [(i, t) for i, (t, *_) in enumerate(SHORT_TEXTS)]), secrets_scan.labelled_findings(spark))
    got = {r.doc_id: (r.candidate, r.is_secret) for r in found.collect()}
    assert got == {i: (c, secret) for i, (_, c, secret) in enumerate(SHORT_TEXTS) if secret is not None}


def test_secret_candidates_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "source")
    extra = [*(t for t, *_ in SHORT_TEXTS), None, "", "key" * 40 + "=" + "x1" * 6, "passw" * 3000 + "=", "token\n=\n'abcdefgh12' token=> ABCDEFGH", "auth:" + "%" * 70_000, "of password=e3b3ed3cc8548923d6 the", "a=b " * 9 + "pwd:=12345678 pwd:1234567"]
    every = docs.union(spark.createDataFrame([(-i - 1, t, "s") for i, t in enumerate(extra)], docs.schema)).persist()
    got = collections.defaultdict(list)
    for r in secrets_scan.candidates(every).collect():
        got[r.doc_id].append((r.word_index, r.nth, r.candidate))
    texts = {r.doc_id: r.text for r in every.collect()}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, t in texts.items() if (v := slow_candidates(t))}


def test_secrets_planted_in_the_tables(spark, tables):
    """Every 40-digit value behind ``token =`` is found, and next to nothing else."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    planted = {r.doc_id for r in docs.collect() if re.search(r'token = "[0-9a-f]{40}"', r.text or "")}
    said = {r.doc_id for r in secrets_scan.op5_secrets(spark, tables).where("is_secret").collect()}
    assert planted <= said and len(said - planted) <= 1 + len(planted) // 20


def test_secrets_forest_on_held_out_findings(spark):
    every = secrets_scan.labelled_findings(spark, 4000).persist()
    model = secrets_scan.fit_forest(every.where("pmod(xxhash64(candidate), 4) <> 0"))
    from pyspark.ml.feature import VectorAssembler

    held = secrets_scan.featured(every.where("pmod(xxhash64(candidate), 4) = 0"))
    out = model.transform(VectorAssembler(inputCols=list(secrets_scan.FEATURES), outputCol="features").transform(held))
    assert out.where("prediction = label").count() / out.count() > 0.97


def test_secrets_empty(spark, nothing, messy):
    findings = secrets_scan.labelled_findings(spark)
    assert secrets_scan.secret_findings(nothing, findings).count() == 0
    assert secrets_scan.secret_findings(messy, findings).where("is_secret").count() == 0
