import collections
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import TEXTS

from reqloom.llm import packing, tokens


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(messy, messy_rows, name):
    if name.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(name)).encode
        size = lambda t: len(encode(t))
    else:
        t = library(name)
        size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    found = tokens.token_counts(messy, name)
    want = collections.Counter((i, len((t or "").encode()), size(t or ""), size(t or "") > 512) for i, t in messy_rows)
    assert collections.Counter(map(tuple, found.collect())) == want


def test_empty(nothing):
    assert tokens.token_counts(nothing).count() == 0
    assert packing.packed(nothing).count() == 0


def spliced(name, text, chunk=tokens.CHUNK, overlap=tokens.OVERLAP):
    """(tokens, characters that were encoded)."""
    path, sizes = tokens.vocabulary_path(name), []

    def encode(x):
        sizes.append(len(x))
        return tokens.encoded(path, x)

    return tokens.count_resynchronised(text, encode, tokens._is_byte_level(path), tokens._added(path), chunk, overlap), sum(sizes)


@pytest.mark.parametrize(("chunk", "overlap"), [(400, 8), (50, 2), (300, 140), (10_000, 64)])
@pytest.mark.parametrize("seed", range(6))
def test_resynchronisation(chunk, overlap, seed):
    rng = random.Random(seed)
    alphabet = ["the", "word's", " ", "\n", "12", "é", "日本", "🙂", "--", "x" * 30, "<|endoftext|>", "\u00a0", "  ", "ing", "''s", "'", "s", "\u0301", "K'll9"]
    text = "".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(3000)) + "a" * 2000 + " b c"
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        if chunk > 50 or name.startswith("byte"):
            assert spliced(name, text, chunk, overlap)[0] == tokens.count_plain(tokens.vocabulary_path(name), [text])[0]


def hard_texts():
    rng = random.Random(8)
    common = "the of and holding interest national paragraph wonder people market".split()
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    return {
        "lines": "\n".join(rng.choice(common) for _ in range(30_000)),
        "cjk": pick([chr(0x4E00 + i) for i in range(3000)], 60_000),
        "kana": pick("あいうえおかきくけこさしすせそ", 40_000),
        "base64": pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 200_000),
        "letters": pick("etaoinshrdlu", 60_000),
        "digits": pick("0123456789", 60_000),
        "emoji": pick("🙂🙃😀🚀é", 30_000),
        "glued": "".join(rng.choice(common) for _ in range(10_000)),
        "blanks": " " * 30_000 + "x" + "\t \n" * 10_000,
        "apostrophes": "'s" * 20_000 + "'" * 20_000,
        "specials": "<|endoftext|>" * 3_000 + "<|endoftext|" * 3_000,
    }


@pytest.mark.parametrize("kind", sorted(hard_texts()))
def test_long_texts_are_exact_and_encoded_about_once(kind):
    text = hard_texts()[kind]
    found, encoded = spliced("byte_bpe_50k.json", text)
    assert found == tokens.count_plain(tokens.vocabulary_path("byte_bpe_50k.json"), [text])[0]
    assert encoded <= 1.5 * len(text), encoded / len(text)


def test_encoder_is_the_library():
    rng = random.Random(4)
    pieces = ["Straße", "ΣΑΣ", "İx", "don't", "''s", "x\u0301", "ﬁ", "\x1c", "\u00a0", "!!'s", "A1b2", "<|endoftext|>", "<|x", "日本語", "…", " ", "\n", "\t", "ĸ", "②", "K"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\x0b"]) for _ in range(60)) for _ in range(300)] + [t or "" for t in TEXTS]
    t = library(packing.VOCABULARY)
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    encoder = packing.Encoder(tokens.vocabulary_path(packing.VOCABULARY))
    assert encoder.encoded(texts) == want
    assert encoder.encoded(texts) == want


def test_short_texts_ask_the_library_for_each_word_once(monkeypatch):
    rng = random.Random(3)
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    chars = [chr(i) for i in (*range(0x250), *range(0x2000, 0x2070))]
    bits = [*chars, "word", "'s", "'ll", "''re", "  ", "\n\n ", " 12", "\u0345", "日本", "🙂", "<|endoftext|>", "<|x"]
    texts = ["", *chars, *("a" + c + " " + c + c + "b" for c in chars), *("".join(rng.choice(bits) + rng.choice(["", " ", "a"]) for _ in range(n)) for n in (3, 20, 200) for _ in range(300))]
    want = [len(x.ids) for x in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert tokens.count_plain(path, texts) == want
    asked, opened = [], tokens._library(path)

    class Spy:
        def encode_batch_fast(self, some, **options):
            asked.extend(some)
            return opened.encode_batch_fast(some, **options)

        def __getattr__(self, name):
            return getattr(opened, name)

    monkeypatch.setitem(tokens._open, path, Spy())
    assert tokens.count_plain(path, ["plain words and plain words, é"] * 50) == [len(opened.encode("plain words and plain words, é").ids)] * 50
    assert len(asked) <= 6


def test_encoder_memory_is_bounded():
    """Many different words, of which a worker remembers some, and texts that it cuts up a few at a time."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=9)) for _ in range(2_500)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    path = tokens.vocabulary_path(packing.VOCABULARY)
    packing._encoders[path] = packing.Encoder(path)
    tracemalloc.start()
    found = sum(part.num_rows for part in packing._pieces([batch], path, 1 << 20, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(texts)
    assert peak < 80e6, peak


def pieces_of(rows, capacity):
    t = library(packing.VOCABULARY)
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            cut = ids[start : start + capacity]
            yield i, piece, start, len(cut), zlib.crc32(cut.tobytes())


@pytest.mark.parametrize(("capacity", "group"), [(4096, 4096), (50, 4)])
def test_packing(messy, messy_rows, capacity, group):
    found = packing.packed(messy, capacity=capacity, group=group).collect()
    assert collections.Counter(tuple(r)[:5] for r in found) == collections.Counter(pieces_of(messy_rows, capacity))
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    if group == 4096:
        assert len(by) == -(-sum(r.length for r in found) // capacity)


def squares(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


@pytest.mark.parametrize("start", [packing.laid, packing.best_fit])
def test_local_search_raises_squares(start):
    rng = random.Random(2)
    for low in (1, 1, 20, 30):
        lengths = [rng.randint(low, 90) for _ in range(120)]
        before = start(lengths, 100)
        after = packing.local_search(before, lengths, 100)
        assert sorted(i for b in before for i in b) == sorted(i for b in after for i in b) == list(range(120))
        assert all(0 < sum(lengths[i] for i in b) <= 100 for b in after)
        assert len(after) < len(before) or squares(after, lengths) >= squares(before, lengths)
        assert len(packing.pack(lengths, 100)) <= len(after)
    spread = [[0, 1], [2, 3], [4]]  # an exchange is needed: 60+20, 50+30, 40 -> two full bins of 100
    assert len(packing.local_search(spread, [60, 20, 50, 30, 40], 100)) == 2


def test_local_search_ends_where_nothing_helps():
    """Moves and exchanges of all kinds are tried from scratch on what it returns: no bin gains from one that is no fuller."""
    rng = random.Random(6)
    for _ in range(30):
        lengths = [rng.randint(25, 70) for _ in range(24)]
        bins = packing.local_search(packing.laid(lengths, 100), lengths, 100)
        if len(bins) == -(-sum(lengths) // 100):
            continue
        fill = [sum(lengths[i] for i in b) for b in bins]
        parts = lambda b: [[], *([i] for i in b), *([i, j] for k, i in enumerate(b) for j in b[k + 1 :])]
        size = lambda x: sum(lengths[i] for i in x)
        for t, target in enumerate(bins):
            for d, donor in enumerate(bins):
                if t != d and fill[d] <= fill[t]:
                    gains = [size(x) - size(y) for x in parts(donor) for y in parts(target) if x and len(x) + len(y) <= 3]
                    assert not any(0 < g <= 100 - fill[t] for g in gains)


def test_search_where_best_fit_falls_short():
    rng = random.Random(1)
    lengths = [rng.randint(900, 1800) for _ in range(4096)]
    plain, fitted, least = packing.laid(lengths, 4096), packing.best_fit(lengths, 4096), -(-sum(lengths) // 4096)
    found = packing.local_search(plain, lengths, 4096)
    assert len(found) <= 1.01 * least < 1.05 * least < len(fitted) < len(plain)


def test_leftovers_of_all_groups_meet(spark):
    """No sequence is ever full here: each group closes all but its emptiest sequence."""
    docs = spark.range(0, 300, 1, 7).selectExpr("id as doc_id", "repeat('a ', 20) as text")
    found = packing.packed(docs, capacity=64, group=16).collect()
    assert len(found) == 300 and len({r.sequence_id for r in found}) == 100
