"""Exact token counts by overlap resynchronisation.

A document of more than ``chunk`` characters is encoded in overlapping chunks
with offsets; a shorter one is a single chunk, whose tokens are counted pre-token
by pre-token (for a byte-level vocabulary), each counted by the library once. Two neighbours are spliced at an
offset inside their overlap that is proven to be a token boundary of the whole
text; the left one counts up to there, the right one from there.

For a byte-level vocabulary two proofs are used. Between a character and a next
one of another class (white space, letters, digits, anything else) a pre-token
ends whatever stands further left or right, but for the blank before a word and
an apostrophe before letters. Inside a pre-token, where a long run of one class
has no such place, a token that both chunks have at the same characters is
proof: byte-pair merges give a sequence exactly if each two neighbours in it are
what they would be by themselves (no merge crosses a border between them), and
with a shared token at the seam each two neighbours occur in one of the chunks.

Other vocabularies are spliced at a single blank between two words, where both
begin a token and no piece can reach across. Where an overlap has no proven
place it is widened, up to the whole of what isn't counted yet.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import ship, slices, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 1 << 13
OVERLAP = 160
#: Characters at either end of an overlap that no splice touches: a special string cut there is shorter.
MARGIN = 32
#: Texts, and characters of them, that are encoded in one call.
TOGETHER, TOGETHER_CHARS = 1000, 1 << 20

_stable = re.compile(r"(?<=\S) (?=\S)")
# The classes of a byte-level pre-token; a place between two classes is a border, but not blank to word nor apostrophe to letter.
_border = regex.compile(r"(?<=[^\s])(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")
# The byte-level pre-tokens, with the classes spelt out for characters whose classes don't change between Unicode versions.
_LATIN = [*range(0x250), *range(0x2000, 0x2065), *range(0x2066, 0x2070)]
_class = lambda kind: "".join(f"\\u{i:04x}" for i in _LATIN if unicodedata.category(chr(i))[0] == kind)
_L, _N, _S = _class("L"), _class("N"), _class("Z") + r"\t\n\x0b\f\r\x85"
_parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_unsure = re.compile(r"[^\x00-\u024f\u2000-\u2064\u2066-\u206f]").search
#: Pre-tokens whose token counts a worker remembers at most, and the longest it remembers.
REMEMBERED, LONGEST = 300_000, 64
_known: dict[str, dict[str, int]] = {}
_added_strings: dict[str, list[str]] = {}
_open: dict[str, object] = {}
_byte_level: dict[str, bool] = {}


def _library(path: str):
    """The opened vocabulary, once per worker process."""
    if path not in _open:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            _open[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            opened = Tokenizer.from_file(path)
            opened.no_truncation()
            opened.no_padding()
            _open[path] = opened
    return _open[path]


def vocabulary_path(name_or_path: str) -> str:
    """A path is taken as it is; a bare name is one of the public tokenizers'."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _is_byte_level(path: str) -> bool:
    """Whether the vocabulary is byte-pair merges over bytes, by the usual pre-tokens and without a normaliser."""
    if path not in _byte_level:
        known = None
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as file:
                known = json.load(file)
        _byte_level[path] = (
            known is not None and known["normalizer"] is None and known["model"]["type"] == "BPE" and not known["model"].get("dropout") and not known["model"].get("ignore_merges")
            and (known["pre_tokenizer"] or {}).get("type") == "ByteLevel" and known["pre_tokenizer"].get("use_regex", True) and not known["pre_tokenizer"].get("add_prefix_space", True)
        )
    return _byte_level[path]


def _added(path: str) -> frozenset[int]:
    """Added tokens whose places don't hang on what stands around them: they don't overlap themselves nor take blanks along."""
    if not _is_byte_level(path):
        return frozenset()
    plain = lambda t: len(t.content) <= MARGIN and not (t.lstrip or t.rstrip or t.single_word or t.normalized) and not any(t.content.endswith(t.content[:n]) for n in range(1, len(t.content)))
    return frozenset(i for i, t in _library(path).get_added_tokens_decoder().items() if plain(t))


#: A chunk's tokens: (ids, offsets at which they begin, offsets at which they end); ids and ends are None where they aren't used.
Tokens = tuple[Sequence[int] | None, Sequence[int], Sequence[int] | None]


def encoded(path: str, text: str) -> Tokens:
    library = _library(path)
    if path.endswith(".model"):
        return None, [piece.begin for piece in library.encode(text, return_type="proto").pieces], None
    found = library.encode(text, add_special_tokens=False)
    offsets = found.offsets
    if not _is_byte_level(path):
        return None, [at for at, _ in offsets], None
    starts, ends = zip(*offsets, strict=True) if offsets else ((), ())
    return found.ids, starts, ends


def _strings(path: str) -> list[str]:
    """The strings that the vocabulary takes whole, wherever they stand."""
    if path not in _added_strings:
        _added_strings[path] = [t.content for t in _library(path).get_added_tokens_decoder().values()]
    return _added_strings[path]


def _sizes(path: str, parts: set[str]) -> dict[str, int]:
    """Tokens of pre-tokens; each worker remembers those it has met."""
    known = _known.setdefault(path, {})
    out = {x: known[x] for x in parts if x in known}
    new = list(parts.difference(out))
    made = dict(zip(new, map(len, _library(path).encode_batch_fast(new, add_special_tokens=False)), strict=True))
    out.update(made)
    known.update((x, n) for x, n in made.items() if len(x) <= LONGEST)
    if len(known) > REMEMBERED:
        known.clear()
    return out


def count_plain(path: str, texts: list[str]) -> list[int]:
    library = _library(path)
    if path.endswith(".model"):
        return [len(x) for x in library.encode(texts, num_threads=1)]
    if not _is_byte_level(path):
        return [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    odd = [any(s in x for s in _strings(path)) or _unsure(x) is not None for x in texts]
    whole = iter([len(x) for x in library.encode_batch_fast([x for x, o in zip(texts, odd, strict=True) if o], add_special_tokens=False)])
    cuts = [[] if o else _parts(x) for x, o in zip(texts, odd, strict=True)]
    sizes = _sizes(path, set().union(*cuts))
    return [next(whole) if o else sum(map(sizes.__getitem__, x)) for x, o in zip(cuts, odd, strict=True)]


def _shared(left: Tokens, right: Tokens, offset: int, text: str, begin: int, end: int, special: frozenset[int]) -> int:
    """The last place within (begin, end) before which both chunks have the same token, or -1.

    The token is an added one, or lies inside a run of one class. ``offset``:
    where the right chunk begins in the left one's offsets. A token ends between
    two characters only if the next one begins there: bytes of one character may
    be several tokens'.
    """
    ids, starts, ends = left
    r_ids, r_starts, r_ends = right
    k = bisect.bisect_left(starts, end) - 1
    while k >= 0 and starts[k] > begin:
        place = ends[k]
        if place < end and (k + 1 == len(starts) or starts[k + 1] >= place):
            j = bisect.bisect_left(r_starts, place - offset) - 1
            if j >= 0 and r_ids[j] == ids[k] and r_ends[j] == place - offset and (ids[k] in special or not _border.search(text, starts[k] - 1, place + 1)):
                return place
        k -= 1
    return -1


def count_resynchronised(text: str, encode: Callable[[str], Tokens], byte_level: bool, special: frozenset[int] = frozenset(), chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of ``text``, encoding little more than ``chunk`` characters at a time.

    ``encode`` gives the tokens of a text, ``special`` are added ones. An overlap without a proven place is
    doubled, so a text without any is encoded again and again in part, never cut
    at a guess.
    """
    total, done, end = 0, 0, min(chunk, len(text))
    left, base = encode(text[:end]), 0  # the left chunk's tokens from ``base`` on
    while end < len(text):
        width = overlap
        after = min(end + chunk, len(text))
        while True:
            begin = max(done, end - width)
            right = encode(text[begin:after])
            if begin == done:  # nothing is cut off on the left: the new chunk has all that isn't counted
                splice = done
                break
            low, high = begin + margin, end - margin
            places = (m.start() for m in (_border if byte_level else _stable).finditer(text, low, high))
            proven = [p for p in places if low < p < high and _begins(left, p - base) and _begins(right, p - begin)]
            splice = proven[-1] if proven else -1
            if splice < 0 and byte_level and (place := _shared(left, right, begin - base, text[base:after], low - base, high - base, special)) >= 0:
                splice = base + place
            if splice >= 0:
                break
            width *= 2
        total += bisect.bisect_left(left[1], splice - base) - bisect.bisect_left(left[1], done - base)
        left, base, done, end = right, begin, splice, after
    return total + len(left[1]) - bisect.bisect_left(left[1], done - base)


def _begins(tokens: Tokens, place: int) -> bool:
    """Whether a token begins at ``place`` and the one before ends there."""
    _, starts, ends = tokens
    k = bisect.bisect_left(starts, place)
    return k < len(starts) and starts[k] == place and (ends is None or k == 0 or ends[k - 1] <= place)


class Counter:
    """Counts tokens of batches of texts; ``chunked`` counts the texts that needed more than one chunk."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.path, self.chunk, self.overlap, self.chunked = path, chunk, overlap, 0

    def counts(self, texts: list[str]) -> list[int]:
        whole = iter(count_plain(self.path, [x for x in texts if len(x) <= self.chunk]))
        return [next(whole) if len(x) <= self.chunk else self._spliced(x) for x in texts]

    def _spliced(self, text: str) -> int:
        self.chunked += 1
        return count_resynchronised(text, lambda x: encoded(self.path, x), _is_byte_level(self.path), _added(self.path), self.chunk, self.overlap)


def _counted(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    counter = Counter(path, chunk, overlap)
    for batch in batches:
        for part in slices(batch, 1, TOGETHER_CHARS):
            for at in range(0, part.num_rows, TOGETHER):
                some = part.slice(at, TOGETHER)
                counts = counter.counts([x or "" for x in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    Tokens are the library's for the whole text without begin, end or added
    special tokens. Null counts as empty: 0 bytes, 0 tokens. A very long text is
    encoded chunk by chunk in its one task. Repeated rows give repeated rows,
    null ids stay null, an empty table gives an empty one; other columns aren't
    read. Ties don't arise: a row's count hangs on its text alone.
    """
    ship(docs.sparkSession)
    path = vocabulary_path(vocabulary)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(lambda b: _counted(b, path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the whole ``documents`` table."""
    return token_counts(table(spark, sf_dir, "documents"))
