"""Packing tokenised documents into sequences by swap-based local search.

Documents are tokenised once; what is longer than a sequence is cut into whole
sequences and a rest. The rests are dealt evenly into groups of bounded size.
In a group they are first laid into sequences as they come, each beginning where
the last one has no room. The local search does the packing: the fullest
underfull sequence takes what fills it most from the others by moving a document
to it, or exchanging one for one, one for two or two for one. It is at least as
full as any other, so each such exchange raises the sum of squared fills;
sequences run empty by and by. The search ends when there are as few sequences
as the tokens need, or when no exchange helps any more.

Full sequences are closed. The documents of all others go to a smaller pool,
which is dealt and searched again; once a round closes little, each group closes
all its sequences but the emptiest. So a group's leftovers are packed with
others', until one group holds the pool. No task holds more than a group.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import compress, count
from operator import not_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import delete_path, ship, slices, table, written_at
from reqloom.llm.tokens import vocabulary_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Documents in a group, which one task packs; a group has at least LEAST_BINS sequences' worth of tokens, unless it is the only one.
GROUP, LEAST_BINS = 4096, 4
#: Pre-tokens a worker remembers at most, the longest it remembers, and bytes of text it works on at a time (cut up they take some 15 times that).
REMEMBERED, LONGEST, SLICE_BYTES = 300_000, 64, 1 << 20

#: Unknown pre-tokens that are encoded in one call.
JOINED = 256


def _basic(category: str) -> str:
    """The ranges of a character class for the first 65,536 characters whose category begins so."""
    found = [i for i in range(1 << 16) if unicodedata.category(chr(i))[0] == category]
    starts = [i for k, i in enumerate(found) if not k or found[k - 1] != i - 1]
    ends = [i for k, i in enumerate(found) if k + 1 == len(found) or found[k + 1] != i + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def _narrow_parts(letters: str, numbers: str, spaces: str):
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+").findall


class Encoder:
    """Ids of texts by an end-of-word vocabulary, remembering the ids of pre-tokens.

    A text's pre-tokens are found by the vocabulary's own rule (normal form C,
    lower case, one pattern), and each is encoded by the library once. Unknown
    ones are encoded together, between spaces, and told apart by the tokens that
    end a word; if these aren't as many, they are encoded one by one. Texts with
    special strings inside are left to the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = tuple(token.content for token in self.tokenizer.get_added_tokens_decoder().values())
        # fixed values: the vocabulary's pre-token pattern; below with the classes that it comes to in narrower texts
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.ascii_parts = _narrow_parts("a-z", "0-9", r" \t\n\r\f\v")
        self.basic_parts = _narrow_parts(_basic("L"), _basic("N"), _basic("Z") + r"\t\n\r\f\v\x85")
        self.beyond_basic = re.compile("[\U00010000-\U0010ffff]").search
        self.known: dict[str, bytes] = {}

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        made: dict[str, bytes] = {}
        for at in range(0, len(parts), JOINED):
            some = parts[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw, lo = ids.tobytes(), 0
                for part, hi in zip(some, (4 * stops).tolist(), strict=True):
                    made[part] = raw[lo:hi]
                    lo = hi
            else:
                made.update(zip(some, self._one_by_one(some), strict=True))
        return made

    def _cut(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_parts(text.lower())
        # the library lowers character by character: a sigma at a word's end is no special case
        lowered = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return self.parts(lowered) if self.beyond_basic(lowered) else self.basic_parts(lowered)

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        known = self.known
        odd = [k for k, x in enumerate(texts) if "<|" in x and any(s in x for s in self.special)]
        whole = dict(zip(odd, self._one_by_one([texts[k] for k in odd]), strict=True))
        cuts = [[] if k in whole else self._cut(x) for k, x in enumerate(texts)]
        ids = [list(map(known.get, x)) for x in cuts]
        missing = [list(compress(count(), map(not_, own))) for own in ids]
        made = self._learn(list({x[at] for x, places in zip(cuts, missing, strict=True) for at in places}))
        for x, own, places in zip(cuts, ids, missing, strict=True):
            for at in places:
                own[at] = made[x[at]]
        known.update((part, own) for part, own in made.items() if len(part) <= LONGEST)
        if len(known) > REMEMBERED:  # at once: a worker that waits for its next stage keeps what it has
            self.known = {}
        return [whole[k] if k in whole else b"".join(own) for k, own in enumerate(ids)]


_encoders: dict[str, Encoder] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    end = np.array([end_id], "<u4").tobytes()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder = _encoders[path]
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            texts = [x or "" for x in part.column(1).to_pylist()]
            rows: list[tuple] = []
            for doc, ids in zip(part.column(0).to_pylist(), encoder.encoded(texts), strict=True):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    cut = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, piece, start, len(cut) // 4, zlib.crc32(cut)))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def laid(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers in their order, each beginning where the last one has no room."""
    bins: list[list[int]] = []
    room = 0
    for item, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = capacity
        bins[-1].append(item)
        room -= n
    return bins


def _highest(bits: int, most: int) -> int:
    """The highest number up to ``most`` whose bit is set, or -1."""
    return (bits & ((2 << most) - 1)).bit_length() - 1 if most >= 0 else -1


class Search:
    """The local search over one group's bins. Sets of lengths are the bits of a number, so a look-up costs one operation.

    ``exchanges`` counts the moves and exchanges that were made.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = [set(b) for b in bins]
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.least = -(-sum(self.fill) // capacity)
        self.owner = {i: k for k, b in enumerate(bins) for i in b}
        self.offered: dict[int, dict[int, None]] = {}  # by length, the items that other bins may take
        self.bits = 0
        self.pair_bits: dict[int, int] = {}
        self.n_bins = sum(1 for b in self.bins if b)
        self.exchanges = 0
        self.donors: set[int] = set()

    def _open(self, k: int) -> bool:
        return 0 < self.fill[k] < self.capacity

    def _offer_item(self, i: int) -> None:
        n = self.lengths[i]
        self.offered.setdefault(n, {})[i] = None
        self.bits |= 1 << n

    def _withdraw(self, i: int) -> None:
        n = self.lengths[i]
        same = self.offered[n]
        del same[i]
        if not same:
            del self.offered[n]
            self.bits ^= 1 << n

    def _pairs(self, k: int) -> int:
        """The sums of two of a bin's items."""
        if k not in self.pair_bits:
            sums = seen = 0
            for i in self.bins[k]:
                n = self.lengths[i]
                if seen >> n & 1:
                    sums |= 1 << 2 * n
                else:
                    sums |= seen << n
                    seen |= 1 << n
            self.pair_bits[k] = sums
        return self.pair_bits[k]

    def _best(self, target: int) -> tuple[list[int], list[int]] | None:
        """(items to the target, items from it) of the largest gain that it has room for."""
        room, lengths = self.capacity - self.fill[target], self.lengths
        own: dict[int, list[int]] = {}
        for i in self.bins[target]:
            own.setdefault(lengths[i], []).append(i)
        best, change = 0, None

        def tried(found: int, n: int) -> bool:
            nonlocal best
            if found - n <= best:
                return False
            best = found - n
            return True

        for n, give in ((0, []), *((n, x[:1]) for n, x in own.items())):
            if tried(found := _highest(self.bits, n + room), n):
                change = [next(reversed(self.offered[found]))], give
                if best == room:
                    return change
        kinds = list(own)
        for at, n in enumerate(kinds):
            for m in kinds[at if len(own[n]) > 1 else at + 1 :]:
                if tried(found := _highest(self.bits, n + m + room), n + m):
                    change = [next(reversed(self.offered[found]))], [own[n][0], own[m][-1]]
                    if best == room:
                        return change
        for k in self.donors:
            if len(self.bins[k]) > 1:
                pairs = self._pairs(k)
                for n in kinds:
                    if tried(found := _highest(pairs, n + room), n):
                        change = self._pair_of(k, found), own[n][:1]
                        if best == room:
                            return change
        return change

    def _pair_of(self, k: int, total: int) -> list[int]:
        seen: dict[int, int] = {}
        for i in self.bins[k]:
            if (j := seen.get(total - self.lengths[i])) is not None:
                return [j, i]
            seen[self.lengths[i]] = i
        raise AssertionError("the bin has no such pair")

    def _fill_up(self, target: int) -> None:
        """Exchanges with the donors, none of which is fuller, until the target is full or nothing helps it."""
        for i in self.bins[target]:
            self._withdraw(i)
        while self.fill[target] < self.capacity and (found := self._best(target)):
            there, back = found
            donor = self.owner[there[0]]
            for i in there:
                self._withdraw(i)
                self.bins[donor].remove(i)
                self.bins[target].add(i)
                self.owner[i] = target
            for i in back:
                self.bins[target].remove(i)
                self.bins[donor].add(i)
                self.owner[i] = donor
                self._offer_item(i)
            gain = sum(self.lengths[i] for i in there) - sum(self.lengths[i] for i in back)
            self.fill[target] += gain
            self.fill[donor] -= gain
            self.pair_bits.pop(target, None)
            self.pair_bits.pop(donor, None)
            if not self.bins[donor]:
                self.n_bins -= 1
                self.donors.remove(donor)
            self.exchanges += 1

    def run(self) -> list[list[int]]:
        while self.n_bins > self.least:
            before = self.exchanges
            self.donors = {k for k in range(len(self.bins)) if self._open(k)}
            for k in self.donors:
                for i in self.bins[k]:
                    self._offer_item(i)
            while self.donors and self.n_bins > self.least:
                target = max(self.donors, key=lambda k: (self.fill[k], -k))
                self.donors.remove(target)
                self._fill_up(target)
            for k in self.donors:
                for i in self.bins[k]:
                    self._withdraw(i)
            if self.exchanges == before:
                break
        return [sorted(b) for b in self.bins if b]


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Raises the sum of squared fills by exchanges of underfull bins with others no fuller, until there are as few bins as can be or none helps."""
    return Search(bins, lengths, capacity).run()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, largest items first, each where it leaves least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # a bit for each room that a bin has
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        fitting = rooms >> n << n
        if fitting:
            room = (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            bins.append([])
            k, room = len(bins) - 1, capacity
        bins[k].append(item)
        by_room.setdefault(room - n, []).append(k)
        if room > n:
            rooms |= 1 << (room - n)
    return bins


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """The local search from a plain start; where that leaves more bins than the tokens need, from best fit too, and the better one."""
    bins = local_search(laid(lengths, capacity), lengths, capacity)
    if len(bins) * capacity >= sum(lengths) + capacity:
        bins = min(bins, local_search(best_fit(lengths, capacity), lengths, capacity), key=len)
    return bins


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long, bin long, offset long, fill long, emptiest long"


def _pack_group(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values(["doc_id", "piece", "ids_crc32", "length"]).reset_index(drop=True)
    lengths = group["length"].tolist()
    number, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
    for k, items in enumerate(pack(lengths, capacity)):
        at = 0
        for i in items:
            number[i], offset[i] = k, at
            at += lengths[i]
        for i in items:
            fill[i] = at
    emptiest = number[int(np.argmin(fill))]
    return group.assign(bin=number, offset=offset, fill=fill, emptiest=emptiest)[["doc_id", "piece", "start", "length", "ids_crc32", "grp", "bin", "offset", "fill", "emptiest"]]


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are a document of the end id alone. Very long texts are
    cut into whole sequences and a rest. Repeated rows are packed each for
    itself; null ids are packed and stay null. Of exchanges that gain as much the
    first found is made. An empty table gives an empty one. Other columns aren't
    read.
    """
    spark = docs.sparkSession
    ship(spark)
    path = vocabulary_path(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces, _ = written_at(rows.mapInArrow(lambda b: _pieces(b, path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    out = whole.select(*columns, "sequence_id", "offset")
    pool, pool_path, round_no, close_most = pieces.where(F.col("length") < capacity), None, 0, False
    while True:
        size = pool.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        if not size["n"]:
            break
        groups = max(1, min(-(-size["n"] // group), size["tokens"] // (LEAST_BINS * capacity)))
        dealt = pool.select(*columns, F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(groups)).alias("grp"))
        made, _ = written_at(dealt.groupBy("grp").applyInPandas(lambda g: _pack_group(g, capacity), _PACKED), "packed")
        if pool_path:
            delete_path(spark, pool_path)
        full = F.lit(True) if groups == 1 else F.col("fill") == capacity
        if close_most and groups > 1:
            full = full | (F.col("bin") != F.col("emptiest"))
        numbered = F.lit(round_no << 56) + F.shiftleft(F.col("grp"), 16) + F.col("bin")
        out = out.unionByName(made.where(full).withColumn("sequence_id", numbered).select(*columns, "sequence_id", "offset"))
        if groups == 1:
            break
        pool, pool_path = written_at(made.where(~full).select(*columns), "packing-pool")
        # once little is closed, all but the emptiest of each group's sequences are: the pool shrinks to one of each LEAST_BINS at most
        close_most = close_most or made.where(full).count() < size["n"] // 10
        round_no += 1
    return out


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table packed into sequences."""
    return packed(table(spark, sf_dir, "documents"))
