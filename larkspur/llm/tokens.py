"""Encoding of texts by a public byte-level BPE vocabulary.

Words are cut by a scan over code-point classes. Each class sets the state of the cutter
whatever it was before, so the transition functions of any run compose to that of its
last characters, and the scan over them comes down to comparisons with neighbours: all
boundaries of a slab of texts come from a few whole-array operations. Equal slices are
merged once, many at a time, and then found by hash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.codepoints import SPACE, Slab, Slices, classes, ragged
from larkspur.session import spread

#: Where the public vocabularies lie; a parameter of every operator.
VOCABULARIES = "/opt/tokenizers"
SLAB = 1 << 20
CACHE = 1 << 20
APOSTROPHE, BLANK = ord("'"), ord(" ")
#: The endings that the vocabulary's pattern cuts after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Rank of a pair that isn't in the vocabulary.
NONE = np.int64(1 << 40)


def boundaries(slab: Slab) -> np.ndarray:
    """True where a token starts.

    A token is an ending after an apostrophe; or a run of letters, of numbers or of
    other characters, with one blank before it; or white space. Of white space before a
    word all but the last character is one token; the last goes to the word if it's a
    blank and stands alone if not.
    """
    p, n = slab.points, len(slab.points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[p]
    first = slab.first()
    last = np.append(first[1:], True)
    space = kind == SPACE
    start = first.copy()
    changed = np.zeros(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    attached = np.zeros(n, bool)  # a word whose blank stands before it in the same text
    attached[1:] = ~space[1:] & (p[:-1] == BLANK)
    attached &= ~first
    start |= changed & ~attached
    # The last white-space character before a word starts a token of its own.
    before_word = np.zeros(n, bool)
    before_word[:-1] = space[:-1] & ~space[1:]
    before_word &= ~last
    start |= before_word
    quote = np.flatnonzero((p == APOSTROPHE) & start & ~last)
    if len(quote):
        # Characters after the apostrophe within its text, 0 beyond.
        follow = [np.append(p, [0, 0, 0])[quote + 1], np.append(p, [0, 0, 0])[quote + 2]]
        follow[1] = np.where(last[quote + 1], 0, follow[1])
        length = np.zeros(len(quote), np.int64)
        for ending in reversed(ENDINGS):
            same = follow[0] == ord(ending[0])
            if len(ending) > 1:
                same &= follow[1] == ord(ending[1])
            length[same] = len(ending)
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        start[quote[length > 1] + 2] = False
        stop = quote + 1 + length
        stop = stop[(stop < n) & ~first[np.minimum(stop, n - 1)]]
        start[stop] |= ~space[stop]
    return start


class Merger:
    """Pair merging by the ranks of a vocabulary file: of a slice's neighbouring tokens the
    pair of the lowest rank is merged, everywhere in the slice, until no pair has one.
    Many slices go at once, one round of merges after the other; long ones one by one."""

    #: Bytes up to which a slice is merged together with others.
    SHORT = 64

    def __init__(self, path: str):
        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Bytes of each id.
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            self.size[rank] = len(token)
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        self.pairs = pairs

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices end to end, and how many each has."""
        whole = [self.ranks.get(p) for p in pieces]
        done: dict[int, list[int]] = {i: [r] for i, r in enumerate(whole) if r is not None}
        rest = [i for i, r in enumerate(whole) if r is None]
        done |= {i: self._long(pieces[i]) for i in rest if len(pieces[i]) > self.SHORT}
        short = [i for i in rest if i not in done]
        for i, ids in zip(short, self._short([pieces[i] for i in short])):
            done[i] = ids
        lengths = np.fromiter((len(done[i]) for i in range(len(pieces))), np.int64, len(pieces))
        return np.fromiter((x for i in range(len(pieces)) for x in done[i]), np.int64, int(lengths.sum())), lengths

    def _short(self, pieces: list[bytes]) -> list[list[int]]:
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        rank = self._ranks(ids[:-1], ids[1:])
        rank[owner[:-1] != owner[1:]] = NONE
        rank = np.append(rank, NONE)
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            active = np.repeat(best != NONE, sizes)
            if not active.all():
                finished.append((owner[~active], ids[~active]))
                ids, owner, rank, best, sizes = ids[active], owner[active], rank[active], best[best != NONE], sizes[best != NONE]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # Of overlapping pairs (one token repeated) every second is merged.
            run = np.append(True, np.diff(hit) > 1)
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            ids[hit] = rank[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            # Only pairs beside a merged token have new ranks.
            where = np.cumsum(keep) - 1
            at = where[hit]
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(ids) - 1)
                rank[i] = np.where((j > i) & (owner[i] == owner[j]), self._ranks(ids[i], ids[j]), NONE)
        if not finished:
            return []
        owner, ids = (np.concatenate(x) for x in zip(*finished))
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(pieces)))
        return [x.tolist() for x in np.split(ids[order], ends[:-1])]

    def _long(self, piece: bytes) -> list[int]:
        """One slice with a queue of its pairs, in n log n steps."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(queue, (q, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]


_merger = cache(Merger)


class Encoder:
    """Encodes slabs of texts; keeps the ids of the slices it has met."""

    def __init__(self, path: str):
        self.merger = _merger(path)
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[int, int] = {}
        self.ids = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)

    def _learn(self, keys: list[int], pieces: list[bytes]) -> None:
        ids, lengths = self.merger.merge(pieces)
        known = len(self.at) - 1
        self.seen.update(zip(keys, range(known, known + len(keys))))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, ids per text, and the byte offset in its text at
        which each id's bytes start."""
        if len(self.seen) > CACHE:
            self._forget()
        slab = Slab(texts)
        starts = np.flatnonzero(boundaries(slab))
        ends = np.append(starts[1:], len(slab.points))
        hashes = Slices(slab.points).hash(starts, ends)
        unique, example, back = np.unique(hashes, return_index=True, return_inverse=True)
        seen, joined = self.seen, slab.joined
        keys = unique.tolist()
        fresh = [i for i, key in enumerate(keys) if key not in seen]
        if fresh:
            self._learn([keys[i] for i in fresh], [joined[starts[e] : ends[e]].encode("utf-8", "replace") for e in example[fresh].tolist()])
        piece = np.fromiter(map(seen.__getitem__, keys), np.int64, len(keys))[back]
        at = self.at
        lengths = at[piece + 1] - at[piece]
        ids = self.ids[ragged(at[piece], lengths)]
        total = np.append(0, lengths.cumsum())
        per_text = np.diff(total[np.searchsorted(starts, slab.starts)])
        # Slices cover their texts, so an id starts where the bytes before it end.
        size = self.merger.size[ids]
        before = np.cumsum(size) - size
        text_first = np.cumsum(per_text) - per_text
        first = np.repeat(before[np.minimum(text_first, max(len(ids) - 1, 0))] if len(ids) else text_first, per_text)
        return ids.astype(np.int32), per_text, before - first


def _slabs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLAB characters; a longer text is a range of its own."""
    lo = size = 0
    for hi, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > SLAB:
            yield lo, hi
            lo, size = hi, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def encode(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken",
    offsets: bool = False,
) -> DataFrame:
    """Token ids of every row's whole text, without special tokens: ``key``, ``ids``
    (array<int>) and, if wanted, ``offsets`` (the byte at which each id starts in the
    UTF-8 text).

    NULL and empty texts give empty lists; rows are kept one for one, also repeated
    ones and those without a key. Columns other than the two named are ignored. A text
    of any length is encoded whole. There is no shuffle, unless
    the table is read in fewer pieces than there are cores.
    """

    # The file goes to the executors, which need not have it at that place.
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(SparkFiles.get(name))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in _slabs(texts):
                ids, per_text, at = encoder.encode([t or "" for t in texts[lo:hi]])
                ends = pa.array(np.append(0, per_text.cumsum()).astype(np.int32))
                out = [keys.slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(ids))]
                if offsets:
                    out.append(pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["key", "ids", "offsets"][: len(out)])

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    schema = f"key {kind}, ids array<int>" + ", offsets array<int>" * offsets
    return spread(narrow).mapInArrow(run, schema).withColumnRenamed("key", key)
