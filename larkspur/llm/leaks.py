"""Passages of evaluation items inside corpus documents.

Words are compared after everything that counts as no change is taken away: markup,
case, accents, punctuation, spacing, line breaks, invisible characters and variants of a
character. Numbers, units and names become typed placeholders. Windows of five such
template words are hashed; documents meet items by a join on the hash. What shares
enough windows in one place is then aligned word by word, and the slots are checked.

Texts are taken apart as arrays of code points, many texts at a time; words become
Python strings only where windows were met.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.codepoints import Slab, Slices, mix, ragged
from larkspur.session import cut, shuffle_width, spread

WINDOW = 5
#: A passage: this many consecutive words of the item, at most this share of them edited.
PASSAGE, EDITS = 20, 0.1
#: 20 words with 2 edits leave at least 6 of their 16 windows whole, whichever words are
#: hit. Fewer are asked for, as a change that counts as none (a blank for a hyphen, a tag
#: within a word) moves the borders of words and breaks windows, too.
SHARED = 4
#: Words around the shared windows that the alignment gets to see.
AROUND = 40
#: Bits of the filters over item windows and over names that are sent to the executors
#: (2 MB each, whatever the number of items).
FILTER_BITS = 24
#: Characters of texts that are taken apart together.
SLAB = 1 << 20

#: Words that stand for a number, and units.
NUMBER_WORDS = frozenset(
    """one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
    eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand
    zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig
    neunzig hundert tausend
    deux trois quatre cinq sept huit neuf dix onze douze treize vingt trente quarante cinquante soixante cent mille
    """.split()
)
UNITS = frozenset("mm cm km kg mg kpa mpa rpm khz mhz hz ml min wt µm nm kw".split())
NUMBER, UNIT, NAME = 1, 2, 3

TAG = re.compile(r"<[/!?A-Za-z][^<>]*>")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Hyphens that join the parts of a word.
HYPHENS = (0x2D, 0x2010, 0x2011)
PLAIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "ı": "i", "đ": "d"}
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("асеорхуіјѕԁһαονρ", "aceopxyijsdhaovp"))
#: The blocks of combining marks.
COMBINING = ((0x300, 0x36F), (0x483, 0x489), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
#: Classes of plain characters.
BREAK, WORD, DIGIT, SCORE, HYPHEN, BLANK, LINE = range(7)


def _plain(c: str) -> str:
    """A character in letters without accents and variants; nothing if it is invisible."""
    point = ord(c)
    if unicodedata.category(c) == "Cf" or 0xFE00 <= point <= 0xFE0F or point == 0x34F or any(a <= point <= b for a, b in COMBINING):
        return ""
    parts = (p for p in unicodedata.normalize("NFKD", c) if not unicodedata.combining(p))
    return "".join(LOOKALIKES.get(q, PLAIN.get(q, q)) for p in parts for q in p.casefold())


def _class_of(c: str) -> int:
    if c.isdigit():
        return DIGIT
    if c.isalnum():
        return WORD
    return {"_": SCORE, "\n": LINE, " ": BLANK, "\t": BLANK}.get(c, HYPHEN if ord(c) in HYPHENS else BREAK)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, list[int]], np.ndarray]:
    """For every code point how many plain characters it has, the first of them, all of
    them where there are several; and the class of every code point."""
    size, single = np.ones(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    kind = np.zeros(0x110000, np.uint8)
    several: dict[int, list[int]] = {}
    # Ideographs have no variants but those in the blocks of compatibility ideographs.
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x2F800), (0x30000, 0x40000)):
        kind[a:b] = WORD
    for a, b in ((0, 0x3400), (0xA000, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)):
        for point in range(a, b):
            c = chr(point)
            kind[point] = _class_of(c)
            plain = _plain(c) if point >= 0x80 else c.lower()
            size[point] = len(plain)
            if len(plain) > 1:
                several[point] = [ord(p) for p in plain]
            if plain:
                single[point] = ord(plain[0])
    return size, single, several, kind


def _plain_points(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plain characters of code points, and where those of each end."""
    size, single, several, _ = _tables()
    sizes = size[points]
    ends = np.cumsum(sizes, dtype=np.int64)
    if (sizes == 1).all():
        return single[points], ends
    out = single[np.repeat(points, sizes)]
    for i in np.flatnonzero(sizes > 1).tolist():
        out[ends[i] - sizes[i] : ends[i]] = several[int(points[i])]
    return out, ends


def unmarked(text: str) -> str:
    """The text without markup."""
    if "&" in text:
        text = ENTITY.sub(lambda m: html.unescape(m[0]), text)
    return TAG.sub(" ", text) if "<" in text else text


class Words:
    """The words of several texts, as they are compared: runs of letters and digits."""

    def __init__(self, texts: list[str]):
        slab = Slab([unmarked(t) + "\x00" for t in texts])
        points, own = _plain_points(slab.points)
        text_ends = own[slab.starts[1:] - 1]
        kinds = _tables()[3][points]
        drop = self._joining(points, kinds)
        if drop is not None:
            keep = ~drop
            text_ends = np.cumsum(keep)[text_ends - 1]
            points, kinds = points[keep], kinds[keep]
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = (kinds == WORD) | (kinds == DIGIT)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.points, self.starts, self.ends = points, edges[::2], edges[1::2]
        #: First word of each text, and one more.
        self.first = np.append(0, np.searchsorted(self.starts, text_ends))
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = Slices(points).hash(self.starts, self.ends)
        digits = np.append(0, np.cumsum(kinds == DIGIT, dtype=np.int32))
        self.numeric = digits[self.ends] - digits[self.starts] == self.ends - self.starts

    @staticmethod
    def _joining(points: np.ndarray, kinds: np.ndarray) -> np.ndarray | None:
        """Hyphens between the parts of a word, with a line's end after them."""
        at = np.flatnonzero(kinds == HYPHEN)
        at = at[(at > 0) & (at + 1 < len(kinds))]
        letter = (kinds == WORD) | (kinds == DIGIT) | (kinds == SCORE)
        at = at[letter[at - 1]]
        if not len(at):
            return None
        drop = np.zeros(len(kinds), bool)
        drop[at[letter[at + 1]]] = True
        for i in at[(kinds[at + 1] == BLANK) | (kinds[at + 1] == LINE)].tolist():
            j = i + 1
            lines = 0
            while j < len(kinds) and kinds[j] in (BLANK, LINE):
                lines += kinds[j] == LINE
                j += 1
            if lines == 1 and j < len(kinds) and letter[j]:
                drop[i:j] = True
        return drop if drop.any() else None

    def text(self, a: int, b: int) -> str:
        """Words a to b with blanks between."""
        s, e = self.starts[a:b], self.ends[a:b]
        out = np.full(int((e - s).sum()) + b - a, 0x20, np.uint32)
        length = e - s
        out[ragged(np.cumsum(length + 1) - length - 1, length)] = self.points[ragged(s, length)]
        return out[:-1].tobytes().decode("utf-32-le", "surrogatepass") if b > a else ""


def words_of(text: str) -> list[str]:
    words = Words([text])
    return words.text(0, len(words.starts)).split(" ") if len(words.starts) else []


def _hash_of(words: Iterator[str]) -> np.ndarray:
    """Sorted hashes of some words."""
    return np.sort(Words(list(words)).hashes)


@cache
def _fixed() -> tuple[np.ndarray, np.ndarray]:
    return _hash_of(NUMBER_WORDS), _hash_of(UNITS)


def _among(hashes: np.ndarray, sorted_hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return sorted_hashes[at] == hashes


def _bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def slots(words: Words, names: np.ndarray) -> np.ndarray:
    """Type of each word's placeholder, 0 for none; ``names`` is a filter by hash."""
    numbers, units = _fixed()
    out = np.where(_bit(names, words.hashes), NAME, 0)
    out[_among(words.hashes, units)] = UNIT
    out[words.numeric | _among(words.hashes, numbers)] = NUMBER
    return out


def windows(hashes: np.ndarray, text_of: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes (signed) of the runs of ``width`` words that lie in one text."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    at = np.flatnonzero(text_of[:n] == text_of[width - 1 :])
    return at, total[at].view(np.int64)


def template(words: Words, names: np.ndarray) -> np.ndarray:
    """Hashes of the template words: those of one placeholder are one word."""
    kind = slots(words, names)
    return np.where(kind > 0, mix(kind.astype(np.uint64)), words.hashes)


def needed(grams: np.ndarray) -> int:
    """How many different windows a passage shares with its item at least: what two edits
    leave of the windows of 20 words, counted as different ones, cut to SHARED."""
    span = PASSAGE - WINDOW + 1
    if len(grams) <= span:
        return 1
    least = min(len(set(grams[i : i + span].tolist())) for i in range(len(grams) - span + 1))
    return max(1, min(SHARED, least - 2 * WINDOW))


def _slabs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about SLAB characters, with the number of the first."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLAB):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _scan(names: np.ndarray, bits: np.ndarray, easy: np.ndarray, widths: tuple[int, ...]):
    """Places of documents with SHARED different windows that pass the filter, or one that
    passes the filter of the items that need fewer, and the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            texts_out: list[str] = []
            grams_out: list[np.ndarray] = []
            for base, texts in _slabs(batch.column(1).to_pylist()):
                words = Words(texts)
                kinds = template(words, names)
                hits, grams = [], []
                for width in widths:
                    place, gram = windows(kinds, words.text_of, width)
                    ok = _bit(bits, gram)
                    hits.append(place[ok])
                    grams.append(gram[ok])
                hit, gram = np.concatenate(hits), np.concatenate(grams)
                if not len(hit):
                    continue
                order = np.argsort(hit, kind="stable")
                hit, gram = hit[order], gram[order]
                doc = words.text_of[hit]
                edge = np.append(0, np.flatnonzero((np.diff(hit) > PASSAGE) | (np.diff(doc) != 0)) + 1)
                light = np.add.reduceat(_bit(easy, gram).astype(np.int64), edge)
                edge = np.append(edge, len(hit))
                for i in np.flatnonzero((np.diff(edge) >= SHARED) | (light > 0)).tolist():
                    lo, hi = int(edge[i]), int(edge[i + 1])
                    if not light[i] and len(set(gram[lo:hi].tolist())) < SHARED:
                        continue
                    d = int(doc[lo])
                    a = max(int(words.first[d]), int(hit[lo]) - AROUND)
                    b = min(int(words.first[d + 1]), int(hit[hi - 1]) + WINDOW + AROUND)
                    at.append(base + d)
                    texts_out.append(words.text(a, b))
                    grams_out.append(np.unique(gram[lo:hi]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(texts_out, pa.string()),
                    pa.array(grams_out, pa.list_(pa.int64())),
                ],
                ["doc_id", "words", "grams"],
            )

    return run


def holds_passage(document: list[str], item: list[str], kinds: list[int] | None = None, renamed: bool = False) -> bool:
    """True if ``document`` has all of the item, or at least PASSAGE consecutive words of
    it, with no more than EDITS of the words changed, dropped or added.

    ``renamed``: words whose placeholder (``kinds``, of the item's words; not 0) has one
    value in the item and another in the document count as no change if they do so
    consistently: one value of the item stands for one of the document and back. Slots
    that break this are edits."""
    n = len(item)
    if not n:
        return False
    edits, added, kept = np.zeros(n), np.zeros(n + 1), np.zeros(n, bool)
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    left, right = item, document
    if renamed and kinds:
        known = dict(zip(item, kinds))
        left = [f"\x01{k}" if k else w for w, k in zip(item, kinds)]
        right = [f"\x01{NUMBER}" if w.isdigit() else f"\x01{known[w]}" if known.get(w) else w for w in document]
    for kind, a, b, c, d in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            for i, j in zip(range(a, b), range(c, d)):
                x, y = item[i], document[j]
                same = x == y if left[i] == x else there.setdefault(x, y) == y and back.setdefault(y, x) == x
                kept[i], edits[i] = same, not same
        elif "".join(item[a:b]) == "".join(document[c:d]):
            kept[a:b] = True
        elif kind == "insert":
            added[a] += d - c
        else:
            edits[a:b] = 1
            added[b] += max(0, (d - c) - (b - a)) if kind == "replace" else 0
    # Edits before each word, and words added before it; a passage begins and ends with a
    # word that is there, so what stands around it doesn't count.
    made, more = np.append(0, edits.cumsum()), np.append(0, added.cumsum())
    first = last = np.flatnonzero(kept)
    if n < PASSAGE:
        first, last = np.array([0]), np.array([n - 1])
    length = last[None, :] + 1 - first[:, None]
    change = made[last + 1][None, :] - made[first][:, None] + more[last + 1][None, :] - more[first + 1][:, None]
    return bool(((length >= min(PASSAGE, n)) & (change <= EDITS * length)).any())


def _filter(hashes: DataFrame, column: str) -> np.ndarray:
    """The filter over a column of 64-bit hashes: its set bytes, gathered as at most 2^21
    small numbers."""
    slot = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    filled = (
        hashes.select(F.shiftright(slot, 3).alias("byte"), F.pow(F.lit(2), slot.bitwiseAND(F.lit(7))).cast("int").alias("bit"))
        .groupBy("byte")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bits[filled["byte"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint8)
    return bits


CAPITAL = re.compile(r"[^\W\d_][\w-]*")


def _names(items: DataFrame) -> DataFrame:
    """Hashes of the items' words that only stand with a capital, within sentences too;
    not of German, where all nouns do."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, small, large = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (lang or "").lower().startswith(("de", "ger")):
                    continue
                for m in CAPITAL.finditer(text):
                    before = text[: m.start()].rstrip()[-1:]
                    words.append(m[0])
                    small.append(not m[0][0].isupper())
                    large.append(m[0][0].isupper() and bool(before) and before not in ".?!:)")
            parts = Words(words)
            one = np.diff(parts.first) == 1
            at = parts.first[:-1][one]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts.hashes[at].view(np.int64)), pa.array(np.array(small, bool)[one]), pa.array(np.array(large, bool)[one])],
                ["h", "small", "large"],
            )

    found = items.select("lang", "text").mapInArrow(seen, "h long, small boolean, large boolean")
    return found.groupBy("h").agg(F.bool_or("small").alias("small"), F.bool_or("large").alias("large")).where("large and not small")


def find_leaks(documents: DataFrame, items: DataFrame, renamed: bool = False) -> DataFrame:
    """``doc_id``, ``item_id``: the document holds the item's text or at least 20
    consecutive words of it, with at most one word in ten changed, dropped or added.

    ``documents``: ``doc_id``, ``text``; ``items``: ``item_id``, ``text``, ``lang``.
    Rows without a key or text take no part; items without a word are never found, those
    of fewer than 5 words where all of them stand together. A passage begins and ends
    with words that are there. Each pair comes once, also where a document is repeated
    under its key. An item that stands under two ids gives a row for each. Other columns
    are ignored; an empty table on either side gives no rows.

    ``renamed``: numbers, units and names that are exchanged consistently (re-
    parameterised questions) count as no change; off, every changed slot is an edit.

    Plan: one scan of the corpus computes window hashes and keeps, through a filter of
    2 MB, the places that share windows with items. They are checkpointed; of places with
    the same words one meets the items' windows in an equi-join, in which only hashes
    take part. What shares enough is aligned, once for all its copies.
    """
    spark = documents.sparkSession
    items = items.where("item_id is not null and text is not null").select("item_id", "lang", "text")
    names = spark.sparkContext.broadcast(_filter(_names(items), "h"))

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, kinds, texts, need, width = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = Words([text])
                n = len(words.starts)
                width.append(min(n, WINDOW))
                gram = windows(template(words, names.value), words.text_of, width[-1])[1] if n else np.zeros(0, np.int64)
                texts.append(words.text(0, n))
                kinds.append(slots(words, names.value).astype(np.int32))
                need.append(needed(gram))
                grams.append(gram)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(texts, pa.string()),
                    pa.array(kinds, pa.list_(pa.int32())),
                    pa.array(need, pa.int32()),
                    pa.array(width, pa.int32()),
                    pa.array(grams, pa.list_(pa.int64())),
                ],
                ["item_id", "item_words", "kinds", "need", "width", "grams"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    prepared = items.select("item_id", "text").mapInArrow(
        item_windows, f"item_id {kind}, item_words string, kinds array<int>, need int, width int, grams array<long>"
    )
    by_item = prepared.select("item_id", "need", F.posexplode("grams").alias("at", "gram"))
    asked = prepared.where("width > 0").select("width", "need").distinct().collect()  # at most WINDOW x SHARED rows
    widths = tuple(sorted({r[0] for r in asked}))
    bits = spark.sparkContext.broadcast(_filter(by_item, "gram"))
    few = any(r[1] < SHARED for r in asked)
    nothing = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    easy = spark.sparkContext.broadcast(_filter(by_item.where(F.col("need") < SHARED), "gram") if few else nothing)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(names.value, bits.value, easy.value, widths)(batches)

    corpus = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    key = corpus.schema["doc_id"].dataType.simpleString()
    met_at = spread(corpus).mapInArrow(scan, f"doc_id {key}, words string, grams array<long>") if widths else None
    if met_at is None:
        return corpus.select("doc_id").join(items.select("item_id").where("false")).distinct()
    places = cut(met_at.withColumns({"h1": F.xxhash64("words"), "h2": F.hash("words")}))
    place = ["h1", "h2"]
    each = places.groupBy(*place).agg(F.first("words").alias("words"), F.first("grams").alias("grams"))
    met = (
        each.select(*place, F.explode("grams").alias("gram"))
        .join(by_item, "gram")
        .groupBy(*place, "item_id", "need")
        .agg(F.sort_array(F.collect_set("at")).alias("met"))
        # So many windows within one passage of the item, not here and there.
        .where(
            F.exists(
                F.sequence(F.lit(0), F.greatest(F.size("met") - F.col("need"), F.lit(0))),
                lambda i: F.get("met", i + F.col("need") - 1) - F.get("met", i) <= PASSAGE - WINDOW,
            )
        )
        .select(*place, "item_id")
        .join(prepared.select("item_id", "item_words", "kinds"), "item_id")
        .join(each.select(*place, "words"), place)
        # Few bytes, but much work for each: the width can't be left to their size.
        .repartition(shuffle_width(spark), *place, "item_id")
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for d, i, k in zip(*(batch.column(c).to_pylist() for c in ("words", "item_words", "kinds"))):
                whole = f" {i} " in f" {d} "
                d, i = d.split(" "), i.split(" ")
                ok.append(whole or holds_passage(d, i, k, renamed))
            yield batch.filter(pa.array(ok, pa.bool_())).select([*place, "item_id"])

    aligned = met.select(*place, "item_id", "words", "item_words", "kinds").mapInArrow(align, f"h1 long, h2 int, item_id {kind}")
    return aligned.join(places.select("doc_id", *place), place).select("doc_id", "item_id").distinct()
