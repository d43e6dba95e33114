"""Texts garbled by a wrong character encoding: found by a classifier of encoding
chains, restored by inverting the chain.

A chain is a list of (written as, read as) steps. The classifier is multinomial over
hashed pairs of UTF-8 bytes, one class for each chain and one for clean text. It is
trained on words of clean documents that are garbled here by every chain. What it
suspects is inverted; a case is only what decodes strictly into text that the
classifier in turn finds far likelier as clean text than what stood there. Marks that
only failed decoding leaves (U+FFFD, C1 controls) are cases by themselves.
"""

from __future__ import annotations

import codecs
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.codepoints import Slab, Slices
from larkspur.llm.tokens import _slabs
from larkspur.session import spread

#: Documents, and characters of each, that the classifier is trained on at most.
TRAIN_DOCS, TRAIN_CHARS = 3000, 6000
BUCKETS = 1 << 16
#: Characters of a word that are judged at once; longer runs are judged in pieces.
PIECE = 48
#: Documents from which on a word weighs no more.
WEIGHT = 100
#: Log-likelihood by which a restored word must beat the word that stood there: a word of
#: the lexicon; another by a chain from a multi-byte encoding; another by one code page
#: read as another, where any bytes decode.
MARGIN_KNOWN, MARGIN, MARGIN_PAGE = 2.0, 7.0, 14.0
#: The same for a word of a code page that no document of the sample holds and that becomes
#: one that at least OFTEN of them hold.
MARGIN_OFTEN, OFTEN = 4.0, 5
CACHE = 1 << 20
MARKS = re.compile("[�\x80-\x84\x86-\x9f]")

#: References to characters, behind which garbled ones may stand.
REFERENCE = re.compile(r"&(?:#[0-9]{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,31}[0-9]{0,2});")

#: Letters of two alphabets side by side, which no restored word has.
MIXED = re.compile("[A-Za-zÀ-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ɏ]")
C1 = re.compile("[\x80-\x9f]")
ASCII = re.compile("[0-9A-Za-z]")
#: Texts that may be cases: others are ASCII without references.
SUSPECT = r"[^\x00-\x7f]|&[#A-Za-z][0-9A-Za-z]+;"
LETTERS = re.compile(r"[^\W\d_]+")

U = "utf-8"
#: The chains, as (written as, read as) steps.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    ((U, "latin-1"),),
    ((U, "cp1252"),),
    ((U, "cp1250"),),
    ((U, "cp1251"),),
    ((U, "mac_roman"),),
    ((U, "cp437"),),
    ((U, "cp850"),),
    ((U, "cp866"),),
    ((U, "koi8-r"),),
    ((U, "gb18030"),),
    ((U, "cp932"),),
    ((U, "big5"),),
    ((U, "latin-1"), (U, "latin-1")),
    ((U, "cp1252"), (U, "cp1252")),
    ((U, "latin-1"), (U, "cp1252")),
    ((U, "cp1252"), (U, "cp1252"), (U, "cp1252")),
    ((U, "latin-1"), (U, "latin-1"), (U, "latin-1")),
    ((U, "cp1251"), (U, "cp1251")),
    ((U, "lower-latin-1"),),
    ((U, "lower-cp1252"),),
    (("cp1252", "mac_roman"),),
    (("cp1252", "cp437"),),
    (("cp1252", "cp850"),),
    (("cp1252", "cp1251"),),
    (("cp1252", "koi8-r"),),
    (("mac_roman", "cp1252"),),
    (("cp437", "cp1252"),),
    (("cp850", "cp1252"),),
    (("cp1251", "cp1252"),),
    (("cp1251", "latin-1"),),
    (("cp1251", "koi8-r"),),
    (("cp1251", "cp866"),),
    (("cp1251", "mac_roman"),),
    (("koi8-r", "cp1251"),),
    (("koi8-r", "cp1252"),),
    (("koi8-r", "latin-1"),),
    (("cp866", "cp1251"),),
    (("cp866", "cp1252"),),
    (("cp932", "cp1252"),),
    (("cp932", "latin-1"),),
    (("euc_jp", "cp1252"),),
    (("euc_jp", "latin-1"),),
    (("euc_jp", "gb18030"),),
    (("gb18030", "cp1252"),),
    (("gb18030", "latin-1"),),
    (("gb18030", "cp932"),),
    (("big5", "cp1252"),),
    (("big5", "latin-1"),),
    (("cp932", "gb18030"),),
)
CLEAN = len(CHAINS)


def referred(text: str) -> str:
    """The text with the characters that its references stand for, but for ASCII."""
    if "&" not in text:
        return text
    return REFERENCE.sub(lambda m: m[0] if (c := html.unescape(m[0])).isascii() else c, text)


@cache
def _table(encoding: str) -> tuple[dict[int, int], str]:
    """Single-byte code page with the bytes it leaves undefined read as C1 controls, as
    most readers do."""
    chars = [codecs.decode(bytes([b]), encoding, "ignore") or chr(b) for b in range(256)]
    return {ord(c): b for b, c in reversed(list(enumerate(chars)))}, "".join(chars)


_SINGLE = {e for step in CHAINS for pair in step for e in pair if e[:2] in ("cp", "ma", "la", "ko") and e != "cp932"}


def write(text: str, encoding: str) -> bytes:
    """Bytes of ``text``; UnicodeError if it can't be written so."""
    if encoding.startswith("lower-"):
        return write(raised(text), encoding[6:])
    if encoding not in _SINGLE or not C1.search(text):
        return text.encode(encoding)
    table, _ = _table(encoding)
    try:
        return bytes([table[ord(c)] for c in text])
    except KeyError as e:
        raise UnicodeError(str(e)) from None


def read(data: bytes, encoding: str, errors: str = "strict") -> str:
    if encoding.startswith("lower-"):
        return read(data, encoding[6:]).lower()
    if encoding not in _SINGLE:
        return data.decode(encoding, errors)
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return data.decode("latin-1").translate(_table(encoding)[1])


def raised(text: str) -> str:
    """Undo lower case in the lead bytes of garbled UTF-8 (they are all capitals)."""
    return re.sub("[à-þ](?=[^\x00-\x7fà-þ])", lambda m: m[0].upper(), text)


#: Chains of one code page read as another, which decode any bytes.
PAGE = [len(c) == 1 and all(e in _SINGLE for e in c[0]) for c in CHAINS]


def core(word: str) -> str:
    """The longest run of letters, folded; the word itself if it has none."""
    runs = LETTERS.findall(word)
    return max(runs, key=len).casefold() if runs else word


def garble(text: str, chain: tuple) -> str | None:
    try:
        for wrote, reads in chain:
            text = read(write(text, wrote), reads, "replace" if reads in ("gb18030", "cp932", "big5") else "strict")
        return text
    except UnicodeError:
        return None


def invert(text: str, chain: tuple) -> str | None:
    """The text before the chain, or None where any step doesn't decode strictly."""
    try:
        for wrote, reads in reversed(chain):
            text = read(write(text, reads), wrote)
        return text
    except UnicodeError:
        return None


def invert_within(word: str, chain: tuple) -> tuple[str, str] | None:
    """(part of the word, that part inverted): the word, or, if it's long and may have been
    cut within a character, the longest part that decodes without at most 3 characters at
    either end."""
    whole = invert(word, chain)
    if whole is not None or len(word) < 12:
        return None if whole is None or whole == word else (word, whole)
    for lost in range(1, 7):
        for left in range(max(0, lost - 3), min(3, lost) + 1):
            part = word[left : len(word) - (lost - left)]
            r = invert(part, chain)
            if r is not None:
                return None if r == part else (part, r)
    return None


def _stretches(data: bytes, at: int, encoding: str) -> list[tuple[int, int, str | None]]:
    """(from, to, text) of the stretches of ``data`` from ``at`` on; None for a text that
    doesn't decode."""
    out: list[tuple[int, int, str | None]] = []
    view = memoryview(data)
    while at < len(data):
        try:
            out.append((at, len(data), read(bytes(view[at:]), encoding)))
            break
        except UnicodeDecodeError as e:
            if e.start:
                out.append((at, at + e.start, read(bytes(view[at : at + e.start]), encoding)))
            out.append((at + e.start, at + e.end, None))
            at += e.end
    return out


def _pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte pairs of all words end to end (blank at either side), and their starts."""
    data = [b" " + w.encode("utf-8", "surrogatepass") + b" " for w in words]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    pair = (flat[:-1] << 8 | flat[1:]) & (BUCKETS - 1)
    return pair, np.append(0, lengths.cumsum())[:-1]


class Classifier:
    """Log probabilities of byte pairs by class, given the pair's first byte, so that
    texts of different lengths compare; pairs of ASCII tell nothing and weigh 0."""

    def __init__(self, classes: list[dict[str, int]], smoothing: float = 0.02):
        # Words that two clean documents of the sample hold, and their letters alone.
        known = Counter()
        for w, n in classes[CLEAN].items():
            for form in {w, core(w)}:
                known[form] += n
        self.lexicon = frozenset(w for w, n in known.items() if n > 1)
        self.common = frozenset(w for w, n in classes[CLEAN].items() if n > 1)
        self.often = frozenset(w for w, n in classes[CLEAN].items() if n >= OFTEN)
        self.held = frozenset(classes[CLEAN])
        counts = np.zeros((BUCKETS, len(classes)), np.float64)
        for k, words in enumerate(classes):
            if words:
                pair, starts = _pairs(list(words))
                length = np.diff(np.append(starts, len(pair)))
                weight = np.repeat(np.fromiter(words.values(), np.float64, len(words)), length)
                counts[:, k] = np.bincount(pair, weight, minlength=BUCKETS)
        index = np.arange(BUCKETS)
        ascii_only = ((index >> 8) < 128) & ((index & 255) < 128)
        total = counts.reshape(256, 256, -1).sum(1, keepdims=True)
        shaped = counts.reshape(256, 256, -1)
        table = np.log((shaped + smoothing) / (total + smoothing * 256)).reshape(BUCKETS, -1)
        table[:, counts.sum(0) == 0] = -30.0
        table[ascii_only] = 0
        self.table = table.astype(np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, classes) log-likelihoods."""
        if not words:
            return np.zeros((0, self.table.shape[1]), np.float32)
        pair, starts = _pairs(words)
        return np.add.reduceat(self.table[pair], starts, axis=0)

    def clean(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.float32)
        pair, starts = _pairs(words)
        return np.add.reduceat(self.table[pair, CLEAN], starts)


#: Blanks, quotes and brackets that a word may stand between within a run.
BORDER = re.compile("[\xa0\u202f\u3000«»‹›‘’‚‛“”„‟「」『』【】（）、。，；：]+")
#: Characters of UTF-8, one of them of several bytes.
_SEVERAL = rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2})"
UTF8 = re.compile(rb"[\x00-\x7f]*(?:" + _SEVERAL + rb"[\x00-\x7f]*)+")
UTF8_ONLY = re.compile(rb"(?:" + _SEVERAL + rb"){2,}")
codecs.register_error("larkspur.ff", lambda e: (b"\xff" * (e.end - e.start), e.end))
READ = sorted({c[-1][1] for c in CHAINS})


@cache
def _writable() -> tuple[list[re.Pattern], list[re.Pattern], frozenset[str]]:
    """Runs of what each encoding that texts are read as can write: code pages, the
    others (but gb18030, which writes everything), and all characters of the code pages."""
    pages, others, high = [], [], set()
    for e in sorted({e.removeprefix("lower-") for e in READ} - {"gb18030"}):
        codes = [bytes([a]) for a in range(128, 256)]
        if e not in _SINGLE:
            codes += [a + bytes([b]) for a in codes for b in range(0x40, 0xFF)]
        chars = {c for b in codes for c in b.decode(e, "ignore")}
        pattern = re.compile("[\x00-\x7f" + "".join(map(re.escape, sorted(chars))) + "]+")
        (pages if e in _SINGLE else others).append(pattern)
        high |= chars if e in _SINGLE else set()
    return pages, others, frozenset(high)


HIGH = re.compile("[^\x00-\x7f]")
HIGHS = re.compile("[^\x00-\x7f]{2}")


def _within(word: str) -> set[str]:
    """Parts of a word that may be garbled beside characters that aren't: between borders,
    runs that an encoding can write, and those whose bytes are UTF-8."""
    if len(HIGH.findall(word)) < 2:
        return set()
    pages, others, high = _writable()
    out = {word, *BORDER.split(word)}
    for part in list(out):
        paged = not high.isdisjoint(part)
        for pattern in [*(pages if paged else ()), *others]:
            out.update(pattern.findall(part))
        if not HIGHS.search(part):
            continue
        for reads in READ:
            code = reads.removeprefix("lower-")
            if code in _SINGLE:
                if paged:
                    data = (raised(part) if code != reads else part).encode(code, "larkspur.ff")
                    out.update(part[m.start() : m.end()] for m in UTF8.finditer(data))
            elif part is word:
                found = [m.span() for m in UTF8_ONLY.finditer(word.encode(code, "larkspur.ff"))]
                found = [(a, b) for a, b in found if b - a > 5]
                bounds = np.cumsum([0, *(len(c.encode(code, "larkspur.ff")) for c in word)]) if found else ()
                for a, b in found:
                    i, j = int(np.searchsorted(bounds, a)), int(np.searchsorted(bounds, b, "right")) - 1
                    out.update(part[k:n] for k in range(i, i + 3) for n in range(j, j - 3, -1) if n - k > 2)
    out.discard(word)
    return {w for w in out if len(w) > 1 and not w.isascii()}


WORD = re.compile("[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
DIGIT = re.compile("[0-9]")


def _words(text: str) -> list[str]:
    out = []
    for w in WORD.findall(DIGIT.sub("0", text)):
        out += [w[i : i + PIECE] for i in range(0, len(w), PIECE)]
    return [w for w in out if not w.isascii()]


def _outdone(held: Counter) -> set[str]:
    """Rule for the training sample only: words that some chain turns back into a word
    that more documents hold."""
    out = set()
    for w, n in held.items():
        for k, chain in enumerate(CHAINS):
            r = invert(w, chain)
            if r is not None and r != w and held.get(r, 0) > n and not (PAGE[k] and len(core(r)) < 3):
                out.add(w)
                break
    return out


def _rightful() -> list[str]:
    """Rare characters that are right by themselves: letters with marks, Greek, Cyrillic,
    punctuation, currencies, arrows, mathematical signs, box drawing. A sample may lack
    them, and what was never seen would otherwise pass for garbled."""
    blocks = ((0xA1, 0x180), (0x370, 0x460), (0x2010, 0x2060), (0x2070, 0x2200), (0x2200, 0x2300), (0x2500, 0x2600))
    chars = [chr(c) for a, b in blocks for c in range(a, b) if unicodedata.category(chr(c))[0] in "LNPS"]
    return [*chars, *(c + c for c in chars), *(f"a{c}" for c in chars), *(f"{c}a" for c in chars)]


def train(texts: list[str]) -> Classifier:
    """Classifier from a bounded sample of texts, most of them clean; those that look
    garbled by rule are left out. A word weighs by the documents that hold it, so the
    few garbled words that the rule misses don't pass for clean ones."""
    docs = [d for t in texts if (d := set(_words(t))) and not any(map(MARKS.search, d))]
    outdone = _outdone(Counter(w for d in docs for w in d))
    held = Counter(w for d in docs if not d & outdone for w in d)
    clean = {w: 1 for w in _rightful()} | {w: min(n, WEIGHT) for w, n in sorted(held.items())}
    classes: list[dict[str, int]] = []
    for chain in CHAINS:
        made: dict[str, int] = {}
        for w, n in clean.items():
            g = garble(w, chain)
            if g is not None and g != w:
                made[g] = n
        classes.append(made)
    return Classifier([*classes, clean])


class Judge:
    """Verdicts on words: None, or (chain, restored word or None)."""

    def __init__(self, model: Classifier):
        self.model = model
        self.seen: dict[int, bool] = {}
        self.parts: dict[str, tuple[int, str | None] | None] = {}

    def words(self, words: list[str], marks: bool = True) -> list[tuple[int, str | None] | None]:
        """``marks``: a word with marks is a case whatever its chain. A word that is no case
        as a whole is one if a part of it is."""
        out = self._whole(words, marks)
        common = self.model.common
        parts = {i: _within(w) - common for i, w in enumerate(words) if out[i] is None and w not in common}
        if len(self.parts) > CACHE:
            self.parts.clear()
        fresh = sorted({w for some in parts.values() for w in some if w not in self.parts})
        self.parts.update(zip(fresh, self._whole(fresh, False)))
        for i, some in parts.items():
            cases = [w for w in some if self.parts[w] is not None]
            if cases:
                out[i] = self.parts[max(cases, key=lambda w: (len(w), w))]
        return out

    def _whole(self, words: list[str], marks: bool) -> list[tuple[int, str | None] | None]:
        out: list = [None] * len(words)
        for i, w in enumerate(words):
            if marks and MARKS.search(w):
                out[i] = (-1, None)
        scores = self.model.scores(words)
        base = scores[:, CLEAN]
        tries: list[tuple[int, int, str, str]] = []
        order = np.argsort(-scores[:, :CLEAN], axis=1)[:, :10]
        for i, w in enumerate(words):
            if out[i] is not None or w in self.model.common:
                continue
            for c in order[i].tolist():
                if scores[i, c] <= base[i] - 2:
                    break
                found = invert_within(w, CHAINS[c])
                if found is not None and not MARKS.search(found[1]) and not MIXED.search(found[1]):
                    tries.append((i, c, *found))
        before = self.model.clean([t[2] for t in tries])
        after = self.model.clean([t[3] for t in tries])
        best: dict[int, tuple[float, int, str]] = {}
        for (i, c, part, r), gain in zip(tries, (after - before).tolist()):
            if gain > self._margin(c, part, r) and (i not in best or gain > best[i][0]):
                best[i] = (gain, c, r)
        for i, (_, c, r) in best.items():
            out[i] = (c, r)
        return out

    def _margin(self, chain: int, word: str, restored: str) -> float:
        letters = core(restored)
        # A symbol beside letters or digits, or a short word, read in another code page.
        if PAGE[chain] and restored in self.model.often and word not in self.model.held and (len(letters) > 1 or ASCII.search(word)):
            return MARGIN_OFTEN
        if PAGE[chain] and (len(letters) < 3 or core(word) in self.model.lexicon):
            return float("inf")
        if (restored in self.model.lexicon or letters in self.model.lexicon) and (
            core(word) not in self.model.lexicon
        ):
            return MARGIN_KNOWN
        if PAGE[chain]:
            return MARGIN_PAGE if sum(c > "\x7f" for c in word) > 2 else float("inf")
        return MARGIN

    def slab(self, texts: list[str]) -> np.ndarray:
        """True for each text with a garbled word. Words are found by whole-array
        operations; each different word is judged once."""
        slab = Slab([referred(t) for t in texts])
        p = slab.points
        high = np.flatnonzero(p > 127)
        flags = np.zeros(len(texts), bool)
        if not len(high):
            return flags
        edge = np.zeros(len(p) + 2, bool)
        blank = (p == 32) | (p == 10) | (p == 13) | (p == 9)
        edge[: len(p)] = blank
        edge[1 : len(p) + 1] |= blank
        edge[slab.starts] = True
        bounds = np.flatnonzero(edge)
        at = np.searchsorted(bounds, high, "right") - 1
        at = at[np.append(True, at[1:] != at[:-1])]
        start = bounds[at]
        end = np.append(bounds, len(p))[at + 1]
        pieces = -(-(end - start) // PIECE)
        step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        s = np.repeat(start, pieces) + step * PIECE
        e = np.minimum(s + PIECE, np.repeat(end, pieces))
        digits = (p >= 48) & (p <= 57)
        hashes = Slices(np.where(digits, 48, p)).hash(s, e)
        unique, example, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.seen) > CACHE:
            self.seen.clear()
        keys = unique.tolist()
        fresh = [i for i, k in enumerate(keys) if k not in self.seen]
        for lo in range(0, len(fresh), 4096):
            some = fresh[lo : lo + 4096]
            words = [DIGIT.sub("0", slab.joined[s[example[i]] : e[example[i]]]) for i in some]
            for i, verdict in zip(some, self.words(words)):
                self.seen[keys[i]] = verdict is not None
        bad = np.fromiter((self.seen[k] for k in keys), bool, len(keys))[back]
        flags[np.searchsorted(slab.starts, s[bad], "right") - 1] = True
        return flags

    def restore(self, text: str) -> tuple[str, list[int], int]:
        """The text with its garbled words restored, the chains used, and how many places
        (words, or within words that don't decode as a whole runs of characters) could
        not be restored."""
        text = self._open(text)
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b] for a, b in spans]
        verdicts = self.words([DIGIT.sub("0", w) for w in words])
        parts = self._parts(words, verdicts)
        known = [v[0] for v in [*verdicts, *parts.values()] if v and v[0] >= 0]
        main = max(sorted(set(known)), key=known.count) if known else -1
        out, at, lost, used = [], 0, 0, set()
        for i, ((a, b), w, v) in enumerate(zip(spans, words, verdicts)):
            v = parts.get(i, v)
            # A word too short to be judged follows the chain of the rest of its text.
            if v is None and main >= 0 and self._leans(w, main):
                v = (main, None)
            if v is None:
                continue
            chain = v[0] if v[0] >= 0 else main
            fixed = invert(w, CHAINS[chain]) if chain >= 0 else None
            left = 0
            if fixed is None or MARKS.search(fixed):
                chain, fixed, left = self._fixed(w, v[0], main)
            lost += left
            if fixed == w:
                continue
            used.add(chain)
            out += [text[at:a], fixed]
            at = b
        return "".join([*out, text[at:]]), sorted(used), lost

    def _open(self, text: str) -> str:
        """The text with the references of its garbled words opened; others stay."""
        if "&" not in text:
            return text
        runs = re.split("([ \t\r\n]+)", text)
        opened = {i: r for i, run in enumerate(runs) if "&" in run and (r := referred(run)) != run}
        pieces = [(i, p) for i, r in opened.items() for p in _words(r)]
        for (i, _), v in zip(pieces, self.words([p for _, p in pieces])):
            if v is not None:
                runs[i] = opened[i]
        return "".join(runs)

    def _parts(self, words: list[str], verdicts: list) -> dict[int, tuple[int, None]]:
        """Verdicts on the words that hold marks, or are too long to be judged whole, by
        the chain of most of their pieces between U+FFFD."""
        owner, pieces = [], []
        for i, (w, v) in enumerate(zip(words, verdicts)):
            if (v is None and len(w) > PIECE) or (v is not None and v[0] < 0):
                some = [p for part in w.split("\ufffd") for p in _words(part)]
                owner += [i] * len(some)
                pieces += some
        chains: dict[int, Counter] = {}
        for i, v in zip(owner, self.words(pieces, marks=False)):
            if v is not None:
                chains.setdefault(i, Counter())[v[0]] += 1
        return {i: (n.most_common(1)[0][0], None) for i, n in chains.items()}

    def _fixed(self, word: str, own: int, main: int) -> tuple[int, str, int]:
        """Chain, text and places left of a garbled word that its chain doesn't invert: by
        another chain that inverts it as a whole, or in parts, by its own chain (-1: not
        known) or the one of most of its text, whichever is likelier. A chain of code
        pages isn't taken over from the text."""
        whole = [(c, r) for c in range(CLEAN) if (r := invert(word, CHAINS[c])) is not None and r != word]
        whole = [(c, r) for c, r in whole if not MARKS.search(r) and not MIXED.search(r)]
        if whole:
            before, *after = self.model.clean([word, *(r for _, r in whole)]).tolist()
            gain, c, r = max((g - before, -c, r) for (c, r), g in zip(whole, after))
            if gain > self._margin(-c, word, r):
                return -c, r, 0
        made = [(own, word, 1)]
        for c in dict.fromkeys((own, main)):
            if c < 0 or (PAGE[c] and c != own):
                continue
            fixed, left = word, 0
            for k, (wrote, reads) in enumerate(reversed(CHAINS[c])):
                fixed, left = self._undo(fixed, wrote, reads, final=k == len(CHAINS[c]) - 1)
            if fixed != word:
                made.append((c, fixed, left))
        return made[int(np.argmax(self.model.clean([m[1] for m in made])))]

    def _undo(self, word: str, wrote: str, reads: str, final: bool) -> tuple[str, int]:
        """One step undone where it decodes strictly, between U+FFFD and characters that
        ``reads`` can't write; in the last step only where that is likelier. Other
        characters stay as they stand; of one of which a byte belongs to a neighbour that
        decodes, U+FFFD stays. Also the number of places that stay and that ``reads`` can
        write, but for borders and what clean texts hold."""
        plain = raised(word) if reads.startswith("lower-") else word
        code = reads.removeprefix("lower-")
        tokens: list[tuple[str, bool]] = []  # text, decoded; ("", False): torn
        run: list[bytes] = []
        for i, c in enumerate([*plain, "\ufffd"]):
            try:
                data = b"" if c == "\ufffd" else write(c, code)
            except UnicodeError:
                data = b""
            if data:
                run.append(data)
                continue
            if run:
                tokens += self._decoded(word[i - len(run) : i], run, wrote, final)
                run = []
            if i < len(word):
                tokens.append((word[i], not MARKS.match(c)))
        out, left, within = "", 0, False
        for (t, good), (after, _) in zip(tokens, [*tokens[1:], ("", True)]):
            if not t and not out.endswith("\ufffd") and not after.startswith("\ufffd"):
                t = "\ufffd"
            odd = not (good or t.isascii() or BORDER.fullmatch(t) or t in self.model.common)
            left += odd and not within
            within = odd or (within and not t)
            out += t
        return out, left

    def _decoded(self, text: str, run: list[bytes], wrote: str, final: bool) -> list[tuple[str, bool]]:
        """Tokens of a run of characters and their bytes."""
        data = b"".join(run)
        bounds = np.append(0, np.cumsum([len(b) for b in run]))

        def held(a: int, b: int) -> str:
            return text[np.searchsorted(bounds, a, "right") - 1 : np.searchsorted(bounds, b)]

        # A code of two bytes may have lost its first byte to the mark before.
        shifts = (0, 1) if wrote not in _SINGLE and wrote != U and len(data) > 1 else (0,)
        ways = [[(0, k, None)] * (k > 0) + _stretches(data, k, wrote) for k in shifts]
        if len(ways) > 1:
            ways.sort(key=lambda w: -self.model.clean(["".join(t or "\ufffd" for *_, t in w)])[0])
        # ASCII out of another character's last byte tells nothing by itself.
        asked = [(a, b, t) for a, b, t in ways[0] if t is not None and (not t.isascii() or t == held(a, b))]
        if final:
            before = self.model.clean([held(a, b) for a, b, _ in asked])
            after = self.model.clean([t for *_, t in asked])
            asked = [x for x, gain in zip(asked, (after - before).tolist()) if gain > 0 and not MARKS.search(x[2])]
        tokens: list[tuple[str, bool]] = []
        torn = ("", False)
        at = 0
        for a, b, t in [*asked, (len(data), len(data), "")]:
            if at < a:
                lo, hi = int(np.searchsorted(bounds, at)), int(np.searchsorted(bounds, a, "right")) - 1
                if lo > hi:
                    tokens.append(torn)
                else:
                    tokens += [torn] * int(bounds[lo] != at)
                    tokens += [(text[lo:hi], False)] * (lo < hi)
                    tokens += [torn] * int(bounds[hi] != a)
            tokens += [(t, True)] * bool(t)
            at = b
        return tokens

    def _leans(self, word: str, chain: int) -> bool:
        r = invert(word, CHAINS[chain])
        if r is None or r == word:
            return False
        before, after = self.model.clean([word, r]).tolist()
        return after > before


def _sample(df: DataFrame, key: str, text: str) -> list[str]:
    """Texts of TRAIN_DOCS documents, those of the smallest hashes of their keys."""
    narrow = df.where(F.col(text).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(text).alias("t"))
    cut = narrow.select("h").orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0]
    if cut is None:
        return []
    rows = narrow.where(F.col("h") <= cut).select(F.substring("t", 1, TRAIN_CHARS)).limit(2 * TRAIN_DOCS).collect()
    return [r[0] for r in rows]


def fit(df: DataFrame, key: str = "doc_id", text: str = "text") -> Classifier:
    """Train on a bounded sample of the table."""
    return train(_sample(df, key, text))


def find_garbled(df: DataFrame, key: str = "doc_id", text: str = "text", model: Classifier | None = None) -> DataFrame:
    """``key`` of every row whose text holds garbled characters, be it in one word.

    Characters behind references (``&#195;``) count. NULL and empty texts and those of
    ASCII without references are no case; a repeated row comes as often as it
    stands. Whole texts are read. Other columns are ignored. There is no shuffle,
    unless the table is read in fewer pieces than there are cores; the classifier (a
    table of fixed size) is broadcast.
    """
    model = model or fit(df, key, text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _slabs(texts):
                flags = judge.slab(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).filter(pa.array(flags))], ["key"])

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(SUSPECT))
    kind = narrow.schema["key"].dataType.simpleString()
    return spread(narrow).mapInArrow(run, f"key {kind}").withColumnRenamed("key", key)


def restore_garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``restored`` (the text with every word, or part of one, restored that
    decodes), ``chains`` (array of names), ``lost`` (places that can't be restored) of the
    rows that ``find_garbled`` gives."""
    model = fit(df, key, text)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = ["; ".join(f"{a} read as {b}" for a, b in c) for c in CHAINS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _slabs(texts):
                at = np.flatnonzero(judge.slab(texts[lo:hi])) + lo
                done = [judge.restore(texts[i]) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        pa.array([d[0] for d in done], pa.string()),
                        pa.array([[names[c] for c in d[1]] for d in done], pa.list_(pa.string())),
                        pa.array([d[2] for d in done], pa.int64()),
                    ],
                    ["key", "restored", "chains", "lost"],
                )

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(SUSPECT))
    kind = narrow.schema["key"].dataType.simpleString()
    schema = f"key {kind}, restored string, chains array<string>, lost long"
    return spread(narrow).mapInArrow(run, schema).withColumnRenamed("key", key)
