"""Garbled text from wrong character encodings.

A wrong decoding is a substitution cipher: every letter became the same wrong letter, or - UTF-8
read as a single-byte page - the same short run of letters. Common keys of these ciphers are listed;
which of them garbled a stretch of text is hidden, and expectation maximisation against bigrams of
the corpus' clean text finds it, with a prior over keys learned per source. What no listed key explains
is treated as an unknown cipher of its source (``ciphers``): its letters are learned by expectation
maximisation against the bigrams of the other sources.
"""

from __future__ import annotations

import codecs
import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import salted_lookup
from strandline.session import arrow_map, cut, ship

#: Characters handled at once by a Python worker (one longer text goes alone).
SLICE = 2_000_000
#: Code pages as which UTF-8 bytes are read by mistake.
UTF8_READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8-r")
#: (read as, written in): whole lines of single-byte text read as another page.
PAGES_READ_AS = (
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "koi8-r"), ("koi8-r", "cp866"),
    ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"), ("iso8859-5", "koi8-r"), ("koi8-r", "iso8859-5"),
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("mac_roman", "cp1251"),
    ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"), ("cp1250", "cp1252"),
    ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp852", "cp1250"), ("cp1250", "cp852"),
    ("cp1252", "shift_jis"), ("cp1252", "euc_jp"),
)
WIDE = ("shift_jis", "euc_jp")
#: Chance per letter (nats) below which a pair of letters is unknown to the other sources, and above which it reads like text.
UNKNOWN, READABLE = -6.0, -5.0
LOST = "lost"
#: Evidence (nats) below which no text counts as garbled.
LEAST_GAIN = 6.0
_ENTITY = re.compile(r"&(?:#\d{2,7}|#x[0-9A-Fa-f]{2,6}|[A-Za-z]{2,8}\d{0,2});")

# --- characters as small numbers ---------------------------------------------------------------
_RANGES = ((0, 0x530), (0x5D0, 0x5EB), (0x621, 0x653), (0xE01, 0xE5C), (0x2000, 0x2070), (0x20A0, 0x20D0), (0x2100, 0x2150), (0x2200, 0x2300), (0x2500, 0x2600))
_KINDS = ((0x3040, 0x30A0), (0x30A0, 0x3100), (0x3100, 0xA000), (0xAC00, 0xD7B0), (0xFF00, 0xFFE0), *((a, a + 0x80) for a in range(0x530, 0x1F00, 0x80)))


@cache
def _classes() -> tuple[np.ndarray, int]:
    """A class for every code point of the basic plane: Latin, Greek, Cyrillic and signs one each, other scripts by block."""
    table, n = np.zeros(0x10000, np.int32), 1
    for a, b in _KINDS:
        table[a:b] = n
        n += 1
    for a, b in _RANGES:
        table[a:b] = np.arange(n, n + b - a)
        n += b - a
    return table, n


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _classes()[0][np.minimum(points, 0xFFFF)]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE, "right")))
        yield a, batch["text"].slice(a, b - a).to_pylist()
        a = b


# --- keys ----------------------------------------------------------------------------------------
@cache
def _page(name: str) -> tuple[dict[str, int], list[str]]:
    """Character -> byte and byte -> character; bytes a page leaves open stand for their control codes."""
    chars, back = [], {}
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
        back.setdefault(chars[-1], b)
    for b in range(128, 160):
        back.setdefault(chr(b), b)  # Latin-1 shares cp1252's key
    return back, chars


@cache
def _sequences(page: str, common: bool = False) -> re.Pattern:
    """Runs that, read back through ``page``, are multi-byte UTF-8; only of Latin letters and usual signs if ``common``."""
    back, _ = _page(page)

    def of(a: int, b: int) -> str:
        return "[" + "".join(re.escape(c) for c, n in back.items() if a <= n <= b) + "]"

    tail = of(0x80, 0xBF)
    if common:
        return re.compile(f"{of(0xC2, 0xC5)}{tail}|{of(0xE2, 0xE2)}{of(0x80, 0x84)}{tail}")
    return re.compile(f"(?:{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{tail}|{of(0xF0, 0xF4)}{tail}{tail}{tail})+")


@cache
def _any_sequence() -> re.Pattern:
    return re.compile("|".join(_sequences(p, True).pattern for p in UTF8_READ_AS[:4]) + "|�")


def _read_back(run: str, page: str) -> str | None:
    back, _ = _page(page)
    try:
        return bytes(back[c] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return None


@cache
def translation(read_as: str, written_in: str) -> dict[int, str]:
    """The ``str.translate`` table of a single-byte key."""
    back, _ = _page(read_as)
    _, chars = _page(written_in)
    return {ord(c): chars[b] for c, b in back.items() if b > 127 and chars[b] != c and ord(c) > 127}


@cache
def _wide_run() -> re.Pattern:
    """Where Japanese text read as cp1252 may stand: four letters of its upper half or more, at most one ASCII sign between."""
    upper = "".join(re.escape(c) for c, b in _page("cp1252")[0].items() if b > 127)
    return re.compile(f"(?:[{upper}][^\\n ]?){{4,}}")


def _apply_page(line: str, key: tuple[str, str]) -> str | None:
    if key[1] not in WIDE:
        return line.translate(translation(*key))
    back, _ = _page(key[0])

    def decode(m: re.Match) -> str:
        try:
            text = bytes(back[c] for c in m.group()).decode(key[1])
        except (UnicodeDecodeError, KeyError):
            return m.group()
        return text if all(ord(c) > 0x2FFF for c in text if ord(c) > 127) else m.group()

    return _wide_run().sub(decode, line)


# --- bigrams -------------------------------------------------------------------------------------
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, n = _classes()
    for batch in batches:
        for _, texts in _pieces(batch):
            clean = [t for t in texts if t and not _any_sequence().search(t)]
            codes = _codes("\n" + "\n\n".join(clean).lower() + "\n")
            pair, times = np.unique(codes[:-1] * np.int32(n) + codes[1:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(times.astype(np.int64))], ["pair", "n"])


@dataclass
class Bigrams:
    """Log chances of character pairs, from counts of at most (classes)**2 pairs."""

    pairs: np.ndarray
    counts: np.ndarray
    _table: np.ndarray | None = None
    _gains: dict[tuple[str, str, str, str], float] = field(default_factory=dict)

    def table(self) -> np.ndarray:
        if self._table is None:
            n = _classes()[1]
            counts = np.zeros(n * n, np.float32)
            counts[self.pairs] = self.counts
            counts = counts.reshape(n, n)
            single = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * n)
            self._table = np.log((counts + 2 * single) / (counts.sum(1, keepdims=True) + 2))
        return self._table

    def without(self, pairs: np.ndarray, own: np.ndarray) -> Bigrams:
        """The bigrams less ``own`` counts of ``pairs``, those of one source."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(len(self.pairs) - 1, 0))
        there = self.pairs[at] == pairs if len(self.pairs) else np.zeros(len(pairs), bool)
        counts = self.counts.copy()
        np.subtract.at(counts, at[there], own[there])
        return Bigrams(self.pairs, np.maximum(counts, 0))

    def singles(self) -> np.ndarray:
        n = _classes()[1]
        return np.bincount(self.pairs % n, self.counts, n)

    def chances(self, pairs: np.ndarray) -> np.ndarray:
        """Log chances of some pairs only, as ``table`` has them."""
        n = _classes()[1]
        after, before = self.singles(), np.bincount(self.pairs // n, self.counts, n)
        single = (after + 0.5) / (after.sum() + 0.5 * n)
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(len(self.pairs) - 1, 0))
        counts = np.where(self.pairs[at] == pairs, self.counts[at], 0) if len(self.pairs) else np.zeros(len(pairs))
        return np.log((counts + 2 * single[pairs % n]) / (before[pairs // n] + 2))

    def of(self, text: str) -> float:
        codes = _codes(text.lower())
        return float(self.table()[codes[:-1], codes[1:]].sum())

    def gain_of(self, before: str, run: str, after: str, page: str) -> float:
        """What reading ``run`` back through ``page`` gains between its neighbours; the same stretches come again and again."""
        known = (before, run, after, page)
        if known not in self._gains:
            if len(self._gains) > 200_000:
                self._gains.clear()
            letters = _read_back(run, page)
            self._gains[known] = 0.0 if letters is None else self.of(before + letters + after) - self.of(before + run + after)
        return self._gains[known]

    def __getstate__(self):
        return {"pairs": self.pairs, "counts": self.counts, "_table": None, "_gains": {}}


def learn_bigrams(documents: DataFrame) -> Bigrams:
    """Bigrams of all texts that hold no run of misread UTF-8 of a common kind: at most (classes)**2 rows."""
    texts = documents.where("text is not null").select("text")
    counted = arrow_map(texts, _count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    order = np.argsort(counted["pair"].to_numpy())
    return Bigrams(counted["pair"].to_numpy()[order], counted["n"].to_numpy()[order])


# --- evidence ------------------------------------------------------------------------------------
def _unescaped(text: str) -> str:
    """``text`` with the entities of non-ASCII characters resolved."""

    def one(m: re.Match) -> str:
        c = html.unescape(m.group())
        return c if len(c) == 1 and ord(c) > 127 else m.group()

    return _ENTITY.sub(one, text) if "&" in text else text


@cache
def _leads_and_tails(page: str) -> tuple[frozenset[str], frozenset[str]]:
    back, _ = _page(page)
    return frozenset(c for c, b in back.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in back.items() if 0x80 <= b <= 0xBF)


def _utf8_gains(text: str, model: Bigrams) -> dict[str, float]:
    gains: dict[str, float] = {}
    there = {c for c in set(text) if c > "\x7f"}
    for page in UTF8_READ_AS:
        if any(there.isdisjoint(some) for some in _leads_and_tails(page)):
            continue
        for m in _sequences(page).finditer(text):
            gain = model.gain_of(text[max(0, m.start() - 1) : m.start()] or "\n", m.group(), text[m.end() : m.end() + 1] or "\n", page)
            if gain > 0:
                gains[f"utf-8>{page}"] = gains.get(f"utf-8>{page}", 0.0) + gain
    return gains


_WORD = re.compile(r"\S{3,}")


@cache
def _class_map(key: tuple[str, str]) -> np.ndarray:
    """What a single-byte key, then lower-casing, makes of each class of characters."""
    table, n = _classes()
    out = np.arange(n, dtype=np.int32)
    swap = translation(*key)
    for a, b in _RANGES:
        for point in range(a, b):
            new = swap.get(point, chr(point)).lower()
            out[table[point]] = table[min(ord(new[0]), 0xFFFF)]
    return out


@cache
def _lower_map() -> np.ndarray:
    table, n = _classes()
    out = np.arange(n, dtype=np.int32)
    for a, b in _RANGES:
        for point in range(a, b):
            out[table[point]] = table[min(ord(chr(point).lower()[0]), 0xFFFF)]
    return out


@cache
def _lines() -> re.Pattern:
    """Box drawing signs in a row, each joined to the next."""
    names = {chr(p): unicodedata.name(chr(p)) for p in range(0x2500, 0x2580)}
    right = {c for c, n in names.items() if "RIGHT" in n or "HORIZONTAL" in n}
    left = {c for c, n in names.items() if "LEFT" in n or "HORIZONTAL" in n}
    return re.compile(f"[{''.join(sorted(right))}][{''.join(sorted(right & left))}]*[{''.join(sorted(left))}]")


def _drawn(word: str) -> bool:
    """Whether signs without letters are a drawing: joined lines, or at most two different non-ASCII signs."""
    return len({c for c in word if c > "\x7f"}) < 3 or _lines().fullmatch(word) is not None


def _page_gains(texts: list[str], model: Bigrams, keys: tuple[tuple[str, str], ...] = PAGES_READ_AS) -> tuple[list[dict[str, float]], list[list[str]]]:
    """For each text, the single-byte ``keys`` with their gain on the line they improve most, and the odd words no key explains.

    A line's gain is the sum over its words; single signs and letters prove nothing. A letter is what is
    one before or after the key is applied. Each different word is weighed once, under all keys.
    """
    owner, line_of, word_of, vocabulary, wide = [], [], [], {}, []
    for i, text in enumerate(texts):
        for line in text.split("\n"):
            if line.isascii():
                continue
            for w in _WORD.findall(line):
                if not w.isascii() and (sum(map(str.isalpha, w)) > 1 or not _drawn(w)):
                    line_of.append(len(owner))
                    word_of.append(vocabulary.setdefault(w, len(vocabulary)))
            if _wide_run().search(line):
                wide.append((i, line))
            owner.append(i)
    gains: list[dict[str, float]] = [{} for _ in texts]
    odd: list[list[str]] = [[] for _ in texts]
    table = model.table()
    if vocabulary:
        codes = _codes(" " + "".join(w + " " for w in vocabulary))
        starts = np.cumsum([0, *[len(w) + 1 for w in vocabulary]])[:-1]
        plain = _lower_map()[codes]
        now = np.add.reduceat(table[plain[:-1], plain[1:]], starts)
        points, at = np.unique(np.frombuffer(" ".join(["", *vocabulary, ""]).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        signs = [chr(p) for p in points]
        owner, line_of, word_of = np.array(owner), np.array(line_of), np.array(word_of)
        explained, lengths = np.zeros(len(vocabulary)), np.array([len(w) + 1 for w in vocabulary])
        for key in keys:
            if key[1] not in WIDE:
                new = _class_map(key)[codes]
                swap = translation(*key)
                letters = np.array([c.isalpha() or swap.get(ord(c), c).isalpha() for c in signs])[at]
                proven = np.add.reduceat(letters[:-1].astype(np.int32), starts) > 1
                better = np.where(proven, np.add.reduceat(table[new[:-1], new[1:]], starts) - now, 0.0)
                explained = np.where((better + now) / lengths > READABLE, np.maximum(explained, better), explained)
                best = np.zeros(len(texts))
                np.maximum.at(best, owner, np.bincount(line_of, better[word_of], len(owner)))
                for i in np.flatnonzero(best > 1):
                    gains[i][f"{key[1]}>{key[0]}"] = float(best[i])
        for line, word in zip(line_of[explained[word_of] <= 2], word_of[explained[word_of] <= 2]):
            odd[owner[line]].append(int(word))
        names = list(vocabulary)
        odd = [[names[w] for w in some] for some in odd]
    for i, line in wide:
        for key in keys:
            if key[1] in WIDE and (other := _apply_page(line, key)) != line:
                gain = model.of("\n" + other + "\n") - model.of("\n" + line + "\n")
                if gain > max(1, gains[i].get(f"{key[1]}>{key[0]}", 0)):
                    gains[i][f"{key[1]}>{key[0]}"] = gain
    return gains, odd


def _lost(text: str) -> bool:
    """Whether ``text`` holds replacement characters that no cut through a letter at its start or end explains."""
    if "�" not in text:
        return False
    text = text.strip()
    inside = text.strip("�")
    edge = max(len(text) - len(text.lstrip("�")), len(text) - len(text.rstrip("�")))
    widest = max((len(c.encode("utf-8", "surrogatepass")) for c in set(inside) if c > "\x7f" and c.isalpha()), default=1)
    return "�" in inside or edge >= widest


_EVIDENCE = "doc_id long, source string, key string, gain double, pair long, n long"


def _pair_rows(sources: list[str], odd: list[list[str]]) -> pa.RecordBatch | None:
    """Pairs of classes in the odd words of each source, counted."""
    n = _classes()[1]
    words: dict[str, list[str]] = {}
    for source, some in zip(sources, odd):
        if some:
            words.setdefault(source, []).extend(some)
    name, pair, times = [], [], []
    for source, some in words.items():
        codes = _codes(" " + " ".join(some) + " ").astype(np.int64)
        p, t = np.unique(codes[:-1] * n + codes[1:], return_counts=True)
        name += [source] * len(p)
        pair.append(p)
        times.append(t)
    if not name:
        return None
    size = len(name)
    nulls = [pa.nulls(size, pa.int64()), pa.array(name, pa.string()), pa.nulls(size, pa.string()), pa.nulls(size, pa.float64())]
    return pa.RecordBatch.from_arrays([*nulls, pa.array(np.concatenate(pair)), pa.array(np.concatenate(times).astype(np.int64))], ["doc_id", "source", "key", "gain", "pair", "n"])


def evidence(documents: DataFrame, model: Bigrams) -> DataFrame:
    """``doc_id, source, key, gain``: by how many nats each key makes a text's odd stretches likelier; and ``source, pair, n`` of the words no listed key explains.

    Only keys that explain something come out. A replacement character is evidence of key ``lost``, but
    for what a cut through one letter leaves at the very start or end of a right decoding: in a text with
    other non-ASCII letters, one for each byte of their longest but one. If ``documents`` has a column
    ``keys`` (learned ciphers of the source), those keys are weighed and no others. ASCII texts stay
    in the JVM.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    learned = "keys" in documents.columns

    def weigh(texts: list[str], own: list[list[str]] | None) -> tuple[list[dict[str, float]], list[list[str]]]:
        if own is None:
            return _page_gains(texts, shared.value)
        sums, odd = [{} for _ in texts], [[] for _ in texts]
        groups: dict[tuple[str, ...], list[int]] = {}
        for i, some in enumerate(own):
            groups.setdefault(tuple(some), []).append(i)
        for some, at in groups.items():
            pages = tuple(tuple(reversed(k.split(">"))) for k in some)
            for i, gains, left in zip(at, *_page_gains([texts[i] for i in at], shared.value, pages)):
                sums[i], odd[i] = gains, left
        return sums, odd

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, keys, gains = [], [], []
            for a, texts in _pieces(batch):
                texts = [_unescaped(t or "") for t in texts]
                there = [i for i, t in enumerate(texts) if not t.isascii()]
                own = [batch["keys"][a + i].as_py() for i in there] if learned else None
                found, odd = weigh([texts[i] for i in there], own)
                for i, sums, words in zip(there, found, odd):
                    if not learned:
                        misread = _utf8_gains(texts[i], shared.value)
                        sums |= misread
                        if "\ufffd" in texts[i] or max((v for k, v in sums.items() if k.startswith(("utf-8>", *WIDE))), default=0.0) >= LEAST_GAIN:
                            words.clear()  # a key of several bytes a letter explains the text
                        if _lost(texts[i]):
                            sums[LOST] = 100.0
                    place += [a + i] * len(sums)
                    keys += sums.keys()
                    gains += sums.values()
                pairs = _pair_rows([batch["source"][a + i].as_py() for i in there], odd)
                if pairs is not None:
                    yield pairs
            at = pa.array(place, pa.int64())
            empty = pa.nulls(len(place), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["source"].take(at), pa.array(keys, pa.string()), pa.array(gains, pa.float64()), empty, empty], ["doc_id", "source", "key", "gain", "pair", "n"])

    odd = "doc_id is not null and (octet_length(text) > length(text) or contains(text, '&'))"
    extra = ["keys"] if learned else []
    rows = documents.where(odd).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text", *extra)
    return arrow_map(rows, run, _EVIDENCE)


# --- unknown ciphers ---------------------------------------------------------------------------------

@cache
def single_byte_pages() -> tuple[str, ...]:
    """Every single-byte code page Python knows whose lower half is ASCII; of pages that agree, one."""
    from encodings.aliases import aliases

    found: dict[str, str] = {}
    for name in sorted(set(aliases.values())):
        try:
            if bytes(range(128)).decode(name) == "".join(map(chr, range(128))) and len("é".encode(name, "replace")) == 1:
                upper = bytes(range(128, 256)).decode(name, "replace")
                if len(upper) == 128 and upper.count("\ufffd") < 100:
                    found.setdefault(upper, name)
        except (LookupError, UnicodeError, ValueError):  # no text encoding
            continue
    return tuple(found.values())


@cache
def _signs() -> np.ndarray:
    """The character of each class that holds only one, else none."""
    table, n = _classes()
    out = np.full(n, "", object)
    for a, b in _RANGES:
        for point in range(a, b):
            out[table[point]] = chr(point)
    return out


def _em(pairs: np.ndarray, start: np.ndarray, joint: np.ndarray, n_fixed: int, rounds: int = 40, prior: float = 0.0) -> tuple[np.ndarray, float]:
    """Baum-Welch on counted pairs: what each unknown sign stands for, given how pairs of letters are distributed.

    ``pairs[i, j]``: how often sign j follows sign i; the first ``n_fixed`` signs and letters are ASCII and
    stand for themselves. ``start[l, c]``: first guess at the chance that letter l is written as sign c, which
    counts as ``prior`` uses of each sign, so that a few words don't overturn it and many do.
    """
    n_letters, n_signs = joint.shape[0] - n_fixed, pairs.shape[0] - n_fixed
    emit = np.zeros((n_fixed + n_letters, n_fixed + n_signs))
    emit[:n_fixed, :n_fixed] = np.eye(n_fixed)
    emit[n_fixed:, n_fixed:] = start / np.maximum(start.sum(1, keepdims=True), 1e-300)
    last, held = -np.inf, prior * start / np.maximum(start.sum(0), 1e-300) + 1e-6
    for _ in range(rounds):
        given = emit.T @ joint @ emit + 1e-300
        likely = float((pairs * np.log(given)).sum())
        if likely - last < 1e-6 * abs(likely):
            break
        last, ratio = likely, pairs / given
        hidden = emit * (joint @ emit @ ratio.T + joint.T @ emit @ ratio)  # E: expected uses of each sign by each letter
        block = hidden[n_fixed:, n_fixed:] + held
        emit[n_fixed:, n_fixed:] = block / block.sum(1, keepdims=True)  # M
    return emit[n_fixed:, n_fixed:], last


def learn_cipher(pair: np.ndarray, times: np.ndarray, model: Bigrams, *, least_gain: float = 40.0) -> tuple[str, str] | None:
    """``(read as, written in)`` of the cipher behind one source's unexplained pairs of signs, if there is one.

    Starts for the mapping of signs to letters are the pairs of code pages that gain most and an even
    guess; each is improved by expectation maximisation against the other sources' bigrams, and the
    likeliest mapping wins. Signs of clean words come to stand for themselves. The pair of code pages that
    agrees with the mapping where signs gain by it completes it: the rarer letters and the capitals, which
    text alone doesn't tell. Where no pair of code pages turns enough signs into readable text, as
    in a script of its own, nothing is learned.
    """
    n, lower, table_of, all_signs = _classes()[1], _lower_map(), _classes()[0], _signs()
    single_sign = np.ones(n, bool)
    single_sign[0] = False
    keep = single_sign[pair // n] & single_sign[pair % n]
    pair, times = pair[keep], times[keep].astype(float)
    rest = model.without(lower[pair // n].astype(np.int64) * n + lower[pair % n], times)
    is_ascii = np.zeros(n, bool)
    is_ascii[table_of[:128]] = True
    left, right = pair // n, pair % n
    use = np.bincount(left, times, n) + np.bincount(right, times, n)
    signs = np.flatnonzero((use > 0) & ~is_ascii & (all_signs != ""))
    signs = signs[np.argsort(-use[signs])][:512]
    kept = np.zeros(n, bool)
    kept[signs], kept[is_ascii] = True, True
    fine = kept[left] & kept[right] & ~(is_ascii[left] & is_ascii[right])
    left, right, times = left[fine], right[fine], times[fine]
    if times.sum() * 3 < least_gain:
        return None
    table, single = rest.table(), rest.singles()
    sign, weight = all_signs[signs], use[signs]
    place = np.full(n, -1)
    place[signs] = np.arange(len(signs))
    chance = table[lower[left], lower[right]]
    alpha = np.array([c.isalpha() for c in sign])
    ends = np.r_[place[left], place[right]]

    def gains(becomes: np.ndarray, letter: np.ndarray) -> tuple[float, np.ndarray]:
        """What a mapping gains on the signs it makes likelier, and which those are."""
        new = lower.copy()
        new[signs] = becomes
        after = table[new[left], new[right]]
        gain = times * (after - chance)
        net = np.bincount(ends[ends >= 0], np.r_[gain, gain][ends >= 0], len(signs))
        good = (net > 0) & letter & (becomes != lower[signs])
        inside = (is_ascii[left] | good[place[left]]) & (is_ascii[right] | good[place[right]])
        readable = float((times * after)[inside].sum()) > READABLE * float(times[inside].sum())  # real letters of a script no one else uses don't get there
        return (float(gain[inside].sum()) if readable else 0.0), good

    tried: dict[bytes, tuple[float, tuple[str, str], np.ndarray, np.ndarray]] = {}
    for read_as in single_byte_pages():
        back, _ = _page(read_as)
        code = np.array([back.get(c, 0) for c in sign])
        for written_in in single_byte_pages():
            if written_in == read_as:
                continue
            chars = _page(written_in)[1]
            becomes = np.array([lower[table_of[min(ord(chars[b]), 0xFFFF)]] if b > 127 else lower[c] for b, c in zip(code.tolist(), signs.tolist())])
            if becomes.tobytes() in tried:
                continue
            letter = alpha | np.array([b > 127 and chars[b].isalpha() for b in code.tolist()])
            gain, good = gains(becomes, letter)
            tried[becomes.tobytes()] = gain, (read_as, written_in), becomes, good
    proven = sorted((x for x in tried.values() if x[0] >= least_gain and x[3].sum() > 2), key=lambda x: (-x[0], x[1]))
    if not proven:  # whatever is learned, no code pages stand behind it
        return None

    letters = np.flatnonzero((single >= 1) & ~is_ascii & (all_signs != ""))
    letters = letters[np.argsort(-single[letters])][:320]
    fixed = np.unique(lower[table_of[:128]])
    known = np.r_[fixed, letters]
    joint = np.exp(table[np.ix_(known, known)]) * (single[known] + 0.5)[:, None]
    joint /= joint.sum()
    at = np.full(n, -1)
    at[fixed] = np.arange(len(fixed))
    at[signs] = len(fixed) + np.arange(len(signs))
    counts = np.zeros((len(fixed) + len(signs),) * 2)
    np.add.at(counts, (at[np.where(is_ascii[left], lower[left], left)], at[np.where(is_ascii[right], lower[right], right)]), times)
    where = {int(c): i for i, c in enumerate(letters)}
    best: tuple[float, tuple[str, str]] | None = None
    for start in [None, *(x[2] for x in proven[:8])]:
        guess = np.ones((len(letters), len(signs)))
        for j, c in enumerate(start if start is not None else ()):
            if int(c) in where:
                guess[where[int(c)], j] += 20.0 * len(signs)
        emit, likely = _em(counts, guess, joint, len(fixed), prior=0.0 if start is None else 5.0)
        likely -= 5.0 * len(signs) if start is None else 0.0  # what a guess of that many letters costs
        stands_for = letters[np.argmax(emit * (single[letters] + 0.5)[:, None], axis=0)]
        agree = [float(weight[x[3] & (x[2] == stands_for)].sum() / weight[x[3]].sum()) for x in proven]
        i = max(range(len(proven)), key=lambda i: (agree[i] * proven[i][0], proven[i][0]))
        if agree[i] >= 0.5 and (best is None or likely > best[0]):
            best = likely, proven[i][1]
    return best[1] if best else None


@cache
def _listed() -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(codecs.lookup(page).name for page in key) for key in PAGES_READ_AS)


def _ciphers_of(shared):
    def run(counted: pd.DataFrame) -> pd.DataFrame:
        key = learn_cipher(counted["pair"].to_numpy(), counted["n"].to_numpy(), shared.value)
        new = key is not None and tuple(codecs.lookup(page).name for page in key) not in _listed()  # listed keys have been weighed
        rows = [(counted["source"].iloc[0], f"{key[1]}>{key[0]}")] if new else []
        return pd.DataFrame(rows, columns=["source", "key"])

    return run


def ciphers(found: DataFrame, model: Bigrams) -> DataFrame:
    """``source, key``: an unknown cipher of each source, from the counted pairs of its unexplained words (at most (classes)**2 rows a source)."""
    ship(found.sparkSession)
    shared = found.sparkSession.sparkContext.broadcast(model)
    counted = found.where("pair is not null").groupBy("source", "pair").agg(F.sum("n").alias("n"))
    return counted.groupBy("source").applyInPandas(_ciphers_of(shared), "source string, key string")


def all_evidence(documents: DataFrame, model: Bigrams, rounds: int = 4) -> DataFrame:
    """``doc_id, source, key, gain`` under the listed keys and the ciphers learned per source.

    Each round learns at most one cipher a source from what is left unexplained and weighs the texts of
    the sources that got one again; it ends when nothing is learned, after ``rounds`` at the latest (a source
    mixes no more unknown ciphers than that).
    """
    found = cut(evidence(documents, model))
    out, known, left = found, None, found
    for _ in range(rounds):
        new = cut(ciphers(left, model))
        if known is not None:
            new = cut(new.join(known, ["source", "key"], "left_anti"))
        if new.isEmpty():
            break
        known = new if known is None else known.unionByName(new)
        keys = known.join(new.select("source"), "source", "left_semi").groupBy("source").agg(F.sort_array(F.collect_set("key")).alias("keys"))
        rows = documents.where("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
        sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
        left = cut(evidence(salted_lookup(rows, cut(keys.join(sizes, "source")), "source", ["doc_id"]), model))
        out = out.unionByName(left)
    return out.where("key is not null").groupBy("doc_id", "source", "key").agg(F.max("gain").alias("gain"))


# --- expectation maximisation ----------------------------------------------------------------------
def _fit(rounds: int, start: float):
    def run(seen: pd.DataFrame) -> pd.DataFrame:
        """Priors of one source's keys from counts of (key, rounded gain): at most keys x bins rows."""
        prior = dict.fromkeys(seen["key"].unique(), start)
        for _ in range(rounds):
            moved = 0.0
            for key, rows in seen.groupby("key"):
                odds = np.log(prior[key] / (1 - prior[key])) + rows["gain"].to_numpy()
                hidden = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))  # E: was it this key?
                new = float((hidden * rows["n"]).sum() + start) / (float(rows["n"].sum()) + 1)  # M, with one pseudo-document
                new = min(max(new, 1e-6), 1 - 1e-6)
                moved, prior[key] = max(moved, abs(new - prior[key])), new
            if moved < 1e-6:
                break
        return pd.DataFrame({"source": seen["source"].iloc[0], "key": list(prior), "prior": list(prior.values())})

    return run


def key_priors(found: DataFrame, *, rounds: int = 50, start: float = 0.01) -> DataFrame:
    """``source, key, prior`` by EM over each source's evidence, folded into counts of rounded gains first."""
    bins = found.select("source", "key", F.least(F.round("gain"), F.lit(60.0)).alias("gain")).groupBy("source", "key", "gain").agg(F.count(F.lit(1)).alias("n"))
    ship(found.sparkSession)
    return bins.groupBy("source").applyInPandas(_fit(rounds, start), "source string, key string, prior double")


def garbled(documents: DataFrame, *, least: float = 0.5, least_gain: float = LEAST_GAIN, model: Bigrams | None = None) -> DataFrame:
    """``doc_id, key, gain, posterior``: texts more likely garbled than not, and the likeliest key.

    ``documents`` has ``doc_id, source, text``. Null ids and texts are passed over, a null source is
    one of its own, repeated rows come out once, extra columns are ignored; an empty table gives an
    empty result. Whole texts are read.
    """
    found = cut(all_evidence(documents, model or learn_bigrams(documents)))
    odds = F.log(F.col("prior") / (1 - F.col("prior"))) + F.col("gain")
    judged = found.join(key_priors(found), ["source", "key"]).withColumn("posterior", 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(50.0)), F.lit(-50.0)))))
    sure = judged.where((F.col("posterior") >= least) & (F.col("gain") >= least_gain))
    order = {f"utf-8>{p}": -i for i, p in enumerate(UTF8_READ_AS)}  # of keys that explain as much, the commonest
    first = F.coalesce(F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("key")], F.lit(-99))
    best = F.struct(F.col("key") != LOST, F.round("gain", 3), first, "key", "gain", "posterior")
    return sure.groupBy("doc_id").agg(F.max(best).alias("b")).select("doc_id", "b.key", "b.gain", "b.posterior")


def restore(text: str, key: str, model: Bigrams | None = None) -> str:
    """``text`` with the key's substitutions undone, again and again while whole runs read back (text garbled twice)."""
    if key == LOST:
        return text
    written_in, read_as = key.split(">")
    text = _unescaped(text)
    if written_in == "utf-8":
        while True:  # each round makes the text shorter
            new = _sequences(read_as).sub(lambda m: m.group() if (r := _read_back(m.group(), read_as)) is None else r, text)
            if new == text:
                return text
            text = new
    return "\n".join(
        other if (other := _apply_page(line, (read_as, written_in))) and (model is None or model.of("\n" + other + "\n") > model.of("\n" + line + "\n")) else line for line in text.split("\n")
    )


def repaired(documents: DataFrame, **options) -> DataFrame:
    """``doc_id, key, text`` of the garbled texts, restored as far as their bytes survive."""
    model = learn_bigrams(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(garbled(documents, model=model, **options).select("doc_id", "key"), "doc_id").groupBy("doc_id", "key").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [restore(t, k, shared.value) for t, k in zip(batch["text"].to_pylist(), batch["key"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(out, pa.string())], ["doc_id", "key", "text"])

    return arrow_map(rows.select("doc_id", "key", "text"), run, "doc_id long, key string, text string")
