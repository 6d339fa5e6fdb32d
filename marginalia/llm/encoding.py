"""Token ids of whole texts, exactly as the tokenizers library gives them, by distinct words.

Both pre-tokenizers end a piece wherever white space follows other text, so a text may be cut
there and each cut encoded by the library by itself. A batch is cut and its distinct cuts are
numbered by Arrow kernels; only distinct cuts are looked up, by 128-bit keys in sorted arrays of
bounded bytes, and those that are new are encoded many at a time, joined by a separator whose id
marks where each ends. A text's ids are then gathered by number. Whatever a cut may hold (special
strings, digits, marks) is the library's own business. Texts with white space that Python, Arrow
and the library class differently take a slower way, cut by cut or whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import caches
from .wordhash import mix

#: Bytes that a worker's values of words may take, and those of a dictionary of other cuts, about.
CACHE_BYTES, DICTIONARY_BYTES = 24 << 20, 4 << 20
#: Bytes of the longest word that is kept.
LONGEST = 64
#: What an entry takes beside its key's letters and its value's bytes.
_ENTRY = 190
_ENDS = frozenset(".,")
#: Words that are encoded as one text.
JOINED = 256
#: Bytes of text that are cut at once.
SLICE_BYTES = 2 << 20
_ODD_SPACE = re.compile(r"\s\s|[^\S \n]")
_CONTROL = re.compile(r"[\x0b\x0c\x1c-\x1f]")
_CUTS = re.compile(r"\s*\S+|\s+")
_OTHER_SPACE = r"\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What plain texts do not hold, for either kind of vocabulary.
_NOT_PLAIN = {True: r"[ \n][ \n]|[\t\r" + _OTHER_SPACE + r"]|\A[ \n]|[ \n]\z", False: f"[{_OTHER_SPACE}]"}
#: Letters and digits for every version of Unicode.
_PLAIN = re.compile(r"[0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_encoders: dict[str, "Encoder"] = {}


class Words(dict):
    """cut -> value, bounded by limit bytes. own_many gives the values of cuts not seen yet, all at once.

    If spaced, a key without leading white space stands for a space and the word. Once full, no
    more is kept; when a full dictionary answers under a quarter of what it is asked, it starts afresh.
    """

    def __init__(self, own_many, spaced: bool, limit: int = DICTIONARY_BYTES):
        self.own_many, self.spaced, self.limit = own_many, spaced, limit
        self.size = self.asked = self.missed = 0
        caches.register(self)
        self.ends = dict(zip(".,", own_many([".", ","])))

    def clear(self) -> None:
        super().clear()
        self.size = self.asked = self.missed = 0

    def values_of(self, cuts: list[str]) -> list[bytes]:
        found = list(map(self.get, cuts))
        if None in found:
            missing = [c for c, v in zip(cuts, found) if v is None]
            if self.size > self.limit:
                self.asked += len(cuts)
                self.missed += len(missing)
                if self.asked > 100_000 and self.missed > 0.75 * self.asked:
                    self.clear()
            new = self.learn(set(missing))
            found = [new[c] if v is None else v for c, v in zip(cuts, found)]
        return found

    def learn(self, cuts: set[str]) -> dict[str, bytes]:
        """Values of cuts that are not kept; kept from now on if there is room."""
        values = {"": b""}
        ended = [c for c in cuts if c[-1:] in _ENDS and len(c) > 1 and _PLAIN.match(c[-2])]
        own = cuts.difference(ended)
        if ended:
            own.update([c[:-1] for c in ended])
            values.update([(c, v) for c in own if (v := self.get(c)) is not None])
        new = list(own.difference(values))
        values.update(zip(new, self.own_many([c if c[0] == "\n" else " " + c for c in new] if self.spaced else new)))
        values.update([(c, values[c[:-1]] + self.ends[c[-1]]) for c in ended])
        if self.size <= self.limit:
            self.update(values)
            self.size += sum(map(len, values)) + sum(map(len, values.values())) + _ENTRY * len(values)
        return values


_random = np.random.default_rng(11)
_LETTER = _random.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(0, 1 << 63, (2, LONGEST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])


class Store:
    """Runs of values by the two keys of a word, bounded by limit bytes; keys are sorted. Fills and starts afresh as Words does."""

    def __init__(self, kind: str, limit: int = CACHE_BYTES):
        self.kind, self.limit = kind, limit
        self.clear()
        caches.register(self)

    def clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used, self.asked, self.missed = np.zeros(1 << 12, self.kind), 0, 0, 0

    def size(self) -> int:
        return 28 * len(self.key) + self.flat.itemsize * self.used

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Places of sorted keys, -1 where absent."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = np.where((self.key[at] == key) & (self.check[at] == check), at, -1)
        if self.size() > self.limit:
            self.asked += len(found)
            self.missed += int((found < 0).sum())
            if self.asked > 100_000 and self.missed > 0.75 * self.asked:
                self.clear()
                return np.full(len(key), -1)
        return found

    def add(self, key: np.ndarray, check: np.ndarray, flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        if self.size() > self.limit:
            return
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(flat), self.used // 2) + 4096, self.kind)])
        self.flat[self.used : self.used + len(flat)] = flat
        key, check, at, n = (np.concatenate(x) for x in ((self.key, key), (self.check, check), (self.at, at + self.used), (self.n, n.astype(np.int32))))
        self.used += len(flat)
        order = np.argsort(key, kind="stable")
        self.key, self.check, self.at, self.n = key[order], check[order], at[order], n[order]


def runs(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[at : at + n] of each, one after another."""
    ends = np.cumsum(n, dtype=np.int64)
    return flat[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Table:
    """Values of a batch's distinct cuts: runs (at, n) of flat; ended: 1 or 2 where the value of a full stop or comma follows."""

    def __init__(self, numbered: pa.Array, store: Store, own_many):
        data, offsets = np.frombuffer(numbered.buffers()[2] or b"", np.uint8), np.frombuffer(numbered.buffers()[1], np.int32, len(numbered) + 1, 4 * numbered.offset)
        first, size = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
        last = np.where(size > 1, first + size - 1, 0)
        ended = np.where((size > 1) & _ALNUM[data[np.maximum(last - 1, 0)]], (data[last] == 46) + 2 * (data[last] == 44), 0) if len(data) else np.zeros(len(size), np.int64)
        size = size - (ended > 0)
        short = (size <= LONGEST) & (size > 0)
        keys = np.zeros((2, len(size)), np.uint64)
        if short.any():
            n = size[short]
            starts = np.cumsum(n) - n
            letters, place = data[np.repeat(first[short] - starts, n) + np.arange(n.sum())], np.arange(n.sum()) - np.repeat(starts, n)
            for k in range(2):
                keys[k, short] = mix(np.add.reduceat(_LETTER[k][letters] * _PLACE[k][place], starts) + n.astype(np.uint64))
        key, where, inverse = np.unique(keys[0], return_index=True, return_inverse=True)
        check = keys[1][where]
        alone = np.flatnonzero(~short & (size > 0) | (check[inverse] != keys[1]))  # long words, or one key for two words
        there = size[where] > 0
        there &= short[where]
        place = np.full(len(key), -1)
        place[there] = store.find(key[there], check[there])
        new = np.flatnonzero(there & (place < 0))
        strings = lambda which: [w[:-1] if e else w for w, e in zip(numbered.take(pa.array(which)).to_numpy(zero_copy_only=False).tolist(), ended[which].tolist())]
        own_flat, own_at, own_n = own_many(strings(where[new])) if len(new) else (np.zeros(0, store.kind), np.zeros(0, np.int64), np.zeros(0, np.int64))
        old = np.flatnonzero(place >= 0)
        old_at, old_n = store.at[place[old]], store.n[place[old]].astype(np.int64)
        flat = [runs(store.flat, old_at, old_n), own_flat]
        at, n = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        at[old], n[old] = np.cumsum(old_n) - old_n, old_n
        at[new], n[new] = own_at + len(flat[0]), own_n
        if len(new):
            store.add(key[new], check[new], own_flat, own_at, own_n)
        self.at, self.n, self.ended = at[inverse], n[inverse], ended
        if len(alone):
            alone_flat, alone_at, alone_n = own_many(strings(alone))
            self.at[alone], self.n[alone] = alone_at + sum(map(len, flat)), alone_n
            flat.append(alone_flat)
        self.flat = np.concatenate(flat)

    def append(self, values: list[bytes]) -> None:
        n = np.fromiter(map(len, values), np.int64, len(values)) // self.flat.itemsize
        self.at, self.n = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n]), np.concatenate([self.n, n])
        self.ended = np.concatenate([self.ended, np.zeros(len(n), self.ended.dtype)])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(values), self.flat.dtype)])


class Encoder:
    """byte_level: a pre-tokenizer that ties one space to the word after it; else white space is dropped."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = self.load(path)
        self.byte_level = self.tokenizer.normalizer is None
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(sorted(special, key=len, reverse=True)) or r"(?!)", re.I)
        self.separator = "\n" if self.byte_level else "|"
        self.separator_id = self.tokenizer.encode(self.separator, add_special_tokens=False).ids
        #: What a text of joined words must not hold beside its words and separators.
        self.unjoined = re.compile(r"[^\S \n]|[ɐ-\U0010ffff]" if self.byte_level else r"[^\S ]|[ɐ-\U0010ffff]")
        self.words = Store("<u4")
        self.odd = Words(lambda cuts: pieces(*self.many(cuts)), self.byte_level)
        self.other = Words(self.direct, False)
        self.ends = np.frombuffer(b"".join(self.odd.ends[c] for c in ".,"), "<u4")

    def load(self, path: str):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def direct(self, texts: list[str]) -> list[bytes]:
        """Ids of each as the library gives them, little-endian unsigned 32-bit."""
        return [little(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of cuts of one word, as runs (at, n) of the first: those of ordinary letters are encoded many at once."""
        lines = [i for i, c in enumerate(cuts) if c[0] == "\n"] if self.byte_level else []
        plain = [i for i, c in enumerate(cuts) if c[0] != "\n"] if lines else range(len(cuts))
        flat, sizes = [], []
        for own, between in ((plain, self.separator if self.byte_level else f" {self.separator} "), (lines, "")):
            for at in range(0, len(own), JOINED):
                words = [cuts[i] for i in own[at : at + JOINED]]
                ids, n = self.joined(words, between) or self.apart(words)
                flat.append(ids)
                sizes.append(n)
        n, at = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64)
        order = [*plain, *lines]
        n[order] = np.concatenate([np.zeros(0, np.int64), *sizes])
        at[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate([np.zeros(0, "<u4"), *flat]), at, n

    def apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.direct(words)
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(v) // 4 for v in found])

    def joined(self, words: list[str], between: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their number by word of words that are encoded as one text; None if that would not show where each ends. With nothing between, each begins with the separator."""
        text, mark = between.join(words), self.separator
        marks = len(words) - 1 if between else len(words)
        spaces = (len(words) if between else 0) if self.byte_level else 2 * marks
        if len(self.separator_id) != 1 or text.count(mark) != marks or text.count(" ") != spaces or self.unjoined.search(text) or self.special.search(text):
            return None
        ids = np.array(self.encoded(text), "<u4")
        cuts = np.flatnonzero(ids == self.separator_id[0])
        if len(cuts) != marks:
            return None
        if between:
            return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        return ids, np.diff(np.append(cuts, len(ids)))

    def encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null: none."""
        return bytes(self.encode_all(pa.array([text], pa.string()))[0])

    def encode_all(self, texts: pa.Array) -> list[memoryview]:
        """Of each text (null: empty) its ids, as views of little-endian unsigned 32-bit integers."""
        out: list[memoryview] = []
        for part in slices(texts):
            plain, cuts = self.cut(part)
            if cuts is None:
                out += [memoryview(self.one(t.as_py())) for t in part]
                continue
            codes, starts, table = cuts
            end = table.ended[codes]
            n = table.n[codes] + (end > 0)
            ends = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(table.at[codes] - ends[:-1], n) + np.arange(ends[-1])
            marks = ends[1:][end > 0] - 1
            at[marks] = 0
            ids = table.flat[at] if len(table.flat) else np.zeros(0, "<u4")
            ids[marks] = self.ends[end[end > 0] - 1]
            raw, at = memoryview(ids).cast("B"), (4 * ends[starts]).tolist()
            views = iter([raw[a:b] for a, b in zip(at, at[1:])])
            out += [next(views) if p else memoryview(self.one(t.as_py())) for p, t in zip(plain, part)] if len(at) <= len(part) else views
        return out

    def cut(self, texts: pa.Array):
        """Which texts are plain, and of those the number of each cut, the starts of texts among the cuts (and their end), and the values by number."""
        return cut_batch(texts, self.byte_level, self.words, self.many, self.other, self.special)

    def one(self, text: str | None) -> bytes:
        return b"".join(cut_values(text, self.byte_level, self.odd, self.other, self.direct, self.special))


def pieces(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[bytes]:
    raw, size = flat.tobytes(), flat.itemsize
    return [raw[size * a : size * (a + k)] for a, k in zip(at.tolist(), n.tolist())]


def little(ids: list[int]) -> bytes:
    ids = array("I", ids)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def slices(texts: pa.Array) -> list[pa.Array]:
    """Runs of texts of about SLICE_BYTES."""
    if not len(texts):
        return []
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff((ends - 1) // SLICE_BYTES)) + 1
    bounds = [0, *cuts.tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(bounds, bounds[1:])]


def cut_batch(texts: pa.Array, byte_level: bool, words: Store, own_many, other: Words, special: re.Pattern):
    """See Encoder.cut; None for the second if no text is plain."""
    texts = pc.fill_null(texts, "")
    plain = pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN[byte_level]))
    if not byte_level:  # specials are case-sensitive and letters are not, so a text that may hold one goes another way
        plain = pc.and_(plain, pc.invert(pc.match_substring_regex(texts, special.pattern, ignore_case=True)))
    plain = plain.to_numpy(zero_copy_only=False)
    if not plain.any():
        return plain, None
    if not plain.all():
        texts = texts.filter(pa.array(plain))
    if byte_level:
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    else:
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))])
    flat = parts.flatten()
    numbered = flat.dictionary_encode()
    codes = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spaced = (lambda cuts: own_many([c if c[0] == "\n" else " " + c for c in cuts])) if byte_level else own_many
    table = Table(numbered.dictionary, words, spaced)
    if byte_level:  # a text's first cut has no space before it
        firsts = flat.take(pa.array(starts[:-1])).to_numpy(zero_copy_only=False).tolist()
        codes[starts[:-1]] = len(table.n) + np.arange(len(firsts))
        table.append(other.values_of(firsts))
    return plain, (codes, starts, table)


def cut_values(text, byte_level, words: Words, other: Words, direct, special: re.Pattern) -> list[bytes]:
    """The values of a text's cuts in order; words is keyed without the space before a word, other by the cut itself."""
    if not text:
        return []
    if _CONTROL.search(text):
        return direct([text])
    if not byte_level:
        if special.search(text):
            return direct([text])
        try:
            text.encode("latin-1")
            text = text.lower()  # these vocabularies lower-case; for such letters, alike in Python
        except UnicodeEncodeError:
            pass
        return words.values_of(text.split())
    if not (_ODD_SPACE.search(text) or text[0].isspace() or text[-1].isspace()):
        cuts = text.replace("\n", " \n").split(" ")
        return other.values_of(cuts[:1]) + words.values_of(cuts[1:])
    cuts = _CUTS.findall(text)
    plain = [len(c) > 1 and c[0] in " \n" and not c[1].isspace() for c in cuts]
    of_words = iter(words.values_of([c.removeprefix(" ") for c, p in zip(cuts, plain) if p]))
    of_others = iter(other.values_of([c for c, p in zip(cuts, plain) if not p]))
    return [next(of_words) if p else next(of_others) for p in plain]


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    caches.use(_encoders[path].words, _encoders[path].odd, _encoders[path].other)
    return _encoders[path]
