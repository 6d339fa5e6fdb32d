"""Exact token counts at every prefix of a text, by dynamic programming over merges.

For a byte-pair vocabulary, the tokens of a prefix end in the one token t such that the tokens of
what stands before t end in a token that t may follow; t may follow s if the merges leave s + t
as those two. So count[j] = count[i] + 1 for that split i, left to right, one pass per word, and
words that share a prefix share its states. Texts are sums of words: the pre-tokenizer cuts where
white space follows other text, and a bounded store keeps the counts of words seen. A text's counts are kept as signed steps (a prefix may
have more tokens than a longer one), so the count of any prefix, the longest prefix within a
budget and the tokens of a slice from the start are read off without encoding again.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches
from .common import texts
from .encoding import Encoder, Store, Words, cut_batch, cut_values, runs, slices

#: The public pattern by which byte-level vocabularies cut text (a fixed value of the file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TRUNCATION_LIMIT = 1024
#: Pairs of tokens whose order is remembered.
MAX_PAIRS = 400_000
_counters: dict[str, "PrefixCounter"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class PrefixCounter:
    """Counts for a byte-level .json vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(letters[c] for c in s)
        self.library = Encoder(path)
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = self.library.special
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
            raise ValueError("special strings that take part of their surroundings are not supported")
        self.vocab = {raw(s): i for s, i in model["vocab"].items() if s not in special}
        self.token = {i: t for t, i in self.vocab.items()}
        #: By last byte, the length of the longest token.
        self.longest = [0] * 256
        for t in self.vocab:
            self.longest[t[-1]] = max(self.longest[t[-1]], len(t))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.follows: dict[int, bool] = {}
        self.pattern, self.space = regex.compile(PATTERN), regex.compile(r"\s")
        self.words = Store("<i2")
        self.odd, self.other = Words(self.steps_of_cuts, True), Words(self.steps_of_cuts, False)

    def merged(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                break
            pair = (parts[best[1]], parts[best[1] + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        if len(self.follows) > MAX_PAIRS:
            self.follows.clear()
        x, y = self.token[a], self.token[b]
        found = self.follows[a << 20 | b] = self.merged(x + y) == [x, y]
        return found

    def extend(self, data: bytes, last: list[int], count: list[int]) -> None:
        """The recurrence for prefixes of data, one pre-token, that are longer than those that last and count have. A byte of no token counts nothing and ends what stands before it, as in the library."""
        vocab, longest, follows = self.vocab, self.longest, self.follows
        for j in range(len(count), len(data) + 1):
            for i in range(max(0, j - longest[data[j - 1]]), j):
                t = vocab.get(data[i:j])
                if t is not None:
                    before = last[i]
                    if before < 0:
                        break
                    may = follows.get(before << 20 | t)
                    if may or may is None and self.may_follow(before, t):
                        break
            else:
                last.append(-1)
                count.append(count[-1])
                continue
            last.append(t)
            count.append(count[i] + 1)

    def prefix_counts(self, data: bytes) -> list[int]:
        """Tokens of data[:j] for j = 0..len(data), data one pre-token."""
        last, count = [-1], [0]
        self.extend(data, last, count)
        return count

    def pre_tokens(self, cut: str) -> list[str]:
        if cut.isascii() or all(c < "ɐ" for c in cut):
            return self.pattern.findall(cut)
        # rarer letters: the library's own classes
        return [cut[a:b] for _, (a, b) in self.library.tokenizer.pre_tokenizer.pre_tokenize_str(cut)]

    def counts(self, cut: str) -> list[int]:
        """Count at each character of a cut that begins a pre-token, from 0.

        A special string ends what stands before it, and its prefixes are ordinary letters. Any
        number of them is linear: each is counted with what stands between it and the one before.
        """
        out, base, at = [], 0, 0
        for a, b in self.specials_in(cut):
            out += [base + n for n in self.plain_counts(cut[at : b - 1])]
            base += 1 + (self.plain_counts(cut[at:a])[-1] if a > at else 0)
            at = b
        return out + [base + n for n in self.plain_counts(cut[at:])]

    def specials_in(self, cut: str) -> list[tuple[int, int]]:
        """The special strings as written (the pattern finds any case)."""
        return [m.span() for m in self.special.finditer(cut) if self.library.tokenizer.token_to_id(m[0]) is not None and m[0].encode() not in self.vocab]

    def plain_counts(self, cut: str) -> list[int]:
        counts, base, pieces = [0], 0, self.pre_tokens(cut)
        patches = []
        for piece, after in zip(pieces, [*pieces[1:], ""]):
            data = piece.encode()
            by_byte = self.prefix_counts(data)
            ends = np.cumsum([len(c.encode()) for c in piece]).tolist() if len(data) != len(piece) else range(1, len(data) + 1)
            own = [by_byte[e] for e in ends]
            if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
                own[1] = 2  # short of its end, the apostrophe and the letter are pre-tokens
            counts += [base + n for n in own]
            if self.space.match(piece) and self.space.match(after):
                # a prefix that ends inside white space has all of that run as one pre-token
                patches.append((len(counts), base + self.prefix_counts((piece + after[0]).encode())[-1]))
            base += own[-1]
        for at, n in patches:
            counts[at] = n
        return counts

    def steps(self, cut: str) -> np.ndarray:
        """Change of the count at each character of a cut that begins a pre-token."""
        return np.diff(self.counts(cut))

    def steps_of_cuts(self, cuts: list[str]) -> list[bytes]:
        """Words of plain letters go in order, so that each takes over the states of the prefix it shares with the one before."""
        out: list[bytes] = [b""] * len(cuts)
        plain = []
        for k, c in enumerate(cuts):
            if c.isascii() and (c.isalpha() or c[:1] == " " and c[1:].isalpha()):
                plain.append((c.encode(), k))
            else:
                out[k] = self.steps(c).astype("<i2").tobytes()
        plain.sort()
        before, last, count = b"", [-1], [0]
        for data, k in plain:
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            self.extend(data, last, count)
            steps = array("h", map(sub, count[1:], count))
            if sys.byteorder == "big":
                steps.byteswap()
            out[k] = steps.tobytes()
            before = data
        return out

    def many(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.steps_of_cuts(cuts)
        n = np.array([len(v) // 2 for v in found], np.int64)
        return np.frombuffer(b"".join(found), "<i2"), np.cumsum(n) - n, n

    def cut(self, texts: pa.Array):
        return cut_batch(texts, True, self.words, self.many, self.other, self.special)

    def index(self, text: str | None) -> np.ndarray:
        """Signed steps by character; their running sum is the count of each prefix."""
        plain, cuts = self.cut(pa.array([text], pa.string()))
        if cuts is None:
            return np.frombuffer(b"".join(cut_values(text, True, self.odd, self.other, self.steps_of_cuts, self.special)), "<i2")
        codes, _, table = cuts
        n, at, ended = table.n[codes], table.at[codes], table.ended[codes] > 0
        out = np.ones(int((n + ended).sum()), "<i2")  # a stop or comma is a token
        ends = np.cumsum(n + ended)
        keep = np.ones(len(out), bool)
        keep[ends[ended] - 1] = False
        out[keep] = runs(table.flat, at, n)
        return out

    def counted(self, texts: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text its tokens and the characters of its longest prefix with at most limit tokens."""
        tokens, within = [], []
        for part in slices(texts):
            plain, cuts = self.cut(part)
            n, chars = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            if cuts is not None:
                codes, starts, table = cuts
                own = np.concatenate([[0], np.cumsum(table.flat, dtype=np.int64)])
                value = own[table.at + table.n] - own[table.at] + (table.ended > 0)
                size = table.n + (table.ended > 0)
                value, size = np.concatenate([[0], np.cumsum(value[codes])]), np.concatenate([[0], np.cumsum(size[codes])])
                total, length = value[starts[1:]] - value[starts[:-1]], size[starts[1:]] - size[starts[:-1]]
                for k in np.flatnonzero(total > limit).tolist():
                    a, b = starts[k], starts[k + 1]
                    # the last cut that begins within the budget; its end is beyond, or the next would
                    j = a + int(np.searchsorted(value[a : b + 1] - value[a], limit, side="left")) - 1
                    if j < a:
                        length[k] = 0
                        continue
                    c, begun = codes[j], value[j] - value[a]
                    steps = table.flat[table.at[c] : table.at[c] + table.n[c]]
                    steps = np.append(steps, 1) if table.ended[c] else steps
                    length[k] = size[j] - size[a] + chars_within(steps, limit - int(begun))
                n[plain], chars[plain] = total, length
            for k in np.flatnonzero(~plain).tolist():
                index = self.index(part[k].as_py())
                n[k], chars[k] = count(index), chars_within(index, limit)
            tokens.append(n)
            within.append(chars)
        return (np.concatenate(tokens), np.concatenate(within)) if tokens else (np.zeros(0, np.int64),) * 2


def count(index: np.ndarray, chars: int | None = None) -> int:
    """Tokens of the first chars characters (all: None)."""
    return int(index[:chars].sum(dtype=np.int64))


def chars_within(index: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most budget tokens."""
    if index.sum(dtype=np.int64) <= budget:
        return len(index)
    fits = np.flatnonzero(np.cumsum(index, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters.clear()
        _counters[path] = PrefixCounter(path)
    caches.use(_counters[path].words, _counters[path].odd, _counters[path].other)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = _TRUNCATION_LIMIT, keep_index: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit, chars_within_limit; with keep_index, prefix_steps (little-endian int16 per character).

    A null or empty text has 0 bytes and 0 tokens. Rows keep their multiplicity; other columns are
    dropped. Special strings inside texts count as the library's default has them. One narrow pass.
    """
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, chars_within_limit bigint"
    schema += ", prefix_steps binary" if keep_index else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n_tokens, within = own.counted(batch.column(1), limit)
            out = [batch.column(0), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(within)]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within_limit"]
            if keep_index:
                kept = [own.index(t.as_py()).tobytes() for t in batch.column(1)]
                out, names = [*out, pa.array(kept, pa.binary())], [*names, "prefix_steps"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return texts(docs).mapInArrow(run, schema)
