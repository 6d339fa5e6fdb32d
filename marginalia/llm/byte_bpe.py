"""Byte-level BPE from a file of ranks: encoding with offsets, and decoding.

The file gives bytes and their ranks. Each token becomes a string of the letters that stand for its
bytes, and every split of it into two tokens becomes a merge, in the order of the tokens' ranks, so
that the tokenizers library merges as the ranks ask. Only where two splits of one token overlap
(bytes x y z with x + y = y + z a token) could the order of its merges count instead of the place:
pieces that hold such bytes are merged here, by rank and then place. Texts go to the library by
distinct words, as in `encoding`. Offsets follow from the bytes: a token's bytes cover the characters
from the one its first byte is in to the one its last byte is in, so a character that several
tokens share belongs to each. Decoding reads the letters' table backwards; tokens that hold part of a
character are held back until it is whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches
from .common import texts
from .encoding import Encoder, little, runs
from .token_counts import PATTERN, byte_letters

_encoders: dict[str, "RankEncoder"] = {}
_decoders: dict[str, "Decoder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def overlaps(ranks: dict[bytes, int]) -> set[bytes]:
    """The strings x + y + z in which one token is both x + y and y + z, x and y of different lengths."""
    found = set()
    for t in ranks:
        for n in range(1, len(t)):
            if 2 * n != len(t) and t[:n] == t[-n:] and t[:-n] in ranks and t[:n] in ranks and t[n:] in ranks:
                found.add(t[:-n] + t)
    return found


class RankEncoder(Encoder):
    """An Encoder for a file of ranks; without special strings."""

    def load(self, path: str):
        import ahocorasick
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.ranks, letters = read_ranks(path), byte_letters()
        name = {t: "".join(map(letters.__getitem__, t)) for t in self.ranks}
        merges = [(name[t[:i]], name[t[i:]]) for t in sorted(self.ranks, key=self.ranks.get) for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        out = Tokenizer(models.BPE(vocab={name[t]: r for t, r in self.ranks.items()}, merges=merges, ignore_merges=True))
        bytes_to_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(PATTERN), "isolated"), bytes_to_letters])
        self.byte = {c: b for b, c in enumerate(letters)}
        self.contested = ahocorasick.Automaton()
        for s in overlaps(self.ranks):
            self.contested.add_word(s.decode("latin-1"), True)
        if len(self.contested):
            self.contested.make_automaton()
        return out

    def is_contested(self, data: bytes) -> bool:
        return len(self.contested) > 0 and next(self.contested.iter(data.decode("latin-1")), None) is not None

    def direct(self, texts: list[str]) -> list[bytes]:
        odd = [self.is_contested(t.encode()) for t in texts]
        plain = iter(super().direct([t for t, o in zip(texts, odd) if not o]))
        return [self.by_piece(t) if o else next(plain) for t, o in zip(texts, odd)]

    def joined(self, words: list[str], between: str):
        return None if self.is_contested(between.join(words).encode()) else super().joined(words, between)

    def by_piece(self, text: str) -> bytes:
        ids, known = [], {}
        for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            if piece not in known:
                data = bytes(map(self.byte.__getitem__, piece))
                known[piece] = self.merged(data) if self.is_contested(data) else [t.id for t in self.tokenizer.model.tokenize(piece)]
            ids += known[piece]
        return little(ids)

    def merged(self, data: bytes) -> list[int]:
        """Ids of one piece: the pair of least rank is merged, the leftmost of equals, until none is a token."""
        if data in self.ranks:
            return [self.ranks[data]]
        ends = list(range(1, len(data) + 1))  # of the part that starts here
        before = list(range(-1, len(data) - 1))
        alive = [True] * len(data)
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and (b := ends[a]) < len(data) and (rank := self.ranks.get(data[a : ends[b]])) is not None:
                heapq.heappush(heap, (rank, a, ends[b]))

        for a in range(len(data)):
            offer(a)
        while heap:
            _, a, end = heapq.heappop(heap)
            if not alive[a] or (b := ends[a]) >= len(data) or ends[b] != end:
                continue  # one of its parts has grown since
            alive[b], ends[a] = False, end
            if end < len(data):
                before[end] = a
            offer(before[a])
            offer(a)
        return [self.ranks[data[a : ends[a]]] for a in range(len(data)) if alive[a]]


class Decoder:
    def __init__(self, path: str):
        letters = byte_letters()
        by_id = {i: "".join(map(letters.__getitem__, t)) for t, i in read_ranks(path).items()}
        byte = {c: b for b, c in enumerate(letters)}
        data = [bytes(map(byte.__getitem__, by_id.get(i, ""))) for i in range(max(by_id, default=-1) + 2)]
        #: Bytes of each id; the last stands for ids that the file has not.
        self.n = np.fromiter(map(len, data), np.int64, len(data))
        self.at = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(data), np.uint8)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.n[np.minimum(ids, len(self.n) - 1)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id that the file has not stands for none."""
        ids = np.minimum(ids, len(self.n) - 1)
        return runs(self.flat, self.at[ids], self.n[ids]).tobytes()

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        """The text that each id completes: empty while a character is not whole. What never becomes a character is U+FFFD; the last item ends the text."""
        own = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield own.decode(self.decode(np.array([i])))
        yield own.decode(b"", True)

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each id's bytes, and the one after its last."""
        n = self.sizes(ids)
        data = np.frombuffer(self.decode(ids), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(n)
        start = np.append(character, character[-1] + 1 if len(character) else 0)[ends - n]
        return start.astype(np.int32), np.where(n > 0, character[np.maximum(ends - 1, 0)] + 1 if len(character) else 0, start).astype(np.int32)


def encoder(path: str) -> RankEncoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = RankEncoder(path)
    own = _encoders[path]
    caches.use(own.words, own.odd, own.other)
    return own


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders.clear()
        _decoders[path] = Decoder(path)
    return _decoders[path]


def encode(docs: DataFrame, ranks: str, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Per row of docs: doc_id, ids (binary, little-endian unsigned 32-bit); with offsets, starts and ends (characters, arrays of int); with decoded, the bytes that ids stand for, decoded in the same pass, so that a task has one Python worker.

    A null or empty text has no ids. Texts are taken whole, however long. Rows keep their
    multiplicity and a null doc_id; other columns are dropped; an empty table gives an empty one.
    One narrow pass.
    """
    schema = "doc_id bigint, ids binary" + (", starts array<int>, ends array<int>" if offsets else "") + (", decoded binary" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = encoder(ranks), decoder(ranks) if offsets or decoded else None
        for batch in batches:
            ids = own.encode_all(batch.column(1))
            out, names = [batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"]
            if offsets:
                both = [back.offsets(np.frombuffer(i, "<u4")) for i in ids]
                out, names = [*out, *(pa.array([x[k] for x in both], pa.list_(pa.int32())) for k in (0, 1))], [*names, "starts", "ends"]
            if decoded:
                out, names = [*out, pa.array([back.decode(np.frombuffer(i, "<u4")) for i in ids], pa.binary())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return texts(docs).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Per row: doc_id, ids, decoded (the bytes that ids stand for; UTF-8 where they are those of a text).

    Null or no ids: no bytes. Ids that the file has not stand for none. Rows keep their
    multiplicity; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(ranks)
        for batch in batches:
            data = [own.decode(np.frombuffer(i.as_buffer() or b"", "<u4")) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Per row of decode's: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = F.coalesce("ids", F.lit(b""))
    return decoded.select("doc_id", F.floor(F.length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """digests of decode of encode, made in one pass: per row of docs doc_id, n_tokens, ids_sha256, decoded_sha256. Neither ids nor bytes leave the tasks.

    A null or empty text has no ids and no bytes; rows as for encode.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = encoder(ranks), decoder(ranks)
        for batch in batches:
            n, shas, texts_ = [], [], []
            for ids in own.encode_all(batch.column(1)):
                n.append(len(ids) // 4)
                shas.append(hashlib.sha256(ids).hexdigest())
                texts_.append(hashlib.sha256(back.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(texts_, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
