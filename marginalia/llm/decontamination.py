"""Benchmark decontamination by latent semantic retrieval.

Passages (WINDOW words, every STRIDE words) and benchmark passages are TF-IDF vectors; words and
document frequencies are counted over all documents. A randomised SVD finds the latent space of what
is indexed, the benchmark: the range of A'A over all of its passages is sketched with random vectors,
each power step summed over partitions. All passages of all documents are folded in and searched
by cosine against the benchmark's passages; first a passage's weight on benchmark words, which
bounds its cosine, rules most out. Beside it, words shared with an item are counted: wherever they
are enough for a subsequence that counts, there is a candidate too, so none is lost to rare words
about it. Candidates are confirmed by the longest common subsequence with
the item around the passage. A long one is a copy (of an item under COPY_WORDS words only with half
of its answer words); a shorter one is a paraphrase only if nearly all of the item's answer words
(its `answer` column, else its rarest words) are there too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches
from .common import release, texts, written
from .wordhash import mix

WINDOW, STRIDE, ITEM_PASSAGE = 32, 16, 64
#: The features, the rank of the latent space and the power steps that find it.
FEATURES, RANK, POWER = 8_000, 128, 2
#: Benchmark passages searched for in one pass over the documents.
ITEMS_IN_PASS = 4000
#: Share of the cosine that an item would have with itself.
COSINE = 0.42
COPY, COPY_ANSWER, COPY_WORDS, PARAPHRASE, PARAPHRASE_ANSWER, ANSWER_WORDS = 0.75, 0.5, 12, 0.55, 0.8, 6
SPACE = 1 << 20
_MARKS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
OUT = "doc_id bigint, contaminated boolean, item_id bigint, lcs double, answer double, n_items int"


_random = np.random.default_rng(5)
_LETTER = _random.integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_LETTER[32] = 0
_PLACE = _random.integers(0, 1 << 32, 64, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def cleaned(text: str | None) -> bytes:
    """Lower case, marks as spaces."""
    return (text or "").lower().encode("utf-8", "replace").translate(_MARKS)


def words_of(text: str | None) -> list[bytes]:
    return cleaned(text).split()


def places_of_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The place (a hash) of each word of cleaned texts, and where each text begins among them (and the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([0, *[len(t) + 1 for t in texts]])
    in_word = data != 32
    starts = np.flatnonzero(in_word[1:] & ~in_word[:-1]) + 1
    if len(data) and in_word[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    # letters weigh by their place in the word; spaces weigh nothing, so a word's sum may run over those after it
    place = np.arange(starts[0], len(data), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(data))))
    place &= 63
    sums = np.add.reduceat(_LETTER[data[starts[0] :]] * _PLACE[place], starts - starts[0], dtype=np.uint32)
    return (mix(sums.astype(np.uint64)) & np.uint64(SPACE - 1)).astype(np.int64), np.searchsorted(starts, ends)


def places_of(words: list[bytes]) -> np.ndarray:
    return places_of_all([b" ".join(words)])[0]


def lcs_length(masks: dict[bytes, int], m: int, region: list[bytes]) -> int:
    """Longest common subsequence with an item of m words, whose places per word are bits of masks."""
    full = (1 << m) - 1
    v = full
    for word in region:
        u = v & masks.get(word, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


class Index:
    """The benchmark in latent space, and what a pass over documents needs."""

    def __init__(self, items: list[tuple[int, str, str | None]]):
        self.items = []
        for name, text, answer in items:
            words = words_of(text)
            for at in range(0, len(words), ITEM_PASSAGE):
                part = words[at : at + ITEM_PASSAGE]
                if at and len(part) < ITEM_PASSAGE // 2:
                    part = words[-ITEM_PASSAGE:]  # a short tail is sought with the words before it
                self.items.append((name, part, words_of(answer) if answer else None))
        self.masks = []
        for _, part, _ in self.items:
            masks: dict[bytes, int] = {}
            for i, word in enumerate(part):
                masks[word] = masks.get(word, 0) | 1 << i
            self.masks.append(masks)

    def own_places(self) -> list[int]:
        return sorted({int(p) for _, part, _ in self.items for p in places_of(part)})

    def choose_features(self, frequent: list[int]) -> None:
        """Rows of features by place: all of the benchmark's words, then the corpus's most frequent, given in that order; the last row is for others."""
        own = self.own_places()
        have = set(own)
        chosen = own + [p for p in frequent if p not in have][: max(0, FEATURES - len(own))]
        self.places = np.array(chosen, np.int64)
        self.n_features, self.n_own = len(chosen), len(own)
        self.row = np.full(SPACE, self.n_features, np.int32)
        self.row[chosen] = np.arange(len(chosen))

    def rows(self, words: list[bytes]) -> np.ndarray:
        return self.row[places_of(words)]

    def weigh(self, df: np.ndarray, documents: int) -> None:
        """Inverse document frequencies; words that are no feature count as in no other document; the padding row weighs nothing."""
        idf = np.log((documents + 1) / (df + 1))
        self.idf = np.concatenate([idf, [np.log(documents + 1.0)], [0.0]]).astype(np.float32)

    def set_basis(self, basis: np.ndarray) -> None:
        """basis: features x rank, orthonormal columns."""
        self.fold = np.zeros((self.n_features + 2, basis.shape[1]), np.float32)
        self.fold[: self.n_features] = basis * self.idf[: self.n_features, None]
        vectors, own, scale = [], [], []
        for _, part, _ in self.items:
            r = self.rows(part)
            v = self.fold[r].sum(axis=0)
            size = max(1e-9, float(np.sqrt((self.idf[r] ** 2).sum())))
            vectors.append(v / max(1e-9, np.linalg.norm(v)))
            own.append(np.linalg.norm(v) / size)
            scale.append(min(1.0, np.sqrt(len(part) / (WINDOW / 2))))
        self.vectors = np.array(vectors, np.float32).reshape(len(self.items), basis.shape[1])
        self.least = (COSINE * np.array(own) * np.array(scale)).astype(np.float32)
        self.gate = float((COSINE * np.array(scale)).min()) ** 2 if self.items else 2.0
        self.answers = []
        for _, part, answer in self.items:
            rare = sorted(set(part), key=lambda w: (-float(self.idf[self.rows([w])[0]]), w))
            self.answers.append(set(answer) if answer else set(rare[:ANSWER_WORDS]))
        self._post()

    def _post(self) -> None:
        """By row of the benchmark's words: the items that hold it, at how many places and for how many answer words; what each item needs of both."""
        posts = []
        self.needs = np.zeros((3, len(self.items)), np.int64)
        self.posts_of: list[dict[int, tuple[int, int]]] = []
        for k, (_, part, answer) in enumerate(self.items):
            places, answers = Counter(self.rows(part).tolist()), Counter()
            if not answer:  # a given answer's words may be no words of the item
                answers.update(self.rows(sorted(self.answers[k])).tolist())
                self.needs[2, k] = next(n for n in range(len(self.answers[k]) + 1) if n / len(self.answers[k]) >= PARAPHRASE_ANSWER)
            self.needs[:2, k] = [next(n for n in range(len(part) + 1) if n / len(part) >= least) for least in (PARAPHRASE, COPY)] if part else [1, 1]
            self.posts_of.append({row: (n, answers[row]) for row, n in places.items()})
            posts += [(row, k, n, answers[row]) for row, n in places.items()]
        posts = np.array(sorted(posts), np.int64).reshape(-1, 4)
        self.post_at = np.searchsorted(posts[:, 0], np.arange(self.n_own + 1))
        self.post_item, self.post_places, self.post_answers = posts[:, 1], posts[:, 2].astype(float), posts[:, 3].astype(float)

    def sharing(self, r: np.ndarray) -> list[tuple[int, int]]:
        """The (window's first word, item) whose region holds words enough of the item that confirm could take it; none that it would take is left out."""
        own = np.unique(r[r < self.n_own])
        n = self.post_at[own + 1] - self.post_at[own]
        at = np.repeat(self.post_at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, size = self.post_item[at], len(self.items)
        places, answers = np.bincount(item, self.post_places[at], size), np.bincount(item, self.post_answers[at], size)
        found = []
        for k in np.flatnonzero((places >= self.needs[0]) & ((places >= self.needs[1]) | (answers >= self.needs[2]))).tolist():
            m, worth = len(self.items[k][1]), self.posts_of[k]
            first = np.arange(0, max(1, -(-len(r) // STRIDE)) * STRIDE, STRIDE)
            lo, hi = np.maximum(first - m, 0), np.minimum(first + WINDOW + m, len(r))
            places, answers = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            for row, (n_places, n_answers) in worth.items():
                there = np.flatnonzero(r == row)
                # as often as the region has the word, but not more often than the item
                n = np.searchsorted(there, hi) - np.searchsorted(there, lo)
                places += np.minimum(n, n_places)
                answers += np.where(n > 0, n_answers, 0)
            enough = (places >= self.needs[0, k]) & ((places >= self.needs[1, k]) | (answers >= self.needs[2, k]))
            found += [(int(f), k) for f in first[enough]]
        return found

    def search(self, docs: list[list[bytes]]) -> list[list[tuple[int, int]]]:
        """For each document the (window's first word, item) of cosine large enough or of shared words enough."""
        return self.search_rows([self.rows(words) for words in docs])

    def search_rows(self, docs: list[np.ndarray]) -> list[list[tuple[int, int]]]:
        """search for documents given by the rows of their words."""
        found: list[list[tuple[int, int]]] = [[] for _ in docs]
        rows, owner, first = [], [], []
        for k, r in enumerate(docs):
            if len(r):
                found[k] = self.sharing(r)
                halves = -(-len(r) // STRIDE) + 1  # a last half of padding, so each half begins a window
                rows.append(np.concatenate([r, np.full(halves * STRIDE - len(r), self.n_features + 1, np.int32)]))
                owner += [k] * halves
                first += range(0, halves * STRIDE, STRIDE)
        if not rows or not self.items:
            return found
        flat, owner, first = np.concatenate(rows).reshape(-1, STRIDE), np.array(owner), np.array(first)
        weight = self.idf[flat] ** 2
        total, inside = weight.sum(axis=1), (weight * (flat < self.n_own)).sum(axis=1)
        total, inside = total[:-1] + total[1:], inside[:-1] + inside[1:]
        can = np.flatnonzero((owner[:-1] == owner[1:]) & (inside >= self.gate * total) & (total > 0))
        for at in range(0, len(can), 256):
            w = can[at : at + 256]
            z = self.fold[np.concatenate([flat[w], flat[w + 1]], axis=1)].sum(axis=1)
            near = z @ self.vectors.T / np.sqrt(total[w])[:, None] >= self.least[None, :]
            for i, item in zip(*(x.tolist() for x in np.nonzero(near))):
                found[owner[w[i]]].append((int(first[w[i]]), item))
        return [sorted(set(f)) for f in found]

    def confirm(self, words: list[bytes], candidates: list[tuple[int, int]]) -> tuple[int | None, float, float, int]:
        """The best item by (common subsequence, answer words, least id), its shares, and how many items are there."""
        best: dict[int, tuple[float, float]] = {}
        for at, item in candidates:
            name, part, _ = self.items[item]
            if best.get(name, (0, 0))[0] == 1.0:
                continue
            region = words[max(0, at - len(part)) : at + WINDOW + len(part)]
            lcs = lcs_length(self.masks[item], len(part), region) / len(part)
            if lcs < PARAPHRASE:
                continue
            there = set(region)
            answer = sum(a in there for a in self.answers[item]) / max(1, len(self.answers[item]))
            if lcs >= COPY and (answer >= COPY_ANSWER or len(part) >= COPY_WORDS) or answer >= PARAPHRASE_ANSWER:
                best[name] = max(best.get(name, (0.0, 0.0)), (lcs, answer))
        if not best:
            return None, 0.0, 0.0, 0
        name = min(best, key=lambda n: (-best[n][0], -best[n][1], n))
        return name, *best[name], len(best)


def _counted(docs: DataFrame) -> DataFrame:
    """Over all of docs: for each place that a word has (place), its words (n) and the documents with it (df); in place -1 the number of documents (df)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df, total = np.zeros(SPACE, np.int64), np.zeros(SPACE, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [cleaned(t) for t in batch.column(0).slice(at, 256).to_pylist()]
                places, starts = places_of_all(texts)
                owner = np.repeat(np.arange(len(texts)), np.diff(starts))
                pairs, times = np.unique(owner * SPACE + places, return_counts=True)
                np.add.at(n, pairs & (SPACE - 1), times)
                np.add.at(df, pairs & (SPACE - 1), 1)
                total += len(texts)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1).astype(np.int32)), pa.array(np.append(n[there], 0)), pa.array(np.append(df[there], total))], names=["place", "n", "df"])

    found = docs.select("text").mapInArrow(run, "place int, n bigint, df bigint")
    return written(found.groupBy("place").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "places", 1)


def _frequencies(counted: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """Chooses the index's features; documents with each, and documents."""
    rank = [F.desc("n"), F.col("place")]
    frequent = [r["place"] for r in counted.where("place >= 0").orderBy(*rank).limit(FEATURES + len(index.own_places())).select("place").collect()]
    index.choose_features(frequent)
    own = counted.sparkSession.createDataFrame(pa.table({"place": pa.array(np.append(index.places, -1).astype(np.int32))}))
    df = {r["place"]: r["df"] for r in counted.join(F.broadcast(own), "place").select("place", "df").collect()}
    return np.array([df.get(p, 0) for p in index.places.tolist()], float), df.get(-1, 0)


def _basis(spark, index: Index, seed: int = 3) -> np.ndarray:
    """Right singular vectors of the benchmark's passages by a randomised range finder; each product with A'A is summed over partitions."""
    passages = [index.rows(part) for _, part, _ in index.items]
    n, idf = index.n_features, index.idf
    k = max(1, min(RANK, n, len(passages)))
    offsets = np.cumsum([0, *map(len, passages)]).astype(np.int32)
    table = pa.table({"rows": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *passages])))})
    rows = spark.createDataFrame(table).repartition(4)
    rows = written(rows, "passages", 1)

    def times(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, out = np.concatenate([shared.value, np.zeros((1, shared.value.shape[1]), np.float32)]), np.zeros((n + 1, shared.value.shape[1]), np.float32)
            for batch in batches:
                for r in batch.column(0):
                    r = r.values.to_numpy(zero_copy_only=False)
                    weight = idf[r] / max(1e-9, float(np.linalg.norm(idf[r])))
                    np.add.at(out, r, weight[:, None] * (weight @ own[r])[None, :])
            yield pa.RecordBatch.from_arrays([pa.array([out[:n].tobytes()], pa.binary())], names=["part"])

        total = np.zeros((n, q.shape[1]))
        for p in rows.mapInArrow(run, "part binary").toLocalIterator():  # the partitions' sums one by one
            total += np.frombuffer(p["part"], np.float32).reshape(n, -1)
        shared.destroy()
        release(spark)
        return total

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, k)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(times(q))[0]
    # within the range, the eigenvectors of A'A; all of the range is kept, so any rotation would do
    small = q.T @ times(q)
    release(spark, rows)
    return q @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]


def _blocks(benchmark: DataFrame) -> list[list[tuple]]:
    """The stated query set, in blocks of which each is broadcast by itself."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    items = items.where("item_id is not null and length(trim(text)) > 0").distinct()
    passes = max(1, -(-items.count() // ITEMS_IN_PASS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    return [[tuple(r) for r in items.where(block == k).orderBy("item_id", "text").collect()] for k in range(passes)]


def fitted(counted: DataFrame, items: list[tuple]) -> Index:
    """The index of a block of items over the corpus whose words are counted."""
    index = Index(items)
    index.weigh(*_frequencies(counted, index))
    release(counted.sparkSession)
    index.set_basis(_basis(counted.sparkSession, index) if index.n_features else np.zeros((0, 1)))
    caches.trim()
    return index


def _judged(index: Index, part: list[str | None]) -> list[tuple[int | None, float, float, int]]:
    texts = [cleaned(t) for t in part]
    places, starts = places_of_all(texts)
    rows = index.row[places]
    found = index.search_rows([rows[a:b] for a, b in zip(starts[:-1], starts[1:])])
    return [index.confirm(t.split(), c) if c else (None, 0.0, 0.0, 0) for t, c in zip(texts, found)]


def find_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, contaminated, and of the best item item_id, lcs (share of its words), answer (share of answer words); n_items found.

    benchmark: item_id, text and perhaps answer; null and blank items match nothing, items that
    repeat an item_id are one. Null, empty and blank texts are clean. Ties go to the least item_id.
    Rows keep their multiplicity, however many blocks of items are searched: a block adds to what
    the row has of those before. A null doc_id is carried; other columns are dropped.
    """
    docs = texts(docs)
    blocks = _blocks(benchmark)
    none = [F.lit(False).alias("contaminated"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("lcs"), F.lit(0.0).alias("answer"), F.lit(0).alias("n_items")]
    found = docs.select("doc_id", "text", *none)
    counted = _counted(docs) if blocks else None
    for k, items in enumerate(blocks):
        found = _pass(found, fitted(counted, items), last=k == len(blocks) - 1)
    return found.drop("text")


def _better(a: tuple, b: tuple) -> tuple:
    """Of two results over different items the better one; the items of both count."""
    rank = lambda x: (x[1], x[2], -x[0] if x[0] is not None else -float("inf"))
    return (*max(a, b, key=rank)[:3], a[3] + b[3])


def _pass(found: DataFrame, index: Index, last: bool) -> DataFrame:
    """found with what a block of items adds; the last pass needs no texts any more."""
    shared = found.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                was = zip(*(part.column(c).to_pylist() for c in ("item_id", "lcs", "answer", "n_items")))
                out = [_better(a, b) for a, b in zip(was, _judged(shared.value, part.column("text").to_pylist()))]
                columns = [pa.array([o[3] > 0 for o in out], pa.bool_()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.int32())]
                kept = [part.column("doc_id")] if last else [part.column("doc_id"), part.column("text")]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=["doc_id", *([] if last else ["text"]), "contaminated", "item_id", "lcs", "answer", "n_items"])

    return found.mapInArrow(run, OUT if last else OUT.replace("doc_id bigint", "doc_id bigint, text string"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item; narrow but for the statistics.

    Null, empty and blank texts stay; rows that repeat go or stay together; an empty table stays
    empty, and an empty benchmark drops nothing.
    """
    corpus, text_at = texts(docs), docs.columns.index("text")
    blocks = _blocks(benchmark)
    counted = _counted(corpus) if blocks else None
    for items in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(fitted(counted, items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield part.filter(pa.array([o[3] == 0 for o in _judged(shared.value, part.column(text_at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
