"""Language by cross-parsing: how few phrases of a language's labelled text a document needs.

Per language a suffix automaton of its sample is built, over the bytes of UTF-8, so that every
script has its letters. A text is read left to right, and a phrase ends where the automaton has no
way on, that is, at the longest match from its start. The language with the fewest phrases per
symbol wins. The automata are dense tables (state, symbol) -> state, and the texts of a batch
advance together, one symbol of every text at a time, so a step is a few vector operations.

Long texts are cut into lanes that are parsed side by side, each as if a phrase began with it, and
then corrected: the parse of the lane before goes on into the lane until both begin a phrase at
one place, from where they are the same. The phrases are those of one parse from left to right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

#: The bounds of what is learned from, in whole rows: documents of each language, their bytes, and bytes of all languages; documents up to SHORT bytes come first.
SAMPLE_DOCS, SAMPLE_BYTES, ALL_BYTES, SHORT = 150, 60_000, 800_000, 600
#: Symbols that are parsed side by side.
LANE = 512
UNDETERMINED = "und"
_letter = regex.compile(r"\p{L}")
_models: dict[int, "Model"] = {}


def prepared(text: str) -> str:
    """Lower case, everything but letters as one space."""
    return " ".join(regex.sub(r"[^\p{L}]+", " ", text.lower()).split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    nexts, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        now = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = now
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return nexts


class Model:
    """samples: language -> prepared texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.tables = [self.table(" ".join(samples[lang]).encode("utf-8", "replace")) for lang in self.languages]

    @staticmethod
    def table(sample: bytes) -> tuple[np.ndarray, int, np.ndarray]:
        """The symbol of each byte (the last for those that the sample lacks), their number, and entries 2 * state, plus 1 where a new phrase begins with the symbol."""
        letters = sorted(set(sample))
        symbol = np.full(256, len(letters), np.int32)
        symbol[letters] = np.arange(len(letters))
        size = len(letters) + 1
        states = suffix_automaton(symbol[list(sample)].tolist())
        root = np.full(size, 1, np.int32)
        for c, s in states[0].items():
            root[c] = 2 * s + 1
        out = np.tile(root, (len(states), 1))
        for k, nexts in enumerate(states[1:], 1):  # at the root a phrase always begins
            for c, s in nexts.items():
                out[k, c] = 2 * s
        return symbol, size, out.ravel()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (text, language) and symbols of prepared texts."""
        data = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
        sizes = np.array([len(s) for s in data], np.int64)
        lanes = [(i, k, s[k * LANE : (k + 1) * LANE]) for i, s in enumerate(data) for k in range(-(-len(s) // LANE))]
        lanes.sort(key=lambda x: -len(x[2]))
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        if not lanes:
            return counts, sizes
        owner, long = np.array([i for i, *_ in lanes]), np.array([len(s) for *_, s in lanes])
        grid = np.zeros((long[0], len(lanes)), np.uint8)
        for k, (*_, s) in enumerate(lanes):
            grid[: len(s), k] = s
        at = {(i, k): n for n, (i, k, _) in enumerate(lanes)}
        before = np.array([at.get((i, k - 1), -1) for i, k, _ in lanes])
        active = np.searchsorted(-long, -np.arange(1, long[0] + 1), side="right")
        for lang, (symbol, size, table) in enumerate(self.tables):
            counts[:, lang] = np.bincount(owner, self.parsed(symbol[grid], size, table, active, before, long), len(texts)).astype(np.int64)
        return counts, sizes

    @staticmethod
    def parsed(symbols: np.ndarray, size: int, table: np.ndarray, active: np.ndarray, before: np.ndarray, long: np.ndarray) -> np.ndarray:
        """How many phrases begin in each lane when its text is parsed as one."""
        lanes = len(before)
        state, found, begins = np.zeros(lanes, np.int32), np.zeros(lanes, np.int64), np.zeros(symbols.shape, bool)
        for t, n in enumerate(active.tolist()):
            step = table[state[:n] * size + symbols[t, :n]]
            begins[t, :n] = step & 1
            found[:n] += step & 1
            state[:n] = step >> 1
        alone, end = found.copy(), state.copy()
        todo = np.flatnonzero(before >= 0)
        while len(todo):
            own, now, mine, other = todo, end[before[todo]], np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
            late = []
            for t in range(len(symbols)):
                over = long[own] <= t  # the lane ended before the parses met
                if over.any():
                    late += [(own[over], mine[over], now[over])]
                    own, now, mine, other = own[~over], now[~over], mine[~over], other[~over]
                if not len(own):
                    break
                step = table[now * size + symbols[t, own]]
                flag = (step & 1).astype(bool)
                mine, now = mine + flag, step >> 1
                other += begins[t, own]
                met = flag & begins[t, own]
                found[own[met]] = mine[met] + alone[own[met]] - other[met]
                own, now, mine, other = own[~met], now[~met], mine[~met], other[~met]
            if len(own):
                late += [(own, mine, now)]
            changed = []
            for which, n, last in late:
                found[which] = n
                changed += which[end[which] != last].tolist()
                end[which] = last
            todo = np.flatnonzero(np.isin(before, changed)) if changed else np.zeros(0, np.int64)
        return found

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [bool(t) and _letter.search(t) is not None for t in texts]
        counts, sizes = self.phrases([prepared(t) if k else "" for t, k in zip(texts, known)])
        out = []
        for k, row, n in zip(known, counts, sizes):
            if not k or not n or not self.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(row.argmin())
            rest = np.delete(row, best)
            out.append((self.languages[best], float(rest.min() / (rest.min() + row[best])) if len(rest) else 1.0))
        return out


def samples(docs: DataFrame, held_out: F.Column) -> dict[str, list[str]]:
    """Whole texts to learn from: of each language SAMPLE_DOCS documents and SAMPLE_BYTES bytes at most, or one document; short ones first, then by hash. With many languages each has its share of ALL_BYTES."""
    labelled = docs.where(~held_out & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    budget = min(SAMPLE_BYTES, ALL_BYTES // len(counts))
    # several times the documents needed pass the hash; then the least of them, so no sort sees a language whole
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 10.0 * SAMPLE_DOCS / n)))])
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    near = labelled.withColumn("h", h).where(F.col("h") < share[F.col("lang")] * (1 << 20))
    near = near.withColumn("size", F.octet_length("text"))
    first = Window.partitionBy("lang").orderBy(F.col("size") > SHORT, "h", "doc_id", "text")
    ranked = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE_DOCS)
    ranked = ranked.withColumn("used", F.sum("size").over(Window.partitionBy("lang").orderBy("k"))).where((F.col("used") <= budget) | (F.col("k") == 1))
    out: dict[str, list[str]] = {}
    for r in ranked.select("lang", "k", "text").orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append(prepared(r["text"]))
    return agreed({lang: texts for lang, texts in out.items() if any(texts)})


def agreed(learned: dict[str, list[str]]) -> dict[str, list[str]]:
    """Without the texts that a model of the other half of the texts takes for another language, unless all of a language's would go: labels may be wrong."""
    halves = [{lang: texts[k::2] for lang, texts in learned.items() if any(texts[k::2])} for k in (0, 1)]
    out: dict[str, list[str]] = {lang: [] for lang in learned}
    for own, other in (halves, halves[::-1]):
        model = Model(other)
        for lang, texts in own.items():
            out[lang] += [t for t, (found, _) in zip(texts, model.predict(texts)) if found == lang or lang not in other]
    return {lang: texts or learned[lang] for lang, texts in out.items()}


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from rows with crc32(doc_id) mod folds other than held.

    lang_pred is und, with score 0, where the text is null or has no letter, or nothing could be
    learned. score is phrases of the next best language over the sum of both (0.5: a tie, which
    the first name wins; 1 with a single language). A null doc_id counts as not held out but is
    learned from like others. Rows keep their multiplicity; other columns are dropped.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    docs = texts(docs, "lang")
    learned = samples(docs, held_out)
    key = hash(tuple((k, tuple(v)) for k, v in sorted(learned.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = Model(learned)
        model = _models[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = model.predict([t.as_py() for t in part.column(2)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
