"""Benchmark decontamination: block-max retrieval from a BM25 index of test items, then overlap checks.

Test items are cut into segments of at most STRIDE words and indexed: each word has a list of segments with its impact there, in
order, and the largest impact of each block of BLOCK segments. Every window of 2 * STRIDE words of
every text, STRIDE apart, is a query, so each place where a segment may stand lies whole in a window. A query is a block-max WAND walk:
cursors on the lists of its words, sorted by segment; the pivot is the first segment where the words' largest impacts add up to
the threshold; if the largest impacts in its block don't, the cursors skip the block (or go on to the next cursor's segment), else they move up to the pivot,
which is scored exactly once all stand there. Windows whose words' largest impacts reach the threshold in none of RANGES ranges of segments
(blocks of blocks) don't set out. The walks of many windows take their steps together, in numpy. A segment is retrieved at
THRESHOLD of the score that it gives itself. Retrieved items
are verified on the whole text: the shares of an item's words that lie in shared runs of
SHINGLE words must reach OVERLAP over all and PART in question and answer each.

Words are lower-case letters and digits of white-space tokens. Question and answer part after the first
question mark or line end inside an item, else at half its words. Items that are null or have no words match
nothing; items of fewer than SHINGLE words need their whole run. Null and empty texts match nothing. Null and
repeated ids of any type pass through, a row for each row and item. The index is built for SHARD items at a time; more items
mean more passes over the texts, not a larger index. Extra columns are dropped by matches() and kept by reject().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seepage.llm.common import bound_batches, decided, frugal, materialize, slices, table

STRIDE = 32
SHINGLE = 5
BLOCK = 4
THRESHOLD = 0.5
OVERLAP = 0.8
PART = 0.5
#: Most items in one index, which goes to every task.
SHARD = 20_000
MEMO_WORDS = 100_000
#: Ranges of segments whose largest impacts are added up for a window before it walks.
RANGES = 64
#: Windows whose walks take their steps together.
WALKS = 2_000
K1, B = 1.2, 0.75


_OTHER = re.compile(r"[\W_]+")


def normal(token: str) -> str:
    """Letters and digits of a token."""
    return token if token.isalnum() else _OTHER.sub("", token)


def words_of(text: str) -> list[str]:
    return [w for w in map(normal, text.lower().split()) if w]


def parts_of(text: str) -> tuple[list[str], int]:
    """(words of an item, how many are its question)."""
    words = words_of(text)
    cut = re.search(r"\?|\n", text.strip())
    head = len(words_of(text.strip()[: cut.end()])) if cut else 0
    return words, head if 0 < head < len(words) else (len(words) + 1) // 2


def segments_of(words: list[str]) -> list[list[str]]:
    """The runs of about STRIDE words that an item is cut into."""
    n = math.ceil(len(words) / STRIDE)
    size = math.ceil(len(words) / n) if n else 1
    return [words[i : i + size] for i in range(0, len(words), size)]


@dataclass
class Statistics:
    """Of the segments of all items, however they are dealt to indexes: their number and mean length, and the document frequency of (some) words."""

    segments: int
    mean: float
    df: dict[str, int]


def statistics(items: list[tuple[int, str]]) -> Statistics:
    segments = [s for _, text in items for s in segments_of(words_of(text or ""))]
    return Statistics(len(segments), sum(map(len, segments)) / max(len(segments), 1), Counter(w for s in segments for w in set(s)))


class Index:
    def __init__(self, items: list[tuple[int, str]], of_all: Statistics | None = None):
        self.ids, self.words, self.heads = [], [], []
        self.vocabulary: dict[str, int] = {}
        segments: list[list[int]] = []
        self.item_of: list[int] = []
        for item_id, text in items:
            words, head = parts_of(text or "")
            if not words:
                continue
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            for own in segments_of(codes):
                segments.append(own)
                self.item_of.append(len(self.ids))
            self.ids.append(item_id)
            self.words.append(np.array(codes, np.int64))
            self.heads.append(head)
        self.segments = len(segments)
        self.blocks = math.ceil(self.segments / BLOCK)
        of_all = of_all or statistics(items)
        df = {code: of_all.df[w] for w, code in self.vocabulary.items()}
        mean, every = of_all.mean, of_all.segments
        rows = []
        for k, s in enumerate(segments):
            norm = K1 * (1 - B + B * len(s) / mean)
            impact = {t: math.log(1 + (every - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in Counter(s).items()}
            own = sum(impact.values())
            rows += [(t, k, v / own) for t, v in impact.items()]
        rows.sort()
        term = np.array([r[0] for r in rows], np.int64)
        seg = np.array([r[1] for r in rows], np.int64)
        self.seg = np.concatenate((seg, [0]))
        self.value = np.array([*(r[2] for r in rows), 0.0])
        self.key = term * max(self.segments, 1) + seg
        pair = term * max(self.blocks, 1) + seg // BLOCK
        cuts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(self.value[:-1], cuts) if len(cuts) else np.zeros(0)
        self.block_key, self.block_top = np.concatenate((pair[cuts], [-1])), np.concatenate((top, [0.0]))
        #: By posting: the largest impact of its word in its block.
        self.near_top = np.concatenate((np.repeat(top, np.diff(np.concatenate((cuts, [len(pair)])))), [0.0]))
        count = np.bincount(term, minlength=len(self.vocabulary) + 1)
        self.end = np.cumsum(count)
        self.begin = self.end - count
        self.most = np.zeros(len(self.vocabulary) + 1)
        np.maximum.at(self.most, term, self.value[:-1])
        #: By word: its largest impact in each of RANGES ranges of segments.
        self.ranges = np.zeros((len(self.vocabulary) + 1, RANGES), np.float32)
        np.maximum.at(self.ranges, (term, seg * RANGES // max(self.segments, 1)), self.value[:-1].astype(np.float32))
        self.shingles = [self._shingles(w) for w in self.words]

    @staticmethod
    def _shingles(codes: np.ndarray, width: int | None = None) -> np.ndarray:
        width = width or min(SHINGLE, len(codes))
        h = np.zeros(len(codes) - width + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width):
                h = (h ^ codes[j : len(codes) - width + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
        return h

    def retrieve(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, segment, score) of all segments at the threshold; windows: distinct codes, the last code for none."""
        live = np.flatnonzero(self.most[windows].sum(axis=1) >= THRESHOLD - 1e-9)
        words = (windows[live] < len(self.vocabulary)).sum(axis=1)
        order = np.argsort(words, kind="stable")
        live, words = live[order], words[order]
        out, keep = [], np.zeros(len(live), bool)
        for a in range(0, len(live), 512):  # of about as many words each
            some = np.sort(windows[live[a : a + 512]], axis=1)[:, : words[a : a + 512].max()]
            total = self.ranges[some[:, 0]]
            for column in some.T[1:]:
                total += self.ranges[column]
            keep[a : a + 512] = total.max(axis=1) >= THRESHOLD - 1e-4  # more than the single precision rounds off
        live, words = live[keep], words[keep]
        for a in range(0, len(live), WALKS):
            part = live[a : a + WALKS]
            out.append(self._walk(np.sort(windows[part], axis=1)[:, : words[a : a + WALKS].max()], part))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def _walk(self, w: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block-max WAND of all windows at once, a step of each at a time."""
        least, past = THRESHOLD - 1e-9, max(self.segments, 1)
        w = w.astype(np.int32)
        most, end, at = self.most[w], self.end[w].astype(np.int32), self.begin[w].astype(np.int32)
        now = np.where(at < end, self.seg[at], past).astype(np.int32)  # the segment under each cursor; past: the list is at its end
        found = []
        steps = 0
        while len(w):
            steps += 1
            order = np.argsort(now, axis=1)
            sorted_now = np.take_along_axis(now, order, axis=1)
            reach = np.cumsum(np.where(sorted_now < past, np.take_along_axis(most, order, axis=1), 0.0), axis=1) >= least
            live = reach[:, -1]
            if not live.all():
                w, number, most, end, at, now, sorted_now, reach = (x[live] for x in (w, number, most, end, at, now, sorted_now, reach))
                if not len(w):
                    break
            pivot = sorted_now[np.arange(len(w)), reach.argmax(axis=1)]
            under = now <= pivot[:, None]
            block = pivot // BLOCK
            row, col = np.nonzero(under)
            top = self.near_top[at[row, col]]
            other = np.flatnonzero(now[row, col] // BLOCK < block[row])
            if len(other):
                key = w[row[other], col[other]].astype(np.int64) * self.blocks + block[row[other]]
                i = np.searchsorted(self.block_key[:-1], key)
                top[other] = np.where(self.block_key[i] == key, self.block_top[i], 0.0)
            bound = np.bincount(row, weights=top, minlength=len(w)) >= least
            scored = bound & (sorted_now[:, 0] == pivot)
            if scored.any():
                score = np.where(now == pivot[:, None], self.value[at], 0.0)[scored].sum(axis=1)
                hit = score >= THRESHOLD
                found.append((number[scored][hit], pivot[scored][hit], score[hit]))
            after = np.where(under, past, now).min(axis=1)  # the first segment of a cursor beyond the pivot
            target = np.where(scored, pivot + 1, np.where(bound, pivot, np.minimum((block + 1) * BLOCK, after)))
            row, col = np.nonzero(now < target[:, None])
            # Most lists go on by one place; only the others are searched.
            i, stop, goal = at[row, col] + 1, end[row, col], target[row]
            far = np.flatnonzero((i < stop) & (self.seg[i] < goal))
            if len(far):
                i[far] = np.searchsorted(self.key, w[row[far], col[far]].astype(np.int64) * self.segments + goal[far])
            at[row, col] = i
            now[row, col] = np.where(i < stop, self.seg[i], past)
            # Columns of lists that are all at their ends go.
            if steps % 8 == 0:
                used = (now < past).sum(axis=1).max(initial=0)
                if not used:
                    break
                if used < now.shape[1]:
                    order = np.argsort(now, axis=1)[:, :used]
                    w, most, end, at, now = (np.take_along_axis(x, order, axis=1) for x in (w, most, end, at, now))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def overlaps(self, codes: np.ndarray, item: int, made: dict | None = None) -> tuple[float, float, float]:
        """Shares of an item's words, of its question's and of its answer's, in runs shared with a text; made keeps the text's shingles for its other items."""
        words, head = self.words[item], self.heads[item]
        width = min(SHINGLE, len(words))
        if len(codes) < width:
            return 0.0, 0.0, 0.0
        made = {} if made is None else made
        if width not in made:
            made[width] = self._shingles(codes, width)
        hit = np.isin(self.shingles[item], made[width])
        covered = np.zeros(len(words) + 1, int)
        at = np.flatnonzero(hit)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + width, -1)
        inside = np.cumsum(covered)[:-1] > 0
        whole = inside.mean()
        return whole, inside[:head].mean(), inside[head:].mean() if head < len(words) else whole


def matcher(index: Index):
    """A function from texts to, for each, its verified (item, score, question overlap, answer overlap)."""
    none = len(index.vocabulary)
    memo: dict[str, int] = {}

    def codes_of(tokens: list[str]) -> np.ndarray:
        c = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
        return c[c >= 0]

    def run(texts: list) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in texts]
        if not index.segments:
            return out
        for start, end in slices(texts):
            tokens = [t.lower().split() if t else [] for t in texts[start:end]]
            if len(memo) > MEMO_WORDS:
                memo.clear()
            get = index.vocabulary.get
            for w in set().union(*tokens).difference(memo):
                n = w if w.isalnum() else _OTHER.sub("", w)
                memo[w] = get(n, none) if n else -1
            codes = [codes_of(ts) for ts in tokens]
            sizes = np.array([-(-len(c) // STRIDE) * STRIDE + STRIDE if len(c) else 0 for c in codes])
            flat = np.full(int(sizes.sum()), none, np.int64)
            at = np.cumsum(sizes) - sizes
            for c, a in zip(codes, at.tolist()):
                flat[a : a + len(c)] = c
            if not len(flat):
                continue
            rows = flat.reshape(-1, STRIDE)
            windows = np.sort(np.concatenate((rows[:-1], rows[1:]), axis=1), axis=1)
            windows[:, 1:][windows[:, 1:] == windows[:, :-1]] = none
            owner = np.repeat(np.arange(len(codes)), sizes // STRIDE)[:-1]
            window, segment, score = index.retrieve(windows)
            best: dict[tuple[int, int], float] = {}
            for d, s, v in zip(owner[window].tolist(), segment.tolist(), score.tolist()):
                k = (d, index.item_of[s])
                best[k] = max(best.get(k, 0.0), v)
            made: dict[int, dict] = {}
            for (d, item), v in best.items():
                whole, question, answer = index.overlaps(codes[d], item, made.setdefault(d, {}))
                if whole >= OVERLAP and question >= PART and answer >= PART:
                    out[start + d].append((index.ids[item], v, question, answer))
        return out

    return run


def _counted(batches):
    """(word, n) rows of a batch's segments: document frequencies, and under an empty word, which no text has, the number of segments; total: their words."""
    for batch in batches:
        own = statistics([(0, t) for t in batch.column("text").to_pylist()])
        words = [*own.df, ""]
        yield pa.RecordBatch.from_pydict({"word": words, "n": pa.array([*own.df.values(), own.segments], pa.int64()), "total": pa.array([0] * len(own.df) + [round(own.mean * own.segments)], pa.int64())})


def shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Indexes of at most about SHARD items each, as broadcast variables: each goes to an executor once.

    Their statistics are those of all items, so that neither scores nor what is retrieved depend on how items are dealt."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    n = max(1, math.ceil(rows.count() / SHARD))
    counts = None
    if n > 1:
        counts = rows.select("text").mapInArrow(frugal(_counted), "word string, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        counts = materialize(counts, "decontamination-words")
        whole = counts.where("word = ''").first()
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        own = sorted(((r["id"], r["text"]) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1]))
        of_all = None
        if counts is not None:
            held = items.sparkSession.createDataFrame([(w,) for w in {w for _, t in own for w in words_of(t)}], "word string")  # the words of one index
            of_all = Statistics(whole["n"], whole["total"] / max(whole["n"], 1), dict(counts.join(held, "word").select("word", "n").toLocalIterator()))
        yield items.sparkSession.sparkContext.broadcast(Index(own, of_all))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs -> (id_col, item_id, score, question_overlap, answer_overlap), a row for each verified text and item."""
    bound_batches(docs.sparkSession)
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "item_id", "score", "question_overlap", "answer_overlap"]
    kinds = [to_arrow_type(kind), to_arrow_type(item_kind), pa.float64(), pa.float64(), pa.float64()]

    def search(index):
        def run(batches):
            of = matcher(index.value)
            for batch in batches:
                found = [(i, *m) for i, ms in zip(batch.column(0).to_pylist(), of(batch.column(1).to_pylist())) for m in ms]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=names)

        return rows.mapInArrow(frugal(run), f"id {kind.simpleString()}, item_id {item_kind.simpleString()}, score double, question_overlap double, answer_overlap double")

    out = None
    for index in shards(items, item_col):
        part = search(index)
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)


def reject(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text holds no item."""
    bound_batches(docs.sparkSession)

    def judge(index):
        def start():
            of = matcher(index.value)
            return lambda texts: [not m for m in of(texts)]

        return start

    for index in shards(items):
        docs = decided(docs, text_col, judge(index))
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
