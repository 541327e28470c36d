"""Ranked lexical search by document FP-trees.

Documents are reduced to the vectors of the terms that some item holds, the terms ordered by their document frequency over all
documents, the most frequent first. A task sorts the vectors of a chunk of documents, so that those which begin alike lie together: the
paths of a frequent-pattern tree, whose nodes are runs of documents. A node knows, for each term, the largest tf below it, and the smallest m.
From them follows a bound for an item's score below the node, since a term's part grows with tf and falls with m. Each item goes through the tree
depth first, the nodes of highest bound before the others, and leaves out what can't reach its worst kept score; where few documents are left below a node, they
are scored. An item's kept documents go with it from tree to tree of the task. What the tasks keep, at most TOP an item, is ranked in two steps.

Of documents that are alike in all terms of items and in m, those of the TOP smallest ids stand for all: no other of them can be among an item's TOP.

Terms are the maximal matches of TERM in whole texts, lower-cased in A-Z alone. Null and empty texts, and those without terms, are no documents of the
collection: they count in no statistic and are never found. An item that is null or has no terms gets no rows. Scores need no item's other items, so they don't depend on how items are
dealt to passes. Repeated rows are documents of their own; equal ids of equal score both stand, ids may be of any type that Spark orders, and null ids
come last among equal scores. Rows of one item id that differ in text are items of their own with one name: each is ranked from 1. Empty tables give
no rows. Extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.llm.common import bound_batches, frugal, materialize, slices, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Characters of items that one pass over the documents answers; their terms are what is broadcast.
PASS_CHARS = 1_000_000
#: Documents below which a node is scored, postings of a tree, and entries of its table of maxima.
LEAF = 32
POSTINGS = 2_000_000
MAXIMA = 16_000_000
#: Nodes of highest bound that are looked at together first; four times as many next, and so on.
STEP = 8
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


def terms_of(text: str | None, find=re.compile(TERM).findall) -> list[str]:
    return find(lower(text)) if text else []


def part_of_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """The tree of a chunk of documents: vectors (starts, terms, tfs), each in the order of the terms' numbers, and m.

    Its documents are in the order of their paths; `of` has their places in the chunk."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, width: int):
        self.vocabulary, local = np.unique(terms, return_inverse=True)
        self.width = max(1, len(self.vocabulary))
        sizes = np.diff(starts)
        path = local.astype(">u4").tobytes()
        ends = (starts * 4).tolist()
        paths = [path[a:b] for a, b in zip(ends, ends[1:])]
        self.of = np.array(sorted(range(len(sizes)), key=paths.__getitem__), dtype=np.int64)
        size = sizes[self.of]
        first = np.cumsum(size) - size
        at = np.repeat(starts[:-1][self.of] - first, size) + np.arange(size.sum())
        self.m = m[self.of]
        self.own = np.repeat(np.arange(len(size)), size)
        self.term, self.tf = local[at], tfs[at]
        #: Sorted, since a path's terms are in order.
        self.key = self.own * self.width + self.term
        self._nodes(self._shared(first, size))

    def _shared(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many terms the path of each document shares with that before it."""
        out = np.zeros(len(size), np.int64)
        n = np.minimum(size[1:], size[:-1])
        has = np.flatnonzero(n)
        if len(has):
            k = n[has]
            base = np.cumsum(k) - k
            step = np.arange(k.sum()) - np.repeat(base, k)
            differ = self.term[np.repeat(first[has], k) + step] != self.term[np.repeat(first[has + 1], k) + step]
            out[has + 1] = np.minimum.reduceat(np.where(differ, step, len(self.term)), base)
            out[has + 1] = np.minimum(out[has + 1], k)
        return out

    def _pieces(self, shared: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
        """The run of documents from a to b, split where its paths share least; none if they are one path.

        As long as all but LEAF documents are in one piece, that is split in place: a node then leaves LEAF documents or more outside its largest child, so
        that nodes are no more than a small multiple of documents / LEAF, however long a chain of paths is."""
        length = lambda doc: self.edge[doc + 1] - self.edge[doc]
        out, x, y, at = [], a, b, 0
        while True:
            inner = shared[x + 1 : y]
            low = inner.min() if len(inner) else 0
            if y - x <= LEAF or (low >= length(x) and low >= length(y - 1)):
                return out
            cuts = [x, *(np.flatnonzero(inner == low) + x + 1).tolist(), y]
            new = list(zip(cuts, cuts[1:]))
            out[at : at + 1] = new
            k = max(range(len(new)), key=lambda i: new[i][1] - new[i][0])
            at, (x, y) = at + k, new[k]
            if y - x < b - a - LEAF:
                return out

    def _nodes(self, shared: np.ndarray) -> None:
        """Nodes are runs of documents. Small neighbours below one node are a leaf together."""
        self.edge = np.searchsorted(self.own, np.arange(len(shared) + 1))
        start, end, children = [0], [len(shared)], [[]]

        def add(node: int, x: int, y: int) -> int:
            children[node].append(len(start))
            start.append(x), end.append(y), children.append([])
            return len(start) - 1

        todo = [0]
        while todo:
            node = todo.pop()
            run: list[int] = []
            for x, y in self._pieces(shared, start[node], end[node]):
                if run and (y - x > LEAF or y - run[0] > LEAF):
                    add(node, *run)
                    run = []
                if y - x > LEAF:
                    todo.append(add(node, x, y))
                else:
                    run = [run[0] if run else x, y]
            if run:
                add(node, *run)
        self.start, self.end, self.children = np.array(start), np.array(end), [np.array(c, np.int64) for c in children]
        # Largest tf of each term and smallest m below a node: leaves from their documents, the others from their children, which come after them.
        self.most = np.zeros((len(start), self.width), np.int32)
        self.least = np.zeros(len(start), np.int64)
        edge = self.edge
        for node in range(len(start) - 1, -1, -1):
            if children[node]:
                self.least[node] = self.least[self.children[node]].min()
                self.most[node] = self.most[self.children[node]].max(axis=0)
            else:
                a, b = self.start[node], self.end[node]
                self.least[node] = self.m[a:b].min()
                np.maximum.at(self.most[node], self.term[edge[a] : edge[b]], self.tf[edge[a] : edge[b]].astype(np.int32))

    def bounds(self, nodes: np.ndarray, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        return part_of_score(self.most[nodes[:, None], terms].astype(np.int64), self.least[nodes][:, None]) @ w

    def scores(self, nodes: np.ndarray, terms: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents below leaves, their scores)."""
        n = self.end[nodes] - self.start[nodes]
        docs = np.repeat(self.start[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        want = docs[:, None] * self.width + terms
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        tf = np.where(self.key[at] == want, self.tf[at], 0)
        return docs, part_of_score(tf, self.m[docs][:, None]) @ w

    def search(self, terms: np.ndarray, w: np.ndarray, least: int, offer) -> None:
        """Depth first: offer(documents, scores) gets every document whose score may reach least, and returns the new least."""
        place = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        held = self.vocabulary[place] == terms
        terms, w = place[held], w[held]
        if not len(terms):
            return
        stack = [(np.zeros(1, np.int64), self.bounds(np.zeros(1, np.int64), terms, w))]
        while stack:
            nodes, bound = stack.pop()
            ok = bound >= max(least, 1)
            nodes = nodes[ok]
            if not len(nodes):
                continue
            leaf = np.array([not len(self.children[k]) for k in nodes])
            if leaf.any():
                docs, score = self.scores(nodes[leaf], terms, w)
                ok = score >= max(least, 1)
                if ok.any():
                    least = offer(docs[ok], score[ok])
            if not leaf.all():
                below = np.concatenate([self.children[k] for k in nodes[~leaf]])
                bound = self.bounds(below, terms, w)
                order = np.argsort(-bound, kind="stable")
                # The few best are taken from the stack first, so that the rest meets a higher least.
                cuts, step = [0], STEP
                while cuts[-1] < len(order):
                    cuts.append(min(cuts[-1] + step, len(order)))
                    step *= 4
                for a, b in zip(cuts[-2::-1], cuts[:0:-1]):
                    stack.append((below[order[a:b]], bound[order[a:b]]))


def _vector_batches(number: dict[str, int]):
    def run(batches):
        find = re.compile(TERM).findall
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                keep, n, starts, terms, tfs = [], [], [0], [], []
                for i in range(a, b):
                    words = terms_of(texts[i], find)
                    if words:
                        tf = Counter(words)
                        held = number.keys() & tf.keys()
                        keep.append(i)
                        n.append(len(words))
                        terms += [number[t] for t in held]
                        tfs += [tf[t] for t in held]
                        starts.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    return run


def _smallest(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The places of the TOP smallest `of` of each key."""
    order = np.lexsort((of, keys))
    k = keys[order]
    start = np.concatenate(([True], k[1:] != k[:-1]))
    place = np.arange(len(k))
    return order[place - np.maximum.accumulate(np.where(start, place, 0)) < TOP]


def _search_batches(rank: np.ndarray, items: list[tuple[int, np.ndarray, np.ndarray]], big_n: int, big_l: int, id_type: pa.DataType):
    """rank: the place of each term in the order of frequency; items: (number, ranks, weights)."""

    def run(batches):
        #: Of each item, up to TOP (score, id) in the order of results, by a number for each id that was kept.
        kept: list[tuple[np.ndarray, pa.Array]] = [(np.zeros(0, np.int64), pa.array([], id_type)) for _ in items]

        def tree_of(part: pa.Table):
            ids = part.column("id").combine_chunks()
            order = pc.sort_indices(ids, null_placement="at_end")
            place = np.empty(len(ids), np.int64)
            place[order.to_numpy()] = np.arange(len(ids))
            n = part.column("n").to_numpy()
            m = 10 + (90 * n * big_n) // big_l
            lists = part.column("terms").combine_chunks()
            starts = lists.offsets.to_numpy().astype(np.int64)
            starts -= starts[0]
            own = np.repeat(np.arange(len(n)), np.diff(starts))
            terms, tfs = rank[lists.flatten().to_numpy()], part.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            sort = np.lexsort((terms, own))
            terms, tfs = terms[sort], tfs[sort]
            # Documents that are alike: terms, tfs and m as bytes.
            packed = np.stack([terms, tfs]).T.astype("<u4").tobytes()
            ends = (starts * 8).tolist()
            seen: dict = {}
            alike = np.array([seen.setdefault((packed[a:b], x), len(seen)) for a, b, x in zip(ends, ends[1:], m.tolist())], np.int64)
            stay = np.sort(_smallest(alike, place))
            stay = stay[np.diff(starts)[stay] > 0]
            if not len(stay):
                return
            size = np.diff(starts)[stay]
            first = np.cumsum(size) - size
            at = np.repeat(starts[stay] - first, size) + np.arange(size.sum())
            tree = Tree(np.concatenate(([0], np.cumsum(size))), terms[at], tfs[at], m[stay], len(rank))
            for k, (_, own_terms, w) in enumerate(items):
                score, known = kept[k]
                best = [score, np.full(len(score), -1)]  # documents of this tree, -1: kept before

                def offer(docs: np.ndarray, found: np.ndarray) -> int:
                    best[0], best[1] = np.concatenate((best[0], found)), np.concatenate((best[1], docs))
                    if len(best[0]) < TOP:
                        return 1
                    return int(np.partition(best[0], -TOP)[-TOP])

                before = len(score)
                tree.search(own_terms, w, int(score.min()) if before == TOP else 1, offer)
                if len(best[0]) == before:
                    continue
                # Ties go by id: what was kept before and what is new are ordered together.
                least = np.partition(best[0], -TOP)[-TOP] if len(best[0]) > TOP else 0
                new = np.flatnonzero((best[1] >= 0) & (best[0] >= least))
                new = new[np.lexsort((place[stay[tree.of[best[1][new]]]], -best[0][new]))][:TOP]
                ids_too = pa.concat_arrays([known, ids.take(pa.array(stay[tree.of[best[1][new]]]))])
                scores_too = np.concatenate((score, best[0][new]))
                rows = pa.table({"s": pa.array(scores_too), "id": ids_too})
                chosen = pc.sort_indices(rows, sort_keys=[("s", "descending"), ("id", "ascending")], null_placement="at_end")[:TOP]
                kept[k] = (scores_too[chosen.to_numpy()], ids_too.take(chosen))

        held, postings, docs = [], 0, 0
        width = max(1, len(rank))
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.list_value_length(batch.column("terms")).to_numpy()
            a, total = 0, np.cumsum(sizes)
            while a < batch.num_rows:
                base = total[a] - sizes[a]
                room = max(1, int(np.searchsorted(total, base + POSTINGS - postings, "right")) - a)
                room = max(1, min(room, MAXIMA * LEAF // (4 * width) - docs))
                b = min(batch.num_rows, a + room)
                held.append(batch.slice(a, b - a))
                postings, docs = postings + int(total[b - 1] - base), docs + b - a
                a = b
                if postings >= POSTINGS or docs >= MAXIMA * LEAF // (4 * width) or a < batch.num_rows:
                    tree_of(pa.Table.from_batches(held))
                    held, postings, docs = [], 0, 0
        if held:
            tree_of(pa.Table.from_batches(held))
        for (number, _, _), (score, ids) in zip(items, kept):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), number)), ids, pa.array(score)], names=["item", "id", "score"])

    return run


def weight(big_n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * big_n + 2) / (2 * df + 1)))


def _one_pass(docs: DataFrame, items: list, id_col: str, text_col: str) -> DataFrame | None:
    """(item, id, score) of what tasks keep for items (number, text)."""
    spark = docs.sparkSession
    of_item = [(number, sorted(set(terms_of(text)))) for number, text in items]
    number = {t: i for i, t in enumerate(sorted({t for _, ts in of_item for t in ts}))}
    if not number:
        return None
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    vectors = rows.mapInArrow(frugal(_vector_batches(number)), f"id {id_type.simpleString()}, n long, terms array<int>, tfs array<int>")
    vectors = materialize(vectors, "lexical-vectors", "zstd")
    big_n, big_l = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not big_n:
        return None
    # A row for each term of the pass's items.
    df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect())
    order = sorted(range(len(number)), key=lambda t: (-df.get(t, 0), t))
    rank = np.empty(len(number), np.int64)
    rank[order] = np.arange(len(order))
    ready = []
    for k, ts in of_item:
        ids = [number[t] for t in ts if df.get(number[t])]
        if ids:
            ready.append((k, rank[ids], np.array([weight(big_n, df[t]) for t in ids], np.int64)))
    if not ready:
        return None
    from pyspark.sql.pandas.types import to_arrow_type

    return vectors.select("id", "n", "terms", "tfs").mapInArrow(frugal(_search_batches(rank, ready, big_n, big_l, to_arrow_type(id_type))), f"item long, id {id_type.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): the TOP documents of highest positive score of each item."""
    spark = docs.sparkSession
    bound_batches(spark)
    named = materialize(items.select(F.col(item_col).alias("name"), F.col(item_text_col).alias("text")).withColumn("item", F.monotonically_increasing_id()), "lexical-items")
    chars = named.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = math.ceil(chars / PASS_CHARS)
    found = []
    for k in range(passes):
        some = named.where((F.pmod(F.xxhash64("item"), F.lit(passes)) == k) & F.col("text").isNotNull()).select("item", "text").collect()  # about PASS_CHARS characters
        part = _one_pass(docs, [tuple(r) for r in some], id_col, text_col)
        if part is not None:
            found.append(part)
    if not found:
        schema = [named.schema["name"], docs.schema[id_col]]
        return spark.createDataFrame([], f"`{item_col}` {schema[0].dataType.simpleString()}, rank int, `{id_col}` {schema[1].dataType.simpleString()}, score long")
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    best = [F.desc("score"), F.col("id").asc_nulls_last()]
    # What tasks keep is ranked in groups of tasks first, so that no item's rows of all tasks meet.
    every = every.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64)))
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("item", "some").orderBy(*best))).where(F.col("rank") <= TOP)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= TOP)
    return ranked.join(named.select("item", "name"), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH i AS (SELECT k, item_id, unnest(list_distinct({_SQL_TERMS})) t FROM (SELECT row_number() OVER () k, item_id, text FROM benchmark)),
v AS (SELECT k, doc_id, {_SQL_TERMS} ts FROM (SELECT row_number() OVER () k, doc_id, text FROM documents)),
d AS (SELECT k, doc_id, len(ts)::BIGINT n FROM v WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT big_n, sum(n)::BIGINT big_l FROM d),
p AS (SELECT k, t, count(*)::BIGINT tf FROM (SELECT k, unnest(ts) t FROM v) WHERE t IN (SELECT t FROM i) GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT w FROM (SELECT t, count(*)::BIGINT df FROM p GROUP BY 1), s),
c AS (SELECT k, t, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)) c FROM p JOIN d USING (k), s),
r AS (SELECT i.k, any_value(i.item_id) item_id, any_value(d.doc_id) doc_id, sum(w * c)::BIGINT score FROM i JOIN w USING (t) JOIN c USING (t) JOIN d ON d.k = c.k GROUP BY i.k, d.k),
q AS (SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) "rank", doc_id, score FROM r WHERE score > 0)
SELECT item_id, "rank"::INT "rank", doc_id, score FROM q WHERE "rank" <= {TOP}
"""
