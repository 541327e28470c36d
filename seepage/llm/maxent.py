"""Language model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(part | class, history) * P(word | part). A word's ending (a hash of its last SUFFIX
bytes) gives its class, so every word has one, seen or not; the end of a text is a class of its own. Endings are put into
classes by what stands beside them in the training texts. The parts of a class are its NAMED commonest training words, each a part of its own, and
PARTS - NAMED hash buckets of all others. Both softmaxes have hashed features of the history: the word before, the word before that (skip), and,
for the class, both; for the part, each together with the class. Inside a bucket part, words have their training counts plus one, and all unseen words of it
together count as one.

Texts are cut into chunks of about CHUNK_BYTES, known by a digest of what they hold. A chunk holds its texts as numbers of its own
word list, so exact corpus counts come from one row for each chunk and word: they are summed by word and
joined back to the chunks' lists. Chunks lie in a table bucketed by chunk, so that only the counts move. The weights (of a
fixed size) are trained by rounds of distributed gradient updates: in each, tasks run sparse minibatch steps
over their chunks of the round from the same weights, and the tasks' weights are averaged by row in proportion to use, in a fixed order.

Null texts are empty; an empty text is its end alone. Texts of any length are scored whole. Null and repeated
ids pass through, a row for each row. Without training texts all counts are 0 and the weights stay 0. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import bound_batches, bucketed, fold, frugal, materialize, parts, runs, table

CHUNK_BYTES = 4_000_000
SUFFIX = 3
ENDINGS = 512  # hash buckets of word endings
CLASSES = 16  # of endings; one more for the end of a text
PARTS = 16  # of a class
NAMED = 12
BUCKETS_LOG2 = 12
BUCKETS = 1 << BUCKETS_LOG2  # for each of the three kinds of feature
PART_LOG2 = 13
PART_BUCKETS = 1 << PART_LOG2  # the same, of features with a class
#: Most buckets of the table of chunks.
TABLE_BUCKETS = 50_000
ROUNDS = 2
BATCH = 8192
RATE = 0.1
#: Added to the squared gradients, so that rare features move little.
DAMP = 0.1
#: Logits of at most this size need no shift before they are exponentiated.
SAFE = 60.0
#: The commonest words, at most so many, reach the chunks as a table of their own and not by the join.
FREQUENT = 200_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_START = np.uint32(0x9747B28C)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def ending(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % ENDINGS


def ending_column(word: str) -> Column:
    return F.pmod(F.crc32(F.substring(word, -SUFFIX, SUFFIX)), F.lit(ENDINGS)).cast("int")


def bucket_part(word: bytes) -> int:
    """The part of a word that has none of its own."""
    return NAMED + zlib.crc32(word) % (PARTS - NAMED)


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def word_numbers(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hash (signed), ending and bucket_part of many words."""
    crc, blake = zlib.crc32, hashlib.blake2b
    hashes = np.frombuffer(b"".join([blake(w, digest_size=8).digest() for w in words]), "<i8")
    endings = np.fromiter([crc(w[-SUFFIX:]) for w in words], np.uint32, len(words)) % ENDINGS
    spare = np.fromiter([crc(w) for w in words], np.uint32, len(words)) % (PARTS - NAMED) + NAMED
    return hashes, endings.astype(np.int16), spare.astype(np.int16)


def _chunk_batches(batches):
    for batch in batches:
        texts = batch.column("text")
        held = np.array(batch.column("held").to_pylist(), bool)
        ids = batch.column("id")
        for start, end in runs([len(t) if t is not None else 0 for t in texts.to_pylist()], CHUNK_BYTES):
            words = _Codes()
            lowered = [(t or b"").translate(LOWER) for t in texts.slice(start, end - start).to_pylist()]
            digest = hashlib.blake2b(repr(ids.slice(start, end - start).to_pylist()).encode(), digest_size=8)
            for t in lowered:
                digest.update(b"%d:" % len(t))
                digest.update(t)
            tokens = [t.split() for t in lowered]
            del lowered
            sizes = np.array([len(t) for t in tokens], np.int64)
            codes = np.fromiter(map(words.__getitem__, chain.from_iterable(tokens)), np.int32, int(sizes.sum()))
            del tokens
            trained = np.repeat(~held[start:end], sizes)
            counts = np.bincount(codes[trained], minlength=len(words)).astype(np.int32)
            hashes, endings, spare = word_numbers(words)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            columns = [
                pa.array([int.from_bytes(digest.digest(), "little") >> 1], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), ids.slice(start, end - start)),
                one(held[start:end], pa.bool_()), one(sizes, pa.int32()), one(codes, pa.int32()), one(list(words), pa.binary()),
                one(counts, pa.int32()), one(hashes, pa.int64()), one(endings, pa.int16()), one(spare, pa.int16()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "held", "sizes", "codes", "words", "counts", "hashes", "endings", "spare"])


def chunks(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks with equal keys hold the same rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).cast("binary").alias("text"))
    schema = f"chunk long, ids array<{kind}>, held array<boolean>, sizes array<int>, codes array<int>, words array<binary>, counts array<int>, hashes array<long>, endings array<smallint>, spare array<smallint>"
    return rows.mapInArrow(frugal(_chunk_batches), schema)


def _numpy(value) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


def _pair_batches(batches):
    """Counts of neighbouring endings in training texts, a row for each first ending."""
    total = np.zeros(ENDINGS * ENDINGS, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, held, codes, endings = (_numpy(batch.column(c)[i]) for c in ("sizes", "held", "codes", "endings"))
            e = endings[codes].astype(np.int64)
            both = np.repeat(~held, sizes)[1:]
            both[np.cumsum(sizes)[:-1][(np.cumsum(sizes)[:-1] > 0) & (np.cumsum(sizes)[:-1] < len(e))] - 1] = False
            total += np.bincount((e[:-1] * ENDINGS + e[1:])[both], minlength=ENDINGS * ENDINGS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])


def ending_classes(table_: DataFrame) -> np.ndarray:
    """The class of each ending: k-means on the leading directions of the endings' neighbour counts, a matrix of fixed size."""
    rows = table_.select("sizes", "held", "codes", "endings").mapInArrow(_pair_batches, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(ENDINGS * ENDINGS)
    counts[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return cluster(counts.reshape(ENDINGS, ENDINGS))


def cluster(counts: np.ndarray) -> np.ndarray:
    both = counts + counts.T
    mass = both.sum(axis=1)
    classes = np.arange(len(mass)) % CLASSES
    seen = np.flatnonzero(mass > 0)
    if len(seen) <= CLASSES:
        return classes
    own = both[np.ix_(seen, seen)]
    share = np.sqrt(own / np.sqrt(mass[seen][:, None] * mass[seen][None, :]))
    u, s, _ = np.linalg.svd(share)
    points = u[:, : CLASSES] * s[: CLASSES]
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    weight = mass[seen]
    centres = [int(weight.argmax())]
    for _ in range(CLASSES - 1):  # the heaviest points far from what is taken
        d = ((points[:, None, :] - points[centres][None, :, :]) ** 2).sum(axis=2).min(axis=1)
        centres.append(int((d * weight).argmax()))
    middle = points[centres]
    for _ in range(50):
        near = ((points[:, None, :] - middle[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(CLASSES):
            if (near == k).any():
                middle[k] = np.average(points[near == k], axis=0, weights=weight[near == k])
    classes[seen] = near
    return classes


@dataclass
class Classes:
    """The class of each ending, and the words that are parts of their own: sorted hashes, words and parts."""

    of_ending: np.ndarray
    hashes: np.ndarray
    words: pa.Array
    parts: np.ndarray

    @classmethod
    def of(cls, of_ending: np.ndarray, common: list[tuple[bytes, int]]) -> Classes:
        """common: (word, count); those of equal hash don't come both."""
        by_class: dict[int, list] = {}
        for word, c in common:
            by_class.setdefault(int(of_ending[ending(word)]), []).append((-c, word))
        named = sorted((word_hash(w), w, part) for own in by_class.values() for part, (_, w) in enumerate(sorted(own)[:NAMED]))
        order = np.argsort(np.array([h for h, _, _ in named], np.uint64).view(np.int64)) if named else []
        named = [named[i] for i in order]
        return cls(of_ending, np.array([h for h, _, _ in named], np.uint64).view(np.int64), pa.array([w for _, w, _ in named], pa.binary()), np.array([p for _, _, p in named], np.int64))

    def __call__(self, words: pa.Array, hashes: np.ndarray, endings: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, part) of each word of a chunk's list; spare: their bucket parts."""
        parts = spare.astype(np.int64)
        at, same = look_up(self.hashes, self.words, hashes, words)
        parts[same] = self.parts[at[same]]
        return self.of_ending[endings], parts


def look_up(known_hashes: np.ndarray, known: pa.Array, hashes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places in known, whether the word is there): found by hash, compared in full."""
    if not len(known_hashes) or not len(words):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(known_hashes, hashes), len(known_hashes) - 1)
    return at, pc.equal(known.take(pa.array(at)), words).to_numpy(zero_copy_only=False)


def history(codes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, classes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature rows of each token, 3 columns; class of each token; feature rows of its part, 2 columns; part), ends counted as tokens."""
    n = len(codes) + len(sizes)
    ends = np.cumsum(sizes + 1) - 1
    word = np.ones(n, bool)
    word[ends] = False
    h = np.full(n, _START, np.uint32)
    h[word] = (hashes.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[codes]
    y = np.full(n, CLASSES, np.int64)
    y[word] = classes[codes]
    z = np.zeros(n, np.int64)
    z[word] = parts[codes]
    one = np.concatenate(([_START], h[:-1]))
    one[ends[:-1] + 1] = _START
    two = np.concatenate(([_START], one[:-1]))
    two[ends[:-1] + 1] = _START
    with np.errstate(over="ignore"):
        both = (one * np.uint32(3266489917)) ^ (two * np.uint32(668265263))
        mixed = (one * np.uint32(2654435761), two * np.uint32(2246822519), both * np.uint32(374761393))
        x = np.stack([(m >> np.uint32(32 - BUCKETS_LOG2)) + np.uint32(k * BUCKETS) for k, m in enumerate(mixed)], axis=1).astype(np.int64)
        own = (y.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
        of_part = [(((m ^ own) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - PART_LOG2)) + np.uint32(k * PART_BUCKETS) for k, m in enumerate(mixed[:2])]
    return x, y, np.stack(of_part, axis=1).astype(np.int64), z


def empty_weights() -> list[np.ndarray]:
    """Of the classes and of the parts: rows of features, then the rows of biases, one for all tokens and one for each class."""
    return [np.zeros((3 * BUCKETS + 1, CLASSES + 1), np.float32), np.zeros((2 * PART_BUCKETS + CLASSES, PARTS), np.float32)]


def logits(weights: np.ndarray, x: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """bias: the bias row of each token, counted from the first."""
    first = len(weights) - (1 if weights.shape[1] == CLASSES + 1 else CLASSES)
    out = weights.take(first + bias, axis=0)
    for k in range(x.shape[1]):
        out += weights.take(x[:, k], axis=0)
    return out


def exps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In place: (exponentials of each row, their sums); rows are shifted where a logit is out of range."""
    if len(z) and (z.max() > SAFE or z.min() < -SAFE):
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def chosen(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of log_softmax, the places y alone; z is used up."""
    own = np.arange(len(y))
    if len(z) and (z.max() > SAFE or z.min() < -SAFE):
        z -= z.max(axis=1, keepdims=True)
    at = z[own, y]
    return at - np.log(exps(z)[1])


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def step(weights: np.ndarray, squares: np.ndarray, uses: np.ndarray, x: np.ndarray, y: np.ndarray, bias: np.ndarray) -> None:
    """One sparse AdaGrad step on a minibatch, in place."""
    g, total = exps(logits(weights, x, bias))
    g /= total[:, None]
    g[np.arange(len(y)), y] -= 1

    def move(rows, total, n):
        squares[rows] += np.einsum("ij,ij->i", total, total) / total.shape[1]
        weights[rows] -= RATE * total / np.sqrt(squares[rows] + DAMP)[:, None]
        uses[rows] += n

    for k in range(x.shape[1]):
        order = np.argsort(x[:, k].astype(np.uint16), kind="stable")  # 16 bits sort by radix
        rows = x[order, k]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        move(rows[first], np.add.reduceat(g.take(order, axis=0), first, axis=0), np.diff(np.concatenate((first, [len(order)]))))
    n = np.bincount(bias)
    rows = np.flatnonzero(n)
    total = (bias[None, :] == rows[:, None]).astype(np.float32) @ g
    move(len(weights) - (1 if weights.shape[1] == CLASSES + 1 else CLASSES) + rows, total, n[rows])


def _train_batches(weights: list[np.ndarray], classes: Classes):
    def run(batches):
        w = [m.copy() for m in weights]
        squares = [np.zeros(len(m), np.float32) for m in w]
        uses = [np.zeros(len(m), np.float32) for m in w]
        source = None
        for batch in batches:
            for i in range(batch.num_rows):
                source = source if source is not None else batch.column("chunk")[i].as_py()
                sizes, held, codes, hashes, endings, spare = (_numpy(batch.column(c)[i]) for c in ("sizes", "held", "codes", "hashes", "endings", "spare"))
                of_word, part = classes(batch.column("words")[i].values, hashes, endings, spare)
                keep = np.repeat(~held, sizes)
                x, y, u, z = history(codes[keep], sizes[~held], hashes, of_word, part)
                for a in range(0, len(y), BATCH):
                    own = y[a : a + BATCH]
                    step(w[0], squares[0], uses[0], x[a : a + BATCH], own, np.zeros(len(own), np.int64))
                    word = np.flatnonzero(own < CLASSES) + a
                    if len(word):
                        step(w[1], squares[1], uses[1], u[word], z[word], y[word])
        for k in range(2):
            at = np.flatnonzero(uses[k])
            for a in range(0, len(at), 4096):
                rows = at[a : a + 4096]
                values = (w[k][rows] - weights[k][rows]) * uses[k][rows][:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), pa.float32()))
                columns = [pa.array(np.full(len(rows), source), pa.int64()), pa.array(k * 1024 + rows // 1024, pa.int32()), pa.array(rows, pa.int32()), pa.array(uses[k][rows], pa.float32()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["source", "block", "row", "uses", "moved"])

    return run


def _average(g: pd.DataFrame) -> pd.DataFrame:
    """The mean change of each row of a block, by use; summed in order of the tasks' first chunks, so that the sum is always the same."""
    g = g.sort_values(["row", "source"], kind="stable")
    rows, first = np.unique(g["row"].to_numpy(), return_index=True)
    total = np.add.reduceat(np.array(g["moved"].tolist(), dtype=float), first, axis=0)
    uses = np.add.reduceat(g["uses"].to_numpy(dtype=float), first)
    return pd.DataFrame({"block": int(g["block"].iloc[0]), "row": rows, "moved": (total / uses[:, None]).astype(np.float32).tolist()})


def train(table_: DataFrame, classes: Classes, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights after a pass over all training texts, cut in rounds."""
    weights = empty_weights()
    rows = table_.select("chunk", "sizes", "held", "codes", "words", "hashes", "endings", "spare")
    for k in range(rounds):
        part = rows.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == k)
        moved = part.mapInArrow(frugal(_train_batches(weights, classes)), "source long, block int, row int, uses float, moved array<float>")
        # As many rows as there are weights, of a fixed size.
        found = moved.groupBy("block").applyInPandas(_average, "block int, row int, moved array<float>").toArrow()
        if found.num_rows:
            block, row = (found.column(c).to_numpy() for c in ("block", "row"))
            change = found.column("moved").combine_chunks()
            flat, at = change.values.to_numpy(), change.offsets.to_numpy()
            for m in range(2):
                own = np.flatnonzero(block // 1024 == m)
                width = weights[m].shape[1]
                weights[m][row[own]] += flat[at[own][:, None] + np.arange(width)]
    return weights


def _score_batches(weights: list[np.ndarray], classes: Classes, totals: np.ndarray, n: int, v: int, ends: int, frequent: tuple[np.ndarray, pa.Array, np.ndarray]):
    """totals: (CLASSES + 1) x PARTS, what the counts inside a part are divided by; 0 for a part that is one word."""
    known_hashes, known_words, known_counts = frequent

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, held, codes, hashes, endings, spare = (_numpy(batch.column(c)[i]) for c in ("sizes", "held", "codes", "hashes", "endings", "spare"))
                words = batch.column("words")[i].values
                of_word, part = classes(words, hashes, endings, spare)
                found = batch.column("found")[i]
                at, same = look_up(known_hashes, known_words, hashes, words)
                counts = np.zeros(len(hashes), np.int64)
                counts[same] = known_counts[at[same]]
                if found.is_valid and len(found.values):
                    counts[found.values.field("pos").to_numpy()] = found.values.field("c").to_numpy()
                x, y, u, z = history(codes, sizes, hashes, of_word, part)
                at = np.cumsum(sizes + 1) - 1
                c = np.full(len(y), ends, np.int64)
                word = np.ones(len(y), bool)
                word[at] = False
                c[word] = counts[codes]
                inside = np.zeros(len(y))
                shared = totals[y, z] > 0
                inside[shared] = np.log10((c[shared] + 1) / totals[y[shared], z[shared]])
                for a in range(0, len(y), BATCH):
                    b = min(a + BATCH, len(y))
                    inside[a:b] += chosen(logits(weights[0], x[a:b], np.zeros(b - a, np.int64)), y[a:b]) / np.log(10)
                    own = np.flatnonzero(word[a:b]) + a
                    if len(own):
                        inside[own] += chosen(logits(weights[1], u[own], y[own]), z[own]) / np.log(10)
                first = at - sizes
                size = (sizes + 1).astype(np.int64)
                base = np.add.reduceat(np.log10(c + 1.0), first) - size * np.log10(n + 1.0 * (v + 1))
                known = np.add.reduceat((c > 0).astype(np.int64), first)
                columns = [batch.column("ids")[i].values, pa.array(held), pa.array(size), pa.array(known), pa.array(np.full(len(size), n, np.int64)), pa.array(base), pa.array(np.add.reduceat(inside, first))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def part_totals(classes: Classes, sums: list, common: dict[bytes, int]) -> np.ndarray:
    """Counts plus one of all words of each part, plus one for what is unseen; sums: (ending, bucket part, count, words)."""
    totals = np.zeros((CLASSES + 1, PARTS))
    totals[:CLASSES, NAMED:] = 1.0
    for e, part, c, words in sums:
        totals[classes.of_ending[e], part] += c + words
    for w in classes.words.to_pylist():  # these are parts of their own
        totals[classes.of_ending[ending(w)], bucket_part(w)] -= common[w] + 1
    return totals


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score); rows where held is true are not learned from."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    fresh = chunks(docs, held, id_col, text_col)
    # With fewer buckets than the session's shuffles have parts, Spark would move the chunks after all.
    made = bucketed(fresh, "maxent-chunks", "chunk", max(parts(spark), min(TABLE_BUCKETS, fresh.rdd.getNumPartitions())))
    listed = made.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words", "w.counts").where("counts > 0")
    counts = materialize(listed.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c")), "maxent-counts", "zstd")
    spare = (F.lit(NAMED) + F.pmod(F.crc32("word"), F.lit(PARTS - NAMED))).cast("int")
    sums = [tuple(r) for r in counts.groupBy(ending_column("word").alias("k"), spare.alias("part")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()]  # rows by ending and part
    ends = made.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    n, v = sum(r[2] for r in sums) + ends, sum(r[3] for r in sums) + (ends > 0)
    common = common_words(frequent_words(counts).toArrow())
    classes = Classes.of(ending_classes(made), list(zip(common.column("word").to_pylist(), common.column("c").to_pylist())))
    totals = part_totals(classes, sums, dict(zip(common.column("word").to_pylist(), common.column("c").to_pylist())))
    weights = train(made, classes)
    hashes = np.fromiter((word_hash(w) for w in common.column("word").to_pylist()), np.uint64, common.num_rows).view(np.int64)
    frequent = (hashes, common.column("word").combine_chunks(), common.column("c").to_numpy())
    # The common words have at most FREQUENT rows; the rest is joined, and what is found moves to the buckets of its chunk.
    places = made.select("chunk", F.posexplode("words").alias("pos", "word"))
    if common.num_rows:
        places = places.join(F.broadcast(spark.createDataFrame(common.select(["word"]))), "word", "left_anti")
    places = places.join(counts, "word")
    found = places.groupBy("chunk").agg(F.collect_list(F.struct("pos", "c")).alias("found"))  # as long as a chunk's word list
    rows = made.drop("counts").join(found.hint("shuffle_hash"), "chunk", "left")
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(frugal(_score_batches(weights, classes, totals, n, v, ends, frequent)), schema).withColumnRenamed("id", id_col)


def common_words(found: pa.Table) -> pa.Table:
    """(word, c) in order of the word's hash, signed; of words with one hash only the first, so that a look-up by hash can't miss."""
    words, c = found.column("word").to_pylist(), found.column("c").to_pylist()
    signed = lambda w: word_hash(w) - (1 << 64) * (word_hash(w) >> 63)
    rows = sorted((signed(w), w, k) for w, k in zip(words, c))
    kept = [r for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]]
    return pa.table({"word": pa.array([w for _, w, _ in kept], pa.binary()), "c": pa.array([k for _, _, k in kept], pa.int64())})


def frequent_words(counts: DataFrame) -> DataFrame:
    """The words whose count reaches the least power of two that at most FREQUENT words reach."""
    power = F.floor(F.log2("c")).cast("int")
    sizes = {r["p"]: r["n"] for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()}
    least, total = 1 << 62, 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > FREQUENT:
            break
        least = 1 << p
    return counts.where(F.col("c") >= least)


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)
