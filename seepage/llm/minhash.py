"""Near-duplicate texts by order MinHash and banded alignment.

Texts that are equal form a class and count once. Of a class, every k-mer of SHINGLE lower-case words,
labelled with its number of occurrence, gets a hash; the SKETCH_KMERS of smallest hash stand for the text, and each of SLOTS
sketches keeps the SAMPLE smallest of them under its own hash and joins them in text order, so a sketch is likely to agree for texts
of small edit distance, not just of similar sets. Of a text of SHORT words or fewer hardly a five-word k-mer outlasts an edit in
each fifth word; such texts (and those up to 1 / SIMILARITY longer, which may be near to them) have SHORT_SLOTS sketches of k-mers of
SHORT_SHINGLE words. Classes that share a sketch are candidates; a pair is near if a banded alignment of its words matches at least
SIMILARITY of the longer text.

Candidates are verified so that a large group of copies costs stars and not all pairs. In each of ROUNDS rounds, a class meets the
centre of its buckets' centres that it meets most often; what is found near becomes one component. Then only buckets
whose members are not yet in one component are left. There, the members outside the bucket's largest component are
compared with all others of other components, in blocks of BLOCK, where a bound on common words does not rule a pair out; a pair
found near joins its components at once, so that a block yields fewer edges than members. What is never compared is in one
component already or shares no sketch. Pairs at SIMILARITY by random substitutions share a sketch with a probability of about 0.93, at 0.85 of
0.99 (the README has measured shares).

Null texts are compared with nothing and stay. Empty texts equal each other. Texts of fewer words than a k-mer have one
k-mer. Classes are known by their smallest id and a digest of their text, so null and repeated ids do no harm: a group's id is the smallest known id
(null if it has none). Repeated rows are copies. Extra columns are dropped by groups() and kept by keep_one().
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.llm.common import bound_batches, bucketed, frugal, materialize, parts, slices, table
from seepage.llm.components import connected_components

SHINGLE = 5
SLOTS = 96
SAMPLE = 2
#: K-mers of smallest hash that the slots draw from.
SKETCH_KMERS = 96
SHORT = 64
SHORT_SHINGLE = 2
SHORT_SLOTS = 32
SIMILARITY = 0.8
#: Rounds in which a class meets one centre.
ROUNDS = 2
BLOCK = 1024
#: Word counts hashed to so many bins bound the words that two texts have in common.
BINS = 128
MOST = 65_535
MEMO_WORDS = 100_000
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
ODD = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.random.default_rng(11).integers(1, 1 << 63, SLOTS + SHORT_SLOTS).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Sketcher:
    def __init__(self):
        self.memo: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def codes(self, words: list[list[str]]) -> list[np.ndarray]:
        if len(self.memo) > MEMO_WORDS:
            self.__init__()
        new = list({w for ws in words for w in ws}.difference(self.memo))
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        own = np.fromiter((int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in new), np.uint64, len(new))
        self.hashes = np.concatenate((self.hashes, own))
        return [self.hashes[np.fromiter(map(self.memo.__getitem__, ws), np.int64, len(ws))] for ws in words]

    def __call__(self, texts: list) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(word counts, sketches of each text, bin counts) of texts."""
        words = [words_of(t) for t in texts]
        n = np.array([len(w) for w in words], dtype=np.int64)
        codes = self.codes(words)
        bins = np.stack([np.bincount((c >> np.uint64(57)).astype(np.int64), minlength=BINS) for c in codes])
        sketches: list[list[np.ndarray]] = [[] for _ in texts]
        for chosen, width, slots in ((n > SHORT, SHINGLE, range(SLOTS)), ((n > 0) & (n <= SHORT / SIMILARITY), SHORT_SHINGLE, range(SLOTS, SLOTS + SHORT_SLOTS))):
            at = np.flatnonzero(chosen)
            if len(at):
                for i, s in zip(at.tolist(), self.family([codes[i] for i in at], width, slots)):
                    sketches[i].append(s)
        return n, [np.concatenate(s) if s else np.zeros(0, np.int64) for s in sketches], bins

    @staticmethod
    def family(codes: list[np.ndarray], width: int, slots: range) -> np.ndarray:
        """(texts, slots) sketches of the k-mers of width words."""
        n = np.array([len(c) for c in codes], np.int64)
        pad = np.zeros(width - 1, np.uint64)
        flat = np.concatenate([x for c in codes for x in (c, pad)])
        starts = np.cumsum(n + width - 1) - (n + width - 1)
        kmers = np.maximum(n - width + 1, 1)
        own = np.repeat(np.arange(len(n)), kmers)
        first = np.cumsum(kmers) - kmers
        place = np.arange(len(own)) - first[own]
        at = starts[own] + place
        with np.errstate(over="ignore"):
            k = np.zeros(len(at), np.uint64)
            for j in range(width):
                k += mix(flat[at + j] + SEEDS[j])
        k = mix(k) >> np.uint64(24)
        # Sorted by text, then hash, then place: repeats of a k-mer stand together and the smallest hashes first.
        order = np.argsort((own.astype(np.uint64) << np.uint64(40)) | k, kind="stable")
        k, place = k[order], place[order]
        same = np.concatenate(([False], (k[1:] == k[:-1]) & (own[1:] == own[:-1])))
        rank = np.arange(len(k))
        occurrence = rank - np.maximum.accumulate(np.where(same, 0, rank))
        kept = rank - first[own] < SKETCH_KMERS
        k, place, own, occurrence = k[kept], place[kept], own[kept], occurrence[kept].astype(np.uint64)
        k = mix(k ^ mix(occurrence + np.uint64(77)))
        size = np.bincount(own, minlength=len(n))
        first = np.cumsum(size) - size
        out = np.empty((len(n), len(slots)), np.int64)
        for i, s in enumerate(slots):
            v = mix(k ^ SEEDS[s])
            low1, at1 = lowest(v, first, own)
            v[at1] = TOP
            low2, at2 = lowest(v, first, own)
            swap = place[at2] < place[at1]
            with np.errstate(over="ignore"):
                out[:, i] = mix(np.where(swap, low2, low1) + ODD * (np.where(swap, low1, low2) ^ np.uint64(s))).view(np.int64)
        return out


def lowest(v: np.ndarray, first: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest value, its first place) of each run of v."""
    low = np.minimum.reduceat(v, first)
    hit = np.flatnonzero(v == low[own])
    of = own[hit]
    return low, hit[np.concatenate(([True], of[1:] != of[:-1]))]


def lcs_at_least(a: list, b: list, share: float = SIMILARITY) -> bool:
    """Whether an alignment matches at least share of the longer sequence's words.

    Bit-parallel rows that hold only the band of diagonals that such an alignment can touch. Words in common, in any order, bound it."""
    if len(a) < len(b):
        a, b = b, a
    need = math.ceil(share * len(a) - 1e-9)
    if len(b) < need:
        return False
    over, under = len(a) - need, len(b) - need
    i, stop = 0, len(b)
    while i < stop and a[i] == b[i]:
        i += 1
    j = 0
    while j < stop - i and a[-1 - j] == b[-1 - j]:
        j += 1
    need -= i + j
    if need <= 0:
        return True
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if sum((Counter(a) & Counter(b)).values()) < need:
        return False
    places: dict = {}
    for x, w in enumerate(a):
        places.setdefault(w, []).append(x)
    masks = {w: sum(1 << x for x in p) for w, p in places.items() if 16 < len(p)}
    width = (1 << (over + under + 1)) - 1  # row y holds the columns from y - under to y + over
    rows, matched = width, 0
    for y, w in enumerate(b):
        if y:
            matched += not rows & 1
            rows = rows >> 1 | 1 << (over + under)
        low = y - under
        if w in masks:
            m = (masks[w] >> low if low >= 0 else masks[w] << -low) & width
        elif w in places:
            p = places[w]
            m = 0
            for x in p[bisect_left(p, low) : bisect_left(p, y + over + 1)]:
                m |= 1 << (x - low)
        else:
            continue
        u = rows & m
        if u:
            rows = ((rows + u) | (rows - u)) & width
    return matched + (over + under + 1 - rows.bit_count()) >= need


def text_key(text_col: str = "text") -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


_SIGN = -(1 << 63)


def node_of(rep: str, key: str) -> Column:
    """A class as bytes in the order of its smallest id (no id: last), then of its text's digest."""
    head = F.when(F.col(rep).isNull(), F.lit("F" * 17)).otherwise(F.concat(F.lit("0"), F.lpad(F.hex(F.col(rep).bitwiseXOR(F.lit(_SIGN))), 16, "0")))
    return F.concat(F.unhex(F.concat(F.lit("0"), head)), F.col(key))


def rep_of(node: str) -> Column:
    """The smallest id of the class; null if it has none."""
    value = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", value)


def _sketch_batches(batches):
    sketcher = Sketcher()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts, 1_000_000):
            n, sketches, bins = sketcher(texts[a:b])
            own = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sketches]))), pa.int32()), pa.array(np.concatenate(sketches), pa.int64()))
            held = np.minimum(bins, MOST).astype(np.uint16).tobytes()
            packed = pa.array([held[i : i + 2 * BINS] for i in range(0, len(held), 2 * BINS)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("key", "node")), pa.array(n, pa.int64()), own, packed], names=["key", "node", "n", "sketch", "bins"])


def sketch(classes: DataFrame) -> DataFrame:
    """(key, node, text) -> (key, node, n, sketch, bins)."""
    return classes.select("key", "node", "text").mapInArrow(frugal(_sketch_batches), "key binary, node binary, n long, sketch array<long>, bins binary")


def _verify_batches(batches):
    words = lru_cache(maxsize=64)(words_of)
    for batch in batches:
        keep = [lcs_at_least(words(a), words(b)) for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        words.cache_clear()


def key_of(node: str) -> Column:
    return F.substring(node, 10, 16)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) of nodes -> those that align; texts (key, text), bucketed by key, stay where they are: pairs come to them, and then go on with one text to the other."""
    first = pairs.withColumn("key", key_of("a")).hint("shuffle_hash").join(texts.withColumnRenamed("text", "ta"), "key").drop("key")
    both = first.withColumn("key", key_of("b")).join(texts.withColumnRenamed("text", "tb"), "key")
    return both.select("a", "b", "ta", "tb").mapInArrow(frugal(_verify_batches), "a binary, b binary")


#: A bucket and a pair of its blocks.
KEYS = ("code", "bi", "bj")
#: Pairs that are looked at together, runs from which on a matrix product looks at them, and the counts that it tells apart.
PAIRS = 20_000
CROWD = 40
LEVELS = 12


def whole_runs(batches):
    """Tables of whole runs of rows with equal KEYS, of rows that are sorted by them; a run of a pair of blocks is at most 2 * BLOCK rows or so."""
    held: pa.Table | None = None
    for batch in batches:
        both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not both.num_rows:
            continue
        changed = np.flatnonzero(run_starts(both))
        last = int(changed[-1]) if len(changed) else 0
        if last:
            yield both.slice(0, last).combine_chunks()
        held = both.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def run_starts(rows: pa.Table) -> np.ndarray:
    keys = np.stack([rows.column(k).to_numpy() for k in KEYS])
    return np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))


def _candidates(rows: pa.Table):
    """Arrays of pairs (i, j) of rows in one run: of different components, and admitted by a bound on common words."""
    n, block, bi, bj = (rows.column(c).to_numpy() for c in ("n", "block", "bi", "bj"))
    comp = pc.dictionary_encode(rows.column("comp").combine_chunks()).indices.to_numpy()
    bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint16).reshape(-1, BINS)
    def admitted(i: np.ndarray, j: np.ndarray):
        ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j])) & ((bi[i] == bj[i]) | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        for a in range(0, len(i), PAIRS):
            x, y = i[a : a + PAIRS], j[a : a + PAIRS]
            ok = np.minimum(bins[x], bins[y]).sum(axis=1, dtype=np.int64) >= SIMILARITY * np.maximum(n[x], n[y])
            ok |= (n[x] >= MOST) & (n[y] >= MOST)
            if ok.any():
                yield x[ok], y[ok]

    def crowd(a: int, b: int):
        """Of a large run, pairs by one matrix product: the words in common are at most those of bins, counted up to LEVELS, and what is over."""
        held = bins[a:b].astype(np.int16) if n[a:b].max() < 1 << 15 else bins[a:b].astype(np.int64)
        steps = (held[:, :, None] > np.arange(LEVELS)).reshape(b - a, -1)
        steps = steps[:, steps.any(axis=0)].astype(np.float32)
        over = np.maximum(held - LEVELS, 0).sum(axis=1)
        length, own = n[a:b], comp[a:b]
        out = []
        for k in range(0, b - a, 256):  # some rows of the product at a time
            rows_ = slice(k, k + 256)
            both = steps[rows_] @ steps.T + np.minimum(over[rows_, None], over[None, :])
            near = both >= SIMILARITY * np.maximum(length[rows_, None], length[None, :])
            near |= (length[rows_, None] >= MOST) & (length[None, :] >= MOST)
            near &= own[rows_, None] != own[None, :]
            i, j = np.nonzero(np.triu(near, k + 1))
            out.append((i + a + k, j + a))
        return tuple(np.concatenate(c) for c in zip(*out))

    pairs_of = lru_cache(maxsize=64)(lambda m: np.triu_indices(m, 1))
    cuts = [*np.flatnonzero(run_starts(rows)).tolist(), len(n)]
    some, total = [], 0
    for a, b in zip(cuts, cuts[1:]):
        if b - a > CROWD:
            i, j = crowd(a, b)
            a = 0
        else:
            i, j = pairs_of(b - a)
        some.append((i + a, j + a))
        total += len(i)
        if total >= PAIRS:
            yield from admitted(*(np.concatenate(c) for c in zip(*some)))
            some, total = [], 0
    if some:
        yield from admitted(*(np.concatenate(c) for c in zip(*some)))


def _cross_rows(batches):
    """The members that have a candidate: the texts of no others are sent to the buckets."""
    for rows in whole_runs(batches):
        used = np.zeros(rows.num_rows, bool)
        for i, j in _candidates(rows):
            used[i] = True
            used[j] = True
        yield from rows.filter(pa.array(used)).to_batches()


def _cross_pairs(batches):
    """Near pairs that join components; what is in one component by pairs found before in the task needs no look."""
    words = lru_cache(maxsize=2 * BLOCK)(words_of)
    for rows in whole_runs(batches):
        node, text, comp = (rows.column(c).to_pylist() for c in ("node", "text", "comp"))
        root: dict[bytes, bytes] = {}

        def find(c: bytes) -> bytes:
            while c in root:
                c = root[c]
            return c

        found, seen = [], set()
        for i, j in _candidates(rows):
            for x, y in zip(i.tolist(), j.tolist()):
                a, b, pair = find(comp[x]), find(comp[y]), (min(node[x], node[y]), max(node[x], node[y]))
                if a == b or pair in seen:
                    continue
                seen.add(pair)
                if lcs_at_least(words(text[x]), words(text[y])):
                    root[max(a, b)] = min(a, b)
                    found.append(pair)
        words.cache_clear()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in range(2)], names=["a", "b"])


def _joined(comps: DataFrame, near: DataFrame) -> DataFrame:
    """comps (node, comp) after the near pairs (a, b) have joined components."""
    ends = near.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    roots = connected_components(ends.select("ca", "cb"), "ca", "cb").select(F.col("node").alias("comp"), "root")
    return materialize(comps.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "minhash-comps")


def _mixed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (code, node, n, comp) of the buckets whose members are in several components."""
    bucket = Window.partitionBy("code")
    placed = members.select("code", "node", "n").join(comps, "node").withColumns({"low": F.min("comp").over(bucket), "high": F.max("comp").over(bucket)})
    return placed.where("low <> high").drop("low", "high")


def _star(members: DataFrame, rank: int) -> DataFrame:
    """(a, b): each class b with the centre a that it meets in most buckets; rank seeds the choice of centres."""
    bucket = Window.partitionBy("code")
    lead = F.xxhash64("node", F.lit(rank)) if rank else F.lit(0)
    met = members.withColumn("c", F.min(F.struct(lead.alias("lead"), "node", "n", "comp")).over(bucket))
    met = met.where(f"comp <> c.comp and least(n, c.n) >= {SIMILARITY} * greatest(n, c.n)")
    met = met.groupBy(F.col("c.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("times"))
    return met.groupBy("b").agg(F.max(F.struct("times", "a")).alias("m")).select("m.a", "b")


def _blocks(mixed: DataFrame) -> DataFrame:
    """mixed with (block, bi, bj): members outside a bucket's largest component meet all blocks, those inside only the blocks of the others."""
    bucket = Window.partitionBy("code")
    sized = mixed.withColumn("of_comp", F.count("*").over(Window.partitionBy("code", "comp")))
    sized = sized.withColumn("main", F.max(F.struct("of_comp", "comp")).over(bucket)).withColumn("inside", F.col("comp") == F.col("main.comp"))
    number = lambda c: F.greatest(F.lit(1), F.ceil(F.count_if(c).over(bucket) / BLOCK).cast("int"))
    sized = sized.withColumns({"outer": number(~F.col("inside")), "inner": number(F.col("inside"))})
    at = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    sized = sized.withColumn("block", F.when(F.col("inside"), F.col("outer") + at("inner")).otherwise(at("outer")))
    partners = F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    wide = sized.withColumn("other", F.explode(F.sequence(F.lit(0), partners - 1)))
    return wide.select(*mixed.columns, "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id long, key, node, root, class_id), a row for each row; class_id: the smallest id of the component that root names."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.first("text").alias("text"))
    n = parts(docs.sparkSession)
    classes = bucketed(classes.select("key", node_of("rep", "key").alias("node"), "text"), "minhash-classes", "key", n)
    sketches = bucketed(sketch(classes), "minhash-sketches", "key", n)
    buckets = sketches.where("n > 0").select("node", "n", F.explode("sketch").alias("code"))
    shared = buckets.withColumn("size", F.count("*").over(Window.partitionBy("code"))).where("size > 1").drop("size")
    members = materialize(shared, "minhash-buckets", "zstd")
    comps = materialize(members.select("node").distinct().withColumn("comp", F.col("node")), "minhash-comps")
    texts = classes.select("key", "text").join(comps.select(key_of("node").alias("key")).hint("shuffle_hash"), "key", "left_semi")
    texts = bucketed(texts, "minhash-texts", "key", n)
    for rank in range(ROUNDS):
        members = members.withColumn("comp", F.col("node")) if not rank else materialize(_mixed(members, comps), "minhash-mixed", "zstd")
        near = materialize(verify(materialize(_star(members, rank), "minhash-star"), texts), "minhash-near")
        comps = _joined(comps, near)
    # Bins come to a bucket's members once, before the members go to the pairs of blocks.
    mixed = _mixed(members, comps).withColumn("key", key_of("node")).hint("shuffle_hash").join(sketches.select("key", "bins"), "key").drop("key")
    wide = _blocks(mixed)
    used = wide.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(frugal(_cross_rows), wide.schema)
    used = materialize(used, "minhash-wide", "zstd").withColumn("key", key_of("node")).hint("shuffle_hash").join(texts, "key").drop("key")
    near = used.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(frugal(_cross_pairs), "a binary, b binary")
    comps = _joined(comps, materialize(near, "minhash-near"))
    named = classes.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("root"))
    found = rows.select("id", "key").join(named, "key", "left")
    return found.select("id", "key", "node", "root", F.when(F.col("key").isNull(), F.col("id")).otherwise(rep_of("root")).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of one text of each group: that of the smallest id (null ids last), once. Null texts stay."""
    kept = groups(docs, id_col, text_col).where("node = root and id <=> class_id").select(F.col("key").alias("__key"), F.coalesce("id", F.lit(0)).alias("__id"), F.col("id").isNull().alias("__none")).distinct()
    keyed = docs.withColumns({"__key": text_key(text_col), "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__none": F.col(id_col).isNull()})
    one = keyed.where("__key is not null").join(kept, ["__key", "__id", "__none"]).dropDuplicates(["__key", "__id", "__none"])
    return one.select(docs.columns).union(docs.where(F.col(text_col).isNull()))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
