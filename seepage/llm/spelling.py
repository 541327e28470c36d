"""Spelling variants: words one edit apart, grouped under their most frequent neighbour.

Words come from whole texts: maximal runs of RUN, lower-cased in A-Z alone, of which the digest of document and run deletes one
code point in some (see `spelled`). Words of LEAST code points and at least two occurrences are compared.

Dense prefix-suffix tiling: the words of a tile are the rows of matrices of code points, padded once at the end and once at the
start. Columns of two blocks are compared from the front and from the back; two words are near if their common prefix and
suffix together reach the longer length minus one. Two words of a longer length M and at most one edit share
their first or their last ceil((M - 1) / 2) code points, so that blocks are formed of words that share one of these: tiles whose
words share neither hold no near pair. Blocks of more than BLOCK words are split, and each pair of their parts is a tile of its own; of small ones,
pairs of rows are compared together. A pair that shares both halves counts in the tile of its first half. Tiles return a row for each word
that has a near one, with the number and the best of them, never pairs.

Null and empty texts have no words. A null id is spelled null in the digest. Repeated rows count each. Empty tables give no rows. Extra columns are ignored; ids may be
of any type, their text counts. Ties go to the smallest word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import frugal, materialize, slices, table

RUN = "[A-Za-zÀ-ÿ]+"
LEAST = 7
SLIPS = 31
#: A form occurs at least so many times as often as the word.
RATIO = 10
BLOCK = 1024
#: Words that a task counts before it hands them on, and pairs of rows compared together.
HELD = 300_000
PAIRS = 1 << 18
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def spelled(runs: dict[str, int], head: int) -> dict[str, int]:
    """Words, with their occurrences, of a document's runs of at least LEAST code points; head: the crc32 of `<doc_id>:`.

    With h the crc32 of `<doc_id>:<run>` in lower case, the run loses its code point h % length where SLIPS divides h."""
    low: dict[str, int] = {}
    for run, n in runs.items():
        w = run.lower() if run.isascii() else run.translate(LOWER)
        low[w] = low.get(w, 0) + n
    out: dict[str, int] = {}
    for w, n in low.items():
        h = zlib.crc32(w.encode(), head)
        if h % SLIPS == 0:
            k = h % len(w)
            w = w[:k] + w[k + 1 :]
            if len(w) < LEAST:
                continue
        out[w] = out.get(w, 0) + n
    return out


def _count_batches(batches):
    # A run of LEAST or more that is found from the left is a maximal one.
    find = re.compile(f"{RUN[:-1]}{{{LEAST},}}").findall
    held: Counter = Counter()
    for batch in batches:
        ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
        for a, b in slices(texts):
            for i in range(a, b):
                if texts[i]:
                    held.update(spelled(Counter(find(texts[i])), zlib.crc32(f"{ids[i]}:".encode())))
            if len(held) > HELD:
                yield pa.RecordBatch.from_pydict({"word": list(held.keys()), "n": pa.array(held.values(), pa.int64())})
                held = Counter()
    if held:
        yield pa.RecordBatch.from_pydict({"word": list(held.keys()), "n": pa.array(held.values(), pa.int64())})


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """(word, n): words of at least `least` occurrences in all documents."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(frugal(_count_batches), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


#: What a block's words share: the longer length of its pairs, the side, and the code points there. With the numbers of a tile's two parts.
KEYS = ("m", "side", "half", "bi", "bj")


def _tiles(words: DataFrame) -> DataFrame:
    """(word, n, m, side, half, block, bi, bj): each word in the blocks of its halves, as a word of the longer length and of the shorter one."""
    length = F.length("word")
    cut = lambda m: F.ceil((m - 1) / 2).cast("int")
    entry = lambda m, side: F.struct(m.cast("int").alias("m"), F.lit(side).alias("side"), (F.expr("word").substr(F.lit(1), cut(m)) if side == 0 else F.expr("word").substr(length - cut(m) + 1, cut(m))).alias("half"))
    rows = words.select("word", "n", F.explode(F.array(*(entry(m, side) for m in (length, length + 1) for side in (0, 1)))).alias("e")).select("word", "n", "e.*")
    sizes = rows.groupBy("m", "side", "half").agg(F.count("*").alias("size"), F.count_if(F.length("word") == F.col("m")).alias("long"))
    # Blocks without a pair of the longer length, or of it and the shorter, have nothing to compare.
    sizes = sizes.where("size > 1 and long > 0").select("m", "side", "half", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(sizes, ["m", "side", "half"]).withColumn("block", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("word", "n", "m", "side", "half", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))


def codes_of(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, code points padded at the end, code points from the last to the first padded at the end); no code point is 0, or over 255."""
    joined = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    n = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(n) - n
    own, place = np.repeat(np.arange(len(n)), n), np.arange(len(joined)) - np.repeat(first, n)
    front, back = np.zeros((2, len(n), width), np.uint8)
    front[own, place] = joined
    back[own, n[own] - 1 - place] = joined
    return n, front, back


def _agree(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix and suffix of rows i and j of (front, back) matrices, column by column."""
    out = []
    for x in (a, b):
        x = x.T  # a column's code points lie together
        alive = np.ones(np.broadcast(i, j).shape, bool)
        total = np.zeros(alive.shape, np.int16)
        for column in x:
            alive &= (column[i] == column[j]) & (column[i] > 0)
            total += alive
            if not alive.any():
                break
        out.append(total)
    return out[0], out[1]


def near_in_runs(words: list[str], m: np.ndarray, side: np.ndarray, block: np.ndarray, cross: np.ndarray, starts: list[int]):
    """Arrays (i, j) of near pairs of rows in one run, i before j; starts: where runs begin, and the end. cross: rows of a tile of two parts."""
    width = int(m.max()) + 1
    n, front, back = codes_of(words, width)

    def near(i: np.ndarray, j: np.ndarray, p: np.ndarray, s: np.ndarray) -> np.ndarray:
        longer = np.maximum(n[i], n[j])
        half = (m[i]) // 2  # ceil((m - 1) / 2)
        ok = (longer == m[i]) & (np.minimum(n[i], n[j]) >= longer - 1) & (p + s >= longer - 1)
        ok &= ~((n[i] == n[j]) & (p == n[i]))  # equal words
        ok &= (side[i] == 0) | (p < half)
        return ok & (~cross[i] | (block[i] != block[j]))

    some: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        nonlocal some, total
        if some:
            i, j = (np.concatenate(x) for x in zip(*some))
            ok = near(i, j, *_agree(i, j, front, back))
            out.append((i[ok], j[ok]))
        some, total = [], 0

    shapes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for a, b in zip(starts, starts[1:]):
        size = b - a
        if size > 64:
            # A dense tile: rows in slabs against all rows after the slab's first.
            for x in range(a, b, 256):
                i, j = np.arange(x, min(x + 256, b))[:, None], np.arange(x, b)[None, :]
                p, s = _agree(i, j, front, back)
                ok = near(i, j, p, s) & (i < j)
                u, v = np.nonzero(ok)
                out.append((u + x, v + x))
        elif size > 1:
            if size not in shapes:
                shapes[size] = np.triu_indices(size, 1)
            i, j = shapes[size]
            some.append((i + a, j + a))
            total += len(i)
            if total >= PAIRS:
                flush()
    flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _starts(rows: pa.Table) -> np.ndarray:
    changed = np.zeros(rows.num_rows, bool)
    changed[0] = True
    for k in KEYS:
        x = rows.column(k).combine_chunks()
        x = x.dictionary_encode().indices.to_numpy() if k == "half" else x.to_numpy()
        changed[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(changed)


def _whole(batches):
    """Tables of whole runs of rows with equal KEYS, sorted by them; a run has 2 * BLOCK rows or so."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        both = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        last = int(_starts(both)[-1])
        if last:
            yield both.slice(0, last)
        held = both.slice(last)
    if held is not None:
        yield held


def _near_batches(batches):
    for rows in _whole(batches):
        words = rows.column("word").to_pylist()
        count, m, side, block, bi, bj = (rows.column(c).to_numpy() for c in ("n", "m", "side", "block", "bi", "bj"))
        i, j = near_in_runs(words, m.astype(np.int64), side, block, bi != bj, [*_starts(rows).tolist(), len(words)])
        if not len(i):
            continue
        src, dst = np.concatenate((i, j)), np.concatenate((j, i))
        # Of each word, the near word of largest n, then the smallest: Latin-1 bytes are in code-point order.
        place = np.argsort(np.array([w.encode("latin-1") for w in words]), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[place] = np.arange(len(words))
        order = np.lexsort((rank[dst], -count[dst], src))
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1])))
        many = np.diff(np.concatenate((first, [len(src)])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[k] for k in src[first]]), pa.array(many, pa.int64()), pa.array(count[dst[first]], pa.int64()), pa.array([words[k] for k in dst[first]])],
            names=["word", "near", "best_n", "best"],
        )


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n) -> (word, n_near, best, best_n) of the words that have a near one."""
    tiles = _tiles(words)
    found = tiles.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(frugal(_near_batches), "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.k")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, by pointer jumping; the paths have no circles."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not moved.where("moved").limit(1).count():
            return at
        at = moved.drop("moved")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """docs -> (word, n, n_near, form, form_n, root), a row for each word."""
    words = materialize(vocabulary(docs, id_col, text_col), "spelling-words", "zstd")
    near = materialize(near_words(words), "spelling-near", "zstd")
    full = words.join(near, "word", "left").withColumn("takes", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
    full = full.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), F.col("best")).alias("form"), F.when(F.col("takes"), F.col("best_n")).alias("form_n"))
    full = materialize(full, "spelling-forms", "zstd")
    found = roots(full.where("form is not null"))
    return full.join(found, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: The 64 letters beyond ASCII, and one ASCII character for each that no word holds: levenshtein() counts bytes.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_NARROW = "".join(map(chr, range(0x20, 0x60))).replace("'", "''")

OP13_SQL = f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) t FROM (SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda z: 0::BIGINT), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) v FROM range(256) r(i))),
r AS (SELECT coalesce(doc_id::VARCHAR, 'null') id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) w FROM documents),
g AS (SELECT id, w, count(*)::BIGINT n FROM r WHERE length(w) >= {LEAST} GROUP BY 1, 2),
b AS (SELECT *, list_transform(string_split(hex(encode(id || ':' || w)), ''), lambda c: (instr('0123456789ABCDEF', c) - 1)::BIGINT) x FROM g),
h AS (SELECT w, n, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(0, len(x), 2), lambda k: x[k + 1] * 16 + x[k + 2]), lambda c, y: xor(t[1 + (xor(c, y) & 255)], c >> 8))) h FROM b, tab),
s AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END w, n FROM h),
v AS (SELECT w, sum(n)::BIGINT n, translate(w, '{_WIDE}', '{_NARROW}') c, length(w) l FROM s WHERE length(w) >= {LEAST} GROUP BY 1 HAVING sum(n) >= 2),
k AS (SELECT w, n, c, l, unnest([{{'m': l, 's': 0}}, {{'m': l + 1, 's': 0}}, {{'m': l, 's': 1}}, {{'m': l + 1, 's': 1}}], recursive := true) FROM v),
q AS (SELECT *, CASE WHEN s = 0 THEN c[:m // 2] ELSE c[l - m // 2 + 1:] END half FROM k),
p AS (SELECT DISTINCT a.w, a.n, b.w o, b.n o_n FROM q a JOIN q b USING (m, s, half) WHERE a.w <> b.w AND greatest(a.l, b.l) = m AND levenshtein(a.c, b.c) = 1),
f AS (SELECT w, count(*)::BIGINT n_near, arg_min(o, (-o_n, o)) form, max(o_n) form_n FROM p GROUP BY 1),
e AS (SELECT v.w word, v.n, coalesce(n_near, 0)::BIGINT n_near, CASE WHEN form_n >= {RATIO} * v.n THEN form END form, CASE WHEN form_n >= {RATIO} * v.n THEN form_n END form_n FROM v LEFT JOIN f USING (w)),
z AS (SELECT word, word root, 0 d FROM e UNION ALL SELECT z.word, e.form, d + 1 FROM z JOIN e ON e.word = z.root WHERE e.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM e JOIN (SELECT word, arg_max(root, d) root FROM z GROUP BY 1) USING (word)
"""
