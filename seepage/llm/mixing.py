"""Mixing sources to target weights by Pareto order sampling.

Sources, in the order of their names' code points (null last), take the weights in turn and share SHARE times all words by them. A
source's target stops at MOST times its words; what it can't use goes to the others by weight until no target is above that. A
document's expected number of copies is its source's target over its source's words (times its own preference, if there is one;
never above MOST). The whole part of it is taken for certain. The rest is its inclusion probability p in a sample of a size
that is fixed in words: each document draws u from a digest of its id and text and is ranked by its random odds over its
inclusion odds, (u / (1 - u)) / (p / (1 - p)), and a source's documents are taken in that order as long as the words that its target still lacks hold
them all. The document that would not fit is passed over once: the order is followed again from there over those that fit what is
lacking. Last, the one document whose words come nearest to what is still lacking closes the gap, if taking it narrows it.

Nothing is sorted as a whole. Where a source's order is cut is found by sums over ranges of the rank, each time inside the range that
holds the cut, and at last, among rows of equal rank (repeated rows), inside one partition of the staged rows. All of it is
DataFrame functions; a row for each source is all that is joined back.

Null and empty texts have no words and take none. Null sources are one source. Repeated rows, and rows that share an id, are documents
of their own; null ids are known by their text. Equal tables give equal results, whatever their order. An empty table gives an empty one. Extra columns are
dropped. A preference that is null counts 1; one that is not positive keeps a document out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.llm.common import materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a rank, and how many of them tell apart the ranges that are summed first.
BITS = 52
RANGE_BITS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_: Column, text: Column, seed: int) -> Column:
    """A whole number below 2 ** BITS from an id and a text."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), F.lit(str(seed)), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, words) -> (sid, source, source_size, target). Rows are sources; they meet in one window.

    With the sources in order of most * words / weight, those before the first that the level L = (share * all - most * words before) / (weights from
    here on) does not fill are full; the others get L times their weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*(F.lit(float(w)) for w in weights))
    s = sizes.groupBy("source").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("w", F.get(turn, F.pmod(F.col("sid"), F.lit(len(weights)))))
    filled = Window.orderBy(F.col("source_size") / F.col("w"), "sid")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("level", (share * F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after))
    s = s.withColumn("open", F.col("level") * F.col("w") <= most * F.col("source_size"))
    s = s.withColumn("at", F.min(F.when(F.col("open"), F.struct((F.col("source_size") / F.col("w")).alias("r"), "sid", "level"))).over(every))
    s = s.withColumn("target", F.least(F.coalesce(F.col("at.level"), F.lit(0.0)) * F.col("w"), most * F.col("source_size").cast("double")))
    return s.select("sid", "source", "source_size", "target")


def _scaled(rows: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """sources with factor: a document's expected copies are least(most, factor * prefer), whose words sum to the target."""
    state = sources.withColumn("factor", F.lit(0.0))
    full = -1
    while True:  # each round adds to the documents that are full; there is a round for each time that some become so
        joined = rows.join(state, "sid").withColumn("full", F.col("factor") * F.col("prefer") >= most)
        sums = joined.groupBy("sid").agg(F.sum(F.when(F.col("full"), F.col("size"))).alias("held"), F.sum(F.when(~F.col("full"), F.col("size") * F.col("prefer"))).alias("loose"), F.count_if("full").alias("n_full"))
        sums = materialize(sums, "mixing-factors")
        now = sums.agg(F.sum("n_full")).first()[0] or 0
        if now == full:
            return state
        full = now
        factor = F.greatest(F.col("target") - most * F.coalesce(F.col("held"), F.lit(0)), F.lit(0.0)) / F.when(F.col("loose") > 0, F.col("loose"))
        state = materialize(state.drop("factor").join(sums, "sid", "left").select(*sources.columns, F.coalesce(factor, F.lit(0.0)).alias("factor")), "mixing-factors")


def _cut(rows: DataFrame, room: DataFrame) -> DataFrame:
    """(sid, rank_, rid_): the last row of each source that the longest beginning of its order (rank, rid) of at most room words holds.

    rows: (sid, rank, rid, size), room: (sid, room). Sources whose rows all fit get a rank above all."""
    inside = rows.join(room, "sid")
    # Ranges of ranks; inside the range of the cut, the ranks, and of repeated ones the partitions that they were staged in.
    for part in (F.struct(F.shiftright("rank", BITS - RANGE_BITS)), F.struct("rank", F.shiftright("rid", 33))):
        sums = inside.groupBy("sid", part.alias("part")).agg(F.sum("size").alias("words"), F.first("room").alias("room"))
        over = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("sid").orderBy("part"))).where("upto > room")
        over = over.groupBy("sid").agg(F.min(F.struct("part", (F.col("room") - F.col("upto") + F.col("words")).alias("room"))).alias("c"))
        cut = materialize(over.select("sid", F.col("c.part").alias("part_"), F.col("c.room").alias("room")), "mixing-cut")
        inside = rows.withColumn("part", part).join(cut, "sid").where("part = part_").drop("part", "part_")
    # Rows of one rank that were staged in one partition.
    last = inside.withColumn("upto", F.sum("size").over(Window.partitionBy("sid").orderBy("rid")))
    last = last.groupBy("sid").agg(F.max("rank").alias("rank"), F.max(F.when(F.col("upto") <= F.col("room"), F.col("rid"))).alias("rid"))
    bound = room.join(last, "sid", "left").select("sid", F.coalesce("rank", F.lit(1 << BITS)).alias("rank_"), F.coalesce("rid", F.lit(-1)).alias("rid_"))
    return materialize(bound, "mixing-bound")


def _before(rank: str, rid: str) -> Column:
    return (F.col("rank") < F.col(rank)) | ((F.col("rank") == F.col(rank)) & (F.col("rid") <= F.col(rid)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, prefer: Column | None = None, seed: int = 0) -> DataFrame:
    """docs -> (id_col, size, source_size, target, copies, taken), a row for each row: copies in the mix and the words that they take."""
    text = F.col(text_col)
    own = F.lit(1.0) if prefer is None else F.greatest(F.coalesce(prefer.cast("double"), F.lit(1.0)), F.lit(0.0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), draw(F.col(id_col), text, seed).alias("draw"), own.alias("prefer"), F.monotonically_increasing_id().alias("rid"))
    rows = materialize(rows, "mixing-rows")
    sources = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("words")), weights, share, most), "mixing-sources")
    rows = rows.withColumnRenamed("source", "source_").join(sources.select("sid", F.col("source").alias("named")), F.col("source_").eqNullSafe(F.col("named"))).drop("source_", "named")
    if prefer is None:
        state = sources.withColumn("factor", F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0)))
    else:
        state = _scaled(rows, sources, most)
    state = state.select("sid", "source_size", "target", "factor")
    expected = F.least(F.col("factor") * F.col("prefer"), F.lit(float(most)))
    ready = rows.join(state, "sid").withColumn("whole", F.floor(expected)).withColumn("p", expected - F.col("whole"))
    u = (F.col("draw") + F.lit(0.5)) / F.lit(float(1 << BITS))
    odds = u / (1 - u) * ((1 - F.col("p")) / F.when(F.col("p") > 0, F.col("p")))
    ready = ready.withColumn("rank", F.floor(odds / (1 + odds) * F.lit(float(1 << BITS))))
    # Drawn are the documents with words and a probability; the largest rank is kept free.
    drawn = ready.where("p > 0 and size > 0").withColumn("rank", F.least("rank", F.lit((1 << BITS) - 1)))
    certain = ready.groupBy("sid").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("sure"))
    room = materialize(certain.select("sid", F.greatest(F.col("target") - F.col("sure"), F.lit(0.0)).alias("room")), "mixing-room")
    drawn = materialize(drawn.select("sid", "rank", "rid", "size"), "mixing-drawn")
    fits = drawn.join(room.withColumnRenamed("room", "room_1"), "sid").where("size <= room_1").drop("room_1")
    first = _cut(fits.select("sid", "rank", "rid", "size"), room).withColumnsRenamed({"rank_": "rank_1", "rid_": "rid_1"})
    plan = room.withColumnRenamed("room", "room_1").join(first, "sid")

    def lacking(rows: DataFrame, chosen: Column, room: str, name: str) -> DataFrame:
        return rows.groupBy("sid").agg((F.first(room) - F.coalesce(F.sum(F.when(chosen, F.col("size"))), F.lit(0))).alias(name))

    in_first = (F.col("size") <= F.col("room_1")) & _before("rank_1", "rid_1")
    rest = drawn.join(plan, "sid")
    second_room = materialize(lacking(rest, in_first, "room_1", "room"), "mixing-room")
    fits = rest.where(~in_first).join(second_room.withColumnRenamed("room", "room_2"), "sid").where("size <= room_2")
    second = _cut(fits.select("sid", "rank", "rid", "size"), second_room).withColumnsRenamed({"rank_": "rank_2", "rid_": "rid_2"})
    plan = materialize(plan.join(second_room.withColumnRenamed("room", "room_2"), "sid", "left").join(second, "sid", "left"), "mixing-plan")
    in_second = ~in_first & (F.col("size") <= F.col("room_2")) & _before("rank_2", "rid_2")
    chosen = F.coalesce(in_first | in_second, F.lit(False))
    rest = drawn.join(plan, "sid")
    third = lacking(rest, in_second, "room_2", "room_3")
    gap = F.abs(F.col("room_3") - F.col("size"))
    close = rest.where(~chosen).join(third, "sid").where(gap < F.col("room_3")).groupBy("sid").agg(F.min(F.struct(gap.alias("gap"), "rank", "rid")).alias("c"))
    plan = materialize(plan.join(close.select("sid", F.col("c.rid").alias("closing")), "sid", "left"), "mixing-plan")
    out = ready.join(plan, "sid", "left")
    drawn_too = (F.col("p") > 0) & (F.col("size") > 0)
    out = out.withColumn("rank", F.least("rank", F.lit((1 << BITS) - 1))).withColumn("copies", F.col("whole") + F.when(drawn_too & F.coalesce(chosen | (F.col("rid") == F.col("closing")), F.lit(False)), 1).otherwise(0))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op11_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _sql() -> str:
    def prefix(k: int, rows: str) -> str:
        """(sid, room, cut): what is lacking, and the documents of the longest beginning that fits it."""
        return f"f{k} AS (SELECT *, sum(size) OVER (PARTITION BY sid ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) upto FROM {rows} WHERE size <= room), c{k} AS (SELECT * FROM f{k} WHERE upto <= room)"

    return rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) size,
  CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':0:' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) draw FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 sid FROM d GROUP BY 1),
s1 AS (SELECT *, [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][1 + sid % {len(WEIGHTS)}] w FROM s0),
s2 AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER (ORDER BY source_size / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY source_size / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM s1),
s AS (SELECT sid, source, source_size, least((SELECT arg_min(level, (source_size / w, sid)) FROM s2 WHERE level * w <= {MOST} * source_size) * w, {MOST}::DOUBLE * source_size) target FROM s2),
r AS (SELECT d.*, sid, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END lam FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p AS (SELECT *, floor(lam) whole, lam - floor(lam) p, (draw + 0.5::DOUBLE) / {1 << BITS}::DOUBLE u FROM r),
o AS (SELECT *, u / (1 - u) * ((1 - p) / nullif(p, 0)) q FROM p),
k AS (SELECT *, floor(q / (1 + q) * {1 << BITS}::DOUBLE) rank, greatest(target - sum(whole * size) OVER (PARTITION BY sid), 0) room FROM o),
w AS (SELECT doc_id, sid, size, rank, room FROM k WHERE p > 0 AND size > 0),
{prefix(1, "w")},
w2 AS (SELECT w.* EXCLUDE (room), room - coalesce(got, 0) room FROM w LEFT JOIN (SELECT sid, sum(size) got FROM c1 GROUP BY 1) USING (sid) WHERE doc_id NOT IN (SELECT doc_id FROM c1)),
{prefix(2, "w2")},
w3 AS (SELECT w2.* EXCLUDE (room), room - coalesce(got, 0) room FROM w2 LEFT JOIN (SELECT sid, sum(size) got FROM c2 GROUP BY 1) USING (sid) WHERE doc_id NOT IN (SELECT doc_id FROM c2)),
c3 AS (SELECT arg_min(doc_id, (abs(room - size), rank, doc_id)) doc_id FROM w3 WHERE abs(room - size) < room GROUP BY sid)
SELECT doc_id, size, source_size, target, CAST(size * (whole + (doc_id IN (SELECT doc_id FROM c1 UNION ALL SELECT doc_id FROM c2 UNION ALL SELECT doc_id FROM c3))::INT) AS BIGINT) taken FROM k
"""


OP11_SQL = _sql()
