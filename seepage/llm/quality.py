"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades and ordered
thresholds (the first free, the rest by positive steps). x holds the mean of hashed token
features (the word and its shape), and indicators of repetition, line reuse and token length.
Expected grade and the probability of at least a cut grade follow from the fitted cumulative links.

Fitting reads all rated rows. They are dealt by a hash of the id to parts of about PART_ROWS; each part is fitted by a
task, and the model is the mean of the parts' weights and thresholds, by their rows (up to PART_ROWS ratings are one part); null
ratings are skipped, and of several ratings for an id the largest holds. The query fits on ratings whose crc32(id as text) mod 5
is not 0 and marks the others as held out, so that its accuracy can be measured. Null and empty texts have no
features. Texts of any length are read whole. With fewer than two grades to learn from, every text gets the
known grade (or null) and tail probability 1. Null and repeated ids pass through. Extra columns are
dropped by grade() and kept by select_good().
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import decided, fold, frugal, materialize, slices, table

#: Ratings that one task fits together.
PART_ROWS = 8_000
BUCKETS = 1 << 14
#: Distinct tokens kept hashed in a task between slices of text.
MEMO_TOKENS = 100_000
SHAPE_SCALE = 8.0

_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-z]+(?<=[A-ZÀ-ÖØ-Þ])|[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
_RUN = re.compile(r"([^\w\s])\1+")


def shape(token: str) -> str:
    return _RUN.sub(r"\1\1", _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", token))))[:12]


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def indicators(tokens: list[str], text: str, repeats: int) -> list[int]:
    """Buckets of the features of the text as a whole."""
    n = len(tokens)
    if not n:
        return []
    size = n.bit_length()
    lines = [x for x in text.split("\n") if x]
    return [
        bucket(f"~unique:{size}:{int(8 * len(set(tokens)) / n)}"),
        bucket(f"~adjacent:{min(int(16 * repeats / n), 8)}"),
        bucket(f"~lines:{min(len(lines), 4)}:{int(8 * len(set(lines)) / max(len(lines), 1))}"),
        bucket(f"~length:{min(int(len(text) / n), 16)}"),
    ]


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def cumulative(self, x: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every k but the last."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - x[:, None], -40, 40)))

    def distribution(self, x: np.ndarray) -> np.ndarray:
        c = np.concatenate((np.zeros((len(x), 1)), self.cumulative(x), np.ones((len(x), 1))), axis=1)
        return np.diff(c, axis=1)


class Featurizer:
    """Token buckets of texts; memo holds (word bucket, shape bucket) columns."""

    def __init__(self):
        self.memo: dict[str, int] = {}
        self.word, self.shape = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, tokens: set[str]) -> None:
        if len(self.memo) > MEMO_TOKENS:
            self.__init__()
        new = list(tokens.difference(self.memo))
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        self.word = np.concatenate((self.word, np.fromiter((bucket(t.lower()) for t in new), np.int32, len(new))))
        self.shape = np.concatenate((self.shape, np.fromiter((bucket("~shape:" + shape(t)) for t in new), np.int32, len(new))))

    def codes(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def _sparse_batches(batches):
    """(part, grade, buckets, values) of each rated text."""
    f = Featurizer()
    for batch in batches:
        out = []
        for grade, text in zip(batch.column("grade").to_pylist(), batch.column("text").to_pylist()):
            tokens = text.split()
            f.add(set(tokens))
            codes = f.codes(tokens)
            x = np.bincount(f.word[codes], minlength=1).astype(float)
            y = np.bincount(f.shape[codes], minlength=1) * SHAPE_SCALE
            whole = np.zeros(BUCKETS)
            whole[: len(x)] += x
            whole[: len(y)] += y
            whole /= max(len(tokens), 1)
            np.add.at(whole, indicators(tokens, text, int((codes[1:] == codes[:-1]).sum())), 1.0)
            at = np.flatnonzero(whole)
            out.append((grade, at.tolist(), whole[at].tolist()))
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("part"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["part", "grade", "at", "x"])


def fit_sparse(rows: np.ndarray, at: np.ndarray, x: np.ndarray, level: np.ndarray, levels: int, steps: int = 150, rate: float = 0.15, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the proportional-odds likelihood, by Adam on sparse rows (row, bucket, value)."""
    n = len(level)
    w, free = np.zeros(BUCKETS), np.zeros(levels - 1)
    share = np.clip(np.cumsum(np.bincount(level, minlength=levels))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    free[0] = start[0]
    free[1:] = np.log(np.maximum(np.diff(start), 1e-3))
    params = np.concatenate((w, free))
    m, v = np.zeros_like(params), np.zeros_like(params)
    ids = np.arange(n)
    for t in range(1, steps + 1):
        w, free = params[:BUCKETS], params[BUCKETS:]
        theta = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
        s = np.bincount(rows, weights=x * w[at], minlength=n)
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        upper = 1 / (1 + np.exp(-np.clip(edge[level + 1] - s, -40, 40)))
        lower = 1 / (1 + np.exp(-np.clip(edge[level] - s, -40, 40)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # d log p / d edge: +du, -dl
        gs = (du - dl) / n  # of the loss by s
        gw = np.bincount(at, weights=x * gs[rows], minlength=BUCKETS) + ridge * w
        ge = np.zeros(levels + 1)
        np.add.at(ge, level + 1, -du / n)
        np.add.at(ge, level, dl / n)
        tail = np.cumsum(ge[1:-1][::-1])[::-1]
        gf = np.concatenate((tail[:1], tail[1:] * np.exp(free[1:])))
        g = np.concatenate((gw, gf))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    free = params[BUCKETS:]
    return params[:BUCKETS], np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))


def _part_fitter(grades: list[int]):
    """The fit of one part: a row for each weight and threshold, times the part's rows."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        # In order of what they hold, so that a part's sums are always the same.
        order = sorted(range(len(g)), key=lambda i: (g["grade"].iat[i], g["at"].iat[i].tobytes(), g["x"].iat[i].tobytes()))
        g = g.iloc[order]
        at, x = np.concatenate(g["at"].tolist()).astype(np.int64), np.concatenate(g["x"].tolist()).astype(float)
        rows = np.repeat(np.arange(len(g)), g["at"].map(len).to_numpy())
        level = np.searchsorted(np.array(grades), g["grade"].to_numpy())
        params = np.concatenate(fit_sparse(rows, at, x, level, len(grades)))
        return pd.DataFrame({"place": np.arange(len(params)), "value": params * len(g), "n": len(g)})

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", part_rows: int = PART_ROWS) -> OrdinalModel | None:
    known = labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(grade_col).cast("int").alias("grade"))
    n_parts = max(1, -(-known.count() // part_rows))
    known = known.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(n_parts)).cast("int"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rated = texts.join(known.hint("merge"), "id").select("part", "grade", "text")  # ratings may be too many to broadcast
    rated = materialize(rated.mapInArrow(frugal(_sparse_batches), "part int, grade int, at array<int>, x array<float>"), "quality-rated", "zstd")
    grades = sorted(r.grade for r in rated.select("grade").distinct().collect())
    if not grades:
        return None
    if len(grades) < 2:
        return OrdinalModel(grades, np.zeros(BUCKETS), np.zeros(0))
    fitted = rated.groupBy("part").applyInPandas(_part_fitter(grades), "place int, value double, n long")
    # As many rows as the model has weights and thresholds.
    mean = fitted.groupBy("place").agg((F.sum("value") / F.sum("n")).alias("value")).orderBy("place").toArrow().column("value").to_numpy()
    return OrdinalModel(grades, mean[:BUCKETS], mean[BUCKETS:])


def latent(model: OrdinalModel):
    """A function from texts to w.x."""
    f = Featurizer()
    w = model.weights

    def run(texts: list) -> np.ndarray:
        out = []
        for start, end in slices(texts):
            parts = [t or "" for t in texts[start:end]]
            tokens = [p.split() for p in parts]
            f.add({t for ts in tokens for t in ts})
            of = w[f.word] + SHAPE_SCALE * w[f.shape]
            for p, ts in zip(parts, tokens):
                codes = f.codes(ts)
                whole = indicators(ts, p, int((codes[1:] == codes[:-1]).sum()))
                out.append(of[codes].sum() / max(len(ts), 1) + w[whole].sum())
        return np.array(out, dtype=float)

    return run


def _graded(model: OrdinalModel | None, cut: int | None):
    """A function from texts to (expected grade, P(grade >= cut)); cut: the highest grade if None."""
    if model is None or len(model.grades) < 2:
        only = float(model.grades[0]) if model else None
        return lambda texts: ([only] * len(texts), [1.0] * len(texts))
    of, grades = latent(model), np.array(model.grades, dtype=float)
    least = grades[-1] if cut is None else cut

    def run(texts):
        p = model.distribution(of(texts))
        return (p @ grades).tolist(), p[:, grades >= least].sum(axis=1).tolist()

    return run


def grade(docs: DataFrame, model: OrdinalModel | None, cut: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id_col, expected_grade, p_tail)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        of = _graded(model, cut)
        for batch in batches:
            expected, tail = of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=["id", "expected_grade", "p_tail"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), f"id {kind}, expected_grade double, p_tail double").withColumnRenamed("id", id_col)


def select_good(docs: DataFrame, model: OrdinalModel | None, cut: int | None = None, at: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose tail probability is at least at."""

    def judge():
        of = _graded(model, cut)
        return lambda texts: [p >= at for p in of(texts)[1]]

    return decided(docs, text_col, judge)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return grade(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "expected_grade", "p_tail", (F.col("p_tail") >= 0.5).cast("int").alias("selected"))
