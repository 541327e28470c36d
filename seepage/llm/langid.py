"""Language identification by interpolated Kneser-Ney character models.

Each language gets a character model of order ORDER over letter words (contexts end at
word boundaries). Probabilities lie in sorted hash arrays, one per order, with a column for each
language; a text goes to the language of lowest cross-entropy per character. A temperature
fitted on labelled texts outside the counts turns cross-entropies into a score, and a limit per
language on the cross-entropy rejects texts unlike anything learned.

Learning reads at most PER_LANGUAGE whole labelled texts a language, chosen by a hash of the id;
null languages and null texts are not read. Texts that are null or have no letter get 'und',
score 0 and are rejected; so do all texts where nothing could be learned. Ties go to the
language first in order. Null and repeated ids pass through. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import fold, materialize, slices, table

ORDER = 4
#: Most labelled texts read for each language.
PER_LANGUAGE = 2_000
#: Distinct words kept scored in a task between slices of text.
MEMO_WORDS = 150_000
UNKNOWN = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the order characters up to each position; codes starts with ORDER - 1 pads."""
    h = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for back in range(order - 1, -1, -1):
            c = np.concatenate((np.zeros(back, np.uint64), codes[: len(codes) - back])) if back else codes
            h = (h ^ c) * MULTIPLIER
            h ^= h >> np.uint64(29)
    return h


def hash_of(gram: str) -> int:
    return int(_hashes(np.array([ord(c) for c in gram], dtype=np.uint64), len(gram))[-1])


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)  # by order from 1: sorted hashes
    probs: list[np.ndarray] = field(default_factory=list)  # discounted probabilities, a column a language
    contexts: list[np.ndarray] = field(default_factory=list)  # by order from 2: sorted hashes of histories
    weights: list[np.ndarray] = field(default_factory=list)  # mass left for the shorter history
    floor: float = 1e-4
    temperature: float = 20.0
    limits: list[float] = field(default_factory=list)

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(-log probability of each letter word in each language, its characters counting its end)."""
        padded = ["^" * (ORDER - 1) + w + "$" for w in words]
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
        ends = np.cumsum(lengths)
        own = np.ones(len(codes), bool)
        for pad in range(ORDER - 1):
            own[ends - lengths + pad] = False
        top = _hashes(codes, ORDER)
        at = np.flatnonzero(own)
        unique, where, back = np.unique(top[at], return_index=True, return_inverse=True)
        at = at[where]
        p = np.full((len(at), len(self.languages)), self.floor)
        for n in range(1, ORDER + 1):
            if n > 1:
                context = _hashes(codes[:-1], n - 1)[at - 1]
                i, hit = _find(self.contexts[n - 2], context)
                p *= np.where(hit[:, None], self.weights[n - 2][i], 1.0)
            else:
                p *= 1 - self.probs[0].sum(axis=0)
            i, hit = _find(self.grams[n - 1], _hashes(codes, n)[at])
            p += np.where(hit[:, None], self.probs[n - 1][i], 0.0)
        cost = -np.log(np.maximum(p, 1e-12))[back]
        first = np.cumsum(lengths - ORDER + 1) - (lengths - ORDER + 1)
        return np.add.reduceat(cost, first, axis=0), lengths - ORDER + 1


def _find(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return i, table_[i] == keys


def estimate(counts: dict[str, dict[str, int]]) -> Model:
    """Kneser-Ney from counts of ORDER-grams by language: lower orders count distinct left neighbours."""
    model = Model(sorted(counts))
    columns = len(model.languages)
    found: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER)]
    left: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER)]
    for k, language in enumerate(model.languages):
        level = counts[language]
        for n in range(ORDER, 0, -1):
            ones = sum(1 for c in level.values() if c == 1)
            twos = sum(1 for c in level.values() if c == 2)
            d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
            total: Counter = Counter()
            kinds: Counter = Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            for g, c in level.items():
                found[n - 1].setdefault(g, np.zeros(columns))[k] = (c - d) / total[g[:-1]]
            for h in total:
                row = left[n - 1].setdefault(h, np.ones(columns))
                row[k] = d * kinds[h] / total[h]
            level = Counter(g[1:] for g in level)
    alphabet = max(2, len(found[0]))
    model.floor = 1 / (alphabet * 4)
    for n in range(1, ORDER + 1):
        keys = sorted((hash_of(g), g) for g in found[n - 1])
        model.grams.append(np.array([h for h, _ in keys], dtype=np.uint64))
        model.probs.append(np.array([found[n - 1][g] for _, g in keys]).reshape(-1, columns))
        if n > 1:
            keys = sorted((hash_of(g), g) for g in left[n - 1])
            model.contexts.append(np.array([h for h, _ in keys], dtype=np.uint64))
            model.weights.append(np.array([left[n - 1][g] for _, g in keys]).reshape(-1, columns))
    model.limits = [math.inf] * columns
    return model


def _count_grams(batches):
    counts: dict[str, Counter] = {}

    def flush():
        rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
        counts.clear()
        kinds = (pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            own = counts.setdefault(lang, Counter())
            for word, n in Counter(text.lower().split()).items():
                w = letters(word)
                if w:
                    w = "^" * (ORDER - 1) + w + "$"
                    for i in range(ORDER, len(w) + 1):
                        own[w[i - ORDER : i]] += n
        if sum(map(len, counts.values())) > 300_000:
            yield flush()
    yield flush()


def text_costs(model: Model):
    """A function from texts to (cross-entropy per character in each language, characters)."""
    memo: dict[str, int] = {}
    state = {"cost": np.zeros((1, len(model.languages))), "size": np.zeros(1, np.int64)}

    def run(texts: list) -> tuple[np.ndarray, np.ndarray]:
        sums, chars = [], []
        for start, end in slices(texts):
            words = [t.lower().split() if t else [] for t in texts[start:end]]
            if len(memo) > MEMO_WORDS:
                memo.clear()
                state.update(cost=np.zeros((1, len(model.languages))), size=np.zeros(1, np.int64))
            new = list({w for ws in words for w in ws}.difference(memo))
            bare = [letters(w) for w in new]
            kept = [b for b in bare if b]
            at = len(state["size"])
            for w, b in zip(new, bare):
                memo[w] = at if b else 0
                at += bool(b)
            if kept:
                cost, size = model.costs(kept)
                state["cost"] = np.concatenate((state["cost"], cost))
                state["size"] = np.concatenate((state["size"], size))
            for ws in words:
                i = np.fromiter(map(memo.__getitem__, ws), dtype=np.int64, count=len(ws))
                sums.append(state["cost"][i].sum(axis=0))
                chars.append(int(state["size"][i].sum()))
        n = np.array(chars, dtype=np.int64)
        return np.array(sums).reshape(len(n), -1) / np.maximum(n, 1)[:, None], n

    return run


def posterior(entropy: np.ndarray, temperature: float) -> np.ndarray:
    x = np.exp(-temperature * (entropy - entropy.min(axis=1, keepdims=True)))
    return x / x.sum(axis=1, keepdims=True)


def _calibrate(model: Model):
    """Rows (language, best cross-entropy, cross-entropies) of texts that gave no counts."""

    def run(batches):
        of = text_costs(model)
        for batch in batches:
            entropy, n = of(batch.column("text").to_pylist())
            keep = n > 0
            lang = [x for x, k in zip(batch.column("lang").to_pylist(), keep) if k]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(entropy[keep].tolist(), pa.list_(pa.float64()))], names=["lang", "entropy"])

    return run


def fit(docs: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = PER_LANGUAGE) -> Model | None:
    """A model of the languages in lang_col, or None if there is nothing to learn from."""
    known = docs if where is None else docs.where(where)
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    if not sizes:
        return None
    share = F.create_map([F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, limit / n))])
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) / 1_000_000
    sample = materialize(rows.where(draw < share[F.col("lang")]), "langid-train")
    held = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(10)) == 0
    grams = sample.where(~held).mapInArrow(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in grams.toLocalIterator():  # as many as the bounded sample holds
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    if not counts:
        return None
    model = estimate(counts)
    checks = sample.where(held).mapInArrow(_calibrate(model), "lang string, entropy array<double>").collect()
    checks = [(model.languages.index(r["lang"]), r["entropy"]) for r in checks if r["lang"] in counts]
    if checks:
        truth, entropy = np.array([k for k, _ in checks]), np.array([e for _, e in checks])
        fits = {t: np.log(np.maximum(posterior(entropy, t)[np.arange(len(truth)), truth], 1e-9)).mean() for t in (1, 2, 4, 8, 16, 32, 64)}
        model.temperature = float(max(fits, key=lambda t: (fits[t], -t)))
        own = entropy[np.arange(len(truth)), truth]
        model.limits = [float(own[truth == k].mean() + 6 * own[truth == k].std() + 0.3) if (truth == k).sum() >= 20 else math.inf for k in range(len(model.languages))]
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id_col, lang_pred, score, entropy, rejected)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))

    def run(batches):
        of = text_costs(model)
        limits = np.array(model.limits)
        for batch in batches:
            entropy, n = of(batch.column(1).to_pylist())
            best = entropy.argmin(axis=1) if len(n) else np.zeros(0, np.int64)
            at = np.arange(len(n))
            score = np.where(n > 0, posterior(entropy, model.temperature)[at, best], 0.0) if len(n) else np.zeros(0)
            lang = [model.languages[b] if c else UNKNOWN for b, c in zip(best.tolist(), n.tolist())]
            low = entropy[at, best] if len(n) else np.zeros(0)
            columns = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64(), mask=n == 0), pa.array((n == 0) | (low > limits[best]), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score", "entropy", "rejected"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, entropy double, rejected boolean").withColumnRenamed("id", id_col)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold("doc_id", 4) != 2)
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
