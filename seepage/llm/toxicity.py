"""Toxicity scores after noisy-channel deobfuscation.

Words that hide behind leetspeak, separators, spacing or repeated letters become a
character lattice; Viterbi decoding under a character language model picks the
likeliest plain reading (channel cost plus language model cost). The restored words
are then weighed by a lexicon of words and word beginnings learned from labels, and a logistic curve over the
sum of a text's distinct words gives the score. Training and scoring read words alike.
The character model counts words of letters alone; those of more than four letters only if seen
three times, since rarer ones are often misspelt or hidden themselves.

Learning reads all labelled rows whose crc32(id as text) mod 5 is not 0. Equal training texts count once a label; of toxic ones that are near copies (the
components of minhash.groups) one counts. Toxic texts are decoded for their features first; a feature that could not get
a weight since clean texts hold it too often as a plain word is let go, and the rest are counted over all training texts. Labels that are null are
skipped; of several labels for an id the largest holds. Null and empty texts have no
words and get the prior. Texts of any length are read whole. Null and repeated
ids pass through scoring. With no usable labels, every score is the prior 0.05. Extra columns
are dropped by score() and kept by reject().
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm import minhash
from seepage.llm.common import decided, fold, frugal, materialize, slices, table

#: Lengths of the word beginnings that are features, beside whole words.
STEMS = (4, 5, 6, 7, 8)
PRIOR = 0.05
#: Tokens whose reading a task keeps between slices of text.
MEMO_TOKENS = 400_000
#: Least weight of a feature of the lexicon: the log of how much likelier the label makes it.
LEAST_WEIGHT = 2.5
#: Least toxic texts that hold a feature, and how many times its share of toxic texts has to exceed that of all.
LEAST_TOXIC, LEAST_RATIO = 3, 4
#: Parts of a unit of evidence that the logistic curve tells apart.
CELLS = 1_000

#: What a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "#": "h",
}
EDGES = ".,!?%$#&*|:;\"'()[]{}<>~_-+=/\\“”‘’«»…`^"
BREAKS = set(" .-_*~,'`/\\:;^#&%=?\"")
#: EDGES that stand for no letter.
SOLID = "".join(x for x in EDGES if x not in LEET)
APART = "".join(BREAKS - {" "})
BETWEEN = re.compile("[" + re.escape("".join(sorted(BREAKS))) + "]+")
DOUBLED = re.compile(r"(.)\1+")


def trigrams(word: str) -> list[str]:
    w = f"^^{word}$"
    return [w[i - 2 : i + 1] for i in range(2, len(w))]


@dataclass
class CharModel:
    """Interpolated character trigrams over words, with ^ before and $ after each."""

    three: dict[str, int] = field(default_factory=dict)
    two: dict[str, int] = field(default_factory=dict)
    one: dict[str, int] = field(default_factory=dict)
    total: int = 1
    costs: dict[tuple[str, str], float] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: list[tuple[str, int]]) -> CharModel:
        """From (word, count)."""
        return cls.of_trigrams([(t, n) for word, n in counts for t in trigrams(word)])

    @classmethod
    def of_trigrams(cls, counts: list[tuple[str, int]]) -> CharModel:
        m = cls({}, {}, {}, 0)
        for t, n in counts:
            m.three[t] = m.three.get(t, 0) + n
            m.two[t[:2]] = m.two.get(t[:2], 0) + n
            m.one[t[2]] = m.one.get(t[2], 0) + n
            m.total += n
        m.total = max(m.total, 1)
        return m

    def cost(self, history: str, c: str) -> float:
        found = self.costs.get((history, c))
        if found is None:
            h3, h2 = self.two.get(history, 0), self.one.get(history[1], 0)
            p3 = self.three.get(history + c, 0) / h3 if h3 else 0.0
            p2 = self.two.get(history[1] + c, 0) / h2 if h2 else 0.0
            if len(self.costs) > 100_000:
                self.costs.clear()
            found = self.costs[history, c] = -math.log(0.75 * p3 + 0.2 * p2 + 0.0499 * self.one.get(c, 0) / self.total + 1e-6)
        return found


def channel(c: str, n: int, symbols: bool = False) -> list[tuple[float, str]]:
    """What a run of n equal characters may stand for: (cost, letters). symbols: those that may be letters are."""
    if c.isalpha():
        return [(0.0 if n == 1 else 1.5, c)] + ([(0.2 if n == 2 else 1.5, c * 2)] if n > 1 else [])
    ways = [(1.0 + (n > 1), x) for x in LEET.get(c, "")] + [(2.5, x * 2) for x in LEET.get(c, "") if n > 1]
    if symbols and ways:
        return ways
    if c in BREAKS or not c.isalnum():
        return ways + [(0.7, ""), (1.0, " ")]
    return ways + [(4.0 * n, c * n)]


def decode(seen: str, model: CharModel, symbols: bool = False) -> str:
    """The likeliest plain reading of an obfuscated span; spaces part its words. symbols: see channel(); the likeliest reading of a span without a letter is often nothing.

    Viterbi over the last two letters, with no state left out: a trigram model needs no more of the past. Readings are chains of pieces, so that long spans take time and memory in proportion."""
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for m in re.finditer(r"(.)\1*", seen, re.S):
        ways = channel(m[0][0], len(m[0]), symbols)
        after: dict[str, tuple[float, tuple | None]] = {}
        for history, (cost, chain) in states.items():
            for price, emit in ways:
                h, total = history, cost + price
                if emit == " ":
                    if h == "^^":
                        continue
                    total, h = total + model.cost(h, "$"), "^^"
                else:
                    for x in emit:
                        total += model.cost(h, x)
                        h = h[1] + x
                if h not in after or total < after[h][0]:
                    after[h] = (total, (chain, emit) if emit else chain)
        states = after or states
    ended = lambda h: states[h][0] + (model.cost(h, "$") if h != "^^" else 0.0)
    chain = states[min(states, key=lambda h: (ended(h), h))][1]
    pieces = []
    while chain:
        chain, emit = chain
        pieces.append(emit)
    return "".join(reversed(pieces))


def single(token: str) -> bool:
    """Whether a token is one letter, digit or what may stand for one, maybe between separators."""
    core = token.strip(APART)
    if not core:
        return any(x in LEET for x in token)
    return len(core) == 1 and (core.isalnum() or core in LEET)


def spaced_runs(tokens: list[str], kinds: set[str] | None = None) -> list[str]:
    """Runs of three or more single characters with nothing but separators between them, joined by one space. kinds: the tokens that are single(), where known."""
    if kinds is None:
        kinds = {t for t in set(tokens) if single(t)}
    at = [i for i, t in enumerate(tokens) if t in kinds]
    runs, start = [], 0
    for k in range(1, len(at) + 1):
        if k < len(at) and not any(tokens[i].strip(APART) for i in range(at[k - 1] + 1, at[k])):
            continue
        if k - start > 2:
            runs.append(" ".join(tokens[at[start] : at[k - 1] + 1]))
        start = k
    return runs


def features(word: str) -> list[str]:
    """The whole word, marked by a final $, and its beginnings."""
    return [f"{word}$", *(word[:n] for n in STEMS if len(word) >= n)]


class Restorer:
    """Restored words of a token. A plain word costs one look-up; any other token with a letter, or with what may stand for one, is decoded."""

    def __init__(self, model: CharModel):
        self.model, self.memo, self.readings = model, {}, {}

    def token(self, token: str) -> list[str]:
        if token.isalpha() and not DOUBLED.search(token):
            return [token]
        core = token.strip(SOLID)
        bare = core.strip(EDGES)
        if not any(x.isalpha() or x in LEET for x in core):
            return []
        if bare.isalpha():
            known = [bare]
            if core == bare and not DOUBLED.search(bare):
                return known
        else:
            known = [x for x in re.split(r"[\W_]+", bare) if x.isalpha()]
        return list(dict.fromkeys([*known, *self.decoded(core)]))

    def decoded(self, core: str) -> list[str]:
        """Readings of a token within its solid edges, which tokens share."""
        found = self.readings.get(core)
        if found is None:
            if len(self.readings) > MEMO_TOKENS:
                self.readings.clear()
            found = decode(core, self.model).split()
            if not any(map(str.isalpha, core)):
                found += decode(core, self.model, symbols=True).split()
            self.readings[core] = found
        return found

    def remembered(self, token: str) -> list[str]:
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) > MEMO_TOKENS:
                self.memo.clear()
            found = self.memo[token] = self.token(token)
        return found

    def spaced(self, tokens: list[str]) -> list[str]:
        """Readings of runs of single characters, whatever white space or separators part them: with word breaks as the model likes them, and as one word."""
        return [w for r in spaced_runs(tokens) for w in self.run(r)]

    def run(self, run: str) -> list[str]:
        return [w for x in (run, BETWEEN.sub("", run)) for w in decode(x, self.model).split()]


def restore(text: str | None, restorer: Restorer) -> list[str]:
    """Distinct restored lower-case words of a text."""
    tokens = (text or "").lower().split()
    words = {w for t in set(tokens) for w in restorer.remembered(t)}
    return sorted(words.union(restorer.spaced(tokens)))


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    prior: float
    chars: CharModel
    intercept: float = math.log(PRIOR / (1 - PRIOR))
    slope: float = 0.0


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, toxic, text) of all rows that labels may be learned from."""
    learned = fold(id_col, 5) != 0
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & learned)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(learned).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return texts.join(known.hint("merge"), "id").select("id", "toxic", "text")  # labels may be too many to broadcast


def _distinct(rows: DataFrame) -> DataFrame:
    """(id, toxic, text) -> (toxic, text): of texts that are equal or verified as near, that of the smallest id for each label."""
    found = minhash.groups(rows, "id").select("key", "root").distinct()
    keyed = rows.withColumn("key", minhash.text_key()).join(found, "key")
    return keyed.groupBy("root", "toxic").agg(F.min_by("text", F.struct("id", "key")).alias("text")).select("toxic", "text")


def _training(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, toxic, text) -> (toxic, text) of toxic and of clean rows, without toxic near copies and clean copies."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "toxic-rows", "zstd")
    toxic = materialize(_distinct(rows.where("toxic <> 0").select("id", "toxic", "text")), "toxic-train", "zstd")
    clean = rows.where("toxic = 0")
    keys = clean.select("row", minhash.text_key().alias("key"))
    repeated = keys.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(keys.join(repeated, "key").where("row <> first").select("row"), "toxic-copies")
    return toxic, clean.join(copies, "row", "left_anti").select("toxic", "text")


def _counted(items):
    """A task's (feature, nt, nc): in how many toxic and clean rows a feature occurs. items() gives a function from a batch to the features of each row, once a task."""

    def run(batches):
        counts: dict[str, list[int]] = {}
        of = items()

        def flush():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[k][1] for k in keys], pa.int64()), pa.array([counts[k][0] for k in keys], pa.int64())], names=["feature", "nt", "nc"])
            counts.clear()
            return out

        for batch in batches:
            for toxic, found in zip(batch.column("toxic").to_pylist(), of(batch)):
                for f in found:
                    counts.setdefault(f, [0, 0])[1 if toxic else 0] += 1
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    return run


def _plain_words():
    return lambda batch: ({w for w in (t.strip(EDGES) for t in set(text.lower().split())) if w.isalpha()} for text in batch.column("text").to_pylist())


def _restored_features(chars: CharModel):
    def items():
        restorer = Restorer(chars)
        return lambda batch: ({f for w in restore(text, restorer) for f in features(w)} for text in batch.column("text").to_pylist())

    return items


def _kept_features(kept: set[str]):
    return lambda: lambda batch: ({f for w in words for f in features(w) if f in kept} for words in batch.column("words").to_pylist())


def _counts(rows: DataFrame, items) -> DataFrame:
    counts = rows.mapInArrow(frugal(_counted(items)), "feature string, nt long, nc long")
    return counts.groupBy("feature").agg(F.sum("nt").alias("nt"), F.sum("nc").alias("nc"))


def _beginnings(words: DataFrame) -> DataFrame:
    """(feature, nt, nc) of plain words -> (feature, least): clean texts that hold a feature, at least."""
    w = F.col("feature")
    found = F.array(F.concat(w, F.lit("$")), *(F.when(F.length(w) >= n, F.substring(w, 1, n)) for n in STEMS))
    found = words.where("nc > 0").select("nc", F.explode(found).alias("feature")).where("feature is not null")
    return found.groupBy("feature").agg(F.max("nc").alias("least"))


def _tail(k: int, n: int, p: float) -> float:
    """log of P(at least k of n) under chance p."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, min(n, k + 60) + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    toxic, clean = _training(_labelled(docs, labels, id_col, text_col))
    rows = toxic.unionByName(clean)
    nt, n = rows.agg(F.coalesce(F.sum((F.col("toxic") != 0).cast("int")), F.lit(0)), F.count("*")).first()
    plain = materialize(_counts(rows, _plain_words), "toxic-words", "zstd")
    words = plain.select(F.concat(F.lit("^^"), "feature", F.lit("$")).alias("w"), (F.col("nt") + F.col("nc")).alias("n")).where("n >= 3 or length(w) <= 7")
    three = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("t"))
    # As many rows as the training texts have letter trigrams, which the alphabets bound.
    chars = CharModel.of_trigrams([(r.t, r.n) for r in three.groupBy("t").agg(F.sum("n").alias("n")).orderBy("t").collect()])
    if not nt or nt == n:
        return ToxicityModel({}, PRIOR, chars)
    share = nt / n
    possible = _counts(toxic, _restored_features(chars)).where(F.col("nt") >= LEAST_TOXIC).join(_beginnings(plain), "feature", "left")
    possible = possible.select("feature", "nt", F.coalesce("least", F.lit(0)).alias("least")).where(F.col("nt") > LEAST_RATIO * share * (F.col("nt") + F.col("least")))
    possible = materialize(possible, "toxic-features", "zstd")
    level = math.log(0.05 / max(possible.count(), 1))

    def weight(a: int, b: int) -> float | None:
        """Of a feature of a toxic and b clean texts; None if it does not tell enough, which no larger b would change."""
        w = math.log((a + 0.5) / (nt + 1)) - math.log((b + 0.5) / (n - nt + 1))
        return round(w, 6) if a > LEAST_RATIO * share * (a + b) and w > LEAST_WEIGHT and _tail(a, a + b, share) < level else None

    # Exact: plain words are among the restored ones, so that no feature let go here would pass once all texts are counted.
    telling = F.udf(lambda a, b: weight(a, b) is not None, "boolean")
    kept = {r.feature for r in possible.where(telling("nt", "least")).select("feature").toLocalIterator()}
    read = materialize(rows.mapInArrow(frugal(_word_batches(kept, chars)), "toxic int, words array<string>"), "toxic-read")
    found = ((r.feature, weight(r.nt, r.nc)) for r in _counts(read, _kept_features(kept)).toLocalIterator())
    weights = {f: w for f, w in found if w is not None}
    model = ToxicityModel(weights, share, chars)
    if weights:
        # All training rows, by label and evidence: a row for each CELLS-th of its range, with the mean inside it.
        seen = read.mapInArrow(_evidence_batches(weights), "toxic int, x long").groupBy("toxic", F.floor(F.col("x") * CELLS / 1_000_000).alias("cell"))
        seen = seen.agg(F.count("*").alias("n"), F.sum("x").alias("x")).orderBy("cell", "toxic").toArrow()
        rows_in = seen.column("n").to_numpy().astype(float)
        model.intercept, model.slope = _logistic(seen.column("x").to_numpy() / 1e6 / rows_in, (seen.column("toxic").to_numpy() != 0).astype(float), rows_in)
    return model


def _word_batches(kept: set[str], chars: CharModel):
    """The restored words of each text that have a feature of kept."""

    def run(batches):
        of = weighed(dict.fromkeys(kept, 1.0), chars)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([sorted(found) for found in of(batch.column("text").to_pylist())], pa.list_(pa.string()))], names=["toxic", "words"])

    return run


def _evidence_batches(weights: dict[str, float]):
    """The evidence of restored words, in millionths."""

    def run(batches):
        for batch in batches:
            x = [round(1e6 * math.fsum(heaviest(words, weights).values())) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.int64())], names=["toxic", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and non-negative slope of a logistic curve, by damped Newton steps; n: how many rows each stands for."""
    a, b = -2.0, 0.5
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(n * (p - y)).sum() + ridge * a, (n * (p - y) * x).sum() + ridge * b])
        v = n * p * (1 - p)
        h = np.array([[v.sum() + ridge, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + ridge]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-9))
        a, b = a - move[0], max(b - move[1], 0.0)
    return float(a), float(b)


def heaviest(words: list[str], weights: dict[str, float]) -> dict[str, float]:
    """The words that have a weight; a word counts by its heaviest feature."""
    found = {w: max((weights[f] for f in features(w) if f in weights), default=0.0) for w in words}
    return {w: x for w, x in found.items() if x}


def weighed(weights: dict[str, float], chars: CharModel):
    """A function from texts to the distinct restored words of each that have a weight."""
    restorer = Restorer(chars)
    memo: dict[str, dict] = {}
    hot: set[str] = set()
    kinds: set[str] = set()
    # A word's features begin as it does: one with another beginning than any feature has no weight.
    heads = {f.removesuffix("$")[: STEMS[0]] for f in weights}

    begun = {DOUBLED.sub(r"\1", h) for h in heads}

    def may(core: str) -> bool:
        """Readings of letters alone differ in doubled letters only: without them, they begin as the letters do."""
        if not core.isalpha():
            return True
        bare = DOUBLED.sub(r"\1", core)
        return any(bare[:n] in begun for n in range(1, STEMS[0] + 1))

    def of(words: list[str]) -> dict[str, float]:
        return heaviest([w for w in words if w[: STEMS[0]] in heads], weights)

    def run(texts: list) -> list[dict[str, float]]:
        out = []
        for start, end in slices(texts):
            tokens = [(t or "").lower().split() for t in texts[start:end]]
            if len(memo) > MEMO_TOKENS:
                memo.clear()
                hot.clear()
                kinds.clear()
            for t in set().union(*tokens).difference(memo):
                memo[t] = (may(t.strip(SOLID)) and of(restorer.token(t))) or _NOTHING
                if memo[t]:
                    hot.add(t)
                if single(t):
                    kinds.add(t)
            for ts in tokens:
                found = of([w for r in spaced_runs(ts, kinds) for w in restorer.run(r)])
                for t in hot.intersection(ts):
                    found.update(memo[t])
                out.append(found)
        return out

    return run


def evidence(model: ToxicityModel):
    """A function from texts to the sum of their distinct words' weights."""
    of = weighed(model.weights, model.chars)
    return lambda texts: [math.fsum(found.values()) for found in of(texts)]


_NOTHING: dict[str, float] = {}


def scorer(model: ToxicityModel):
    """A function from texts to scores."""
    of = evidence(model)
    return lambda texts: [1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + model.slope * x)))) for x in of(texts)]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id_col, score): 0 to 1, higher where the label is likelier."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        of = scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(batch.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def reject(docs: DataFrame, model: ToxicityModel, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below at."""

    def judge():
        of = scorer(model)
        return lambda texts: [s < at for s in of(texts)]

    return decided(docs, text_col, judge)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
