"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a run of texts form a small corpus. Each word is laid out as
a chain of byte symbols in flat arrays. An inverted index maps a pair of token ids to
the positions where the pair starts; merges are taken from it in rank order,
each merge rewrites only the positions listed for its pair and the two
neighbours of each, and new pairs enter the index as they appear. The encoded words
then stand for every occurrence in the texts.

round_trip() encodes, decodes and digests in one pass, so that a task runs one Python worker and the ids and bytes need not
travel back. Nulls encode as the empty text; empty texts give no ids. Texts of any length are
encoded whole. Rows that repeat are encoded alike. Ids are not unique keys here: no
join is made, so null or repeated ids pass through. Extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import frugal, runs, table

#: Pieces of text kept encoded in a task between batches, and bytes of their text; the memo is emptied when either is full.
MEMO_PIECES = 100_000
MEMO_BYTES = 4_000_000
#: Texts are encoded in runs of about this many bytes.
RUN_BYTES = 2_000_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file (base64 token, rank a line). The vocabulary is a parameter of bounded size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_one(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Lowest-ranked, leftmost pair first; for the rare words whose merges are not in rank order."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class MergeReplay:
    """Encodes sets of distinct words against one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[tuple[int, int], int] = {}

    def merged(self, a: int, b: int) -> int:
        """Rank of the pair, which is also the id of the merged token; -1 if it never merges."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return found

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in order)."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        rest = [i for i in np.flatnonzero(whole < 0).tolist() if words[i]]
        counts = (whole >= 0).astype(np.int64)
        if not rest:
            return counts, whole[whole >= 0].astype(np.int32)
        n, ids = self._replay([words[i] for i in rest])
        counts[rest] = n
        flat = np.empty(int(counts.sum()), np.int32)
        first = np.cumsum(counts) - counts
        flat[first[whole >= 0]] = whole[whole >= 0]
        flat[np.repeat(first[rest] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return counts, flat

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        owner = np.repeat(np.arange(len(words)), lengths)
        symbol = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        nxt = np.arange(1, total + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, total - 1)
        prv[ends - lengths] = -1
        index: dict[tuple[int, int], list[np.ndarray]] = {}
        heap: list[tuple[int, int, int]] = []
        unordered: set[int] = set()

        def enter(left: np.ndarray, right: np.ndarray, at: np.ndarray, rank: int) -> None:
            """Put positions of the pairs (left, right) into the index."""
            if not len(at):
                return
            keys = left * (1 << 20) + right
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            bounds = [*cuts.tolist(), len(keys)]
            for i, key in enumerate(keys[cuts].tolist()):
                pair = (key >> 20, key & ((1 << 20) - 1))
                new = self.merged(*pair)
                if new < 0:
                    continue
                where = at[bounds[i] : bounds[i + 1]]
                if new < rank:
                    unordered.update(owner[where].tolist())
                if pair in index:
                    index[pair].append(where)
                else:
                    index[pair] = [where]
                    heapq.heappush(heap, (new, *pair))

        starts = np.flatnonzero(nxt >= 0)
        enter(symbol[starts], symbol[nxt[starts]], starts, -1)
        while heap:
            rank, a, b = heapq.heappop(heap)
            at = index.pop((a, b))
            at = np.unique(np.concatenate(at)) if len(at) > 1 else np.sort(at[0])
            follow = nxt[at]
            ok = (symbol[at] == a) & (follow >= 0)
            at, follow = at[ok], follow[ok]
            ok = symbol[follow] == b
            at, follow = at[ok], follow[ok]
            if a == b and len(at) > 1:  # of a run a a a, the leftmost pairs merge
                keep, last = [], -1
                for p, q in zip(at.tolist(), follow.tolist()):
                    if p != last:
                        keep.append(p)
                        last = q
                at = np.array(keep)
                follow = nxt[at]
            if not len(at):
                continue
            symbol[at] = rank
            symbol[follow] = -1
            after = nxt[follow]
            nxt[at] = after
            inner = after >= 0
            prv[after[inner]] = at[inner]
            before = prv[at]
            has = before >= 0
            enter(symbol[before[has]], symbol[at[has]], before[has], rank)
            has = nxt[at] >= 0
            enter(symbol[at[has]], symbol[nxt[at[has]]], at[has], rank)
        live = symbol >= 0
        counts = np.bincount(owner[live], minlength=len(words))
        ids = symbol[live]
        if unordered:
            first = np.cumsum(counts) - counts
            lists = [encode_one(w, self.ranks) if i in unordered else ids[first[i] : first[i] + counts[i]] for i, w in enumerate(words)]
            counts, ids = np.array([len(x) for x in lists]), np.concatenate(lists).astype(np.int64)
        return counts, ids


def expand(at: np.ndarray, count: np.ndarray, first: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs flat[first[i] : first[i] + count[i]] for each i of at, one after the other."""
    n = count[at]
    return flat[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class _Pieces(dict):
    """Text piece -> number of its slot; 0 is for pieces that can't be split off without their neighbours."""

    def __init__(self, slots: list[str], lead: str):
        self.slots, self.lead = slots, lead

    def __missing__(self, piece: str) -> int:
        if not piece or (self.lead and piece[0].isspace()) or piece[-1].isspace():
            n = 0
        else:
            n = len(self.slots)
            self.slots.append(self.lead + piece)
        self[piece] = n
        return n


def _encoder(pattern: str, ranks: dict[bytes, int]):
    """A function from a text column to runs of (first row, sizes, ids). A text without runs of white space is cut at its spaces:
    there, a space always begins the next match of the pattern, so each distinct piece needs to be matched once only. Other texts are matched whole."""
    import regex

    find = regex.compile(pattern).findall
    replay = MergeReplay(ranks)
    slots: list[str] = []

    def reset():
        slots[:] = [""]
        return _Pieces(slots, ""), _Pieces(slots, " "), {}, np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    start, spaced, matched, size, flat, held = reset()

    def run(column: pa.Array):
        nonlocal start, spaced, matched, size, flat, held
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for begin, end in runs(lengths, RUN_BYTES):
            if len(slots) > MEMO_PIECES or held > MEMO_BYTES:
                start, spaced, matched, size, flat, held = reset()
            done = len(size)
            at: list[np.ndarray] = []
            texts = column.slice(begin, end - begin).to_pylist()
            for t in texts:
                parts = (t or "").split(" ")
                n = np.fromiter(map(spaced.__getitem__, parts), dtype=np.int32, count=len(parts))
                n[0] = start[parts[0]]
                if not n.all():
                    parts = find(t or "")
                    n = np.empty(len(parts), np.int32)
                    for i, w in enumerate(parts):
                        k = matched.get(w)
                        if k is None:
                            k = matched[w] = len(slots)
                            slots.append(w)
                        n[i] = k
                at.append(n)
            del texts
            held += sum(map(len, slots[done:]))
            words: dict[str, int] = {}
            parts = array("i")  # words of the new pieces
            lengths_of = np.zeros(len(slots) - done, np.int64)
            for i, piece in enumerate(slots[done:]):
                found = find(piece)
                lengths_of[i] = len(found)
                parts.extend([words.setdefault(w, len(words)) for w in found])
            counts, word_ids = replay.encode([w.encode() for w in words])
            del words
            parts = np.frombuffer(parts, np.int32) if parts else np.zeros(0, np.int32)
            of_piece = np.concatenate(([0], np.cumsum(counts[parts])))
            ends = np.cumsum(lengths_of)
            size = np.concatenate((size, of_piece[ends] - of_piece[ends - lengths_of]))
            flat = np.concatenate((flat, expand(parts, counts, np.cumsum(counts) - counts, word_ids)))
            first = np.cumsum(size) - size
            values = [expand(n, size, first, flat) for n in at]
            yield begin, [len(v) for v in values], np.concatenate(values) if values else np.zeros(0, np.int32)

    return run


def _lists(sizes: list[int], ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32()), pa.array(ids, pa.int32()))


def _encode_batches(pattern: str, ranks: dict[bytes, int]):
    def run(batches):
        encode = _encoder(pattern, ranks)
        for batch in batches:
            for begin, sizes, ids in encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(sizes)), _lists(sizes, ids)], names=["id", "ids"])

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id_col, ids array<int>): the ids of each whole text, without special tokens."""
    spark = docs.sparkSession
    ranks = read_ranks(spark, vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(frugal(_encode_batches(pattern, ranks)), f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def _decode_batches(tokens: dict[int, bytes]):
    def run(batches):
        get = tokens.__getitem__
        for batch in batches:
            column = batch.column(1)
            flat, offsets = column.values.to_numpy(), column.offsets.to_pylist()
            texts = [b"".join(map(get, flat[a:b].tolist())) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.binary())], names=["id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids) -> (id_col, ids, decoded binary): the bytes that the ids stand for; null ids decode to no bytes."""
    tokens = {v: k for k, v in read_ranks(encoded.sparkSession, vocabulary).items()}
    kind = encoded.schema[id_col].dataType.simpleString()
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    rows = encoded.select(F.col(id_col).alias("id"), ids.alias("ids"))
    out = rows.mapInArrow(frugal(_decode_batches(tokens)), f"id {kind}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def _digest_batches(pattern: str, ranks: dict[bytes, int], keep_ids: bool):
    def run(batches):
        encode = _encoder(pattern, ranks)
        most = max(ranks.values())
        bytes_of: list[bytes] = [b""] * (most + 1)
        for token, i in ranks.items():
            bytes_of[i] = token
        digits = [str(i) for i in range(most + 1)]
        for batch in batches:
            for begin, sizes, ids in encode(batch.column(1)):
                said, decoded, at = [], [], 0
                for n in sizes:
                    own = ids[at : at + n].tolist()
                    at += n
                    said.append(hashlib.sha256(" ".join(map(digits.__getitem__, own)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(bytes_of.__getitem__, own))).hexdigest())
                columns = [batch.column(0).slice(begin, len(sizes)), pa.array(sizes, pa.int64()), pa.array(said), pa.array(decoded), *([_lists(sizes, ids)] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return run


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """docs -> (id_col, n_tokens, ids_sha256, decoded_sha256), with ids if asked for: each text encoded, and decoded from its ids again."""
    ranks = read_ranks(docs.sparkSession, vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(frugal(_digest_batches(pattern, ranks, keep_ids)), schema).withColumnRenamed("id", id_col)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
