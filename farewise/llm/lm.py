"""LM scoring: context-tree weighting over bytes.

A text is its lower-cased words joined by single spaces, then an end byte.  Each
byte is coded as 8 binary decisions; a decision's node is (context, bits so far).
At every context length 0 to ``depth`` a node's Krichevsky-Trofimov estimate
comes from the training texts, and the estimates of all lengths are mixed by the
weights of the context tree: Pw = (Pe + product of the children's Pw) / 2, and
Pe / 2 Pw is the weight of stopping at a node.  Contexts that training never saw
leave their weight to the longest one it saw.  The bits' log probabilities sum to
the text's code length.

The model is never in one place.  Documents are dealt into blocks of about
``block_bytes``.  A block asks once for each distinct (context, byte) it holds,
with the count of its training texts; questions are dealt by the two most recent
context bytes, so everything below those two lies in one task.  Such a task adds
up the counts, builds its part of the tree, and answers each block in the order
of its questions.  Only the nodes of lengths 0 and 1 (at most 257 x 255) meet on
the driver.  Word counts for the base model go the same way, dealt by a hash of
the word.

Defined cases: a null text counts as empty, and an empty text is the end byte
alone; a null id counts as the empty text for the split (crc32 0: held out);
repeated rows are scored (and learned from) each; without training texts every
bit has probability 1/2; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import give_back, land, parts, pick
from farewise.llm.ranked import runs

DEPTH = 5
TOP = 2  # context bytes that decide which task holds a node
BLOCK_BYTES = 16 << 20
HELD_OUT_OF = 10
TEXT_AT_ONCE = 1 << 20
END = b"\n"

ASK = "kind int, bucket long, block long, items binary, counts binary"
ANSWER = "kind int, block long, items binary, answer binary"
TOPS = "node long, total double, ones double, below double, words long, tokens long"
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double, n_bytes long"
)
GRAM, WORD = 0, 1


# --- texts to grams -------------------------------------------------------

def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams_of(datas: list[bytes], depth: int) -> np.ndarray:
    """One number per byte of the ``datas`` in turn: the ``depth`` bytes before it, most
    recent first, then the byte itself.  Before its first byte a text has end bytes."""
    pad = END * depth
    raw = b"".join([bytes(8), *(x for d in datas for x in (pad, d))])
    buffer = np.frombuffer(raw, dtype=np.uint8)[8:]
    # the 8 bytes before each byte as one number, the most recent one in front
    before = np.ndarray((len(buffer),), "<u8", raw, 0, (1,))
    out = (before >> np.uint64(8 * (8 - depth))) << np.uint64(8)
    out |= buffer
    lengths = np.fromiter(map(len, datas), dtype=np.int64, count=len(datas)) + depth
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    own = np.ones(len(buffer), dtype=bool)
    own[(starts[:, None] + np.arange(depth)[None, :]).ravel()] = False
    return out.view(np.int64)[own]


def some_texts(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows of about ``TEXT_AT_ONCE`` of text and their words, so that a block's words never
    are in memory all at once."""
    for batch in table.to_batches():
        for a, b in runs(batch.column("text"), TEXT_AT_ONCE):
            if b > a:
                rows = batch.slice(a, b - a)
                yield rows, list(map(words_of, rows.column("text").to_pylist()))


def counted(datas: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of the ``datas`` and their counts."""
    if not datas:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    keys = np.sort(grams_of(datas, depth))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return (keys[first], np.add.reduceat(counts, first)) if len(keys) else (keys, counts)


def _planes(values: np.ndarray) -> bytes:
    """Non-negative numbers as byte planes, which file and shuffle compression shrinks well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=0))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data))


# --- the tree -------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, brought back by the recurrence; x >= 1/2."""
    product = np.ones_like(x)
    for i in range(8):
        product = product * (x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def log_kt(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    total, ones = total.astype(np.float64), ones.astype(np.float64)
    return _log_gamma(total - ones + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(total + 1)


def log_weighted(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) - math.log(2)


def shorter(keys: np.ndarray) -> np.ndarray:
    """Grams without their oldest context byte."""
    return (keys >> 16 << 8) | (keys & 255)


class Tree:
    """Nodes of the context lengths ``top`` to ``depth`` over sorted distinct grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int = TOP):
        self.keys, self.depth, self.top = [keys], depth, top
        self.counts, self.up = [counts], []  # by level: 0 is the longest context
        for _ in range(depth - top):
            short, at = np.unique(shorter(self.keys[-1]), return_inverse=True)
            self.up.append(at)
            self.counts.append(np.bincount(at, self.counts[-1], minlength=len(short)).astype(np.int64))
            self.keys.append(short)

    def bit(self, j: int):
        """For decision ``j`` of the byte, from the longest context to the shortest: first gram
        of each node, each gram's node, totals, ones, logs of Pe and Pw."""
        levels, below = [], None
        for level, (keys, counts) in enumerate(zip(self.keys, self.counts)):
            prefix = keys >> (8 - j)
            fresh = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            first, node = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            total = np.add.reduceat(counts, first)
            ones = np.add.reduceat(counts * (keys >> (7 - j) & 1), first)
            own = log_kt(total, ones)
            weighted = own
            if level:
                f, w = below
                weighted = log_weighted(own, np.bincount(node[self.up[level - 1][f]], w, minlength=len(first)))
            levels.append((first, node, total, ones, own, weighted))
            below = (first, weighted)
        return levels

    def tops(self) -> list[np.ndarray]:
        """(context byte << 8 | 1 then the bits so far), totals, ones, sums of log Pw of the
        nodes of length ``top``, by their parents of length 1."""
        found = []
        for j in range(8):
            first, _, total, ones, _, weighted = self.bit(j)[-1]
            keys = self.keys[-1][first]
            byte = keys >> (8 * self.top)
            ids = byte << 8 | 1 << j | (keys & 255) >> (8 - j)
            node, at = np.unique(ids, return_inverse=True)
            found.append(np.stack([node, *(np.bincount(at, x, minlength=len(node)) for x in (total, ones, weighted))]))
        return list(np.concatenate(found, axis=1)) if found else []

    def log2_probabilities(self, upper: Upper) -> np.ndarray:
        """Of each gram's last byte after its context."""
        out = np.zeros(len(self.keys[0]))
        bytes_, recent = self.keys[0] & 255, self.keys[0] >> (8 * self.depth)
        for j in range(8):
            p = None
            at = np.arange(len(self.keys[0]))
            bit = self.keys[0] >> (7 - j) & 1
            for level, (_, node, total, ones, own, weighted) in enumerate(self.bit(j)):
                if level:
                    at = self.up[level - 1][at]
                n = node[at]
                p = mixed(p, bit, total[n], ones[n], own[n], weighted[n])
            out += np.log2(upper.mix(p, j, bit, bytes_, recent))
        return out


def mixed(longer, bit, total, ones, own, weighted) -> np.ndarray:
    """Probability of ``bit``: the node's estimate and that of longer contexts (NaN: never seen) by
    the node's weight of stopping; NaN where the node itself was never seen."""
    kt = (np.where(bit == 1, ones, total - ones) + 0.5) / (total + 1.0)
    if longer is not None:
        stop = np.exp(own - weighted - math.log(2))
        kt = np.where(np.isnan(longer), kt, stop * kt + (1 - stop) * longer)
    return np.where(total > 0, kt, np.nan)


class Upper:
    """The nodes of context lengths 1 and 0, from the sums of their children."""

    def __init__(self, node: np.ndarray, total: np.ndarray, ones: np.ndarray, below: np.ndarray):
        def spread(x):
            out = np.zeros((256, 256))
            out[node >> 8, node & 255] = x
            return out

        self.total, self.ones = spread(total), spread(ones)
        self.own = log_kt(self.total, self.ones)
        self.weighted = log_weighted(self.own, spread(below))
        self.total0, self.ones0 = self.total.sum(axis=0), self.ones.sum(axis=0)
        self.own0 = log_kt(self.total0, self.ones0)
        self.weighted0 = log_weighted(self.own0, self.weighted.sum(axis=0))

    def mix(self, p, j, bit, bytes_, recent) -> np.ndarray:
        n = (1 << j) | (bytes_ >> (8 - j))
        p = mixed(p, bit, *(x[recent, n] for x in (self.total, self.ones, self.own, self.weighted)))
        p = mixed(p, bit, *(x[n] for x in (self.total0, self.ones0, self.own0, self.weighted0)))
        return np.where(np.isnan(p), 0.5, p)


# --- questions and answers ------------------------------------------------

def _gram_bucket(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    shard = (keys >> (8 * (depth + 1 - TOP))).astype(np.uint64)
    return ((shard * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % buckets


def block_items(table: pa.Table, depth: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A block's sorted distinct words and their counts in its training texts, its sorted
    distinct grams and their counts there."""
    counts: Counter[bytes] = Counter()
    others: set[bytes] = set()
    keys, n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for rows, words in some_texts(table):
        held = rows.column("held_out").to_pylist()
        for ws, h in zip(words, held):
            (others if h else counts).update(ws)
        learned, seen = (counted([b" ".join(ws) + END for ws, h in zip(words, held) if h is out], depth) for out in (False, True))
        del words
        keys, n = summed(np.concatenate([keys, learned[0], seen[0]]), np.concatenate([n, learned[1], np.zeros_like(seen[1])]))
    names = sorted(others.union(counts))
    return names, np.fromiter(map(counts.__getitem__, names), dtype=np.int64, count=len(names)), keys, n


def _sides(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in order) for each bucket that occurs."""
    order = np.argsort(buckets, kind="stable")
    ends = np.flatnonzero(np.diff(buckets[order])) + 1
    for places in np.split(order, ends) if len(order) else []:
        yield int(buckets[places[0]]), places


def _leanly(group, *args):
    """``group(*args)``; then what it has freed goes back to the system, as Python workers live on."""
    try:
        return group(*args)
    finally:
        give_back()


def _ask(depth: int, buckets: int):
    def asked(key, table):
        block = key[0].as_py()
        names, n_names, keys, n = block_items(table, depth)
        out: list[tuple] = []
        for b, at in _sides(_word_buckets(names, buckets)):
            out.append((WORD, b, block, b" ".join(names[i] for i in at.tolist()), _planes(n_names[at])))
        for b, at in _sides(_gram_bucket(keys, depth, buckets)):
            out.append((GRAM, b, block, _pack_keys(keys[at]), _planes(n[at])))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = ("kind", "bucket", "block", "items", "counts")
        return pa.table({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(zip(columns, types))})

    def ask(key, table):
        return _leanly(asked, key, table)

    return ask


def _bucket_tree(table: pa.Table, depth: int) -> tuple[Tree, list[np.ndarray]]:
    keys = [_unpack_keys(x) for x in table.column("items").to_pylist()]
    counts = [_numbers(x) for x in table.column("counts").to_pylist()]
    return Tree(*summed(np.concatenate(keys), np.concatenate(counts)), depth), keys


def _bucket_counts(table: pa.Table) -> tuple[dict[bytes, int], list[list[bytes]]]:
    total: dict[bytes, int] = {}
    lists = [x.split(b" ") for x in table.column("items").to_pylist()]
    for ws, data in zip(lists, table.column("counts").to_pylist()):
        for w, n in zip(ws, _numbers(data).tolist()):
            total[w] = total.get(w, 0) + n
    return total, lists


def _tops(depth: int):
    def found(key, table):
        if key[0].as_py() == WORD:
            total, _ = _bucket_counts(table)
            rows = [[-1], [0.0], [0.0], [0.0], [sum(n > 0 for n in total.values())], [sum(total.values())]]
        else:
            node, n, ones, below = _bucket_tree(table, depth)[0].tops()
            rows = [node, n, ones, below, np.zeros(len(node)), np.zeros(len(node))]
        types = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        names = ("node", "total", "ones", "below", "words", "tokens")
        return pa.table({k: pa.array(np.asarray(r).astype("f8" if t == pa.float64() else "i8"), t) for k, r, t in zip(names, rows, types)})

    def tops(key, table):
        return _leanly(found, key, table)

    return tops


def _answer(depth: int, upper):
    def answered(key, table):
        if key[0].as_py() == WORD:
            total, lists = _bucket_counts(table)
            out = [_planes(np.fromiter(map(total.__getitem__, ws), dtype=np.int64, count=len(ws))) for ws in lists]
        else:
            tree, keys = _bucket_tree(table, depth)
            p = tree.log2_probabilities(upper.value).astype("<f4")
            out = [p[np.searchsorted(tree.keys[0], k)].tobytes() for k in keys]
        return table.select(["kind", "block", "items"]).append_column("answer", pa.array(out, pa.binary()))

    def answer(key, table):
        return _leanly(answered, key, table)

    return answer


def _score(depth: int):
    def scored(key, docs, answers):
        logs: dict[bytes, float] = {}
        keys, p = [], []
        for batch in answers.to_batches(max_chunksize=64):
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "items", "answer")))
            for kind, items, answer in rows:
                if kind == WORD:
                    logs.update(zip(items.split(b" "), np.log10(_numbers(answer) + 0.1).tolist()))
                else:
                    keys.append(_unpack_keys(items))
                    p.append(np.frombuffer(answer, dtype="<f4"))
        keys, p = np.concatenate(keys), np.concatenate(p)
        order = np.argsort(keys)
        keys, p = keys[order], p[order]
        del order
        unknown = math.log10(0.1)
        base, n_known, n_tokens, n_bytes, scores = [], [], [], [], []
        for _, words in some_texts(docs):
            for ws in words:
                found = list(map(logs.__getitem__, ws))
                base.append(sum(found))
                n_known.append(len(found) - found.count(unknown))
                n_tokens.append(len(ws))
            datas = [b" ".join(ws) + END for ws in words]
            del words
            sizes = np.fromiter(map(len, datas), dtype=np.int64, count=len(datas))
            grams = grams_of(datas, depth)
            del datas
            order = np.argsort(grams)
            grams = grams[order]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            logs2 = np.empty(len(grams))
            logs2[order] = np.repeat(p[np.searchsorted(keys, grams[first])].astype(np.float64), np.diff(first, append=len(grams)))
            scores.append(np.add.reduceat(logs2, np.cumsum(sizes) - sizes))
            n_bytes.append(sizes)
            del grams, order, first, logs2
        return pa.table({
            "doc_id": docs.column("id"), "held_out": docs.column("held_out"),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "base_sum": pa.array(base, pa.float64()),
            "score": pa.array(np.concatenate(scores) * math.log10(2), pa.float64()),
            "n_bytes": pa.array(np.concatenate(n_bytes), pa.int64()),
        })

    def score(key, docs, answers):
        return _leanly(scored, key, docs, answers)

    return score


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                    block_bytes: int = BLOCK_BYTES, held_out_of: int = HELD_OUT_OF) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities) and bits_per_byte (of the normalised text)."""
    if not TOP < depth <= 6:
        raise ValueError("depth must be 3 to 6: a gram is one 64-bit number")
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % held_out_of == 0
    size, n_train = rows.agg(
        F.sum(F.octet_length("text")), F.sum(F.when(held, 0).otherwise(1))
    ).first()
    n_train = n_train or 0
    blocks = max(parts(docs), -(-(size or 0) // block_bytes))
    buckets = blocks
    dealt = rows.select(
        "id", "text", held.alias("held_out"), F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block")
    )
    asked = land(dealt.groupBy("block").applyInArrow(_ask(depth, buckets), ASK), "lm-asked")
    tops = asked.groupBy("kind", "bucket").applyInArrow(_tops(depth), TOPS)
    # at most 256 x 255 nodes and one row for the word counts
    top = tops.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("total", "ones", "below", "words", "tokens")]).toPandas()
    words, grams = top[top["node"] < 0], top[top["node"] >= 0].sort_values("node")
    train_tokens = int(words["tokens"].sum()) + n_train
    vocabulary = int(words["words"].sum()) + (n_train > 0)
    upper = spark.sparkContext.broadcast(Upper(*(grams[c].to_numpy() for c in ("node", "total", "ones", "below"))))
    answers = asked.groupBy("kind", "bucket").applyInArrow(_answer(depth, upper), ANSWER)
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(depth), SCORES)
    # the end of each text is a token too; its count is that of the training texts
    tokens = F.col("n_tokens") + 1
    share = math.log10(train_tokens + 0.1 * (vocabulary + 1))
    return scored.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("n_known") + F.lit(int(n_train > 0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") + F.lit(math.log10(n_train + 0.1)) - tokens * F.lit(share)).alias("base_score"), "score",
        (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
