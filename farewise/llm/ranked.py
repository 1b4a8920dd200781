"""Ranked lexical search: summed accumulators of short lists, skipping over long ones.

**Index.**  Each task cuts the documents it reads into shards of about ``SHARD_BYTES``
of text (no shuffle, so no document or source can be too hot) and writes one row per
shard: its terms (whole, so nothing rests on hashes), each term's postings in document
order with their frequencies, and the documents' ids and lengths.  Document counts
and lengths are summed over all shards, document frequencies over those of the terms
asked for, so scores of different shards compare and the best ``k`` of the shards'
best ``k`` are the exact answer.

**Search** of one query in one shard, term at a time where lists are short and
document at a time where they are long:

* lists in less than a 1/``LONG`` share of the shard's documents are short: their
  contributions are summed into one accumulator per document;
* the accumulators then act as one more iterator, bounded by their largest sum,
  beside those of the long lists, bounded by their largest contributions.  All bounds
  are held per window of ``WINDOW`` documents;
* windows are met in document order, and one whose bounds together cannot reach the
  k-th best score so far (``least``, kept from shard to shard of a task) is skipped;
* in a window, iterators whose bounds together stay below ``least`` cannot bring in a
  document by themselves.  The others propose the documents; the former are then
  asked, largest bound first, only about documents that can still reach ``least``
  (a binary search in the list, which skips the rest of it).

Scores are 64-bit integers throughout, so no order of summing matters.

Queries are taken in blocks of at most about ``QUERY_BYTES`` of terms, each broadcast to
the tasks that read the index; for more queries the index is read once per block.

Defined cases: null and empty texts have no terms: as documents they are never
found and do not count, as queries they have no answers; a null query id is kept as
null; repeated rows are documents and queries of their own; equal scores come by
ascending id, a null id first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farewise.llm.common import land, pick, union_all

K = 10
B = 75  # per cent of the length normalisation
K1_8 = 8
ONE = 1_000_000_000
SHARD_BYTES = 16 << 20
LONG = 16
WINDOW = 512
QUERY_BYTES = 16 << 20
NO_ID = -(1 << 63)

#: Term bytes: digits, letters, all that is not ASCII; A-Z lower-cased, the rest a blank.
_TERM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

INDEX = "docs long, words long, terms array<binary>, starts binary, postings binary, tfs binary, ids binary, lengths binary"
FOUND = "query long, doc_id long, score long"
_ARRAYS = {"starts": "<i8", "postings": "<i4", "tfs": "<i4", "ids": "<i8", "lengths": "<i8"}


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERM).split() if text else []


def counted(texts: list[bytes | None], first: int, split=terms_of) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term of each posting, its document, its frequency, lengths) of some documents."""
    words = [split(t) for t in texts]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    size = max(1, len(coded.dictionary))
    pairs = np.repeat(np.arange(len(words)), lengths) * size + coded.indices.to_numpy(zero_copy_only=False)
    pairs, tfs = np.unique(pairs, return_counts=True)
    return coded.dictionary, pairs % size, pairs // size + first, tfs, lengths


def joined(parts: list[tuple]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Several ``counted`` as one: every term once."""
    names = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    codes, at, term = names.indices.to_numpy(zero_copy_only=False), 0, []
    for p in parts:
        term.append(codes[at:at + len(p[0])][p[1]] if len(p[0]) else p[1])
        at += len(p[0])
    return names.dictionary, np.concatenate(term), *(np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))


class Builder:
    """Collects documents until they make a shard."""

    def __init__(self):
        self.ids, self.parts, self.bytes, self.docs = [], [], 0, 0

    def add(self, ids: np.ndarray, texts: list[bytes | None]) -> None:
        self.parts.append(counted(texts, self.docs))
        self.ids.append(ids)
        self.bytes += sum(map(len, filter(None, texts)))
        self.docs += len(texts)

    def row(self) -> dict:
        """The inverted index: terms in byte order, postings in document order."""
        names, term, docs, tfs, lengths = joined(self.parts)
        order = pc.array_sort_indices(names).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        term = rank[term]
        place = np.argsort(term, kind="stable")  # documents stay in order
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(order)))])
        arrays = {"starts": starts, "postings": docs[place], "tfs": tfs[place], "ids": np.concatenate(self.ids), "lengths": lengths}
        return {
            "docs": int((lengths > 0).sum()), "words": int(lengths.sum()), "terms": names.take(pa.array(order)),
            **{c: arrays[c].astype(t).tobytes() for c, t in _ARRAYS.items()},
        }


def _index_batch(row: dict) -> pa.RecordBatch:
    terms = pa.ListArray.from_arrays(pa.array([0, len(row["terms"])], pa.int32()), row["terms"])
    return pa.RecordBatch.from_arrays(
        [pa.array([row["docs"]]), pa.array([row["words"]]), terms, *(pa.array([row[c]], pa.binary()) for c in _ARRAYS)],
        names=["docs", "words", "terms", *_ARRAYS],
    )


def runs(texts: pa.Array, size: int) -> list[tuple[int, int]]:
    """Rows cut into runs of about ``size`` bytes of text, a longer text alone."""
    steps = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)) // size
    cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(texts)]
    return list(zip(cuts, cuts[1:]))


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard, written to the shared folder."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Builder()
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for a, b in runs(batch.column(1), max(1, shard_bytes // 4)):
                shard.add(ids[a:b], batch.column(1).slice(a, b - a).to_pylist())
                if shard.bytes >= shard_bytes:
                    yield _index_batch(shard.row())
                    shard = Builder()
        if shard.docs:
            yield _index_batch(shard.row())

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    return land(rows.mapInArrow(build, INDEX), "ranked-index")


class Shard:
    """An index row opened for the terms of a block of queries, with the numbers of the whole table."""

    def __init__(self, row, at: int, asked: pa.Array, docs: int, words: int):
        read = lambda c: np.frombuffer(row.column(c)[at].as_buffer(), dtype=_ARRAYS[c])
        self.ids, lengths, self.starts, self.postings, self.tfs = (read(c) for c in ("ids", "lengths", "starts", "postings", "tfs"))
        self.n = len(self.ids)
        self.m = 100 - B + B * lengths * docs // max(1, words)
        self.windows = -(-self.n // WINDOW)
        self.edges = np.arange(self.windows + 1) * WINDOW
        where = pc.index_in(asked, value_set=row.column("terms")[at].values)
        #: the shard's number of each term asked for, or -1
        self.place = where.fill_null(-1).to_numpy(zero_copy_only=False).tolist()
        self.open: dict[int, tuple] = {}

    def list_of(self, term: int):
        """(documents, contributions without the weight, window starts and bounds if long)."""
        got = self.open.get(term)
        if got is None:
            some = slice(self.starts[term], self.starts[term + 1])
            docs, tf = self.postings[some], self.tfs[some].astype(np.int64)
            part = ONE * tf // (1000 * tf + K1_8 * self.m[docs])
            edges = most = None
            if len(docs) * LONG >= self.n:
                edges = np.searchsorted(docs, self.edges)
                most = np.zeros(self.windows, dtype=np.int64)
                some = np.flatnonzero(np.diff(edges))
                most[some] = np.maximum.reduceat(part, edges[some])
            got = self.open[term] = docs, part, edges, most
        return got

    def search(self, query: list[tuple[int, int]], k: int, least: int, best: tuple) -> tuple[int, tuple, int]:
        """``query``: (term number, weight); ``best``: (ids, scores) so far, ``least`` their k-th score.
        Returns both anew and how many postings and accumulators were read document at a time."""
        short, long = [], []
        for t, weight in query:
            if (place := self.place[t]) >= 0 and weight > 0:
                docs, part, edges, most = self.list_of(place)
                (short if edges is None else long).append((docs, part, weight, edges, most))
        if not short and not long:
            return least, best, 0
        sums = np.zeros(self.windows * WINDOW, dtype=np.int64)
        for docs, part, weight, _, _ in short:
            sums[docs] += part * weight  # a document is in a list once
        bounds = np.stack([sums.reshape(-1, WINDOW).max(axis=1), *(most * weight for _, _, weight, _, most in long)])
        reach, read = bounds.sum(axis=0), 0
        for w in np.flatnonzero(reach > 0).tolist():
            if reach[w] < max(least, 1):
                continue
            first = w * WINDOW
            mine = bounds[:, w]
            order = np.argsort(mine, kind="stable")
            together = np.cumsum(mine[order])
            asked = int(np.searchsorted(together, max(least, 1)))  # these cannot reach it, even together
            total = np.zeros(WINDOW, dtype=np.int64)
            for i in order[asked:].tolist():
                if i == 0:
                    total += sums[first:first + WINDOW]
                    read += WINDOW
                else:
                    docs, part, weight, edges, _ = long[i - 1]
                    some = slice(edges[w], edges[w + 1])
                    total[docs[some] - first] += part[some] * weight
                    read += edges[w + 1] - edges[w]
            left = int(together[asked - 1]) if asked else 0
            near = np.flatnonzero(total > 0)
            near = near[total[near] + left >= max(least, 1)]
            for i in order[:asked][::-1].tolist():
                if not len(near):
                    break
                left -= int(mine[i])
                if i == 0:
                    total[near] += sums[first + near]
                    read += len(near)
                else:
                    docs, part, weight, edges, _ = long[i - 1]
                    some = docs[edges[w]:edges[w + 1]]
                    if len(some):
                        at = np.minimum(np.searchsorted(some, near + first), len(some) - 1)
                        total[near] += np.where(some[at] == near + first, part[edges[w] + at] * weight, 0)
                        read += len(near)
                near = near[total[near] + left >= max(least, 1)]
            if len(near):
                ids, scores = np.concatenate([best[0], self.ids[first + near]]), np.concatenate([best[1], total[near]])
                if len(ids) > k:
                    keep = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[keep], scores[keep]
                best = ids, scores
                if len(ids) == k:
                    least = int(scores.min())
        return least, best, read


def _searcher(block, docs: int, words: int, k: int):
    """Index rows of a task to its best ``k`` of each of the block's queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, queries = block.value
        asked = pa.array(asked, pa.binary())
        nothing = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        best, least = [nothing] * len(queries), [0] * len(queries)
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard(batch, at, asked, docs, words)
                for i, (_, terms) in enumerate(queries):
                    least[i], best[i], _ = shard.search(terms, k, least[i], best[i])
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            ids = np.concatenate([b[0] for b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([q for q, _ in queries], sizes)), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([b[1] for b in best]))],
                names=["query", "doc_id", "score"],
            )

    return run


def _frequencies(index: DataFrame, asked: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of the block's terms is."""
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.binary())
        for batch in batches:
            for at in range(batch.num_rows):
                place = pc.index_in(terms, value_set=batch.column("terms")[at].values).fill_null(-1).to_numpy(zero_copy_only=False)
                there = np.flatnonzero(place >= 0)
                sizes = np.diff(np.frombuffer(batch.column("starts")[at].as_buffer(), dtype="<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sizes[place[there]])], names=["t", "df"])

    found = index.select("terms", "starts").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()
    shared.unpersist()
    return {asked[t]: df for t, df in zip(found.column("t").to_pylist(), found.column("df").to_pylist())}


def weight(docs: int, df: int) -> int:
    """The weight of a term in ``df`` of ``docs`` documents."""
    return floor(1000 * log((2 * docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id",
           query_text: str = "text", k: int = K, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """For each row of ``queries`` its best ``k`` documents: the query's id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    index = index_documents(docs, id_col, text_col, shard_bytes)
    counted, words = index.agg(F.sum("docs"), F.sum("words")).first()
    named = land(
        pick(queries, query_id=query_id, text=query_text)
        .select(F.monotonically_increasing_id().alias("query"), F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("binary").alias("text")),
        "ranked-queries",
    )
    size = named.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    found = []
    for i in range(blocks):
        # about query_bytes of queries pass the driver at a time
        some = named.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).select("query", "text").toArrow()
        bags = [terms_of(t) for t in some.column("text").to_pylist()]
        asked = sorted({t for bag in bags for t in bag})
        number = {t: j for j, t in enumerate(asked)}
        dfs = _frequencies(index, asked)
        weights = [weight(counted or 0, dfs[t]) if t in dfs else 0 for t in asked]
        block = []
        for query, bag in zip(some.column("query").to_pylist(), bags):
            times: dict[int, int] = {}
            for t in bag:
                times[number[t]] = times.get(number[t], 0) + 1
            block.append((query, [(t, n * weights[t]) for t, n in times.items()]))
        shared = spark.sparkContext.broadcast((asked, block))
        best = index.mapInArrow(_searcher(shared, counted or 0, words or 0, k), FOUND)
        w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        found.append(land(best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "ranked-found"))
        shared.unpersist()
    named = named.select("query", F.col("query_id").alias(query_id))
    return union_all(found).join(named, "query").select(query_id, "rank", "doc_id", "score")
