"""Exact top-k search: BM25 over a sharded inverted index, blocks of documents pruned by their bounds.

Tasks cut the documents they read into shards of about ``SHARD_BYTES`` of text; each
shard's inverted index (terms, postings, term frequencies, lengths; documents ordered by
their commonest word and their length) is written once.  Document frequencies and the mean length are those of the whole
table, so scores of different shards compare, and the best ``k`` of all shards'
best ``k`` are the exact answer.

Like queries are searched for together: they are sorted into kinds by their commonest words
(their language's, as a rule), then by their number of words.  For some of them at a time, words
that many of them and many of a shard's documents have are columns of a matrix; the other
words' postings are added up query by query, in rows of ``ROW`` postings.  A document can reach
at most that sum plus the largest of its block of ``BLOCK`` documents in the query's columns, or
plus the most that one of the block has in all columns.  Blocks that reach no query's threshold
(the k-th score that its task has found, kept from shard to shard) are left out; for the others
the queries times the matrix gives the scores in single precision, and what can be among the
best is scored again in double.  Nothing else is left out, so the answer is that of scoring
everything.

There are as many search tasks as cores, each with its share of the shards, so what they
hand on grows with the queries, not with queries times shards.

Queries are taken in blocks of at most about ``QUERY_BYTES``, each sent to all
tasks as numbers of the block's words; a word is looked up once in a shard, not once a
query.  The index is read once for each block, one shard of a task in memory at a time.

Defined cases: null or empty text, and a query without known words, have no
answers; a null id is no query; repeated rows are documents (and queries) of
their own; equal scores (to 8 places) rank by id, null first; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farewise.llm.common import give_back, land, lean, pick, union_all
from farewise.llm.ranked import joined, runs

K = 10
K1, B = 1.2, 0.75
SHARD_BYTES, SHARD_DOCS = 32 << 20, 16384
# A word is a column of the matrix where the share of the queries at hand that have it times the share of
# the shard's documents that have it is at least 1 / FREQUENT ** 2.
FREQUENT = 16
BLOCK = 8
# Postings that are read together.
ROW = 8
# The most numbers in a matrix, about the words of the queries searched for at a time, and the most queries.
CELLS = 3 << 21
WORDS_AT_ONCE = 1 << 16
QUERIES_AT_ONCE = 256
# Such groups of queries that share a matrix.
MATRIX_FOR = 8
# Queries are sorted into so many kinds by so many of their commonest words, in so many rounds.
KINDS, COMMON, KIND_ROUNDS = 8, 256, 4
# What scores in single precision may be off by, for their size.
SLACK = 1e-4
# Candidates after which they are scored to all digits, and for how many queries a document is at a time.
FOUND_AT_ONCE = 1 << 18
AT_ONCE = 256
QUERY_BYTES = 64 << 20
QUERY_EVERY = 20
SEED = 42
NO_ID = -(1 << 63)

INDEX = "docs int, words long, ids binary, lengths binary, terms binary, counts binary, postings binary, tfs binary"
ARRAYS = ("ids", "lengths", "terms", "counts", "postings", "tfs")
FOUND = "qid long, doc_id long, score double"


def _terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs."""
    most = int(numbers.max()) if len(numbers) else 0
    return numbers.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _unpacked(data, n: int) -> np.ndarray:
    """A view of ``n`` packed numbers."""
    return np.frombuffer(data, dtype=f"<u{len(data) // n if n else 1}")


def _counted(texts: pa.Array, first: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word of each posting, its document, its frequency, lengths) of some documents, lower-cased
    and split as bytes.  Postings come by document."""
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(kind)))
    doc, words = pc.list_parent_indices(words).to_numpy(), words.flatten()
    some = pc.not_equal(pc.binary_length(words), 0)  # white space at the ends leaves empty words
    doc, coded = doc[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()
    size = max(1, len(coded.dictionary))
    pairs, tfs = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary.cast(pa.binary()), pairs % size, pairs // size + first, tfs, np.bincount(doc, minlength=len(texts))


class Builder:
    """Collects documents until they make a shard: counted terms of some MB of text at a time."""

    def __init__(self):
        self.ids, self.parts, self.bytes, self.docs = [], [], 0, 0

    def add(self, ids: np.ndarray, texts: pa.Array) -> None:
        names, *numbers = _counted(texts, self.docs)
        self.parts.append((names, *(x.astype(np.int32) for x in numbers)))
        self.ids.append(ids)
        self.bytes += pc.sum(pc.binary_length(texts)).as_py() or 0
        self.docs += len(texts)

    def batch(self) -> pa.RecordBatch:
        """The inverted index as little-endian arrays, terms by hash, like documents together."""
        from xxhash import xxh64_intdigest

        names, term, doc, tf, lengths = joined(self.parts)
        ids = np.concatenate(self.ids)
        self.parts, self.ids = [], []
        # blocks of one commonest word (the language's) and of one length have tight maxima
        common, size = np.full(len(ids), -1, dtype=np.int64), max(1, len(names))
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        if len(first):
            common[doc[first]] = size - 1 - np.maximum.reduceat(tf.astype(np.int64) * size + (size - 1 - term), first) % size
        order = np.lexsort((ids, lengths, common))
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in names.to_pylist()), dtype=np.uint64, count=len(names)).view(np.int64)
        by_hash = np.argsort(hashes, kind="stable")
        rank = np.empty(len(names), dtype=np.int64)
        rank[by_hash] = np.arange(len(names))
        # postings by term, then by document: sorted as one number, with their frequency where it fits
        most = int(tf.max(initial=0)) + 1
        if len(names) * len(ids) * most < 1 << 63:
            keys = rank[term]
            del term
            for factor, x in ((len(ids), place[doc]), (most, tf)):
                keys *= factor
                keys += x
            keys.sort()
            tf = (keys % most).astype(np.int32)
            keys //= most
            doc = (keys % len(ids)).astype(np.int32)
            term = np.floor_divide(keys, len(ids), out=keys)
            del keys
        else:
            term, doc = rank[term], place[doc]
            by = np.lexsort((doc, term))
            term, doc, tf = term[by], doc[by], tf[by]
        arrays = {
            "ids": ids[order].astype("<i8").tobytes(), "lengths": lengths[order].astype("<i8").tobytes(), "terms": hashes[by_hash].astype("<i8").tobytes(),
            "counts": _packed(np.bincount(term, minlength=len(names))), "postings": _packed(doc), "tfs": _packed(tf),
        }
        return pa.RecordBatch.from_arrays(
            [pa.array([len(ids)], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), *(pa.array([x], pa.binary()) for x in arrays.values())],
            names=["docs", "words", *arrays],
        )


def _spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each of ``first`` on, as many as ``many`` says."""
    where = np.repeat(first - (np.cumsum(many) - many), many)
    where += np.arange(len(where))
    return where


def _at_least(least: np.ndarray) -> np.ndarray:
    """What a score in single precision is at least, where the true one is ``least``."""
    return np.maximum(least * (1 - SLACK) - 1e-6, 1e-9).astype(np.float32)


def _products(asked: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """What each query's columns add up to for each document."""
    return asked @ matrix


class Asked:
    """The distinct words of some like queries, how many queries have each, the queries' words as places
    among them and where each query's begin; ``parts``: queries that are searched for together."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, cuts: list[tuple[int, int]]):
        self.start, stop = cuts[0][0], cuts[-1][1]
        self.n, self.parts = stop - self.start, [(a - self.start, b - self.start) for a, b in cuts]
        self.starts = starts[self.start:stop + 1] - starts[self.start]
        self.words, places, self.counts = np.unique(words[starts[self.start]:starts[stop]], return_inverse=True, return_counts=True)
        self.places = places.astype(np.int32)


class Shard:
    """An index ready for searching, given the mean length of all documents and the queries' words.
    Only postings of these words are kept: by word, in rows of ``ROW`` of them, and by document."""

    def __init__(self, row: dict, mean: float, vocabulary: np.ndarray, weights: np.ndarray):
        read = lambda c: np.frombuffer(row[c], dtype="<i8").astype(np.int64)
        n, ids, lengths, terms = row["docs"], read("ids"), read("lengths"), read("terms")
        sizes = _unpacked(row["counts"], len(terms)).astype(np.int64)
        total = int(sizes.sum())
        # the place of each of the queries' words among those that the shard has, -1 where it has it not
        known = np.searchsorted(vocabulary, terms)
        known[known == len(vocabulary)] = 0
        asked = vocabulary[known] == terms if len(vocabulary) else np.zeros(len(terms), dtype=bool)
        known = known[asked]
        self.at = np.full(len(vocabulary), -1, dtype=np.int32)
        self.at[known] = np.arange(len(known))
        kept = np.repeat(asked, sizes)
        self.sizes = sizes[asked]
        # documents of a block have places ``blocks`` apart: its largest of a row is one step for all blocks
        self.blocks = -(-n // BLOCK)
        self.n = self.blocks * BLOCK
        place = np.arange(n)
        place = place % BLOCK * self.blocks + place // BLOCK
        self.ids, norms = np.zeros(self.n, dtype=np.int64), np.zeros(self.n)
        self.ids[place] = ids
        norms[place] = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        doc = place.astype(np.uint16 if self.n < 1 << 16 else np.int32)[_unpacked(row["postings"], total)[kept]]
        tf = _unpacked(row["tfs"], total)[kept]
        del kept, asked, sizes, terms
        # a last row that is not full has contributions of 0 to a place after the documents'
        self.rows = -(-self.sizes // ROW)
        self.first = np.cumsum(self.rows) - self.rows
        where = _spans(self.first * ROW, self.sizes)
        self.docs = np.full(int(self.rows.sum()) * ROW, self.n, dtype=doc.dtype)
        self.docs[where] = doc
        self.parts = np.zeros(len(self.docs), dtype=np.float32)
        part = norms.astype(np.float32)[doc]
        part += tf
        np.divide(tf, part, out=part, dtype=np.float32)
        part *= np.repeat((weights[known] * (K1 + 1)).astype(np.float32), self.sizes)
        self.parts[where] = part
        self.docs, self.parts = self.docs.reshape(-1, ROW), self.parts.reshape(-1, ROW)
        del where, part
        by = np.argsort(doc, kind="stable")
        self.words = np.repeat(np.arange(len(known), dtype=np.int32), self.sizes)[by]
        self.tfs, self.norms, self.weights = tf[by], norms, weights[known]
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=self.n))])
        # the contributions of one document, 0 for words that the shard has not
        self.values = np.zeros(len(known) + 1)

    def facing(self, asked: Asked) -> tuple[np.ndarray, ...]:
        """For the words of some queries: the first row and the number of rows of each that has no column,
        the column of each that has one (others -1), the columns' contributions as a matrix with a row for
        each, its largest of each block, and the most that a document of a block has in all."""
        at = self.at[asked.words]
        known = at >= 0
        first, rows = np.zeros((2, len(at)), dtype=np.int64)
        first[known], rows[known] = self.first[at[known]], self.rows[at[known]]
        worth = np.zeros(len(at), dtype=np.int64)
        worth[known] = asked.counts[known] * self.sizes[at[known]]
        some = np.flatnonzero(worth * FREQUENT ** 2 >= asked.n * max(1, self.n))
        some = some[np.argsort(-worth[some], kind="stable")][:max(1, CELLS // max(1, self.n))]
        column = np.full(len(at), -1, dtype=np.int32)
        column[some] = np.arange(len(some))
        matrix = np.zeros((len(some), self.n + 1), dtype=np.float32)
        where = _spans(first[some], rows[some])
        matrix[np.repeat(np.arange(len(some)), rows[some])[:, None], self.docs[where]] = self.parts[where]
        rows[some] = 0
        return first, rows, column, matrix, self._by_block(matrix).max(axis=1), self._by_block(matrix.sum(axis=0)[None]).max(axis=1)

    def _by_block(self, numbers: np.ndarray) -> np.ndarray:
        return numbers[:, :self.n].reshape(len(numbers), BLOCK, self.blocks)

    def search(self, words: np.ndarray, starts: np.ndarray, k: int, least: np.ndarray, facing: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(query, document) of all that can be among the best ``k`` of one of these queries, each
        of them the ``words`` (places in what they are ``facing``) from one of ``starts`` to the next; k
        others already reach its ``least``."""
        n = len(starts) - 1
        first, rows, column, matrix, most, mass = facing
        many = rows[words]
        where, ends = _spans(first[words], many), np.concatenate([[0], np.cumsum(many)])[starts].tolist()
        sums = np.zeros((n, self.n + 1), dtype=np.float32)
        for q, (a, b) in enumerate(zip(ends, ends[1:])):
            some = where[a:b]
            np.add.at(sums[q], self.docs.take(some, axis=0, mode="clip").ravel().astype(np.intp), self.parts.take(some, axis=0, mode="clip").ravel())
        del where
        asked, columns = np.zeros((n, len(matrix)), dtype=np.float32), column[words]
        some = np.flatnonzero(columns >= 0)
        asked[np.searchsorted(starts, some, side="right") - 1, columns[some]] = 1
        # blocks of documents that no query's bounds reach are left out where they are many
        reach, wanted = self._by_block(sums).max(axis=1), _at_least(least)[:, None]
        near = np.flatnonzero((reach + mass >= wanted).any(axis=0))
        near = near[(reach[:, near] + np.minimum(asked @ most[:, near], mass[0, near]) >= wanted).any(axis=0)]
        if 4 * len(near) < 3 * self.blocks:
            docs = (np.arange(BLOCK)[:, None] * self.blocks + near).ravel()
            rough = _products(asked, self._by_block(matrix).take(near, axis=2).reshape(len(matrix), len(docs)))
            rough += self._by_block(sums).take(near, axis=2).reshape(n, len(docs))
        else:
            docs = np.arange(self.n)
            rough = _products(asked, matrix[:, :self.n])
            rough += sums[:, :self.n]
        del sums
        # scores to about 6 digits: what can be among the best is scored to all digits
        none = np.flatnonzero(least <= 0)
        if len(none) and len(docs) > k:
            least = least.copy()
            for some in np.array_split(none, -(-len(none) // 32)):
                least[some] = np.partition(rough[some], -k, axis=1)[:, -k]
        found = np.flatnonzero(rough >= _at_least(least)[:, None])
        return found // len(docs), docs[found % len(docs)]

    def scores(self, words: np.ndarray, starts: np.ndarray, found: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """What documents ``docs`` score for queries ``found``, to 8 places; each query has the ``words``
        from one of ``starts`` to the next."""
        scores, sizes = np.empty(len(found)), np.diff(starts)
        # a document for at most AT_ONCE queries at a time
        order = np.argsort(docs, kind="stable")
        heads = np.flatnonzero(np.diff(docs[order], prepend=-1))
        heads = np.flatnonzero((np.arange(len(docs)) - np.repeat(heads, np.diff(heads, append=len(docs)))) % AT_ONCE == 0).tolist()
        for a, b in zip(heads, [*heads[1:], len(docs)]):
            doc, mine = docs[order[a]], found[order[a:b]]
            its, tf = (x[self.edges[doc]:self.edges[doc + 1]] for x in (self.words, self.tfs))
            self.values[its] = tf * (K1 + 1) / (tf + self.norms[doc]) * self.weights[its]
            many = sizes[mine]
            scores[order[a:b]] = np.add.reduceat(self.values.take(self.at[words[_spans(starts[mine], many)]], mode="wrap"), np.cumsum(many) - many)
            self.values[its] = 0
        return np.round(scores, 8)


def _best(ids: np.ndarray, scores: np.ndarray, found: np.ndarray, more: np.ndarray, theirs: np.ndarray) -> None:
    """Puts what was ``found`` for the queries (ids ``more``, scores ``theirs``) into their rows of the
    best ``ids`` and ``scores``, best first; score 0: none."""
    some = np.flatnonzero((theirs > 0) & (theirs >= scores[found, -1]))
    found, more, theirs = found[some], more[some], theirs[some]
    own = np.unique(found)
    rows, places = np.nonzero(scores[own] > 0)
    rows, more, theirs = np.concatenate([own[rows], found]), np.concatenate([ids[own[rows], places], more]), np.concatenate([scores[own[rows], places], theirs])
    order = np.lexsort((more, -theirs, rows))
    rows, more, theirs = rows[order], more[order], theirs[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, own)[np.searchsorted(own, rows)]
    top = rank < ids.shape[1]
    ids[rows[top], rank[top]], scores[rows[top], rank[top]] = more[top], theirs[top]


def _searcher(block, mean: float, k: int):
    """Index rows of a partition to the best ``k`` of each of the block's queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, number, starts, words, vocabulary, weights = block.value
        # some queries at a time: those that begin within WORDS_AT_ONCE words; a matrix serves some of these
        cuts = np.flatnonzero(np.diff(starts[:-1] // WORDS_AT_ONCE, prepend=-1))
        cuts = [(c, min(b, c + QUERIES_AT_ONCE)) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts) - 1]) for c in range(a, b, QUERIES_AT_ONCE)]
        cuts = [cuts[i:i + MATRIX_FOR] for i in range(0, len(cuts), MATRIX_FOR)]
        asked = [Asked(words, starts, some) for some in cuts]
        give_back()
        ids, scores = np.zeros((len(starts) - 1, k), dtype=np.int64), np.zeros((len(starts) - 1, k))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {"docs": batch.column("docs")[i].as_py(), **{c: batch.column(c)[i].as_buffer() for c in ARRAYS}}
                shard = Shard(row, mean, vocabulary, weights)
                del row
                give_back()
                found, pairs = [], 0
                for some in asked:
                    facing = shard.facing(some)
                    for a, b in some.parts:
                        of, docs = shard.search(some.places[some.starts[a]:some.starts[b]], some.starts[a:b + 1] - some.starts[a], k, scores[some.start + a:some.start + b, -1], facing)
                        found.append((of + (some.start + a), docs))
                        pairs += len(of)
                        if pairs >= FOUND_AT_ONCE or some is asked[-1] and b == some.n:
                            of, docs = map(np.concatenate, zip(*found))
                            found, pairs = [], 0
                            _best(ids, scores, of, shard.ids[docs], shard.scores(words, starts, of, docs))
                    del facing
                del shard
                give_back()
        rows, places = np.nonzero(scores[number] > 0)
        if len(rows):
            found = ids[number[rows], places]
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[rows]), pa.array(found, mask=found == NO_ID), pa.array(scores[number[rows], places])],
                names=["qid", "doc_id", "score"],
            )

    return lean(search)


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard: its inverted index, written to the shared folder.  Tasks cut what they
    read into shards of at most ``shard_docs`` and about ``shard_bytes`` of text: nothing is
    shuffled, whatever repeats."""
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Builder()
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for start, stop in runs(batch.column(1), max(1, shard_bytes // 4)):
                while start < stop:
                    n = min(stop - start, shard_docs - shard.docs)
                    shard.add(ids[start:start + n], batch.column(1).slice(start, n))
                    start += n
                    if shard.bytes >= shard_bytes or shard.docs >= shard_docs:
                        yield shard.batch()
                        shard = Builder()
        if shard.docs:
            yield shard.batch()

    return land(rows.mapInArrow(lean(build), INDEX), "index")


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term) for each distinct word of each query (qid, text)."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            for some in range(0, b.num_rows, 256):
                part = b.slice(some, 256)
                words = [sorted(set(_terms_of(t))) for t in part.column("text").to_pylist()]
                qids = np.repeat(part.column("qid").to_numpy(), list(map(len, words)))
                hashes = np.array([xxh64_intdigest(w, SEED) for ws in words for w in ws], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(hashes)], names=["qid", "term"])

    return queries.mapInArrow(per_batch, "qid long, term long")


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all shards."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                terms = np.frombuffer(b.column("terms")[i].as_buffer(), dtype="<i8")
                counts = _unpacked(b.column("counts")[i].as_buffer(), len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], names=["term", "df"])

    return index.select("terms", "counts").mapInArrow(per_batch, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _alike(words: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """An order of queries (``sizes`` words each, of ``n``) that puts like ones together: by their nearest
    of ``KINDS`` means of the commonest words that they have, then by their number of words; those
    with the same words come together."""
    common = np.argsort(-np.bincount(words, minlength=n), kind="stable")[:COMMON]
    column = np.full(n, -1, dtype=np.int32)
    column[common] = np.arange(len(common))
    column, query = column[words], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    has = np.zeros((len(sizes), len(common)), dtype=np.float32)
    has[query[column >= 0], column[column >= 0]] = 1
    hits = has.sum(axis=1)
    has /= np.sqrt(np.maximum(hits, 1))[:, None]
    kind = np.zeros(len(sizes), dtype=np.int64)
    # the first means: queries that have many of the words, each least like those before
    least, means = np.where(hits * 2 > np.median(hits) if len(hits) else 0, 0, 2).astype(np.float32), []
    for _ in range(KINDS if len(sizes) else 0):
        means.append(has[np.argmin(least)])
        least = np.maximum(least, has @ means[-1])
    for _ in range(KIND_ROUNDS if means else 0):
        kind = np.argmax(has @ np.array(means).T, axis=1)
        means = [has[kind == i].sum(axis=0) for i in range(KINDS)]
        means = [m / max(float(np.sqrt(m @ m)), 1e-9) for m in means]
    mixed = np.random.default_rng(SEED).integers(1 << 63, size=n, dtype=np.int64)[words] if len(words) else words
    return np.lexsort((np.add.reduceat(mixed, np.cumsum(sizes) - sizes) if len(sizes) else sizes, sizes, kind))


def _block(asked: pa.Table, n: int) -> tuple[np.ndarray, ...]:
    """(query ids, the number of each one's words, where the words of each number start, words as places
    in the vocabulary, vocabulary by hash, weights of its words) of a block of queries, like ones together."""
    lists, dfs = asked.column("terms").combine_chunks(), asked.column("dfs").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    vocabulary, first, words = np.unique(lists.flatten().to_numpy(), return_index=True, return_inverse=True)
    df = dfs.flatten().to_numpy()[first].astype(np.float64)
    order, found = _alike(words, sizes, len(vocabulary)), asked.column("qid").to_numpy()
    weights = np.log1p((n - df + 0.5) / (df + 0.5))
    sizes, first, words = sizes[order], starts[:-1][order], words.astype(np.int32)
    # of queries with the same words, which come one after the other, the first is searched for
    same = np.zeros(len(order), dtype=bool)
    like = np.flatnonzero(np.diff(sizes, prepend=-1) == 0)
    if len(like):
        equal = words[_spans(first[like], sizes[like])] == words[_spans(first[like - 1], sizes[like])]
        same[like] = np.logical_and.reduceat(equal, np.cumsum(sizes[like]) - sizes[like])
    sizes, first = sizes[~same], first[~same]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return found[order], np.cumsum(~same) - 1, starts, words[_spans(first, sizes)], vocabulary, weights


def top_k(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
          shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """For each row of ``queries`` (same columns as ``docs``) the best ``k`` documents by
    BM25 over its distinct words: query_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    index = index_documents(docs, id_col, text_col, shard_docs, shard_bytes)
    n, words = index.agg(F.sum("docs"), F.sum("words")).first()
    named = land(
        pick(queries, id=id_col, text=text_col).select(F.col("id").cast("long").alias("query_id"), "text")
        .withColumn("qid", F.monotonically_increasing_id()), "queries",
    )
    terms = query_terms(named.select("qid", "text")).join(document_frequencies(index), "term")
    asked = land(
        terms.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("t")).select(
            "qid", F.col("t.term").alias("terms"), F.col("t.df").alias("dfs")
        ), "asked",
    )
    size = asked.agg(F.sum(F.size("terms") * 16 + 32)).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    found = []
    for i in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow()  # one block: about query_bytes
        shared = spark.sparkContext.broadcast(_block(some, n))
        best = index.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(_searcher(shared, (words or 0) / max(1, n or 0), k), FOUND)
        w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        found.append(land(best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "found"))
        shared.unpersist()
    return union_all(found).join(named.select("qid", "query_id"), "qid").select("query_id", "rank", "doc_id", "score")


def every_nth(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = QUERY_EVERY) -> DataFrame:
    """The stated query set: rows whose id is divisible by ``n``."""
    return pick(docs, **{id_col: id_col, text_col: text_col}).filter(F.col(id_col) % n == 0)
