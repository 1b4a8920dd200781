"""Ranked search, piece encoding and hard negatives against brute force."""

import math
import random
import re
import struct
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from edge import LONG, ROWS, documents, edge_docs, empty_docs
from farewise.llm import negatives, pieces, ranked
from farewise.llm.queries import ORACLES, PIECES, QUERIES, tokenizer_path
from tables import SF_SMALL

# --- ranked search ------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked_brute(docs, queries, k=10):
    """(query, rank, doc_id, score) of rows (id, text), over all pairs."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for q, text in queries:
        found = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // words
            score = sum(weight[t] * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if score > 0:
                found.append((-score, d is not None, d, d))
        for rank, (score, _, _, d) in enumerate(sorted(found, key=lambda f: f[:2] + ((f[2],) if f[1] else (0,)))[:k], 1):
            out.append((q, rank, d, -score))
    return sorted(out, key=str)


def some_texts(n, seed, words=400):
    """Texts of words of very different frequency, some of them equal."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    shares = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(rnd.choices(vocabulary, shares, k=rnd.randint(0, 60))) for _ in range(n)]
    return texts[: n - n // 10] + texts[: n // 10]


@pytest.mark.parametrize("shard_bytes", [1 << 10, 1 << 24])
def test_ranked_search_is_brute_force(spark, shard_bytes):
    docs = [(i if i % 37 else None, t) for i, t in enumerate(some_texts(1500, 1))]
    queries = [(100 + i, t + " w0 w0 unknown") for i, t in enumerate(some_texts(20, 2))] + [(None, "w3 w300"), (7, None), (7, "w5"), (7, "w5")]
    table = documents(spark, docs).repartition(4)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = ranked.search(table, asked, shard_bytes=shard_bytes, query_bytes=1000).collect()
    assert sorted(map(tuple, got), key=str) == ranked_brute(docs, queries)


def test_ranked_search_of_edge_rows(spark):
    queries = [(1, "the SAME text"), (2, LONG), (3, "été ½"), (4, "License-Version"), (5, "")]
    asked = spark.createDataFrame([(*q, "x") for q in queries], "item_id long, text string, Item_ID string")
    want = ranked_brute([(r[0], r[1]) for r in ROWS], queries)
    assert sorted(map(tuple, ranked.search(edge_docs(spark), asked).collect()), key=str) == want
    assert ranked.search(empty_docs(spark), asked).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert ranked.search(edge_docs(spark), nothing).collect() == []


def test_long_lists_are_skipped():
    """Once ten good documents are known, most of the long lists is not read."""
    texts = [b"w0 w1 w2 rare words"] * 12 + [t.encode() for t in some_texts(20_000, 3)]
    shard = ranked.Builder()
    shard.add(np.arange(len(texts)), texts)
    asked = [b"rare", b"w0", b"w1", b"w2", b"words"]
    row = shard.row()
    opened = ranked.Shard(ranked._index_batch(row), 0, pa.array(asked, pa.binary()), row["docs"], row["words"])
    dfs = [sum(1 for t in texts if w in t.split()) for w in asked]
    query = [(i, ranked.weight(row["docs"], df)) for i, df in enumerate(dfs)]
    nothing = np.empty(0, dtype=np.int64)
    least, best, read = opened.search(query, 10, 0, (nothing, nothing))
    assert sorted(best[0]) == list(range(10)) and least == best[1].min()
    assert read < sum(dfs) / 5
    # the same answer when nothing can be skipped
    full = np.zeros(len(texts), dtype=np.int64)
    for t, weight in query:
        docs, part, _, _ = opened.list_of(opened.place[t])
        full[docs] += part * weight
    order = np.lexsort((np.arange(len(texts)), -full))[:10]
    assert dict(zip(best[0], best[1])) == dict(zip(order, full[order]))


# --- pieces -------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return pieces.Encoder(tokenizer_path(PIECES))


def library_ids(coder, text):
    return coder.library.encode(text or "", add_bos=True, add_eos=True)


def ids_of(packed):
    return [i for (i,) in struct.iter_unpack("<I", packed)]


@pytest.mark.parametrize("text", [
    None, "", " ", "  ", "\n", "a\0b", "▁x", "<s>", "</s><unk>", "<0x41>", "a  b ", " x", "日本語テスト", "𝒳😀é", "�", "İıſK", LONG,
    " " * 5000, "a" * 5000, "ab" * 3000, "the" * 3000, "=" * 3000, "\n" * 300, "▁" * 40 + "the", "été" * 999, "日" * 999,
])
def test_pieces_are_those_of_the_library(coder, text):
    packed = coder.encode(text)
    assert ids_of(packed) == library_ids(coder, text)
    assert coder.decode(packed) == coder.library.decode(library_ids(coder, text))


def test_pieces_of_random_texts(coder):
    rnd = random.Random(5)
    known = list(coder.packed)
    letters = "abcdefgh ▁\n.,'ABC012éßñ日本語́😀\0\t"
    for i in range(6000):
        if i % 3 == 0:
            text = "".join(rnd.choices(known, k=rnd.randint(1, 9))).replace("▁", " ")
        elif i % 3 == 1:
            text = "".join(rnd.choices(letters, k=rnd.randint(0, 30)))
        else:
            text = "".join(rnd.choices("the an in er on re".split(" "), k=rnd.randint(1, 40)))
        assert ids_of(coder.encode(text)) == library_ids(coder, text), text
        for s in coder.segments(coder.library.normalize(text)) if text else []:
            assert coder.pieces(s) == coder.merges.merge(s)


def test_backtracking_takes_back_what_cannot_go_on():
    """Longest first would take "abc", which nothing can follow."""
    merges = pieces.Merges({"bcd": -1, "cd": -0.5, "abc": -3, "ab": -2, "a": 0, "b": 0, "c": 0, "d": 0})
    assert merges.merge("abcd") == ["a", "bcd"] and "abc" in merges.reached
    assert merges.adjacent("a", "bcd") and not merges.adjacent("abc", "d") and not merges.adjacent("ab", "cd")


def test_caches_do_not_change_ids(coder, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED", 3)
    monkeypatch.setattr(pieces, "FITS", 3)
    for text in ("one two three four five six one two", "seven eight nine ten one two three"):
        assert ids_of(coder.encode(text)) == library_ids(coder, text)


def test_piece_query_of_edge_rows(spark, coder):
    got = pieces.piece_digests(edge_docs(spark), tokenizer_path(PIECES)).collect()
    want = []
    for row in ROWS:
        ids = library_ids(coder, row[1])
        want.append((row[0], len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     sha256(coder.library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pieces.piece_digests(empty_docs(spark), tokenizer_path(PIECES)).collect() == []
    whole = pieces.encode_documents(edge_docs(spark), tokenizer_path(PIECES)).collect()
    assert sorted((str(r[0]), ids_of(r[1]), r[2]) for r in whole) == sorted(
        (str(r[0]), library_ids(coder, r[1]), coder.library.decode(library_ids(coder, r[1]))) for r in ROWS)


# --- hard negatives -----------------------------------------------------------


def mined_brute(rows):
    taking = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taking.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(taking):
        if i % 100:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), j, other) for b, (j, w, other) in enumerate(taking) if b != a]
        by = sorted(scores, key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in by if s[2] == label][:5]:
            inside = [s for s in by if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:10]
            out.extend((i, j, r, n, p, s) for r, (s, n, _) in enumerate(inside, 1))
    return sorted(out)


VECTORS = T.StructType([
    T.StructField("VEC_ID", T.StringType()), T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("row", T.StringType()), T.StructField("v", T.StringType()),
])


def vectors(spark, rows):
    return spark.createDataFrame([("x", *r, "y", "z") for r in rows], VECTORS).repartition(3)


def some_vectors(n, seed, width=12, scale=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(4, width))
    return [(i, (scale * (centres[i % 4] + rnd.normal(size=width))).astype(np.float32).tolist(), int(rnd.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize(("scale", "block_bytes"), [(1.0, 1 << 23), (1.0, 600), (3000.0, 1 << 23)])
def test_hard_negatives_are_brute_force(spark, scale, block_bytes):
    rows = some_vectors(520, 4, scale=scale)
    rows += [
        (100, rows[100][1], rows[100][2]), (100, rows[100][1], rows[100][2]),  # repeated rows, an anchor among them
        (3, rows[4][1], 2), (900, None, 1), (800, rows[1][1], None), (None, rows[1][1], 1), (901, [None] * 12, 1),
        (1000, [float("nan")] * 12, 1), (1100, [float("inf")] * 12, 1), (1200, [], 1), (1300, [2.0, -1.0], 1),
        (1400, [0.0] * 12, 2), (1500, [1.0] * 15, 9),
    ]
    got = negatives.hard_negatives(vectors(spark, rows), block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got)) == mined_brute(rows)


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(vectors(spark, [])).collect() == []
    assert negatives.hard_negatives(vectors(spark, [(100, [1.0], 1)])).collect() == []
    with pytest.raises(ValueError, match="64-bit"):
        negatives.hard_negatives(vectors(spark, [(100, [1e12], 1)]))


@pytest.mark.parametrize("bound", [1, 100, 70_000, 1 << 40, (1 << 62) // 100])
def test_residues_give_exact_signed_products(bound):
    rnd = np.random.default_rng(7)
    primes = negatives.primes_for(bound)
    assert len(set(primes)) == len(primes) and math.prod(primes) > 2 * bound and math.prod(primes) < 1 << 63
    width = 3000  # over several float32 sums
    top = max(1, math.isqrt(bound // width))
    a, b = (rnd.integers(-top, top + 1, size=(5, width)) for _ in range(2))
    a[0], b[0], b[1] = top, top, -top
    if top * top * width <= bound:
        got = negatives.gemm(negatives.residues(a, primes), negatives.residues(b, primes), primes)
        assert got.tolist() == [[int(sum(int(x) * int(y) for x, y in zip(r, c))) for c in b] for r in a]


@pytest.mark.parametrize("name", ["op11_ranked", "op13_negatives"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    cursor = con.execute(ORACLES[name])
    columns, want = [c[0] for c in cursor.description], cursor.fetchall()
    got = QUERIES[name](spark, SF_SMALL)
    assert got.columns == columns
    rows = defaultdict(int, Counter(map(tuple, got.collect())))
    assert rows == Counter(want)
