"""SimHash near-dedup: Golay-code fuzzy hashing.

Fingerprints link at ``MAX_BITS`` (4) or fewer differing bits.  A fingerprint is
cut into three segments of 22, 21 and 21 bits, each a word of the perfect binary
Golay code (23, 12), which decodes every word to one codeword.  Words within one
bit of each other share a key if one gives its own codeword and the other the
codewords of all its neighbours (six at most).

Pigeonhole: of 4 errors over three segments the two best segments have (0,0),
(0,1), (1,1) or (0,2).  The first three meet on a pair of codewords (24 bits; one
gives neighbours in the first segment, the other in the second).  (0,2) means the
third segment also has 2, so one segment is equal: it is a key itself (21 bits).
So no link is missed, and every candidate is verified by its bit distance.

Equal fingerprints are one node from the start.  Within a key, a search that
compares each found node with the not yet found ones links everything that hangs
together, and only a spanning forest leaves the task: n nodes give at most n - 1
rows.  Keys with more than ``block`` nodes are cut into blocks, and pairs of
blocks are searched by different tasks.

Defined cases: a null text counts as empty; a text without words has fingerprint
zero and links like any other; null ids are linked but never name a component
unless all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import attach, land, lean, pick, staying, text_of

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GOLAY_GENERATOR = 0b101011100011
BLOCK = 4096
HASHES_AT_ONCE = 1 << 14
ROWS_AT_ONCE = 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1].tolist()
    stops = (ends[k - 1:] - 1).tolist()
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), HASHES_AT_ONCE):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i: i + HASHES_AT_ONCE], stops[i: i + HASHES_AT_ONCE])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, hash (of the text), fp (the 64 bits as a signed long) of every row."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, ROWS_AT_ONCE) for batch in batches for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hash"), pa.array(fps.view(np.int64))], names=["id", "hash", "fp"])

    slim = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("hash"))
    return slim.mapInArrow(lean(per_batch), "id long, hash long, fp long")


@lru_cache(maxsize=1)
def golay_decoder() -> np.ndarray:
    """For each 23-bit word the number (0 to 4095) of the codeword within three bits of it."""
    codes = np.zeros(4096, dtype=np.int32)
    for i in range(12):
        codes ^= np.where(np.arange(4096) >> i & 1, GOLAY_GENERATOR << i, 0).astype(np.int32)
    table = np.empty(1 << 23, dtype=np.int16)
    bit = [1 << i for i in range(23)]
    errors = [0] + bit + [a | b for i, a in enumerate(bit) for b in bit[:i]]
    errors += [a | b | c for i, a in enumerate(bit) for j, b in enumerate(bit[:i]) for c in bit[:j]]
    for e in errors:
        table[codes ^ e] = np.arange(4096)
    return table


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all distinct keys of each fingerprint."""
    table, words, own, near = golay_decoder(), [], [], []
    for first, n in SEGMENTS:
        w = ((fps >> np.uint64(first)) & np.uint64((1 << n) - 1)).astype(np.int64)
        words.append(w)
        own.append(table[w].astype(np.int64))
        flips = np.concatenate([[0], 1 << np.arange(n)])
        near.append(table[w[:, None] ^ flips[None, :]].astype(np.int64))
    keys = []
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        keys.append((kind << 24) | (near[i] << 12) | own[j][:, None])
        keys.append((kind << 24) | (own[i][:, None] << 12) | near[j])
    keys += [((3 + i) << 24 | w)[:, None] for i, w in enumerate(words)]
    wide = np.sort(np.concatenate(keys, axis=1), axis=1)
    fresh = np.ones(wide.shape, dtype=bool)
    fresh[:, 1:] = wide[:, 1:] != wide[:, :-1]
    return np.nonzero(fresh)[0], wide[fresh]


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (node, root) of the stars of everything that hangs together by links of ``max_bits``."""
    edges, left = [], np.arange(len(fps))
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            far = np.bitwise_count(fps[left] ^ fps[front.pop()]) > max_bits
            found = left[~far]
            if len(found):
                edges.extend((int(f), int(root)) for f in found)
                front.extend(found.tolist())
                left = left[far]
    return edges


def _linker(max_bits: int):
    """Rows (key, block pair, fp) sorted by group: the spanning forest of each group's links."""

    def groups(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []
        for b in batches:
            rows = np.stack([b.column(c).to_numpy() for c in ("key", "pair", "fp")])
            new = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            for piece in np.split(rows, new, axis=1) if len(new) else [rows]:
                if held and (held[0][:2, 0] != piece[:2, 0]).any():
                    yield np.concatenate([h[2] for h in held])
                    held = []
                held.append(piece)
        if held:
            yield np.concatenate([h[2] for h in held])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

        for fps in groups(batches):
            fps = np.unique(fps)
            u = fps.view(np.uint64)
            if len(u) == 2:
                if np.bitwise_count(u[0] ^ u[1]) <= max_bits:
                    a.append(fps[1:])
                    b.append(fps[:1])
            elif len(u) > 2:
                edges = forest(u, max_bits)
                if edges:
                    at = np.array(edges)
                    a.append(fps[at[:, 0]])
                    b.append(fps[at[:, 1]])
            if len(a) > 10_000:
                yield out()
                a, b = [], []
        if a:
            yield out()

    return link


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) linked at ``max_bits``."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys guarantee links of at most {MAX_BITS} bits")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in range(0, b.num_rows, 4096):
                fps = b.column("fp").slice(some, 4096).to_numpy()
                row, key = fuzzy_keys(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "fp"])

    keyed = nodes.mapInArrow(lean(per_batch), "key long, fp long")
    big = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # block pairs (i <= j) that hold the row's own block
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.least(mine, other).cast("long") * blocks + F.greatest(mine, other),
    )
    dealt = keyed.join(big, "key", "left").select(
        "key", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("pair"), "fp"
    )
    grouped = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return grouped.mapInArrow(lean(_linker(max_bits)), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not its component's
    smallest node, by alternating large-star and small-star rounds.

    Each round keeps one row per edge at most and lands its edges, so a lost
    executor replays one round."""
    e = land(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges"
    )

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = land(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = land(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = state(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id; also
    root (the component's smallest fingerprint) and text_hash."""
    rows = land(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = land(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "nodes")
    stars = components(links(nodes.select("fp"), max_bits, block))
    named = nodes.join(stars, nodes["fp"] == stars["node"], "left").select(
        "fp", "least", "copies", F.coalesce("root", "fp").alias("root")
    )
    named = land(named, "named")
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    of_fp = attach(named.select("fp", "copies", "root"), of_root, ["root"], "members", nodes.count())
    of_fp = land(of_fp.select("fp", "copies", "root", "component_id"), "components")
    out = attach(rows, of_fp, ["fp"], "copies", rows.count())
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        "root", F.col("hash").alias("text_hash"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component, the one that names it, with all its columns.
    (Of several rows with that id, the one whose text hash is smallest.)"""
    found = near_duplicates(docs, id_col, text_col, **options)
    names_it = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = names_it.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("key"))
    return staying(docs, kept.select("doc_id", "key"), id_col, F.xxhash64(text_of(docs, text_col)))
