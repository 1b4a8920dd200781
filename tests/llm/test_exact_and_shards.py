"""Exact dedup, mixing and sharding against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from edge import ROWS, documents, edge_docs, empty_docs
from farewise.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from farewise.llm.mixing import mix, mixed_rows
from farewise.llm.sharding import balanced_cuts, greedy, minimax_cuts, shard, smallest_capacity


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_duplicates_match_brute_force(spark):
    rows = [tuple(r) for r in exact_duplicates(edge_docs(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    groups = {}
    for i, text, *_ in ROWS:
        groups.setdefault(normal(text), []).append(i)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, sha = min(known, default=None), hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            want[(i, keep, len(ids), i == keep and first, sha)] += 1
            first = first and i != keep
    assert Counter(rows) == want


def test_exact_duplicates_of_a_hot_group(spark):
    docs = documents(spark, [(i, "hot text" if i % 3 == 0 else f"text {i % 400}") for i in range(3000)]).repartition(16)
    got = {r["doc_id"]: r for r in exact_duplicates(docs).collect()}
    assert len(got) == 3000 and got[2997]["keep_id"] == 0 and got[2997]["group_size"] == 1000
    kept = [i for i, r in got.items() if r["kept"]]
    texts = Counter("hot text" if i % 3 == 0 else f"text {i % 400}" for i in kept)
    assert set(texts.values()) == {1} and len(texts) == len({"hot text" if i % 3 == 0 else f"text {i % 400}" for i in range(3000)})


def test_dropping_exact_duplicates_keeps_rows_whole(spark):
    docs = edge_docs(spark)
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    kept = [(r[1], r[2]) for r in out.collect()]
    texts = [normal(t) for _, t in kept]
    assert len(texts) == len(set(texts)) == len({normal(t) for _, t, *_ in ROWS})
    assert exact_duplicates(empty_docs(spark)).count() == 0 and drop_exact_duplicates(empty_docs(spark)).count() == 0


def waterfill(sizes):
    """Targets by resharing the excess until none is above three times its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, got):
    sizes, largest = Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
        largest[source] = max(largest[source], words(text))
    target = waterfill(sizes)
    taken = Counter()
    source_of = {r[0]: r[2] for r in rows}
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(1, largest[s])


def test_mix_meets_targets(spark):
    rnd = random.Random(3)
    sources = ["a", "b", "é", "z", None, ""]
    rows = [(i, " ".join(["w"] * min(400, int(rnd.paretovariate(0.9)))), "a" if i % 3 == 0 else rnd.choice(sources)) for i in range(2000)]
    got = mix(documents(spark, rows).repartition(7)).collect()
    assert len(got) == len(rows)
    check_mix(rows, got)
    again = mix(documents(spark, rows).repartition(2)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mix_edge_cases(spark):
    got = mix(edge_docs(spark)).collect()
    assert len(got) == len(ROWS) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    out = mixed_rows(edge_docs(spark))
    assert out.columns == edge_docs(spark).columns
    assert Counter(r[2] for r in out.collect()).total() == sum(r["copies"] for r in got)
    assert mix(empty_docs(spark)).count() == 0 and mixed_rows(empty_docs(spark)).count() == 0


def brute_capacity(sizes, shards):
    best = None
    for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        edges = [0, *cuts, len(sizes)]
        top = max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:]))
        best = top if best is None else min(best, top)
    return best


def test_capacity_is_the_smallest(spark):
    rnd = random.Random(5)
    for _ in range(30):
        sizes = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        prefix = np.concatenate([[0], np.cumsum(sizes)])
        capacity = smallest_capacity(prefix, 3, max(sizes))
        assert capacity == brute_capacity(sizes, 3)
        edges = [0, *balanced_cuts(prefix, capacity, 3), len(sizes)]
        assert edges == sorted(edges) and max(prefix[b] - prefix[a] for a, b in zip(edges, edges[1:])) <= capacity
        assert greedy(prefix, capacity, 3)[-1] == len(sizes)


@pytest.mark.parametrize("cells", [4, 64])
def test_cells_are_refined_to_the_exact_capacity(spark, cells):
    rnd = random.Random(cells)
    groups = sorted((rnd.randint(-(1 << 63), (1 << 63) - 1), rnd.randint(1, 50) * (40 if i == 7 else 1)) for i in range(400))
    df = spark.createDataFrame(groups, "key long, bytes long")
    cuts, capacity = minimax_cuts(df, 5, cells)
    prefix = np.concatenate([[0], np.cumsum([b for _, b in groups])])
    assert capacity == smallest_capacity(prefix, 5, max(b for _, b in groups))
    sums = Counter(sum(k >= c for c in cuts) for k, _ in groups)
    assert len(sums) <= 5
    filled = Counter()
    for k, b in groups:
        filled[sum(k >= c for c in cuts)] += b
    assert max(filled.values()) <= capacity


def test_shards_keep_groups_and_gapless_slots(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text number {i % 900} " + "x" * (i % 37)) for i in range(3000)]
    got = shard(documents(spark, rows).repartition(9)).collect()
    text = dict(rows)
    of = {}
    for r in got:
        assert of.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    filled = Counter()
    for r in got:
        filled[r["shard"]] += r["size"]
    group = Counter()
    for i, t in rows:
        group[t] += len(t.encode()) + 1
    # the order of the groups is that of their texts' hash, as signed numbers
    order = sorted(group, key=lambda t: np.uint64(xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    prefix = np.concatenate([[0], np.cumsum([group[t] for t in order])])
    assert max(filled.values()) == smallest_capacity(prefix, 16, max(group.values()))


def test_shard_edge_cases(spark):
    got = shard(edge_docs(spark)).collect()
    assert len(got) == len(ROWS) and {r["size"] for r in got if r["doc_id"] in (5, 6)} == {1}
    assert shard(empty_docs(spark)).count() == 0
