"""SimHash near-dedup and packing against brute force and round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from edge import ROWS, documents, edge_docs, empty_docs
from farewise.llm.packing import Encoder, best_fit, pack_documents, pack_pieces, spans
from farewise.llm.simhash import components, drop_near_duplicates, fingerprint, fuzzy_keys, golay_decoder, links, near_duplicates

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_fingerprint(text, k=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))]
    if not words:
        return 0
    shingles = [" ".join(words[i: i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, bits):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_match_their_definition():
    texts = [r[1] for r in ROWS] + ["One two THREE four five\x0bsix Été É", "a b c", "a\x1cb c\x85d e f"]
    assert [fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_golay_decoder_is_perfect():
    table = golay_decoder()
    assert np.bincount(table, minlength=4096).tolist() == [2048] * 4096


def test_all_fingerprints_within_four_bits_share_a_key():
    rnd = random.Random(1)
    for bits in range(5):
        a = np.array([rnd.getrandbits(64) for _ in range(300)], dtype=np.uint64)
        flips = [sum(1 << b for b in rnd.sample(range(64), bits)) for _ in a]
        b = a ^ np.array(flips, dtype=np.uint64)
        keys = []
        for x in (a, b):
            row, key = fuzzy_keys(x)
            keys.append([set(key[row == i].tolist()) for i in range(len(x))])
        assert all(p & q for p, q in zip(*keys))


def _clustered(n, seed):
    rnd = random.Random(seed)
    nodes = {rnd.getrandbits(64) for _ in range(n // 2)}
    hub = rnd.getrandbits(64)
    nodes |= {hub ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(n // 4)}
    some = list(nodes)
    nodes |= {x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6))) for x in rnd.sample(some, n // 4)}
    return sorted(nodes)


def test_links_give_the_components_of_all_pairs(spark):
    for block in (4096, 16):  # 16: hot keys are cut into blocks
        nodes = _clustered(500, block)
        signed = [int(np.uint64(x).astype(np.int64)) for x in nodes]
        df = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(5)
        edges = links(df, block=block)
        assert edges.count() < 40 * len(nodes)
        root = {s: s for s in signed} | {r["node"]: r["root"] for r in components(edges).collect()}
        want = brute_components(nodes, 4)
        got = {}
        for x, s in zip(nodes, signed):
            got.setdefault(root[s], set()).add(x)
        expected = {}
        for x, r in want.items():
            expected.setdefault(r, set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates_of_documents(spark):
    rnd = random.Random(2)
    base = [" ".join(f"w{rnd.randint(0, 500)}" for _ in range(300)) for _ in range(12)]
    rows = [(i, base[i % 12]) for i in range(30)]
    rows += [(100 + i, base[i % 12].replace(base[i % 12].split()[i], "changed", 1)) for i in range(12)]
    got = {r["doc_id"]: r for r in near_duplicates(documents(spark, rows)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    root = brute_components(sorted(set(fps.values())), 4)
    for i, _ in rows:
        assert got[i]["fingerprint"] == f"{fps[i]:016x}"
        assert got[i]["component_id"] == min(j for j, _ in rows if root[fps[j]] == root[fps[i]])
    out = drop_near_duplicates(documents(spark, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({r["component_id"] for r in got.values()})


def test_near_duplicate_edge_cases(spark):
    docs = edge_docs(spark)
    got = near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (5, 6, 40)} == {"0" * 16}
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6, 40)} == {5}
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns and out.count() == len({(r["root"]) for r in got})
    assert near_duplicates(empty_docs(spark)).count() == 0 and drop_near_duplicates(empty_docs(spark)).count() == 0


def test_ids_equal_those_of_whole_texts(spark):
    t = Tokenizer.from_file(PATH)  # as loaded: the strings of special tokens are those tokens
    rnd = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "word", "Été", "don't", "½", "x²", ".", ",", " ", " ", "\x1c", "\x85", "<|endoftext|>", "1a", "'s", "\r\n", "🙂"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(3000)] + [r[1] or "" for r in ROWS]
    e = Encoder(PATH, cache_spans=50)
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in e.encode_all(texts)]
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert " ".join(spans("a b  c")) == "a b  c"


def test_ids_of_a_batch_come_from_one_lookup():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["", " ", "a", "end. of\nline, (x)\ny!! z\n", "\n", "a\n\nb c\n d", "tail\n.", "...", "don't, it's; \u00e9t\u00e9! \u4f60\u597d, 12.5%", "x\r\ny.\tz?"]
    texts = odd + [" ".join(f"{w}{i % 97}{s}" for i in range(60_000)) for w, s in (("w", ""), ("v", "."), ("u", "\nq"))]
    texts += [t + " " + t for t in odd] + ["ab, " * 1_100_000]
    assert (1 << 22) < sum(map(len, texts)) < (1 << 23)
    encoder, asked = Encoder(path), []
    plain = encoder.encode
    encoder.encode = lambda some: asked.append(len(some)) or plain(some)
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in encoder.encode_all(texts)]
    assert asked == [len(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_fills_bins():
    rnd = np.random.default_rng(1)
    lengths = rnd.integers(1, 1024, 5000)
    bins, offsets, fills = best_fit(lengths, 1024)
    assert fills.max() <= 1024 and np.bincount(bins, lengths).astype(int).tolist() == fills.tolist()
    assert len(fills) <= 1.01 * lengths.sum() / 1024 + 1
    for b in range(len(fills)):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert offsets[mine].tolist() == np.concatenate([[0], np.cumsum(lengths[mine])[:-1]]).tolist()


def test_rounds_merge_underfull_bins(spark):
    rnd = np.random.default_rng(2)
    lengths = rnd.integers(1, 700, 4000).tolist()
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long").repartition(24)
    rows = pack_pieces(items, items_per_task=500).collect()
    check_gapless([(r["sequence_id"], r["offset"], lengths[r["item"]]) for r in rows], 4000)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * sum(lengths) / 1024 + 1


def check_gapless(placed, n):
    assert len(placed) == n
    sequences = {}
    for s, o, length in placed:
        sequences.setdefault(s, []).append((o, length))
    for parts in sequences.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 1024


def test_packing_documents(spark):
    t = Tokenizer.from_file(PATH)  # as loaded: the strings of special tokens are those tokens
    docs = edge_docs(spark)
    rows = pack_documents(docs, PATH, with_ids=True).collect()
    check_gapless([(r["sequence_id"], r["offset"], r["length"]) for r in rows], len(rows))
    whole = {}
    for i, text, *_ in ROWS:
        whole.setdefault(i, []).append(t.encode(text or "", add_special_tokens=False).ids + [2])
    by_doc = {}
    for r in rows:
        ids = list(r["ids"])
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        by_doc.setdefault(r["doc_id"], {}).setdefault(r["piece"], []).append((r["start"], ids))
    for i, texts in whole.items():
        pieces = by_doc[i]
        assert all(len(p) == len(texts) for p in pieces.values())
        got = [x for k in sorted(pieces) for x in pieces[k][0][1]]
        assert got == texts[0]
        starts = [pieces[k][0][0] for k in sorted(pieces)]
        lengths = [len(pieces[k][0][1]) for k in sorted(pieces)]
        assert starts == np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int).tolist() and set(lengths[1:]) <= {1024}
    assert pack_documents(empty_docs(spark), PATH).count() == 0


def test_tasks_give_back_memory_when_they_end(monkeypatch):
    from farewise.llm import common

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    twice = common.lean(lambda batches: (2 * b for b in batches))
    assert list(twice(iter([1, 2, 3]))) == [2, 4, 6] and given == [1]
    some = twice(iter([1, 2, 3]))  # also where rows are not read to the end
    assert next(some) == 2 and given == [1]
    some.close()
    assert given == [1, 1]


def test_text_at_once_bounds_what_is_tokenized_together(spark):
    texts = [f"word{i} and, more words\nof text {i}" for i in range(60)]
    whole, few, seen = Encoder(PATH), Encoder(PATH, text_at_once=100), []
    encode = few.encode
    few.encode = lambda held: seen.append(sum(map(len, held))) or encode(held)
    assert list(few.encode_all(texts)) == list(whole.encode_all(texts))
    assert len(seen) > 10 and max(seen) < 100 + max(map(len, texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda **options: sorted(map(tuple, pack_documents(docs, PATH, **options).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert rows(text_at_once=100) == rows()
