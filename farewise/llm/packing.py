"""Best-fit packing: hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens.  Every partition packs
its pieces best-fit, longest first.  Bins filled to within ``slack`` of the
capacity are done; an underfull bin goes on to the next round as one item of its
fill.  Rounds merge ``FAN_IN`` partitions into one and pack again, up to one
partition, or to as many as keep a task at ``items_per_task`` items; rounds end
there, or when they no longer save bins.  A piece's place is the chain of bins it
went through.

Defined cases: a null text is an empty one; an empty text is one piece holding
the end token alone; repeated rows are pieces of their own; an empty table gives
an empty result.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import give_back, land, lean, pick

CAPACITY = 1024
END_ID = 2
SLACK = 4
FAN_IN = 8
ITEMS_PER_TASK = 200_000
# Distinct spans of text whose ids a Python worker keeps in a generation.
CACHE_SPANS = 400_000
# Signs that end a word: neither letters, digits nor white space, as the pre-tokenizer has it.
STOPS = string.punctuation
ENCODE_AT_ONCE = 20_000
# Characters of text that are cut into spans at once (a longer text is taken alone),
# and rows that are taken out of an Arrow batch at once.
TEXT_AT_ONCE = 1 << 23
ROWS_AT_ONCE = 2048

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    give_back()  # what reading the file took
    return found


_SPACED = re.compile(r"\s ")
_SOLID = re.compile(r"\S+\Z").match
_SPLIT = re.compile(r"(?<=\S) ")


def spans(text: str) -> list[str]:
    """``text`` cut at each space that follows a non-space; the space belongs to the
    span after it and is left out.

    A byte-level pre-tokenizer never joins a non-space with a space after it, and
    looks ahead only from white space; every span ends in a non-space (or ends
    the text), so the ids of a text are those of its spans one after another."""
    return text.split(" ") if not _SPACED.search(text) and text[:1] != " " else _SPLIT.split(text)


def _spans_of(texts: list[str]) -> pa.ListArray:
    """``spans`` of every text; Arrow cuts those whose spaces all follow a non-space."""
    odd = [i for i, t in enumerate(texts) if t[:1] == " " or _SPACED.search(t)]
    if not odd:
        return pc.split_pattern(pa.array(texts, pa.string()), " ")
    plain = pc.split_pattern(pa.array(["" if o else t for t, o in zip(texts, _marks(odd, len(texts)))], pa.string()), " ")
    other = pa.array([spans(texts[i]) for i in odd], pa.list_(pa.string()))
    place = np.arange(len(texts))
    place[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([plain, other]).take(pa.array(place))


def _strings(texts: pa.Array) -> list[str]:
    """``to_pylist`` by way of numpy, which makes no scalar of each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def _marks(at: list[int], n: int) -> list[bool]:
    out = np.zeros(n, dtype=bool)
    out[at] = True
    return out.tolist()


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Keeps the ids of spans in two generations: when the young one is full it becomes
    the old one, and what is used again moves back.  A word of letters and the signs
    after it are pre-tokens of their own, so words are kept without them.  Words not seen
    before, one pre-token each, are tokenized in rows of ``ENCODE_AT_ONCE``."""

    def __init__(self, path: str, cache_spans: int = CACHE_SPANS, text_at_once: int = TEXT_AT_ONCE):
        self.tokenizer, self.most, self.text_at_once = _tokenizer(path), cache_spans, text_at_once
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {}  # runs of signs
        self.heads: dict[str, bytes] = {}  # beginnings of lines, with the break before them

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), ENCODE_AT_ONCE):
            for e in self.tokenizer.encode_batch_fast(texts[i: i + ENCODE_AT_ONCE], add_special_tokens=False):
                yield np.array(e.ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words of letters, each with a space before it."""
        for i in range(0, len(words), ENCODE_AT_ONCE):
            some = words[i: i + ENCODE_AT_ONCE]
            e = self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False)
            data = np.array(e.ids, dtype="<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(len(some)), side="right")).tolist()
            yield from (data[a:b] for a, b in zip([0, *ends], ends))

    def _learn(self, missing: set[str]) -> None:
        """Bring the ids of ``missing`` spans into the young generation."""
        young, old, plain, other = self.young, self.old, [], []
        for s in missing:
            ids = old.get(s)
            if ids is not None:
                young[s] = ids
            else:
                (plain if s.isalpha() else other).append(s)
        young.update(zip(plain, self._words(plain)))
        young.update(zip(other, self._ids([" " + s for s in other])))

    def _known(self, names: pa.Array) -> list[bytes]:
        """The ids of spans, each with a space before it."""
        # a line break between non-spaces is a pre-token of its own: what follows is known by itself
        broken = np.flatnonzero(pc.match_substring(names, "\n").to_numpy(zero_copy_only=False))
        lines = {i: parts for i, s in zip(broken.tolist(), _strings(names.take(pa.array(broken)))) if all(map(_SOLID, parts := s.split("\n")))}
        if lines:
            return self._with_lines(names, lines)
        keys = _strings(names)
        words = pc.utf8_rtrim(names, characters=STOPS)
        shorter = np.flatnonzero(pc.not_equal(pc.binary_length(words), pc.binary_length(names)).to_numpy(zero_copy_only=False))
        ended = [(i, w) for i, w in zip(shorter.tolist(), _strings(words.take(pa.array(shorter)))) if w.isalpha()]
        tails = [keys[i][len(w):] for i, w in ended]
        for i, w in ended:
            keys[i] = w
        get = self.young.get
        known = list(map(get, keys))
        missing = {s for s, ids in zip(keys, known) if ids is None}
        if missing:
            self._learn(missing)
            known = [get(s) if ids is None else ids for s, ids in zip(keys, known)]
        new = list({t for t in tails if t not in self.stops})
        self.stops.update(zip(new, self._ids(new)))
        for (i, _), t in zip(ended, tails):
            known[i] += self.stops[t]
        return known

    def _with_lines(self, names: pa.Array, lines: dict[int, list[str]]) -> list[bytes]:
        place = np.arange(len(names))
        place[list(lines)] = len(names) + np.arange(len(lines))
        begun = pa.array([parts[0] for parts in lines.values()], pa.string())
        known = self._known(pa.concat_arrays([names, begun]).take(pa.array(place)))
        heads = list({p for parts in lines.values() for p in parts[1:] if p not in self.heads})
        self.heads.update(zip(heads, self._ids(["\n" + p for p in heads])))
        for i, parts in lines.items():
            known[i] = b"".join([known[i], *[self.heads[p] for p in parts[1:]]])
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > self.most:
            self.old, self.young, self.stops, self.heads = self.young, {}, {}, {}
        cut = _spans_of(texts)
        sizes = np.diff(cut.offsets.to_numpy())
        heads = np.cumsum(sizes) - sizes  # a text's first span has no space before it
        coded = cut.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy().copy(), coded.dictionary
        first = list(self._ids(_strings(coded.dictionary.take(pa.array(codes[heads])))))
        codes[heads] = len(names) + np.arange(len(texts))
        # every distinct span is looked up once, then all ids are laid out together
        known = self._known(names) + first
        lengths = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        values = np.frombuffer(b"".join(known), dtype="<u4")
        each = lengths[codes]
        ends = np.cumsum(each)
        begins = np.cumsum(lengths) - lengths
        out = values[np.repeat(begins[codes] - (ends - each), each) + np.arange(int(each.sum()))]
        cuts = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(sizes)]]).tolist()
        return [out[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        held, n = [], 0
        for t in texts:
            held.append(t)
            n += len(t)
            if n >= self.text_at_once:
                yield from self.encode(held)
                held, n = [], 0
        if held:
            yield from self.encode(held)


@lru_cache(maxsize=1)
def _encoder(path: str, cache_spans: int, text_at_once: int) -> Encoder:
    return Encoder(path, cache_spans, text_at_once)


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only the first may be short."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache_spans: int = CACHE_SPANS,
           text_at_once: int = TEXT_AT_ONCE) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, with ``with_ids``, the ids.
    ``cache_spans`` and ``text_at_once`` only trade a Python worker's memory for time."""
    end = int(end_id).to_bytes(4, "little")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, cache_spans, text_at_once)
        for b in (batch.slice(i, ROWS_AT_ONCE) for batch in batches for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
            rows: list[list] = [[] for _ in range(5)]
            parts: list[bytes] = []
            ids, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
            for doc, data in zip(ids, encoder.encode_all([t or "" for t in texts])):
                data += end
                for k, (start, n) in enumerate(_cut(len(data) // 4, capacity)):
                    part = data[4 * start: 4 * (start + n)]
                    for column, value in zip(rows, (doc, k, start, n, zlib.crc32(part))):
                        column.append(value)
                    if with_ids:
                        parts.append(part)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(rows, types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                data = np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(rows[3])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(data)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    slim = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return slim.mapInArrow(lean(per_batch), PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every item and the fill of every bin: longest items first,
    each into the open bin with the least room that still holds it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fills = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in order.tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if room > n:
            open_bins[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fills, dtype=np.int64)


def _packer(level: int, capacity: int, items_per_task: int):
    """(item, length) rows of a partition to (item, bin, offset, fill), fill being the bin's in the end."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def flush(held):
            nonlocal made
            table = pa.Table.from_batches(held)
            bins, offsets, fills = best_fit(table.column("length").to_numpy(), capacity)
            ids = (np.int64(level) << 56) | (np.int64(part) << 32) | (bins + made)
            made += len(fills)
            yield pa.RecordBatch.from_arrays(
                [table.column("item").combine_chunks(), pa.array(ids), pa.array(offsets), pa.array(fills[bins])],
                names=["item", "bin", "offset", "fill"],
            )

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= items_per_task:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return pack


def pack_pieces(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK,
                items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``items`` (item long, length long) packed: item, sequence_id, offset."""
    schema = "item long, bin long, offset long, fill long"
    width, levels, count = None, [], None
    while True:
        level = len(levels)
        packed = land(items.mapInArrow(lean(_packer(level, capacity, items_per_task)), schema), "packed")
        levels.append(packed)
        # an underfull bin is the item of the next round: its first member stands for it
        rest = packed.filter((F.col("offset") == 0) & (F.col("fill") < capacity - slack))
        n = rest.count()
        if width == 1 or n <= 1 or (width and count and n > 0.999 * count and -(-n // items_per_task) >= width):
            break
        width = max(1, (width or max(2, packed.rdd.getNumPartitions())) // FAN_IN, -(-n // items_per_task))
        count = n
        items = rest.select(F.col("bin").alias("item"), F.col("fill").alias("length")).repartition(width, "item")
    placed = levels[-1].select("item", F.col("bin").alias("sequence_id"), "offset")
    for packed in reversed(levels[:-1]):
        up = placed.select(F.col("item").alias("_bin"), "sequence_id", F.col("offset").alias("_before"))
        placed = packed.join(up, packed["bin"] == up["_bin"], "left").select(
            "item", F.coalesce("sequence_id", "bin").alias("sequence_id"),
            (F.col("offset") + F.coalesce("_before", F.lit(0))).alias("offset"),
        )
    return placed


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK,
                   items_per_task: int = ITEMS_PER_TASK, with_ids: bool = False, cache_spans: int = CACHE_SPANS,
                   text_at_once: int = TEXT_AT_ONCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    cut = pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids, cache_spans, text_at_once)
    landed = land(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == capacity
    # a full piece is a sequence by itself; the others are packed (ids below 0 are never given to bins)
    placed = pack_pieces(landed.filter(~full).select("item", "length"), capacity, slack, items_per_task)
    alone = landed.filter(full).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    return landed.filter(~full).join(placed, "item").unionByName(alone).drop("item")
