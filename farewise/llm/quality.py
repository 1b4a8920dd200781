"""Quality classifier: co-training of two views.

The content view sees a text's byte trigrams (hashed) and how much its words
repeat.  The metadata view sees language, source, stated length and the page's
character and line statistics.  Both are logistic models.

Rounds: each view scores all documents outside the labelled sample and hands the
``share`` of them that it is surest of, of both classes and of every source and
language, to the other view's training set.  A row's place in the rounds follows
from its own views and the models and limits of the rounds before, so nothing is
joined.  The views are made once and landed in little space; those of the rows handed
over are fitted on in Spark, by gradient sums.  A third of the labelled sample is never
trained on; on it the views are calibrated and combined by a logistic model of their two
margins.  Every document is then scored.

Only the labelled sample is bounded: at most ``labelled`` rows, chosen by a hash of
the id.  Labels beyond it are not used; their documents count as unlabelled.

Defined cases: null or empty text, language, source and length are values of
their own; labels that are null, or name no document, are ignored; with a single
class among the labels (or none) every document scores that class (or 1);
repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewise.llm.common import give_back, land, lean, parts, pick, position, union_all

LABELLED = 2400
ROUNDS = 3
SHARE = 1 / 16  # of a source and language, handed over by a view in a round
THRESHOLD = 0.5
CONTENT_SLOTS = 1 << 12
METADATA_SLOTS = 1 << 10
SEED = 29
EPOCHS = 80
MORE_EPOCHS = 20  # of each round, from where the last one ended
STRATA = 1 << 16  # hash values of (source, language)
ROWS_AT_ONCE = 256  # rows whose views are in memory together
SURE = 1.0  # a view of a lesser margin has no opinion to hand over
STEPS, TOP = 8, 255  # limits lie in steps of a margin; the last step is open

SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("p_content", "p_metadata", "score")])


@lru_cache(maxsize=1 << 14)
def _slot(name: str, slots: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % slots


def _bin(x: float, steps: int = 12) -> int:
    return min(steps, int(x * steps))


def _grams(text: str | None) -> tuple[np.ndarray, np.ndarray, int, list[int]]:
    """Hashed byte trigrams: their places, counts and number, and the places of the marks for repetition."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 1, [_slot("empty", CONTENT_SLOTS)]
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    b = np.concatenate([np.full(2, 10, dtype=np.uint32), b])
    grams = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.bincount(grams, minlength=CONTENT_SLOTS)
    at = np.flatnonzero(counts)
    n = len(words)
    twice = sum(map(eq, words, words[1:])) / n
    fresh = len(set(words)) / n
    marks = (f"twice {_bin(twice)}", f"fresh {n.bit_length()} {_bin(fresh)}")
    return at, counts[at], len(grams), [_slot(m, CONTENT_SLOTS) for m in marks]


def content_view(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams; marks for repetition."""
    at, counts, n, marks = _grams(text)
    out = np.zeros(CONTENT_SLOTS, dtype=np.float32)
    out[at] += np.sqrt(counts / n)
    for m in marks:
        out[m] += 1
    return out


def _marks(text: str | None, lang: str | None, source: str | None, n_chars: float | None) -> list[int]:
    """The places of one mark each for language, source, stated length, and statistics of characters and lines."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    by = (np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) / n).tolist()
    lines = data.count(b"\n") + 1
    marks = [
        f"lang {lang!r}", f"source {source!r}", f"length {None if n_chars is None else int(n_chars).bit_length()}",
        f"line {(n // lines).bit_length()}", f"lines {lines.bit_length()}",
        f"upper {_bin(sum(by[65:91]))}", f"lower {_bin(sum(by[97:123]))}", f"digit {_bin(sum(by[48:58]), 40)}",
        f"sign {_bin(sum(by[33:48]) + sum(by[58:65]) + sum(by[91:97]) + sum(by[123:127]), 40)}",
        f"space {_bin(by[32] + sum(by[9:14]), 20)}", *(f"has {c} {_bin(by[ord(c)], 100)}" for c in "!#$%&*|"),
    ]
    return [_slot(m, METADATA_SLOTS) for m in marks]


def metadata_view(text: str | None, lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """The metadata marks as a vector."""
    out = np.zeros(METADATA_SLOTS, dtype=np.float32)
    for m in _marks(text, lang, source, n_chars):
        out[m] += 1
    return out


@dataclass
class Logistic:
    """A logistic model's margin."""

    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


class Adagrad:
    """Logistic regression by full-batch Adagrad, which can go on with more rows; both classes weigh the same."""

    def __init__(self, x: np.ndarray, y: np.ndarray, decay: float = 1e-4):
        self.x, self.y, self.decay = x, y, decay
        self.w, self.b = np.zeros(x.shape[1], dtype=np.float32), 0.0
        self.seen_w, self.seen_b = np.full(x.shape[1], 1e-8), 1e-8

    def weigh(self, more: tuple[int, int] = (0, 0)) -> tuple[float, float]:
        """A row's weight by class, with so many rows of each class besides the own ones."""
        return tuple(0.5 / max(1, int((self.y == c).sum()) + more[c]) for c in (0, 1))

    def step(self, each: tuple[float, float], gradient: np.ndarray | None = None) -> None:
        """One epoch; ``gradient``: that of other rows (last: bias)."""
        err = (1 / (1 + np.exp(-np.clip(self.x @ self.w + self.b, -30, 30))) - self.y) * np.where(self.y == 1, each[1], each[0])
        gw, gb = err.astype(np.float32) @ self.x + self.decay * self.w, float(err.sum())
        if gradient is not None:
            gw, gb = gw + gradient[:-1], gb + float(gradient[-1])
        self.seen_w += gw * gw
        self.seen_b += gb * gb
        self.w -= (0.5 * gw / np.sqrt(self.seen_w)).astype(np.float32)
        self.b -= 0.5 * gb / np.sqrt(self.seen_b)

    def model(self) -> Logistic:
        return Logistic(self.w.copy(), float(self.b))


def _platt(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients (last: bias) of a lightly regularised logistic model of the columns of ``x``, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    c = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(c))
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * c)
        c = c + step
        if np.abs(step).max() < 1e-6:
            break
    return c


@dataclass
class CoTrained:
    """The two views, their calibrations and their combination; or a constant."""

    content: Logistic | None
    metadata: Logistic | None
    calibrations: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    constant: float = 1.0

    def score(self, text, lang, source, n_chars) -> tuple[float, float, float]:
        if self.content is None:
            return (self.constant,) * 3
        a = float(self.content.margin(content_view(text)))
        b = float(self.metadata.margin(metadata_view(text, lang, source, n_chars)))
        ca, cb, both = self.calibrations
        margins = (ca[0] * a + ca[1], cb[0] * b + cb[1], both[0] * a + both[1] * b + both[2])
        return tuple(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))) for z in margins)


ENTRY = np.dtype([("at", "<u2"), ("value", "<f4")])


def _pack(x: np.ndarray) -> bytes:
    """A sparse vector: place and value of each entry."""
    at = np.flatnonzero(x)
    out = np.empty(len(at), dtype=ENTRY)
    out["at"], out["value"] = at, x[at]
    return out.tobytes()


def _unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of all entries of sparse vectors."""
    entries = np.frombuffer(b"".join(packed), dtype=ENTRY)
    row = np.repeat(np.arange(len(packed)), [len(b) // ENTRY.itemsize for b in packed])
    return row, entries["at"].astype(np.int64), entries["value"].astype(np.float32)


def _dense(packed: bytes, slots: int) -> np.ndarray:
    out = np.zeros(slots, dtype=np.float32)
    _, at, values = _unpack([packed])
    out[at] = values
    return out


def _vectors(rows: DataFrame) -> list[Row]:
    """id, y and both views' vectors, made in the tasks; of rows with one id the one whose hash is least."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, metadata = [], []
            for text, lang, source, n_chars in zip(*(b.column(n).to_pylist() for n in ("text", "lang", "source", "n_chars"))):
                n_chars = None if n_chars is None or n_chars != n_chars else n_chars
                content.append(_pack(content_view(text)))
                metadata.append(_pack(metadata_view(text, lang, source, n_chars)))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("y"), b.column("h"), pa.array(content, pa.binary()), pa.array(metadata, pa.binary())],
                names=["id", "y", "h", "content", "metadata"],
            )

    slim = rows.select(
        "id", F.col("y").cast("int").alias("y"), F.xxhash64("text", "lang", "source", "n_chars").alias("h"),
        F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double"),
    )
    kinds = T.StructType([*slim.schema.fields[:3], T.StructField("content", T.BinaryType()), T.StructField("metadata", T.BinaryType())])
    one = slim.mapInArrow(lean(per_batch), kinds).groupBy("id").agg(F.min(F.struct("h", "y", "content", "metadata")).alias("r"))
    return sorted(one.select("id", "r.*").collect(), key=lambda r: r["id"])  # at most ``labelled`` rows of bounded size


def _views(pool: DataFrame) -> DataFrame:
    """Both views of every row, landed once for all rounds: the counts of a text's trigrams, and places of marks.

    A row takes about a third of its text on disk: places as differences, counts byte by byte."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, ROWS_AT_ONCE) for batch in batches for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
            ns, grams, marks, meta = [], [], [], []
            for text, lang, source, n_chars in zip(*(b.column(c).to_pylist() for c in range(4))):
                at, counts, n, own = _grams(text)
                ns.append(n)
                grams.append(np.diff(at, prepend=0).astype("<u2").tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
                marks.append(np.array(own, dtype="<u2").tobytes())
                n_chars = None if n_chars is None or n_chars != n_chars else n_chars
                meta.append(np.array(_marks(text, lang, source, n_chars), dtype="<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(4), b.column(5), pa.array(ns, pa.int64()), *(pa.array(c, pa.binary()) for c in (grams, marks, meta))],
                names=["stratum", "turn", "n", "grams", "marks", "meta"],
            )

    rows = pool.select("text", "lang", "source", "n_chars", "stratum", "turn")
    return land(rows.mapInArrow(lean(per_batch), "stratum int, turn double, n long, grams binary, marks binary, meta binary"), "views")


class Rows:
    """Some landed rows: strata, turns and, for each view, the row, place and value of all entries in row order."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda c: batch.column(c).to_pylist()
        self.strata, self.turns = batch.column("stratum").to_numpy(), batch.column("turn").to_numpy()
        at, value = [], []
        for n, g, m in zip(column("n"), column("grams"), column("marks")):
            k = len(g) // 6
            counts = np.frombuffer(g, dtype=np.uint8, count=4 * k, offset=2 * k).reshape(4, k).T.copy().view("<u4")[:, 0] if k else np.empty(0)
            own = np.frombuffer(m, dtype="<u2")
            at.append(np.concatenate([np.cumsum(np.frombuffer(g, dtype="<u2", count=k), dtype=np.int64), own]))
            value.append(np.concatenate([np.sqrt(counts / n), np.ones(len(own))]).astype(np.float32))
        meta = [np.frombuffer(m, dtype="<u2").astype(np.int64) for m in column("meta")]
        self.views = tuple(
            (np.cumsum([0, *map(len, a)]), np.concatenate([np.empty(0, dtype=np.int64), *a]), np.concatenate([np.empty(0, dtype=np.float32), *v]))
            for a, v in ((at, value), (meta, [np.ones(len(m), dtype=np.float32) for m in meta]))
        )

    def margins(self, view: int, model: Logistic) -> np.ndarray:
        ends, at, value = self.views[view]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        return np.bincount(row, value * model.weights[at], len(ends) - 1) + model.bias

    def packed(self, view: int, row: int) -> bytes:
        """A row's view as a sparse vector (see ``_pack``)."""
        ends, at, value = self.views[view]
        some = slice(ends[row], ends[row + 1])
        out = np.empty(ends[row + 1] - ends[row], dtype=ENTRY)
        out["at"], out["value"] = at[some], value[some]
        return out.tobytes()


@dataclass
class Round:
    """Both views' models and, by 4 * stratum + 2 * view + class (``keys``, in order), the least step taken and the share of its rows."""

    models: tuple[Logistic, Logistic]
    keys: np.ndarray | None = None
    least: np.ndarray | None = None
    part: np.ndarray | None = None

    def sides(self, rows: Rows) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each view the rows that it is sure of, 2 * view + class, and the step of its margin."""
        out = []
        for v, model in enumerate(self.models):
            m = rows.margins(v, model)
            sure = np.flatnonzero(np.abs(m) >= SURE)
            out.append((sure, 2 * v + (m[sure] > 0), np.minimum(TOP, (np.abs(m[sure]) * STEPS).astype(np.int64))))
        return out

    def taken(self, rows: Rows) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view the rows that it hands over and their sides; a row's turn is its place among its like, 0 to 1."""
        out = []
        for sure, side, step in self.sides(rows):
            key = 4 * rows.strata[sure].astype(np.int64) + side
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
            least, part = (x[at] if len(x) else np.zeros(len(key)) for x in (self.least, self.part))
            good = known & ((step > least) | ((step == least) & (rows.turns[sure] < part)))
            out.append((sure[good], side[good]))
        return out


def _left(batches: Iterator[pa.RecordBatch], past: list[Round]) -> Iterator[tuple[Rows, np.ndarray]]:
    """Some rows at a time, and which of them no past round has taken."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            rows = Rows(batch.slice(i, ROWS_AT_ONCE))
            left = np.ones(len(rows.strata), dtype=bool)
            for r in past:
                for some, _ in r.taken(rows):
                    left[some] = False
            yield rows, left


def _limits(pool: DataFrame, past: list[Round], now: Round, share: float, good: float) -> None:
    """Set what ``now`` takes so that every stratum gives its ``share``, split by class as ``good``, of the rows left."""
    shared = pool.sparkSession.sparkContext.broadcast((past, now))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past, now = shared.value
        n: Counter = Counter()  # at most 4 * (TOP + 1) + 1 a stratum
        for rows, left in _left(batches, past):
            strata = rows.strata.astype(np.int64)
            keys = [(strata[left] * 5) << 8]
            for some, side, step in now.sides(rows):
                mine = left[some]
                keys.append((strata[some][mine] * 5 + 1 + side[mine]) << 8 | step[mine])
            for key, c in zip(*(x.tolist() for x in np.unique(np.concatenate(keys), return_counts=True))):
                n[key] += c
        key = np.fromiter(n, dtype=np.int64, count=len(n))
        yield pa.RecordBatch.from_pydict(
            {"stratum": pa.array(((key >> 8) // 5).astype(np.int32)), "side": pa.array(((key >> 8) % 5 - 1).astype(np.int32)),
             "step": pa.array((key & 255).astype(np.int32)), "n": pa.array(list(n.values()), pa.int64())}
        )

    kinds = "stratum int, side int, step int, n long"
    seen = pool.mapInArrow(lean(count), kinds).groupBy("stratum", "side", "step").agg(F.sum("n").alias("n"))
    # at most 4 * (TOP + 1) + 1 rows a stratum
    by = Window.partitionBy("stratum")
    upward = Window.partitionBy("stratum", "side").orderBy(F.desc("step"))
    of_class = F.when(F.col("side") % 2 == 1, good).otherwise(1 - good)
    found = (
        seen.withColumn("all", F.sum(F.when(F.col("side") < 0, F.col("n"))).over(by))
        .filter("side >= 0")
        .withColumn("upto", F.sum("n").over(upward))
        .withColumn("want", F.ceil(F.col("all") * share * of_class))
        .filter("upto >= want and upto - n < want")
        .select("stratum", "side", "step", ((F.col("want") - F.col("upto") + F.col("n")) / F.col("n")).alias("part"))
    )
    limits = sorted((4 * r["stratum"] + r["side"], r["step"], r["part"]) for r in found.collect())  # at most 4 * STRATA rows
    now.keys, now.least, now.part = (np.array([x[i] for x in limits], dtype=t) for i, t in enumerate((np.int64, np.int64, np.float64)))


def _handed(pool: DataFrame, past: list[Round], now: Round) -> DataFrame:
    """The rows taken in this round: the view that learns from them, their label and that view's vector, landed."""
    shared = pool.sparkSession.sparkContext.broadcast((past, now))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past, now = shared.value
        for rows, left in _left(batches, past):
            out = [(1 - s // 2, s % 2, i) for some, side in now.taken(rows) for i, s in zip(some.tolist(), side.tolist()) if left[i]]
            yield pa.RecordBatch.from_pydict(
                {"view": pa.array([v for v, _, _ in out], pa.int32()), "y": pa.array([y for _, y, _ in out], pa.int32()),
                 "x": pa.array([rows.packed(v, i) for v, _, i in out], pa.binary())}
            )

    return land(pool.mapInArrow(lean(take), "view int, y int, x binary"), "handed")


def _gradients(given: DataFrame, models: list[Logistic], each: list[tuple[float, float]]) -> list[np.ndarray]:
    """Both views' gradients (last: bias) over the rows given to them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(m.weights) + 1) for m in models]
        for b in batches:
            views, ys, xs = b.column("view").to_numpy(), b.column("y").to_numpy(), b.column("x").to_pylist()
            for v, m in enumerate(models):
                mine = np.flatnonzero(views == v)
                if not len(mine):
                    continue
                row, at, value = _unpack([xs[i] for i in mine])
                z = np.bincount(row, value * m.weights[at], len(mine)) + m.bias
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - ys[mine]) * np.where(ys[mine] == 1, each[v][1], each[v][0])
                total[v][:-1] += np.bincount(at, value * err[row], len(m.weights))
                total[v][-1] += err.sum()
        yield pa.RecordBatch.from_pydict({"g": pa.array([np.concatenate(total).tobytes()], pa.binary())})

    sums = [np.frombuffer(r["g"]) for r in given.mapInArrow(lean(add), "g binary").collect()]  # one row per task
    whole = np.sum(sums, axis=0) if sums else np.zeros(sum(len(m.weights) + 1 for m in models))
    return np.split(whole, [len(models[0].weights) + 1])


def co_train(labelled: list[tuple], pool: DataFrame | None, rounds: int = ROUNDS, share: float = SHARE) -> CoTrained:
    """``labelled``: (y, content view, metadata view); ``pool``: text, lang, source,
    n_chars, stratum (hash of source and language) and turn (hash from 0 to 1) of all other rows, or none."""
    if len({r[0] for r in labelled}) < 2:
        return CoTrained(None, None, None, float(labelled[0][0]) if labelled else 1.0)
    y = np.array([r[0] for r in labelled], dtype=np.float64)
    known = [np.stack([r[1 + v] for r in labelled]) for v in (0, 1)]
    # every third row of each class is held out
    held = np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::3]] = True
    if len(set(y[~held])) < 2:
        held[:] = False
    fits = [Adagrad(x[~held], y[~held]) for x in known]
    for f in fits:
        each = f.weigh()
        for _ in range(EPOCHS):
            f.step(each)
    past: list[Round] = []
    handed: list[DataFrame] = []
    counts = {(v, c): 0 for v in (0, 1) for c in (0, 1)}
    pool = _views(pool) if rounds and pool is not None else None
    for _ in range(rounds if pool is not None else 0):
        now = Round(tuple(f.model() for f in fits))
        _limits(pool, past, now, share, float(y[~held].mean()))
        got = _handed(pool, past, now)
        new = {(r["view"], r["y"]): r["count"] for r in got.groupBy("view", "y").count().collect()}
        if not new:
            break
        past.append(now)
        handed.append(got)
        for k, n in new.items():
            counts[k] += n
        given = union_all(handed)
        given = given.coalesce(parts(given))
        each = [f.weigh((counts[v, 0], counts[v, 1])) for v, f in enumerate(fits)]
        for _ in range(MORE_EPOCHS):
            for f, e, g in zip(fits, each, _gradients(given, [f.model() for f in fits], each)):
                f.step(e, g)
    models = [f.model() for f in fits]
    check = held if held.any() else ~held
    margins = np.column_stack([models[v].margin(known[v][check]) for v in (0, 1)]).astype(np.float64)
    return CoTrained(
        models[0], models[1],
        (_platt(margins[:, :1], y[check]), _platt(margins[:, 1:], y[check]), _platt(margins, y[check])),
    )


def _columns(docs: DataFrame, names: dict[str, str]) -> dict[str, Column]:
    """The wanted columns of positionally renamed ``docs``; a null where there is none."""
    found = {}
    for new, old in names.items():
        try:
            found[new] = F.col(f"c{position(docs.columns, old)}")
        except KeyError:
            found[new] = F.lit(None)
    return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        labelled: int = LABELLED, seed: int = SEED, **columns: str) -> CoTrained:
    """The classifier, from a bounded sample of labelled documents and all others."""
    wanted = {"id": id_col, "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"} | columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows = plain.select(*[c.alias(n) for n, c in _columns(docs, wanted).items()])
    marks = pick(labels, id=id_col, y=label_col).filter("id is not null and y is not null")
    marks = marks.groupBy("id").agg(F.min(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    turn = F.xxhash64(F.lit(seed), F.col("id").cast("long"))
    some = marks.join(rows.select("id"), "id", "left_semi").orderBy(turn, "id").limit(labelled)  # at most ``labelled`` rows
    sample = _vectors(rows.join(F.broadcast(some.select("id", "y")), "id"))
    ids = docs.sparkSession.createDataFrame([(r["id"],) for r in sample], T.StructType([T.StructField("id", rows.schema["id"].dataType)]))
    like = F.xxhash64(F.lit(seed), F.col("id").cast("long"), "text")
    others = rows.join(F.broadcast(ids), "id", "left_anti").select(
        F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double"),
        F.pmod(F.xxhash64("source", F.lit(0), "lang"), F.lit(STRATA)).cast("int").alias("stratum"),
        (F.shiftrightunsigned(like, 11) / float(1 << 53)).alias("turn"),
    )
    return co_train([(r["y"], _dense(r["content"], CONTENT_SLOTS), _dense(r["metadata"], METADATA_SLOTS)) for r in sample], others)


def scored(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD, **columns: str) -> DataFrame:
    """``docs``, columns renamed c0, c1, ..., with the struct ``quality`` (p_content, p_metadata, score)."""
    wanted = {"text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"} | columns
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # one weight per slot

    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            clean = ([None if v is None or v != v else v for v in s] for s in columns)
            out = [shared.value.score(*row) for row in zip(*clean)]
            yield pd.DataFrame(out, columns=[f.name for f in SCORES])
        give_back()

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    args = [c.cast(kinds[n]) for n, c in _columns(docs, wanted).items()]
    return plain.withColumn("quality", F.pandas_udf(score, SCORES)(*args))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, p_content, p_metadata, score, keep."""
    model = fit(docs, labels, id_col, **options)
    i = position(docs.columns, id_col)
    return scored(docs, model).select(
        F.col(f"c{i}").cast("long").alias("doc_id"), "quality.*"
    ).withColumn("keep", F.col("score") >= threshold)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    out = scored(docs, fit(docs, labels, id_col, **options)).filter(F.col("quality.score") >= threshold)
    return out.drop("quality").toDF(*docs.columns)
