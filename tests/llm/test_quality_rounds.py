"""One round of co-training against a dense, row-by-row account of it."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from farewise.llm import quality
from farewise.llm.quality import STEPS, SURE, TOP, Logistic, Round, content_view, metadata_view


def _pool(spark):
    rnd = random.Random(8)
    rows = [(None, None, None, None, 0, 0.5), ("", "en", "a", 0.0, 3, 0.1), (" \n ", "en", "a", float("nan"), 3, 0.9)]
    for i in range(700):
        text = " ".join(rnd.choice(["the", "of", "spam", "!!!", "été", "x" * rnd.randint(1, 9)]) for _ in range(rnd.randint(1, 80)))
        source = rnd.choice("aab")
        rows.append((text, rnd.choice(["en", "fr"]), source, float(len(text)), 3 if source == "a" else 65535, rnd.random()))
    rows += rows[5:9]  # repeated rows
    rows.append(("ab" * 40_000, "en", "b", 80_000.0, 65535, 0.3))  # counts beyond two bytes
    return rows, spark.createDataFrame(rows, "text string, lang string, source string, n_chars double, stratum int, turn double").repartition(3)


def _dense(row):
    text, lang, source, n = row[:4]
    return content_view(text), metadata_view(text, lang, source, None if n is None or n != n else n)


def _brute(rows, models, past, share, good):
    """(limits, taken) of a round: by key (least step, part), and row number with its sides."""
    seen, n_all = defaultdict(Counter), Counter()
    opinions = []
    for i, row in enumerate(rows):
        margins = [float(x.astype(np.float64) @ m.weights + m.bias) for x, m in zip(_dense(row), models)]
        mine = [(2 * v + (m > 0), min(TOP, int(abs(m) * STEPS))) for v, m in enumerate(margins) if abs(m) >= SURE]
        opinions.append(mine)
        if i in past:
            continue
        n_all[row[4]] += 1
        for side, step in mine:
            seen[row[4], side][step] += 1
    limits = {}
    for (stratum, side), steps in seen.items():
        want = math.ceil(n_all[stratum] * share * (good if side % 2 else 1 - good))
        upto = 0
        for step in sorted(steps, reverse=True):
            if upto < want <= upto + steps[step]:
                limits[4 * stratum + side] = (step, (want - upto) / steps[step])
            upto += steps[step]
    taken = {}
    for i, row in enumerate(rows):
        if i in past:
            continue
        sides = []
        for side, step in opinions[i]:
            least, part = limits.get(4 * row[4] + side, (999, 0.0))
            if step > least or (step == least and row[5] < part):
                sides.append(side)
        if sides:
            taken[i] = sides
    return limits, taken


def test_rounds_hand_over_what_a_row_by_row_account_does(spark):
    rows, pool = _pool(spark)
    views = quality._views(pool)
    rnd = np.random.default_rng(3)
    past_rounds, past_rows = [], set()
    for i in range(2):
        models = (Logistic(rnd.normal(size=quality.CONTENT_SLOTS).astype(np.float32) * 4, 0.2),
                  Logistic(rnd.normal(size=quality.METADATA_SLOTS).astype(np.float32), -0.1))
        now = Round(models)
        quality._limits(views, past_rounds, now, 0.2, 0.6)
        limits, taken = _brute(rows, models, past_rows, 0.2, 0.6)
        assert dict(zip(now.keys.tolist(), zip(now.least.tolist(), now.part.tolist()))) == limits and limits
        got = quality._handed(views, past_rounds, now).collect()
        want = Counter((1 - s // 2, s % 2, tuple(np.flatnonzero(_dense(rows[i])[1 - s // 2]).tolist())) for i, sides in taken.items() for s in sides)
        assert Counter((r["view"], r["y"], tuple(np.flatnonzero(quality._dense(r["x"], 1 << 12)).tolist())) for r in got) == want
        past_rounds.append(now)
        past_rows |= set(taken)


def test_landed_views_are_the_dense_ones(spark):
    rows, pool = _pool(spark)
    batch = quality._views(pool.coalesce(1).orderBy(F.col("text"), "turn")).toArrow().combine_chunks().to_batches()[0]
    landed = quality.Rows(batch)
    slots = (quality.CONTENT_SLOTS, quality.METADATA_SLOTS)
    got = Counter()
    for i in range(batch.num_rows):
        got[tuple(tuple(np.round(_sum(landed.packed(v, i), slots[v]), 5).tolist()) for v in (0, 1))] += 1
    want = Counter(tuple(tuple(np.round(x.astype(np.float32), 5).tolist()) for x in _dense(r)) for r in rows)
    assert got == want


def _sum(packed, slots):
    entries = np.frombuffer(packed, dtype=quality.ENTRY)
    return np.bincount(entries["at"], entries["value"], slots).astype(np.float32)
