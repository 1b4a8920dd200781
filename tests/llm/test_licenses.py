"""Interrupted and repeated license texts."""

import random

from edge import documents
from farewise.llm.licenses import scan
from farewise.llm.templates import LICENSES


def _noise(rnd, n):
    return [f"n{rnd.randint(0, 10**6)}" for _ in range(n)]


def test_interrupted_licenses_are_found(spark):
    rnd = random.Random(3)
    rows, want = [], set()
    for i, (name, text) in enumerate(LICENSES):
        words = text.split()
        if len(words) < 45:
            continue
        half = len(words) // 2
        rows.append((i, " ".join(_noise(rnd, 50) + words[:half] + _noise(rnd, 200) + words[half:] + _noise(rnd, 20))))
        want.add((i, name))
        rows.append((100 + i, " ".join(_noise(rnd, 50) + words[:half] + _noise(rnd, 200))))  # half of it is not enough
    assert want
    got = {(r["doc_id"], r["license_id"]): (r["containment"], r["shingle"]) for r in scan(documents(spark, rows)).collect()}
    assert want <= set(got) and not any(i >= 100 and (i - 100, n) in want for i, n in got)
    assert all(0.8 <= got[w][0] <= 1 and got[w][1] == 50 for w in want)


def test_a_text_that_repeats_a_notice(spark):
    name, text = min(LICENSES, key=lambda t: abs(len(t[1].split()) - 40))
    rows = [(1, " ".join([text] * 20_000)), (2, "nothing of the kind is said in this text at all")]
    got = [tuple(r) for r in scan(documents(spark, rows)).collect()]
    assert (1, name, 1.0, 0) in got and {g[0] for g in got} == {1}
