import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigflow.llm import negatives as N

SCHEMA = "id long, label int, vector array<float>, rank string"


def brute(rows, is_anchor, kp=5, kn=5, low=80, high=100, scale=256):
    """All pairs, sorted, row by row."""
    use = []
    for at, (i, label, v, *_) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((at, i, label, [math.floor(scale * float(np.float32(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for at, i, label, v in use:
        if not is_anchor(i):
            continue
        scored = sorted([(dot(v, w), j, b, other) for b, j, other, w in use if b != at], key=order)
        for ps, p, _, _ in [s for s in scored if s[3] == label][:kp]:
            fit = [s for s in scored if s[3] != label and low * ps <= 100 * s[0] <= high * ps][:kn]
            out += [(i, p, r + 1, s[1], ps, s[0]) for r, s in enumerate(fit)]
    return sorted(out, key=str)


def mined(spark, rows, parts):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, N.hard_negatives(df, F.col("id") % 10 == 0).collect()), key=str)


@pytest.mark.parametrize("parts, labels, spread", [(1, 3, 1.0), (4, 10, 0.3), (8, 2, 0.05)])
def test_equals_brute_force(spark, monkeypatch, parts, labels, spread):
    rng = np.random.default_rng(parts)
    centre = rng.normal(size=(4, 6))
    v = (centre[rng.integers(0, 4, 240)] + spread * rng.normal(size=(240, 6))).astype(np.float32)
    rows = [(i, int(rng.integers(0, labels)), v[i].tolist()) for i in range(240)]
    rows += [(1000 + i, i % labels, v[3].tolist()) for i in range(40)]          # ties by id, within and across labels
    rows += [(20, rows[20][1], v[20].tolist()), (None, 0, v[0].tolist()), (None, 1, v[0].tolist()),
             (300, None, v[0].tolist()), (310, 1, None), (320, 1, [float("nan")] * 6), (330, 1, [float("inf")] + [0.0] * 5),
             (340, 1, [None] + [1.0] * 5), (350, 0, [0.0] * 6), (360, 99, v[1].tolist()), (370, 1, [1.0, 2.0]), (380, 1, [])]
    is_anchor = lambda i: i is not None and i % 10 == 0
    # repeated ids only differ in rows that are equal, so the row order does not show
    got = mined(spark, rows, parts)
    assert got == brute(rows, is_anchor) and got
    monkeypatch.setattr(N, "ANCHORS", 7)
    monkeypatch.setattr(N, "CELLS", 500)
    assert mined(spark, rows, parts) == got


def test_one_row_and_none(spark):
    assert mined(spark, [(0, 1, [1.0])], 1) == [] and mined(spark, [(1, 1, [1.0])], 1) == []
    assert N.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") == 0).collect() == []
    same = [(i, 0, [1.0, 1.0]) for i in range(5)]
    assert mined(spark, same, 2) == []


def test_keys_sort_as_their_fields():
    rng = np.random.default_rng(0)
    a, s, i, r = (rng.integers(-5, 5, 500) * 10**12 for _ in range(4))
    kind, none = rng.integers(0, 2, 500), rng.integers(0, 2, 500).astype(bool)
    keys = np.concatenate([N.pack(a[j:j + 1], s[j:j + 1], kind[j], none[j:j + 1], i[j:j + 1], r[j:j + 1]) for j in range(500)]).astype(N.KEY)
    back = N.unpack(keys)
    for name, want in zip(("anchor", "score", "kind", "none", "id", "row"), (a, s, kind, none, i, r)):
        assert np.array_equal(back[name], want)
    by_bytes = sorted(range(500), key=lambda j: keys[j].tobytes())
    fields = lambda j: (a[j], -s[j], kind[j], none[j], i[j], r[j])
    assert [fields(j) for j in by_bytes] == sorted(map(fields, range(500)))


def test_scores_too_large_fail(spark):
    with pytest.raises(Exception, match="55 bits"):
        mined(spark, [(0, 0, [3e30]), (1, 0, [3e30]), (2, 1, [1.0])], 1)
