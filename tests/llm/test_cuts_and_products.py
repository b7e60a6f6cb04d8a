import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvegrid.llm import fill_middle, hard_negatives
from cvegrid.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

from .helpers import awkward, documents, empty

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op12_kronecker_negatives", "op13_swar_fill_middle"])
def test_queries_equal_their_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == []


# ---------------------------------------------------------------- fill in the middle


@pytest.mark.parametrize("alphabet", ["a ", "ab \t\n\r\x0b\x0c", "é \x08\x0e\x1f!\x85  😀", "\x00\x7f\x80 "])
def test_units_and_their_ends(alphabet):
    rnd = random.Random(alphabet)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    found = fill_middle.Units([t.encode() for t in texts])
    units = [UNIT.findall(t) for t in texts]
    assert found.counts.tolist() == [len(u) for u in units]
    for share in (0.0, 0.3, 0.7, 1.0):
        k = np.array([int(share * len(u)) for u in units])
        expected = [len("".join(u[:n]).encode()) for u, n in zip(units, k.tolist())]
        assert found.cut(k).tolist() == expected


def test_no_texts():
    none = fill_middle.Units([])
    assert none.counts.tolist() == [] and none.cut(np.zeros(0, np.int64)).tolist() == []


def plain_fill(doc_id, text):
    text, units = text or "", UNIT.findall(text or "")
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", text, None, None
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_fill_middle_on_awkward_rows(spark):
    cut = fill_middle.transform(awkward(spark).withColumn("fim", F.lit("own")).withColumn("cut", F.lit(1)))
    rows = cut.select("*", fill_middle.restore(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(rows) == 8
    for r in rows:
        assert tuple(r.fim) == plain_fill(r.doc_id, r.text) and r.back == (r.text or "") and r["cut"] == 1
    assert fill_middle.transform(empty(spark)).count() == 0


def test_markers_in_texts_and_pieces_like_markers(spark):
    texts = ["a <P> b", "x <S>", "<M>", *["< <P <S <M P> S> M> " * 3] * 40, *["<", " <", ">"] * 20]
    cut = fill_middle.transform(documents(spark, *texts))
    rows = cut.select("*", fill_middle.restore(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    for r in rows:
        assert tuple(r.fim) == plain_fill(r.doc_id, r.text) and r.back == r.text
    assert {r.fim.form for r in rows} == {"plain", "psm", "spm"}


# ---------------------------------------------------------------- hard negatives


@pytest.mark.parametrize("low, high, width", [(-256, 256, 64), (-3, 5, 7), (4, 9, 3), (-9, -2, 5), (0, 0, 2), (-30_000, 30_000, 8), (-2, 2, 0)])
def test_packed_products_are_exact(low, high, width):
    rng = np.random.default_rng(width)
    for n in (1, 2, 3, 5, 40):
        rows, anchors = (rng.integers(low, high + 1, (m, width)) for m in (n, 4))
        rows[0], anchors[0] = high, high  # the largest sums that a field must hold
        assert (hard_negatives.Packed(rows, low, high).scores(anchors) == anchors @ rows.T).all()


def test_too_wide_products_are_refused():
    with pytest.raises(ValueError):
        hard_negatives.Packed(np.array([[2**40]]), -2**40, 2**40)


def test_best_of_a_row_with_ties():
    scores = np.array([[3, 5, 5, 1], [hard_negatives.NONE, 2, hard_negatives.NONE, 2], [hard_negatives.NONE] * 4])
    rows, columns = hard_negatives.best(scores, 2)
    assert list(zip(rows.tolist(), columns.tolist())) == [(0, 1), (0, 2), (1, 1), (1, 3)]
    assert len(hard_negatives.best(np.zeros((0, 3), np.int64), 2)[0]) == 0


def plain_negatives(rows, anchor_every):
    held = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        new = (label, [int(np.floor(256 * float(x))) for x in v])
        held[i] = min(held.get(i, new), new)
    out = set()
    for a, (label, v) in held.items():
        if a % anchor_every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in held.items() if i != a and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(s, i) for s, i, other in scored if other != label and -50 * ps <= -100 * s <= -95 * ps]
            out |= {(a, p, rank, i, -ps, -s) for rank, (s, i) in enumerate(fits[:3], 1)}
    return out


def test_negatives_equal_brute_force_in_small_blocks(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, None]), [rng.uniform(-1, 1) + 0.4 for _ in range(6)]) for i in range(160)]
    rows += [(i, rng.choice([0, 1]), rows[5][2]) for i in range(160, 200)]  # many equal vectors: ties
    rows += [(3, 2, [0.5] * 6), (7, 1, rows[7][2]), (10, 0, rows[10][2]), (None, 1, [1.0] * 6), (200, 1, None), (201, 0, [1.0, None]),
             (202, 0, [float("nan")] * 6), (203, 1, [float("inf")] * 6), (204, 0, [0.5, 0.5]), (205, 1, [0.4, 0.3]), (210, 0, [0.5, 0.6]),
             (220, 3, []), (230, 3, []), (240, 4, [])]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<float>, id string, v string")
    exact = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    found = hard_negatives.mine(table, F.col("id") % 10 == 0, F.col("label"), block=24, anchor_block=4).collect()
    expected = plain_negatives(exact, 10)
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected and len(expected) > 100


def test_no_rows_to_mine(spark):
    table = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(table, F.col("id") % 10 == 0, F.col("label")).count() == 0
    one = spark.createDataFrame([(0, 1, [0.5])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(one, F.col("id") % 10 == 0, F.col("label")).count() == 0
