import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cvegrid.llm import curriculum, neighbour_graph, ngram_join, quality_cnn, secret_scan, toxicity
from cvegrid.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

from .helpers import SCHEMA, awkward, documents, empty

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, shard string")


def test_all_candidates_come_where_there_are_few(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.standard_normal(5).tolist(), 1, "x") for i in range(12)]
    bad = [(100, None, 1, "x"), (101, [0.0] * 5, 1, "x"), (102, [1.0, None, 0.0, 0.0, 0.0], 1, "x"),
           (103, [1.0, float("nan"), 0.0, 0.0, 0.0], 1, "x"), (104, [1.0, float("inf"), 0.0, 0.0, 0.0], 1, "x"),
           (105, [1.0, 2.0], 1, "x"), (None, [1.0] * 5, 1, "x"), rows[3]]
    found = neighbour_graph.nearest(vectors(spark, rows + bad), F.col("id") % 6 == 0, k=20).collect()
    x = np.array([r[1] for r in rows])
    for q in (0, 6):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        order = sorted((i for i in range(12) if i != q), key=lambda i: (-(x[i] @ x[q]), i))
        assert [r.vec_id for r in mine] == order and [r["rank"] for r in mine] == list(range(1, 12))
        assert np.allclose([r.score for r in mine], [x[i] @ x[q] for i in order], atol=1e-12)
    assert {r.query_id for r in found} == {0, 6}
    assert neighbour_graph.nearest(vectors(spark, []), F.lit(True)).count() == 0


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(set)
    for r in QUERIES["op2_neighbour_graph"](spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits.append(len(got[ids[i]] & set(ids[np.argsort(-scores)[:20]].tolist())) / 20)
    assert len(got) == len(hits) and np.mean(hits) >= 0.9


def test_recall_with_very_different_lengths(spark):
    rnd = np.random.default_rng(6)
    x = rnd.standard_normal((2000, 16)) * np.exp(1.5 * rnd.standard_normal((2000, 1)))
    x[7] *= 1000 / np.linalg.norm(x[7])
    found = defaultdict(set)
    for r in neighbour_graph.nearest(vectors(spark, [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]), F.col("id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    hits = []
    for q in range(0, 2000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits.append(len(found[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9, np.mean(hits)


def test_lengths_count_and_copies_are_ties(spark):
    rows = [(i, [1.0 + i % 4, 0.5], 1, "x") for i in range(80)]
    found = [r for r in neighbour_graph.nearest(vectors(spark, rows), F.col("id") == 0, k=5).collect()]
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [3, 7, 11, 15, 19]


# ---------------------------------------------------------------- mixing


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert not differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name])


def plain_targets(sizes, weights, total):
    """Share by weight, fix what exceeds its bound, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, total * sum(sizes.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
        free -= over
    return out


def test_targets_settle_and_words_meet_them(spark):
    rnd = random.Random(2)
    texts = ["w " * rnd.randint(0, 60) for _ in range(120)]
    docs = documents(spark, *texts, source=lambda i: [None, "a", "é", "b", "B"][min(i % 9, 4)])
    rows = curriculum.plan(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].split()) and 0 <= r.taken <= 2 * r["size"]
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    wanted = plain_targets(sizes, (3, 1, 2), 1.5)
    for s in sizes:
        assert abs(target[s] - wanted[s]) < 1e-6 and taken[s] == int(target[s] + 0.5), (s, sizes, target, wanted, taken)
    positions = [r.position for r in rows if r.taken]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)


def test_mixture_repeats_whole_documents_by_position(spark):
    docs = documents(spark, *["w " * 10] * 40, source=lambda i: f"s{i % 2}")
    mixed = curriculum.mix(docs, weights=(1, 3))
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and sum(counts.values()) == 60 and max(counts.values()) == 2
    assert all(counts[i] == 2 for i in range(1, 40, 2))  # the heavier source meets its bound


def test_curriculum_awkward_rows(spark):
    rows = curriculum.plan(awkward(spark)).collect()
    assert len(rows) == 8 and sum(r.taken for r in rows) > 0
    assert all(r.taken == 0 and r.position is None for r in rows if r.doc_id in (1, 2, 3))
    assert curriculum.plan(empty(spark)).count() == curriculum.mix(empty(spark)).count() == 0
    assert curriculum.mix(awkward(spark)).columns == awkward(spark).columns


# ---------------------------------------------------------------- toxicity and quality


def plain_segments(scores):
    """Maximal segments by definition: the best one, then the same on either side of it."""
    if not len(scores):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((total[b] - total[a], -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    a, b = best[3], best[4]
    right = [(x + b, y + b, s) for x, y, s in plain_segments(scores[b:])]
    return plain_segments(scores[:a]) + [(a, b, best[0])] + right


def test_segments_are_the_maximal_ones():
    rnd = random.Random(7)
    for _ in range(300):
        scores = np.array([rnd.choice([-3.0, -1.5, -0.7, 1.1, 2.3, 4.9]) + rnd.random() / 1000 for _ in range(rnd.randint(0, 14))])
        found = toxicity.segments(scores, np.flatnonzero(scores > 0))
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in plain_segments(scores)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def prose(rnd, extra=()):
    return " ".join([rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60)] + list(extra)).split()


def test_toxic_passages_are_found_and_clean_texts_left(spark):
    rnd = random.Random(1)
    texts, marks = [], []
    for i in range(240):
        found = prose(rnd)
        if i % 4 == 0:
            found[20:23] = ["nasty", "vile", "nasty"]
        texts.append(" ".join(found))
        marks.append(int(i % 4 == 0))
    known = labels(spark, [(i, 1, m) for i, m in enumerate(marks) if i < 200] + [(None, 1, 1), (3, None, None)])
    docs = documents(spark, *texts)
    model = toxicity.fit(docs, known, F.lit(True))
    rows = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert all((rows[i].score >= 0.5) == bool(marks[i]) for i in range(240))
    assert [(p.first, p.end) for p in rows[0].passages] == [(20, 23)]
    out = toxicity.score(awkward(spark), model).collect()
    assert len(out) == 8 and all(r.toxicity.score < 0.5 for r in out)
    assert toxicity.score(empty(spark), model).count() == 0


def test_rare_words_of_toxic_documents_only_count(spark):
    """Each of 100 words is in 6 of 3,000 documents, which are toxic."""
    rnd = random.Random(4)
    rare = [a + b + "rk" for a in "bcdfghjklm" for b in "aeiouyäöüé"]
    texts = []
    for i in range(3000):
        found = prose(rnd)
        if i % 10 == 0:
            found[30:32] = [rare[i // 10 % 100], rare[(i // 10 * 7 + 1) % 100]]
        texts.append(" ".join(found))
    docs, known = documents(spark, *texts), labels(spark, [(i, 1, int(i % 10 == 0)) for i in range(2400)])
    rows = {r.doc_id: r.toxicity for r in toxicity.score(docs, toxicity.fit(docs, known, F.lit(True))).collect()}
    assert all((rows[i].score >= 0.5) == (i % 10 == 0) for i in range(3000))
    assert [(p.first, p.end) for p in rows[2900].passages] == [(30, 32)]


def test_words_are_counted_each_for_itself(spark):
    """Clean documents hold 200,000 words more; none takes part in the counts or the score of another."""
    rnd = random.Random(9)
    letter = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(prose(rnd) + [f"q{i * 500 + j}z".translate(letter) for j in range(500)]) for i in range(400)]
    texts += [" ".join(prose(rnd) + ["nasty", "vile"]) for _ in range(100)]
    docs, known = documents(spark, *texts), labels(spark, [(i, 1, int(i >= 400)) for i in range(500)])
    model = toxicity.fit(docs, known, F.lit(True))
    assert {w for w, s in model.scores.items() if s > 0} == {b"nasty", b"vile"}
    odds = toxicity.log_odds(*np.array([[100.0], [100.0], [0.0]]), (500, 100, 400))
    assert np.allclose([model.scores[b"nasty"], model.scores[b"vile"]], odds)
    unseen = " ".join(f"x{i}z".translate(letter) for i in range(20_000))
    rows = toxicity.score(documents(spark, unseen, "Nasty, vile!"), model).orderBy("doc_id").collect()
    assert rows[0].toxicity.score < 0.01 and not rows[0].toxicity.passages and rows[1].toxicity.score > 0.5


def test_evidence_grows_with_the_count():
    n = np.arange(1.0, 15)
    found = toxicity.likelihood_ratio(n, 0 * n, (342, 2709))
    odds = toxicity.log_odds(3 * n, n, 0 * n, (10_000, 342, 2709))
    assert (np.diff(found) > 0).all() and (np.diff(odds) > 0).all()
    assert found[13] > toxicity.least_evidence(150_000) and found[0] < toxicity.least_evidence(1)
    assert (toxicity.likelihood_ratio(np.array([0.0, 10.0]), np.array([0.0, 100.0]), (100, 1000)) < 1e-9).all()


def test_toxicity_without_labels_marks_nothing(spark):
    model = toxicity.fit(awkward(spark), labels(spark, []), F.lit(True))
    assert all(r.toxicity.score < 0.5 for r in toxicity.score(awkward(spark), model).collect())


@pytest.mark.parametrize("name, column, threshold, modulus, rest, least", [
    ("op4_toxic_segments", "toxic", 0.5, 5, 0, 0.93), ("op7_quality_cnn", "quality", 0.7, 4, 2, 0.93)])
def test_held_out_accuracy(spark, name, column, threshold, modulus, rest, least):
    folder = "/root/testdata/sf0.1" if column == "toxic" else "/root/testdata/sf0.01"
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    judged = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(judged) >= least


def test_gradients_of_the_network():
    rnd = np.random.default_rng(5)
    net = quality_cnn.Network()
    x, y = rnd.integers(0, 257, (3, quality_cnn.CHUNK)).astype(np.int16), np.array([1.0, 0.0, 1.0], np.float32)

    def loss():
        logits = net.forward(x)[0].astype(np.float64)
        return float(np.logaddexp(0, -(2 * y - 1) * logits).sum())

    logits, kept = net.forward(x)
    gradients = net.backward(kept, (1 / (1 + np.exp(-logits)) - y).astype(np.float32))
    for name, at in [("out", (2,)), ("hidden", (3, 1)), ("filters", (5, 7)), ("filter_bias", (4,)), ("out_bias", (0,))]:
        before = net.p[name][at]
        net.p[name][at] = before + 1e-2
        above = loss()
        net.p[name][at] = before - 1e-2
        below = loss()
        net.p[name][at] = before
        assert abs((above - below) / 2e-2 - gradients[name][at]) < 2e-2 + 0.05 * abs(gradients[name][at]), name


def test_chunks_cover_the_whole_text():
    text = "".join(chr(33 + i % 90) for i in range(2000))
    parts = quality_cnn.chunks(text)
    seen = bytes(parts[0].astype(np.uint8)) + b"".join(
        bytes(p[quality_cnn.CHUNK - quality_cnn.STEP:].astype(np.uint8)) for p in parts[1:])
    assert seen[:2000] == text.encode() and len(quality_cnn.chunks("")) == 1


def test_quality_awkward_rows(spark):
    network = quality_cnn.fit(empty(spark), labels(spark, []), F.lit(True))
    out = quality_cnn.score(awkward(spark), network)  # a column called score is there already
    assert out.columns == awkward(spark).columns and all(0 <= r.score <= 1 for r in out.collect())
    assert quality_cnn.score(empty(spark), network).count() == 0


# ---------------------------------------------------------------- similarity join


def plain_components(texts, n, similarity):
    sets = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                first, second = sorted((find(a), find(b)))
                root[second] = first
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(rnd, count):
    out = []
    for _ in range(count):
        base = [f"w{rnd.randint(0, 500)}" for _ in range(rnd.choice([2, 3, 9, 25, 80, 200]))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randint(0, 900)}"
            out.append(" ".join(copy).replace("w", "W") if rnd.random() < 0.2 else " ".join(copy))
    return out


@pytest.mark.parametrize("n, similarity", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, n, similarity):
    texts = variants(random.Random(n), 25) + ["", " \n", None]
    rows = ngram_join.join(documents(spark, *texts), n=n, similarity=similarity).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(dict(enumerate(texts)), n, similarity)


def test_long_texts_are_joined_exactly(spark):
    rnd = random.Random(12)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(4000)]
    near, apart = list(base), list(base)
    for words, changes in ((near, 50), (apart, 200)):
        for at in rnd.sample(range(4000), changes):
            words[at] = f"x{at}"
    texts = {i: " ".join(t) for i, t in enumerate((base, near, apart, [f"y{i % 3900}" for i in range(4000)]))}
    rows = ngram_join.join(documents(spark, *texts.values()), n=3, similarity=90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts, 3, 90)
    assert [r.component_id for r in sorted(rows, key=lambda r: r.doc_id)] == [0, 0, 2, 3]


def test_similar_sets_share_a_signature():
    rnd = random.Random(3)
    for similarity in (90, 80):
        for _ in range(400):
            m = rnd.choice([3, 8, 12, 20, 60, 300])
            a = np.unique(np.array([rnd.getrandbits(64) for _ in range(m)], np.uint64))
            gone = rnd.randint(0, max(1, m * (100 - similarity) // (100 + similarity)))
            more = np.array([rnd.getrandbits(64) for _ in range(rnd.randint(0, gone))], np.uint64)
            b = np.unique(np.concatenate([a[gone:], more]))
            shared = len(np.intersect1d(a, b))
            if shared and shared < max(len(a), len(b)) and 100 * shared >= similarity * (len(a) + len(b) - shared):
                assert len(np.intersect1d(ngram_join.signatures(a, similarity), ngram_join.signatures(b, similarity)))


def test_long_sets_with_a_common_passage_meet_seldom_and_similar_ones_always():
    numbers = np.random.default_rng(5)
    draw = lambda m: numbers.integers(0, 2**64, m, np.uint64)
    passage = draw(150)
    sets = [np.unique(np.concatenate([passage, draw(3000 + 10 * i)])) for i in range(60)]
    signs = [ngram_join.signatures(s, 80) for s in sets]
    meet = sum(len(np.intersect1d(x, y)) > 0 for i, x in enumerate(signs) for y in signs[:i])
    assert meet <= 60 * 59 // 2 // 6
    for similarity in (80, 90):
        for a in sets[:20]:
            gone = len(a) * (100 - similarity) // (100 + similarity)  # the most that two sets of this size may differ by, on each side
            b = np.unique(np.concatenate([numbers.permutation(a)[gone:], draw(gone)]))
            shared = len(np.intersect1d(a, b))
            assert 100 * shared >= similarity * (len(a) + len(b) - shared)
            assert len(np.intersect1d(ngram_join.signatures(a, similarity), ngram_join.signatures(b, similarity)))


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102)]
    found = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 103)}}


def test_join_awkward_rows(spark):
    rows = ngram_join.join(awkward(spark)).collect()
    assert len(rows) == 8 and sorted(r.component_id for r in rows if r.n_shingles == 0) == [1, 2, 3]
    assert [r.component_id for r in rows if r.doc_id == 5] == [5, 5]
    assert ngram_join.join(empty(spark)).count() == ngram_join.keep_one(empty(spark)).count() == 0
    assert ngram_join.keep_one(awkward(spark)).columns == awkward(spark).columns


def test_join_query_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_partenum_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts, 3, 90)


# ---------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    from cvegrid.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF), "stage"))
    first, good, single, masked, mixed, coded = kept
    assert all(x.columns == docs.columns for x in kept[:5])
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in good.collect()}
    lost = [i for i, q in truth.items() if q == 1 and i not in left]
    assert len(lost) <= 0.1 * sum(truth.values())
    groups = plain_components({r.doc_id: r.text for r in good.collect()}, 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, root) in groups.items() if root == i}
    judged = {r.doc_id: r.n_owned for r in secret_scan.find(single).collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    for r in masked.collect():
        assert (secret_scan.MASK in r.text) == (judged[r.doc_id] > 0) and (judged[r.doc_id] or r.text == before[r.doc_id])
        assert r.n_chars == len(r.text)
    planned = {r.doc_id: r for r in curriculum.plan(masked).collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for i, r in planned.items():
        times = int(r.taken / r["size"] + 0.5) if r["size"] else 0
        assert counts.get(i, 0) == times
    assert coded.count() == mixed.count() and coded.where("not exact").count() == 0


def test_pipeline_run_and_empty_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("not exact").count() == 0
    none = spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:]:
        none = stage(spark, none, SF)
    assert none.count() == 0


def test_signature_groups_by_one_pass(spark):
    rnd = random.Random(8)
    rows = [(rnd.randint(0, 300), rnd.randint(0, 12)) for _ in range(1500)] + [(7, i % 700) for i in range(2000)]
    found = ngram_join.grouped(spark.createDataFrame(rows, "signature long, node long")).collect()
    held = {}
    for s, v in rows:
        held.setdefault(s, set()).add(v)
    expected = {(s, v) for s, nodes in held.items() if len(nodes) > 1 for v in nodes}
    assert len(found) == len(expected) and {(r.signature, r.node) for r in found} == expected
    hubs = {}
    for r in found:
        hubs.setdefault(r.signature, set()).add(r.hub)
    assert all(len(h) == 1 and h <= held[s] for s, h in hubs.items())
    assert ngram_join.grouped(spark.createDataFrame([], "signature long, node long")).count() == 0


def test_one_of_equal_rows_stays_and_names_do_not_clash(spark):
    texts = ["one two three four five six seven"] * 2 + ["", "other words are these here now too"]
    docs = documents(spark, *texts)
    docs = docs.unionByName(docs).withColumnsRenamed({"row": "kept_id", "ids": "__id", "score": "size"})
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 2, 3]
    other = docs.withColumn("lang", F.monotonically_increasing_id().cast("string"))
    assert sorted(r.doc_id for r in ngram_join.keep_one(other).collect()) == [0, 0, 2, 2, 3, 3]


def test_wide_maps_bound_the_difference_and_are_no_longer_than_needed():
    rng = np.random.default_rng(8)
    for size, length in ((1024, 256), (1100, 512), (3000, 1024), (40_000, 2048)):
        grams = np.unique(rng.integers(0, 1 << 63, size + 50, np.uint64))[:size]
        for changed in (0, 7, size // 5):
            other = np.unique(np.append(grams[changed:], rng.integers(0, 1 << 63, changed // 2, np.uint64)))
            a, b = ngram_join.wide_parity(grams), ngram_join.wide_parity(other)
            assert len(a) == length
            if b is not None:
                differ = len(np.setxor1d(grams, other))
                assert ngram_join.wide_difference(a, b) == ngram_join.wide_difference(b, a) <= differ
                assert size > 8192 or ngram_join.wide_difference(a, b) >= 0.7 * differ


def test_join_leaves_no_groups_and_pairs_behind(spark):
    """What a step wrote and shuffled goes once it is done: the disks held all of it to the end."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(500)}" for _ in range(60)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in range(0, 60, 3)] + [" ".join(rnd.choices(base, k=40)) for _ in range(20)]
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    ngram_join.join(documents(spark, *texts), n=3, similarity=60).collect()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "nodes" in left and not left & {"groups", "open", "sets"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
