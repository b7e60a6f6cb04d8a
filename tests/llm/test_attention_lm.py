import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvegrid.llm import attention_lm as lm
from cvegrid.llm import common, lexicon
from cvegrid.llm.common import in_fold
from cvegrid.llm.queries import QUERIES

from .helpers import awkward, documents, empty

SF = "/root/testdata/sf0.001"
RANKS = lm.read_ranks(lm.TOKENIZER_FILE)
#: A lower-case text with white space beyond ASCII, broken and long words.
ODD = ["a b   x   ", "", " \t\n\x0b\x0c\r ", "é中文 ñandú́ \x1c\x85 " + "zq" * 3000, "foo.bar,  it's 1234 '' ###"]


def plain_words(text):
    return text.encode().lower().split()


def test_words_are_spelled_each_by_itself():
    words = lm.Words(RANKS)
    rnd = random.Random(1)
    texts = ODD + [" ".join(rnd.choice(["the", "ünder", "x ", " ", "'s", "a-b", "q" * rnd.randint(1, 9)]) for _ in range(50)) for _ in range(40)]
    for size in (1, 60, 1 << 19):
        for part in lm._batches(texts, size):
            numbers, n_words, ids, counts = lm.sequences(words, part, 99_999)
            at, place = 0, 0
            for text, n, m in zip(part, n_words.tolist(), counts.tolist()):
                expected = [words.encoding.encode_ordinary(" " + w.decode()) for w in text.split()]
                assert n == len(expected) and ids[place:place + m].tolist() == [i for e in expected for i in e] + [99_999]
                at, place = at + n, place + m
            assert at == len(numbers) and place == len(ids)


def test_forgotten_words_come_back_and_hashes_differ():
    words = lm.Words(RANKS, limit=10)
    text = b" ".join(b"w%d" % (i % 300) for i in range(3000))
    first = lm.sequences(words, [text], 7)[2].tolist()
    hashes = words.hashes.tolist()
    assert words.full() and len(set(hashes)) == 300
    words.forget()
    assert lm.sequences(words, [text], 7)[2].tolist() == first and sorted(words.hashes.tolist()) == sorted(hashes)


def test_hash_of_a_word_does_not_depend_on_its_place(monkeypatch):
    monkeypatch.setattr(lexicon, "PART", 64)
    rnd = random.Random(2)
    found = [bytes(rnd.choice(b"ab\xc3") for _ in range(rnd.choice([1, 2, 3, 10, 100, 500]))) for _ in range(400)]
    data = np.frombuffer(b"\n" + b" ".join(found) + b"\n", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = ends - [len(w) for w in found]
    hashes = lexicon.Hasher()(data, starts, ends).tolist()
    assert len(set(zip(found, hashes))) == len(set(found)) == len(set(hashes))


def a_model(seed=3, n_ids=40):
    rng = np.random.default_rng(seed)
    counts = np.append(rng.integers(0, 50, n_ids), [0, 0])
    slot, kind, share, classes, n_slots = lm.ranks(counts)
    w = lm.beginning(classes, n_slots)
    w = {k: (x + rng.standard_normal(x.shape) * 0.3).astype(np.float32) for k, x in w.items()}
    return lm.Model(n_ids - 1, slot, kind, share, w, (np.zeros(0, np.int64),) * 2, None, 0, 0)


def plain_log(model, ids, place):
    """The base-10 logarithm of one id's probability, input by input."""
    w = {k: x.astype(float) for k, x in model.weights.items()}
    inputs = [model.vocabulary + 1, *ids[:-1]]
    rows = [w["embed"][model.slot[i]] for i in inputs]
    low = max((place // lm.STEP - 1) * lm.STEP, 0)
    weights, values = [], []
    for j in range(low, place + 1):
        x = (rows[place] @ w["query"]) @ (rows[j] @ w["key"]) / math.sqrt(lm.WIDTH) + w["far"][place - j]
        weights.append(max(1 + x / 16, 0) ** 16)
        values.append(rows[j] @ w["value"])
    mixed = sum(a * v for a, v in zip(weights, values)) / (sum(weights) + 1e-6)
    hidden = np.maximum(mixed + rows[place] @ w["keep"], 0)
    odds = np.maximum(1 + (hidden @ w["out"] + w["base"]) / 16, lm.LEAST) ** 16
    return math.log10(odds[model.kind[ids[place]]] / odds.sum()) + model.share[ids[place]] / math.log(10)


def test_every_token_is_scored_once_with_its_context():
    model = a_model()
    scorer = lm.Scorer.__new__(lm.Scorer)
    scorer.model, scorer.tables = model, lm.tables_of(model.weights)
    rng = np.random.default_rng(5)
    texts = [[*rng.integers(0, 39, n).tolist(), 39] for n in (0, 1, 7, 8, 9, 16, 50)]
    scores = scorer.logs(np.array([i for t in texts for i in t], np.uint32), np.array(list(map(len, texts))))
    for text, found in zip(texts, scores):
        assert found == pytest.approx(sum(plain_log(model, text, p) for p in range(len(text))), abs=2e-3)


def test_probabilities_of_all_next_ids_add_up_to_one():
    model = a_model()
    for context in ([], [3, 5], list(range(20))):
        assert sum(10 ** plain_log(model, [*context, i], len(context)) for i in range(40)) == pytest.approx(1)


def test_gradients_of_the_model():
    model = a_model(9)
    w = {k: x.astype(np.float64) for k, x in model.weights.items()}
    rng = np.random.default_rng(1)
    now, before = rng.integers(0, 40, (3, lm.STEP)), rng.integers(0, 40, (3, lm.STEP))
    kinds, real = rng.integers(0, 30, (3, lm.STEP)), rng.random((3, lm.STEP)) < 0.8
    loss = lambda: lm.gradients(w, now, before, np.array([True, False, False]), kinds, real)
    _, found = loss()
    for name, x in w.items():
        for place in rng.integers(0, x.size, 6).tolist():
            place = place % (40 * lm.WIDTH) if name == "embed" else place
            flat, step = x.reshape(-1), 1e-5
            flat[place] += step
            up = loss()[0]
            flat[place] -= 2 * step
            down = loss()[0]
            flat[place] += step
            assert found[name].reshape(-1)[place] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-6), name


def expected_base(texts, held_out):
    counts, total = Counter(), 0
    for i, text in texts:
        if not held_out(i):
            counts.update([*plain_words(text), b"\n"])
    total = sum(counts.values())
    scale = total + 0.5 * (len(counts) + 1)
    return total, {i: (len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.5) / scale) for x in w))
                   for i, text in texts for w in [[*plain_words(text), b"\n"]]}


def test_query_on_whole_table(spark):
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    total, expected = expected_base(texts, lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    rows = QUERIES["op11_attention_lm"](spark, SF).collect()
    assert len(rows) == len(texts) and len({r.doc_id for r in rows}) == len(texts)
    for r in rows:
        n, known, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_learning_helps_on_texts_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    usable = ~in_fold(F.col("doc_id"), 5, 1)
    means = []
    for rounds in (0, 2):
        model = lm.fit(docs, usable, rounds=rounds, rate=8)
        rows = lm.score(docs.where(~usable), model).agg(F.sum("lm.score"), F.sum("lm.n_tokens")).first()
        means.append(rows[0] / rows[1])
    assert means[1] > means[0] + 0.5


def test_rare_words_are_joined(spark):
    docs = documents(spark, "a b b c", "A b d", "", None, "c c x", "a b b c")
    total, expected = expected_base([(i, t or "") for i, t in enumerate(["a b b c", "A b d", "", None, "c c x", "a b b c"])], lambda i: i == 4)
    docs = docs.withColumnsRenamed({"row": "judged", "ids": "lm"}).withColumn("row_number", F.lit(1)).withColumn("more", F.lit(2))
    for head in (0, 1, 3, 1000):
        model = lm.fit(docs, F.col("doc_id") != 4, head=head, rate=1)
        rows = {r.doc_id: r for r in lm.score(docs, model).collect()}
        assert model.train_tokens == total and len(model.head[0]) <= head
        for i, (n, known, base) in expected.items():
            assert (rows[i].lm.n_tokens, rows[i].lm.n_known, rows[i].more, rows[i].row_number) == (n, known, 2, 1)
            assert rows[i].lm.base_score == pytest.approx(base)


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    model = lm.fit(docs, F.lit(True))
    rows = lm.score(docs, model).collect()
    assert len(rows) == 8 and all(r.lm.n_known == r.lm.n_tokens and math.isfinite(r.lm.score) for r in rows)
    assert len({r.lm for r in rows if r.doc_id == 5}) == 1 and {r.lm.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    nothing = lm.fit(empty(spark), F.lit(True))
    assert nothing.train_tokens == 0 and lm.score(empty(spark), nothing).count() == 0
    scored = lm.score(docs, nothing).collect()
    assert all(r.lm.n_known == 0 and abs(r.lm.base_score) < 1e-6 and math.isfinite(r.lm.score) for r in scored)


def test_every_window_of_the_training_texts_is_learned_from(spark, monkeypatch):
    """By default no window is left out, and the rounds share them: each is learned from once."""
    rows = documents(spark, *[" ".join(f"w{i * j % 91}" for j in range(200 + i)) for i in range(40)], "", None)
    kept = []
    monkeypatch.setattr(lm, "_learned", lambda windows, model, rounds: kept.append(windows) or model.weights)
    lm.fit(rows, F.col("doc_id") != 4)
    words = lm.Words(RANKS)
    expected = Counter()
    end = max(RANKS.values()) + 1
    for r in rows.where("doc_id <> 4").collect():
        ids, counts = lm.sequences(words, [(r.text or "").encode().lower()], end)[2:]
        expected.update(map(bytes, lm.windows(ids, counts, end + 1, end + 2)[1].astype("<u4")))
    found = Counter()
    for r in kept[0].collect():
        found.update(map(bytes, np.frombuffer(r.ids, "<u4").reshape(-1, 2 * lm.STEP + 1)[:, -lm.STEP:].copy()))
    assert found == expected and sum(found.values()) > 1000


def test_a_worker_keeps_one_scorer_and_the_words_that_it_counted(monkeypatch):
    """Workers outlive a query: scorers of models before, each with words of its own, filled their memory."""
    monkeypatch.setattr(common, "_WORKER_STATE", {})
    shipped = SimpleNamespace(value=RANKS)
    words = lm._words("file", shipped)
    models = [a_model(seed) for seed in (1, 2, 3)]
    scorers = [lm._scorer(model, lm._words("file", shipped)) for model in models]
    assert all(s.words is words for s in scorers) and [s.model for s in scorers] == models
    assert lm._scorer(models[2], words) is scorers[2] and list(common._WORKER_STATE[("attention",)].values()) == [scorers[2]]


def test_gradients_of_many_windows_are_those_of_its_parts(monkeypatch):
    model, rng = a_model(4), np.random.default_rng(2)
    now, before = rng.integers(0, 40, (9, lm.STEP)), rng.integers(0, 40, (9, lm.STEP))
    kinds, real, first = rng.integers(0, 30, (9, lm.STEP)), rng.random((9, lm.STEP)) < 0.8, rng.random(9) < 0.3
    found = []
    for together in (2, 9):
        monkeypatch.setattr(lm, "TOGETHER", together)
        found.append(lm.gradients(model.weights, now, before, first, kinds, real))
    assert found[0][0] == pytest.approx(found[1][0], rel=1e-5)
    for name, x in found[0][1].items():
        assert x == pytest.approx(found[1][1][name], rel=1e-3, abs=1e-5), name
