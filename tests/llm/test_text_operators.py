import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cvegrid.llm import bpe_prefix, huffman, personal, repetition, secret_scan
from cvegrid.llm.queries import QUERIES
from cvegrid.llm.spans import fingerprint, joined
from cvegrid.session import scratch

from .helpers import awkward, documents, empty

SF = "/root/testdata/sf0.001"


def texts_of(spark, folder=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


# ---------------------------------------------------------------- personal data


def plain_personal(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


@pytest.mark.parametrize("alphabet", ["a@.b-_c%é 1", "0123456789 .-+()", "1.2 -+4@a(", "0055.. -"])
def test_personal_base_is_leftmost_and_non_overlapping(alphabet):
    rnd = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        assert sorted(personal.find_base(text)) == sorted(plain_personal(text)), text


def test_personal_query_on_whole_table(spark):
    rows = {r.doc_id: r for r in QUERIES["op1_personal_bootstrap"](spark, SF).collect()}
    for doc_id, text in texts_of(spark).items():
        spans = plain_personal(text)
        order = {k: i for i, k in enumerate(personal.KINDS)}
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]])))
        assert rows[doc_id].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert rows[doc_id].n_email == sum(s[0] == "email" for s in spans)
        assert not line or set(line.split(",")) <= set(rows[doc_id].spans.split(","))


def test_patterns_of_seeds_find_the_unknown(spark):
    seeds = [f"please call +1 (555) 555-01{i:02} now" for i in range(8)]
    found = personal.extract(documents(spark, *seeds, "please call 555 0199 now", "the year 555 0198 ended")).collect()
    spans = {r.doc_id: [(s.start, s.end, s.kind) for s in r.added] for r in found}
    assert spans[8] == [(12, 20, "phone")] and not any(v for k, v in spans.items() if k != 8)
    assert all(len(r.base) == (r.doc_id < 8) for r in found)


def test_personal_awkward_rows(spark):
    rows = personal.extract(awkward(spark)).collect()
    assert len(rows) == 8 and sum(len(r.base) for r in rows) == 1
    assert personal.extract(empty(spark)).count() == 0


# ---------------------------------------------------------------- secrets


def plain_secrets(text):
    names = "(?:(?i:password|passwd|secret|token|api_?key))"
    out = [("assign", *m.span()) for m in re.finditer(rf"""{names}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[1]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


def test_secret_base_on_made_texts(spark):
    rnd = random.Random(3)
    parts = ["token", "=", ":", " ", "'", "AKIA", "ABCDEFGHIJKLMN0", "0123456789abcdef", "Password", "api_key", "ſecret", "é", "zz", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    found = secret_scan.find(documents(spark, *texts)).select("doc_id", joined(F.col("base")).alias("line")).collect()
    order = {k: i for i, k in enumerate(secret_scan.KINDS)}
    for row in found:
        spans = sorted(plain_secrets(texts[row.doc_id]), key=lambda s: (s[1], order[s[0]]))
        assert row.line == ",".join(f"{k}:{a}:{b}" for k, a, b in spans), texts[row.doc_id]


def test_copied_examples_and_owned_secrets(spark):
    copied, owned, mixed = "token=mnopmnopmnopmnop", "token=zyxwzyxwzyxwzyxw", "Qw3rtyQw3rtyQw3rty99xx"
    docs = documents(spark, *[f"see {copied} here"] * 9, f"mine {owned} and {mixed} end", source=lambda i: f"s{i}")
    rows = {r.doc_id: r for r in secret_scan.find(docs).collect()}
    assert (rows[0].n_owned, rows[0].n_copied) == (0, 1) and rows[9].n_owned == 2
    assert [(s.start, s.end) for s in rows[9].added] == [(32, 54)]
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert masked[0] == f"see {copied} here"
    assert masked[9] == "mine [REDACTED] and [REDACTED] end"


def test_secret_awkward_rows(spark):
    docs = awkward(spark)
    rows = secret_scan.find(docs).collect()
    assert len(rows) == 8 and sum(r.n_owned for r in rows) == 2  # an assignment and the hexadecimal digits in it
    kept = secret_scan.redact(docs)
    assert kept.columns == docs.columns and kept.count() == 8
    assert "abcdefabcdef123456" not in "".join(r.text or "" for r in kept.collect())
    assert secret_scan.find(empty(spark)).count() == secret_scan.redact(empty(spark)).count() == 0


# ---------------------------------------------------------------- repetition


def plain_repeats(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def test_suffix_array_gives_longest_and_maximal_repeats():
    rnd = random.Random(5)
    for _ in range(150):
        lists = [[rnd.randint(0, 2) for _ in range(rnd.randint(0, 30))] for _ in range(3)]
        ids, text = np.array(sum(lists, []), np.int64), np.repeat(np.arange(3), [len(x) for x in lists])
        if not len(ids):
            continue
        order, common = repetition.suffix_array(ids, text)
        longest = repetition.longest_repeats(order, common)
        assert longest.tolist() == sum(map(plain_repeats, lists), [])
        marked = np.zeros(len(ids), bool)
        for length, starts in repetition.maximal_repeats(order, common, ids, text, 2):
            assert len({tuple(ids[s:s + length]) for s in starts}) == 1 < len(starts)
            for s in starts:
                marked[s:s + length] = True
        assert (marked == repetition.covered(longest, 2)).all()


def test_repetition_query_on_whole_table(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_suffix_repetition"](spark, SF).collect()}
    for doc_id, text in texts_of(spark).items():
        words, r = re.findall(r"[^\x20\x09-\x0D]+", text), rows[doc_id]
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        if twice is not None:
            places = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
            assert r.n_repeat_words == len(places)
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_repetition_verdict_and_awkward_rows(spark):
    unit = " ".join(f"w{i}" for i in range(205))
    fresh = " ".join(f"v{i}" for i in range(3000))
    docs = documents(spark, f"{unit} {fresh} {unit}", fresh, "one two " * 200, "few words")
    kept = {r.doc_id: r.repetition.kept for r in repetition.judge(docs).collect()}
    assert kept == {0: False, 1: True, 2: False, 3: False}
    out = repetition.judge(awkward(spark))
    assert out.count() == 8 and out.columns == awkward(spark).columns + ["repetition"]
    assert out.where("doc_id = 1").first().repetition.n_words == 0
    assert repetition.judge(empty(spark)).count() == 0


def test_words_said_a_few_times_in_a_row_are_rejected(spark):
    runs = [" ".join(f"w{i} " * times for i in range(40)) for times in (3, 4, 5, 8)]
    fresh = " ".join(f"v{i}" for i in range(200))
    half = f"{fresh} " + " ".join(f"w{i} " * 5 for i in range(60))
    twice = f"{fresh} one two three four five six seven {fresh[:20]} one two three four five six seven"
    rows = {r.doc_id: r.repetition for r in repetition.judge(documents(spark, *runs, half, fresh, twice)).collect()}
    assert not any(r.base_failed for r in rows.values()) and all(r.longest_repeat < 8 for r in rows.values())
    assert [rows[i].kept for i in range(7)] == [False] * 5 + [True] * 2


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    with open(bpe_prefix.RANK_FILE, "rb") as file:
        ranks = bpe_prefix.load_ranks(file.read())
    return bpe_prefix.TextEncoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_comes_back(bpe):
    ours, library = bpe
    rnd = random.Random(8)
    for _ in range(1500):
        text = "".join(rnd.choice("aeéèßz .,'’中文字😀‍́0９\n\t<|>ſKﬁ\x1c\x85") for _ in range(rnd.randint(0, 30)))
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert ours.decode(ids).decode() == text


def test_bpe_appends_and_edits_are_exact(bpe):
    prefix, rnd = bpe[0].prefix, random.Random(9)
    for _ in range(120):
        data = "".join(rnd.choice("aeirstng hé") for _ in range(rnd.randint(1, 150))).encode()
        cut = rnd.randint(0, len(data))
        grown = prefix.extend(prefix.extend([], data[:cut]), data)
        assert prefix.path(grown) == prefix._merged(data)
        start = rnd.randint(0, len(data))
        stop, new = rnd.randint(start, min(len(data), start + 6)), bytes(rnd.choice(b"abcst") for _ in range(rnd.randint(0, 5)))
        table, edited = prefix.replace(grown, data, start, stop, new)
        assert edited == data[:start] + new + data[stop:] and table == prefix.extend([], edited)


def test_bpe_memo_of_prefixes_starts_anew_at_any_piece(bpe, monkeypatch):
    monkeypatch.setattr(bpe_prefix, "PREFIXES", 6)
    small = bpe_prefix.PrefixEncoder(bpe[0].prefix.ranks)
    for word in (" eaqx", " eaqxzzk", " eaqxzwv", " eaqxzwvk", " eaqxq", " eazzq", " eazzqj"):
        assert small.encode_piece(word.encode()) == bpe[1].encode_ordinary(word)


def test_bpe_query_on_whole_table(spark, bpe):
    rows = {r.doc_id: r for r in QUERIES["op9_bpe_prefix"](spark, SF).collect()}
    for doc_id, text in texts_of(spark).items():
        ids = np.array(bpe[1].encode_ordinary(text), "<u4")
        assert rows[doc_id].n_tokens == len(ids) and rows[doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_awkward_rows(spark):
    docs = awkward(spark)
    out = bpe_prefix.decode(bpe_prefix.encode(docs))  # a column called ids is there already
    assert [(r.text or "").encode() for r in docs.collect()] == [bytes(r.decoded) for r in out.collect()]
    assert bpe_prefix.encode(empty(spark)).count() == 0


def test_bpe_round_trip_is_one_pass(spark):
    docs = awkward(spark)
    once, twice = bpe_prefix.round_trip(docs), bpe_prefix.decode(bpe_prefix.encode(docs))
    assert once.columns == twice.columns and sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert bpe_prefix.round_trip(empty(spark)).count() == 0
    # each Python step of a stage has a worker a task, with its own remembered pieces
    for rows in (QUERIES["op9_bpe_prefix"](spark, SF), corpus_pipeline.tokens(spark, docs, SF)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


# ---------------------------------------------------------------- Huffman coding


def test_code_lengths_are_optimal_within_the_limit():
    assert huffman.code_lengths({7: 5}) == {7: 1} and huffman.code_lengths({}) == {}
    assert sorted(huffman.code_lengths({1: 1, 2: 1, 3: 2, 4: 4}).items()) == [(1, 3), (2, 3), (3, 2), (4, 1)]
    steep = {i: 2**i for i in range(30)}
    limited = huffman.code_lengths(steep, 8)
    assert max(limited.values()) == 8 and sum(2.0**-x for x in limited.values()) <= 1


def test_blocks_come_back():
    rnd = random.Random(4)
    for n in [1, 2, 63, 64, 65, 128, 5000]:
        ids = np.array([min(int(rnd.expovariate(0.05)), 400) for _ in range(n)], np.uint32)
        counts = dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True))))
        codec = huffman.Codec(huffman.code_lengths(counts, 12), 12)
        bits, checkpoints = codec.pack(ids)
        assert (codec.unpack(bits, checkpoints, n) == ids).all()


def test_word_tokens_equal_the_library():
    with open(huffman.TOKENIZER_FILE, encoding="utf-8") as file:
        definition = file.read()
    ours, library, rnd = huffman.WordTokens(definition, 500), Tokenizer.from_str(definition), random.Random(6)
    texts = ["".join(rnd.choice("aeAEéÉßz .,'’中文字😀̌́‍0９\n\t<|>ſKﬁJHTİıΣσŁøĳŉ\u00a0\u2003 s'll!?*") for _ in range(rnd.randint(0, 25)))
             for _ in range(3000)]
    names = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "a", " ", "É", "x.", "<|", "|>"]
    texts += ["".join(rnd.choice(names) for _ in range(rnd.randint(1, 6))) for _ in range(600)]
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_names_of_special_tokens_are_one_id(spark):
    rows = huffman.tokenize(documents(spark, "a <|endoftext|>b", "<|startoftext|>"), end_id=None).orderBy("doc_id").collect()
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in rows]
    assert ids[0][1] == 49407 and len(ids[0]) == 3 and ids[1] == [49406]


def test_huffman_query_on_whole_table(spark):
    rows = sorted(QUERIES["op10_huffman_tokens"](spark, SF).collect(), key=lambda r: r.doc_id)
    library = Tokenizer.from_file(huffman.TOKENIZER_FILE)
    start = 0
    for row, (_, text) in zip(rows, sorted(texts_of(spark).items()), strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_huffman_awkward_rows(spark):
    for docs, n in ((awkward(spark), 8), (empty(spark), 0)):
        path = scratch(spark, "huffman")
        huffman.encode_and_write(docs, path)
        out = huffman.read(spark, path).orderBy("start").collect()
        assert len(out) == n
        if n:
            assert [r.doc_id for r in out] == [None, 1, 2, 3, 4, 5, 5, 6]
            assert [len(r.ids) // 4 for r in out][1:4] == [1, 1, 1]
            sizes = [len(r.ids) // 4 for r in out]
            assert [r.start for r in out] == [sum(sizes[:i]) for i in range(n)]


def test_span_text(spark):
    made = spark.sql("SELECT array(named_struct('start', 5, 'rank', 1, 'end', 9, 'kind', 'b'), named_struct('start', 5, 'rank', 0, 'end', 7, 'kind', 'a')) s")
    assert made.select(joined(F.col("s")), fingerprint(F.col("s"))).first()[0] == "a:5:7,b:5:9"
