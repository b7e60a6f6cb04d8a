"""Scores of texts by a small causal self-attention model over subword ids, beside a plain count of words.

One pass over the training texts counts words and subword ids and keeps their windows of ids. The model learns from every
window, each in one of some rounds: every task trains on its own ones from the parameters of the round before, and the results
are averaged, each embedding weighing what it was seen. Windows, tasks and counts all grow with the corpus.

A window holds ``2 * STEP`` inputs; the later half is scored, the earlier one is context. So windows overlap, every token
is scored once, and a batch of windows is one masked attention. The next id's probability is that of its class by
attention, times the id's share of its class in the counts; the commonest ids are classes of their own.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import session, stored, worker_state
from .lexicon import PART, REMEMBERED, Lexicon, split

TOKENIZER_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Inputs scored by a window, of twice as many; numbers of an embedding; ids with an embedding of their own, and shared ones.
STEP, WIDTH, OWN, SHARED = 8, 8, 4096, 256
#: Classes of the next id: the commonest ids, and groups of the others.
COMMON, GROUPS = 48, 16
#: One window in so many is learned from; rounds; windows of a step of descent; its first length.
RATE, ROUNDS, BATCH, LEARN = 1, 2, 128, 0.05
#: After so many steps, each has so many times as many windows: less work a window.
EARLY, LATER = 64, 8
#: Windows that are scored together.
TOGETHER = 256
#: Words whose counts every task gets.
HEAD = 1 << 18
#: Stands for the hash of the end of a text, which counts as a word.
END_KEY = 0
WORD, SUBWORD, WINDOW = 0, 1, 2


# ---------------------------------------------------------------- words and their ids


def read_ranks(tokenizer_file: str) -> dict[bytes, int]:
    """A tokenizer's tokens: bounded content, read by the driver and sent to the tasks."""
    with open(tokenizer_file, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Words(Lexicon):
    """Words by number: their hashes and subword ids, for as many words as a task remembers.

    A word is encoded with a space before it, by itself: what stands around it does not change its ids.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = REMEMBERED):
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))
        super().__init__(limit)

    def _spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has; no token spans the space between two."""
        texts = [word.decode("utf-8", "replace") for word in words]
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(texts)), np.uint32)
        sizes = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
        owner = np.searchsorted(np.cumsum(sizes), np.cumsum(self.lengths[ids]))
        return ids, np.bincount(owner, minlength=len(words))


def _batches(texts: list[str], size: int = PART) -> Iterator[list[bytes]]:
    """Texts as UTF-8, about ``size`` bytes at a time; only A to Z are lowered."""
    held, length = [], 0
    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass").lower())
        length += len(held[-1])
        if length >= size:
            yield held
            held, length = [], 0
    if held:
        yield held


def sequences(words: Words, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts with words a text, and all ids, each text's ended by ``end``, with ids a text."""
    data, starts, ends, bounds = split(texts)
    numbers = words.look(data, starts, ends)
    ids, sizes = words.spell(numbers)
    before = np.append(0, np.cumsum(sizes))[bounds]
    return numbers, np.diff(bounds), np.insert(ids, before[1:], np.uint32(end)), np.diff(before) + 1


def windows(ids: np.ndarray, counts: np.ndarray, start: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets ``[window, STEP]`` of texts, the texts of the windows, and which are a text's first.

    The input before a target is the id before it, ``start`` at a text's beginning; ``pad`` fills a text's last window.
    """
    n = -(-counts // STEP)
    text = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first * STEP, counts)
    targets = np.full(int(n.sum()) * STEP, pad, np.uint32)
    targets[place] = ids
    inputs = np.append(np.uint32(start), targets[:-1])
    inputs[first * STEP] = start
    is_first = np.zeros(len(text), bool)
    is_first[first] = True
    return inputs.reshape(-1, STEP), targets.reshape(-1, STEP), text, is_first


# ---------------------------------------------------------------- the model


#: How far an input lies before another, by places in a window, and what an input does not see: what comes after it.
DISTANCE = np.arange(STEP)[:, None] + STEP - np.arange(2 * STEP)[None, :]
MASK = np.where(DISTANCE >= 0, 0, -1e9).astype(np.float32)
DISTANCE = np.maximum(DISTANCE, 0)
ALL = np.ones(COMMON + GROUPS, np.float32)
#: Instead of exp(x), (1 + x / 16) ** 16: four squarings. It falls no lower than LEAST ** 16; a sum has at least TINY.
LEAST, TINY = np.float32(0.05), np.float32(1e-6)


def power(t: np.ndarray) -> np.ndarray:
    """The 16th power, in place."""
    for _ in range(4):
        np.multiply(t, t, out=t)
    return t


@dataclass
class Model:
    vocabulary: int  # the end of a text is the id after the last one, then the start and the filling
    slot: np.ndarray  # an id's embedding
    kind: np.ndarray  # an id's class
    share: np.ndarray  # the logarithm of its share of the class
    weights: dict[str, np.ndarray]
    head: tuple[np.ndarray, np.ndarray]  # hashes of the commonest words in order, and their counts
    rest: DataFrame | None  # (hash, n) of the others
    train_tokens: int
    train_words: int
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def shipped(self) -> Model:
        """Without the table that stays in Spark."""
        return Model(self.vocabulary, self.slot, self.kind, self.share, self.weights, self.head, None, self.train_tokens,
                     self.train_words, self.name)


def beginning(shares: np.ndarray, n_slots: int) -> dict[str, np.ndarray]:
    """Parameters to start from: the classes by their counts, whatever comes before."""
    random = np.random.default_rng(7)
    draw = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
    return {
        "embed": draw(n_slots, WIDTH), "query": draw(WIDTH, WIDTH), "key": draw(WIDTH, WIDTH), "value": draw(WIDTH, WIDTH),
        "keep": draw(WIDTH, WIDTH), "far": np.zeros(2 * STEP, np.float32), "out": np.zeros((WIDTH, len(shares)), np.float32),
        "base": (16 * (shares ** (1 / 16) - 1)).astype(np.float32),
    }


SCALE = np.float32(1 / (16 * np.sqrt(WIDTH)))


def tables_of(w: dict) -> dict:
    """What is the same for all windows: embeddings times matrices, and sums of constants."""
    embed = w["embed"]
    return {
        "query": embed @ w["query"] * SCALE, "key": embed @ w["key"], "keep": embed @ w["keep"],
        "value": np.pad(embed @ w["value"], ((0, 0), (0, 1)), constant_values=1),  # the last column adds up the weights
        "far": 1 + w["far"][DISTANCE] / 16 + MASK, "out": w["out"] / 16, "base": 1 + w["base"] / 16,
    }


def attend(tables: dict, now: np.ndarray, before: np.ndarray, is_first: np.ndarray) -> tuple:
    """Hidden states of windows of slots, given those of the windows before them, and what the gradient needs."""
    q = tables["query"].take(now, axis=0)
    k = np.concatenate([tables["key"].take(before, axis=0), tables["key"].take(now, axis=0)], axis=1)
    v = np.concatenate([tables["value"].take(before, axis=0), tables["value"].take(now, axis=0)], axis=1)
    t = q @ k.transpose(0, 2, 1)
    t += tables["far"]
    t[is_first, :, :STEP] = 0
    np.maximum(t, 0, out=t)
    weights = power(t.copy())
    mixed = weights @ v
    total = mixed[:, :, WIDTH:] + TINY
    mixed = mixed[:, :, :WIDTH] / total
    hidden = mixed + tables["keep"].take(now, axis=0)
    return np.maximum(hidden, 0), hidden, t, weights, total, q, k, v, mixed


def class_logs(tables: dict, hidden: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The logarithm of the probability of each state's class, and what the gradient needs."""
    t = hidden @ tables["out"]
    t += tables["base"]
    np.maximum(t, LEAST, out=t)
    odds = power(t.copy())
    total = odds @ ALL
    return np.log(odds[np.arange(len(kinds)), kinds] / total), t, odds, total


def summed(slots: np.ndarray, rows: np.ndarray, n_slots: int) -> np.ndarray:
    """The sum of each slot's rows; slots are below 65,536."""
    order = np.argsort(slots.astype(np.uint16), kind="stable")
    ordered = slots[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    out = np.zeros((n_slots, rows.shape[1]), rows.dtype)
    out[ordered[first]] = np.add.reduceat(rows[order], first)
    return out


def gradients(w: dict, now: np.ndarray, before: np.ndarray, is_first: np.ndarray, kinds: np.ndarray, real: np.ndarray) -> tuple[float, dict]:
    """The mean loss of windows, and its derivatives. ``real`` marks targets that are no filling.

    ``TOGETHER`` windows at a time, whose arrays fit a processor's cache; embeddings get the sums of their slots.
    """
    n, tables, loss = max(int(real.sum()), 1), tables_of(w), 0.0
    embed = w["embed"]
    out = {name: np.zeros_like(w[name]) for name in ("out", "base", "far")}
    as_now, as_seen = [], []
    for at in range(0, len(now), TOGETHER):
        some = slice(at, at + TOGETHER)
        active, hidden, t, weights, total, q, k, v, mixed = attend(tables, now[some], before[some], is_first[some])
        flat, wanted, here = active.reshape(-1, WIDTH), kinds[some].reshape(-1), real[some].reshape(-1)
        logs, s, d, sums = class_logs(tables, flat, wanted)
        loss -= float((logs * here).sum())
        part = (here / n).astype(d.dtype)
        d *= (part / sums)[:, None]
        d[np.arange(len(d)), wanted] -= part
        d /= s
        d[s <= LEAST] = 0
        out["out"] += flat.T @ d
        out["base"] += d.sum(axis=0)
        d_hidden = (d @ w["out"].T).reshape(hidden.shape)
        d_hidden *= hidden > 0
        weights /= total
        d_value = weights.transpose(0, 2, 1) @ d_hidden
        d_x = d_hidden @ v[:, :, :WIDTH].transpose(0, 2, 1)
        d_x -= (d_hidden * mixed).sum(axis=2, keepdims=True)
        d_x *= weights
        d_x /= np.where(t > 0, t, 1)
        out["far"] += np.bincount(DISTANCE.reshape(-1), d_x.sum(axis=0).reshape(-1), 2 * STEP).astype(d_x.dtype)
        as_now.append(np.concatenate([d_x @ k, d_hidden], axis=2).reshape(-1, 2 * WIDTH))
        as_seen.append(np.concatenate([d_x.transpose(0, 2, 1) @ q, d_value], axis=2).reshape(-1, 2 * WIDTH))
    of_now = summed(now.reshape(-1), np.concatenate(as_now), len(embed))
    of_seen = summed(np.concatenate([before, now], axis=1).reshape(-1), np.concatenate(as_seen), len(embed))
    d_embed = np.zeros_like(embed)
    for name, part in (("query", of_now[:, :WIDTH] * (16 * SCALE)), ("keep", of_now[:, WIDTH:]),
                       ("key", of_seen[:, :WIDTH] * 16), ("value", of_seen[:, WIDTH:])):
        out[name] = embed.T @ part
        d_embed += part @ w[name].T
    out["embed"] = d_embed
    return loss / n, out


class Descent:
    """Adam over all parameters."""

    def __init__(self, weights: dict, learn: float):
        self.w = {k: x.copy() for k, x in weights.items()}
        self.learn, self.steps = learn, 0
        self.mean = {k: np.zeros_like(x) for k, x in weights.items()}
        self.square = {k: np.zeros_like(x) for k, x in weights.items()}

    def step(self, change: dict) -> None:
        self.steps += 1
        for k, g in change.items():
            g = g.astype(self.w[k].dtype)
            self.mean[k] += (g - self.mean[k]) * 0.1
            self.square[k] += (g * g - self.square[k]) * 0.01
            m = self.mean[k] / (1 - 0.9**self.steps)
            s = self.square[k] / (1 - 0.99**self.steps)
            self.w[k] -= self.learn * m / (np.sqrt(s) + 1e-6)


# ---------------------------------------------------------------- learning


def _words(name: str, shipped) -> Words:
    """A worker's words, the same for counting and for scoring, by whatever model."""
    return worker_state(("subwords", name), lambda: Words(shipped.value))


def _gathered(texts: DataFrame, shipped, name: str, vocabulary: int, rate: int) -> DataFrame:
    """``(kind, key, n, ids)``: counts of words and of subword ids by task, and the windows to learn from, some together."""
    end, start, pad = vocabulary, vocabulary + 1, vocabulary + 2

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(name, shipped)
        seen = np.zeros(0, np.int64)
        ends = 0

        def counted() -> pd.DataFrame:
            used = np.flatnonzero(seen)
            ids, sizes = words.spell(used)
            totals = np.bincount(ids, np.repeat(seen[used], sizes), vocabulary).astype(np.int64)
            of = np.flatnonzero(totals)
            return pd.DataFrame({
                "kind": np.repeat([WORD, SUBWORD, WORD, SUBWORD], [len(used), len(of), 1, 1]).astype(np.int32),
                "key": np.concatenate([words.hashes[used], of, [END_KEY, end]]),
                "n": np.concatenate([seen[used], totals[of], [ends, ends]]), "ids": None})

        for batch in batches:
            for some in _batches(batch["text"].tolist()):
                numbers, _, ids, counts = sequences(words, some, end)
                ends += len(some)
                seen = np.pad(seen, (0, len(words.hashes) - len(seen))) + np.bincount(numbers, minlength=len(words.hashes))
                inputs, targets, text, is_first = windows(ids, counts, start, pad)
                digests = np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(some))
                order = np.arange(len(text), dtype=np.uint64) - np.repeat(np.flatnonzero(is_first), -(-counts // STEP)).astype(np.uint64)
                drawn = (digests[text] ^ order * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                chosen = np.flatnonzero((drawn >> np.uint64(33)) % np.uint64(rate) == 0)
                earlier = np.where(is_first[chosen, None], np.uint32(pad), inputs[chosen - 1])
                # the other inputs are the targets before them
                rows = np.concatenate([earlier, inputs[chosen, :1], targets[chosen]], axis=1).astype("<u4")
                yield pd.DataFrame({"kind": np.int32(WINDOW), "key": np.int64(0), "n": np.int64(len(rows)), "ids": [rows.tobytes()]})
                if words.full():
                    yield counted()
                    words.forget()
                    seen, ends = np.zeros(0, np.int64), 0
        yield counted()

    return texts.mapInPandas(gather, "kind int, key long, n long, ids binary")


def _learned(kept: DataFrame, model: Model, rounds: int) -> dict[str, np.ndarray]:
    """Parameters after some rounds, each the average of what the tasks have learned from their windows of the round."""
    spark, weights = kept.sparkSession, model.weights
    pad, slot, kind = model.vocabulary + 2, model.slot, model.kind
    names = sorted(weights)
    sizes = [weights[k].size for k in names]
    flat = lambda w: np.concatenate([np.asarray(w[k]).reshape(-1) for k in names])
    one = 1 << 24  # parameters are added up as whole numbers of this part, so that the order does not matter
    for i in range(rounds):
        shipped = spark.sparkContext.broadcast((weights, slot, kind))
        learn = LEARN / (1 + i)

        def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start, slot, kind = shipped.value
            descent, seen, n = Descent(start, learn), np.zeros(len(start["embed"]), np.int64), 0
            for batch in batches:
                rows, at = np.frombuffer(b"".join(batch["ids"]), "<u4").reshape(-1, 2 * STEP + 1)[i::rounds], 0
                while at < len(rows):
                    some = rows[at:at + (BATCH if descent.steps < EARLY else BATCH * LATER)]
                    at += len(some)
                    before, now, targets = some[:, :STEP], some[:, STEP:-1], some[:, STEP + 1:]
                    real = targets != pad
                    _, change = gradients(descent.w, slot[now], slot[before], before[:, 0] == pad, kind[targets], real)
                    descent.step(change)
                    seen += np.bincount(slot[now].reshape(-1), minlength=len(seen))
                    n += len(some)
            weight = {k: np.full(x.shape, n, np.int64) for k, x in start.items()}
            weight["embed"] = np.repeat(seen[:, None], WIDTH, axis=1)
            w = flat(weight)
            used = np.flatnonzero(w)
            value = np.rint(np.clip(flat(descent.w)[used], -100, 100) * one).astype(np.int64)
            yield pd.DataFrame({"i": used, "value": value, "weight": w[used]})

        added = kept.mapInPandas(train, "i long, value long, weight long").groupBy("i").agg(
            F.sum(F.col("value").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")).alias("value"),
            F.sum("weight").alias("weight")).select(
                "i", (F.col("value").cast("double") / F.col("weight") / one).alias("value")).toPandas()
        new = flat(weights).astype(np.float64)
        new[added["i"].to_numpy(np.int64)] = added["value"].to_numpy(np.float64)
        parts = np.split(new.astype(np.float32), np.cumsum(sizes)[:-1])
        weights = {k: part.reshape(weights[k].shape) for k, part in zip(names, parts)}
    return weights


def ranks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Embedding, class, share of the class and the classes' shares for ids with these counts; the number of embeddings.

    The last two ids are the start and the filling, which never come next.
    """
    n = len(counts) - 2
    order = np.lexsort((np.arange(n), -counts[:n]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    slot = np.append(np.where(place < OWN, place, OWN + place % SHARED), [OWN + SHARED, OWN + SHARED + 1])
    # groups of the rarer ids, of about equal counts
    smooth = counts[:n] + 0.5
    rare = order[COMMON:]
    upto = np.cumsum(smooth[rare])
    kind = place.copy()
    if len(rare):
        kind[rare] = COMMON + np.minimum(GROUPS * upto / (upto[-1] * (1 + 1e-9)), GROUPS - 1).astype(np.int64)
    totals = np.bincount(kind, smooth, COMMON + GROUPS)
    share = np.append(np.log(smooth / totals[kind]), [0.0, 0.0])
    classes = np.maximum(totals, 1e-9) / totals.sum()
    return slot, np.append(kind, [0, 0]), share, classes, OWN + SHARED + 2


def fit(docs: DataFrame, usable: Column, text: str = "text", tokenizer_file: str = TOKENIZER_FILE, rounds: int = ROUNDS,
        rate: int = RATE, head: int = HEAD) -> Model:
    """Counts over the texts of rows that ``usable`` allows, and a model that has learned from their windows.

    Null text counts as empty, which is an end and nothing else; repeated rows count as often as they are there. Without
    rows nothing is known, and every class is as likely as its number of ids says. Words are counted by 64-bit hashes.
    The driver holds the parameters, a count for each subword id, and at most ``head`` of the commonest words.
    """
    spark = session(docs.sparkSession)
    tokens = read_ranks(tokenizer_file)
    vocabulary, shipped = max(tokens.values()) + 1, spark.sparkContext.broadcast(tokens)
    texts = docs.where(usable).select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = stored(_gathered(texts, shipped, tokenizer_file, vocabulary, rate), "gathered")
    counts = stored(found.where(F.col("kind") < WINDOW).groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0"), "counts")
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("hash"), "n")
    whole = words.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    ids = np.zeros(vocabulary + 3, np.int64)
    for row in counts.where(F.col("kind") == SUBWORD).select("key", "n").collect():  # at most the vocabulary
        ids[row["key"]] = row["n"]
    slot, kind, share, classes, n_slots = ranks(ids)
    # as many of the commonest words as fit: from the first count level whose words, with all above, are few enough
    levels = words.groupBy(F.floor(8 * F.log2("n")).alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect()
    least, room = None, head
    for row in sorted(levels, key=lambda r: -r["level"]):
        room -= row["words"]
        if room < 0:
            break
        least = row["n"]
    common = words.where(F.col("n") >= (least if least is not None else 1 << 62)).orderBy("hash").toPandas()
    rest = words.where(F.col("n") < (least if least is not None else 1 << 62))
    model = Model(vocabulary, slot, kind, share, beginning(classes, n_slots), (common["hash"].to_numpy(np.int64), common["n"].to_numpy(np.int64)),
                  rest, int(whole["n"] or 0), int(whole["words"] or 0))
    model.weights = _learned(found.where(F.col("kind") == WINDOW).select("ids"), model, rounds)
    return model


# ---------------------------------------------------------------- scoring


class Scorer:
    def __init__(self, model: Model, words: Words):
        self.words, self.model = words, model
        self.tables, self.forgotten = tables_of(model.weights), -1

    def _count(self) -> None:
        """Logarithms of the counts of the words remembered, for the common ones; the others count as unknown here."""
        if self.forgotten != self.words.forgotten:
            self.forgotten, self.log, self.common = self.words.forgotten, np.zeros(0), np.zeros(0, bool)
        new = self.words.hashes[len(self.log):]
        hashes, counts = self.model.head
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, new), len(hashes) - 1)
            common, count = hashes[at] == new, counts[at]
        else:
            common, count = np.zeros(len(new), bool), np.zeros(len(new))
        self.log = np.append(self.log, np.log10(np.where(common, count, 0) + 0.5))
        self.common = np.append(self.common, common)

    def texts(self, texts: list[bytes]) -> tuple:
        """Of each text: words, logarithms of common words' counts, words known by them, others with their numbers, score."""
        words = self.words
        numbers, n_words, ids, counts = sequences(words, texts, self.model.vocabulary)
        self._count()
        bounds = np.append(0, np.cumsum(n_words))
        upto = lambda x: np.append(0, np.cumsum(x))[bounds]
        common = self.common[numbers]
        sums, n_known = np.diff(upto(self.log[numbers])), np.diff(upto(common.astype(np.int64)))
        rare = np.flatnonzero(~common)
        owner, n = np.searchsorted(bounds, rare, side="right") - 1, max(len(words.hashes), 1)
        pairs, times = np.unique(owner * n + numbers[rare], return_counts=True)
        cuts = np.searchsorted(pairs // n, np.arange(1, len(texts)))
        others = np.split(words.hashes[pairs % n], cuts)
        scores = self.logs(ids, counts)
        if words.full():
            words.forget()
        return n_words, sums, n_known, others, np.split(times, cuts), scores

    def logs(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The base-10 logarithm of each text's probability."""
        model = self.model
        inputs, targets, text, is_first = windows(ids, counts, model.vocabulary + 1, model.vocabulary + 2)
        slots = model.slot[inputs]
        real = targets != model.vocabulary + 2
        kinds, out = model.kind[targets], np.where(real, model.share[targets], 0.0).sum(axis=1)
        for at in range(0, len(slots), TOGETHER):
            now = slots[at:at + TOGETHER]
            before = slots[np.maximum(np.arange(at, at + len(now)) - 1, 0)]
            active = attend(self.tables, now, before, is_first[at:at + TOGETHER])[0]
            logs = class_logs(self.tables, active.reshape(-1, WIDTH), kinds[at:at + TOGETHER].reshape(-1))[0]
            out[at:at + TOGETHER] += np.where(real[at:at + TOGETHER], logs.reshape(now.shape), 0).sum(axis=1, dtype=np.float64)
        return np.bincount(text, out, len(counts)) / np.log(10)


def _scorer(model: Model, words: Words) -> Scorer:
    """A worker's scorer; that of a model before is let go."""
    held = worker_state(("attention",), dict)
    if model.name not in held:
        held.clear()
        held[model.name] = Scorer(model, words)
    return held[model.name]


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "lm", tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """Add ``into``: ``n_tokens`` (words and an end), ``n_known`` (those counted in training), ``base_score`` and ``score``.

    ``base_score`` is the base-10 logarithm of the text's probability by word counts, ``score`` by the attention model.
    Null text counts as empty: an end alone. Rows are scored each for itself, equal texts alike; other columns pass
    unchanged, one called ``into`` is replaced; an empty table gives none.

    Counts of the commonest words are sent to the tasks; the others of a text are joined by their hashes.
    """
    spark = session(docs.sparkSession)
    tokens = spark.sparkContext.broadcast(read_ranks(tokenizer_file))
    shipped = spark.sparkContext.broadcast(model.shipped())

    @pandas_udf("n long, logs double, known long, rare array<long>, times array<long>, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(shipped.value, _words(tokenizer_file, tokens))
        for batch in batches:
            parts = [scorer.texts(some) for some in _batches(batch.tolist())]
            columns = [[x for part in parts for x in part[i]] for i in range(6)]
            yield pd.DataFrame(dict(zip(("n", "logs", "known", "rare", "times", "score"), columns)))

    free = lambda name: next(x for x in (name, *(f"{name}_{i}" for i in range(len(docs.columns) + 1))) if x not in docs.columns)
    row, part = free("row_number"), free("judged")
    seen = stored(docs.withColumn(part, judged(F.coalesce(F.col(f"`{text}`"), F.lit("")))).withColumn(row, F.monotonically_increasing_id()), "judged")
    each = seen.select(F.col(row).alias("row"), F.explode(F.arrays_zip(F.col(f"{part}.rare"), F.col(f"{part}.times"))).alias("w"))
    each = each.select("row", F.col("w.rare").alias("hash"), F.col("w.times").alias("times"))
    zero = float(np.log10(0.5))
    found = each.join(model.rest, "hash").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - zero)).alias("more"), F.sum("times").alias("known_too"))
    found = found.withColumnsRenamed({"row": row, "more": free("more"), "known_too": free("known_too")})
    end_known = int(model.train_tokens > 0)  # every training text has an end
    hashes, counts = model.head
    ends = counts[hashes == END_KEY]
    in_rest = [r["n"] for r in model.rest.where(F.col("hash") == END_KEY).collect()] if not len(ends) else []
    n_ends = int(ends[0]) if len(ends) else sum(in_rest)
    whole = float(np.log10(model.train_tokens + 0.5 * (model.train_words + 1)))
    n_tokens = F.col(f"{part}.n") + 1
    base = F.col(f"{part}.logs") + F.coalesce(F.col(free("more")), F.lit(0.0)) + float(np.log10(n_ends + 0.5)) - n_tokens * whole
    known = F.col(f"{part}.known") + F.coalesce(F.col(free("known_too")), F.lit(0)) + end_known
    return seen.join(found, row, "left").withColumn(into, F.struct(
        n_tokens.alias("n_tokens"), known.alias("n_known"), base.alias("base_score"), F.col(f"{part}.score").alias("score"),
    )).select(*[f"`{c}`" for c in docs.columns if c != into], into)
