"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded and pass through learned filters; the strongest response of every filter in a chunk goes through a
hidden layer to a logit. Overlapping chunks cover a whole text, and the mean of their logits gives its probability. The
network is trained on a bounded sample of labelled documents, in one task; scoring is a map over all documents.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import session

#: Bytes of a chunk, and how far the next one starts after it.
CHUNK, STEP = 512, 448
#: Embedding, filter width and stride in bytes (filters overlap), number of filters, hidden units.
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 4, 32, 16
#: Bound of the training sample: documents of each label, and chunks of a document.
SAMPLE, SAMPLE_CHUNKS = 2500, 4
EPOCHS, BATCH, RATE, SEED = 8, 64, 2e-3, 7
PAD = 256
#: Weight of label 1 against label 0; share of chunks cut short in training, and their least bytes.
KEEP, SHORT_SHARE, SHORTEST = 2.0, 0.4, 12
#: Chunks that pass through the filters together.
TOGETHER = 256


def chunks(text: str) -> np.ndarray:
    """All chunks of a text, the last one padded; an empty text is one chunk of padding."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = 1 + max(0, -(-(len(data) - CHUNK) // STEP))
    padded = np.full((n - 1) * STEP + CHUNK, PAD, np.int16)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    """Parameters by name; ``forward`` keeps what ``backward`` needs."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None):
        random = np.random.default_rng(SEED)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (random.standard_normal(shape) * scale).astype(np.float32)

        self.p = parameters or {
            "embed": normal(PAD + 1, EMBED, scale=0.5),
            "filters": normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }

    def _windows(self, x: np.ndarray) -> np.ndarray:
        """Every filter's input: chunk, place, embedded bytes."""
        embedded = self.p["embed"][x].reshape(len(x), CHUNK * EMBED)
        places = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        return np.ascontiguousarray(places)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        windows = self._windows(x)
        responses = windows @ self.p["filters"]
        best = responses.argmax(axis=1)
        pooled = np.take_along_axis(responses, best[:, None], axis=1)[:, 0] + self.p["filter_bias"]
        active = np.maximum(pooled, 0)
        hidden = np.tanh(active @ self.p["hidden"] + self.p["hidden_bias"])
        return hidden @ self.p["out"] + self.p["out_bias"], (x, windows, best, pooled, active, hidden)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), TOGETHER):
            pooled = (self._windows(x[i:i + TOGETHER]) @ self.p["filters"]).max(axis=1) + self.p["filter_bias"]
            hidden = np.tanh(np.maximum(pooled, 0) @ self.p["hidden"] + self.p["hidden_bias"])
            out.append(hidden @ self.p["out"] + self.p["out_bias"])
        return np.concatenate(out)

    def backward(self, kept: tuple, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients, given that of the loss by each chunk's logit."""
        x, windows, best, pooled, active, hidden = kept
        g = {"out": hidden.T @ slope, "out_bias": slope.sum(keepdims=True)}
        before = slope[:, None] * self.p["out"] * (1 - hidden**2)
        g["hidden"], g["hidden_bias"] = active.T @ before, before.sum(axis=0)
        at = (before @ self.p["hidden"].T) * (pooled > 0)
        g["filter_bias"] = at.sum(axis=0)
        rows = np.arange(len(x))[:, None]
        chosen = windows[rows, best]  # chunk, filter, input: only the strongest place of a filter learns
        g["filters"] = np.einsum("cf,cfi->if", at, chosen, optimize=True)
        inputs = (at[:, :, None] * self.p["filters"].T[None]).reshape(-1, EMBED)
        bytes_at = x[rows[:, :, None], (best * STRIDE)[:, :, None] + np.arange(WIDTH)]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], bytes_at.reshape(-1), inputs)
        return g

    def dump(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, **self.p)
        return file.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as file:
            return cls({name: file[name] for name in file.files})


def train(texts: list[str], labels: list[int]) -> Network:
    """Adam on the logistic loss of chunks, which carry their document's label.

    Label 1 weighs ``KEEP`` times label 0 as a whole. Some chunks are cut short in each step, so that short texts are
    known too.
    """
    random, network = np.random.default_rng(SEED), Network()
    if not texts:
        return network
    parts, target = [], []
    for text, label in zip(texts, labels):
        every = chunks(text)
        chosen = random.permutation(len(every))[:SAMPLE_CHUNKS]
        parts.append(every[chosen])
        target += [label] * len(chosen)
    x, y = np.concatenate(parts), np.array(target, np.float32)
    good, bad = max(float(y.mean()), 1e-6), max(float(1 - y.mean()), 1e-6)
    weight = np.where(y == 1, KEEP / (KEEP + 1) / good, 1 / (KEEP + 1) / bad).astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    steps = max(EPOCHS * -(-len(x) // BATCH), 400)  # few labels get more passes
    done, order = 0, np.zeros(0, np.int64)
    while done < steps:
        if len(order) < BATCH:
            order = np.concatenate([order, random.permutation(len(x))])
        batch, order = order[:BATCH], order[BATCH:]
        shown = x[batch]
        ends = np.exp(random.uniform(np.log(SHORTEST), np.log(CHUNK), len(batch)))
        ends[random.random(len(batch)) > SHORT_SHARE] = CHUNK
        shown[np.arange(CHUNK) >= ends[:, None]] = PAD
        logits, kept = network.forward(shown)
        slope = (weight[batch] * (1 / (1 + np.exp(-logits)) - y[batch]) / len(batch)).astype(np.float32)
        done += 1
        rate = RATE * min(1, 2 * (1 - done / steps) + 0.05)
        for name, g in network.backward(kept, slope).items():
            m, v = moments[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            network.p[name] -= (rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)).astype(np.float32)
    return network


def probabilities(network: Network, texts: list[str]) -> np.ndarray:
    """Whole texts: the mean of all chunks' logits, as a probability."""
    held = [chunks(t) for t in texts]
    sizes = np.array([len(c) for c in held])
    out, start = np.zeros(len(texts)), 0
    while start < len(texts):  # runs of texts, so that few chunks are in memory as bytes and fewer as windows
        stop = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), 4 * TOGETHER, "right")) + start)
        logits = network.logits(np.concatenate(held[start:stop]))
        ends = np.cumsum(sizes[start:stop])
        sums = np.add.reduceat(logits.astype(np.float64), ends - sizes[start:stop])
        out[start:stop] = sums / sizes[start:stop]
        start = stop
    return 1 / (1 + np.exp(-out))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, id_col: str = "doc_id", text: str = "text",
           rows: int = SAMPLE) -> DataFrame:
    """``(id, text, label)`` of at most ``rows`` labelled documents of each label, chosen by the hash of their id.

    ``usable`` is a condition on ``doc_id``. Null ids and labels take no part; of contradicting labels the smaller
    counts. What is broadcast is ``rows`` ids of either label at most.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
        .groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("hash", F.xxhash64("doc_id"))
    )
    one = known.where("label = 1").orderBy("hash", "doc_id").limit(rows)
    other = known.where("label = 0").orderBy("hash", "doc_id").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(one.unionByName(other)), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", rows: int = SAMPLE) -> bytes:
    """The trained network, as bytes. One task holds the bounded sample, cut to whole chunks of its texts."""
    session(docs.sparkSession)
    chosen = sample(docs, labels, "quality", usable, id_col, text, rows)

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        rows = pd.concat(held, ignore_index=True).sort_values(["hash", "text"])
        yield pd.DataFrame({"network": [train(list(rows["text"]), list(rows["label"])).dump()]})

    row = chosen.select("text", "label", "hash").repartition(1).mapInPandas(trained, "network binary").first()
    return row["network"] if row else Network().dump()  # without labels nothing is learned


def score(docs: DataFrame, network: bytes, text: str = "text", into: str = "score") -> DataFrame:
    """Add ``into``: the probability (0 to 1) that a text is of quality; null text counts as empty.

    Rows are scored each for itself from their whole text; other columns pass unchanged, one called ``into`` is replaced.
    """
    session(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Network.load(shipped.value)
        for batch in batches:
            yield pd.Series(probabilities(net, list(batch)))

    return docs.withColumn(into, scored(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
