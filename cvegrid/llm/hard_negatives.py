"""Hard negatives by exact integer products, several candidates in one multiplication (Kronecker packing).

Components become integers. Candidates' components are made non-negative by a bias and laid, several candidates side by
side, into fields of one 64-bit word, wide enough that a sum of products never leaves its field. One multiplication by an
anchor's biased component then multiplies all of them; after the last component the fields are unpacked and what the
biases added is taken off, which leaves the exact inner products.

Rows lie in packed blocks, anchors in blocks of their own. Anchors first meet the blocks of their label, which gives their
positives, then all blocks with what bounds the negatives. A block pair emits only its best few; Spark merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session, stored

#: Components are multiplied by this and rounded down.
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between so many hundredths of the positive's.
LEAST, MOST = 50, 95
#: Rows of a candidate block and anchors of an anchor block, about; anchors multiplied at a time.
BLOCK, ANCHORS, STEP = 4096, 1024, 64
NONE = np.iinfo(np.int64).min


# ---------------------------------------------------------------- packed products


def field_bits(width: int, low: int, high: int) -> int:
    """The bits of a field that holds any sum of ``width`` products of biased components."""
    return max((width * (high - low) ** 2).bit_length(), 1)


class Packed:
    """Candidates in wide words: ``words[d, w]`` holds component ``d`` of the candidates ``w``, ``w + n_words``, ..."""

    def __init__(self, rows: np.ndarray, low: int, high: int):
        self.n, self.width = rows.shape
        self.low, self.bits = low, field_bits(self.width, low, high)
        self.fields = 64 // self.bits
        if not self.fields:
            raise ValueError(f"products of {self.width} components from {low} to {high} need more than 64 bits")
        self.n_words = -(-self.n // self.fields)
        biased = np.zeros((self.n_words * self.fields, self.width), np.uint64)
        biased[: self.n] = (rows - low).astype(np.uint64)
        layers = biased.reshape(self.fields, self.n_words, self.width)
        self.words = np.zeros((self.width, self.n_words), np.uint64)
        for i in range(self.fields):
            self.words |= layers[i].T << np.uint64(i * self.bits)
        self.sums = rows.sum(axis=1)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The inner products ``[anchor, candidate]``: one multiplication for each anchor component and wide word."""
        biased = (anchors - self.low).astype(np.uint64)
        total = np.zeros((len(anchors), self.n_words), np.uint64)
        product = np.empty(self.n_words, np.uint64)
        for row, components in zip(total, biased):
            for component, words in zip(components, self.words):
                if component:
                    np.multiply(words, component, out=product)
                    row += product
        mask = np.uint64((1 << self.bits) - 1)
        out = np.empty((len(anchors), self.fields, self.n_words), np.int64)
        for i in range(self.fields):
            out[:, i] = ((total >> np.uint64(i * self.bits)) & mask).astype(np.int64)
        out = out.reshape(len(anchors), -1)[:, : self.n]
        # (a - low)(c - low) = ac - low * a - low * c + low * low, summed over the components
        return out + self.low * (anchors.sum(axis=1)[:, None] + self.sums[None, :]) - self.width * self.low**2


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest of each row, but for ``NONE``; of equal ones the leftmost."""
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    rows, columns = np.nonzero((scores >= least[:, None]) & (scores != NONE))
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


# ---------------------------------------------------------------- blocks


def integers(vector: Column) -> Column:
    """Components times ``SCALE``, rounded down."""
    return F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, and all components there and finite."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))


def rows_of(table: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``(id, label, v, width)`` of the rows that take part; of rows with one id the smallest counts."""
    rows = table.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x")))
    whole = rows.select("id", F.struct("label", integers(F.col("x")).alias("v")).alias("r"))
    return whole.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v", F.size("r.v").alias("width"))


def _chunks(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """``rows`` with ``chunk``: those alike in ``by`` split by their ids into chunks of about ``size``."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("chunks"))
    return rows.join(counts, by).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).drop("chunks")


def _blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """A row for each chunk: ids in ascending order with labels and components, as bytes."""

    def lay(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        matrix = np.stack(frame["v"].to_list()).astype("<i8") if len(frame["v"].iloc[0]) else np.zeros((len(frame), 0), "<i8")
        held = dict(zip([*by, "chunk"], key))
        return pd.DataFrame([held | {
            "ids": frame["id"].to_numpy("<i8").tobytes(), "labels": frame["label"].to_numpy("<i8").tobytes(), "v": matrix.tobytes(),
            "bounds": np.array(frame["bounds"].to_list(), "<i8").tobytes() if "bounds" in frame else b""}])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by, "chunk").applyInPandas(
        lay, f"{schema}, chunk long, ids binary, labels binary, v binary, bounds binary")


def _open(block: bytes, width: int = 1) -> np.ndarray:
    flat = np.frombuffer(block, "<i8")
    return flat.reshape(-1, width) if width != 1 else flat


def _meet(anchors: DataFrame, candidates: DataFrame, on: list[str], low: int, high: int, choose, schema: str) -> DataFrame:
    """What ``choose`` finds for every anchor block and every candidate block alike in ``on``."""
    sides = [blocks.select(*on, *[F.col(c).alias(f"{c}_{side}") for c in ("ids", "labels", "v", "bounds")], F.col("chunk").alias(f"chunk_{side}"))
             for side, blocks in (("a", anchors), ("c", candidates))]
    # block pairs are dealt evenly; a pair is two blocks of bounded size
    pairs = sides[0].join(sides[1], on).repartition(*on, "chunk_a", "chunk_c")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                ids, n = _open(b.ids_c), len(b.ids_c) // 8
                packed = Packed(np.frombuffer(b.v_c, "<i8").reshape(n, -1), low, high)
                a_ids, a_labels, bounds = _open(b.ids_a), _open(b.labels_a), _open(b.bounds_a)
                a_v = np.frombuffer(b.v_a, "<i8").reshape(len(a_ids), -1)
                bounds = bounds.reshape(len(a_ids), -1)
                for at in range(0, len(a_ids), STEP):
                    some = slice(at, at + STEP)
                    yield choose(packed.scores(a_v[some]), a_ids[some], a_labels[some], bounds[some], ids, _open(b.labels_c))

    return pairs.mapInPandas(found, schema)


# ---------------------------------------------------------------- the two meetings


def _positives(scores, anchors, _labels, _bounds, ids, _ids_labels) -> pd.DataFrame:
    own = anchors[:, None] == ids[None, :]
    rows, columns = best(np.where(own, NONE, scores), POSITIVES)
    return pd.DataFrame({"anchor_id": anchors[rows], "positive_id": ids[columns], "positive_score": scores[rows, columns]})


def _negatives(scores, anchors, labels, bounds, ids, ids_labels) -> pd.DataFrame:
    """``bounds`` holds a positive and its score, ``POSITIVES`` times; a missing one has the id ``NONE``."""
    other = labels[:, None] != ids_labels[None, :]
    out = []
    for i in range(POSITIVES):
        positive, score = bounds[:, 2 * i], bounds[:, 2 * i + 1]
        low, high = -(-LEAST * score // 100), MOST * score // 100
        fits = other & (scores >= low[:, None]) & (scores <= high[:, None]) & (positive != NONE)[:, None]
        some = np.flatnonzero(fits.any(axis=1))
        rows, columns = best(np.where(fits[some], scores[some], NONE), NEGATIVES)
        rows = some[rows]
        out.append(pd.DataFrame({
            "anchor_id": anchors[rows], "positive_id": positive[rows], "positive_score": score[rows],
            "negative_id": ids[columns], "negative_score": scores[rows, columns]}))
    return pd.concat(out)


def mine(table: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         block: int = BLOCK, anchor_block: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    An anchor's positives are the ``POSITIVES`` rows of its label with the highest scores; for each, the ``NEGATIVES``
    highest rows of other labels between ``LEAST`` and ``MOST`` hundredths of its score. Ties go to the smaller id.
    ``is_anchor`` is a condition on ``id``, ``label`` an expression over ``table``. Rows with a null id or label, a null
    vector, or a null or non-finite component take no part; of rows that repeat an id the one with the smallest label and
    then components counts. Vectors are compared with those of the same number of components. Other columns do not matter,
    an empty table gives none. Components so large that a score would need more than 64 bits raise an error.

    Every block of anchors meets every block of rows once, and those of its label once more: work grows with anchors times
    rows, tasks with block pairs, and a task holds two blocks.
    """
    session(table.sparkSession)
    rows = stored(rows_of(table, id_col, vector_col, label), "rows")
    ends = rows.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    anchors = rows.where(is_anchor)
    by_label = _blocks(_chunks(rows, ["width", "label"], block), ["width", "label"])
    askers = _blocks(_chunks(anchors, ["width", "label"], anchor_block), ["width", "label"])
    near = _meet(askers, by_label, ["width", "label"], low, high, _positives, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= POSITIVES)
    pair = F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score")))
    nothing = F.array(F.lit(int(NONE)).cast("long"), F.lit(0).cast("long"))
    flat = F.flatten(F.transform(pair, lambda p: F.array(p["positive_id"], p["positive_score"])))
    padded = F.slice(F.concat(flat, F.flatten(F.array_repeat(nothing, POSITIVES))), 1, 2 * POSITIVES)
    bounded = anchors.join(positives.groupBy("anchor_id").agg(padded.alias("bounds")).withColumnRenamed("anchor_id", "id"), "id")
    asking = stored(_blocks(_chunks(bounded, ["width"], anchor_block), ["width"]), "anchors")
    far = _meet(asking, _blocks(_chunks(rows, ["width"], block), ["width"]), ["width"], low, high, _negatives,
                "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
