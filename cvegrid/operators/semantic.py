"""Vector search over advisory pages."""

from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import estimate_tokens
from ..functions.vectors import cosine
from ..schemas import IVF_LISTS, SEMANTIC_K
from ..session import cut
from .intents import package_tags, wanted_tags, with_filters
from .retrieval import age_days, risk_order

#: Queries and vectors that meet in a task, on average, and the bytes of either's components; blocks of wide vectors have fewer.
QUERY_BLOCK = 8_192
VECTOR_BLOCK = 8_192
BLOCK_BYTES = 4 * 1024 * 1024
#: Queries and vectors that are multiplied at once.
_QUERIES, _ROWS = 512, 1_024
_DIGITS = 6
#: What similarities that are equal once rounded may differ by.
_ROUNDING = 10.0 ** -_DIGITS

_OUT = "query_id STRING, item_id STRING, similarity DOUBLE"
_RESULT = pa.schema([("query_id", pa.string()), ("item_id", pa.string()), ("similarity", pa.float64())])


def search(vectors: DataFrame, query: list[float], k: int = SEMANTIC_K) -> DataFrame:
    """Top ``k`` rows of ``(item_id, embedding, …)`` for one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return (
        vectors.withColumn("similarity", F.round(cosine(F.col("embedding"), q), _DIGITS))
        .where(F.col("similarity").isNotNull())
        .orderBy(F.desc("similarity"), "item_id")
        .limit(k)
    )


def _unit(rows: pa.Table) -> np.ndarray:
    flat = rows["embedding"].combine_chunks()
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1 if len(flat.values) else 0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def _names(rows: pa.Table, column: str) -> np.ndarray:
    return np.array(rows[column].to_pylist(), dtype=str)


class _Membership:
    """Which queries admit which items: their lists share an entry, or the query has no list."""

    def __init__(self, wanted: pd.Series):
        self.free = wanted.isna().to_numpy()[:, None]
        self.index = {x: i for i, x in enumerate(sorted({x for row in wanted.dropna() for x in row}))}
        self.wanted = self._matrix(wanted)

    def _matrix(self, lists: pd.Series) -> np.ndarray:
        out = np.zeros((len(lists), len(self.index)), dtype=np.float32)
        for i, row in enumerate(lists):
            if row is not None:
                out[i, [self.index[x] for x in row if x in self.index]] = 1
        return out

    def admits(self, offered: pd.Series) -> np.ndarray:
        if self.free.all():
            return np.ones((len(self.wanted), len(offered)), dtype=bool)
        return self.free | (self.wanted @ self._matrix(offered).T > 0)


class _TopK:
    """Running top ``k`` of a block of queries over blocks of vectors, ordered
    by similarity and then by the smaller id."""

    def __init__(self, block: pa.Table, k: int):
        self.query_ids, self.queries, self.k = block["query_id"], _unit(block), k
        self.narrow, n = self.queries.astype(np.float32), block.num_rows
        # how far products of single precision and rounded ones may be from each other, on both sides of a comparison
        self.slack = _ROUNDING + 2 * (self.queries.shape[1] + 8) * 2.0 ** -24
        self.ids, self.sims = np.full((n, k), "", dtype=str), np.full((n, k), -np.inf)
        self.days = _numbers(block, "days")[:, None]
        lists = [name for name in _LISTS if block[name].null_count < n]
        self.lists = {name: _Membership(block[name].to_pandas()) for name in lists}

    def add(self, block: pa.Table) -> None:
        """``block`` is in the order of its ids."""
        ids, vectors = _names(block, "item_id"), _unit(block)
        narrow = vectors.astype(np.float32)
        for start in range(0, len(ids), _ROWS):
            tile = slice(start, start + _ROWS)
            admitted = self._admissible(block.slice(start, _ROWS))
            for first in range(0, len(self.queries), _QUERIES):
                rows = slice(first, first + _QUERIES)
                near = self.narrow[rows] @ narrow[tile].T
                keep = np.flatnonzero(self._contenders(near, rows, None if admitted is None else admitted[rows]))
                if len(keep):
                    row, at = np.divmod(keep, near.shape[1])
                    sims = np.round(_products(self.queries[rows], vectors[tile], row, at), _DIGITS)
                    self._merge(row + first, at, sims, ids[tile], rows)

    def _admissible(self, items: pa.Table) -> np.ndarray | None:
        """Which queries admit which items; None if no query has a filter."""
        if not self.lists and np.isnan(self.days).all():
            return None
        ok = np.isnan(self.days) | (_numbers(items, "age")[None, :] <= self.days)
        for name, member in self.lists.items():
            ok &= member.admits(items[name].to_pandas())
        return ok

    def _contenders(self, near: np.ndarray, rows: slice, admitted: np.ndarray | None) -> np.ndarray:
        """Pairs that may be among the best ``k``, by products of single precision; undefined ones never are."""
        keep = near >= (self.sims[rows, -1:] - self.slack).astype(np.float32)
        if admitted is not None:
            keep &= admitted
        if near.shape[1] > self.k and np.count_nonzero(keep) > 4 * self.k * len(near):
            best = np.partition(np.where(keep, near, -np.inf), -self.k, axis=1)[:, -self.k, None]
            keep &= near >= best - np.float32(self.slack)
        return keep

    def _merge(self, row: np.ndarray, at: np.ndarray, sims: np.ndarray, ids: np.ndarray, rows: slice) -> None:
        """Takes in the pairs of query ``row`` and item ``ids[at]``, whose ids are sorted."""
        worst = self.sims[row, -1]
        # of equal similarities only a smaller id counts
        before = np.searchsorted(ids, self.ids[rows, -1])[row - rows.start]
        better = (sims > worst) | ((sims == worst) & (at < before))
        row, at, sims = row[better], at[better], sims[better]
        if not len(row):
            return
        order = np.lexsort((at, -sims, row))
        row, at, sims = row[order], at[order], sims[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(row)]))
        place = np.arange(len(row)) - starts[group]
        few = place < self.k
        hit, new = row[starts], np.full((len(starts), self.k), -np.inf)
        names = np.full(new.shape, "", dtype=ids.dtype)
        new[group[few], place[few]], names[group[few], place[few]] = sims[few], ids[at[few]]
        all_sims, all_ids = np.hstack([self.sims[hit], new]), np.hstack([self.ids[hit], names])
        order = np.lexsort((all_ids, -all_sims), axis=1)[:, :self.k]
        self.ids = self.ids.astype(all_ids.dtype, copy=False)  # longer ids need more room
        self.ids[hit], self.sims[hit] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)

    def result(self) -> pa.RecordBatch:
        row, place = np.nonzero(self.sims > -np.inf)
        columns = [self.query_ids.take(pa.array(row)).combine_chunks(), self.ids[row, place], self.sims[row, place]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)


def _products(queries: np.ndarray, vectors: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Products in double precision of the pairs ``row`` and ``at``."""
    if 8 * len(row) > len(queries) * len(vectors):
        return (queries @ vectors.T)[row, at]
    step = max(1, 2 ** 20 // max(1, queries.shape[1]))
    return np.concatenate([
        np.einsum("ij,ij->i", queries[row[i:i + step]], vectors[at[i:i + step]]) for i in range(0, len(row), step)])


def _numbers(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].to_pandas().to_numpy(dtype=float, na_value=np.nan)


#: List filters: a query that carries the column only admits items sharing an entry.
_LISTS = ["ids", "tags", "levels", "cells"]
_QUERY = {"query_id": "string", "embedding": "array<double>", "days": "bigint", **dict.fromkeys(_LISTS, "array<string>")}
_ITEM = {"item_id": "string", "embedding": "array<double>", "age": "bigint", **dict.fromkeys(_LISTS, "array<string>")}


def _shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    if dict(df.dtypes)["embedding"] == "array<float>":  # half as much to store; products are of doubles
        columns = columns | {"embedding": "array<float>"}
    return df.select(*[
        (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in columns.items()
    ])


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = SEMANTIC_K, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """Exact top ``k`` vectors per query: ``(query_id, rank, item_id, similarity)``.

    ``queries`` is ``(query_id, embedding)``, ``vectors`` ``(item_id, embedding)``.
    A query may carry ``days``, against the vectors' ``age``, and any of the list
    filters; only vectors that pass all of them compete. Vectors that are null,
    hold a null or non-finite component, or are not as wide as most queries,
    take no part. Both sides are written once, as blocks of bounded size,
    ``query_block`` queries at most on average. A task holds one block of queries
    and reads blocks of vectors one after the other, so that no vector is
    shuffled for each block that it meets; only a task's own top ``k`` are.
    """
    queries, vectors = _usable(_shaped(queries, _QUERY)), _usable(_shaped(vectors, _ITEM))
    widths = queries.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))
    counts = widths.orderBy(F.desc("n"), "width").collect()  # as many rows as there are widths
    if not counts:
        found = queries.sparkSession.createDataFrame([], _OUT)
    else:
        width, n = counts[0]["width"], counts[0]["n"]
        same = F.size("embedding") == width
        found = _blockwise(queries.where(same), n, vectors.where(same), width, k, query_block)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _usable(df: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return df.where(F.col("embedding").isNotNull() & finite)


def _blockwise(queries: DataFrame, n: int, vectors: DataFrame, width: int, k: int, query_block: int) -> DataFrame:
    """Every block of queries meets every block of vectors, as they are read again from where they were written."""
    wide = max(1, BLOCK_BYTES // (8 * max(1, width)))
    qs, q_blocks = _packed(queries, n, "query_id", min(query_block, wide))
    vs, v_blocks = _packed(vectors, vectors.count(), "item_id", min(VECTOR_BLOCK, wide))
    pairs = qs.select("number", F.col("block").alias("queries")).crossJoin(
        vs.select(F.col("block").alias("items")).hint("shuffle_replicate_nl"))
    # pairs of one block of queries follow each other: a task takes all of them, or a share where such blocks are few
    shares = -(-int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // q_blocks)
    pairs = pairs.coalesce(q_blocks * min(v_blocks, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, top = None, None
        for batch in batches:
            for number, block, items in zip(*batch.columns):
                if top is None or number != of:
                    if top is not None:
                        yield top.result()
                    of, top = number, _TopK(_unpacked(block), k)
                top.add(_unpacked(items))
        if top is not None:
            yield top.result()

    return pairs.mapInArrow(run, _OUT)


def _packed(df: DataFrame, n: int, id_col: str, rows: int) -> tuple[DataFrame, int]:
    """Blocks ``(number, block)`` of about ``rows`` rows in the order of their ids, a partition each, and their number."""
    blocks = max(1, -(-n // rows))
    parts = df.repartition(blocks).mapInArrow(_packer(id_col), "block BINARY")
    return cut(parts.select(F.spark_partition_id().alias("number"), "block")), blocks


def _packer(id_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            rows, sink = pa.Table.from_batches(found), pa.BufferOutputStream()
            rows = rows.take(pa.array(np.argsort(_names(rows, id_col), kind="stable"))).combine_chunks()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    return pack


def _unpacked(block: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def nearest_filtered(
    intents: DataFrame,
    queries: DataFrame,
    vectors: DataFrame,
    vulns: DataFrame,
    packages: DataFrame,
    now: datetime,
    k: int = SEMANTIC_K,
) -> DataFrame:
    """Top ``k`` per question among the CVEs its structured filters admit.

    ``queries`` is ``(intent_id, embedding)``, ``vectors`` ``(cve_id, embedding)``.
    A question without filters searches all vectors.
    """
    filters = with_filters(intents).withColumn("tags", wanted_tags()).select(
        "intent_id", F.col("cve_ids").alias("ids"), "tags", "levels", "days"
    )
    asked = queries.join(filters, "intent_id", "left").withColumnRenamed("intent_id", "query_id")
    wanted = filters.select(F.explode("tags").alias("tag"))
    # at most one entry per wanted tag
    tags = package_tags(packages, wanted).groupBy("cve_id").agg(F.collect_set("tag").alias("tags"))
    facts = vulns.select("cve_id", F.array("severity").alias("levels"), age_days(now).alias("age"))
    items = vectors.select("cve_id", "embedding").join(facts, "cve_id").join(tags, "cve_id", "left")
    items = items.withColumn("ids", F.array("cve_id")).withColumnRenamed("cve_id", "item_id")
    found = nearest(asked, items, k)
    return found.select(F.col("query_id").alias("intent_id"), F.col("item_id").alias("cve_id"), "similarity", "rank")


# --- coarse cells ---------------------------------------------------------------------

def train_cells(vectors: DataFrame, lists: int = IVF_LISTS, seed: int = 1):
    """Cluster model whose centres are the cells of the index."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.select(array_to_vector("embedding").alias("features"))
    return KMeans(k=lists, seed=seed, distanceMeasure="cosine", maxIter=10).fit(points)


def assign_cells(vectors: DataFrame, model) -> DataFrame:
    """Adds the ``cell`` of each vector; store the table partitioned by it."""
    from pyspark.ml.functions import array_to_vector

    points = vectors.withColumn("features", array_to_vector("embedding"))
    return model.transform(points).withColumnRenamed("prediction", "cell").drop("features")


def nearest_in_cells(
    queries: DataFrame, indexed: DataFrame, model, k: int = SEMANTIC_K, probes: int = 1
) -> DataFrame:
    """Top ``k`` per query among the vectors of its ``probes`` closest cells.

    Approximate unless all cells are probed. Reads only the probed cells.
    """
    spark = queries.sparkSession
    centres = [(str(i), [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    cells = spark.createDataFrame(centres, "item_id STRING, embedding ARRAY<DOUBLE>")
    probed = nearest(queries.select("query_id", "embedding"), cells, probes)
    lists = probed.groupBy("query_id").agg(F.collect_list("item_id").alias("cells"))
    asked = queries.select("query_id", "embedding").join(lists, "query_id")
    read = probed.select(F.col("item_id").cast("int").alias("cell")).distinct()
    items = indexed.join(read, "cell", "left_semi").withColumn("cells", F.array(F.col("cell").cast("string")))
    return nearest(asked, items.select("item_id", "embedding", "cells"), k)


# --- merging with structured hits -------------------------------------------------------

def hybrid(
    structured: DataFrame, semantic: DataFrame, vulns: DataFrame, exploits: DataFrame
) -> DataFrame:
    """Structured and semantic hits of each question, one row per CVE, ranked.

    ``structured`` is ``(intent_id, cve_id)``, ``semantic`` adds ``similarity``.
    Relevance counts with KEV membership, known exploits and EPSS.
    """
    nothing = F.lit(None).cast("double")
    hits = structured.select("intent_id", "cve_id", nothing.alias("similarity"), F.lit(True).alias("from_sql"))
    hits = hits.unionByName(semantic.select("intent_id", "cve_id", "similarity", F.lit(False).alias("from_sql")))
    merged = hits.groupBy("intent_id", "cve_id").agg(
        F.max("similarity").alias("similarity"), F.bool_or("from_sql").alias("from_sql")
    )
    known = exploits.select("cve_id").distinct().withColumn("_exploit", F.lit(True))
    facts = vulns.select("cve_id", "cisa_kev", "epss_score", "cvss_score", "published_at")
    rows = merged.join(facts, "cve_id").join(known, "cve_id", "left")
    has = F.coalesce("_exploit", F.lit(False))
    relevance = (
        F.coalesce("similarity", F.lit(0.0))
        + F.when(F.col("cisa_kev"), 0.5).otherwise(0.0)
        + F.when(has, 0.25).otherwise(0.0)
        + 0.25 * F.coalesce("epss_score", F.lit(0.0))
    )
    rows = rows.withColumns({"has_exploit": has, "relevance": F.round(relevance, _DIGITS)}).drop("_exploit")
    order = Window.partitionBy("intent_id").orderBy(F.desc("relevance"), *risk_order())
    return rows.withColumn("rank", F.row_number().over(order))


def embeddable(vulns: DataFrame, min_tokens: int = 200) -> DataFrame:
    """CVEs whose description is long enough for a vector of its own."""
    return vulns.where(estimate_tokens(F.col("description")) > min_tokens)


def keyword_search(vulns: DataFrame, phrase: str) -> DataFrame:
    """Descriptions containing a phrase, whatever the case."""
    literal = phrase.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return vulns.where(F.col("description").ilike(f"%{literal}%"))
