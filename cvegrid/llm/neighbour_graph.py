"""Nearest neighbours by inner product: a neighbour graph by NN-descent, searched greedily.

Vectors are compared by inner product, coded in eight bits with a scale of their own, whatever the others' lengths.
Sorting their directions along random projections gives first neighbours, and so do the longest vectors; then, in rounds of Spark joins, the neighbours of every
vector (those it lists and some that list it) are compared with each other, and each keeps the best it has met. A search
holds the best vectors found so far for every query, follows the neighbours of all that it has not yet followed, and ends
when there are none. Vectors and their lists live in shards; queries travel to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session, stored

#: Neighbours kept a vector; how many of them, and of those that list it, meet in a round; what each takes from a meeting.
NEIGHBOURS, MEET, TAKE = 40, 20, 10
#: Sortings for the first neighbours, vectors compared along them, neighbours taken from each, rounds of descent.
SORTINGS, ALONG, FIRST, ROUNDS = 3, 256, 16, 3
#: The longest vectors, which all are compared with.
LONGEST = 256
#: Vectors a search holds for a query, and entry points that all queries share.
BEAM, ENTRIES = 320, 16
#: Vectors in a shard and queries in a block, about: what one task handles together.
SHARD, BLOCK = 4096, 256
SEED = 11


def _place(ids: np.ndarray, n: int) -> np.ndarray:
    """The shard or block of an id."""
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.exists(vector, lambda x: x != 0) & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))


def vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """The usable vectors with shards and codes, written once; their number and the number of shards.

    Of rows with one id the smallest vector counts; null ids and vectors of another size than the most frequent one
    take no part.
    """
    session(table.sparkSession)
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), F.desc("width")).first()
    width, n = (best["width"], best["n"]) if best else (1, 0)
    shards = max(1, -(-n // SHARD))
    random = np.random.default_rng(SEED)
    directions = random.standard_normal((width, SORTINGS, 6))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(list(batch["v"]), np.float64).reshape(-1, width)
            largest = np.abs(x).max(axis=1, keepdims=True)
            shape = x / largest
            length = np.sqrt((shape * shape).sum(axis=1, keepdims=True))
            codes = np.rint(shape * 127).astype(np.int8)
            along = np.einsum("nd,dsk->nsk", shape / length, directions)
            signs = ((along[:, :, :5] > 0) * (1 << np.arange(5))).sum(axis=2)
            keys = (signs << 40) + np.rint(along[:, :, 5] * (1 << 30)).astype(np.int64)
            ids = batch["id"].to_numpy(np.int64)
            yield pd.DataFrame({
                "id": ids, "shard": _place(ids, shards), "vector": [r.tobytes() for r in x],
                "code": [l.tobytes() + r.tobytes() for l, r in zip(largest / 127, codes)],
                "length": (largest * length)[:, 0], **{f"key{t}": keys[:, t] for t in range(SORTINGS)},
            })

    keys = "".join(f", key{t} long" for t in range(SORTINGS))
    table = rows.where(F.size("v") == width).mapInPandas(coded, "id long, shard int, vector binary, code binary, length double" + keys)
    return stored(table, "vectors"), n, shards


def _best(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Everyone's ``k`` best partners with rank. Equal pairs share a rank, and tasks drop the rest before the shuffle."""
    rank = F.dense_rank().over(Window.partitionBy("u").orderBy(F.desc("s"), "w"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["u", "rank"])


def _decoded(codes) -> tuple[np.ndarray, np.ndarray]:
    """Scales and codes as a matrix, in which products of whole numbers are exact."""
    codes = list(codes)
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    exact = np.float32 if raw.shape[1] <= 1024 else np.float64
    return raw[:, :8].copy().view(np.float64)[:, 0], raw[:, 8:].copy().view(np.int8).astype(exact)


def _products(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inner products; those of a pair are the same wherever it is compared."""
    return (left[1] @ right[1].T).astype(np.float64) * (left[0][:, None] * right[0][None, :])


def _first(table: DataFrame, n: int) -> DataFrame:
    """Neighbours along the sortings, where stretches of ``ALONG`` vectors are compared, and among the longest vectors."""
    longest = table.select("id", "code", "length").orderBy(F.desc("length"), "id").limit(LONGEST).collect()
    heads = np.array([r["id"] for r in longest], np.int64)

    def among(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _decoded([bytes(r["code"]) for r in longest])
        for batch in batches:
            ids = batch["id"].to_numpy(np.int64)
            products = _products(_decoded(batch["code"]), known)
            products[ids[:, None] == heads[None, :]] = -np.inf
            yield _largest(products, ids, heads)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            left = batch if left is None else pd.concat([left, batch], ignore_index=True)
            while len(left) >= 2 * ALONG:
                yield _pairs(left.iloc[:ALONG])
                left = left.iloc[ALONG:]
        if left is not None and len(left):
            yield _pairs(left)

    parts = max(1, -(-n // (2 * SHARD)))
    each = [
        table.select("id", "code", f"key{t}").repartitionByRange(parts, f"key{t}", "id").sortWithinPartitions(f"key{t}", "id")
        .select("id", "code").mapInPandas(compare, "u long, w long, s double")
        for t in range(SORTINGS)
    ]
    edges = each[0]
    if longest:
        each.append(table.select("id", "code").mapInPandas(among, "u long, w long, s double"))
    for other in each[1:]:
        edges = edges.unionAll(other)
    return edges


def _pairs(rows: pd.DataFrame) -> pd.DataFrame:
    ids = rows["id"].to_numpy(np.int64)
    decoded = _decoded(rows["code"])
    products = _products(decoded, decoded)
    np.fill_diagonal(products, -np.inf)
    return _largest(products, ids, ids)


def _largest(products: np.ndarray, ids: np.ndarray, others: np.ndarray) -> pd.DataFrame:
    k = min(FIRST, len(others))
    best = np.argpartition(-products, k - 1, axis=1)[:, :k]
    s = np.take_along_axis(products, best, axis=1).reshape(-1)
    found = pd.DataFrame({"u": np.repeat(ids, k), "w": others[best.reshape(-1)], "s": s})
    return found[s > -np.inf]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each centre, compare all members; each takes the best that beat what it has."""
    for batch in batches:
        lists = batch.column(0)
        members, offsets = lists.values, lists.offsets.to_numpy()
        ids, least = members.field("m").to_numpy(zero_copy_only=False), members.field("least").to_numpy(zero_copy_only=False)
        scales, matrix = _decoded(members.field("code").to_pylist()) if len(ids) else (np.zeros(0), np.zeros((0, 1)))
        out_u, out_w, out_s = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            here = scales[a:b], matrix[a:b]
            products = _products(here, here)
            np.fill_diagonal(products, -np.inf)
            k = min(TAKE, b - a - 1)
            if k < 1:
                continue
            best = np.argpartition(-products, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(products, best, axis=1)
            row, column = np.nonzero(s > least[a:b, None])
            out_u.append(ids[a:b][row])
            out_w.append(ids[a:b][best[row, column]])
            out_s.append(s[row, column])
        if out_u:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (out_u, out_w, out_s)], names=["u", "w", "s"])


def graph(table: DataFrame, n: int, rounds: int = ROUNDS) -> DataFrame:
    """``(u, w, s, rank)``: the neighbours of every vector of ``vectors()``, by rounds of descent."""
    edges = stored(_best(_first(table, n)), "graph")
    codes = table.select(F.col("id").alias("m"), "code")
    for turn in range(rounds):
        near = edges.where(F.col("rank") <= MEET)
        listed = near.select(F.col("u").alias("c"), F.col("w").alias("m"))
        # of those that list a vector, one for each of MEET slots: however many there are, tasks reduce them first
        order = F.xxhash64("u", "w", F.lit(turn))
        listing = (
            near.withColumn("h", order).groupBy(F.col("w").alias("c"), F.pmod("h", F.lit(MEET)).alias("slot"))
            .agg(F.min_by("u", "h").alias("m")).select("c", "m")
        )
        own = table.select(F.col("id").alias("c"), F.col("id").alias("m"))
        members = listed.unionAll(listing).unionAll(own).distinct()
        least = edges.groupBy(F.col("u").alias("m")).agg(F.min("s").alias("low"), F.count("*").alias("held"))
        known = codes.join(least, "m", "left").select(
            "m", "code", F.when(F.col("held") >= NEIGHBOURS, F.col("low")).otherwise(float("-inf")).alias("least"))
        meetings = members.join(known, "m").groupBy("c").agg(F.collect_list(F.struct("m", "least", "code")).alias("members"))
        offers = meetings.select("members").mapInArrow(_meet, "u long, w long, s double")
        edges = stored(_best(edges.select("u", "w", "s").unionAll(offers)), "graph")
    return edges


def _split(ids: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    place = _place(ids, shards)
    order = np.argsort(place, kind="stable")
    ids, place = ids[order], place[order]
    cuts = np.flatnonzero(np.diff(place)) + 1
    for part in np.split(np.arange(len(ids)), cuts):
        if len(part):
            yield int(place[part[0]]), ids[part]


def _numbers(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(data, kind)


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


STATE = "block int, q long, vector binary, ids binary, scores binary, followed binary, open int"


def search(table: DataFrame, edges: DataFrame, n: int, shards: int, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """Everything each query ``(q, vector)`` holds in the end: ``q``, ``ids`` and ``scores``, best first.

    A query whose id is indexed starts from its own neighbours too and is no candidate of its own.
    """
    lists = stored(
        edges.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("rank", "w"))).alias("l"))
        .join(table.select(F.col("id").alias("u"), "shard"), "u").select("shard", "u", F.col("l.w").alias("near")), "lists")
    rows = table.select("shard", "id", "vector")
    entries = np.array([r["id"] for r in table.select("id").orderBy(F.xxhash64("id"), "id").limit(ENTRIES).collect()], np.int64)
    blocks = max(1, -(-n // (20 * BLOCK)))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = batch["q"].to_numpy(np.int64)
            yield pd.DataFrame({
                "block": _place(q, blocks), "q": q, "vector": batch["vector"], "ids": b"", "scores": b"", "followed": b"", "open": 1})

    def frontier(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Everything held and not yet followed; a new query follows its own vector and the entries."""
        for batch in batches:
            out = []
            for s in batch.itertuples(index=False):
                ids = _numbers(s.ids)
                todo = ids[_numbers(s.followed, np.bool_) == 0] if len(ids) else np.append(entries, s.q)
                out += [(shard, s.block, s.q, part.tobytes()) for shard, part in _split(np.unique(todo), shards)]
            yield _frame(out, ["shard", "block", "q", "at"])

    def follow(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        known, out = dict(zip(near["u"], near["near"])), []
        for a in asked.itertuples(index=False):
            lists = [known[i] for i in _numbers(a.at).tolist() if i in known]
            if lists:
                out.append((a.block, a.q, np.unique(np.concatenate(lists)).astype(np.int64).tobytes()))
        return _frame(out, ["block", "q", "to"])

    def send(states: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """What was found and is not held goes to its shards, with the query and the least score that matters."""
        new, out = found.groupby("q")["to"].apply(b"".join).to_dict() if len(found) else {}, []
        for s in states.itertuples(index=False):
            held, scores = _numbers(s.ids), _numbers(s.scores, np.float64)
            to = _numbers(new.get(s.q, b""))
            to = np.append(to, entries) if not len(held) else to
            to = np.setdiff1d(to, np.append(held, s.q))
            least = float(scores[-1]) if len(scores) >= beam else -np.inf
            out += [(shard, s.block, s.q, s.vector, least, part.tobytes()) for shard, part in _split(to, shards)]
        return _frame(out, ["shard", "block", "q", "vector", "least", "to"])

    def measure(asked: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        """Exact inner products in double precision; only what may be held goes back."""
        if not len(asked) or not len(here):
            return _frame([], ["block", "q", "ids", "scores"])
        here = here.sort_values("id")
        ids, out = here["id"].to_numpy(np.int64), []
        matrix = np.frombuffer(b"".join(here["vector"]), np.float64).reshape(len(ids), -1)
        for a in asked.itertuples(index=False):
            to = _numbers(a.to)
            at = np.searchsorted(ids, to)
            scores = np.einsum("nd,d->n", matrix[at], _numbers(a.vector, np.float64))
            good = scores >= a.least
            if good.any():
                out.append((a.block, a.q, to[good].tobytes(), scores[good].tobytes()))
        return _frame(out, ["block", "q", "ids", "scores"])

    def hold(states: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        got = {q: (b"".join(g["ids"]), b"".join(g["scores"])) for q, g in found.groupby("q")} if len(found) else {}
        out = []
        for s in states.itertuples(index=False):
            more = got.get(s.q, (b"", b""))
            ids = np.concatenate([_numbers(s.ids), _numbers(more[0])])
            scores = np.concatenate([_numbers(s.scores, np.float64), _numbers(more[1], np.float64)])
            followed = np.zeros(len(ids), np.bool_)
            followed[: len(s.ids) // 8] = True
            order = np.lexsort((ids, -scores))[:beam]
            out.append((s.block, s.q, s.vector, ids[order].tobytes(), scores[order].tobytes(), followed[order].tobytes(),
                        int((~followed[order]).sum())))
        return _frame(out, ["block", "q", "vector", "ids", "scores", "followed", "open"])

    def together(left: DataFrame, right: DataFrame, key: str, how, schema: str) -> DataFrame:
        return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(how, schema)

    state = stored(queries.mapInPandas(start, STATE), "state")
    while not state.where("open > 0").isEmpty():
        asked = state.where("open > 0").mapInPandas(frontier, "shard int, block int, q long, at binary")
        found = together(asked, lists, "shard", follow, "block int, q long, to binary")
        sent = together(state.where("open > 0"), found, "block", send, "shard int, block int, q long, vector binary, least double, to binary")
        measured = together(sent, rows, "shard", measure, "block int, q long, ids binary, scores binary")
        state = stored(together(state, measured, "block", hold, STATE), "state")
    return state.select("q", "ids", "scores")


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            rounds: int = ROUNDS, beam: int = BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row of ``table`` that ``is_query`` (a
    condition on ``id``), best first, ties to the smaller id; all others if there are fewer.

    Null ids, and vectors that are null, empty, zero, not finite or of another size than most, take no part. An empty
    table gives none. Other columns do not matter.
    """
    indexed, n, shards = vectors(table, id_col, vector_col)
    queries = indexed.where(is_query).select(F.col("id").alias("q"), "vector")
    found = search(indexed, graph(indexed, n, rounds), n, shards, queries, max(beam, k))

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                ids, scores = _numbers(s.ids)[:k], _numbers(s.scores, np.float64)[:k]
                yield pd.DataFrame({"query_id": s.q, "rank": np.arange(1, len(ids) + 1, dtype=np.int32), "vec_id": ids, "score": scores})

    return found.mapInPandas(ranked, "query_id long, rank int, vec_id long, score double")
