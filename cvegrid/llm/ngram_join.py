"""Similarity join of texts by the Jaccard similarity of their word n-grams, with PartEnum signatures.

Sets are split by size into bands of which similar sets lie in the same one or in adjacent ones. Within two adjacent
bands similar sets differ in at most k elements. The domain of elements is partitioned, each partition again; in some
partition two such sets differ so little that they agree on all but one of its parts, so enumerating the subsets without
one part gives a signature that both share. Sets with a common signature are compared exactly.

Equal sets are one node from the start. In a group of nodes with a common signature, each is compared with one of them;
links become components, and only nodes of different components in a group are compared further, if their sizes and
parity maps, which bound the difference of two sets from below, allow a link. So no link is lost, and what is compared by
its elements is little more than what is linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import discard, free_name, session, stored, worker_state
from .lexicon import Hasher, parts, split

WORDS = 3
#: Similarity in hundredths from which two sets are linked.
SIMILARITY = 90
#: Partitions beyond those needed, and of two parts one more for so many differences, so that a set can leave out its emptiest parts.
SLACK, PER_SLACK = 2, 8
#: Places where a task remembers nodes that it has signed.
SIGNED = 1 << 20
#: Bits of the map of wanted rows, and rows of a group's block that meet those of another.
WANTED, BLOCK = 1 << 24, 512


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The sets of hashed n-grams of many texts, each sorted."""

    def __init__(self, n: int):
        self.n, self.hasher = n, Hasher()
        self.factors = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def _grams(self, hashes: np.ndarray, m: int) -> np.ndarray:
        grams = np.full(max(len(hashes) - m + 1, 0), m, np.uint64)
        for i in range(m):
            grams += hashes[i:i + len(grams)] * self.factors[i]
        return _mix(grams)

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Fewer words than n give their whole sequence, no words nothing."""
        for some in parts(texts):
            # as bytes: A to Z alone are lowered
            data, starts, ends, bounds = split([t.encode("utf-8", "surrogatepass").lower() for t in some])
            hashes = self.hasher(data, starts, ends)
            grams = self._grams(hashes, self.n)
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if high - low >= self.n:
                    yield np.unique(grams[low:high - self.n + 1])
                else:
                    yield self._grams(hashes[low:high], high - low)[:high > low]


def node(grams: np.ndarray) -> int:
    """A set's name: 64 bits of its digest. 0 for the empty set."""
    if not len(grams):
        return 0
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) or 1


def band_ends(size: int, similarity: int) -> tuple[int, int, int, int]:
    """The number of the band that holds ``size``, and the largest sizes of the band before, this one, and the next."""
    ends = _ends(similarity)
    while ends[-2] < size:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // similarity))
    low, high = 0, len(ends) - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if ends[middle] < size else (low, middle)
    return low, ends[low - 1], ends[low], ends[low + 1]


@lru_cache(maxsize=8)
def _ends(similarity: int) -> list[int]:
    """Largest sizes of the bands, growing as needed; the first band is the empty set."""
    return [0, 1]


def shape(k: int) -> tuple[int, int]:
    """Partitions and their parts for sets that differ in at most ``k`` elements: in one partition at most one does."""
    return (k // 2 + 1 + SLACK, 3) if k <= 8 else (k // 2 + 1 + SLACK + k // PER_SLACK, 2)


def signatures(grams: np.ndarray, similarity: int) -> np.ndarray:
    """The signatures of a set, for its own and the preceding pair of adjacent bands.

    Sets in one pair of bands that differ nowhere are equal, thus one node, and need none. A part without elements says
    nothing and is signed only if the set has so many that it may have nothing else in common with a similar one.

    Of two parts an element is in one signature alone, so k differences leave one of any k + 1 alike. A set signs its k + 1
    fullest parts, in an order that place and content decide: of two similar sets, the one whose last part comes earlier in
    it shares one of its parts with the other, which signs that too. Parts of few elements are alike in many long texts
    that have a passage in common, so the number of their pairs would grow with the square of that of long texts.
    """
    size = len(grams)
    band, before, here, after = band_ends(size, similarity)
    out = []
    for pair, most in ((band - 1, before + here), (band, here + after)):
        k = most * (100 - similarity) // (100 + similarity)
        if not k:
            continue
        partitions, parts = shape(k)
        cell = ((grams >> np.uint64(11)) % np.uint64(partitions * parts)).astype(np.int64)
        sums = np.zeros(partitions * parts, np.uint64)
        np.add.at(sums, cell, _mix(grams + np.uint64(pair)))
        counts = np.bincount(cell, minlength=partitions * parts).reshape(partitions, parts)
        # leave one part out: what the others hold
        rest = sums.reshape(partitions, parts).sum(axis=1, keepdims=True) - sums.reshape(partitions, parts)
        held = counts.sum(axis=1, keepdims=True) - counts
        place = np.arange(partitions * parts, dtype=np.uint64) + np.uint64((pair << 32) + 1)
        signed = _mix(rest.reshape(-1) + _mix(place))
        if parts == 2:
            signed = signed[np.lexsort((signed, -held.reshape(-1)))[:k + 1]]
        elif (held == 0).any(axis=1).sum() < partitions - k // 2:
            signed = signed[held.reshape(-1) > 0]
        out.append(signed)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


#: Longs of the parity map of a set: each element flips one of its bits.
PARITY = 16


def parity(grams: np.ndarray) -> list[int]:
    """A map whose difference between two sets is at most the number of elements in which they differ."""
    flips = np.bincount((grams >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64).tolist()


#: Sets from this size on have a second, wider map: the first one says little about long texts. It has two to four bits
#: an element, and so many at most.
WIDE_FROM, WIDE = 1024, 1 << 14


def wide_parity(grams: np.ndarray) -> bytes | None:
    if len(grams) < WIDE_FROM:
        return None
    bits = min(WIDE, 2 << (len(grams) - 1).bit_length())
    return np.packbits((np.bincount((grams >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_difference(a: bytes, b: bytes) -> int:
    """In how many bits two wide maps differ; a longer one is folded to the length of the other."""
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, n), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _narrowed(pairs: DataFrame, members: DataFrame, similarity: int) -> DataFrame:
    """The pairs ``(a, b)`` that their wide maps allow too; a pair with a small set stays."""

    @pandas_udf("long")
    def differ(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([
            0 if a is None or b is None else wide_difference(a, b) for a, b in zip(left, right)
        ])

    wide = members.where("wide IS NOT NULL").select("node", "size", "wide")
    both = pairs.join(wide.toDF("b", "size_b", "wide_b"), "b", "left").join(wide.toDF("a", "size_a", "wide_a"), "a", "left")
    apart = (100 + similarity) * differ("wide_a", "wide_b") > (100 - similarity) * F.coalesce(F.col("size_a") + F.col("size_b"), F.lit(0))
    return both.where(~apart).select(*pairs.columns)


def _may_link(similarity: int, size_a: str, parity_a: str, size_b: str, parity_b: str) -> Column:
    """Whether sizes and parity maps allow the similarity: no similar pair is lost, few others stay."""
    differ = reduce(
        lambda x, y: x + y,
        [F.bit_count(F.col(parity_a)[i].bitwiseXOR(F.col(parity_b)[i])) for i in range(PARITY)],
    )
    sizes = F.col(size_a) + F.col(size_b)
    apart = F.greatest(differ, F.abs(F.col(size_a) - F.col(size_b)))
    return (100 + similarity) * apart <= (100 - similarity) * sizes


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    session(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def _shingler(n: int) -> Shingler:
    return worker_state(("shingles", n), lambda: Shingler(n))


def nodes(texts: DataFrame, n: int) -> DataFrame:
    """Every row's id, set size, node and parity maps."""

    @pandas_udf("size long, node long, parity array<long>, wide binary")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(_shingler(n).sets(batch.tolist()))
            yield pd.DataFrame({"size": [len(s) for s in sets], "node": [node(s) for s in sets], "parity": [parity(s) for s in sets],
                                "wide": [wide_parity(s) for s in sets]})

    return texts.select("id", named("text").alias("set")).select("id", "set.size", "set.node", "set.parity", "set.wide")


def signed(texts: DataFrame, n: int, similarity: int) -> DataFrame:
    """``(signature, node)`` of every set; a task signs copies of a set once."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(SIGNED, np.int64)  # the node last signed at each place
        for batch in batches:
            names, lists = [], []
            for grams in _shingler(n).sets(batch["text"].tolist()):
                name = node(grams)
                if seen[name % SIGNED] == name:  # the empty set is 0, and signs nothing
                    continue
                seen[name % SIGNED] = name
                names.append(name)
                lists.append(signatures(grams, similarity))
            counts = [len(x) for x in lists]
            yield pd.DataFrame({
                "signature": np.concatenate(lists) if lists else np.zeros(0, np.int64),
                "node": np.repeat(np.array(names, np.int64), counts),
            })

    return texts.select("text").mapInPandas(sign, "signature long, node long")


def _named(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(node, id)`` of the nodes in pairs."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return members.join(nodes, "node").select("node", "id")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components, with these, the smaller first."""
    a, b = roots.withColumnsRenamed({"node": "a", "root": "x"}), roots.withColumnsRenamed({"node": "b", "root": "y"})
    rooted = pairs.join(a, "a", "left").join(b, "b", "left")
    x, y = F.coalesce("x", "a"), F.coalesce("y", "b")
    return rooted.where(x != y).select("a", "b", F.least(x, y).alias("root_a"), F.greatest(x, y).alias("root_b"))


def grouped(signs: DataFrame) -> DataFrame:
    """``(signature, node, hub)`` of the signatures that several nodes have; a node of the group is its hub.

    Rows are dealt by signature and sorted, which spills; one pass over them holds nothing but the row before. Any node
    serves as a hub; it is drawn by group, so that a node of many groups meets many hubs.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, hub, alone = None, None, True
        for batch in batches:
            s, v = batch["signature"].to_numpy(np.int64), batch["node"].to_numpy(np.int64)
            if last is not None:  # the row before stands in front again
                s, v = np.append(last[0], s), np.append(last[1], v)
            new = np.append(True, (s[1:] != s[:-1]) | (v[1:] != v[:-1]))
            s, v = s[new], v[new]
            first = np.append(True, s[1:] != s[:-1])
            hubs = v[np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))]
            if last is not None:
                hubs[: int(np.argmax(first[1:])) + 1 if first[1:].any() else len(s)] = hub
            shared = ~first | np.append(~first[1:], False)
            shared[0] = shared[0] and (last is None or alone)  # else it came out already
            shared[0] = shared[0] and len(s) > 1 and not first[1]
            yield pd.DataFrame({"signature": s[shared], "node": v[shared], "hub": hubs[shared]})
            alone = bool(first[-1]) if len(s) > 1 or last is None else alone
            last, hub = (s[-1], v[-1]), hubs[-1]

    dealt = signs.withColumn("draw", F.xxhash64("signature", "node")).repartition("signature").sortWithinPartitions("signature", "draw", "node")
    return dealt.select("signature", "node").mapInPandas(pick, "signature long, node long, hub long")


def _among(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id may be wanted, found while reading them: few others reach the exchange.

    The map of wanted ids has ``WANTED`` bits, whatever their number: 2 MB at most, in words of 64.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(WANTED))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(id), {WANTED}) % 64 AS INT))")
    marks = wanted.select((place / 64).cast("long").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    near = texts.withColumn("word", (place / 64).cast("long")).join(F.broadcast(marks), "word")
    return near.where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``(node, grams)`` of the wanted nodes ``(node, id)``, from the texts of one id each."""

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(_shingler(n).sets(batch["text"].tolist()))
            right = [node(s) == name for s, name in zip(sets, batch["node"])]
            yield pd.DataFrame({
                "node": batch["node"][right].to_numpy(np.int64),
                "grams": pd.Series([s.tobytes() for s, ok in zip(sets, right) if ok], dtype=object),
            })

    found = _among(texts, wanted).join(wanted.withColumnRenamed("id", "wanted_id"), F.col("id").eqNullSafe(F.col("wanted_id"))).select("node", "text")
    return found.mapInPandas(again, "node long, grams binary").dropDuplicates(["node"])


def _linked(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs, ``a`` and ``b`` among their columns, that are similar, by their sets."""

    @pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.sort(np.concatenate([a, b]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out.append(100 * shared >= similarity * (len(a) + len(b) - shared))
        return pd.Series(out)

    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    return pairs.join(right, "b").join(left, "a").where(similar("grams_a", "grams_b")).select(*pairs.columns)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes with links ``(a, b)``: the smallest node reachable.

    Every node's larger neighbours are hung under its smallest one, then smaller ones likewise, until stars remain.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.where("u <> v")
        smallest = lower.groupBy("u").agg(F.min("v").alias("m"))
        hung = lower.join(smallest, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v")))
        last, edges = edges, stored(small.distinct(), "links")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more links ``(root_a, root_b)`` between components: only these are taken together."""
    over = stored(components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "over")
    lifted = roots.join(over.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(lifted.unionByName(over).groupBy("node").agg(F.min("root").alias("root")), "roots")


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Null or empty text has no n-grams and is linked with nothing: its component is its own id. Rows that repeat an id
    are each judged by their own text; a null id takes part but names no component unless nothing else does. Other
    columns do not matter; an empty table gives none. Sets are compared as 64-bit hashes of their n-grams.
    """
    texts = _texts(docs, id_col, text)
    named = stored(nodes(texts, n), "nodes")
    classes = named.where("size > 0").groupBy("node").agg(
        F.min("id").alias("id"), F.any_value("size").alias("size"), F.any_value("parity").alias("parity"),
        F.any_value("wide").alias("wide"))
    groups = stored(grouped(signed(texts, n, similarity)), "groups")
    members = stored(classes.join(groups.select("node").distinct(), "node"), "members")
    left = members.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("parity").alias("parity_a"))
    right = members.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("parity").alias("parity_b"))
    may_link = _may_link(similarity, "size_a", "parity_a", "size_b", "parity_b")
    may = (
        groups.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        .join(right, "b").join(left, "a").where(may_link).select("a", "b"))
    may = stored(may, "pairs")
    stars = stored(_narrowed(may, members, similarity), "pairs")
    discard(may)
    sets = stored(_sets(texts, _named(members, stars), n), "sets")
    # one comparison a node first; then, between the components that gives, one for each two that have a pair left; then all
    tested = stored(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    roots = stored(components(stored(_linked(tested, sets, similarity), "linked")), "roots")
    for one_each in (True, False):
        left_over = stored(_between(stars, roots).join(tested, ["a", "b"], "left_anti"), "pairs")
        if left_over.isEmpty():
            break
        pairs = left_over
        if one_each:
            pairs = left_over.groupBy("root_a", "root_b").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b", "root_a", "root_b")
        links = stored(_linked(pairs, sets, similarity), "linked")
        if not links.isEmpty():
            last, roots = roots, _merged(roots, links)
            discard(last, links)
        tested = stored(tested.unionByName(pairs.select("a", "b")), "pairs")
        discard(left_over)
    # what is left are pairs without their group's hub; a large group's rows are dealt in blocks, each two of which meet
    labelled = groups.where("node <> hub").select("signature", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("signature").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low < high")
    open_groups = stored(labelled.join(mixed.select("signature", "blocks"), "signature"), "open")
    block, other_block = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = open_groups.join(members, "node").select("signature", "node", "root", "size", "parity", block.alias("block"), other_block)
    dealt = placed.select(
        "signature", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "root", "size", "parity", "block",
    ).repartition("signature", "low", "high")
    one, other = (
        dealt.toDF("signature", "low", "high", side, f"root_{side}", f"size_{side}", f"parity_{side}", f"block_{side}") for side in ("a", "b")
    )
    apart = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & ((F.col("low") == F.col("high")) | (F.col("block_a") != F.col("block_b")))
    may = one.join(other, ["signature", "low", "high"]).where(apart & may_link).select(
        "a", "b", F.least("root_a", "root_b").alias("root_a"), F.greatest("root_a", "root_b").alias("root_b")).distinct().join(tested, ["a", "b"], "left_anti")
    may = stored(may, "pairs")
    discard(groups, open_groups, stars, tested, sets)
    across = stored(_narrowed(may, members, similarity), "pairs")
    if not across.isEmpty():
        links = stored(_linked(across, stored(_sets(texts, _named(members, across), n), "sets"), similarity), "linked")
        if not links.isEmpty():
            roots = _merged(roots, links)
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = rooted.join(least, "root").select("node", "component_id")
    some = named.where("size > 0").join(labels, "node").select("id", "size", "component_id")
    empty = named.where("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return some.unionByName(empty).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one whose id names the component, once if the row is repeated.

    Rows without words stay, as often as they are there. Of rows that share an id but not their columns each stays.
    """
    judged = join(docs, id_col, text, n, similarity)
    name = free_name(docs, "kept_id")
    kept = stored(judged.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias(name)).agg(
        F.max("n_shingles").alias("size"), F.count("*").alias("times")), "kept")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(name))
    several = (F.col("size") > 0) & (F.col("times") > 1)
    once = docs.join(kept.where(~several).select(name), same, "left_semi")
    repeated = kept.where(several).select(name)
    if repeated.isEmpty():
        return once
    return once.unionByName(docs.join(repeated, same, "left_semi").distinct())
