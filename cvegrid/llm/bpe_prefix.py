"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a piece there is exactly one token with which its encoding can end: the one whose neighbour
to the left, the last token of the remaining prefix, stays next to it when the two are encoded together. Storing that
token per prefix gives the encoding of every prefix at once. Appending bytes only adds entries, and an edit only
recomputes entries until a token's length of them agrees with the old ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import LONG_KEY, Memo, free_name, session, worker_state

#: Last tokens of prefixes that a worker remembers before it starts anew.
PREFIXES = 300_000
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class PrefixEncoder:
    """Encodes and decodes pieces by the ranks of their tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._beside = Memo(lambda pair: self._merged(self.tokens[pair[0]] + self.tokens[pair[1]]) == list(pair))
        self._alone = {}
        self._prefixes: dict[bytes, int] = {}

    def _stands(self, token: int) -> bool:
        """Whether a token's own bytes merge to it; the answers are bounded by the vocabulary."""
        if token not in self._alone:
            self._alone[token] = self._merged(self.tokens[token]) == [token]
        return self._alone[token]

    def _merged(self, data: bytes) -> list[int]:
        """The definition: merge the leftmost pair of lowest rank while there is one."""
        rank, none, cuts = self.ranks.get, len(self.ranks) + 1, list(range(len(data) + 1))
        pairs = [rank(data[i:i + 2], none) for i in range(len(data) - 1)]
        while pairs and (lowest := min(pairs)) < none:
            i = pairs.index(lowest)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(data[cuts[i]:cuts[i + 2]], none)
            if i:
                pairs[i - 1] = rank(data[cuts[i - 1]:cuts[i + 1]], none)
        return [self.ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def extend(self, last: list[int], data: bytes, upto: int | None = None) -> list[int]:
        """Add to ``last`` (the last tokens of shorter prefixes) those of longer prefixes of ``data``."""
        rank, longest, beside = self.ranks.get, self.longest, self._beside
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):  # short tokens are the likely ones
                token = rank(data[start:end])
                if token is not None and (beside[last[start - 1], token] if start else self._stands(token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}: the ranks lack a byte")
        return last

    def path(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes."""
        out, end = [], len(last) if end is None else end
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def replace(self, last: list[int], data: bytes, start: int, stop: int, new: bytes) -> tuple[list[int], bytes]:
        """The table after ``data[start:stop]`` gave way to ``new``, and the new bytes.

        Entries depend on the bytes and entries of one longest token before them: once that many in a row agree with
        the old ones, all later ones do.
        """
        edited = data[:start] + new + data[stop:]
        table, shift, same = last[:start], len(new) - (stop - start), 0
        settled = start + len(new) + self.longest
        for end in range(start + 1, len(edited) + 1):
            self.extend(table, edited, end)
            old = end - shift
            same = same + 1 if end > start + len(new) and old > 0 and table[-1] == last[old - 1] else 0
            if end >= settled and same >= self.longest:
                return table + last[old:], edited
        return table, edited

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece that is a token is that token, as in the tokenizer's own library.

        The last tokens of short pieces' prefixes are remembered, so pieces share the work on common beginnings.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > LONG_KEY:
            return self.path(self.extend([], piece))
        known, end = self._prefixes, len(piece) - 1
        while end and piece[:end] not in known:
            end -= 1
        last = self.extend([known[piece[:k]] for k in range(1, end + 1)], piece)
        if len(known) > PREFIXES:  # start anew, with the shared beginnings too: every prefix of a known one is known
            known.clear()
            end = 0
        for k in range(end + 1, len(piece) + 1):
            known[piece[:k]] = last[k - 1]
        return self.path(last)


class TextEncoder:
    """Whole texts: the pieces of the pattern, each encoded alone, results of common pieces remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = regex.compile(pattern)
        self.prefix = PrefixEncoder(ranks)
        self.memo = Memo(self._packed, 300_000)

    def _packed(self, piece: str) -> bytes:
        return np.array(self.prefix.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pieces.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.prefix.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(df: DataFrame, rank_file: str, pattern: str):
    with open(rank_file, "rb") as file:  # on the driver; the tasks get its bounded content
        shipped = df.sparkSession.sparkContext.broadcast(file.read())
    return lambda: worker_state(("bpe", shipped.value, pattern), lambda: TextEncoder(load_ranks(shipped.value), pattern))


def encode(docs: DataFrame, text: str = "text", into: str = "ids", rank_file: str = RANK_FILE,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add ``into``: the token ids of ``text`` as little-endian unsigned 32-bit integers.

    Null text counts as empty. Rows are independent: repeated rows, other columns and an empty table pass unchanged,
    a column already called ``into`` is replaced. Text of any length is encoded whole.
    """
    session(docs.sparkSession)
    codec = _codec(docs, rank_file, pattern)

    @pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = codec()
        for batch in batches:
            yield pd.Series([encoder.encode(text) for text in batch], dtype=object)

    return docs.withColumn(into, encoded(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", rank_file: str = RANK_FILE,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add ``into``: the bytes that the ids in column ``ids`` stand for. Null ids decode to no bytes."""
    session(docs.sparkSession)
    codec = _codec(docs, rank_file, pattern)

    @pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = codec()
        for batch in batches:
            yield pd.Series([encoder.decode(x) for x in batch], dtype=object)

    return docs.withColumn(into, decoded(F.coalesce(F.col(f"`{ids}`"), F.lit(b""))))


def round_trip(docs: DataFrame, text: str = "text", into: str = "ids", back: str = "decoded", rank_file: str = RANK_FILE,
               pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add ``into`` as ``encode`` does and ``back`` as ``decode`` does from it, both in one pass.

    Two passes would keep two Python workers for each task, each with its own remembered pieces.
    """
    session(docs.sparkSession)
    codec = _codec(docs, rank_file, pattern)

    @pandas_udf("ids binary, decoded binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = codec()
        for batch in batches:
            ids = [encoder.encode(text) for text in batch]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(list(map(encoder.decode, ids)), dtype=object)})

    both = free_name(docs, "both")
    return docs.withColumn(both, coded(F.coalesce(F.col(f"`{text}`"), F.lit("")))).withColumns(
        {into: F.col(f"{both}.ids"), back: F.col(f"{both}.decoded")}).drop(both)
