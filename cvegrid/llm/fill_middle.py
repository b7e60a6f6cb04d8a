"""Fill-in-the-middle texts, cut between words by arithmetic on eight bytes at a time.

The texts of a batch lie one after the other as UTF-8, each filled up with spaces to whole 64-bit words. Comparisons within
a word mark the bytes that end a unit; ``bitwise_count`` and a running sum number the units; the word that holds the k-th
end is found by a search in the sums, and the byte in it by a multiplication that counts the marks byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import session

#: What opens the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are rearranged, and of a hundred of those so many begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42

ONES = np.uint64(0x0101010101010101)
LOW, HIGH = ONES * np.uint64(0x7F), ONES * np.uint64(0x80)
EIGHT, SEVEN, TOP = np.uint64(8), np.uint64(7), np.uint64(56)


def white(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a space or one of U+0009 to U+000D; no carry crosses a byte."""
    low = words & LOW
    from_9 = low + ONES * np.uint64(0x80 - 0x09)
    from_14 = low + ONES * np.uint64(0x80 - 0x0E)
    not_space = (low ^ (ONES * np.uint64(0x20))) + LOW
    return ((from_9 & ~from_14) | ~not_space) & ~words & HIGH


def select(marks: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The number of the byte that holds the ``rank``-th mark (from 1) of each word, lowest byte first."""
    upto = (marks >> SEVEN) * ONES  # byte i: the marks in bytes 0 to i
    reached = ((upto | HIGH) - rank.astype(np.uint64) * ONES) & HIGH
    return 8 - np.bitwise_count(reached).astype(np.int64)


class Units:
    """The units of a batch of texts: how many there are in each, and where the first k of them end."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        fill = 8 - self.sizes % 8  # one to eight: a text's last byte is always followed by white space
        data = b"".join([t + b" " * n for t, n in zip(texts, fill.tolist())])
        words = np.frombuffer(data, "<u8")
        ends = np.cumsum((self.sizes + fill) >> 3)
        self.first = ends - ((self.sizes + fill) >> 3)
        gaps = white(words)
        after = np.append(gaps[1:], HIGH) << TOP
        self.marks = ~gaps & HIGH & ((gaps >> EIGHT) | after)
        # white space at the end of a text is a unit of its own
        last = self.first * 8 + self.sizes - 1
        held = np.flatnonzero(self.sizes > 0)
        bit = HIGH & (np.uint64(0xFF) << ((last[held] & 7).astype(np.uint64) * EIGHT))
        open_ended = (gaps[last[held] >> 3] & bit) != 0
        self.marks[last[held][open_ended] >> 3] |= bit[open_ended]
        self.upto = np.cumsum(np.bitwise_count(self.marks).astype(np.int64))
        self.before = np.where(self.first > 0, self.upto[self.first - 1], 0) if len(texts) else np.zeros(0, np.int64)
        self.counts = (self.upto[ends - 1] if len(texts) else np.zeros(0, np.int64)) - self.before

    def cut(self, k: np.ndarray) -> np.ndarray:
        """The bytes of each text's first ``k`` units, 0 to all of them."""
        wanted = self.before + k
        word = np.searchsorted(self.upto, wanted)
        word = np.minimum(word, max(len(self.upto) - 1, 0))  # k = 0 at the end of the batch: not used
        rank = wanted - np.where(word > 0, self.upto[word - 1], 0)
        place = word * 8 + select(self.marks[word], np.maximum(rank, 1)) + 1
        return np.where(k > 0, place - self.first * 8, 0)


def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, one, other in batches:
        units = Units(texts.tolist())
        a, b = (x.to_numpy(np.int64) % (units.counts + 1) for x in (one, other))
        yield pd.DataFrame({
            "n": units.counts, "cut_1": units.cut(np.minimum(a, b)), "cut_2": units.cut(np.maximum(a, b))})


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits, drawn by an id: the beginning of a digest. A null id draws like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", into: str = "fim", seed: int = SEED,
              rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Add ``into``: ``n`` (units of the text), ``form`` (plain, psm or spm), ``output``, ``prefix_chars``, ``middle_chars``.

    A unit is white space and the word that follows it, or white space at the end. Null text counts as empty; empty texts
    and those that hold a marker stay plain, with null lengths. Rows are cut each for itself, equal rows alike; other
    columns pass unchanged, one called ``into`` is replaced; an empty table gives none.
    """
    session(docs.sparkSession)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    h = draws(F.col(f"`{id_col}`"), seed)
    cut = pandas_udf(_cuts, "n long, cut_1 int, cut_2 int")(whole.cast("binary"), h[0], h[1])
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    plain = (whole == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.withColumn(into, F.struct(cut.alias("cut"), form.alias("form"), whole.cast("binary").alias("bytes")))
    at, form, data = (F.col(f"`{into}`.{x}") for x in ("cut", "form", "bytes"))
    piece = lambda start, length: F.substring(data, start, length).cast("string")
    prefix = piece(F.lit(1), at["cut_1"])
    middle = piece(at["cut_1"] + 1, at["cut_2"] - at["cut_1"])
    suffix = piece(at["cut_2"] + 1, F.octet_length(data) - at["cut_2"])
    output = (
        F.when(form == "plain", data.cast("string"))
        .when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    length = lambda x: F.when(form != "plain", F.char_length(x).cast("long"))
    return rows.withColumn(into, F.struct(
        at["n"].alias("n"), form.alias("form"), output.alias("output"),
        length(prefix).alias("prefix_chars"), length(middle).alias("middle_chars")))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: a text that holds a marker stays plain, so the markers split it."""
    # a marker begins and ends differently, so none arises where a piece and a marker meet
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second = (F.get(pieces, F.lit(i)) for i in (1, 2))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(first, F.get(pieces, F.lit(3)), second))
        .otherwise(F.concat(second, F.get(pieces, F.lit(3)), first))
    )
