"""Repetition inside a text, by a suffix array over its words.

All texts of a batch are sorted together: suffixes by prefix doubling, of which only those not yet told apart are sorted
again. The ranks kept at each doubling give the longest common prefix of neighbours, and these give, per position, the
longest passage from there that occurs elsewhere in the text. Spans of such passages are united per text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import session, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Shortest repeated passage, in words, for the base and for the verdict's first limit.
WINDOW = 8
#: The verdict's limits: characters of words in repeated passages of ``WINDOW`` words, and the longest passage repeated.
MAX_COVERED = 0.3
#: The same for repeated passages of three words and of two, of which long prose has many by chance: their shares are
#: 0.48 and 0.69 in a manual of 49,000 words, 0.43 and 0.55 in a license of 1,200.
MAX_TRIPLES, MAX_PAIRS = 0.5, 0.75
MAX_REPEAT = 200


def suffix_array(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all texts in order (a text's together) and the common prefix of each with the next one.

    ``ids`` are word numbers, ``text`` the number of the text a word belongs to, ascending.
    """
    n = len(ids)
    key = text * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    rank, levels, h = np.empty(n + 1, np.int64), [], 1
    rank[n] = -1
    slots, todo, key = np.arange(n), order, key[order]
    while True:
        new = np.diff(key, prepend=-1) != 0
        first = np.maximum.accumulate(np.where(new, slots, 0))  # a group is named by its first slot
        rank[todo] = first
        order[slots] = todo
        levels.append(rank.copy())
        single = new & np.append(new[1:], True)
        slots, todo = slots[~single], todo[~single]
        if not len(todo):
            break
        ahead = np.minimum(todo + h, n)
        inside = (todo + h < n) & (text[np.minimum(todo + h, n - 1)] == text[todo])
        key = rank[todo] * (n + 2) + np.where(inside, rank[ahead], -1) + 1
        again = np.argsort(key, kind="stable")
        todo, key = todo[again], key[again]
        h *= 2
    return order, _common_prefixes(order, levels)


def _common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(left), np.int64)
    live = np.flatnonzero(levels[0][left] == levels[0][right])
    left, right = left[live], right[live]
    length = np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ranks = levels[k]
        same = ranks[left + length] == ranks[right + length]
        length += same.astype(np.int64) << k
    common[live] = length
    return common


def longest_repeats(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Per position, the longest passage from there that starts elsewhere in the text too."""
    longest = np.zeros(len(order), np.int64)
    longest[order] = np.maximum(np.append(common, 0), np.insert(common, 0, 0)) if len(order) else 0
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeated passage of at least ``least`` words."""
    starts = np.flatnonzero(longest >= least)
    delta = np.bincount(starts, minlength=len(longest) + 1)
    delta -= np.bincount(starts + longest[starts], minlength=len(longest) + 1)
    return np.cumsum(delta[:-1]) > 0


def maximal_repeats(order: np.ndarray, common: np.ndarray, ids: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, list[int]]]:
    """``(length, starts)`` of every passage of at least ``least`` words whose occurrences extend to neither side alike.

    Intervals of the common prefixes are closed by a stack; one is maximal if different words stand before its
    occurrences (the start of a text counts as different).
    """
    found, stack = [], []  # (length, first slot)
    for slot, length in enumerate([*common.tolist(), 0]):
        first = slot
        while stack and stack[-1][0] > length:
            shared, first = stack.pop()
            starts = sorted(order[first:slot + 1].tolist())
            before = {ids[s - 1] if s and text[s - 1] == text[s] else -1 - s for s in starts}
            if shared >= least and len(before) > 1:
                found.append((shared, starts))
        if length and (not stack or stack[-1][0] < length):
            stack.append((length, first))
    return sorted(found, key=lambda x: (-x[0], x[1]))


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The measures of a batch of whole texts."""
    lists = [words(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for x in lists for w in x), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    lengths = np.array([len(w.decode("utf-8", "surrogatepass")) for w in number], np.int64)
    chars = lengths[ids] if len(ids) else ids

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=values, minlength=len(texts)).astype(np.int64)

    longest = longest_repeats(*suffix_array(ids, text)) if len(ids) else ids
    # these are also the spans of the maximal repeats: a passage found twice lies in one that extends to neither side
    repeated, triples, pairs = (covered(longest, least) for least in (WINDOW, 3, 2))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, text, longest)
    return {
        "n_words": sizes,
        "word_chars": per_text(chars),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([_repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": per_text(repeated),
        "repeat_chars": per_text(chars * repeated),
        "triple_chars": per_text(chars * triples),
        "pair_chars": per_text(chars * pairs),
        "longest_repeat": top,
    }


def _repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "triple_chars",
            "pair_chars", "longest_repeat")


def judge(docs: DataFrame, text: str = "text", into: str = "repetition", max_covered: float = MAX_COVERED,
          max_repeat: int = MAX_REPEAT, max_triples: float = MAX_TRIPLES, max_pairs: float = MAX_PAIRS) -> DataFrame:
    """Add ``into``, a struct of the measures with ``base_failed`` and ``kept``.

    ``kept`` is false for texts that fail the base (under 20 words, or over 30% of the words in 8-word windows found
    twice), that have more than ``max_covered`` of their word characters in repeated passages of 8 words or more,
    ``max_triples`` in those of three or more or ``max_pairs`` in those of two or more (words said a few times in a row
    are such), or whose longest repeated passage has more than ``max_repeat`` words. Null text counts as empty: no words, so it fails. Other
    columns and repeated rows pass unchanged; a column called ``into`` is replaced.
    """
    session(docs.sparkSession)

    @pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(measure(list(batch)))

    m = F.col("`__measures`")
    base_failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    kept = (
        ~base_failed & (m["repeat_chars"] <= max_covered * m["word_chars"]) & (m["longest_repeat"] <= max_repeat)
        & (m["triple_chars"] <= max_triples * m["word_chars"]) & (m["pair_chars"] <= max_pairs * m["word_chars"])
    )
    return (
        docs.withColumn("__measures", measures(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
        .withColumn(into, F.struct(*[m[x].alias(x) for x in MEASURES], base_failed.alias("base_failed"), kept.alias("kept")))
        .drop("__measures")
    )
