"""Personal data: fixed patterns, and what stands in the same places as their findings.

The identifiers found by fixed patterns are seeds. The words around them are lexical patterns; a graph joins patterns to
the instances seen in them, seeds and unknown identifier-like strings alike. Spark scores it in rounds: a pattern is as
good for a kind as the instances in it, an unknown instance as good as its patterns. Unknown strings in patterns of high
confidence become spans of that kind.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, stored
from .spans import SPAN

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern speaks for a kind from so many distinct instances and this confidence on.
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Strings that might identify someone: number groups, and two parts around some form of "at".
_NUMBERS = re.compile(r"(?<![A-Za-z0-9])[(+]?[0-9][0-9().\x20/-]{5,30}[0-9](?![A-Za-z0-9])")
_AT = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9.-]{1,64}(?![A-Za-z0-9-])")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards, so that long runs without one cost nothing."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, floor
        at = text.find("@", max(floor, at + 1))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def find_base(text: str) -> list[tuple[str, int, int]]:
    """All findings of the fixed patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    spans = [("email", a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def find_unknown(text: str, known: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings that touch no known span."""
    patterns = ([_NUMBERS] if _DIGITS.search(text) else []) + ([_AT] if "@" in text or "at)" in text or "at]" in text else [])
    spans = sorted(m.span() for p in patterns for m in p.finditer(text))
    if not spans:
        return []
    starts, ends = [], []  # the known spans, united
    for a, b in sorted((a, b) for _, a, b in known):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    found, taken = [], 0
    for a, b in spans:
        before = bisect_left(starts, b) - 1  # the last known one that starts before the end
        if a < taken or before >= 0 and ends[before] > a:
            continue
        if len(_DIGITS.findall(text, a, b)) >= 7 or _AT.fullmatch(text, a, b):
            found.append((a, b))
            taken = b
    return found


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: two words before it, and one word on either side."""
    before = _DIGITS.sub("0", text[max(0, start - 80):start].lower()).split()[-2:]
    after = _DIGITS.sub("0", text[end:end + 40].lower()).split()[:1]
    return ([f"{before[0]} {before[1]} _"] if len(before) == 2 else []) + (
        [f"{before[-1]} _ {after[0]}"] if before and after else []
    )




def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One written row per document: its id, a row number, and every known (or ``?``) span with its patterns."""

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["text"]:
                base = find_base(t)
                every = base + [("?", a, b) for a, b in find_unknown(t, base)]
                out.append([
                    {"kind": k, "start": a, "end": b, "value": t[a:b].lower(), "patterns": contexts(t, a, b)}
                    for k, a, b in every
                ])
            yield pd.DataFrame({"id": batch["id"], "spans": pd.Series(out, index=batch.index, dtype=object)})

    session(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    found = texts.mapInPandas(spans, f"id {kind}, spans array<struct<kind:string,start:int,end:int,value:string,patterns:array<string>>>")
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "personal")


def bootstrap(found: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT,
              min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(pattern, kind)`` of the patterns that speak for a kind, after some rounds over the graph.

    Edges are distinct (pattern, instance) pairs, so copies of a text count once. A pattern's confidence for a kind is
    the mean score of its instances; an unknown instance's score is the best confidence among its patterns.
    """
    places = found.select(F.explode("spans").alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern"))
    edges = stored(
        places.select("pattern", F.col("kind").alias("seed"), F.xxhash64("value").alias("instance")).distinct(), "edges"
    )
    scores = edges.where("seed <> '?'").select("instance", "seed").distinct().select(
        "instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    sizes = edges.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("size"))
    unknown = edges.where("seed = '?'").select("pattern", "instance").distinct()
    seeds, confident = scores, None
    for _ in range(rounds):
        sums = (
            edges.select("pattern", "instance").distinct().join(scores, "instance")
            .groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
        )
        confident = stored(
            sums.join(sizes, "pattern")
            .where((F.col("size") >= min_support) & (F.col("total") >= min_confidence * F.col("size")))
            .select("pattern", "kind", (F.col("total") / F.col("size")).alias("confidence")),
            "patterns",
        )
        learned = unknown.join(confident, "pattern").groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        scores = seeds.unionByName(learned).groupBy("instance", "kind").agg(F.max("score").alias("score"))
    return confident


def extract(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: its id, ``base`` and ``added`` arrays of spans (code points, end exclusive).

    Null text counts as empty. Repeated rows are scanned each for itself, null ids stay null, other columns do not
    matter, an empty table gives none. A place in confident patterns of several kinds gets the kind of the highest
    confidence, ties to the kind listed first.
    """
    found = scan(docs, id_col, text)
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    places = (
        found.select("row", F.explode("spans").alias("s")).where("s.kind = '?'")
        .select("row", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    )
    added = (
        places.join(bootstrap(found, rounds), "pattern")
        .groupBy("row", "start", "end")
        .agg(F.max_by("kind", F.struct("confidence", -rank[F.col("kind")])).alias("kind"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind")).alias("added"))
    )
    none = F.array().cast(f"array<{SPAN}>")
    base = F.transform(
        F.filter("spans", lambda s: s["kind"] != "?"),
        lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return (
        found.select("row", F.col("id").alias(id_col), base.cast(f"array<{SPAN}>").alias("base"))
        .join(added, "row", "left")
        .select(id_col, "base", F.coalesce(F.col("added").cast(f"array<{SPAN}>"), none).alias("added"))
    )
