"""Token ids as canonical, length-limited Huffman codes.

Format, under one folder: ``lengths`` holds the code length of every token (codes follow canonically, by length and
then id); ``blocks`` holds independent blocks of whole documents in ascending document order. A block carries its
documents' ids and lengths, the bits, and the bit offset of every ``CHECKPOINT``-th token, so that a reader decodes all
stretches of a block side by side, or any one of them alone.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from tokenizers import Tokenizer

from .common import Memo, session, stored, worker_state
from .lexicon import Lexicon, parts, split

TOKENIZER_FILE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
BLOCK = 1 << 17
CHECKPOINT = 64
LIMIT = 16
#: Words that a task remembers: about 100 MB.
WORDS = 450_000
#: Marks that may combine with a letter before it, where case and composition interact.
MARKS = regex.compile(r"\p{M}")


# ---------------------------------------------------------------- tokens


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the model's vocabulary: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class WordTokens(Lexicon):
    """The library's ids of texts, word by word.

    The tokenizer drops white space and never merges across it, so a word is encoded once and remembered. ASCII letters
    are lowered first, as the tokenizer does itself; texts with combining marks are left as they are, for there
    composition comes first. A word of letters is one piece and goes to the library's model directly, and punctuation
    after letters is a piece of its own. Texts that hold the name of a special token go to the library whole.
    """

    TAIL = bytes(set(string.punctuation.encode()) - set(b"'"))  # an apostrophe may open an ending

    def __init__(self, definition: str, limit: int = WORDS):
        super().__init__(limit)
        self.tokenizer = Tokenizer.from_str(definition)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Memo(self._whole, 10_000)

    def _whole(self, word: bytes) -> list[int]:
        self.tokenizer.encode_special_tokens = True  # within a word their names come from lowering alone
        return self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids

    def _one(self, word: bytes) -> list[int]:
        core = word.rstrip(self.TAIL)
        if not core:
            return self.pieces[word]
        if core.isascii():
            letters, lowered = core.isalpha(), core.lower()
        else:  # Latin letters: composed already, and lowered alike everywhere but for the dotted I
            text = core.decode("utf-8")
            letters = text.isalpha() and max(text) < "\u0250" and "\u0130" not in text
            lowered = text.lower().encode("utf-8")
        if not letters:
            return self.pieces[word]
        piece = lowered.decode("ascii") if lowered.isascii() else "".join(map(self.letters.__getitem__, lowered))
        ids = [token.id for token in self.model.tokenize(piece)]
        return ids if len(core) == len(word) else ids + self.pieces[word[len(core):]]

    def _spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._one(word) for word in words]
        return np.fromiter((i for ids in found for i in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _prepared(self, text: str) -> bytes:
        data = text.encode("utf-8")
        return data.lower() if text.isascii() or not MARKS.search(text) else data  # bytes: ASCII letters only

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = []
        for some in parts(texts):
            if self.full():
                self.forget()
            named = [any(name in text for name in self.special) for text in some]
            data, starts, ends, bounds = split([b"" if n else self._prepared(text) for n, text in zip(named, some)])
            ids, sizes = self.spell(self.look(data, starts, ends))
            found = np.split(ids, np.append(0, np.cumsum(sizes))[bounds[1:-1]])
            for at in np.flatnonzero(named).tolist():
                self.tokenizer.encode_special_tokens = False
                found[at] = np.array(self.tokenizer.encode(some[at], add_special_tokens=False).ids, np.uint32)
            out += found
        return out


def tokenize(docs: DataFrame, text: str = "text", into: str = "ids", tokenizer_file: str = TOKENIZER_FILE,
             end_id: int | None = END_ID, width: int = 4) -> DataFrame:
    """Add ``into``: the ids of ``text`` as little-endian unsigned integers of ``width`` bytes, ended by ``end_id``.

    The ids are those of the library with ``add_special_tokens=False``: a special token's name in a text is its one id.
    Null text counts as empty; other columns and repeated rows pass unchanged.
    """
    session(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as file:  # on the driver; the tasks get its bounded content
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    tail = np.array([] if end_id is None else [end_id], f"<u{width}").tobytes()

    @pandas_udf("binary")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = worker_state(("words", tokenizer_file), lambda: WordTokens(shipped.value))
        for batch in batches:
            yield pd.Series([ids.astype(f"<u{width}").tobytes() + tail for ids in coder.encode(batch.tolist())], dtype=object)

    return docs.withColumn(into, tokens(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


# ---------------------------------------------------------------- codes


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits, by merging packages of the rarest symbols."""
    symbols = sorted((s for s, n in counts.items() if n > 0), key=lambda s: (counts[s], s))
    n = len(symbols)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    if n < 2:
        return dict.fromkeys(symbols, 1)
    leaves = np.array([counts[s] for s in symbols], np.int64)
    current, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        current = both[order]
        levels.append(order < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    return dict(zip(symbols, lengths.tolist()))


class Codec:
    """Canonical codes for given lengths: packs arrays of ids, decodes them by one table of all bit windows."""

    def __init__(self, lengths: dict[int, int], limit: int = LIMIT):
        self.limit = limit
        size = max(lengths, default=0) + 1
        self.length, self.code = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.symbol_at, self.length_at = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.int64)
        code, before = 0, 0
        for symbol, length in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
            code <<= length - before
            self.length[symbol], self.code[symbol] = length, code
            self.symbol_at[code << (limit - length):(code + 1) << (limit - length)] = symbol
            self.length_at[code << (limit - length):(code + 1) << (limit - length)] = length
            code, before = code + 1, length

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, first bit highest, and the bit offset of every checkpoint."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        lengths = self.length[ids]
        if not lengths.all():
            raise ValueError("a token without a code")
        ends = np.cumsum(lengths)
        starts = ends - lengths
        word = starts >> 5
        window = self.code[ids] << (64 - (starts & 31) - lengths).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        words[word[first]] += np.add.reduceat(window >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes()[: -(-int(ends[-1]) // 8)], starts[::CHECKPOINT]

    def unpack(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All ``n`` ids: one step decodes the next id of every stretch between checkpoints."""
        data = np.frombuffer(bits + b"\0" * 4, np.uint8).astype(np.uint32)
        windows = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        at, out = checkpoints.astype(np.int64), np.zeros((len(checkpoints), CHECKPOINT), np.uint32)
        last = n - (len(checkpoints) - 1) * CHECKPOINT  # ids of the last stretch
        for step in range(CHECKPOINT if len(checkpoints) > 1 else last):
            if step == last:
                at = at[:-1]
            shift = (24 - self.limit - (at & 7)).astype(np.uint32)
            window = (windows[at >> 3] >> shift) & np.uint32((1 << self.limit) - 1)
            out[: len(at), step] = self.symbol_at[window]
            at = at + self.length_at[window]
        return out.reshape(-1)[:n]


# ---------------------------------------------------------------- files


def count_ids(docs: DataFrame, ids: str = "ids", width: int = 4) -> DataFrame:
    """``(id, n)`` over all documents: tasks add up their own ids first."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            part = np.bincount(np.frombuffer(b"".join(batch.iloc[:, 0]), f"<u{width}"))
            if len(part) > len(total):
                total = np.pad(total, (0, len(part) - len(total)))
            total[: len(part)] += part
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    ids_only = docs.select(F.coalesce(F.col(f"`{ids}`"), F.lit(b"")).alias("ids"))
    return ids_only.mapInPandas(add_up, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _block_schema(id_type: T.DataType) -> str:
    kind = id_type.simpleString()
    return (
        f"part int, block int, start long, n_ids long, docs array<{kind}>, doc_ids array<long>, "
        "bits binary, checkpoints binary"
    )


def write(docs: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids", limit: int = LIMIT,
          width: int = 4) -> None:
    """Write the ids of all documents under ``path``, in ascending order of ``id_col`` (null first).

    Rows with equal ids stay apart, in the order of their tokens. An empty table gives empty files. The code table is
    as large as the vocabulary, which is what the driver holds; the documents are range-sorted by Spark.
    """
    spark = session(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{ids}`"), F.lit(b"")).alias("ids"))
    counts = {row["id"]: row["n"] for row in count_ids(rows, "ids", width).collect()}
    lengths = code_lengths(counts, limit)
    spark.createDataFrame(sorted(lengths.items()), "id long, length int").coalesce(1).write.parquet(f"{path}/lengths")
    shipped = spark.sparkContext.broadcast(lengths)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = worker_state(("codes", path), lambda: Codec(shipped.value, limit))
        part, block, start, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def row():
            ids = np.frombuffer(b"".join(x for _, x in held), f"<u{width}")
            bits, checkpoints = codec.pack(ids)
            return pd.DataFrame({
                "part": [part], "block": [block], "start": [start], "n_ids": [len(ids)],
                "docs": [[i for i, _ in held]], "doc_ids": [[len(x) // width for _, x in held]],
                "bits": [bits], "checkpoints": [checkpoints.astype("<i8").tobytes()],
            })

        for batch in batches:
            for i, x in zip(batch["id"].astype(object).where(batch["id"].notna(), None), batch["ids"]):
                if held and size + len(x) // width > BLOCK:
                    yield row()
                    block, start, held, size = block + 1, start + size, [], 0
                held.append((i, x))
                size += len(x) // width
        if held:
            yield row()

    (rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "ids")
     .mapInPandas(blocks, _block_schema(rows.schema["id"].dataType)).write.parquet(f"{path}/blocks"))


def read(spark: SparkSession, path: str, id_col: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """Decode all documents under ``path``: id, ``start`` (ids of all documents before it) and ``ids``."""
    spark = session(spark)
    files = spark.read.parquet(f"{path}/blocks")
    lengths = spark.sparkContext.broadcast(
        {row["id"]: row["length"] for row in spark.read.parquet(f"{path}/lengths").collect()}
    )
    before, offsets = 0, {}
    for row in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row a file
        offsets[row["part"]] = before
        before += row["n"]

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = worker_state(("codes", path), lambda: Codec(lengths.value, limit))
        for batch in batches:
            for b in batch.itertuples(index=False):
                ids = codec.unpack(b.bits, np.frombuffer(b.checkpoints, "<i8"), b.n_ids) if b.n_ids else np.zeros(0, "<u4")
                ends = np.cumsum(np.asarray(b.doc_ids, np.int64))
                starts = ends - np.asarray(b.doc_ids, np.int64)
                yield pd.DataFrame({
                    id_col: list(b.docs), "start": offsets[b.part] + b.start + starts,
                    "ids": [ids[s:e].astype("<u4").tobytes() for s, e in zip(starts, ends)],
                })

    kind = files.schema["docs"].dataType.elementType.simpleString()
    return files.mapInPandas(documents, f"`{id_col}` {kind}, start long, ids binary")


def encode_and_write(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text",
                     tokenizer_file: str = TOKENIZER_FILE, end_id: int | None = END_ID) -> None:
    """Tokenize once, keep the ids in the shared folder, as narrow as the vocabulary allows, count, and write."""
    size = Tokenizer.from_file(tokenizer_file).get_vocab_size()
    width = 2 if max(size, end_id or 0) <= 1 << 16 else 4
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    ids = tokenize(texts, "text", "ids", tokenizer_file, end_id, width).drop("text")
    write(stored(ids, "ids"), path, "id", "ids", width=width)
