"""Harmonic packing of tokenised documents into fixed-length sequences.

A document is its tokens and one end token.  It is cut into whole sequences,
then pieces of half, a quarter, ... of the capacity down to ``GRAIN`` tokens,
then one last piece below that.  A piece longer than capacity/(k+1) and at
most capacity/k is of class k, and every bin of class k takes exactly k
pieces.  Halved pieces fill their bins without a gap; the last pieces, of few
tokens, leave less than one such piece free.

Tokenising tasks number their pieces within each class; small prefix sums of
the tasks' counts turn these into numbers for the whole class, so bins are
filled independently in every task and each class has one unfinished bin at
most.  An unfinished bin of a halved class is cut into runs of 2^j pieces,
whose lengths are powers of two and need no padding.  The unfinished bins of
the other classes, fewer than ``CAPACITY`` * ``GRAIN`` pieces whatever the
data, are laid into shared sequences by next fit.

Edge cases: a null or empty text is the end token alone; rows that repeat an
id are packed on their own, told apart by ``row``; an empty table gives no
piece.  Extra columns are not carried over.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarryline.llm.common import cut_lineage

CAPACITY = 1024
GRAIN = 32
END_ID = 0
#: Words whose tokens a worker keeps.
KEPT_WORDS = 100_000
#: Ids of sequences: the class in the upper bits, the bin below.
BIN_BITS = 40
LEFTOVER_CLASS = 2 * CAPACITY
NAMES = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "n"]
#: Then last pieces of one class all have the same length.
assert GRAIN * GRAIN <= CAPACITY


class Tokens:
    """Token ids of whole texts, as bytes of little-endian unsigned 32-bit numbers.

    The vocabulary splits a text before its merges work, and a single space
    always begins a new part.  So words that end at single spaces are encoded
    once and their ids are kept; a batch's unknown words are encoded together.
    A text with a space before other white space, or at an end, is encoded
    whole, and one with a special token by the tokenizer file itself.
    """

    ODD = re.compile(r" \s|^ | $")

    def __init__(self, ranks: str, tokenizer: str, special: str = "<|endoftext|>"):
        import public_tokenizers
        import tiktoken

        with open(ranks) as f:
            table = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            self.size[i] = len(token)
        self.tokenizer, self.special, self.kept = tokenizer, special, {}

    @cached_property
    def file(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer)

    def exact(self, text: str) -> bytes:
        return np.array(self.file.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def add(self, words: list[str]) -> None:
        """Encode words, each with the space before it, in one go."""
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            ids = np.array(self.bpe.encode_ordinary(" " + " ".join(part)), "<u4")
            ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in part), np.int64, len(part)))
            cuts = [0, *np.searchsorted(np.cumsum(self.size[ids]), ends, side="left") + 1]
            raw = ids.tobytes()
            for w, x, y in zip(part, cuts, cuts[1:], strict=False):
                self.kept[w] = raw[4 * x : 4 * y]

    def batch(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for t in texts:
            split.append(None if self.special in t or self.ODD.search(t) else t.split(" "))
        fresh = list({w for words in split if words for w in words[1:] if w not in self.kept})
        self.add(fresh)
        out = []
        for t, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self.exact(t) if self.special in t else self.whole(t))
            else:
                out.append(self.whole(words[0]) + b"".join(map(self.kept.__getitem__, words[1:])))
        for w in fresh[max(0, len(fresh) - max(0, len(self.kept) - KEPT_WORDS)) :]:
            del self.kept[w]
        return out


@lru_cache(1)
def tokens_of(ranks: str, tokenizer: str) -> Tokens:
    return Tokens(ranks, tokenizer)


def pieces_of(length: int) -> list[tuple[int, int, int]]:
    """(start, length, class) of a document's pieces."""
    out, at = [], 0
    while length - at >= CAPACITY:
        out.append((at, CAPACITY, 1))
        at += CAPACITY
    part = CAPACITY // 2
    while part >= GRAIN:
        if length - at >= part:
            out.append((at, part, CAPACITY // part))
            at += part
        part //= 2
    if at < length:
        out.append((at, length - at, CAPACITY // (length - at)))
    return out


def cutter(ranks: str, tokenizer: str, id_type: pa.DataType, with_ids: bool):
    """A task's pieces, numbered within their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, counts, row = TaskContext.get().partitionId(), {}, 0
        tokens, end = tokens_of(ranks, tokenizer), np.array([END_ID], "<u4").tobytes()
        for rows in batches:
            for a in range(0, rows.num_rows, 256):
                part = rows.slice(a, 256)
                place, out, ids = [], [], []
                for i, raw in enumerate(tokens.batch([t or "" for t in part.column("text").to_pylist()])):
                    raw, row = raw + end, row + 1
                    for start, length, kind in pieces_of(len(raw) // 4):
                        n = counts[kind] = counts.get(kind, -1) + 1
                        own = raw[4 * start : 4 * (start + length)]
                        place.append(i)
                        out.append((row, start, length, zlib.crc32(own), len(raw) // 4, kind, task, n))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()], strict=True)]
                arrays = [part.column("doc_id").cast(id_type).take(pa.array(place, pa.int32())), *columns]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, NAMES + ["ids"] * with_ids)

    return run


def next_fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Bins and offsets of the few pieces left, long ones first."""
    rows = rows.sort_values(["length", "task", "n"], ascending=[False, True, True], kind="stable")
    bins, used, at = [], 0, 0
    for length in rows["length"]:
        if used + length > CAPACITY:
            at, used = at + 1, 0
        bins.append((at, used))
        used += length
    return rows.assign(bin=[b for b, _ in bins], offset=[u for _, u in bins])[["class", "task", "n", "bin", "offset"]]


def pack(docs: DataFrame, ranks: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Rows doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, task, row, and ids on demand."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind)])
    for name in NAMES[1:]:
        schema.add(name, T.IntegerType() if name in ("class", "task") else T.LongType())
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pieces = cut_lineage(rows.mapInArrow(cutter(ranks, tokenizer, to_arrow_type(kind), with_ids), schema))
    counts = pieces.groupBy("class", "task").agg(F.count("*").alias("count"))
    earlier = F.coalesce(F.sum("count").over(W.partitionBy("class").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    in_class = F.sum("count").over(W.partitionBy("class"))
    counts = counts.select("class", "task", earlier.alias("before"), in_class.alias("in_class"))
    # A row for each task and class, of at most 37 classes.
    rows = pieces.join(counts, ["class", "task"]).withColumn("index", F.col("before") + F.col("n"))
    rows = rows.withColumns({"bins": F.floor(F.col("in_class") / F.col("class")), "bin": F.floor(F.col("index") / F.col("class")), "slot": F.col("index") % F.col("class")})
    power_of_two = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    done = rows.where((F.col("bin") < F.col("bins")) | power_of_two)
    # In the last bin of m pieces, slot s lies in the run of 2^p pieces for the highest bit p in which s and m differ.
    m = F.col("in_class") % F.col("class")
    p = F.length(F.bin(F.col("slot").bitwiseXOR(m))) - 1
    run_start = F.call_function("shiftleft", F.call_function("shiftright", F.col("slot"), p + 1), p + 1)
    last = F.col("bin") >= F.col("bins")
    base = F.shiftleft(F.col("class").cast("long"), BIN_BITS)
    done = done.withColumn("sequence_id", base + F.when(last, F.col("bins") + p).otherwise(F.col("bin")))
    done = done.withColumn("offset", F.when(last, F.col("slot") - run_start).otherwise(F.col("slot")) * F.col("length"))
    left = rows.where((F.col("bin") >= F.col("bins")) & ~power_of_two)
    # Fewer than CAPACITY tokens of each class under GRAIN tokens a piece, whatever the input.
    placed = left.select("class", "task", "n", "length", F.lit(0).alias("all")).groupBy("all").applyInPandas(next_fit, "class int, task int, n long, bin long, offset long")
    left = left.drop("bin").join(F.broadcast(placed), ["class", "task", "n"])
    left = left.withColumn("sequence_id", F.lit(LEFTOVER_CLASS << BIN_BITS) + F.col("bin"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "row"] + ["ids"] * with_ids
    return done.select(*names).unionByName(left.select(*names))


def sequences(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) from pieces with ids, padded to CAPACITY unless the length is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = joined.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids")).withColumn("n_tokens", F.size("ids"))
    exact = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(CAPACITY) - F.col("n_tokens")))
    return joined.select("sequence_id", "n_tokens", F.when(exact, F.col("ids")).otherwise(padded).alias("ids"))
