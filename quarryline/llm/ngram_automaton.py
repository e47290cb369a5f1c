"""Language-model scores from a weighted backoff automaton.

Counts of all n-grams of the training texts, up to ``order`` words, make a
hierarchically smoothed model: with c the count of a history h,

    P(w | h) = (c(h w) + PRIOR * P(w | h without its first word)) / (c(h) + PRIOR),

down to the add-one distribution over single tokens.  As an automaton, a seen
history is a state.  A seen n-gram is an arc from its history, weighing
log10 P(w | h), to the longest seen history that then holds.  Any other token
takes the state's failure arc to the shorter history, which weighs
log10(PRIOR / (c(h) + PRIOR)); at the root every token has an arc, an unseen
one too.  A text is scored in one pass from left to right: the state is
carried, the weights of arcs and failure arcs add up.

The automaton of a large corpus is larger than any task, so no task gets it
whole.  Texts are cut into slices of about ``SLICE_TOKENS`` tokens, numbered
within the slice and stored.  A slice sends its distinct n-grams, with their
counts in its training texts, to the parts that own them by hash; a part adds
up what all slices sent and answers each with the totals of its own n-grams.
From these the slice has all states and arcs that its texts can reach, and
traverses them.  A frequent n-gram is one number from each slice, so no key
is hot.  Counts cover all training texts; none is pruned.

Words are told apart by 64-bit hashes; of longer n-grams' hashes a part gets
48 bits, besides those that led to the part.  A billion distinct ones are
expected to have about two pairs that share a hash, which adds their counts.

Edge cases: a null or empty text is its end alone.  A null ``trained`` counts
as false.  Repeated rows are texts of their own.  A longer text than a slice
is a slice of its own, whole.  An empty table has no scores; without any
training text every token has the probability 1.  Kept columns travel in one
struct, so no name of theirs can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import DOUBLE, LONG, column, nullable, record, written
from quarryline.llm.shingles import BYTES, FACTOR, word_hashes

ORDER = 2
#: Weight of the shorter history's distribution, in tokens.
PRIOR = 200.0
#: Tokens of a slice; a task holds about a slice with its states and arcs.
SLICE_TOKENS = 1 << 20
#: Tokens of the corpus for each part that adds up n-grams.
PART_TOKENS = 1 << 20
#: The token that ends a text.
END = np.uint64(0x5851F42D4C957F2D)

INTEGER, BINARY = T.IntegerType(), T.BinaryType()
ASK = record(part=LONG, slice=LONG, size=INTEGER, keys=BINARY, width=INTEGER, counts=BINARY)
PACKED = ("sizes", "trained", "words", "low", "high")
REPLY = record(slice=LONG, size=INTEGER, part=LONG, width=INTEGER, totals=BINARY, sent=LONG, distinct=LONG)
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def narrow(values: np.ndarray) -> np.ndarray:
    """In the fewest bytes; most counts need one."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def key_bytes(keys: np.ndarray, size: int) -> bytes:
    """Whole keys of words, and the lower 48 bits of longer n-grams' keys."""
    return keys.tobytes() if size == 1 else np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def keys_of(raw: bytes, size: int) -> np.ndarray:
    if size == 1:
        return np.frombuffer(raw, np.uint64)
    whole = np.zeros((len(raw) // 6, 8), np.uint8)
    whole[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return whole.view(np.uint64).ravel()


def mixed(keys: np.ndarray) -> np.ndarray:
    keys = keys ^ (keys >> np.uint64(32))
    keys *= BYTES[0]
    return keys ^ (keys >> np.uint64(29))


def tokens(raw: bytes | None) -> np.ndarray:
    """Keys of a text's words, A-Z lower-cased, and of its end."""
    return np.append(mixed(word_hashes((raw or b"").lower())), END)


# --- slices ------------------------------------------------------------------------


def sliced(most: int) -> Callable:
    """From (own, trained, text): one row for each slice, with its distinct words and the texts' tokens as numbers among them."""

    def packed(name: int, held: list[tuple[np.ndarray, bool]], rows: list[pa.Array]) -> pa.RecordBatch:
        words, codes, times = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent words get small numbers, and the high halves pack well
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        codes = place[codes]
        binary = [np.array([len(t) for t, _ in held], np.int32), np.array([x for _, x in held], bool), words[order], (codes & 0xFFFF).astype(np.uint16), narrow(codes >> 16)]
        own = pa.concat_arrays(rows)
        columns = [pa.array([name], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *(pa.array([x.tobytes()], pa.binary()) for x in binary)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(codes)], pa.int64())], ["slice", "own", *PACKED, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, held, rows, size = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            own, start = batch.column("own"), 0
            for i, (trained, raw) in enumerate(zip(batch.column("trained").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                held.append((tokens(raw), trained))
                size += len(held[-1][0])
                if size >= most:
                    yield packed(name, held, [*rows, own.slice(start, i + 1 - start)])
                    name, held, rows, size, start = name + 1, [], [], 0, i + 1
            rows.append(own.slice(start))
        if held:
            yield packed(name, held, rows)

    return run


class Slice:
    """A slice's tokens, and its distinct n-grams of each size."""

    def __init__(self, sizes: bytes, trained: bytes, words: bytes, low: bytes, high: bytes):
        self.sizes = np.frombuffer(sizes, np.int32).astype(np.int64)
        words = np.frombuffer(words, np.uint64)
        order = np.argsort(words)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        low, high = np.frombuffer(low, np.uint16), np.frombuffer(high, f"u{2 * len(high) // len(low)}")
        self.words, self.codes = words[order], place[low.astype(np.int64) | high.astype(np.int64) << 16]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.codes)) - np.repeat(self.starts, self.sizes)
        self.trained = np.repeat(np.frombuffer(trained, bool), self.sizes)

    def levels(self, order: int) -> Iterator[Level]:
        """Of each size from 1: the sorted keys, the number among them that ends at each token (-1: none), and a token at which each ends."""
        first = np.full(len(self.words), -1, np.int64)
        first[self.codes[::-1]] = np.arange(len(self.codes))[::-1]
        yield self.words, self.codes.astype(np.int64), first
        keys = self.words[self.codes]
        single = keys
        for n in range(2, order + 1):
            ends = np.flatnonzero(self.place >= n - 1)
            longer = np.zeros_like(keys)
            longer[ends] = mixed(keys[ends - 1] * FACTOR + single[ends])
            keys = longer
            found, at, inverse = np.unique(keys[ends], return_index=True, return_inverse=True)
            number = np.full(len(keys), -1, np.int64)
            number[ends] = inverse
            yield found, number, ends[at]

    def counts(self, level: Level) -> np.ndarray:
        """How often each n-gram is in the slice's training texts."""
        number = level[1][self.trained]
        return np.bincount(number[number >= 0], minlength=len(level[0]))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Falls into ``parts`` ranges of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def asks(order: int, parts: int) -> Callable:
    """From slices: their distinct n-grams and counts, for the parts that own them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, *packed = (batch.column(c)[row].as_py() for c in ("slice", *PACKED))
                own = Slice(*packed)
                for size, level in enumerate(own.levels(order), 1):
                    keys, counts = level[0], narrow(own.counts(level))
                    if not len(keys):
                        continue
                    each = part_of(keys, parts)
                    starts = np.flatnonzero(np.concatenate(([True], each[1:] != each[:-1])))
                    spans = list(zip(starts, [*starts[1:], len(keys)], strict=True))
                    columns = [pa.array(each[starts]), pa.array([number] * len(spans), pa.int64()), pa.array([size] * len(spans), pa.int32())]
                    columns += [pa.array([key_bytes(keys[a:b], size) for a, b in spans], pa.binary()), pa.array([counts.itemsize] * len(spans), pa.int32()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ASK.names)

    return run


def totals(table: pa.Table) -> pa.Table:
    """A part's answers to all slices: the counts of their n-grams over all of them."""
    out = []
    for size in sorted(set(table.column("size").to_pylist())):
        rows = table.filter(pa.compute.equal(table.column("size"), size))
        keys = [keys_of(x, size) for x in rows.column("keys").to_pylist()]
        counts = [np.frombuffer(x, f"u{w}") for x, w in zip(rows.column("counts").to_pylist(), rows.column("width").to_pylist(), strict=True)]
        found, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, np.concatenate(counts), len(found)).astype(np.int64)  # exact below 2^53
        answers = np.split(total[number], np.cumsum([len(x) for x in keys])[:-1])
        for i, (name, part, sent, answer) in enumerate(zip(rows.column("slice").to_pylist(), rows.column("part").to_pylist(), counts, answers, strict=True)):
            answer = narrow(answer)
            out.append((name, size, part, answer.itemsize, answer.tobytes(), int(sent.sum(dtype=np.int64)), 0 if i else int((total > 0).sum())))
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], REPLY.names)


# --- automaton ---------------------------------------------------------------------


class Automaton:
    """The states and arcs on the paths of a slice's texts.

    A state is a seen history, and 0 words are the root.  Where a text stands,
    its state is told by the history's length; ``arc[k]`` tells of each n-gram
    of k + 1 words whether the history of k words has it as an arc, and
    ``weight[k]`` the arc's weight; ``fail[k]`` is the weight of a history's
    failure arc.
    """

    def __init__(self, levels: list[Level], counts: list[np.ndarray], all_tokens: int, vocabulary: int, prior: float):
        self.number = [level[1] for level in levels]
        lower = (counts[0] + 1) / (all_tokens + vocabulary + 1)
        self.arc, self.weight, self.known = [np.ones(len(lower), bool)], [np.log10(lower)], counts[0] > 0
        self.fail = [np.zeros(1)] + [np.log10(prior / (c + prior)) for c in counts[:-1]]
        for (_, _, at), count, before, over in zip(levels[1:], counts[1:], self.number[:-1], counts[:-1], strict=True):
            lower = (count + prior * lower[before[at]]) / (over[before[at - 1]] + prior)
            self.arc.append(count > 0)
            self.weight.append(np.log10(lower))

    def traverse(self, begin: int, end: int) -> float:
        """log10 of the probability of the tokens from ``begin`` to ``end``, a whole text."""
        most = len(self.arc) - 1
        ends = [number[begin:end] for number in self.number]
        known = self.known[ends[0]].tolist()
        arc, weight = ([x[e].tolist() if len(x) else [False] * len(e) for x, e in zip(xs, ends, strict=True)] for xs in (self.arc, self.weight))
        fail = [[]] + [x[e].tolist() for x, e in zip(self.fail[1:], ends, strict=False)]
        state, score = 0, 0.0
        for i, seen in enumerate(known):
            while not arc[state][i]:
                score += fail[state][i - 1]
                state -= 1
            score += weight[state][i]
            state = min(state + 1, most) if seen else 0
        return score


SCORES = record(n_tokens=LONG, n_known=LONG, base_score=DOUBLE, score=DOUBLE)


def scores(order: int, prior: float, all_tokens: int, vocabulary: int) -> Callable:
    """From a slice and the answers to it: its rows with their scores."""

    def run(slices: pa.Table, replies: pa.Table) -> pa.Table:
        own = Slice(*(slices.column(c)[0].as_py() for c in PACKED))
        levels, counts = list(own.levels(order)), []
        replies = replies.sort_by([("size", "ascending"), ("part", "ascending")])
        for n in range(1, order + 1):
            rows = replies.filter(pa.compute.equal(replies.column("size"), n))
            parts = [np.frombuffer(x, f"u{w}").astype(np.int64) for x, w in zip(rows.column("totals").to_pylist(), rows.column("width").to_pylist(), strict=True)]
            counts.append(np.concatenate([np.zeros(0, np.int64), *parts]))
        model = Automaton(levels, counts, all_tokens, vocabulary, prior)
        known = np.add.reduceat(model.known[own.codes].astype(np.int64), own.starts)
        base = np.add.reduceat(model.weight[0][own.codes], own.starts)
        found = [model.traverse(a, a + n) for a, n in zip(own.starts, own.sizes, strict=True)]
        values = pa.StructArray.from_arrays([pa.array(own.sizes), pa.array(known), pa.array(base), pa.array(found, pa.float64())], SCORES.names)
        return pa.table([slices.column("own").combine_chunks().flatten(), values], ["own", "scores"])

    return run


def score(docs: DataFrame, trained: Column, keep: list[str], text: str = "text", order: int = ORDER, prior: float = PRIOR, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """``own`` (the columns of ``keep``), ``scores`` (n_tokens, n_known, base_score, score) and ``train_tokens`` of every row.

    The model is learned from the rows where ``trained`` holds.
    """
    own = F.struct(*(column(c).alias(c) for c in keep)).alias("own")
    rows = docs.select(own, F.coalesce(trained, F.lit(False)).alias("trained"), column(text).cast("binary").alias("text"))
    kept = nullable(rows.schema["own"].dataType)
    kinds = T.StructType([*record(slice=LONG, own=T.ArrayType(kept), **dict.fromkeys(PACKED, BINARY), n=LONG)])
    slices = written(rows.mapInArrow(sliced(slice_tokens), kinds), "slices", "zstd")
    size = slices.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_TOKENS))
    asked = slices.select("slice", *PACKED).mapInArrow(asks(order, parts), ASK)
    replies = written(asked.groupBy("part").applyInArrow(totals, REPLY), "totals", "zstd")
    all_tokens, vocabulary = replies.where("size = 1").agg(F.coalesce(F.sum("sent"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    answers = replies.select("slice", "size", "part", "width", "totals").groupBy("slice")
    result = T.StructType([T.StructField("own", kept), T.StructField("scores", SCORES)])
    found = slices.groupBy("slice").cogroup(answers).applyInArrow(scores(order, prior, all_tokens, vocabulary), result)
    return found.select("own", "scores", F.lit(all_tokens).cast("long").alias("train_tokens"))
