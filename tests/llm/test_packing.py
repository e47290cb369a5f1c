import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarryline.llm import harmonic

RANKS, FILE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "\n\n a", "été 𝒳 x", "it's  we'll", "<|endoftext|> x", "a b  c", "\x1f x", "x" * 3000, " 12 345\t6", "tab\t word", "a\r\n b"]


def texts():
    rng = random.Random(6)
    parts = ["the", "river", "runs", "été", "naïve", "1234", "...", "(x)", "don't", "\n", "\n\n", "  ", "\t"]
    return ODD + [" ".join(rng.choices(parts, k=rng.randrange(1, 900))) for _ in range(60)] + [None]


def ids_of(text):
    return Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids + [0]


def test_tokens_equal_the_tokenizer():
    tokens = harmonic.Tokens(RANKS, FILE)
    plain = [t for t in texts() if t is not None]
    for raw, t in zip(tokens.batch(plain) + tokens.batch(plain[::-1])[::-1], plain * 2):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(t)[:-1], t


@pytest.mark.parametrize("length", [1, 31, 32, 33, 511, 512, 1023, 1024, 1025, 5000])
def test_pieces_cover_a_document(length):
    at = 0
    for start, size, kind in harmonic.pieces_of(length):
        assert start == at and 1024 // (kind + 1) < size <= 1024 // kind
        at += size
    assert at == length


def test_packing_is_exact_and_tight(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "twice"), (3, "twice")]
    packed = harmonic.pack(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, FILE, with_ids=True)
    pieces = packed.toPandas()
    by_row = {k: g.sort_values("start") for k, g in pieces.groupby(["task", "row"])}
    got = sorted((int(g["doc_id"].iloc[0]), [x for ids in g["ids"] for x in ids]) for g in by_row.values())
    assert got == sorted((i, ids_of(t)) for i, t in rows)
    for g in by_row.values():
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert (g["doc_tokens"] == at).all()
    padding = 0
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
        used = int(g["length"].sum())
        assert used <= 1024
        padding += 0 if used & (used - 1) == 0 else 1024 - used
    assert padding <= 40 * 1024
    whole = harmonic.sequences(packed).collect()
    assert all(len(r["ids"]) == 1024 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in whole)


def test_null_ids_and_empty_table(spark):
    assert harmonic.pack(spark.createDataFrame([], "doc_id long, text string"), RANKS, FILE).count() == 0
    out = harmonic.pack(spark.createDataFrame([(None, None, "x")], "doc_id string, text string, length string"), RANKS, FILE).collect()
    assert [(r["doc_id"], r["length"], r["doc_tokens"]) for r in out] == [(None, 1, 1)]
