"""Tokenizer alignment against a plain version, byte by byte."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetcast.llm import alignment
from fleetcast.llm.code_index import CodeIndex
from fleetcast.llm.pieces import cut_points
from fleetcast.llm.words import text_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick  brown\tfox — it's naïve…\n\n12345 and <|endoftext|> end ",
    None,
    "",
    " ",
    "   three blanks, ß and 日本 語  x é́ y",
    "<s> <0x41> </s> <unk>",
    "a ▁ piece mark",
    "ends with blanks   ",
    "words of words of words of words",
    "words of words of words of words",
    "x" * 5000,
    "no-blank-" * 3000,
    "été à la  plage \r\n\r\n 🙂🙂 \x00 nul",
]


def brute(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of all rows, in their order."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = alignment.byte_level_alphabet()
    entry = {i: bytes(chars[c] for c in t) for t, i in a.get_vocab().items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for i, text in rows:
        one, links, groups = ([], []), [], []
        if text:
            whole = b" " + text.encode()
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            spelled = [entry[x] for x in ids[0]], [piece(x) for x in ids[1]]
            if b"".join(spelled[0]) == whole == b"".join(spelled[1]):
                one = ids
                ends = [np.cumsum([len(s) for s in side]).tolist() for side in spelled]
                starts = [[0, *e[:-1]] for e in ends]
                k = 0
                for x, s, e in zip(ids[0], starts[0], ends[0], strict=True):
                    while ends[1][k] <= s:
                        k += 1
                    j = k
                    while j < len(ids[1]) and starts[1][j] < e:
                        links.append((x, ids[1][j]))
                        j += 1
                last = [0, 0]
                place = [{e: k + 1 for k, e in enumerate(side)} for side in ends]
                for e in sorted(set(ends[0]) & set(ends[1])):
                    upto = [side[e] for side in place]
                    groups.append("|".join(",".join(map(str, ids[q][last[q] : upto[q]])) for q in (0, 1)))
                    last = upto
        counts.update(links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((i, len(one[0]), len(one[1]), len(groups), links, sha))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (i, x, y, g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha) for i, x, y, g, links, sha in found
    ]


def key(row):
    return tuple((v is not None, v) for v in row)


def aligned(df, **size):
    return sorted(map(tuple, alignment.align_tokenizers(df, A, B, **size).collect()), key=key)


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 64])
def test_small_texts(spark, block):
    rows = [(None if k == 4 else k // 2, t) for k, t in enumerate(TEXTS)] * 2
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "doc_id long, text string, n_a int, block int, kind string, a int")
    assert aligned(df, block_bytes=block) == sorted(brute(rows), key=key)


def test_whole_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert aligned(df.repartition(5), block_bytes=200_000) == sorted(brute(rows), key=key)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert aligned(df) == []
    assert aligned(spark.createDataFrame([("x", None)], "doc_id string, text string")) == [("x", 0, 0, 0, 0, 0, 0, "")]


def test_vocabularies_never_cross_a_space():
    """What lets a text be cut there: no entry holds a space between two visible characters."""
    for spelled in (alignment.spelled_a(A)[1], alignment.spelled_b(B)[1]):
        assert len(spelled) > 30_000
        assert not [s for s in spelled if len(cut_points(np.frombuffer(b"  " + s, np.uint8)))]


def test_worker_forgets():
    words = alignment.Aligner(A, B)
    first = words.parts(*text_bytes(pa.array(["one two", "two three"])))[0]
    assert first[1] == first[2] and words.valid.n == 3
    words.forget()
    assert words.parts(*text_bytes(pa.array(["four"])))[0].tolist() == [0]


def test_code_index():
    rnd = np.random.default_rng(3)
    codes = np.unique(rnd.integers(0, 1 << 63, 50_000).astype(np.uint64) * np.uint64(2))
    index = CodeIndex(4)
    for part in np.array_split(rnd.permutation(codes), 7):
        assert (index.find(part) == -1).all()
        slots = index.add(part)
        assert (index.find(part) == slots).all()
    assert sorted(index.find(codes)) == list(range(len(codes)))
    assert (index.find(codes + np.uint64(1)) == -1).sum() >= len(codes) - 1
