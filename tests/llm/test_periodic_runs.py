"""Runs of words against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcast.llm import periodic_runs, queries
from fleetcast.llm.words import mix


def plain_runs(words, least=12):
    """(start, length, period) of all runs."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                if not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                    out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def found(word_lists):
    """Runs of several texts through the whole-array code."""
    at = np.concatenate([[0], np.cumsum([len(w) for w in word_lists])]).astype(np.int64)
    code = mix(np.array([w + 1 for ws in word_lists for w in ws], np.uint64))
    out = [[] for _ in word_lists]
    for t, s, m, q in zip(*(x.tolist() for x in periodic_runs.runs_of(code, at)), strict=True):
        out[t].append((s, m, q))
    return out


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_equal_the_plain_search():
    rnd = random.Random(11)
    texts = [
        [],
        [1],
        [7] * 11,
        [7] * 12,
        [1] + [7] * 40 + [2],
        [1, 2] * 6,
        [1, 2] * 5 + [1],
        [1, 2, 3, 4, 5, 6] * 2,
        list(range(30)) * 2 + [3],
        fibonacci(300),
        [bin(i).count("1") % 2 for i in range(256)],  # Thue-Morse: no overlap
        [1] * 20 + [2] + [1] * 20 + [3] + [1] * 20 + [2] + [1] * 20,
        [5] * 30 + [6] * 30,
    ]
    for _ in range(300):
        kind = rnd.choice([1, 2, 3, 9])
        ws = [rnd.randrange(kind + 1) for _ in range(rnd.randrange(0, 70))]
        for _ in range(rnd.randrange(3)):
            a, p = rnd.randrange(len(ws) + 1), rnd.randrange(1, 12)
            ws = ws[:a] + (ws[a : a + p] or [1]) * rnd.randrange(1, 9) + ws[a + p :]
        texts.append(ws)
    got = found(texts)
    for ws, runs in zip(texts, got, strict=True):
        assert runs == plain_runs(ws), ws
    assert sum(map(len, got)) > 300


def test_long_repeats():
    """Many occurrences of one stretch, one word throughout, a long period."""
    rnd = random.Random(5)
    line = [rnd.randrange(1000) for _ in range(15)]
    apart = [w for k in range(400) for w in [*line, 10_000 + k, 20_000 + k]]
    runs = found([[3] * 30_000, line * 900, apart, list(range(9000)) * 2])
    assert runs == [[(0, 30_000, 1)], [(0, 13_500, 15)], [], [(0, 18_000, 9000)]]


def test_clusters_leave_few_leaves():
    """Only the suffixes a whole number of periods into a run stay."""
    code = mix(np.array(list(range(100, 200)) + list(range(50)) * 20 + [999], np.uint64))
    assert len(periodic_runs.clustered(code, np.array([0, len(code)]))) <= 20


def test_pairs_of_an_interval_by_either_way():
    """Lists of left words and the common list give the same pairs."""
    pos, left = [3, 30, 9, 14, 20], [1, 2, 1, 3, 4]
    want = set()
    for i, x in enumerate(pos):
        for y, c in zip(pos[:i], left[:i], strict=True):
            if left[i] != c and abs(x - y) <= 12 and abs(x - y) + 12 >= 12:
                want.add((min(x, y), abs(x - y), 12))
    assert set(periodic_runs.maximal_pairs(pos, left, [0, 12, 12, 12, 12])) == want


TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "la " * 40,
    "x y z " * 9 + "end",
    "Ab ab " * 10,
    "été " * 12 + "\x0b日本 語 " * 14,
    "a b c d e f g h i j k l m n",
    "tail only " + "r s t u " * 7,
]


def test_query_on_odd_rows(spark):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:7]
    rows = [(i, t) for k, t in enumerate(TEXTS) for i in (k, ids[k % 7], None)] * 2
    df = spark.createDataFrame([(*r, 4, "s", 1) for r in rows], "doc_id long, text string, n_runs int, seed string, start int")
    got = periodic_runs.periodic_runs(df, seed=F.crc32(F.col("doc_id").cast("string")))
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_row(*r) for r in rows), key=key)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_texts_and_spans(spark):
    df = spark.createDataFrame([("k", "so " + "very much " * 8 + "done"), ("n", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(df, texts=True).collect()}
    assert [tuple(r) for r in got["k"].runs] == [(1, 16, 2)] and got["k"].collapsed == "so very much done"
    assert got["n"].runs == [] and got["n"].collapsed == ""


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_the_corpus(spark, sf):
    root = f"/root/testdata/{sf}"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, root).collect()))
    short = {i for i, t in rows.items() if len((t or "").split()) < 700}
    assert len(got) == len(rows) and len(short) > 150
    assert [r for r in got if r[0] in short] == sorted(plain_row(i, rows[i]) for i in short)
    assert sum(r[1] > 0 for r in got) > 10
