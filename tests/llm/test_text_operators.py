"""Token files, edit-aware counts, decontamination, secrets and packing against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetcast.llm import decontaminate, edit_counts, packing, pieces, secrets, token_files
from fleetcast.llm.frames import new_folder
from tests.llm import brute

DOCS = "doc_id long, text string, TEXT_ string, n_tokens int, secrets string, state string, _n int, chunk int"
PLAIN = [
    (5, "The quick  brown\tfox — it's naïve…\n\n12345 and <|endoftext|> end "),
    (3, None),
    (9, ""),
    (3, "again the same id"),
    (3, "again the same id"),
    (None, "no id  here  é à ü x"),
    (7, "été   deux  mots 日本 語  x é́ y"),
    (8, " leading and trailing "),
    (12, "<|endoftext|>at the start, twice<|endoftext|><|endoftext|> and alone <|endoftext|> at the end<|endoftext|>"),
    (2, "word " * 9000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "s", "t", 1, 1) for i, t in PLAIN]
    return spark.createDataFrame(rows, DOCS)


def corpus(spark, sf="sf0.001", name="documents"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def token_index(spark, df, **size):
    path = new_folder(spark, "t")
    token_files.write_token_files(df, path, brute.VOCABULARY, end_id=2, **size)
    return path, sorted(map(tuple, token_files.read_token_index(spark, path).collect()), key=lambda r: r[1])


def test_token_files_equal_the_library(spark, docs):
    order = sorted(PLAIN, key=lambda r: (r[0] is not None, r[0] or 0, spark.range(1).select(F.xxhash64(F.lit(r[1]).cast("string"))).first()[0]))
    path, got = token_index(spark, docs, sequence=16, file_tokens=64)
    assert got == brute.token_rows(order)
    files = [token_files.TokenFile.open(r.content) for r in spark.read.format("binaryFile").load(path).collect() if r.content]
    assert len(files) > 3
    for f in files:
        assert len(f.ids) % 16 == 0 and sum(f.mask.values.to_pylist()) == f.tokens == f.spans()[1].sum()
        assert list(f.sequence_at(0)) == list(f.ids[:16])


def test_token_files_of_the_corpus(spark):
    df = corpus(spark)
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    assert token_index(spark, df)[1] == brute.token_rows(rows)


def test_token_files_of_nothing(spark, docs):
    assert token_index(spark, docs.limit(0))[1] == []


def test_edits_count_as_the_whole_text(spark):
    rnd = random.Random(4)
    base = [t or "" for _, t in PLAIN] + [r.text for r in corpus(spark).limit(60).collect()]
    rows = []
    for i, text in enumerate(base):
        edits = []
        for _ in range(rnd.choice([0, 1, 2, 7])):
            a = rnd.randrange(len(text) + 1)
            edits.append((a, min(len(text), a + rnd.choice([0, 0, 1, 3, 40, 900])), rnd.choice(["", "x", " ", "<gone>", "é neu ", "\n\n", "日本"])))
        rows.append((i % 50 if i % 7 else None, text if i else None, edits + [(5, 4, "bad"), (10**6, 10**6 + 1, "far")]))
    kind = "doc_id long, text string, edits array<struct<start:bigint,end:bigint,text:string>>"
    df = spark.createDataFrame(rows, kind)
    states = edit_counts.state_table(df, brute.VOCABULARY)
    got = sorted(
        (r.doc_id is not None, r.doc_id or 0, r.n_tokens_before, r.n_tokens, r.n_edits)
        for r in edit_counts.recount_edited(df, states, brute.VOCABULARY).collect()
    )
    t, want = brute.tokenizer(), []
    for i, text, edits in rows:
        text = text or ""
        kept = edit_counts.clean_edits([dict(zip(("start", "end", "text"), e, strict=True)) for e in edits], len(text))
        size = lambda s: len(t.encode(s, add_special_tokens=False).ids)
        want.append((i is not None, i or 0, size(text), size(edit_counts.apply_edits(text, kept)), len(kept)))
    assert got == sorted(want)


def test_edits_encode_only_their_surroundings(spark):
    df = spark.createDataFrame([(1, "some words " * 20000, [(100_000, 100_004, "other")])], "doc_id long, text string, edits array<struct<start:bigint,end:bigint,text:string>>")
    row = edit_counts.recount_edited(df, edit_counts.state_table(df, brute.VOCABULARY), brute.VOCABULARY).first()
    assert row.bytes_encoded < 1000
    assert edit_counts.recount_edited(df.limit(0), edit_counts.state_table(df.limit(0), brute.VOCABULARY), brute.VOCABULARY).count() == 0


def test_sum_tree():
    import numpy as np

    tree = edit_counts.SumTree(np.array([3, 5, 2]), np.array([1, 2, 3]))
    assert [tree.find(k) for k in (0, 2, 3, 7, 8, 9, 10)] == [0, 0, 1, 1, 2, 2, 2]
    tree.put(1, 0, 0)
    assert (tree.total(), tree.start(2), tree.find(3)) == (4, 3, 2)


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "short ITEM here"),
    (2, "short ITEM here"),
    (10, "three four five six seven eight nine ten eleven twelve"),
    (4, None),
    (5, "..."),
    (None, "no id item"),
    (6, "é"),
]
TEXTS = [
    "x one two, THREE four five six seven eight nine ten eleven twelve y",
    "a short item. here short item here",
    "short item",
    None,
    "",
    "no id item é",
    "one two three four five six seven eight nine",
    "filler " * 30000 + "short item here",
]


@pytest.mark.parametrize("block", [1 << 18, 3])
def test_benchmark_windows(spark, block):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, contamination string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_contamination(df, items, block=block, result="_c")
    got = sorted(map(tuple, decontaminate.contamination_summary(found, result="_c").collect()))
    items = [x for x in ITEMS if x[0] is not None]
    assert got == sorted([(i, *brute.benchmark_hits(t, items)) for i, t in enumerate(TEXTS)] * 2)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(found, result="_c").collect()}
    assert cut[0] == "x  y" and cut[2] == "short item" and cut[3] is None and cut[1] == "a "
    kept = decontaminate.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 6}


def test_benchmark_of_the_corpus_and_of_nothing(spark):
    df, items = corpus(spark), corpus(spark, name="benchmark")
    pairs = [(r.item_id, r.text) for r in items.collect()]
    found = decontaminate.contamination_summary(decontaminate.find_contamination(df, items))
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == {r.doc_id: brute.benchmark_hits(r.text, pairs) for r in df.collect()}
    assert any(v[-1] for v in got.values())
    none = decontaminate.find_contamination(df, items.limit(0))
    assert none.filter(F.size("contamination.hits") > 0).count() == 0
    assert decontaminate.find_contamination(df.limit(0), items).count() == 0


KEY = "Zx9Kq2Lm7Rt4Vb8Wy3Pn"
SECRETS = [
    "password: hunter22 and Token='abc' API_KEY = \"a.b-c/d+e=f_\" apikey=123456",
    "paſſword=abcdef tokKen=abcdef passwd  :   'q1w2e3'",
    f"AKIA{'A1' * 8} AKIA123 AKIA{'Z' * 40}",
    f"{'0123456789abcdef' * 2} {'a' * 23} {'f' * 24}",
    f"é {KEY} and token={KEY}",
    "de305d54-75b4-431b-adb2-eb6b9e546014 2024-01-01-2024-01-02-2024 some-long-slug-with-words-2024",
    "z" * 100_000 + " " + "token " * 1000,
    None,
    "",
]


def test_secret_patterns_and_entropy(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(SECRETS)] * 2, "doc_id long, text string, secrets string")
    found = secrets.find_secrets(df, result="_s")
    rows = {r.doc_id: r for r in secrets.secrets_summary(found, result="_s").collect()}
    for i, t in enumerate(SECRETS):
        base = brute.base_secrets(t)
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        r = rows[i]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), i
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for *_, k in base) for x in secrets.BASE_KINDS]
    assert rows[4].n_entropy == 1 and f"entropy:2:{2 + len(KEY)}" in rows[4].spans
    assert rows[5].spans == "" and rows[6].spans == ""
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(df).collect()}
    assert masked[4] == "é <entropy> and <assign>" and masked[7] is None and masked[8] == ""
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_bare_base64_keys_of_128_bits():
    """Keys of 24 characters with + and / (or - and _) between letters and digits: found up to the last of 22 characters at least."""
    import base64

    rnd = random.Random(4)
    for code in (base64.b64encode, base64.urlsafe_b64encode):
        keys = []
        while len(keys) < 300:
            key = code(rnd.randbytes(16)).decode()
            if any(c in key[6:18] for c in "+/-_") and not any(p.fullmatch(key) for p in secrets.ALLOWED):
                keys.append(key)
        found = [secrets.secret_spans(f"the key {k} is here") for k in keys]
        assert sum(bool(f) for f in found) >= 0.99 * len(keys)
        assert all(f == [] or (f[0][2] == "entropy" and f[0][0] <= 12 and f[-1][1] >= 28) for f in found)
    for plain in ("src/main/resources/templates", "some-long-slug-with-words-2024", "2024-01-01/2024-01-02/2024", "aaaa/bbbb1aaaa/bbbb1aaaa"):
        assert secrets.secret_spans(plain) == []


def test_entropy_windows_by_definition():
    rnd = random.Random(1)
    for _ in range(50):
        s = "".join(rnd.choice("abcdefghAB12" if rnd.random() < 0.7 else "a") for _ in range(80))
        inside = set()
        for i in range(len(s) - 19):
            w = s[i : i + 20]
            if -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) >= 3.0 - 1e-9:
                inside |= set(range(i, i + 20))
        assert {k for a, b in secrets.entropy_spans(s, 20, 3.0) for k in range(a, b)} == inside


def test_secrets_of_the_corpus(spark):
    df = corpus(spark)
    got = {r.doc_id: r.base_sha256 for r in secrets.secrets_summary(secrets.find_secrets(df)).collect()}
    for r in df.collect():
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in brute.base_secrets(r.text))
        assert got[r.doc_id] == hashlib.sha256(text.encode()).hexdigest()


def least_padding(lengths, counts, buckets):
    from itertools import combinations

    best = None
    for k in range(1, min(buckets, len(lengths)) + 1):
        for cut in combinations(range(len(lengths) - 1), k - 1):
            limits = [lengths[i] for i in cut] + [lengths[-1]]
            cost = sum(c * min(x for x in limits if x >= n) for n, c in zip(lengths, counts, strict=True))
            best = cost if best is None else min(best, cost)
    return best


def test_limits_are_optimal():
    rnd = random.Random(3)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randint(1, 8)))
        counts = [rnd.randint(1, 9) for _ in lengths]
        for buckets in (1, 2, 3, 8):
            limits = packing.best_limits(lengths, counts, buckets)
            cost = sum(c * min(x for x in limits if x >= n) for n, c in zip(lengths, counts, strict=True))
            assert len(limits) <= buckets and cost == least_padding(lengths, counts, buckets)


def test_packing_keeps_every_token(spark, docs):
    rows = packing.pack(docs, packing.word_count(F.col("text")), tie=F.xxhash64("text"), context=64, step=4, buckets=3, budget=256).collect()
    want = sum(len(t.split()) + 1 for _, t in PLAIN if t and t.split())
    assert sum(r.n_tokens for r in rows) == pytest.approx(want, abs=3)  # NBSP and EM SPACE are no blanks here
    assert sum(r.n_tokens == 0 and r.bucket is None and r.batch is None for r in rows) == 2
    full = {}
    for r in rows:
        if r.bucket:
            assert 0 < r.n_tokens <= r.bucket <= 64
            full.setdefault((r.bucket, r.batch), []).append(r.slot)
    last = {b: max(k for c, k in full if c == b) for b, _ in full}
    for (bucket, batch), slots in full.items():
        per = 256 // bucket
        assert sorted(slots) == list(range(len(slots))) and len(slots) * bucket <= 256
        assert len(slots) == per or batch == last[bucket]
    assert packing.pack(docs.limit(0), packing.word_count(F.col("text"))).count() == 0


def test_token_buckets_count_tokens(spark, docs, monkeypatch):
    """Lengths are those of the library, also of a long text without blanks."""
    from fleetcast.llm import queries

    rnd = random.Random(2)
    bare = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9000))
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(50, bare), (51, "日本語" * 900)], "doc_id long, text string"))
    for df in (more, corpus(spark)):
        monkeypatch.setattr(queries, "table", lambda *a, df=df: df)
        want = {}
        t = brute.tokenizer()
        for r in df.collect():
            n = len(t.encode(r.text or "", add_special_tokens=False).ids)
            want[r.doc_id] = want.get(r.doc_id, 0) + n + (n > 0)
        rows = queries.QUERIES["op2_length_buckets"](spark, "").collect()
        got = {}
        for r in rows:
            got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
            assert r.n_tokens <= (r.bucket or 0) <= packing.CONTEXT
        assert got == want
    sizes = {}
    for r in rows:
        if r.bucket:
            sizes[r.bucket, r.batch] = sizes.get((r.bucket, r.batch), 0) + r.n_tokens
    assert max(sizes.values()) <= packing.BUDGET


def test_batches_equal_a_plain_packing(spark, chunks):
    """Chunks, limits of least padding, and numbered batches of whole real token counts."""
    rnd = random.Random(6)
    texts = [None, "", "<|endoftext|>", *(" ".join(rnd.choice(["tree", "x", "été", "12345"]) for _ in range(rnd.choice([1, 3, 9, 30, 31, 200]))) for _ in range(60))]
    df = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in enumerate(texts)], "doc_id long, text string, bucket int, _n int, chunk string")
    rows = packing.pack(df, packing.token_count(F.col("text"), brute.VOCABULARY), context=64, step=8, buckets=3, budget=300).collect()
    t, cut = brute.tokenizer(), []
    for k, text in enumerate(texts):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        n += n > 0
        cut += [(k, c, min(64, n - 64 * c)) for c in range(max(1, -(-n // 64)))]
    rounded = [-(-n // 8) * 8 for _, _, n in cut if n]
    limits = sorted({r.bucket for r in rows if r.bucket})
    lengths = sorted(set(rounded))
    counts = [rounded.count(x) for x in lengths]
    assert sum(min(b for b in limits if b >= x) for x in rounded) == least_padding(lengths, counts, 3) and len(limits) == 3
    placed, want = dict.fromkeys(limits, 0), []
    for k, c, n in cut:
        if not n:
            want.append((k, c, 0, None, None, None))
            continue
        b = min(x for x in limits if x >= n)
        want.append((k, c, n, b, placed[b] // (300 // b), placed[b] % (300 // b)))
        placed[b] += 1
    assert sorted(map(tuple, rows)) == want
    none = packing.pack(df.limit(0), packing.token_count(F.col("text"), brute.VOCABULARY))
    assert none.count() == 0 and none.columns == ["doc_id", "chunk", "n_tokens", "bucket", "batch", "slot"]


def test_row_without_text_column_types():
    assert token_files.TokenFile.open(token_files._file(__import__("numpy").array([5, 2], "uint16"), pa.table({"doc_id": [1], "n_tokens": [2]}), 0, 0, 4)).tokens == 2


def test_frequent_pieces_outlive_a_full_store(monkeypatch):
    """Ever new words fill the store again and again; the words that come back are encoded once all the same."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    words, plain = pieces.PieceEncoder(path, 64), pieces.PieceEncoder(path)
    asked = []
    monkeypatch.setattr(words, "direct", lambda texts: asked.extend(texts) or plain.direct(texts))
    common = [f" common{k}" for k in range(10)]
    for turn in range(40):
        text = "start" + "".join(common) + "".join(f" new{turn}x{k}" for k in range(30))
        ids, at = words.encode(pa.array([text, "", text]))
        want = plain.direct([text])[0]
        assert ids.tolist() == want + want and at.tolist() == [0, len(want), len(want), 2 * len(want)]
        assert words.index.size <= 64 + 41
    assert [asked.count(c) for c in common] == [1] * 10 and asked.count(" new39x3") == 1
