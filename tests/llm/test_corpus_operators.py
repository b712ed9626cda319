"""Joins, vectors, toxicity, urls, archives and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetcast.llm import ngram_join, pq_dedup, queries, toxicity, url_cascade, warc
from fleetcast.llm.components import components
from fleetcast.llm.frames import new_folder
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def corpus(spark, name, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def brute_components(rows):
    """(n_shingles, component) of (id, text) rows; rows of one id are linked."""
    sets = [brute.shingles(t) for _, t in rows]
    linked = []
    known = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    for x in known:
        for y in known:
            if x < y:
                both = len(sets[x] & sets[y])
                if rows[x][0] == rows[y][0] or 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    linked.append((x, y))
    root = brute.components(range(len(rows)), linked)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    return sorted(((i is not None, i or 0, len(s), least.get(root[k], None) if i is not None else None) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def varied(rnd, n, edits):
    words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    for _ in range(edits):
        words[rnd.randrange(n)] = f"x{rnd.randrange(10**6)}"
    return words


def near_rows():
    rnd = random.Random(5)
    rows = [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "ONE  two"), (105, "one two three"), (None, "one two"), (None, None)]
    for group in range(12):
        size = rnd.choice([5, 6, 9, 14, 30, 60, 200, 700])
        base = varied(rnd, size, 0)
        for k in range(rnd.choice([2, 3, 12, 25])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, max(1, size // 50), max(1, size // 20)])):
                act, at = rnd.randrange(3), rnd.randrange(len(words))
                words[at : at + (act > 0)] = ["neu"] if act != 2 or len(words) < 3 else []
            rows.append((200 + 50 * group + k, " ".join(words).title() if k % 2 else "  ".join(words)))
    shared = " ".join(varied(rnd, 40, 0))  # a passage that unlike documents share
    rows += [(1000 + k, " ".join(varied(rnd, 60, 0)) + " " + shared) for k in range(30)]
    rows += [rows[20], (rows[30][0], rows[60][1]), (rows[40][0], rows[40][1])]
    return rows


def test_join_links_all_and_only_near_copies(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 1, "c", "x") for i, t in rows], "doc_id long, text string, class int, component_id string, s string")
    got = [(r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()]
    assert sorted(got, key=str) == brute_components(rows)
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {r[1] for r in brute_components(rows) if r[0] and r[1] == r[3]}
    assert sorted(x for x in ids if x is not None) == sorted(want) and ids.count(None) == 2
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_join_on_the_corpus(spark):
    df = corpus(spark, "documents")
    got = [(True, r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()]
    assert sorted(got, key=str) == brute_components([(r.doc_id, r.text) for r in df.collect()])


def test_every_linked_pair_meets_in_a_bucket():
    """The pigeonhole: whatever the sizes, a spent segment of the larger set is indexed by the smaller one."""
    rnd = np.random.default_rng(2)
    for _ in range(300):
        s = int(rnd.choice([1, 2, 4, 5, 9, 10, 24, 39, 40, 41, 70, 300]))
        a = rnd.integers(1, 2**63, s, dtype=np.int64).astype(np.uint64)
        gone, new = rnd.integers(0, s // 5 + 1), rnd.integers(0, s // 4 + 1)
        b = np.unique(np.concatenate([a[gone:], rnd.integers(1, 2**63, new, dtype=np.int64).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        index = ngram_join._Index(1, ngram_join.SIMILARITY)
        index.add(1, a)
        index.add(2, b)
        large = 1 if len(a) > len(b) else 2
        held = {}
        for codes, rows in zip(index.codes, index.rows, strict=True):
            entry = index.entries[int(rows[0] & np.uint16(ngram_join._LARGE - 1))]
            for c, r in zip(codes.tolist(), rows.tolist(), strict=True):
                held.setdefault(c, set()).add((entry[0], bool(entry[4]), r >= ngram_join._KEEP))
        small = 3 - large
        assert any((small, True, k) in v and any(x[0] == large and x[2] for x in v) for v in held.values() for k in (True, False)), (len(a), len(b), both)


def test_components_of_long_chains(spark):
    rnd = random.Random(8)
    chain = list(range(0, 900, 3))
    rnd.shuffle(chain)
    links = list(zip(chain, chain[1:], strict=False)) + [(2000, 2000), (2001, 2007), (2007, 2001), (2003, 2001)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()))
    want = brute.components({x for p in links for x in p}, links)
    assert {n: r for n, r in want.items() if n != 2000} == got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_by_definition(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 12))
    near = np.concatenate([base[:8] + 0.15 * rng.normal(size=(8, 12)) for _ in range(6)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near, base[:3], 7.5 * base[3:4], 1e-180 * base[4:5], 1e180 * base[4:5]]))]
    odd = [None, [], [0.0] * 12, [math.nan] * 12, [None] + [1.0] * 11, [math.inf] * 12]
    rows += [(1000 + k, v) for k, v in enumerate(odd)] + [(2000, [1.0, 2.0]), (2001, [2.0, 4.0]), (None, rows[0][1]), rows[5]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, class int, kept string")
    got = sorted((r.vec_id is not None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in pq_dedup.near_vectors(df).collect())
    sound = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    for x in sound:
        for y in sound:
            if x != y and len(rows[x][1]) == len(rows[y][1]):
                a, b = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (x, y))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    links[x].append(y)
    root = brute.components(links, [(x, y) for x, v in links.items() for y in v])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    want = []
    for k, (i, _) in enumerate(rows):
        c = least[root[k]] if i is not None else None
        want.append((i is not None, i or 0, len(links[k]), c, i == c))
    assert got == sorted(want)
    assert pq_dedup.near_vectors(df.limit(0)).count() == 0 and pq_dedup.near_vectors(df.filter("vec_id = 1000")).count() == 1


def test_vector_recall_with_many_lists(spark):
    """Sixty groups of near copies among single vectors: recall of links against brute force."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    for g in range(60):
        x[g * 20 : g * 20 + 12] = x[g * 20] + 0.22 * rng.normal(size=(12, 32))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in pq_dedup.near_vectors(df, probes=4).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.9 * true.sum() > 1000


def test_vector_recall_of_a_hot_group(spark, monkeypatch):
    """Half of the vectors are different near copies, dealt to 50 or more lists: the registered default finds every link."""
    rng = np.random.default_rng(11)
    n, hot, d = 6_000, 3_000, 64
    x = rng.normal(size=(n, d)).astype(np.float32)
    centre = x[0] + np.float32(0.3) * rng.normal(size=(100, d)).astype(np.float32)
    x[:hot] = np.repeat(centre, hot // 100, axis=0) + np.float32(0.1) * x[:hot]
    rng.shuffle(x)
    fitted, fit = [], pq_dedup.Quantiser.fit
    monkeypatch.setattr(pq_dedup, "LIST_VECTORS", 32)  # as many lists as 48 000 vectors have
    monkeypatch.setattr(pq_dedup.Quantiser, "fit", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = dict(map(tuple, pq_dedup.near_vectors(rows).select("vec_id", "n_links").collect()))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (u @ u.T >= pq_dedup.LIMIT).sum(axis=1) - 1
    assert len(np.unique((u @ fitted[0].centres.T).argmax(axis=1)[true > 100])) >= 50 and true.sum() > 10**5
    assert [got[i] for i in range(n)] == true.tolist()


def _dealt_to_blocks(spark, monkeypatch, x):
    """(vec_id, n_links, component_id) rows, rows sent to the tiles, and the blocks."""
    seen, dealt = [], pq_dedup._dealt
    monkeypatch.setattr(pq_dedup, "_dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, pq_dedup.near_vectors(rows).select("vec_id", "n_links", "component_id").collect()))
    return got, seen[0][0].count(), seen[0][1]


def test_vectors_are_sent_in_proportion(spark, monkeypatch):
    """Unstructured vectors probe more lists in a larger table; rows are sent per block, of which there are as many."""
    monkeypatch.setattr(pq_dedup, "LIST_VECTORS", 16)
    monkeypatch.setattr(pq_dedup, "BLOCK_VECTORS", 64)
    x = np.random.default_rng(5).normal(size=(4000, 32)).astype(np.float32)
    for n in (1000, 4000):
        _, sent, blocks = _dealt_to_blocks(spark, monkeypatch, x[:n])
        assert pq_dedup.BLOCKS <= len(blocks.low) <= 2 * pq_dedup.BLOCKS and sent <= len(blocks.low) * n


@pytest.mark.parametrize("most", [16, 150])
def test_lists_cut_over_blocks(spark, monkeypatch, most):
    """A hot list larger than a block is cut; links inside it, across blocks and of equal vectors are all counted."""
    rng = np.random.default_rng(8)
    n, d = 1500, 24
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[:400] = x[0] + np.float32(0.25) * rng.normal(size=(400, d)).astype(np.float32)
    x[400:420] = x[10:30]
    rng.shuffle(x)
    monkeypatch.setattr(pq_dedup, "BLOCK_BYTES", 4 * d * most)
    got, sent, blocks = _dealt_to_blocks(spark, monkeypatch, x)
    assert blocks.parts.max() > 1 and sent > n and (most > 16 or len(blocks.low) > 64)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= pq_dedup.LIMIT
    np.fill_diagonal(linked, False)
    links = {i: np.flatnonzero(linked[i]).tolist() for i in range(n)}
    root = brute.components(links, [(a, b) for a, v in links.items() for b in v])
    least = {}
    for i in range(n):
        least.setdefault(root[i], i)
    assert got == [(i, len(links[i]), least[root[i]]) for i in range(n)]


def test_malformed_urls_are_no_trap(spark):
    urls = [None, "", "no scheme", "broken", "www.example.org/x", "also broken", *(f"http://a.example.invalid/t?s={k}" for k in range(3))]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_cascade.judge_urls(df, queries.URL_RULES).collect()}
    assert [got[k] for k in range(9)] == ["allow"] * 6 + ["block"] * 3


def test_maximal_segments_by_definition():
    """Every maximal segment: all its proper parts score less, and no larger segment has that property."""
    rnd = random.Random(9)
    for _ in range(200):
        n = rnd.randint(1, 14)
        gain = {k: rnd.choice([0.25, 0.75, 1.0, 2.0]) for k in range(n) if rnd.random() < 0.5}
        score = [gain.get(k, -0.5) for k in range(n)]
        sums = np.concatenate([[0], np.cumsum(score)])
        good = lambda a, b: all(sums[a] < sums[k] < sums[b] for k in range(a + 1, b)) and sums[b] > sums[a]
        # a segment is proper if its least sum is only at the start and its greatest only at the end
        proper = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if good(a, b)]
        want = [(a, b) for a, b in proper if not any((c, d) != (a, b) and c <= a and b <= d for c, d in proper)]
        at = np.array(sorted(gain))
        got = toxicity.maximal_segments(at, np.array([gain[k] for k in at]), 0.5) if gain else []
        assert [(a, b) for a, b, _ in got] == sorted(want)
        assert all(abs(s - (sums[b] - sums[a])) < 1e-9 for a, b, s in got)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = queries.op4_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    bad = scored[scored.toxic == 1]
    assert (bad.predicted == 1).mean() >= 0.8 and (scored[scored.toxic == 0].predicted == 1).mean() <= 0.01
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.7) == (scored.predicted == 1)).all()


def test_toxicity_edges(spark):
    texts = [(k, "you vile toad go away" if k % 4 == 0 else f"a calm day number {k} by the lake", None) for k in range(40)]
    texts += [(50, None, "x"), (51, "", "x"), (52, "vile toad " * 20000, "x"), (None, "vile toad", "x"), (0, texts[0][1], None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)] + [(4, None), (8, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    rows = {r.doc_id: r.t for r in toxicity.score_toxicity(df, toxicity.fit(df, labels), result="t").collect()}
    assert min(rows[k].score for k in (0, 4, 52, None)) > 0.7 > 0.3 > max(rows[k].score for k in (1, 2, 50, 51))
    assert rows[52].passages and rows[0].passages[0].start == 0 and rows[51].n_words == 0
    blank = toxicity.fit(df, labels.filter("toxic = 0"))
    assert {r.t.score for r in toxicity.score_toxicity(df, blank, result="t").collect()} == {0.0}
    assert toxicity.score_toxicity(df.limit(0), toxicity.fit(df.limit(0), labels), result="t").count() == 0


URLS = [
    ("http://A.Net/x", "a.net", "/x", "net/", "block"),
    ("http://Example.NET/en/1?q=/de/", "example.net", "/en/1", "example.net/en/", "allow"),
    ("http://m.example.net/EN/", "m.example.net", "/EN/", "net/", "block"),
    ("https://notexample.com/de/1", "notexample.com", "/de/1", None, None),
    ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("x://org/fr/#/a", "org", "/fr/", "org/fr/", "allow"),
    ("x://net", "net", "", None, None),
    ("x://net?a=/", "net", "", None, None),
    ("x://a://net/b", "a:", "//net/b", None, None),
    ("é://ÉX.org/fr/\nz#b", "Éx.org", "/fr/\nz", "org/fr/", "allow"),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
]


@pytest.mark.parametrize("shipped", [1 << 25, 0])
def test_urls_and_traps(spark, shipped, monkeypatch):
    monkeypatch.setattr(url_cascade, "SHARD_KEYS", 64)
    member = url_cascade.with_membership
    monkeypatch.setattr(url_cascade, "with_membership", lambda *a: member(*a, shipped=shipped))
    rows = [(k, u[0]) for k, u in enumerate(URLS)]
    rows += [(1000 + k, f"http://h{k % 97}.com/p/{k % 350}?s={k}") for k in range(3000)] + [(None, "http://solo.com/"), (5, "http://solo.com/")]
    df = spark.createDataFrame([(i, u, "r", "l") for i, u in rows], "page_id long, url string, rule string, listed string")
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge_urls(df, queries.URL_RULES).collect()}
    assert len(got) == len(rows)
    for k, (u, host, path, rule, verdict) in enumerate(URLS):
        assert got[k, u] == (host, path, rule, verdict or "allow")
    seen = {}
    for k in range(3000):
        seen.setdefault((f"h{k % 97}.com", f"/p/{k % 350}"), set()).add(k)
    for k in range(3000):
        host, path = f"h{k % 97}.com", f"/p/{k % 350}"
        assert got[1000 + k, f"http://{host}{path}?s={k}"] == (host, path, None, "block" if len(seen[host, path]) >= 3 else "allow")
    assert url_cascade.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_cascade_levels_are_exact():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (2, 20000), dtype=np.int64).astype(np.uint64)
    for n in (0, 1, 500, 20000):
        inside, outside = tuple(k[:n] for k in keys), tuple(k[n:] for k in keys)
        levels = url_cascade.build_levels(inside, outside)
        assert (url_cascade.look_up(*keys, levels) == (np.arange(20000) < n)).all()


def test_archives_come_back_whole(spark):
    big = "<p>é</p>" * 200
    trick = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" + "y" * 1000
    pages = [(1, "http://b.a.com/1", big), (7, "http://b.a.com/1", big), (3, None, big), (4, "http://x.org/\r\n?q", None), (5, "http://x.org/", ""), (None, "http://a.com/", big)]
    pages += [(8, "http://z.com/", trick), (9, "http://z.com/", "s" * 999), (10, "http://z.com/", "s" * 999), (11, "http://z.com/", trick), (11, "http://z.com/", trick), (12, "http://z.com/", "t" * 300_000)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, run string").repartition(3)
    path = new_folder(spark, "w")
    warc.write_archives(df, path, captured_at=F.timestamp_seconds(F.coalesce("page_id", F.lit(0))))
    rows = warc.merge_index(warc.read_index(spark, path), range_rows=4).collect()
    largest = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000 and i is not None:
            largest[h] = max(largest.get(h, i), i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        first = largest.get(h)
        again = len(raw) >= 1000 and first is not None and i != first
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == sorted(want, key=str)
    ordered = sorted(rows, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(len(pages)))
    assert [(r.url_key, r.captured_at) for r in ordered] == sorted((r.url_key, r.captured_at) for r in rows)
    assert "com,a,b)/1" in {r.url_key for r in rows}


def test_archives_of_nothing(spark):
    path = new_folder(spark, "w")
    none = corpus(spark, "pages").limit(0)
    warc.write_archives(none, path, captured_at=F.timestamp_seconds(F.lit(0)))
    assert warc.merge_index(warc.read_index(spark, path)).count() == 0


def test_loser_tree_merges():
    rnd = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rnd.randrange(20),) for _ in range(rnd.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_pages_of_the_corpus(spark):
    pages = {r.page_id: (r.html or "").encode() for r in corpus(spark, "pages").collect()}
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in queries.op8_warc_index(spark, SF).collect()}
    assert got == {i: (len(h), hashlib.sha1(h).hexdigest(), "response") for i, h in pages.items()}


def test_pipeline_against_a_plain_version(spark):
    docs = {r.doc_id: r.text for r in corpus(spark, "documents").collect()}
    bench = [(r.item_id, r.text) for r in corpus(spark, "benchmark").collect()]
    toxic = {r.doc_id for r in queries.op4_toxicity(spark, SF).filter("predicted = 1").collect()}
    left = sorted((i, t) for i, t in docs.items() if i not in toxic)
    left = [(i, t) for (i, t), row in zip(left, sorted(brute_components(left), key=lambda r: r[1]), strict=True) if row[3] == i]
    left = [(i, t) for i, t in left if not brute.benchmark_hits(t, bench)[-1]]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in left} and len(left) < len(docs)
    masked = corpus_pipeline.mask_secret_spans(spark, corpus(spark, "documents"), SF).collect()
    words = {r.doc_id: len(r.text.split(" ")) for r in masked if r.n_chars == len(r.text)}
    assert len(words) == len(docs)
    library = brute.tokenizer()
    text = {r.doc_id: r.text for r in masked}
    for i, _ in left:
        n = len(library.encode(text[i], add_special_tokens=False).ids)
        assert sum(r.n_tokens for r in rows if r.doc_id == i) == n + (n > 0)
    for name, step in corpus_pipeline.STAGES[:-1]:
        empty = step(spark, corpus(spark, "documents").limit(0), SF)
        assert empty.columns == corpus(spark, "documents").columns and empty.count() == 0, name


def test_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, an empty and a very long text, a column named like a result."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, toxicity string, secrets string"
    texts = [None, "", "plain words only", "plain words only", "password = hunter2hunter2 end", "long " * 60_000]
    rows = [(i, t, "en", "s", len(t or ""), "own", None) for t in texts for i in (None, 7, 7, 8)]
    df = spark.createDataFrame(rows, schema)
    key = lambda r: tuple((v is not None, v) for v in r)
    kept = corpus_pipeline.drop_toxic(spark, df, SF)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=key) == sorted(rows, key=key)
    masked = corpus_pipeline.mask_secret_spans(spark, df, SF)
    assert masked.columns == df.columns
    got = sorted(map(tuple, masked.collect()), key=key)
    assert len(got) == len(rows) and not any("hunter2" in (r[1] or "") for r in got)
    assert all(r[4] == len(r[1]) for r in got if r[1] is not None) and sum(r[5] == "own" for r in got) == len(rows)
    packed = corpus_pipeline.pack_buckets(spark, df, SF)
    assert {r.doc_id for r in packed.collect()} == {None, 7, 8}


def test_very_long_urls(spark):
    long = "http://A.example.com/" + "x" * 200_000
    rows = [(1, long), (2, long + "?q"), (3, "y" * 300_000), (4, "http://" + "h" * 100_000 + ".net/p")]
    got = {r.page_id: (r.host[-12:], len(r.path), r.rule, r.verdict) for r in url_cascade.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert got[1][:2] == (".example.com", 200_001) and got[1][1:] == got[2][1:]
    assert got[3] == ("", 0, None, "allow") and got[4] == ("hhhhhhhh.net", 2, "net/", "block")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))
