"""Toxic passages: maximal scoring segments over token log-odds, calibrated by extreme values.

*Log-odds.* Words and their first four bytes are counted in toxic and clean training texts. The rate
of a beginning in a class has an informative Dirichlet prior at its rate in both; the rate of a word
inside its beginning likewise, so an unknown word takes the log-odds of its beginning. Only
log-odds that are significantly above zero count; all other words take a small fixed cost.

*Passages.* One linear scan finds all maximal scoring segments of a text (each cannot be made better
by growing or shrinking). Over clean text the number of segments with score S or more among n words
is about K n exp(-lambda S); lambda solves the clean words' balance, K is the rate of such
segments in the clean training texts.

*Score.* The evidence -log10(p) of the significant passages is added up and mapped to a probability
by a logistic curve, fitted with a ridge on the training rows.

Null and empty texts have no passage and the lowest score. Without rows of both classes every score
is 0. A text is always read whole. Repeated documents are each scored; for training, a doc_id with
several labels counts as toxic if any of them is, null labels are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.frames import input_columns, measured_join
from fleetcast.llm.words import WORDLIKE, slices, span_codes, text_bytes, word_spans
from fleetcast.session import stage

#: labelled rows that a model is fitted on at most (a hash sample of them beyond)
TRAINING_ROWS = 200_000

BEGINNING = 4  # bytes
PRIOR_FLAT = 0.5  # pseudo-words of every beginning
PRIOR_BEGINNING = 50.0  # pseudo-words dealt out by the rates in both classes
PRIOR_WORD = 5.0  # pseudo-words inside a beginning
SIGNIFICANT = 3.0  # standard errors above zero
LEAST_GAIN = 1.0  # log-odds below it count as none
COST = 0.1  # of a word without significant log-odds
RIDGE = 0.01

_TABLE_BITS = 20
_PASSAGE = "struct<start:bigint,end:bigint,score:double,e_value:double>"
_SCORED = f"struct<score:double,n_words:bigint,passages:array<{_PASSAGE}>>"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words and of their beginnings, and the first word of each row."""
    raw, at = text_bytes(column)
    start, end, first = word_spans(raw, at, WORDLIKE)
    return span_codes(raw, start, end), span_codes(raw, start, np.minimum(end, start + BEGINNING)), first


def count_words(rows: DataFrame) -> DataFrame:
    """Per word: its code, the code of its beginning, and how many toxic and clean rows have it.

    ``rows`` has text and toxic. Tasks add up their own rows before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                word, begin, first = _words(part.column("text"))
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                order = np.lexsort((word, row))
                row, word, begin = row[order], word[order], begin[order]
                once = np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])]) if len(row) else np.zeros(0, bool)
                row, word, begin = row[once], word[once], begin[once]
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                code, where, which = np.unique(word, return_index=True, return_inverse=True)
                bad = np.bincount(which, weights=toxic, minlength=len(code)).astype(np.int64)
                yield pa.record_batch(
                    {
                        "word": pa.array(code.view(np.int64)),
                        "beginning": pa.array(begin[where].view(np.int64)),
                        "toxic": pa.array(bad),
                        "clean": pa.array(np.bincount(which, minlength=len(code)) - bad),
                    }
                )

    counted = rows.mapInArrow(count, "word long, beginning long, toxic long, clean long")
    return counted.groupBy("word", "beginning").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame) -> DataFrame:
    """Significant log-odds: code, kind ("word" or "beginning"), gain, and the code's share of clean words.

    Plain column arithmetic; what is significant has some ten occurrences or more, so the result is
    far smaller than the training sample.
    """
    total = F.broadcast(counts.agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0")))
    begins = counts.groupBy("beginning").agg(F.sum("toxic").alias("b1"), F.sum("clean").alias("b0"))
    kinds = F.broadcast(begins.agg((PRIOR_BEGINNING + PRIOR_FLAT * F.count(F.lit(1))).alias("prior")))
    begins = begins.crossJoin(total).crossJoin(kinds)  # one row each
    q = PRIOR_FLAT + (F.col("b1") + F.col("b0")) / (F.col("n1") + F.col("n0")) * PRIOR_BEGINNING
    rate = lambda y, n: (F.col(y) + q) / (F.col(n) + F.col("prior"))
    begins = begins.withColumns(
        {"bg": F.log(rate("b1", "n1") / rate("b0", "n0")), "bv": 1 / (F.col("b1") + q) + 1 / (F.col("b0") + q)}
    )
    words = counts.join(begins, "beginning")
    inside = (F.col("toxic") + F.col("clean")) / (F.col("b1") + F.col("b0")) * PRIOR_WORD
    share = lambda y, n: (F.col(y) + inside) / (F.col(n) + PRIOR_WORD)
    words = words.withColumns(
        {
            "g": F.col("bg") + F.log(share("toxic", "b1") / share("clean", "b0")),
            "v": F.col("bv") + 1 / (F.col("toxic") + inside) + 1 / (F.col("clean") + inside),
        }
    )
    by_word = words.select(F.col("word").alias("code"), F.lit("word").alias("kind"), "g", "v", (F.col("clean") / F.col("n0")).alias("share"))
    by_begin = begins.select(
        F.col("beginning").alias("code"), F.lit("beginning").alias("kind"), F.col("bg").alias("g"), F.col("bv").alias("v"), (F.col("b0") / F.col("n0")).alias("share")
    )
    sure = (F.col("g") >= SIGNIFICANT * F.sqrt("v")) & (F.col("g") >= LEAST_GAIN)
    # a word that speaks against its beginning must not take the beginning's gain
    told = by_begin.filter(sure).select(F.col("code").alias("beginning"))
    against = counts.join(told, "beginning", "left_semi").select(F.col("word").alias("code"))
    against = by_word.filter(F.col("g") < LEAST_GAIN).join(against, "code", "left_semi").withColumn("g", F.lit(0.0))
    kept = by_begin.filter(sure).unionByName(by_word.filter(sure)).unionByName(against)
    return kept.select("code", "kind", F.col("g").alias("gain"), "share").dropDuplicates(["code", "kind"])


def maximal_segments(at: np.ndarray, gain: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that is ``-cost`` everywhere but ``gain`` at the places ``at``.

    Returns (start, end, score). Each gain is first taken as a segment with the sums before and
    after it; it joins the latest earlier segment with a smaller sum before it if that one's sum
    after is smaller too, again and again. Every segment is joined or set aside once.
    """
    held: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to the end
    link: list[int] = []  # latest earlier segment with a smaller sum before
    total, last = 0.0, 0
    for k, g in zip(at.tolist(), gain.tolist(), strict=True):
        total -= cost * (k - last)
        start, end, low, high = k, k + 1, total, total + g
        total, last = high, k + 1
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = link[j]
            if j < 0 or held[j][3] >= high:
                held.append((start, end, low, high))
                link.append(j)
                break
            start, low = held[j][0], held[j][2]
            del held[j:], link[j:]
    return [(a, b, high - low) for a, b, low, high in held]


@dataclass
class Model:
    """Gains by code, and the calibration."""

    codes: np.ndarray
    gains: np.ndarray
    is_word: np.ndarray
    rate: float = 1.0  # lambda
    density: float = 1.0  # K
    shift: float = 0.0
    slope: float = 1.0
    fitted: bool = False

    def __post_init__(self):
        self.tables = []
        for kind in (True, False):
            code, gain = self.codes[self.is_word == kind], self.gains[self.is_word == kind]
            order = np.argsort(code)
            maybe = np.zeros(1 << _TABLE_BITS, bool)
            maybe[code & np.uint64((1 << _TABLE_BITS) - 1)] = True
            self.tables.append((code[order], gain[order], maybe))

    def _known(self, kind: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, gains, maybe = self.tables[kind]
        at = np.flatnonzero(maybe[code & np.uint64((1 << _TABLE_BITS) - 1)])
        if not len(at) or not len(codes):
            return np.zeros(0, np.int64), np.zeros(0)
        slot = np.minimum(np.searchsorted(codes, code[at]), len(codes) - 1)
        same = codes[slot] == code[at]
        return at[same], gains[slot[same]]

    def gains_of(self, word: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places with a gain, and the gains; a word's own goes before its beginning's."""
        gain = np.zeros(len(word))
        at, g = self._known(1, begin)
        gain[at] = g
        at, g = self._known(0, word)
        gain[at] = g
        places = np.flatnonzero(gain > 0)
        return places, gain[places]

    def p_value(self, score: float, n: int) -> tuple[float, float]:
        e = self.density * max(n, 1) * math.exp(-self.rate * score)
        return e, -math.expm1(-e)

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Sum of -log10(p) over the passages expected less than once by chance; the best one's if there is none."""
        told = [(e, -math.log10(max(p, 1e-300))) for e, p in (self.p_value(s[2], n) for s in segments)]
        return sum(x for e, x in told if e < 1) or max((x for _, x in told), default=0.0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.shift + self.slope * evidence)))) if self.fitted else 0.0


def _passages(texts: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    for part in slices(pa.record_batch({"text": texts}), "text"):
        word, begin, first = _words(part.column("text"))
        at, gain = model.gains_of(word, begin)
        edge = np.searchsorted(at, first)
        for i in range(part.num_rows):
            a, b = edge[i], edge[i + 1]
            yield int(first[i + 1] - first[i]), maximal_segments(at[a:b] - first[i], gain[a:b], COST) if b > a else []


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve with a ridge on the slope, by Newton steps."""
    design = np.stack([np.ones_like(x), x], axis=1)
    beta, pull = np.array([math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)), 0.1]), np.diag([RIDGE, RIDGE * max(1, len(x)) / 100])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + pull, design.T @ (y - p) - pull @ beta)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def _clean_balance(gain: np.ndarray, share: np.ndarray) -> float:
    """The lambda at which the clean words' mean of exp(lambda * score) is 1."""
    rest = max(0.0, 1 - share.sum())
    low, high = 1e-3, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        mean = (share * np.exp(np.minimum(mid * gain, 700))).sum() + rest * math.exp(-COST * mid)
        low, high = (mid, high) if mean < 1 else (low, mid)
    return min(low, 1.0)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """A model of the labelled documents, of at most about ``rows`` of them."""
    known = input_columns(labels, doc_id=doc_id, toxic=label).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = stage(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    sample = measured_join(input_columns(docs, doc_id=doc_id, text=text), known, "doc_id", "inner").select("text", "toxic")
    counts = stage(count_words(sample))
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool))
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not sums[0] or not sums[1]:
        return empty
    found = log_odds(counts).toArrow()
    code = found.column("code").to_numpy().view(np.uint64)
    gain, share = found.column("gain").to_numpy(), found.column("share").to_numpy()
    is_word = np.array([k == "word" for k in found.column("kind").to_pylist()], bool)
    model = Model(code, gain, is_word)
    use = ~is_word & (gain > 0)
    model.rate = _clean_balance(gain[use], share[use]) if use.any() else 1.0
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = list(_passages(batch.column("text"), sent.value))
            kind = pa.list_(pa.float64())
            yield pa.record_batch(
                {
                    "toxic": batch.column("toxic"),
                    "n": pa.array([n for n, _ in facts], pa.int64()),
                    "scores": pa.array([[s[2] for s in segments] for _, segments in facts], kind),
                }
            )

    # one small row per training document, so at most about ``rows``
    tried = sample.mapInArrow(search, "toxic int, n long, scores array<double>").toArrow()
    y, n_words = tried.column("toxic").to_numpy().astype(float), tried.column("n").to_numpy()
    scores = tried.column("scores").to_pylist()
    clean = [s for own, bad in zip(scores, y, strict=True) if not bad for s in own]
    low = float(gain[gain > 0].min()) if (gain > 0).any() else 0.0  # the smallest segment there can be
    model.density = (0.5 + len(clean)) * math.exp(model.rate * low) / max(1, n_words[y == 0].sum())
    x = np.array([model.evidence([(0, 0, s) for s in own], int(k)) for own, k in zip(scores, n_words, strict=True)])
    model.shift, model.slope = _fit_curve(x, y)
    model.fitted = True
    return model


def score_toxicity(docs: DataFrame, model: Model, *, text: str = "text", result: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column: score, n_words, and the significant passages (word places, end exclusive)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        fitted, out = sent.value, []
        for n, segments in _passages(texts, fitted):
            passages = []
            for a, b, s in segments:
                e, _ = fitted.p_value(s, n)
                if e < 1:
                    passages.append({"start": a, "end": b, "score": s, "e_value": e})
            out.append({"score": fitted.probability(fitted.evidence(segments, n)), "n_words": n, "passages": passages})
        passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])
        return pa.array(out, pa.struct([("score", pa.float64()), ("n_words", pa.int64()), ("passages", pa.list_(passage))]))

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(result, F.arrow_udf(score, _SCORED)(F.col(text)))


def held_out(doc_id: Column) -> Column:
    """A third of the ids, never trained on."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))
