"""Toxic passages as maximal-scoring segments of token log-odds.

Words and their beginnings get log-odds of toxic against other labelled texts under an informative Dirichlet prior.
A text is a sequence of such scores; one linear scan finds all its maximal-scoring segments. Segment scores follow an
extreme-value law whose scale is fitted to the scores of untoxic text, so each segment has an expected number of chance
hits as good, with a constant fitted to the best scores of such text; a logistic curve turns the best and the sum of all significant segments into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import write_table

WORDS = re.compile(r"\w+")
#: Lengths of the beginnings of words that count as features beside the word.
STEMS = (5, 4)


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in STEMS if len(word) > n)]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time.

    Each held segment knows the nearest one to its left that begins at a lower sum; a search hops along these links, so
    every segment is passed over once.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    for i, low, high in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        start, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
            j -= 1
        found.append((start, i + 1, low, high, j))
    return [(s, e, high - low) for s, e, low, high, _ in found]


def karlin_scale(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(x * scores)) = 1, where the mean score is below zero."""
    low, high = 0.0, 1.0
    value = lambda x: float((weights * np.exp(np.clip(x * scores, -700, 700))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if value(mid) > 0 else (mid, high)
    return high


@dataclass
class ToxicModel:
    """Log-odds by feature, the score of any other word, the extreme-value scale and the logistic curve."""

    odds: dict[str, float]
    other: float
    scale: float
    constant: float
    curve: tuple[float, float, float]
    significant: float = 0.01

    def scorer(self):
        known: dict[str, float] = {}
        odds, other = self.odds, self.other

        def of(word: str) -> float:
            score = next((odds[f] for f in features(word) if f in odds), other)
            if len(known) > 60_000:
                known.clear()
            known[word] = score
            return score

        def scores(words: list[str]) -> np.ndarray:
            return np.fromiter((known[w] if w in known else of(w) for w in words), float, len(words))

        return scores

    def bits(self, score: float, length: int) -> float:
        """-ln of the expected number of chance segments as good in a text of ``length`` words."""
        return self.scale * score - math.log(self.constant * length)

    def read(self, scores: np.ndarray) -> tuple[tuple[float, float], list[tuple[int, int, float]]]:
        """What the curve takes (best and total), and the significant segments as (start, end, bits), from one scan."""
        found = maximal_segments(scores)
        good = [(s, e, b) for s, e, x in found if (b := self.bits(x, len(scores))) >= -math.log(self.significant)]
        best = self.bits(max((x[2] for x in found), default=0.0), len(scores)) if len(scores) else -10.0
        return (max(-10.0, min(30.0, best)), math.log1p(sum(x[2] for x in good))), good

    def probability(self, x: tuple[float, float]) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x[0] + c * x[1]))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic regression with a ridge by Newton steps; the classes weigh alike."""
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    z = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(3), np.diag([0.0, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(3), z.T @ (w * (y - p)) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def training_labels(labels: DataFrame, *, fit_rows: int) -> DataFrame:
    """(doc_id, toxic) of at most ``fit_rows`` labelled documents outside the held-out fifth, by the order of a hash."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)


def learn_odds(features: list[tuple[str, int, int]], n_calm: int, n_toxic: int, *, prior_share: float, least_z: float) -> ToxicModel:
    """Log-odds from (feature, calm, toxic) counts of texts, whose sums over all features are ``n_calm`` and ``n_toxic``."""
    prior = prior_share * (n_calm + n_toxic)  # the prior's weight, as a share of what was counted
    names = [f for f, *_ in features]
    calm, toxic = np.array([x[1:] for x in features], float).reshape(-1, 2).T
    share = (calm + toxic) * prior_share
    at, an = toxic + share, calm + share
    delta = np.log(at / (n_toxic + prior - at)) - np.log(an / (n_calm + prior - an))
    chosen = np.flatnonzero((delta / np.sqrt(1 / at + 1 / an) >= least_z) & (delta > 0.7))
    odds = {names[i]: float(delta[i]) for i in chosen}
    # Any other word speaks a little for untoxic text, enough that the mean score of such text is below zero.
    other = -max(0.05, 4 * float((calm[chosen] * delta[chosen]).sum()) / n_calm)
    p = np.concatenate([[0.0], (calm[chosen] + 0.5) / (n_calm + 1)])
    p = p * min(1.0, 0.2 / max(p.sum(), 1e-12))
    p[0] = 1 - p.sum()
    scale = karlin_scale(np.concatenate([[other], delta[chosen]]), p) if odds else 1.0
    return ToxicModel(odds, other, scale, 1.0, (-5.0, 0.0, 0.0))


def extreme_constant(best: np.ndarray, lengths: np.ndarray, scale: float) -> float:
    """The likeliest constant of the extreme-value law of the best segment scores of untoxic texts of these lengths."""
    total = float((lengths * np.exp(-scale * best)).sum())
    return min(10.0, max(1e-4, len(best) / total)) if total > 0 else 0.1


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 30_000, least_count: int = 3, prior_share: float = 0.1, least_z: float = 3.0, most_held: int = 50_000) -> ToxicModel:
    """Learn from a bounded sample of the labelled documents outside the held-out fifth.

    The sample has two halves. Each is scored by odds that the other one taught, for the extreme-value constant and the
    logistic curve; the odds of the model come from both. ``fit_rows`` labels (a few hundred KB) are broadcast to the
    scans of the documents. The driver gets the features of ``least_count`` texts or more that some odds could use, which
    the sample bounds, and three numbers a sampled row; a task hands its counts on at ``most_held`` features. Null labels and ids are left out. Without documents of both
    classes nothing is toxic.
    """
    spark = docs.sparkSession
    sample = training_labels(labels, fit_rows=fit_rows).select("doc_id", "toxic", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).alias("half"))
    wanted = {r["doc_id"]: (int(r["toxic"]), int(r["half"])) for r in sample.toLocalIterator()}
    chosen = spark.sparkContext.broadcast(wanted)
    rows = docs.select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[int]] = {}

        def counted() -> pa.RecordBatch:
            columns = list(zip(*by.values(), strict=True)) or [()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(by, pa.string())] + [pa.array(c, pa.int64()) for c in columns], ["feature", *names])
            by.clear()
            return batch

        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                label = chosen.value.get(i)
                if label is not None:
                    at = label[0] + 2 * label[1]
                    for f in ("", *(f for w in set(WORDS.findall((text.as_py() or "").lower())) for f in features(w))):
                        by.setdefault(f, [0, 0, 0, 0])[at] += 1
                    if len(by) > most_held:
                        yield counted()
        yield counted()

    names = ["calm0", "toxic0", "calm1", "toxic1"]
    schema = "feature string, " + ", ".join(f"{c} long" for c in names)
    counts = write_table(rows.mapInArrow(count, schema).groupBy("feature").agg(*(F.sum(c).alias(c) for c in names)), "toxic-counts")
    empty = ToxicModel({}, -1.0, 1.0, 1.0, (-5.0, 0.0, 0.0))
    by_class = counts.where("feature = ''").select(*names).first() if wanted else None  # numbers of texts
    if by_class is None or not (by_class["calm0"] + by_class["calm1"]) or not (by_class["toxic0"] + by_class["toxic1"]):
        return empty
    sums = counts.where("feature <> ''").agg(*(F.sum(c).alias(c) for c in names)).first().asDict()
    if not (sums["calm0"] or 0) + (sums["calm1"] or 0) or not (sums["toxic0"] or 0) + (sums["toxic1"] or 0):
        return empty
    # A feature that is no more frequent in toxic texts than in others, in both halves, has no use.
    useful = F.lit(False)
    for h in (0, 1):
        useful = useful | (F.col(f"toxic{h}") * max(1, sums[f"calm{h}"]) > F.col(f"calm{h}") * max(1, sums[f"toxic{h}"]))
    kept = counts.where("feature <> ''").where(F.expr("calm0 + toxic0 + calm1 + toxic1") >= least_count).where(useful).orderBy("feature").toArrow()
    table = np.stack([kept[c].to_numpy() for c in names], axis=1) if kept.num_rows else np.zeros((0, 4), np.int64)
    words = kept["feature"].to_pylist()

    def learned(halves: tuple[int, ...]) -> ToxicModel | None:
        calm, toxic = (sum(table[:, 2 * h + k] for h in halves) for k in (0, 1))
        n_calm, n_toxic = (sum(sums[f"{k}{h}"] for h in halves) for k in ("calm", "toxic"))
        if not n_calm or not n_toxic:
            return None
        some = np.flatnonzero(calm + toxic >= least_count)
        found = [(words[i], int(calm[i]), int(toxic[i])) for i in some]
        return learn_odds(found, n_calm, n_toxic, prior_share=prior_share, least_z=least_z)

    model = learned((0, 1))
    graders = spark.sparkContext.broadcast([learned((1,)) or model, learned((0,)) or model])

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers, graded = [m.scorer() for m in graders.value], []
        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                label = chosen.value.get(i)
                if label is not None:
                    values = scorers[label[1]](WORDS.findall((text.as_py() or "").lower()))
                    found = [x[2] for x in maximal_segments(values)]
                    graded.append((*label, len(values), found))
        columns = list(zip(*graded, strict=True)) or [(), (), (), ()]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["toxic", "half", "words", "found"])

    graded = write_table(rows.mapInArrow(grade, "toxic long, half long, words long, found array<double>"), "toxic-graded")
    best = graded.select("toxic", "half", "words", F.coalesce(F.array_max("found"), F.lit(0.0)).alias("best")).toArrow()
    toxic, half, length, top = (best[c].to_numpy() for c in ("toxic", "half", "words", "best"))
    constants = []
    for h in (0, 1):
        calm = (toxic == 0) & (half == h) & (length > 0)
        constants.append(extreme_constant(top[calm], length[calm], graders.value[h].scale) if calm.any() else 0.1)
    model.constant = float(np.sqrt(constants[0] * constants[1]))
    # The curve's inputs, with each half's own scale and constant; as ToxicModel.read makes them.
    scale = F.when(F.col("half") == 0, graders.value[0].scale).otherwise(graders.value[1].scale)
    base = F.log(F.when(F.col("half") == 0, constants[0]).otherwise(constants[1]) * F.col("words"))
    bits = F.transform("found", lambda x: x * scale - base)
    top_bits = F.coalesce(F.array_max("found"), F.lit(0.0)) * scale - base
    inputs = graded.select(
        F.when(F.col("words") > 0, F.greatest(F.lit(-10.0), F.least(F.lit(30.0), top_bits))).otherwise(-10.0).alias("best"),
        F.log1p(F.aggregate(F.filter(bits, lambda x: x >= -math.log(model.significant)), F.lit(0.0), lambda a, x: a + x)).alias("total"),
        F.col("toxic").cast("double").alias("toxic"),
    ).toArrow()
    x = np.column_stack([inputs["best"].to_numpy(), inputs["total"].to_numpy()])
    y = inputs["toxic"].to_numpy()
    if len(np.unique(y)) == 2:
        model.curve = fit_curve(x, y)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, then score (0 to 1), predicted (1 if score >= 0.5) and passages, which replace any of these names.

    Only the text is read for the score. passages: start and end (code points of the lower-cased text) and the negative
    logarithm of the expected number of chance passages as good. A null or empty text scores as a text without words.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted", "passages")]
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, model = held.value.scorer(), held.value
        for batch in batches:
            score, found = [], []
            for text in batch[text_col]:
                low = (text.as_py() or "").lower()
                values = scores(WORDS.findall(low))
                inputs, segments = model.read(values)
                score.append(model.probability(inputs))
                spans = [m.span() for m in WORDS.finditer(low)] if segments else []
                found.append([{"start": spans[s][0], "end": spans[e - 1][1], "bits": b} for s, e, b in segments])
            columns = [batch[f.name] for f in keep]
            columns += [pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(found, passage)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in keep] + ["score", "predicted", "passages"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return docs.select([f.name for f in keep]).mapInArrow(each, f"{schema}, score double, predicted int, passages array<struct<start: long, end: long, bits: double>>")
