"""Toxicity: a linear-chain conditional random field marks toxic tokens; marginals give document scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import arrow_map, held_out, in_slices, in_training, materialise

#: Labelled documents that training reads at most, by label; chosen by the hash of their id.
TRAIN_TOXIC, TRAIN_CLEAN = 3_000, 5_000
#: Word features kept at most, by their likelihood ratio (G squared) of leaning to toxic documents, and the least ratio.
LEXICON, LEAST_G = 4_000, 19.0
#: Windows of tokens per training document, and their length.
TRAIN_WINDOWS, WINDOW = 4, 48
THRESHOLD = 0.3
#: What is left of a state after so many plain tokens is below this.
FORGOTTEN = 1e-10
CACHE_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The word, its prefixes and its suffixes."""
    n = len(word)
    return [f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6, 7) if n > k), *(f"{word[-k:]}$" for k in (4, 5, 6) if n > k)]


@dataclass
class ToxicModel:
    """States O and T; weights are those of T against O."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray  # (2, 2) log potentials from state to state
    start: np.ndarray  # (2,)
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def emission(self, word: str) -> float:
        get = self.weights.get
        return sum(w for f in word_features(word) if (w := get(f)) is not None)


def forward_backward(emission: np.ndarray, trans: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of T, expected transitions and log partitions of equally long sequences.

    ``emission`` is (sequences, tokens): the log potential of T where that of O
    is 0. Messages are scaled at each token.
    """
    n, length = emission.shape
    pot = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -60, 60))], 2)
    move = np.exp(trans)
    alpha, scale = np.empty((n, length, 2)), np.empty((n, length))
    for t in range(length):
        a = (np.exp(start)[None] if t == 0 else alpha[:, t - 1] @ move) * pot[:, t]
        scale[:, t] = a.sum(1)
        alpha[:, t] = a / scale[:, t, None]
    beta = np.empty((n, length, 2))
    beta[:, -1] = np.exp(end)
    for t in range(length - 2, -1, -1):
        beta[:, t] = (pot[:, t + 1] * beta[:, t + 1]) @ move.T / scale[:, t + 1, None]
    gamma = alpha * beta
    z = gamma.sum(2, keepdims=True)
    pairs = np.einsum("nti,ij,ntj,nt->ij", alpha[:, :-1], move, pot[:, 1:] * beta[:, 1:], 1 / (scale[:, 1:] * z[:, 1:, 0]))
    return (gamma / z)[:, :, 1], pairs, np.log(scale).sum(1) + np.log(z[:, -1, 0])


def train_crf(windows: list[tuple[list[str], list[int]]], lexicon: set[str], steps: int = 120) -> ToxicModel:
    """Fit by Adam on the conditional likelihood, with an L2 penalty; windows are padded with O tokens."""
    names = sorted(lexicon)
    number = {f: i for i, f in enumerate(names)}
    seq, tok, feat = [], [], []
    gold = np.zeros((len(windows), WINDOW), int)
    for s, (words, tags) in enumerate(windows):
        gold[s, : len(tags)] = tags
        for t, w in enumerate(words):
            for f in word_features(w):
                if f in number:
                    seq.append(s)
                    tok.append(t)
                    feat.append(number[f])
    seq, tok, feat = np.array(seq, int), np.array(tok, int), np.array(feat, int)
    w, bias, trans = np.zeros(len(names)), -3.0, np.array([[1.0, -2.0], [0.0, 0.0]])
    moved = np.zeros((2, 2))
    np.add.at(moved, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    mean, var = np.zeros(len(names) + 5), np.zeros(len(names) + 5)
    total = max(1, len(windows))
    for step in range(1, steps + 1):
        e = np.full(gold.shape, bias)
        np.add.at(e, (seq, tok), w[feat])
        m, pairs, _ = forward_backward(e, trans, np.zeros(2), np.zeros(2))
        miss = gold - m
        g = np.concatenate([np.bincount(feat, miss[seq, tok], len(names)) - 0.02 * w, [miss.sum()], (moved - pairs - 0.02 * trans).ravel()]) / total
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-9)
        w, bias, trans = w + move[: len(names)], bias + move[len(names)], trans + move[-4:].reshape(2, 2)
    return ToxicModel({n: float(x) for n, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(bias), trans, np.zeros(2))


class Scorer:
    """Marginals of whole documents, computed around the tokens that carry weight.

    Between those tokens the chain meets the same potentials again and again,
    and its messages settle; a token further than ``halo`` plain tokens from
    any weighted one has the settled marginal, up to ``FORGOTTEN``.
    """

    def __init__(self, model: ToxicModel) -> None:
        self.model, self.known, self.idle = model, {}, {}
        step = np.exp(model.trans) * np.array([1.0, np.exp(model.bias)])[None]
        values, vectors = np.linalg.eig(step)
        order = np.argsort(-np.abs(values))
        ratio = abs(values[order[1]] / values[order[0]])
        self.halo = max(4, min(512, int(np.ceil(np.log(FORGOTTEN) / np.log(max(ratio, 1e-12))))))
        ahead = np.abs(np.linalg.eig(step.T)[1][:, np.argmax(np.abs(np.linalg.eig(step.T)[0]))].real)
        back = np.abs(vectors[:, order[0]].real)
        self.ahead, self.back = ahead / ahead.sum(), back / back.sum()
        self.plain = float((self.ahead * self.back)[1] / (self.ahead * self.back).sum())

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            found = self.known[word] = self.model.emission(word)
        return found

    def document(self, text: str) -> tuple[float, float, int, list[tuple[int, int, float]]]:
        """Largest marginal, expected toxic tokens, tokens, and the spans of marginals over one half.

        Neighbouring toxic tokens are one span. Words are lower-cased one by one
        where lower-casing the whole text would move the offsets.
        """
        low = text.lower()
        words = _WORD.findall(low)
        if len(low) != len(text):
            low = text
            words = [w.lower() for w in _WORD.findall(text)]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        weight = self.weight
        active = {w for w in set(words) if abs(weight(w)) > 1e-9}
        n = len(words)
        if not n:
            return 0.0, 0.0, 0, []
        if not active:
            return *self._idle(n), n, []
        # The ends of a text differ from its middle, and so count like weighted tokens.
        at = sorted({0, n - 1, *(i for i, w in enumerate(words) if w in active)})
        best, total, marked, lo = self.plain, 0.0, [], 0
        covered = 0
        while lo < len(at):
            hi = lo
            while hi + 1 < len(at) and at[hi + 1] - at[hi] <= 2 * self.halo:
                hi += 1
            begin, end = max(0, at[lo] - self.halo), min(n, at[hi] + self.halo + 1)
            m = self._segment([weight(w) if w in active else 0.0 for w in words[begin:end]], begin == 0, end == n)
            best, total, covered = max(best, max(m)), total + sum(m), covered + end - begin
            marked += [(begin + i, x) for i, x in enumerate(m) if x > 0.5]
            lo = hi + 1
        spans = []
        if marked:
            wanted, last = dict(marked), -2
            for i, place in enumerate(_WORD.finditer(low)):
                if i in wanted:
                    if i == last + 1:
                        spans[-1] = (spans[-1][0], place.end(), max(spans[-1][2], wanted[i]))
                    else:
                        spans.append((place.start(), place.end(), wanted[i]))
                    last = i
        return best, total + self.plain * (n - covered), n, spans

    def _idle(self, n: int) -> tuple[float, float]:
        """Largest marginal and their sum for ``n`` tokens without weight."""
        some = min(n, 2 * self.halo + 2)
        if some not in self.idle:
            m = self._segment([0.0] * some, True, True)
            self.idle[some] = max(m), sum(m)
        best, total = self.idle[some]
        return best, total + self.plain * (n - some)

    def _segment(self, e: list[float], first: bool, last: bool) -> list[float]:
        """Scaled forward-backward over two states in plain numbers."""
        (oo, ot), (to, tt) = np.exp(self.model.trans).tolist()
        pots = np.exp(np.clip(np.array(e) + self.model.bias, -60, 60)).tolist()
        fo, ft = np.exp(self.model.start).tolist() if first else (self.ahead @ np.exp(self.model.trans)).tolist()
        forward = []
        for p in pots:
            o, t = fo, ft * p
            s = o + t
            o, t = o / s, t / s
            forward.append((o, t))
            fo, ft = o * oo + t * to, o * ot + t * tt
        bo, bt = (1.0, 1.0) if last else self.back.tolist()
        out = []
        for (o, t), p in zip(reversed(forward), reversed(pots), strict=True):
            a, b = o * bo, t * bt
            out.append(b / (a + b))
            x, y = bo, bt * p
            bo, bt = oo * x + ot * y, to * x + tt * y
            s = bo + bt
            bo, bt = bo / s, bt / s
        return out[::-1]


def _summary(best: float, total: float, n: int) -> np.ndarray:
    return np.array([1.0, best, np.log1p(total), min(1.0, 20 * total / n) if n else 0.0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel | None:
    """Train on a bounded sample of labelled rows outside the held-out part; None without both labels.

    Documents carry the labels, tokens do not; a token of a toxic document is
    labelled toxic if one of its features is found in toxic documents nearly
    only. Copies of a text count once.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("toxic")).where(F.col("toxic").isNotNull() & in_training(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = ids.where("toxic = 1").orderBy(order).limit(TRAIN_TOXIC).unionByName(ids.where("toxic = 0").orderBy(order).limit(TRAIN_CLEAN))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    sample = materialise(rows.join(chosen, "doc_id").dropDuplicates(["text", "toxic"]), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic].update({f for w in set(_WORD.findall(text.lower())) for f in word_features(w)})
        for toxic, some in found.items():
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(list(some)), pa.array([toxic] * len(some), pa.int32()), pa.array(list(some.values()), pa.int64())], names=["feature", "toxic", "n"])

    n1, n0 = float(sizes[1]), float(sizes[0])
    counts = arrow_map(sample.select("text", F.col("toxic").cast("int").alias("toxic")), counted, "feature string, toxic int, n long")
    by = counts.groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    p, q, rate = F.col("p"), F.col("q"), n1 / (n1 + n0)
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    g = 2 * (part(p, (p + q) * rate) + part(q, (p + q) * (1 - rate)))
    leaning = by.where((p >= 4) & (p * (n0 / n1) > 4 * q)).withColumn("g", g).where(F.col("g") >= LEAST_G)
    lexicon = {r["feature"]: (r["p"] / n1) / (r["p"] / n1 + r["q"] / n0) for r in leaning.orderBy(F.desc("g"), "feature").limit(LEXICON).collect()}
    sure = {f for f, share in lexicon.items() if share >= 0.97}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_out, tags_out = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text.lower())
                hit = [i for i, w in enumerate(words) if any(f in lexicon for f in word_features(w))]
                centres = hit[:: max(1, len(hit) // TRAIN_WINDOWS)][:TRAIN_WINDOWS] or [len(words) // 2]
                for c in sorted({max(0, min(c - WINDOW // 2, len(words) - WINDOW)) for c in centres}):
                    part = words[c : c + WINDOW]
                    words_out.append(part)
                    tags_out.append([int(bool(toxic) and any(f in sure for f in word_features(w))) for w in part])
            yield pa.RecordBatch.from_arrays([pa.array(words_out, pa.list_(pa.string())), pa.array(tags_out, pa.list_(pa.int32()))], names=["words", "tags"])

    windows = arrow_map(sample.select("text", "toxic"), cut, "words array<string>, tags array<int>").collect()
    model = train_crf(sorted((list(r["words"]), list(r["tags"])) for r in windows), set(lexicon))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [_summary(*scorer.document(t)[:3]).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    known = sorted((list(r["x"]), r["y"]) for r in arrow_map(sample.select("text", F.col("toxic").cast("int").alias("toxic")), seen, "x array<double>, y int").collect())
    x, y = np.array([k[0] for k in known]), np.array([k[1] for k in known], float)
    c = np.zeros(4)
    for _ in range(30):  # Newton steps of a logistic regression with a small penalty
        mu = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (mu * (1 - mu))[:, None]).T @ x + 0.05 * np.eye(4)
        c = c + np.linalg.solve(h, x.T @ (y - mu) - 0.05 * c)
    model.calibration = c
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_toxic_tokens, spans`` of every whole text.

    ``spans`` are the character offsets of runs of tokens that are rather toxic
    than not, with the largest marginal of each; ``n_toxic_tokens`` is the sum
    of all marginals.

    Defined cases: null and empty texts have no tokens and the score of a text
    without any; without a model every score is 0; repeated rows each return a
    row; a null id is kept, is never learned from and is not held out; an empty
    table gives an empty result; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
        for batch in in_slices(batches):
            scores, totals, spans = [], [], []
            for text in batch.column(1).to_pylist():
                best, total, n, found = scorer.document(text or "") if scorer else (0.0, 0.0, 0, [])
                scores.append(float(1 / (1 + np.exp(-np.clip(_summary(best, total, n) @ model.calibration, -30, 30)))) if scorer else 0.0)
                totals.append(total)
                spans.append([{"start": a, "end": b, "marginal": m} for a, b, m in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(totals, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "n_toxic_tokens", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, work, "doc_id long, score double, n_toxic_tokens double, spans array<struct<start: long, end: long, marginal: double>>")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns, the expected number of toxic tokens, and the offending spans as ``start-end`` in characters from 0."""
    told = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic_tokens", told.alias("spans"))
