"""Language identification with a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import arrow_map, held_out, in_slices, in_training

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
#: Labelled documents that training reads at most; they are chosen by the hash of their id.
TRAIN_DOCUMENTS = 4000
#: Windows that training takes from one labelled document at most.
TRAIN_WINDOWS = 3
UNDETERMINED = "und"
#: A document is rejected by the filter below this score.
MIN_SCORE = 0.5
#: Windows that run through the network at once.
BATCH_WINDOWS = 512

_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteNet:
    """Embedding, convolutions of several widths, max pooling over the window, softmax."""

    langs: list[str]
    embed: np.ndarray  # (256, EMBED)
    kernels: dict[int, np.ndarray]  # width -> (width, EMBED, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray  # (FILTERS * len(WIDTHS), langs)
    out_bias: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """What each byte adds at each offset of a filter, so that a convolution is a sum of look-ups."""
        return {w: [(self.embed @ k[o]).astype(np.float32) for o in range(w)] for w, k in self.kernels.items()}


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text in consecutive windows; the last is padded with zero bytes."""
    data = np.frombuffer(raw, np.uint8)
    out = np.zeros((max(1, -(-len(data) // size)), size), np.uint8)
    out.reshape(-1)[: len(data)] = data
    return out


def _forward(net: ByteNet, tables: dict[int, list[np.ndarray]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Logits, pooled activations and the positions at which the pool took its maxima."""
    pooled, where = [], {}
    for w in net.kernels:
        n = x.shape[1] - w + 1
        total = np.take(tables[w][0], x[:, :n], axis=0)
        for o in range(1, w):
            total += np.take(tables[w][o], x[:, o : o + n], axis=0)
        where[w] = total.argmax(1)
        best = np.take_along_axis(total, where[w][:, None, :], 1)[:, 0] + net.bias[w]
        pooled.append(np.maximum(best, 0))
    h = np.concatenate(pooled, 1)
    return h @ net.out + net.out_bias, h, where


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, seed: int = 11) -> ByteNet:
    """Fit the network by Adam on windows ``x`` (bytes) with label numbers ``y``."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (256, EMBED))
    kernels = {w: rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS}
    net = ByteNet(langs, embed, kernels, {w: np.zeros(FILTERS) for w in WIDTHS}, rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))), np.zeros(len(langs)))
    params = [net.embed, *net.kernels.values(), *net.bias.values(), net.out, net.out_bias]
    mean, var, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            rows = order[lo : lo + 64]
            xb, yb = x[rows], y[rows]
            logits, h, where = _forward(net, net.tables(), xb)
            d = _softmax(logits.astype(np.float64))
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            g_out, g_out_bias, dh = h.T @ d, d.sum(0), (d @ net.out.T) * (h > 0)
            g_embed, g_kernels, g_bias = np.zeros_like(net.embed), {}, {}
            for i, w in enumerate(WIDTHS):
                dw = dh[:, i * FILTERS : (i + 1) * FILTERS]
                g_bias[w], g_kernels[w] = dw.sum(0), np.zeros_like(net.kernels[w])
                for o in range(w):
                    seen = np.take_along_axis(xb, where[w] + o, 1)  # the byte under offset o of each filter's maximum
                    g_kernels[w][o] = np.einsum("bf,bfe->ef", dw, net.embed[seen])
                    np.add.at(g_embed, seen.ravel(), (dw[:, :, None] * net.kernels[w][o].T[None]).reshape(-1, EMBED))
            grads = [g_embed, *g_kernels.values(), *g_bias.values(), g_out, g_out_bias]
            step += 1
            for p, g, m, v in zip(params, grads, mean, var, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def predict(net: ByteNet, tables: dict[int, list[np.ndarray]], texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts: the windows' logits are averaged, each text by its own windows."""
    letter = [raw is not None and _LETTER.search(raw.decode("utf-8", "replace")) is not None for raw in texts]
    sums, counts = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def flush() -> None:
        x, who = np.concatenate(held), np.concatenate(owner)
        for lo in range(0, len(x), BATCH_WINDOWS):
            logits, _, _ = _forward(net, tables, x[lo : lo + BATCH_WINDOWS])
            np.add.at(sums, who[lo : lo + BATCH_WINDOWS], logits)
            np.add.at(counts, who[lo : lo + BATCH_WINDOWS], 1)
        held.clear()
        owner.clear()

    for i, raw in enumerate(texts):
        if letter[i]:
            held.append(windows(raw))
            owner.append(np.full(len(held[-1]), i))
            if sum(len(x) for x in held) >= 4 * BATCH_WINDOWS:
                flush()
    if held:
        flush()
    p = _softmax(sums / np.maximum(counts, 1)[:, None])
    best = p.argmax(1)
    ok = np.array(letter, bool)
    return [net.langs[b] if k else UNDETERMINED for b, k in zip(best, ok, strict=True)], np.where(ok, p[np.arange(len(texts)), best], 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_documents: int = TRAIN_DOCUMENTS) -> ByteNet | None:
    """Train on at most ``max_documents`` labelled rows outside the held-out part.

    The rows with the smallest hash of their id are taken, evenly over the
    languages; up to ``TRAIN_WINDOWS`` windows spread over each text are used.
    Returns None where there is nothing to learn from.
    """
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        in_training(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs, x, y = sorted(counts), [], []
    per_lang = max(1, max_documents // len(langs))
    # An id's hash is uniform, so this threshold leaves about per_lang rows, each cut to its windows in the executors.
    share = F.create_map(*[v for k in langs for v in (F.lit(k), F.lit(min(1.0, 1.2 * per_lang / counts[k])))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    wide = F.octet_length("text")
    places = F.array(*[F.greatest(F.lit(0), ((wide - WINDOW) * k / max(1, TRAIN_WINDOWS - 1)).cast("int")) for k in range(TRAIN_WINDOWS)])
    bits = chosen.select("doc_id", "lang", F.explode(F.array_distinct(places)).alias("at"), F.col("text").cast("binary").alias("raw")).select(
        "lang", "at", "doc_id", F.substring("raw", F.col("at") + 1, F.lit(WINDOW)).alias("raw")
    )
    for row in bits.orderBy(F.xxhash64("doc_id", "at"), "raw").limit(2 * max_documents * TRAIN_WINDOWS).collect():
        x.append(windows(bytes(row["raw"]))[0])
        y.append(langs.index(row["lang"]))
    return train(np.array(x), np.array(y), langs)


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row, preceded by the columns in ``keep``.

    Whole texts are read, in windows of fixed length. Defined cases: ``und`` with score 0 for a null text, a text without any
    letter, and every text if the network could not be trained; repeated rows
    each return a row; a null id is kept, is never learned from and is not held
    out; an empty table gives an empty result; other columns are not read.
    """
    ship = (net, net.tables()) if net else None
    kept = keep or []
    sent = [i for i, c in enumerate(kept) if c != text_col]  # the text goes to Python once, whether it is kept or not
    place = {i: 1 if c == text_col else 2 + sent.index(i) for i, c in enumerate(kept)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            if ship is None:
                langs, score = [UNDETERMINED] * len(raw), np.zeros(len(raw))
            else:
                langs, score = predict(*ship, raw)
            rest = [batch.column(place[i]) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*rest, batch.column(0), pa.array(langs, pa.string()), pa.array(score)], names=[*(f"k{i}" for i in range(len(kept))), "doc_id", "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(f"`{kept[i]}`").alias(f"k{i}") for i in sent)]
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(kept)), "doc_id long, lang_pred string, score double"])
    return arrow_map(docs.select(*cols), work, schema)


def with_held_out(result: DataFrame) -> DataFrame:
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is undetermined or uncertain go."""
    columns = docs.columns
    found = identify(docs, fit(docs), keep=columns)
    passed = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return passed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)])
