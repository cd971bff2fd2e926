"""Packing documents into fixed windows by multiway differencing."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import arrow_map, materialise

CAPACITY = 2048
END_ID = 1
#: Padding that is little enough, as a share of the ids. Remainders are cut only where a group needs more windows than that.
GOAL = 0.02
#: In how many equal parts a remainder may be cut, and the lengths above which it is, tried one after the other.
PARTS, LIMITS = (1, 2, 4), (1.0, 0.5, 0.4, 0.333, 0.25)
#: Remainders that one task packs at a time.
GROUP_ROWS = 600
#: Words whose ids a worker remembers.
CACHE_WORDS = 600_000

# Texts in which Unicode normal form, lower case and word splitting are the same for Python as for the
# tokenizer: Latin letters without combining marks, no number signs outside 0-9, no odd white space.
_ODD = re.compile(r"[^\x00-\x1B\x20-\x84\x86-\xB1\xB4-\xB8\xBA\xBB\xBF-įı-ňŊ-ž‐-‧‰-⁞]")
# The tokenizer file's own split rule, for those texts.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_MARKS = frozenset(".,;:!?)|")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")

#: A slot's sum stands above the bits of its root's number.
_SLOT = 24
_ROOT = (1 << _SLOT) - 1

_held: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The worker's tokenizer, one for words that are already split, which ids end a word, and two memories.

    The second tokenizer has the same model behind a plain split at white
    space: its words are in lower case and normal form before they reach it.
    The memories hold ids as unsigned numbers of the smallest size that fits.
    """
    if path not in _held:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        parts = json.loads(made.to_str())
        parts["normalizer"] = None
        parts["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        split = Tokenizer.from_str(json.dumps(parts))
        split.model._resize_cache(0)  # every word goes through it once
        vocab = made.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        _held[path] = (made, split, ends, "<u2" if len(ends) <= 1 << 16 else "<u4", {}, {})
    return _held[path]


def _learn(new: list[str], split, ends: np.ndarray, kind: str, parts_known: dict[str, bytes]) -> dict[str, bytes]:
    """The ids of words without white space in them, from few calls of the tokenizer.

    A word is cut by the split rule; the parts that are new go through the
    tokenizer as one text, in which each ends with one id of ``ends``.
    """
    # Most words are letters, or letters and one mark, which need no pattern.
    cut = [(w,) if w.isalpha() else (w[:-1], w[-1]) if w[-1] in _MARKS and w[:-1].isalpha() else _SPLIT.findall(w) for w in new]
    fresh = list(set().union(*cut).difference(parts_known))
    for lo in range(0, len(fresh), 2_000):
        some = fresh[lo : lo + 2_000]
        ids = np.array(split.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, kind)
        stops = (ids.itemsize * (np.flatnonzero(ends[ids]) + 1)).tolist()
        raw, at = ids.tobytes(), 0
        for part, stop in zip(some, stops, strict=True):
            parts_known[part] = raw[at:stop]
            at = stop
    get = parts_known.__getitem__
    return {w: get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for w, p in zip(new, cut, strict=True)}


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text, without special tokens.

    Plain texts are split at white space here, and each distinct word goes
    through the tokenizer once in a worker, or again after its memory was full;
    any other text goes through it whole.
    """
    tokenizer, split, ends, kind, known, parts = _tokenizer(path)
    plain = [not _ODD.search(t) and not ("<|" in t and _SPECIAL.search(t)) for t in texts]
    words = [t.lower().split() if p else None for t, p in zip(texts, plain, strict=True)]
    here = set().union(*[w for w in words if w])
    known.update(_learn(list(here.difference(known)), split, ends, kind, parts))
    local = {w: known[w] for w in here}  # small, and so near to the processor
    if len(known) > CACHE_WORDS:  # what stands here is what is frequent
        known.clear()
        known.update(local)
    if len(parts) > CACHE_WORDS:
        parts.clear()
    odd = iter(tokenizer.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
    get = local.__getitem__
    return [np.array(next(odd).ids, kind) if w is None else np.frombuffer(b"".join(map(get, w)), kind) for w in words]


def equal_parts(length: int, parts: int) -> list[int]:
    return [length // parts + (i < length % parts) for i in range(parts)]


def difference(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece by Karmarkar-Karp differencing into ``windows`` parts.

    Each piece starts as a partition of its own with one filled slot. The two
    partitions with the largest imbalance merge, the fullest slot of one with
    the emptiest of the other, until one is left. A slot keeps the root of the
    pieces in it; merged slots are joined by a parent link.
    """
    parent = np.arange(len(lengths))
    heap = [(-int(n), i, [int(n) << _SLOT | i]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    count = len(heap)
    # A partition is kept as its filled slots in falling order, each a sum and a root in one number.
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over > 0:
            # The fullest of a meet the emptiest of b: slot i of a joins slot windows - 1 - i of b.
            for i in range(windows - len(b), len(a)):
                other = b[windows - 1 - i]
                parent[other & _ROOT] = a[i] & _ROOT
                a[i] += other - (other & _ROOT)
            del b[len(b) - over :]
        a += b
        a.sort(reverse=True)
        low = a[-1] >> _SLOT if len(a) == windows else 0
        heapq.heappush(heap, (low - (a[0] >> _SLOT), count, a))
        count += 1
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    return np.unique(parent, return_inverse=True)[1]


def balanced(lengths: np.ndarray, capacity: int = CAPACITY, most: int | None = None) -> np.ndarray | None:
    """Near-equal windows; their number rises until none is over the capacity. With ``most`` only so many are tried."""
    windows = most or max(1, -(-int(lengths.sum()) // capacity))
    while True:
        found = difference(lengths, windows)
        if np.bincount(found, lengths).max() <= capacity:
            return found
        if most:
            return None
        windows += max(1, windows // 400)


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY, goal: float = GOAL) -> tuple[np.ndarray, np.ndarray]:
    """In how many parts each remainder is cut, and the window of each part.

    First whole remainders are packed; if they need more windows than the goal
    allows, those over half a window are cut in two, and so on with shorter
    limits, so that no more is cut than the padding asks for.
    """
    allowed = int(lengths.sum() * (1 + goal) // capacity)
    for limit in LIMITS:
        parts = np.array(PARTS)[np.searchsorted(capacity * limit * np.array(PARTS[:-1]), lengths)] if limit < 1 else np.ones(len(lengths), int)
        items = np.concatenate([equal_parts(int(n), int(k)) for n, k in zip(lengths, parts, strict=True)])
        last = limit == LIMITS[-1] or (parts == 1).all() and lengths.max() <= capacity * LIMITS[-1]
        found = balanced(items, capacity) if last else balanced(items, capacity, allowed) if allowed else None
        if found is not None:
            return parts, found
    raise AssertionError("the last limit always packs")


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sums``: the whole windows of each document, and what remains of it.

    ``sums`` are checksums of the row's ids: of all, and of each part for every
    number of parts in which a remainder may be cut.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 400):
                batch = whole.slice(lo, 400)
                out: list[list] = [[], [], [], [], []]
                for doc, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()], tokenizer_path), strict=True):
                    raw = np.append(ids, END_ID).astype("<u4").tobytes()
                    n = len(ids) + 1
                    for start in range(0, n, capacity):
                        length, sums = min(capacity, n - start), []
                        for parts in PARTS if length < capacity else (1,):
                            at = start
                            for size in equal_parts(length, parts):
                                sums.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                                at += size
                        for column, value in zip(out, (doc, start, length, n, sums), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.list_(pa.int64()))], names=["doc_id", "start", "length", "doc_tokens", "sums"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, work, "doc_id long, start long, length long, doc_tokens long, sums array<long>")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, goal: float = GOAL, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Each piece of each document with its sequence and its offset there.

    A document's ids end with ``END_ID``. Whole windows are sequences of their
    own; what remains of a document is packed by differencing, in groups of
    about ``group_rows`` remainders. A remainder stays whole unless its group
    would need over ``goal`` of padding (``pack_group``). The groups are dealt
    evenly by the row's number, whatever the documents are. A sequence is named
    after the smallest number of its pieces.

    Texts never cross the network: tokens are counted and their checksums taken
    where the text is read, and only lengths and checksums are shuffled.

    Defined cases: a null or empty text is the single end id; repeated rows
    and null ids are packed like any other row; an empty table gives an empty
    result; other columns are not read.
    """
    cut = materialise(pieces(docs, tokenizer_path, id_col, text_col, capacity).withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == capacity
    groups = max(1, round(cut.where(~full).count() / group_rows))
    named = F.col("row_no") * 8  # a whole window; the parts of a remainder have the numbers after it
    alone = cut.where(full).select("doc_id", "start", "length", F.get("sums", 0).alias("ids_crc32"), "doc_tokens", named.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    columns = alone.columns

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        parts, window = pack_group(pdf["length"].to_numpy(), capacity, goal)
        sizes = [equal_parts(int(n), int(k)) for n, k in zip(pdf["length"], parts, strict=True)]
        first = {k: sum(PARTS[:i]) for i, k in enumerate(PARTS)}
        out = pdf.loc[pdf.index.repeat(parts), ["doc_id", "start", "doc_tokens", "row_no"]]
        out["length"] = np.concatenate(sizes)
        out["start"] += np.concatenate([np.cumsum([0, *x[:-1]]) for x in sizes])
        out["ids_crc32"] = np.concatenate([list(s)[first[k] : first[k] + k] for s, k in zip(pdf["sums"], parts.tolist(), strict=True)])
        out["window"], out["piece_no"] = window, out["row_no"] * 8 + 1 + np.concatenate([np.arange(k) for k in parts])
        by = out.groupby("window")
        out["offset"] = by["length"].cumsum() - out["length"]
        out["sequence_id"] = by["piece_no"].transform("min")
        return out[columns]

    dealt = cut.where(~full).withColumn("group", F.pmod(F.xxhash64("row_no"), F.lit(groups)))
    return alone.unionByName(dealt.groupBy("group").applyInPandas(work, alone.schema))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents packed into sequences."""
    return pack(docs, default_tokenizer())
