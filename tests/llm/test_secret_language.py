"""Words and letter transitions that the secret scan learns from the documents."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from tidemark.llm import secret_scan

TEXTS = [
    "The harbour lights, the Harbour wall; x9harbour nine",
    "harbour master's lights été\nlights off",
    "a harbour of stone walls stone " + "stone " * 500,
    "stone lights " + "w" * 21,
    "stone, wall. harbour9 wall_walls",
    None,
    "",
]


def known_words(texts: list[str | None]) -> dict[str, int]:
    held = Counter()
    for text in texts:
        held.update({w for w in re.split(r"[\W_]+", (text or "").lower()) if re.fullmatch("[a-z]{3,20}", w)})
    return {w: n for w, n in held.items() if n >= secret_scan.KNOWN_DOCUMENTS}


def transitions(words: dict[str, int]) -> list[float]:
    seen = Counter()
    for w, n in words.items():
        for a, b in zip(w, w[1:]):
            seen[a, b] += n
    letters = [chr(97 + i) for i in range(26)]
    return [math.log((seen[a, b] + 1) / sum(seen[a, c] + 1 for c in letters)) for a in letters for b in letters]


def expected(core: str, words: dict[str, int], pairs: list[float]) -> tuple[float, float]:
    parts = re.split("[^a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", core).lower())
    low = core.lower()
    scores = [pairs[(ord(a) - 97) * 26 + ord(b) - 97] for a, b in zip(low, low[1:]) if a in "abcdefghijklmnopqrstuvwxyz" and b in "abcdefghijklmnopqrstuvwxyz"]
    return sum(len(p) for p in parts if p in words) / max(len(core), 1), sum(scores) / len(scores) if scores else -math.log(26)


def test_learned_features_equal_brute_force(spark):
    """Documents count once a word; repeated rows count each; other columns with clashing names are not read."""
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, core string, n_docs int")
    language = secret_scan.learn_language(docs)
    words = known_words(TEXTS)
    assert {r["word"]: r["n_docs"] for r in language.words.collect()} == words
    assert {"harbour", "stone", "lights"} <= set(words)
    pairs = transitions(words)
    assert language.pairs == pytest.approx(pairs)
    cores = ["harbourLights-stone", "HARBOUR", "harbourstone", "q7Zx-9K", "1234567890123456", "é-ß", "x", "", "ab" * 100_000, "stone" + "/stone" * 40]
    rows = spark.createDataFrame([(c,) for c in cores * 2], "core string")
    got = {r["core"]: (r["known"], r["transition"]) for r in secret_scan.learned_features(rows, language).collect()}
    assert set(got) == set(cores)
    for c in cores:
        assert got[c] == pytest.approx(expected(c, words, pairs)), c


def test_known_share_grows_with_the_documents(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "KNOWN_SHARE", 0.5)
    docs = spark.createDataFrame([(t,) for t in ["alpha beta"] * 4 + ["alpha"] * 6], "text string")
    assert [r["word"] for r in secret_scan.learn_language(docs).words.collect()] == ["alpha"]


def test_nothing_to_learn(spark, no_docs):
    language = secret_scan.learn_language(no_docs)
    assert language.words.count() == 0
    assert language.pairs == pytest.approx([-math.log(26)] * 676)


def test_scan_with_a_language_keeps_every_candidate_once(spark, no_docs, odd_docs):
    """The learned features change scores, never which candidates there are; copies of one secret each stay."""
    lines = ["the harbour api_key = 'a8Kd03mZqP17xVb9Lr4TnW2y' end", "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "stone lights"]
    rows = [(i, line) for i, line in enumerate(lines)] + [(0, lines[0])] * 3 + [(9, None), (None, lines[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    language = secret_scan.learn_language(docs)
    forest = secret_scan.fit_forest(secret_scan.all_findings(spark), language)
    found = secret_scan.scan_secrets(docs, forest, keep_rejected=True, language=language).collect()
    want = [(r["doc_id"], r["line_no"], r["word_no"], r["core"]) for r in secret_scan.candidates(docs).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r["doc_id"], r["line_no"], r["word_no"], r["core"]) for r in found), key=key) == sorted(want, key=key)
    score = {r["core"]: r["score"] for r in found}
    assert score["a8Kd03mZqP17xVb9Lr4TnW2y"] >= 0.5 > score["9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"]
    assert secret_scan.scan_secrets(no_docs, forest, language=language).count() == 0
    assert secret_scan.scan_secrets(odd_docs, forest, language=language).count() == 0
