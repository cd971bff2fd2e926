"""Values at the ends of what numbers and texts can be: huge components, very long names, planted secrets."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import cover_tree, secret_scan, tile_search
from tidemark.llm.components import connected_components


def whole_top(rows, every=20, k=20):
    x = {i: [math.floor(64 * c) for c in v] for i, v in rows}
    out = []
    for q in x:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x[q], v, strict=True)), i) for i, v in x.items() if i != q)[:k]
            out += [(q, r, i, -s if abs(s) < 2**63 else None) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [[(0, [1.0, 1.0]), (1, [1e20, 1.0]), (2, [2e20, 1.0]), (3, [3e20, 1.0]), (4, [-1e20, 3.0])], [(i, [i * 2.0**50 + 1, 0.5 - i, -1e14]) for i in range(45)]])
def test_exact_search_beyond_64_bits(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cover_tree.digest(df).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in got) == whole_top(rows)


@pytest.mark.parametrize("size", [1e20, 1e150, 1e155, 1e160, 1e300, 1e-170])
def test_nearest_neighbours_of_any_size(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * size).tolist()) for i in range(60)]
    got = tile_search.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(r["query_id"] for r in got) == {0: 20, 20: 20, 40: 20}

    def product(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    vectors = dict(rows)
    for q in (0, 20, 40):
        order = sorted((i for i in vectors if i != q), key=lambda i: (lambda s: (s == s, -s if s == s else 0, i))(product(vectors[q], vectors[i])))
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == order[:20]
        assert [repr(r["score"]) for r in mine] == [repr(product(vectors[q], vectors[i])) for i in order[:20]]


#: The same values found from every secret word on, which takes the square of a name's length.
FROM_EVERY_WORD = "(?i)" + secret_scan.NAMED[secret_scan.NAMED.index("((?:") :]


def test_named_values_start_at_the_first_secret_word():
    rng = random.Random(2)
    bits = ["key", "Secret", "token", "x", "_", "-", "9", " ", "  ", "=", ":", "=>", "'", '"', "\\", "abcdef", "pa$$w0rd!", "password", "bearer ", "\t", ",", "é"]
    for _ in range(4_000):
        line = "".join(rng.choices(bits, k=rng.randint(1, 25)))
        a, b = ([(m.end(), m.groups()) for m in re.finditer(p, line)] for p in (secret_scan.NAMED, FROM_EVERY_WORD))
        assert a == b, line


def test_candidates_against_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "api_key", "=", ":", '"q7!aZ$kk"', "'two words'", "password=hunter2!x", "token:", "A" * 20, "c0ffee" * 5 + "==", "x" * 15, "secret='a b c d'", "https://a.example/bb/cccccccccccccccccc", "key="]
    docs = [(d, "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 5)))) for d in range(80)] + [(80, None), (81, ""), (None, "key='lonely!'")]
    want = Counter()
    for d, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            for w in re.split(r"[ \t\x0b\f\r]+", line):
                want.update((d, n, core) for core in re.findall(secret_scan.SHAPE, w))
            for m in re.finditer(FROM_EVERY_WORD, line):
                core = m[4] or re.sub(secret_scan.TRAIL, "", (m[5] or "") + (m[6] or ""))
                if len(core) >= secret_scan.LEAST and not re.fullmatch(secret_scan.SHAPE, core):
                    want[(d, n, core)] += 1
    got = secret_scan.candidates(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "line_no", "core").collect()
    assert Counter(tuple(r) for r in got) == want and len(want) > 100


@pytest.mark.parametrize("text", ["secret" * 200_000, "secret_-" * 100_000 + ":", "a" * 1_000_000 + "key", "key " * 200_000, "key='" + "x" * 500_000])
def test_candidates_of_very_long_texts_take_little_time(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secret_scan.candidates(df.withColumn("text", F.substring("text", 1, 50))).collect()
    began = time.time()
    secret_scan.candidates(df).agg(F.sum(F.length("core"))).collect()
    assert time.time() - began < 12  # a quadratic search takes some 45 minutes here


def test_components_of_a_large_star(spark):
    star = [(0, i) for i in range(1, 3_000)] + [(5_000 + i, 5_001 + i) for i in range(40)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(star, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(3_000)} | {5_000 + i: 5_000 for i in range(41)}
