"""Document operators against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import license_scan, line_dedup, mixing, packing, secret_scan, simhash, toxicity
from tidemark.llm.components import connected_components


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def counted(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def test_line_dedup(odd_docs, odd_rows, no_docs):
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, text, *_ in odd_rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                holders[key(line)].add(doc)
    want = []
    for doc, text, *_ in odd_rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (doc is not None and len(holders[key(x)]) >= 2 and min(holders[key(x)]) != doc)]
        want.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert counted(line_dedup.digest(line_dedup.dedup_lines(odd_docs)).collect()) == counted(want)
    assert line_dedup.dedup_lines(no_docs).count() == 0
    more = line_dedup.dedup_lines(odd_docs, min_documents=3).agg({"n_dropped": "sum"}).first()[0]
    assert 0 < more <= sum(w[2] for w in want)


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(odd_docs, odd_rows, no_docs):
    fps = [(doc, fingerprint(text)) for doc, text, *_ in odd_rows]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            least[root(i)].append(doc)
    want = counted((doc, f"{fp:016x}", min(least[root(i)], default=None)) for i, (doc, fp) in enumerate(fps))
    got = simhash.digest(simhash.near_duplicates(odd_docs)).select("doc_id", "fingerprint", "component_id")
    assert counted(got.collect()) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def clumped(n=250, seed=1):
    """Four clumps of fingerprints, each of which has up to three bits turned."""
    rng = np.random.default_rng(seed)
    fps = set()
    for base in rng.integers(0, 2**63, 4):
        for _ in range(n):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(bit)
            fps.add(x)
    return np.array(sorted(fps), np.uint64)


def links_of(f, max_bits=2):
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= max_bits
    return {tuple(sorted((int(f.view(np.int64)[i]), int(f.view(np.int64)[j])))) for i, j in zip(*np.where(near), strict=True) if i < j}


@pytest.mark.parametrize(("node_rows", "max_bits"), [(32_768, 2), (60, 2), (2, 2), (60, 0), (60, 3)])
def test_trie_join_finds_every_link(spark, node_rows, max_bits):
    f = clumped()
    table = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    rows = [tuple(sorted(r)) for r in simhash.near_pairs(table, max_bits, node_rows).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == links_of(f, max_bits)


def test_frontier_of_node_pairs(spark):
    """Node pairs of the frontier are within the budget, cover every link once, and are far from all pairs of nodes."""
    f = np.concatenate([clumped(60), np.random.default_rng(9).integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)])
    frontier = simhash.node_pairs(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), 2, 16).collect()
    whole = lambda x, d: (x & (2**64 - 1)) << (64 - d)
    for r in frontier:
        assert r["errors"] == (whole(r["a"], r["depth"]) ^ whole(r["b"], r["depth"])).bit_count() <= 2
    under = Counter()
    for r in frontier:
        under[r["depth"], r["a"], r["b"]] += 1
    depths = {r["depth"] for r in frontier}
    assert set(under.values()) == {1} and len(depths) > 1
    for x, y in links_of(f):
        at = [tuple(sorted(((v & (2**64 - 1)) >> (64 - d)) for v in (x, y))) for d in depths]
        assert sum((d, *p) in under for d, p in zip(depths, at, strict=True)) == 1
    nodes = {(r["depth"], n) for r in frontier for n in (r["a"], r["b"])}
    assert len(frontier) < len(nodes) ** 2 / 2 / 4


def test_traversal_prunes_node_pairs():
    f = np.sort(np.random.default_rng(2).integers(0, 2**63, 4096).astype(np.uint64))
    visited: list[int] = []
    found = [p for p in simhash.trie_self_join(f, np.array([[0, len(f), 0, len(f), 0]]), 63, 2, visited)]
    assert sum(len(i) for i, _ in found) == len(links_of(f)) and sum(visited) < len(f) ** 2 / 2 / 50


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(500, 500), (71, 70)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}, 70: 70, 71: 70}


def test_mixing(odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 7)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    monkeypatch.setattr(mixing, "SPARES", 3)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for _, text, _, source, *_ in odd_rows:
        totals[source] += size(text)
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    whole, full = sum(totals.values()), set()
    while True:
        left = whole - sum(3 * totals[s] for s in full)
        target = {s: 3 * totals[s] if s in full else left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * totals[s]}
        if not over:
            break
        full |= over
    rows = mixing.mix(odd_docs).collect()
    assert counted((r["doc_id"], r["size"]) for r in rows) == counted((doc, size(text)) for doc, text, *_ in odd_rows)
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert r["source_size"] == totals[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    largest = max(size(t) for _, t, *_ in odd_rows)
    assert all(abs(taken[s] - target[s]) <= largest / 2 for s in order)
    again = mixing.mix(odd_docs).collect()
    assert counted((r["doc_id"], r["taken"]) for r in again) == counted((r["doc_id"], r["taken"]) for r in rows)
    assert mixing.mix(no_docs).count() == 0


def test_pivotal_keeps_expectations():
    size, prob = np.array([5.0, 3.0, 8.0, 1.0, 2.0]), np.array([0.5, 0.25, 0.7, 0.1, 0.4])
    rng = np.random.default_rng(0)
    runs = np.array([mixing.pivotal(prob, size, rng.random(5)) for _ in range(20_000)])
    assert runs.mean(0) == pytest.approx(prob, abs=0.015)
    assert (runs @ size) == pytest.approx(prob @ size) and (((runs > 0) & (runs < 1)).sum(1) <= 1).all()


def test_packing_round_trip(odd_docs, odd_rows, no_docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    ids = {(doc, text): [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1] for doc, text, *_ in odd_rows}
    rows = packing.pack(odd_docs, path).collect()
    # Each piece has the checksum of its ids, and the pieces of a document follow on each other; rows of one id are told apart by length.
    by_doc = defaultdict(list)
    for doc, text, *_ in odd_rows:
        by_doc[doc].append(ids[doc, text])
    held = defaultdict(Counter)
    for r in rows:
        fits = [x for x in by_doc[r["doc_id"]] if len(x) == r["doc_tokens"] and packing.zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert fits and 1 <= r["length"] <= 2048 and r["start"] + r["length"] <= r["doc_tokens"]
        held[r["doc_id"], r["doc_tokens"]].update(range(r["start"], r["start"] + r["length"]))
    assert {k: set(c.values()) for k, c in held.items()} == {(doc, len(x)): {by_doc[doc].count(x)} for doc, xs in by_doc.items() for x in xs}
    assert all(set(c) == set(range(n)) for (_, n), c in held.items())
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        ends = np.cumsum([length for _, length in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    used = sum(r["length"] for r in rows)
    assert 2048 * len(windows) <= used * 1.05 + 2 * 2048
    assert packing.pack(no_docs, path).count() == 0


@pytest.mark.parametrize("text", ["ﬁ café İstanbul ΣΑΣ ² x's don't \"'s 12.3 <|endoftext|> a\x1cb é ... '' '", "A_b__c \"'s\" ’s naïve œuvre", "", "\n\t ", "straße ÀÉ İ", "日本語 テスト 123", "5€ “quoted” — dash…", "it's we'll I'M", "á b", "\x85x\xa0y", "a,b. c! (d)"])
def test_word_memory_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    for _ in range(2):
        assert packing.encode([text], path)[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def naive_differencing(lengths, windows):
    """Sums of the windows by the method's definition: the two partitions of the largest spread merge, fullest with emptiest."""
    parts = [(sorted([0] * (windows - 1) + [int(n)], reverse=True)) for n in lengths]
    order = list(range(len(parts)))
    count = len(parts)
    held = [(p[-1] - p[0], i, p) for i, p in zip(order, parts, strict=True)]
    while len(held) > 1:
        held.sort()
        (_, _, a), (_, _, b), *held = held
        merged = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        held.append((merged[-1] - merged[0], count, merged))
        count += 1
    return held[0][2]


@pytest.mark.parametrize("windows", [1, 2, 3, 7, 20])
def test_differencing_equals_its_definition(windows):
    rng = np.random.default_rng(windows)
    for n in (1, 5, 40):
        lengths = rng.integers(1, 2048, n)
        found = packing.difference(lengths, windows)
        assert sorted(np.bincount(found, lengths).astype(int).tolist(), reverse=True) == [x for x in naive_differencing(lengths, windows) if x]


def test_remainders_are_cut_only_where_padding_asks_for_it():
    small = np.random.default_rng(4).integers(1, 500, 600)
    parts, window = packing.pack_group(small)
    assert (parts == 1).all() and np.bincount(window, small).max() <= 2048
    large = np.full(99, 1364)
    parts, window = packing.pack_group(large)
    assert (parts > 1).any() and (window.max() + 1) * 2048 <= large.sum() * 1.05
    whole = np.full(100, 1024)
    assert (packing.pack_group(whole)[0] == 1).all() and packing.pack_group(np.array([2047]))[1].tolist() == [0]


def test_differencing_is_a_balanced_partition():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 512, 400)
    found = packing.balanced(lengths)
    sums = np.bincount(found, lengths)
    assert sums.max() <= 2048 and sums.sum() == lengths.sum() and sums.max() - sums.min() < 64
    assert packing.balanced(np.array([2047])).tolist() == [0]


def test_license_scan(odd_docs, odd_rows, spark, no_docs):
    extra = [
        (900, "Released UNDER the MIT-License. cc by nc by nc CC-BY-NC apache license, version 2.0"),
        (901, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\ncode"),
        (902, "under the mit licenses"), (903, "SPDX-License-Identifier: MIT OR ("), (904, "é under the mit license É"),
    ]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = []
    for doc, text in [*((r[0], r[1]) for r in odd_rows), *extra]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))
        places = [(i, label) for phrase, label in license_scan.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        want.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    found = license_scan.scan_licenses(docs).collect()
    assert counted(r[:6] for r in found) == counted(want)
    by = {r["doc_id"]: r for r in found}
    assert by[901]["choices"] == [["apache-2.0+gpl-2.0-only-with-classpath-exception-2.0", "gpl-2.0-only-with-classpath-exception-2.0+mit"]]
    assert by[903]["labels"] == "mit" and by[902]["labels"] == "" and all(0 <= r["score"] <= 1 for r in found)
    told = {r["doc_id"]: r for r in license_scan.digest(license_scan.scan_licenses(docs)).collect()}
    assert told[901]["choices"] == "|".join(by[901]["choices"][0]) and (told[901]["n_tags"], told[902]["n_tags"], told[902]["choices"]) == (1, 0, "")
    assert license_scan.scan_licenses(no_docs).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("mit", ["mit"]), ("a or b and c", ["a", "b", "c", "and", "or"]), ("( a or b ) and c", ["a", "b", "or", "c", "and"]), ("a with b or c", ["a", "b", "with", "c", "or"]), ("a or", None), ("( a", None), ("a )", None), ("a b", None), ("", None), ("( )", None)],
)
def test_shunting_yard(text, want):
    assert license_scan.parse_expression(text.split()) == want


def test_license_expressions_of_any_length():
    names = [f"lic-{i}" for i in range(400)]
    assert license_scan.leading_expression(" " + " or ".join(names) + " */")[0].count("or") == 399
    assert license_scan.leading_expression(" (mit) or")[0] == ["mit"]
    assert license_scan.leading_expression(" (mit or") == (None, 0)
    assert license_scan.expression_terms(["a", "b", "with", "c", "or"]) == {"a-with-b", "c"}
    found = license_scan.scan("SPDX-License-Identifier: " + " and ".join(names), license_scan._automaton())
    assert found["labels"] == ",".join(sorted(names)) and found["score"] > 0.9


def test_license_choices_of_long_expressions():
    names = [f"lic-{i}" for i in range(400)]
    scan = lambda text: license_scan.scan("SPDX-License-Identifier: " + text, license_scan._automaton())
    assert scan(" or ".join(names))["choices"] == [sorted(names)]
    assert scan(" and ".join(names))["choices"] == [["+".join(sorted(names))]]
    assert scan(" or ".join(names) + " and extra")["choices"] == [sorted([*names[:-1], "extra+lic-399"])]
    pairs = " and ".join(f"(a{i} or b{i})" for i in range(40))
    found = scan(pairs + "\nSPDX-License-Identifier: mit")
    assert found["choices"] == [None, ["mit"]] and found["labels"].count(",") == 80
    assert found["expressions"] == [license_scan.parse_expression(re.findall(r"[()]|\w+", pairs)), ["mit"]]


def test_license_choices_equal_brute_force():
    import random

    def brute(rpn):
        stack = []
        for token in rpn:
            if token not in ("or", "and", "with"):
                stack.append({frozenset([token])})
                continue
            right, left = stack.pop(), stack.pop()
            stack.append(left | right if token == "or" else {a | b if token == "and" else frozenset(f"{x}-with-{y}" for x in a for y in b) for a in left for b in right})
        return stack[0]

    rng = random.Random(3)

    def made(n):
        if n == 1:
            return [rng.choice("abcdefghij")]
        k = rng.randint(1, n - 1)
        return [*made(k), *made(n - k), rng.choice(["or", "and", "or", "and", "or", "and", "with"])]

    for _ in range(400):
        rpn = made(rng.randint(1, 14))
        assert license_scan.evaluate_expression(rpn) == brute(rpn), rpn


def test_secret_scan(spark, odd_docs, no_docs):
    forest = secret_scan.fit_forest(secret_scan.labelled_findings(spark))
    hidden = "9f14a7029c8514dfe98aba92898d323168e199da"
    rows = [
        (1, f'some prose here token = "{hidden}" and more prose'), (2, f"commit {hidden} of the revision"), (3, "a thonoringatherenand thingathereonoring word"),
        (4, f"API_KEY={hidden.upper()}!!"), (5, None), (6, ""), (7, "https://www.example.com/about/the_example_page_name.html"), (1, f'some prose here token = "{hidden}" and more prose'),
    ]
    found = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), forest).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 1, 4] and all(r["core"].lower() == hidden for r in found)
    assert secret_scan.scan_secrets(no_docs, forest).count() == 0
    assert secret_scan.scan_secrets(odd_docs, forest).count() == 0


def test_secret_scan_of_short_and_broken_values(spark):
    """Values of any characters after a name; one that is just a run is found once, and words after a name are not kept."""
    forest = secret_scan.fit_forest(secret_scan.all_findings(spark))
    hidden = "9f14a7029c8514dfe98aba92898d323168e199da"
    true = [
        ('password = "Tr0ub4dor&3"', 2, "Tr0ub4dor&3"), ("db:\t API_KEY=Zk3.91xQ!7vB$2, rest", 1, "Zk3.91xQ!7vB$2"), ("token: ab12cd34.ef56gh78.ij90", 1, "ab12cd34.ef56gh78.ij90"),
        ("one\ntwo pwd=x7Kq9Lm2", 1, "x7Kq9Lm2"), ("secret = 'we ird\t7#kQ!z 99' tail", 2, "we ird\t7#kQ!z 99"), (f'token = "{hidden}"', 2, hidden), ("Authorization: Bearer aB3.dE5-fG7_hI9.jK1", 2, "aB3.dE5-fG7_hI9.jK1"),
    ]
    false = ["author: Jonathan wrote it", "the key: something important", 'password: "please enter your password"', "token = get_token()", "key: 2024-01-02", 'keyword = "abc", name = "defghij"', "auth: user@mail.example.com"]
    rows = [*enumerate(t for t, _, _ in true), *enumerate(false, 100)]
    found = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), forest).collect()
    assert sorted((r["doc_id"], r["word_no"], r["core"]) for r in found) == [(i, at, core) for i, (_, at, core) in enumerate(true)]


def test_toxicity_learns_marks_and_offsets(spark, no_docs):
    import random

    rng = random.Random(1)
    plain = ["wind", "water", "stone", "river", "cloud", "green", "table", "paper"]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["Blorfing", "blorfed", "GRUMPTH"]))
        docs.append((i, " ".join(words)))
        labels.append((i, i % 2, int(i % 4 == 0)))
    docs += [(None, None), (1000, ""), (1001, "stone blorfish river"), (1002, "\u0130stanbul \u0130 stone Blorfing blorfed river"), (1003, "stone " * 60_000 + "blorfing"), docs[0], docs[0]]
    frame = spark.createDataFrame([(*d, 1, 0.5, "x") for d in docs], "doc_id long, text string, toxic int, score double, spans string")
    model = toxicity.fit(frame, spark.createDataFrame([*labels, (7, 1, None), (8, None, 1)], "doc_id long, quality int, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(frame, model).collect()}
    assert all((found[i]["score"] >= 0.3) == (i % 4 == 0) for i in range(400))
    spans = found[0]["spans"]
    assert {w for s in spans for w in docs[0][1][s["start"] : s["end"]].lower().split()} <= {"blorfing", "blorfed", "grumpth"} and spans
    assert 0 <= found[None]["score"] < 0.3 and 0 <= found[1000]["score"] < 0.3
    assert [docs[403][1][s["start"] : s["end"]] for s in found[1002]["spans"]] == ["Blorfing blorfed"]
    assert [(s["start"], s["end"]) for s in found[1003]["spans"]] == [(360_000, 360_008)]
    told = [r for r in toxicity.digest(toxicity.score_toxicity(frame, model)).collect()]
    assert len(told) == len(docs) and sum(r["doc_id"] == 0 for r in told) == 3 and not any(r["held_out"] for r in told if r["doc_id"] is None)
    assert {r["spans"] for r in told if r["doc_id"] == 1002} == {"17-33"}
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    assert toxicity.fit(no_docs, spark.createDataFrame([], "doc_id long, toxic int")) is None


def test_settled_chain_equals_the_whole_chain():
    model = toxicity.ToxicModel({"=bad": 6.0, "=meh": 2.0}, -3.0, np.array([[1.0, -1.0], [0.2, -0.5]]), np.zeros(2))
    scorer = toxicity.Scorer(model)
    words = ["a"] * 100 + ["bad", "meh"] + ["a"] * 70 + ["meh"] + ["a"] * 90 + ["bad"]
    e = np.array([[model.bias + model.emission(w) for w in words]])
    whole = toxicity.forward_backward(e, model.trans, np.zeros(2), np.zeros(2))[0][0]
    best, total, n, _ = scorer.document(" ".join(words))
    assert n == len(words) and best == pytest.approx(whole.max(), abs=1e-9)
    assert total == pytest.approx(whole.sum(), abs=1e-7)
    bare = np.full((1, 300), model.bias)
    assert scorer.document("a " * 300)[1] == pytest.approx(forward_sum(bare, model), abs=1e-7)


def forward_sum(e, model):
    return toxicity.forward_backward(e, model.trans, np.zeros(2), np.zeros(2))[0].sum()


def test_crf_gradient_counts():
    rng = np.random.default_rng(0)
    e, trans = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    m, pairs, log_z = toxicity.forward_backward(e, trans, np.zeros(2), np.zeros(2))
    import itertools

    for s in range(3):
        scores = {y: sum(e[s, t] * y[t] for t in range(5)) + sum(trans[y[t], y[t + 1]] for t in range(4)) for y in itertools.product((0, 1), repeat=5)}
        z = np.logaddexp.reduce(list(scores.values()))
        assert log_z[s] == pytest.approx(z)
        assert m[s] == pytest.approx([sum(np.exp(v - z) for y, v in scores.items() if y[t]) for t in range(5)])
    assert pairs.sum() == pytest.approx(12)
