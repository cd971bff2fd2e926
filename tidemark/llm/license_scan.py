"""License scans: Aho-Corasick phrases and tags, and license expressions by a shunting yard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import arrow_map, in_slices

#: Fixed by the contract: phrase and label.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Notice phrases of the method's own, with their labels and weights in the score.
NOTICE_PHRASES = (
    ("gnu general public license version 2", "gpl-2", 0.8),
    ("gnu general public license version 3", "gpl-3", 0.8),
    ("gnu general public license", "gpl", 0.6),
    ("gnu lesser general public license", "lgpl", 0.6),
    ("gnu affero general public license", "agpl", 0.6),
    ("mozilla public license", "mpl", 0.6),
    ("permission is hereby granted free of charge", "mit", 0.6),
    ("redistribution and use in source and binary forms", "bsd", 0.6),
    ("eclipse public license", "epl", 0.6),
    ("creative commons attribution", "cc-by", 0.4),
    ("all rights reserved", "all-rights-reserved", 0.3),
)
BASE_WEIGHT = 0.9
#: Licenses that a list of choices may name beyond the length of its expression. All expressions of up to 41 tokens need less.
MAX_LISTED = 65_536
TAG_WEIGHT = 0.95
TAG = "spdx-license-identifier:"
TAG_WORDS = "spdx license identifier"

Choices = frozenset[frozenset[str]]

_UPPER = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_BREAKS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
#: What a line's expression may consist of; the first other character ends it.
_EXPRESSION = re.compile(r"[ \t()A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_UPPER)


def parse_expression(tokens: list[str]) -> list[str] | None:
    """Reverse Polish form of a license expression by the shunting-yard rule; None if it is malformed.

    ``with`` binds tightest, then ``and``, then ``or``; words are lower case.
    """
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in tokens:
        if token == "(":
            if not operand_next:
                return None
            held.append(token)
        elif token == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token in _RANK:
            if operand_next:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next:
        return None
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return out


def _products(parts: list[Choices | None], most: int) -> Choices | None:
    """The choices of terms that bind together; None if listing them names more than ``most`` licenses."""
    if None in parts:
        return None
    # What leaves no choice is taken in one step, the rest one after the other.
    found = {frozenset().union(*(next(iter(p)) for p in parts if len(p) == 1))}
    for part in (p for p in parts if len(p) > 1):
        wider, size = set(), 0
        for a in found:
            for b in part:
                both = a | b
                if both not in wider:
                    wider.add(both)
                    size += len(both)
                    if size > most:
                        return None
        found = wider
    return frozenset(found)


def _exceptions(left: Choices | None, right: Choices | None, most: int) -> Choices | None:
    if left is None or right is None or sum(map(len, left)) * sum(map(len, right)) > most:
        return None
    return frozenset(frozenset(f"{x}-with-{y}" for x in a for y in b) for a in left for b in right)


def evaluate_expression(rpn: list[str], most: int = MAX_LISTED) -> Choices | None:
    """The choices that an expression leaves: each is the set of licenses that bind together.

    None if a list of them, or of a part's, names more than ``most`` licenses beyond
    the expression's own length; one of ``or`` or of ``and`` alone never does.
    """
    most += len(rpn)

    def closed(op: str, parts: list[Choices | None]) -> Choices | None:
        if len(parts) == 1:
            return parts[0]
        if op == "and":
            return _products(parts, most)
        found = None if None in parts else frozenset().union(*parts)
        return found if found is None or sum(map(len, found)) <= most else None

    # An operand is a chain of parts under one operator, so that long chains are joined once.
    stack: list[tuple[str, list[Choices | None]]] = []
    for token in rpn:
        if token not in _RANK:
            stack.append(("", [frozenset([frozenset([token])])]))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(("", [_exceptions(closed(*left), closed(*right), most)]))
            continue
        few, many = sorted((x[1] if x[0] == token else [closed(*x)] for x in (left, right)), key=len)
        many.extend(few)
        stack.append((token, many))
    return closed(*stack[0])


def expression_terms(rpn: list[str]) -> set[str]:
    """The licenses that an expression names, with their exceptions; of any length, unlike the choices."""
    stack: list[set[str]] = []
    for token in rpn:
        if token not in _RANK:
            stack.append({token})
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append({f"{x}-with-{y}" for x in left for y in right})
        else:
            left |= right
            stack.append(left)
    return stack[0]


def leading_expression(text: str) -> tuple[list[str] | None, int]:
    """The longest well-formed expression at the start of one line, and where it ends.

    One pass over the tokens: an expression may end wherever an operand or a
    closing bracket leaves no bracket open.
    """
    tokens, ends, upto, depth, operand_next = [], [], 0, 0, True
    for m in _TOKEN.finditer(text, 0, _EXPRESSION.match(text).end()):
        token = m.group().lower()
        if operand_next != (token == "(" or (token != ")" and token not in _RANK)):
            break
        depth += (token == "(") - (token == ")")
        if depth < 0:
            break
        operand_next = token == "(" or token in _RANK
        tokens.append(token)
        ends.append(m.end())
        if not operand_next and not depth:
            upto = len(tokens)
    return (parse_expression(tokens[:upto]), ends[upto - 1]) if upto else (None, 0)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in BASE_PHRASES:
        found.add_word(f" {phrase} ", (True, label, BASE_WEIGHT, phrase))
    for phrase, label, weight in NOTICE_PHRASES:
        found.add_word(f" {phrase} ", (False, label, weight, phrase))
    found.add_word(f" {TAG_WORDS} ", (None, "", 0.0, TAG_WORDS))
    found.make_automaton()
    return found


def scan(text: str, automaton: ahocorasick.Automaton) -> dict:
    """All places of one text, its labels and its score."""
    lowered = ascii_lower(text)
    joined = f" {_BREAKS.sub(' ', lowered).strip(' ')} "
    n_words = joined.count(" ") - 1 if len(joined) > 2 else 0
    starts, base, labels, miss, places = [], set(), set(), 1.0, []
    counted, at, tagged = 0, 0, False
    for end, (is_base, label, weight, phrase) in automaton.iter(joined):
        begin = end - len(phrase) - 1
        if begin + 1 < at:  # a longer phrase that began before the last one
            counted, at = 0, 0
        counted += joined.count(" ", at, begin + 1)
        at = begin + 1
        if is_base is None:
            tagged = True
            continue
        word = counted - 1
        places.append((word, phrase, label))
        labels.add(label)
        miss *= 1 - weight
        if is_base:
            starts.append(word)
            base.add(label)
    choices, expressions = [], []
    at = lowered.find(TAG) if tagged else -1
    while at >= 0:
        stop = lowered.find("\n", at)
        rpn, _ = leading_expression(lowered[at + len(TAG) : stop if stop >= 0 else len(lowered)])
        if rpn:
            terms = expression_terms(rpn)
            options = evaluate_expression(rpn)
            choices.append(None if options is None else sorted("+".join(sorted(o)) for o in options))
            expressions.append(rpn)
            labels |= terms
            miss *= 1 - TAG_WEIGHT
        at = lowered.find(TAG, at + len(TAG))
    return {
        "n_words": n_words, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1 - miss, "places": places, "choices": choices, "expressions": expressions,
    }


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<word: long, phrase: string, label: string>>, choices array<array<string>>, expressions array<array<string>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its words, the places of phrases, the labels and the score.

    A word is a run outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
    lower-cased; an automaton over the words, one blank between each two,
    finds all phrases in one pass. Identifier tags are read from the text
    itself. ``expressions`` has each tag's expression whole, in reverse Polish
    form; ``choices`` lists for each tag the sets of licenses of which one must
    be kept, and is null for a tag where ``evaluate_expression`` finds too many
    to list. The score is one minus the product of the misses of all finds.
    Everything happens where the text is read.

    Defined cases: a null or empty text has no words, empty labels, score 0
    and null for the first and last word; a malformed expression adds nothing;
    overlapping phrases all count; repeated rows each return a row; null ids
    stay; an empty table gives an empty result; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        kinds = {
            "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
            "places": pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string())])), "choices": pa.list_(pa.list_(pa.string())), "expressions": pa.list_(pa.list_(pa.string())),
        }
        for batch in in_slices(batches, 1_000):
            rows = [scan(x.as_py() or "", automaton) for x in batch.column(1)]
            for r in rows:
                r["places"] = [{"word": w, "phrase": p, "label": x} for w, p, x in r["places"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in kinds.items())], names=["doc_id", *kinds])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, work, _SCHEMA)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns, and what the method adds: all places, and for each identifier tag the choices of its expression.

    Choices are joined by ``|``, tags by a line feed; a tag whose choices are too many to list has its expression in reverse Polish form.
    """
    told = F.transform(F.arrays_zip("choices", "expressions"), lambda t: F.coalesce(F.array_join(t["choices"], "|"), F.array_join(t["expressions"], " ")))
    return result.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("places").cast("long").alias("n_places"), F.size("choices").cast("long").alias("n_tags"), F.array_join(told, "\n").alias("choices"))
