"""Secret scans: candidates by shape and by name, false positives removed by a random forest; DataFrame operations only."""

from __future__ import annotations

import json
import math
import random
import re
import string
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

#: A candidate is a run of these characters, at least so long.
SHAPE = r"[A-Za-z0-9_+/\-]{16,}={0,2}"
#: Words before and after a candidate that the forest sees.
BEFORE, AFTER = 3, 2
THRESHOLD = 0.5
TREES, DEPTH, SEED = 40, 8, 17
#: Labelled findings that the built-in generator makes.
FINDINGS = 4_000

SECRET_WORDS = "key|secret|token|passw|pwd|credential|auth|bearer|private|signature"
HARMLESS_WORDS = "commit|sha|md5|checksum|hash|revision|digest|uuid|etag|order|card|phone|isbn|tracking|page|mail|version|build"
#: Values of any characters are candidates as well where a name of a secret is assigned one of at least so many characters.
LEAST = 6
#: Group 1 is what comes before the value, with its quote; the value is group 4 in quotes, else group 5 or 6 (a quote without end).
#: A name is searched from its beginning, once, for its first secret word: what stands before that is not looked at again,
#: so that the search takes time in proportion to the text, however long a name is.
NAMED = (
    rf"(?i)(?<![A-Za-z0-9_\-])(?>[A-Za-z0-9_\-]*?(?={SECRET_WORDS}))((?:{SECRET_WORDS})[A-Za-z0-9_\-]*+[\"'`]?[ \t]*+(?::=|=>|==|[:=])[ \t]*+(?:(?:bearer|basic|token)[ \t]++)?+([\"'`]?))"
    rf"(?:(?<=([\"'`]))((?:(?!\3)[^\\]|\\.){{{LEAST}}}.*?)(?<!\\)(?=\3)|(?<![\"'`])([^\s\"'`]\S{{{LEAST - 1},}})|(?<=[\"'`])([^\s\"'`]{{{LEAST},}}))"
)
#: What ends an unquoted value without being part of it.
TRAIL = r"[\"'`,.;:!?)\]}>*#]+$"
BLANKS = r"[ \t\x0b\f\r]+"

DICTIONARY = "about|access|account|address|after|also|example|and|are|because|been|before|between|change|client|code|company|could|data|dummy|file|first|for|from|group|have|here|house|image|index|information|insert|internal|international|into|just|know|like|made|make|model|more|name|number|only|order|other|over|page|part|people|place|point|private|public|report|sample|server|service|should|some|state|system|test|than|that|the|their|there|these|they|thing|this|time|token|update|user|value|very|water|when|which|with|work|world|would|year|your"
BIGRAMS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|le|de|la|ng|io|ie|ch|qu|ou"

#: A word of a corpus is known where at least so many documents hold it, and at least such a share of them.
KNOWN_DOCUMENTS, KNOWN_SHARE = 3, 1e-5
LETTERS = 26

FEATURES = ("len", "digits", "uppers", "vowels", "switches", "variety", "repeats", "bigrams", "coverage", "hex_only", "symbols", "blanks", "path", "mail", "quoted", "assigned", "secret_near", "harmless_near")

#: What a corpus adds to these: the share of the candidate in known words, the mean log probability of its letter pairs.
LEARNED = ("known", "transition")


@dataclass(frozen=True)
class Language:
    """What a corpus says of its words: ``word, n_docs`` of all known ones, and a log probability for each pair of letters."""

    words: DataFrame
    pairs: list[float]


def learn_language(docs: DataFrame, text_col: str = "text") -> Language:
    """Known words and letter transitions of all documents and whole texts.

    A word is a run of 3 to 20 letters a-z, lower-cased, between characters
    that are no letters or digits. A document counts once for each of its
    words, so that a long or repetitive one weighs no more than others; counts
    are added up where they are before they are shuffled. Transitions come
    from the different words, each weighing as its documents. They are 26 x 26
    numbers at any size, and all that goes to the driver; the words stay a
    table. Null and empty texts have no words; without words no word is known
    and all transitions are equally likely.
    """
    held = F.array_distinct(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"))
    rows = docs.select(F.explode(held).alias("word")).where(F.col("word").rlike("^[a-z]{3,20}$"))
    counted = materialise(rows.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs")), "words")
    least = max(KNOWN_DOCUMENTS, KNOWN_SHARE * docs.count())
    words = counted.where(F.col("n_docs") >= least)
    code = F.ascii(F.substring("word", F.col("i"), F.lit(1))) - ord("a")
    after = F.ascii(F.substring("word", F.col("i") + 1, F.lit(1))) - ord("a")
    places = words.select("word", "n_docs", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    seen = {(r["a"], r["b"]): r["n"] for r in places.groupBy(code.alias("a"), after.alias("b")).agg(F.sum("n_docs").alias("n")).collect()}
    pairs = []
    for a in range(LETTERS):
        row = [seen.get((a, b), 0) + 1 for b in range(LETTERS)]
        pairs += [math.log(n / sum(row)) for n in row]
    return Language(words, pairs)


def learned_features(cores: DataFrame, language: Language) -> DataFrame:
    """``core, known, transition`` for each different ``core``.

    Words within a candidate end at other characters and where a capital
    follows a small letter. A candidate without two letters in a row has the
    transition of evenly likely letters.
    """
    cores = cores.select("core").distinct()
    parts = F.split(F.lower(F.regexp_replace("core", "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+")
    each = cores.select("core", F.explode(F.filter(parts, lambda x: F.length(x).between(3, 20))).alias("word"))
    covered = each.join(language.words.select("word"), "word").groupBy("core").agg(F.sum(F.length("word")).alias("covered"))
    codes = F.transform(F.split(F.lower("core"), ""), lambda c: F.when(c.between("a", "z") & (F.length(c) == 1), F.ascii(c) - ord("a")))
    table = F.lit(language.pairs)
    two = F.zip_with("codes", F.slice("codes", F.lit(2), F.greatest(F.size("codes") - 1, F.lit(0))), lambda a, b: F.get(table, a * LETTERS + b))
    scored = cores.select("core", codes.alias("codes")).select("core", F.filter(two, lambda x: x.isNotNull()).alias("scores"))
    mean = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores")
    scored = scored.select("core", F.when(F.size("scores") > 0, mean).otherwise(-math.log(LETTERS)).alias("transition"))
    known = F.coalesce(F.col("covered"), F.lit(0)) / F.greatest(F.char_length("core"), F.lit(1))
    return scored.join(covered, "core", "left").select("core", known.alias("known"), "transition")


def with_learned(rows: DataFrame, language: Language | None) -> DataFrame:
    """``rows`` with the learned features of their ``core``; as they are without a language.

    They are found once for each different candidate and joined back; a
    candidate that many rows share meets one row, so such a join can be split.
    """
    if language is None:
        return rows
    rows = materialise(rows, "secret-candidates")
    return rows.join(learned_features(rows, language), "core")


def features(before: Column, word: Column, core: Column, after: Column) -> dict[str, Column]:
    """What the forest sees of one candidate: its length, character transitions, dictionary coverage, path and neighbours."""
    n = F.char_length(core).cast("double")
    low = F.lower(core)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    at = F.instr(word, core)
    head = F.lower(F.concat_ws(" ", before, F.substring(word, F.lit(1), F.greatest(at - 1, F.lit(0)))))
    return {
        "len": F.least(n, F.lit(200.0)),
        "digits": count(core, "[0-9]") / n,
        "uppers": count(core, "[A-Z]") / n,
        "vowels": count(low, "[aeiou]") / n,
        "switches": count(core, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])") / n,
        "variety": F.size(F.array_distinct(F.split(core, ""))).cast("double") / F.least(n, F.lit(64.0)),
        "repeats": count(low, r"(.)\1\1") / n,
        "bigrams": count(low, BIGRAMS) / n,
        "coverage": (n - F.char_length(F.regexp_replace(low, DICTIONARY, ""))) / n,
        "hex_only": flag(low.rlike("^[0-9a-f]+$")),
        "symbols": count(core, r"[^A-Za-z0-9_\s]") / n,
        "blanks": F.least(count(core, r"\s"), F.lit(5.0)),
        "path": F.least(count(word, r"[/\\]|://|\.[a-z]{2,4}\b"), F.lit(5.0)),
        "mail": flag(word.contains("@")),
        "quoted": flag(word.rlike("[\"'`]")),
        "assigned": flag(head.rlike(r"[=:]\s*[\"'`]?\s*$")),
        "secret_near": flag(head.rlike(SECRET_WORDS)),
        "harmless_near": flag(F.concat_ws(" ", head, F.lower(after)).rlike(HARMLESS_WORDS)),
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``before, word, after, label``: findings made by rule, with their verdicts.

    Credentials of common formats stand in assignments; look-alikes are digests
    and ids named as such, placeholders, long words, paths and addresses. Every
    choice follows from a hash of the row number, so the table is the same in
    every run.
    """
    pick = lambda salt, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(values))) + 1).cast("int"))
    hexed = lambda salt, size: F.substring(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512), 1, size)
    mixed = lambda salt, size: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512))), "[+/=]", ""), 1, size)
    name = pick("name", "token", "api_key", "apikey", "secret", "access_token", "client_secret", "password", "auth_token", "TOKEN", "SECRET_KEY", "private_key")
    value = F.element_at(
        F.array(hexed("a", 40), hexed("b", 32), hexed("c", 64), mixed("d", 40), mixed("e", 24), mixed("f", 64), F.concat(F.lit("AKIA"), F.upper(mixed("g", 16))), F.concat(F.lit("ghp_"), mixed("h", 36)), F.upper(hexed("i", 40)), F.concat(F.lit("sk_live_"), mixed("j", 24))),
        (F.pmod(F.xxhash64(F.lit("value"), "id"), F.lit(10)) + 1).cast("int"),
    )
    quote = pick("quote", '"', "'", "", '"')
    end = pick("end", "", ";", ",", "###", "!!", "***", ".")
    lead, tail = pick("lead", "the and of", "in with by", "le de la", "und die der", "el de la", ""), pick("tail", "the of", "and in", "de la", "", "else return")
    syllables = F.concat(*[pick(f"s{i}", "th", "er", "on", "in", "ti", "an", "en", "re", "at", "or", "hea", "ble", "ing", "ness", "ch", "ou", "eau", "ment", "ion", "keit") for i in range(9)])
    size = (F.pmod(F.xxhash64(F.lit("size"), "id"), F.lit(16)) + 16).cast("int")
    plain = F.col("plain")
    cased = F.element_at(F.array(plain, F.initcap(plain), F.upper(plain)), (F.pmod(F.xxhash64(F.lit("case"), "id"), F.lit(3)) + 1).cast("int"))
    words = F.concat_ws("_", *[pick(f"w{i}", "your", "token", "here", "example", "insert", "value", "test", "user", "sample", "data", "server", "name") for i in range(5)])
    digest = F.element_at(F.array(hexed("k", 40), hexed("l", 32), hexed("m", 64), F.concat_ws("-", hexed("n", 8), hexed("o", 4), hexed("p", 4), hexed("q", 4), hexed("r", 12))), (F.pmod(F.xxhash64(F.lit("digest"), "id"), F.lit(4)) + 1).cast("int"))
    number = F.lpad(F.abs(F.xxhash64(F.lit("number"), "id")).cast("string"), 16, "4")
    made = {"name": name, "value": value, "quote": quote, "end": end, "lead": lead, "tail": tail, "syllables": cased, "words": F.col("words"), "digest": digest, "number": number}
    made |= {"harmless": pick("harmless", "commit", "sha1", "checksum:", "revision", "md5 =", "digest", "uuid:", "etag =", "build"), "filler": F.repeat(pick("x", "x", "0", "*", "a"), 24)}
    made |= {"k4": F.pmod(F.xxhash64(F.lit("k4"), "id"), F.lit(4)), "k8": F.pmod(F.xxhash64(F.lit("k8"), "id"), F.lit(8))}
    # One bounded partition; each exchange also keeps its parts out of one huge generated function.
    rows = spark.range(n).select("id", F.substring(syllables, F.lit(1), size).alias("plain"), words.alias("words")).repartition(1)
    rows = rows.select("id", *[c.alias(k) for k, c in made.items()]).repartition(1)
    name, value, quote, end, lead, tail, syllables, words, digest, number, harmless, filler = (F.col(c) for c in ("name", "value", "quote", "end", "lead", "tail", "syllables", "words", "digest", "number", "harmless", "filler"))
    true = F.struct(
        F.element_at(F.array(F.concat_ws(" ", lead, name, F.lit("=")), F.concat_ws(" ", lead, F.concat(name, F.lit(":"))), F.concat_ws(" ", lead, F.lit("Authorization: Bearer")), lead), (F.col("k4") + 1).cast("int")).alias("before"),
        F.when(F.col("k4") == 3, F.concat(name, F.lit("="), quote, value, quote, end)).otherwise(F.concat(quote, value, quote, end)).alias("word"),
        tail.alias("after"),
    )
    false = F.element_at(
        F.array(
            F.struct(F.concat_ws(" ", lead, harmless).alias("before"), F.concat(quote, digest, quote, end).alias("word"), tail.alias("after")),
            F.struct(lead.alias("before"), F.concat(syllables, end).alias("word"), tail.alias("after")),
            F.struct(F.concat_ws(" ", lead, name, F.lit("=")).alias("before"), F.concat(quote, words, quote, end).alias("word"), tail.alias("after")),
            F.struct(lead.alias("before"), F.concat(F.substring(number, 1, 16), end).alias("word"), tail.alias("after")),
            F.struct(lead.alias("before"), F.concat(F.substring(syllables, 1, 18), F.lit(".41@mail.example.com"), end).alias("word"), tail.alias("after")),
            F.struct(lead.alias("before"), F.concat(F.lit("https://www.example.com/"), F.substring(syllables, 1, 9), F.lit("/"), words, F.lit(".html")).alias("word"), tail.alias("after")),
            F.struct(F.concat_ws(" ", lead, name, F.lit("=")).alias("before"), F.concat(quote, filler, quote, end).alias("word"), tail.alias("after")),
            F.struct(F.concat_ws(" ", lead, name, F.lit("=")).alias("before"), F.concat(quote, syllables, quote, end).alias("word"), tail.alias("after")),
        ),
        (F.col("k8") + 1).cast("int"),
    )
    return rows.select(F.when(F.col("id") % 2 == 0, true).otherwise(false).alias("x"), (1 - F.col("id") % 2).cast("double").alias("label")).repartition(1).select("x.*", "label")


def labelled_values(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``before, word, core, after, label``: assigned values that are no plain run, made by rule as in ``labelled_findings``.

    Passwords and keys are short, or broken by other characters; look-alikes
    after the same names are words, phrases, placeholders, code, dates, versions
    and addresses. The rows are made here and go into the plan as one literal.
    """
    rng = random.Random(SEED)
    sounds = "th er on in ti an ra re bo mo hea ble ing ness ch lu eau ment ka dor".split()
    spoken = "your password here please enter value the user main point which server name und les para".split()
    names = "password passwd pwd secret token api_key key client_secret auth PASSWORD db_password credentials private_key".split()
    word = lambda k: "".join(rng.choice(sounds) for _ in range(k))
    say = lambda: rng.choice(spoken)
    sign = lambda: rng.choice("!$@#%&*.?^-_")
    mixed = lambda a, b: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(a, b)))
    hexed = lambda a, b: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(a, b)))
    two, four = lambda: f"{rng.randint(10, 99)}", lambda: f"{rng.randint(1000, 9999)}"
    true = (
        lambda: word(3).capitalize().translate(str.maketrans("aeot", "4307")) + sign() + two(), lambda: mixed(3, 8) + sign() + mixed(6, 35), lambda: mixed(3, 8) + sign() + mixed(8, 14) + sign() + two(),
        lambda: word(4).capitalize() + four() + sign() + two(), lambda: f"{mixed(8, 14)}.{mixed(6, 35)}.{hexed(10, 15)}", lambda: mixed(8, 14) + sign() + four(), lambda: mixed(7, 14) + two()[0], lambda: "7" + hexed(9, 14),
        lambda: word(3) + sign() + word(4) + sign() + four(), lambda: f"{mixed(3, 7)} {sign()}{mixed(3, 8)} {two()}",
    )
    false = (
        lambda: word(4), lambda: word(3).capitalize(), lambda: " ".join(say() for _ in range(4)), lambda: rng.choice(" .-/").join(say() for _ in range(3)), lambda: f"{word(4).capitalize()}, {word(3)} {say()}",
        lambda: word(3) + rng.choice([".", "()", "[0].", "->", "::"]) + say() + rng.choice(["()", "", "_id", "[1]", "(x)"]), lambda: rng.choice(["${", "<", "{{", "%("]) + f"{word(3)}_{say()}".upper() + rng.choice(["}", ">", "}}", ")s"]),
        lambda: f"20{two()}" + rng.choice(["-01-", "/11/", ".7.", ":30:"]) + two(), lambda: word(3) + rng.choice(["@mail.example.com", "@example.org", ".example.com/index.html", ".html", "********"]), lambda: rng.choice("*x.0-") * rng.randint(6, 15),
    )
    rows = []
    for i in range(n):
        core = rng.choice(false if i % 2 else true)()
        quote = rng.choice(["\"", "'", "\""] if " " in core else ["\"", "'", "\"", ""])
        head = rng.choice(["", "the and of ", "in with by ", "le de la ", "und die der "]) + rng.choice(names) + rng.choice([" = ", "=", ": ", ":", " : ", "= "])
        before, _, lead = head.rpartition(" ")
        if len(core) >= LEAST and not re.fullmatch(SHAPE, core):
            rows.append({"before": before, "word": lead + quote + core + quote, "core": core, "after": rng.choice(["the of", "and in", "de la", ""]), "label": 1.0 - i % 2})
    made = F.from_json(F.lit(json.dumps(rows)), "array<struct<before: string, word: string, core: string, after: string, label: double>>")
    return spark.range(1).select(F.inline(made))


def all_findings(spark: SparkSession) -> DataFrame:
    return labelled_findings(spark).withColumn("core", F.lit(None).cast("string")).unionByName(labelled_values(spark)).select("before", "word", "core", "after", "label")


def fit_forest(findings: DataFrame, language: Language | None = None) -> PipelineModel:
    """A random forest on labelled findings (``before, word, after, label``), in one partition for one order of rows.

    The candidate is the first run of a word, or what the column ``core`` has.
    A forest that learned with a ``language`` needs one when it scans.
    """
    core = F.regexp_extract("word", SHAPE, 0)
    if "core" in findings.columns:
        core = F.coalesce("core", core)
    rows = findings.withColumn("core", core).where(F.col("core") != "").repartition(1)
    rows = rows.select("label", "core", *[c.alias(n) for n, c in features(F.col("before"), F.col("word"), F.col("core"), F.col("after")).items()])
    rows = with_learned(rows, language)
    inputs = [*FEATURES, *(LEARNED if language else ())]
    rows = rows.select("label", *inputs).repartition(1)
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"),
        RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED),
    ]
    return Pipeline(stages=stages).fit(rows.sortWithinPartitions("label", *inputs))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, word_no, before, word, core, after`` for each candidate.

    Candidates are all runs of ``SHAPE``, and all values of ``NAMED`` that are
    not just such a run. Documents without a candidate go first, then lines;
    only the words of the lines that remain are exploded, and nothing is
    shuffled.
    """
    either = F.col("text").rlike(SHAPE) | F.col("text").rlike(NAMED)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(either)
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    runs, named = F.col("line").rlike(SHAPE), F.col("line").rlike(NAMED)
    lines = lines.select("*", runs.alias("runs"), named.alias("named")).where("runs or named")
    near = lambda first, many: F.array_join(F.slice("words", F.greatest(first, F.lit(1)), F.greatest(many, F.lit(0))), " ")
    none = F.lit("")
    every = lambda i: F.regexp_extract_all("line", F.lit(NAMED), F.lit(i))
    blanks = lambda x: F.regexp_count(x, F.lit(BLANKS))
    parts = lines.select("doc_id", "line_no", "runs", F.split("line", BLANKS, -1).alias("words"), *[F.when(F.col("named"), x).otherwise(F.array().cast("array<string>")).alias(k) for k, x in {"gaps": F.split("line", NAMED, -1), "whole": every(0), "head": every(1), "quoted": every(4), "open": every(5), "rest": every(6)}.items()])
    # Blanks up to each assignment: those of all gaps and assignments before it, and of its own gap and head.
    steps = F.transform("whole", lambda x, i: blanks(F.concat(F.get("gaps", i), F.lit("|"), x)))
    parts = parts.withColumn("steps", steps)
    value = lambda i: F.when(F.get("quoted", i) != "", F.get("quoted", i)).otherwise(F.regexp_replace(F.concat(F.get("open", i), F.get("rest", i)), TRAIL, ""))
    start = lambda i: F.aggregate(F.slice("steps", F.lit(1), i), F.lit(0), lambda a, x: a + x) + blanks(F.concat(F.get("gaps", i), F.lit("|"), F.get("head", i)))
    assigned = F.transform("whole", lambda x, i: F.struct(start(i).alias("at"), F.regexp_extract(F.get("head", i), r"\S*$", 0).alias("lead"), value(i).alias("core")))
    assigned = F.filter(assigned, lambda x: (F.char_length(x["core"]) >= LEAST) & ~x["core"].rlike(f"^{SHAPE}$"))
    plain = F.when(F.col("runs"), F.filter(F.transform("words", lambda x, i: F.struct(i.alias("at"), x.alias("word"), none.alias("core"))), lambda x: x["word"].rlike(SHAPE)))
    plain = F.coalesce(plain, F.array().cast("array<struct<at:int,word:string,core:string>>"))
    assigned = F.transform(assigned, lambda x: F.struct(x["at"].alias("at"), F.concat(x["lead"], x["core"], F.regexp_extract(x["lead"], "[\"'`]$", 0)).alias("word"), x["core"].alias("core")))
    found = parts.select("doc_id", "line_no", "words", F.explode(F.concat(plain, assigned)).alias("hit")).select("doc_id", "line_no", "words", "hit.*")
    at, inner = F.col("at"), blanks(F.col("core"))
    return found.select(
        "doc_id", "line_no", at.alias("word_no"), "word",
        near(at + 1 - BEFORE, F.least(at, F.lit(BEFORE))).alias("before"),
        near(at + 2 + inner, F.lit(AFTER)).alias("after"),
        F.explode(F.when(F.col("core") == "", F.regexp_extract_all("word", F.lit(f"({SHAPE})"), 1)).otherwise(F.array("core"))).alias("core"),
    )


def scan_secrets(docs: DataFrame, forest: PipelineModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep_rejected: bool = False, language: Language | None = None) -> DataFrame:
    """``doc_id, line_no, word_no, core, score`` for each finding that the forest keeps.

    With a ``language``, the one that the forest has learned with, candidates
    are written once and judged by the corpus's own words and transitions too.

    Lines and words count from 0; the score is the forest's probability. A
    value in quotes may hold blanks and is at the word where it begins; an
    unquoted one ends at a blank, without the marks of ``TRAIL``. Runs within a
    broken value are findings of their own where the forest keeps them.

    Defined cases: null, empty and candidate-free texts give no rows; repeated
    rows each give their findings; a null id is kept; a word may give several
    findings; a text of any length is searched whole, in time in proportion to
    its length (and to the square of the assignments in one line); an empty
    table gives an empty result; other columns are not read.
    """
    rows = candidates(docs, id_col, text_col)
    made = features(F.col("before"), F.col("word"), F.col("core"), F.col("after"))
    judged = with_learned(rows.select("doc_id", "line_no", "word_no", "core", *[c.alias(n) for n, c in made.items()]), language)
    scored = forest.transform(judged)
    scored = scored.select("doc_id", "line_no", "word_no", "core", F.get(vector_to_array("probability"), 1).alias("score"))
    return scored if keep_rejected else scored.where(F.col("score") >= threshold)


def digest(result: DataFrame) -> DataFrame:
    """Findings without the secrets themselves: their length and SHA-256."""
    return result.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("word_no").cast("long").alias("word_no"), F.char_length("core").cast("long").alias("length"), F.sha2(F.col("core").cast("binary"), 256).alias("secret_sha256"), "score")
