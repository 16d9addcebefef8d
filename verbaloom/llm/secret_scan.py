"""Secret scan whose false positives are removed by a random forest.

Candidates of a text are runs without space or quote that hold a digit and are
``MIN_LENGTH`` long, and values of assignments; also what lies in one of these as the value of a
name (``env:KEY=…``, ``?key=…&``), after a ``?``, or as user or password before an ``@``.  All
are judged.  Of candidates that overlap the innermost that the forest takes for secrets are
findings, and where it takes none, the outermost is one that is no secret.  Each is described by its length, its character
classes and transitions, how much of it dictionary words cover, whether it lies in a path or
address, and the words on both sides of it, each with the log odds that half of the labelled
findings give it.  A random forest fitted on the other half keeps or rejects it.

Words are counted over all documents, by language, and stored as a table.  Character transitions are
those of all words, with characters beyond ``LAST_LETTER`` as one, which bounds their number.  The
dictionary is the words that are in a ``SHARE`` of the documents of a language, whatever their
number: a document with w different words of its own adds up to at most w / SHARE such words,
so there are no more than the mean of w over SHARE in a language at any size.  Languages with less than a
``MINOR`` part of all documents are counted as one.  The
forest is fitted by Spark, saved to the shared folder and its nodes read back, so a text is
scanned, judged and redacted in one pass without a shuffle.

Defined cases: null text has no findings and stays null.  Findings do not overlap; positions
count code points from 0.  Repeated rows get the same findings each.  A null language is one of its
own.  An empty table gives an empty result, and an empty corpus an empty dictionary.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from verbaloom.llm.common import free_name, in_slices, shared_folder, stored, table
from verbaloom.llm.labelled_findings import labelled_findings

#: A dictionary word is in this share of a language's documents, and in ``LEAST`` of them at least.
SHARE, LEAST = 1 / 2_000, 2
#: Share of all documents below which languages are counted together.
MINOR = 1 / 1_000
#: Letters of a word; longer runs of letters are none.
WORD_LETTERS = (4, 40)
LAST_LETTER = "\u024f"
#: Labelled findings that odds and forest are fitted on.
MAX_LABELLED = 4_000
#: Words before and after a candidate that count, within so many characters of its line.
BEFORE, AFTER, NEAR = 3, 2, 24
TREES, DEPTH, SEED = 40, 8, 5
MIN_LENGTH, MIN_ASSIGNED = 12, 8
MASK = "[SECRET]"
EDGE = "\\s\"'`<>|,;()\\[\\]{}"
DIGIT_RUN = re.compile(r"[0-9]+")
TO_LEFT, TO_RIGHT = re.compile(rf"[{EDGE}=]"), re.compile(rf"[^{EDGE}]*")
ASSIGNMENT = re.compile(rf"[:=]\s{{0,3}}[\"']?([^{EDGE}]{{{MIN_ASSIGNED},}})")
NEIGHBOUR = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
FILLER = re.compile(r"your|example|xxxx|change|dummy|sample|insert|placeholder|redact|here|test|environ|\.env\.|1234|0000", re.I)
ADDRESS = re.compile(r"://|^www\.|^\.{0,2}/|^[A-Za-z]:[/\\]|\.(?:html?|py|js|java|txt|parquet|png|css)\b|@", re.I)
#: Where the value of a name starts inside a candidate, or what stands behind a question mark.
INNER_START = re.compile(r"(?:(?<=[?&;:/#@])|^)(?:[A-Za-z_][\w.%-]{0,60}=|[A-Za-z_-]{1,30}:)|(?<=\?)")
USER_INFO = re.compile(r"(?<=//)([^/@:?#]*+)(?::([^/?#]*))?@")
BARE_USER = re.compile(r"([^/@:?#]*+):([^/?#]*)@(?=[\w-]+(?:\.[\w-]+)+|localhost\b)")
LETTERS = re.compile(r"[^\W\d_]{4,}")


def _trimmed(text: str, start: int, end: int, least: int) -> tuple[int, int]:
    while end - start > least and text[end - 1] in ".!?:*#$%&":
        end -= 1
    return start, end


def _found(text: str) -> list[tuple[int, int]]:
    """(start, end) of assigned values and of runs with digits in order; where two overlap, one lies in the other."""
    found = []
    for match in ASSIGNMENT.finditer(text):
        found.append(match.span(1))
    done = 0
    for match in DIGIT_RUN.finditer(text):
        if match.start() < done:
            continue
        start = match.start()
        while start > done and not TO_LEFT.match(text, start - 1):
            start -= 1
        end = done = TO_RIGHT.match(text, match.end()).end()
        start, end = _trimmed(text, start, end, 0)
        if end - start >= MIN_LENGTH:
            found.append((start, end))
    return [_trimmed(text, start, end, MIN_ASSIGNED) for start, end in sorted(found)]


def _outermost(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    result: list[tuple[int, int]] = []
    for start, end in found:
        if not result or start >= result[-1][1]:
            result.append((start, end))
    return result


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of outermost candidates in order, without overlaps."""
    return _outermost(_found(text))


def _inside(value: str) -> set[tuple[int, int]]:
    """(start, end) of values, users and passwords in an outermost candidate; no character is in more than a few."""
    asked = value.find("?")
    in_query = asked if "/" in value[: max(0, asked)] else len(value)
    marks = [m.span() for m in INNER_START.finditer(value) if m[0] or m.start() > in_query]
    parts = set()
    for (_, start), (end, _) in itertools.pairwise([(0, 0), *marks, (len(value), 0)]):
        end -= end < len(value) and end > start
        if start > in_query:
            end = min([at for at in (value.find("&", start, end), value.find("#", start, end)) if at >= 0], default=end)
        parts.add((start, end))
    for match in [*USER_INFO.finditer(value), *filter(None, [BARE_USER.match(value)])]:
        parts |= {match.span(1), match.span(2)} - {(-1, -1)}
    return parts


def nested_candidates(text: str) -> list[tuple[int, int]]:
    """All candidates in order, also those that lie in others."""
    found = _found(text)
    spans = set(found)
    for start, end in _outermost(found):
        for a, b in _inside(text[start:end]):
            a, b = _trimmed(text, start + a, start + b, MIN_ASSIGNED)
            if b - a >= MIN_ASSIGNED:
                spans.add((a, b))
    return sorted(spans)


def resolved(spans: list[tuple[int, int]], scores: Iterable[float]) -> list[tuple[int, int, float]]:
    """(start, end, score) in order, without overlaps: the innermost secrets, else the outermost candidates."""
    rows = [(a, b, float(s)) for (a, b), s in zip(spans, scores, strict=True)]
    secrets = sorted((r for r in rows if r[2] >= 0.5), key=lambda r: (r[1] - r[0], r))
    others = sorted((r for r in rows if r[2] < 0.5), key=lambda r: (r[0] - r[1], r))
    starts: list[int] = []
    taken: list[tuple[int, int, float]] = []
    for row in [*secrets, *others]:
        i = bisect.bisect(starts, row[0])
        if (not i or taken[i - 1][1] <= row[0]) and (i == len(taken) or row[1] <= taken[i][0]):
            starts.insert(i, row[0])
            taken.insert(i, row)
    return taken


Odds = tuple[dict[str, float], dict[str, float]]


def neighbours(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Lower-case words on the line before a candidate, nearest first, and after it."""
    before = text[max(0, start - NEAR) : start].split("\n")[-1]
    after = text[end : end + NEAR].split("\n")[0]
    return ([w.lower() for w in NEIGHBOUR.findall(before)[: -BEFORE - 1 : -1]], [w.lower() for w in NEIGHBOUR.findall(after)[:AFTER]])


def neighbour_odds(labelled: Iterable[tuple[str, int, int, int]]) -> Odds:
    """For each side the log odds of a secret that a word there speaks for."""
    counts = [(Counter(), Counter()) for _ in range(2)]  # by side: of mistakes, of secrets
    totals = [0, 0]
    for text, start, end, secret in labelled:
        totals[secret] += 1
        for side, words in zip(counts, neighbours(text, start, end), strict=True):
            side[secret].update(set(words))
    return tuple(
        {w: math.log((secrets[w] + 1) * (totals[0] + 2) / ((mistakes[w] + 1) * (totals[1] + 2))) for w in mistakes | secrets}
        for mistakes, secrets in counts)


class Describer:
    """Features of candidates; knows the dictionary, the corpus' character transitions and what
    neighbouring words speak for."""

    def __init__(self, words: Iterable[str], pairs: Iterable[tuple[str, int]], odds: Odds = ({}, {})):
        self.words, self.odds = set(words), odds
        self.longest = max(map(len, self.words), default=0)
        pairs, firsts = dict(pairs), Counter()
        for pair, count in pairs.items():
            firsts[pair[0]] += count
        self.surprise = {p: -math.log2(n / firsts[p[0]]) for p, n in pairs.items()}

    def covered(self, text: str) -> float:
        """The share of characters that dictionary words of four letters or more cover, longest first."""
        total = 0
        for run in LETTERS.findall(text.lower()):
            at = 0
            while at + 4 <= len(run):
                size = next((k for k in range(min(len(run) - at, self.longest), 3, -1) if run[at : at + k] in self.words), 0)
                total += size
                at += size or 1
        return total / max(1, len(text))

    def features(self, text: str, start: int, end: int) -> list[float]:
        value = text[start:end]
        n = max(1, len(value))
        before = text[max(0, start - NEAR) : start]
        left, right = ([odds.get(w, 0.0) for w in words] for odds, words in zip(self.odds, neighbours(text, start, end), strict=True))
        digits = sum(c.isdigit() for c in value)
        upper, lower = sum(c.isupper() for c in value), sum(c.islower() for c in value)
        kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
        low = value.lower()
        counts = Counter(value)
        transitions = [self.surprise.get(low[i : i + 2], 12.0) for i in range(len(low) - 1)]
        return [
            float(n), digits / n, upper / n, lower / n, (n - digits - upper - lower) / n,
            float(all(c in "0123456789abcdef" for c in low)),
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
            sum(transitions) / max(1, len(transitions)),
            -sum(c / n * math.log2(c / n) for c in counts.values()),
            self.covered(value), len(counts) / n,
            float(value.count("/") + value.count("\\")), float(value.count(".")), float(value.count("-")),
            float(bool(ADDRESS.search(value)) or before.rstrip().endswith("/")),
            float(sum(left)), left[0] if left else 0.0, float(sum(right)),
            float(before.rstrip(" \"'")[-1:] in (":", "=") if before else False),
            float(before[-1:] in "\"'" if before else False), float(bool(FILLER.search(value))),
        ]


class Forest:
    """Nodes of all trees in arrays: a row goes left where its feature is at most the limit."""

    def __init__(self, nodes: list[tuple[int, int, float, int, int, int, float]]):
        """``nodes``: (tree, id, share of secrets, left, right, feature, limit), left = -1 for leaves."""
        base: dict[int, int] = {}
        for i, row in enumerate(sorted(nodes)):
            base.setdefault(row[0], i)
        rows = sorted(nodes)
        self.roots = np.array(list(base.values()), np.int64)
        offset = np.array([base[r[0]] for r in rows], np.int64)
        self.share = np.array([r[2] for r in rows])
        self.left = np.array([r[3] for r in rows], np.int64)
        self.leaf = self.left < 0
        self.left, self.right = self.left + offset, np.array([r[4] for r in rows], np.int64) + offset
        self.feature, self.limit = np.array([max(0, r[5]) for r in rows], np.int64), np.array([r[6] for r in rows])

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while not self.leaf[at].all():
            down = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            at = np.where(self.leaf[at], at, down)
        return self.share[at].mean(axis=1)


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, dict[str | None, int]]:
    """A stored table ``lang, word, n`` with the number of documents that have a word, and the
    documents of each language; both with null for all minor languages."""
    own = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    sizes = docs.groupBy(own.alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    major = sizes.filter((F.col("n") >= total * MINOR) & F.col("lang").isNotNull()).collect()  # 1 / MINOR rows
    langs = {r["lang"]: r["n"] for r in major}
    name = F.when(own.isin(*langs), own) if langs else F.lit(None).cast("string")
    low, high = WORD_LETTERS
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(rf"(?<!\p{{L}})\p{{L}}{{{low},{high}}}(?!\p{{L}})"), F.lit(0))
    words = docs.select(name.alias("lang"), F.explode(F.array_distinct(found)).alias("word"))
    counts = stored(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    return counts, langs | {None: total - sum(langs.values())}


def corpus_dictionary(counts: DataFrame, langs: dict[str | None, int]) -> list[str]:
    """The dictionary's words, those of most documents first."""
    least = F.lit(max(LEAST, math.ceil(langs[None] * SHARE)))
    for lang, n in langs.items():
        if lang is not None:
            least = F.when(F.col("lang") == lang, F.lit(max(LEAST, math.ceil(n * SHARE)))).otherwise(least)
    known = counts.filter(F.col("n") >= least).groupBy("word").agg(F.sum("n").alias("n"))
    rows = known.collect()  # mean words of a document / SHARE, for each of 1 / MINOR languages at most
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]


def letter_pairs(counts: DataFrame) -> list[tuple[str, int]]:
    """Neighbouring letters in the words of all documents, and how often."""
    word = F.regexp_replace("word", f"[^\0-{LAST_LETTER}]", "\uffff")
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    split = counts.select(word.alias("word"), "n").select(F.explode(pairs).alias("pair"), "n")
    rows = split.groupBy("pair").agg(F.sum("n").alias("n")).collect()  # letters up to LAST_LETTER and one more, squared
    return [(r["pair"], r["n"]) for r in rows]


def train(spark: SparkSession, labelled: Iterable[tuple[str, int, int, int]], describer: Describer) -> Forest:
    """A forest from rows (text, start, end, is secret), at most ``MAX_LABELLED`` of them."""
    rows = [(float(y), describer.features(t, a, b)) for (t, a, b, y), _ in zip(labelled, range(MAX_LABELLED), strict=False)]
    data = spark.createDataFrame(rows, "label double, f array<double>").select("label", array_to_vector("f").alias("features"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(data)
    path = shared_folder(spark, "secret-forest")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # TREES times 2 ** DEPTH nodes at most
    return Forest([(
        r["treeID"], r["id"], r["impurityStats"][1] / sum(r["impurityStats"]), r["leftChild"], r["rightChild"],
        r["split"]["featureIndex"], (r["split"]["leftCategoriesOrThreshold"] or [0.0])[0]) for r in saved])


FINDING = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
REDACTED = StructType([StructField("text", StringType()), StructField("secrets", LongType())])


def found_in(text: str | None, describer: Describer, forest: Forest) -> list[tuple[int, int, float]]:
    """(start, end, score) of a text's findings."""
    spans = nested_candidates(text) if text else []
    if not spans:
        return []
    scores = forest.scores(np.array([describer.features(text, a, b) for a, b in spans]))
    return resolved(spans, scores)


def scan(docs: DataFrame, describer: Describer, forest: Forest, text: str = "text") -> Column:
    """The findings of a text with the forest's score."""
    def findings(texts: list[str | None]) -> list[list[dict]]:
        return [[{"start": a, "end": b, "score": s} for a, b, s in found_in(t, describer, forest)] for t in texts]
    return in_slices(ArrayType(FINDING), findings)(docs[text])


def scanner(spark: SparkSession, docs: DataFrame) -> tuple[Describer, Forest]:
    counts, langs = word_counts(docs)
    words = corpus_dictionary(counts, langs)
    labelled = list(labelled_findings(MAX_LABELLED, words[:2000]))
    describer = Describer(words, letter_pairs(counts), neighbour_odds(labelled[: MAX_LABELLED // 2]))
    return describer, train(spark, labelled[MAX_LABELLED // 2 :], describer)


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    pieces, at = [], 0
    for start, end in spans:
        pieces += [text[at:start], MASK]
        at = end
    return "".join([*pieces, text[at:]])


def redact(docs: DataFrame, describer: Describer, forest: Forest, text: str = "text") -> DataFrame:
    """``docs`` with secrets replaced by ``MASK``; ``n_chars`` follows where there is such a column.
    One Python function finds and masks, and only texts with secrets come back from it."""
    def changed(texts: list[str | None]) -> list[dict]:
        rows = []
        for t in texts:
            secrets = [(a, b) for a, b, score in found_in(t, describer, forest) if score >= 0.5]
            rows.append({"text": masked(t, secrets) if secrets else None, "secrets": len(secrets)})
        return rows
    own = free_name(docs, "redacted")
    new = F.col(own)["text"]
    found = docs.withColumn(own, in_slices(REDACTED, changed)(F.col(text)))
    columns = {text: F.coalesce(new, F.col(text))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(new.isNotNull(), F.length(new)).otherwise(F.col("n_chars"))
    return found.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets are masked."""
    return redact(docs, *scanner(spark, docs))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate: its place, hash, score, and whether it is a secret."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = docs.withColumn("found", scan(docs, *scanner(spark, docs)))
    values = F.transform("found", lambda f: F.struct(
        f["start"].alias("start"), f["end"].alias("end"), f["score"].alias("score"),
        F.sha2(F.substring(F.col("text"), (f["start"] + 1).cast("int"), (f["end"] - f["start"]).cast("int")), 256).alias("sha256")))
    rows = found.filter(F.size("found") > 0).select("doc_id", F.explode(values).alias("f"))
    return rows.select("doc_id", "f.start", "f.end", F.col("f.sha256").alias("value_sha256"),
                       F.round("f.score", 6).alias("score"), (F.col("f.score") >= 0.5).alias("secret"))
