"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks, that is runs of text between block-level tags, each with the
tags, class and id words of its open ancestors.  Features are these, pairs of tags that lie
in each other, and a few properties of the text.  A chain model with two labels is fitted on
labelled pages by its exact likelihood (forward and backward sums), and a page's labels are
its Viterbi path.  Blocks that are labelled as main text are joined by line breaks.

Attributes are read as browsers do: a quote opens a value only behind ``=``.  Tags need not be
closed: a paragraph ends at the next block, a list item at the next one, and
an end tag closes what is open inside it.  ``script``, ``style`` and other elements without
text of their own, comments and declarations are skipped.  ``head`` is none of these, since its
end tag may be missing.  Formulas belong to the text around them.

Defined cases: null, empty or markup-free pages: no text, or one block of text.  A page that
ends inside a tag, comment, script, style, title or text field loses that last piece; of other
skipped elements without an end tag only the tag is left out.  Repeated pages get the same text
each.  An empty table gives an empty result.  A column named as the result is replaced, all
others pass through.
"""

from __future__ import annotations

import functools
import html
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from verbaloom.llm.common import table
from verbaloom.llm.labelled_pages import labelled_pages

#: Labelled pages that the model is fitted on, at most.
MAX_LABELLED = 400
STEPS, RATE, PENALTY = 150, 0.1, 1e-3

# Fixed names of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Up to their first end tag, or to the end of the page, these hold no markup.
RAW = set("script style title textarea".split())
#: Skipped with all that is in them, if they have an end tag.
SKIPPED = set("noscript template svg iframe select object audio video canvas".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
             "strike strong sub sup time tt u var wbr "
             "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
             "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split())
CLOSES_ITSELF = {"li", "dt", "dd", "tr", "td", "th", "option"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@functools.lru_cache(maxsize=4096)
def _own_features(tag: str, attributes: str) -> frozenset[str]:
    names = {f"tag {tag}"}
    for value in NAMED.findall(attributes):
        for word in PART.findall(value):
            word = word.lower()
            names.add(f"name {word.removesuffix('s')}")
    return frozenset(names)


class _Open:
    """An open element and the features of all its ancestors and itself."""

    __slots__ = ("features", "tag")

    def __init__(self, tag: str, attributes: str, parent: _Open | None):
        own = _own_features(tag, attributes)
        self.tag = tag
        self.features = own if parent is None else parent.features | own | {f"in {parent.tag} {tag}"}


def _text_features(text: str, linked: int, tag: str) -> set[str]:
    size = len(text)
    return {
        f"own {tag}", f"length {min(size.bit_length(), 9)}",
        f"links {min(4, 5 * linked // max(size, 1))}", f"end {text[-1] if text[-1] in '.!?:,' else 'x'}",
    }


def _tokens(page: str) -> list[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, is an end tag, attributes) of what is not text; the tag is None where all of it is skipped."""
    tokens: list[tuple[int, int, str | None, bool, str]] = []
    opened: dict[str, list[int]] = {}
    until: dict[int, int] = {}
    at = drawings = 0
    while token := TOKEN.search(page, at):
        at, name = token.end(), token[2] or token[5]
        tag, ends, attributes = name and name.lower(), bool(token[1] or token[4]), token[3] or token[6] or ""
        closed = attributes.endswith("/")
        if tag in ("svg", "math") and not closed:
            drawings = max(0, drawings - 1) if ends else drawings + 1
        if tag in RAW and not ends and not (closed and drawings > 0):
            end = RAW_END[tag].search(page, at)
            at, tag = end.end() if end else len(page), None
        elif tag in SKIPPED:
            if ends and opened.get(tag):
                until[opened[tag].pop()] = len(tokens)
            elif not ends and not (closed and tag == "svg"):
                opened.setdefault(tag, []).append(len(tokens))
        tokens.append((token.start(), at, tag, ends, attributes))
    kept, i = [], 0
    while i < len(tokens):
        start, end, tag, ends, attributes = tokens[i]
        if tag in SKIPPED or tag in RAW:
            i = until.get(i, i)
            end, tag = tokens[i][1], None
        kept.append((start, end, tag, ends, attributes))
        i += 1
    return kept


def leaf_blocks(page: str) -> list[tuple[str, frozenset[str] | set[str]]]:
    """(text, features) of the leaf blocks in page order."""
    blocks: list[tuple[str, set[str]]] = []
    stack: list[_Open] = []
    run: list[str] = []
    linked, at, owner = 0, 0, None

    def flush() -> None:
        nonlocal linked, owner
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        if text:
            blocks.append((text, _text_features(text, linked, owner.tag if owner else "") | (owner.features if owner else set())))
        run.clear()
        linked, owner = 0, None

    def close(index: int) -> None:
        del stack[index:]

    for start, end, tag, ends, attributes in _tokens(page):
        if start > at:
            text = page[at:start]
            if owner is None and not text.isspace():
                owner = next((e for e in reversed(stack) if e.tag not in INLINE), None)
            run.append(text)
            if any(e.tag == "a" for e in stack[-4:]):
                linked += len(text)
        at = end
        if tag is None:
            continue
        if tag not in INLINE:
            flush()
        if tag == "br":
            run.append(" ")
        if tag in VOID or tag == "head":
            continue
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag not in INLINE:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p" or (tag in CLOSES_ITSELF and stack[i].tag == tag):
                    close(i)
                    break
                if stack[i].tag not in INLINE and not (tag in CLOSES_ITSELF and stack[i].tag in CLOSES_ITSELF):
                    break
        if not attributes.endswith("/"):
            stack.append(_Open(tag, attributes, stack[-1] if stack else None))
    if at < len(page):
        text = page[at:]
        if owner is None and not text.isspace():
            owner = next((e for e in reversed(stack) if e.tag not in INLINE), None)
        run.append(text)
    flush()
    return blocks


class ChainModel:
    """Weights of a two-label chain: ``weights`` by feature, for main text against the rest;
    ``steps[a][b]`` for label b after label a; ``bias``."""

    def __init__(self, weights: dict[str, float], bias: float, steps: list[list[float]]):
        self.weights, self.bias, self.steps = weights, bias, steps

    def labels(self, blocks: list[tuple[str, set[str]]]) -> list[int]:
        """The Viterbi path."""
        weight, (stay0, to1), (to0, stay1) = self.weights.get, *self.steps
        zero, one, back = 0.0, 0.0, []
        for i, (_, features) in enumerate(blocks):
            score = self.bias + sum(weight(f, 0.0) for f in features)
            if i:
                from0, from1 = zero + stay0 >= one + to0, zero + to1 >= one + stay1
                zero, one = (zero + stay0 if from0 else one + to0), (zero + to1 if from1 else one + stay1) + score
                back.append((0 if from0 else 1, 0 if from1 else 1))
            else:
                one = score
        if not blocks:
            return []
        path = [int(one > zero)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return "\n".join(text for (text, _), label in zip(blocks, self.labels(blocks), strict=True) if label)


def fit(pages: list[tuple[str, list[str]]]) -> ChainModel:
    """Maximum likelihood with a penalty; all pages move along the chain together."""
    chains, truth = [], []
    for page, texts in pages:
        blocks = leaf_blocks(page)
        main = {" ".join(html.unescape(t).split()) for t in texts}
        if blocks:
            chains.append(blocks)
            truth.append([int(text in main) for text, _ in blocks])
    if not chains:
        return ChainModel({}, 0.0, [[0.0, 0.0], [0.0, 0.0]])
    names = sorted({f for c in chains for _, fs in c for f in fs})
    index = {f: i for i, f in enumerate(names)}
    n, length = len(chains), max(map(len, chains))
    x = np.zeros((n, length, len(names) + 1), np.float32)
    y, there = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (chain, labels) in enumerate(zip(chains, truth, strict=True)):
        y[i, : len(chain)], there[i, : len(chain)] = labels, True
        for t, (_, fs) in enumerate(chain):
            x[i, t, [index[f] for f in fs]] = 1
            x[i, t, -1] = 1
    flat = x.reshape(n * length, -1)
    both = there[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    w, steps = np.zeros(flat.shape[1]), np.zeros((2, 2))
    drift, speed = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, STEPS + 1):
        score = np.zeros((n, length, 2))
        score[:, :, 1] = (flat @ w).reshape(n, length)
        ahead, behind = score.copy(), np.zeros_like(score)
        for t in range(1, length):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps, axis=1)
            ahead[:, t] = np.where(there[:, t, None], score[:, t] + step, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = np.logaddexp.reduce((score[:, t + 1] + behind[:, t + 1])[:, None, :] + steps, axis=2)
            behind[:, t] = np.where(there[:, t + 1, None], step, behind[:, t + 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * there
        pairs = np.exp(ahead[:, :-1, :, None] + steps + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
        expected = (pairs * both[:, :, None, None]).sum((0, 1))
        slope = np.concatenate([((y - one) * there).reshape(-1) @ flat / n - PENALTY * w, (seen - expected).ravel() / n])
        drift, speed = 0.9 * drift + 0.1 * slope, 0.99 * speed + 0.01 * slope * slope
        move = RATE * drift / (1 - 0.9**k) / (np.sqrt(speed / (1 - 0.99**k)) + 1e-8)
        w, steps = w + move[: len(w)], steps + move[len(w) :].reshape(2, 2)
    return ChainModel({f: float(w[i]) for f, i in index.items()}, float(w[-1]), steps.tolist())


def train(labelled: DataFrame, most: int = MAX_LABELLED) -> ChainModel:
    """The model of at most ``most`` rows ``page, main`` (texts of the main blocks), fitted in one task."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["page"] or "", r["main"] or []) for b in batches for r in b.to_pylist())
        model = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.weights, model.bias, model.steps))], pa.binary())], names=["model"])
    rows = labelled.select("page", "main").orderBy(F.xxhash64("page")).limit(most).repartition(1)
    row = rows.mapInArrow(learn, StructType([StructField("model", BinaryType())])).first()
    return ChainModel(*pickle.loads(bytes(row["model"])))


def own_labelled_pages(spark: SparkSession, count: int = MAX_LABELLED) -> DataFrame:
    return spark.createDataFrame(list(labelled_pages(count)), "page string, main array<string>")


def extract(pages: DataFrame, model: ChainModel, page: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text in the column ``into``."""
    @F.pandas_udf(StringType())
    def main_text(raw: pd.Series) -> pd.Series:
        return pd.Series([model.main_text(p) for p in raw], dtype=object)
    return pages.withColumn(into, main_text(F.col(page)))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(own_labelled_pages(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, model).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
