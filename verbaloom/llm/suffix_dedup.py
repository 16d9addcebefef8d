"""Removal of repeated byte strings with suffix arrays that are built block by block.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is removed.
The suffixes that matter are the starts of such windows.  They are dealt into buckets so that
equal windows meet: a window's bucket is the smallest hashed ``GRAM``-byte string in it, and a
run of windows with the same smallest string travels as one piece of text.

0. *Merge.*  Of equal texts each task passes two on, whatever their number, and a text's copies meet in
   one chunk, where they are one.  Texts that stand on several rows are removed as a whole, and their
   one copy still shows which strings of other texts repeat.
1. *Scan.*  Each task reports the smallest strings of its texts, with counts, added up by text
   chunk.  A string that occurs once in the whole corpus has no repeats in its windows; this
   drops most of a clean corpus and loses nothing.
2. *Deal.*  Pieces of the other windows go to their buckets; equal pieces of a chunk go once.
3. *Sort.*  A task sorts one block of buckets at a time.  Pieces that are equal as a whole are
   settled at once.  For the rest the window starts are sorted as suffixes: by their next
   bytes, and ties, however long, by the ranks of a difference-cover sample
   (``suffix_array``).  Neighbours with ``LENGTH`` equal bytes are repeats.
4. *Cut.*  Repeats go back to the chunks, where bytes are removed.

A block holds ``BLOCK_BYTES`` on average; the number of blocks follows the corpus, so memory is
bounded.  A smallest string that occurs more than ``HOT`` times would still gather its pieces,
which differ around it, in one block: its windows are dealt singly, as 128-bit BLAKE2b digests of their
bytes, which spread evenly, and of equal windows of a chunk one goes.

Defined cases: a null text is empty.  Texts shorter than ``LENGTH`` are left whole.  Rows that
repeat, also with the same id, repeat each other.  Matches never cross texts.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from verbaloom.llm.common import stored, table
from verbaloom.llm.suffix_array import repeated_starts

LENGTH = 200
GRAM = 32
WINDOWS = LENGTH - GRAM + 1
CHUNK_BYTES = 8 << 20
BLOCK_BYTES = 3 << 20
HOT = 4_000
#: Bytes that one smallest string stands for on average, for block counts.
RUN_BYTES = WINDOWS // 2 + LENGTH

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFF)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        size = 1 << max(16, size.bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return _POWERS[base]


def rolling_hash(x: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each position."""
    up, down = _powers(_BASE, len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(7)) * up[: len(x)], out=sums[1:])
    name = (sums[length:] - sums[:-length]) * down[: len(x) - length + 1]
    name = (name ^ (name >> np.uint64(31))) * _M1
    name = (name ^ (name >> np.uint64(29))) * _M2
    return name ^ (name >> np.uint64(32))


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows that have their leftmost smallest string at the same place: the string's
    name (48 bits) and the first window of each run.  ``x`` has ``LENGTH`` bytes at least.

    Equal windows have that string equally far inside, so at different places they are of
    different runs, and its name counts for each.
    """
    name = rolling_hash(x, GRAM)
    count = len(x) - LENGTH + 1
    # Smallest of each stretch of WINDOWS names: of a tail and a head of two neighbouring blocks.
    # The low bits say how far from the tail's block it is, so the leftmost of equal names wins.
    size = -(-len(name) // WINDOWS) * WINDOWS
    padded = np.full(size, ~np.uint64(0), np.uint64)
    padded[: len(name)] = name
    blocks = (padded & ~_LOW).reshape(-1, WINDOWS) | np.arange(WINDOWS, dtype=np.uint64)
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    heads = np.minimum.accumulate(blocks + np.uint64(WINDOWS), axis=1).ravel()
    least = np.minimum(tails[:count], heads[WINDOWS - 1 : WINDOWS - 1 + count])
    at = np.arange(count)
    place = at - at % WINDOWS + (least & _LOW).astype(np.int64)
    first = np.ones(count, bool)
    first[1:] = place[1:] != place[:-1]
    starts = np.flatnonzero(first)
    return least[starts] >> np.uint64(16), starts


def raw_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def chunk_of(text: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(chunks)).cast("long")


def _first_rows(batch: pa.RecordBatch, most: int, seen: dict[str, int]) -> pa.RecordBatch:
    """The rows of ``chunk, text, key`` that are among the first ``most`` of their key in this task."""
    keep = []
    for key in batch.column(2).to_pylist():
        number = seen.get(key, 0)
        keep.append(number < most)
        seen[key] = min(most, number + 1)
    return batch.filter(pa.array(keep, pa.bool_())).select(["chunk", "text"])


def long_texts(docs: DataFrame, chunks: int) -> DataFrame:
    """``chunk, text, key`` of each row whose text has a window; the key is the text's SHA-256."""
    long = docs.filter(F.octet_length("text") >= LENGTH)
    return long.select(chunk_of(F.col("text"), chunks).alias("chunk"), "text", F.sha2("text", 256).alias("key"))


def merged_texts(texts: DataFrame) -> DataFrame:
    """Step 0: ``chunk, text``, at most two rows of a text from each task."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            yield _first_rows(batch, 2, seen)
    return texts.select("chunk", "text", "key").mapInArrow(merge, _schema(chunk=LongType, text=StringType))


def _distinct(texts: pa.Table) -> list[tuple[str, int]]:
    """A chunk's different texts in order, with the number of rows that came of each."""
    return sorted(Counter(texts.column("text").to_pylist()).items())


def _batch(schema: StructType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {LongType: pa.int64(), BinaryType: pa.binary(), StringType: pa.string(), BooleanType: pa.bool_()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[type(f.dataType)]) for c, f in zip(columns, schema, strict=True)], names=schema.names)


def _schema(**kinds: Any) -> StructType:
    return StructType([StructField(n, k()) for n, k in kinds.items()])


COUNTED = _schema(part=LongType, chunk=LongType, names=BinaryType, counts=BinaryType)
MARKED = _schema(chunk=LongType, names=BinaryType, hot=BinaryType, found=LongType)
DEALT = _schema(block=LongType, chunk=LongType, hot=BooleanType, heads=BinaryType, data=BinaryType)
REPEATS = _schema(chunk=LongType, spans=BinaryType)


def _split(order: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of equal ``keys``: the key and the indices in ``order`` that have it."""
    order = order[np.argsort(keys[order], kind="stable")]
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        yield int(keys[group[0]]), group


def counted_names(texts: DataFrame, parts: int) -> DataFrame:
    """Step 1: names of smallest strings and their counts, by part of the name space and chunk.  A text
    that several tasks have counts for each, which marks more names and loses none."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            names, chunks = [], []
            batch = _first_rows(batch, 1, seen)
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = raw_bytes(text)
                if len(x) >= LENGTH:
                    found = runs(x)[0]
                    names.append(found)
                    chunks.append(np.full(len(found), chunk, np.int64))
            rows = []
            if names:
                name, chunk = np.concatenate(names), np.concatenate(chunks)
                part = (name % np.uint64(parts)).astype(np.int64)
                for p, inside in _split(np.arange(len(name)), part):
                    for c, here in _split(inside, chunk):
                        values, counts = np.unique(name[here], return_counts=True)
                        rows.append((p, c, values.tobytes(), counts.astype(np.int64).tobytes()))
            yield _batch(COUNTED, rows)
    return texts.select("chunk", "text", "key").mapInArrow(scan, COUNTED)


def marked_names(counted: DataFrame) -> DataFrame:
    """For each chunk the names that occur twice or more in the corpus, and which are hot."""
    def mark(rows: pa.Table) -> pa.Table:
        names = [np.frombuffer(b, np.uint64) for b in rows.column("names").to_pylist()]
        counts = [np.frombuffer(b, np.int64) for b in rows.column("counts").to_pylist()]
        flat = np.concatenate(names)
        _, inverse = np.unique(flat, return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts))[inverse]
        result, at = [], 0
        for chunk, own, count in zip(rows.column("chunk").to_pylist(), names, counts, strict=True):
            mine = total[at : at + len(own)]
            at += len(own)
            again = mine > 1
            if again.any():
                result.append((chunk, own[again].tobytes(), (mine[again] > HOT).tobytes(), int(count[again].sum())))
        return pa.Table.from_batches([_batch(MARKED, result)])
    return counted.groupBy("part").applyInArrow(mark, MARKED)


def _window_digests(whole: bytes, windows: np.ndarray) -> np.ndarray:
    """Two longs for each of the windows that begin at ``windows``."""
    raw = b"".join(hashlib.blake2b(whole[w : w + LENGTH], digest_size=16).digest() for w in windows.tolist())
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _merged(singles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (first half, second half, row, window) one for each digest, and the rows (row,
    window, 1) of the digests that occur more than once."""
    order = np.lexsort((singles[:, 1], singles[:, 0]))
    rows = singles[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    group = np.cumsum(new) - 1
    again = np.bincount(group)[group] > 1
    known = rows[again][:, 2:]
    return rows[new], np.column_stack([known, np.ones(len(known), np.int64)])


def dealt_pieces(docs: DataFrame, marked: DataFrame, blocks: int) -> DataFrame:
    """Step 2: pieces of text, or hashes of windows, for the blocks.

    Heads are rows (name, row in the chunk, first window, windows, bytes at) of five longs; for
    hot names (first and second half of the digest, row, window) without data.  Hot windows that repeat
    within the chunk are known already and are only passed on.
    """
    def deal(texts: pa.Table, marks: pa.Table) -> pa.Table:
        if not texts.num_rows or not marks.num_rows:
            return pa.Table.from_batches([_batch(DEALT, [])])
        chunk = texts.column("chunk")[0].as_py()
        known = np.concatenate([np.frombuffer(b, np.uint64) for b in marks.column("names").to_pylist()])
        hot = np.concatenate([np.frombuffer(b, np.bool_) for b in marks.column("hot").to_pylist()])
        place = np.argsort(known)
        known, hot = known[place], hot[place]
        heads, data, singles = [], [], []
        for number, (text, _) in enumerate(_distinct(texts)):
            x = raw_bytes(text)
            name, start = runs(x)
            at = np.minimum(np.searchsorted(known, name), len(known) - 1)
            again = known[at] == name
            if not again.any():
                continue
            count = np.diff(np.append(start, len(x) - LENGTH + 1))
            whole = x.tobytes()
            for n, s, c in zip(*[a[again & ~hot[at]].tolist() for a in (name, start, count)], strict=True):
                heads.append((n, number, s, c))
                data.append(whole[s : s + c + LENGTH - 1])
            if (again & hot[at]).any():
                window = np.concatenate([np.arange(s, s + c) for s, c in zip(start[again & hot[at]], count[again & hot[at]], strict=True)])
                singles.append(np.column_stack([_window_digests(whole, window), np.full(len(window), number), window]))
        rows = []
        if heads:
            table_ = np.array(heads, np.int64)
            for block, inside in _split(np.arange(len(table_)), table_[:, 0] % blocks):
                kept: dict[bytes, int] = {}
                size, at = 0, []
                for i in inside.tolist():  # an equal piece points at the bytes of the first
                    piece = data[i]
                    if piece not in kept:
                        kept[piece] = size
                        size += len(piece)
                    at.append(kept[piece])
                packed = np.column_stack([table_[inside], np.array(at, np.int64)])
                rows.append((block, chunk, False, packed.tobytes(), b"".join(kept)))
        if singles:
            table_, known_spans = _merged(np.concatenate(singles))
            for block, inside in _split(np.arange(len(table_)), np.mod(table_[:, 1], blocks)):
                rows.append((block, chunk, True, np.ascontiguousarray(table_[inside]).tobytes(), b""))
            if len(known_spans):
                rows.append((chunk % blocks, chunk, True, b"", known_spans.tobytes()))
        return pa.Table.from_batches([_batch(DEALT, rows)])
    return docs.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(deal, DEALT)


def _block_repeats(chunks: list[int], heads: list[bytes], data: list[bytes]) -> dict[int, list[np.ndarray]]:
    """Repeats among pieces: by chunk, rows (row in the chunk, first window, windows)."""
    head = np.concatenate([np.frombuffer(h, np.int64).reshape(-1, 5) for h in heads])
    of = np.concatenate([np.full(len(h) // 40, i) for i, h in enumerate(heads)])
    numbers: dict[bytes, int] = {}
    number = np.empty(len(head), np.int64)
    for i, (row, source) in enumerate(zip(head.tolist(), of.tolist(), strict=True)):
        piece = data[source][row[4] : row[4] + row[3] + LENGTH - 1]
        number[i] = numbers.setdefault(piece, len(numbers))
    copies = np.bincount(number)
    name = np.empty(len(numbers), np.int64)
    name[number] = head[:, 0]
    pieces = list(numbers)
    # Only names with several different pieces can have repeats across pieces.
    _, inverse, sizes = np.unique(name, return_inverse=True, return_counts=True)
    open_pieces = np.flatnonzero(sizes[inverse] > 1)
    windows = np.array([len(pieces[i]) - LENGTH + 1 for i in open_pieces], np.int64)
    flags: dict[int, np.ndarray] = {}
    if len(open_pieces):
        x = np.frombuffer(b"".join(pieces[i] for i in open_pieces), np.uint8)
        base = np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1)
        inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        repeated = repeated_starts(x, np.repeat(base, windows) + inner, LENGTH)
        flags = dict(zip(open_pieces.tolist(), np.split(repeated, np.cumsum(windows)[:-1]), strict=True))
    result: dict[int, list[np.ndarray]] = {}
    for i, (row, source) in enumerate(zip(head.tolist(), of.tolist(), strict=True)):
        piece = int(number[i])
        if copies[piece] > 1:
            spans = np.array([[row[1], row[2], row[3]]], np.int64)
        elif piece in flags and flags[piece].any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], flags[piece], [False]]).astype(np.int8)))
            begin, end = edge[::2], edge[1::2]
            spans = np.column_stack([np.full(len(begin), row[1]), row[2] + begin, end - begin])
        else:
            continue
        result.setdefault(chunks[source], []).append(spans)
    return result


def _single_repeats(chunks: list[int], heads: list[bytes]) -> dict[int, list[np.ndarray]]:
    rows = np.concatenate([np.frombuffer(h, np.int64).reshape(-1, 4) for h in heads])
    of = np.concatenate([np.full(len(h) // 32, i) for i, h in enumerate(heads)])
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    same = (rows[order[1:], :2] == rows[order[:-1], :2]).all(axis=1)
    again = np.zeros(len(rows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return {chunks[i]: [np.column_stack([rows[inside][:, 2:], np.ones(len(inside), np.int64)])]
            for i, inside in _split(np.flatnonzero(again), of)}


def repeated_windows(dealt: DataFrame) -> DataFrame:
    """Step 3: for each chunk the repeated windows, as rows (row, first window, windows) of longs."""
    def sort(rows: pa.Table) -> pa.Table:
        chunks, heads = rows.column("chunk").to_pylist(), rows.column("heads").to_pylist()
        if rows.column("hot")[0].as_py():
            known = rows.column("data").to_pylist()
            found = _single_repeats(chunks, heads)
            for chunk, spans in zip(chunks, known, strict=True):
                if spans:
                    found.setdefault(chunk, []).append(np.frombuffer(spans, np.int64).reshape(-1, 3))
        else:
            found = _block_repeats(chunks, heads, rows.column("data").to_pylist())
        return pa.Table.from_batches([_batch(REPEATS, [(c, np.concatenate(s).tobytes()) for c, s in found.items()])])
    return dealt.groupBy("block", "hot").applyInArrow(sort, REPEATS)


CUT = _schema(key=StringType, n_removed=LongType, n_spans=LongType, kept_sha256=StringType, kept=BinaryType)


def _cut(x: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(kept bytes, removed bytes, removed runs) when ``spans`` (first window, windows) repeat."""
    edges = np.zeros(len(x) + 1, np.int64)
    np.add.at(edges, spans[:, 0], 1)
    np.add.at(edges, spans[:, 0] + spans[:, 1] + LENGTH - 1, -1)
    gone = np.cumsum(edges[:-1]) > 0
    return x[~gone], int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())


def cut_texts(texts: DataFrame, repeats: DataFrame, keep_bytes: bool) -> DataFrame:
    """Step 4: what is left of each text of which anything is removed, by the text's SHA-256."""
    def cut(rows: pa.Table, found: pa.Table) -> pa.Table:
        spans = [np.frombuffer(b, np.int64).reshape(-1, 3) for b in found.column("spans").to_pylist()]
        span = np.concatenate(spans) if spans else np.empty((0, 3), np.int64)
        by_row = dict(_split(np.arange(len(span)), span[:, 0])) if len(span) else {}
        result = []
        for number, (text, copies) in enumerate(_distinct(rows)):
            x = raw_bytes(text)
            if copies > 1:
                kept, removed, pieces = x[:0], len(x), 1
            elif number in by_row:
                kept, removed, pieces = _cut(x, span[by_row[number]][:, 1:])
            else:
                continue
            rest = kept.tobytes()
            result.append((hashlib.sha256(x.tobytes()).hexdigest(), removed, pieces, hashlib.sha256(rest).hexdigest(), rest if keep_bytes else None))
        return pa.Table.from_batches([_batch(CUT, result)])
    return texts.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(cut, CUT)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the kept bytes, one row per document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + size // CHUNK_BYTES
    texts = long_texts(rows, chunks)
    # A part of the names is some megabytes of longs.
    parts = 1 + size // (32 * CHUNK_BYTES)
    marked = stored(marked_names(counted_names(texts, max(parts, chunks // 4 + 1))), "repeated-names")
    found = marked.agg(F.sum("found")).first()[0] or 0
    blocks = 1 + found * RUN_BYTES // BLOCK_BYTES
    repeats = stored(repeated_windows(dealt_pieces(merged_texts(texts), marked, blocks)), "repeated-windows")
    cuts = cut_texts(merged_texts(texts), repeats, keep_bytes)
    whole = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"),
                        *([F.col("text").cast("binary").alias("raw")] if keep_bytes else []))
    joined = whole.join(cuts, whole["own"] == cuts["key"], "left")
    kept = F.when(F.col("key").isNull(), F.col("raw")).otherwise(F.col("kept")) if keep_bytes else F.lit(None).cast("binary")
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"), kept.alias("kept"))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")
