"""Same or near-same texts across splits (problem 2).

The evaluation texts become full-text indexes: blocks of bounded size, each the
Burrows-Wheeler transform of its words with sorted occurrence lists, so one step of
backward search is two binary searches. Training texts stream through every block. From
its last word backwards a text is cut into disjoint matches, each extended until it
occurs at most ``rare`` times; a text of n words can suffer n // 4 edits, so of any
n // 4 + 1 disjoint matches one survives in every true partner. The rarest that many are
located, the spans of each pair of texts merged, and the word edit distance of the pair
decides. A text with too few rare matches is searched again with a higher bound, up to
single words, so no partner is lost and no count is capped.

Equal texts are searched once and expanded at the end. A null text, or one without a
word, is no case; a null split is on neither side.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.session import scratch_path, written

#: Words of one index block; a block takes about 24 bytes a word while it is searched.
BLOCK_WORDS = 4_000_000
#: Longest match; blocks are sorted by so many words.
DEPTH = 64
TOLERANCE = 5  # one word in so many may differ
#: A match is rare at so many occurrences in a block, to begin with.
FEW = 64
#: Matches wanted beyond the edits a text can suffer and one.
SPARE = 0
_PARTS = ("keys", "doc_of", "words", "starts", "vocabulary", "h1", "h2")


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits of a text, case folded."""
    runs = F.regexp_extract_all(F.lower(F.upper(text)), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return F.transform(runs, lambda w: F.xxhash64(w))


def sided(rows: DataFrame, name: str, text: Column) -> DataFrame:
    """(table_name, line_no, side, source, split, h1, h2, words) of the rows on either side."""
    split = F.lower(F.trim("split"))
    side = F.when(split == "train", "train").when(split.isin("dev", "test"), "eval")
    some = rows.select(F.lit(name).alias("table_name"), "line_no", side.alias("side"), F.col("source"), split.alias("split"), word_hashes(text).alias("words"))
    some = some.where(F.col("side").isNotNull() & (F.size("words") > 0))
    return some.withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(7), "words")})


def suffix_order(t: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions sorted by the words from there on, up to ``depth`` of them: prefix doubling."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth and rank.max() < n - 1:
        tail = np.zeros(n, np.int64)
        tail[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + tail
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = fresh
        k *= 2
    return order


class Block:
    """Full-text index of a block of texts."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.__dict__.update(parts)
        self.n = len(self.doc_of)

    @classmethod
    def build(cls, texts: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> Block:
        sizes = np.array([len(x) for x in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        vocabulary, ids = np.unique(flat, return_inverse=True)
        t = np.ones(starts[-1], np.int64)  # 1 ends a text
        inside = np.ones(starts[-1], bool)
        inside[starts[1:] - 1] = False
        t[inside] = ids + 2
        order = suffix_order(t)
        before = t[order - 1]  # position 0 is preceded by the end of the last text
        n = len(t)
        keys = np.sort(before * n + np.arange(n))
        doc_of = (np.searchsorted(starts, order, side="right") - 1).astype(np.int32)
        return cls({"keys": keys, "doc_of": doc_of, "words": t.astype(np.int32), "starts": starts, "vocabulary": vocabulary, "h1": h1, "h2": h2})

    def save(self, path: str) -> None:
        system, root = _file_system(path)
        system.create_dir(root, recursive=True)
        for name in _PARTS:
            data = io.BytesIO()
            np.save(data, getattr(self, name))
            with system.open_output_stream(f"{root}/{name}.npy") as out:
                out.write(data.getbuffer())

    @classmethod
    def load(cls, path: str) -> Block:
        system, root = _file_system(path)
        if isinstance(system, fs.LocalFileSystem):  # pages are shared between the workers of a machine
            return cls({name: np.load(f"{root}/{name}.npy", mmap_mode="r") for name in _PARTS})
        parts = {}
        for name in _PARTS:
            with system.open_input_stream(f"{root}/{name}.npy") as data:
                parts[name] = np.load(io.BytesIO(data.read()))
        return cls(parts)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers in this block, -1 where it has no such word."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, -1)

    def matches(self, words: np.ndarray, starts: np.ndarray, which: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Disjoint matches of the texts ``which``, found from the right: (text, low, high) of each.

        A match is extended to the left until at most ``rare`` suffixes of the block begin with it.
        """
        at = starts[which + 1] - 1
        first = starts[which]
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        length = np.zeros(len(which), np.int64)
        text = which.copy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(text):
            c = words[at]
            known = c >= 0
            base = np.where(known, c, 0) * self.n
            low = np.where(known, np.searchsorted(self.keys, base + low), 0)
            high = np.where(known, np.searchsorted(self.keys, base + high), 0)
            length += 1
            done = (high - low <= rare) | (length >= DEPTH - 1)
            if done.any():
                found.append((text[done], low[done], high[done]))
                low, high = np.where(done, 0, low), np.where(done, self.n, high)
                length[done] = 0
            at = at - 1
            go = at >= first
            if not go.all():
                at, first, low, high, length, text = at[go], first[go], low[go], high[go], length[go], text[go]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def candidates(self, words: np.ndarray, starts: np.ndarray, rare: int = FEW, spare: int = SPARE) -> tuple[np.ndarray, np.ndarray]:
        """(text, document) pairs that include every pair within the tolerance.

        Of s disjoint matches at least s less the allowed edits survive in a true partner, so only
        documents with that many hits are kept. A text is searched again with a higher bound while
        it has fewer than ``spare`` matches beyond its edits; words alone are the last resort.
        """
        sizes = np.diff(starts)
        documents = len(self.h1)
        need = sizes // (TOLERANCE - 1) + 1
        lengths = np.diff(self.starts) - 1
        which = np.flatnonzero(sizes > 0)
        kept: list[np.ndarray] = []
        while len(which):
            text, low, high = self.matches(words, starts, which, rare)
            counts = np.bincount(text, minlength=len(sizes))
            last = rare >= self.n
            enough = counts[which] >= need[which] + (0 if last else spare)
            served = np.zeros(len(sizes), bool)
            served[which[enough | last]] = True
            keep = served[text] & (high > low)
            text, low, width = text[keep], low[keep], (high - low)[keep]
            if len(text):
                rows = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())
                pair, hits = np.unique(np.repeat(text, width) * documents + self.doc_of[rows], return_counts=True)
                t, d = pair // documents, pair % documents
                most = np.maximum(sizes[t], lengths[d]) // TOLERANCE
                true = (hits >= counts[t] - most) & (np.abs(sizes[t] - lengths[d]) <= most)
                kept.append(pair[true])
            which = which[~(enough | last)]
            rare *= 4
        merged = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return merged // documents, merged % documents

    def text(self, doc: int) -> np.ndarray:
        return self.words[self.starts[doc] : self.starts[doc + 1] - 1]


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Words to add, remove or replace to turn one text into the other; more than ``most`` counts as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    masks: dict[int, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for j, w in enumerate(b):
        eq = masks.get(w, 0)
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hm = minus | ~(d | plus) & full, d & plus
        score += bool(hp & top) - bool(hm & top)
        if score - (len(b) - 1 - j) > most:
            return most + 1
        hp, hm = (hp << 1 | 1) & full, hm << 1 & full
        plus, minus = hm | ~(d | hp) & full, hp & d
    return min(score, most + 1)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@lru_cache(maxsize=2)
def _block(path: str) -> Block:
    return Block.load(path)


def _flat(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _build(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (table_name, block); one index for each."""
        here: tuple[str, int] | None = None
        texts: list[np.ndarray] = []
        h1: list[int] = []
        h2: list[int] = []

        def finish() -> pa.RecordBatch:
            path = f"{folder}/{here[0]}-{here[1]}"
            Block.build(texts, np.array(h1, np.int64), np.array(h2, np.int64)).save(path)
            return pa.RecordBatch.from_pylist([{"table_name": here[0], "path": path}])

        for b in batches:
            flat, offsets = _flat(b, 4)
            names, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
            first, second = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i in range(b.num_rows):
                if (names[i], blocks[i]) != here:
                    if here:
                        yield finish()
                    here, texts, h1, h2 = (names[i], blocks[i]), [], [], []
                texts.append(flat[offsets[i] : offsets[i + 1]].copy())
                h1.append(first[i])
                h2.append(second[i])
        if here:
            yield finish()

    return run


def _search(paths: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(table_name, h1, h2, words) of training texts to pairs of equal or near-equal texts."""
        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            flat, offsets = _flat(b, 3)
            h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            out: list[tuple[str, int, int, int, int, int]] = []
            for name in dict.fromkeys(names.tolist()):
                rows = np.flatnonzero(names == name)
                sizes = np.diff(offsets)[rows]
                starts = np.concatenate([[0], np.cumsum(sizes)])
                hashes = np.concatenate([flat[offsets[r] : offsets[r + 1]] for r in rows]) if len(rows) else flat[:0]
                for path in paths.get(name, ()):
                    block = _block(path)
                    words = block.ids(hashes)
                    text, doc = block.candidates(words, starts)
                    at, own, bag = -1, [], frozenset()
                    for t, d in zip(text.tolist(), doc.tolist(), strict=True):
                        if t != at:
                            at, own = t, words[starts[t] : starts[t + 1]].tolist()
                            bag = frozenset(own)
                        other = block.text(d).tolist()
                        most = max(len(own), len(other)) // TOLERANCE
                        if len(bag.difference(other)) > most:
                            continue
                        distance = edit_distance(own, other, most)
                        if distance <= most:
                            r = rows[t]
                            out.append((name, int(h1[r]), int(h2[r]), int(block.h1[d]), int(block.h2[d]), distance))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["table_name", "t1", "t2", "e1", "e2", "distance"])

    return run


def text_pairs(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(table_name, t1, t2, e1, e2, distance): the training and evaluation texts within the tolerance of one another.

    ``rows`` is what sided() gives. A text is named by its two hashes; copies of a text are one.
    """
    spark = rows.sparkSession
    texts = rows.groupBy("table_name", "side", "h1", "h2").agg(F.first("words").alias("words"))
    held_out = written(texts.where("side = 'eval'").drop("side"), "held-out")
    totals = {r.table_name: r.n for r in held_out.groupBy("table_name").agg(F.sum(F.size("words") + 1).alias("n")).collect()}
    if not totals:
        return spark.createDataFrame([], "table_name string, t1 bigint, t2 bigint, e1 bigint, e2 bigint, distance int")
    blocks = F.lit(1)
    for name, n in totals.items():
        blocks = F.when(F.col("table_name") == name, -(-n // block_words)).otherwise(blocks)
    folder = scratch_path(spark, "blocks")
    parted = held_out.select("table_name", F.pmod("h1", blocks).cast("bigint").alias("block"), "h1", "h2", "words")
    made = parted.repartition(max(len(totals), sum(-(-n // block_words) for n in totals.values())), "table_name", "block").sortWithinPartitions("table_name", "block")
    # One row for each block of block_words words comes to the driver: the blocks' places, never their content.
    places: dict[str, list[str]] = {}
    for r in made.mapInArrow(_build(folder), "table_name string, path string").collect():
        places.setdefault(r.table_name, []).append(r.path)
    # A set number of partitions: by size alone, few would be left for what is mostly computing.
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    training = texts.where("side = 'train'").select("table_name", "h1", "h2", "words").repartition(tasks, "h1")
    return training.mapInArrow(_search({k: sorted(v) for k, v in places.items()}), "table_name string, t1 bigint, t2 bigint, e1 bigint, e2 bigint, distance int")


def row_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair of rows of the paired texts: (table_name, train_line, eval_line, train_source, eval_source, eval_split, distance)."""
    key = lambda side, a, b: rows.where(F.col("side") == side).select("table_name", F.col("h1").alias(a), F.col("h2").alias(b), F.col("line_no").alias(f"{side}_line"), F.col("source").alias(f"{side}_source"), F.col("split").alias(f"{side}_split"))
    return (
        pairs.join(key("train", "t1", "t2"), ["table_name", "t1", "t2"])
        .join(key("eval", "e1", "e2"), ["table_name", "e1", "e2"])
        .select("table_name", "train_line", "eval_line", "train_source", "eval_source", "eval_split", "distance")
    )
