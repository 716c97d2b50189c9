"""Benchmark decontamination by Wu-Manber search over words.

A text's words are its runs of a-z, 0-9 and all characters beyond ASCII, after A-Z are
lower-cased. A pattern is a window of 13 consecutive words of a benchmark item; an item of fewer
words (but not none) is one pattern by itself. The patterns of one length m share three tables,
as in Wu and Manber's multi-pattern search, with words for characters and blocks of two words:

* the shift table tells, for the block under the window's end, how far no pattern can end; most
  blocks of a document occur in no pattern, so the search moves on by m - 1 words at once;
* where the shift is 0, the block's hash picks a bucket of patterns that end in it, and the hash
  of the window's first block leaves out those that start otherwise;
* the words are then compared byte by byte, so what is reported does occur.

The search runs in many lanes at a time, each over some hundreds of window ends, in numpy.

The tables of a block of at most ``block_bytes`` of benchmark text go to the executors: one buffer
of words, and for each pattern a key, a place in the buffer and an item, about ten times the
text's bytes, with a shift table of eight slots a pattern. Of a larger benchmark each block is searched by a pass
over the texts, which writes what it found by the text's hash, and the last pass takes that
in. Documents are never shuffled, unless the documents hit by earlier blocks are too many to broadcast.

Defined results: null or wordless texts have no words and no hits; null items have no pattern;
an item_id that stands in several rows counts once. A document is contaminated if it has a hit
word and 20 * n_hit >= n_words. Extra columns stay, whatever their names. An empty table gives an
empty table, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidelog.llm.arrays import U64, Texts, byte_class, counts_per_text, mix, runs, slices, span_hashes
from tidelog.llm.kit import add_columns, cut, free_name, named, row_lists, small

WINDOW = 13
BLOCK_BYTES = 8_000_000
LANE = 512
LEAST_BITS, MOST_BITS = 16, 26


@cache
def lower_case() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def words_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, ends, text numbers and hashes of the words."""
    data = lower_case()[texts.data]
    starts, ends, owner = runs(byte_class("word13")[data], texts.offsets)
    return data, starts, ends, owner, span_hashes(data, starts, ends)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9FB21C651E98DF25) + b)


@dataclass
class Words:
    """The words of a benchmark's items, each followed by a space in ``data``; their starts, ends and hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


class Patterns:
    """The tables of all patterns of one length, in words: those that begin at the words ``first`` of items ``item``."""

    def __init__(self, length: int, words: Words, first: np.ndarray, item: np.ndarray, names: list[str]) -> None:
        self.length, self.block, self.names, self.data = length, min(2, length), names, words.data
        bits = min(max(int(8 * len(first)).bit_length(), LEAST_BITS), MOST_BITS)
        self.mask = U64((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.block + 1, dtype=np.uint8)
        # Later blocks have smaller shifts, which so prevail.
        for k in range(self.block - 1, length):
            self.shift[(self.blocks(words.hashes, first + k) & self.mask).astype(np.int64)] = length - 1 - k
        key = _pair(self.blocks(words.hashes, first + length - 1), self.blocks(words.hashes, first + self.block - 1))
        order = np.argsort(key, kind="stable")
        self.keys, self.item = key[order], item[order].astype(np.int32)
        self.start, self.end = words.starts[first][order], words.ends[first + length - 1][order]

    def blocks(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hash of the block that ends in each word ``last``."""
        return hashes[last] if self.block == 1 else _pair(hashes[last - 1], hashes[last])

    def search(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, list[str]]]:
        """Last word and items of every occurrence; text i has the words first[i] up to first[i + 1]."""
        begin, end = first[:-1] + self.length - 1, first[1:]
        lanes = np.maximum(0, -(-(end - begin) // LANE))
        which = np.repeat(np.arange(len(begin)), lanes)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[which] + nth * LANE
        stop = np.minimum(at + LANE, end[which])
        near = []
        while len(at):
            shift = self.shift[(self.blocks(hashes, at) & self.mask).astype(np.int64)]
            near.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        if not near:
            return
        near = np.concatenate(near)
        key = _pair(self.blocks(hashes, near), self.blocks(hashes, near - self.length + self.block))
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        some = high > low
        met: dict[int, tuple[bytes, list[str]]] = {}
        for p, a, b in zip(near[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
            text = _joined(data, starts, ends, p - self.length + 1, p + 1)
            if a not in met or met[a][0] != text:
                same = (k for k in range(a, b) if self.data[self.start[k] : self.end[k]].tobytes() == text)
                met[a] = text, sorted({self.names[self.item[k]] for k in same})
            if met[a][1]:
                yield p, met[a][1]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))


def compile_patterns(items: list[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    """Tables for the items (id, text), one for each length of pattern."""
    names = [name for name, _ in items]
    parts, owners, at = [], [], 0
    for texts in slices(pa.array([text for _, text in items], pa.string())):
        data, starts, ends, owner, hashes = words_of(texts)
        sizes = ends - starts
        begin = np.cumsum(sizes + 1) - sizes - 1
        joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        joined[np.repeat(begin, sizes) + within] = data[np.repeat(starts, sizes) + within]
        parts.append((joined, begin + at, begin + sizes + at, hashes))
        owners.append(owner + texts.first)
        at += len(joined)
    if not parts:
        return []
    words, owner = Words(*(np.concatenate(x) for x in zip(*parts, strict=True))), np.concatenate(owners)
    n = np.bincount(owner, minlength=len(items))
    length = np.minimum(n, window)
    # Where a pattern can begin: so many words before its item's end.
    left = np.repeat(np.cumsum(n), n) - np.arange(len(owner))
    first = np.flatnonzero(left >= length[owner])
    of = length[owner[first]]
    return [Patterns(int(m), words, first[of == m], owner[first[of == m]], names) for m in np.unique(of)]


def _search_batch(tables: list[Patterns], column: pa.Array, prior: tuple[list, list] | None) -> list[pa.Array]:
    """n_words, hit ranges and items of each text, with those of earlier blocks."""
    n_words, ranges, items = [], [], []
    for texts in slices(column):
        data, starts, ends, owner, hashes = words_of(texts)
        counts = counts_per_text(owner, len(texts))
        first = np.concatenate(([0], np.cumsum(counts)))
        edge = np.zeros(len(starts) + 1, np.int32)
        found: dict[int, set[str]] = {}
        for table in tables:
            for p, names in table.search(data, starts, ends, hashes, first):
                edge[p - table.length + 1] += 1
                edge[p + 1] -= 1
                found.setdefault(int(owner[p]), set()).update(names)
        if prior:
            for i in range(len(texts)):
                for a, b in prior[0][texts.first + i]:
                    edge[first[i] + a] += 1
                    edge[first[i] + b] -= 1
                if prior[1][texts.first + i]:
                    found.setdefault(i, set()).update(prior[1][texts.first + i])
        a, b, of = runs(np.cumsum(edge[:-1]) > 0, first)
        n_words.append(counts)
        ranges.append((counts_per_text(of, len(texts)), a - first[of], b - first[of]))
        items += [sorted(found.get(i, ())) for i in range(len(texts))]
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*ranges, strict=True)] or [np.zeros(0, np.int64)] * 3
    pairs = pa.StructArray.from_arrays([pa.array(joined[1], pa.int32()), pa.array(joined[2], pa.int32())], ["start", "stop"])
    return [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), row_lists(joined[0], pairs), pa.array(items, pa.list_(pa.string()))]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items, some megabytes at a time."""
    block, size = [], 0
    rows = benchmark.select(named(id_col).cast("string").alias("id"), named(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    for name, text in rows.toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text)
    yield block


def overlaps(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, hits, items, n_hit and contaminated.

    hits are ranges of words (start, stop) inside occurrences, items the ids, as strings and
    sorted, of the items that occur.
    """
    spark = docs.sparkSession
    n_words, hits, items, n_hit, *prior = (free_name(docs, x) for x in ("n_words", "hits", "items", "n_hit", "hit_h1", "hit_h2", "hit_ranges", "hit_items"))
    pair = StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])
    fields = [StructField("n_words", LongType()), StructField("hits", ArrayType(pair)), StructField("items", ArrayType(StringType()))]
    blocks = item_blocks(benchmark, item_col, item_text, block_bytes)
    block, following, earlier = next(blocks), next(blocks, None), []
    hashes = lambda x: [F.xxhash64(x, F.lit(seed)) for seed in (1, 2)]
    while following is not None:
        tables = spark.sparkContext.broadcast(compile_patterns(block, window))
        found = add_columns(docs.select(named(text_col).alias("text")), fields, _searcher(tables, 0, False)).where(F.size("items") > 0)
        found = found.select(*(h.alias(n) for h, n in zip(hashes(F.col("text")), ("h1", "h2"), strict=True)), "hits", "items")
        # Equal texts have equal hits.
        earlier.append(cut(found.groupBy("h1", "h2").agg(F.first("hits").alias("hits"), F.first("items").alias("items")), "overlaps"))
        tables.destroy()
        block, following = following, next(blocks, None)
    rows, kept = docs, docs.columns if keep is None else keep
    if earlier:
        met = reduce(DataFrame.unionByName, earlier).groupBy("h1", "h2")
        met = cut(met.agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items")), "overlaps")
        met = small(met).toDF(*prior)
        same = [h == F.col(n) for h, n in zip(hashes(named(text_col)), prior[:2], strict=True)]
        rows = docs.join(met, same[0] & same[1], "left").select(*map(named, docs.columns), *prior[2:])
    tables = spark.sparkContext.broadcast(compile_patterns(block, window))
    fields = [StructField(name, f.dataType) for name, f in zip((n_words, hits, items), fields, strict=True)]
    out = add_columns(rows, fields, _searcher(tables, docs.columns.index(text_col), bool(earlier)), kept)
    out = out.withColumn(n_hit, F.aggregate(hits, F.lit(0).cast("long"), lambda total, r: total + r["stop"] - r["start"]))
    return out.withColumn(free_name(docs, "contaminated"), contaminated(F.col(n_hit), F.col(n_words)))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _searcher(tables, at: int, with_prior: bool):
    """The columns of _search_batch; with earlier blocks' ranges and items in the batch's last two columns."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        prior = None
        if with_prior:
            ranges, items = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            prior = [[(r["start"], r["stop"]) for r in x or ()] for x in ranges], [x or () for x in items]
        return _search_batch(tables.value, batch.column(at), prior)

    return make
