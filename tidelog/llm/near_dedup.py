"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the weighted set of its five-word shingles (words are runs of anything but ASCII
white space, weights 1 + ln(count)); a shorter one has all its words as one shingle. The
similarity of two is the probability Jaccard of their weights, which is the usual Jaccard where
all weights are equal.

Signatures: each shingle is a Poisson process whose rate is its weight. Its arrivals come at
exponential steps, each at a random register, and a register keeps the shingle that arrives
first, so two documents agree in a register with just their similarity. A shingle is through as
soon as its next arrival is later than the latest of all registers: nearly all stop at their
first. Arrivals of many documents are drawn at once in numpy.

Banding: documents that agree in the four registers of any of 16 bands meet in a bucket (a pair
at 0.8 is missed once in 4500 times). Within a bucket a sketch, two bits of each of 256 registers,
estimates the similarity to 0.03; pairs below FLOOR go no further. Band keys are counted before
they are shuffled; only rows whose key another row has go on.

Verification, on whole texts: first each document with the one that looks most similar among the
first few of its buckets, which is linear in the rows and joins most groups. A bucket of more than
SPLIT rows is dealt out to several tasks, and its first few rows go to each of them. What remains are pairs
of a bucket that the verified links haven't connected yet. Those are compared in blocks of bounded
rows and bytes, by sketch and then by text, so that no link between two groups is lost however large a bucket
is; only links leave a block. A pair is looked at in the first bucket that both are in. Texts with
equal weights within one task are joined at once and only one goes on.

A group is a connected component of verified links; its class is its smallest id.

Defined results: null ids, and texts without words, are in no group: their class is their id.
Rows that share an id are one document, similar to what any of its texts is; repeated rows are one
row. Extra columns stay, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from tidelog.llm.arrays import U64, Texts, byte_class, gram_hashes, mix, runs, slices, span_hashes
from tidelog.llm.components import components
from tidelog.llm.kit import cut, discard, free_name, map_parts, named, row_lists, small
from tidelog.plans.shipping import map_batches

WORDS = 5
THRESHOLD = 0.8
FLOOR = 0.70
BANDS, ROWS = 16, 4
REGISTERS = 256
FIRST = 64
SPLIT = 512
BLOCK = 256
BLOCK_BYTES = 8_000_000
MET = 200_000


def weighted_shingles(texts: Texts, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers (ascending), hashes and weights of the different shingles of each text."""
    starts, ends, owner = runs(~byte_class("space")[texts.data], texts.offsets)
    words = span_hashes(texts.data, starts, ends)
    grams = gram_hashes(words, size)
    whole = np.flatnonzero(owner[: len(grams)] == owner[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
    text, value = owner[whole], grams[whole]
    n_words = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        first = np.searchsorted(owner, short)
        all_words = np.array([_fold(words[a : a + n]) for a, n in zip(first.tolist(), n_words[short].tolist(), strict=True)], U64)
        text, value = np.concatenate((text, short)), np.concatenate((value, all_words))
    # Sorted by text and value; one sort of both in one number does, unless two values of a text begin alike.
    both = text.astype(U64) << U64(40) | value >> U64(24)
    order = np.argsort(both)
    if (both[order][1:] == both[order][:-1]).any() and (value[order][1:] != value[order][:-1])[both[order][1:] == both[order][:-1]].any():
        order = np.lexsort((value, text))
    text, value = text[order], value[order]
    edges = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])))) if len(order) else order
    counts = np.diff(np.concatenate((edges, [len(order)])))
    return text[edges], value[edges], 1 + np.log(counts)


def _fold(words: np.ndarray) -> np.uint64:
    out = np.full(1, len(words), U64)
    for w in words:
        out = mix(out * U64(0x9FB21C651E98DF25) + w)
    return out[0]


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of ``n`` weighted sets: the shingle of the earliest arrival in each register, 0 for empty sets."""
    earliest = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, U64)
    t, v, w, at, step, width = text, value, weight, np.zeros(len(text)), 0, 1
    while len(t):
        nth = np.arange(step, step + width, dtype=U64)
        drawn = mix(v[:, None] + (nth * U64(2) + U64(1)) * U64(0x9E3779B97F4A7C15))
        place = mix(v[:, None] + (nth * U64(2) + U64(2)) * U64(0xC2B2AE3D27D4EB4F))
        gaps = -np.log(((drawn >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)) / w[:, None]
        arrivals = at[:, None] + np.cumsum(gaps, axis=1)
        cell = (t * registers)[:, None] + ((place >> U64(32)) * U64(registers) >> U64(32)).astype(np.int64)
        flat, times = cell.ravel(), arrivals.ravel()
        np.minimum.at(earliest, flat, times)
        won = times == earliest[flat]
        holder[flat[won]] = np.repeat(v, width)[won]
        latest = earliest.reshape(n, registers).max(axis=1)
        at = arrivals[:, -1]
        on = at < latest[t]
        t, v, w, at = t[on], v[on], w[on], at[on]
        step += width
        width = min(2 * width, 32)
    return holder.reshape(n, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A hash for each band of each signature."""
    parts = signature[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * U64(0x9FB21C651E98DF25) + parts[:, :, k])
    return out


def sketches(signature: np.ndarray) -> np.ndarray:
    """Two mixed bits of each register, in uint64 words."""
    bits = (mix(signature) & U64(3)).astype(np.uint8).reshape(len(signature), -1, 4)
    return np.ascontiguousarray(bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6).view(U64)


def estimates(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of each sketch with each of ``others``."""
    x = some[:, None, :] ^ others[None, :, :]
    differ = np.bitwise_count((x | x >> U64(1)) & U64(0x5555555555555555)).sum(axis=2, dtype=np.int64)
    return 1 - differ / (some.shape[1] * 32) * 4 / 3


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (ascending values, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][in_a], b[1][in_b]
    # For each common value d: the sum over all values of max(w_a / w_a[d], w_b / w_b[d]).
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    ratio = x / y
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    cx, cy = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(y)))
    k = np.searchsorted(ratio, ratio, side="left")
    above, below = only_a + cx[-1] - cx[k], only_b + cy[k]
    # Rounded, so that a similarity of just the threshold isn't lost to the last bits.
    return round(float((1 / (above / x + below / y)).sum()), 12)


SIGNED = StructType([
    StructField("id", LongType()), StructField("tid", LongType()), StructField("same", LongType()), StructField("size", LongType()),
    StructField("keys", ArrayType(LongType())), StructField("sketch", BinaryType()),
])
PAIRS = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("estimate", DoubleType())])


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = len(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row SIGNED for each (id, tid, text) with words: its band keys and sketch, or ``same``, a document of the same weights."""
    met: dict[tuple[int, int], int] = {}
    for batch in map_parts(batches):
        ids, tids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for texts in slices(batch.column(2)):
            text, value, weight = weighted_shingles(texts)
            at = np.searchsorted(text, np.arange(len(texts) + 1))
            prints = [np.zeros(len(texts), U64), np.zeros(len(texts), U64)]
            for k, p in enumerate(prints):
                np.add.at(p, text, mix(value * U64(2 * k + 3) + weight.view(U64)))
            if len(met) > MET:
                met.clear()
            fresh, copies, first = [], [], []
            for i, both in enumerate(zip(prints[0].tolist(), prints[1].tolist(), strict=True)):
                if at[i] == at[i + 1]:
                    continue
                own = int(ids[texts.first + i])
                if both not in met:
                    met[both] = own
                    fresh.append(i)
                elif met[both] != own:
                    copies.append(i)
                    first.append(met[both])
            sizes = np.diff(texts.offsets)
            if fresh:
                fresh = np.array(fresh)
                number = np.full(len(texts), -1)
                number[fresh] = np.arange(len(fresh))
                wanted = number[text] >= 0
                signature = signatures(number[text[wanted]], value[wanted], weight[wanted], len(fresh))
                keys = row_lists(np.full(len(fresh), BANDS), pa.array(band_keys(signature).ravel().view(np.int64)))
                own = [pa.array(x) for x in (ids[texts.first + fresh], tids[texts.first + fresh])]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(fresh), pa.int64()), pa.array(sizes[fresh], pa.int64()), keys, _binary(sketches(signature))], names=SIGNED.names)
            if copies:
                own = [pa.array(x[texts.first + np.array(copies)]) for x in (ids, tids)]
                none = [pa.nulls(len(copies), pa.list_(pa.int64())), pa.nulls(len(copies), pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, pa.array(first, pa.int64()), pa.array(sizes[copies], pa.int64()), *none], names=SIGNED.names)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Runs of rows with equal first ``keys`` columns: whether a run goes on, and the columns' arrays.

    A run comes in pieces of one batch at most. Binary columns become rows of uint64, lists and
    texts arrays of objects.
    """
    last = None
    for batch in batches:
        columns = []
        for c in batch.columns:
            if pa.types.is_binary(c.type):
                flat = np.frombuffer(b"".join(c.to_pylist()), dtype=U64) if len(c) else np.zeros(0, U64)
                columns.append(flat.reshape(len(c), -1))
            elif pa.types.is_list(c.type) or pa.types.is_string(c.type):
                objects = np.empty(len(c), object)
                objects[:] = c.to_pylist()
                columns.append(objects)
            else:
                columns.append(c.to_numpy(zero_copy_only=False))
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(edges, edges[1:], strict=False):
            name = tuple(int(c[a]) for c in columns[:keys])
            yield name == last, [c[a:b] for c in columns]
            last = name


def _most_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, salt, id, sketch) sorted by key and salt: each with the most similar of its group's first rows that has a smaller id."""
    heads, head_ids = np.zeros((0, 8), U64), np.zeros(0, np.int64)
    for goes_on, (_, _, ids, rows) in _groups(batches, 2):
        if not goes_on:
            heads, head_ids = rows[:0], ids[:0]
        room = FIRST - len(heads)
        if room > 0:
            heads, head_ids = np.concatenate((heads, rows[:room])), np.concatenate((head_ids, ids[:room]))
        if len(heads) < 2:
            continue
        for at in range(0, len(ids), BLOCK):
            own = ids[at : at + BLOCK]
            part = estimates(rows[at : at + BLOCK], heads)
            part[head_ids[None, :] >= own[:, None]] = -1
            best = part.argmax(axis=1)
            found = part[np.arange(len(part)), best]
            good = found >= FLOOR
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(head_ids[best[good]]), pa.array(own[good]), pa.array(found[good])], names=PAIRS.names)


MIXED = ["key", "low", "high", "block", "id", "tid", "comp", "keys", "sketch"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows MIXED sorted by key, low and high: each group's columns, and its similar pairs of two components.

    A pair of rows (i, j) comes in one group only: that of the smallest key that both have.
    """

    def pairs(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        key, low, high, block, ids, _, comp, keys, rows = columns[:9]
        left, right = np.flatnonzero(block == low[0]), np.flatnonzero(block == high[0])
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            looks = estimates(rows[some], rows[right])
            good = (looks >= FLOOR) & (comp[some][:, None] != comp[right][None, :])
            if low[0] == high[0]:
                good &= ids[some][:, None] < ids[right][None, :]
            i, j = np.nonzero(good)
            found.append((some[i], right[j], looks[i, j]))
        i, j, looks = (np.concatenate(x) for x in zip(*found, strict=True))
        sets = {k: set(keys[k]) for k in {*i.tolist(), *j.tolist()}}
        here = np.array([min(sets[x] & sets[y]) == key[0] for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
        return columns, i[here], j[here], looks[here]

    held: list[list[np.ndarray]] = []
    for goes_on, columns in _groups(batches, 3):
        if held and not goes_on:
            yield pairs([np.concatenate(x) for x in zip(*held, strict=True)])
            held = []
        held.append(columns)
    if held:
        yield pairs([np.concatenate(x) for x in zip(*held, strict=True)])


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, low, high, id, tid) of groups that are in any of their pairs."""
    for columns, i, j, _ in _blocks(batches):
        rows = np.union1d(i, j)
        yield pa.RecordBatch.from_arrays([pa.array(columns[k][rows]) for k in (0, 1, 2, 4, 5)], names=["key", "low", "high", "id", "tid"])


def _linked(threshold: float):
    """Links (a, b) between components, by whole texts: of two components the pairs that look best are tried first, until one holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, i, j, looks in _blocks(batches):
            ids, comp, texts = columns[4], columns[6].tolist(), columns[9]
            root = {c: c for c in comp}

            def find(c: int, root=root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            links = []
            for k in np.argsort(-looks, kind="stable").tolist():
                x, y = int(i[k]), int(j[k])
                a, b = find(comp[x]), find(comp[y])
                if a == b:
                    continue
                for row in (x, y):
                    if row not in sets:
                        (own,) = slices(pa.array([texts[row]], pa.string()), 1 << 62)
                        sets[row] = weighted_shingles(own)[1:]
                if similarity(sets[x], sets[y]) >= threshold:
                    root[b] = a
                    links.append((int(ids[x]), int(ids[y])))
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in links], pa.int64()), pa.array([max(p) for p in links], pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least so similar, with their similarity.

    All partners of one document a are read with it, the partners of a frequent one dealt out in
    several lots; it comes first in each.
    """
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(500)).cast("int").alias("lots"))
    partners = pairs.join(lots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("lots").cast("long")).alias("lot"), F.col("b").alias("id"))
    hubs = lots.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots").cast("long") - 1)).alias("lot"), F.col("a").alias("id"))
    rows = texts.join(small(cut(partners.unionByName(hubs), "lots")), "id").select("a", "lot", (F.col("id") != F.col("a")).alias("partner"), "id", "text")
    rows = rows.repartition("a", "lot").sortWithinPartitions("a", "lot", "partner", "id")
    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("similarity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_sets = None, []
        for batch in map_parts(batches):
            a, ids = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            out: tuple[list, list, list] = ([], [], [])
            for part in slices(batch.column(4)):
                text, value, weight = weighted_shingles(part)
                at = np.searchsorted(text, np.arange(len(part) + 1))
                for i in range(len(part)):
                    k, own = part.first + i, (value[at[i] : at[i + 1]], weight[at[i] : at[i + 1]])
                    if ids[k] == a[k]:
                        hub, hub_sets = ids[k], [own, *(hub_sets if hub == ids[k] else [])]
                    elif hub == a[k] and (s := max(similarity(x, own) for x in hub_sets)) >= threshold:
                        for x, y in zip(out, (a[k], ids[k], s), strict=True):
                            x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=schema.names)

    return map_batches(rows, run, schema)


def split(met: DataFrame) -> DataFrame:
    """Rows (key, salt, head, id, sketch) of buckets met (key, n, id, tid, sketch): a bucket of more than SPLIT rows in several salts, each with its FIRST rows as heads."""
    salts = F.ceil(F.col("n") / F.lit(SPLIT)).cast("long")
    salt = F.when(F.col("n") > SPLIT, F.pmod(F.xxhash64("id", "tid"), salts)).otherwise(F.lit(0).cast("long"))
    rows = met.select("key", salt.alias("salt"), F.lit(False).alias("head"), "id", "sketch")
    # Spark keeps no more than FIRST rows of a key in each task before it shuffles them.
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id", "tid"))
    heads = met.where(F.col("n") > SPLIT).withColumn("nth", nth).where(F.col("nth") <= FIRST)
    heads = heads.select("key", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(True).alias("head"), "id", "sketch")
    return rows.unionByName(heads)


def deal(labelled: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The rows (key, id, tid, size, comp, sketch) of buckets that hold several components, dealt out as MIXED; and the tables it wrote on the way.

    The rows of a bucket's largest component never meet each other: they go once to each block of
    the other rows, and these go to all blocks. A huge group with a few strangers in its bucket so
    makes about as many rows as it has. A block holds about BLOCK rows and BLOCK_BYTES of text.
    """
    several = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    several = cut(several.select("key"), "mixed")
    rest = labelled.join(small(several), "key")
    sizes = rest.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    sizes = sizes.groupBy("key").agg(F.max_by(F.struct("comp", "n", "bytes"), F.struct("n", -F.col("comp"))).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES)), F.lit(1)).cast("long")
    inner, outer = blocks(F.col("main.n"), F.col("main.bytes")), blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes"))
    sizes = cut(sizes.select("key", F.col("main.comp").alias("main"), inner.alias("inner"), outer.alias("outer")), "mixed")
    keys = rest.groupBy("id", "tid").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    dealt = rest.join(small(sizes), "key").join(keys, ["id", "tid"])
    in_main, spread = F.col("comp") == F.col("main"), F.xxhash64("id", "tid")
    dealt = dealt.withColumn("block", F.when(in_main, F.pmod(spread, "inner")).otherwise(F.col("inner") + F.pmod(spread, "outer")))
    others = F.sequence(F.when(in_main, F.col("inner")).otherwise(F.lit(0).cast("long")), F.col("inner") + F.col("outer") - 1)
    dealt = dealt.withColumn("other", F.explode(others))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return cut(dealt.select(MIXED), "dealt"), [several, sizes]


def near_links(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links (a, b) whose components are the groups of near-duplicates."""
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("id", F.xxhash64("text").alias("tid"), "text")
    signed = cut(map_batches(rows, _sign, SIGNED), "signed")
    copies = signed.where("same IS NOT NULL").select(F.least("id", "same").alias("a"), F.greatest("id", "same").alias("b"))
    banded = signed.where("same IS NULL").select(F.explode("keys").alias("key"), "id", "tid", "size", "sketch")
    shared = cut(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared_keys")
    met = cut(banded.join(small(shared), "key").select("key", "n", "id", "tid", "size", "sketch"), "bands")
    texts = cut(rows.join(small(cut(met.select("id").distinct(), "met_ids")), "id", "left_semi"), "met_texts")

    first = split(met).repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("head"), "id").drop("head")
    first = map_batches(first, _most_similar, PAIRS)
    first = cut(first.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")).select("a", "b"), "first_pairs")
    links = cut(verified(first, texts, threshold).select("a", "b").unionByName(copies), "first_links")

    comps = components(links)
    labelled = met.join(small(comps), "id", "left").select("key", "id", "tid", "size", F.coalesce("comp", "id").alias("comp"), "sketch")
    labelled = cut(labelled, "labelled")
    dealt, mixed = deal(labelled)
    place, one = ["key", "low", "high"], ["key", "low", "high", "id", "tid"]
    in_pairs = map_batches(dealt.repartition(*place).sortWithinPartitions(*one), _involved, StructType([StructField(c, LongType()) for c in one]))
    wanted = cut(dealt.join(in_pairs, one, "left_semi").dropDuplicates(one), "wanted")
    needed = small(cut(wanted.select("id").distinct(), "wanted_ids"))
    read = texts.join(needed, "id", "left_semi").join(wanted, ["id", "tid"]).select(*MIXED, "text")
    read = read.repartition(*place).sortWithinPartitions(*one)
    more = cut(map_batches(read, _linked(threshold), StructType([StructField("a", LongType()), StructField("b", LongType())])), "rest_links")
    discard(signed, shared, met, texts, first, labelled, *mixed, dealt, wanted)
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with class_id, the smallest id of the document's group."""
    own, least = free_name(docs, "class_of"), free_name(docs, "class_min")
    classes = components(near_links(docs, id_col, text_col, threshold)).withColumnsRenamed({"id": own, "comp": least})
    joined = docs.join(classes, named(id_col) == F.col(own), "left")
    return joined.select(*map(named, docs.columns), F.coalesce(least, named(id_col)).alias(free_name(docs, "class_id")))
