"""Quality rules: base counts, and a linear-chain CRF that tells content lines from boilerplate.

Words are runs of anything but ASCII white space. The base counts of a document fail it if it
has fewer than 10 words, or if more than a fifth of its words lie in five-word windows that occur
twice or more in it. Of the others, the method decides: each line with a word is described by
its form (length, symbols, case, digits, repetition, place, words of notices); Viterbi decoding
finds the most probable sequence of content and boilerplate lines; a document is kept if the
lines marked content hold at least ``share`` of its words.

The CRF is trained by gradient ascent on documents with quality labels, each line taking its
document's label. The sample is bounded: at most ``per_class`` label rows of each label, those
of the smallest hash, and of a document with more than ``max_lines`` worded lines a run of so many,
which begins where its hash says. Decoding looks at every line of every document. Without
labelled documents of both kinds all lines count as content.

Defined results: null text has no words and fails; an unlabelled or doubly labelled document is
no problem, each label row is one example; null labels and ids are no examples. Extra columns stay,
whatever their names. An empty table gives an empty table. Only labels are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from tidelog.llm.arrays import U64, Texts, byte_class, gram_hashes, mix, runs, slices, span_hashes
from tidelog.llm.kit import add_columns, free_name, map_parts, named
from tidelog.plans.shipping import map_batches

SHARE = 0.5
PER_CLASS, MAX_LINES = 1000, 64

# Words of notices and menus.
NOTICE_WORDS = (
    "license licensed licence copyright rights reserved cookie cookies privacy policy terms login subscribe newsletter menu home share click"
).split()

FEATURES = (
    "bias length symbols upper digits marks word_length repeated_line repeated_words distinct_words first last notice".split()
)


@cache
def _notice_hashes() -> np.ndarray:
    column = pa.array(NOTICE_WORDS)
    return np.concatenate([span_hashes(t.data, t.offsets[:-1], t.offsets[1:]) for t in slices(column)])


@dataclass
class Lines:
    """The lines with a word: text number, line number, words, features; and the base counts."""

    text: np.ndarray
    line: np.ndarray
    words: np.ndarray
    features: np.ndarray
    base: np.ndarray
    all_lines: np.ndarray


@cache
def _classes() -> np.ndarray:
    """For each byte: whether it starts a code point, is a symbol, upper case, a letter, a digit, a mark."""
    out = np.zeros((6, 256), bool)
    out[0] = True
    out[0, 0x80:0xC0] = False
    out[1] = byte_class("symbol")
    out[2, 0x41:0x5B] = True
    out[3, 0x41:0x5B] = out[3, 0x61:0x7B] = True
    out[4, 0x30:0x3A] = True
    out[5, list(b"!?*#$%&|<>{}[]=_~^")] = True
    return out


def describe(texts: Texts) -> Lines:
    """Base counts of each text, and the features of each of its lines that has a word."""
    data, offsets, n = texts.data, texts.offsets, len(texts)
    space = byte_class("space")[data]
    starts, ends, owner = runs(~space, offsets)
    hashes = span_hashes(data, starts, ends)
    per_text = np.searchsorted(owner, np.arange(n + 1))
    n_words = np.diff(per_text)

    total = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    points = total(_classes()[0][data] & ~space)
    symbols = total(_classes()[1][data])

    # Words in five-word windows that occur twice or more in their text.
    grams = gram_hashes(hashes, 5)
    whole = np.flatnonzero(owner[: len(grams)] == owner[4:]) if len(grams) else np.zeros(0, np.int64)
    keys = mix(grams[whole] ^ mix(owner[whole].astype(U64) + U64(1)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(whole), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, whole[twice], 1)
    np.add.at(edge, whole[twice] + 5, -1)
    repeats = total(np.cumsum(edge[:-1]) > 0)

    # Lines: what line feeds and the ends of texts leave.
    feeds = np.flatnonzero(data == 0x0A)
    feed_text = np.searchsorted(offsets, feeds, side="right") - 1
    begin = np.concatenate((offsets[:-1], feeds + 1))
    text = np.concatenate((np.arange(n), feed_text))
    order = np.lexsort((begin, text))
    begin, text = begin[order], text[order]
    stop = np.empty_like(begin)
    stop[:-1] = np.where(text[1:] == text[:-1], begin[1:] - 1, offsets[text[:-1] + 1])
    stop[-1:] = offsets[-1]
    all_lines = np.bincount(text, minlength=n)
    line = np.arange(len(text)) - np.searchsorted(text, text)
    w0, w1 = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    worded = w1 > w0
    begin, stop, text, line, w0, w1 = (x[worded] for x in (begin, stop, text, line, w0, w1))
    line_keys = mix(span_hashes(data, begin, stop) ^ mix(text.astype(U64) + U64(1)))
    seen_first = np.zeros(len(text), bool)
    seen_first[np.unique(line_keys, return_index=True)[1]] = True
    dup_lines = np.bincount(text[~seen_first], minlength=n)

    base = np.stack((n_words, points[offsets[1:]] - points[offsets[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], dup_lines, repeats[per_text[1:]] - repeats[per_text[:-1]]))

    words = (w1 - w0).astype(np.float64)
    chars = np.maximum(points[stop] - points[begin], 1).astype(np.float64)
    within = lambda k: (lambda c: c[stop] - c[begin])(total(_classes()[k][data]))
    letters = np.maximum(within(3), 1)
    in_line = np.repeat(np.arange(len(w0)), w1 - w0)
    pairs = mix(hashes ^ mix(in_line.astype(U64) + U64(1)))
    distinct = np.bincount(in_line[np.unique(pairs, return_index=True)[1]], minlength=len(w0))
    notices = np.bincount(in_line[np.isin(_lowered(data, starts, ends), _notice_hashes())], minlength=len(w0))
    firsts = np.ones(len(text), bool)
    firsts[1:] = text[1:] != text[:-1]
    features = np.stack((
        np.ones(len(words)), np.log1p(words) / 4, within(1) / chars, within(2) / letters, within(4) / chars, within(5) / chars,
        chars / words / 10, ~seen_first, (repeats[w1] - repeats[w0]) / words,
        distinct / words, firsts, np.roll(firsts, -1), np.minimum(notices, 3) / 3,
    ), axis=1).astype(np.float64)
    return Lines(text, line, words, features, base, all_lines)


def _lowered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words in lower case, without one mark at their end."""
    low = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)
    tail = np.isin(low[ends - 1], np.frombuffer(b".,;:!?", np.uint8)) & (ends - starts > 1) if len(ends) else np.zeros(0, bool)
    return span_hashes(low, starts, ends - tail)


@dataclass
class Crf:
    """Weights of the features for content over boilerplate, and of content for neighbours."""

    weights: np.ndarray
    step: np.ndarray

    def decode(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Viterbi: whether each line is content; all texts advance together, line by line."""
        score = features @ self.weights
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((first, [len(text)])))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        best = np.stack((np.zeros(len(first)), score[first]), axis=1) if len(first) else np.zeros((0, 2))
        back = np.zeros((len(text), 2), bool)
        for t in range(1, size[0] if len(size) else 0):
            m = int(np.searchsorted(-size, -t, side="left"))
            at = first[:m] + t
            paths = best[:m, :, None] + self.step
            back[at] = paths[:, 1] > paths[:, 0]
            best[:m] = paths.max(axis=1)
            best[:m, 1] += score[at]
        out = np.zeros(len(text), bool)
        state = best[:, 1] > best[:, 0]
        for t in range((size[0] if len(size) else 0) - 1, -1, -1):
            m = int(np.searchsorted(-size, -t, side="left"))
            at = first[:m] + t
            out[at] = state[:m]
            state[:m] = back[at, state[:m].astype(np.int64)]
        return out


ALL_CONTENT = Crf(np.eye(len(FEATURES))[0], np.zeros((2, 2)))


def train(examples: list[tuple[np.ndarray, bool]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3, step_decay: float = 0.1) -> Crf:
    """Gradient ascent (Adam) on the mean log-likelihood; the classes weigh the same.

    As all lines of an example have one label, neighbours seem to agree more than they do;
    ``step_decay`` holds their weights down, so that a few odd lines don't turn a document.
    """
    if len({good for _, good in examples}) < 2:
        return ALL_CONTENT
    d, length, k = len(examples), max(len(x) for x, _ in examples), len(FEATURES)
    x, mask = np.zeros((d, length, k)), np.zeros((d, length), bool)
    for i, (f, _) in enumerate(examples):
        x[i, : len(f)], mask[i, : len(f)] = f, True
    good = np.array([g for _, g in examples])
    weight = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) / mask.sum(axis=1)
    truth = good.astype(int)
    theta, m1, m2 = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    lines = mask.sum(axis=1)
    for t in range(1, rounds + 1):
        score, step = x @ theta[:k], theta[k:].reshape(2, 2)
        emit = np.stack((np.zeros_like(score), score), axis=2)
        alpha, beta = np.zeros((d, length, 2)), np.zeros((d, length, 2))
        alpha[:, 0] = emit[:, 0]
        for i in range(1, length):
            new = emit[:, i] + np.logaddexp(alpha[:, i - 1, :1] + step[0], alpha[:, i - 1, 1:] + step[1])
            alpha[:, i] = np.where(mask[:, i, None], new, alpha[:, i - 1])
        for i in range(length - 2, -1, -1):
            onward = (emit[:, i + 1] + beta[:, i + 1])[:, None, :] + step
            beta[:, i] = np.where(mask[:, i + 1, None], np.logaddexp(onward[:, :, 0], onward[:, :, 1]), 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        content = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
        grad = np.zeros(k + 4)
        grad[:k] = np.einsum("d,dl,dlk->k", weight, truth[:, None] * mask - content, x)
        both = mask[:, 1:, None, None]
        joint = np.exp(alpha[:, :-1, :, None] + step + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]) * both
        expected = np.einsum("d,dlab->ab", weight, joint)
        np.add.at(expected, (truth, truth), -weight * (lines - 1))
        grad[k:] = -expected.ravel()
        grad[:k] -= decay * theta[:k]
        grad[k:] -= step_decay * theta[k:]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return Crf(theta[:k], theta[k:].reshape(2, 2))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, max_lines: int) -> list[tuple[np.ndarray, bool]]:
    """Line features of at most ``per_class`` documents of each label."""
    marks = labels.select(named(id_col).alias("id"), named(label_col).alias("label")).where("id IS NOT NULL")
    of = lambda q: marks.where(F.col("label") == q).select("id", F.lit(bool(q)).alias("good")).orderBy(F.xxhash64("id"), "id").limit(per_class)
    # Two limits bound what is broadcast.
    own = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    chosen = own.join(F.broadcast(of(0).unionByName(of(1))), "id").select(F.xxhash64("id", "text").alias("place"), "good", "text")
    schema = StructType([StructField("place", LongType()), StructField("good", BooleanType()), StructField("lines", IntegerType()), StructField("x", ArrayType(FloatType()))])

    def run(batches):
        for batch in map_parts(batches):
            rows = []
            places, good = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for texts in slices(batch.column(2)):
                lines = describe(texts)
                at = np.searchsorted(lines.text, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    own, place = lines.features[at[i] : at[i + 1]], places[texts.first + i]
                    begin = place % (len(own) - max_lines + 1) if len(own) > max_lines else 0
                    own = own[begin : begin + max_lines]
                    if len(own):
                        rows.append((place, good[texts.first + i], len(own), own.astype(np.float32).ravel().tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=pa.schema([("place", pa.int64()), ("good", pa.bool_()), ("lines", pa.int32()), ("x", pa.list_(pa.float32()))]))

    # An id that stands in very many rows can't make the sample larger.
    found = map_batches(chosen, run, schema).orderBy("place", "good", "lines", "x").limit(2 * per_class).collect()
    return [(np.array(r["x"], np.float64).reshape(r["lines"], -1), r["good"]) for r in found]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, max_lines: int = MAX_LINES) -> Crf:
    return train(training_sample(docs, labels, id_col, text_col, label_col, per_class, max_lines))


def judge(docs: DataFrame, model: Crf, text_col: str = "text", share: float = SHARE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the base counts, base_failed, content_share, line_marks and kept.

    line_marks has a letter for each line: C content, B boilerplate, - without a word.
    """
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kinds = [*((c, LongType()) for c in counts), ("base_failed", BooleanType()), ("content_share", DoubleType()), ("line_marks", StringType()), ("kept", BooleanType())]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        base, failed, part, marks, kept = [], [], [], [], []
        for texts in slices(batch.column(at)):
            lines, n = describe(texts), len(texts)
            content = shared.value.decode(lines.features, lines.text)
            n_words, n_repeat = lines.base[0], lines.base[4]
            own = np.bincount(lines.text, lines.words * content, n) / np.maximum(n_words, 1)
            bad = (n_words < 10) | (100 * n_repeat > 20 * n_words)
            base.append(lines.base)
            failed.append(bad)
            part.append(own)
            kept.append(~bad & (own >= share))
            first = np.concatenate(([0], np.cumsum(lines.all_lines)))
            letters = np.full(first[-1], ord("-"), np.uint8)
            letters[first[lines.text] + lines.line] = np.where(content, ord("C"), ord("B"))
            raw = letters.tobytes().decode("ascii")
            marks += [raw[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        joined = np.concatenate(base, axis=1) if base else np.zeros((5, 0), np.int64)
        flat = lambda xs, kind: pa.array(np.concatenate(xs) if xs else [], kind)
        return [*(pa.array(x, pa.int64()) for x in joined), flat(failed, pa.bool_()), flat(part, pa.float64()), pa.array(marks, pa.string()), flat(kept, pa.bool_())]

    return add_columns(docs, [StructField(free_name(docs, c), kind) for c, kind in kinds], make, keep)
