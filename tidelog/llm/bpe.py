"""BPE encoding and decoding with forced boundaries, for tokenizer files with word ends.

A word's bytes are its first symbols, the last one marked as a word's end. Two neighbouring
symbols that stand side by side inside no token of the vocabulary can't end up in one token, so
the word is cut there before any merge. The fragments are encoded by themselves and put together
again; most are short and few are different, so each task keeps those it has met of late, up to
a number of bytes; words of more than SHORT characters are never kept.

Within a fragment, the pair of lowest rank is merged first, the leftmost of several; fragments
of many symbols use a heap, so a long run of letters costs n log n, and a word with cuts as many
steps as it has bytes.

Before that, special tokens are cut out of the raw text; the rest is composed (NFC), lower-cased
character by character and split into words by the file's pattern. Decoding joins the tokens by
a space, as is done where the file names no decoder. Files that ask for other steps (another
normaliser, byte-level words without ends, a decoder, dropout or byte fallback) are refused with
a ValueError that names the step.

Defined results: null or empty text has no ids and decodes to an empty text. Extra columns stay.
Nothing is shuffled and each row's result depends on its text alone.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from tidelog.llm.kit import add_columns, free_name, row_lists

KEPT_BYTES = 40_000_000
SHORT = 64
LONG = 48
SIDE = 1 << 32

# What the tokenizer files write as \s.
SPACE = r"\p{White_Space}"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: itself if printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Recent(dict):
    """What ``make`` returned for the keys met of late: two generations of about ``kept_bytes`` each.

    Keys longer than SHORT are made anew each time.
    """

    def __init__(self, make, kept_bytes: int = KEPT_BYTES, length=len) -> None:
        super().__init__()
        self.make, self.kept_bytes, self.room, self.length, self.older = make, kept_bytes, kept_bytes, length, {}

    def __missing__(self, key):
        value = self.older.get(key) or self.make(key)
        n = self.length(key)
        if n <= SHORT:
            # A key, a tuple and their place in the table, about.
            self.room -= 250 + 2 * n + 8 * len(value)
            if self.room < 0:
                self.older = dict(self)
                self.clear()
                self.room = self.kept_bytes
            self[key] = value
        return value


def _shape(part: object) -> object:
    """A step of a tokenizer file without what doesn't change ids: its types and settings."""
    if isinstance(part, list):
        return [_shape(x) for x in part]
    if isinstance(part, dict):
        return {k: _shape(v) for k, v in part.items() if k not in ("trim_offsets", "pattern", "content")}
    return part


# The steps this module takes, as tokenizer files write them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace"}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]}
PLAIN = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def check_file(spec: dict) -> None:
    """Raise a ValueError unless the tokenizer file asks for just the steps that this module takes."""
    model = spec["model"]
    if model.get("type") != "BPE" or not model.get("end_of_word_suffix"):
        raise ValueError("the tokenizer's model must be BPE with an end-of-word suffix")
    if odd := [k for k, v in PLAIN.items() if model.get(k, v) != v]:
        raise ValueError(f"the tokenizer's model sets {', '.join(odd)}")
    for name, wanted in (("normalizer", NORMALIZER), ("pre_tokenizer", PRE_TOKENIZER), ("post_processor", None), ("decoder", None)):
        if _shape(spec.get(name)) != wanted:
            raise ValueError(f"the tokenizer's {name} isn't the one this module follows")
    replace = spec["normalizer"]["normalizers"][1]
    if replace["pattern"] != {"Regex": r"\s+"} or replace["content"] != " ":
        raise ValueError("the tokenizer's normalizer replaces other things than white space")
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("the tokenizer's added tokens are matched in another way")


class Bpe:
    """The tokenizer of a JSON file's text."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        check_file(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        ranked = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # By the ids of a pair, first * SIDE + second: its rank; by rank: what it becomes.
        self.ranks: dict[int, int] = {}
        self.becomes: list[int] = []
        for rank, (x, y) in enumerate(ranked):
            self.ranks[self.vocab[x] * SIDE + self.vocab[y]] = rank
            self.becomes.append(self.vocab[x + y])
        letters = byte_letters()
        self.symbols = [self.vocab.get(x) for x in letters]
        self.last_symbols = [self.vocab.get(x + self.end) for x in letters]
        self.inside = self._pairs_inside(letters)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.by_letters = r"|[\p{L}]+|" in pattern and pattern.endswith(r"|[^\s\p{L}\p{N}]+")
        self.words = regex.compile(pattern.replace(r"\s", SPACE)).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.space = regex.compile(f"[{SPACE}]+").split
        self.marks = {t[0] for t in self.special}
        self.chunk = Recent(self._chunk)
        self.word = Recent(self._word, KEPT_BYTES // 10)
        self.fragment = Recent(self._fragment, KEPT_BYTES // 10, lambda key: len(key[0]))

    def _pairs_inside(self, letters: list[str]) -> bytearray:
        """1 at first * 512 + second for neighbours inside a token; a word's last byte counts from 256."""
        number = {x: b for b, x in enumerate(letters)}
        found = bytearray(512 * 512)
        for token in self.vocab.keys() - self.special.keys():
            ends = bool(self.end) and token.endswith(self.end)
            own = [number[x] for x in (token[: -len(self.end)] if ends else token)]
            if ends and own:
                own[-1] += 256
            for x, y in zip(own, own[1:], strict=False):
                found[x * 512 + y] = 1
        return found

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of what stands between white space, which no word of the pattern crosses."""
        # Letters, or letters and a mark, are what the pattern would make of them.
        if self.by_letters and chunk.isalpha():
            return self._word(chunk)
        if self.by_letters and chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():
            return self.chunk[chunk[:-1]] + self.word[chunk[-1]]
        return tuple(chain.from_iterable(map(self.word.__getitem__, self.words(chunk))))

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        inside, start, last, ids = self.inside, 0, len(raw) - 1, []
        before = raw[0] << 9
        for i in range(1, last):
            if not inside[before + raw[i]]:
                ids += self.fragment[raw[start:i], False]
                start = i
            before = raw[i] << 9
        if last > 0 and not inside[before + raw[last] + 256]:
            ids += self.fragment[raw[start:last], False]
            start = last
        ids += self.fragment[raw[start:], True] if start else self._fragment((raw, True))
        return tuple(ids)

    def _fragment(self, key: tuple[bytes, bool]) -> tuple[int, ...]:
        raw, ends = key
        symbols = [self.symbols[b] for b in raw]
        if ends:
            symbols[-1] = self.last_symbols[raw[-1]]
        if None not in symbols:
            return tuple(self._merged(symbols))
        # A byte that the vocabulary lacks has no token and joins nothing.
        ids, start = [], 0
        for k in [*(i for i, x in enumerate(symbols) if x is None), len(symbols)]:
            ids += self._merged(symbols[start:k])
            start = k + 1
        return tuple(ids)

    def _merged(self, symbols: list[int]) -> list[int]:
        return self._merge_long(symbols) if len(symbols) > LONG else self._merge(symbols)

    def _merge(self, symbols: list[int]) -> list[int]:
        rank, last = self.ranks.get, len(self.becomes)
        ranks = [rank(x * SIDE + y, last) for x, y in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < last:
            i = ranks.index(least)
            new = symbols[i] = self.becomes[least]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] * SIDE + new, last)
            if i < len(ranks):
                ranks[i] = rank(new * SIDE + symbols[i + 1], last)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        n, rank = len(symbols), self.ranks.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, x, y) for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(x * SIDE + y)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != x or symbols[j] != y:
                continue
            symbols[i], symbols[j] = self.becomes[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(symbols[a] * SIDE + symbols[b])) is not None:
                    heapq.heappush(heap, (r, a, symbols[a], symbols[b]))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.cut(text) if any(m in text for m in self.marks) else (text,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            if not part.isascii():
                # Lower-casing by characters: a capital sigma has one small form wherever it stands.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            # Python's own split also takes the four information separators for white space.
            chunks = filter(None, self.space(part.lower())) if any(map(part.__contains__, "\x1c\x1d\x1e\x1f")) else part.lower().split()
            ids += chain.from_iterable(map(self.chunk.__getitem__, chunks))
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


_built: dict[int, Bpe] = {}


def _of(source) -> Bpe:
    """The tokenizer of a broadcast text, built once in each Python worker."""
    if source.value is not None and hash(source.value) not in _built:
        _built.clear()
        _built[hash(source.value)] = Bpe(source.value)
    return _built[hash(source.value)]


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ids (array<int>) and, if ``with_text``, decoded.

    The driver reads the tokenizer's file, whose size the vocabulary bounds, and broadcasts it.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    at = docs.columns.index(text_col)
    fields = [StructField(free_name(docs, "ids"), ArrayType(IntegerType()))]
    fields += [StructField(free_name(docs, "decoded"), StringType())] * with_text

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = _of(source)
        ids = [bpe.encode(t) if t else [] for t in batch.column(at).to_pylist()]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())))
        return [row_lists(counts, flat), *([pa.array(map(bpe.decode, ids), pa.string())] if with_text else [])]

    return add_columns(docs, fields, make, keep)


def decode(docs: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with decoded, the text of the ids; null ids decode to an empty text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    at = docs.columns.index(ids_col)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = _of(source)
        return [pa.array([bpe.decode(i or []) for i in batch.column(at).to_pylist()], pa.string())]

    return add_columns(docs, [StructField(free_name(docs, "decoded"), StringType())], make)
