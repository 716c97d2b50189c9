"""Language identification in two steps: the family first, then the language within it.

Both steps vote with linear support vector machines, one for each pair of families and one for
each pair of languages of a family (one-versus-one). A text is described by the shares of its
hashed byte bigrams and trigrams around letters, in lower case; a machine's margin is then the
mean weight of the text's grams, so texts are scored whole, by table lookups.

The machines are trained by dual coordinate descent on a bounded sample: of each of the
``languages`` most frequent languages about ``per_language`` labelled documents, those of the
smallest hash of id and text. Rarer languages aren't learnt. Held-out documents (the CRC-32
of the id's text leaves ``held_out`` when divided by ``folds``) and null ids are never learnt from.

Defined results: ``und`` and score 0 for null texts and texts without a letter, and where nothing
could be learnt; ties go to the larger margin, then to the first name. A language that was learnt
alone in its family needs no machine there. Null ids, texts and languages are not learnt from.
Extra columns stay, whatever their names. An empty table gives an empty table. Only counts are
shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from tidelog.llm.arrays import Texts, slices
from tidelog.llm.kit import add_columns, free_name, map_parts, named
from tidelog.plans.shipping import map_batches

# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz tt".split(),
    "indo-aryan": "hi bn mr gu pa ur ne".split(),
    "semitic": "ar he mt".split(),
    "celtic": "ga gd cy br".split(),
    "baltic": "lt lv".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

BITS = 14
SIZE = 1 << BITS
SCALE = 20.0
PER_LANGUAGE, LANGUAGES = 500, 64
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams and trigrams of lower-cased bytes, and their text numbers; only those that start with a letter."""
    data, offsets = texts.data, texts.offsets
    letter = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    clean = np.where(letter, data, 0x20).astype(np.uint32)
    at = np.flatnonzero(letter)
    owner = np.searchsorted(offsets, at, side="right") - 1
    end = offsets[owner + 1]
    after = lambda k: np.where(at + k < end, clean[np.minimum(at + k, len(clean) - 1)], 0x20)
    before = np.where(at > offsets[owner], clean[np.maximum(at - 1, 0)], 0x20)
    pair = clean[at] << 8 | after(1)
    slot = lambda x: ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    return np.stack((slot(pair | np.uint32(1 << 24)), slot(before << 16 | pair))), owner


@dataclass
class Machine:
    """A linear machine between two names: positive margins speak for the first."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]


def train_machine(first: str, second: str, rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 10.0, epochs: int = 12) -> Machine:
    """L2-regularised hinge loss by dual coordinate descent; each class has the same total cost."""
    w, b = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    limit = np.where(signs > 0, len(rows) / max((signs > 0).sum(), 1), len(rows) / max((signs < 0).sum(), 1)) * cost / 2
    norms = np.array([x @ x + 1.0 for _, x in rows])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slot, x = rows[i]
            grad = signs[i] * (w[slot] @ x + b) - 1
            new = min(max(alpha[i] - grad / norms[i], 0.0), limit[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * signs[i]
                w[slot] += change * x
                b += change
                alpha[i] = new
    return Machine(first, second, w.astype(np.float32), b)


def _pairwise(names: list[str], label: list[str], rows: list) -> list[Machine]:
    out = []
    for a, b in combinations(names, 2):
        own = [i for i, x in enumerate(label) if x in (a, b)]
        out.append(train_machine(a, b, [rows[i] for i in own], np.array([1.0 if label[i] == a else -1.0 for i in own])))
    return out


def family(code: str) -> str:
    return FAMILY_OF.get(code.lower()[:2] if len(code) > 2 and code[2] in "-_" else code.lower(), "other")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """A model learnt from a bounded sample of the documents that aren't held out."""
    usable = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang"))
    usable = usable.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return Model([], {}, [], {})
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * per_language / n))))
    place = F.pmod(F.xxhash64(F.lit("langid"), "id", "text"), F.lit(1 << 40))
    chosen = usable.where(place / float(1 << 40) < share[F.col("lang")]).select(place.alias("place"), "lang", "text")
    # Repeated rows have one place, and are combined before they are shuffled.
    chosen = chosen.dropDuplicates(["place", "lang"])
    schema = StructType([StructField("place", LongType()), StructField("lang", StringType()), StructField("slots", ArrayType(IntegerType())), StructField("x", ArrayType(FloatType()))])

    def run(batches):
        for batch in map_parts(batches):
            places, langs, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for texts in slices(pc.utf8_lower(batch.column(2))):
                slots, owner = grams(texts)
                at = np.searchsorted(owner, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    own = slots[:, at[i] : at[i + 1]].ravel()
                    if len(own):
                        slot, n = np.unique(own, return_counts=True)
                        rows.append({"place": places[texts.first + i], "lang": langs[texts.first + i], "slots": slot.tolist(), "x": (n * (2 * SCALE / len(own))).tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("place", pa.int64()), ("lang", pa.string()), ("slots", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))]))

    found = map_batches(chosen, run, schema).toArrow()
    order = sorted(zip(found["place"].to_pylist(), found["lang"].to_pylist(), range(found.num_rows), strict=True))
    label, rows, taken = [], [], dict.fromkeys(counts, 0)
    for _, lang, i in order:
        if taken[lang] < per_language:
            taken[lang] += 1
            label.append(lang)
            rows.append((found["slots"][i].values.to_numpy(), found["x"][i].values.to_numpy().astype(np.float64)))
    families = sorted({family(x) for x in label})
    languages = {f: sorted({x for x in label if family(x) == f}) for f in families}
    between = _pairwise(families, [family(x) for x in label], rows)
    return Model(families, languages, between, {f: _pairwise(names, label, rows) for f, names in languages.items()})


def _vote(names: list[str], machines: list[Machine], margin) -> tuple[np.ndarray, np.ndarray]:
    """For each text the name with most votes, then the largest sum of margins, and its confidence."""
    n = margin(None)
    if len(names) == 1:
        return np.zeros(n, np.int64), np.ones(n)
    votes, sums, weakest = np.zeros((len(names), n)), np.zeros((len(names), n)), np.full((len(names), n), np.inf)
    for m in machines:
        x, a, b = margin(m), names.index(m.first), names.index(m.second)
        votes[a] += x >= 0
        votes[b] += x < 0
        for k, y in ((a, x), (b, -x)):
            sums[k] += y
            weakest[k] = np.minimum(weakest[k], y)
    best = np.argmax(votes + np.tanh(sums / 1e3) / 4, axis=0)
    return best, 1 / (1 + np.exp(-2 * np.clip(weakest[best, np.arange(n)], -20, 20)))


def _predict(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    slots, owner = grams(texts)
    size = np.maximum(np.bincount(owner, minlength=n), 1)

    def margin(m: Machine | None):
        if m is None:
            return n
        return np.bincount(owner, m.weights[slots[0]] + m.weights[slots[1]], n) * SCALE / size + m.bias

    of, sure = _vote(model.families, model.between, margin)
    out, score = np.empty(n, object), np.zeros(n)
    for k, f in enumerate(model.families):
        own = of == k
        if own.any():
            lang, certain = _vote(model.languages[f], model.within[f], margin)
            out[own] = np.array(model.languages[f], object)[lang[own]]
            score[own] = (sure * certain)[own]
    return out, score


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred and score."""
    has_letter, lang, score = (free_name(docs, x) for x in ("has_letter", "lang_pred", "score"))
    kept = docs.columns if keep is None else keep
    rows = docs.withColumn(has_letter, F.coalesce(named(text_col).rlike(r"\p{L}"), F.lit(False)))
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if not shared.value.families:
            return [pa.array([UNKNOWN] * batch.num_rows), pa.array(np.zeros(batch.num_rows))]
        parts = [_predict(shared.value, t) for t in slices(pc.utf8_lower(batch.column(at)))]
        langs, scores = ([x for p in parts for x in p[k]] for k in (0, 1))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    out = add_columns(rows, [StructField(lang, StringType()), StructField(score, DoubleType())], make, [*kept, has_letter])
    found = F.col(has_letter)
    return out.withColumns({lang: F.when(found, F.col(lang)).otherwise(UNKNOWN), score: F.when(found, F.col(score)).otherwise(0.0)}).drop(has_letter)
