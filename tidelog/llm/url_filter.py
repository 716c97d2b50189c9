"""URL filters: rules on host and path, and for the rest a ratio of two character models.

A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's; the longest rule wins. Other URLs are judged by how they are spelt:
two variable-order Markov models, one of accepted and one of rejected URLs, give each character
a probability after the longest context they know, smoothed into the shorter ones (Witten-Bell).
The mean difference of the log-likelihoods, length-normalised, is the score. A URL below the
threshold is blocked. The threshold is calibrated on URLs of hosts that the models then don't
know: the counts of one host in four (by the MD5 of the host) are taken out, those hosts' URLs
scored, and the highest threshold chosen that blocks at most ``max_false`` of the accepted ones.
The models that judge count all URLs. Where the hosts taken out lack accepted or rejected URLs,
all URLs calibrate.

URLs to learn from are labelled by a column of the table, or else by ``reject``, a regular
expression of words; all others are accepted. Counts are gathered from every URL and keyed by the exact context, so they grow with the
URLs: characters fall into 64 symbols, a gram is a symbol after four others, and the table of gram
counts stays in Spark. Contexts of up to two characters have 64 ** 3 cells at most, which are also
kept as arrays; those of three and four are counted by windows over the grams that share their
last three characters (64 ** 2 at most). The gain of each distinct gram is joined to the grams of
the distinct URLs; gains are summed in units of 2 ** -36, so their order changes nothing.

Defined results: a null URL, or one without ``://``, has an empty host and path; an empty URL has
score 0 and is allowed, whatever the threshold. A null label counts as accepted. Without rejected
or without accepted URLs nothing is blocked by the models. Equal URLs have equal results. Extra
columns stay, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, LongType, StructField, StructType

from tidelog.llm.arrays import Texts, slices
from tidelog.llm.kit import add_columns, cut, free_name, map_parts, named, row_lists
from tidelog.plans.shipping import map_batches

ORDERS = 5
# The orders kept as arrays, and their cells.
WIDTHS = [1, 64, 1 << 12]
STARTS = np.concatenate(([0], np.cumsum(np.array(WIDTHS) * 64)))
SLOTS = int(STARTS[-1])
UNITS = 2.0**36
BINS, LOW, HIGH = 800, -4.0, 4.0
MAX_FALSE = 0.001

# Words that mark a URL to be rejected.
REJECT_WORDS = "adult porn xxx sex escort casino poker slots bet bets betting gambling lottery jackpot pills viagra payday warez crack torrent".split()
REJECT = rf"(?:^|[^a-z])(?:{'|'.join(REJECT_WORDS)})(?:[^a-z]|$)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as host + path, else null."""
    found = F.lit(None).cast("string")
    for rule_host, rule_path, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_col == rule_host) | host_col.endswith(f".{rule_host}")) & path_col.startswith(rule_path)
        found = F.when(fits, rule_host + rule_path).otherwise(found)
    return found


# The characters that have a symbol of their own, from 1 on.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=% "


def symbol_table() -> np.ndarray:
    """A symbol for each byte: letters, digits and the marks of URLs; 63 for all else."""
    out = np.full(256, 63, np.int64)
    for i, c in enumerate(SYMBOLS.encode()):
        out[c] = i + 1
    out[0x41:0x5B] = out[0x61:0x7B]
    return out


def contexts(texts: Texts) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order and character its context, the last character first; the symbols; the characters' text numbers."""
    symbols = symbol_table()[texts.data]
    owner = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    since = np.arange(len(symbols)) - texts.offsets[owner]
    out = [np.zeros(len(symbols), np.int64)]
    for k in range(1, ORDERS):
        earlier = np.where(since >= k, np.concatenate((np.zeros(k, np.int64), symbols[:-k])) if len(symbols) >= k else 0, 0)
        out.append(out[-1] * 64 + earlier)
    return out, symbols, owner


def places(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For each order kept as an array and each character its slot, context first; and the characters' text numbers."""
    found, symbols, owner = contexts(texts)
    return np.stack([STARTS[k] + found[k] * 64 + symbols for k in range(len(WIDTHS))]), owner


def grams(texts: Texts) -> np.ndarray:
    """Each character after its four, as 30 bits."""
    found, symbols, _ = contexts(texts)
    return found[-1] * 64 + symbols


@dataclass
class Markov:
    """Counts of characters after contexts of up to two, by slot."""

    counts: np.ndarray

    def __post_init__(self) -> None:
        by_context = self.counts.reshape(-1, 64)
        self.total, self.kinds = by_context.sum(axis=1), (by_context > 0).sum(axis=1)

    def probability(self, slots: np.ndarray) -> np.ndarray:
        p = np.full(slots.shape[1], 1 / 64)
        for k in range(len(WIDTHS)):
            context = slots[k] >> 6
            p = smoothed(self.counts[slots[k]], self.total[context], self.kinds[context], p)
        return p

    def log_probability(self, slots: np.ndarray) -> np.ndarray:
        return np.log(self.probability(slots))


def smoothed(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Witten-Bell: the counts after a context mixed with ``p``, that after the shorter one."""
    return np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)


def short_probabilities(by_two: np.ndarray) -> np.ndarray:
    """The probability of each symbol after each two characters, from its counts."""
    cube = by_two.reshape(64, 64, 64)
    model = Markov(np.concatenate((cube.sum(axis=(0, 1)), cube.sum(axis=1).ravel(), by_two)))
    cell = np.arange(64**3)
    symbol = cell & 63
    return model.probability(np.stack((symbol, STARTS[1] + (cell >> 12) * 64 + symbol, STARTS[2] + cell)))


@dataclass
class UrlModel:
    """Counts of grams (g, n0 of accepted and n1 of rejected URLs), probabilities after two characters, threshold."""

    counts: DataFrame
    short: list[np.ndarray]
    threshold: float


def spelling(url: Column) -> Column:
    """What the models read: the URL without its scheme."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")


def gains(model: UrlModel, wanted: DataFrame) -> DataFrame:
    """(g, gain): log-ratio of the two models for each gram counted or ``wanted``, in units."""
    zero = F.lit(0).cast("long")
    rows = model.counts.unionByName(wanted.select("g", zero.alias("n0"), zero.alias("n1"))).groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = rows.select("g", F.shiftright("g", 12).alias("c3"), F.shiftright("g", 6).alias("c4"), F.col("g").bitwiseAND(63).alias("sym"), "n0", "n1")
    by_3, by_gram, by_4 = Window.partitionBy("c3"), Window.partitionBy("c3", "sym"), Window.partitionBy("c3", "c4")
    numbers = []
    for n in ("n0", "n1"):
        some = F.when(F.col(n) > 0, F.col("sym"))
        numbers += [F.sum(n).over(by_gram), F.sum(n).over(by_3), F.size(F.collect_set(some).over(by_3)).cast("long"), F.col(n), F.sum(n).over(by_4), F.count(some).over(by_4)]
    rows = rows.select("g", *(x.alias(f"x{i}") for i, x in enumerate(numbers)))
    shared = wanted.sparkSession.sparkContext.broadcast(model.short)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        g, *x = (batch.column(i).to_numpy() for i in range(13))
        cell, logs = (g >> 18) * 64 + (g & 63), []
        for k in (0, 1):
            p = smoothed(*x[6 * k : 6 * k + 3], shared.value[k][cell])
            logs.append(np.log(smoothed(*x[6 * k + 3 : 6 * k + 6], p)))
        return [pa.array(np.rint((logs[0] - logs[1]) * UNITS).astype(np.int64))]

    return cut(add_columns(rows, [StructField("gain", LongType())], make, ["g"]), "url_gains")


def scores(texts: DataFrame, model: UrlModel) -> DataFrame:
    """(spelt, score) of the distinct, not empty strings ``spelt``."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [(np.diff(t.offsets), grams(t)) for t in slices(batch.column(0))]
        counts, values = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        return [row_lists(counts, pa.array(values))]

    each = add_columns(texts, [StructField("g", ArrayType(LongType()))], make).select("spelt", F.explode("g").alias("g"))
    table = gains(model, each.select("g").distinct())
    return each.join(table, "g").groupBy("spelt").agg((F.sum("gain") / F.count("*") / UNITS).alias("score"))


def held_back(host_col: Column) -> Column:
    """Whether a host's URLs calibrate the threshold: one host in four."""
    return F.substring(F.md5(host_col.cast("binary")), 1, 1) < "4"


def labelled(urls: DataFrame, url_col: str, bad_col: str | None, reject: str) -> DataFrame:
    """(spelt, bad, held) of the URLs that aren't empty."""
    url = F.coalesce(named(url_col), F.lit(""))
    bad = F.coalesce(named(bad_col).cast("boolean"), F.lit(False)) if bad_col else F.lower(url).rlike(reject)
    return urls.select(spelling(url).alias("spelt"), bad.alias("bad"), held_back(host(url)).alias("held")).where(F.length("spelt") > 0)


def count_grams(rows: DataFrame) -> DataFrame:
    """(g, n0, n1, h0, h1): how often each gram stands in accepted and rejected URLs, and in those held back."""
    schema = StructType([StructField("kind", ByteType()), StructField("g", LongType()), StructField("n", LongType())])

    def count(batches):
        for batch in map_parts(batches):
            bad, held = (np.array(batch.column(i).to_numpy(zero_copy_only=False), np.int8) for i in (1, 2))
            for kind in range(4):
                own = batch.column(0).filter(pa.array(bad + 2 * held == kind))
                found = [grams(t) for t in slices(own)]
                if found:
                    g, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), kind, np.int8)), pa.array(g), pa.array(n.astype(np.int64))], names=schema.names)

    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))
    counts = map_batches(rows, count, schema).groupBy("g").agg(of(0, 2).alias("n0"), of(1, 3).alias("n1"), of(2).alias("h0"), of(3).alias("h1"))
    return cut(counts, "url_counts")


def model_of(counts: DataFrame) -> tuple[UrlModel, bool]:
    """The model of counts (g, n0, n1), which blocks nothing yet, and whether it knows URLs of both kinds."""
    cell = (F.shiftright("g", 18) * 64 + F.col("g").bitwiseAND(63)).alias("cell")
    gathered = counts.groupBy(cell).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    by_two = np.zeros((2, 64**3))
    for kind in (0, 1):
        by_two[kind, gathered["cell"].to_numpy()] = gathered[f"n{kind}"].to_numpy()
    return UrlModel(counts, [short_probabilities(x) for x in by_two], -np.inf), bool(by_two[0].any() and by_two[1].any())


def calibrate(rows: DataFrame, model: UrlModel, max_false: float) -> float:
    """The highest threshold that blocks at most ``max_false`` of the accepted URLs, or the lowest that catches as many."""
    known = rows.groupBy("spelt", "bad").agg(F.count("*").alias("n"))
    scored = known.join(scores(rows.select("spelt").distinct(), model), "spelt")
    place = F.greatest(F.least(F.floor((F.col("score") - LOW) / (HIGH - LOW) * BINS), F.lit(BINS - 1)), F.lit(0))
    spread = np.zeros((2, BINS), np.int64)
    for bad, k, n in scored.groupBy("bad", place.alias("k")).agg(F.sum("n").alias("n")).collect():
        spread[int(bad), k] = n
    blocked = np.concatenate(([0], np.cumsum(spread[0])))
    caught = np.concatenate(([0], np.cumsum(spread[1])))
    allowed = blocked <= max_false * max(blocked[-1], 1)
    return LOW + int(np.argmax(np.where(allowed, caught, -1))) * (HIGH - LOW) / BINS


def fit(urls: DataFrame, url_col: str = "url", bad_col: str | None = None, reject: str = REJECT, max_false: float = MAX_FALSE) -> UrlModel:
    """Models of all URLs, and a threshold from hosts that were held back."""
    rows = labelled(urls, url_col, bad_col, reject)
    counts = count_grams(rows)
    model, both = model_of(counts.select("g", "n0", "n1"))
    if not both:
        return model
    without, usable = model_of(counts.select("g", (F.col("n0") - F.col("h0")).alias("n0"), (F.col("n1") - F.col("h1")).alias("n1")).where("n0 + n1 > 0"))
    apart = rows.where("held")
    usable = usable and apart.select("bad").distinct().count() == 2
    model.threshold = calibrate(apart, without, max_false) if usable else calibrate(rows, model, max_false)
    return model


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score and verdict."""
    h, p, r, s, v, text = (free_name(pages, x) for x in ("host", "path", "rule", "score", "verdict", "spelling"))
    rows = pages.withColumn(text, spelling(named(url_col)))
    spelt, found = free_name(rows, "spelt"), free_name(rows, "found")
    own = scores(rows.select(F.col(text).alias("spelt")).where(F.length("spelt") > 0).distinct(), model).select(F.col("spelt").alias(spelt), F.col("score").alias(found))
    scored = rows.join(own, F.col(text) == F.col(spelt), "left").withColumn(s, F.coalesce(found, F.lit(0.0)))
    out = scored.withColumns({h: host(named(url_col)), p: path(named(url_col))})
    out = out.withColumn(r, rule_of(F.col(h), F.col(p), rules))
    by_rule = F.create_map(*(F.lit(x) for a, b, verdict in rules for x in (a + b, verdict))) if rules else F.lit(None)
    own = F.when((F.length(text) > 0) & (F.col(s) < model.threshold), "block").otherwise("allow")
    ruled = F.when(F.col(r).isNotNull(), by_rule[F.col(r)]).otherwise(own) if rules else own
    return out.select(*map(named, pages.columns), h, p, r, s, ruled.alias(v))
