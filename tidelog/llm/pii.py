"""Personal data, and the terms that give it away, with DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers. Each value
found (lower-cased address, digits of a number) is a protected entity. The corpus then tells
which terms reveal an entity: of the terms of the documents that hold it, those whose pointwise
mutual information with the entity,

    PMI(e; t) = log2(N * n_et / (n_e * n_t)),

is at least ``alpha`` times the entity's own information IC(e) = log2(N / n_e). N is the number
of documents, n_e, n_t and n_et those that hold e, t and both anywhere; t counts only if n_et is
``support`` or more. Every occurrence of such a term in any document becomes a span of kind
``term``; in the cleaned text it is generalised to [NAME] or [NUMBER] by its form, or removed.

Base spans are found once, and only documents that hold any, or terms found, are shuffled with
their texts. Counts are combined before each shuffle, and mentions of an entity are never brought
into one group, so an address that a third of all documents carry is one row for each task.
Entities in fewer than ``support`` documents, which no term can reveal, are left out before terms
are paired with them; of terms, only those of documents that hold an entity left are counted; and
a term with n_t above n_e ** alpha * N ** (1 - alpha) is left out: as n_et is n_e at most, its
information is below the threshold whatever n_et is. None of this changes a result.

Defined results: null text counts as empty; a document without spans keeps its text; rows with
equal id and text share one result; overlapping spans are all reported and cut out as one
region, labelled by the first. Extra columns stay, whatever their names. An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.kit import cut, discard, free_name, named, small

# The kinds of personal data in their order, and the form of each. Possessive
# quantifiers and the look-behinds change no match; they keep long runs of one class linear.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
IP_OK = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
TERM = r"[\p{L}\p{N}]+"
TERM_KIND = len(FORMS)
KINDS = [*FORMS, "term"]

ALPHA, SUPPORT = 0.85, 3


def prefix_sums(values: Column) -> Column:
    """array<long>: sums of the first 1, 2, ... values, in log2(n) passes over the array."""
    return _scan(values, lambda a, b: a + b)


def prefix_max(values: Column) -> Column:
    return _scan(values, lambda a, b: F.greatest(a, b))


def _scan(values: Column, join) -> Column:
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    shift = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= F.pow(F.lit(2), k).cast("int"), join(x, F.get(acc, i - F.pow(F.lit(2), k).cast("int")))).otherwise(x))
    return F.aggregate(steps, F.transform(values, lambda x: x.cast("long")), shift)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _validator(kind: str):
    return lambda span: _valid(kind, span["value"])


def _valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(IP_OK)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _placed(text: Column, found: Column, form: str, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of the matches ``found`` of ``form`` in ``text``."""
    between = F.split(text, form, -1)
    step = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, m: F.struct(F.length(a).alias("gap"), F.length(m).alias("len")))
    ends = prefix_sums(F.transform(step, lambda s: s["gap"] + s["len"]))
    return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value")))


SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def base_spans(rows: DataFrame, text: str, into: str) -> DataFrame:
    """``rows`` with ``into``: the valid base matches of the string column ``text``, by start and kind."""
    found = {k: free_name(rows, f"{into}_{k}") for k in FORMS}
    could = {"email": F.contains(F.col(text), F.lit("@")), "phone": F.contains(F.col(text), F.lit("+"))}
    none = F.array().cast("array<string>")
    extract = {found[k]: F.when(could.get(k, F.lit(True)), F.regexp_extract_all(F.col(text), F.lit(form), F.lit(0))).otherwise(none) for k, form in FORMS.items()}
    rows = rows.withColumns(extract)
    empty = F.array().cast(SPAN)
    placed = [
        F.when(F.size(found[k]) > 0, F.filter(_placed(F.col(text), F.col(found[k]), form, i), _validator(k))).otherwise(empty).cast(SPAN)
        for i, (k, form) in enumerate(FORMS.items())
    ]
    return rows.withColumn(into, F.array_sort(F.concat(*placed))).drop(*found.values())


def span_text(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    kind = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def terms_of(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)), "")


def disclosing_terms(held: DataFrame, holding: DataFrame, docs: DataFrame, alpha: float, support: int) -> DataFrame:
    """(kind, entity, term) whose mutual information passes the threshold.

    held: one row for each entity of each document, with ``own``, the terms of its values; holding: the documents with a base span.
    """
    total = docs.count()
    n = F.lit(float(max(total, 1)))
    n_e = held.groupBy("kind", "entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < total))
    # A little above the bound, as powers are rounded.
    n_e = cut(n_e.withColumn("most", F.pow("n_e", F.lit(alpha)) * F.pow(n, F.lit(1 - alpha)) * 1.000001), "often")
    top = n_e.agg(F.max("most")).first()[0] or 0.0
    held = cut(held.join(small(n_e), ["kind", "entity"]), "held")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))
    holders = cut(held.select(F.col("id").alias("id2"), F.col("key").alias("key2")).distinct(), "holders")
    texts = holding.join(small(holders), same, "left_semi").select("id", "key", F.explode(terms_of(F.col("text"))).alias("term"))
    texts = cut(texts, "holder_terms")
    wanted = cut(texts.select("term").distinct(), "wanted_terms")
    n_t = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).join(small(wanted), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    n_t = cut(n_t.where((F.col("n_t") >= support) & (F.col("n_t") <= top)), "term_counts")
    pairs = texts.join(small(n_t), "term").join(held.withColumnsRenamed({"id": "id2", "key": "key2"}), same)
    pairs = pairs.where((F.col("n_t") <= F.col("most")) & ~F.array_contains("own", F.col("term")))
    counted = pairs.groupBy("kind", "entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    log = lambda x: F.log2(x.cast("double"))
    pmi = log(n) + log(F.col("n_et")) - log(F.col("n_e")) - log(F.col("n_t"))
    told = cut(counted.where(pmi >= F.lit(alpha) * (log(n) - log(F.col("n_e")))).select("kind", "entity", "term"), "disclosing")
    discard(n_e, held, holders, texts, wanted, n_t)
    return told


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``docs`` with base (spans), spans (base and term spans) and safe_text."""
    own = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    own = own.select("id", F.xxhash64("text", F.lit(0)).alias("key"), "text")
    holding = cut(base_spans(own, "text", "base").where(F.size("base") > 0).dropDuplicates(["id", "key"]), "holding")

    entity = F.when(F.col("s.kind") == 0, F.lower("s.value")).otherwise(F.when(F.col("s.kind") == 1, F.col("s.value")).otherwise(digits(F.col("s.value"))))
    single = holding.select("id", "key", F.explode("base").alias("s"))
    # The terms of the values themselves, as "mail" and "com" of an address, reveal nothing more.
    values = single.select("id", "key", F.col("s.kind").alias("kind"), entity.alias("entity"), terms_of(F.col("s.value")).alias("own"))
    held = cut(values.groupBy("id", "key", "kind", "entity").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own")), "mentions")
    told = disclosing_terms(held, holding, own, alpha, support)
    terms = small(cut(told.select(F.col("term").alias("told")).distinct(), "told_terms"))

    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))
    here = own.select("id", "key", F.explode(terms_of(F.col("text"))).alias("term")).join(terms, F.col("term") == F.col("told"))
    carriers = cut(here.select(F.col("id").alias("id2"), F.col("key").alias("key2")).distinct(), "carriers")
    texts = own.join(small(carriers), same, "left_semi")
    words = texts.withColumn("found", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))
    words = words.select("id", "key", F.explode(_placed(F.col("text"), F.col("found"), TERM, TERM_KIND)).alias("s"))
    hits = words.join(terms, F.lower("s.value") == F.col("told"))
    # Rows of one document have the same hits.
    extra = hits.groupBy("id", "key").agg(F.collect_set("s").alias("extra"))
    none = F.array().cast(SPAN)
    kept = holding.select("id", "key", "base", none.alias("extra")).unionByName(extra.select("id", "key", none.alias("base"), "extra"))
    found = kept.groupBy("id", "key").agg(F.flatten(F.collect_list("base")).alias("base"), F.flatten(F.collect_list("extra")).alias("extra"))
    found = cut(found, "spans")

    text, key, id2, key2, extras = (free_name(docs, x) for x in ("pii_text", "pii_key", "pii_id2", "pii_key2", "pii_extra"))
    base, spans = free_name(docs, "base"), free_name(docs, "spans")
    rows = docs.withColumn(text, F.coalesce(named(text_col), F.lit("")))
    rows = rows.withColumn(key, F.xxhash64(F.col(text), F.lit(0)))
    found = small(found).select(F.col("id").alias(id2), F.col("key").alias(key2), F.col("base").alias(base), F.col("extra").alias(extras))
    full = rows.join(found, named(id_col).eqNullSafe(F.col(id2)) & (F.col(key) == F.col(key2)), "left")
    full = full.withColumn(base, F.coalesce(base, none))
    full = full.withColumn(spans, F.array_sort(F.concat(F.col(base), F.coalesce(extras, none))))
    return redact(full, text, spans, free_name(docs, "safe_text")).drop(text, key, id2, key2, extras)


def redact(rows: DataFrame, text: str, spans: str, into: str) -> DataFrame:
    """``rows`` with ``into``: the text with each region of touching spans replaced by the label of its first."""
    reach, opens, regions = (free_name(rows, f"{into}_{x}") for x in ("reach", "opens", "regions"))
    rows = rows.withColumn(reach, prefix_max(F.transform(spans, lambda s: s["end"])))
    starts_one = lambda s, i: (i == 0) | (s["start"] >= F.get(F.col(reach), i - 1))
    rows = rows.withColumn(opens, F.filter(F.transform(spans, lambda s, i: F.when(starts_one(s, i), i)), lambda i: i.isNotNull()))
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in FORMS))
    general = lambda v: F.when(v.rlike("[0-9]"), "[NUMBER]").when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("")
    label = lambda s: F.when(s["kind"] == TERM_KIND, general(s["value"])).otherwise(F.get(labels, s["kind"]))
    # A region ends where the furthest span before the next region ends.
    end = lambda k: F.get(F.col(reach), F.coalesce(F.get(F.col(opens), k + 1), F.size(spans)) - 1)
    region = lambda o, k: F.struct(F.get(F.col(spans), o)["start"].alias("start"), end(k).alias("end"), label(F.get(F.col(spans), o)).alias("label"))
    rows = rows.withColumn(regions, F.transform(opens, region))
    past = lambda k: F.coalesce(F.get(F.col(regions), k - 1)["end"], F.lit(0))
    part = lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int"))
    pieces = F.transform(regions, lambda g, k: F.concat(part(past(k), g["start"]), g["label"]))
    whole = F.concat(F.array_join(pieces, ""), part(past(F.size(regions)), F.length(text).cast("long")))
    return rows.withColumn(into, F.when(F.size(spans) == 0, F.col(text)).otherwise(whole)).drop(reach, opens, regions)
