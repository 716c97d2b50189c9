"""Operators that SQL can't express, against plain computations over the small tables."""

import collections
import hashlib
import json
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import chat, components, decontam, langid, near_dedup, pii, quality, template, url_filter, warc
from tidelog.llm.arrays import slices
from tidelog.llm.bpe import Bpe
from tidelog.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    with open(PATH, encoding="utf-8") as f:
        return library, Bpe(f.read())


def test_bpe_query_agrees_with_the_library(spark, small, texts, both):
    library, _ = both
    got = {r["doc_id"]: r for r in QUERIES["op6_bpe"](spark, small).collect()}
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("text", ["".join(chr(0x4E00 + i * 7919 % 20000) for i in range(200_000)), "漢字、" * 60_000, "x" * 200_000, "é" * 100_000, "ab1" * 60_000])
def test_bpe_agrees_on_long_texts_without_white_space(both, text):
    library, own = both
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert sum(map(len, (own.chunk, own.word, own.fragment))) < 400_000 and all(len(k) <= 64 for k in own.chunk)


def test_tokenizer_files_that_ask_for_other_steps_are_refused(both):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="end-of-word"):
        Bpe(f.read())
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for place, value in (("normalizer", None), ("decoder", {"type": "BPEDecoder", "suffix": "</w>"}), ("pre_tokenizer", {"type": "Whitespace"})):
        with pytest.raises(ValueError, match=place):
            Bpe(json.dumps(spec | {place: value}))
    with pytest.raises(ValueError, match="dropout"):
        Bpe(json.dumps(spec | {"model": spec["model"] | {"dropout": 0.1}}))


PIECES = ["a", "the", "'s", " ", "\n", "Σ", "ς", "İ", "e\u0301", "中", "😀", "5", "½", "<|endoftext|>", "<|end", "!!", "\x1c", "\x85", "\xa0", "ß", "\x00", "ab" * 60]


@given(st.lists(st.sampled_from(PIECES), max_size=12))
@settings(max_examples=300, deadline=None)
def test_bpe_agrees_on_odd_texts(both, pieces):
    text = "".join(pieces)
    library, own = both
    encoded = library.encode(text, add_special_tokens=False)
    assert own.encode(text) == encoded.ids
    assert own.decode(encoded.ids) == library.decode(encoded.ids, skip_special_tokens=False)


def test_long_fragments_merge_alike(both):
    _, own = both
    rng = random.Random(3)
    for _ in range(50):
        symbols = [own.symbols[rng.choice(b"abehint")] for _ in range(rng.randint(2, 90))]
        assert own._merge(list(symbols)) == own._merge_long(list(symbols))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    return {g: 1 + np.log(n) for g, n in grams.items()}


def probability_jaccard(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return total


def test_near_duplicate_classes(spark, small, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    by_shingle = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by_shingle[g].append(i)
    common = collections.Counter((a, b) for ids in by_shingle.values() for k, b in enumerate(ids) for a in ids[:k])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for (a, b), n in common.items():
        if n >= 0.5 * min(len(sets[a]), len(sets[b])) and probability_jaccard(sets[a], sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y], links = x, links + 1
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op2_near_dedup"](spark, small).collect()}
    assert links and got == {i: find(i) for i in sets}


def test_a_group_with_few_strangers_is_dealt_out_once(spark):
    comps = {i: 1 if i < 3000 else i for i in range(3003)}
    rows = [(key, i, 0, 100, c, b"\0" * 64) for key in (7, 9) for i, c in comps.items() if key == 7 or i < 4]
    rows += [(11, 3000, 0, 100, 3000, b""), (11, 3001, 0, 100, 3001, b"")]
    dealt, _ = near_dedup.deal(spark.createDataFrame(rows, "key bigint, id bigint, tid bigint, size bigint, comp bigint, sketch binary"))
    got = dealt.drop("sketch").collect()
    # The group once, and each stranger for each of the group's blocks and its own.
    assert sum(r["key"] == 7 for r in got) == 3000 + 3 * (-(-3000 // near_dedup.BLOCK) + 1)
    assert {r["key"] for r in got} == {7, 11} and all(r["keys"] == sorted(k for k, i, *_ in rows if i == r["id"] and k != 9) for r in got if r["id"] >= 2990)
    groups = collections.defaultdict(list)
    for r in got:
        groups[r["key"], r["low"], r["high"]].append((r["id"], r["block"]))
    met = {(k, *sorted((i, j))) for (k, low, high), own in groups.items() for i, a in own if a == low for j, b in own if b == high and i != j}
    assert met >= {(7, i, j) for j in (3000, 3001, 3002) for i in range(j) if comps[i] != comps[j]} | {(11, 3000, 3001)}
    assert not any(k == 7 and j < 3000 for k, _, j in met)
    # Of long texts fewer fit in a block.
    long = [(7, i, 0, near_dedup.BLOCK_BYTES, 0 if i < 6 else i, b"") for i in range(8)]
    dealt, _ = near_dedup.deal(spark.createDataFrame(long, "key bigint, id bigint, tid bigint, size bigint, comp bigint, sketch binary"))
    assert dealt.select("block").distinct().count() > 2


def test_a_large_bucket_is_dealt_out_with_its_heads(spark):
    n = 5 * near_dedup.SPLIT
    met = spark.createDataFrame([(1, n, i, 0, 1, b"") for i in range(n)] + [(2, 3, i, 0, 1, b"") for i in range(3)], "key bigint, n bigint, id bigint, tid bigint, size bigint, sketch binary")
    groups = collections.defaultdict(lambda: ([], []))
    for r in near_dedup.split(met).collect():
        groups[r["key"], r["salt"]][r["head"]].append(r["id"])
    assert len(groups) == 6 and sorted(groups[2, 0][0]) == [0, 1, 2] and groups[2, 0][1] == []
    parts = [groups[1, k] for k in range(5)]
    assert sorted(i for rows, _ in parts for i in rows) == list(range(n)) and all(sorted(heads) == list(range(near_dedup.FIRST)) for _, heads in parts)


def test_each_text_of_an_id_meets_its_own_partners(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(200))
    edited = lambda k: words(k).replace(f"w{k}x7 ", "changed ")
    rows = [(1, words(1)), (1, words(2)), (1, words(2)), (2, edited(1)), (3, edited(2)), (4, words(4)), (5, words(4)), (6, words(6))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted(tuple(r)[::2] for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_components_of_long_chains_take_few_rounds(spark, monkeypatch, seed):
    ids = [0, *range(999, 0, -1)]
    if seed:
        random.Random(seed).shuffle(ids)
    rounds, to_roots = [], components._to_roots
    monkeypatch.setattr(components, "_to_roots", lambda hooks: rounds.append(1) or to_roots(hooks))
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a bigint, b bigint")
    got = {r["id"]: r["comp"] for r in components.components(links).collect()}
    assert got == dict.fromkeys(range(1000), 0) and len(rounds) < 12


def test_components_of_odd_links(spark):
    links = spark.createDataFrame([(5, 5), (3, 4), (4, 3), (None, 3), (9, 8), (7, None)], "a bigint, b bigint")
    assert sorted(map(tuple, components.components(links).collect())) == [(3, 3), (4, 3), (8, 8), (9, 8)]
    assert components.components(links.limit(0)).count() == 0


def test_a_large_group_of_edited_copies_holds_together(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(1500):
        own = list(words)
        for _ in range(rng.randrange(8)):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(5000 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(60))) for i in range(200)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()}
    # All pairs, by the exact similarity.
    sets = {i: shingles(t) for i, t in rows}
    at = {g: k for k, g in enumerate({g for s in sets.values() for g in s})}
    parent = dict.fromkeys(sets)
    parent = {i: i for i in parent}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    ids = [i for i, _ in rows[:1500]]
    hold = np.zeros((1500, len(at)), np.float32)
    for i in ids:
        hold[i, [at[g] for g in sets[i]]] = 1
    inter = hold @ hold.T
    size = hold.sum(axis=1)
    for a, b in zip(*np.nonzero(np.triu(inter / (size[:, None] + size[None, :] - inter) >= 0.8, 1)), strict=True):
        x, y = sorted((find(int(a)), find(int(b))))
        parent[y] = x
    wrong = [i for i, _ in rows if got[i] != find(i)]
    assert len(wrong) <= 3, wrong  # what banding and sketches may miss


def test_probminhash_estimates_the_probability_jaccard():
    a, b = ({f"{k}": 1.0 + k % 3 for k in range(300)}, {f"{k}": 1.0 + k % 2 for k in range(60, 340)})
    hashed = lambda s: {int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "little"): w for k, w in s.items()}
    rows = [sorted(hashed(s).items()) for s in (a, b)]
    text = np.repeat([0, 1], [len(r) for r in rows])
    value, weight = np.array([k for r in rows for k, _ in r], np.uint64), np.array([w for r in rows for _, w in r])
    m = 20_000
    signature = near_dedup.signatures(text, value, weight, 2, m)
    exact = probability_jaccard(hashed(a), hashed(b))
    assert abs((signature[0] == signature[1]).mean() - exact) < 4 * (exact * (1 - exact) / m) ** 0.5
    sets = [(value[text == k], weight[text == k]) for k in (0, 1)]
    assert near_dedup.similarity(*sets) == pytest.approx(exact)
    assert near_dedup.estimates(near_dedup.sketches(signature[:1, :4096]), near_dedup.sketches(signature[1:, :4096]))[0, 0] == pytest.approx(exact, abs=0.04)


def test_base_counts_of_quality(texts):
    cases = [*texts.values(), None, "", "\n", "a\n\na", "é x y"]
    got = [row for t in slices(pa.array(cases)) for row in zip(*quality.describe(t).base.tolist(), strict=True)]
    assert got == [plain_counts(t) for t in cases]


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(2)
    model = quality.Crf(rng.normal(size=3), rng.normal(size=(2, 2)))
    text = np.repeat([0, 1, 2], [7, 1, 4])
    features = rng.normal(size=(12, 3))
    got = model.decode(features, text)
    score = features @ model.weights
    for t in range(3):
        own = np.flatnonzero(text == t)
        paths = [[(p >> k) & 1 for k in range(len(own))] for p in range(1 << len(own))]
        best = max(paths, key=lambda p: sum(score[i] for i, y in zip(own, p, strict=True) if y) + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert got[own].tolist() == [bool(y) for y in best]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_keeps_held_out_good_documents_and_drops_junk(spark, small):
    at = small.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    model = quality.fit(docs.select("doc_id", "text"), known)
    judged = {r["doc_id"]: r for r in quality.judge(docs.select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi"), model, keep=["doc_id"]).collect()}
    own = [(r["quality"], judged[r["doc_id"]]) for r in labels.collect() if held_out(r["doc_id"]) and not judged[r["doc_id"]]["base_failed"]]
    good, bad = ([r["kept"] for q, r in own if q == k] for k in (1, 0))
    assert len(good) > 500 and len(bad) > 50 and np.mean(good) > 0.99 and np.mean(bad) < 0.1


def plain_counts(t):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def best_content(model, features):
    """Viterbi in plain steps: whether each of a text's lines is content."""
    score, paths = features @ model.weights, [(0.0, []), (0.0, [])]
    for i, x in enumerate(score):
        emit = (0.0, x)
        paths = [
            max(((paths[a][0] + (model.step[a, b] if i else 0) + emit[b], paths[a][1] + [bool(b)]) for a in ((0, 1) if i else (b,))), key=lambda p: p[0])
            for b in (0, 1)
        ]
    return max(paths, key=lambda p: p[0])[1]


def test_quality_query_agrees_with_plain_counts_and_decoding(spark, small, texts):
    got = {r["doc_id"]: r for r in QUERIES["op9_quality"](spark, small).collect()}
    model = quality.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    assert got.keys() == texts.keys() and {r["kept"] for r in got.values()} == {True, False}
    for i, t in texts.items():
        r, (n, chars, symbols, dup, repeats) = got[i], plain_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        (part,) = slices(pa.array([t], pa.string()), 1 << 62)
        lines = quality.describe(part)
        share = lines.words @ np.array(best_content(model, lines.features), float) / max(n, 1) if n else 0.0
        assert r["content_share"] == pytest.approx(share) and r["kept"] == (not r["base_failed"] and share >= quality.SHARE)


def test_long_labelled_documents_teach_too(spark):
    long = "\n".join(f"a line of words number {i}" for i in range(500))
    docs = spark.createDataFrame([(1, long), (2, "short and good"), (2, "short and good")] + [(3, "x y z")] * 40, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (None, 1), (4, None)], "doc_id bigint, quality int")
    sample = quality.training_sample(docs, labels, "doc_id", "text", "quality", 5, 64)
    assert len(sample) == 10 and [len(x) for x, good in sample if not good] in ([64], [])
    lines = sorted(len(x) for x, _ in quality.training_sample(docs.where("doc_id < 3"), labels, "doc_id", "text", "quality", 5, 64))
    assert lines == [1, 1, 64]


def test_held_out_languages(spark, duck, small):
    at = small.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in QUERIES["op7_langid"](spark, at).collect()}
    truth = dict(duck.execute(f"SELECT doc_id, lang FROM '{at}/documents.parquet'").fetchall())
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and truth[i] is not None]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.98
    assert langid.family("en") == "germanic" and langid.family("pt-BR") == "romance" and langid.family("zz") == "other"


def test_language_is_learnt_from_no_held_out_document(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(other)
    assert a.languages == b.languages and all((x.weights == y.weights).all() for x, y in zip(a.between, b.between, strict=True))


def plain_language(model, text):
    """The language and score of a text, gram by gram."""
    raw = pc.utf8_lower(pa.array([text]))[0].as_py().encode()
    letter = lambda k: 0 <= k < len(raw) and (0x61 <= raw[k] <= 0x7A or raw[k] >= 0x80)
    clean = lambda k: raw[k] if letter(k) else 0x20
    slots = []
    for k in filter(letter, range(len(raw))):
        pair = clean(k) << 8 | clean(k + 1)
        slots += [(x * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.BITS) for x in (pair | 1 << 24, clean(k - 1) << 16 | pair)]

    def winner(names, machines):
        if len(names) == 1:
            return names[0], 1.0
        margins = {(m.first, m.second): sum(float(m.weights[s]) for s in slots) * langid.SCALE / (len(slots) / 2) + m.bias for m in machines}
        votes = lambda n: sum((x >= 0) == (n == a) for (a, b), x in margins.items() if n in (a, b))
        sums = lambda n: sum(x if n == a else -x for (a, b), x in margins.items() if n in (a, b))
        best = max(names, key=lambda n: (votes(n), sums(n)))
        weakest = min(x if best == a else -x for (a, b), x in margins.items() if best in (a, b))
        return best, 1 / (1 + np.exp(-2 * np.clip(weakest, -20, 20)))

    family, sure = winner(model.families, model.between)
    lang, certain = winner(model.languages[family], model.within[family])
    return lang, sure * certain


def test_language_query_agrees_with_plain_votes(spark, small, texts):
    got = {r["doc_id"]: r for r in QUERIES["op7_langid"](spark, small).collect()}
    model = langid.fit(spark.read.parquet(f"{small}/documents.parquet"))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        lang, score = plain_language(model, t) if regex.search(r"\p{L}", t or "") else ("und", 0.0)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-5) and got[i]["held_out"] == held_out(i)


def test_rare_languages_and_repeated_rows_leave_the_sample_bounded(spark):
    rows = [(i, f"text number {i} in a language", f"x{i % 7}") for i in range(70)] + [(7, "text number 7 in a language", "x0")] * 500
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_language=5, languages=3)
    assert sum(map(len, model.languages.values())) <= 3 and "x0" in model.languages["other"]


def plain_rule(url):
    """host, path and rule of a URL, by the contract."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules = {"net/": ("net", "/"), "example.net/en/": ("example.net", "/en/"), "example.com/de/": ("example.com", "/de/"), "org/fr/": ("org", "/fr/")}
    fits = [r for r, (h, p) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_query_agrees_with_plain_rules(spark, small):
    at = small.replace("sf0.001", "sf0.01")
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    verdicts = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for r in QUERIES["op8_url_filter"](spark, at).collect():
        assert (r["host"], r["path"], r["rule"]) == plain_rule(urls[r["page_id"]]) and r["verdict"] in ({verdicts[r["rule"]]} if r["rule"] else {"allow", "block"})


def test_url_models_judge_hosts_they_have_not_seen(spark, small):
    pages = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.1')}/pages.parquet").select("page_id", "url")
    hosts = url_filter.host(F.col("url"))
    known = F.crc32(hosts.cast("binary")) % 3 != 0
    own = [r for r in url_filter.judge(pages.where(~known), url_filter.fit(pages.where(known)), []).collect()]
    bad = [bool(re.search(url_filter.REJECT, r["url"].lower())) for r in own]
    blocked = [r["verdict"] == "block" for r in own]
    # Some of the words that label hosts stand in none that was learnt, so much can't be known.
    assert sum(bad) > 20 and np.mean([b for b, x in zip(blocked, bad, strict=True) if x]) > 0.5
    assert np.mean([b for b, x in zip(blocked, bad, strict=True) if not x]) < 0.05


def test_urls_are_learnt_from_a_column_of_labels(spark):
    rng = random.Random(4)
    some = lambda letters: "".join(rng.choice(letters) for _ in range(9))
    rows = [(i, f"http://{some('aeioubdk')}.com/{some('aeioubdk')}", None if i % 5 else False) for i in range(300)]
    rows += [(1000 + i, f"http://{some('qxzwvyjh')}.com/{some('qxzwvyjh')}", True) for i in range(120)] + [(5000, None, True), (5001, "", True)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    out = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.fit(pages, bad_col="bad"), []).collect()}
    assert np.mean([out[i] == "block" for i in range(1000, 1120)]) > 0.95 and np.mean([out[i] == "allow" for i in range(300)]) > 0.98
    assert out[5000] == out[5001] == "allow"
    # The verdict of an empty URL doesn't hang on the threshold.
    model = url_filter.fit(pages, bad_col="bad")
    model.threshold = 3.0
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id >= 5000"), model, []).collect()} == {"allow"}
    one_kind = url_filter.fit(pages.where("page_id < 300"), bad_col="bad")
    assert {r["verdict"] for r in url_filter.judge(pages, one_kind, []).collect()} == {"allow"}


def test_smoothed_probabilities_sum_to_one():
    (t,) = slices(pa.array(["abcab", "abd"]))
    counts = np.zeros(url_filter.SLOTS, np.float32)
    np.add.at(counts, url_filter.places(t)[0].ravel(), 1)
    model = url_filter.Markov(counts)
    slots = url_filter.places(t)[0]
    for k in range(slots.shape[1]):
        every = np.stack([(slots[:, k] >> 6 << 6) + s for s in range(64)], axis=1)
        assert np.exp(model.log_probability(every)).sum() == pytest.approx(1)


def test_url_scores_are_those_of_exact_contexts(spark):
    rng = np.random.default_rng(5)
    urls = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz/"), 40)) for _ in range(400)]
    urls = [f"http://{u}/casino/" if i % 4 == 0 else f"http://{u}" for i, u in enumerate(urls)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: r["score"] for r in url_filter.judge(pages, url_filter.fit(pages), []).collect()}
    counts = [{}, {}]
    contexts = lambda u, i: [u[max(i - k, 0) : i].rjust(k, "^") for k in range(url_filter.ORDERS)]
    spelt = [u.removeprefix("http://") for u in urls]
    for url, u in zip(urls, spelt, strict=True):
        model = counts[bool(re.search(url_filter.REJECT, url))]
        for i, c in enumerate(u):
            for context in contexts(u, i):
                after = model.setdefault(context, {})
                after[c] = after.get(c, 0) + 1

    def probability(model, u, i):
        p = 1 / 64
        for context in contexts(u, i):
            if after := model.get(context):
                p = (after.get(u[i], 0) + len(after) * p) / (sum(after.values()) + len(after))
        return p

    for k, u in enumerate(spelt):
        gain = [np.log(probability(counts[0], u, i) / probability(counts[1], u, i)) for i in range(len(u))]
        assert got[k] == pytest.approx(np.mean(gain), abs=1e-9)


def wu_manber(document, items):
    tables = decontam.compile_patterns(items)
    n_words, hits, found = decontam._search_batch(tables, pa.array([document], pa.string()), None)
    return n_words[0].as_py(), {k for r in hits[0].as_py() for k in range(r["start"], r["stop"])}, found[0].as_py()


def plainly(document, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    d, hit, names = words(document), set(), set()
    for name, text in items:
        w = words(text)
        size = min(13, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(d) - size + 1):
            if tuple(d[i : i + size]) in windows:
                hit.update(range(i, i + size))
                names.add(name)
    return len(d), hit, sorted(names)


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_wu_manber_agrees_with_plain_search(data):
    vocabulary = ["a", "B", "é", "x1", "-", "zz"]
    some = lambda n: st.lists(st.sampled_from(vocabulary), max_size=n).map(" ".join)
    document = data.draw(some(80))
    items = [(str(i), data.draw(some(20))) for i in range(3)]
    inside = document.split()
    if len(inside) > 14:
        items.append(("in", " ".join(inside[2:18])))
    assert wu_manber(document, items) == plainly(document, items)


def test_long_documents_run_in_several_lanes():
    rng = random.Random(1)
    words = [f"w{rng.randrange(3000)}" for _ in range(9000)]
    items = [("a", " ".join(words[500:530])), ("b", " ".join(words[8970:])), ("c", "w1")]
    assert wu_manber(" ".join(words), items) == plainly(" ".join(words), items)


def test_blocks_of_items_give_the_same(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    whole, parts = (decontam.overlaps(docs, bench, block_bytes=n, keep=["doc_id"]).drop("text").collect() for n in (10**9, 1500))
    assert sorted(map(str, whole)) == sorted(map(str, parts))


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(n):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(n))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text):
            n = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(n) <= 19 and luhn(n), "phone": 10 <= len(n) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_agree_with_plain_expressions(spark):
    rng = random.Random(8)
    pieces = ["a", "b.c", "@", ".", "-", "_x", "1", "12", "255", "256", "0007", " ", "(", ")", "+", "+1", "4111111111111111", "4111 1111 1111 1111", "555-1234", "é", "😀", "a@b.c", "d@e-f.g_h@i.j", "1.2.3.4", "\n", "%"]
    cases = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    for r in pii.base_spans(df, "text", "base").collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == base_spans(r["text"]), r["text"]


def test_terms_that_disclose_an_address_are_found_and_rewritten(spark):
    rows = [(i, f"Contact zorblax and Quixotl9 at ana.k@example.com today number {i}") for i in range(5)] + [(100 + i, f"today we contact someone at number {i}") for i in range(200)]
    out = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    told = {s["value"] for s in out[0]["spans"] if s["kind"] == pii.TERM_KIND}
    assert told == {"zorblax", "Quixotl9", "and"} and out[100]["spans"] == []
    assert out[0]["safe_text"] == "Contact   [NUMBER] at [EMAIL] today number 0" and out[100]["safe_text"] == rows[5][1]


def test_terms_far_from_an_address_and_in_other_documents_are_found(spark):
    far = "we met today " * 20
    rows = [(i, f"Quixotl {far} ana.k@example.com") for i in range(8)] + [(50, "Quixotl alone")] + [(100 + i, "we met today") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert all(out[i]["safe_text"] == f"[NAME] {far} [EMAIL]" for i in range(8)) and out[50]["safe_text"] == "[NAME] alone"
    assert out[100]["spans"] == []


def test_archives_follow_the_format_and_damage_is_seen():
    records = [warc.make_record(i, f"http://x/{i}", b"<p>%d</p>" % i * 50, warc.sha1_base32(b"<p>%d</p>" % i * 50), None, False) for i in range(40)]
    data = warc.pack(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data[8 + size :], read_across_frames=True)
    assert reader.read() == b"".join(records)
    assert list(warc.frames(memoryview(data))) == records and all(warc.parse(r).error is None for r in records)
    torn = list(warc.frames(memoryview(data[:-5])))
    assert torn[:-1] == records[:-1] and isinstance(torn[-1], warc.Damaged)
    flipped = bytearray(data)
    flipped[-20] ^= 0xFF
    assert any(isinstance(x, warc.Damaged) for x in warc.frames(memoryview(bytes(flipped))))
    for broken in (records[0].replace(b"WARC/1.1", b"WARC/9.9"), records[0][:-1], records[0].replace(b"WARC-Date", b"X-Date"), records[0].replace(b"<p>0", b"<p>1", 1)):
        assert warc.parse(broken).error
    assert list(warc.frames(memoryview(warc.pack(records[:1])))) == records[:1]


def record(kind, block, *more, date=True):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:8d3c8a1e-7e0b-4b5e-9d0e-3f6f0a6f2b11>", *(["WARC-Date: 2020-01-01T00:00:00Z"] * date), f"Content-Length: {len(block)}", *more]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = "Content-Type: application/http; msgtype=response"


def test_records_of_others_are_read():
    ok = lambda *a: (lambda r: (r.error, r.payload, r.payload_bytes))(warc.parse(record(*a)))
    assert ok("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields") == (None, b"software: x\r\n", 13)
    assert ok("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request") == (None, b"", 0)
    assert ok("response", b"HTTP/1.1 200 OK\r\n\r\nbody", HTTP) == (None, b"body", 4)
    chunks = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n"
    assert ok("response", chunks, HTTP, f"WARC-Payload-Digest: sha1:{warc.sha1_base32(b'abcde')}") == (None, b"abcde", 5)
    assert ok("response", b"93.184.216.34", "Content-Type: text/dns")[:2] == (None, b"93.184.216.34")
    assert ok("revisit", b"", HTTP, "WARC-Refers-To: <urn:x:1>") == (None, b"", None)
    assert ok("resource", b"x", f"WARC-Block-Digest: sha1:{hashlib.sha1(b'x').hexdigest()}", "WARC-Payload-Digest: md5:0") == (None, b"x", 1)
    for bad in (
        record("resource", b"x", "WARC-Block-Digest: sha1:AAAA"), record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nbody", HTTP), record("response", b"nothing", HTTP),
        record("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 99999999999999999999\r\n\r\n", HTTP, "WARC-Refers-To: x"), record("revisit", b""),
        record("resource", b"x", date=False), record("resource", b"x").replace(b"Length: 1", b"Length: " + b"9" * 5000),
    ):
        assert warc.parse(bad).error


def test_damaged_archives_give_rows(spark, tmp_path):
    made = warc.make_record(7, "http://x/", b"abc" * 300, warc.sha1_base32(b"abc" * 300), None, False)
    good = warc.pack([made] * 40)
    _, size = struct.unpack_from("<II", good)
    broken = bytearray(good)
    broken[8 + size // 2] ^= 0xFF
    huge = bytearray(zstandard.ZstdCompressor().compress(b"y" * 100))
    # A frame header with an eight-byte content size of 2 ** 45, and its block as it was.
    huge = huge[:4] + bytes([0xE0]) + struct.pack("<Q", 1 << 45) + huge[6:]
    other = zstandard.ZstdCompressor().compress(record("warcinfo", b"k: v\r\n"))
    below = tmp_path / "2020" / "crawl"
    below.mkdir(parents=True)
    for name, data in {"a.warc.zst": good, "b.warc.zst": bytes(broken), "c.zst": bytes(huge) + other, "d.gz": b"\x1f\x8b" + b"0" * 50, "e": b""}.items():
        (below / name).write_bytes(data)
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    fine = [r for r in rows if r["error"] is None]
    assert sum(r["id"] == 7 for r in fine) == 40 and [(r["id"], r["record_type"], r["record_id"][:10]) for r in fine if r["id"] is None] == [(None, "warcinfo", "<urn:uuid:")]
    assert len(rows) - len(fine) == 3 and any("dictionary" in r["error"] for r in rows if r["error"])
    assert [str(x) for x in warc.frames(memoryview(zstandard.ZstdCompressor().compress(b"z" * 30_000_000)), 1000)] == ["a frame of more than 1000 bytes"]


@given(st.text(alphabet="[]/INST<s>\\RO LE é", max_size=40), st.text(alphabet="[]/INST<s>\\ROLE ", max_size=40))
def test_escapes_are_reversible_and_hide_control_strings(a, b):
    assert chat.unescape(chat.escape(a)) == a and not any(c in chat.escape(a) for c in chat.CONTROLS)
    pieces = [p for p in chat.renderer(chat.TEMPLATE)({"messages": [{"role": "user", "content": a}, {"role": "assistant", "content": b}, {"role": a, "content": b}]}) if isinstance(p, str)]
    role = a if a not in ("user", "assistant") else a
    assert chat.read_turns("".join(pieces)) == ([("user", a), ("assistant", b), (role, b)], len("".join(pieces)))


def render(source, **env):
    return "".join(p for p in template.compile_template(source, chat.FILTERS)(env) if isinstance(p, str))


def test_the_template_language():
    assert render("{% for x in xs %}{{ loop.index }}{{ x.a ~ '!' if loop.last else x['a'] }}{% else %}none{% endfor %}", xs=[{"a": 1}, {"a": 2}]) == "1122!"
    assert render("{% for x in xs %}{% else %}none{% endfor %}", xs=[]) == "none"
    assert render("{% set y = 2 * 3 %}{{ y + 1 }}{# no #}  {%- if not y == 7 and 'a' in 'abc' %} yes{% elif y %}no{% endif %}") == "7 yes"
    assert render("{{ x.missing }}{{ x.__class__ }}|{{ 'a\\n' }}", x={}) == "|a\n"
    for bad in ("{% for x in xs %}", "{{ }}", "{{ f(1) }}", "{% endif %}", "{{ 1 | nothing }}", "{% while x %}", "{{ a b }}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad, chat.FILTERS)


def test_what_chat_templates_ask_for():
    turns = lambda: template.Turns(iter([{"role": "system", "content": "S"}, {"role": "user", "content": "U"}, {"role": "assistant", "content": "A"}]))
    source = """{%- if messages[0]['role'] == 'system' -%}{% set system = messages[0].content %}{% set rest = messages[1:] %}{%- else -%}{% set rest = messages %}{%- endif -%}
    {%- if system is defined -%}<{{ system }}>{%- endif -%}{%- for m in rest -%}{%- if m.role not in ['x'] -%}{%- endif -%}{{ loop.index0 }}{{ m.content }}{%- endfor -%}"""
    source = source.replace("m.role not in ['x']", "m.role not in 'x'")
    assert render(source, messages=turns()) == "<S>0U1A"
    assert render("{% if messages[0].role == 'user' %}no{% endif %}{% for m in messages %}{{ m.content }}{% endfor %}", messages=turns()) == "SUA"
    assert render("{{ -1 + 3 }}{{ 'b' not in 'abc' }}{{ x is not defined }}{{ y is none }}{{ 'abc'[-1] }}{{ 'abcd'[1:3] }}{{ m.k is defined }}", y=None, m={"k": 1}) == "2FalseTrueTruecbcTrue"
    assert render("{% if messages %}some{% endif %}", messages=template.Turns(iter([]))) == ""
    with pytest.raises(template.TemplateError, match="odd turn"):
        render("{% if messages[1].role != 'x' %}{{ raise_exception('odd ' ~ 'turn') }}{% endif %}", messages=turns())
    for bad in ("{{ messages }}", "{{ messages | length }}", "{{ messages[-1] }}", "{{ messages[:1] }}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{{ 1 + 'a' }}", "{{ x + 1 }}"):
        with pytest.raises(template.TemplateError):
            render(bad, messages=turns())


def test_templates_cannot_allocate_at_will():
    for bad in ("{{ '%999999999d' % 1 }}", "{{ 'a' * 1000000000 }}", "{{ 10000000000 * 10000000000 }}", "{{ 'a' * x }}", "{{ 1 % 0 }}", "{{ 1 is odd }}"):
        with pytest.raises(template.TemplateError):
            render(bad, x=10**9)
    with pytest.raises(template.TemplateError):
        render("{% set y = 'ab' %}{% for i in xs %}{% set y = y + y %}{{ y[0] }}{% endfor %}" + "{% set y = y * 100000000 * 100000000 %}", xs=[1])


def test_constants_are_folded():
    nodes = template.fold_all(template.parse("a{{ 'b' ~ (1 + 2) }}{% if 1 > 2 %}x{% else %}c{% endif %}{{ 'D' | lower }}{{ y }}"), chat.FILTERS)
    assert [(n.kind, n.value) for n in nodes] == [("text", "ab3cd"), ("print", None)]
