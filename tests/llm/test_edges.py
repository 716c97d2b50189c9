"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidelog.llm import bpe, chat, decontam, langid, near_dedup, pii, quality, url_filter, warc
from tidelog.llm.line_dedup import line_dedup

LONG = "word " * 60_000 + "\n" + "x" * 200_000 + "\nana@example.com " + "1" * 5000
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (4, "a b c"), (5, LONG), (None, "no id here at all"), (6, None), (7, "\n\n\n\n\n"), (8, "é中😀 ñandú")]
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i != 3 else None) for i, t in TEXTS], "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns with the names that operators add or use inside, in other cases too, and names that need quotes."""
    names = "N_LINES n_removed spans Safe_Text base n_words hits items n_hit contaminated ids decoded kept base_failed lang_pred score class_id id key host".split()
    names += "id2 key2 tid same keys sketch comp term told s own lines w pos h1 h2 first cut_at cut_id CUT_KEY cut_lines class_of class_min pii_text pii_key pii_id2 pii_key2 pii_extra extra".split()
    names += "doc_key doc_key_id doc_lines has_letter lang2 good place word_chars line_marks content_share a.b a`b".split() + ["", "two words"][1:]
    return docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


def operators(spark):
    bench = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "item_id bigint, text string")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id bigint, quality int, toxic int")
    return {
        "lines": line_dedup,
        "near": near_dedup.near_duplicates,
        "pii": pii.sanitise,
        "decontam": lambda d: decontam.overlaps(d, bench),
        "bpe": lambda d: bpe.encode(d, PATH),
        "langid": lambda d: langid.identify(d, langid.fit(d)),
        "quality": lambda d: quality.judge(d, quality.fit(d, labels)),
    }


@pytest.mark.parametrize("name", ["lines", "near", "pii", "decontam", "bpe", "langid", "quality"])
def test_rows_stay_whatever_they_hold(spark, docs, clashing, name):
    f = operators(spark)[name]
    out = f(docs)
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(str(i) for i, _ in TEXTS)
    wide = f(clashing)
    assert wide.columns[: len(clashing.columns)] == clashing.columns
    assert len({c.lower() for c in wide.columns}) == len(wide.columns) and len(wide.columns) > len(clashing.columns)
    assert wide.count() == len(TEXTS)
    empty = f(docs.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_defined_results(spark, docs):
    ops = operators(spark)
    lines = by_id(ops["lines"](docs), "text", "n_lines", "n_removed")
    assert lines[1] == (None, 0, 0) and lines[2] == ("", 1, 0) and lines[7] == ("\n\n\n\n\n", 6, 0)
    near = by_id(ops["near"](docs), "class_id")
    assert near[1] == (1,) and near[4] == (4,) and near[None] == (None,) and near[2] == (2,) and near[3] == (3,)
    found = by_id(ops["pii"](docs), "spans", "safe_text")
    assert found[1] == ([], "") and found[8] == ([], "é中😀 ñandú")
    at = LONG.index("ana@")
    assert [(s["kind"], s["start"], s["end"]) for s in found[5][0]] == [(0, at, at + 15)]
    assert found[5][1] == LONG.replace("ana@example.com", "[EMAIL]")
    hits = by_id(ops["decontam"](docs), "n_words", "n_hit", "items", "contaminated")
    assert hits[1] == (0, 0, [], False) and hits[4] == (3, 3, ["1"], True) and hits[8] == (2, 0, [], False)
    tokens = by_id(ops["bpe"](docs), "ids", "decoded")
    assert tokens[1] == tokens[2] == tokens[3] == ([], "")
    langs = by_id(ops["langid"](docs), "lang_pred", "score")
    assert all(langs[k] == ("und", 0.0) for k in (1, 2, 3, 7)) and langs[8][0] == "en" and 0 <= langs[8][1] <= 1
    kept = by_id(ops["quality"](docs), "n_words", "kept", "line_marks")
    assert kept[1] == (0, False, "-") and kept[7] == (0, False, "------") and kept[4][0] == 3


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://net", "http://net/", "no scheme", None, "", "x://example.com/de/1", "x://a.org/fr/", "x://b.org/en/", "ftp://free-bets.example.org/en/1", "a://b://net/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, HOST string")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    out = url_filter.judge(pages, url_filter.fit(pages), rules)
    got = {r["page_id"]: (r["_host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][:3] == ("net", "", None) and got[2] == ("net", "/", "net/", "block")
    assert got[3][:3] == got[4][:3] == got[5][:3] == ("", "", None) and got[4][3] == got[5][3] == "allow"
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == ("org/fr/", "allow") and got[8][2] is None
    assert got[10][0] == "b:"
    assert url_filter.judge(pages.limit(0), url_filter.fit(pages.limit(0)), rules).count() == 0
    nothing = url_filter.judge(pages.where("page_id = 8"), url_filter.fit(pages.where("page_id = 8")), [])
    assert nothing.first()["verdict"] == "allow"


def test_archives(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (5, None, "same"), (5, "v", "same"), (2, "u\r\nx", None), (3, "", ""), (None, "n", "same"), (-7, "m", "é" * 100_000)], "page_id bigint, url string, html string")
    got = sorted((str(r["id"]), r["record_type"], r["payload_bytes"], r["refers_to"], r["error"]) for r in warc.round_trip(pages).collect())
    assert got == sorted([("1", "revisit", 4, 5, None), ("5", "response", 4, None, None), ("5", "response", 4, None, None), ("2", "revisit", 0, 3, None), ("3", "response", 0, None, None), ("None", "revisit", 4, 5, None), ("-7", "response", 200_000, None, None)])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 2, "assistant", None), (1, 1, None, "</s>[INST] \\ [/INST]"), (None, None, "user", "x"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (2, 1, "tool\n[ROLE]", "<" * 5)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, PART int")
    parts = chat.format_turns(df)
    turns = {}
    for r in sorted(parts.collect(), key=lambda r: (str(r["conv_id"]), r["part"])):
        turns.setdefault(r["conv_id"], []).extend(chat.read_turns(r["formatted"])[0])
    assert turns == {1: [("", "</s>[INST] \\ [/INST]"), ("assistant", ""), ("assistant", "b"), ("assistant", "b")], 2: [("tool\n[ROLE]", "<" * 5)], None: [("user", "x")]}
    read = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(parts).collect()}
    assert read == {1: (4, 2), 2: (1, 0), None: (1, 0)}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
