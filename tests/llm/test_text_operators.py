"""URL filter, exact dedup, chat formatting, decontamination."""

import hashlib
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyframe.llm import chat, decontam, exact_dedup, queries, url_filter
from skyframe.llm.url_filter import UrlRule, WildcardAutomaton


def lower(text):
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


# --- URL filter --------------------------------------------------------------


def glob_regex(glob):
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if c == "\\":
            k += 1
            out += re.escape(glob[k])
        elif glob[k : k + 2] == "**":
            out, k = out + ".*", k + 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        k += 1
    return re.compile(out, re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/*?", max_size=6), min_size=1, max_size=40), st.lists(st.text("ab/é", max_size=12), max_size=8))
def test_automaton_matches_regular_expressions(globs, texts):
    globs = [g.replace("***", "**") for g in globs]
    fits = WildcardAutomaton(globs).match(texts)
    for row, text in zip(fits, texts):
        assert row.tolist() == [bool(glob_regex(g).fullmatch(text)) for g in globs]


def test_automaton_carries_between_words():
    globs = ["a" * 100 + "*b", "x" * 70]
    fits = WildcardAutomaton(globs).match(["a" * 103 + "b", "x" * 70, "a" * 99 + "b"])
    assert fits.tolist() == [[True, False], [False, True], [False, False]]


def test_url_verdicts(spark):
    urls = {
        "http://WWW.Example.com/en/a?x#y": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "https://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
        "https://a.net/EN": ("a.net", "/EN", None, "allow"),
        "https://a.com?q=/en/": ("a.com", "", None, "allow"),
        "https://x.org/y.com/": ("x.org", "/y.com/", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://h://b.com/": ("h:", "//b.com/", None, "allow"),
    }
    rows = [(k, u, "clash") for k, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = url_filter.judge_urls(pages, queries.URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["url"]]
    kept = url_filter.filter_urls(pages, queries.URL_RULES)
    assert kept.columns == pages.columns and kept.count() == 2 * sum(v[3] == "allow" for v in urls.values())
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert url_filter.judge_urls(pages, []).where("verdict = 'allow' and rule is null").count() == len(rows)


def test_url_ties_go_to_block(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    row = url_filter.judge_urls(pages, [UrlRule("a.b/", "allow"), UrlRule("a.b/", "block")]).first()
    assert row["verdict"] == "block"


# --- exact dedup -------------------------------------------------------------


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t or ""), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t or "")]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "Abc"), (2, "abc"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "abc"), (7, "abc"), (None, "abc"), (None, "zz"), (8, "x" * 200_000), (9, "X" * 200_000)]


def test_exact_groups(spark):
    rows = ROWS + [(100 + k, "hot") for k in range(300)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, digest string").repartition(5)
    got = exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_groups(rows)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in ROWS], "doc_id long, text string, kept string")
    got = exact_dedup.dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"][:3]) for r in got.where("doc_id is not null").collect()) == [(4, ""), (5, "É"), (6, "é"), (7, "abc"), (9, "XXX")]
    assert got.where("doc_id is null").count() == 1


def test_equal_digests_do_not_merge_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}


# --- chat formatting ---------------------------------------------------------

CONTROL = st.sampled_from(["\\", "#", "<", "### ", "<msg>", "<and>", "</turn>\n", "a", "é", "\n", "😀", ">", "user"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "sys<#\\"]), st.lists(CONTROL, max_size=6).map("".join)), min_size=1, max_size=12))
def test_chat_round_trip(spark, turns):
    rows = [(1, k, role, text) for k, (_, role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).select("formatted", chat.parse_chat(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t["role"], t["text"]) for t in out["turns"]] == [(r, x) for _, _, r, x in rows]
    assert out["loss"] == "".join(x for _, _, r, x in rows if r == "assistant")


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(1, 1, "user", None, "z"), (1, 0, "user", "a", "z"), (1, 2, "assistant", "b", "z"), (1, 2, "assistant", "b", "z"), (2, 0, None, "x" * 100_000, "z"), (None, None, "assistant", "q", "z")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["formatted"] == "### user<msg>a<and></turn>\n### assistant<msg>b<and>b</turn>\n"
    assert [(s["start"], s["length"]) for s in got[1]["loss_spans"]] == [(45, 1), (51, 1)]
    assert len(got[2]["formatted"]) == 100_000 + 17 and got[2]["loss_spans"] == []
    assert got[None]["formatted"] == "### assistant<msg>q</turn>\n"
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


# --- decontamination ---------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items, width):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text or ""))
        for k in range(max(1, len(w) - width + 1)) if w and item is not None else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, named = WORD.findall(lower(text or "")), set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    named |= owners
        out.append((doc, len(w), len(hit), sorted(named), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_contamination(spark, limit):
    rng = random.Random(4)
    words = ["a", "b", "c", "é", "x1", "the"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(60)] + [(None, "A-b c"), (5, "a b c a b"), (5, "a b c a b"), (70, None), (71, "...")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 7)))) for k in range(12)] + [(90, None), (91, ""), (None, "a b"), (92, "zzz never"), (3, "c, C; c")]
    a = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, words int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(a, b, width=4, broadcast_windows=limit)
    got = got.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_contamination(docs, items, 4)


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).first()["n_hit"] == 0
    mixed = spark.createDataFrame([(1, "a b", 1), (2, "c", 2), (2, "a", 3)], "doc_id long, text string, _bad int")
    left = decontam.drop_contaminated(mixed, items)
    assert left.columns == mixed.columns and [(r["doc_id"], r["text"]) for r in left.collect()] == [(2, "c")]
