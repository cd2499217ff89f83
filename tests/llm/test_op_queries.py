"""The queries opN_<name> themselves: against their SQL, or against the tokenizer
libraries and the contract where SQL cannot tell."""

import os
import zlib

import numpy as np
import pytest

from skyframe.llm import queries, toxicity
from skyframe.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return connection


@pytest.fixture(scope="module")
def texts(db):
    return {i: t or "" for i, t in db.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in place) for r in want.fetchall()), key=repr)


def library_ids(file, texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path(file)).encode_batch(list(texts.values()), add_special_tokens=False)
    return {i: e.ids for i, e in zip(texts, found)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_pieces(pieces, ids, size=2048):
    """Each id in one piece; sequences gapless and full but for powers of two."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == ids.keys()
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc]) and p["ids_crc32"] == crc(ids[doc][at : at + p["length"]])
            at += p["length"]
        assert at == len(ids[doc])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding <= 0.01 * sum(map(len, ids.values()))


def test_op4(spark, texts):
    ids = {i: [*x, 1] for i, x in library_ids("byte_bpe_50k.json", texts).items()}
    check_pieces(queries.op4_packing(spark, SF).collect(), ids)


def test_op5(spark, texts):
    ids = {i: [*x, 2] for i, x in sorted(library_ids("word_bpe_49k.json", texts).items())}
    starts = dict(zip(ids, np.cumsum([0, *map(len, ids.values())]).tolist()))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op5_token_ids(spark, SF).collect()}
    assert got == {i: (starts[i], len(x), crc(x)) for i, x in ids.items()}


def test_op9(spark, texts):
    ids = library_ids("word_bpe_49k.json", texts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op9_token_counts(spark, SF).collect()}
    assert got == {i: (len(texts[i].encode()), len(x), len(x) > 2048) for i, x in ids.items()}


def test_op10(spark, texts, db):
    rows = {r["doc_id"]: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_the_curve_is_fitted_on_separable_labels_too():
    x = np.array([[0.0, 0.0]] * 900 + [[40.0, 3.7], [55.0, 4.1], [8.0, 2.2]] * 30)
    y = np.array([0.0] * 900 + [1.0] * 90)
    w = toxicity._logistic(x, y)
    chance = 1 / (1 + np.exp(-(w[0] + x @ np.array(w[1:]))))
    assert np.isfinite(w).all() and np.abs(w).max() < 1000 and ((chance >= 0.5) == (y == 1)).all()


def test_both_ways_of_making_ids_pack_alike(spark):
    from skyframe.llm.packing import pack

    docs = spark.createDataFrame([(1, "Some text, it's 42 <|endoftext|> é"), (2, None), (3, ""), (4, "x " * 5000)], "doc_id long, text string").coalesce(1)
    file = tokenizer_path("byte_bpe_50k.json")
    one, two = (sorted(map(tuple, pack(docs, file, compiled=c).drop("ids").collect())) for c in (True, False))
    assert one == two


def test_pipeline_of_odd_tables(spark, tmp_path, texts):
    """Repeated and null ids, empty and null texts, extra columns; then no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "a b c d e f g h", "k"), (1, "a b c d e f g h", "k"), (2, "A b c d e f g h", "z"), (None, "no id but words of its own here", None), (3, None, None), (4, "", None), (5, "quite another text of seven words", "q")]
    for n, folder in ((len(rows), "some"), (0, "none")):
        at = str(tmp_path / folder)
        spark.createDataFrame(rows, "doc_id long, text string, component_id string").limit(n).write.parquet(f"{at}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
        pieces = pipeline.run(spark, at).collect()
        if n:
            assert {p["doc_id"] for p in pieces} == {None, 2, 4, 5}
            for doc in (None, 2, 4, 5):  # whole, whatever the cuts
                own = sorted((p["start"], p["length"], p["doc_tokens"]) for p in pieces if p["doc_id"] == doc)
                assert [a for a, _, _ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1]] and sum(n for _, n, _ in own) == own[0][2]
        else:
            assert pieces == []


