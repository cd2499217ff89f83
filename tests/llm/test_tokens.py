"""Transducer, packing, id files: against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from skyframe.llm import id_coder, packing, token_fst, tokens
from skyframe.llm.store import Scratch
from skyframe.llm.token_fst import BpeTransducer, token_counts, transducer
from skyframe.llm.tokens import library, tokenizer_path, word_level

tokenizers = pytest.importorskip("tokenizers")
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
PARTS = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "'s", "'", "<|endoftext|>", "<|startoftext|>", "...", "'re", "\x1c", "\x85", "\u0301", "Σ", "日", "'LL", "\r", "\u200b", "İ", "the", "ing", "½", "😀", "zq"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    fixed = ["", None, "don't", "''s's'll", "x" * 3000, "a  'tis", "\n's x", "a \n\n b", " 's", "   ", "ab " * 5000]
    return fixed + ["".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(1500)]


def library_ids(name, texts):
    t = tokenizers.Tokenizer.from_file(tokenizer_path(name))
    return [np.array(e.ids, "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts_are_the_library_s(texts):
    assert BpeTransducer(tokenizer_path(WORD)).count(texts) == [len(x) for x in library_ids(WORD, texts)]


def test_ids_are_the_library_s(texts):
    assert transducer(tokenizer_path(BYTE), counting=False).ids(texts) == [x.tobytes() for x in library_ids(BYTE, texts)]
    assert word_level(tokenizer_path(WORD)).encode(texts) == [x.tobytes() for x in library_ids(WORD, texts)]


def test_the_library_gets_each_word_once():
    """Each unit was encoded, with its signs and capitals: most of op5's tokenization."""

    class Counted:
        words: list[str] = []

        def encode_batch_fast(self, some, **options):
            self.words += [w for text in some for w in text.split()]
            return own.encode_batch_fast(some, **options)

    units = tokens.WordIds(tokenizer_path(WORD))
    own, units.tokenizer = units.tokenizer, Counted()
    given = ["Nevező, nevező. (NEVEZő", "nevező; nevező...", None, "", "a-nevező: it's"]
    for _ in range(2):
        assert units.encode(given) == [x.tobytes() for x in library_ids(WORD, given)]
    assert sorted(Counted.words) == sorted(["nevező", ",", ".", "(", ";", "...", "a", "-", ":", "it's"])


def test_kept_words_are_bounded(texts, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 60)
    monkeypatch.setattr(tokens, "GROUP_BYTES", 400)
    monkeypatch.setattr(tokens, "_SEAT_BITS", 3)  # seats clash, and are too few
    rng = random.Random(6)
    some = texts[-400:] + ["".join(rng.choices("abcdEFGéß-.,<' 1\n", k=rng.randint(0, 300))) for _ in range(200)] + ["", None, "Ab" * 9, "q" * 17, "Ⱥɏ Ɏ", "İi", "a\x00b a\x00", "<|ENDOFTEXT|> x<|endoftext|>"]
    units = tokens.WordIds(tokenizer_path(WORD))
    assert units.encode(some) == [x.tobytes() for x in library_ids(WORD, some)]
    assert units.encode([None, ""]) == [b"", b""] and units.encode([]) == []


def test_the_library_holds_one_text_at_once(texts):
    """Encodings of 1024 texts at once took some 120 MB more of a worker."""

    class Counted:
        most = 0

        def encode_batch_fast(self, some, **options):
            self.most = max(self.most, len(some))
            return own.encode_batch_fast(some, **options)

    units = library(tokenizer_path(BYTE))
    own, units.tokenizer = units.tokenizer, Counted()
    try:
        assert units.ids(texts) == [x.tobytes() for x in library_ids(BYTE, texts)]
        assert units.tokenizer.most == 1
    finally:
        units.tokenizer = own


def test_chunks_do_not_matter(texts, monkeypatch):
    from skyframe.llm import token_fst

    monkeypatch.setattr(token_fst, "BATCH_BYTES", 5000)
    monkeypatch.setattr(token_fst, "MAX_STATES", 400)
    for lanes in (1, 7, 500):
        monkeypatch.setattr(token_fst, "LANES", lanes)
        assert BpeTransducer(tokenizer_path(WORD)).count(texts) == [len(x) for x in library_ids(WORD, texts)]


def test_token_counts_query(spark, texts):
    rows = [(k, t, 1) for k, t in enumerate(texts[:200])] + [(None, "a", 1), (1, None, 1), (1, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, tokenizer_path(WORD)).collect()), key=repr)
    want = sorted(((i, len((t or "").encode()), len(x)) for (i, t, _), x in zip(rows, library_ids(WORD, [r[1] for r in rows]))), key=repr)
    assert got == want
    assert token_counts(docs.limit(0), tokenizer_path(WORD)).count() == 0


def check_pieces(rows, pieces, end, size):
    """Every id lies in one piece, sequences are gapless, padding is at powers of two."""
    want = {i: np.append(x, end).astype("<u4") for i, x in rows}
    seen = {}
    for p in pieces:
        seen.setdefault(p["doc_id"], []).append(p)
        ids = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(ids) == p["length"] and zlib.crc32(ids.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(want[p["doc_id"]])
    assert seen.keys() == want.keys()
    for i, own in seen.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(want[i])
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size and (at == size or at & (at - 1) == 0)


def test_packing(spark, texts):
    rows = list(enumerate(texts[:400]))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, offset int").repartition(3)
    out = packing.pack(docs, tokenizer_path(BYTE), end_id=1, size=256, max_open=20).collect()
    ids = library_ids(BYTE, [t for _, t in rows])
    check_pieces([(i, x) for (i, _), x in zip(rows, ids)], out, 1, 256)
    again = packing.pack(docs, tokenizer_path(BYTE), end_id=1, size=256, max_open=20).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert packing.pack(docs.limit(0), tokenizer_path(BYTE)).count() == 0
    twice = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert packing.pack(twice, tokenizer_path(BYTE)).count() >= 3


def test_sum_of_squares_choice():
    p = packing.SumOfSquaresPacker(10, 100)
    rng = np.random.default_rng(3)
    for k in range(300):
        s = int(rng.integers(1, 10))
        n = p.counts.copy()

        def squares(level):
            after = n.copy()
            if level:
                after[level] -= 1
            if level + s < 10:
                after[level + s] += 1
            return int((after[1:10] ** 2).sum())

        options = [0] + [h for h in range(1, 10 - s + 1) if n[h]]
        chosen = p.level_for(s)
        assert chosen in options and squares(chosen) == min(map(squares, options))
        p.add(k, bytes(4 * s))


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    for ids in ([], [5], [7] * 5000, rng.zipf(1.3, 20_000) % 49408, rng.integers(0, 65536, 9000), np.tile(rng.integers(0, 500, 300), 60)):
        ids = np.array(ids, np.uint32)
        blocks = id_coder.encode_blocks(ids)
        assert (id_coder.decode_blocks(blocks, id_coder._blocks(len(ids))) == ids).all()
    repeated = np.tile(rng.integers(0, 40_000, 200), 200).astype(np.uint32)
    assert sum(map(len, id_coder.encode_blocks(repeated))) < len(repeated)
    with pytest.raises(ValueError):
        id_coder.encode_blocks(np.array([70_000], np.uint32))


def test_blocks_share_what_a_file_is_fitted_to():
    """Each block began with an empty model, of which its first ids had nothing."""
    ids = np.tile(np.random.default_rng(6).permutation(40_000)[:3000], 40).astype(np.uint32)
    blocks = id_coder.encode_blocks(ids)
    assert 16 * sum(map(len, blocks)) < len(ids) * 2
    assert (id_coder.decode_blocks(blocks[20:], id_coder._blocks(len(ids))[20:]) == ids[20 * 4096 :]).all()
    for n in (1, 2, 3, 4095, 4097, 4099, 8190):
        back = id_coder.unpack_file(id_coder.pack_file([7], [n], ids[:n]))[2]
        assert (back == ids[:n]).all()


def test_blocks_stand_alone_and_are_checked():
    ids = np.random.default_rng(5).integers(0, 900, 10_000).astype("<u4")
    blocks, sizes = id_coder.encode_blocks(ids), id_coder._blocks(10_000)
    assert (id_coder.decode_blocks(blocks[1:2], sizes[1:2]) == ids[4096:8192]).all()
    data = bytearray(id_coder.pack_file([1, None], [4000, 6000], ids))
    docs, lengths, back = id_coder.unpack_file(bytes(data))
    assert docs == [1, None] and lengths.tolist() == [4000, 6000] and (back == ids).all()
    data[-40] ^= 1
    with pytest.raises(ValueError, match="damaged block 2"):
        id_coder.unpack_file(bytes(data))
    data[60] ^= 1
    with pytest.raises(ValueError, match="damaged head"):
        id_coder.unpack_file(bytes(data))


def test_id_files(spark, texts):
    rows = [(k * 7 % 300, t) for k, t in enumerate(texts[:300])] + [(None, "a b")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    scratch = Scratch(spark, "ids")
    manifest = scratch.save(id_coder.write_ids(docs, scratch.path("f"), tokenizer_path(WORD)), "m")
    got = id_coder.read_ids(manifest, scratch.path("f"), with_ids=True).orderBy("start").collect()
    ids = dict(zip([i for i, _ in rows], library_ids(WORD, [t for _, t in rows])))
    assert [r["doc_id"] for r in got] == sorted(ids, key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        want = np.append(ids[r["doc_id"]], 2).astype("<u4").tobytes()
        assert bytes(r["ids"]) == want and (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want) // 4, zlib.crc32(want))
        at += r["n_tokens"]
    fs, base = pafs.FileSystem.from_uri(scratch.path("f"))
    assert all(f.path.endswith(".bin") for f in fs.get_file_info(pafs.FileSelector(base)))
    empty = scratch.save(id_coder.write_ids(docs.limit(0), scratch.path("g"), tokenizer_path(WORD)), "e")
    assert id_coder.read_ids(empty, scratch.path("g")).count() == 0


@pytest.mark.parametrize("maps", [16, 0])  # 0: only true entries, as for chunks that never forget theirs
def test_words_through_many_chunks(monkeypatch, maps):
    monkeypatch.setattr(token_fst, "MAPS_PER_CHUNK", maps)
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("aeinrstk", k=n))
    texts = ["a" * 40_000, "the" * 12_000, letters(30_000), " ".join(letters(rng.choice([2, 70, 900, 4000])) for _ in range(60)), "szépvíz" * 5_000 + " ok", "-" * 9_000 + "=" * 9_000]
    machine, want = BpeTransducer(tokenizer_path(WORD)), [len(i) for i in library_ids(WORD, texts)]
    assert [machine.count([t])[0] for t in texts] == want and machine.count(texts) == want
    machine = BpeTransducer(tokenizer_path(BYTE), counting=False)
    assert machine.ids(texts) == [i.tobytes() for i in library_ids(BYTE, texts)]


def test_a_million_letters_without_a_word_end():
    text = "nevezetes" * 115_000
    assert BpeTransducer(tokenizer_path(WORD)).count([text]) == [len(library_ids(WORD, [text])[0])]
