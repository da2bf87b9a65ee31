"""Encoding, packing, token files and the word table against the tokenizers library on whole texts."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import multiset
from triagekit.llm import binary, encode, pack, words
from triagekit.sources.store import new_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
TRICKY = st.text(st.sampled_from(list("ab' sT,.\n\t1é́İΣ\x1c　 <|>")), max_size=40) | st.text(max_size=30)


def ids_of(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


LINED = st.lists(st.sampled_from(["a", "B,", "'s", "x'll", "1\u00b2", "\u00e9.", "<|endoftext|>", "\n", "\n\n", " ", "  ", "\t", "\r\n", "\u00a0", "\x1c", "\u5317"]), max_size=24)


def fresh():
    return encode.IdEncoder(BYTE)


FRESH = fresh()


@settings(max_examples=1000, deadline=None)
@given(st.lists(LINED.map("".join), max_size=4), st.booleans())
def test_lines_have_the_ids_of_the_text(texts, forget):
    if forget:
        for kept in (*FRESH.words.values(), FRESH.others):
            kept.now, kept.before = {}, {}
    got = FRESH.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(BYTE, t) for t in texts]


def test_few_words_are_kept(monkeypatch):
    monkeypatch.setattr(encode, "KEPT_WORDS", 40)
    monkeypatch.setattr(encode, "GROUP_BYTES", 400)
    own, texts = fresh(), [" ".join(f"w{'xyz'[i % 3] * ((i * j) % 97)}{'z' * (150 if i % 9 == 0 else 1)}" for j in range(60)) for i in range(40)]
    assert [np.frombuffer(g, "<u4").tolist() for g in own.encode(texts)] == [ids_of(BYTE, t) for t in texts]
    kept = own.words[" "]
    assert 0 < max(len(kept.now), len(kept.before)) <= 40
    assert not any(len(w) > encode.LONG_WORD for w in [*kept.now, *kept.before])


def test_pieces_of_a_sliced_column():
    texts = pa.array(["skip", "a b\n\nc", None, "", " x  y", "d e."]).slice(1)
    assert [np.frombuffer(g, "<u4").tolist() for g in fresh().encode(texts)] == [ids_of(BYTE, t) for t in texts.to_pylist()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_pieces_have_the_ids_of_the_text(text):
    got = list(encode.encoder(BYTE).encode([text, None, text + "<|endoftext|> x " + text]))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(BYTE, t) for t in (text, "", text + "<|endoftext|> x " + text)]


@settings(max_examples=500, deadline=None)
@given(TRICKY | st.lists(st.text(st.sampled_from(list("aBzÀÖ×÷ßŉǅȺɏɐİḁ1_.,;:!?#$%&*|'")), max_size=8), max_size=8).map(" ".join))
def test_words_have_the_ids_of_the_text(text):
    s = words.splitter(WORD)
    text = f"{text} <|startoftext|>{text}"
    found = [w for part in text.split(" ") for w in s.words(part)]
    assert [i for w in found for i in s.ids(w)] == ids_of(WORD, text)


def check_packed(docs, packed, size, end):
    rows = packed.collect()
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size and at & (at - 1) == 0  # full, or a length that needs no padding
    expected = sorted((r.doc_id is None, r.doc_id or 0, ids_of(BYTE, r.text) + [end]) for r in docs.select("doc_id", "text").collect())
    assert sum(len(x[2]) for x in expected) == sum(r.length for r in rows)
    for null, key, _ in expected:
        key = None if null else key
        own = [ids for n, k, ids in expected if (None if n else k) == key]
        found = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces[key])
        if len(own) == 1:
            assert [p[0] for p in found] == np.cumsum([0] + [p[1] for p in found[:-1]]).tolist()
            assert all(crc(own[0][s : s + n]) == c and total == len(own[0]) for s, n, c, total in found)
        else:
            assert all(any(crc(ids[s : s + n]) == c and total == len(ids) for ids in own) for s, n, c, total in found)
            assert sum(p[1] for p in found) == sum(map(len, own))


@pytest.mark.parametrize("parts", [1, 40])
def test_packing(documents, parts):
    docs = documents.repartition(parts)
    check_packed(docs, pack.pack_documents(docs, BYTE, 2048, 1), 2048, 1)


def test_packing_edges(edge, none):
    check_packed(edge, pack.pack_documents(edge, BYTE, 64, 1, open_windows=3), 64, 1)
    assert pack.pack_documents(none, BYTE).count() == 0


def test_window_count_is_bounded():
    packer = pack.Packer(16, 4)
    rng = np.random.default_rng(1)
    total = closed = 0
    for i in range(500):
        n = int(rng.integers(1, 40))
        total += n
        for w in packer.add(pack.Piece(i, 0, n, memoryview(bytes(4 * n)))):
            assert w.gap == 0
            closed += 16
        assert len(packer.windows) <= 4
    rest = [sum(p.length for p in w.pieces) for w in packer.join_rest()]
    assert closed + sum(rest) == total and all(n & (n - 1) == 0 for n in rest)


def check_files(spark, docs, end):
    folder = new_path(spark, "test-files")
    binary.write_ids(docs, folder, BYTE, end)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start, expected, lists = 0, [], []
    for key, text in rows:
        ids = ids_of(BYTE, text) + [end]
        expected.append((key, start, len(ids), crc(ids)))
        lists.append((key, start, ids))
        start += len(ids)
    assert multiset(binary.read_digests(spark, folder).collect()) == multiset(expected)
    assert multiset(binary.read_ids(spark, folder).collect()) == multiset(lists)


def test_token_files(spark, documents):
    check_files(spark, documents, 2)


def test_token_files_edges(spark, edge, none):
    check_files(spark, edge, 2)
    check_files(spark, edge, 70_000)  # does not fit into 16 bits
    check_files(spark, none, 2)


def expected_words(docs):
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(WORD, r.text)
        yield r.doc_id, ids, LIBRARY[WORD].decode(ids, skip_special_tokens=False)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_word_table(documents):
    expected = [(k, len(ids), sha(" ".join(map(str, ids))), sha(text)) for k, ids, text in expected_words(documents)]
    assert multiset(words.encoded_digests(documents, WORD).collect()) == multiset(expected)


def test_word_table_edges(edge, none, monkeypatch):
    monkeypatch.setattr(words, "MOST_STRETCHES", 50)
    assert multiset(words.encode(edge, WORD).collect()) == multiset(expected_words(edge))
    assert words.encoded_digests(none, WORD).count() == 0


def test_decode(spark):
    vocabulary = words.pieces(spark, WORD)
    lists = spark.createDataFrame([(1, [320, 49407, 5]), (2, []), (3, None), (4, [5, 10**6, 5])], "k long, ids array<int>")
    got = {r.k: r.decoded for r in words.decode(lists, "k", "ids", vocabulary).collect()}
    assert got[1] == LIBRARY[WORD].decode([320, 49407, 5], skip_special_tokens=False)
    assert got[2] == got[3] == ""
    assert got[4] == LIBRARY[WORD].decode([5, 5])
