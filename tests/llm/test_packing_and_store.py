"""Packing and the token store against the tokenizers library itself."""
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import bm25, packing, substring_dedup, token_store
from faultline.llm.tokens import WordTokens
from faultline.session import scratch_path

PARTS = ["a", "b", "The", "it's", "İ", "ß", "ς", " ", "  ", "\n", "\n\n", "\t", " ", "　", ".", ",", "!!", "'s", "'", "é", "1", "23", "<|endoftext|>", "<|",
         "\x01", "\x00", "\x1c", "\x85", "漢字", "😀", "’", "...", "_", "-", "ﬁ"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_word_by_word_ids_are_the_library_s(name, lower, texts):
    ours, whole = _both(name, lower)
    got = ours.blobs([t.encode() for t in texts])
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


_made = {}


def _both(name, lower):
    if name not in _made:
        _made[name] = WordTokens(name, lower), Tokenizer.from_file(public_tokenizers.path(name))
    return _made[name]


def check_places(rows, size=1024):
    seats = defaultdict(list)
    for r in rows:
        seats[r.sequence_id].append((r.offset, r.length))
    for taken in seats.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= size
    return sum(r.length for r in rows) / (size * len(seats)) if seats else 1.0


def test_packing_whole_table(read):
    docs = read("documents")
    rows = packing.report(docs).collect()
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {r.doc_id: whole.encode(r.text, add_special_tokens=False).ids + [0] for r in docs.collect()}
    covered = Counter()
    for r in rows:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert len(piece) == r.length and crc(piece) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
    assert covered == {i: len(x) for i, x in ids.items()}
    assert check_places(rows) > 0.97


def test_packing_tricky_rows(tricky, empty):
    rows = packing.report(tricky).collect()
    check_places(rows)
    by = Counter(r.doc_id for r in rows if r.start == 0)
    assert by == Counter(r.doc_id for r in tricky.collect())
    assert all(r.doc_tokens == 1 for r in rows if r.doc_id in (1, 2))
    assert packing.report(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_shortest_pack_first_places_every_piece(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = Counter()
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= 64
        for n in lengths:
            placed[n] += count
    assert placed == histogram
    table = packing.slots(patterns)
    for n, most in histogram.items():  # the slots' ranges of ranks follow each other without a gap
        mine = table[table[:, 0] == n]
        assert mine[0, 1] == 0 and (mine[1:, 1] == (mine[:, 1] + mine[:, 3])[:-1]).all() and mine[-1, 1] + mine[-1, 3] == most


def test_store_whole_table(read):
    docs = read("documents")
    got = {r.doc_id: r for r in token_store.report(docs).collect()}
    whole = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    before = 0
    for r in docs.orderBy("doc_id").collect():
        ids = whole.encode(r.text, add_special_tokens=False).ids + [1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (before, len(ids), crc(ids))
        before += len(ids)
    assert len(got) == docs.count()


def test_store_tricky_rows(spark, tricky, empty):
    rows = sorted(token_store.report(tricky).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in tricky.collect()], key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows[:-1]]).tolist()
    assert all(r.n_tokens == 1 and r.ids_crc32 == crc([1]) for r in rows if r.doc_id in (1, 2))
    assert token_store.report(empty).collect() == []


def test_one_document_is_read_by_itself_and_the_dictionary_is_checked(spark, read):
    folder = scratch_path(spark, "store")
    shards = token_store.write_store(read("documents"), folder).collect()
    fs, root = token_store._open(folder)
    dictionary = fs.open_input_stream(f"{root}/dictionary").read()
    assert dictionary
    shard = token_store.Shard(fs, f"{root}/{shards[0].path}", dictionary)
    k = len(shard.index) // 2
    text = read("documents").filter(f"doc_id = {shard.index[k, 0]}").first().text
    whole = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    assert np.frombuffer(shard.ids(k), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids + [1]
    with pytest.raises(ValueError):
        token_store.Shard(fs, f"{root}/{shards[0].path}", dictionary + b"x")


def test_large_ids_beside_a_null_id_stay_exact(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(None, "a b"), (big, "c d"), (big + 1, "e f"), (-big, "g")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in token_store.report(docs).collect()} == {None, big, big + 1, -big}
    assert {r.doc_id for r in substring_dedup.report(docs).collect()} == {None, big, big + 1, -big}
    asked = spark.createDataFrame([(1, "a c e g")], "query_id long, text string")
    assert {r.doc_id for r in bm25.search(docs, asked).collect()} == {None, big, big + 1, -big}
