"""Tokenizer operators against the tokenizers library."""

import glob
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthgrid.llm.bpe import decode_documents, encode_documents
from hearthgrid.llm.token_files import open_token_file, read_token_index, write_token_files
from hearthgrid.llm.wordpieces import public_path, read_tokenizer, splitter

from .helpers import corpus, frame

WORD, BYTE = public_path("word_bpe_49k.json"), public_path("byte_bpe_50k.json")
ODD = ["It's 3.14² o'clock, DON'T!!  two  blanks\n\n\nlines\t\ttabs ", "Ünïcödé ß ÀÉ İı Σίσυφος ΣΑΣ 漢字かな 한국어 ﬁ é  nbsp em \x1c \x85  ",
       "<|endoftext|> and <|startoftext|>mid<|endoftext|>", "'s't're've'm'll'd ''s '''", "a" * 5000, "🙂👍🏽 \U0001d54f", "“quoted” – dash…", "\x00\x01", "x<|endoftext|", " lead"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def rows_of():
    rows = corpus(11, 20)
    return rows + [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000, ODD[0])]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encode_decode(spark, path):
    rows, t = rows_of(), library(path)
    df = frame(spark, rows + [(None, "null id"), rows[0]])
    enc = encode_documents(df, path, block_bytes=20_000)
    got = {(r["id"], tuple(r["ids"])): r["decoded"] for r in decode_documents(enc, path).collect()}
    want = {}
    for i, x in rows + [(None, "null id")]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[(i, tuple(ids))] = t.decode(ids, skip_special_tokens=False)
    assert got == want
    assert enc.count() == df.count()
    digest = {r["id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in decode_documents(enc, path, digests=True).collect()}
    for (i, ids), text in want.items():
        assert digest[i] == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17f), st.characters(blacklist_categories=("Cs",)), st.sampled_from(" \n't́")), max_size=40))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_splitter(path, text):
    words = splitter(read_tokenizer(path))
    got = np.frombuffer(words.encode([text])[0], dtype=f"<u{words.width}").tolist()
    assert got == library_of(path).encode(text, add_special_tokens=False).ids


_LIBRARY = {}


def library_of(path):
    return _LIBRARY.setdefault(path, library(path))


def test_forgetting(monkeypatch):
    words = splitter(read_tokenizer(BYTE))
    monkeypatch.setattr(words, "REMEMBERED", 50)
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join(f"w{rng.randrange(300)}" for _ in range(60))
        assert np.frombuffer(words.encode([text])[0], dtype="<u2").tolist() == library_of(BYTE).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("end", [0, 50256])
def test_token_files(spark, tmp_path, end):
    rows, t = rows_of() + [(None, "null id")], library(BYTE)
    path = str(tmp_path / "ids")
    write_token_files(frame(spark, rows), path, BYTE, end_id=end, partition_bytes=4000)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for i, x in order:
        ids = t.encode(x or "", add_special_tokens=False).ids + [end]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in read_token_index(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    files = sorted(f for f in glob.glob(path + "/part-*") if open(f, "rb").read(1))
    assert len(files) > 2
    joined = np.concatenate([open_token_file(f)[0] for f in files])
    flat = [x for i, text in order for x in t.encode(text or "", add_special_tokens=False).ids + [end]]
    assert joined.tolist() == flat
    assert joined.dtype == (np.uint16 if end == 0 else np.uint32)


def test_empty(spark, tmp_path):
    none = frame(spark, corpus(1)[:2]).filter("false")
    assert encode_documents(none, WORD).count() == 0
    write_token_files(none, str(tmp_path / "none"), BYTE)
    assert read_token_index(spark, str(tmp_path / "none")).count() == 0


def test_repeated_ids(spark, tmp_path):
    rows = [(1, "b b"), (1, "a"), (1, "a"), (0, None)]
    write_token_files(frame(spark, rows), str(tmp_path / "r"), BYTE)
    got = read_token_index(spark, str(tmp_path / "r")).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(0, 0, 1), (1, 1, 2), (1, 3, 2), (1, 5, 3)]
    assert encode_documents(frame(spark, rows), WORD).groupBy("id").agg(F.count("*").alias("n")).orderBy("id").collect()[1]["n"] == 3
