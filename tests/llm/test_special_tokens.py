"""Token ids of op2 and op7 where a text holds the vocabulary's special tokens, against the library's plain encode."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from annotara.llm import packing, token_files, word_ids

PATH = P.path("word_bpe_49k.json")
START, END = "<|startoftext|>", "<|endoftext|>"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def texts():
    rng = random.Random(4)
    parts = [START, END, "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", " ", "\n", "Hello", "it's", "é", "İ", "日本", "x1", ".", "́", "a" * 90]
    own = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    return [*own, END, START + END, f"tok{END}en", f"hello {END} world", ("word " * 60_000 + END) * 2, END * 50_000, None, ""]


def test_plain_ids_equal_the_library(plain):
    coder = word_ids.word_ids(PATH, literal=False)
    got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode([None if t is None else t.encode() for t in texts()])]
    assert got == [plain(t) for t in texts()]


def test_literal_ids_are_ordinary_text():
    ids = np.frombuffer(word_ids.word_ids(PATH).encode([f"a {END} b".encode()])[0], "<u4")
    assert len(ids) > 3 and 49407 not in ids


def test_queries_encode_as_the_contract_says(spark, plain):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start long")
    ids = {i: np.array(plain(t), "<u4") for i, t, *_ in rows}
    got = {r.doc_id: r for r in token_files.query(docs, PATH, literal=False).collect()}
    start = 0
    for i, own in ids.items():
        whole = np.append(own, 2).astype("<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)
    for r in packing.pack(docs, PATH, literal=False).collect():
        whole = np.append(ids[r.doc_id], 1).astype("<u4")
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())


def test_rows_of_one_id_are_dealt_to_many_tasks(spark, plain, tmp_path):
    rows = [(7, f"{i * 7919 % 1000:03d} word") for i in range(1000)] + [(1, "a"), (9, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in token_files.query(docs, PATH, literal=False).orderBy("start").collect()]
    start = 0
    for (i, t), r in zip(sorted(rows), got, strict=True):
        own = np.append(plain(t), 2).astype("<u4")
        assert r == (i, start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows become one task again
    try:
        token_files.write_tokens(docs, f"file://{tmp_path}/t", PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(f"file://{tmp_path}/t").groupBy("_metadata.file_name").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 900
