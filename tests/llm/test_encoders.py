"""Encoders and their files against the public libraries."""

import base64
import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placeweave.llm import arrow_files, byte_bpe, edit_counts
from placeweave.llm.tokens import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "",
    "  ",
    "a  b",
    "a \n b\r\n\tc ",
    "x\x1cy \x1d z",
    "don't 's it's'll  'S",
    "0123 456,78 a0b",
    "日本語 テキスト ok",
    "\x85\x85 a b​c",
    "é́ ́n",
    "<|endoftext|> <|startoftext|>x",
    "z" * 3000,
    " " * 300 + "x",
    "İstanbul ΣΑΣ Straße",
]


def odd_texts():
    draw = random.Random(5)
    signs = "ab '\n\t.19é日\x1c \xa0sS"
    return ODD + ["".join(draw.choices(signs, k=draw.randint(0, 60))) for _ in range(1500)]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def numbers(found: bytes) -> list[int]:
    return np.frombuffer(found, "<u4").tolist()


@pytest.mark.parametrize("remembered", [50, 100_000])
def test_word_encoder_equals_library(remembered):
    own, library = WordEncoder(WORDS, remembered), Tokenizer.from_file(WORDS)
    texts = odd_texts()
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        expected = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert list(map(numbers, own.encode(part))) == expected


def test_word_encoder_cuts_long_texts(monkeypatch):
    own, library = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    monkeypatch.setattr(own, "BLOCK", 40)
    texts = ["", "short one", "a longer text, that\tis cut\nwhere it's white  " * 9, "x" * 90 + " y", " ", "end"]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(map(numbers, own.encode(texts))) == expected


def test_byte_encoder_equals_library(library):
    own, texts = byte_bpe.ByteEncoder(RANKS), odd_texts()
    found = list(map(numbers, own.encode(texts)))
    assert found == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(ids) for ids in found] == [t.encode() for t in texts]


def test_long_piece_merges_as_short_ones_do(library):
    pieces = ["".join(random.Random(k).choices("abenth", k=600)) for k in range(3)]
    ranks = byte_bpe.Ranks(RANKS)
    ids, ends = ranks.merge([p.encode() for p in pieces])
    found = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert found == [library.encode_ordinary(p) for p in pieces]
    together = ranks._merge_alike([p.encode() for p in pieces], 1024)
    assert [row[row >= 0].tolist() for row in together] == found


def test_bpe_columns(spark, library):
    rows = [(k, t, "kept") for k, t in enumerate(ODD)] + [(None, None, "kept"), (3, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()
    assert {(r.doc_id, r.text, tuple(r.ids), bytes(r.decoded)) for r in found} == {
        (k, t, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for k, t, _ in rows
    }
    assert not byte_bpe.encode(docs.limit(0), RANKS).collect()


def test_tree_follows_edits(library):
    counter, draw = edit_counts.PieceCounter(RANKS), random.Random(3)
    signs = "ab '\n\t.19é日\x1c \xa0sStelrvm"

    def text(most):
        return "".join(draw.choices(signs, k=draw.randint(0, most)))

    for trial in range(300):
        start = text(3000 if trial % 20 == 0 else 60)
        tree = edit_counts.Tree(start, counter.count(start), counter)
        for _ in range(5):
            place = draw.randint(-1, len(tree.text) + 1)
            tree.edit(place, place + draw.choice([0, 2, 300]), text(draw.choice([0, 3, 200])))
            assert tree.leaf_rows().tolist() == counter.count(tree.text).tolist()
            assert tree.block_sizes().sum() == len(tree.leaf_rows())
            level = tree.sums[1 : tree.leaves]
            assert (level == tree.sums[2 : 2 * tree.leaves].reshape(-1, 2, 2).sum(1)).all()
            assert tree.n_tokens == len(library.encode_ordinary(tree.text))


def test_edit_encodes_only_its_surroundings():
    counter = edit_counts.PieceCounter(RANKS)
    text = "some words here and there " * 5000
    tree = edit_counts.Tree(text, counter.count(text), counter)
    tree.edit(60_000, 60_003, "new")
    assert tree.encoded < 50


def test_edit_of_a_long_text_changes_few_sums():
    counter = edit_counts.PieceCounter(RANKS)
    text = "some words here and there " * 40_000
    tree = edit_counts.Tree(text, counter.count(text), counter)
    assert tree.leaves == 4_096
    for k in range(1, 6):
        tree.edit(200_000 * k, 200_000 * k + 3, "new")
    # Two paths from a block to the root at most.
    assert tree.touched <= 5 * 2 * 13 and tree.encoded < 250
    assert tree.n_tokens == counter.count(tree.text)[:, 1].sum()


def test_trees_of_a_batch_are_those_of_each_document():
    draw = np.random.default_rng(6)
    n = np.array([0, 1, 64, 65, 0, 128, 129, 1_000, 0, 63, 4_097])
    pairs = draw.integers(1, 9, (n.sum(), 2))
    together, ends = edit_counts.new_trees(pairs, n), np.cumsum([0, *n])
    for k, (start, end) in enumerate(zip(ends, ends[1:])):
        tree = edit_counts.Tree("", pairs[start:end], None)
        parts = [*tree.leaf_rows().T, tree.block_sizes(), *tree.sums.T]
        assert [c[k].as_py() for c in together] == [p.tolist() for p in parts]
    assert [len(c) for c in edit_counts.new_trees(pairs[:0], n[:0])] == [0] * 5


def test_edits_go_on_from_stored_trees(spark, library):
    edits = "edits array<struct<start: int, end: int, new: string>>"
    texts = {1: "a few words " * 300, 2: "", 3: "x"}
    clash = {"lengths": "none", "counts": 1, "char_sums": "no", "n_edits": 7, "block_sizes": None}
    kind = f"doc_id long, text string, {edits}, lengths string, counts int, char_sums string, n_edits int, block_sizes string, other int"
    rows = [(k, t, [(5, 9, "or many"), (700, 1_500, "")], *clash.values(), k) for k, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[0]], kind)
    counted = edit_counts.count(docs, RANKS)
    once = edit_counts.apply_edits(counted, RANKS)
    again = F.array(F.struct(F.lit(3).alias("start"), F.lit(40).alias("end"), F.lit(" é").alias("new")))
    twice = edit_counts.apply_edits(once.withColumn("edits", again), RANKS).collect()
    assert sorted(r.other for r in twice) == [1, 1, 2, 3]
    for r in twice:
        text = texts[r.doc_id]
        for start, end, new in [(5, 9, "or many"), (700, 1_500, ""), (3, 40, " é")]:
            text = text[:start] + new + text[end:]
        assert (r.text, r.n_tokens, r.n_edits) == (text, len(library.encode_ordinary(text)), 1)
        assert r.token_sums[1] == sum(r.counts) and sum(r.block_sizes) == len(r.counts)
    nothing = edit_counts.apply_edits(edit_counts.count(docs.limit(0), RANKS), RANKS)
    assert nothing.columns == once.columns and not nothing.collect()


def test_edit_counts_columns(spark, library):
    edits = [(0, 2, "x y"), (5, 5, None), None, (1_000, 2_000, " end")]
    rows = [(1, "a b c d e f", edits), (2, None, edits), (3, "z", None), (None, "", [])]
    kind = "doc_id long, text string, edits array<struct<start: int, end: int, new: string>>"
    docs = spark.createDataFrame(rows, kind)
    found = edit_counts.apply_edits(edit_counts.count(docs, RANKS), RANKS).collect()
    by_id = {r.doc_id: r for r in found}
    texts = {1: "x yb c d e f end", 2: "x y end", 3: "z", None: ""}
    assert {k: r.text for k, r in by_id.items()} == texts
    for k, r in by_id.items():
        assert r.n_tokens == len(library.encode_ordinary(texts[k])) == sum(r.counts)
        assert sum(r.lengths) == len(texts[k])
    assert [by_id[k].n_edits for k in (1, 2, 3, None)] == [2, 2, 0, 0]
    assert by_id[1].n_tokens_before == len(library.encode_ordinary("a b c d e f"))


@pytest.mark.parametrize("length", [4, 1024])
def test_files_give_the_ids_back(spark, stage, length):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files = arrow_files.write(docs, stage, WORDS, length)
    found = sorted(arrow_files.read(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    start, library = 0, Tokenizer.from_file(WORDS)
    for r in found:
        assert (r.start, 4 * r.n_tokens) == (start, len(r.ids))
        start += r.n_tokens
    expected = [library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    assert sorted(numbers(bytes(r.ids)) for r in found) == sorted(expected)
    for file in files.collect():
        sequences = arrow_files.Sequences(file.ids_file)
        count = -(-file.n_ids // length)
        masks = [sequences.sequence(k)[1] for k in range(count)]
        assert sum(m.true_count for m in masks) == file.n_ids
        assert masks[0].buffers()[1].address == sequences.masks[0].buffers()[1].address
        assert all(len(m) == length for m in masks)
        assert np.shares_memory(sequences.sequence(0)[0], sequences.flat[0])


def test_no_files_for_no_rows(spark, stage):
    files = arrow_files.write(spark.createDataFrame([], "doc_id long, text string"), stage, WORDS)
    assert not files.collect() and not arrow_files.read(files).collect()


def test_queries_on_whole_table(spark, library):
    from placeweave.llm.queries import derived_edits, queries

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    encoded = {r.doc_id: r for r in queries()["op7_byte_bpe"](spark, folder).collect()}
    written = {r.doc_id: r for r in queries()["op6_arrow_files"](spark, folder).collect()}
    counted = {r.doc_id: r for r in queries()["op9_edit_counts"](spark, folder).collect()}
    edited = {}
    for r in derived_edits(spark.read.parquet(f"{folder}/documents.parquet")).collect():
        text = r.text or ""
        for edit in r.edits:
            text = text[: edit.start] + edit.new + text[max(edit.start, edit.end) :]
        edited[r.doc_id] = text
    words, start = Tokenizer.from_file(WORDS), 0
    for doc_id, text in sorted((r.doc_id, r.text or "") for r in docs):
        ids = library.encode_ordinary(text)
        row = encoded[doc_id]
        assert row.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256(text.encode()).hexdigest()
        assert row.n_tokens == counted[doc_id].n_tokens_before == len(ids)
        assert counted[doc_id].n_tokens == len(library.encode_ordinary(edited[doc_id]))
        assert counted[doc_id].text_sha256 == sha256(edited[doc_id].encode()).hexdigest()
        ids = np.array(words.encode(text, add_special_tokens=False).ids + [2], "<u4")
        digest = zlib.crc32(ids.tobytes())
        assert tuple(written[doc_id])[1:] == (start, len(ids), digest)
        start += len(ids)
