"""Operators on documents against brute-force versions."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placeweave.llm import (
    chosen_path,
    components,
    histogram_sort,
    line_rules,
    packing,
    quotations,
    toxicity,
)
from placeweave.llm.queries import queries
from placeweave.llm.rows import shingle_set

WORDS = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.01"


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


# -- components ---------------------------------------------------------------------------


def smallest_reachable(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, stage, shape):
    draw = random.Random(4)
    edges = {
        "chain": [(k, k + 1) for k in range(40)] + [(50, 51)],
        "star": [(k, 7) for k in range(200)],
        "random": [(draw.randint(0, 90), draw.randint(0, 90)) for _ in range(60)],
        "none": [],
    }[shape]
    table = spark.createDataFrame(edges + edges[:3], "a long, b long")
    found = components.connected(table, stage).collect()
    linked = [(a, b) for a, b in edges if a != b]
    expected = smallest_reachable({n for e in linked for n in e}, linked)
    assert {r.id: r.component for r in found} == expected


# -- 1 ------------------------------------------------------------------------------------


def check_shards(rows, shards, slack):
    size = Counter()
    for shard, members in itertools.groupby(sorted(rows, key=lambda r: (r.shard, r.slot)), lambda r: r.shard):
        members = list(members)
        assert [m.slot for m in members] == list(range(len(members)))
        assert 0 <= shard < shards
        size[shard] = sum(len((m.text or "").encode()) + 1 for m in members)
    mean = sum(size.values()) / shards
    assert all(abs(size[k] - mean) <= slack for k in range(shards))


def test_shards_have_near_equal_bytes(spark, stage, texts):
    rows = list(texts.items()) + [(None, None), (None, "x"), (5_000, None), (5_001, "")]
    found = histogram_sort.shard(documents(spark, rows), stage, 8).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    check_shards(found, 8, 2 * max(len(t.encode()) for t in texts.values()))
    by_text = {}
    for r in found:
        by_text.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) > 1 for s in by_text.values()) <= 7


def test_a_hot_text_is_parted(spark, stage):
    rows = [(k, "copy " * 50) for k in range(2_000)] + [(k, f"text {k}") for k in range(2_000, 4_000)]
    found = histogram_sort.shard(documents(spark, rows), stage, 4).collect()
    check_shards(found, 4, 600)


def test_shards_of_few_rows(spark, stage):
    same = documents(spark, [(1, "a")] * 20, "")
    assert Counter(r.slot for r in histogram_sort.shard(same, stage, 3).collect()).most_common(1)[0][1] <= 3
    extra = same.withColumns({"shard": F.lit("x"), "size": F.lit(9)}).limit(1)
    (row,) = histogram_sort.shard(extra, stage, 3).collect()
    assert row.slot == 0 and row["size"] == 9
    assert not histogram_sort.shard(same.limit(0), stage, 3).collect()


def test_shard_query(spark, texts):
    rows = queries()["op1_histogram_sort"](spark, FOLDER).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {
        (k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts.items()
    }
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


# -- 2 ------------------------------------------------------------------------------------


def labelled(spark, count):
    draw, rows, labels = random.Random(9), [], []
    for k in range(count):
        words = ["".join(draw.choices("abcdeilnorst", k=draw.randint(2, 7))) for _ in range(60)]
        toxic = draw.random() < 0.3
        if toxic:
            words[draw.randrange(60)] = words[draw.randrange(60)] = draw.choice(["vermin!", "Scumbag"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, stage):
    docs, labels = labelled(spark, 1_500)
    model = toxicity.train(docs, labels, stage)
    scored = toxicity.score(docs, model).join(labels, "doc_id")
    held = scored.filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert {r.doc_id for r in held} == {k for k in range(1_500) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)


def plain_buckets(text):
    text, found = f" {' '.join(text.lower().split())} ", set()
    for n in (3, 4, 5):
        for k in range(len(text) - n + 1):
            number = 0
            for sign in text[k : k + n]:
                number = (number * 0x01000193 + ord(sign)) % 2**32
            number = (number ^ number >> 15) * (0x85EBCA6B + 2 * n) % 2**32
            found.add(number >> 14)
    return found


def plain_scores(rows, marks, n_features):
    """Ratios, choice of features and regression over a table of all features."""
    learned = [k for k in marks if zlib.crc32(str(k).encode()) % 5]
    grams = {k: plain_buckets(rows[k]) for k in rows}
    n_toxic = sum(marks[k] for k in learned)
    n_other = len(learned) - n_toxic
    toxic = Counter(b for k in learned if marks[k] for b in grams[k])
    other = Counter(b for k in learned if not marks[k] for b in grams[k])

    def clear(b):
        share = (toxic[b] + other[b]) / len(learned)
        return abs(toxic[b] / n_toxic - other[b] / n_other) / math.sqrt(share * (1 - share) + 1e-4)

    features = sorted(sorted(toxic | other, key=lambda b: (-clear(b), b))[:n_features])
    ratio = [math.log((toxic[b] + 1) / (n_toxic + 2) * (n_other + 2) / (other[b] + 1)) for b in features]
    table = {k: np.array([r * (b in grams[k]) for b, r in zip(features, ratio)]) for k in rows}
    x = np.array([[*table[k], 1.0] for k in learned])
    y = np.array([marks[k] for k in learned])
    share = (n_toxic + 0.5) / (len(learned) + 2)
    theta = np.zeros(len(features) + 1)
    theta[-1] = math.log(share / (1 - share))
    slope, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, toxicity.FIT_STEPS + 1):
        down = x.T @ (1 / (1 + np.exp(-x @ theta)) - y) / len(y)
        down[:-1] += toxicity.PENALTY / len(y) * theta[:-1]
        slope, square = 0.9 * slope + 0.1 * down, 0.999 * square + 0.001 * down**2
        size = np.sqrt(square / (1 - 0.999**step)) + 1e-8
        theta = theta - toxicity.STEP * slope / (1 - 0.9**step) / size
    return {k: 1 / (1 + math.exp(-(table[k] @ theta[:-1] + theta[-1]))) for k in rows}


def test_scores_equal_those_of_a_plain_model(spark, stage, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 150)
    docs, labels = labelled(spark, 300)
    rows = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    expected = plain_scores(rows, marks, 150)
    found = toxicity.score(docs, toxicity.train(docs, labels, stage)).collect()
    assert {r.doc_id: r.score for r in found} == pytest.approx(expected, abs=1e-4)
    assert all(r.predicted == (r.score >= 0.5) for r in found)


def test_held_out_labels_teach_nothing(spark, stage):
    docs, labels = labelled(spark, 300)
    other = labels.withColumn(
        "toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    one, two = toxicity.train(docs, labels, stage), toxicity.train(docs, other, stage)
    assert np.array_equal(one.weights, two.weights) and one.constant == two.constant


def test_toxicity_of_odd_rows(spark, stage):
    docs, labels = labelled(spark, 200)
    labels = labels.union(spark.createDataFrame([(None, 1), (3, None), (4, 1), (4, 0)], labels.schema))
    model = toxicity.train(docs, labels, stage)
    odd = documents(spark, [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "a" * 200_000, "x")], ", score string")
    found = toxicity.score(odd, model).collect()
    assert len(found) == 4 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if not r.text}) == 1
    nothing = toxicity.train(docs, labels.limit(0), stage)
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}
    assert not toxicity.score(docs.limit(0), model).collect()


# -- 3 ------------------------------------------------------------------------------------


def test_quotations(spark, stage):
    rows = [
        (1, 0, "user", "First line\nsecond line"),
        (1, 1, "assistant", "> first   LINE\nanswer"),
        (1, 2, "user", ">> first line\n> answer\n\nthanks"),
        (1, 3, None, "> nothing like this\nhm"),
        (2, 0, "user", "> answer\nfrom elsewhere"),
        (2, 1, "user", None),
        (None, 1, "user", "> answer\nlost"),
        (3, None, "user", ""),
        (4, 0, "user", "second line"),
        (4, 1, "user", "> second line\nhere first"),
    ]
    kind = "conv_id long, turn long, role string, text string"
    found = quotations.link_quotations(spark.createDataFrame(rows, kind), stage).collect()
    seen = {(r.conv_id, r.turn): r for r in found}
    assert len(found) == len(rows)
    replies = {k: (r.reply_conv_id, r.reply_turn) for k, r in seen.items() if r.reply_turn is not None}
    assert replies == {(1, 1): (1, 0), (1, 2): (1, 1), (2, 0): (1, 1), (4, 1): (4, 0)}
    assert seen[1, 2].message == "<|user|>\nthanks" and seen[1, 3].message == "<|unknown|>\nhm"
    assert (seen[1, 2].depth, seen[1, 2].thread_turn, seen[1, 2].n_quoted, seen[1, 2].n_linked) == (2, 0, 2, 2)
    assert (seen[1, 3].depth, seen[1, 3].n_quoted, seen[1, 3].n_linked) == (0, 1, 0)
    assert (seen[2, 0].thread_conv_id, seen[2, 0].depth) == (1, 2)
    order = {(r.conv_id, r.turn): k for k, r in enumerate(found)}
    assert all(order[child] > order[parent] for child, parent in replies.items())
    assert not quotations.link_quotations(spark.createDataFrame([], kind), stage).collect()


def test_quotations_of_odd_messages(spark, stage):
    deep, wide = ">" * 100_000 + " far down", "x" + " " * 200_000 + "y  \n"
    rows = [
        (1, 0, "user", "asked", "a"),
        (1, 1, "user", deep, "a"),
        (1, 2, "user", wide, None),
        (1, 3, "user", "> asked\nfirst part", "b"),
        (1, 3, "user", "second part", "b"),
        (1, 4, "user", "> second   part\n" + wide, "b"),
        (1, 5, "user", "> asked\nother branch", "b"),
    ]
    kind = "conv_id long, turn long, role string, text string, depth string"
    found = quotations.link_quotations(spark.createDataFrame(rows, kind), stage).collect()
    assert len(found) == len(rows)
    seen = {(r.turn, r.message): r for r in found}
    assert seen[1, "<|user|>\n"].n_quoted == 1
    assert seen[2, "<|user|>\n" + wide.strip()].depth == 0
    # Two rows of one message hold the lines of both.
    assert {(r.reply_turn, r.depth) for r in found if r.turn == 3} == {(0, 1)}
    assert seen[4, "<|user|>\n" + wide.strip()].reply_turn == 3
    assert seen[5, "<|user|>\nother branch"].thread_turn == 0


def test_a_passage_that_very_many_quote(spark, stage):
    rows = [(0, 0, "user", "said once")] + [(k, 1, "user", "> said once\nyes") for k in range(1, 3_000)]
    kind = "conv_id long, turn long, role string, text string"
    found = quotations.link_quotations(spark.createDataFrame(rows, kind), stage)
    assert found.filter("reply_conv_id = 0 AND reply_turn = 0 AND depth = 1").count() == 2_999


def test_quotation_query_finds_what_was_quoted(spark):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    original = {(t.conv_id, t.turn): t for t in turns}
    for r in queries()["op3_quotation_linking"](spark, FOLDER).collect():
        t = original[r.conv_id, r.turn]
        parent = t.turn - (2 if t.turn % 3 == 2 else 1)
        expected = (t.conv_id, parent) if (t.conv_id, parent) in original else (None, None)
        assert (r.reply_conv_id, r.reply_turn) == expected
        assert r.message == f"<|{t.role}|>\n{t.text.strip()}" and r.n_quoted == r.n_linked


# -- 4 ------------------------------------------------------------------------------------


def plain_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    again = {k + i for k, w in enumerate(windows) if windows.count(w) > 1 for i in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(line in lines[:k] for k, line in enumerate(lines)),
        len(again),
        len(words) < 10 or 100 * len(again) > 20 * len(words),
    )


def test_line_figures(spark, texts):
    odd = ["", None, "a b c d e a b c d e\x0b\x0c f", "x \n\nx \n y z\ny", "1 2 3 4 5 " * 9]
    rows = list(enumerate(odd)) + [(k, t) for k, t in texts.items() if len(t) < 4_000][:300]
    for r in line_rules.clean_lines(documents(spark, rows)).collect():
        assert tuple(r)[2:8] == plain_figures(r.text)
        assert not (r.kept and r.base_failed)


def test_line_rules(spark):
    good = [" ".join(f"{w}{k}" for w in "these are words that nobody would remove".split()) for k in range(12)]
    bad = ["Home | News | About | Contact", "x$$$ y### z*** a&&& b%%%", "All Rights Reserved", "ha " * 15]
    text = "\n".join([*good, bad[0], "", *bad[1:]])
    junk = "\n".join([good[0], *bad[:3], *bad[:3]])
    docs = documents(spark, [(1, text, "x"), (2, junk, "x"), (3, None, "x")], ", kept string")
    found = {r.doc_id: r for r in line_rules.clean_lines(docs).collect()}
    assert found[1].clean_text == "\n".join([*good, ""]) and found[1].n_lines_removed == 4
    assert [found[k].kept for k in (1, 2, 3)] == [True, False, False]
    assert not line_rules.clean_lines(docs.limit(0)).collect()


def test_long_lines_are_judged_by_share_and_not_by_length(spark):
    draw = random.Random(5)
    prose = draw.choices([f"word{k}" for k in range(15_000)], k=60_000)
    passage = draw.choices([f"word{k}" for k in range(900)], k=900)
    lines = {
        1: " ".join(prose),
        2: " ".join([*prose[:400], "see our privacy policy", *prose[400:600]]),
        3: " ".join(draw.choices(prose[:100], k=5_000)),
        4: " ".join(passage * 6),
        5: " ".join([*prose[:20], "All rights reserved. Privacy policy."]),
    }
    found = {r.doc_id: r for r in line_rules.clean_lines(documents(spark, list(lines.items()))).collect()}
    assert [found[k].n_lines_removed for k in lines] == [0, 0, 1, 1, 1]
    assert all(found[k].kept and found[k].clean_text == lines[k] for k in (1, 2))
    assert not any(found[k].kept for k in (3, 4, 5))


# -- 5 ------------------------------------------------------------------------------------


def fewest_bins(lengths, capacity):
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[k]}):
            rest = list(rooms)
            rest.remove(room)
            place(k + 1, [*rest, room - lengths[k]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_bounds_hold_and_packings_fit():
    draw = random.Random(2)
    for _ in range(150):
        capacity = draw.choice([1, 2, 7, 10, 30])
        lengths = sorted(draw.choices(range(1, capacity + 1), k=draw.randint(1, 8)), reverse=True)
        bins, offsets, used = packing.best_fit_decreasing(np.array(lengths), capacity)
        assert packing.lower_bound(np.array(lengths), capacity) <= fewest_bins(lengths, capacity) <= len(used)
        assert max(used) <= capacity
        for b in range(len(used)):
            at = 0
            for k in np.flatnonzero(bins == b):
                assert offsets[k] == at
                at += lengths[k]


def check_packing(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark, texts):
    rows = queries()["op5_best_fit_packing"](spark, FOLDER).collect()
    library, total = Tokenizer.from_file(WORDS), 0
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.piece):
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        for piece, r in enumerate(by_doc.pop(doc_id)):
            part = ids[4096 * piece : 4096 * (piece + 1)]
            assert (r.piece, r.start, r.length) == (piece, 4096 * piece, len(part))
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
    assert not by_doc
    assert check_packing(rows, 4096) == -(-total // 4096)


def test_partitions_with_gaps_pack_again(spark, stage, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 60)
    draw = random.Random(8)
    lengths = [draw.randint(1, 700) for _ in range(1_000)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    found = packing.pack(pieces, stage, 1_000).join(pieces, "row").collect()
    assert sorted(r.row for r in found) == list(range(1_000))
    bound = packing.lower_bound(np.array(lengths), 1_000)
    assert check_packing(found, 1_000) <= 1.02 * bound


def test_one_partition_packs_again_up_to_the_bound(spark, stage):
    draw = random.Random(5)
    lengths = [draw.randint(10, 50) for _ in range(40)]
    ordered = np.array(sorted(lengths, reverse=True))
    bound = packing.lower_bound(ordered, 100)
    assert len(packing.best_fit_decreasing(ordered, 100)[2]) > bound
    pieces = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    places = packing.pack(pieces, stage, 100)
    found = places.join(pieces, "row").collect()
    assert sorted(r.row for r in found) == list(range(40))
    assert check_packing(found, 100) == bound and packing.is_certified(pieces, places, 100)
    alone = spark.createDataFrame([(k, k, 0) for k in range(40)], places.schema)
    assert not packing.is_certified(pieces, alone, 100)


def test_packing_of_odd_rows(spark, stage):
    docs = documents(spark, [(None, None, 1), (1, "", 1), (1, "", 1), (2, "a b " * 5_000, 1)], ", row int")
    packed = packing.pack_documents(docs, stage, WORDS, 64)
    rows = packed.pieces.join(packed.places, "row").collect()
    assert sorted(r.length for r in rows if r.doc_id != 2) == [1, 1, 1]
    assert sum(r.length for r in rows if r.doc_id == 2) == 10_001
    assert check_packing(rows, 64) == -(-10_004 // 64)
    assert not packing.pack_documents(docs.limit(0), stage, WORDS).places.collect()


# -- 10 -----------------------------------------------------------------------------------


def classes_by_brute_force(texts, width):
    sets = {k: shingle_set(t, width) for k, t in texts.items() if k is not None}
    holders = {}
    for k, s in sets.items():
        for h in s.tolist():
            holders.setdefault(h, []).append(k)
    shared = Counter(p for ks in holders.values() for p in itertools.combinations(sorted(ks), 2))
    links = [
        (a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)
    ]
    return {k: len(s) for k, s in sets.items()}, smallest_reachable(sets, links)


def test_shingles_are_those_of_the_words():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choices("aB é\t\n\x0b ", k=draw.randint(0, 40)))
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        expected = {tuple(words[k : k + 2]) for k in range(max(1, len(words) - 1))} if words else set()
        assert len(shingle_set(text, 2)) == len(expected)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, stage, width):
    draw, rows = random.Random(6), []
    for group in range(25):
        words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(draw.choice([1, 3, 30, 200]))]
        for _ in range(draw.choice([1, 2, 6, 40])):
            copy = [w if draw.random() > 0.03 else "other" for w in words]
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n"), (len(rows) + 3, "one")]
    draw.shuffle(rows)
    docs = documents(spark, rows + [rows[0], (None, "one"), (None, None)])
    found = chosen_path.near_duplicates(docs, stage, width).collect()
    assert len(found) == len(rows) + 3
    n, expected = classes_by_brute_force(dict(rows), width)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (n[r.doc_id], expected[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)


def test_large_nodes_branch_and_tile(spark, stage, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL_NODE", 4)
    monkeypatch.setattr(chosen_path, "TILE", 8)
    draw = random.Random(7)
    base = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(100)]
    texts = {k: " ".join(w if draw.random() > 0.06 else f"x{k}" for w in base) for k in range(120)}
    found = chosen_path.near_duplicates(documents(spark, list(texts.items())), stage, 2).collect()
    assert {r.doc_id: r.component_id for r in found} == classes_by_brute_force(texts, 2)[1]


def test_trees_miss_few_pairs_at_the_last_level(spark):
    draw, pairs = np.random.default_rng(8), 4_000
    width = chosen_path.TREES * chosen_path.LEVELS * 2
    left, right = draw.integers(0, 2**62, (2, pairs, width))
    right = np.where(draw.random((pairs, width)) < 0.8, left, right)
    rows = [(2 * k + side, 1, v.tolist()) for side, part in enumerate((left, right)) for k, v in enumerate(part)]
    sets = spark.createDataFrame(rows, "id long, n long, coordinates array<long>")
    nodes = chosen_path._branches_of_roots(sets)
    for level in range(1, chosen_path.LEVELS):
        nodes = chosen_path._branch(nodes, sets, level)
    pair = F.floor(F.col("id") / 2).alias("pair")
    met = nodes.groupBy("tree", "node", pair).agg(F.count_distinct("id").alias("sides")).filter("sides = 2")
    met = met.groupBy("tree").agg(F.count_distinct("pair").alias("n")).collect()
    assert len(met) == chosen_path.TREES
    assert math.prod(1 - r.n / pairs for r in met) < 1e-4


def test_sketches_do_not_lose_long_texts(spark, stage):
    # 4,000 of 5,000 words are shared, which the sketches of this pair put at 0.711.
    words = [f"s1149w{k}" for k in range(5_000)]
    texts = {1: " ".join(words[:4_500]), 2: " ".join(words[500:])}
    found = chosen_path.near_duplicates(documents(spark, list(texts.items())), stage, 1).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1}


def test_no_documents(spark, stage):
    assert not chosen_path.near_duplicates(documents(spark, []), stage).collect()


def test_a_doc_id_that_repeats_with_other_texts(spark, stage):
    text = "one two three four five six seven eight nine ten " * 3
    near = text + "eleven"
    for other in (None, "", "  ", "quite another text with many words of its own"):
        rows = [(1, text), (2, near), (1, other), (2, other), (3, "alone in this table of texts")]
        found = chosen_path.near_duplicates(documents(spark, rows), stage, 2, 80).collect()
        assert Counter(r.doc_id for r in found) == Counter(k for k, _ in rows)
        assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1), (3, 3)}
