"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from watchkeep.llm import (
    decontamination, gru, lm_scoring, near_dedup, packing, quality_model, quality_rules, sharding, token_counts, toxicity, warc)
from watchkeep.llm.common import prepare

WORDS = [f"w{i}ord" for i in range(400)]
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, row long, id long, score double, _host string, key string"


def prose(seed, n=80):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def rows():
    base = [(i, prose(i), "a") for i in range(30)]
    base += [(30, None, "a"), (31, "", None), (32, "  \n\t", "b"), (33, "one", "b"), (34, prose(3), "b"), (None, prose(77), None)]
    base += [(35, prose(35, 30_000), "a"), (36, "x" * 50_000, "a"), (5, prose(5), "a"), (37, "ÀÉ İx ﬁ 漢字 <|endoftext|> it's", "c")]
    return [(*r, 1, 2, 0.5, "h", "k") for r in base]


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, 1 - i % 2) for i in range(30)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def test_shards_are_filled_to_one_row(docs, none, rows):
    found = sharding.bounded_ring(docs, shards=7).collect()
    sizes = [sum(r["shard"] == s for r in found) for s in range(7)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    assert sharding.bounded_ring(none, shards=7).count() == 0


def test_few_keys_move_when_a_shard_is_added(spark):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    one, two = ({r["doc_id"]: r["shard"] for r in sharding.bounded_ring(many, shards=n).collect()} for n in (10, 11))
    assert sum(one[k] != two[k] for k in one) < 0.5 * len(one)


def test_one_key_in_all_rows_is_dealt_over_shards(spark):
    same = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.bounded_ring(same, shards=10).groupBy("shard").count().collect()
    assert {r["count"] for r in found} == {100}


def test_archives_keep_payloads_with_version_lines(spark):
    magic = "<p>WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n</p>"
    html = [magic, None, "", "same", "same", magic + magic, "é" * 4000, "WARC/1.0\r\n", "same"]
    rows = [(i, f"http://x/\r\n{i}", h, "e") for i, h in enumerate(html)] + [(None, None, "nobody", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    found = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(found) == len(rows)
    for number, _, text, _ in rows:
        data = (text or "").encode()
        assert found[number]["payload_bytes"] == len(data)
        assert found[number]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert [found[i]["record_type"] for i in (3, 4, 8, 1, 2)] == ["revisit", "revisit", "response", "revisit", "response"]
    assert found[3]["refers_to"] == 8 and found[8]["refers_to"] is None and found[1]["refers_to"] == 2
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_token_counts_equal_the_library(docs, none, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    want = sorted((len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, BYTE_BPE).collect()) == want
    assert token_counts.token_counts(none, BYTE_BPE).count() == 0


def test_packing_covers_all_ids(docs, none, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    found = packing.pack(docs, WORD_BPE, 2048).collect()
    want = sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r["length"] for r in found) == want
    ids = np.array(t.encode(rows[37 - 1][1] or "", add_special_tokens=False).ids + [0], "<u4")
    for r in found:
        if r["doc_id"] == rows[36][0]:
            assert zlib.crc32(ids[r["start"]: r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for s in {r["sequence_id"] for r in found}:
        parts = sorted((r["offset"], r["length"]) for r in found if r["sequence_id"] == s)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert packing.pack(none, WORD_BPE).count() == 0


def test_bounds_never_exceed_what_is_needed():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        where, offset, _ = packing.best_fit_decreasing(lengths, 100)
        fills = np.bincount(where, lengths)
        assert fills.max() <= 100
        assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= len(fills)
    assert packing.lower_bound(np.bincount([60] * 5, minlength=101), 100) == 5


def test_quality_measures(docs, none, rows):
    found = quality_rules.line_rules(docs).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[30]["n_words"] == 0 and by[30]["base_failed"] and not by[30]["kept"]
    assert by[35]["n_words"] == 30_000 and by[33]["n_words"] == 1 and by[0]["kept"]
    assert quality_rules.passing(docs).columns == docs.columns
    assert quality_rules.line_rules(none).count() == 0 and quality_rules.passing(none).count() == 0


def test_repeated_windows(spark):
    def brute(text):
        w = text.split()
        windows = [tuple(w[i: i + 8]) for i in range(len(w) - 7)]
        return len({j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)})

    texts = [prose(1, 30) + " " + prose(1, 30), "a " * 50, prose(2, 8), prose(2, 9), (prose(4, 10) + " z ") * 3, prose(6, 60)]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.line_rules(frame).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_frequent_lines_go(spark):
    line = "subscribe to our letter now"
    rows = [(i, f"{line}\n{prose(i, 40)}", "h") for i in range(150)] + [(999, f"{line}\n" * 30 + prose(1000, 25), "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {r["doc_id"]: r for r in quality_rules.line_rules(frame).collect()}
    assert by[3]["kept"] and by[3]["removed_words"] == 5 and not by[999]["kept"]
    clean = {r["doc_id"]: r["text"] for r in quality_rules.without_frequent_lines(frame).collect()}
    assert clean[3] == prose(3, 40) and line not in clean[999]


def shingle_set(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, none, words):
    rng, rows = random.Random(words), []
    for g in range(12):
        base = prose(g, 60).split()
        for _ in range(8):
            own = [x if rng.random() > 0.05 else rng.choice(WORDS) for x in base]
            rows.append((len(rows), " ".join(own)))
    rows += [(500, rows[3][1]), (501, None), (502, ""), (503, "One"), (504, "one"), (None, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingle_set(t, words) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in root):
            break
    found = near_dedup.near_duplicates(frame, words).collect()
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == root
    assert [r["kept"] for r in found if r["doc_id"] is None] == [True]
    assert near_dedup.near_duplicates(none, words).count() == 0


def test_passages_with_edits_are_found(spark, none):
    fold = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    rng, items = random.Random(5), [(i, prose(200 + i, 20)) for i in range(20)] + [(98, None), (None, "x"), (99, "tiny")]
    rows, want = [], set()
    for k in range(60):
        item, text = items[rng.randrange(20)]
        letters = list(fold(text))
        most = int(len(letters) * decontamination.EDIT_SHARE)
        for _ in range(rng.randrange(0, most + 1)):
            letters[rng.randrange(len(letters))] = "q"
        rows.append((k, f"{prose(k, 30)}!  {''.join(letters).upper()} -- {prose(k + 1, 30)}"))
        want.add((k, item))
    rows += [(100, None), (101, ""), (102, prose(9, 20_000))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.leaks(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert {r["doc_id"] for r in decontamination.without_leaks(frame, bench).collect()} == {100, 101, 102}
    assert decontamination.leaks(none, bench).count() == 0 and decontamination.leaks(frame, bench.limit(0)).count() == 0


def test_toxic_words_are_learned(spark, docs, none, labels):
    rows = [(i, prose(i, 60) + (" horridword" if i % 4 == 0 else "")) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    found = [r for r in toxicity.toxicity(frame, known).collect() if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in found) > 0.97 * len(found)
    odd = toxicity.toxicity(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_quality_is_learned_from_passages(spark, docs, none, labels):
    rows = [(i, prose(i, 150) if i % 3 else prose(i, 80) + " ###| " * 60) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    found = [r for r in quality_model.quality(frame, known).collect() if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in found) > 0.97 * len(found)
    odd = quality_model.quality(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_model.quality(none, labels).count() == 0
    assert quality_model.accepted(docs, labels).columns == docs.columns


def test_language_model_scores(docs, none, rows):
    found = lm_scoring.log_scores(docs, known=300, heads=128, rounds=2, share=2).collect()
    assert len(found) == len(rows)
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    train = [w for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2 for w in tokens(r[1])]
    counts = {w: 0 for w in train}
    for w in train:
        counts[w] += 1
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        own = tokens(texts[r["doc_id"]])
        base = sum(math.log10((counts.get(w, 0) + 1) / (len(train) + len(counts) + 1)) for w in own)
        assert r["n_tokens"] == len(own) and r["train_tokens"] == len(train)
        assert r["n_known"] == sum(w in counts for w in own)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lm_scoring.log_scores(none).count() == 0


def test_recurrent_gradients():
    shape, rng = gru.Shape(100, 8, 16), np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.start(shape, rng.integers(1, 50, 100).astype(float), np.ones(8)).items()}
    tokens, fresh = rng.integers(0, 108, (4, 9)), np.zeros((4, 9), bool)
    fresh[:, 0] = fresh[1, 4] = True

    def loss(q):
        cuts = [np.append(np.flatnonzero(row), 9) for row in fresh]
        return -sum(gru.log_likelihood(q, shape, t, c).sum() for t, c in zip(tokens, cuts, strict=True)) / 36

    class Kept:
        def update(self, g):
            self.g = g

    trainer = gru.Trainer(p, shape, 0.01)
    trainer.adam = Kept()
    trainer._window(tokens, fresh, np.zeros((4, gru.HIDDEN)))
    for name in p:
        place = np.unravel_index(int(np.abs(trainer.adam.g[name]).argmax()), p[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][place] += 1e-5
        down[name][place] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - trainer.adam.g[name][place]) < 1e-5
