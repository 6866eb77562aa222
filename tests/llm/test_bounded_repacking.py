"""Pieces that are dealt anew stay in groups of a bounded size."""

import random

import public_tokenizers

from watchkeep.llm import packing
from watchkeep.llm.common import prepare


def test_repacking_groups_stay_bounded(spark, monkeypatch):
    dealt, pack = [], packing._pack

    def counted(rows, parts, capacity, step):
        dealt.append((rows.count(), parts))
        return pack(rows, parts, capacity, step)

    monkeypatch.setattr(packing, "PART_ROWS", 40)
    monkeypatch.setattr(packing, "_pack", counted)
    rng, capacity = random.Random(5), 100
    # Three of these never fit in a sequence and two leave room, so most partitions keep a gap.
    rows = [(i, " ".join(["the"] * rng.randint(24, 47))) for i in range(640)]
    prepare(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity).collect()
    assert len(dealt) > 1, dealt
    assert all(parts >= -(-count // 40) for count, parts in dealt), dealt
    assert sorted(r["doc_id"] for r in found) == list(range(640))
    used = {}
    for r in found:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= capacity
