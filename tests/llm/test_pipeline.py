from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts, start = docs.columns, [], docs
    from lanternq.llm.common import written

    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != "shard":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "decontamination", "mix", "shard"]
    assert start.count() >= counts[0] >= counts[1] >= counts[2] and counts[3] == counts[4]
    again = corpus_pipeline.run(spark, sf)
    order = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, again.select(order).collect())) == sorted(map(tuple, docs.select(order).collect()))


def test_near_duplicates_are_complete(spark):
    """Every pair of 5-word-shingle Jaccard 0.8 or more ends in one component, and no other pair is linked."""
    import random

    rng = random.Random(3)
    rows = [(0, "a short one"), (1, "A  short one"), (2, "a short two"), (3, ""), (4, None)]
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200]))] + ["the", "same", "end", "of", "every", "page"]
        for copy in range(6):
            new = list(words)
            for _ in range(copy * len(words) // 120 + (copy == 5)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(new)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    kept = sorted(r["doc_id"] for r in corpus_pipeline.dedup(spark, docs, "").collect())
    assert kept == sorted(set(root)) and 20 < len(kept) < len(rows) - 20
    assert corpus_pipeline.dedup(spark, docs.limit(0), "").count() == 0
