"""Operators of lanternq.llm against brute force, round trips and planted cases on small tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lanternq.llm import chat, classifier, decontaminate, mixing, quality_rules, sharding, simhash, tokens, url_filter
from lanternq.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_ string, b_ int"


def docs_of(spark, rows):
    """Rows of (doc_id, text, source) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, None, s, None, "x", 1) for i, t, s in rows], DOCS)


def awkward(spark):
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, "a null id", "b"), (5, long, "b"), (6, "same text here now", "b"), (6, "same text here now", "b"), (7, "same text here now", None), (8, "é ü 中文 \u00a0x", "c"), (9, "a\x0bb\x0cc\rd", "c")]
    return docs_of(spark, rows), rows


def words(text):
    return WORD.findall(text or "")


def brute_rules(text):
    text = text or ""
    w = words(text)
    seen = collections.defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    repeat = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), n < 50 or 100 * len(repeat) > 50 * n)


def test_rules_match_brute_force(spark):
    d, rows = awkward(spark)
    rng = random.Random(3)
    more = [(100 + k, "\n".join(" ".join(rng.choice("a b c d# e|") for _ in range(rng.randrange(0, 9))) for _ in range(12)), "z") for k in range(40)]
    d = d.unionByName(docs_of(spark, more))
    got = sorted(((r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in quality_rules.quality_report(d).collect()), key=str)
    assert got == sorted(((i, *brute_rules(t)) for i, t, _ in [*rows, *more]), key=str)
    assert all(not r["kept"] for r in quality_rules.quality_report(d).where("base_failed").collect())


def test_rule_order_does_not_change_the_verdict(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["word", "other", "x", "THING", "$$", "bye!"]) + str(rng.randrange(60)) for _ in range(80)), "s") for k in range(30)]
    stats = quality_rules.with_statistics(docs_of(spark, rows))
    verdicts = {tuple(r[0] is None for r in stats.orderBy("doc_id").select(quality_rules.first_rejection(list(o))).collect()) for o in itertools.islice(itertools.permutations(quality_rules.RULES), 0, 720, 180)}
    assert len(verdicts) == 1


def test_cascade_orders_by_what_is_left_per_cost():
    r = quality_rules.RULES
    e = [quality_rules.Estimate(r[k], cost, 0.5) for k, cost in enumerate((1.0, 0.25, 1.0, 1.0))]
    # The first rule rejects most, but nearly all of that is rejected by the second, which is cheap.
    outcomes = {(True, True, False, False): 40, (True, False, False, False): 5, (False, False, True, False): 10, (False, False, False, False): 45}
    assert quality_rules.ordered(e, outcomes) == [r[1], r[2], r[0], r[3]]


def test_lazy_cascade_gives_the_verdict_of_the_report(spark):
    d, rows = awkward(spark)
    rng = random.Random(8)
    more = [(100 + k, "\n".join(" ".join(rng.choice(["word", "b", "c d", "d#!", "E", "f$$", "xylophone", str(rng.randrange(99))]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))), "z") for k in range(60)]
    more += [(200 + k, " ".join(f"plain{j}{k}" for j in range(60)), "z") for k in range(9)]
    d = d.unionByName(docs_of(spark, more))
    report = sorted((str(r["doc_id"]) for r in quality_rules.quality_report(d).where("kept").collect()))
    for order in (None, [*reversed((*quality_rules.BASE, *quality_rules.RULES))]):
        if order is None:
            kept = quality_rules.keep_good(d)
        else:
            kept = quality_rules.with_rejection(d.select(F.struct(*d.columns).alias("row_"), "text"), order).where("rejected_by IS NULL").select("row_.*")
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == report and kept.columns == d.columns
    assert 5 < len(report) < len(more)


def test_keep_good_passes_columns_through(spark):
    good = " ".join(f"plain{k}" for k in range(70))
    d = docs_of(spark, [(1, good, "a"), (2, "short", "a"), (3, None, "a")])
    out = quality_rules.keep_good(d)
    assert out.columns == d.columns and [r["doc_id"] for r in out.collect()] == [1]
    assert quality_rules.keep_good(d.limit(0)).count() == 0


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted({i for i, _ in prints if i is not None})
    root = {f: f for _, f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    least = collections.defaultdict(lambda: None)
    for i, f in prints:
        if i is not None:
            least[find(f)] = i if least[find(f)] is None else min(i, least[find(f)])
    assert ids
    return {(i, f, least[find(f)]) for i, f in prints}


@pytest.mark.parametrize("tile_rows", [1, 7, 1000])
def test_simhash_matches_brute_force(spark, tile_rows):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        rows.append((10 + 3 * k, " ".join(base), "s"))
        for v in range(rng.randrange(0, 3)):
            near = list(base)
            near[rng.randrange(len(near))] = "Edited"
            rows.append((11 + 3 * k + v, " ".join(near), "s"))
    d, own = awkward(spark)
    all_rows = [*rows, *own]
    got = {(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(d.unionByName(docs_of(spark, rows)), tile_rows=tile_rows).collect()}
    assert got == brute_components([(i, brute_fingerprint(t)) for i, t, _ in all_rows])


def test_simhash_chains_and_keep_one(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {**{k: 0 for k in range(1, 61)}, 101: 100}
    d, _ = awkward(spark)
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and sorted(kept.select("doc_id").collect(), key=str) == sorted([(1,), (5,), (6,), (8,), (9,), (None,)], key=str)
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 7, 24, 97, 1000, 4999):
        got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
        assert sorted(got) == list(range(n))
    for n in range(1, 3000):
        a, b = sharding.factors(n)
        assert a * b >= n


def test_shards(spark):
    import zlib

    d, rows = awkward(spark)
    got = sharding.sharded(d, shards=4).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 4
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    again = sharding.sharded(d.repartition(5), shards=4).collect()
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert sharding.sharded(d.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.VOCABULARY)
    d, rows = awkward(spark)
    hard = ["a  b   c", " lead", "trail ", "x<|endoftext|>y <|endoftext|>", "don't  we'll", "1 2  3\n\n4 \n 5", "\u00a0 a\u2003 b\u3000c", "a\x1c b\x1d c", "tab\t x", "😀 😀😀 é", "x" * 3000, "\ud7ff z", " ", "\n", "a \nb\n c"]
    rng = random.Random(1)
    hard += ["".join(rng.choice(" \n\tab1.,é中'\u00a0") for _ in range(60)) for _ in range(200)]
    more = [(1000 + k, t, "h") for k, t in enumerate(hard)]
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(d.unionByName(docs_of(spark, more)), path).collect()}
    t = Tokenizer.from_file(path)
    want = set()
    for i, text, _ in [*rows, *more]:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want.add((i, len((text or "").encode()), n, n > 512))
    assert got == want and tokens.token_counts(d.limit(0), path).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> [\\INST]", "plain", "", None, "<", "[", "<s", "a\nb", "[/INST]</s><s>user[INST]"]
    rows = [(c, k, random.Random(c + k).choice(["user", "assistant", "<s>", None]), hard[(c * 3 + k) % len(hard)]) for c in range(20) for k in range(5)]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("n_", F.lit(2))
    out = chat.formatted(d)
    assert out.where("NOT identical OR identical IS NULL").count() == 0
    got = {r["conv_id"]: r for r in chat.digests(out).collect()}
    by = collections.defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((-1 if k is None else k, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"], got[c]["n_turns"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(turns))
    unchanged = out.select(F.explode("turns").alias("t")).where("t.text = 'plain'").count()
    assert unchanged and chat.formatted(d.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://example.org/es/1", "https://A.EXAMPLE.org/en/12", "http://x.org", "http://x.org/", "http://com/fr/x", "http://b.com/de/", "nothing", None, "a://h.com?x/de/", "://y.org/#", "http://notexample.com:80/de/", "http://bad.host.net/a", "http://bad.host.net/b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    labelled = spark.createDataFrame([(f"http://bad.host.net/x{k}", True) for k in range(20)] + [(f"http://good.host.net/x{k}", False) for k in range(40)], "url string, bad boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, labelled).collect()}
    assert got[0] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("x.org", "", None, "allow") and got[3] == ("x.org", "/", "org/", "allow")
    assert got[4] == ("com", "/fr/x", "com/fr/", "allow") and got[5] == ("b.com", "/de/", "com/de/", "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("h.com", "", None, "allow") and got[9] == ("y.org", "/", "org/", "allow")
    assert got[10] == ("notexample.com:80", "/de/", None, "allow") and got[11][3] == got[12][3] == "block"
    none = url_filter.judged(pages, labelled.limit(0))
    assert none.where("page_id IN (11, 12) AND verdict = 'allow'").count() == 2 and url_filter.judged(pages.limit(0), labelled).count() == 0


def test_targets():
    sizes = [100, 1, 50, 0]
    got = mixing.targets(sizes)
    assert sum(got) == pytest.approx(151) and all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes))
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    assert mixing.targets([60, 60, 60]) == pytest.approx([30, 60, 90])


def test_fit_is_as_close_as_can_be():
    rng = random.Random(2)
    for _ in range(300):
        lengths = sorted(rng.sample(range(0, 30), rng.randrange(1, 5)))
        counts = [rng.randrange(0, 4) for _ in lengths]
        budget = rng.randrange(0, 60)
        got = mixing.fit(lengths, counts, budget)
        sums = [sum(n * k for n, k in zip(lengths, pick)) for pick in itertools.product(*[range(c + 1) for c in counts])]
        assert all(0 <= g <= c for g, c in zip(got, counts))
        assert abs(sum(n * g for n, g in zip(lengths, got)) - budget) == min(abs(s - budget) for s in sums)
    lengths, counts = list(range(1, 900)), [50] * 899
    got = mixing.fit(lengths, counts, 9_999_999)
    assert sum(n * g for n, g in zip(lengths, got)) == 9_999_999 and all(g <= 50 for g in got)
    assert mixing.fit([3, 50_000_000], [10, 4], 20) == [7, 0]


def test_mixing_report(spark):
    d, rows = awkward(spark)
    rng = random.Random(4)
    more = [(50 + k, " ".join("w" for _ in range(rng.randrange(0, 40))), rng.choice(["a", "b", "c", None])) for k in range(300)]
    d = d.unionByName(docs_of(spark, more))
    got = mixing.mix_report(d).collect()
    again = mixing.mix_report(d.repartition(3)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert all(r["taken"] <= 3 * r["size"] for r in got) and len(got) == len(rows) + len(more)
    size = collections.Counter()
    for _, t, s in [*rows, *more]:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    # Water filling by bisection, not by the code under test: every source gets the least of its cap and its weight's share.
    weight, low, high = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, 0.0, float(sum(size.values()))
    for _ in range(200):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min(3 * size[s], unit * weight[s]) for s in order) < sum(size.values()) else (low, unit)
    want = {s: min(3.0 * size[s], high * weight[s]) for s in order}
    taken, targets = collections.Counter(), {}
    by_target = {round(w, 3): s for s, w in want.items()}
    for r in got:
        s = by_target[round(r["target"], 3)]
        taken[s] += r["taken"]
        targets[s] = r["target"]
        assert r["source_size"] == size[s]
    for s in order:
        own = [len(words(t)) for _, t, x in [*rows, *more] if x == s]  # as near as its documents allow: b is mostly one of 20,000 words
        assert abs(taken[s] - want[s]) <= max(own) / 2 + 1
    repeated = mixing.mixed_rows(d)
    assert repeated.columns == d.columns
    assert sum(len(words(r["text"])) for r in repeated.select("text").collect()) == sum(r["taken"] for r in got)
    assert mixing.mix_report(d.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, say(40)) for k in range(6)]
    edited = [w if k % 6 else "edited" for k, w in enumerate(items[1][1])]
    dropped = [w for k, w in enumerate(items[2][1]) if k % 9]
    rows = [(1, [*say(60), *items[0][1], *say(60)]), (2, [*say(60), *edited, *say(10)]), (3, [*say(5), *dropped]), (4, say(300)), (5, [*say(30), *items[3][1][:8], *say(90)]), (6, items[0][1]), (7, [])]
    more = [(100 + k, [*say(20), *items[4][1], *say(20)]) for k in range(30)]  # a passage that many documents hold
    d = docs_of(spark, [(i, " ".join(w).upper() if i == 1 else " ".join(w), "s") for i, w in [*rows, *more]] + [(8, None, "s")])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, ""), (91, None), (92, "zz qq")], "item_id long, text string")
    want = {(1, 0), (2, 1), (3, 2), (6, 0), *[(100 + k, 4) for k in range(30)]}
    for block_bytes in (decontaminate.BLOCK_BYTES, 500):
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(d, bench, block_bytes=block_bytes).collect()}
        assert set(got) == want and got[(1, 0)] == 1.0 and 0.5 <= got[(2, 1)] < 1
    clean = decontaminate.keep_clean(d, bench)
    assert clean.columns == d.columns and {r["doc_id"] for r in clean.collect()} == {4, 5, 7, 8}
    assert decontaminate.leaks(d, bench.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), bench).count() == 0


def test_alignment_matches_plain_programme():
    import numpy as np

    rng = random.Random(6)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(map(max, h))


def test_classifier_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = classifier.quality_scores(docs, labels)
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    judged = got.join(labels, "doc_id").where("held_out")
    right = judged.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.85


def test_classifier_edges(spark):
    d, _ = awkward(spark)
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in classifier.quality_scores(d, one).collect()} == {1}
    assert {r["score"] for r in classifier.quality_scores(d, one.limit(0)).collect()} == {0.5}
    assert classifier.quality_scores(d.limit(0), one).count() == 0
