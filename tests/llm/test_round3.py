"""Spelling variants, alignment of tokenizers and packing, against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lanternq.llm import alignment, packing, spelling

A, B, C = (public_tokenizers.path(x) for x in (alignment.VOCABULARY_A, alignment.VOCABULARY_B, packing.VOCABULARY))
AWKWARD = [
    (1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "x\r\ny;\r\n z)\r  "), (6, "\n\nfoo\tbar  baz　qux "), (None, "a\x1cb \x1c c"), (None, "a\x1cb \x1c c"),
    (8, "<|endoftext|></s> <s>"), (9, "  \r\n"), (10, "\r"), (11, "日本語、テキスト。 한국어 🙂🙂 é"), (12, "don't I'LL 12½ ²x'S"), (13, "Wort " * 2500 + "x" * 9000),
    (14, "a " * 2047), (15, "a " * 2048), (16, "the same text"), (17, "the same text"), (17, "the same text"), (18, "Straße ÀÉÎ élève's naïve-éclair"),
]
CLASHES = ("word", "n", "near", "head", "m", "p", "q", "d", "r", "h", "block", "at", "number", "seg", "times", "of", "link", "b", "row_", "length", "group_", "piece", "id", "y")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return rows.withColumns({c: F.lit("clash") for c in CLASHES})


def _variants(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    own = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {a: [b for b in own if abs(len(a) - len(b)) <= 1 and one_edit(a, b)] for a in own}
    form = {}
    for w, n in own.items():
        best = min(((-own[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None
    out = []
    for w, n in own.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), own[form[w]] if form[w] else None))
    return sorted(out)


def _words_with_variants(spark):
    draw, rows = random.Random(5), []
    base = ["elephant", "elephants", "telephone", "aaaaaaaa", "aaaaaaaaa", "interesting", "Éléphant", "strasse", "straßes", "abcdefg", "x" * 300]
    for k in range(160):
        words = []
        for _ in range(120):
            w = base[min(int(draw.expovariate(0.9)), len(base) - 1)]
            if draw.random() < 0.2:
                at, how, c = draw.randrange(len(w)), draw.randrange(3), draw.choice("abéX")
                w = w[:at] + (c if how < 2 else "") + w[at + (how > 0) :]
            words.append(w)
        rows.append((k if k % 40 else None, " ".join(words)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("most", [2, 128])
def test_spelling_variants_equal_all_pairs_however_blocks_are_divided(spark, most):
    rows, docs = _words_with_variants(spark)
    got = sorted(tuple(r) for r in spelling.variants(docs, most=most).collect())
    assert got == _variants(rows) and len(got) > 100


def test_forms_are_followed_to_the_last(spark):
    rows = [(k, t) for k, (t, n) in enumerate([("abcdefgh", 1000), ("abcdefghi", 100), ("abcdefghij", 10)])]
    docs = spark.createDataFrame([(i, (t + " ") * n) for (i, t), n in zip(rows, (1000, 100, 10))], "doc_id long, text string")
    got = {r["word"]: r["root"] for r in spelling.variants(docs, typos=2**40).collect()}
    assert got == {"abcdefgh": "abcdefgh", "abcdefghi": "abcdefgh", "abcdefghij": "abcdefgh"}


def test_spelling_of_awkward_rows_and_of_an_empty_table(spark, docs):
    assert sorted(tuple(r) for r in spelling.variants(docs).collect()) == _variants(AWKWARD)
    assert spelling.variants(docs.limit(0)).collect() == []


def _alignments(rows):
    t, docs, counts = alignment.tokenizers(A, B), [], Counter()
    for d, text in rows:
        a = t.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = t.b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(t.a_bytes[k] for k in a) != whole or b"".join(t.b_bytes[k] for k in b) != whole:
            docs.append((d, 0, 0, [], []))
            continue
        owner = {n: [k for k, i in enumerate(ids) for _ in table[i]] for n, ids, table in (("a", a, t.a_bytes), ("b", b, t.b_bytes))}
        links = sorted(set(zip(owner["a"], owner["b"])))
        ends = [{k for k in range(1, len(whole) + 1) if k == len(whole) or owner[n][k] != owner[n][k - 1]} for n in "ab"]
        groups, start = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(ids[k]) for k in sorted(set(owner[n][start:end]))) for n, ids in (("a", a), ("b", b))))
            start = end
        docs.append((d, len(a), len(b), [(a[x], b[y]) for x, y in links], groups))
        counts.update(docs[-1][3])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return sorted([(d, a, b, len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest(g)) for d, a, b, links, g in docs], key=str)


@pytest.mark.parametrize("options", [{}, {"block_chars": 50}, {"block_chars": 50, "dealt_blocks": 2}, {"block_chars": 50, "dealt_blocks": 2, "sent_pairs": 0}])
def test_alignment_of_segments_equals_alignment_of_texts(docs, options):
    got = sorted([tuple(r) for r in alignment.alignments(docs, A, B, **options).collect()], key=str)
    assert got == _alignments(AWKWARD)


def test_alignment_of_an_empty_table(docs):
    assert alignment.alignments(docs.limit(0), A, B).collect() == []


def test_segments_are_never_cut_where_a_token_may_reach_across():
    t, draw = alignment.tokenizers(A, B), random.Random(3)
    assert "\r" not in t.cuts and " " in t.cuts and "\n" in t.cuts
    for _ in range(1500):
        text = " " + "".join(draw.choice(["a", "B", "'s", " ", "  ", "\n", "\t", "\r", ";", ")\r", "1", "é", "　", "\xa0", "🙂", "<s>"]) for _ in range(draw.randint(1, 12)))
        segments = t.segments(text)
        assert "".join(segments) == text
        one = t.encoded(text)
        parts = [t.encoded(s) for s in segments]
        for k in (0, 1):
            assert np.array_equal(one[k], np.concatenate([p[k] for p in parts]))


def _pieces(rows):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(C), []
    for d, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    return sorted(out, key=str)


def _sequences(rows):
    found = defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in found.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(found)


@pytest.mark.parametrize("group", [4, 16_384])
def test_packing_keeps_every_piece_and_leaves_no_gap(docs, group):
    rows = packing.packed(docs, C, group_pieces=group).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == _pieces(AWKWARD)
    assert _sequences(rows) <= -(-sum(r["length"] for r in rows) // 2048) + (1 if group > 4 else 8)


def test_packing_of_an_empty_table(docs):
    assert packing.packed(docs.limit(0), C).collect() == []


def test_words_have_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    library, words, draw = Tokenizer.from_file(C), packing.Words(C), random.Random(1)
    parts = ["a", "S", "'", "s", "t", "re", "'ll", "1", "²", "ª", "×", "é", "É", "é", "́", " ", "\n", "\x1c", "\xa0", "　", "ß", "İ", "Σ", "日本", "🙂", "<|endoftext|>", "<|", "!", "_", "\x85", "\x00", "x" * 70]
    for _ in range(1500):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 20)))
        assert words.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _fewest(lengths, room):
    """The least number of bins, by trying every place of every item."""
    best, items = len(lengths), sorted(lengths, reverse=True)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= room:
                place(k + 1, bins[:i] + [bins[i] + items[k]] + bins[i + 1 :])
        place(k + 1, bins + [items[k]])

    place(0, [])
    return best


def test_exchanges_empty_sequences_that_best_fit_leaves():
    draw = np.random.default_rng(4)
    fewer = 0
    for _ in range(60):
        lengths = draw.integers(15, 60, 9).astype(np.int64)
        own = packing.best_fit(lengths, 100)
        after = packing.emptied(lengths, own, 100)
        fill = np.bincount(after, weights=lengths)
        assert fill.max() <= 100 and np.count_nonzero(fill) <= own.max() + 1
        assert np.count_nonzero(fill) <= _fewest(lengths.tolist(), 100) + 1
        fewer += np.count_nonzero(fill) < own.max() + 1
    large = draw.integers(500, 900, 3000).astype(np.int64)
    own = packing.best_fit(large, 2048)
    assert len(np.unique(packing.emptied(large, own, 2048))) < 0.96 * (own.max() + 1)


#: Every name that a step of these operators gives to a column of its own, and some that tables often have.
INNER = (
    "y id h k n b w e s g key th th_ row_ rows times stays own own_id own_th of_id of_text words count bin tile other meets left right i j a piece side whole parts least root node fp "
    "size o_ b_ n_ p_ size_ own_ last_ rows_ taken_ times_ copy_ epochs more rank ahead target source_ source_size c shared_ k_ h_ bad_id_ bad_th_ item_id score label quality label_ held_out predicted kept base_failed "
    "n_words word_chars n_symbols number seg links at block length group_ value values text_ doc column1 window"
).split()


def test_extra_columns_of_any_name_change_nothing(spark, sf):
    from lanternq.llm import classifier, decontaminate, mixing, quality_rules, sharding, simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    more = docs.withColumns({c: F.lit("clash") for c in INNER if c not in docs.columns})
    for name, apply in {
        "op1": lambda d: classifier.quality_scores(d, labels.withColumns({c: F.lit("x") for c in INNER if c not in labels.columns})),
        "rules": quality_rules.keep_good, "dedup": simhash.keep_one, "clean": lambda d: decontaminate.keep_clean(d, benchmark), "mix": mixing.mixed_rows, "shards": sharding.sharded,
    }.items():
        want, got = apply(docs), apply(more)
        if name not in ("op1", "shards"):
            assert got.columns == more.columns and got.where("id <> 'clash'").count() == 0
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), name


def test_rows_that_differ_in_other_columns_only_are_picked_alike_in_every_run(spark):
    from lanternq.llm import mixing, simhash

    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, lang, "s", k) for k, lang in enumerate(["de", "en", "fr", "es"])]
    picked = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars int").repartition(4)
        assert [r["lang"] for r in simhash.keep_one(docs).collect()] == ["de"]
        other = docs.unionByName(spark.createDataFrame([(9, "a b c", "en", "t", 0)], docs.schema))
        picked.append(sorted((r["doc_id"], r["lang"]) for r in mixing.mixed_rows(other).collect()))
    assert picked[0] == picked[1]


def test_personal_data_that_was_left_in_clear(spark):
    from lanternq.llm import pii

    key = b"k"
    new = lambda t: pii.replaced(t, key)[0]
    for text, gone in {
        "Mr Juan Carlos Luis Pedro Garcia Lopez called.": ["Juan", "Carlos Luis", "Garcia", "Lopez"], "api_key=ABCDEFGHIJKLMNOPQRST": ["ABCDEFGH"], "My name is Wei Zhang": ["Wei", "Zhang"],
        "call (030) 1234567 now": ["1234567"], "call 07700 900123": ["900123"], "call 0912-345-678": ["345-678"],
    }.items():
        assert not any(g in new(text) for g in gone), new(text)
    for text in ("the secret conversations", "Paul Street", "01-02-2024", "0123 456", "password requirements"):
        assert new(text) == text
    with pytest.raises(ValueError, match="secret key"):
        pii.session_key(spark)
