"""The training-data operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import chat, decontaminate, fill_middle, license_scan, lm_scoring, near_dedup, packing, pieces, quality_classifier, quality_rules, source_audit, token_files, token_rollup
from millrace.llm import queries as Q
from millrace.llm.text import SPACED, Texts, slices
from millrace.llm.tokens import Encoder

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "sun", "vé") for b in ("n", "st", "re", "", "dol", "q")]
EDGES = [None, "", " ", "\n\n", "one", "a b", "...", "éÉ \U0001f600 x", "x " * 3000, "tab\tand\x0bvt", "Same line\nSame line\nSame line", "<|im_end|> <\\|x"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Edge cases, ties, exact copies and near copies."""
    rng = random.Random(3)
    texts = list(EDGES)
    for _ in range(40):
        base = sentence(rng, rng.randint(5, 120)).split()
        texts.append(" ".join(base))
        for changes in (0, 1, 2, 6):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy).upper() if changes == 1 else " ".join(copy))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns named like the results, besides null ids and a repeated row."""
    rows = [(1, "a b c d e f g h i j k", "x", 9, 1.5, True), (1, "a b c d e f g h i j k", "x", 9, 1.5, True), (None, "a b c d e f g h i j k", None, None, None, None), (2, None, "y", 0, 0.0, False)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, n_words int, score double, kept boolean")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


# --- shared text layer


def test_texts_match_regular_expressions():
    texts = [(t or "").encode() for _, t in corpus()]
    t = Texts(texts, SPACED)
    hashes, bounds, seen = t.hashes(), t.bounds(), {}
    for i, text in enumerate(texts):
        words = [w.encode() for w in spaced(text.decode())]
        assert bounds[i + 1] - bounds[i] == len(words)
        for w, h in zip(words, hashes[bounds[i]:bounds[i + 1]]):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_span_hashes_do_not_depend_on_the_place():
    long = b"z" * (1 << 20) + b"zz"
    a = Texts([b"p q", long, b"q"], SPACED).hashes()
    b = Texts([b"q " + long + b" p"], SPACED).hashes()
    assert a[0] == b[2] and a[1] == a[3] == b[0] and a[2] == b[1]


def test_slices_hold_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["ab", None, "c" * 50, ""]})
    assert [t for _, ts in slices([batch], most=3) for t in ts] == [b"ab", b"", b"c" * 50, b""]


@pytest.mark.parametrize("name,space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_gives_the_librarys_ids(name, space):
    own, library = Encoder(public_tokenizers.path(name), space, most=50), Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(1)
    texts = [t or "" for _, t in corpus()] + ["".join(rng.choice(" \n'sSdtaé́ŉİΣßﬁ1²٣|<>_  \r\t\x08,.") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for text in texts:
        assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes(), repr(text)


def thue_morse(bits, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(1 << bits))


@pytest.mark.parametrize("bits", range(3, 15))
def test_words_of_equal_length_have_hashes_of_their_own(bits):
    words = [thue_morse(bits, *x) for x in ("ab", "ba", "ac")]
    hashes = Texts([" ".join(words).encode()], SPACED).hashes()
    assert len(set(hashes.tolist())) == 3
    lines = quality_rules.measure(["\n".join(w.replace("a", "a ") for w in words).encode()], (5,))
    assert lines["n_dup_lines"].tolist() == [0]
    x, y = (near_dedup.shingle_sets([f"one {w} two three four".encode()], 4)[0] for w in words[:2])
    assert not set(x.tolist()) & set(y.tolist()) - set(near_dedup.shingle_sets([b"two three four"], 4)[0].tolist())


# --- op1


def test_lm_scores_are_sums_of_conditional_log_probabilities(spark, docs):
    model = lm_scoring.fit(docs, vocabulary=30, own=12, tails=6)
    net = model.network
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, model).collect()}
    table, out, bias = net.weights
    counts = Counter(w.encode() for _, text in corpus() for w in plain(text))
    assert {bytes(r["word"]): r["n"] for r in model.counts.collect()} == counts
    own = [w for w, i in net.ids.items() if i < 12]
    assert sorted((counts[w] for w in own), reverse=True) == sorted(counts.values(), reverse=True)[:12]
    of = lambda w: net.ids[w] if w in own else 12 + zlib.crc32(w[-3:]) % 6
    mass = Counter()
    for w, n in counts.items():
        mass[of(w)] += n
    for i, text in corpus():
        words = [w.encode() for w in plain(text)]
        ids = [net.edge] * 2 + [net.ids.get(w, 30 + zlib.crc32(w[-3:]) % 6) for w in words] + [net.edge] * 2
        total = 0.0
        for at, w in enumerate(words, 2):
            hidden = np.tanh(sum(table[k][ids[at + o]].astype(float) for k, o in enumerate((-2, -1, 1, 2))))
            logits = hidden @ out.astype(float) + bias
            logits -= np.log(np.exp(logits - logits.max()).sum()) + logits.max()
            total += logits[of(w)] + np.log(counts[w] / mass[of(w)])
        assert got[i]["n_tokens"] == len(words)
        assert got[i]["log_likelihood"] == pytest.approx(total, rel=1e-3, abs=1e-3)
        assert (got[i]["per_token"] is None) == (not words)


def test_lm_gradient_and_distribution():
    words, counts = [b"a", b"b", b"c", b"d"], {b"a": 9, b"b": 5, b"c": 3, b"d": 2, b"e": 1, b"f": 2}
    tails = [0, 0, 0]
    for w, n in counts.items():
        tails[zlib.crc32(w) % 3] += n
    model = lm_scoring.Network(words, [9, 5, 3, 2], 2, tails, 1, 3)
    mass = Counter()
    for w, n in counts.items():
        token = model.ids.get(w, 4 + model.ending(w))
        mass[model.classes[token]] += np.exp(model.inside[token]) * (1 if w in model.ids else n)
    assert all(np.isclose(m, 1) for m in mass.values())  # the words of each class share its probability
    ids = np.array([7, 0, 1, 2, 0, 3, 4, 7], np.int32)
    at = np.arange(1, 7)
    sides, target = model.context(ids, at), model.classes[ids[at]]
    before = [w.copy() for w in model.weights]

    def loss():
        _, logits, _, mass = model.forward(sides)
        return float(np.mean(np.log(mass) - logits[np.arange(6), target]))

    eps, numeric = 1e-2, np.zeros_like(before[1])
    for i, j in np.ndindex(*before[1].shape):
        model.weights[1][i, j] += eps
        up = loss()
        model.weights[1][i, j] -= 2 * eps
        numeric[i, j] = (up - loss()) / (2 * eps)
        model.weights[1][i, j] += eps
    want = loss()
    assert model.step(sides, target, 1.0) / 6 == pytest.approx(want, rel=1e-4)
    assert np.allclose(before[1] - model.weights[1], numeric, atol=2e-3)


def test_lm_learns_from_both_sides(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(x for _ in range(60) for x in rng.choice((("left", "mid", "right"), ("links", "mitte", "rechts"))))) for i in range(60)]
    model = lm_scoring.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), vocabulary=10, own=10, tails=4, rounds=9)
    assert 2 <= len(model.loss) <= 9 and model.loss[-1] < model.loss[0]
    good, bad = [(1, "left mid right links mitte rechts"), (2, "left mitte right links mid rechts")]
    got = {r["doc_id"]: r["per_token"] for r in lm_scoring.score(spark.createDataFrame([good, bad], "doc_id long, text string"), model).collect()}
    assert got[1] > got[2] + 0.2


def test_lm_grows_with_the_corpus_and_beats_a_unigram(spark):
    small, large = lm_scoring.sizes(10**7), lm_scoring.sizes(10**9)
    assert all(b > 1.9 * a for a, b in zip(small[:2], large)) and large[2] > small[2]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm_scoring.fit(docs)
    counts = {bytes(r["word"]): r["n"] for r in model.counts.collect()}
    tokens = sum(counts.values())
    unigram = sum(n * np.log(n / tokens) for n in counts.values()) / tokens
    got = lm_scoring.score(docs, model).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
    assert got[1] == tokens and got[0] / got[1] > unigram + 0.03


def test_lm_vocabulary_leaves_no_large_part_of_the_text_out():
    """On the 3,948,988 words of sf0.1, 880 words were half of the text, and 36 had a class of their own."""
    words, own, tails = lm_scoring.sizes(3_948_988)
    assert words > 2_500 and own > 90 and tails > 28


def test_lm_step_in_parts_is_one_step(monkeypatch):
    nets = []
    for places in (5, 512):
        monkeypatch.setattr(lm_scoring, "PLACES", places)
        nets.append(lm_scoring.Network([b"a", b"b", b"c"], [9, 5, 3], 2, [4, 2], 1, 3))
        ids = np.array([nets[0].edge, *np.random.default_rng(3).integers(0, 5, 40), nets[0].edge], np.int32)
        seen, loss = nets[-1].train(ids, 0.3, 40)
        assert seen == 40 and loss > 0
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(nets[0].weights, nets[1].weights))


def test_lm_step_takes_large_and_small_logits():
    """A shift is left out only where exp cannot overflow; the gradient of the bias is that of the softmax either way."""
    for size in (0.1, 300.0):
        net = lm_scoring.Network([b"a", b"b", b"c"], [9, 5, 3], 2, [4, 2], 1, 3)
        net.weights[1] = (np.random.default_rng(1).normal(0, 1, net.shapes[1]) * size).astype(np.float32)
        ids = np.array([net.edge, 0, 1, 2, 0, net.edge], np.int32)
        sides, target = net.context(ids, np.arange(1, 5)), net.classes[ids[1:5]]
        (table, out, bias), before = net.weights, net.weights[2].copy()
        logits = np.tanh(sum(table[k][sides[:, k]].astype(float) for k in range(2))) @ out.astype(float) + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        want = (p / p.sum(1, keepdims=True) - np.eye(net.n_classes)[target]).mean(0)
        assert net.joint()[1] == (size < 1)
        net.step(sides, target, 1.0)
        assert np.allclose(before - net.weights[2], want, atol=1e-4)


def test_slices_make_objects_of_one_slice_only(monkeypatch):
    import pyarrow as pa

    from millrace.llm import text

    made, whole = [], text.byte_texts
    monkeypatch.setattr(text, "byte_texts", lambda batch, column="text": made.append(len(batch)) or whole(batch, column))
    batch = pa.RecordBatch.from_arrays([pa.array([*["x" * 10] * 100, None, ""])], ["text"])
    got = list(slices([batch], most=25))
    assert max(made) == 3 and sum(made) == 102 and [t for _, texts in got for t in texts] == [b"x" * 10] * 100 + [b"", b""]
    assert list(slices([batch.slice(0, 0)])) == []


# --- op2


@pytest.mark.parametrize("seed,n,top", [(1, 300, 63), (2, 5000, 63), (3, 1, 5), (4, 40, 20)])
def test_plan_covers_the_histogram_and_is_tight(seed, n, top):
    lengths = np.random.default_rng(seed).integers(1, top + 1, n)
    histogram = {int(k): int(v) for k, v in Counter(lengths.tolist()).items()}
    plan = packing.plan(histogram, 64)
    used = Counter()
    for content, copies in plan:
        assert sum(k * t for k, t in content.items()) <= 64
        for k, t in content.items():
            used[k] += t * copies
    assert used == histogram
    keys = np.array(sorted(histogram))
    simple = sum(c for _, c in packing.best_fit(keys, np.array([histogram[int(k)] for k in keys]), 64))
    assert sum(c for _, c in plan) <= max(simple * 1.01, simple + 1) and sum(c for _, c in plan) >= -(-int(lengths.sum()) // 64)


def test_best_configuration_is_the_knapsack_optimum():
    lengths, values = np.array([3, 5, 7]), np.array([3.1, 5.4, 7.2])
    times = packing.best_configuration(values, lengths, 17)
    brute = max(a * 3.1 + b * 5.4 + c * 7.2 for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 17)
    assert times @ lengths <= 17 and times @ values == pytest.approx(brute)


def test_pieces_and_places(spark, docs):
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=128)
    got = packing.pack(pieces, 128).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in corpus():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(ids, np.uint32).tobytes()
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert all(r["length"] == 128 for r in own[1:])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128


def test_pack_edges(spark):
    rows = spark.createDataFrame([(1, 5, 7), (1, 5, 7), (2, None, 0), (3, 0, 0), (4, 11, 0), (5, 10, 0)], "doc_id long, length long, offset int")
    got = sorted((r["doc_id"], r["sequence_id"] is None, r["offset"]) for r in packing.pack(rows, 10).collect())
    assert [g[:2] for g in got] == [(1, False), (1, False), (2, True), (3, True), (4, True), (5, False)]
    assert sorted(g[2] for g in got if g[0] == 1) == [0, 5]
    assert packing.pack(rows.where("false"), 10).count() == 0


# --- op3


def test_license_scan_matches_brute_force(spark, docs):
    extra = [(900, "Licensed under the Apache Licence, Version 2.0."), (901, "GNU-General; public LICENSE. cc by cc BY"), (902, "the gnu generel publik license"), (903, "gnu gxxxxxl public license"), (904, "redistribution and uses in sorce and binary form"), (905, "xgnu general public license")]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = {r["doc_id"]: r for r in license_scan.scan(rows).collect()}
    for i, text in [*corpus(), *extra]:
        words = plain(text)
        assert got[i]["n_words"] == len(words)
        want = sorted((k, p) for p in license_scan.PHRASES for k in range(len(words)) if words[k:k + len(p.split())] == p.split())
        assert sorted((x["word"], x["phrase"]) for x in got[i]["places"]) == want
        # every notice within its edits of some run of whole words is found, and nothing else
        near = set()
        for notice in license_scan.NOTICES:
            n = len(notice.text.split())
            for a in range(len(words)):
                for b in range(a + 1, min(a + n + notice.edits, len(words)) + 1):
                    if abs(len(" ".join(words[a:b])) - len(notice.text)) <= notice.edits and edit_distance(" ".join(words[a:b]), notice.text) <= notice.edits:
                        near.add(notice.label)
        assert {s["label"] for s in got[i]["spans"]} == near, (i, text)
    assert "gpl" in {s["label"] for s in got[902]["spans"]} and not got[903]["spans"]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# --- op4


def test_quality_rules_match_brute_force(docs):
    got = {r["doc_id"]: r for r in quality_rules.repetition(docs).collect()}
    for i, text in corpus():
        words, r = spaced(text), got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")))
        lines = [x for x in (text or "").split("\n") if spaced(x)]
        again = [x for k, x in enumerate(lines) if x in lines[:k]]
        assert (r["n_lines"], r["n_dup_lines"], r["dup_line_chars"]) == (len(lines), len(again), sum(map(len, again)))
        for n in (5, 6, 8, 10):
            grams = Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1))
            inside = {k + j for k in range(len(words) - n + 1) if grams[tuple(words[k:k + n])] > 1 for j in range(n)}
            assert (r[f"repeat_words_{n}"], r[f"gram_chars_{n}"]) == (len(inside), sum(len(words[k]) for k in inside))


# --- op5


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    out = Q.op5_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in out) >= 0.93 * len(out)
    assert all(r["predicted"] == 1 for r in out if r["quality"] == 1)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)


def test_vote_is_exact():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 6)).astype(np.float32), rng.normal(size=(25, 6)).astype(np.float32)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    labels = rng.integers(0, 2, 25).astype(float)
    got = quality_classifier.vote(x, y, labels, 5, 2.0, block=7)
    for i in range(40):
        near = sorted(((float(x[i] @ y[j]), j) for j in range(25)), reverse=True)[:5]
        mass = sum(max(s, 0) ** 2 for s, _ in near)
        assert got[i] == pytest.approx(sum(max(s, 0) ** 2 * labels[j] for s, j in near) / mass, abs=1e-5)


def test_classifier_reads_no_ids(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True))
    scores = lambda ids: sorted((r["text"], r["score"]) for r in quality_classifier.classify(docs.withColumn("doc_id", ids), model).collect())
    assert scores(F.col("doc_id")) == scores(F.col("doc_id") + 1000) == scores(F.lit(None).cast("long"))


def test_latent_space_is_the_singular_value_decomposition(spark, docs):
    labels = spark.createDataFrame([(12, 1), (13, 0)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, F.lit(True), axes=6)
    x = quality_classifier.features([(t or "").encode() for _, t in corpus()])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    assert model.idf == pytest.approx(idf)
    _, _, right = np.linalg.svd(quality_classifier._scaled(x, idf).astype(float), full_matrices=False)
    assert np.abs(right[:6] @ model.axes) == pytest.approx(np.eye(6), abs=1e-3)


def test_classifier_without_labels(spark, docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, none, F.lit(True))
    assert {r["score"] for r in quality_classifier.classify(docs, model).collect()} == {0.5}


# --- op6


def test_contamination_matches_brute_force(spark, docs):
    rng = random.Random(9)
    bodies = [t for _, t in corpus() if t and len(plain(t)) > 20]
    items = [(k, " ".join(plain(bodies[k])[3:3 + n])) for k, n in enumerate((1, 2, 4, 13, 14, 17))] + [(20, sentence(rng, 30)), (21, None), (22, "..."), (5, " ".join(plain(bodies[0])[:15])), (None, " ".join(plain(bodies[9])[:13]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    for i, text in corpus():
        words, hit, names = plain(text), set(), set()
        for item, body in items:
            w = plain(body)
            for k in range(max(len(w) - 12, 1) if w else 0):
                part = w[k:k + 13]
                for a in range(len(words) - len(part) + 1):
                    if words[a:a + len(part)] == part:
                        hit |= set(range(a, a + len(part)))
                        names.add("null" if item is None else str(item))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(words), len(hit), len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(words))


def test_contamination_in_small_blocks(spark, docs):
    bench = spark.createDataFrame([(k, t) for k, t in corpus() if k % 3 == 0], "item_id long, text string")
    keyed = docs.withColumn("doc_key", F.struct("doc_id"))
    whole = decontaminate.occurrences(keyed, bench).select("doc_key.doc_id", "start", "window").collect()
    cut = decontaminate.occurrences(keyed, bench, block=40).select("doc_key.doc_id", "start", "window").collect()
    assert whole and sorted(whole) == sorted(cut)


# --- op7


def test_rollup_is_idempotent_and_signed(spark, tmp_path):
    kind = "source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    rows = spark.createDataFrame([("a", "en", "t1", 5, 2), ("a", "en", "t1", 7, 7), ("b", None, "t1", None, 1), (None, "fr", "t2", 3, 0)], kind)
    r = token_rollup.Rollup(spark, str(tmp_path / "roll"))
    assert r.totals().count() == 0
    assert r.apply("one", token_rollup.inserts(rows)) and not r.apply("one", token_rollup.inserts(rows))
    assert r.apply("two", token_rollup.revisions(rows.where("source = 'a'"))) and r.apply("three", token_rollup.deletes(rows.where("source = 'b'")))
    want = {("a", "en", "t1", 2, 15), (None, "fr", "t2", 1, 3)}
    assert {tuple(x) for x in r.totals().collect()} == want
    assert r.compact() and not r.apply("two", token_rollup.inserts(rows))
    assert {tuple(x) for x in r.totals().collect()} == want
    assert r.apply("four", token_rollup.inserts(rows.where("false"))) and {tuple(x) for x in r.totals().collect()} == want
    r.apply("five", token_rollup.inserts(rows.where("source = 'a'")))
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == {("a", "en", "t1", 4, 27), (None, "fr", "t2", 1, 3)}
    with pytest.raises(ValueError):
        r.apply("../x", rows)


def test_no_batch_id_meets_a_compacted_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "t1", 5)], "source string, lang string, tokenizer string, n_tokens long")
    r = token_rollup.Rollup(spark, str(tmp_path / "names"))
    for i, name in enumerate(("compact-1", "x", "packed-2", "batch-y", "compact-2")):
        assert r.apply(name, token_rollup.inserts(rows))
        assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "t1", i + 1, 5 * (i + 1))]
        assert not i or r.compact()
        assert not r.apply(name, token_rollup.inserts(rows))
    other = token_rollup.Rollup(spark, str(tmp_path / "names"))
    places, names = other._live()
    assert len(names) == 5
    for _ in range(2):  # two runs that compact the same batches at the same time
        held = other._read([other._named(n) for n in names]).groupBy(*token_rollup.GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        other._put(f"{other.folder}/packed-{random.random()}", held.withColumn("batches", F.array(*map(F.lit, names))))
    assert [tuple(x) for x in other.totals().collect()] == [("a", "en", "t1", 5, 25)]


def test_a_second_writer_of_one_batch_is_refused(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", "en", "t1", 5)], "source string, lang string, tokenizer string, n_tokens long")
    r = token_rollup.Rollup(spark, str(tmp_path / "two"))
    assert r.apply("one", token_rollup.inserts(rows))
    monkeypatch.setattr(r, "committed", list)  # as if the other had committed after the look
    assert not r.apply("one", token_rollup.inserts(rows))
    monkeypatch.undo()
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "t1", 1, 5)]


def test_counts(spark, docs):
    got = token_rollup.count_ids(docs.withColumns({"w": token_rollup.count_words(F.col("text")), "b": token_rollup.count_bytes(F.col("text"))}), public_tokenizers.path("word_bpe_49k.json"), False).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in got:
        assert (r["w"], r["b"], r["n_tokens"]) == (len(spaced(r["text"])), len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids))


# --- op8


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_001, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack_bits(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert (token_files.unpack_bits(packed, bits, 0, len(ids)) == ids).all()
    for start, n in ((0, 0), (1, 9), (69_990, 11), (12_345, 3000)):
        assert (token_files.unpack_bits(packed, bits, start, n) == ids[start:start + n]).all()


def test_token_files_round_trip(spark, docs, tmp_path):
    path, library = public_tokenizers.path("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    token_files.write(docs, str(tmp_path / "ids"), path, block=300)
    got = sorted((r["doc_id"], r["start"], bytes(r["ids"]), r["n_tokens"]) for r in token_files.read(spark, str(tmp_path / "ids")).collect())
    at = 0
    for (i, text), (doc, start, ids, n) in zip(corpus(), got, strict=True):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)
        assert (doc, start, ids, n) == (i, at, want.tobytes(), len(want))
        at += n
    assert [x.tobytes() for x in token_files.ids_of(spark, str(tmp_path / "ids"), 40)] == [got[40][2]]


# --- op9


def test_near_duplicates_match_brute_force(docs):
    sets = {}
    for i, text in corpus():
        w = spaced(lower(text))
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_dedup.near_duplicates(docs, words=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def hub_of_copies(n, seed):
    """n copies of one text of 103 words, two words replaced far from each other, and the text itself with the largest id."""
    rng = random.Random(seed)
    base = [f"w{seed}x{k}" for k in range(103)]
    rows = []
    for i in range(n):
        copy, at = list(base), rng.randrange(5, 45)
        copy[at], copy[at + rng.randrange(10, 50)] = f"a{seed}y{i}", f"b{seed}y{i}"
        rows.append((seed * 1000 + i, " ".join(copy)))
    return [*rows, (seed * 1000 + n, " ".join(base))]


def test_near_duplicates_of_an_original_with_the_largest_id(spark):
    rows = [r for seed in (1, 2, 3) for r in hub_of_copies(80, seed)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, i // 1000 * 1000) for i, _ in rows}


def family(n, seed):
    """n pairs of texts of one template: texts of a pair are similar (0.81), texts of different pairs are not (0.77)."""
    rng = random.Random(seed)
    body = [f"t{k}" for k in range(174)]
    texts = [body + [f"p{seed}x{k}" for k in range(6)] + [f"q{seed}x{k}x{side}" for k in range(20)] for seed in range(n) for side in "ab"]
    rng.shuffle(texts)
    return list(enumerate(" ".join(t) for t in texts))


def test_near_duplicates_inside_a_family_of_unlike_texts(spark):
    rows = family(100, 5)
    sets = [{tuple(w[k:k + 4]) for k in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    want = {}
    for i, x in enumerate(sets):
        alike = [j for j, y in enumerate(sets) if 100 * len(x & y) >= 80 * len(x | y)]
        assert len(alike) == 2
        want[i] = min(alike)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_exact_candidates_hold_all_similar_pairs(spark):
    rng = random.Random(2)
    sets = []
    for _ in range(30):
        base = rng.sample(range(60), rng.randint(1, 40))
        sets += [sorted({*base, *rng.sample(range(60, 200), rng.randint(0, 4))} - set(rng.sample(base, rng.randint(0, len(base) // 8)))) for _ in range(4)]
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<long>")
    ids = spark.createDataFrame([(i, i % 40) for i in range(len(sets))], "id long, label long")
    for per_salt in (2, 256):
        got = {(r["a"], r["b"]) for r in near_dedup._exact_candidates(frame, ids, 80, per_salt).collect()}
        want = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if i % 40 != j % 40 and 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})}
        assert len(want) > 20 and want <= got and all(i < j and i % 40 != j % 40 for i, j in got)


@pytest.mark.parametrize("members", [150, 600])
def test_members_of_one_component_do_not_meet_in_the_exact_join(spark, members):
    """A family of one label beside unlike sets and one similar set: the pairs that meet grow with the members."""
    rng = random.Random(members)
    sets = [sorted({*range(40), 1000 + i}) for i in range(members)]  # label 0
    sets += [sorted({*rng.sample(range(40), 20), *range(10_000 + 40 * i, 10_018 + 40 * i)}) for i in range(members // 5)]
    sets.append(sorted({*range(38), 99_000}))
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<long>")
    ids = spark.createDataFrame([(i, 0 if i < members else i) for i in range(len(sets))], "id long, label long")
    x, y = near_dedup._sides(frame, ids, 80)
    assert x.join(y, ["cell", "salt", "own"]).count() <= 40 * members
    got = {(r["a"], r["b"]) for r in near_dedup._exact_candidates(frame, ids, 80).collect()}
    assert {(i, len(sets) - 1) for i in range(members)} <= got


def test_rows_of_hot_and_other_keys_are_joined_once(spark):
    rows = [(i, 7 if i < 2000 else i) for i in range(3000)] + [(9000, None)]
    left = spark.createDataFrame(rows, "id long, key long")
    right = left.groupBy("key").agg(F.count("*").alias("n")).where("n < 2 OR key = 7")
    for how, n in (("inner", 3000), ("left", 3001)):
        out = near_dedup._dealt(left, right, "key", "n", how)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1 and "Union" not in plan
        got = [(r["id"], r["key"], r["n"]) for r in out.collect()]
        assert len(got) == n and set(got) >= {(i, k, 2000 if k == 7 else 1) for i, k in rows[:-1]}


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    donors = near_dedup._donors(240)
    for n, shared in ((30, 24), (400, 320)):
        same = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - shared, dtype=np.uint64)])) * np.uint64(2) for _ in range(2))
            same.append((near_dedup.signature(np.sort(a), 240, donors) == near_dedup.signature(np.sort(b), 240, donors)).mean())
        assert np.mean(same) == pytest.approx(shared / (2 * n - shared), abs=0.06)


def test_empty_bins_ask_until_they_meet_a_full_one():
    """Agreement per bin is the similarity, however few bins are full."""
    rng, donors = np.random.default_rng(6), near_dedup._donors(240)
    for n, m in ((4, 5), (8, 10)):
        same = []
        for _ in range(400):
            all_ = np.sort(rng.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2))
            few = np.sort(rng.permutation(all_)[:n])
            same.append((near_dedup.signature(all_, 240, donors) == near_dedup.signature(few, 240, donors)).mean())
        assert np.mean(same) == pytest.approx(0.8, abs=0.04)


@pytest.mark.parametrize("pairs", [300])
def test_no_link_between_short_texts_is_lost(spark, pairs):
    rows, want = [], {}
    for n, m in ((4, 5), (8, 10), (12, 15), (40, 50)):
        for k in range(pairs):
            words = [f"w{n}x{k}x{i}" for i in range(m + 3)]
            i = len(rows)
            rows += [(i, " ".join(words)), (i + 1, " ".join(words[:n + 3]))]
            want |= {i: i, i + 1: i}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_exact_join_over_all_sets(spark):
    """Without any band the exact join alone finds the links."""
    rows = family(30, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, words=4).collect()}
    got = near_dedup.near_duplicates(docs, words=4, bands=1, rows=30, exact=None).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) == 30


def test_components_with_hubs_and_large_labels(spark):
    edges = [(1, k) for k in range(2, 900)] + [(5000, k) for k in range(1000, 1600)] + [(1599, 1700), (1700, 1800), (-4, 1800)]
    got = {r["id"]: r["label"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 900)} | {k: -4 for k in (*range(1000, 1600), 5000, 1700, 1800, -4)}


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (100, 102)], "a long, b long")
    got = {r["id"]: r["label"] for r in near_dedup.components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}


# --- op10


def test_formatted_turns_come_back(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\| <|", "", None, "line\nline\n", "<", "|>", "é\U0001f600 <|"]
    rows = [(c, t, r, nasty[(c * 3 + t) % len(nasty)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "user\n<|nl|>", None, "assistant"][:c + 1])]
    rows += [(None, 0, "user", "x"), (7, 1, "user", "b"), (7, 1, "user", "b"), (7, None, "assistant", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.conversations(chat.thread(turns)).select("tree_id", "text", "loss", chat.turns_of(F.col("text")).alias("turns"), chat.masked_text(F.col("text"), F.col("loss")).alias("masked")).collect()
    groups = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0)):
        groups[c].append((r or "", x or ""))
    assert len(out) == len(groups)
    for r in out:
        assert [(x["role"], x["text"]) for x in r["turns"]] == groups[r["tree_id"]]
        assert r["masked"] == "".join(x for role, x in groups[r["tree_id"]] if role == "assistant")
        assert r["text"].count("<|im_start|>") == len(groups[r["tree_id"]])


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 2, "user", "c", 5.0), (1, 5, 3, "user", "d", None), (2, 1, 9, "user", "orphan", 1.0), (3, 1, 2, "user", "x", 1.0), (3, 2, 1, "user", "y", 1.0)]
    messages = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double")
    got = {(r["tree_id"], r["leaf"]): (r["rank"], r["n_turns"], r["score"]) for r in chat.conversations(messages, best=2).collect()}
    assert got == {(1, 4): (1, 3, 6.0), (1, 5): (2, 3, 2.0), (2, 1): (1, 1, 1.0)}
    assert {(r["tree_id"], r["leaf"]) for r in chat.conversations(messages).collect()} == {(1, 4), (2, 1)}
    assert {(r["leaf"], r["rank"]) for r in chat.conversations(messages, best=None).where("tree_id = 1").collect()} == {(4, 1), (5, 2)}
    assert chat.conversations(messages, best=None).count() == 3


def test_a_leaf_on_a_circle_gives_no_path(spark):
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 4, 3), (1, 5, None), (1, 6, 5), (1, 7, 6), (None, 1, 1), (None, 2, 1), (None, 3, None)]
    messages = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long")
    got = {(r["tree_id"], r["leaf"], r["message_id"], r["up"]) for r in chat.paths(messages).collect()}
    assert got == {(1, 7, 7, 0), (1, 7, 6, 1), (1, 7, 5, 2), (None, 3, 3, 0)}
    chain = spark.createDataFrame([(1, i, i - 1 or None) for i in range(1, 38)], "tree_id long, message_id long, parent_id long")
    assert sorted(r["up"] for r in chat.paths(chain).collect()) == list(range(37))


# --- all: clashing columns, null ids, repeated rows, empty tables


def test_every_operator_takes_clashing_columns_and_empty_tables(spark, clashing, empty, tmp_path):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for docs in (clashing, empty):
        n = docs.count()
        scored = lm_scoring.score(docs, lm_scoring.fit(docs), keep=docs.columns)
        assert scored.count() == n and scored.columns.count("n_tokens") == 1
        assert packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))).count() == n
        assert license_scan.scan(docs).count() == n
        assert quality_rules.repetition(docs).count() == n
        assert quality_classifier.classify(docs, quality_classifier.fit(docs, labels, F.lit(True))).count() == n
        assert decontaminate.contamination(docs.withColumn("doc_key", F.lit(1)), bench).columns.count("doc_key") == 1
        found = decontaminate.contamination(docs, bench)
        assert found.count() == n and found.where("contaminated").count() == (3 if n else 0)
        assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
        assert token_rollup.count_ids(docs, public_tokenizers.path("word_bpe_49k.json"), False).count() == n
        token_files.write(docs, str(tmp_path / f"ids{n}"), public_tokenizers.path("word_bpe_49k.json"))
        assert token_files.read(spark, str(tmp_path / f"ids{n}")).count() == n
        assert near_dedup.near_duplicates(docs).count() == n
    assert chat.conversations(chat.thread(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# --- op11


def test_sentence_pieces_are_the_librarys(spark, docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    odd = ["".join(rng.choice("  ▁▁ab\n\tÀé①ﬁ\0<s>語　.x") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    given = [(i, t) for i, t in enumerate(odd)] + [(None, "a b"), (None, None), (7, "a b"), (7, "a b"), (8, "y" * 30000), (9, " " * 3000 + "end")]
    df = docs.unionByName(spark.createDataFrame(given, docs.schema)).repartition(3)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or "")
    for block in (1 << 22, 300):
        ids = pieces.encode(df, path, keep=("doc_id", "text"), block=block)
        got, want = sorted(ids.collect(), key=key), sorted(df.collect(), key=key)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            expected = library.encode(w["text"] or "") + [library.eos_id()]
            assert (g["doc_id"], g["text"], g["ids"]) == (w["doc_id"], w["text"], expected)
        back = pieces.decode(ids.drop("text"), path).collect()
        assert sorted(r["text"] for r in back) == sorted(library.decode(r["ids"]) for r in got)
    assert pieces.encode(empty, path).count() == 0
    assert pieces.encode(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), path, end_id=False).where("size(ids) = 0").count() == 2


def test_each_distinct_chunk_is_segmented_once():
    import zstandard

    asked = []
    rows = [(part, zstandard.compress("\n".join(chunks).encode())) for part, chunks in ((1, ["▁a", "▁b"]), (1, ["▁b", "▁▁", "▁a"]), (2, ["c"]), (2, ["c", "▁d"]))]
    out = list(pieces.segmented(rows, lambda chunks: asked.extend(chunks) or [[len(c), 7] for c in chunks]))
    assert sorted(asked) == ["c", "▁a", "▁b", "▁d", "▁▁"]
    assert [pieces._unpacked(sizes).tolist() for sizes, _ in out] == [[2, 2], [2, 2, 2], [2], [2, 2]]
    assert [pieces._unpacked(ids).tolist() for _, ids in out] == [[2, 7, 2, 7], [2, 7, 2, 7, 2, 7], [1, 7], [1, 7, 2, 7]]
    for values in ([], [0], [255, 256], [1 << 24, 3, (1 << 32) - 1]):
        assert pieces._unpacked(pieces._packed(np.array(values, np.int64))).tolist() == values


# --- op12


def audit_by_hand(rows, least, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        having = Counter(t for x in terms if x[0] == lang for t in set(x[2]))
        kept = sorted(t for t, n in having.items() if n >= least)
        counts = {s: Counter(t for x in terms if x[:2] == (lang, s) for t in x[2] if having[t] >= least) for s in {x[1] for x in terms if x[0] == lang}}
        everywhere = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(o, sum(abs(share(c, t) - share(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            own = [(t, share(c, t) - share(everywhere, t)) for t in kept if c[t] and share(c, t) > share(everywhere, t)]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_source_audit_matches_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = ["alpha", "Beta", "élan", "Zéta", "x", "語語", "gamma"] + WORDS
    rows = [(" ".join(rng.choice(words[:rng.randint(2, 40)]) + rng.choice(["", ".", "7"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", "é", None])) for _ in range(300)]
    rows += [(None, "en", "silent"), ("", "fr", "only"), ("rare words here", "it", "a"), ("other words there", "it", "b")] + [rows[0]] * 20
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value int, term string").repartition(6)
    want = audit_by_hand(rows, 30, 5)
    assert sorted(map(tuple, source_audit.audit(df, top=5).collect())) == want
    monkeypatch.setattr(source_audit, "CELLS", 7)  # many small trees
    monkeypatch.setattr(source_audit, "HELD", 3)
    assert sorted(map(tuple, source_audit.audit(df, top=5).collect())) == want
    assert source_audit.audit(df.limit(0)).count() == 0


def test_tree_corrections_count_shared_paths():
    rng = np.random.default_rng(2)
    paths = sorted({(int(rng.integers(2)), tuple((s, int(rng.integers(3, 6))) for s in range(5) if rng.random() < 0.7)) for _ in range(200)})
    zero = {(k, s): 1 + k + s for k in range(2) for s in range(5)}
    times = rng.integers(1, 9, len(paths))
    want = Counter()
    for (k, path), n in zip(paths, times):
        for j, (b, pb) in enumerate(path):
            for a, pa_ in path[:j]:
                za, zb = zero[k, a], zero[k, b]
                want[k, a, b] += int(n) * (abs(pa_ - pb) - abs(pa_ - zb) - abs(za - pb) + abs(za - zb))
    cells = [(k, s, p) for k, path in paths for s, p in path]
    first = np.concatenate([[0], np.cumsum([len(path) for _, path in paths])])
    got = source_audit.pair_corrections(np.array([k for k, _ in paths]), first, np.array([s for _, s, _ in cells]), np.array([p for *_, p in cells]), np.array([zero[k, s] for k, s, _ in cells]), times)
    assert {(k, a, b): v for k, a, b, v in zip(*map(np.ndarray.tolist, got)) if v} == {k: v for k, v in want.items() if v}


# --- op13


def test_rank_index_is_exact_and_bounded():
    rng = np.random.default_rng(4)
    for n in (1, 2, 257, 5000):
        offsets = np.concatenate([[0], np.cumsum(np.repeat(rng.integers(1, 5, n // 50 + 1), 50))])[:n].astype(np.int64)
        for error in (1, 3, 100):
            index = fill_middle.RankIndex(offsets, error)
            assert (index.offsets(np.arange(n)) == offsets).all()
            assert np.abs(index.residual).max() <= error + 1
    even = fill_middle.RankIndex(np.arange(100_000))
    assert len(even.first) == 1 and not even.residual.any()


def test_fill_in_middle_matches_the_rule(spark, docs, clashing, empty):
    texts = [t for _, t in corpus()] + ["a <P> b", "<M>", "<", "<S", "P><S", "語" * 5000 + "x" * 5000] + ["é<" * k for k in range(60)]
    given = [(i, t) for i, t in enumerate(texts)] + [(3, "twice é"), (3, "twice é"), (None, "no id")]
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("form", F.lit(1)).repartition(3)
    out = fill_middle.fill_in_middle(df.withColumn("asked", F.col("text")))
    got = out.withColumn("restored", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(given)
    forms = Counter()
    for r in got:
        text = r["asked"] or ""
        digest = hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
        a, b = sorted(x % (len(text) + 1) for x in h[:2])
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want = ("plain", None, None, text)
        elif h[3] % 100 < 20:
            want = ("spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
        else:
            want = ("psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (len(text), *want)
        assert r["restored"] == text
        forms[r["form"]] += 1
    assert set(forms) == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(empty).count() == 0
    assert fill_middle.fill_in_middle(clashing).columns == ["doc_id", "label", "n_words", "score", "kept", *fill_middle.COLUMNS]
