"""The corpus operators against brute force, on documents with every edge case: nulls, empty and very long texts, ties, repeated rows, odd columns."""

import functools
import gzip
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import types
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tellurion.llm import common, fingerprints, language, line_dedup, lm_score, neighbours, ngram_join, packing, sentencepiece_codec, toxicity, warc
from tellurion.llm.queries import RANKS, TOKENIZER, oracle_sql, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(3)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "Lambda", "MU", "nü", "xi,", "omicron."]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@functools.cache
def cases():
    base = prose(120)
    words = base.split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in (3, 60, 119)]
    far = " ".join(words[:80]) + " " + prose(40)
    texts = [None, "", "   \t\n ", "one", "two words", "same three words", "same three words", base, base, *near, far, prose(6000), "x" * 50_000, "é́ 　 ü\x1cß", base.upper()]
    texts += [prose(RNG.randrange(4, 60)) + "\n" + prose(20) + "\n\nshared line that many have, word for word\n" + prose(5) for _ in range(20)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, base, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- common


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_word_hashes_tell_words_apart_wherever_they_stand(monkeypatch, chunk):
    monkeypatch.setattr(common, "_CHUNK", chunk)
    texts = [t for _, t, *_ in cases()]
    h, at = common.word_hashes(pa.array(texts))
    seen, i = {}, 0
    for n, t in zip(np.diff(at), texts, strict=True):
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        assert n == len(words)
        for w in words:
            assert seen.setdefault(w, h[i]) == h[i]
            i += 1
    assert len(set(seen.values())) == len(seen)


def test_components_join_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 150)}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- 1 toxicity


def test_toxicity_learns_words_and_their_beginnings(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(30, rng) + (" idiotic" + rng.choice(["", "s", "ly", "ness"]) if bad else "") + " " + prose(10, rng)
        rows.append((i, text))
        labels.append((i, int(bad)))
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")  # noqa: E741
    model = toxicity.fit(d, l.where("doc_id < 300"))
    got = toxicity.score(d, model, ["doc_id"]).where("doc_id >= 300").collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) == bool(r["predicted"]) for r in got)
    new = spark.createDataFrame([(1, "idiotico x"), (2, None), (3, "")], "doc_id long, text string")
    odd = {r["doc_id"]: r["score"] for r in toxicity.score(new, model, ["doc_id"]).collect()}
    assert odd[1] > 0.5 and odd[2] == odd[3] < 0.5


def test_toxicity_without_labels_or_rows(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, empty)
    assert {r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()} == {0.5}
    assert toxicity.score(none, model, ["doc_id"]).count() == 0


def test_ftrl_leaves_useless_features_at_zero():
    x = [np.array([1, 5] if i % 2 else [2, 5]) for i in range(200)]
    index, weight, _ = toxicity.fit_ftrl(x, np.array([i % 2 for i in range(200)], float), bits=4)
    w = dict(zip(index.tolist(), weight.tolist(), strict=True))
    assert w[1] > 0 > w.get(2, -1) and set(w) <= {1, 2, 5}


def test_ftrl_follows_its_rule_coordinate_by_coordinate():
    rng = np.random.default_rng(4)
    x = [np.unique(rng.integers(0, 40, rng.integers(0, 9))) for _ in range(150)]
    y = rng.integers(0, 2, 150).astype(float)
    index, weight, bias = toxicity.fit_ftrl(x, y, bits=6)
    a, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n = defaultdict(float), defaultdict(float)

    def weight_of(k):
        bound = 0.0 if k == "bias" else l1
        return 0.0 if abs(z[k]) <= bound else -(z[k] - math.copysign(bound, z[k])) / ((beta + math.sqrt(n[k])) / a + l2)

    for epoch in range(toxicity.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(150):
            w = {k: weight_of(k) for k in [*x[i].tolist(), "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[i]
            for k in w:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / a * w[k]
                n[k] += g * g
    want = {k: weight_of(k) for k in range(40) if weight_of(k)}
    assert dict(zip(index.tolist(), weight.tolist(), strict=True)) == pytest.approx(want, rel=1e-3, abs=1e-4)
    assert bias == pytest.approx(weight_of("bias"), rel=1e-3, abs=1e-5)


def test_toxicity_learns_from_no_more_than_it_may_hold(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(500)) + (" idiot" if i % 2 else "")) for i in range(60)]
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")  # noqa: E741
    full = toxicity.fit(d, l)
    one = toxicity.fit(d, l, train_bytes=1)
    assert len(full[0]) > 0 and not np.array_equal(full[0], one[0])
    assert toxicity.score(d, one, ["doc_id"]).count() == 60


def test_toxicity_holds_the_features_of_little_text_at_once():
    import tracemalloc

    rng = random.Random(3)
    texts = [prose(400, rng) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array([0] * 1500, pa.int32()), pa.array(texts)], names=["rank", "y", "text"])
    tracemalloc.start()
    rows = [x for b in toxicity._examples([batch]) for x in b.column("x").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1] - sum(map(len, rows))
    tracemalloc.stop()
    assert peak < 48 << 20
    for text, x in zip(texts[::100], rows[::100], strict=True):
        assert np.array_equal(np.frombuffer(x, np.int32), np.unique(toxicity.features(pa.array([text]))[1]))


def test_a_worker_forgets_what_other_operators_remember():
    own, other = common.remembered("tests.own"), common.remembered("tests.other")
    own["a"] = other["a"] = packing._encoders["a", 1] = 1

    def f(batches):
        yield from batches

    f.__module__ = "tests.own"
    assert list(common.tidy(f)([1, 2])) == [1, 2]
    assert own and not other and not packing._encoders and packing._encoders is common.remembered(packing.__name__)


# ---------------------------------------------------------------- 2 sentencepiece


def test_sentencepiece_parity_and_round_trip(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    judge = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_codec.encode(docs, path, with_ids=True).collect()
    assert len(got) == docs.count() and all(r["parity"] and r["round_trip"] for r in got)
    texts = {i: t for i, t, *_ in cases() if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert r["ids"] == judge.encode(texts[r["doc_id"]] or "") and r["decoded"] == (texts[r["doc_id"]] or "")
    assert sentencepiece_codec.encode(none, path).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  two  spaces ", "a▁b", "tab\tline\n\n", "<s>x</s><0x41><unk>", "日本語 🎉 é", "\x00\x1f"])
def test_sentencepiece_words_are_as_the_whole(text):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec = sentencepiece_codec.Codec.of(path)
    ids, good = codec.encode([text.encode()])
    assert ids[0].tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(text) and good.all()
    if text:
        assert codec.tokenizer.encode(text, add_special_tokens=False).ids == ids[0].tolist()


def test_sentencepiece_table_holds_bytes_not_words(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(sentencepiece_codec, "CACHE_BYTES", 300_000)
    with open(path, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    judge = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh中文字🎉<>") for _ in range(60_000)) for _ in range(8)] + [prose(300, rng) + "  x " for _ in range(200)] + [" ", "  ", "a  b", "a ", " a"]
    for t in [*texts, *texts[:3]]:
        ids, good = codec.encode([t.encode()])
        assert ids[0].tolist() == judge.encode(t) and good.all()
        assert codec.table.cost[-1] < 300_000 + 400_000  # never over by more than a text


def test_sentencepiece_unigram_model_is_rebuilt():
    m = sentencepiece_codec.Model([("<unk>", 0.0, 2), ("▁ab", -1.0, 1), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]], sentencepiece_codec.UNIGRAM, True, b"", True, False, True)
    t = sentencepiece_codec.build(m)
    assert t.encode("ab c", add_special_tokens=False).tokens == ["▁ab", "▁", "<0x63>"]
    with pytest.raises(ValueError):
        sentencepiece_codec.build(sentencepiece_codec.Model(kind=4))


# ---------------------------------------------------------------- 3 n-gram join


def brute_components(rows, n, percent):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    items = [(i, grams(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in items if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a, (i, s) in enumerate(items):
        for j, t in items[a + 1 :]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in items if i is not None}, links


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_join_is_exact_on_edge_cases(docs, n, percent):
    want, _ = brute_components(cases(), n, percent)
    got = ngram_join.join(docs, n, percent).collect()
    assert len(got) == len(cases())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_links"] == 0
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


@pytest.mark.parametrize("block", [4, 256])
def test_join_is_exact_on_a_chain_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(5)
    words = prose(150, rng).split()
    rows = []
    for i in range(60):  # each a few words from the one before: the ends are far apart
        words = list(words)
        for _ in range(2):
            words[rng.randrange(150)] = f"new{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(100, rng)) for i in range(20)]
    want, links = brute_components(rows, 4, 85)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == {i: (*want[i], links[i]) for i in want}


@pytest.mark.parametrize("cells", [4, 20])
def test_join_is_exact_whatever_the_order(spark, monkeypatch, cells):
    monkeypatch.setattr(ngram_join, "LEAST_CELL_BITS", cells)
    monkeypatch.setattr(ngram_join, "MOST_CELL_BITS", max(6, cells))
    rng = random.Random(15)
    shared = prose(30, rng)  # a passage that every document has
    rows = []
    for i in range(60):
        own = prose(60, rng).split()
        rows += [(10 * i, shared + " " + " ".join(own)), (10 * i + 1, shared + " " + " ".join(own[:-1] + ["x"])), (10 * i + 2, " ".join(own[:30]) + " " + shared)]
    want, links = brute_components(rows, 4, 85)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == {i: (*want[i], links[i]) for i in want}


def test_join_writes_less_than_the_texts_with_a_full_table(spark, monkeypatch):
    """Where the table no longer tells n-grams that come once, those of documents that meet no other aren't written."""
    from pathlib import Path

    from tellurion.sources import shared

    monkeypatch.setattr(ngram_join, "LEAST_CELL_BITS", 6)
    monkeypatch.setattr(ngram_join, "MOST_CELL_BITS", 6)
    stash, written = ngram_join.stash, []

    def measured(df):
        out = stash(df)
        path = Path(shared._paths[out].removeprefix("file:"))
        written.append(sum(f.stat().st_size for f in path.glob("*.parquet")))
        return out

    monkeypatch.setattr(ngram_join, "stash", measured)
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.randrange(10**6)}" for _ in range(2000))) for i in range(300)]
    rows.append((300, rows[7][1] + " end"))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 7 if i == 300 else i for i in range(301)}
    assert sum(written) < sum(len(t) for _, t in rows)


def test_fragments_of_the_order_hold_alike_many_grams():
    rng = np.random.default_rng(1)
    table = np.minimum(255, 1 + 8 * np.log2(1 + rng.pareto(1.0, 1 << 16))).astype(np.uint8)
    bounds = ngram_join.order_bounds(table)
    weight = 2.0 ** ((table - 1) / 8)
    place = np.searchsorted(bounds, table.astype(np.uint64) << np.uint64(56) | rng.integers(0, 1 << 56, len(table)).astype(np.uint64))
    share = np.bincount(place, weight, minlength=ngram_join.FRAGMENTS) / weight.sum()
    assert len(share) == ngram_join.FRAGMENTS and share.max() < 0.4 and share.min() > 0.1


def test_join_of_nothing(none):
    assert ngram_join.join(none).count() == 0


# ---------------------------------------------------------------- 4 WARC


def test_warc_round_trip(spark):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://b.example/x?q=1", big), (9, "http://a.example/", big), (5, None, big), (2, "http://a.example/", "small"), (3, "http://a.example/", "small"), (4, "not a url\n", None), (None, "", big), (9, "http://a.example/", big), (6, "http://[bad", "z" * 1000), (7, "u", "z" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("capture_ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))).withColumn("bytes", F.lit("clash"))
    got = warc.archive(pages).orderBy("range_id", "position").collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for p, _, h in rows if p == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha1(html).hexdigest())
        same_big = html == big.encode()
        assert r["record_type"] == ("revisit" if same_big and r["page_id"] != 9 else "response")
        assert r["refers_to"] == (9 if r["record_type"] == "revisit" else None)
    keys = [(r["url_key"], r["capture_ts"]) for r in got]
    assert keys == sorted(keys)
    assert warc.archive(pages.limit(0)).count() == 0


def test_loser_tree_merges_any_runs():
    rng = random.Random(2)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_broken_archive_is_refused():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabcdef"))
    assert gzip.decompress(gzip.compress(b"")) == b""


# ---------------------------------------------------------------- 5 packing


def check_packing(rows, got, context=4096, tokenizer=TOKENIZER):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by.pop(i), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= context and at & (at - 1) == 0  # full, or a power of two


def test_packing_loses_and_pads_nothing(spark, docs, none):
    rows = [(i, t) for i, t, *_ in cases() if i is not None]
    once = list(dict(rows).items())
    check_packing(once, packing.pack(spark.createDataFrame(once, "doc_id long, text string").repartition(2), TOKENIZER).collect())
    check_packing(once, packing.pack(spark.createDataFrame(once, "doc_id long, text string"), TOKENIZER, remember=50).collect())
    assert packing.pack(docs, TOKENIZER).agg(F.sum("length")).first()[0] > 0
    assert packing.pack(none, TOKENIZER).count() == 0


def test_packing_with_a_vocabulary_that_keeps_white_space(spark):
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.WordEncoder.of(TOKENIZER).by_word and not packing.WordEncoder.of(other).by_word
    rows = [(0, None), (1, "  two  spaces\n\tand Lines "), (2, prose(900)), (3, "中" * 5000 + " x"), (4, "y" * 9000)]
    check_packing(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), other).collect(), tokenizer=other)


def test_packing_table_holds_bytes_not_words():
    encoder = packing.WordEncoder(TOKENIZER, 200_000)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh中文字") for _ in range(30_000)) for _ in range(12)]
    ids, at = encoder.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2]]
    for t in texts:
        encoder.encode(pa.array([t]))
    assert encoder.table.cost[-1] < 600_000


def test_packer_fills_windows_of_every_tier():
    p = packing.Packer(64, (8, 16, 32, 64))
    rng = random.Random(4)
    sizes = [rng.choice([1, 3, 7, 9, 20, 33, 64, 200]) for _ in range(300)]
    for i, n in enumerate(sizes):
        p.add(i, n)
        if i % 50 == 0:
            p.pack()
    p.pack()
    p.finish()
    lengths = [sum(x[2] for x in w) for w in p.sequences]
    assert sum(lengths) == sum(sizes) and all(n & (n - 1) == 0 and n <= 64 for n in lengths) and {8, 16, 32, 64} <= set(lengths)


@pytest.mark.parametrize("flushes", [1, 6, 40])
def test_steps_have_as_many_tokens(flushes):
    rng = random.Random(7)
    steps, held = packing.Steps(), Counter()
    for _ in range(flushes):
        sizes = [rng.choice([512, 512, 1024, 2048, 4096, 4096]) for _ in range(37)]
        for g, n in zip(steps.deal(sizes), sizes, strict=True):
            held[g] += n
    assert max(held.values()) <= packing.STEP_TOKENS and sum(n < packing.STEP_TOKENS for n in held.values()) <= 4
    assert sorted(held) == list(range(len(held)))


# ---------------------------------------------------------------- 6 language


def test_language_held_out(spark):
    from tellurion.llm.common import crc_mod

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = language.fit(d.where(crc_mod("doc_id", 4) != 2))
    got = language.predict(d.where(crc_mod("doc_id", 4) == 2), trees, ["doc_id", "lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(got)


def test_language_edge_cases(spark, docs, none):
    rows = [(i, "the cat and the dog are here " * 3, "en") for i in range(40)] + [(100 + i, "le chat et le chien sont là " * 3, "fr") for i in range(40)]
    trees = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!! …"), (4, "the dog"), (5, "le chien"), (6, "日本")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, trees, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] == "fr" and got[6][0] in ("en", "fr")
    empty = language.fit(none)
    assert {r["lang_pred"] for r in language.predict(docs, empty, ["doc_id"]).collect()} == {"und"}


def test_code_lengths_are_those_of_the_escape_rule(spark):
    rng = random.Random(8)
    rows = [(i, lang, " ".join(rng.choice(words) + rng.choice(["", "s", "é", "!"]) for _ in range(rng.randrange(1, 90)))) for i in range(30) for lang, words in (("en", WORDS), ("fr", WORDS[:5] + ["là", "chat"]))]
    rows += [(100, "en", "once"), (101, "fr", ""), (102, "en", "q")]
    trees = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    folded = lambda t: bytes(language.fold(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0])
    texts = [prose(40, rng), "zzz once là", "", "q", *[t for _, _, t in rows[:6]], "中文 chat"]
    bits, size = trees.lengths(pa.array(texts))
    assert size.tolist() == [max(0, len(folded(t)) - 1) for t in texts]
    for li, lang in enumerate(trees.langs):
        counts = [defaultdict(Counter) for _ in range(language.MAX_ORDER + 1)]
        for raw in (folded(t) for _, x, t in rows if x == lang):
            for k in range(language.MAX_ORDER + 1):
                for i in range(k, len(raw)):
                    counts[k][raw[i - k : i]][raw[i]] += 1
        want = [sum(escape_cost(counts, raw[:i], raw[i]) for i in range(1, len(raw))) for raw in map(folded, texts)]
        assert bits[:, li] == pytest.approx(want, abs=1e-2)


def escape_cost(counts, past, s):
    def cost(past, s):
        bits = 0.0
        for k in range(min(len(past), language.MAX_ORDER), -1, -1):
            seen = counts[k].get(past[len(past) - k :])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if s in seen:
                return bits - math.log2(seen[s] / total)
            bits -= math.log2(len(seen) / total)
        return bits + 8

    return cost(past, s)


# ---------------------------------------------------------------- 7 fingerprints


def test_fingerprints_of_edited_texts(docs, none, spark):
    rows = [(i, t or "") for i, t in dict((i, t) for i, t, *_ in cases() if i is not None).items()]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(d).collect()}
    order = sorted(dict(rows), reverse=True)
    texts = dict(rows)
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and got[i]["near_next"] == pytest.approx(np.mean([a == b for a, b in zip(re.findall("....", got[i]["fingerprint"]), re.findall("....", got[order[(k + 1) % len(order)]]["fingerprint"]), strict=True)]))
    assert got[7]["fingerprint"] == got[8]["fingerprint"] != got[13]["fingerprint"]
    assert fingerprints.fingerprint(docs).count() == len(cases()) and fingerprints.fingerprint(none).count() == 0


def test_collisions_follow_generalised_jaccard():
    rng = random.Random(9)
    errors = []
    for _ in range(60):
        a = [rng.choice(WORDS) for _ in range(rng.randrange(5, 200))]
        b = a[: rng.randrange(len(a))] + [rng.choice(WORDS) for _ in range(20)]
        x, y = Counter(w.lower() for w in a), Counter(w.lower() for w in b)
        true = sum((x & y).values()) / sum((x | y).values())
        s = fingerprints.signatures(pa.array([" ".join(a), " ".join(b)]))
        errors.append(float(fingerprints.likeness(s[:1], s[1:])[0]) - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_collisions_of_documents_with_tens_of_thousands_of_words():
    # 50 common words carry a third of the weight, and a quarter of the rare ones are shared
    errors = []
    for trial in range(4):
        common = [f"c{trial}x{i}" for i in range(50) for _ in range(400)]
        a = common + [f"r{trial}x{i}" for i in range(40_000)]
        b = common + [f"r{trial}x{i}" for i in range(24_000, 64_000)]
        true = 36_000 / 84_000
        s = fingerprints.signatures(pa.array([" ".join(a), " ".join(b)]))
        errors.append(float(fingerprints.likeness(s[:1], s[1:])[0]) - true)
    assert abs(np.mean(errors)) < 0.08


# ---------------------------------------------------------------- 8 lines


def brute_lines(rows):
    places = defaultdict(list)
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                places[line.strip(" \t\r\x0b\x0c")].append((i, n))
    names = list(places)
    low = ["".join(c.lower() if c.isascii() else c for c in n) for n in names]
    sets = [{z[i : i + 6] for i in range(len(z) - 5)} if len(z) >= 6 else {z} for z in low]
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i, n in enumerate(names):
        classes[find(i)] += places[n]
    gone = defaultdict(set)
    for v in classes.values():
        keep = min(v)
        for i, n in v:
            if (i, n) != keep:
                gone[i].add(n)
    return gone


def test_lines_that_resemble_one_before_them_go(spark, docs, none):
    rng = random.Random(12)
    line = "a rather long line of ordinary words that is repeated with small changes over and over"
    edit = lambda: "".join(c if rng.random() > 0.01 else rng.choice("xyz") for c in line)
    rows = [(i, "\n".join([prose(12, rng), edit(), "", "ab", "  tail\t", edit().upper()])) for i in range(40)] + [(100, None), (101, ""), (102, "\n\n")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1)).withColumn("line_no", F.lit(1)).repartition(3)
    want = brute_lines(rows)
    texts = dict(rows)
    got = line_dedup.dedup(d).collect()
    assert len(got) == len(rows)
    missed = 0
    for r in got:
        missed += len(want[r["doc_id"]] ^ set(r["removed_lines"]))
        lines = (texts[r["doc_id"]] or "").split("\n")
        assert r["n_lines"] == len(lines) and r["n_kept"] == len(lines) - len(r["removed_lines"])
        if texts[r["doc_id"]] is not None:
            assert r["text"] == "\n".join(x for n, x in enumerate(lines) if n not in set(r["removed_lines"]))
    assert missed <= 2  # banding finds a pair of similarity 0.8 with probability 0.998
    assert {r["doc_id"]: r["removed_lines"] for r in line_dedup.report(d).collect()} == {r["doc_id"]: r["removed_lines"] for r in got}
    assert line_dedup.dedup(docs).count() == len(cases()) and line_dedup.dedup(none).count() == 0


def test_texts_of_fewer_characters_than_a_shingle(spark):
    assert [x.tolist() for x in line_dedup._shingle_sets([b"ab"])[:2]][1] == [1] and line_dedup.band_keys([b"ab"]).shape == (1, line_dedup.BANDS)
    d = spark.createDataFrame([(1, "ab"), (2, " ab\t")], "doc_id long, text string")
    assert {r["doc_id"]: r["removed_lines"] for r in line_dedup.report(d).collect()} == {1: [], 2: [0]}


def test_few_lines_are_compared_with_two_hashes_a_shingle(monkeypatch):
    rng, done = random.Random(5), []
    texts = [(prose(12, rng) + " ab").encode() for _ in range(60)]
    texts = [x for t in texts for x in (t, t + b" c")]
    monkeypatch.setattr(line_dedup, "mix", lambda h: done.append(len(h)) or common.mix(h))
    i, j = line_dedup._few_links(texts, np.arange(120) // 4, np.arange(120) % 4 == 0)
    assert {(a, a + 1) for a in range(0, 120, 4)} <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert sum(done) < 2.2 * sum(len(t) for t in texts)


# ---------------------------------------------------------------- 9 language model


@pytest.fixture(scope="module")
def scored(docs):
    return lm_score.score(docs, RANKS).collect()


def test_base_score_is_exact(scored):
    rows = [(i, [w.lower() for w in (t or "").encode().split()] + [0]) for i, t, *_ in cases()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in rows if not held(i) for w in ws)
    total, distinct = sum(c.values()), len(c)
    want = sorted((i is not None, i or 0, held(i), len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws), 6)) for i, ws in rows)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored)
    assert got == want


def test_model_scores_are_log_probabilities(scored, none):
    assert all(r["score"] < 0 for r in scored)
    long = max(scored, key=lambda r: r["n_tokens"])
    assert long["score"] < min(r["score"] for r in scored if r["n_tokens"] < 5)
    assert lm_score.score(none, RANKS).count() == 0


def test_windows_score_each_id_once_and_sum_to_one(monkeypatch):
    counts = np.array([5, 3, 2, 7, 1, 1, 4, 2] * 20)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, len(counts), 900).astype(np.int32)
    m = lm_score.Model(counts, ids, np.array([0, 300, 900]))
    at = np.array([0, 0, 1, 70, 500])
    _, target, doc = m.windows(ids[:500], at)
    assert [(target[doc == d] >= 0).sum() for d in range(4)] == [0, 1, 69, 430]
    ends = [m.score(np.array([*ids[:40], x], np.int32), np.array([0, 41]))[0] for x in range(len(counts))]
    start = m.score(ids[:40], np.array([0, 40]))[0]
    assert sum(10 ** (e - start) for e in ends) == pytest.approx(1, abs=1e-3)


def test_the_model_learns_from_documents_outside_its_first_sample(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FIT_ROWS", 20)
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("red", "blue", "north", "salt", "iron", "cold", "high", "deep") for b in ("", " river", " stone", " wind")]
    words = sorted({w for x in words for w in x.split()})
    first = lambda d: d.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(20 / 600 * (1 << 30)) + 1)
    few = {r["doc_id"] for r in first(spark.range(600).withColumnRenamed("id", "doc_id")).collect()}
    texts = [rng.sample(words, len(words)) * 8 for _ in range(600)]
    ordered = lambda i, t: t if i in few else sorted(t[: len(words)]) * 8
    models = []
    for change in (lambda i, t: t, ordered):
        d = spark.createDataFrame([(i, " " + " ".join(change(i, t))) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
        assert first(d).count() == len(few) < 60
        models.append(lm_score.fit(d, RANKS))
    ids, at = lm_score.Subwords.of(RANKS).encode(pa.array([" " + " ".join(sorted(words) * 8)]))
    assert models[1].score(ids, at)[0] > models[0].score(ids, at)[0] + 0.05 * len(ids)
    assert (models[0].row == models[1].row).sum() > 0.9 * len(models[0].row)


def test_the_model_tells_256_classes_apart():
    counts = np.full(600, 3)
    m = lm_score.Model(counts, np.zeros(0, np.int32), np.zeros(1, np.int64))
    assert len(np.unique(m.kind)) == len(m.p["b"]) == 256


def test_scores_are_those_of_attention_place_by_place():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 9, 700)
    ids, at = rng.integers(0, 700, 400).astype(np.int32), np.array([0, 150, 151, 400])
    m = lm_score.Model(counts, ids, at)
    p = {k: v.astype(float) for k, v in m.p.items()}

    def naive(text):
        rows, total = [m.begin, *m.row[text].tolist()], 0.0
        for i, x in enumerate(text.tolist()):
            past = range(max(0, i - lm_score.SPAN), i + 1)
            w = np.array([math.exp(min(30, p["q"][rows[i]] @ p["k"][rows[j]] / 4 + p["d"][i - j])) for j in past])
            h = p["x"][rows[i]] + (w / w.sum()) @ np.array([p["v"][rows[j]] for j in past])
            kind = m.kind[x]
            g = m.group[kind]
            a, b = m.edges[g], m.edges[g + 1]
            total += sum(z[k] - math.log(np.exp(z).sum()) for z, k in ((h @ p["go"] + p["gb"], g), (h @ p["o"][:, a:b] + p["b"][a:b], kind - a)))
            total += math.log((counts[x] + 0.5) / (counts + 0.5)[m.kind == kind].sum())
        return total / math.log(10)

    assert m.score(ids, at) == pytest.approx([naive(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], rel=1e-4)


def test_gradients_are_slopes_and_places_meet_twice_the_span():
    rng = np.random.default_rng(6)
    counts = rng.integers(1, 9, 700)
    ids, at = rng.integers(0, 700, 130).astype(np.int32), np.array([0, 5, 75, 130])
    m = lm_score.Model(counts, np.zeros(0, np.int32), np.zeros(1, np.int64))
    m.p = {k: v.astype(float) + rng.normal(0, 0.1, v.shape) for k, v in m.p.items()}
    rows, target, _ = m.windows(ids, at)
    assert m._attend(rows, True)[4].size == rows.shape[0] * lm_score.STRIDE * 2 * lm_score.SPAN

    def loss():
        order, kind, ends = m._sorted(target.reshape(-1))
        return -m._logs(m._attend(rows, True)[-1], order, kind, ends)[1].sum() / len(order)

    for name, g in m._gradient(rows, target).items():
        flat, some = m.p[name].reshape(-1), np.argsort(-np.abs(g.reshape(-1)))[:12:3]
        for i in some:
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert (up - down) / 2e-5 == pytest.approx(g.reshape(-1)[i], rel=1e-3)


def test_subwords_of_very_long_runs():
    encoder = lm_score.Subwords.of(RANKS)
    texts = [" " * 5_000_000, "\n" * 3_000_000 + "x", "\t" * 1_000_000, "中" * 300_000, "ab" * 500_000, "", "A plain text,  with spaces"]
    ids, at = encoder.encode(pa.array(texts))
    assert [x.as_py().decode() for x in encoder.decode(ids, at)] == [t.lower() for t in texts]
    assert ids[at[-2] : -1].tolist() == encoder.encoding.encode_ordinary(texts[-1].lower())


def test_subwords_looked_up_are_those_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(lm_score, "_MOST", 40)
    encoder, rng = lm_score.Subwords(RANKS), random.Random(8)
    some = [*"ab Z  \n\t.,'12é中😀", "'s", " a", " be", "  ", "\r\n", "\x0b", "\x1c", "\u00a0", "\u0085", "\u1680", "\u2003", "\u3000", "\u200b", "ß", " É"]
    for _ in range(60):
        texts = ["".join(rng.choices(some, k=rng.randint(0, 80))) for _ in range(40)]
        ids, at = encoder.encode(pa.array(texts))
        plain = [encoder.encoding.encode_ordinary(t.encode().lower().decode()) for t in texts]
        assert [ids[a : b - 1].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == plain and (ids[at[1:] - 1] == encoder.end).all()


def test_a_word_that_comes_again_is_not_encoded_again():
    encoder, done = lm_score.Subwords(RANKS), []
    plain = encoder.encoding
    encoder.encoding = types.SimpleNamespace(encode_ordinary=lambda t: done.append(len(t)) or plain.encode_ordinary(t))
    text = "Some words, " + "and others " * 500
    first, second = (encoder.encode(pa.array([text])) for _ in range(2))
    assert first[0].tolist() == second[0].tolist() == [*plain.encode_ordinary(text.lower()), encoder.end]
    assert sum(done) < 50


def test_a_learning_process_does_not_take_its_memory_anew():
    code = """
import resource
import numpy as np
from tellurion.llm import common, lm_score
rng = np.random.default_rng(3)
ids, at = rng.integers(0, 900, 120_000).astype(np.int32), np.arange(0, 120_001, 400)
m = lm_score.Model(np.full(900, 9), np.zeros(0, np.int32), np.zeros(1, np.int64))
pages = []
def task(batches):
    for _ in batches:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        m.learn(ids, at, rng, 1, 0.01, 0.01)
        pages.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
        yield None
list(common.roomy(task)(range(4)))
print(max(pages[1:]))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True, env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert int(done.stdout) < 1000


def test_softmaxes_run_along_places():
    counts = np.random.default_rng(4).integers(1, 9, 900)
    rng = np.random.default_rng(5)
    ids, at = rng.integers(0, 900, 3000).astype(np.int32), np.array([0, 1000, 3000])
    m = lm_score.Model(counts, ids, at)
    rows, target, _ = m.windows(ids, at)
    order, kind, ends = m._sorted(target.reshape(-1))
    h = m._attend(rows)[-1]
    hs, top, z, inner = m._logs(h, order, kind, ends, True)
    assert z.shape == (len(m.edges) - 1, len(order)) and z.flags.c_contiguous
    want = hs @ m.p["go"] + m.p["gb"]
    want = np.exp(want - np.log(np.exp(want).sum(1))[:, None])
    own = np.log(want[np.arange(len(order)), m.group[kind]])
    want[np.arange(len(order)), m.group[kind]] -= 1
    assert np.allclose(z.T, want, atol=1e-5)
    for where, of, y in inner:
        assert y.shape == (of.stop - of.start, where.stop - where.start) and y.flags.c_contiguous
        want = hs[where] @ m.p["o"][:, of] + m.p["b"][of]
        want = np.exp(want - np.log(np.exp(want).sum(1))[:, None])
        place = np.arange(where.stop - where.start), kind[where] - of.start
        own[where] += np.log(want[place])
        want[place] -= 1
        assert np.allclose(y.T, want, atol=1e-5)
    assert np.allclose(top, own, atol=1e-4) and np.allclose(m._logs(h, order, kind, ends)[1], top, atol=1e-6)


def test_a_group_of_one_class_is_certain():
    counts = np.full(600, 3)
    m = lm_score.Model(counts, np.zeros(0, np.int32), np.zeros(1, np.int64))
    m.edges = np.array([0, 1, 1, 250, 256])  # groups of one class, of none and of many
    m.group = np.repeat(np.arange(4), np.diff(m.edges))
    m.group_of = m.group[m.kind].astype(np.uint8)
    m.p |= {"go": m.p["go"][:, :4], "gb": m.p["gb"][:4], "b": np.where(np.arange(256) == 0, 0, m.p["b"]).astype(np.float32)}
    h = np.random.default_rng(6).normal(0, 90, (600, lm_score.DIM)).astype(np.float32)
    order, kind, ends = m._sorted(np.arange(600, dtype=np.int32))
    _, top, z, inner = m._logs(h, order, kind, ends, True)
    some = inner[0][0]
    assert inner[0][1] == slice(0, 1) and (inner[0][2] == 0).all() and np.isfinite(top).all() and np.isfinite(z).all()
    assert np.allclose(np.exp(top[some]), z[0, some] + 1, atol=1e-5)


def test_bytes_are_classed_as_by_look_up():
    x = np.arange(256, dtype=np.uint8)
    ink = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xC3 <= b <= 0xDF or 0xE4 <= b <= 0xF4]
    assert (common.lower(x) == common.LOWER).all() and (common.space(x) == common.SPACE).all() and np.flatnonzero(lm_score._ink(x)).tolist() == ink


def test_gradient_is_that_of_the_loss():
    counts = np.full(80, 3)
    rng = np.random.default_rng(1)
    ids, at = rng.integers(0, 80, 120).astype(np.int32), np.array([0, 50, 120])
    m = lm_score.Model(counts, np.zeros(0, np.int32), np.zeros(1, np.int64))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rows, target, _ = m.windows(ids, at)

    def loss():
        h = m._attend(rows)[-1]
        return -m._logs(h, *m._sorted(target.reshape(-1)))[1].mean()

    g = m._gradient(rows, target)
    for name in m.p:
        flat = m.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g[name].reshape(-1)))[:3]:
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-4, rel=0.03, abs=2e-5)


# ---------------------------------------------------------------- 10 neighbours


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[50:200] = x[50]  # one vector many times
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1100, []), (1200, [0.0] * 16), (1300, [float("nan")] * 16), (1400, [float("inf")] * 16), (1500, [None, *[1.0] * 15]), (None, [1.0] * 16), (1600, [1.0] * 3)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("ids", F.lit(1)).repartition(3)
    got = defaultdict(dict)
    for r in neighbours.search(d, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]][r["rank"]] = (r["score"], r["vec_id"])
    y = np.array([v for _, v in rows], np.float64)
    hit = 0
    assert set(got) == {i for i in range(0, 600, 100)}
    for q, found in got.items():
        dist = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = sorted((dist[i], i) for i in range(600) if i != q)[:10]
        assert sorted(found) == list(range(1, 11)) and all(s == dist[i] for s, i in found.values())
        hit += len({i for _, i in want} & {i for _, i in found.values()})
    assert hit >= 0.9 * 60
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert neighbours.search(few, F.col("vec_id") == 0).count() == 3
    assert neighbours.search(few.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize(("spread", "most"), [(0.0, 0.45), (3.0, 0.12)])
def test_the_radius_follows_the_structure_of_the_vectors(spread, most):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32)) + spread * rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)]
    coder = neighbours.Coder(x[:2000])
    radius = neighbours.fitted_radius(coder, x[:2000], 10)
    index, codes = neighbours.Index(coder.codes(x)), coder.codes(x)
    seen = hit = 0
    for q in range(0, 4000, 80):
        rows = index.within(codes[q], radius)
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(np.intersect1d(np.argsort(d)[:10], rows))
        seen += len(rows)
    assert hit >= 0.95 * 500 and seen < most * 50 * 4000  # the share of rows compared


def test_vectors_are_searched_by_length(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3 if i % 3 else 5).tolist()) for i in range(90)] + [(300, [1.0] * 9)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=4).collect()
    assert Counter(r["query_id"] for r in got) == dict.fromkeys(range(0, 90, 10), 4)
    assert all((r["query_id"] % 3 == 0) == (r["vec_id"] % 3 == 0) for r in got)


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 256, (500, 4)).astype(np.uint8)
    index = neighbours.Index(codes)
    for r in (0, 3, 9, 17, 32):
        q = codes[7] ^ np.uint8(3)
        want = np.flatnonzero(np.unpackbits(codes ^ q, axis=1).sum(1) <= r)
        assert index.within(q, r).tolist() == want.tolist()


# ---------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_runs(spark, name):
    got = queries()[name](spark, DATA)
    assert got.count() > 0
    if sql := oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        rel = con.sql(sql)
        order = sorted(got.columns)
        key = lambda r: tuple(str(v) for v in r)
        assert sorted(map(tuple, got.select(*order).collect()), key=key) == sorted(rel.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall(), key=key)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, t, "en", "s", len(t or "")) for i, t in dict((i, t) for i, t, *_ in cases() if i is not None).items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = None
    for name, stage in p.STAGES[:-1]:
        docs = common.stash(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language":
            assert not ids & {0, 1, 2}  # null, empty and blank have no letter
        if name == "ngram_join":
            groups, _ = brute_components(before, 5, 80)
            assert ids == {i for i, (_, c) in groups.items() if c == i}
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert p.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len(before)
    assert p.run(spark, str(tmp_path)).count() > 0
