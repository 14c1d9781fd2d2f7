"""Each operator against a brute-force version, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("loomgraph.llm")

from pyspark.sql import functions as F  # noqa: E402

from loomgraph.llm import (  # noqa: E402
    byte_bpe,
    html_extraction,
    lm_scoring,
    nearest_neighbours,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    toxicity,
    warc,
)

LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = ["", " \t\n", "one", "one two three four", "One TWO three four five", "a b c d e f g h i j", "x " * 50, "Ä é ñ ß word", "the end.\n\nthe end.\nlast", LONG, "b" * 5000, "\x1codd\x1dtext here", "!! ** ## $$"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 0.5, 7) for i, t in enumerate(TEXTS)] + [(90, None, None, None, None, None, None), (3, TEXTS[3], "en", "s", 1, 0.5, 7), (None, "no id here", "en", "s", 1, 0.5, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=repr)


def test_quality_rules_statistics(docs):
    got = quality_rules.statistics(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        w = words_of(r.text)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 500 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
        covered = {j for i, x in enumerate(windows) if x in twice for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if words_of(x)]
        assert r.n_words == len(w)
        assert r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(covered), r.text


def test_quality_rules_random_repeats(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    for r in quality_rules.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = r.text.split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        assert r.n_repeat_words == len({j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)})


def test_quality_rules_edges(docs, none):
    got = quality_rules.annotate(docs)
    assert got.count() == docs.count()
    assert {r.base_failed for r in got.where("text is null").collect()} == {True}
    assert quality_rules.annotate(none).count() == 0
    assert set(docs.columns) <= set(got.columns)


def test_expectation_maximisation_separates_classes():
    rnd = random.Random(1)
    counts = {}
    for _ in range(4000):
        good = rnd.random() < 0.8
        pattern = tuple(None if rnd.random() < 0.2 else int(good if rnd.random() < a else not good) for a in (0.95, 0.9, 0.85, 0.8))
        counts[pattern] = counts.get(pattern, 0) + 1
    share, rate = quality_rules.expectation_maximisation(sorted(counts.items(), key=repr))
    assert abs(share - 0.8) < 0.03
    for (good, bad), a in zip(rate, (0.95, 0.9, 0.85, 0.8), strict=True):
        assert abs(good - a) < 0.05 and abs(bad - (1 - a)) < 0.1
    assert quality_rules.posterior((1, 1, 1, 1), share, rate) > 0.9 > 0.5 > quality_rules.posterior((0, 0, 0, 0), share, rate)
    assert quality_rules.posterior((None,) * 4, share, rate) == pytest.approx(share)
    assert quality_rules.expectation_maximisation([])[0] == quality_rules.PRIOR


def test_a_weak_bad_vote_is_outvoted_and_an_accurate_one_is_not():
    # rules 0 to 2 fail together on bad texts, mostly; rule 3 fails on any text at random
    rnd = random.Random(7)
    counts = {}
    for _ in range(5000):
        bad = rnd.random() < 0.1
        pattern = tuple(int(not (bad and rnd.random() < 0.8)) for _ in range(3)) + (int(rnd.random() > 0.08),)
        counts[pattern] = counts.get(pattern, 0) + 1
    share, rate = quality_rules.expectation_maximisation(sorted(counts.items()))
    assert abs(share - 0.9) < 0.02
    for r in range(3):
        alone = tuple(int(k != r) for k in range(3)) + (1,)
        assert quality_rules.posterior(alone, share, rate) < 0.5
    assert quality_rules.posterior((1, 1, 1, 0), share, rate) > 0.9


def test_quality_rules_keep_texts_with_an_outvoted_rule(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.annotate(docs.select("doc_id", "text")).join(labels.select("doc_id", "quality"), "doc_id", "left").select("quality", "base_failed", "kept", F.exists(F.map_values("votes"), lambda v: F.coalesce(v == 0, F.lit(False))).alias("accused")).collect()
    passed = [r for r in got if not r.base_failed]
    assert sum(r.kept and r.accused for r in passed) > 0
    assert all(r.kept for r in passed if r.quality == 1) and not any(r.kept for r in passed if r.quality == 0)


def test_quality_rules_leave_clashing_columns(spark):
    names = ["n_words", "n_plain", "votes", "posterior", "kept", "_w", "_l", "base_failed", "__vote_length", "n_lines"]
    docs = spark.createDataFrame([(i, t, *[f"own {n}" for n in names]) for i, t in enumerate(TEXTS + [" ".join(f"{chr(97 + k % 26)}word{'abcdefghij'[k % 10]}{'klmnopq'[(k + i) % 7]}" for k in range(80)) + "." for i in range(20)])], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = quality_rules.stage(spark, docs, "").collect()
    whole = {r.doc_id: r for r in docs.collect()}
    assert kept and all(r == whole[r.doc_id] for r in kept)
    got = quality_rules.statistics(docs)
    assert dict(got.dtypes)["n_words"] == "bigint" and dict(got.dtypes)["_w"] == "string" and len(set(got.columns)) == len(got.columns)


def small_corpus(spark, n=240):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 120))]
        bad, toxic = i % 3 == 0, i % 5 == 1
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = "vileword" + rnd.choice(["s", "ed", ""])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier_held_out(spark, docs, none):
    d, labels = small_corpus(spark)
    model = quality_classifier.fit(d, labels, quality_classifier.train_rows())
    got = quality_classifier.score(d, model).join(labels, "doc_id").where(quality_classifier.remainder(3) == 1).collect()
    assert len(got) > 40
    assert sum((r.score >= 0.5) == bool(r.quality) for r in got) / len(got) > 0.9
    odd = quality_classifier.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality_classifier.score(none, model).count() == 0
    empty = quality_classifier.fit(d, labels.where("false"))
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(docs, empty).collect())


def test_quality_classifier_against_plain_compression(spark, docs):
    import zstandard

    d, labels = small_corpus(spark)
    model = quality_classifier.fit(d, labels, quality_classifier.train_rows())

    def size(raw, data):
        return len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw)) if data else len(zstandard.ZstdCompressor(level=model.level, write_content_size=False).compress(raw))

    for r in quality_classifier.score(docs.where("length(text) < 6000 or text is null"), model).collect():
        raw = (r.text or "").encode()
        parts = [raw[i : i + model.block] for i in range(0, len(raw), model.block)]
        x = (sum(size(p, model.bad) - size(p, model.good) for p in parts) + quality_classifier.PULL * model.usual) / (len(raw) + quality_classifier.PULL)
        assert r.size_difference == pytest.approx(x, abs=1e-9)
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -50, 50))))


def test_a_null_text_scores_as_the_empty_one(spark):
    d, labels = small_corpus(spark)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for module in (quality_classifier, toxicity):
        got = {r.doc_id: r.score for r in module.score(odd, module.fit(d, labels)).collect()}
        assert got[1] == got[2]


def test_fit_does_not_depend_on_the_order_of_repeated_ids(spark):
    d, labels = small_corpus(spark)
    twice = d.unionByName(d.withColumn("text", F.concat("text", F.lit(" again"))))
    rows = [quality_classifier.labelled_sample(x, labels, "quality", F.lit(True), 50, 10_000) for x in (twice, twice.orderBy(F.desc("text")).repartition(5))]
    assert rows[0] == rows[1]


def test_remainder_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", quality_classifier.remainder(3, "id").alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def test_toxicity_held_out(spark, docs, none):
    d, labels = small_corpus(spark)
    model = toxicity.fit(d, labels, toxicity.remainder(5) != 0)
    got = toxicity.score(d, model).join(labels, "doc_id").where(toxicity.remainder(5) == 0).collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in got) / len(got) > 0.9
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(none, model).count() == 0
    one_class = toxicity.fit(d, labels.where("toxic = 0"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, one_class).collect())


def brute_fingerprint(t):
    w = words_of((t or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("t", TEXTS)
def test_fingerprint(t):
    assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("m", [1, 2, 63, 64, 65, 300])
def test_bit_sliced_links(m):
    rnd = np.random.default_rng(m)
    base = rnd.integers(0, 2**63, max(1, m // 4), dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rnd.integers(0, 64, len(base), dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, len(base), dtype=np.uint64)) for _ in range(4)])[:m])
    got = simhash.linked(fps)
    for i in range(len(fps)):
        row = np.unpackbits(got[i].view(np.uint8), bitorder="little")[: len(fps)]
        want = np.array([i != j and bin(int(fps[i]) ^ int(fps[j])).count("1") <= 4 for j in range(len(fps))])
        assert (row.astype(bool) == want).all()


@pytest.mark.parametrize("b", [5, 6, 7, 8])
def test_blocks_lose_no_link(b):
    masks = [m & (1 << 64) - 1 for m in simhash.masks(b)]
    rnd = random.Random(b)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for k in rnd.sample(range(64), 4):
            y ^= 1 << k
        assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("tile", [8, 2048])
def test_simhash_components(spark, tile):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(12)]
    fps = {b for b in base}
    for b in base[:4]:
        for _ in range(25):
            x = b
            for k in rnd.sample(range(64), rnd.randint(1, 3)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.component for r in simhash.connected_components(simhash.links(nodes, len(fps), tile=tile)).collect()}
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert all(got.get(f, f) == find(f) for f in fps)


def test_simhash_edges(docs, none):
    got = simhash.components(docs).collect()
    assert len(got) == docs.count()
    assert {r.component_id for r in got if r.doc_id in (0, 1, 90)} == {0}
    assert simhash.components(none).count() == 0


def test_simhash_stage_keeps_one_row_of_each_component(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine", "quite another text about something else entirely here")
    rows = [(5, a, "x", 1), (2, a, "x", 2), (None, a, "x", 3), (None, b, "y", 4), (None, b, "y", 4), (7, c, "z", 5), (7, c, "z", 5), (7, a + " " + c, "w", 6), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")
    got = sorted(((r.doc_id, r.text, r.fp, r.component) for r in simhash.stage(spark, docs, "").collect()), key=repr)
    assert got == sorted([rows[1], rows[3], rows[5], rows[7], rows[8]], key=repr)
    assert simhash.stage(spark, docs, "").columns == docs.columns


def reference_ids(texts):
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path(byte_bpe.VOCABULARY), "rb"))}
    t = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [t.encode_ordinary(x or "") for x in texts]


def test_byte_bpe(docs, none):
    got = byte_bpe.encode(docs, bytes_col="decoded").collect()
    assert len(got) == docs.count()
    for r, ids in zip(got, reference_ids([r.text for r in got]), strict=True):
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert bytes(r.decoded).decode() == (r.text or "")
    assert byte_bpe.encode(none).count() == 0
    again = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in again)


def test_byte_bpe_odd_spaces():
    import pyarrow as pa

    rnd = random.Random(6)
    alphabet = [chr(i) for i in range(0x180)] + list("  　 \x85\U0001f600中") + [" ", "\n", "'s", "'ll", "ab"] * 40
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["", " ", "  ", " \n a", "a "]
    own = byte_bpe.codec(byte_bpe.default_vocabulary(), byte_bpe.default_pattern())
    got = own.encode(pa.array(texts))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == reference_ids(texts)


def test_byte_bpe_heaps_side_by_side():
    """Words merged side by side get the ids of `merge` and of tiktoken, at every length and with equal pairs in a row."""
    import pyarrow as pa

    rnd = random.Random(8)
    own = byte_bpe.codec(byte_bpe.default_vocabulary(), byte_bpe.default_pattern())
    bits = ["a", "b", " ", "er", "tion", "\u00e9", "\u4e2d", "\U0001f600", "0", "-"]
    words = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60))).encode() for _ in range(12000)]
    words += [c * n for c in (b"a", b" ", b"ab", b"\xff", b"\xe4\xb8") for n in range(1, 140)]
    words = [w[:128] for w in words if len(w) > 1] + [w[: rnd.randint(2, 20)] for w in words if len(w) > 1]
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    flat, size = own.heaps.merge(data, np.cumsum(length) - length, length)
    assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == [byte_bpe.merge(w, own.rank) for w in words]
    assert [x.tolist() for x in own.heaps.merge(data, length[:0], length[:0])] == [[], []]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 90))) for _ in range(2000)] + ["".join(rnd.choice("er\u00e9\u4e2dtion") for _ in range(n)) for n in range(20, 300)] + ["", "a" * 5000, "\n b"]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(pa.array(texts))] == reference_ids(texts)
    for none in ([], [""], ["", ""]):
        got = own.encode(pa.array(none, pa.string()))
        assert got == [b""] * len(none)
        assert own.decode(got).to_pylist() == got
    with pytest.raises(ValueError, match="32-bit"):
        own.decode([b"12345"])


def test_byte_bpe_without_every_byte(tmp_path):
    """A vocabulary that lacks bytes, and has gaps, is merged by `merge` alone."""
    import pyarrow as pa

    path = tmp_path / "few.tiktoken"
    ranks = {0: b"a", 1: b"b", 2: b" ", 5: b"ab", 9: b"aab", 11: b" a"}
    path.write_text("".join(f"{base64.b64encode(w).decode()} {r}\n" for r, w in ranks.items()))
    own = byte_bpe.Codec(str(path), byte_bpe.default_pattern())
    assert own.heaps is None
    got = own.encode(pa.array(["aab aabab", "ab", "b a ab"]))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [[9, 2, 9, 5], [5], [1, 11, 2, 5]]
    assert own.decode(got).to_pylist() == [b"aab aabab", b"ab", b"b a ab"]


def test_byte_bpe_new_words_are_cheaper_than_their_merges():
    """Encoding words that are all new takes less than merging each by a heap of its own."""
    import time

    import pyarrow as pa

    rnd = random.Random(9)
    parts = "er tion an he ou sch ic qu au \u00e9e \u00f1o ing le st".split()
    words = list({"".join(rnd.choice(parts) for _ in range(rnd.randint(3, 7))) for _ in range(60000)})
    own = byte_bpe.codec(byte_bpe.default_vocabulary(), byte_bpe.default_pattern())
    texts = pa.array([" ".join(words[k : k + 100]) for k in range(0, len(words), 100)])
    raw = [b" " + w.encode() for w in words]
    took = []
    for run in (lambda: own.encode(texts), lambda: [byte_bpe.merge(w, own.rank) for w in raw]):
        at = time.process_time()
        run()
        took.append(time.process_time() - at)
    assert took[0] < took[1], took


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(2000)]
    table = byte_bpe.PerfectHash(keys)
    assert table.find(keys) == list(range(2000))
    assert sorted(table.entry.tolist()) == list(range(2000))


def test_perfect_hash_with_gaps(tmp_path):
    path = tmp_path / "gaps.tiktoken"
    words = {0: b"a", 1: b"b", 5: b"ab", 9: b"aab"}
    path.write_text("".join(f"{base64.b64encode(w).decode()} {r}\n" for r, w in words.items()))
    codec = byte_bpe.Codec(str(path), r"\S+|\s+")
    assert [codec.entries[e] for e in codec.table.find([b"a", b"ab", b"aab"])] == [b"a", b"ab", b"aab"]
    with pytest.raises(ValueError, match="differ"):
        byte_bpe.PerfectHash([b"x", b"x"])


def test_packing_pieces(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pieces(docs).collect()
    want = sorted((i, k, ids[k * 4096 : (k + 1) * 4096]) for i, t in ((r.doc_id, r.text) for r in docs.collect()) if i is not None for ids in [tok.encode(t or "", add_special_tokens=False).ids + [1]] for k in range(-(-len(ids) // 4096)))
    assert sorted((r.doc_id, r.piece, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got if r.doc_id is not None) == want
    assert all(r.start == r.piece * 4096 and r.length == len(r.ids) // 4 for r in got)
    assert packing.pack(none).count() == 0


def test_packing_places_have_no_gaps(spark, docs):
    rnd = random.Random(8)
    rows = [(i, 0, rnd.choice([4096, 2048, 1000, 1000, 1000, 37, rnd.randint(1, 4096)])) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    for got in (packing.place(table).collect(), packing.pack(docs).collect()):
        seqs = {}
        for r in got:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
    total = sum(x[2] for x in rows)
    assert len({r.sequence_id for r in packing.place(table).collect()}) <= 1.02 * total / 4096 + 2
    assert sorted((r.doc_id, r.length) for r in packing.place(table).collect()) == sorted((a, c) for a, _, c in rows)


def test_packing_plan_edges():
    assert packing.plan(np.zeros(4097, np.int64)) == []
    h = np.zeros(4097, np.int64)
    h[3000] = 5
    assert sum(n for n, _ in packing.plan(h)) == 5


def test_packed_sequences_join_the_ids(docs):
    placed = packing.pack(docs)
    got = {r.sequence_id: bytes(r.ids) for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert got[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def pages_table(spark):
    rnd = random.Random(3)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nPage-Id: 99999\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = []
    for i in range(150):
        h = "".join(rnd.choice("abc é\n<p>") for _ in range(rnd.randint(0, 600)))
        if i % 3 == 0:
            h = h + fake * rnd.randint(1, 4) + h
        if i % 5 == 0:
            h = "X" * 150
        if i % 7 == 0:
            h = None if i % 14 else "short"
        if i == 11:
            h = fake * 300
        rows.append((i, None if i % 9 == 0 else f"http://a/{i}\r\nb", h, "clash"))
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(2)


@pytest.mark.parametrize("split", [700, 1 << 25])
def test_warc_round_trip(spark, split):
    rows, df = pages_table(spark)
    got = warc.digest(warc.read(spark, warc.write(df), split)).collect()
    assert sorted(r.page_id for r in got) == [r[0] for r in rows]
    first = {}
    for i, _, h, _ in rows:
        first.setdefault(h or "", i)
    for r in got:
        h = rows[r.page_id][2] or ""
        again = len(h.encode()) >= 100 and first[h] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), hashlib.sha256(h.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[h]) if again else ("response", None))


def test_warc_query_jumps_over_several_splits(spark, monkeypatch):
    took = []
    plain = warc.reachable
    monkeypatch.setattr(warc, "reachable", lambda c: took.append(plain(c)) or took[-1])
    got = warc.query(spark, "/root/testdata/sf0.01")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.01/pages.parquet").count()
    entries, rounds = took[0]
    assert rounds >= 2 and entries.groupBy("path").count().agg(F.max("count")).first()[0] > 2


def test_warc_magic_in_payloads_is_no_record(spark):
    record = "WARC/1.0\r\nContent-Length: 7\r\n\r\npayload\r\n\r\n"
    df = spark.createDataFrame([(i, "http://x.org", f"page {i} " + record * (i % 5)) for i in range(300)], "page_id long, url string, html string")
    got = warc.digest(warc.read(spark, warc.write(df.repartition(2)), 900)).collect()
    assert sorted(r.page_id for r in got) == list(range(300))


def test_warc_empty_table(spark):
    _, df = pages_table(spark)
    assert warc.read(spark, warc.write(df.where("false"))).count() == 0


def test_html_extraction(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>'
        "<article><h1>A &amp; B</h1><p>First <b>bold</b>\n text.<br>Line two.<p>Second &lt;x&gt; para &copy; here, and it goes on.</p><script>var x='</p>'</script></article>"
        '<div class="comments"><p>Great post!</p></div><aside><p>Related stories</p></aside><form><p>Subscribe now</p></form><footer>&copy; all rights</footer></body></html>'
    )
    read = html_extraction.train(html_extraction.labelled_pages()).reader()
    assert read(page) == "A & B First bold text. Line two. Second <x> para © here, and it goes on."
    assert read(None) == read("") == read("<nav>") == ""
    assert read("<!-- x -->" + page) == read(page) and read("<!-- x " + page) == read(page).replace("<html>", "")
    for cut in range(0, len(page), 37):
        read(page[:cut])
    read("<div>" * 3000 + "deep" + "</div>" * 10)
    model = html_extraction.ChainModel()
    df = spark.createDataFrame([(1, None, 5), (2, page, 6), (2, page, 6)], "page_id int, html string, text int")
    assert sorted(r.n_chars for r in html_extraction.extract(df, model).collect())[0] == 0
    assert html_extraction.extract(df.where("false"), model).count() == 0


def test_html_held_out_pages():
    model = html_extraction.train(html_extraction.labelled_pages())
    read = model.reader()
    right = 0
    pages = html_extraction.labelled_pages(80, 99)
    for page, labels in pages:
        want = " ".join(b.text for b, y in zip(html_extraction.blocks(page), labels, strict=True) if y)
        right += read(page) == want
    assert right >= 72


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p a'b>Hello don't stop</p><p>More text it's</p>", ["Hello don't stop", "More text it's"]),
        ('<p title="it>Hello</p><p>x', ["Hello", "x"]),
        ("<p>a<!-- never closed <b>x</b></p><p>more</p>", ["ax", "more"]),
        ("<p>a<!-- closed <b>x</b> --></p>", ["a"]),
        ("a < b and c > d <3", ["a < b and c > d <3"]),
        ("<p>x</p><a b ", ["x"]),
        ("<title>never <p>Hello</p>", ["Hello"]),
        ("<p data-x=\"a>b\" class='c'>q</p><a href=\"x>y\" b=\">\">t</a>", ["q", "t"]),
        ("<p>1</p></p></div><p>2", ["1", "2"]),
        ("<!-->x<!doctype html>y", ["xy"]),
    ],
)
def test_malformed_tags_lose_no_text(page, texts):
    assert [b.text for b in html_extraction.blocks(page)] == texts


def test_malformed_pages_take_time_in_proportion():
    import time

    parts = ["<a b ", "<div>", "</p>", "<b>x<hr>", '<p a="x>y', "<!-- a > ", "<title>x", "<b>", "<li>", "<x a='"]
    for part in parts:
        took = []
        for n in (20_000, 160_000):
            began = time.process_time()
            html_extraction.blocks("<p>" + part * n + "<h1>end</h1>")
            took.append(time.process_time() - began)
        # eight times the length; the square would be 64
        assert took[1] < max(0.5, 30 * took[0]), part


def test_viterbi_is_the_best_path():
    from itertools import product

    rnd = np.random.default_rng(1)
    for _ in range(30):
        m = html_extraction.ChainModel(step=rnd.normal(size=(2, 2)), first=rnd.normal(size=2))
        s = rnd.normal(size=6).tolist()
        value = lambda y: m.first[y[0]] + sum(m.step[a, b] for a, b in zip(y, y[1:], strict=False)) + sum(v for v, k in zip(s, y, strict=True) if k)  # noqa: B023, E731
        assert value(m.decode(s)) == pytest.approx(max(map(value, product((0, 1), repeat=6))))


def test_nearest_neighbours(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(1500, 16))
    x[300:800] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0]), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in nearest_neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20].tolist()
        assert len(got[q]) == 20
        assert all(v == pytest.approx(float(x[i] @ x[q])) for i, v in got[q])
        hit += len({i for i, _ in got[q]} & set(want))
        total += 20
    assert hit / total > 0.9
    assert set(got) == set(range(0, 1500, 20))
    assert nearest_neighbours.search(df.where("vec_id in (20, 21, 22)"), F.col("vec_id") % 20 == 0).count() == 2
    assert nearest_neighbours.search(df.where("false"), F.lit(True)).count() == 0


def visited(x, queries, **more):
    """Lists, mean copies of a vector, and the share of rows that a query is compared with."""
    lists = nearest_neighbours.fit(x, float(np.linalg.norm(x, axis=1).max()), **more)
    _, homes = lists.homes(lists.lift(x))
    q, at = lists.visits(np.c_[x[queries], np.zeros(len(queries))])
    size = np.bincount(homes, minlength=len(lists.centroids))
    return len(size), len(homes) / len(x), size[at].sum() / len(queries) / len(x), len(at) / len(queries)


def test_nearest_neighbours_visit_few_lists(spark, monkeypatch):
    monkeypatch.setattr(nearest_neighbours, "LIST_SIZE", 25)
    rnd = np.random.default_rng(4)
    for name, x in (("random", rnd.normal(size=(6000, 24))), ("clustered", rnd.normal(size=(100, 24))[rnd.integers(0, 100, 6000)] + 0.3 * rnd.normal(size=(6000, 24)))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        true = x[::60] @ x.T
        true[np.arange(100), np.arange(0, 6000, 60)] = -np.inf
        best = {(i * 60, j) for i, row in enumerate(true) for j in np.argsort(-row)[:10].tolist()}
        found = lambda **more: {(r.query_id, r.vec_id) for r in nearest_neighbours.search(df, F.col("vec_id") % 60 == 0, 10, **more).collect()}  # noqa: B023, E731
        recall = len(best & found()) / len(best)
        n, copies, share, lists = visited(x, np.arange(0, 6000, 60), lists=240, pairs=10)
        print(name, "recall", recall, "lists", n, "visited", lists, "copies", copies, "compared", share)
        assert recall >= 0.9 and copies < 2 and n > 100
        assert lists < (n / 2 if name == "random" else n / 10)
    assert found(exact=True) == best


def test_nearest_neighbours_short_lists_are_made_up_for(spark, monkeypatch):
    monkeypatch.setattr(nearest_neighbours, "LIST_SIZE", 3)
    x = np.random.default_rng(6).normal(size=(120, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest_neighbours.search(df, F.col("vec_id") % 20 == 0).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: 20 for i in range(0, 120, 20)}


def test_lm_scores_prefer_seen_order(spark, docs, none):
    rnd = random.Random(0)
    rows = [(i, " ".join(w for _ in range(rnd.randint(20, 60)) for w in (rnd.choice(["red", "blue"]), "fish", "swims"))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    words = lm_scoring.vocabulary(d)
    assert words.words[:2] == ["fish", "swims"]
    assert words.counts.tolist() == sorted(words.counts, reverse=True) and words.counts.sum() == sum(len(t.split()) for _, t in rows)
    net = lm_scoring.train(d, words, share=1, rounds=3)
    probe = spark.createDataFrame([(1, "red fish swims blue fish swims"), (2, "swims swims red red fish fish")], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_probability for r in lm_scoring.score(probe, words, net).collect()}
    assert got[1] > got[2]
    odd = lm_scoring.score(docs, words, net).collect()
    assert len(odd) == docs.count()
    assert all(r.n_tokens == len((r.text or "").split()) and r.log_likelihood <= 0 for r in odd)
    assert lm_scoring.score(none, words, net).count() == 0
    assert lm_scoring.vocabulary(none).words == []


def test_lm_rare_words_have_their_own_tokens(spark):
    common = [f"w{i}x{i * 7 % 97}" for i in range(lm_scoring.WORDS)]
    d = spark.createDataFrame([(i, " ".join(common)) for i in range(3)] + [(9, "kitchen zzqqkitchen \u4e2d\U0001f600en")], "doc_id long, text string")
    numbers = lm_scoring.Numbers(lm_scoring.vocabulary(d))
    seen = set()
    for w in [*common, "kitchen", "zzqqkitchen", "chicken", "\u4e2d\U0001f600en", "\u4e2e\U0001f600en", "unseenen"]:
        tokens, ends, n = numbers.of(lm_scoring.pa.array([w, None, f" {w} "]))
        assert n.tolist() == [1, 0, 1] and ends.tolist() == [len(tokens) // 2, len(tokens) // 2, len(tokens)]
        seen.add(tuple(tokens[: ends[0]].tolist()))
    assert len(seen) == len(common) + 6
    two, one = (numbers.of(lm_scoring.pa.array([t]))[0].tolist() for t in ("kitch zzqqen", "kitchzzqqen"))
    assert two != one


def test_lm_learns_from_every_document(spark):
    rows = spark.range(400).selectExpr("id as doc_id", "concat('word', id % 7, ' of text') as text")
    words, key = lm_scoring.vocabulary(rows), F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(32))
    fresh = lm_scoring.Network.fresh(words.counts).flat()
    for some in (rows.where(key == 17), rows.where(key > 1), rows.withColumn("doc_id", F.lit(None).cast("long"))):
        assert not np.array_equal(lm_scoring.train(some, words).flat(), fresh)
    seen = []
    for lone in [r.doc_id for r in rows.orderBy("doc_id").limit(6).collect()]:
        seen.append(not np.array_equal(lm_scoring.train(rows.where(F.col("doc_id") == lone), words).flat(), fresh))
    assert all(seen)


def test_lm_probabilities_sum_to_one():
    net = lm_scoring.Network.fresh(np.arange(lm_scoring.VOCABULARY, 0, -1) ** 1.5)
    rnd = np.random.default_rng(1)
    net = net.shaped(net.flat() + rnd.normal(0, 0.3, net.flat().size))
    total = 0.0
    for t in range(lm_scoring.VOCABULARY):
        total += float(np.exp(net.log_probability(np.array([5, t, 9], np.int32), np.array([3]))[1]))
    assert total == pytest.approx(1.0, abs=1e-3)


def naive_log_likelihood(net, tokens):
    """Token by token, one text, in plain loops over the window."""
    total = 0.0
    for i, t in enumerate(tokens):
        h = net.hidden.astype(float).copy()
        for k, step in enumerate((-2, -1, 1, 2)):
            j = i + step
            h += net.place[k][tokens[j] if 0 <= j < len(tokens) else lm_scoring.VOCABULARY]
        h = np.tanh(h)
        c = max(c for c in range(lm_scoring.CLASSES) if net.edges[c] <= t)
        one = h @ net.one + net.one_bias
        a, b = net.edges[c], net.edges[c + 1]
        two = h @ net.two[:, a:b] + net.two_bias[a:b]
        total += one[c] - np.log(np.exp(one).sum()) + two[t - a] - np.log(np.exp(two).sum())
    return total


def test_lm_scores_against_plain_loops(spark, docs):
    words = lm_scoring.vocabulary(docs)
    net = lm_scoring.Network.fresh(words.counts)
    net = net.shaped(net.flat() + np.random.default_rng(1).normal(0, 0.3, net.flat().size))
    numbers = lm_scoring.Numbers(words)
    for r in lm_scoring.score(docs, words, net).collect():
        tokens = [x for w in (r.text or "").split()[:3000] for x in numbers.of(lm_scoring.pa.array([w]))[0].tolist()]
        if r.n_tokens <= 3000:
            want = naive_log_likelihood(net, tokens)
            assert r.log_likelihood == pytest.approx(want, rel=1e-4, abs=1e-4)
            assert r.mean_log_probability == pytest.approx(want / max(1, r.n_tokens), rel=1e-4, abs=1e-4)


def test_lm_steps_go_down_the_slope():
    """A gradient step moves each table by the slope of the loss, measured by small differences."""
    rnd = np.random.default_rng(2)
    tokens, ends = rnd.integers(0, 50, 12).astype(np.int32), np.array([5, 5, 12])
    net = lm_scoring.Network.fresh(np.arange(lm_scoring.VOCABULARY, 0, -1.0))
    net = net.shaped(net.flat() + rnd.normal(0, 0.2, net.flat().size))
    loss = lambda n: -float(n.log_probability(tokens, ends).astype(float).sum())
    moved = net.shaped(net.flat())
    moved.learn(tokens, ends, 1e-3)
    for name in ("place", "hidden", "one", "one_bias", "two", "two_bias"):
        before, after = getattr(net, name), getattr(moved, name)
        step = (after - before).ravel()
        for at in np.argsort(-np.abs(step))[:3]:
            slope = []
            for e in (3e-2, -3e-2):
                other = net.shaped(net.flat())
                getattr(other, name).ravel()[at] += e
                slope.append(loss(other))
            assert np.sign(step[at]) == -np.sign(slope[0] - slope[1]), name


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_lm_beats_unigrams_on_texts_it_has_not_seen(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    seen, held = docs.where("doc_id % 10 != 3"), docs.where("doc_id % 10 = 3 and length(text) < 20000")
    words = lm_scoring.vocabulary(seen)
    net = lm_scoring.train(seen, words)
    share = np.log((words.counts + 0.5) / (words.counts + 0.5).sum())
    numbers, rnd = lm_scoring.Numbers(words), random.Random(3)
    texts = [r.text or "" for r in held.collect()]
    mixed = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in texts]
    got, n = {}, sum(len(t.split()) for t in texts)
    for name, part in (("real", texts), ("mixed", mixed)):
        tokens, ends, _ = numbers.of(lm_scoring.pa.array(part))
        got[name] = net.log_probability(tokens, ends).astype(float).sum() / n
        got["unigram"] = share[tokens].sum() / n
    print(got)
    assert got["real"] > got["unigram"] + 1
    assert got["real"] > got["mixed"] + 0.1


CONTRACTS = {
    "op1_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op3_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op5_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op6_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", [*CONTRACTS, "op2_lm_scoring"])
def test_queries_keep_their_contracts(spark, name):
    from loomgraph.llm import registry

    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    types = dict(got.dtypes)
    for part in CONTRACTS.get(name, "doc_id bigint, n_tokens bigint, log_likelihood double, mean_log_probability double").split(", "):
        column, kind = part.split()
        assert types[column] == kind, (name, column)
    table = {"op1_html_extraction": "pages", "op5_warc": "pages"}.get(name, "documents")
    if name not in ("op4_nearest_neighbours", "op10_packing"):
        assert got.count() == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    d, labels = small_corpus(spark)
    full = d.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    full = full.unionByName(full.where("doc_id = 1").withColumn("doc_id", F.lit(1001).cast("long")))
    full.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert 1001 not in kept and 1 in kept
    bad = {i for i in range(240) if i % 3 == 0}
    assert not kept & bad and len(kept) > 140
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, now, str(tmp_path)).columns == now.columns
        assert stage(spark, now.where("false"), str(tmp_path)).count() == 0


def test_lm_numbered_texts_are_spelt_once(spark, tmp_path, monkeypatch):
    """Numbers of tokens, written once, train and score like the texts; the query spells no text after that."""
    rows = [(i, t, "x") for i, t in enumerate([None, "", " ", "one two three", "İstanbul ǅ one", "two three " * 3000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(1)
    words = lm_scoring.vocabulary(docs)
    own = lm_scoring.numbered(docs, words)
    assert own.columns == ["doc_id", *lm_scoring.NUMBERED]
    net, same = lm_scoring.train(docs, words), lm_scoring.train(own, words, None)
    assert np.array_equal(net.flat(), same.flat())
    of = lambda df: {r.doc_id: (r.n_tokens, r.log_likelihood, r.mean_log_probability) for r in df.collect()}
    assert of(lm_scoring.score(docs, words, net)) == of(lm_scoring.score(own, words, net, None))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read = []
    monkeypatch.setattr(lm_scoring, "train", lambda d, *a, f=lm_scoring.train: read.append(d.columns) or f(d, *a))
    assert lm_scoring.query(spark, str(tmp_path)).count() == 6
    assert read == [["doc_id", *lm_scoring.NUMBERED]]
