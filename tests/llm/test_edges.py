"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns; and each operator's own general form."""

import math
import tracemalloc
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnspark.llm import byte_bpe, chat, context_tree, licenses, line_cleaning, minhash, multi_index, packing, shared, sstable, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, and then it sleeps for the rest of the day."),
    (2, "The quick brown fox jumps over the lazy dog, and then it sleeps for the rest of the day."),
    (2, "The quick brown fox jumps over the lazy dog, and then it sleeps for the rest of the day."),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, LONG),
    (7, "Žluťoučký kůň \U0001f600 e\u0301 ﬁ <|endoftext|> [/INST]</s> \x00\x01"),
    (8, "one two"),
    (None, "a row without an id of its own stands here for the test"),
    (None, None),
]
EXTRA = {"n": "x", "a": "x", "k1": "x", "bucket": "x", "length": "x", "kept_": "x", "n_words": "x"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in EXTRA.items()}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id = -1")


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "user", "[INST] \\[/INST] [\\/INST]"),
        (1, 2, "assistant", None),
        (1, 3, "tool", "x [/TURN] y [ROLE]"),
        (1, 4, "assistant", "</s><\\s> ok </s>"),
        (2, 0, None, None),
        (3, None, "user", "same"),
        (3, None, "user", "same"),
        (None, 1, "assistant", "no conversation"),
        (4, 0, "odd [/ROLE] role", "[ROLE] x [/ROLE] "),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("turns", F.lit(1)).withColumn("whole", F.lit(1))
    out = chat.prefix_targets(turns)
    read = out.select("conv_id", "example", "target_turn", "is_last", "formatted", "loss_start", "loss_length", chat.parse("formatted").alias("turns"), chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss")).collect()
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    for c, turns_ in own.items():
        turns_ = [(r, x) for _, r, x in sorted(turns_)]
        mine = sorted((r for r in read if r.conv_id == c), key=lambda r: r.example)
        assert [tuple(t) for t in mine[-1].turns] == turns_ and mine[-1].is_last
        targets = [k for k, (r, _) in enumerate(turns_) if r == "assistant"]
        assert [r.target_turn for r in mine if r.target_turn is not None] == targets
        for r in mine:
            if r.target_turn is not None:
                assert r.loss == turns_[r.target_turn][1] and [tuple(t) for t in r.turns] == turns_[: r.target_turn + 1]
    assert chat.prefix_targets(turns.filter("conv_id = 99")).count() == 0


def test_sstable(spark, docs, none):
    path = shared.new_path(spark, "shards")
    sstable.write_shards(docs, path, tokenizer=WORDS, end_id=2, shard_bytes=20_000)
    rows = sstable.read_shards(spark, path).collect()
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(WORDS)
    want = sorted(((i is not None, i or 0), [*code.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids)
    found = [(r.doc_id, r.ids) for r in sstable.lookup(spark, path, [2, 6, 77, None]).collect()]
    assert sorted(map(repr, found)) == sorted(repr((i, x)) for (has, i), x in ((k, v) for k, v in want) for i in [i if has else None] if i in (2, 6, None))
    empty = shared.new_path(spark, "shards")
    sstable.write_shards(none, empty, tokenizer=WORDS, end_id=2)
    assert sstable.read_shards(spark, empty).count() == 0


def test_shards_go_by_number(spark):
    """Names have five digits at least; from shard 100,000 on, text order isn't number order."""
    names = ["part-99998-a.txt", "part-100001-a.txt", "part-00002-a.txt", "part-100000-a.txt", "part-99999-a.txt"]
    rows = spark.createDataFrame([(n, 10 ** k) for k, n in enumerate(names)], "shard string, n_ids long")
    got = {r.shard: r.start for r in sstable._with_starts(rows).collect()}
    assert [got[n] for n in ("part-00002-a.txt", "part-99998-a.txt", "part-99999-a.txt", "part-100000-a.txt", "part-100001-a.txt")] == [0, 100, 101, 10101, 11101]


def test_shard_finds_each_key_in_many_blocks():
    writer, data, rng = sstable.ShardWriter(2), bytearray(), np.random.default_rng(1)
    values = {k: rng.integers(0, 1000, 30).astype("<u2").tobytes() for k in range(-5000, 5000, 7)}
    for k, v in values.items():
        for record in writer.add(sstable.pack_key(k), v):
            data += record + b"\n"
    for record in writer.finish():
        data += record + b"\n"
    shard = sstable.Shard(bytes(data))
    assert len(shard.blocks) > 1 and [sstable.unpack_key(k) for k, _ in shard.scan()] == list(values)
    assert all(shard.get(sstable.pack_key(k)) == ([values[k]] if k in values else []) for k in range(-5010, 5010, 3))
    damaged = bytearray(data)
    damaged[10] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Shard(bytes(damaged)).scan())


def test_near_duplicates(spark, docs, none):
    out = minhash.near_duplicates(docs, shingle=3, percent=85).collect()
    known = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in out}
    assert len(out) == len(TEXTS)
    assert known[1, 17] == (1, True) and known[2, 17] == (1, False) and known[8, 1] == (8, True)
    assert all(known[i, 0] == (i, True) for i in (3, 4, 5)) and known[None, 0] == (None, True)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 7, 8]


def test_near_duplicates_of_many_edited_copies(spark):
    """Chains of edits, a passage that all share, and pairs just at and below the threshold."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    passage, rows = word(60), []
    for g in range(40):
        own = word(int(rng.integers(30, 200)))
        for c in range(int(rng.integers(1, 9))):
            own = list(own)
            for k in rng.integers(0, len(own), int(rng.integers(0, 8))):
                own[k] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(own + (passage if g % 2 else []))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=size, percent=percent).collect()}
        assert got == brute.components(rows, size, percent)


def test_one_id_with_two_texts_keeps_the_links_of_both(spark):
    rng = np.random.default_rng(15)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    near = lambda w: " ".join([*w[:-1], "end"])
    a, b, c = word(120), word(120), word(120)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (11, near(a)), (12, near(b)), (3, " ".join(c)), (20, " ".join(c)), (20, " ".join(a)), (30, " ".join(word(50)))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == sorted((i, 30 if i == 30 else 3, i in (3, 30)) for i, _ in rows)


def test_a_filter_that_is_too_large_is_left_out(spark, monkeypatch):
    rows = spark.range(100).select(F.col("id").alias("doc_id"))
    few = rows.filter("doc_id < 7")
    assert 7 <= shared.maybe_in(rows, few, "doc_id").count() < 20
    monkeypatch.setattr(shared, "MOST_FILTER_BITS", 1)
    assert shared.maybe_in(rows, few, "doc_id").count() == 100


def test_min_and_max_are_unbiased():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:600], rng.integers(0, 1 << 63, 300).astype(np.uint64)]))
    h, starts = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    s = minhash.signatures(h, starts, 2000)
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - truth) < 0.03


def test_packing(spark, docs, none):
    rows = packing.pack(docs, tokenizer=WORDS, end_id=1, max_len=64).collect()
    total = {}
    for r in rows:
        total.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == r.length <= 64
    for places in total.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 64
    assert sum(r.piece == 0 for r in rows) == len(TEXTS)
    assert packing.pack(none, tokenizer=WORDS, end_id=1).count() == 0
    whole = packing.sequences(packing.pack(docs, tokenizer=WORDS, end_id=1, max_len=64)).collect()
    assert all(len(r.input_ids) == sum(r.lengths) and len(r.doc_ids) == len(r.lengths) for r in whole) and len(whole) == len(total)


def test_packed_sequences_hold_the_ids_that_pieces_are_read_from(spark, docs, none, tmp_path):
    packed = packing.pack(docs, tokenizer=WORDS, end_id=1, max_len=64)
    placed = shared.written(packed, "placed")
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    rows = [tuple(r) for r in packing.unpacked(packing.sequences(placed), with_ids=True).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(r[c] for c in fields) for r in placed.collect()), key=repr)
    short = packing.unpacked(packing.sequences(packing.pack(docs, tokenizer=WORDS, end_id=1, max_len=64, as_bytes=True)), with_ids=True).collect()
    wide = packing.unpacked(packing.sequences(packing.pack(docs, tokenizer=WORDS, end_id=1, max_len=64, as_bytes=True, vocabulary=1 << 17)), with_ids=True).collect()
    assert sorted(([r.length, r.ids_crc32, r.ids] for r in short)) == sorted(([r.length, r.ids_crc32, r.ids] for r in wide)) == sorted([r[3], r[4], r[7]] for r in rows)
    assert all(r[4] == zlib.crc32(np.array(r[7], dtype="<u4").tobytes()) for r in rows)
    assert packing.unpacked(packing.sequences(packing.pack(none, tokenizer=WORDS, end_id=1))).count() == 0
    documents = spark.createDataFrame([(k, "some words of a document " * k) for k in range(5)], "doc_id long, text string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    whole = {}
    for r in packing.packing_stage(spark, documents, str(tmp_path)).collect():
        whole.setdefault(r.sequence_id, []).append((r.offset, r.ids))
    assert all(o == sum(len(x) for p, x in places if p < o) and ids[-1] == 1 for places in whole.values() for o, ids in places)
    assert sum(len(places) for places in whole.values()) == 5


def test_plan_places_all_and_fills():
    rng = np.random.default_rng(2)
    lengths = np.minimum(4096, np.maximum(1, rng.lognormal(6.2, 0.9, 20_000))).astype(int)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    groups = packing.plan(histogram, 4096)
    placed = {}
    for g, n in groups:
        assert sum(g) <= 4096
        for x in g:
            placed[x] = placed.get(x, 0) + n
    assert placed == histogram
    assert sum(n for _, n in groups) <= 1.005 * lengths.sum() / 4096 + 1
    assert packing.plan({}, 4096) == []


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(4)
    a, b = rng.random((30, 50)), rng.random(30) * 10
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-5 and abs(slope[x > 0]).max(initial=0) < 1e-5


def test_context_tree_is_exact(spark):
    """Against node-by-node weighting of the same texts, those learned from and others."""
    texts = ["abracadabra abra", "abra cadabra", "the cat sat", "the bat sat on the cat", "Žluť", "", None, "zzz qqq", "the cat sat"]
    rows = [(k, t, k in (1, 5, 7)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    flat = lambda t: b" ".join(context_tree.words_of(t))
    want = brute.context_tree([flat(t) for _, t, out in rows if not out], [flat(t) for t in texts], context_tree.DEPTH)
    found = context_tree.score(df, block_bytes=40).collect()
    got, rates = {r.doc_id: r.score for r in found}, {r.doc_id: (r.n_bytes, r.bits_per_byte) for r in found}
    for k, w in enumerate(want):
        assert math.isclose(got[k], w, rel_tol=1e-5), (k, got[k], w)
        n = len(flat(texts[k])) + 1
        assert rates[k][0] == n and math.isclose(rates[k][1], -w * math.log2(10) / n, rel_tol=1e-5)


def test_context_tree_with_contexts_of_many_blocks(monkeypatch, spark):
    """Grams that many blocks hold go as several rows, contexts come in several batches; scores stay what they are."""
    monkeypatch.setattr(context_tree, "MOST_BLOCKS", 3)
    key = np.array([1, 1, 1, 1, 5, 5, 9], dtype=np.int64)
    distinct, n, cuts, of = context_tree._rows(key, np.arange(7), np.arange(7))
    assert (distinct.tolist(), n.tolist(), cuts.tolist(), of.tolist()) == ([1, 5, 9], [6, 9, 6], [0, 3, 4, 6], [0, 0, 1, 2])
    monkeypatch.undo()
    rng = np.random.default_rng(18)
    keys, starts = context_tree.keys_of([[b"".join(rng.choice([b"a", b"b", b"c"], 300))]])
    grams, times = np.unique(keys, return_counts=True)
    import pyarrow as pa

    rows = pa.table({"kind": np.zeros(len(grams), dtype=np.int32), "key": grams, "n": times, "block": np.zeros(len(grams), dtype=np.int32)})
    seen = []
    for step, least in ((7, 1), (50, 60), (10**6, 10**6)):
        out = pa.Table.from_batches(context_tree._grow(iter(rows.to_batches(max_chunksize=step)), least)).to_pylist()
        nodes = {}
        for r in out:
            if r["kind"] == context_tree.NODE:
                nodes[r["key"]] = np.add(nodes.get(r["key"], 0.0), r["sums"])
        seen.append(({r["key"]: r["p"] for r in out if r["kind"] == context_tree.GRAM}, {k: v.round(9).tolist() for k, v in nodes.items()}))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) == len(grams)


def test_context_tree_counts_beyond_single_precision():
    """A node of 2^31 decisions and log weights of billions: shares and weights to double precision."""
    zeros, ones = np.array([2.0**31 + 1, 3.0]), np.array([1.0, 5.0])
    keys = np.array([(97 << 8 | 98) << 8 | 1, (97 << 8 | 99) << 8 | 1])
    own = context_tree.log_kt(zeros, ones)
    top = context_tree.Top(keys, zeros, ones, own - np.array([1e-3, 2.0]))
    at = int(top.pair[97 << 8 | 98]) << 8 | 1
    assert math.isclose(top.depths[0][1][at], 1.5 / (2.0**31 + 3), rel_tol=1e-12)
    assert math.isclose(top.depths[0][2][at], 1 / (1 + math.exp(-1e-3)), rel_tol=1e-4)
    assert math.isclose(top.depths[1][0][97 << 8 | 1], (2.0**31 + 4.5) / (2.0**31 + 11), rel_tol=1e-12)


def test_context_tree_edges(spark, docs, none):
    marked = lambda df: df.select("doc_id", "text", F.lit(False).alias("held_out"))
    rows = context_tree.score(marked(docs)).collect()
    assert len(rows) == len(TEXTS) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert sorted(r.n_tokens for r in rows)[:4] == [1, 1, 1, 1]
    assert context_tree.score(marked(none)).count() == 0
    unlearned = context_tree.score(docs.filter("doc_id = 8").select("doc_id", "text", F.lit(True).alias("held_out"))).collect()[0]
    assert (unlearned.n_known, unlearned.train_tokens) == (0, 0) and math.isclose(unlearned.score, -8 * math.log10(2) * len("one two\n"), rel_tol=1e-6)


def test_multi_index_edges(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(30)]
    rows += [(30, None), (31, [0.0] * 4), (32, [1.0, None, 0.0, 0.0]), (33, [float("nan"), 1.0, 1.0, 1.0]), (34, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (35, [1.0, 2.0]), (36, rows[3][1]), (37, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    out = multi_index.search(df, is_query=F.col("vec_id") % 10 == 0, k=5, recall=1.0).collect()
    ok = {i: np.array(v) for i, v in rows if i is not None and i not in range(30, 36)}
    for q in (0, 10, 20):
        want = sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q))[:5]
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == [i for _, i in want] and np.allclose([r.score for r in own], [-s for s, _ in want], rtol=0, atol=1e-12)
    assert {r.query_id for r in out} == {0, 10, 20}
    assert multi_index.search(df.filter("vec_id = -1"), is_query=F.lit(True)).count() == 0
    few = multi_index.search(df.filter("vec_id < 3"), is_query=F.lit(True), k=20).collect()
    assert len(few) == 6


@pytest.mark.parametrize(("shape", "most"), [("clusters", 0.25), ("none", 0.8), ("hot", 0.8)])
def test_multi_index_prunes_and_finds(spark, shape, most):
    """Recall of all queries, not of those tried, and the share of rows scored; vectors of norms about 1,000 as well."""
    rng = np.random.default_rng(21)
    n, d = 6000, 32
    m = rng.normal(size=(n, d))
    if shape == "clusters":
        m = m * 0.3 + rng.normal(size=(60, d))[rng.integers(0, 60, n)]
    if shape == "hot":
        m[: n // 3] = 1000 * m[0]  # a third of all rows is one vector: ties go by id
    df = spark.createDataFrame([(k, v) for k, v in enumerate(m.tolist())], "vec_id long, embedding array<double>")
    rows = multi_index.search(df, is_query=F.col("vec_id") % 10 == 0, k=10).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r)
    hit, near = 0, m @ m.T
    for q in range(0, n, 10):
        own = near[q].copy()
        own[q] = -np.inf
        best = set(np.lexsort((np.arange(n), -own))[:10].tolist())
        hit += len(best & {r.vec_id for r in found[q]})
    scored = np.mean([r[0].n_scored for r in found.values()]) / n
    assert hit / (10 * len(found)) >= 0.9 and len(found) == n // 10
    assert scored <= most


def test_blocks_hold_each_cell():
    counts = np.array([0, 5000, 10, 0, 4000, 90, 9000, 0, 3])
    index = multi_index.Index(np.zeros((3, 1)), np.zeros((3, 1)), counts)
    assert all(index.low[index.block[c]] <= c < index.high[index.block[c] + index.parts[c] - 1] for c in np.flatnonzero(counts))
    assert index.parts[[1, 2, 4, 5, 6, 8]].tolist() == [2, 1, 1, 1, 3, 1]
    held = np.bincount(index.block, weights=np.where(index.parts == 1, counts, 0), minlength=len(index.low))
    assert held.max() <= multi_index.BLOCK


def test_visit_goes_by_falling_sum():
    rng = np.random.default_rng(7)
    f, s, counts = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 5, 63)
    seen = multi_index.visit(f, s, counts, 10**9)
    sums = [f[i] + s[j] for i, j in seen]
    assert len(set(seen)) == 63 and all(a >= b - 1e-12 for a, b in zip(sums, sums[1:]))


def test_licenses(spark, docs, none):
    text = "intro\nLicensed under the Apache License, Version 2.0;\nyou may not use this file\nexcept in compliance with the License\nmore MIT  License\nunder CC-BY and cc by"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "released under the mit"), (4, "released under the mit")], "doc_id long, text string").withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].base_labels) == brute.phrases(text, licenses.PHRASES)[:2] + (brute.phrases(text, licenses.PHRASES)[4],)
    assert got[1].base_labels == "apache,cc-by,mit" and "apache-2.0" in got[1].labels.split(",") and got[1].score == 1
    assert (got[2].n_words, got[2].labels, got[2].score, got[2].first_word) == (0, "", 0.0, None)
    assert licenses.scan(none).count() == 0 and licenses.scan(docs).count() == len(TEXTS)


def test_every_window_that_holds_enough_of_a_template_is_found(spark):
    """Against all windows of all words; a match is a stretch of windows that meet and overlap, with its best containment."""
    rng = np.random.default_rng(8)
    templates = [(" ".join(rng.choice(list("abcdefghijklmnop"), 9)), f"t{k}") for k in range(6)]
    texts = [(k, "\n".join(" ".join(rng.choice(list("abcdefghijklmnopqrst"), int(rng.integers(0, 7)))) for _ in range(int(rng.integers(1, 12))))) for k in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.score, {(m.label, round(m.containment, 9)) for m in r.matches}) for r in licenses.scan(df, templates=templates, threshold=0.8).collect()}
    for k, t in texts:
        words, want = t.split(), set()
        for template, label in templates:
            own = set(template.split())
            reach, last, best = math.ceil(len(template.split()) / 0.8 - 1e-9), None, 0.0
            for first, w in enumerate(words):
                share = len(own & set(words[first : first + reach])) / len(own)
                if w in own and share >= 0.8 - 1e-9:
                    if last is not None and first >= last + reach:
                        want.add((label, round(best, 9)))
                        best = 0.0
                    last, best = first, max(best, share)
            if last is not None:
                want.add((label, round(best, 9)))
        assert got[k][1] == want and math.isclose(got[k][0], max((c for _, c in want), default=0.0), abs_tol=1e-9)


def test_licenses_however_they_are_wrapped(spark):
    wording = licenses.TEMPLATES[0][0].split()
    shapes = {
        1: " ".join(wording),
        2: "\n".join(" ".join(wording[k : k + 4]) for k in range(0, len(wording), 4)),
        3: "\n".join(wording),
        4: "\n\n".join(" ".join(wording[k : k + 6]) for k in range(0, len(wording), 6)),
        5: "\n".join(" * " + " ".join(wording[k : k + 3]) + " *" for k in range(0, len(wording), 3)),
        6: " ".join(wording[: len(wording) // 2]),
        7: " filler ".join(wording),
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(shapes.items()), "doc_id long, text string")).collect()}
    assert all(got[k].labels == "mit" and got[k].score == 1 for k in (1, 2, 3, 4, 5))
    assert all(got[k].labels == "" and got[k].score == 0 for k in (6, 7))


def test_licenses_of_like_wording_are_told_apart(spark):
    texts = {
        "released under the license of the publisher": "",
        "Licensed under the license, version 2.0 of the vendor": "",
        "Licensed under CC BY 3.0": "cc-by",
        "GNU General Public License": "gpl",
        "Licensed by the state under rule 4, cc 0": "",
        "This work is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
        "This work is licensed under the GNU General Public License, version 2, or any later": "gpl,gpl-2.0",
        "Licensed under CC BY 4.0": "cc-by,cc-by-4.0",
        "Licensed under\n# the Apache License,\n# Version 2.0": "apache,apache-2.0",
        "it is released under the MIT license.": "mit",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values())


def test_toxicity_learns_from_positive_and_unlabelled_rows(spark, docs, none):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(1200):
        w = [f"w{x}" for x in rng.integers(0, 400, 30)]
        if bad := k % 6 == 0:
            w[5:8] = ["vile", "nasty", f"bad{k % 3}"]
        rows.append((k, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    labels = df.filter("doc_id % 2 = 0").select("doc_id", F.col("truth").alias("toxic"))
    model = toxicity.train(df.filter("doc_id < 900").select("doc_id", "text"), labels)
    out = toxicity.score(df.filter("doc_id >= 900"), model).collect()
    assert sum((r.toxicity >= 0.7) == (r.truth == 1) for r in out) >= 0.98 * len(out)
    scored = toxicity.score(docs.withColumn("Toxicity", F.lit("x")), model)
    assert scored.count() == len(TEXTS) and toxicity.score(none, model).count() == 0
    assert all(0 <= r.toxicity <= 1 for r in scored.select("toxicity").collect())
    nothing = toxicity.train(none, labels)
    assert all(r.toxicity < 0.01 for r in toxicity.score(docs, nothing).collect())


def test_toxicity_with_repeated_ids_and_on_spark(spark):
    """Ids that repeat many times drop no confirmed row; steps as Spark jobs end where those on the driver do."""
    rng = np.random.default_rng(16)
    rows = []
    for k in range(400):
        w = [f"w{x}" for x in rng.integers(0, 200, 20)]
        if k % 8 == 0:
            w[5:8] = ["vile", "nasty", f"bad{k % 3}"]
        rows += [(k, " ".join(w))] * (100 if k % 50 == 1 else 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(0, 400, 3)] + [(24, 0), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, model).collect()}
    assert all((s >= 0.7) == (i % 8 == 0) for i, s in got.items())
    near, far = (toxicity.train(df, labels, steps=8, local_sets=n) for n in (10**6, 0))
    assert near.weights.keys() == far.weights.keys() and len(near.weights) > 3
    assert math.isclose(near.bias, far.bias, rel_tol=1e-9) and all(math.isclose(w, far.weights[f], rel_tol=1e-9) for f, w in near.weights.items())


def test_toxicity_equals_a_plain_fit(spark):
    """Scores against features, counts and risk worked out one row at a time, the gradient by the risk's own differences."""
    rng = np.random.default_rng(17)
    rows = []
    for k in range(160):
        w = [f"w{x}" for x in rng.integers(0, 30, 6)]
        if k % 5 == 0:
            w[2:4] = ["Vileness", f"bad{k % 2}"]
        rows.append((k, " ".join(w) + "!"))
    labels = {k: int(k % 5 == 0) for k in range(0, 160, 2)}
    df, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model = toxicity.train(df, marked, steps=40)
    want = brute.nnpu(rows, labels, steps=40)
    for r in toxicity.score(df, model).collect():
        assert abs(r.toxicity - want[r.doc_id]) < 1e-4


def test_toxicity_stage_keeps_columns_of_any_name(spark, docs, tmp_path):
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own = docs.withColumns({"Toxicity": F.lit("own"), "_toxicity": F.lit("own"), "kind": F.lit("own")})
    out = toxicity.toxicity_stage(spark, own, str(tmp_path))
    assert out.columns == own.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, own.collect()))
    assert toxicity.toxicity_stage(spark, own.filter("doc_id = -1"), str(tmp_path)).count() == 0


def test_toxicity_workers_take_little_memory(spark, monkeypatch):
    """A worker's numpy arrays and words stay small, however many distinct words go by; texts go to Python, not back."""
    made = {}
    real = shared.map_arrow
    monkeypatch.setattr(shared, "map_arrow", lambda df, run, schema: made.setdefault("run", run) and real(df, run, schema))
    rng = np.random.default_rng(18)
    batches = [pa.record_batch({"doc_id": pa.array(range(1500)), "text": pa.array([" ".join(f"w{x}" for x in r) for r in rng.integers(0, 10**9, (1500, 200)).tolist()])}) for _ in range(3)]
    model = toxicity.Model({f"w{k}": 1.0 for k in range(100)}, -3.0, 0.1)
    df = spark.createDataFrame([(1, "w5 x"), (2, None), (3, "w7 w5 w7")], "doc_id long, text string")
    whole = toxicity.score(df, model)
    tracemalloc.start()
    rows = sum(b.num_rows for b in made["run"](iter(batches)))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == 4500 and peak < 40
    lean = toxicity.score(df, model, without=["text"])
    assert lean.columns == ["doc_id", "toxicity"] and whole.columns == ["doc_id", "text", "toxicity"]
    assert sorted(lean.collect()) == sorted(whole.drop("text").collect())


def test_nnpu_finds_positives_among_the_unlabelled():
    """A quarter of the positives is confirmed; the rest stands unlabelled, and still scores high."""
    rng = np.random.default_rng(10)
    n, d = 3000, 60
    truth = np.arange(n) % 3 == 0
    on = rng.random((n, d)) < 0.05
    on[:, 0] = truth & (rng.random(n) < 0.9)
    on[:, 1] = False
    positive = truth & (np.arange(n) < n // 4)
    w, b = toxicity.fit_nnpu(np.nonzero(on), d, positive, (truth & ~positive).sum() / (~positive).sum())
    g = on @ w + b
    hidden = truth & ~positive
    assert (g[hidden & on[:, 0]] > 0).mean() > 0.95 and (g[~truth] > math.log(0.7 / 0.3)).mean() < 0.05 and w[1] == 0
    again = toxicity.fit_nnpu(np.nonzero(on), d, positive, (truth & ~positive).sum() / (~positive).sum())
    assert (again[0] == w).all() and again[1] == b


def test_byte_bpe(spark, docs, none):
    import tiktoken

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    code = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(ranks), special_tokens={})
    encoded = byte_bpe.encode(docs, ranks=ranks, pattern=public_tokenizers.PATTERN)
    want = sorted(repr((i, code.encode_ordinary(t or ""))) for i, t in TEXTS)
    assert sorted(repr((r.doc_id, r.ids)) for r in encoded.collect()) == want
    back = byte_bpe.decode(encoded, ranks=ranks, pattern=public_tokenizers.PATTERN).collect()
    assert sorted(repr((r.doc_id, bytes(r.decoded))) for r in back) == sorted(repr((i, (t or "").encode())) for i, t in TEXTS)
    assert byte_bpe.encode(none, ranks=ranks, pattern=public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_on_random_texts():
    import random

    import tiktoken

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    code = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(ranks), special_tokens={})
    own = byte_bpe._loaded(ranks, public_tokenizers.PATTERN)
    import pyarrow as pa

    random.seed(11)
    pieces = ["a", "B", " ", "  ", "\n", "\r\n", "\t", "'s", "'LL", "1", "234", "é", "Ž", "ß", "\u00a0", "\u3000", "漢", "\U0001f600", "e\u0301", ".", "!!", "_", "\x00", "don't", "İ", "ſ", "#", "&&", "$a", "=", "~", "<|", "|>", "é#", "antidisestablishmentarianism"]
    texts = ["".join(random.choices(pieces, k=random.randrange(0, 40))) for _ in range(3000)]
    ids, offsets = own.chunked(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == code.encode_ordinary(t), t


def test_word_ids_on_random_texts():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    code, own = Tokenizer.from_file(WORDS), shared.word_bpe(WORDS)
    random.seed(12)
    pieces = ["a", "B", " ", "  ", "\n", "\t", "\x0b", "'s", "'LL", "1", "234", "é", "Ž", "\u00a0", "\u3000", "漢", "\U0001f600", "e\u0301", "\u0338", ".", "!!", "(", ")", "_", "\x01", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "İ", "K", "#", "&&", "$a", "=", "~", "[", "é#", "antidisestablishmentarianism"]
    texts = ["".join(random.choices(pieces, k=random.randrange(0, 40))) for _ in range(3000)]
    ids, offsets = own(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == code.encode(t, add_special_tokens=False).ids, t


def test_chunk_encoder_starts_anew_and_tells_chunks_apart():
    """Chunks that differ in length or in zero bytes alone, long ones, and a memory of a few chunks."""
    import random

    import pyarrow as pa

    starts = lambda data: np.append(True, data[:-1] == 0x20)
    coded = lambda chunks: (np.array([2] * len(chunks), dtype=np.int32), np.array([x for c in chunks for x in (len(c), zlib.crc32(c))], dtype=np.uint32))
    random.seed(13)
    pool = ["", "\x00", "\x00\x00", "a", "a\x00", "x" * 14, "x" * 15, "x" * 16, "y" * 40, *(f"{k:x}" for k in range(300))]
    texts = [" ".join(random.choices(pool, k=random.randrange(0, 30))) for _ in range(400)]
    for keep, long_bytes in ((10, 1 << 20), (10**6, 50), (10**6, 1 << 20)):
        encoder = shared.ChunkEncoder(starts, coded, keep=keep, long_bytes=long_bytes)
        for a in range(0, 400, 40):
            ids, offsets = encoder(pa.array(texts[a : a + 40]))
            for k, t in enumerate(texts[a : a + 40]):
                raw = t.encode()
                cuts = [0, *(i + 1 for i, b in enumerate(raw[:-1]) if b == 32)]
                want = [raw[x:y] for x, y in zip(cuts, [*cuts[1:], len(raw)])] if raw else []
                assert ids[offsets[k] : offsets[k + 1]].tolist() == [x for c in want for x in (len(c), zlib.crc32(c))]
    table = shared.KeyTable()
    keys = np.arange(500_000, dtype=np.uint64)
    for part in np.array_split(keys, 9):
        assert (table.find(part, part % np.uint64(3)) == -1).all()
        table.add(part, part % np.uint64(3))
    assert (table.find(keys, keys % np.uint64(3)) == np.arange(500_000)).all() and (table.find(keys, keys % np.uint64(3) + np.uint64(1)) == -1).all()


def test_line_cleaning(spark, docs, none):
    body = "This is a sentence with enough words to stand on its own, and it ends well."
    text = f"{body}\nHome | About | Contact\n{body} More.\nClick here to read more\n\n#### $$$$ %%%%\nhello there"
    df = spark.createDataFrame([(1, text), (2, "\n".join(["Home", "About", body, "Menu"])), (3, "Home | About | News | Shop\n" * 30 + body)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_cleaning.clean_lines(df).collect()}
    assert got[1].clean_text == f"{body}\n{body} More.\n" and got[1].lost > 0
    assert got[2].kept and not got[3].kept
    again = line_cleaning.clean_lines(docs).collect()
    assert len(again) == len(TEXTS) and all(isinstance(r.n_words, int) for r in again)
    for r in again:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_quality(r.text)
    assert line_cleaning.clean_lines(none).count() == 0
