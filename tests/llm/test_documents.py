"""The ten operators on awkward rows, on empty tables and against brute force."""

import collections
import hashlib
import os
import random
import sys
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases  # noqa: E402
import public_tokenizers  # noqa: E402

from segstats.llm import common, exact, html, imatch, mixing, packing, quality, simhash, substring, token_shards, tokens, toxicity  # noqa: E402

RUN = uuid.uuid4().hex  # tables of earlier runs may be left in the warehouse
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
key = lambda x: tuple((v is not None, str(v)) for v in x)


def same(found, expected):
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)


@pytest.fixture(scope="module")
def awkward(spark):
    common.prepare(spark)
    return cases.awkward(spark).cache()


@pytest.fixture(scope="module")
def rows(awkward):
    return [(r["doc_id"], r["text"]) for r in awkward.collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    common.prepare(spark)
    return cases.docs(spark, [])


@pytest.fixture(scope="module")
def table(spark):
    return common.table(spark, cases.SF, "documents")


@pytest.fixture(scope="module")
def table_rows(table):
    return [(r["doc_id"], r["text"]) for r in table.collect()]


# ---------------------------------------------------------------- 1 fingerprints


def test_fingerprints_of_edited_and_next_texts(table, table_rows):
    found = {r["doc_id"]: r for r in imatch.fingerprints(table).collect()}
    order = sorted(table_rows, reverse=True)
    by_text = {}
    for (d, t), (_, n) in zip(order, [*order[1:], order[0]]):
        half = len(t) // 2
        assert (found[d]["n_chars"], found[d]["edited_sha256"]) == (len(t), hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest())
        assert by_text.setdefault(t, found[d]["fingerprint"]) == found[d]["fingerprint"]
        assert 0 <= found[d]["near_edited"] <= 1 and 0 <= found[d]["near_next"] <= 1
    assert np.mean([r["near_edited"] for r in found.values()]) > 10 * np.mean([r["near_next"] for r in found.values()])


def test_fingerprint_is_the_hash_of_the_sorted_lexicon_terms(spark, table, table_rows):
    """Brute force of the band, the subsets and the likeness, with the term hash of Spark."""
    kept = {r["term"] for r in imatch.lexicon(table).collect()}
    split = {d: [w for w in dict.fromkeys((t or "").lower().replace("\n", " ").replace("\t", " ").split(" ")) if w] for d, t in table_rows}
    words = sorted({w for ws in split.values() for w in ws})
    hashed = dict(zip(words, (r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect())))
    df = {}
    for ws in split.values():
        for w in ws:
            df[w] = df.get(w, 0) + 1
    n = len(table_rows)
    assert kept == {hashed[w] for w, k in df.items() if n * np.exp(-imatch.IDF_BAND[1]) <= k <= n * np.exp(-imatch.IDF_BAND[0])}
    found = {r["doc_id"]: r for r in imatch.fingerprints(table).collect()}
    for d in list(split)[:20]:
        mine = sorted(hashed[w] for w in split[d] if hashed[w] in kept)
        empty = [not [t for t in mine if t >> skip & density - 1 == i] for skip, density, many in imatch.DENSITIES for i in range(many)]
        parts = [found[d]["fingerprint"][k:k + 8] for k in range(0, 8 * len(empty), 8)]
        assert [p == "0" * 8 for p in parts] == empty


def test_fingerprints_of_awkward_rows(awkward, rows, nothing):
    found = imatch.fingerprints(awkward).collect()
    assert len(found) == len(rows)
    assert {r["fingerprint"] for r in found if r["n_chars"] == 0} == {"0" * 8 * sum(many for _, _, many in imatch.DENSITIES)}
    assert imatch.fingerprints(nothing).collect() == []


def test_half_changed_long_texts_keep_hashes_in_common(spark):
    texts = [" ".join(f"w{d}x{i}" for i in range(n)) for d, n in enumerate([6000, 1500, 5000, 300, 2000])]
    found = imatch.fingerprints(cases.docs(spark, texts)).collect()
    for r in found:
        assert r["near_next"] == 0 and (r["near_edited"] > 0.03 or r["doc_id"] == 3)


def test_texts_without_lexicon_terms_match_by_all_terms_only(spark):
    texts = ["the and of", "The and", "of and the", "the of", "", "  ", None]
    found = {r["doc_id"]: r for r in imatch.fingerprints(cases.docs(spark, texts)).collect()}
    prints = [found[i]["fingerprint"] for i in range(7)]
    assert prints[0] == prints[2] and len(set(prints)) == 4
    assert {p for p in prints if not p.strip("0")} == set(prints[4:]) and len(set(prints[4:])) == 1
    assert [found[i]["near_next"] for i in range(7)] == [0, 0, 0, 0, 0, 1, 1]


def test_lexicon_join_by_shuffle_gives_the_same(table, monkeypatch):
    before = imatch.fingerprints(table).collect()
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", -1)
    same(imatch.fingerprints(table).collect(), before)


# ---------------------------------------------------------------- 2 near copies


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_near_duplicates_equal_all_pairs(which, request):
    df = request.getfixturevalue(which)
    pairs = [(r["doc_id"], cases.simhash(r["text"])) for r in df.collect()]
    expected = [(d, f"{f:016x}", c) for (d, f), c in zip(pairs, cases.components(pairs))]
    same(simhash.near_duplicates(df).collect(), expected)


def test_links_of_random_fingerprints(spark):
    rng = random.Random(5)
    fps = [0] + [rng.getrandbits(64) for _ in range(30)]
    for f in list(fps):
        for k in range(6):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    found = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}


def test_one_of_each_group_stays(awkward, nothing):
    kept = simhash.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    expected = {r["component_id"] for r in simhash.near_duplicates(awkward).collect()}
    assert set(ids) == expected and len(ids) == len(expected)
    assert simhash.keep_one_of_each(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0


# ---------------------------------------------------------------- 3 and 6 tokens


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_pieces_give_the_ids_of_whole_texts(name, table_rows):
    enc = tokens.Encoder(public_tokenizers.path(name))
    assert enc.plain
    odd = ["", " ", "  ", " a", "a ", "a  b", "x\n y", "a\n\n b  c\td ", "foo <|endoftext|> bar<|endoftext|>", "don't we'll 'S", "é ́x", "ΣΣ Σ", "日本 語",
           "\x1c a \x85b", "İ ı", " a  b", "Straße. École?! 12,5", "a b.\nC\n\nd e\nf, g", "x \n\n\ny z\n", "a\nb c\n. d"]
    for text in odd + [t for _, t in table_rows]:
        assert enc.encode(text) == enc._whole(text), text[:80]


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    enc = tokens.Encoder(public_tokenizers.path(BYTE_BPE))
    for i in range(20):
        text = " ".join(f"{'w' * (j + 1)}{i}" for j in range(60))
        assert enc.encode(text) == enc._whole(text)
    assert len(enc.known) <= 5 + 60 and len(enc.known.older) <= 5 + 60


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_token_files_read_back(which, request, monkeypatch):
    df = request.getfixturevalue(which)
    out = token_shards.token_files(df, public_tokenizers.path(WORD_BPE)).collect()
    expected, at = [], 0
    for d, t in sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = cases.encoded(WORD_BPE, t)
        expected.append((d, at, len(ids), cases.crc(ids)))
        at += len(ids)
    same(out, expected)


def test_small_shards_hold_the_same(spark, table, table_rows):
    folder = token_shards.new_folder(spark)
    manifest = token_shards.write_shards(table, folder, public_tokenizers.path(WORD_BPE), ids_per_shard=5000)
    assert manifest.count() > 8
    out = token_shards.read_shards(spark, folder, manifest).collect()
    whole = token_shards.token_files(table, public_tokenizers.path(WORD_BPE)).collect()
    same(out, whole)


def test_shard_answers_by_key():
    keys = [(None, 0), (None, 1), *((d, 0) for d in range(500)), (7, 1)]
    data = token_shards.pack_shard(keys, [np.arange(i % 7, dtype="<u4").tobytes() for i in range(len(keys))], 70_000)
    shard = token_shards.Shard(data)
    assert sorted(shard.slots.tolist()) == list(range(len(keys)))
    for i, k in enumerate(keys):
        assert shard.get(*k).tolist() == list(range(i % 7))
    assert sum(shard.get(d) is not None for d in range(1000, 3000)) == 0
    assert token_shards.Shard(token_shards.pack_shard([], [], 100)).get(1) is None


def test_lookup_opens_only_the_shards_of_its_keys(spark):
    """Null ids, ids that fill several shards, ids before, between and beyond the shards; copies are given whole."""
    rows = [(d, f"text {d} " * (1 + d % 5)) for d in range(0, 400, 2)] + [(None, f"nobody {k}") for k in range(30)] + [(100, f"again {k} " * 8) for k in range(60)]
    docs = cases.docs(spark, [t for _, t in rows], [d for d, _ in rows])
    folder, path = token_shards.new_folder(spark), public_tokenizers.path(WORD_BPE)
    manifest = token_shards.write_shards(docs, folder, path, ids_per_shard=60)
    asked = [None, 0, 1, 98, 100, 102, 398, 399, -5, 1000, 100]
    keys = spark.createDataFrame([(d,) for d in asked], "doc_id long")
    found = token_shards.lookup(keys, folder, manifest).collect()
    coder = Tokenizer.from_file(path)
    want = collections.Counter((d, *coder.encode(t, add_special_tokens=False).ids, token_shards.END_ID) for d, t in rows if d in set(asked))
    assert collections.Counter((r["doc_id"], *r["ids"]) for r in found) == want
    opened = token_shards.shards_of(keys, manifest).collect()
    assert len({(r["part"], r["number"]) for r in opened}) < manifest.count() / 2
    assert len({(r["part"], r["number"]) for r in opened if r["doc_id"] == 100}) > 5
    assert max(collections.Counter(r["doc_id"] for r in opened if r["doc_id"] not in (None, 100)).values()) <= 2
    assert token_shards.lookup(keys.where("doc_id < -100"), folder, manifest).isEmpty()


def test_no_documents_no_tokens(nothing):
    assert token_shards.token_files(nothing, public_tokenizers.path(WORD_BPE)).count() == 0
    assert packing.pack_documents(nothing, public_tokenizers.path(BYTE_BPE)).count() == 0


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_packing_holds_every_piece_once(which, request):
    df = request.getfixturevalue(which)
    out = packing.pack_documents(df, public_tokenizers.path(BYTE_BPE)).collect()
    expected, total = [], 0
    for r in df.collect():
        ids = cases.encoded(BYTE_BPE, r["text"])
        total += len(ids)
        begin, end, piece = 0, (len(ids) - 1) % 1024 + 1, 0
        while begin < len(ids):
            expected.append((r["doc_id"], piece, begin, end - begin, cases.crc(ids[begin:end])))
            begin, end, piece = end, end + 1024, piece + 1
    same([r[:5] for r in out], expected)
    in_sequence = {}
    for r in out:
        in_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in in_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(in_sequence) <= 1.02 * total / 1024 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, None, None), (100, 3, None), (100, None, 4000), (100, 4, 6000)])
def test_vector_best_fit_keeps_every_constraint(rule, limits):
    rng = random.Random(1)
    histogram = {n: rng.randint(1, 40) for n in range(1, 61)}
    held = packing.Capacities(*limits, rule=rule)
    where = packing.plan(histogram, held)
    bins = {}
    for length, rows in where.items():
        ranks = [*rows[:, 0].tolist(), histogram[length]]
        for (first, sequence, each, offset), end in zip(rows.tolist(), ranks[1:]):
            for i in range(end - first):
                bins.setdefault(sequence + i // each, []).append((offset + i % each * length, length))
    assert sum(map(len, bins.values())) == sum(histogram.values())
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert (np.array([at, len(pieces), sum(n * n for _, n in pieces)]) <= held.limits).all()


def test_plan_equals_best_fit_of_single_pieces():
    """The counted form opens as many sequences as a loop over single pieces."""
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(400)]
    held = packing.Capacities(100, 5)
    residuals = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(residuals) if (r >= held.demand(n)).all()]
        if fits:
            scores = held.scores(np.array([residuals[i] for i in fits]), held.demand(n))
            best = fits[int(np.argmin(scores))]
        else:
            residuals.append(held.limits.copy())
            best = len(residuals) - 1
        residuals[best] = residuals[best] - held.demand(n)
    where = packing.plan({n: lengths.count(n) for n in set(lengths)}, held)
    many = 1 + max(int(s + (end - first - 1) // each) for n, rows in where.items()
                   for (first, s, each, _), end in zip(rows.tolist(), [*rows[1:, 0].tolist(), lengths.count(n)]))
    assert abs(many - len(residuals)) <= 1


# ---------------------------------------------------------------- 4 and 7 classifiers


def labelled(spark, good=60, n=400):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    rows, marks = [], []
    for d in range(n):
        bad = d % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if bad:
            for _ in range(4):
                text[rng.randrange(10)] = rng.choice(["zzgrunk", "zzvex", "zzgrunkle", "qqspite"])
        rows.append(" ".join(text))
        marks.append((d, 0 if d % 5 == 0 else 1, int(bad)))
        if d % 5 == 0:
            rows[-1] = " ".join(w.upper() + "!!" for w in text[:10] * 4)
    return cases.docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_held_out_rows(spark, operator, label):
    docs, labels = labelled(spark)
    out = operator.classify(docs, labels).join(labels, "doc_id").collect()
    assert len(out) == 400 and {r["held_out"] for r in out} == {True, False}
    held = [r for r in out if r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([r["predicted"] == r[label] for r in held]) > 0.95


@pytest.mark.parametrize("operator,label,none", [(toxicity, "toxic", 0.0), (quality, "quality", 0.5)])
def test_classifiers_without_labels(spark, awkward, nothing, operator, label, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in operator.classify(awkward, empty).collect()} == {none}
    labels = spark.createDataFrame([(3, 1, 1), (4, None, None), (5, 0, 0), (5, 1, 1), (8, 0, 0), (None, 1, 0)], empty.schema)
    assert operator.classify(awkward, labels).count() == awkward.count()
    assert operator.classify(nothing, labels).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same(toxicity.classify(docs, flipped).collect(), toxicity.classify(docs, labels).collect())


def test_toxic_documents_go_and_columns_stay(spark):
    docs, labels = labelled(spark)
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    kept = {r["doc_id"] for r in left.collect()}
    assert len(kept & toxic) <= 2 and len(kept - toxic) >= 0.99 * (400 - len(toxic))


def test_isotonic_fit():
    rng = np.random.default_rng(1)
    x, y, w = np.sort(rng.random(50)), rng.random(50), rng.integers(1, 9, 50).astype(float)
    out = quality.isotonic(x, y, w)
    assert (np.diff(out) >= 0).all() and np.isclose((out * w).sum(), (y * w).sum())
    for v in np.unique(out):  # each flat part holds its weighted mean
        assert np.isclose(v, np.average(y[out == v], weights=w[out == v]))


# ---------------------------------------------------------------- 5 repeats


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_repeats_equal_brute_force(which, request):
    df = request.getfixturevalue(which)
    out = substring.remove_repeats(df, with_text=False).collect()
    same(out, cases.repeats([(r["doc_id"], r["text"]) for r in df.collect()]))


def test_repeats_of_few_words_in_many_orders(spark):
    """Words of a small vocabulary repeat at every alignment; one very common passage."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + f" {passage if i % 3 == 0 else ''} tail{i}" for i in range(120)]
    df = cases.docs(spark, texts, rng.sample(range(1000), 120))
    out = substring.remove_repeats(df).collect()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    same([r[:4] for r in out], cases.repeats(rows))
    for r in out:
        words = dict(rows)[r["doc_id"]].split()
        gone = {i for s in r["repeats"] for i in range(s["first"], s["last"] + 1)}
        assert r["kept"] == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_no_documents_no_repeats(nothing):
    assert substring.remove_repeats(nothing).count() == 0


# ---------------------------------------------------------------- 8 mixing


def test_mixing_awkward_rows(awkward, rows, nothing):
    out = mixing.mix_plan(awkward).collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert sum(r["taken"] for r in out) >= sum(r["size"] for r in out) - 5
    same(mixing.mix_plan(awkward).collect(), out)
    assert mixing.mix_plan(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0


def test_targets_are_filled_from_below(spark):
    sizes = {"+a": 10, "+b": 1000, "+c": 1000, "+d": 5, "-": 7}
    out = {r["_source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "_source string, source_size long")).collect()}
    weights = dict(zip(sorted(sizes, key=lambda s: (s == "-", s)), (5, 2, 1, 5, 2)))
    assert abs(sum(out.values()) - sum(sizes.values())) < 1e-6
    level = max(out[s] / weights[s] for s in sizes)
    assert all(abs(out[s] - min(3 * sizes[s], weights[s] * level)) < 1e-6 for s in sizes)


def test_mixed_documents_are_whole_and_near_target(table):
    mixed = mixing.mix_documents(table)
    assert mixed.columns == table.columns
    plan = mixing.mix_plan(table).join(table.select("doc_id", "source"), "doc_id")
    words = mixed.groupBy("source").agg(F.sum(mixing.n_words()).alias("words"))
    longest = plan.agg(F.max("size")).first()[0]
    for r in plan.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).join(words, "source").collect():
        assert abs(r["taken"] - r["target"]) <= 1 and abs(r["words"] - r["target"]) <= longest / 2 + 1


# ---------------------------------------------------------------- 9 exact copies


def test_exact_decisions(spark, awkward, rows, nothing):
    out = exact.decisions(awkward, exact.DigestIndex(spark, f"exact_awkward_{RUN}")).collect()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    expected = {}
    for d, t in rows:
        expected.setdefault(lower(t), []).append(d)
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == len(expected)
    for r in out:
        group = next(g for t, g in expected.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(group) and r["keep_id"] == max((d for d in group if d is not None), default=None)
    assert exact.decisions(nothing, exact.DigestIndex(spark, f"exact_nothing_{RUN}")).count() == 0


def test_later_batches_meet_the_index(spark):
    index = exact.DigestIndex(spark, f"exact_batches_{RUN}", buckets=4)
    first, second = cases.docs(spark, ["A b", "c"], [1, 2]), cases.docs(spark, ["a B", "d", "D"], [9, 10, 11])
    assert {r["doc_id"] for r in exact.keep_first_seen(first, index).collect()} == {1, 2}
    again = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact.decisions(second, index).collect()}
    assert again == {9: (1, False), 10: (11, False), 11: (11, True)}
    assert index.read().count() == 3
    assert not any(r["kept"] for r in exact.decisions(second, index).collect()) and index.read().count() == 3
    spark.sql(f"drop table exact_batches_{RUN}")


def test_slices_of_one_batch_meet_in_the_index(spark):
    """Copies lie in several slices: the anti-join with what the earlier slices appended takes them out; the index ends with one row per text."""
    index = exact.DigestIndex(spark, f"exact_slices_{RUN}", buckets=4)
    docs = cases.docs(spark, [f"text {i % 10}" for i in range(100)], list(range(100)))
    out = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.decisions(docs, index, "a").collect()}
    assert out == {i: (90 + i % 10, 10, i >= 90) for i in range(100)}
    assert index.read().count() == 10 and index.read().agg(F.sum("group_size")).first()[0] < 100  # later slices found their digests there
    assert {r["doc_id"]: r["kept"] for r in exact.decisions(docs, index, "a").collect()} == {i: i >= 90 for i in range(100)}  # the batch again
    assert index.read().count() == 10 and not any(r["kept"] for r in exact.decisions(docs, index, "b").collect())
    spark.sql(f"drop table exact_slices_{RUN}")


def test_null_beside_minus_one_and_no_table_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = cases.docs(spark, ["a", "A", "b", None, ""], [-1, None, None, 5, 5])
    kept = [(r["doc_id"], r["text"]) for r in exact.keep_first_seen(docs, exact.DigestIndex(spark)).collect()]
    assert len(kept) == 3 and (-1, "a") in kept and (None, "b") in kept
    assert {t.name for t in spark.catalog.listTables()} == before


def test_index_is_read_without_a_shuffle(spark):
    index = exact.DigestIndex(spark, f"exact_plan_{RUN}", buckets=4)
    exact.keep_first_seen(cases.docs(spark, ["A b", "c"], [1, 2]), index)
    new = cases.docs(spark, ["x"], [3]).select(exact.digest(F.col("text")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))
    plan = new.join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    spark.sql(f"drop table exact_plan_{RUN}")


def test_kept_rows_keep_their_columns(spark, awkward, rows):
    kept = exact.keep_first_seen(awkward, exact.DigestIndex(spark, f"exact_rows_{RUN}"))
    assert kept.columns == awkward.columns
    assert kept.count() == len({(t or "").lower() for _, t in rows})


# ---------------------------------------------------------------- 10 pages

PAGE = """<html><head><title>x</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><header class="site-header"><h1>My Site</h1></header>
<div id="cookie-notice"><p>We use cookies and this is a long notice text, accept them please now.</p></div><div class="main-menu"><ul><li><a href=x>Home</a></li></ul></div>
<div class="content"><div class="post"><h1>Title here</h1><p>First paragraph with <b>bold</b> text &amp; more
 words to be long enough, really.<p>Unclosed one<br>with a break<ul><li>item one<li>item two</ul><blockquote>Quoted text of some length here.</blockquote>
<p>Second paragraph also <a href="a>b">a link</a> inside.</p><form><input><label>Mail</label></form></div>
<div class="comments"><h3>Comments</h3><p>Reader comment is a long text too, with many words in it to fool densities.</p></div></div>
<aside><p>Sidebar text that is long long long long long long</p></aside><footer>foot</footer></body></html>"""


def test_article_of_a_page():
    assert html.main_text(PAGE).split("\n") == [
        "Title here", "First paragraph with bold text & more words to be long enough, really.", "Unclosed one with a break", "item one", "item two",
        "Quoted text of some length here.", "Second paragraph also a link inside."]


@pytest.mark.parametrize("icon", ['<svg-icon name="x"></svg-icon>', "<title-bar>", "<template-x></template-x>", '<svg viewBox="0 0 1 1"/>', "<svg/>", '<svg a="/>"><title>no</title></svg>', "<svg\n><path d=''/></svg>"])
def test_text_after_icons_stays(icon):
    assert html.main_text(f"<p>a</p>{icon}<p>the rest</p>") == "a\nthe rest"


@pytest.mark.parametrize("page, text", [
    ("<head><meta charset=utf-8><title>t</title><body><p>article</p>", "article"), ("<html><head><link rel=x><p>article", "article"), ("<head><title>t</title>article", "article"),
    ("<ul><li class=share>x<li>y</ul><p>article</p>", "y\narticle"), ("<p class=notice>x<p>article</p>", "article"), ("<div><span class=share>x</div><p>article", "article"),
    ("<p><a class=share href=x>x<a href=y>y</a> article</p>", "y article"), ("<nav><ul><li>a<li>b</ul><p>c</nav><p>article", "article"),
    ("<div><span class=share><span>x</span>x</span>article</div>", "article"), ("<table><tr><td class=ad>x<td>article</table>", "article")])
def test_left_out_elements_end_where_others_do(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("wrap", ["div class=content-sidebar-wrap", "div class='post has-comments'", "div class='site header-fixed'", "div id=social-science", "form action=x", "div role=form"])
def test_wrappers_of_the_article_stay(wrap):
    article = "<h1>Title</h1><p>The text of the article, which is longer than the rest.</p><p>And more of it.</p>"
    expected = "Title\nThe text of the article, which is longer than the rest.\nAnd more of it."
    rest = "<nav><a href=x>Home</a></nav><div class=sidebar><p>Aside text.</p></div>"
    for inner in (article, f"<main>{article}</main>", f"<div class=sidebar><p>Latest posts</p></div><div>{article}</div>"):
        assert html.main_text(f"<body>{rest}<{wrap}>{inner}</{wrap.split()[0]}><div class=share>Share</div></body>") == expected


def test_main_inside_a_wrapper_stays_beside_long_comments():
    comments = "<div class=comments>" + "<p>A comment that is as long as can be.</p>" * 3 + "</div>"
    assert "The article." in html.main_text(f"<div class='page has-comments'><main><p>The article.</p></main></div>{comments}")


def test_awkward_pages(spark):
    pages = [None, "", "just text <b>x</b>", "<p>a<p>b<div>c", "<nav>menu</nav>", "<p>cut &am <a href='x", "<!-- open", "<" * 3000, "<p " * 3000, "<div>" * 3000 + "deep", "&lt;p&gt;&#233;&nbsp;x"]
    out = [r["text"] for r in html.extract(spark.createDataFrame([(i, "u", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")).orderBy("page_id").collect()]
    assert out[:6] == ["", "", "just text x", "a\nb\nc", "", "cut &am"] and out[6] == "" and out[9] == "deep" and out[10] == "<p>é x"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_table_keep_their_article(spark):
    import re
    from html import unescape
    for r in html.extract(common.table(spark, cases.SF, "pages")).join(common.table(spark, cases.SF, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_time_of_deep_pages_is_linear():
    """40,000 open elements in a few seconds, where the square of it would take minutes."""
    import time

    for page in ("<ul><li>aa" * 40_000, "<div>" * 40_000 + "x", "<main>a" * 20_000, "<table><tr><td>a" * 20_000):
        began = time.process_time()
        assert html.main_text(page)
        assert time.process_time() - began < 10


def test_comments_in_articles_go_and_articles_about_comments_stay():
    story = "<article><h1>T</h1><p>The story has many words in it and goes on for a while.</p></article>"
    text = html.main_text(f'<body>{story}<article class="comment"><p>A reader says something.</p></article>')
    assert text.startswith("T\nThe story") and "reader" not in text
    assert "goes on" in html.main_text('<body><article class="post has-comments"><h1>T</h1><p>The only story here goes on and on.</p></article>')


def test_training_takes_one_text_of_each_labelled_document(spark):
    """10,000 rows of one labelled doc_id with many texts: one text trains, the same in every order."""
    common.prepare(spark)
    docs = cases.docs(spark, [f"plain words number {i} idiot" for i in range(10_000)] + [f"plain words number {i}" for i in range(300)], [3] * 10_000 + list(range(100, 400)))
    labels = spark.createDataFrame([(3, 1)] + [(i, int(i % 7 == 0)) for i in range(100, 400)], "doc_id long, toxic int")
    models = [toxicity.fit(d, labels) for d in (docs, docs.orderBy(F.rand(5)))]
    assert (models[0].toxic, models[0].ordinary, list(models[0].coefficients)) == (models[1].toxic, models[1].ordinary, list(models[1].coefficients))
