"""Merkle manifest, prefix trie and streaming BPE against brute force and the library."""

import hashlib
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases  # noqa: E402
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from segstats.llm import bpe, common, merkle, trie  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
key = lambda x: tuple((v is not None, str(v)) for v in x)


def same(found, expected):
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


# ---------------------------------------------------------------- 11 manifest


def manifest_by_hand(df):
    return cases.merkle([tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()])


def test_manifest_of_awkward_rows(spark):
    common.prepare(spark)
    for docs in (cases.awkward(spark), cases.docs(spark, []), cases.docs(spark, ["Alone"])):
        same(merkle.verified(docs).collect(), manifest_by_hand(docs))


def test_manifest_over_several_blocks_and_levels(spark):
    """A language of many blocks with a last run of one node, many small languages, and none."""
    n = 8 * merkle.BLOCK * 8 + 1
    docs = spark.range(n + 300).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id")).alias("text"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"),
        F.when(F.col("id") < n, "en").when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("é"), F.col("id") % 70)).alias("lang"))
    same(merkle.verified(docs).collect(), manifest_by_hand(docs))


@pytest.mark.parametrize("sizes", [[1], [8, 9], [64, 65, 520], [700, 2]])
def test_butterfly_gives_every_node_its_proof(spark, sizes):
    rows = [(t, i, n, hashlib.sha256(f"{t},{i}".encode()).hexdigest()) for t, n in enumerate(sizes) for i in range(n)]
    found = merkle.climb(spark.createDataFrame(rows, "tree long, i long, n long, digest string")).collect()
    assert len(found) == len(rows)
    leaf = {(t, i): d for t, i, _, d in rows}
    for r in found:
        level, steps, i = [leaf[r["tree"], k] for k in range(sizes[r["tree"]])], [], r["i"]
        while len(level) > 1:
            run = level[i - i % 8:i - i % 8 + 8]
            steps.append((i % 8, "".join(run[:i % 8] + run[i % 8 + 1:])))
            level, i = [hashlib.sha256("".join(level[k:k + 8]).encode()).hexdigest() for k in range(0, len(level), 8)], i // 8
        assert (r["root"], [tuple(s) for s in r["path"]]) == (level[0], steps)


# ---------------------------------------------------------------- 12 trie

TURNS = "conv_id long, turn long, role string, text string, depth string, a int, c string"


def trie_by_hand(df):
    return cases.trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_awkward_conversations(spark):
    """Null and repeated turns, null roles, texts and ids, negative and large ids, groups without a first conversation, copies."""
    rnd = random.Random(5)
    extra = ("q", 1, "k")
    rows = [(c, rnd.choice([None, i, i, i // 2]), rnd.choice(["u", "a", None]), rnd.choice(["x y", "x", "", None, "z z z"]), *extra)
            for c in [*range(60), None, -3, -20, 125, 7000, 2**40] for i in range(rnd.randrange(1, 7))]
    rows += [(c, i, "u", "same text", *extra) for c in range(200, 260) for i in range(3)]
    made = spark.createDataFrame(rows, TURNS)
    same(trie.trie(made).collect(), trie_by_hand(made))


def test_trie_of_few_turns(spark):
    for rows in ([], [(5, 0, "u", "hello", None, None, None)], [(7, 0, "u", "hello", None, None, None)], [(20, 3, "u", "a b " * 50_000, None, None, None)]):
        made = spark.createDataFrame(rows, TURNS)
        same(trie.trie(made).collect(), trie_by_hand(made))


def test_trie_of_the_table(spark):
    table = common.table(spark, cases.SF, "conversations")
    same(trie.trie(table).collect(), trie_by_hand(table))


def test_lists_longer_than_a_range(spark):
    """Ids of one sequence in several ranges, negative ones too, pass as one stream."""
    ids = [-9000, -1, 0, 4095, 4096, 4097, 20_000, 2**60]
    ends = spark.createDataFrame([(c, 1, 2, 3) for c in ids] + [(c, 0, 0, 0) for c in (5, 3, trie.NULL)], "c long, depth long, a long, b long")
    found = {r["depth"]: r["ends"] for r in trie.list_hashes(ends.repartition(5)).collect()}
    assert found == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 0: hashlib.sha256(b"3,5").hexdigest()}


# ---------------------------------------------------------------- 13 encoding and decoding


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoders():
    """One as in production, one whose slices, blocks and open pieces are a few characters."""
    return bpe.Encoder(PATH), bpe.Encoder(PATH, slice_=7, block=5, open_=6)


ALPHABET = ["a", "b", " ", "  ", "\n", "'s", "'", "ll", "'l", "é", "1", "²", "!", "<|endoftext|>", "<|end", "　", "中", "\t", "guarantee", "ing", " guarantee",
            "\x1c", "́", "\x85", "'re", "aaaa", "\U0001f600", "x", "\xa0", "Ᲊ", "\U00032000", "\x00"]


def test_ids_of_random_texts_equal_the_library(library, encoders):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(1, 30))) for _ in range(3000)]
    want = [library.encode(text, add_special_tokens=False).ids for text in texts]
    for encoder in encoders:
        assert [list(encoder.ids(text)) for text in texts] == want
        assert [list(memoryview(ids).cast("I")) for ids in encoder.many(texts)] == want


def test_windows_of_a_matrix_equal_the_plain_merge(library, encoders):
    """Rows of many lengths, merged together."""
    rnd, rules = random.Random(6), encoders[0].rules
    words = ["".join(rnd.choice(["a", "e", "ing", "th", "é", "ß", "guarant", "1", "!"]) for _ in range(rnd.randrange(1, 9))).encode() for _ in range(3000)]
    assert rules.merged_windows(words) == [bpe.array("I", [rules.ids[t] for t in rules.merged(list(w))]).tobytes() for w in words]


def test_words_longer_than_any_window_equal_the_library(library, encoders):
    rnd = random.Random(4)
    texts = ["a" * 3000, " " * 3000 + "b", "!?" * 2000, "\n" * 1500 + " x", "7" * 3000, "guarantee" * 700, "ing" * 900]
    texts += ["".join(rnd.choice(["guarantee", "ing", "a", "ab", "tion"]) for _ in range(800)) for _ in range(4)]
    texts += ["".join(rnd.choice("abcdefghij"[:k]) for _ in range(4000)) for k in (2, 5, 10)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        for encoder in encoders:
            assert list(encoder.ids(text)) == want


def test_lookahead_of_a_small_merge_list():
    """ab, cd, then b+cd: what follows 'ab' changes it back to a|bcd only where b is free, so chains follow left edges."""
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "cd"), ("a", "bcd")]) == 3
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([("ab", "c"), ("a", "b")])


@pytest.mark.parametrize("seed", range(6))
def test_lookahead_is_sufficient(seed):
    """Random merge lists over two letters: tokens that end before the lookahead never change, whatever follows."""
    rnd = random.Random(seed)
    symbols, merges = ["a", "b"], []
    while len(merges) < 12:
        u, v = rnd.choice(symbols), rnd.choice(symbols)
        if u + v not in symbols:
            merges.append((u, v))
            symbols.append(u + v)
    number = {s: k for k, s in enumerate(symbols)}
    rules = bpe.Rules.__new__(bpe.Rules)
    rules.ranks = bpe._Ranks({(number[u], number[v]): number[u + v] for u, v in merges})
    ahead = bpe.sufficient_lookahead(merges)

    def ends(text):
        out, at = [], 0
        for t in rules.merged([number[c] for c in text]):
            at += len(symbols[t])
            out.append(at)
        return out

    for _ in range(300):
        text = "".join(rnd.choice("ab") for _ in range(60))
        whole = ends(text)
        for n in range(1, 60):
            stable = [e for e in ends(text[:n]) if e <= n - ahead]
            assert stable == [e for e in whole if e <= n - ahead][:len(stable)]


def test_decoding_any_ids_equals_the_library(library, encoders):
    rnd, rules = random.Random(5), encoders[0].rules
    some = sorted(rules.bytes_of_id)
    for _ in range(2000):
        ids = [rnd.choice(some) for _ in range(rnd.randrange(1, 8))]
        decoder = bpe.Decoder(rules)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.end() == library.decode(ids, skip_special_tokens=False)


def test_round_trip_of_awkward_rows(spark, library):
    common.prepare(spark)
    docs = cases.awkward(spark)
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same(bpe.round_trip(docs, PATH).collect(), want)
    assert bpe.round_trip(cases.docs(spark, []), PATH).collect() == []
    same(bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect(), [(d, t or "") for d, t in docs.select("doc_id", "text").collect()])


def test_files_of_another_kind_are_refused():
    with pytest.raises(ValueError):
        bpe.Rules(public_tokenizers.path("word_bpe_49k.json"))
