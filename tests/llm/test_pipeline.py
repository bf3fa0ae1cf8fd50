"""The queries of the subpackage and the pipeline on the smallest tables."""

import functools
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402

from segstats.llm import common, mixing, packing, simhash  # noqa: E402
from segstats.llm.components import connected  # noqa: E402
from segstats.scale import settle  # noqa: E402


@pytest.mark.parametrize("n", range(1, 14))
def test_query_returns_a_row_per_document(spark, n):
    (name,) = [q for q in entry.queries() if q.startswith(f"op{n}_")]
    out = entry.queries()[name](spark, cases.SF)
    if n == 12:  # a row per node
        assert out.where("depth = 0").count() == 1 and out.count() > common.table(spark, cases.SF, "conversations").select("conv_id").distinct().count() / 2
        return
    table = common.table(spark, cases.SF, "pages" if n == 10 else "documents")
    ident = "page_id" if n == 10 else "doc_id"
    assert out.select(ident).distinct().count() == table.count()
    if n != 6:
        assert out.count() == table.count()


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    docs = common.table(spark, cases.SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, cases.SF))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "exact dedup", "near dedup"):
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty() and docs.count() <= before.count() - (name == "exact dedup")
    exact = seen["exact dedup"].collect()
    assert len({r["text"].lower() for r in exact}) == len(exact)
    stays = {r["doc_id"] for r in seen["near dedup"].collect()}
    pairs = cases.similar_pairs([(r["doc_id"], r["text"]) for r in exact])
    assert pairs and not [p for p in pairs if stays.issuperset(p)]
    assert {r["doc_id"] for r in exact} - stays <= {d for p in pairs for d in p}
    mixed = seen["mixing"]
    copies = mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert 1 <= copies <= mixing.REPEATS
    assert docs.where("piece = 0").count() == mixed.count()


def test_pipeline_runs_on_awkward_rows(spark):
    docs = cases.awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, cases.SF))
    assert docs.count() > 0


def _edited(words, every, rnd):
    return [w if k % every else f"new{rnd.randrange(10 ** 6)}" for k, w in enumerate(words)]


def test_near_copies_are_found_and_strangers_stay(spark):
    """Copies with scattered words changed, with a block changed, cut and grown, short and long; a group of many copies; strangers of few common words."""
    rnd, texts = random.Random(8), []
    for n in (40, 120, 400, 1500):
        for _ in range(12):
            words = [f"w{rnd.randrange(3000)}" for _ in range(n)]
            block = max(1, n // 12)
            texts += [words, _edited(words, max(50, n // 3), rnd), words[:n // 2] + [f"x{rnd.randrange(10 ** 6)}" for _ in range(block)] + words[n // 2 + block:],
                      words[: n - n // 10], words + [f"y{k}" for k in range(n // 10)]]
    hub = [f"w{rnd.randrange(3000)}" for _ in range(300)]
    texts += [_edited(hub, rnd.randrange(60, 200), rnd) for _ in range(60)] + [[rnd.choice(["der", "die", "und", "in"]) for _ in range(80)] for _ in range(20)]
    texts = [" ".join(t) for t in texts]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    rows = [(d, texts[k]) for d, k in enumerate(order)] + [(None, None), (2000, ""), (2001, " \n")]
    docs = cases.docs(spark, [t for _, t in rows], [d for d, _ in rows])
    kept = [r["doc_id"] for r in simhash.keep_one_of_similar(docs).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= {d for d, _ in rows}
    pairs = cases.similar_pairs(rows)
    both = [p for p in pairs if set(p) <= set(kept)]
    assert len(pairs) > 1500 and len(both) <= 0.02 * len(pairs)
    assert {d for d, _ in rows} - set(kept) <= {d for p in pairs for d in p}
    assert [d for d in kept if d is None or d >= 2000] == [2000]  # three texts without words are one group, named by a doc_id


def test_components_of_chains_stars_and_pairs(spark):
    rnd = random.Random(9)
    links = [(i, i + 1) for i in range(100)] + [(500, k) for k in range(501, 560)] + [(700, 701), (701, 700), (900, 900)]
    rnd.shuffle(links)
    found = {r["node"]: r["label"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(101)} | {k: 500 for k in range(500, 560)} | {700: 700, 701: 700}


def test_near_copies_in_a_chain_are_one_group(spark):
    rows = spark.createDataFrame([(i, (1 << 3 * i) - 1) for i in range(12)], "doc_id long, fp long")
    assert {r["component_id"] for r in simhash.components(rows).collect()} == {0}


def test_capacities_refuse_pieces_that_fit_nowhere():
    with pytest.raises(ValueError):
        packing.plan({50: 1}, packing.Capacities(100, attention=2000))


def test_a_sketch_never_turns_a_similar_pair_away(spark):
    """The sketch bounds the difference of two sets from below, and long fingerprints carry it; a group of unlike texts makes few pairs."""
    rnd = random.Random(10)
    for n in (0, 1, 5, 60, 146, 900, 5000):
        words = [f"w{rnd.randrange(4000)}" for _ in range(n)]
        for every in (7, 30, 90):
            a, b = (simhash._shingle_hashes(" ".join(w).encode()) for w in (words, _edited(words, every, rnd)))
            one, two = simhash.parity_sketch(a), simhash.parity_sketch(b)
            bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(one[:-1], two[:-1]))
            assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and (one[-1], two[-1]) == (len(a), len(b))
            shared = len(set(a.tolist()) & set(b.tolist()))
            row = spark.createDataFrame([([0] * simhash.LANES + one, [0] * simhash.LANES + two)], "a array<bigint>, b array<bigint>")
            if shared >= simhash.SIMILAR * (len(a) + len(b) - shared):
                assert row.select(simhash._candidates("a", "b")).first()[0]


def test_two_blocks_meet_at_one_variant(spark):
    """Blocks within 2 bits share variants and are taken at exactly one of them."""
    rnd = random.Random(11)
    for k in (0, 3, 7):
        base = [rnd.getrandbits(63) for _ in range(simhash.LANES + simhash.PARITIES + 1)]
        for flips in ((), (0,), (31,), (3, 17), (30, 31)):
            other = list(base)
            for bit in flips:
                other[k // 2] ^= 1 << bit + 32 * (k % 2)
            other[k // 2] -= (1 << 64) * (other[k // 2] >> 63)
            blocks = [(x[k // 2] >> 32 * (k % 2)) & 0xFFFFFFFF for x in (base, other)]
            balls = [{b, *(b ^ 1 << j for j in range(32))} for b in blocks]
            keys = spark.createDataFrame([(base, other, (k << 32) | v) for v in balls[0] & balls[1]], "a array<bigint>, b array<bigint>, key bigint")
            assert keys.where(simhash._meet_here("a", "b")).count() == 1


def test_a_node_lists_the_variants_where_it_is_taken(spark):
    """Every pair of blocks within 2 bits is taken at one variant that both nodes list, and no other variant is listed."""
    rnd = random.Random(12)
    hubs = [rnd.getrandbits(32) for _ in range(16)]
    fps = []
    for node in range(60):
        blocks = [h ^ sum(1 << b for b in rnd.sample(range(32) if k % 3 else [0, 1, 2, 30, 31], rnd.randrange(3))) for k, h in enumerate(hubs[:2 * simhash.LANES])]
        lanes = [blocks[2 * k] | blocks[2 * k + 1] << 32 for k in range(simhash.LANES)]
        fps.append((node, [x - ((1 << 64) * (x >> 63)) for x in lanes] + [0] * (simhash.PARITIES + 1), blocks))
    expected = set()
    for a, _, one in fps:
        for b, _, two in fps:
            for k, (x, y) in enumerate(zip(one, two)):
                if a != b and (x ^ y).bit_count() <= 2:
                    low = (x ^ y) & -(x ^ y)
                    expected |= {(node, k << 32 | min(x ^ low, y ^ low)) for node in (a, b)}
    nodes = spark.createDataFrame([r[:2] for r in fps], "node long, fp array<bigint>")
    met = simhash._collisions(nodes)
    listed = simhash._listed(functools.reduce(lambda x, y: x.unionByName(y), met), nodes).collect()
    assert sorted((r["node"], k) for r in listed for k in r["keys"]) == sorted(expected)


def test_texts_are_shuffled_once_for_near_copies(spark):
    """With tables too large to broadcast the kept rows are found where the texts lie, and rows that repeat doc_id and text stay once."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    try:
        out = simhash.keep_one_of_similar(cases.docs(spark, ["one two three", "four five six", "one two three", None], [5, 6, 5, 7]))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert sorted(r["doc_id"] for r in out.collect()) == [5, 6, 7]
    finally:
        for n, v in zip(names, before):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
