import numpy as np

from cairn.llm import mixing


def test_permutations_are_permutations():
    for size in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (0, 1, 12345678901234567890):
            assert sorted(mixing.permute(np.arange(size), size, key).tolist()) == list(range(size))
    assert mixing.permute(np.arange(1000), 1000, 1).tolist() != mixing.permute(np.arange(1000), 1000, 2).tolist()


def brute(docs, weights, slots, block, shard, seed, stripes, stripe_of):
    """The same mixture with one stripe a source unless told otherwise."""
    sources = sorted({s for _, t, s in docs if t and t.split()}, key=lambda s: (s is not None, str(s)))
    blocks = {}
    for s in sources:
        out = []
        for stripe in range(stripes.get(s, 1)):
            words = [w for d, t in sorted((d, t) for d, t, x in docs if x == s and t and stripe_of(s, d, t) == stripe) for w in t.split()]
            out += [words[i : i + block] for i in range(0, len(words), block)]
        blocks[s] = out
    p = np.array([weights.get(s, 0.0) for s in sources])
    p /= p.sum()
    used, out = dict.fromkeys(sources, 0), {}
    for h in range(-(-slots // shard)):
        n, slot = mixing.draws(h, min(shard, slots - h * shard), p, seed), 0
        for s, c in zip(sources, n):
            for _ in range(c):
                rnd, i = divmod(used[s], len(blocks[s]))
                at = int(mixing.permute(np.array([i]), len(blocks[s]), mixing._of(s) ^ (seed * 1000003 + rnd))[0])
                out[h, slot] = (s, rnd, at, " ".join(blocks[s][at]))
                used[s] += 1
                slot += 1
    return out


def test_against_brute_force(spark):
    docs = [(i, " ".join(f"w{i}_{j}" for j in range(i % 37)), ["a", "b", None][i % 3]) for i in range(120)]
    weights = {"a": 1.0, "b": 2.0, None: 3.0, "absent": 9.0}
    df = spark.createDataFrame([(d, t, "en", s) for d, t, s in docs], "doc_id bigint, text string, lang string, source string")
    got = {(r.shard, r.slot): (r.source, r.round, r.block, r.text) for r in mixing.mix_sources(df, weights, slots=300, block=16, shard=32, seed=4).collect()}
    assert got == brute(docs, weights, 300, 16, 32, 4, {}, lambda *x: 0)


def test_stripes_keep_every_token_and_full_rounds_use_every_block(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(50)), "en", "a") for i in range(200)], "doc_id bigint, text string, lang string, source string")
    rows = mixing.mix_sources(docs, {"a": 1.0}, block=16, shard=8, stripe_tokens=500).collect()
    assert sorted(w for r in rows for w in r.text.split()) == sorted(f"w{i}_{j}" for i in range(200) for j in range(50))
    assert {r["round"] for r in rows} == {0} and len({r.block for r in rows}) == len(rows)
    assert {d for r in rows for d in r.doc_ids} == set(range(200))
    again = mixing.mix_sources(docs.repartition(7), {"a": 1.0}, block=16, shard=8, stripe_tokens=500).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_shares_follow_the_weights(spark, documents):
    rows = mixing.mix_sources(documents, {"src0": 3.0, "src1": 1.0}, slots=4000, shard=100).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in rows}
    assert set(n) == {"src0", "src1"} and sum(n.values()) == 4000 and abs(n["src0"] / 4000 - 0.75) < 0.03


def test_edges(spark, edges, nothing):
    rows = mixing.mix_sources(edges, {"a": 1.0, "b": 1.0, "c": 1.0, None: 1.0}, slots=100).collect()
    assert {r.source for r in rows} == {"a", "b", "c", None}
    assert all(0 < r.n_tokens == len(r.text.split()) <= mixing.BLOCK for r in rows)
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.mix_sources(edges, {"zzz": 1.0}).count() == 0
    docs = mixing.as_documents(mixing.mix_sources(edges))
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.select("doc_id").distinct().count() == docs.count()


def test_a_small_source_that_is_gone_through_many_times(spark):
    docs = [(i, " ".join(f"w{i}_{j}" for j in range(9)), "few") for i in range(3)] + [(10 + i, "a b c d " * 20, "many") for i in range(9)]
    df = spark.createDataFrame([(d, t, "en", s) for d, t, s in docs], "doc_id bigint, text string, lang string, source string")
    rows = mixing.mix_sources(df, {"few": 5.0, "many": 1.0}, slots=200, block=8, shard=16, seed=9).collect()
    got = {(r.shard, r.slot): (r.source, r.round, r.block, r.text) for r in rows}
    assert got == brute(docs, {"few": 5.0, "many": 1.0}, 200, 8, 16, 9, {}, lambda *x: 0) and max(r["round"] for r in rows) > 3 * mixing.ROUNDS
