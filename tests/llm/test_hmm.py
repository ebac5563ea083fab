from itertools import product

import numpy as np
import pytest
from cairn.llm import hmm
from conftest_words import word_list


def model(seed=0, states=3, symbols=5):
    r = np.random.default_rng(seed)
    emit = r.random((states, symbols))
    move = r.random((states, states))
    start = r.random(states)
    return hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), (emit / emit.sum(1, keepdims=True)).astype(np.float32))


def paths(m, seq):
    for p in product(range(len(m.start)), repeat=len(seq)):
        yield p, m.start[p[0]] * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[k, s] for s, k in zip(seq, p)])


@pytest.mark.parametrize("piece", [2048, 3, 2, 1])
def test_likelihood_and_counts_are_sums_over_all_paths(monkeypatch, piece):
    """Also where sequences are cut into pieces of a few words."""
    monkeypatch.setattr(hmm, "PIECE", piece)
    m, seqs, times = model(), [[0, 1, 2, 3], [4], [2, 2, 0], [1, 0, 4, 4, 3, 2, 1]], np.array([1, 3, 2, 1])
    flat, size = np.array(sum(seqs, []), np.int32), np.array([len(s) for s in seqs])
    first = np.cumsum(size) - size
    like = hmm.forward(m, flat, first, size)
    counts = np.zeros((3, 5))
    start, moves, total = hmm.expected(m, flat, first, size, times, counts)
    want_counts, want_start, want_moves = np.zeros((3, 5)), np.zeros(3), np.zeros((3, 3))
    for s, ll, n in zip(seqs, like, times):
        whole = sum(p for _, p in paths(m, s))
        assert np.isclose(np.exp(ll), whole, rtol=1e-4)
        for path, p in paths(m, s):
            want_start[path[0]] += n * p / whole
            for a, b in zip(path, path[1:]):
                want_moves[a, b] += n * p / whole
            for x, k in zip(s, path):
                want_counts[k, x] += n * p / whole
    assert np.isclose(total, (like * times).sum(), rtol=1e-5)
    assert np.allclose(counts, want_counts, rtol=1e-4) and np.allclose(start, want_start, rtol=1e-4) and np.allclose(moves, want_moves, rtol=1e-4)


def test_only_pieces_between_two_others_cost_matrices(monkeypatch):
    """And the vectors of outer pieces give what sequences that aren't cut give, also over thousands of words."""
    m, r, seen, real = model(4, 8, 50), np.random.default_rng(1), [], hmm.transfers
    size = np.array([3, 64, 65, 128, 129, 3000, 700])
    flat, first, times = r.integers(0, 50, size.sum()).astype(np.int32), np.cumsum(size) - size, np.array([1, 2, 1, 1, 3, 1, 1])
    whole, whole_counts = None, None
    for piece in (5000, 64):
        monkeypatch.setattr(hmm, "PIECE", piece)
        monkeypatch.setattr(hmm, "transfers", lambda m_, flat_, first_, *rest: seen.append(len(first_)) or real(m_, flat_, first_, *rest))
        counts = np.zeros((8, 50))
        got = [hmm.forward(m, flat, first, size), *hmm.expected(m, flat, first, size, times, counts)]
        if whole is None:
            whole, whole_counts = got, counts
    inner = np.maximum(-(-size // 64) - 2, 0).sum()
    assert seen == [inner, inner]
    assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(got, whole)) and np.allclose(counts, whole_counts, rtol=1e-4)


def counted(texts):
    n = {}
    for t in texts:
        for w in word_list(t):
            n[w] = n.get(w, 0) + 1
    return n


def test_the_vocabulary_and_totals_cover_all_documents(spark, documents):
    raw = hmm.encode(documents)
    m = hmm.initial(raw)
    n = counted(r.text for r in documents.collect())
    assert (m.size, m.total, m.once) == (sum(v > 1 for v in n.values()), sum(n.values()), sum(v == 1 for v in n.values()))
    got = np.concatenate([np.frombuffer(r.counts) for r in m.vocabulary.collect()])
    assert sorted(got) == sorted(v for v in n.values() if v > 1)
    want = sum(v * np.log(v / m.total) for v in n.values() if v > 1) + m.once * np.log(m.once / m.total)
    assert np.isclose(m.plain, want, rtol=1e-6)


def test_the_registered_training_rises_with_every_sweep_and_beats_plain_frequencies(spark, documents):
    m, coded, likes = hmm.train(documents)
    assert likes == sorted(likes) and len(likes) > 2
    assert likes[-1] > m.plain + 0.3 * m.total
    t = sum(m.totals.values())
    assert np.isclose(t[72:80].sum(), m.total, rtol=1e-4) and np.isclose(t[8:72].sum() + t[:8].sum(), m.total, rtol=1e-4)


def test_held_out_text_is_more_probable_than_by_plain_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null").dropDuplicates(["text"])
    train, held = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    m, _, _ = hmm.train(train)
    n = counted(r.text for r in train.collect())
    total, once = sum(n.values()), sum(v == 1 for v in n.values())
    plain = {r.doc_id: sum(np.log(n[w] / total if n.get(w, 0) > 1 else 1 / (2 * total)) for w in word_list(r.text)) for r in held.collect()}
    got = {r.doc_id: (r.log_likelihood or 0.0, r.n_tokens) for r in hmm.score_docs(held, m).collect()}
    tokens = sum(t for _, t in got.values())
    assert once == m.once and (sum(x for x, _ in got.values()) - sum(plain.values())) / tokens > 0.5


def test_scores_are_the_sums_over_paths_of_the_trained_model(spark):
    """The whole query against brute force: the parameters are read from the tables, and every path of short texts is summed."""
    texts = ["red cat sat", "blue dog ran far", "red dog", "cat ran", "blue cat sat far", "new one here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    m, coded, _ = hmm.train(docs, states=2, batches=2, sweeps=2)
    sums, rare, left = m.sums()
    assert left == 0
    counts, n = {}, {}
    for r in m.vocabulary.collect():
        n |= dict(zip(np.frombuffer(r.words, np.uint64).tolist(), np.frombuffer(r.counts).tolist()))
    for t in m.tables.values():
        for r in t.filter("words is not null").collect():
            for w, c in zip(np.frombuffer(r.words, np.uint64).tolist(), np.frombuffer(r.counts, np.float32).reshape(-1, 2)):
                counts[w] = counts.get(w, 0) + c
    from cairn.llm.textkernel import words
    import pyarrow as pa

    for r in hmm.score(coded, m).collect():
        emit = [(counts[w] + hmm.SHARE / 2 * n[w]) / sums if w in n else rare / sums / (2 * m.once) for w in words(pa.array([texts[r.doc_id]])).hash.tolist()]
        whole = sum(m.start[p[0]] * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([e[k] for e, k in zip(emit, p)]) for p in product(range(2), repeat=len(emit)))
        assert r.n_tokens == len(emit) and np.isclose(r.log_likelihood, np.log(whole), rtol=1e-5)


def test_repartitioning_changes_no_score(spark, documents):
    docs = documents.limit(80)
    a, b = ({(r.doc_id, r.log_likelihood) for r in hmm.score_corpus(d, sweeps=2).collect()} for d in (docs.coalesce(1), docs.repartition(5)))
    assert a == b and len(a) == 80


def test_edges(spark, edges, nothing):
    rows = hmm.score_corpus(edges, sweeps=1).collect()
    assert len(rows) == edges.count()
    for r in rows:
        assert (r.log_likelihood is None) == (r.n_tokens == 0) == (r.per_token is None)
    assert next(r for r in rows if r.doc_id == 7).n_tokens == 20_000
    assert len([r for r in rows if r.doc_id == 5]) == 2 and len({r.log_likelihood for r in rows if r.doc_id == 5}) == 1
    assert hmm.score_corpus(nothing).count() == 0


def test_a_plateau_below_plain_frequencies_is_not_convergence():
    assert not hmm.converged([-100.0, -99.99], -99.0)
    assert hmm.converged([-98.0, -97.99], -99.0)
    assert not hmm.converged([-98.0], -99.0) and hmm.converged([0.0], 0.0)
