import numpy as np
import pyarrow as pa

from cairn.llm import sstable
from cairn.llm.tokens import encoder


def key(t):
    return (t[0] is not None, t[0] or 0, t[1] is not None, (t[1] or "").encode())


def test_round_trip_of_documents(spark, documents):
    shards = sstable.write_shards(documents, shard_bytes=100_000, block_bytes=4096)
    rows = sorted(shards.collect(), key=lambda r: r.first_id)
    assert len(rows) > 3 and all(a.last_id < b.first_id for a, b in zip(rows, rows[1:]))
    assert sum(r.n_docs for r in rows) == documents.count()
    want = sorted((r.doc_id, r.text) for r in documents.collect())
    assert sorted((r.doc_id, r.text) for r in sstable.scan(shards).collect()) == want
    ids = [w[0] for w in want][::9] + [10**15, -5]
    found = {r.doc_id: r.tokens for r in sstable.lookup(shards, ids).collect()}
    assert set(found) == {w[0] for w in want[::9]}
    texts = dict(want)
    assert all(encoder().direct.decode(t) == texts[i] for i, t in found.items())


def test_reader_finds_each_key_and_no_other():
    w = sstable.Writer(2, 200)
    ids = sorted([None, -(1 << 62), -1, 0, 1, 2, 2, 2, 255, 256, 1 << 40, *range(1000, 3000, 7)], key=lambda i: (i is not None, i or 0))
    keys, before = sstable.keys_of(pa.array(ids, pa.int64())), None
    for n, (i, k) in enumerate(zip(ids, keys)):
        k = k.tobytes()
        shared = 0 if before is None else next((j for j in range(sstable.KEY) if k[j] != before[j]), sstable.KEY)
        w.add(k, shared, b"\1" + np.arange(n % 9, dtype="<u2").tobytes())
        before = k
    s = sstable.Shard(w.finish())
    assert s.entries == len(ids) and [i for i, _ in s.scan()] == ids and len(s.blocks) > 5
    for i in set(ids):
        assert len(s.get(i)) == ids.count(i)
    absent = [i for i in range(-50, 5000) if i not in ids]
    assert all(not s.get(i) for i in absent)
    assert sum(s.may_have(sstable.keys_of(pa.array([i], pa.int64()))[0].tobytes()) for i in absent) < 0.05 * len(absent)


def test_damage_is_noticed():
    w = sstable.Writer(2)
    w.add(sstable.keys_of(pa.array([1], pa.int64()))[0].tobytes(), 0, b"\1abcd")
    data = bytearray(w.finish())
    data[3] ^= 1
    try:
        list(sstable.Shard(bytes(data)).scan())
    except ValueError:
        return
    raise AssertionError("the damage went unnoticed")


def test_edges(spark, edges, nothing):
    shards = sstable.write_shards(edges, block_bytes=64)
    got = sorted(((r.doc_id, r.text) for r in sstable.scan(shards).collect()), key=key)
    assert got == sorted(((r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()), key=key)
    assert sstable.write_shards(nothing).count() == 0
    found = sstable.lookup(shards, [None, 2, 3, 5]).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found) == [(False, 0), (False, 0), (True, 2), (True, 3), (True, 5), (True, 5)]
    assert next(r for r in found if r.doc_id == 2).tokens is None and next(r for r in found if r.doc_id == 3).tokens == []
