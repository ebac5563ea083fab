"""Suffix-array deduplication: passages that occurred before, by longest-previous-factor arrays.

For each place of the corpus (documents in the order of doc_id, each a list of words) the longest previous factor is the
longest run of words from there on that also begins at an earlier place. It is found in suffix order: the previous and the
next suffix that begin earlier in the text give the longest match. Every run of at least ``LEAST`` words with an earlier
occurrence is a later copy; its words go, the first occurrence stays.

Suffixes are sorted where they can matter only. Winnowing gives each window of LEAST words an anchor: the first of its ``GRAM``-word
runs with the least hash, so equal windows have equal anchors at equal places, and neighbours mostly share theirs. A window can
have an equal one only if its anchor occurs elsewhere too. These windows go, with their words, to where their anchor is handled; equal
windows meet there, and no others need to. There all suffixes are sorted by prefix doubling, and longest previous factors of at least LEAST
words (lengths count up to what was sent along) mark the copies. The result is that of a suffix array of the whole corpus.

Defined cases. Texts that are null, or have fewer than LEAST words, have no passages. Rows with a null doc_id are neither searched nor
reported. Rows that repeat doc_id and text are one document; rows that share only the doc_id are different ones, in the order of their
texts' hashes. Repeats inside one document count too. Very long texts are searched whole. An empty table gives an empty result. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import column, pieces, repeated, whole_groups, write_table
from cairn.llm.textkernel import Words, grams, words

LEAST = 50
GRAM = 10


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or largest of each ``width`` numbers in a row."""
    op, size = (np.minimum if least else np.maximum), 1
    while 2 * size <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def winnow(w: Words, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, first word and text of each run of ``gram`` words; those that begin a window of ``least`` words; the anchor of each
    of these windows, the first of its runs with the least hash."""
    h, at, row = grams(w, gram)
    h |= np.uint64(1)
    width = least - gram + 1
    if len(h) < width:
        return h, at, row, np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens = np.flatnonzero(at + least <= w.first[1:][row])
    low = _slide(h, width, True)[opens]
    anchor, look = opens.copy(), np.flatnonzero(h[opens] != low)
    # The anchor isn't before that of the window before, so marks of any window are the only places to look at.
    lows = np.zeros(len(h), np.uint64)
    lows[opens] = low
    pad = np.zeros(width - 1, np.uint64)
    marks = np.flatnonzero(_slide(np.concatenate([pad, lows[: len(h) - width + 1], pad]), width, False) == h)
    mark = np.searchsorted(marks, opens[look])
    while len(look):
        anchor[look] = marks[mark]
        on = h[anchor[look]] != low[look]
        look, mark = look[on], mark[on] + 1
    return h, at, row, opens, anchor


def previous_factors(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Suffixes in suffix order, by their places in the text; lcp[i] is the common length of i and i + 1. Gives for
    each the longest match with one that begins earlier: of the previous and the next smaller place in suffix order."""
    n = len(place)
    out = np.zeros(n, np.int64)
    stack: list[list[int]] = []  # index, least lcp between it and the one below it on the stack
    for i in range(n):
        common = int(lcp[i - 1]) if i else 0
        while stack and place[stack[-1][0]] > place[i]:
            top, below = stack.pop()
            if common > out[top]:  # i is the next smaller of top
                out[top] = common
            common = min(common, below)
        if stack and common > out[i]:
            out[i] = common
        stack.append([i, common])
    return out


def suffix_order(tokens: np.ndarray, ends: np.ndarray, at: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes tokens[at:ends[at]] by prefix doubling, as far as ``depth`` tokens at least; equal ones by
    place. Gives the order and the common length of neighbours."""
    n = len(tokens)
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    while 1 << (len(ranks) - 1) < depth:
        step, last = 1 << (len(ranks) - 1), ranks[-1]
        follow = np.arange(n) + step
        second = np.where(follow < ends, last[np.minimum(follow, n - 1)] + 1, 0)
        ranks.append(np.unique(last * np.int64(n + 1) + second, return_inverse=True)[1].astype(np.int64))
    order = np.lexsort((place, ranks[-1][at]))
    a, b = at[order[:-1]], at[order[1:]]
    common = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        fits = (x + (1 << level) <= ends[a]) & (y + (1 << level) <= ends[b])
        same = fits & (ranks[level][np.minimum(x, n - 1)] == ranks[level][np.minimum(y, n - 1)])
        common[same] += 1 << level
    return order, common


def _copies(rows: pa.Table, least: int) -> dict[str, np.ndarray]:
    """Of windows that meet (doc_id, text_hash, start, n, words): the runs of windows with an earlier equal one."""
    doc, th, begin, n = (np.asarray(rows.column(c)) for c in ("doc_id", "text_hash", "start", "n"))
    order = np.lexsort((begin, th, doc))
    fresh = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (th[order][1:] != th[order][:-1]) | (begin[order][1:] != begin[order][:-1])]
    order = order[fresh]  # rows of repeated documents count once
    doc, th, begin, n = doc[order], th[order], begin[order], n[order].astype(np.int64)
    raw = rows.column("words").to_pylist()
    tokens = np.frombuffer(b"".join(raw[i] for i in order), np.uint32)
    sizes = n + least - 1
    first = np.cumsum(sizes) - sizes
    ends = np.repeat(first + sizes, sizes)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(row))  # rows are in the order of the text
    by, lcp = suffix_order(tokens, ends, first[row] + inside, place, least)
    cut = np.r_[0, np.flatnonzero(lcp < least) + 1, len(by)]
    size = np.diff(cut)
    where = place[by]
    earliest = np.repeat(np.minimum.reduceat(where, cut[:-1]), size)
    factor = np.zeros(len(by), np.int64)
    two = cut[:-1][size == 2]
    factor[np.where(where[two] > where[two + 1], two, two + 1)] = lcp[two]
    for a, b in zip(cut[:-1][size > 2], cut[1:][size > 2]):
        factor[a:b] = previous_factors(where[a:b].tolist(), lcp[a : b - 1].tolist())
    later = np.zeros(len(row), bool)
    source = np.zeros(len(row), np.int64)
    later[where] = factor >= least
    source[where] = earliest
    on = np.flatnonzero(later)
    apart = (row[on][1:] != row[on][:-1]) | (on[1:] != on[:-1] + 1)
    some = np.ones(min(len(on), 1), bool)
    heads, tails = on[np.r_[some, apart]], on[np.r_[apart, some]]
    src = source[heads]
    return {"doc_id": doc[row[heads]], "text_hash": th[row[heads]], "start": begin[row[heads]] + inside[heads], "stop": begin[row[tails]] + inside[tails] + least, "first_doc_id": doc[row[src]], "first_word": begin[row[src]] + inside[src]}


def _spans(docs: DataFrame, least: int, gram: int) -> DataFrame:
    docs = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words(part.column("text"))
                h, at, row, _, anchor = winnow(w, least, gram)
                anchor = np.unique(anchor)
                rows = pa.array(row[anchor])
                yield pa.RecordBatch.from_pydict({"key": column(h[anchor]), "doc_id": part.column("doc_id").take(rows), "text_hash": part.column("text_hash").take(rows), "at": pa.array((at - w.first[:-1][row])[anchor].astype(np.int32))})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words(part.column("text"))
                h, at, row, opens, anchor = winnow(w, least, gram)
                listed = part.column("at")
                starts = np.searchsorted(row, np.arange(part.num_rows))
                often = np.zeros(len(h), bool)
                often[np.repeat(starts, np.asarray(listed.value_lengths())) + np.asarray(listed.flatten())] = True
                s, mine = opens[often[anchor]], anchor[often[anchor]]
                if not len(s):
                    continue
                head = np.r_[True, (mine[1:] != mine[:-1]) | (s[1:] != s[:-1] + 1)]
                begin = s[head]
                n = np.diff(np.r_[np.flatnonzero(head), len(s)])
                size = n + least - 1
                stop = np.cumsum(size)
                flat = (w.hash >> np.uint64(32)).astype(np.uint32)[np.repeat(at[begin] - (stop - size), size) + np.arange(int(stop[-1]))]
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.r_[0, stop] * 4).astype(np.int32)), pa.py_buffer(flat)])
                rows = pa.array(row[begin])
                yield pa.RecordBatch.from_pydict({
                    "key": column(h[mine[head]]), "doc_id": part.column("doc_id").take(rows), "text_hash": part.column("text_hash").take(rows),
                    "start": pa.array((at[begin] - w.first[:-1][row[begin]]).astype(np.int32)), "n": pa.array(n.astype(np.int32)), "words": data,
                })

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "key"):
            found = _copies(group, least)
            if len(found["doc_id"]):
                yield pa.RecordBatch.from_pydict({k: pa.array(v.astype(np.int32) if k in ("start", "stop", "first_word") else v) for k, v in found.items()})

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one document that overlap or touch become one."""
        for group in whole_groups(batches, "doc_id"):
            doc, th, start, stop = (np.asarray(group.column(c)).astype(np.int64) for c in ("doc_id", "text_hash", "start", "stop"))
            other = np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]
            lift = (np.cumsum(other) - 1) << 32  # documents apart, so that one running maximum serves for all
            reach = np.maximum.accumulate(stop + lift)
            head = np.r_[True, (start + lift)[1:] > reach[:-1]] if len(doc) else other
            at = np.flatnonzero(head)
            end = (reach - lift)[np.r_[at[1:] - 1, len(doc) - 1]]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc[at]), "text_hash": pa.array(th[at]), "start_word": pa.array(start[at].astype(np.int32)), "end_word": pa.array(end.astype(np.int32)),
                "first_doc_id": group.column("first_doc_id").combine_chunks().take(pa.array(at)), "first_word": group.column("first_word").combine_chunks().take(pa.array(at)),
            })

    marks = docs.mapInArrow(anchors, "key bigint, doc_id bigint, text_hash bigint, at int")
    often = marks.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(lambda b: repeated(b, "key", ["doc_id", "text_hash", "at"]), "doc_id bigint, text_hash bigint, at int")
    lists = often.groupBy("doc_id", "text_hash").agg(F.collect_list("at").alias("at"))
    near = docs.join(lists, ["doc_id", "text_hash"]).mapInArrow(windows, "key bigint, doc_id bigint, text_hash bigint, start int, n int, words binary")
    runs = near.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(longest, "doc_id bigint, text_hash bigint, start int, stop int, first_doc_id bigint, first_word int")
    return runs.repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "text_hash", "start").mapInArrow(union, "doc_id bigint, text_hash bigint, start_word int, end_word int, first_doc_id bigint, first_word int")


def later_copies(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id, first_word): the passages that go, in words of the document from 0,
    the end excluded; and where the first ``least`` words of each occur first. Of a document that isn't alone with its
    doc_id, each text has rows of its own."""
    return _spans(docs, least, gram).drop("text_hash")


def without_copies(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``docs`` with the later copies cut out of ``text``, from the first byte of a passage to the last; the other
    columns are as they were. Repeated rows all lose what their document loses."""
    spans = write_table(_spans(docs, least, gram), "spans")
    cut = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("s"))
    cut = cut.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("s.start_word").alias("_from"), F.col("s.end_word").alias("_to"))
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.col("text").alias("text"), F.xxhash64("text").alias("_th"))
    joined = packed.join(cut, (F.col("_doc") == F.col("_id")) & (F.col("_th") == F.col("_hash")), "left").select("_row", "text", "_from", "_to")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            some = np.flatnonzero(np.asarray(batch.column("_from").is_valid()))
            w = words(batch.column("text").take(pa.array(some)))
            for k, i in enumerate(some.tolist()):
                data, out, at, base, first = texts[i].encode(), [], 0, int(w.offsets[k]), int(w.first[k])
                for a, b in zip(batch.column("_from")[i].as_py(), batch.column("_to")[i].as_py()):
                    out.append(data[at : int(w.start[first + a]) - base])
                    at = int(w.end[first + b - 1]) - base
                texts[i] = b"".join([*out, data[at:]]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "_text"])

    row = joined.schema["_row"].dataType
    from pyspark.sql import types as T

    cut_text = joined.mapInArrow(shorten, T.StructType([T.StructField("_row", row), T.StructField("_text", T.StringType())]))
    return cut_text.select(*[F.col("_text").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
