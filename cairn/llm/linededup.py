"""Near-duplicate lines, by a join of deletion neighbourhoods.

Lines are what newlines part in a text. Two lines are alike if one turns into the other by at most one edit: a character
(code point) put in, taken out or replaced. Of alike lines the earliest, in the order (doc_id, line number), stays: a line goes
if an earlier line is alike to it, whether that one itself stays or goes.

Lines emit their variants with one character left out, as hashed keys. Two lines of equal length that share a
variant with the character left out at the same place differ by a replacement there; a line that is a variant of a longer one
differs from it by an insertion. So within a key the earliest line is found without comparing all pairs, and frequent keys
are no burden. Each found pair is then verified by its edit distance.

Equal lines are made one before. And as one edit leaves either the first or the second half of a line as it is, only lines that
share a half with another line emit variants, and only with characters of the other half left out. For that, a half is taken at
the place ``N // 2`` for a pair whose longer line has N characters; each line takes part for N its length, and one more.

Defined cases. Null and empty texts have no lines to look at, and empty lines are never duplicates. Rows with a null doc_id are
neither searched nor reported. Rows that repeat a doc_id hold the same line if its number and content agree; this line is no
duplicate of itself. Lines of any length are handled whole. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import column, pieces, repeated, whole_groups, write_table
from cairn.llm.textkernel import BASE, mix, powers

OTHER_BASE = 0xD1B54A32D192ED03
SAME_PLACE, SHORTER, ITSELF = range(3)  #: what a key's row says: place left out, one character less, the line itself


class Points:
    """Code points of texts, with hashes of slices of them."""

    def __init__(self, texts: list[str]) -> None:
        whole = "".join(texts)
        self.offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        self.points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sums = self._sums(BASE)

    def _sums(self, base: int) -> np.ndarray:
        total = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * powers(len(self.points) + 2, base)[0][: len(self.points)], out=total[1:])
        return total

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, text and number in its text of every line."""
        breaks = np.flatnonzero(self.points == 10)
        text = np.searchsorted(self.offsets, breaks, "right") - 1
        starts = np.r_[self.offsets[:-1], breaks + 1]
        ends = np.r_[self.offsets[1:], breaks]
        order = np.lexsort((starts, np.r_[np.arange(len(self.offsets) - 1), text]))
        row = np.r_[np.arange(len(self.offsets) - 1), text][order]
        ends_order = np.lexsort((ends, np.r_[np.arange(len(self.offsets) - 1), text]))
        start, end = starts[order], ends[ends_order]
        number = np.arange(len(row)) - np.searchsorted(row, row)
        return start, end, row, number

    def raw(self, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None, base: int = BASE) -> np.ndarray:
        sums = self.sums if sums is None else sums
        return (sums[end] - sums[start]) * powers(len(self.points) + 2, base)[1][start]


def _key(raw: np.ndarray, a: np.ndarray | int, b: np.ndarray | int = 0) -> np.ndarray:
    h = mix(raw + np.asarray(a, np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return mix(h ^ (np.asarray(b, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)))


def variants(p: Points, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the neighbourhoods: line, key, kind. Bits of mask: the first, the second half is shared by a line no
    longer than this one; the first, the second by one that is a character longer."""
    n, half = end - start, (end - start) // 2
    low = np.where(mask & 2, 0, half)
    high = np.where(mask & 1, n, half)
    count = np.where(mask & 3, high - low, 0)
    line = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) + low[line] + start[line]
    power, inverse = powers(len(p.points) + 2)
    left = (p.sums[at] - p.sums[start[line]]) * inverse[start[line]]
    right = (p.sums[end[line]] - p.sums[at + 1]) * inverse[start[line] + 1]
    v = left + right
    place = at - start[line]
    new = (place == low[line]) | (p.points[at] != p.points[np.maximum(at - 1, 0)])
    longer = np.flatnonzero((mask & 12) != 0)
    itself = p.raw(start[longer], end[longer])
    return (
        np.concatenate([line, line[new], longer]),
        np.concatenate([_key(v, n[line], place + 1), _key(v[new], n[line][new] - 1), _key(itself, n[longer])]),
        np.concatenate([np.full(len(line), SAME_PLACE), np.full(int(new.sum()), SHORTER), np.full(len(longer), ITSELF)]).astype(np.int8),
    )


def earliest(key: np.ndarray, kind: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row of an earlier line that is alike) among rows whose keys meet. rank orders the lines."""
    order = np.lexsort((rank, kind == ITSELF, key))
    key, kind, rank = key[order], kind[order], rank[order]
    cut = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(key)] - 1
    group = np.cumsum(cut) - 1
    head, tail = first[group], last[group]  # the earliest variant of the key; the line itself, if there
    away, stay = [], []
    same = np.flatnonzero((kind == SAME_PLACE) & (rank > rank[head]))
    away.append(same)
    stay.append(head[same])
    short = np.flatnonzero((kind == SHORTER) & (kind[tail] == ITSELF) & (rank > rank[tail]))
    away.append(short)
    stay.append(tail[short])
    own = np.flatnonzero((kind == ITSELF) & (kind[head] == SHORTER) & (rank > rank[head]))
    away.append(own)
    stay.append(head[own])
    return order[np.concatenate(away)], order[np.concatenate(stay)]


def _listed(column_: pa.Array) -> list[str]:
    return pc.fill_null(column_, "").to_pylist()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, keep_doc_id, keep_line_no, distance): each line that goes, the earliest line that is alike to it,
    and their edit distance, 0 or 1. Lines count from 0."""
    docs = docs.filter("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                p = Points(_listed(part.column("text")))
                start, end, row, number = p.lines()
                some = end > start
                start, end, row, number = start[some], end[some], row[some], number[some]
                n = end - start
                h = _key(p.raw(start, end), n)
                h2 = _key(p.raw(start, end, p._sums(OTHER_BASE), OTHER_BASE), n)
                halves = []
                for longest in (n, n + 1):
                    half = longest // 2
                    halves += [_key(p.raw(start, start + half), longest, 1), _key(p.raw(end - (longest - 1 - half), end), longest, 2)]
                yield pa.RecordBatch.from_pydict({"h": column(h), "h2": column(h2), "doc_id": part.column("doc_id").take(pa.array(row)), "line_no": pa.array(number.astype(np.int32))} | {f"k{i}": column(k) for i, k in enumerate(halves)})

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({
                "key": pa.concat_arrays([b.column(f"k{i}") for i in range(4)]), "doc_id": pa.concat_arrays([b.column("doc_id")] * 4), "line_no": pa.concat_arrays([b.column("line_no")] * 4),
                "bit": pa.array(np.repeat(np.array([1, 2, 4, 8], np.int32), b.num_rows)),
            })

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of candidates, with their bits and hash."""
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = _listed(part.column("text"))
                p = Points(texts)
                start, end, row, number = p.lines()
                first = np.searchsorted(row, np.arange(len(texts)))
                asked = part.column("lines")
                owner = np.repeat(np.arange(len(texts)), np.asarray(asked.value_lengths()))
                fields = asked.flatten()
                at = first[owner] + np.asarray(fields.field("line_no"))
                s, e = start[at], end[at]
                base = p.offsets[owner]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").take(pa.array(owner)), "line_no": fields.field("line_no"), "h": column(_key(p.raw(s, e), e - s)), "mask": fields.field("mask"),
                    "line": pa.array([texts[o][a:b] for o, a, b in zip(owner.tolist(), (s - base).tolist(), (e - base).tolist())], pa.string()),
                })

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "line", 1 << 18):
                p = Points(_listed(part.column("line")))
                line, key, kind = variants(p, p.offsets[:-1], p.offsets[1:], np.asarray(part.column("mask")))
                rows = pa.array(line)
                yield pa.RecordBatch.from_pydict({"key": column(key), "kind": pa.array(kind), "doc_id": part.column("doc_id").take(rows), "line_no": part.column("line_no").take(rows), "h": part.column("h").take(rows)})

    def earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "key"):
            doc, no, h = (np.asarray(group.column(c)) for c in ("doc_id", "line_no", "h"))
            order = np.lexsort((h, no, doc))
            step = (doc[order][1:] != doc[order][:-1]) | (no[order][1:] != no[order][:-1]) | (h[order][1:] != h[order][:-1])
            rank = np.zeros(len(doc), np.int64)
            rank[order] = np.r_[0, np.cumsum(step)]
            away, stay = earliest(np.asarray(group.column("key")), np.asarray(group.column("kind")), rank)
            if len(away):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[away]), "line_no": pa.array(no[away]), "h": pa.array(h[away]), "e_doc_id": pa.array(doc[stay]), "e_line_no": pa.array(no[stay]), "e_h": pa.array(h[stay])})

    raw = docs.mapInArrow(split, "h bigint, h2 bigint, doc_id bigint, line_no int, " + ", ".join(f"k{i} bigint" for i in range(4)))
    raw = write_table(raw, "raw")
    # The first of equal lines by partial sums, and a join that splits a frequent line; a window would sort all of these in one task.
    first = raw.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("f")).select("h", "h2", F.col("f.doc_id").alias("f_doc_id"), F.col("f.line_no").alias("f_line_no"))
    lines = write_table(raw.join(first, ["h", "h2"]).drop("h2"), "lines")
    own = "doc_id = f_doc_id and line_no = f_line_no"
    keyed = lines.filter(own).select("doc_id", "line_no", "k0", "k1", "k2", "k3").mapInArrow(halves, "key bigint, doc_id bigint, line_no int, bit int")
    met = keyed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(lambda b: repeated(b, "key", ["doc_id", "line_no", "bit"]), "doc_id bigint, line_no int, bit int")
    wanted = met.groupBy("doc_id", "line_no").agg(F.bit_or("bit").alias("mask")).groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "mask")).alias("lines"))
    # Of rows that share doc_id some may have fewer lines than another: then they haven't the line that is meant.
    enough = F.size(F.split("text", "\n")) > F.array_max(F.transform("lines", lambda x: x["line_no"]))
    wanted = docs.join(wanted, "doc_id").withColumn("lines", F.when(enough, F.col("lines")).otherwise(F.filter("lines", lambda x: x["line_no"] < F.size(F.split("text", "\n")))))
    candidates = write_table(wanted.mapInArrow(pick, "doc_id bigint, line_no int, h bigint, mask int, line string").filter("line <> ''"), "candidates")
    pairs = candidates.mapInArrow(neighbours, "key bigint, kind tinyint, doc_id bigint, line_no int, h bigint").repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(earlier, "doc_id bigint, line_no int, h bigint, e_doc_id bigint, e_line_no int, e_h bigint")
    pairs = pairs.distinct()
    text = candidates.select("doc_id", "line_no", "h", "line").distinct()
    there = text.select(F.col("doc_id").alias("e_doc_id"), F.col("line_no").alias("e_line_no"), F.col("h").alias("e_h"), F.col("line").alias("e_line"))
    near = pairs.join(text, ["doc_id", "line_no", "h"]).join(there, ["e_doc_id", "e_line_no", "e_h"]).filter(F.levenshtein("line", "e_line", 1) == 1)
    near = near.groupBy("doc_id", "line_no", "h").agg(F.min(F.struct("e_doc_id", "e_line_no")).alias("e"))  # of those that are verified
    near = near.select(F.col("doc_id").alias("f_doc_id"), F.col("line_no").alias("f_line_no"), "h", "e.*")
    rest = lines.select("doc_id", "line_no", "h", "f_doc_id", "f_line_no").join(near, ["f_doc_id", "f_line_no", "h"], "left").filter(f"e_doc_id is not null or not ({own})")
    return rest.select(
        "doc_id", "line_no", F.coalesce("e_doc_id", "f_doc_id").alias("keep_doc_id"), F.coalesce("e_line_no", "f_line_no").alias("keep_line_no"),
        F.when(F.col("e_doc_id").isNull(), 0).otherwise(1).alias("distance"),
    ).distinct()


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that go, their line ends included; the other columns are as they were. Repeated rows all lose what their document
    loses. A doc_id must name one text, or the lines couldn't be told apart."""
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.collect_set("line_no").alias("_lines")).select(F.col("doc_id").alias("_doc"), "_lines")
    shared = docs.filter("doc_id is not null and text is not null").select("doc_id", "text").distinct().groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_many"))
    if not shared.isEmpty():
        raise ValueError("lines can be taken out only where a doc_id names one text")
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    joined = packed.join(gone, F.col("_id") == F.col("_doc"), "left")
    kept = F.array_join(F.filter(F.split("_text", "\n"), lambda x, i: ~F.array_contains("_lines", i)), "\n")
    text = F.when(F.col("_lines").isNull(), F.col("_text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
