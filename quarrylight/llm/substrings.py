"""Removal of repeated byte strings by distributed suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Every such string holds an anchor: the least
hash of `GRAM` bytes in it. Equal strings have equal anchors at equal places, so strings only have to be compared around equal
anchors, and anchors that come once rule out all strings they stand for. Around the others:

1. texts that come twice or more as a whole are known from a count and are settled by it;
2. anchors whose whole surroundings (all strings with this anchor) come elsewhere settle those strings at once;
3. of the rest, one surrounding of each kind is dealt to buckets by anchor. There, laid out in words that begin at the anchors,
   its suffixes are sorted by the difference-cover algorithm (sampled triples, recursion on names, merge) and neighbours in
   suffix order are compared; strings are equal if their whole words and the bytes on both sides of them are. The strings of
   anchors with too many surroundings for a task are counted by 128-bit names on the cluster instead, which gives the same spans.

Texts, surroundings and such strings are named by 128 bits: an MD5 sum, or two hashes from independent tables and multipliers.

Spans found for a text are united, and every row loses the spans of its text.

Defined results: null text counts as empty (nothing removed); texts shorter than `length` lose nothing; equal texts lose all
their strings; repeated rows each get a row; a null doc_id stays null; texts of any length are taken whole, STEP starts at a time,
in memory that grows with the text and not with its repetitions; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written
from .shingles import mixed
from .suffixes import window_classes

LENGTH = 200
GRAM = 64
#: Odd numbers, the second one independent of the first: two hashes of a run are its 128-bit name.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Documents whose anchors fill one bucket, and surroundings that are sorted together.
BUCKET_DOCS, BUCKET_PIECES = 2000, 8000
#: Different surroundings of one anchor up to which they are sorted in one task.
ONE_TASK = 50_000
#: Anchors with more, up to which their hashes (8 bytes each) are broadcast.
BROADCAST_ANCHORS = 1_000_000
#: Starts of strings that are looked at together, and anchors; both bound memory, not the result.
STEP, ANCHORS_AT_ONCE = 1 << 20, 4096
#: Anchors, and texts, that a task holds before it deals them out.
HELD_ANCHORS, HELD_TEXTS = 300_000, 60_000
PACKED = ("h", "around", "other", "local", "at", "back", "span")
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_MIX = tuple((mixed(np.arange(k, k + 256, dtype=np.uint64) * np.uint64(m))) for k, m in ((1, MULTIPLIERS[0]), (300, MULTIPLIERS[1])))


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def named(text) -> Column:
    """A 128-bit name of a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class Hasher:
    """Hashes of all runs of a byte array, by prefix sums of polynomials modulo 2 ** 64."""

    def __init__(self, ways: int = 2):
        self.ways = ways
        self.power, self.back = ([np.ones(1, np.uint64)] * ways for _ in range(2))

    def load(self, data: bytes) -> int:
        n = len(data)
        if len(self.power[0]) <= n:
            size = 1 << int(n).bit_length()
            up = lambda m: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, m, np.uint64)]))
            self.power = [up(m) for m in MULTIPLIERS[: self.ways]]
            self.back = [up(pow(m, -1, 1 << 64)) for m in MULTIPLIERS[: self.ways]]
        x = np.frombuffer(data, np.uint8)
        self.sums = []
        for k in range(self.ways):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_MIX[k][x] * self.power[k][:n], out=sums[1:])
            self.sums.append(sums)
        return n

    def runs(self, start, end, way: int = 0) -> np.ndarray:
        return mixed((self.sums[way][end] - self.sums[way][start]) * self.back[way][start])

    def grams(self, n: int, k: int) -> np.ndarray:
        return mixed((self.sums[0][k:] - self.sums[0][: n - k + 1]) * self.back[0][: n - k + 1])


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or greatest) of every w neighbours, in two running passes over blocks."""
    f, fill = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % w, fill, np.uint64)]).reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(hasher: Hasher, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first and last start of its strings) of the least gram of every string of `length` bytes; of equal ones,
    each."""
    none = np.empty(0, np.int64)
    if n < length:
        return np.empty(0, np.uint64), none, none, none
    h = hasher.grams(n, gram)
    w = length - gram + 1
    low = sliding(h, w, True)
    pad = np.zeros(w - 1, np.uint64)
    ends = np.concatenate([pad, low, pad])  # of gram i, the strings start at i - w + 1 to i
    at = np.flatnonzero(h == sliding(ends, w, False))
    windows = np.lib.stride_tricks.sliding_window_view(ends, w)
    first, last = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for k in range(0, len(at), ANCHORS_AT_ONCE):
        some = at[k : k + ANCHORS_AT_ONCE]
        mine = windows[some] == h[some, None]
        first[k : k + len(some)] = some - w + 1 + mine.argmax(axis=1)
        last[k : k + len(some)] = some - mine[:, ::-1].argmax(axis=1)
    return h[at], at, first, last


def anchored(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Anchors of each distinct text (docs: name, text), dealt to buckets as arrays, beside the names of the texts they are of. A
    long text is taken in steps, each with the strings that start in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, names, n_held, seen = Hasher(), [], [], 0, set()

        def emit():
            arrays = [np.concatenate([x[k] for x in held]) for k in range(7)]
            held.clear()
            bucket = (arrays[0] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, arrays = bucket[order], [x[order] for x in arrays]
            who = arrays[3]
            begins = np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]
            new = begins | np.append(True, who[1:] != who[:-1])[: len(bucket)]
            first = np.flatnonzero(begins)
            ends = np.append(first[1:], len(bucket))[: len(first)]
            nth = np.cumsum(new) - 1
            arrays[3] = (nth - np.repeat(nth[first], ends - first)).astype(np.uint32)
            called = np.frombuffer(b"".join(names), "V16")
            names.clear()
            cols = [[x[a:b].tobytes() for a, b in zip(first, ends, strict=True)] for x in arrays]
            cols.append([called[who[a:b][new[a:b]]].tobytes() for a, b in zip(first, ends, strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64())] + [pa.array(c, pa.binary()) for c in cols], names=["bucket", *PACKED, "names"])

        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(name)
                data = bytes_of(text)
                if len(data) < length:
                    continue
                names.append(name)
                for a in range(0, len(data) - length + 1, STEP):
                    n = hasher.load(data[a : a + STEP + length - 1])
                    h, at, first, last = anchors(hasher, n, length, gram)
                    shape = ((at - first).astype(np.uint64) << np.uint64(32)) ^ (last - at + length).astype(np.uint64)
                    around, other = hasher.runs(first, last + length) ^ shape, hasher.runs(first, last + length, 1)
                    held.append((h, around, other, np.full(len(h), len(names) - 1, np.uint32), (a + at).astype(np.uint32), (at - first).astype(np.uint16), (last - first).astype(np.uint16)))
                    n_held += len(h)
                if n_held >= HELD_ANCHORS or len(names) >= HELD_TEXTS:
                    yield emit()
                    n_held = 0
        if held:
            yield emit()

    small_batches(docs.sparkSession)
    return docs.select("name", "text").mapInArrow(run, "bucket long, " + ", ".join(f"{c} binary" for c in (*PACKED, "names")))


MARKS = "name binary, at long, first long, last long, h long, settled boolean"


def repeated(packed: DataFrame) -> DataFrame:
    """(name, at, first, last, h, settled): anchors that come twice or more, with the starts of their strings. settled: the whole
    surroundings come elsewhere too; where surroundings differ, one row of each kind has settled false or null (null: only to
    be compared with)."""

    def join(table: pa.Table) -> pa.Table:
        types = (np.uint64, np.uint64, np.uint64, np.uint32, np.uint32, np.uint16, np.uint16)
        parts = [[np.frombuffer(b, d) for b in table.column(c).to_pylist()] for c, d in zip(PACKED, types, strict=True)]
        listed = [np.frombuffer(b, ">u8").astype(np.uint64).reshape(-1, 2) for b in table.column("names").to_pylist()]
        base = np.cumsum([0] + [len(x) for x in listed])
        names = np.concatenate(listed)
        parts[3] = [x.astype(np.int64) + b for x, b in zip(parts[3], base, strict=False)]
        order = np.lexsort((names[:, 1], names[:, 0]))
        new = np.append(True, (names[order][1:] != names[order][:-1]).any(axis=1))
        dense = np.empty(len(order), np.int64)
        dense[order] = np.cumsum(new) - 1
        names = names[order][new]
        h, around, other, name, at, back, span = (np.concatenate(x) for x in parts)
        cols = [h, around, other, dense[name], at, back, span]
        order = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
        cols = [x[order] for x in cols]

        def starts(*some):
            new = np.ones(len(some[0]), bool)
            if len(new):
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in some])
            return new

        new = starts(*cols[:5])
        h, around, other, name, at, back, span = (x[new] for x in cols)
        group, kind = starts(h), starts(h, around, other)
        in_group, in_kind = np.cumsum(group) - 1, np.cumsum(kind) - 1
        kinds, same = np.bincount(in_group, weights=kind)[in_group], np.bincount(in_kind)[in_kind]
        settled = same > 1
        compare = (kinds > 1) & kind  # the first of each kind
        rows = np.concatenate([np.flatnonzero(settled), np.flatnonzero(compare)])
        mark = [True] * int(settled.sum()) + [None if x > 1 else False for x in same[compare]]
        at = at.astype(np.int64)
        first = at - back
        out = {"at": at, "first": first, "last": first + span, "h": h.view(np.int64)}
        said = pa.array(names[name[rows]].astype(">u8").view("V16").ravel().tolist(), pa.binary())
        return pa.table({"name": said} | {c: pa.array(x[rows]) for c, x in out.items()} | {"settled": pa.array(mark, pa.bool_())})

    return packed.groupBy("bucket").applyInArrow(join, MARKS)


def surroundings(texts: DataFrame, marks: DataFrame, buckets: int, length: int) -> DataFrame:
    """The bytes around each anchor that has to be compared, dealt by anchor."""
    wanted = marks.groupBy("name").agg(F.collect_list(F.struct("at", "first", "last", "h")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = bytes_of(text)
                out += [(m["h"] % buckets, name, m["first"], m["at"] - m["first"], m["last"] - m["first"], data[m["first"] : m["last"] + length]) for m in found]
            if out:
                types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "name", "first", "anchor", "span", "piece"])

    one = texts.groupBy("name").agg(F.first("text").alias("text")).where("text is not null")
    return one.join(wanted, "name").select("name", "text", "marks").mapInArrow(run, "bucket long, name binary, first long, anchor int, span int, piece binary")


def counted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """What sorted_spans gives, for anchors with more surroundings than a task should sort: every string is named by two 64-bit
    hashes and strings are counted on the cluster, so that one anchor's strings are spread over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            names, at, h1, h2 = [], [], [], []
            for name, first, span, piece in zip(*(batch.column(c).to_pylist() for c in ("name", "first", "span", "piece")), strict=True):
                start = np.arange(span + 1)
                hasher.load(piece)
                names += [name] * (span + 1)
                at.append(first + start)
                h1.append(hasher.runs(start, start + length).view(np.int64))
                h2.append(hasher.runs(start, start + length, 1).view(np.int64))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array(np.concatenate(x), pa.int64()) for x in (at, h1, h2))], names=["name", "at", "h1", "h2"])

    w = pieces.select("name", "first", "span", "piece").mapInArrow(run, "name binary, at long, h1 long, h2 long")
    # a string is repeated if it stands at two places or more; least and greatest place tell without a list
    place = F.struct("name", "at")
    twice = w.groupBy("h1", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h1", "h2")
    return w.join(twice, ["h1", "h2"], "left_semi").select("name", F.col("at").alias("a"), (F.col("at") + length).alias("b"))


def sorted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """(name, a, b): bytes of texts that strings found in suffix order cover."""

    def run(table: pa.Table) -> pa.Table:
        called = table.column("name").combine_chunks().dictionary_encode()
        name, first = called.indices.to_numpy().astype(np.int64), table.column("first").to_numpy()
        anchor, span = table.column("anchor").to_numpy().astype(np.int64), table.column("span").to_numpy().astype(np.int64)
        which, start, c = window_classes(table.column("piece").to_pylist(), anchor, np.zeros(len(span), np.int64), span, length)
        # only classes with two windows or more matter; the same place of a text may stand in several pieces and counts once
        many = np.bincount(c)[c] > 1
        c, nm, p = c[many], name[which[many]], first[which[many]] + start[many]
        order = np.lexsort((p, nm, c))
        c, nm, p = c[order], nm[order], p[order]
        new = np.append(True, (c[1:] != c[:-1]) | (nm[1:] != nm[:-1]) | (p[1:] != p[:-1]))[: len(c)]
        c, nm, p = c[new], nm[new], p[new]
        twice = np.bincount(c)[c] > 1 if len(c) else np.zeros(0, bool)
        nm, p = nm[twice], p[twice]
        order = np.lexsort((p, nm))
        nm, p = nm[order], p[order]
        begin = np.flatnonzero(np.append(True, (nm[1:] != nm[:-1]) | (np.diff(p) > length))[: len(nm)])
        end = np.append(begin[1:], len(nm)) - 1 if len(begin) else begin
        return pa.table({"name": called.dictionary.take(pa.array(nm[begin])), "a": pa.array(p[begin], pa.int64()), "b": pa.array(p[end] + length, pa.int64())})

    return pieces.groupBy("bucket").applyInArrow(run, "name binary, a long, b long")


def cut(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """Every row without its text's spans. spans: name, copies, found (array of a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, copies, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = bytes_of(text)
                kept, removed, n_spans, end = [], 0, 0, 0
                if (copies or 1) > 1 and len(data) >= length:
                    found = [{"a": 0, "b": len(data)}]
                at = -1  # end of the open span
                for s in sorted(found or [], key=lambda s: s["a"]):
                    a, b = max(0, s["a"]), min(len(data), s["b"])
                    if a > at:
                        n_spans += 1
                        kept.append(data[max(at, 0) : a])
                        removed += b - a
                        at = b
                    elif b > at:
                        removed += b - at
                        at = b
                end = max(at, 0)
                kept.append(data[end:])
                out.append((doc_id, len(data), removed, n_spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            cols = list(zip(*out, strict=True))
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    joined = docs.join(spans, "name", "left")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "copies", "found").mapInArrow(run, SCHEMA)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: bytes, bytes removed, spans removed, and a digest of what is left."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", named(F.col("text")).alias("name"))
    copies = written(rows.groupBy("name").agg(F.count("*").alias("copies")), "copies")
    total = copies.agg(F.sum("copies")).first()[0] or 0
    marks = written(repeated(anchored(rows, max(8, -(-total // BUCKET_DOCS)), length, gram)), "marks")
    compare = marks.where("settled is null or not settled")
    n_pieces, texts = compare.count(), rows.select("name", "text")
    buckets = max(1, -(-n_pieces // BUCKET_PIECES))
    crowded = written(compare.groupBy("h").count().where(F.col("count") > ONE_TASK).select("h"), "crowded")
    n_crowded = crowded.count()
    if not n_crowded:
        spans = sorted_spans(surroundings(texts, compare, buckets, length), length)
    else:
        few = F.broadcast(crowded) if n_crowded <= BROADCAST_ANCHORS else crowded
        spans = sorted_spans(surroundings(texts, compare.join(few, "h", "left_anti"), buckets, length), length)
        spans = spans.unionByName(counted_spans(surroundings(texts, compare.join(few, "h", "left_semi"), buckets, length), length))
    settled = marks.where("settled").select("name", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    every = written(settled.unionByName(spans), "spans")
    discard(marks)
    discard(crowded)
    found = every.groupBy("name").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    both = copies.where("copies > 1").join(found, "name", "full").select("name", "copies", "found")
    return cut(rows, both, length)
