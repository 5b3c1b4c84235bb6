"""Chroma audio fingerprints of a media column, and a search that aligns recordings.

A recording (32-bit float PCM) becomes frames of energy by pitch class; filters on an integral image over those frames compare
areas, each comparison is quantised to two bits in Gray code, and sixteen of them make one packed integer per frame. Recordings
with equal fingerprints form a class.

Classes are aligned by integers that they share. Of each class the least integers of sliding windows are sampled; a query's
integers are all looked up, so that noise in a neighbour hides none. Where at one time offset at least `SHARE` of the shorter
one's sampled integers agree, and the two overlap there by half of the shorter one or more, the share of differing bits over the
whole overlap decides. So many integers must be shared that it is enough to look up the rarest ones of the shorter recording
(prefix filter); nothing is capped. An excerpt aligns with the whole, and so does a recording with a shifted start, an insertion,
or noise that leaves a quarter of the integers as they were (about 20 dB); under stronger noise it is not found.

The tables hold no audio: `render` turns a text into PCM, a chord per word, as a stand-in for a media column.

Defined results: null, empty and very short recordings have no integers; a recording without integers is a class of its own;
repeated rows are in the same class; recordings of any length are taken whole, CHUNK frames at a time; an empty table gives no
rows; other columns are ignored, whatever their names; null ids sort before others. Of an integer that comes again within a
recording only the first place is looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .neardup import CHUNK as CHUNK_CELLS
from .neardup import sketch_of
from .shingles import mixed

RATE, SIZE, HOP = 4000, 256, 128
#: Frames that a packed integer sees.
SPAN = 16
#: Integers of which the least is sampled; share of the shorter one's sampled integers that must agree at one offset.
WINDOW = 4
SHARE = (1, 4)
#: Share of the shorter recording that must lie in the overlap, and of bits there that may differ.
LEAST_OVERLAP, MOST_ERRORS = (1, 2), 0.30
#: Counts of sampled integers, of a fixed size whatever the corpus; they order integers by rareness and decide no result.
SKETCH_BITS = 16
#: Frames that are transformed at once; bounds memory, not the result.
CHUNK = 16_384
THRESHOLDS = (-0.25, 0.0, 0.25)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of the sixteen filters, from a rule."""
    return [(k % 6, (5 * k) % 8, 4 if k % 2 else 3, (4, 8, 12, 16)[k // 4]) for k in range(16)]


def pitch_matrix() -> np.ndarray:
    """Share of each spectrum bin in each pitch class."""
    f = np.fft.rfftfreq(SIZE, 1 / RATE)
    m = np.zeros((len(f), 12), np.float32)
    for i, hz in enumerate(f):
        if 200 <= hz <= 1800:
            m[i, int(round(12 * np.log2(hz / 440.0))) % 12] = 1
    return m


def chroma(pcm: np.ndarray, pitches: np.ndarray) -> np.ndarray:
    """Frames by pitch class, each frame of length one (silence: zero)."""
    n = (len(pcm) - SIZE) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    views, bell = np.lib.stride_tricks.sliding_window_view(pcm, SIZE)[::HOP], np.hanning(SIZE).astype(np.float32)
    c = np.concatenate([np.abs(np.fft.rfft(views[k : min(n, k + CHUNK)] * bell, axis=1)).astype(np.float32) @ pitches for k in range(0, n, CHUNK)])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-6)


def fingerprint(c: np.ndarray) -> np.ndarray:
    """One packed integer per frame that has SPAN frames before its end."""
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = np.cumsum(np.cumsum(c, axis=0, dtype=np.float64), axis=1)
    t = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return image[t + x1, y1] - image[t + x0, y1] - image[t + x1, y0] + image[t + x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        a, b = y, y + h
        if kind == 0:  # the band against what is outside of it
            p, q = area(0, w, a, b), (area(0, w, 0, 12) - area(0, w, a, b)) * h / (12 - h)
        elif kind == 1:  # before and after
            p, q = area(0, w // 2, a, b), area(w // 2, w, a, b)
        elif kind == 2:  # low and high
            p, q = area(0, w, a, a + h // 2), area(0, w, a + h // 2, a + 2 * (h // 2))
        elif kind == 3:  # crossed quarters
            m = a + h // 2
            p, q = area(0, w // 2, a, m) + area(w // 2, w, m, b), area(0, w // 2, m, b) + area(w // 2, w, a, m)
        elif kind == 4:  # the middle in pitch
            p, q = 2 * area(0, w, a + 1, b - 1), area(0, w, a, a + 1) + area(0, w, b - 1, b)
        else:  # the middle in time
            p, q = area(w // 4, w - w // 4, a, b), area(0, w // 4, a, b) + area(w - w // 4, w, a, b)
        level = np.searchsorted(THRESHOLDS, np.round(np.log((1 + p) / (1 + q)), 6))
        out = out << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    return out


def tones(text: str | None) -> np.ndarray:
    """Three pitch classes a word, chosen by the word."""
    h = np.array([zlib.crc32(w) for w in (text or "").encode("utf-8", "surrogatepass").split()], np.int64)
    return np.stack([h % 12, h // 12 % 12, h // 144 % 12], axis=1)


def render(chords: np.ndarray) -> np.ndarray:
    """PCM of chords of three tones, HOP samples each. A stand-in where a table holds no audio."""
    t = np.arange(HOP, dtype=np.float32) / RATE
    wave = np.sin(2 * np.pi * 440.0 * 2 ** (np.arange(12)[:, None] / 12) * t).astype(np.float32)
    return wave[chords].sum(axis=1).ravel() / 3


def sung(text: str | None, pitches: np.ndarray) -> np.ndarray:
    """Frames of a text's recording, rendered piece by piece: a frame is two chords."""
    chords = tones(text)
    return np.concatenate([chroma(render(chords[k : k + CHUNK + 1]), pitches) for k in range(0, max(1, len(chords) - 1), CHUNK)])


def integers(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers of a fingerprint, in order, with their first places."""
    value, first = np.unique(fp, return_index=True)
    return value.astype(np.int64), first


def sampled(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers that are the least, by hash, of WINDOW neighbours, in order, with their first places there."""
    if not len(fp):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(mixed(fp.astype(np.uint64)), min(WINDOW, len(fp)))
    at = np.unique(np.arange(len(views)) + views.argmin(axis=1))
    value, first = np.unique(fp[at], return_index=True)
    return value.astype(np.int64), at[first]


def cells(values: np.ndarray) -> np.ndarray:
    """Where values are counted in the sketch."""
    return (mixed(values.astype(np.uint64)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def needed(n: int, m: int) -> int:
    """Sampled integers that must agree at one offset, of recordings with n and m of them."""
    return -(-SHARE[0] * min(n, m) // SHARE[1])


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """(offset of b against a, integers sampled from b that agree there, share of differing bits), if the two align: at the offset
    with the fewest errors of those with votes enough, the least on ties."""
    (va, pa_), (vb, pb) = integers(a), sampled(b)
    common, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if not len(common):
        return None
    offsets, votes = np.unique(pb[ib] - pa_[ia], return_counts=True)  # the histogram
    best = None
    for k in np.flatnonzero(votes >= needed(len(sampled(a)[0]), len(vb))):
        offset = int(offsets[k])
        lo, hi = max(0, -offset), min(len(a), len(b) - offset)
        if LEAST_OVERLAP[1] * (hi - lo) < LEAST_OVERLAP[0] * min(len(a), len(b)):
            continue
        errors = round(float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).mean()) / 32, 6)
        if errors <= MOST_ERRORS and (best is None or errors < best[2]):
            best = offset, int(votes[k]), errors
    return best


def fingerprints(rows: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids and the packed integers of each row's recording."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pitches = pitch_matrix()
        for batch in batches:
            fps = [fingerprint(sung(t, pitches)).astype("<u4").tobytes() for t in batch.column(len(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(pa.int64()) for k in range(len(ids))), pa.array(fps, pa.binary())], names=[*ids, "fp"])

    return rows.select(*ids, text).mapInArrow(run, ", ".join(f"{c} long" for c in ids) + ", fp binary")


def search(rows: DataFrame, ids: list[str], text: str, is_query) -> DataFrame:
    """Per row: ids, number of integers, class (the class's least ids), whether it is a query, and for queries the classes that
    align with it: their ids, offset, shared anchors and bit errors."""
    fps = fingerprints(rows.select(*ids, F.coalesce(is_query, F.lit(False)).cast("long").alias("is_query"), text), [*ids, "is_query"], text)
    alone = F.concat_ws(":", F.lit("none"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ids])
    name = F.unhex(F.when(F.length("fp") > 0, F.sha2("fp", 256)).otherwise(F.sha2(alone, 256)))
    members = written(fps.withColumns({"name": name, "is_query": F.col("is_query") > 0}), "members")
    classes = members.groupBy("name").agg(F.min(F.struct(*ids)).alias("rep"), F.max("is_query").alias("asked"), F.first("fp").alias("fp"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    sounding = classes.where("length(fp) > 0")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            found = [cells(sampled(np.frombuffer(b, "<u4"))[0]) for b in batch.column(0).to_pylist()]
            sketch += np.bincount(np.concatenate(found), minlength=len(sketch))
        parts = sketch.astype(np.uint32).reshape(-1, CHUNK_CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["chunk", "counts"])

    counts = rows.sparkSession.sparkContext.broadcast(sketch_of(sounding.select("fp").mapInArrow(counted, "chunk int, counts binary"), SKETCH_BITS))  # fixed size

    def taken(of, some: DataFrame, c: str) -> DataFrame:
        """(class, n, value, lead): the integers that of() takes from each class, how many are sampled from it, and which are the
        rarest, of which one at least must be shared where the class is the shorter one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, n, lead = [], [], []
                for b in batch.column(1).to_pylist():
                    fp = np.frombuffer(b, "<u4")
                    v, k = of(fp)[0], len(sampled(fp)[0])
                    first = np.zeros(len(v), bool)
                    first[np.lexsort((v, counts.value[cells(v)]))[: len(v) - needed(k, k) + 1]] = True
                    values.append(v)
                    n.append(k)
                    lead.append(first)
                sizes = [len(v) for v in values]
                who = pa.array(np.repeat(np.arange(len(values)), sizes))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), pa.array(np.repeat(n, sizes), pa.int32()), pa.array(np.concatenate(values), pa.int64()), pa.array(np.concatenate(lead))], names=[c, f"n_{c}", "value", f"lead_{c}"])

        return some.select("class", "fp").mapInArrow(run, f"{c} long, n_{c} int, value long, lead_{c} boolean")

    r, q = taken(sampled, sounding, "r"), taken(integers, sounding.where("asked"), "q")
    meet = (r["value"] == q["value"]) & (F.col("q") != F.col("r")) & F.when(F.col("n_r") <= F.col("n_q"), F.col("lead_r")).otherwise(F.col("lead_q"))
    pairs = r.join(q, meet).select("q", "r").distinct()
    of = classes.select("class", "fp", "rep")
    pairs = pairs.join(of.select(F.col("class").alias("q"), F.col("fp").alias("qf")), "q").join(of.select(F.col("class").alias("r"), F.col("fp").alias("rf"), "rep"), "r")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [aligned(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            keep = [i for i, f in enumerate(found) if f]
            if keep:
                at = pa.array(keep)
                got = list(zip(*(found[i] for i in keep), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(batch.column(3 + k).take(at) for k in range(len(ids))), pa.array(got[0], pa.int32()), pa.array(got[1], pa.int32()), pa.array(got[2], pa.float64())], names=["q", *ids, "offset", "votes", "errors"])

    hits = pairs.select("q", "qf", "rf", *[F.col(f"rep.{c}").alias(c) for c in ids]).mapInArrow(check, "q long, " + ", ".join(f"{c} long" for c in ids) + ", offset int, votes int, errors double")
    links = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(*ids, "offset", "votes", "errors"))).alias("links"))
    summary = classes.select("name", "class", "rep").join(links, F.col("class") == F.col("q"), "left").select("name", "rep", "links")
    out = members.select(*ids, "is_query", "name", (F.length("fp") / 4).cast("long").alias("n_integers")).join(summary, "name")
    return out.select(*ids, "n_integers", *[F.col(f"rep.{c}").alias(f"class_{c}") for c in ids], "is_query", F.when(F.col("is_query"), F.coalesce("links", F.array().cast(links.schema["links"].dataType))).alias("links"))


def query(conversations: DataFrame) -> DataFrame:
    return search(conversations, ["conv_id", "turn"], "text", F.col("conv_id") % 20 == 0)
