"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

Every distinct word sequence is a node, named by 128 bits. Its shingles are put in one global order, rarest first by a corpus-wide
count sketch of fixed size, ties by hash. Two sets can only reach the threshold if their prefixes share a shingle, so prefixes are
dealt to buckets by shingle, packed as arrays, and a bucket joins the nodes that meet at a shingle. Pairs that pass the length and
positional bounds become candidates; a bound on how far two sets differ (the parity of their shingles on 2 ** k places) drops
nearly all that do not reach the threshold, before any text is moved.

A shingle held by many nodes (one large group of near copies, say) is not expanded into all pairs. Its nodes are compared with
the group's least node first. When components of those links are known, only groups that still hold nodes of several components
are looked at again: the nodes outside of a group's largest component are held against the whole group, block by block, so that
no task holds a group, and only pairs across components are added: each node's nearest first, since they join most components,
then all that are left. Pairs inside a component cannot change the result, so no link between components is lost and nothing is
capped.

Candidates are verified on both whole texts, each distinct pair once; a suffix filter on the tails gives up early. Tables in the
shared folder are deleted as soon as nothing reads them again.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer than five words are one shingle; equal
texts share a node; repeated rows each get a row; a null doc_id gets its group's component and takes no part in the minimum (a
null where it stands alone); texts of any length are taken whole, hashed a megabyte at a time; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written
from .components import components
from .shingles import Shingler, key_of, normal

SIZE = 5
#: Similarity as a fraction of whole numbers.
NUM, DEN = 3, 4
SKETCH_BITS = 20
CHUNK = 4096
#: Nodes at one shingle up to which all their pairs are made at once.
SMALL_GROUP = 16
#: Places of a set's parity.
LEAST_MOST_BITS = (1024, 65536)
#: Rounds in which only each node's so many nearest pairs of a block are verified, before all that are left are.
NEAREST_ROUNDS = (2,)
#: Documents whose prefixes fill one bucket; nodes of one block of a large group.
BUCKET_DOCS, BLOCK = 2000, 1024
#: Entries of prefixes, and documents, that a task holds before it deals them out.
HELD_ENTRIES, HELD_DOCS = 400_000, 60_000
#: Texts that a task knows again; others may leave it twice, which costs a little and changes nothing.
SEEN = 500_000

PROFILE = ["doc_id", "node", "n", "chunk", "counts", "parity"]


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def parity(x: np.ndarray) -> np.ndarray:
    """Which of 2 ** k places an odd number of shingles falls on, packed into words; k grows with the set. Two sets differ in at
    least as many shingles as their parities differ in places. Halves may be folded onto each other by exclusive or."""
    bits = 1 << int(np.clip(2 * len(x), *LEAST_MOST_BITS)).bit_length() - 1
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Places in which two parities differ, after folding the longer one."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def profile(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One pass: per document its id, node key, number of shingles and parity; per task the sketch of its shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch = Shingler(size), np.zeros(1 << SKETCH_BITS, np.int64)
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            sets = shingler.of_many(texts)
            sketch += np.bincount(np.concatenate([(x >> shift).astype(np.uint32) for x in sets]).astype(np.int64), minlength=len(sketch))
            n = len(texts)
            marks = [parity(x).tobytes() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(map(key_of, texts), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(marks, pa.binary())], names=PROFILE)
        rows = [(i, sketch[i * CHUNK : (i + 1) * CHUNK]) for i in range(len(sketch) // CHUNK)]
        rows = [(i, c.astype(np.uint32).tobytes()) for i, c in rows if c.any()]
        if rows:
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.nulls(n, pa.binary())], names=PROFILE)

    return _mapped(docs.select("doc_id", "text"), run, "doc_id long, node binary, n long, chunk int, counts binary, parity binary")


def sketch_of(profiled: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """The corpus-wide sketch (2 ** bits counts, whatever the corpus): summed on the cluster chunk by chunk."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for b in table.column("counts").to_pylist():
            total += np.frombuffer(b, np.uint32)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(1 << bits, np.int64)
    for r in profiled.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def rarest(x: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Places of the k shingles of x (sorted) that the sketch counts least, ties by hash."""
    return (np.sort(counts.astype(np.uint64) << np.uint64(32) | np.arange(len(x), dtype=np.uint64))[:k] & np.uint64(0xFFFFFFFF)).astype(np.int64)


PACKED = "bucket long, tokens binary, local binary, at binary, nodes binary, sizes binary"


def packs(docs: DataFrame, buckets: int, sketch, size: int = SIZE) -> DataFrame:
    """Prefix shingles dealt to buckets: arrays of shingle, place of its node in the pack's list, position; and that list with
    the nodes' set sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, seen = Shingler(size), sketch.value, set()
        shift = np.uint64(64 - SKETCH_BITS)
        tokens: list[np.ndarray] = []
        nodes: list[bytes] = []
        sizes: list[int] = []

        def emit():
            n = np.array([len(x) for x in tokens])
            token = np.concatenate(tokens)
            who = np.repeat(np.arange(len(nodes)), n)
            at = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # within a bucket by node
            bucket, token, who, at = bucket[order], token[order], who[order], at[order].astype(np.uint32)
            new = np.append(True, (bucket[1:] != bucket[:-1]) | (who[1:] != who[:-1]))
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(first[1:], len(bucket))
            nth = np.cumsum(new) - 1
            local = (nth - nth[first].repeat(ends - first)).astype(np.uint32)
            names, size_of = np.frombuffer(b"".join(nodes), "V16"), np.array(sizes, np.uint32)
            out = []
            for a, b in zip(first, ends, strict=True):
                listed = who[a:b][new[a:b]]
                out.append((token[a:b].tobytes(), local[a:b].tobytes(), at[a:b].tobytes(), names[listed].tobytes(), size_of[listed].tobytes()))
            for x in (tokens, nodes, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64())] + [pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

        n_held = 0
        for batch in batches:
            fresh = {}
            for text in batch.column(0).to_pylist():
                words = normal(text)
                node = key_of(words)
                if words and node not in seen:  # an equal text of this task has sent its prefix
                    fresh[node] = words
                    if len(seen) < SEEN:
                        seen.add(node)
            for node, x in zip(fresh, shingler.of_many(list(fresh.values())), strict=True):
                tokens.append(x[rarest(x, counts[(x >> shift).astype(np.int64)], prefix_length(len(x)))])
                nodes.append(node)
                sizes.append(len(x))
                n_held += len(tokens[-1])
                if n_held >= HELD_ENTRIES or len(nodes) >= HELD_DOCS:
                    yield emit()
                    n_held = 0
        if nodes:
            yield emit()

    return _mapped(docs.select("text"), run, PACKED)


def can_reach(n1, at1, n2, at2):
    """Length and positional filters: may sets of sizes n1, n2 that meet at these places reach the threshold?"""
    length = DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)
    most = np.minimum(at1, at2) + 1 + np.minimum(n1 - at1 - 1, n2 - at2 - 1)
    return length & ((NUM + DEN) * most >= NUM * (n1 + n2))


def named(nodes: np.ndarray) -> pa.Array:
    """Names (two numbers each, the first byte leading) as a binary column."""
    return pa.array(nodes.astype(">u8").view("V16").ravel().tolist(), pa.binary())


MET = "a binary, b binary, grp binary, node binary, size long, at long"


def meet(packed: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) of small groups and of large groups' least nodes; and the members of large groups, a row each."""

    def join(table: pa.Table) -> pa.Table:
        def col(name, dtype):
            return [np.frombuffer(b, dtype) for b in table.column(name).to_pylist()]

        listed, local = col("nodes", ">u8"), col("local", np.uint32)
        base = np.cumsum([0] + [len(x) // 2 for x in listed])[:-1]
        names, sizes = np.concatenate(listed).reshape(-1, 2), np.concatenate(col("sizes", np.uint32)).astype(np.int64)
        order = np.lexsort((names[:, 1], names[:, 0]))
        names, sizes = names[order], sizes[order]
        new = np.append(True, (names[1:] != names[:-1]).any(axis=1))
        dense = np.empty(len(order), np.int64)  # nodes by number, in the order of their names
        dense[order] = np.cumsum(new) - 1
        names, sizes = names[new], sizes[new]
        tokens, at = np.concatenate(col("tokens", np.uint64)), np.concatenate(col("at", np.uint32)).astype(np.int64)
        nodes = dense[np.concatenate([x + b for x, b in zip(local, base, strict=True)])]
        order = np.lexsort((nodes, tokens))
        tokens, nodes, at = tokens[order], nodes[order], at[order]
        new = np.append(True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1]))
        tokens, nodes, at = tokens[new], nodes[new], at[new]
        n = sizes[nodes]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        count = np.diff(np.append(first, len(tokens)))
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m in range(2, SMALL_GROUP + 1):
            starts = first[count == m]
            for i in range(m if len(starts) else 0):
                for j in range(i + 1, m):
                    p, q = starts + i, starts + j
                    ok = can_reach(n[p], at[p], n[q], at[q])
                    left.append(nodes[p[ok]])
                    right.append(nodes[q[ok]])
        groups: dict[bytes, tuple] = {}
        for s, m in zip(first[count > SMALL_GROUP], count[count > SMALL_GROUP], strict=True):
            e = slice(s, s + m)
            # nodes are sorted: the first is the least
            ok = can_reach(n[s], at[s], n[s + 1 : s + m], at[s + 1 : s + m])
            left.append(np.full(int(ok.sum()), nodes[s]))
            right.append(nodes[s + 1 : s + m][ok])
            groups.setdefault(nodes[e].tobytes() + at[e].tobytes(), (tokens[s].tobytes(), nodes[e], at[e]))
        pairs = np.unique(np.concatenate(left) * len(names) + np.concatenate(right))
        g = list(groups.values())
        members = np.concatenate([np.empty(0, np.int64), *(x[1] for x in g)])
        places = np.concatenate([np.empty(0, np.int64), *(x[2] for x in g)])
        k, m = len(pairs), len(members)
        none = lambda c, kind: pa.nulls(c, kind)
        columns = {
            "a": (named(names[pairs // len(names)]), none(m, pa.binary())),
            "b": (named(names[pairs % len(names)]), none(m, pa.binary())),
            "grp": (none(k, pa.binary()), pa.array([x[0] for x in g], pa.binary()).take(pa.array(np.repeat(np.arange(len(g)), [len(x[1]) for x in g])))),
            "node": (none(k, pa.binary()), named(names[members])),
            "size": (none(k, pa.int64()), pa.array(sizes[members])),
            "at": (none(k, pa.int64()), pa.array(places)),
        }
        return pa.table({c: pa.chunked_array(list(x)) for c, x in columns.items()})

    return packed.groupBy("bucket").applyInArrow(join, MET)


def near_enough(pairs: DataFrame, parities: DataFrame) -> DataFrame:
    """The pairs(a, b) whose parities do not rule them out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)):
                if (NUM + DEN) * apart(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) <= (DEN - NUM) * (n + m):
                    keep.append(i)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    of = [parities.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"parity_{s}")) for s in "ab"]
    both = pairs.select("a", "b").join(of[0], "a").join(of[1], "b")
    return _mapped(both.select("a", "b", "n_a", "n_b", "parity_a", "parity_b"), check, "a binary, b binary")


def verify(pairs: DataFrame, docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The pairs(a, b) whose whole texts reach the threshold. Texts move by node once; a pair takes the text of b to that of a."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for batch in batches:
            out = {}
            for text in batch.column(0).to_pylist():
                words = normal(text)
                node = key_of(words)
                if words and node not in seen:  # one copy of a text leaves a task
                    out[node] = pack(words)
                    if len(seen) < SEEN:
                        seen.add(node)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.binary())], names=["node", "words"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingler, unpack = Shingler(size), zstandard.ZstdDecompressor().decompress
        kept: dict[bytes, np.ndarray] = {}

        def shingles(node, words):
            x = kept.get(node)
            if x is None:
                x = shingler.of_words(unpack(words))
                if len(kept) >= 256:
                    kept.clear()
                kept[node] = x
            return x

        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = shingles(a, ta), shingles(b, tb)
                need = -(-NUM * (len(x) + len(y)) // (NUM + DEN))
                if min(len(x), len(y)) < need:
                    continue
                # suffix filter: halves on either side of x's middle bound the overlap
                mid = len(x) // 2
                cut = int(np.searchsorted(y, x[mid]))
                if min(mid, cut) + min(len(x) - mid, len(y) - cut) < need:
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if int((y[at] == x).sum()) >= need:
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _mapped(docs.select("text"), keyed, "node binary, words binary")
    texts = written(texts.join(nodes.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words")), "texts")
    of = [texts.select(F.col("node").alias(s), F.col("words").alias(f"words_{s}")) for s in "ab"]
    both = pairs.join(of[1], "b").join(of[0], "a")
    links = written(_mapped(both.select("a", "b", "words_a", "words_b"), check, "a binary, b binary"), "links")
    discard(texts)
    return links


def cross(table: pa.Table, nearest: int | None) -> pa.Table:
    """Pairs of a block's outer nodes (outside of the group's largest component) and members in other components that pass the
    length, positional and parity filters; of each outer node's, the `nearest` by parity, or all."""
    t = table.sort_by([("size", "ascending"), ("node", "ascending")])
    node, n, at, c = (t.column(k).to_pylist() for k in ("node", "size", "at", "component"))
    n, at, outer = np.array(n), np.array(at), np.array(t.column("outer").to_pylist(), bool)
    number = {x: i for i, x in enumerate(dict.fromkeys(c))}
    c = np.array([number[x] for x in c])
    marks = [np.frombuffer(b, np.uint64) for b in t.column("parity").to_pylist()]
    words = np.array([len(m) for m in marks])
    inner = np.flatnonzero(~outer)
    folded: dict[int, np.ndarray] = {}

    def at_level(k: int) -> np.ndarray:
        """Parities of the members that have k words or more, folded to k words."""
        if k not in folded:
            folded[k] = np.stack([np.bitwise_xor.reduce(marks[i].reshape(-1, k), axis=0) if len(marks[i]) >= k else np.zeros(k, np.uint64) for i in inner])
        return folded[k]

    pairs = set()
    for i in np.flatnonzero(outer):
        # sorted by size: outside of these places the length filter fails
        lo, hi = np.searchsorted(n[inner], -(-NUM * n[i] // DEN)), np.searchsorted(n[inner], DEN * n[i] // NUM, side="right")
        j = np.arange(lo, hi)
        j = j[(c[inner[j]] != c[i]) & can_reach(n[i], at[i], n[inner[j]], at[inner[j]])]
        far = np.empty(len(j), np.int64)
        small = words[inner[j]] < words[i]
        if (~small).any():
            far[~small] = np.bitwise_count(at_level(int(words[i]))[j[~small]] ^ marks[i]).sum(axis=1, dtype=np.int64)
        far[small] = [apart(marks[i], marks[inner[x]]) for x in j[small]]
        close = (NUM + DEN) * far <= (DEN - NUM) * (n[i] + n[inner[j]])
        j, far = j[close], far[close]
        if nearest is not None and len(j) > nearest:
            j = j[np.argsort(far, kind="stable")[:nearest]]
        pairs.update((min(node[i], node[x]), max(node[i], node[x])) for x in inner[j])
    a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def across(members: DataFrame, labels: DataFrame, parities: DataFrame, tried: list[DataFrame], nearest: int | None = None) -> DataFrame:
    """Pairs of large groups whose nodes are in different components so far, without those that were tried, written. A group with
    several components is cut into blocks of about BLOCK nodes; its outer nodes, those outside of the largest component, go in
    blocks against every block of the group."""
    m = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = m.groupBy("grp", "component").agg(F.count("*").alias("held"))
    most = sizes.groupBy("grp").agg(F.max(F.struct("held", "component")).alias("most"), F.sum("held").alias("all_"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda rows: F.ceil(rows / F.lit(BLOCK)).cast("int")
    most = most.select("grp", F.col("most.component").alias("main"), blocks(F.col("all_")).alias("n_all"), blocks(F.col("all_") - F.col("most.held")).alias("n_outer"))
    most = written(most, "main")  # a plain table, so that Spark may split a large group's rows in the join
    m = m.join(most, "grp").join(parities.select("node", "parity"), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    columns = ["grp", "node", "size", "at", "component", "parity"]
    inner = m.select(*columns, F.lit(False).alias("outer"), own(F.col("n_all")).alias("j"), F.explode(F.sequence(F.lit(0), F.col("n_outer") - 1)).alias("i"))
    outer = m.where("component <> main").select(*columns, F.lit(True).alias("outer"), own(F.col("n_outer")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"))
    pairs = inner.unionByName(outer).groupBy("grp", "i", "j").applyInArrow(lambda t: cross(t, nearest), "a binary, b binary").distinct()
    for t in tried:
        pairs = pairs.join(t, ["a", "b"], "left_anti")
    out = written(pairs, "more")
    discard(most)
    return out


def grouped(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Per document doc_id, node and n; per node its least doc_id and its component."""
    spark = docs.sparkSession
    profiled = written(profile(docs, size), "profile")
    sketch = spark.sparkContext.broadcast(sketch_of(profiled))  # fixed size
    of = profiled.where("chunk is null").select("doc_id", "node", "n")
    buckets = max(8, -(-of.count() // BUCKET_DOCS))
    met = written(meet(packs(docs, buckets, sketch, size)), "met")
    nodes = profiled.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    nodes = written(nodes, "nodes")
    parities = nodes.select("node", "n", "parity")
    members = met.where("grp is not null").select("grp", "node", "size", "at")
    pairs = met.where("a is not null").select("a", "b").distinct()
    near = written(near_enough(pairs, parities), "near")
    links = verify(near, docs, size)
    tried, found = [near], [links]
    labels = components(links)
    # first each node's nearest pairs, which join most components; what is then left across components is verified in full
    for nearest in (*NEAREST_ROUNDS, None):
        more = across(members, labels, parities, tried, nearest)
        tried.append(more)
        if more.limit(1).count():
            links = verify(more, docs, size)
            found.append(links)
            if links.limit(1).count():
                discard(labels)
                every = found[0]
                for x in found[1:]:
                    every = every.union(x)
                labels = components(every)
    for x in (met, *tried, *found):
        discard(x)
    out = written(nodes.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "named")
    discard(nodes)
    discard(labels)
    return of, out


def linked(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document: doc_id, n_shingles and the smallest doc_id reachable by links."""
    of, nodes = grouped(docs, size)
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    found = nodes.join(ids, "component").select("node", "component_id")
    empty = of.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return of.where("node is not null").join(found, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty)


def keep_one(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row of docs for each group: one with the group's smallest doc_id, null only where all are, and of the texts under that
    id the one with the least node. Rows of texts without words stay, once for each doc_id and text where they have an id. Other
    columns come back as they are, whatever their names."""
    _, nodes = grouped(docs, size)
    first = nodes.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "node")).alias("first"))
    first = written(first.select(F.col("first.least").alias("least"), F.col("first.node").alias("node")), "kept")
    discard(nodes)

    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series([key_of(normal(t if isinstance(t, str) else None)) for t in texts], dtype=object)

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), key(F.col("text")).alias("d_node"))
    one = rows.join(first, F.col("id").eqNullSafe(F.col("least")) & (F.col("d_node") == F.col("node")), "left_semi").dropDuplicates(["d_node"])
    bare = rows.where("d_node is null")
    with_id = bare.where("id is not null").withColumn("said", F.col("row.text")).dropDuplicates(["id", "said"]).drop("said")
    return one.unionByName(with_id).unionByName(bare.where("id is null")).select("row.*")
