"""SimHash near-duplicates by deletion variants.

A fingerprint is cut into so few segments that, of two fingerprints that are to be found, at least
one segment differs in at most one bit. Each segment is indexed once for each of its 4-bit groups,
with that group blanked: a segment that differs in at most one bit agrees with the other's in the
variant that blanks it. An equality join on these variants gives the candidates, which are verified.
(Blanking one bit a variant, four times the rows, finds nothing more: `blank_bits=1`.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, discard, id_text, likely, materialise, to_batch
from .components import components

#: Members of a bucket that are compared in one matrix.
BLOCK = 1024
#: Members of a bucket from which it is cut by a second index before it is compared.
LARGE_BUCKET = 4096


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, repeats included; fewer words: of all of them."""
    found = text.encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): 64-bit SimHash of whole texts, as a signed long. Null or wordless texts: 0."""
    bounded_batches(docs.sparkSession)

    def make(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            fp = simhash(text, words)
            yield doc_id, fp - (1 << 64) if fp >> 63 else fp

    return id_text(docs, id_col, text_col).mapInArrow(arrow_rows(make, FINGERPRINTS, 8192), "doc_id long, fp long")


def segments_for(distance: int) -> int:
    """The fewest segments of which one differs in at most one bit."""
    return distance // 2 + 1


def variant_keys(distance: int, blank_bits: int = 4, bits: int = 64) -> list[tuple[int, int]]:
    """(number, mask) of each variant: the segment's bits without the blanked group."""
    n = segments_for(distance)
    cuts = [round(i * bits / n) for i in range(n + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        whole = ((1 << (b - a)) - 1) << a
        for at in range(a, b, blank_bits):
            blank = ((1 << min(blank_bits, b - at)) - 1) << at
            out.append((len(out), whole & ~blank))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """Union-find over n rows that keeps the edges which joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        x, y = self.root(i), self.root(j)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((i, j))

    def add(self, near: np.ndarray, first: int, second: int) -> None:
        """Join what a matrix of rows from `first` and columns from `second` says is near."""
        while True:
            root = self.roots()
            left, right = root[first : first + near.shape[0]], root[second : second + near.shape[1]]
            apart = near & (left[:, None] != right[None, :])
            rows = np.flatnonzero(apart.any(1))
            if not len(rows):
                return
            for i, j in zip(rows.tolist(), apart[rows].argmax(1).tolist(), strict=True):
                self.join(first + i, second + j)


def spanning_edges(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs at `distance` or less connect, and no more than one less than the rows.

    A group around one row is settled by that row alone; only what is left apart is compared further.
    """
    n = len(fps)
    forest = Forest(n)
    for i in range(min(n, 4)):
        forest.add((np.bitwise_count(fps[i] ^ fps) <= distance)[None, :], i, 0)
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            root = forest.roots()
            if len(np.unique(np.concatenate([root[a : a + BLOCK], root[b : b + BLOCK]]))) > 1:
                forest.add(np.bitwise_count(fps[a : a + BLOCK, None] ^ fps[None, b : b + BLOCK]) <= distance, a, b)
    return forest.edges


def bucket_edges(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Edges within a large bucket, cut by finer variants first, which loses no pair.

    The finer index blanks one bit over the whole fingerprint. Pairs within the distance have one of its
    segments that differs in at most one bit, so they meet in one of its buckets.
    """
    for _, mask in variant_keys(distance, 1):
        key = fps & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(run) > 1:
                for i, j in spanning_edges(fps[run], distance):
                    yield run[i], run[j]


EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _key_columns(variants: list[tuple[int, int]], word: str, first: int = 0) -> list:
    """A hash of each variant's number and the bits that it keeps; a chance collision is only one more
    candidate, which verification drops."""
    return [F.xxhash64(F.lit(first + k), F.col(word).bitwiseAND(F.lit(_signed(mask)))) for k, mask in variants]


def linked(rows: DataFrame, distance: int, exact: bool) -> DataFrame:
    """Edges (u, v) from rows of (key, node, fp): of each key's rows those within `distance`, as forests.

    Rows are dealt by key and sorted, so that a bucket's lie together; a bucket of one costs no Python
    object. `exact`: the distance is that of the index, so a large bucket may be cut by a finer one.
    """
    bounded_batches(rows.sparkSession)
    dealt = rows.select("key", "node", "fp").repartition("key").sortWithinPartitions("key", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, nodes, held = None, [], []
        out: list[tuple] = []

        def close() -> None:
            if sum(map(len, nodes)) > 1:
                node, fps = np.concatenate(nodes), np.concatenate(held)
                found = bucket_edges(fps, distance) if exact and len(fps) > LARGE_BUCKET else spanning_edges(fps, distance)
                out.extend((int(node[i]), int(node[j])) for i, j in found if node[i] != node[j])

        for batch in batches:
            key, node, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "fp"))
            fp = fp.view(np.uint64)
            if not len(key):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            sizes = np.diff(cuts)
            ends = np.zeros(len(sizes), bool)
            ends[[0, -1]] = True
            for r in np.flatnonzero((sizes > 1) | ends):
                a, b = cuts[r], cuts[r + 1]
                if key[a] != held_key:
                    close()
                    held_key, nodes, held = key[a], [], []
                nodes.append(node[a:b].copy())
                held.append(fp[a:b].copy())
                if len(out) >= 8192:
                    yield to_batch(out, EDGES)
                    out = []
        close()
        if out:
            yield to_batch(out, EDGES)

    return dealt.mapInArrow(link, "u long, v long")


def fingerprint_edges(distinct: DataFrame, distance: int, blank_bits: int = 4) -> DataFrame:
    """Edges (u, v) between distinct 64-bit fingerprints (column fp), enough for their components."""
    keys = F.array(*_key_columns(variant_keys(distance, blank_bits), "fp"))
    return linked(distinct.select(F.explode(keys).alias("key"), F.col("fp").alias("node"), "fp"), distance, exact=True)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, blank_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Equal fingerprints collapse before anything is joined, so copies cost one row however many they
    are. A null text is empty; wordless texts have fingerprint 0 and are linked with each other and
    with what lies within the distance. Null ids are never the smallest; a component of null ids
    alone has a null component_id. Repeated rows are all returned.
    """
    fps = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(fingerprint_edges(distinct, distance, blank_bits))
    linked = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = materialise(linked, "linked-fingerprints")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by similarity: the fingerprint only proposes, the shingles decide.

#: Words of a shingle and the Jaccard similarity from which two texts are copies.
COPY_WORDS, SIMILARITY = 5, 0.8
#: Fingerprint words (64 bits each) that are indexed, in segments of 32 bits, and the distance of the one
#: further word within which two texts are compared at all.
INDEXED_WORDS, SEGMENT_BITS, SKETCH_DISTANCE = 4, 32, 16
#: Members and bytes of a block in which shingles are compared.
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: Tasks that the members of a large group are spread over where they meet its size.
SALTS = 64

WIDE = pa.schema([("uid", pa.int64()), ("same1", pa.int64()), ("same2", pa.int64()), ("size", pa.int64()), *[(f"f{i}", pa.int64()) for i in range(INDEXED_WORDS + 1)]])


def wide_simhash(text: str) -> list[int]:
    """SimHash of the set of words, INDEXED_WORDS + 1 words of 64 bits, and two hashes of the sequence.

    Of near copies a few words differ, each of which would change five shingles; over words the
    fingerprints of such copies agree in more bits.
    """
    found = text.encode("utf-8").lower().split()
    joined = b" ".join(found)
    same = [xxhash.xxh64_intdigest(joined, seed) for seed in (1, 2)]
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in set(found)], np.uint64)
    out = []
    for i in range(INDEXED_WORDS + 1):
        mixed = (h + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        out.append(majority(mixed ^ mixed >> np.uint64(29)))
    return [_signed(x) for x in (*same, len(joined), *out)]


def jaccard_edges(texts: list[str], blocks: list[int], cross: bool) -> list[tuple[int, int]]:
    """Forest edges between texts whose word shingles have at least the similarity.

    cross: only pairs from different blocks count.
    """
    sets = [np.unique(shingle_hashes(t, COPY_WORDS)) for t in texts]
    sizes = np.array([len(x) for x in sets], np.float32)
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    values, place, often = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = often > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    owner, place = owner[use], column[place[use]]
    common = np.zeros((n, n), np.float32)
    step = 1024
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(place, [at, at + step])
        part = np.zeros((n, step), np.float32)
        part[owner[a:b], place[a:b] - at] = 1
        common += part @ part.T
    near = np.zeros((n, n), bool)
    for i in range(n):  # a row at a time, so that no second matrix of floats is held
        union = sizes[i] + sizes - common[i]
        near[i] = (common[i] >= SIMILARITY * union - 1e-3) & (union > 0)
    del common
    if cross:
        block = np.array(blocks)
        near &= block[:, None] != block[None, :]
    forest = Forest(n)
    forest.add(near, 0, 0)
    return forest.edges


def _verify(key, table):
    uids = table.column("uid").to_pylist()
    found = jaccard_edges(table.column("text").to_pylist(), table.column("block").to_pylist(), key[1].as_py() != key[2].as_py())
    return pa.table([pa.array([uids[i] for i, _ in found], pa.int64()), pa.array([uids[j] for _, j in found], pa.int64())], names=["u", "v"])


SHINGLES = pa.schema([("h", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])


def _spare(n: int) -> int:
    """How many shingles are looked at beyond the fifth in which a copy may differ."""
    return max(1, n // 20)


def _shingle_rows(texts: DataFrame, whole: bool) -> DataFrame:
    """(h, node, n) for each of the n distinct shingles of a text, or only for its smallest hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = np.unique(shingle_hashes(text, COPY_WORDS))
                n = len(found)
                h = (found if whole else found[: n // 5 + _spare(n)]).view(np.int64)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), node)), pa.array(np.full(len(h), n))], schema=SHINGLES)

    return texts.mapInArrow(make, "h long, node long, n long")


def prefix_edges(texts: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all pairs of distinct texts (uid, text) with at least the similarity, and others.

    Of n shingles a text shares four fifths at least with a copy, so in any order that all texts keep, the
    first fifth and one more hold the first shingle that both have, and the first fifth and k more hold the
    first k. By hash, that drops texts which share too few of their first shingles with any other. The
    rest are taken whole and ordered by how many texts have a shingle: the rarest fifth and one
    more are joined, between texts whose numbers of shingles allow the similarity. No pair is lost.
    """
    first = _shingle_rows(texts, False)
    often = first.withColumn("often", F.count("*").over(Window.partitionBy("h"))).filter("often > 1")
    # A copy has four fifths of the shingles at least, so it may look at fewer.
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 4 / 5) / 20))
    able = often.groupBy("node", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= need)
    able = materialise(able.select(F.col("node").alias("uid")), "sharing")
    some = likely(texts, "uid", able).filter("likely").drop("likely").join(able, "uid").select("uid", "text")
    rows = materialise(_shingle_rows(some, True), "shingles")
    df = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    by_node = Window.partitionBy("node")
    ranked = rows.join(df, "h").withColumn("shared", F.count("*").over(by_node))
    ranked = ranked.withColumn("place", F.row_number().over(by_node.orderBy("df", "h")))
    # Those that no other text has come first in the order.
    rarest = ranked.filter(F.col("place") + F.col("n") - F.col("shared") <= F.floor(F.col("n") / 5) + 1)
    # Sizes that allow the similarity are in the same or neighbouring levels, which differ by a factor of a little over 1.25.
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.2501)))
    rarest = rarest.select("h", "node", F.explode(F.array(level, level + 1)).alias("level"))
    rarest = materialise(rarest, "rarest-shingles")
    least = rarest.groupBy("h", "level").agg(F.min("node").alias("u"), F.count("*").alias("m")).filter("m > 1").drop("m")
    edges = materialise(rarest.join(least, ["h", "level"]).filter("u <> node").select("u", F.col("node").alias("v")).distinct(), "prefix-edges")
    discard(able, rows, rarest)
    return edges


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored, groups): the rows with a uid, and (uid, doc_id, root) of each.

    Rows are in one group if a chain of texts connects them of which neighbours have equal words or
    shingles of at least the similarity. Candidates come from deletion variants of a wide fingerprint
    over words, and from `prefix_edges`, which proposes every pair of at least the similarity. All
    candidates are verified. Large groups of candidates are compared in pairs of blocks.
    """
    stored = materialise(docs.withColumn("uid", F.monotonically_increasing_id()), "with-uid")
    spark = docs.sparkSession
    bounded_batches(spark)

    def make(batch: pa.RecordBatch) -> Iterator[tuple]:
        for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
            yield uid, *wide_simhash(text)

    names = [f"f{i}" for i in range(INDEXED_WORDS + 1)]
    texts = stored.select("uid", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wide = texts.mapInArrow(arrow_rows(make, WIDE, 8192), "uid long, same1 long, same2 long, size long, " + ", ".join(f"{x} long" for x in names))
    wide = materialise(wide, "wide-fingerprints")
    classes = wide.groupBy("same1", "same2", "size").agg(F.min("uid").alias("node"), *[F.min(x).alias(x) for x in names])
    classes = materialise(classes, "classes")
    variants = variant_keys(2 * (64 // SEGMENT_BITS) - 1)
    keys = [k for i, x in enumerate(names[:-1]) for k in _key_columns(variants, x, 1000 * i)]
    proposed = linked(classes.select(F.explode(F.array(*keys)).alias("key"), "node", F.col(names[-1]).alias("fp")), SKETCH_DISTANCE, exact=False)
    same = wide.select("uid", "same1", "same2", "size").join(classes.select("same1", "same2", "size", "node"), ["same1", "same2", "size"])
    same = materialise(same.select("uid", "node"), "same-words")
    # Of equal texts one stands for all; only those that may be others are moved to learn that.
    others = likely(texts, "uid", same.filter("uid <> node").select("uid"))
    single = others.filter("NOT likely").select("uid", "text")
    single = single.unionByName(others.filter("likely").join(same.filter("uid <> node").select("uid"), "uid", "left_anti").select("uid", "text"))
    by_prefix = prefix_edges(single)
    groups = components(proposed.unionByName(by_prefix))
    # Most texts have no candidate: only those that may have one are moved.
    nodes = groups.select(F.col("node").alias("uid"), "root")
    members = likely(texts, "uid", nodes).filter("likely").drop("likely").join(nodes, "uid")
    members = materialise(members.select("root", "uid", "text"), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    count = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("b") / BLOCK_BYTES)).cast("int")
    # Only large groups are cut. Their numbers of blocks go to all salts, so that no group's members meet in one task.
    sizes = sizes.select("root", count.alias("blocks")).filter("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(sizes, ["root", "salt"], "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "uid", "block", "text")
    verified = components(dealt.groupBy("root", "a", "b").applyInArrow(_verify, "u long, v long"))
    named = same.join(verified, "node", "left").select("uid", F.coalesce("root", "node").alias("root"))
    ids = stored.select("uid", F.col("doc_id").cast("long").alias("doc_id"))
    found = materialise(named.join(ids, "uid"), "groups")
    discard(wide, classes, same, by_prefix, members)
    return stored, found


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of copies: that with the smallest doc_id (null: last), then the first stored.

    All columns are kept, but for one named uid, which goes. Null texts are empty, and copies of each other.
    """
    if "uid" in docs.columns:
        docs = docs.drop("uid")
    stored, groups = copies(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    kept = groups.groupBy("root").agg(first.alias("first")).select(F.col("first.uid").alias("uid"))
    # By uid, so that no group's members meet in one task.
    gone = materialise(groups.select("uid").join(kept, "uid", "left_anti"), "copies")
    # Most rows stay: only those that may go are moved to learn whether they do.
    marked = likely(stored, "uid", gone)
    sure = marked.filter("NOT likely").select(*docs.columns)
    return sure.unionByName(marked.filter("likely").join(gone, "uid", "left_anti").select(*docs.columns))
