"""Packing documents into sequences: best fit, then swap-based local search between underfull bins.

Pieces are dealt to groups of bounded size; each group is packed alone. What its underfull bins hold
goes on to the next level, where fewer groups pack it together, until one group is left. Where pieces
do not fill bins and most would go on, only each group's emptiest bins do. So the search sees bounded
groups at any input size, and levels end for any lengths.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, id_text, materialise
from .tokenise import encoder

CAPACITY = 4096
#: Pieces of a group on average.
GROUP_PIECES = 8192
#: Share of a bin that may be free when it is closed at its level.
CLOSED_AT = 1 / 256
#: Share of a level's pieces up to which all underfull bins go on to the next.
GOES_ON = 3 / 4

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, add the end id and cut only what is longer than a sequence.

    A null text is empty: one piece with the end id. Rows with equal ids stay apart.
    """
    bounded_batches(docs.sparkSession)

    def make(batch: pa.RecordBatch) -> Iterator[tuple]:
        encode = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = encode.encode(text) + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)

    return id_text(docs, id_col, text_col).mapInArrow(arrow_rows(make, PIECES), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Longest piece first, each into the fullest bin that takes it; bins as lists of positions."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > n:
            by_free[free - n].append(b)
            mask |= 1 << (free - n)
    return bins


class _Underfull:
    """Bins with what each could give back in a swap: nothing, a piece or two, as arrays over all bins.

    What a changed bin had is struck out, and what it has is written at the end.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths = bins, lengths
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
        self.capacity, self.clock = capacity, 0
        self.changed = np.zeros(len(bins), np.int64)
        self.owner, self.back, self.pair = (np.zeros(0, t) for t in (np.int64, np.int64, bool))
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64)] * len(bins)
        self.used = 0
        for k in range(len(bins)):
            self._write(k)

    def values(self, k: int) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
        """(singles, pairs): the lengths of a bin's pieces and pairs of pieces, each with the lengths it is made of."""
        counts = Counter(self.lengths[i] for i in self.bins[k])
        own = sorted(counts)
        pairs = {x + y: (x, y) for n, x in enumerate(own) for y in own[n:] if x != y or counts[x] > 1}
        return {x: (x,) for x in own}, pairs

    def _write(self, k: int) -> None:
        self.owner[self.rows[k]] = -1
        self.rows[k] = np.zeros(0, np.int64)
        if not self.bins[k] or self.fill[k] >= self.capacity:
            return
        singles, pairs = self.values(k)
        back = [0, *singles, *pairs]
        if self.used + len(back) > len(self.owner):
            live = np.flatnonzero(self.owner[: self.used] >= 0)
            place = np.cumsum(self.owner[: self.used] >= 0) - 1
            self.rows = [place[r] for r in self.rows]
            size = 2 * (len(live) + len(back)) + 1024
            for name in ("owner", "back", "pair"):
                old = getattr(self, name)
                new = np.full(size, -1, old.dtype) if name == "owner" else np.zeros(size, old.dtype)
                new[: len(live)] = old[live]
                setattr(self, name, new)
            self.used = len(live)
        at = np.arange(self.used, self.used + len(back))
        self.owner[at], self.back[at], self.pair[at] = k, back, at > self.used + len(singles)
        self.rows[k] = at
        self.used += len(back)

    def step(self, source: int, since: int) -> bool:
        """Make the exchange with a bin changed after `since` that adds most to the squared fills, if one adds."""
        target = (self.changed > since) & (self.fill >= self.fill[source]) & (self.fill < self.capacity)
        target[source] = False
        owner = self.owner[: self.used]
        # Where an entry is struck out, -1 reads the last one, so it must be no target.
        rows = np.flatnonzero(np.append(target, False)[owner])
        if not len(rows):
            return False
        singles, pairs = self.values(source)
        one, any_of = np.array(sorted(singles)), np.array(sorted({**pairs, **singles}))
        owner, back, pair = owner[rows], self.back[rows], self.pair[rows]
        most = back + self.capacity - self.fill[owner]
        # The largest that fits; a pair is given back for one piece only.
        give = np.where(pair, np.append(one, 0)[np.searchsorted(one, most, "right") - 1], np.append(any_of, 0)[np.searchsorted(any_of, most, "right") - 1])
        gain = give - back
        gain[gain < 0] = 0
        adds = gain * (self.fill[owner] - self.fill[source] + gain)
        best = int(adds.argmax())
        if adds[best] <= 0:
            return False
        k, value = int(owner[best]), int(give[best])
        given = singles.get(value) or pairs[value]
        theirs, their_pairs = self.values(k)
        y = int(back[best])
        got = () if not y else their_pairs[y] if pair[best] else theirs[y]
        self._move(source, k, given)
        self._move(k, source, got)
        self.fill[source] -= gain[best]
        self.fill[k] += gain[best]
        self.clock += 1
        self.changed[[source, k]] = self.clock
        self._write(source)
        self._write(k)
        return True

    def _move(self, a: int, b: int, wanted: tuple[int, ...]) -> None:
        for length in wanted:
            i = next(i for i in self.bins[a] if self.lengths[i] == length)
            self.bins[a].remove(i)
            self.bins[b].append(i)


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Move pieces, one for one, two for one, one for two or alone, from emptier to fuller underfull bins.

    Each step adds to a bin that is at least as full as the one it takes from, so the sum of squared
    fills grows and the search ends: when no exchange is left that adds to it, or the bins are as few
    as the pieces' sum needs. A bin that loses its last piece is dropped. A bin that found no exchange
    is tried again with the bins that have changed since.
    """
    least = math.ceil(sum(lengths) / capacity)
    bins = [list(b) for b in bins if b]
    if len(bins) <= least:
        return bins
    full = [b for b in bins if sum(lengths[i] for i in b) >= capacity]
    bins = [b for b in bins if sum(lengths[i] for i in b) < capacity]
    state = _Underfull(bins, lengths, capacity)
    alive = len(full) + len(bins)
    tried = np.full(len(bins), -1, np.int64)
    moved = True
    while moved and alive > least:
        moved = False
        for source in np.argsort(state.fill, kind="stable").tolist():
            while bins[source] and state.fill[source] < capacity and alive > least:
                # What has itself changed since is tried with all.
                since = int(tried[source]) if state.changed[source] <= tried[source] else -1
                if not state.step(source, since):
                    tried[source] = state.clock
                    break
                moved = True
                alive -= not bins[source]
    return full + [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _group_packer(level: int, last: bool, capacity: int, quota: int):
    """Packs one group; bins that stay open go to the next level, and at the last one all close.

    `emptiest` marks those of the open bins that go on where too many are open: the emptiest with
    `quota` pieces together, and one at least.
    """

    def run(key, table):
        order = pa.compute.sort_indices(table, [("length", "descending"), ("uid", "ascending")])
        table = table.take(order).drop_columns(["grp"])
        lengths = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        is_open, emptiest = np.zeros(len(lengths), bool), np.zeros(len(lengths), bool)
        stay: list[tuple[int, list[int]]] = []
        for b, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in sorted(members):
                sequence[i] = (level << 56) | (key[0].as_py() << 24) | b
                offset[i] = at
                at += lengths[i]
            if not last and capacity - at > CLOSED_AT * capacity:
                is_open[members] = True
                stay.append((at, members))
        taken = 0
        for _, members in sorted(stay):
            if taken and taken + len(members) > quota:
                break
            emptiest[members] = True
            taken += len(members)
        for name, values in (("sequence_id", sequence), ("offset", offset), ("open", is_open), ("emptiest", emptiest)):
            table = table.append_column(name, pa.array(values))
        return table

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to a table with a column `length` (1 to capacity).

    All other columns are kept, but for columns named uid, level, sequence_id or offset, which are
    replaced. Equal rows stay apart. An empty table gives an empty table.
    """
    bounded_batches(pieces.sparkSession)
    kept = [c for c in pieces.columns if c not in ("uid", "level", "sequence_id", "offset", "grp", "open", "emptiest")]
    # Ids are made once and read from the written table, so that a repeated task sees the same ones.
    left = materialise(pieces.select(*kept).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    done: list[DataFrame] = []
    level = 0
    while n := left.count():
        groups = max(1, math.ceil(n / group_pieces))
        last = groups == 1

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
        pack_group = _group_packer(level, last, capacity, max(1, group_pieces // groups))
        packed = materialise(dealt.groupBy("grp").applyInArrow(pack_group, f"{fields}, sequence_id long, offset long, open boolean, emptiest boolean"), "packed")
        # Each level has at most GOES_ON of the pieces of the one before, so levels end.
        goes_on = next((c for c in ("open", "emptiest") if not last and packed.filter(c).count() <= GOES_ON * n), None)
        done.append((packed.filter(~F.col(goes_on)) if goes_on else packed).select(*kept, "sequence_id", "offset"))
        if goes_on is None:
            break
        left = packed.filter(goes_on).select(*left.columns)
        level += 1
    if not done:
        return left.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the sequence and the place of each."""
    return pack(pieces(docs, vocabulary, end_id, capacity), capacity)
