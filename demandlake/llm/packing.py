"""Hierarchical residual packing of tokenised documents into sequences.

``pieces`` encodes whole texts and cuts only those longer than ``capacity``: full pieces, the first
one taking the rest. ``pack`` then works in rounds on items, first one per piece. Items are hashed
into groups of bounded size; each group packs its items best-fit, largest first; bins filled to
``EMIT`` of the capacity are final sequences, the others become the items of the next round, which
has half the groups (a tree merge). Where the underfull bins no longer fit into half the groups, and
at the end, the tree's root packs all that are left: bins of equal fill are interchangeable, so their
counts per fill, ``capacity`` numbers at most, stand for them in the best-fit (``best_fit_classes``),
and each bin finds its place there by its rank among those of its fill. So the root sees every
underfull bin, whatever their number, and holds none. Bins of small groups may be too full to share
and yet not full: where the counts say that fewer sequences come of it, the root takes their pieces
as its items instead. An item carries its member pieces, at most
``capacity`` of them, so no join is needed to say where a piece ends up.

Defined results: null or empty text -> one piece with the end id; every row packs on its own, rows
of equal id included; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, save, spans_of, table, texts
from .tokens import crc, encoder, vocab_path

CAPACITY = 1024
GROUP_MEMBERS = 60_000  # pieces that one task packs together
EMIT = 0.998
ENCODE_STEP = 128

MEMBER = "array<struct<doc_id:{id},piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, drops_space: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        enc = encoder(vocab, drops_space)
        for b in batches:
            for at in range(0, b.num_rows, ENCODE_STEP):
                part = b.slice(at, ENCODE_STEP)
                ids, ends = enc.encode_lists(texts(part))
                size = np.diff(ends, prepend=0)
                n = -(-size // capacity)  # pieces of each document, the first of which takes the rest
                own, first = np.repeat(np.arange(len(size)), n), size - (n - 1) * capacity
                piece = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece > 0, first[own] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[own])
                raw, at = ids.tobytes(), 4 * (ends - size)[own] + 4 * start
                sums = [crc(raw[a:z]) for a, z in zip(at.tolist(), (at + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item indices: each item, largest first, goes to the fullest bin that can take it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set while a bin with room r is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        left = room - n
        if left:
            by_room[left].append(k)
            open_rooms |= 1 << left
    return bins


def best_fit_classes(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``best_fit`` on counts per size: (number of bins, {size: times in each}).

    Of equal items a bin takes as many as it can, as best fit comes back to the bin it just filled. A
    size splits one class of bins at most in two, so there are at most a few classes per size.
    """
    classes: list[list] = []  # [bins, content]
    by_room: dict[int, list[int]] = {}

    def put(bins: int, content: dict[int, int], room: int) -> None:
        classes.append([bins, content])
        by_room.setdefault(room, []).append(len(classes) - 1)

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r, own in by_room.items() if r >= size and own), default=None)
            if room is None:
                each = capacity // size
                put(-(-left // each), {}, capacity)
                continue
            k = by_room[room].pop()
            bins, content = classes[k]
            each = min(room // size, left)
            used = min(bins, left // each)
            put(used, {**content, size: each}, room - each * size)
            left -= used * each
            classes[k][0] = bins - used
            if bins > used:
                by_room[room].append(k)
    return [(n, content) for n, content in classes if n and content]


def _root(items: DataFrame, capacity: int) -> DataFrame:
    """All underfull bins packed by ``best_fit_classes``; the result has the columns of ``items``."""

    def numbered(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            fill = b.column(0).to_numpy()
            order = np.argsort(fill, kind="stable")
            own, first, n = np.unique(fill[order], return_index=True, return_counts=True)
            seq = np.empty(len(fill), np.int64)
            seq[order] = np.arange(len(fill)) - np.repeat(first, n) + seen[fill[order]]
            seen[own] += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(fill), part, np.int32)), pa.array(seq)], names=["fill", "members", "part", "seq"])

    def classes(column: str) -> list[tuple[int, dict[int, int]]]:
        sizes = items.select("fill" if column == "fill" else F.explode("members.length").alias("length"))
        return best_fit_classes({r[0]: r[1] for r in sizes.groupBy(column).agg(F.count(F.lit(1))).collect()}, capacity)  # one row per size, capacity at most

    bins, apart = classes("fill"), classes("length")
    if sum(n for n, _ in apart) < sum(n for n, _ in bins):
        bins = apart
        items = items.select(F.explode("members").alias("m")).select(F.col("m.length").alias("fill"), F.array("m").alias("members"))
    rows = save(arrow_map(items, numbered, f"fill long, members {items.schema['members'].dataType.simpleString()}, part int, seq long"), "pack-root")
    per_part = rows.groupBy("fill", "part").agg(F.count(F.lit(1)).alias("n"))
    before = per_part.select(F.col("fill").alias("f"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("fill").orderBy("part")) - F.col("n")).alias("before"))
    starts: dict[int, list] = {}
    taken: dict[int, int] = {}
    base = 0
    for n, content in bins:
        for size, each in content.items():
            starts.setdefault(size, []).append((taken.get(size, 0), each, base))
            taken[size] = taken.get(size, 0) + each * n
        base += n
    tables = {size: np.array(own, np.int64).T for size, own in starts.items()}

    def bins_of(batches):
        for b in batches:
            fill, rank = b.column(0).to_numpy(), b.column(2).to_numpy()
            bin_of = np.empty(len(fill), np.int64)
            for size in np.unique(fill).tolist():
                at = np.flatnonzero(fill == size)
                first, each, number = tables[size]
                k = np.searchsorted(first, rank[at], "right") - 1
                bin_of[at] = number[k] + (rank[at] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bin_of)], names=["fill", "members", "bin"])

    ranked = rows.join(before, (F.col("fill") == F.col("f")) & (F.col("part") == F.col("p"))).select("fill", "members", (F.col("before") + F.col("seq")).alias("rank"))
    placed = arrow_map(ranked, bins_of, f"fill long, members {items.schema['members'].dataType.simpleString()}, bin long")
    return placed.groupBy("bin").agg(F.sum("fill").alias("fill"), F.flatten(F.collect_list("members")).alias("members")).select("fill", "members")


def _round(items: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Pack each of ``groups`` groups of (fill, members) best-fit; the result has the same columns."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        members, fill = pa.concat_arrays(t.column("members").chunks), t.column("fill").to_numpy()
        bins = best_fit(fill, capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        first = np.concatenate([[0], np.cumsum([len(b) for b in bins])[:-1]]).astype(np.int64)
        moved = members.take(pa.array(order))
        per_bin = np.add.reduceat(moved.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), first)
        values, starts, fills = moved.flatten(), np.concatenate([[0], np.cumsum(per_bin)]), np.add.reduceat(fill[order], first)
        for a in range(0, len(bins), 4096):
            z = min(a + 4096, len(bins))
            own = values.slice(starts[a], starts[z] - starts[a])
            yield pa.RecordBatch.from_arrays([pa.array(fills[a:z]), pa.ListArray.from_arrays(pa.array(starts[a:z + 1] - starts[a], pa.int32()), own)], names=["fill", "members"])

    dealt = items.repartition(groups, F.xxhash64(F.lit(turn), "fill", F.col("members")[0]))
    return arrow_map(dealt, run, items.schema)


def _placed(bins: DataFrame, id_type: str) -> DataFrame:
    """One row per member: its bin's number and its offset there."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for b in batches:
            members = b.column(0)
            n = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            own = members.flatten()
            length = own.field("length").to_numpy(zero_copy_only=False)
            ends = np.cumsum(length)
            first = np.repeat(spans_of(n), n)
            offset = ends - length - (ends - length)[first] if len(length) else length
            columns = [own.field(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number + np.repeat(np.arange(len(n)), n)), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
            number += len(n)

    return arrow_map(bins, run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(parts: DataFrame, capacity: int = CAPACITY, group_members: int = GROUP_MEMBERS, emit: float = EMIT) -> DataFrame:
    """The pieces with sequence_id (any numbers) and offset."""
    id_type = parts.schema["doc_id"].dataType.simpleString()
    items = save(parts.select(F.col("length").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).cast(MEMBER.format(id=id_type)).alias("members")), "pack-items")
    full = F.col("fill") >= int(emit * capacity)
    size = lambda df: df.agg(F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("m")).first().m
    done, items, turn = [items.where(full)], items.where(~full), 0
    left = size(items)
    groups = first = -(-left // group_members)
    while left and left <= groups * group_members:
        got = save(_round(items, groups, turn, capacity), "pack-round")
        done.append(got.where(full))
        items, turn = got.where(~full), turn + 1
        left = size(items)
        if groups == 1:
            break
        groups = -(-groups // 2)
    if left and first > 1:
        items = _root(items, capacity)
    out = items
    for d in done:
        out = out.unionAll(d)
    return _placed(out.select("members"), id_type)


def op10_best_fit_packing(spark, sf_dir, vocab: str | None = None):
    return pack(pieces(table(spark, sf_dir, "documents"), vocab or vocab_path("byte_bpe_50k.json")))
