"""Embedding near-dedup by a forest of random-projection trees.

Every tree splits recursively along random directions at medians, with spill: vectors near a split go to both sides.
Splits are fitted on a sample (``SAMPLE`` rows with the lowest hash, or one row in ``SHARE`` of a very large table); all
rows are routed and compared.  Vectors that share a leaf in any tree are compared by cosine in double precision, verified
pairs are united.

A split may part at most ``LOSS`` of the pairs of its sample that reach the cosine: where the usual spill parts more (a
group of near copies that fills much of the node), the cut moves beside the group or the spill widens to the distance of
its pairs, and a node that no such split makes cheaper to compare is a leaf, whatever its size.

The sample bounds how deep a tree can be fitted.  A leaf that ends for want of sampled rows and holds more than ``BLOCK``
rows is split again on a sample of its own (``OWN_SAMPLE`` rows or so), round by round, so leaves do not grow with the table.

Copies are made in memory.  A vector lies in a hundred leaves and more, which are not written: rows travel to the units of
a tree, nodes of tens of thousands of rows, and the task that has a unit follows the tree below it, splits large leaves
again and compares.  The units are taken in passes, and what a pass has shuffled goes before the next, so the disk holds
about two copies of the table at a time however many there are.  A leaf too large for a task is dealt out in blocks, each
pair of them a group of its own, so no leaf is held whole by one task and none is cut.

Equal vectors are one row with a weight.  A task hands on the leaves in which a row meets another one and stars for each
component, not its pairs.  Links are counted once these are known: rows of a component of up to ``TOGETHER`` rows are
compared once with each other, and a pair counts if it shares a leaf; rows of larger components are compared by the leaves
in which they met, and a pair counts in the first of them.

Edge cases: vectors that are null, zero, empty, or hold null or non-finite components link with nothing; vectors of
another length than most are compared with those of their own length, all with all in blocks; repeated rows are equal
vectors; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, discard, exact_longs, mix, ranges, shuffles_removed, stage, text_buffers
from .graph import components, local_labels

COSINE = 0.9
TREES = 10
LEAF = 96
SPILL = 0.08
SAMPLE = 20_000
SHARE = 2000        # one row in so many is sampled, if that is more
OWN_SAMPLE = 2048   # rows on which a large leaf is split again
DEALT = 16_384      # rows that are always dealt as one unit
UNIT_BYTES = 1 << 24  # of a unit's vectors in single precision
PASS_BYTES = 1 << 27  # of rows that always travel at once
LEAST_SAMPLE = 16   # sampled rows of a node that is still split
LOSS = 0.05         # share of a node's sampled near pairs that a split may part
PROBE = 384         # sampled rows of a node whose near pairs are looked at
CUTS = (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8)
LEVELS = 40
BLOCK = 1024
TOGETHER = 2048     # rows of a component that are compared all with all
MEETING = 4096      # rows of a leaf of those that met there, compared in one piece
AT_ONCE = 2048      # rows of the components or leaves that one group counts, or so
SEED = 2
_OTHER = -1

_VECTOR = "vec_id long, key binary, dim int, vector binary"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each usable vector, its length and the digest of its doubles; the others have null in all three.

    Bytes are singles where these hold the same numbers, doubles otherwise."""
    for batch in batches:
        column = batch.column("embedding")
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        wide = np.asarray(column.flatten().to_numpy(zero_copy_only=False), "<f8") + 0.0  # nulls are NaN; no negative zero
        with np.errstate(over="ignore"):
            narrow = wide.astype("<f4")
        at = np.concatenate(([0], np.cumsum(sizes)))
        holds = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[at])  # noqa: E731  how many of each vector
        usable = (holds(~np.isfinite(wide)) == 0) & (holds(wide != 0) > 0)
        exact = holds(narrow != wide) == 0
        keys, blobs = [None] * len(sizes), [None] * len(sizes)
        for k in np.flatnonzero(usable).tolist():
            a, b = at[k], at[k + 1]
            keys[k] = hashlib.sha256(wide[a:b].tobytes()).digest()
            blobs[k] = (narrow if exact[k] else wide)[a:b].tobytes()
        dims = pa.array(sizes.astype(np.int32), pa.int32(), mask=~usable)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), dims, pa.array(blobs, pa.binary())],
                                         names=["vec_id", "key", "dim", "vector"])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _matrix(column, dim: int) -> np.ndarray:
    """Doubles of vectors of one length."""
    data, at = text_buffers(column)
    sizes = np.diff(at)
    out = np.empty((len(sizes), dim))
    for kind in ("<f4", "<f8"):
        width = int(kind[2]) * dim
        own = np.flatnonzero(sizes == width)
        if len(own) == len(sizes):
            out[:] = data.view(kind).reshape(-1, dim)
        elif len(own):
            out[own] = np.ascontiguousarray(data[at[own][:, None] + np.arange(width)]).view(kind)
    return out


def _quantiles(ordered: np.ndarray, shares: list[float]) -> list[float]:
    """What ``np.quantile`` gives, of sorted values."""
    out = []
    for share in shares:
        place = share * (len(ordered) - 1)
        below = int(place)
        a, b, t = float(ordered[below]), float(ordered[min(below + 1, len(ordered) - 1)]), place - below
        out.append(b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t)
    return out


def _split(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float, float] | None:
    """Lower end of the spill, cut and upper end for the projections of a node's rows, of which (x, y) are near pairs."""
    least, best, ordered = float(len(p)) ** 2, None, np.sort(p)
    near_low, near_high = np.minimum(p[x], p[y]), np.maximum(p[x], p[y])
    for middle in CUTS:
        low, cut, high = _quantiles(ordered, [middle - SPILL, middle, middle + SPILL])
        parted = ((near_low <= low) & (near_high >= high)).sum() > LOSS * len(x)
        if parted:
            apart = np.maximum(np.minimum(near_high - cut, cut - near_low), 0)
            reach = np.nextafter(np.quantile(apart, 1 - LOSS, method="higher"), np.inf)
            low, high = min(low, cut - reach), max(high, cut + reach)
        left, right = _sides(p, low, cut, high)
        cost = float(np.count_nonzero(left)) ** 2 + float(np.count_nonzero(right)) ** 2
        if cost < least:
            least, best = cost, (low, cut, high)
        if not parted and middle == CUTS[0]:
            break
    return best


def _sides(p: np.ndarray, low: float, cut: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    return (p <= cut) | (p < high), (p > cut) | (p > low)


def _near(x: np.ndarray, cosine: float, cut: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (a < b) that reach the cosine, strip by strip; with a ``cut``, of a row before it and one behind.

    Products in single precision choose the pairs that are told apart in double precision."""
    narrow, doubt = x.astype(np.float32), (x.shape[1] + 8) * 2.0 ** -22
    step = max(16, (1 << 20) // max(1, len(x)))
    for start in range(0, cut or len(x), step):
        stop = min(start + step, cut or len(x))
        first = cut or start
        product = narrow[start:stop] @ narrow[first:].T
        if not cut:
            np.fill_diagonal(product, -2)
        near = product >= cosine - doubt
        rows = np.flatnonzero(near.any(1))
        if not len(rows):
            continue
        a, b = np.nonzero(near[rows])
        a = rows[a]
        sure = product[a, b] >= cosine + doubt
        a, b = a + start, b + first
        open_ = np.flatnonzero(~sure)
        sure[open_] = np.einsum("ij,ij->i", x[a[open_]], x[b[open_]]) >= cosine
        sure &= a < b
        yield a[sure], b[sure]


def _grow(sample: np.ndarray, rows: int, rng: np.random.Generator, cosine: float, root: int = 0) -> tuple[list[dict[int, tuple]], list[int]]:
    """Splits by level of the tree below a node, and the leaves that more sampled rows would not split."""
    levels, closed, members = [], [], {root: (np.arange(len(sample)), None)}
    depth = (root + 1).bit_length() - 1
    while members:
        splits, below = {}, {}
        for node, (at, near) in members.items():
            if len(at) * rows <= LEAF * len(sample) or depth + len(levels) >= LEVELS:
                closed.append(node)
                continue
            if len(at) < LEAST_SAMPLE:
                continue
            direction = rng.standard_normal(sample.shape[1])
            p = sample[at] @ direction
            if near is None:
                near = next(_near(sample[at[:PROBE]], cosine), (np.empty(0, np.int64),) * 2)  # one strip; the sample is in hash order
            x, y = near
            split = _split(p, x, y)
            if split is None:
                closed.append(node)
                continue
            splits[node] = (direction, *split)
            left = p <= split[1]
            for child, side in ((2 * node + 1, left), (2 * node + 2, ~left)):
                inner = None
                if len(at) <= PROBE:  # all pairs of the node are known, and so those of its children
                    both, place = side[x] & side[y], np.cumsum(side) - 1
                    inner = place[x[both]], place[y[both]]
                below[child] = at[side], inner
        if not splits:
            break
        levels.append(splits)
        members = below
    return levels, closed


def fit_forest(sample: np.ndarray, rows: int, trees: int = TREES, cosine: float = COSINE,
               closed: list[tuple[int, int]] | None = None) -> list[list[dict[int, tuple]]]:
    """For each tree and level, the split of each node: direction, lower and upper end of the spill, and threshold.

    ``closed`` receives the (tree, leaf) that more sampled rows would not split."""
    rng = np.random.default_rng(SEED)
    forest = []
    for tree in range(trees):
        levels, ended = _grow(sample, rows, rng, cosine)
        forest.append(levels)
        if closed is not None:
            closed += [(tree, leaf) for leaf in ended]
    return forest


def _nodes(levels: list[dict[int, tuple]]) -> dict[int, tuple]:
    return {node: split for splits in levels for node, split in splits.items()}


def _descend(splits: dict[int, tuple], vectors: np.ndarray, root: int = 0, rows: np.ndarray | None = None,
             ends=frozenset(), wanted=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Node, rows and vectors of each leaf below a node, or of each of the nodes ``ends``; ``wanted`` names all nodes to enter."""
    todo = [(root, np.arange(len(vectors)) if rows is None else rows, vectors)]
    while todo:
        node, at, x = todo.pop()
        if not len(at) or wanted is not None and node not in wanted:
            continue
        split = None if node in ends else splits.get(node)
        if split is None:
            yield node, at, x
            continue
        for child, side in zip((2 * node + 1, 2 * node + 2), _sides(x @ split[0], *split[1:])):
            own = np.flatnonzero(side)
            todo.append((child, at[own], x.take(own, axis=0)))


def route(forest, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``(row, tree, leaf)`` of the vectors."""
    out = []
    for tree, levels in enumerate(forest):
        for leaf, row, _ in _descend(_nodes(levels), vectors):
            out.append((row, np.full(len(row), tree), np.full(len(row), leaf, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _units(splits: dict[int, tuple], sample: np.ndarray, rows: int, most: int) -> dict[int, int]:
    """The nodes of a tree that are dealt to tasks, with the rows to be expected: the first of ``most`` rows or fewer on
    each way down, or its end."""
    units, todo = {}, [(0, sample)]
    while todo:
        node, x = todo.pop()
        size = -(-len(x) * rows // len(sample))
        if size <= most or node not in splits:
            units[node] = size
            continue
        for child, side in zip((2 * node + 1, 2 * node + 2), _sides(x @ splits[node][0], *splits[node][1:])):
            todo.append((child, x[side]))
    return units


def _passes(units: dict[tuple[int, int], tuple[int, int]], most: int) -> list[dict[tuple[int, int], tuple[int, list[int]]]]:
    """Units, each with its blocks and those of them whose pairs with themselves and later ones are due, by pass of about
    ``most`` rows.  ``units``: rows and blocks of each."""
    passes, filled = [{}], 0
    for unit_, (rows, blocks) in sorted(units.items()):
        for i in range(blocks):
            size = rows if blocks == 1 else 2 * (blocks - i) * rows // blocks
            if filled and filled + size > most:
                passes.append({})
                filled = 0
            passes[-1].setdefault(unit_, (blocks, []))[1].append(i)
            filled += size
    return passes


_ROUTED = "tree int, leaf long, blocks int, i int, j int, rid long, vec_id long, vector binary"


def _block(rid: np.ndarray, blocks) -> np.ndarray:
    return (mix(rid.astype(U)) % np.asarray(blocks).astype(U)).astype(np.int64)


def _routing(shared, dim: int, due: dict[tuple[int, int], tuple[int, list[int]]], ends: dict[int, frozenset]):
    """Rows for each of the units that are due."""
    wanted = defaultdict(set)
    for tree, node in due:
        while tree >= 0 and node not in wanted[tree]:
            wanted[tree].add(node)
            node = (node - 1) // 2 if node else 0

    def dealt(batch: pa.RecordBatch, tree: int, node: int, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        blocks, firsts = due[tree, node]
        block = _block(exact_longs(batch.column("rid"))[at], blocks)
        for i in firsts:
            for j in range(i, blocks) if blocks > 1 else (0,):
                own = at[(block == i) | (block == j)] if blocks > 1 else at
                if len(own):
                    rows, n = batch.take(pa.array(own)), len(own)
                    same = [pa.array(np.full(n, v), kind) for v, kind in ((tree, pa.int32()), (node, pa.int64()), (blocks, pa.int32()), (i, pa.int32()), (j, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, rows.column("rid"), pa.array(exact_longs(rows.column("vec_id"))), rows.column("vector")],
                                                     names=["tree", "leaf", "blocks", "i", "j", "rid", "vec_id", "vector"])

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value[0] if any(wanted.values()) else []
        for batch in batches:
            dims, parts, held = exact_longs(batch.column("dim")), [], 0
            usual = np.flatnonzero(dims == dim)
            ways = []
            if len(usual) and any(wanted.values()):
                x = unit(_matrix(batch.column("vector").take(pa.array(usual)), dim))
                ways = ((tree, node, usual[at]) for tree in sorted(wanted) if tree >= 0
                        for node, at, _ in _descend(forest[tree], x, ends=ends[tree], wanted=wanted[tree]))
            others = ((_OTHER, 8 * d, np.flatnonzero(dims == d)) for d in np.unique(dims[dims != dim]).tolist())
            for way in (ways, others):
                for tree, node, at in way:
                    for part in dealt(batch, tree, node, at) if (tree, node) in due else ():
                        parts.append(part)
                        held += part.num_rows
                        if held >= 16_384:
                            yield joined(parts)
                            parts, held = [], 0
            if parts:
                yield joined(parts)

    return run


def _linked(x: np.ndarray, cosine: float, cut: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row reaches the cosine with another one, and the least row that it is linked with over any number of
    pairs.  With a ``cut``, rows before it are compared with the others only."""
    met, label = np.zeros(len(x), bool), np.arange(len(x))
    for a, b in _near(x, cosine, cut):
        met[a] = met[b] = True
        a, b = label[a], label[b]
        apart = a != b
        if apart.any():
            label = local_labels(a[apart], b[apart], len(x))[label]
    return met, label


def xxhash64(longs: np.ndarray, last: int) -> np.ndarray:
    """Spark's ``xxhash64`` of a column of longs and an int."""
    p1, p2, p3, p4, p5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << U(k)) | (v >> U(64 - k))

    def finish(v):
        v = (v ^ (v >> U(33))) * p2
        v = (v ^ (v >> U(29))) * p3
        return v ^ (v >> U(32))

    with np.errstate(over="ignore"):
        v = np.full(len(longs), U(42) + p5 + U(8))
        v = finish(turn(v ^ turn(longs.view(U) * p2, 31) * p1, 27) * p1 + p4)
        v = v + p5 + U(4)
        return finish(turn(v ^ U(last & 0xFFFFFFFF) * p1, 23) * p2 + p3).view(np.int64)


def _leaves(splits: dict[int, tuple], closed: set[int], tree: int, node: int, x: np.ndarray, ids: np.ndarray, cosine: float,
            block: int, own_sample: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The leaves of a tree below a node that has the rows ``x``; those of more than ``block`` rows are split on samples of their own."""
    closed, draws = set(closed), xxhash64(ids, tree)

    def split(leaf: int, at: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        chosen = np.flatnonzero(draws[at] % len(at) < own_sample) if len(at) > block and leaf not in closed else []
        if not len(chosen):
            yield leaf, at, own
            return
        chosen = chosen[np.argsort(ids[at[chosen]], kind="stable")]
        chosen = chosen[np.random.default_rng([SEED, tree, leaf]).permutation(len(chosen))]  # reruns agree
        levels, ended = _grow(own[chosen], len(at), np.random.default_rng([SEED, leaf, tree]), cosine, leaf)
        closed.update(ended if levels else [leaf])
        for part in _descend(_nodes(levels), own, leaf, at):
            yield from split(*part)

    for whole in _descend(splits, x, node):
        yield from split(*whole)


_MET = "tree int, leaf long, pieces int, rid long, vec_id long, root long"


def _meet(shared, dim: int, most: int, cosine: float, block: int, own_sample: int):
    """Of a unit, or two blocks of it, the rows that reach the cosine with another one in a leaf."""
    def run(table: pa.Table) -> pa.Table:
        tree, node, blocks, i, j = (table.column(c)[0].as_py() for c in ("tree", "leaf", "blocks", "i", "j"))
        ids, rid = exact_longs(table.column("vec_id")), exact_longs(table.column("rid"))
        x = unit(_matrix(table.column("vector"), dim if tree >= 0 else node // 8))
        found: list[tuple] = []

        def add(leaf: int, at: np.ndarray, met: np.ndarray, label: np.ndarray, pieces: int) -> None:
            own = np.flatnonzero(met)
            if len(own):
                found.append((np.full(len(own), leaf), np.full(len(own), pieces or -(-len(own) // MEETING)), rid[at[own]], ids[at[own]], ids[at[label[own]]]))

        if blocks > 1 or tree < 0:
            side = _block(rid, blocks)
            at = np.argsort(side, kind="stable")
            cut = 0 if i == j else int((side == i).sum())
            if i == j or 0 < cut < len(x):
                add(node, at, *_linked(x[at], cosine, cut), blocks * -(-most // MEETING) if blocks > 1 else 0)
        else:
            splits, closed = shared.value
            for leaf, at, own in _leaves(splits[tree], closed[tree], tree, node, x, ids, cosine, block, own_sample):
                add(leaf, at, *_linked(own, cosine), 0)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 5
        leaf, pieces, rid, ids, root = columns
        return pa.table({"tree": pa.array(np.full(len(leaf), tree), pa.int32()), "leaf": pa.array(leaf, pa.int64()), "pieces": pa.array(pieces, pa.int32()),
                         "rid": rid, "vec_id": ids, "root": root})

    return run


def _split_again(routed: DataFrame, below: tuple, cosine: float) -> DataFrame:
    """Splits units down to their leaves, those of more than ``BLOCK`` rows on samples of their own until each is smaller or
    closed, and compares: the rows of each leaf that meet there."""
    shared, dim, most = below
    return routed.groupBy("tree", "leaf", "blocks", "i", "j").applyInArrow(_meet(shared, dim, most, cosine, BLOCK, OWN_SAMPLE), _MET)


def _pad(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists of codes as rows of one width."""
    sizes = np.diff(at)
    out = np.full((len(sizes), int(sizes.max(initial=0))), np.iinfo(np.int64).min)
    out[np.arange(out.shape[1]) < sizes[:, None]] = codes
    return out


def _first_meeting(here: int, leaves: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs (a, b), those that share no leaf before this one."""
    fresh = np.ones(len(a), bool)
    for k in range(leaves.shape[1]):
        mine = leaves[a, k]
        early = (mine < here) & (mine != np.iinfo(np.int64).min) & fresh
        at = np.flatnonzero(early)
        if len(at):
            fresh[at] = ~(leaves[b[at]] == mine[at][:, None]).any(1)
    return fresh


_LINKED = "rid long, vec_id long, weight long, dim int, leaves array<long>, pieces array<int>, component long, vector binary"
_SET = "bucket long, place long, i int, j int, vec_id long, rid long, pieces int, weight long, dim int, leaves array<long>, vector binary"


def _meetings(passes: int, number: int, buckets: int):
    """A row for each leaf in which a row met others, or each pair of its pieces, of those that a pass counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                lists, rid = batch.column("leaves"), exact_longs(batch.column("rid"))
                leaf, pieces = exact_longs(lists.flatten()), exact_longs(batch.column("pieces").flatten())
                at = np.repeat(np.arange(batch.num_rows), exact_longs(pc.list_value_length(lists)))
                other = ranges(np.zeros(len(pieces), np.int64), pieces)
                at, leaf, pieces = (np.repeat(v, pieces) for v in (at, leaf, pieces))
                own = _block(rid[at], pieces)
                i, j = np.minimum(own, other), np.maximum(own, other)
                hashed = mix(mix(mix(leaf.astype(U)) + i.astype(U)) + j.astype(U))
                due = np.flatnonzero(hashed % U(passes) == U(number))
                bucket = (hashed // U(passes) % U(buckets)).astype(np.int64)
                rows = batch.take(pa.array(at[due]))
                columns = {"bucket": bucket[due], "place": leaf[due], "i": pa.array(i[due], pa.int32()), "j": pa.array(j[due], pa.int32()), "pieces": pa.array(pieces[due], pa.int32())}
                columns |= {c: rows.column(c) for c in ("vec_id", "rid", "weight", "dim", "leaves", "vector")}
                yield pa.RecordBatch.from_pydict({c.split()[0]: columns[c.split()[0]] for c in _SET.split(", ")})
    return run


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _count(cosine: float, by_leaf: bool):
    """Links of the rows of leaves, counted in the first leaf that a pair shares, or of components, if it shares one."""
    def run(table: pa.Table) -> pa.Table:
        place, i, j, dim, rid, ids, weights, pieces = (exact_longs(table.column(c)) for c in ("place", "i", "j", "dim", "rid", "vec_id", "weight", "pieces"))
        order = np.lexsort((rid, dim, j, i, place))
        starts = np.flatnonzero(_fresh(*(c[order] for c in (place, i, j, dim))))
        lists, blobs, links = table.column("leaves").combine_chunks(), table.column("vector").combine_chunks(), np.zeros(len(order))
        for at in np.split(order, starts[1:]):
            if len(at) < 2:
                continue
            vectors, own = unit(_matrix(blobs.take(pa.array(at)), int(dim[at[0]]))), lists.take(pa.array(at))
            leaves = _pad(exact_longs(own.flatten()), np.concatenate(([0], np.cumsum(exact_longs(pc.list_value_length(own))))))
            low, high = i[at[0]], j[at[0]]
            block = _block(rid[at], pieces[at])
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            for start in range(0, len(left), 128):  # a strip of the comparison at a time
                rows = left[start: start + 128]
                x, y = np.nonzero(vectors[rows] @ vectors[right].T >= cosine)
                x, y = rows[x], right[y]
                keep = x < y if low == high else x != y
                x, y = x[keep], y[keep]
                for k in range(0, len(x), 16_384):
                    a, b = x[k: k + 16_384], y[k: k + 16_384]
                    counts = _first_meeting(place[at[0]], leaves, a, b) if by_leaf else ~_first_meeting(np.iinfo(np.int64).max, leaves, a, b)
                    a, b = a[counts], b[counts]
                    links[at] += np.bincount(a, weights[at[b]], len(at)) + np.bincount(b, weights[at[a]], len(at))
        found = np.flatnonzero(links > 0)
        return pa.table({"vec_id": ids[found], "links": links[found].astype(np.int64)})

    return run


_LINKS = "vec_id long, links long"


def _gathered(met: DataFrame, groups: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows that met others, with the leaves in which they did and their component."""
    code = F.shiftleft(F.col("tree").cast("long"), 48).bitwiseOR(F.col("leaf"))
    leaves = met.groupBy("rid").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_set(F.struct(code.alias("code"), "pieces"))).alias("leaves"))
    leaves = leaves.join(groups, F.col("vec_id") == F.col("node"), "left")
    return stage(leaves.join(reps.select("rid", "weight", "dim", "vector"), "rid").select(
        "rid", "vec_id", "weight", "dim", F.col("leaves.code").alias("leaves"), F.col("leaves.pieces").alias("pieces"),
        F.coalesce("component", "vec_id").alias("component"), "vector"), "vectors-linked")


def _links(linked: DataFrame, size: int, cosine: float) -> DataFrame:
    """The weight that each row links with; ``linked`` goes.

    A pass over leaves sends about as much as ``size``, the bytes of all vectors, or ``PASS_BYTES``."""
    sizes = stage(linked.groupBy("component").agg(F.count("*").alias("members")), "vectors-component-sizes")
    n = sizes.where(F.col("members") <= TOGETHER).agg(F.sum("members")).first()[0] or 0
    large = sizes.where(F.col("members") > TOGETHER).select("component")
    bucket = F.pmod(F.xxhash64("component"), F.lit(-(-n // AT_ONCE) or 1))
    small = linked.join(large, "component", "left_anti").select(bucket.alias("bucket"), F.col("component").alias("place"), F.lit(0).alias("i"),
        F.lit(0).alias("j"), "vec_id", "rid", F.lit(1).alias("pieces"), "weight", "dim", "leaves", "vector")
    parts = [stage(small.groupBy("bucket").applyInArrow(_count(cosine, False), _LINKS), "vectors-links")]
    rest = stage(linked.join(large, "component", "left_semi"), "vectors-linked-large")
    discard(linked)
    groups = F.expr("aggregate(pieces, 0L, (s, x) -> s + x)")
    rows, sent = rest.agg(F.sum(groups), F.sum(groups * (F.length("vector") + 8 * F.size("leaves") + 64))).first()
    passes = -(-(sent or 0) // max(size, PASS_BYTES))
    for number in range(passes):
        sets = rest.mapInArrow(_meetings(passes, number, -(-rows // (passes * AT_ONCE))), _SET)
        parts.append(stage(sets.groupBy("bucket").applyInArrow(_count(cosine, True), _LINKS), "vectors-links"))
    discard(rest)
    return reduce(DataFrame.unionByName, parts).groupBy("vec_id").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector: links at ``cosine`` or more, found by the forest."""
    with shuffles_removed(vectors.sparkSession):
        return _near_duplicate_vectors(vectors, cosine, trees)


def _near_duplicate_vectors(vectors: DataFrame, cosine: float, trees: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    read = stage(rows.mapInArrow(_vectors, _VECTOR), "vectors")
    distinct = read.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    reps = stage(distinct.withColumn("rid", F.monotonically_increasing_id()), "vectors-distinct")
    rows = stage(read.select("vec_id", "key"), "vectors-keys")
    discard(read)
    dims = reps.groupBy("dim").agg(F.count("*").alias("rows"), F.sum(F.length("vector")).alias("bytes")).collect()  # a row for each length
    n, size = sum(r["rows"] for r in dims), sum(r["bytes"] for r in dims)
    sample = _sample(reps, n)
    dim = Counter(d for d, _ in sample).most_common(1)[0][0] if sample else 0
    usual = _matrix(pa.array([v for d, v in sample if d == dim], pa.binary()), dim) if sample else np.empty((0, 0))
    closed: list[tuple[int, int]] = []
    most = max(2 * BLOCK, UNIT_BYTES // (4 * max(dim, 1)))
    units = {(_OTHER, 8 * r["dim"]): (r["rows"], -(-r["rows"] // most)) for r in dims if r["dim"] != dim and r["rows"] > 1}
    forest, ends = [], {}
    if len(usual):
        usual = unit(usual)
        forest = [_nodes(levels) for levels in fit_forest(usual, n, trees, cosine, closed)]
        for tree, splits in enumerate(forest):
            whole = set(closed)
            found = _units(splits, usual, n, min(most, max(DEALT, n // 8)))
            ends[tree] = frozenset(found)
            units |= {(tree, node): (k, -(-k // most) if (tree, node) in whole and k > 2 * most else 1) for node, k in found.items()}
    shared = spark.sparkContext.broadcast((forest, [{leaf for t, leaf in closed if t == tree} for tree in range(trees)]))
    parts = []
    for due in _passes(units, max(2 * n, PASS_BYTES // (4 * max(dim, 1)))):
        groups = sum(blocks - i if blocks > 1 else 1 for blocks, firsts in due.values() for i in firsts)
        routed = reps.mapInArrow(_routing(shared, dim, due, ends), _ROUTED).repartition(max(1, 2 * groups), "tree", "leaf", "blocks", "i", "j")
        parts.append(stage(_split_again(routed, (shared, dim, most), cosine), "vectors-met"))
    met = reduce(DataFrame.unionByName, parts)
    groups = components(met.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), "vector-components")
    linked = _gathered(met, groups, reps)
    for part in parts:
        discard(part)
    links = _links(linked, size, cosine)
    known = reps.select("key", "vec_id", "weight").join(links, "vec_id", "left").join(groups, F.col("vec_id") == F.col("node"), "left")
    known = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    known = stage(known, "vectors-known")
    discard(reps)
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _sample(reps: DataFrame, n: int) -> list[tuple[int, bytes]]:
    """Length and bytes of the rows with the lowest hashes."""
    size, hashed = max(SAMPLE, n // SHARE), F.xxhash64("key")
    low = reps.where(hashed < int(-2 ** 63 + 1.5 * size / n * 2 ** 64)) if n > 4 * size else reps
    for rows in (low, reps):
        found = rows.orderBy(hashed, "vec_id").select("dim", "vector").limit(size).collect()
        if len(found) == min(n, size):
            break
    return [(r["dim"], bytes(r["vector"])) for r in found]
