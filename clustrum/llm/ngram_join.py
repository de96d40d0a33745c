"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the components of its links.

A set of s shingles that is similar enough to another one shares at least T = ceil(0.75 s) of them. The inverted lists
are made in hash buckets, which tell each class of equal sets which of its shingles stand in another class too, and in
how many. Two linked classes both have their rarest common shingle among their s - T + 1 rarest ones (Chaudhuri et al.
2006), so classes that share none of those can't be linked, nor can a class of which fewer than T shingles stand
anywhere else. What is left falls into groups that are connected by such rare shingles. Each group, or block of a large
group, has its inverted index in one task, and every class is searched in it by DivideSkip (Li, Lu and Lu 2008): the L
longest of its lists are set aside, L = T / (MU log2 M + 1) for a longest list of M; the short ones are merged by a
heap, which skips to the first id that can still stand on T - L of them; and the long ones are probed by binary search
for the ids that do, until the required overlap is reached or out of reach.

Links are needed as components only. So a class that is linked with an earlier one isn't put in the index at first,
and afterwards the classes outside a group's largest component are searched among all of the group. A group too large
for one task is cut into blocks that share a few of its classes, and the classes left outside its largest component
visit all blocks. No link between different components is lost.

Shingles are known by 64 bits of a hash: two different ones of a pair of sets of 500 meet once in 10**13 pairs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit
from .components import components
from .shared import cut, drop, pack, read_table, ship, spare, unpack, worker_tables

WIDTH, PERCENT = 5, 75
#: Shingles known as frequent beforehand, at most (12 bytes each, broadcast). They come last in the order of rarity and
#: get no list in the buckets, so no bucket holds a list of a large share of all classes.
HOT_SHINGLES = 1 << 18
#: A task reports a shingle as frequent from this many sets among WINDOW shingles.
HOT_FROM, WINDOW = 4, 1_000_000
#: Postings that a task deals to the buckets at once; postings of a list bucket and of a class bucket on average.
CHUNK, BUCKET, CLASS_BUCKET = 2_000_000, 1_000_000, 4_000_000
#: Shingles of a search task on average; search tasks, at least; classes of a large group that all its blocks hold.
BLOCK, BLOCKS, HUBS = 500_000, 32, 8
#: Members of one rare list in one batch from which they are dealt over other buckets, with one of them in the list's own.
LOCAL_HOT = 64
#: The weight of a probe against a step of the merge in the choice of L.
MU = 0.005

_SCANNED = "doc_id long, t long, n long, d1 long, d2 long, h long, c long"
_DEALT = "key long, kind int, blob binary"
_ACTIVE = "x long, n long, w long, central double, rare binary, shingles binary"


def needed(n, percent: int):
    """Shingles of a set of n that a similar set shares at least."""
    return (percent * n + 99) // 100


def overlap_needed(n, m, percent: int):
    """Common shingles of linked sets of n and m: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def _joined(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True)]


def _rank(count: np.ndarray) -> np.ndarray:
    """0, 1, .. within runs of these lengths."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(sorted_keys)])


def _digest(s: np.ndarray, seed: int) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(2, "little")).digest()


def _scanned(batches: Iterator[pa.RecordBatch], width: int, seed: int, window_size: int, hot_from: int) -> Iterator[pa.RecordBatch]:
    """A row for each text, with the size and the digest of its set, and one for each shingle that is frequent in a window."""
    worker_tables("shingles")
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "t", "n", "d1", "d2", "h", "c")])
    window, size, seen = [], 0, set()

    def rows(names, arrays):
        given = dict(zip(names, arrays, strict=True))
        n = len(arrays[0])
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, pa.int64())) for f in schema], schema=schema)

    def frequent():
        keys, counts = np.unique(np.concatenate(window), return_counts=True)
        many = counts >= hot_from
        return rows(("h", "c"), (pa.array(keys[many].view(np.int64)), pa.array(counts[many].astype(np.int64))))

    for batch in batches:
        out = []
        for _, s in textkit.shingle_rows(batch.column(1), width):
            digest = _digest(s, seed)
            out.append((len(s), digest))
            if len(s) and digest not in seen:
                seen.add(digest)
                window.append(s)
                size += len(s)
            if size >= window_size:
                yield frequent()
                window, size, seen = [], 0, set()
        two = np.frombuffer(b"".join(x[1] for x in out), np.int64).reshape(-1, 2)
        yield rows(("doc_id", "t", "n", "d1", "d2"), (batch.column(0), batch.column(2), pa.array([x[0] for x in out], pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1])))
    if window:
        yield frequent()


def _deal(batches: Iterator[pa.RecordBatch], hot, width: int, seed: int, buckets: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Lists: the shingles of each class that aren't frequent, with the class; records: its size and its frequent ones."""
    worker_tables("shingles")
    keys, counts = hot.value

    def flush():
        n = np.array([len(s) for s in sets])
        h, x = np.concatenate(sets), np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)[:, 0].copy()
        row = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        n_hot, places = np.zeros(len(n), np.int32), np.zeros(0, np.int32)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            met = keys[at] == h
            places, owner = at[met].astype(np.int32), row[met]
            places = places[np.lexsort((places, counts[places], owner))]
            n_hot = np.bincount(owner, minlength=len(n)).astype(np.int32)
            h, row = h[~met], row[~met]
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        # the buckets are ranges of the hash, so a bucket's postings are a run of the sorted ones
        edges = np.searchsorted(h, np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64))
        edges = np.r_[0, edges, len(h)]
        out = [(0, 1, pack(x, n.astype(np.int32), n_hot, places))]
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[b], edges[b + 1])
            members, local = np.unique(row[own], return_inverse=True)
            small = np.uint16 if len(members) < 1 << 16 else np.uint32
            out.append((b, 0, pack(np.diff(h[own], prepend=np.uint64(0)), local.astype(small), x[members])))
        out[0] = (int(textkit.mix(x[:1].view(np.uint64))[0] % np.uint64(buckets)), *out[0][1:])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["key", "kind", "blob"])

    sets, names, size, seen = [], [], 0, set()
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        for _, s in textkit.shingle_rows(batch.column(1), width):
            digest = _digest(s, seed)
            if not len(s) or digest in seen:
                continue
            seen.add(digest)
            sets.append(s)
            names.append(digest)
            size += len(s)
            if size >= chunk:
                yield flush()
                sets, names, size, seen = [], [], 0, set()
    if sets:
        yield flush()


def _by_key(key: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.argsort(key, kind="stable")
    starts, lengths = _runs(key[order])
    return [(int(key[order[a]]), kind, pack(*(v[order[a : a + m]] for v in arrays))) for a, m in zip(starts.tolist(), lengths.tolist(), strict=True)]


def _class_key(x: np.ndarray, n: int) -> np.ndarray:
    return (textkit.mix(x.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _count_lists(table: pa.Table, class_buckets: int) -> pa.Table:
    """The postings of a bucket that stand on lists of two or more classes, with the lists' lengths, for the classes' buckets."""
    kind, blobs = table.column("kind").to_numpy(), table.column("blob").to_pylist()
    out = []
    for i in np.flatnonzero(kind == 1).tolist():
        x, n, n_hot, places = unpack(blobs[i])
        key = _class_key(x, class_buckets)
        owner = np.repeat(key, n_hot)
        for k in np.unique(key).tolist():
            own = key == k
            out.append((k, 1, pack(x[own], n[own], n_hot[own], places[owner == k])))
    lists = [unpack(blobs[i]) for i in np.flatnonzero(kind == 0).tolist()]
    if lists:
        h = np.concatenate([np.cumsum(d) for d, _, _ in lists])
        x = np.concatenate([members[local] for _, local, members in lists])
        order = np.argsort(h, kind="stable")
        h, x = h[order], x[order]
        alone = np.r_[True, h[1:] != h[:-1]] & np.r_[h[1:] != h[:-1], True]
        h, x = h[~alone], x[~alone]
        order = np.lexsort((x, h))
        h, x = h[order], x[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])] if len(h) else np.zeros(0, bool)  # one posting of a class on a list
        h, x = h[fresh], x[fresh]
        _, length = _runs(h)
        length = np.repeat(length, length)
        h, x, length = h[length > 1], x[length > 1], length[length > 1].astype(np.uint32)
        order = np.argsort(x, kind="stable")
        h, x, length = h[order], x[order], length[order]
        starts, count = _runs(x)
        key, names = _class_key(x[starts], class_buckets), x[starts]
        whole = np.repeat(key, count)
        order = np.argsort(whole, kind="stable")
        h, length = h[order], length[order]
        order = np.argsort(key, kind="stable")
        key, names, count = key[order], names[order], count[order].astype(np.int32)
        ends = np.cumsum(count)
        begin = 0
        for a, m in zip(*(v.tolist() for v in _runs(key)), strict=True):
            end = int(ends[a + m - 1])
            out.append((int(key[a]), 0, pack(names[a : a + m], count[a : a + m], h[begin:end], length[begin:end])))
            begin = end
    return pa.table({"key": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int32()), "blob": pa.array([r[2] for r in out], pa.binary())})


def _candidates(table: pa.Table, hot, percent: int) -> pa.Table:
    """The classes of a bucket that can be linked: their shared shingles, and which of them are among their rarest."""
    worker_tables("shingles")
    keys, counts = hot.value
    kind, blobs = table.column("kind").to_numpy(), table.column("blob").to_pylist()
    x, n, n_hot, places = _joined([blobs[i] for i in np.flatnonzero(kind == 1).tolist()])
    owner = np.repeat(np.arange(len(x)), n_hot)
    names, first = np.unique(x, return_index=True)  # a class is met once in each of several tasks
    at_first = np.zeros(len(x), bool)
    at_first[first] = True
    hot_class, places = np.searchsorted(names, x[owner[at_first[owner]]]), places[at_first[owner]]
    n, n_hot = n[first].astype(np.int64), n_hot[first].astype(np.int64)
    replies = [blobs[i] for i in np.flatnonzero(kind == 0).tolist()]
    rx, count, h, length = _joined(replies) if replies else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    cls = np.searchsorted(names, np.repeat(rx, count))
    shared = np.bincount(cls, minlength=len(names)) + n_hot
    able = shared >= needed(n, percent)
    h, length, cls = h[able[cls]], length[able[cls]].astype(np.int64), cls[able[cls]]
    places, hot_class = places[able[hot_class]], hot_class[able[hot_class]]
    # frequent shingles come last, whatever their number
    h, length, cls = np.r_[h, keys[places]], np.r_[length, counts[places].astype(np.int64) + (1 << 40)], np.r_[cls, hot_class]
    order = np.lexsort((h, length, cls))
    h, length, cls = h[order], length[order], cls[order]
    starts, size = _runs(cls)
    owners = cls[starts]
    alone = n[owners] - size
    rare = _rank(size) < np.repeat(n[owners] - needed(n[owners], percent) + 1 - alone, size)
    worth = np.add.reduceat((length & ((1 << 40) - 1)).astype(np.float64), starts) / n[owners] if len(starts) else np.zeros(0)
    out = {k: [] for k in ("x", "n", "w", "central", "rare", "shingles")}
    for i, (a, m) in enumerate(zip(starts.tolist(), size.tolist(), strict=True)):
        own = h[a : a + m]
        some = own[rare[a : a + m]]
        if len(some):
            c = owners[i]
            for k, v in zip(out, (int(names[c]), int(n[c]), m, float(worth[i]), some.tobytes(), own.tobytes()), strict=True):
                out[k].append(v)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})


def _rare_lists(batches: Iterator[pa.RecordBatch], buckets: int, local_hot: int) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of the classes, dealt by shingle. Of many members of one list in a batch one stands for all."""
    for batch in batches:
        x, lists = batch.column(0).to_numpy(zero_copy_only=False), [np.frombuffer(b, np.uint64) for b in batch.column(1).to_pylist()]
        if not len(x):
            continue
        h, x = np.concatenate(lists), np.repeat(x, [len(v) for v in lists])
        order = np.argsort(h, kind="stable")
        h, x = h[order], x[order]
        starts, length = _runs(h)
        salt, extra = np.zeros(len(h), np.uint64), []
        for a, m in zip(starts[length >= local_hot].tolist(), length[length >= local_hot].tolist(), strict=True):
            salt[a : a + m] = textkit.mix(x[a : a + 1].view(np.uint64)) | np.uint64(1)
            extra.append(a)
        h = np.r_[h ^ salt, h[extra]] if extra else h
        x = np.r_[x, x[extra]] if extra else x
        out = _by_key((textkit.mix(h) % np.uint64(buckets)).astype(np.int64), 0, h, x)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["key", "kind", "blob"])


def _connected(table: pa.Table) -> pa.Table:
    """The classes of a bucket's lists, each with the smallest one that the lists connect it with."""
    h, x = _joined(table.column("blob").to_pylist())
    names, at = np.unique(x, return_inverse=True)
    order = np.argsort(h, kind="stable")
    starts, length = _runs(h[order])
    at = at[order]
    head = np.repeat(at[starts], length)
    low = np.arange(len(names))
    while not np.array_equal(low[head], low[at]):
        a, b = low[head], low[at]
        least = np.minimum(a, b)
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        while not np.array_equal(low, after := low[low]):
            low = after
    moved = low != np.arange(len(names))
    return pa.table({"u": pa.array(names[low[moved]], pa.int64()), "v": pa.array(names[moved], pa.int64())})


def divide_skip(lists: list[list[int]], least: int, required, skip) -> Iterator[int]:
    """The ids that stand on enough of the sorted lists: on required(id) of them, which is `least` or more.

    Ids for which skip(id) holds when they turn up are left out.
    """
    if len(lists) < least:
        return
    lists = sorted(lists, key=len)
    aside = min(least - 1, int(least / (MU * np.log2(len(lists[-1])) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    enough = least - aside
    heap = [x[0] << 32 | i for i, x in enumerate(short)]  # the id, and the list that it stands on
    heapify(heap)
    at = [0] * len(short)
    while len(heap) >= enough:
        top, popped = heap[0] >> 32, []
        while heap and heap[0] >> 32 == top:
            popped.append(heappop(heap) & 0xFFFFFFFF)
        if len(popped) >= enough:
            if not skip(top):
                found, left, want = len(popped), len(long), required(top)
                for x in long:
                    if found >= want or found + left < want:
                        break
                    left -= 1
                    k = bisect_left(x, top)
                    found += k < len(x) and x[k] == top
                if found >= want:
                    yield top
            onward = top + 1
        else:
            while heap and len(popped) < enough - 1:
                popped.append(heappop(heap) & 0xFFFFFFFF)
            if not heap:
                return
            onward = heap[0] >> 32
        for i in popped:
            x = short[i]
            k = at[i] = bisect_left(x, onward, at[i])
            if k < len(x):
                heappush(heap, x[k] << 32 | i)


class _Block:
    """The classes of one search task with their inverted lists, in the order in which they are searched."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent = percent
        role, central, names = table.column("role").to_numpy(), table.column("central").to_numpy(), table.column("x").to_numpy()
        order = np.lexsort((names, -central, role != 1))
        self.names, self.role = names[order], role[order]
        self.n, self.group = table.column("n").to_numpy()[order].tolist(), table.column("g").to_numpy()[order]
        blobs = table.column("shingles").to_pylist()
        sets = [np.frombuffer(blobs[i], np.uint64) for i in order]
        size = np.array([len(s) for s in sets])
        _, term, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        ends = np.cumsum(size)
        self.terms = [t[count[t] > 1].tolist() for t in np.split(term, ends[:-1])]
        self.lists: list[list[int]] = [[] for _ in range(len(count))]
        _, first, same = np.unique(table.column("known").to_numpy()[order], return_index=True, return_inverse=True)
        self.parent = first[same].tolist()
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)

    def add(self, i: int) -> None:
        for t in self.terms[i]:
            self.lists[t].append(i)

    def search(self, i: int) -> bool:
        """Link i with what the index holds; whether anything was found."""
        least, n, found = needed(self.n[i], self.percent), self.n[i], False
        lists = [x for t in self.terms[i] if (x := self.lists[t])]

        def skip(j: int) -> bool:
            m = self.n[j]
            return self.root(i) == self.root(j) or 100 * min(n, m) < self.percent * max(n, m)

        for j in divide_skip(lists, least, lambda j: overlap_needed(n, self.n[j], self.percent), skip):
            self.links.append((int(self.names[i]), int(self.names[j])))
            self.join(i, j)
            found = True
        return found

    def table(self) -> pa.Table:
        return pa.table({"u": pa.array([u for u, _ in self.links], pa.int64()), "v": pa.array([v for _, v in self.links], pa.int64())})


def _search(table: pa.Table, percent: int) -> pa.Table:
    """Links within a task's groups that connect all that are linked; in a block of a larger group, those of the first pass.

    Roles: 0 member, 1 member that all blocks of its group hold.
    """
    block = _Block(table, percent)
    kept = []
    for i in range(len(block.names)):
        if not block.search(i):
            block.add(i)
            kept.append(i)
    if not table.column("divided")[0].as_py():
        dropped = np.ones(len(block.names), bool)
        dropped[kept] = False
        order = np.argsort(block.group, kind="stable")
        for a, m in zip(*(v.tolist() for v in _runs(block.group[order])), strict=True):
            own = np.sort(order[a : a + m])
            roots = np.array([block.root(i) for i in own.tolist()])
            values, count = np.unique(roots, return_counts=True)
            if len(values) == 1 or not dropped[own].any():
                continue
            for t in {t for i in own.tolist() for t in block.terms[i]}:
                block.lists[t] = []
            for i in own.tolist():
                block.add(i)
            for i in own[roots != values[count.argmax()]].tolist():
                block.search(i)
    return block.table()


def _visit(table: pa.Table, percent: int) -> pa.Table:
    """Links of the visitors (role 2) with a block's members, but for those within a component that is known."""
    block = _Block(table, percent)
    for i in np.flatnonzero(block.role != 2).tolist():
        block.add(i)
    for i in np.flatnonzero(block.role == 2).tolist():
        block.search(i)
    return block.table()


def _links(active: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that connect the linked classes of each of the groups (node, component)."""
    placed = cut(groups.select(F.col("node").alias("x"), F.col("component").alias("g")).join(active.select("x", "w"), "x"), "placed")
    total = placed.agg(F.sum("w")).first()[0] or 0
    tasks = max(BLOCKS, int(total // BLOCK))
    sizes = placed.groupBy("g").agg(F.ceil(F.sum("w") / max(1, int(total // tasks))).cast("long").alias("blocks"))
    cuts = F.col("blocks") > 1
    home = placed.join(sizes, "g").select(
        "x", "g", "blocks", cuts.alias("divided"), F.when(cuts, F.col("g")).otherwise(F.lit(0)).alias("a"),
        F.when(cuts, F.pmod(F.xxhash64("x"), "blocks")).otherwise(F.pmod(F.xxhash64("g"), F.lit(tasks))).alias("b"),
    )
    home = cut(home, "home")
    drop(placed)
    large = home.where("divided")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b")
    hubs = large.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("x"), "x"))).where(F.col("r") <= HUBS)

    def rows(place: DataFrame) -> DataFrame:
        return active.select("x", "n", "central", "shingles").join(place, "x")

    first = home.select("x", "g", "divided", "a", "b", F.lit(0).alias("role"), F.col("x").alias("known"))
    first = first.union(hubs.select("x", "g", "divided", "a", everywhere, F.lit(1), F.col("x")))
    links = cut(rows(first).groupBy("divided", "a", "b").applyInArrow(lambda t: _search(t, percent), "u long, v long"), "links")
    if large.isEmpty():
        return links
    state = large.join(components(links).withColumnRenamed("node", "x"), "x", "left").withColumn("known", F.coalesce("component", "x")).drop("component")
    state = cut(state, "state")
    most = state.groupBy("g", "known").count().groupBy("g").agg(F.max(F.struct("count", "known"))["known"].alias("most"), F.count("*").alias("parts")).where("parts > 1")
    state = state.join(most, "g")
    second = state.select("x", "g", "divided", "a", "b", F.lit(0).alias("role"), "known")
    second = second.union(state.where("known <> most").select("x", "g", "divided", "a", everywhere, F.lit(2), "known"))
    return links.union(rows(second).groupBy("divided", "a", "b").applyInArrow(lambda t: _visit(t, percent), "u long, v long"))


def _scan(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows of _scanned(), the classes (d1, doc, n), and the seed of digests of which 64 bits name each class."""
    for seed in range(1 << 16):
        scanned = cut(docs.mapInArrow(lambda b: _scanned(b, width, seed, WINDOW, HOT_FROM), _SCANNED), "sets")
        classes = scanned.where("n > 0 and doc_id is not null").groupBy("d1")
        classes = cut(classes.agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.min("d2").alias("low"), F.max("d2").alias("high")), "classes")
        if classes.where("low <> high").isEmpty():
            return scanned, classes, seed
        drop(scanned)
        drop(classes)
    raise RuntimeError("the classes can't be named by 64 bits")


def frequent_shingles(scanned: DataFrame, most: int = HOT_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that stand in many sets, and how many; only the order of lists depends on them."""
    top = scanned.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(most).toPandas()
    keys = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["c"].to_numpy(np.int64)[order].astype(np.int32)


def _joined_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of _scanned(), classes of equal sets, links that connect the linked classes) of (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    scanned, classes, seed = _scan(docs, width)
    hot = spark.sparkContext.broadcast(frequent_shingles(scanned))
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets, class_buckets = max(64, int(total // BUCKET)), max(32, int(total // CLASS_BUCKET))
    dealt = docs.select("doc_id", "text").mapInArrow(lambda b: _deal(b, hot, width, seed, buckets, CHUNK), _DEALT)
    shared = dealt.groupBy("key").applyInArrow(lambda t: _count_lists(t, class_buckets), _DEALT)
    active = cut(shared.groupBy("key").applyInArrow(lambda t: _candidates(t, hot, percent), _ACTIVE), "active")
    rare = active.agg(F.sum(F.length("rare")) / 8).first()[0] or 0
    rare_buckets = max(32, int(rare // BUCKET))
    lists = active.select("x", "rare").mapInArrow(lambda b: _rare_lists(b, rare_buckets, LOCAL_HOT), _DEALT)
    groups = cut(components(lists.groupBy("key").applyInArrow(_connected, "u long, v long")), "groups")
    return scanned, classes, _links(active, groups, percent)


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of (doc_id, text): see the module's text.

    A null or empty text has no shingle and is linked with nothing. A row without doc_id takes no part and has no
    component. Rows that repeat a doc_id are one document, which reaches what any of its texts is linked with; those
    that repeat a text are one class. An empty table gives an empty result. Other columns aren't read.
    """
    scanned, classes, links = _joined_classes(docs, width, percent)
    whole = scanned.where("n > 0 and doc_id is not null")
    # the texts of one document
    several = whole.groupBy("doc_id").agg(F.min("d1").alias("u"), F.max("d1").alias("v")).where("u <> v").select("doc_id", "u")
    own = whole.select("doc_id", F.col("d1").alias("v")).join(several, "doc_id").where("u <> v").select("u", "v").distinct()
    found = cut(components(links.select("u", "v").union(own)), "components")

    low = found.join(classes.select(F.col("d1").alias("node"), "doc"), "node").groupBy("component").agg(F.min("doc").alias("component_id"))
    low = found.join(low, "component").select(F.col("node").alias("d1"), "component_id")
    at = cut(classes.join(low, "d1", "left").select("d1", F.coalesce("component_id", "doc").alias("component_id")), "membership")
    # a row of no text may have any digest, but its set is empty
    out = scanned.where("n is not null").select("doc_id", "n", F.when(F.col("n") > 0, F.col("d1")).alias("d1")).join(at, "d1", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that stay if of all texts that links connect one stays.

    Of each group the text of the smallest doc_id stays, and of its texts the first by a hash; repeated rows of that text
    under that doc_id are one. Texts are what is linked here: two different texts under one doc_id are no copies of each
    other. Rows without doc_id, and those without a word, stay.
    """
    scanned, classes, links = _joined_classes(docs, width, percent)
    found = cut(components(links), "components")
    named = scanned.where("n > 0 and doc_id is not null").select("doc_id", "t", "d1")
    named = named.join(found.select(F.col("node").alias("d1"), "component"), "d1", "left").select("doc_id", "t", F.coalesce("component", "d1").alias("g"))
    # a group's rows are aggregated before they are shuffled, and each text's rows are one line from here on
    texts = cut(named.groupBy("g", "doc_id", "t").agg(F.count("*").alias("rows")), "texts")
    first = texts.groupBy("g").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.count("*").alias("texts"))
    state = texts.join(first, "g").where((F.col("texts") > 1) | (F.col("rows") > 1))
    stays = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    id_, hash_, rows, gone = spare(docs.columns, "_id", "_hash", "_rows", "_gone")
    state = cut(state.where(~stays | (F.col("rows") > 1)).select(F.col("doc_id").alias(id_), F.col("t").alias(hash_), (~stays).alias(gone)), "copies")
    key = (docs["doc_id"].cast("long") == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(hash_))
    once = state.where(~F.col(gone))
    kept = docs.join(state, key, "left_anti")
    if once.isEmpty():
        return kept
    repeats = docs.join(once, key).withColumn(rows, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    return kept.unionByName(repeats.groupBy(id_, hash_).agg(F.min_by(rows, F.xxhash64(rows)).alias(rows)).select(f"{rows}.*"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
