"""Matches of `A (D|U)*? P` over the ordered rows of each key, found on run tokens.

A row is D or U by its own predecessor alone, so the letters don't depend on where a match starts: an A can pass through
the rows after it as long as each is D or U (a chain), and ends at the chain's first goal row whose cents reach its own.
Runs of D rows and of U rows are tokens, each with its goal rows and their largest cents. Cents fall along a D token, so
its first goal is its largest; they rise along a U token, so a binary search places P. A start asks the tokens after it
by their summaries, each of which points to the next larger one of its chain, and looks at rows only to place P.

The rows are cut by range into blocks in order (key, time, id), whatever key holds them, and each block is one packed
row. A block needs four things of the others: the row before it, the largest goal ahead of its last chain, the match that
is open where it begins, and how many matches its first key had before. Each is a prefix combination of small summaries.
How the open match passes through a block
is a step function of the open A's cents: a block's first chain ends it at one of its ascending goals, or not at all.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .carries import STATE as _STATE
from .carries import carries
from .shared import cut, pack, read_table, ship, unpack, worker_tables

#: Rows of a block on average, unless the session asks for more partitions.
BLOCK_ROWS = 250_000
GAP_MICROS = 10 * 60 * 1_000_000
#: What a row's kind lets it be: no letter but A, any letter but P, any letter.
BARRED, STEP, GOAL = 0, 1, 2
#: Cents beyond this are no whole numbers of cents in double precision.
CENTS = 2.0**53

_BLOCK = "i long, summary binary, rows binary"


def _last(left, right):
    return right


def _goal_ahead(left, right):
    """(largest goal cents of the rows that go on with the chain, whether that chain goes on past the end)."""
    top, on = left
    if not on:
        return left
    return max((x for x in (top, right[0]) if x is not None), default=None), right[1]


def passed(passing, state):
    """The state after a block: the open match, None for no open match, as the block's step function has it."""
    free, limits, exits = passing
    if state is None:
        return free
    at = bisect_left(limits, state[0])
    return exits[at] if at < len(limits) else state


def _chained(left, right):
    """One step function after the other."""
    free, limits, exits = left
    limits, exits = list(limits), [passed(right, x) for x in exits]
    for limit, exit_ in zip(right[1], right[2], strict=True):
        if not limits or limit > limits[-1]:
            limits.append(limit)
            exits.append(exit_)
    return passed(right, free), limits, exits


def _counted(left, right):
    """(first key, last key, matches of the last key)."""
    return left[0], right[1], right[2] + (left[2] if left[1] == right[1] == right[0] else 0)


class Block:
    """The letters, chains and tokens of a block's rows, given the row before it and the largest goal ahead."""

    def __init__(self, arrays: list[np.ndarray], before, ahead, gap: int):
        self.key, self.ts, self.id, self.no_id, self.cents, valid, code = arrays
        n = self.n = len(self.key)
        valid = valid.astype(bool)
        shift = lambda x, first: np.r_[np.array([first], x.dtype), x[:-1]]
        key0, ts0, cents0, valid0 = before or (0, 0, 0, False)
        last = shift(self.cents, cents0)
        near = (self.key == shift(self.key, key0)) & shift(valid, valid0) & valid
        # differences of times would overflow at the ends of the range
        near &= self.ts.astype(np.float64) - shift(self.ts, ts0).astype(np.float64) <= 2.0 * gap
        near[near] = (self.ts - shift(self.ts, ts0))[near] <= gap
        self.step = near & (code != BARRED) & (self.cents != last)
        self.goal = near & (code == GOAL)
        self.up = self.cents > last
        self.labels = np.where(self.up, ord("U"), ord("D")).astype(np.uint8)
        self.total = np.r_[0, np.cumsum(np.where(valid, self.cents, 0))]
        chain = np.cumsum(~self.step) - (1 if n and not self.step[0] else 0)
        self.chain = chain
        chains = int(chain[-1]) + 1 if n else 0
        heads = np.flatnonzero(~self.step)
        #: The last row of each chain, and the row after it if it is a goal that ends it.
        self.end = np.r_[heads[1:] - 1 if n and not self.step[0] else heads - 1, n - 1] if n else heads
        after = np.minimum(self.end + 1, max(n - 1, 0))
        self.after = np.where((self.end + 1 < n) & self.goal[after], after, -1) if n else heads
        own = np.flatnonzero(self.goal & self.step)
        edge = np.flatnonzero(self.step & np.r_[True, (self.up[1:] != self.up[:-1]) | ~self.step[:-1]])
        token = np.searchsorted(edge, own, "right") - 1
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(own) else own
        ends = np.r_[starts[1:], len(own)] if len(own) else own
        rising = self.up[own[starts]]
        #: Tokens with goals: their goals, the place of their first goal, whether they rise, their largest cents, and the next
        #: token of their chain with larger cents.
        self.goals, self.goal_cents = own.tolist(), self.cents[own].tolist()
        self.token_row = edge[token[starts]].tolist()
        self.token_goals = list(zip(starts.tolist(), ends.tolist(), rising.tolist(), strict=True))
        self.token_top = self.cents[own[np.where(rising, ends - 1, starts)]].tolist() if len(own) else []
        self.token_chain = chain[own[starts]].tolist()
        self.larger, stack = [-1] * len(self.token_row), []
        for t, top in enumerate(self.token_top):
            while stack and (self.token_chain[stack[-1]] != self.token_chain[t] or self.token_top[stack[-1]] < top):
                low = stack.pop()
                if self.token_chain[low] == self.token_chain[t]:
                    self.larger[low] = t
            stack.append(t)
        self.first_token = np.searchsorted(np.array(self.token_row, np.int64), np.arange(n), "right")
        self.ahead = ahead
        # the largest goal after each row in its chain, by ranks of cents
        values = np.unique(np.r_[self.cents[self.goal | valid], [] if ahead is None else [ahead]].astype(np.int64))
        rank = np.full(n + 1, -1)
        rank[own] = np.searchsorted(values, self.cents[own])
        term = np.where(self.after >= 0, np.searchsorted(values, self.cents[np.maximum(self.after, 0)]), -1) if n else heads
        if n and ahead is not None:
            term[-1] = max(term[-1], int(np.searchsorted(values, ahead)))
        base = np.int64(len(values) + 2)
        run = np.maximum.accumulate((rank[1:][::-1] + 1) + base * (chains - np.r_[chain[1:], chain[-1:]][::-1])) if n else rank
        best = run[::-1] - base * (chains - chain) - 1 if n else rank
        best = np.maximum(np.where(best < 0, -1, best), term[chain]) if n else rank
        fits = valid & (best >= np.searchsorted(values, self.cents)) if n else valid
        #: The starts from which a match exists.
        self.starts = np.flatnonzero(fits).tolist()

    def place(self, i: int) -> int:
        """The row of P for a start from which a match exists; n if it lies ahead."""
        want, chain = self.cents[i], self.chain[i]
        t = int(self.first_token[i]) - 1
        if t >= 0 and self.token_chain[t] == chain and self.token_goals[t][2]:
            # within a rising token all goals after i are larger, if i belongs to it
            a, b, _ = self.token_goals[t]
            k = bisect_left(self.goals, i + 1, a, b)
            if k < b:
                return self.goals[k]
        t += 1
        while 0 <= t < len(self.token_row) and self.token_chain[t] == chain:
            if self.token_top[t] >= want:
                a, b, rising = self.token_goals[t]
                return self.goals[bisect_left(self.goal_cents, want, a, b) if rising else a]
            t = self.larger[t]
        j = int(self.after[chain])
        return j if j >= 0 and self.cents[j] >= want else self.n

    def walk(self, s: int) -> Iterator[tuple[int, int]]:
        """(A, P) of the matches of a search that starts at row s."""
        at = bisect_left(self.starts, s)
        while at < len(self.starts):
            i = self.starts[at]
            j = self.place(i)
            yield i, j
            at = bisect_left(self.starts, j + 1, at)

    def ladder(self) -> list[tuple[int, int]]:
        """(cents, row) of the goals at which a match that is open before the block can end, ascending."""
        out: list[tuple[int, int]] = []
        if not self.n:
            return out
        if self.step[0]:
            stop = int(self.end[0])
            for j in self.goals[: bisect_left(self.goals, stop + 1)]:
                if not out or self.cents[j] > out[-1][0]:
                    out.append((int(self.cents[j]), j))
            j = int(self.after[0])
        else:
            j = 0 if self.goal[0] else -1
        if j >= 0 and (not out or self.cents[j] > out[-1][0]):
            out.append((int(self.cents[j]), j))
        return out

    def passing(self, i: int):
        """How an open match passes: the state after the block for no open match, and by its cents for an open one."""
        seen: dict[int, tuple | None] = {}

        def leave(s: int):
            way, state = [], None
            for a, p in self.walk(s):
                if a in seen:
                    state = seen[a]
                    break
                way.append(a)
                if p == self.n:
                    state = (int(self.cents[a]), i, a, int(self.key[a]), None if self.no_id[a] else int(self.id[a]))
            for a in way:
                seen[a] = state
            return state

        free, limits, exits = leave(0), [], []
        for cents, j in self.ladder():
            state = leave(j + 1)
            if exits and exits[-1] == state:
                limits[-1] = cents
            else:
                limits.append(cents)
                exits.append(state)
        return free, limits, exits


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a sorted partition: the packed rows and their summary."""
    worker_tables("row_pattern")
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    col = lambda name, kind: t.column(name).fill_null(0).to_numpy().astype(kind)
    ts = t.column("ts").cast(pa.int64()).to_numpy()
    no_id, valid = t.column("id").is_null().to_numpy(), t.column("cents").is_valid().to_numpy()
    arrays = [col("key", np.int64), ts, col("id", np.int64), no_id.astype(np.uint8), col("cents", np.int64), valid.astype(np.uint8), col("code", np.uint8)]
    key, cents, code = arrays[0], arrays[4], arrays[6]
    first = tuple(x.item() for x in (key[0], ts[0], cents[0], valid[0], code[0]))
    last = tuple(x.item() for x in (key[-1], ts[-1], cents[-1], valid[-1]))
    yield pa.RecordBatch.from_arrays([pa.array([t.column("i")[0].as_py()], pa.int64()), pa.array([pickle.dumps((first, last))], pa.binary()), pa.array([pack(*arrays)], pa.binary())], ["i", "summary", "rows"])


def _ahead_states(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    """What the rows of each block are to a chain that is open before it."""
    for batch in batches:
        out = []
        for rows, carry in zip(batch.column("rows").to_pylist(), batch.column("carry").to_pylist(), strict=True):
            block = Block(unpack(rows), pickle.loads(carry), None, gap)
            steps = bool(block.step[0])
            out.append(pickle.dumps(((block.ladder() or [(None, 0)])[-1][0], steps and int(block.end[0]) == block.n - 1)))
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(out, pa.binary())], ["i", "state"])


def _passing_states(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, rows, before, ahead in zip(*(batch.column(c).to_pylist() for c in ("i", "rows", "before", "ahead")), strict=True):
            out.append(pickle.dumps(Block(unpack(rows), pickle.loads(before), (pickle.loads(ahead) or (None,))[0], gap).passing(i)))
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(out, pa.binary())], ["i", "state"])


_FOUND = "i long, key long, no long, at_block long, at_row long, part long, first_id long, last_id long, ended boolean, n_rows long, sum_cents long, labels string, digest string, state binary"


def _found(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    """The matches of each block, or their parts in it, numbered within their key from 1; and a row that counts them."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    types = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in _FOUND.split(", ")]
    digests: dict[str, str] = {}
    for batch in batches:
        for i, rows, before, ahead, passing in zip(*(batch.column(c).to_pylist() for c in ("i", "rows", "before", "ahead", "passing")), strict=True):
            block = Block(unpack(rows), pickle.loads(before), (pickle.loads(ahead) or (None,))[0], gap)
            opened = passed(p, None) if (p := pickle.loads(passing)) is not None else None
            out: list[tuple] = []
            ids = lambda j: None if block.no_id[j] else int(block.id[j])  # noqa: B023, E731
            text = lambda a, b: block.labels[a:b].tobytes().decode()  # noqa: B023, E731
            cents = lambda a, b: int(block.total[b] - block.total[a])  # noqa: B023, E731
            s = 0
            if opened is not None:
                want, at_block, at_row, key, first_id = opened
                j = next((j for c, j in block.ladder() if c >= want), block.n)
                ended = j < block.n
                out.append((i, key, None, at_block, at_row, i, first_id, ids(j) if ended else None, ended, j + ended, cents(0, j + ended), text(0, j) + "P" * ended, None, None))
                s = j + 1
            key, no, heads = int(block.key[0]), 0, int(block.key[0])
            for a, p in block.walk(s):
                if block.key[a] != key:
                    key, no = int(block.key[a]), 0
                no += 1
                ended = p < block.n
                label = "A" + text(a + 1, p) + "P" * ended
                if ended and label not in digests:
                    if len(digests) > 10_000:
                        digests.clear()
                    digests[label] = hashlib.sha256(label.encode()).hexdigest()
                out.append((i, key, no, i, a, i, ids(a), ids(p) if ended else None, ended, p - a + ended, cents(a, p + ended), None if ended else label, digests[label] if ended else None, None))
            last = int(block.key[-1])
            out.append((i, *[None] * 12, pickle.dumps((heads, last, no if key == last else 0))))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states = [pickle.loads(c) or (None, None, 0) for c in batch.column("carry").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([s[1] for s in states], pa.int64()), pa.array([s[2] for s in states], pa.int64())], ["i", "key", "before"])


def match_rows(rows: DataFrame, key: str, time: str, row_id: str, value: str, letter: Column, gap_micros: int = GAP_MICROS) -> DataFrame:
    """One row for each match of `A (D|U)*? P` among the distinct rows of each key, ordered by time and id.

    `letter` tells what a row's kind lets it be: BARRED (only A), STEP (A, D or U) or GOAL (also P); null counts as BARRED.
    Cents are floor(100 * value + 0.5); a value that is null, not finite or beyond 2**53 cents fits no letter. A fits every
    other row; D needs fewer cents than the row before, U more, P at least A's; D, U and P follow the row before within
    gap_micros. Search goes on after a match's last row, or one row on where none starts.

    Returns key, match_no (from 1), first_id, last_id, n_rows, sum_cents, labels_sha256. Rows without key or time take no
    part. Null ids come first. Rows equal in all columns count once; of rows equal in key, time and id the order is by
    cents, kind and a hash of the other columns. Other columns, whatever their names, only tell rows apart. An empty table
    gives an empty result. Sums are of 64 bits.
    """
    spark = rows.sparkSession
    ship(spark)
    used = {c.lower() for c in (key, time, row_id, value)}
    rest = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in used]
    cents = F.when(F.abs(F.col(value)) * 100 < CENTS, F.floor(F.col(value) * 100 + 0.5))
    plain = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(time).alias("ts"), F.col(row_id).cast("long").alias("id"), cents.cast("long").alias("cents"), F.coalesce(letter, F.lit(BARRED)).cast("int").alias("code"),
        F.xxhash64(value, *rest).alias("rest"),
    )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK_ROWS))
    order = ["key", "ts", "id", "cents", "code", "rest"]
    ranged = plain.repartitionByRange(n, *order).distinct().sortWithinPartitions(*order).withColumn("i", F.spark_partition_id().cast("long"))
    blocks = cut(ranged.drop("rest").mapInArrow(_blocks, _BLOCK), "blocks")

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pickle.dumps(pickle.loads(s)[1]) for s in b.column(1).to_pylist()], pa.binary())], ["i", "state"])

    def joined(df: DataFrame, carry: DataFrame, name: str) -> DataFrame:
        return df.join(carry.select("i", F.col("carry").alias(name)).hint("merge"), "i")

    before = carries(blocks.select("i", "summary").mapInArrow(state, _STATE), _last)
    ahead = carries(joined(blocks, before, "carry").select("i", "rows", "carry").mapInArrow(lambda b: _ahead_states(b, gap_micros), _STATE), _goal_ahead, backward=True)
    around = joined(joined(blocks.select("i", "rows"), before, "before"), ahead, "ahead")
    passing = carries(around.mapInArrow(lambda b: _passing_states(b, gap_micros), _STATE), _chained)
    found = cut(joined(around, passing, "passing").mapInArrow(lambda b: _found(b, gap_micros), _FOUND), "matches")
    offsets = carries(found.where("state is not null").select("i", "state"), _counted).mapInArrow(_offsets, "i long, key long, before long")

    parts = found.where("state is null")
    # a match within one block is a row already; the parts of any other meet by where it starts
    whole = parts.where("digest is not null").select("i", "key", "no", "first_id", "last_id", "n_rows", "sum_cents", F.col("digest").alias("labels_sha256"))
    across = parts.where("digest is null").groupBy("at_block", "at_row").agg(
        F.max("key").alias("key"), F.max("no").alias("no"), F.max("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n_rows").alias("n_rows"), F.sum("sum_cents").alias("sum_cents"),
        F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "labels"))), lambda x: x["labels"])), 256).alias("labels_sha256"),
    )
    every = whole.union(across.select(F.col("at_block").alias("i"), "key", "no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256"))
    number = F.col("no") + F.coalesce("before", F.lit(0))
    return every.join(offsets.hint("merge"), ["i", "key"], "left").select("key", number.alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256")


def click_letter() -> Column:
    """What a click's kind lets it be: a purchase is a goal; an error, or no kind, is barred."""
    kind = F.col("kind")
    return F.when(kind == "purchase", GOAL).when(kind.isNull() | (kind == "error"), BARRED).otherwise(STEP)


def op12_row_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches among each client's clicks."""
    return match_rows(read_table(spark, sf_dir, "clicks"), "client_id", "ts", "click_id", "value", click_letter()).withColumnRenamed("key", "client_id")


SQL = """
WITH RECURSIVE base AS (
  SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL
), r AS (
  SELECT client_id, ts, click_id, kind, CAST(floor(100 * value + 0.5) AS BIGINT) AS cents, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id NULLS FIRST) AS rn FROM base
), p AS (
  SELECT *, lag(cents) OVER w AS before, ts - lag(ts) OVER w <= INTERVAL 10 MINUTE AS near FROM r WINDOW w AS (PARTITION BY client_id ORDER BY rn)
), f AS (
  SELECT *, coalesce(near AND kind <> 'error' AND cents <> before, false) AS step, coalesce(near AND kind = 'purchase' AND cents IS NOT NULL AND before IS NOT NULL, false) AS goal,
    CASE WHEN cents < before THEN 'D' ELSE 'U' END AS letter FROM p
), s AS (
  SELECT *, count(*) FILTER (NOT step) OVER (PARTITION BY client_id ORDER BY rn) AS chain FROM f
), ends AS (
  SELECT a.client_id, a.rn AS i, min(g.rn) AS j FROM s a
  JOIN (SELECT client_id, rn, cents, chain - CASE WHEN step THEN 0 ELSE 1 END AS chain FROM s WHERE goal) g
    ON a.client_id = g.client_id AND a.chain = g.chain AND g.rn > a.rn AND g.cents >= a.cents GROUP BY 1, 2
), following AS (
  SELECT e.client_id, e.i, e.j, n.i AS onward FROM ends e ASOF LEFT JOIN (SELECT client_id, i FROM ends) n ON e.client_id = n.client_id AND e.j < n.i
), way AS (
  SELECT f.client_id, f.i, f.j, f.onward, CAST(1 AS BIGINT) AS match_no FROM following f WHERE (f.client_id, f.i) IN (SELECT (client_id, min(i)) FROM ends GROUP BY client_id)
  UNION ALL
  SELECT f.client_id, f.i, f.j, f.onward, w.match_no + 1 FROM way w JOIN following f ON w.client_id = f.client_id AND w.onward = f.i
)
SELECT w.client_id, w.match_no, max(CASE WHEN s.rn = w.i THEN s.click_id END) AS first_id, max(CASE WHEN s.rn = w.j THEN s.click_id END) AS last_id, count(*) AS n_rows, CAST(sum(s.cents) AS BIGINT) AS sum_cents,
  sha256(string_agg(CASE WHEN s.rn = w.i THEN 'A' WHEN s.rn = w.j THEN 'P' ELSE s.letter END, '' ORDER BY s.rn)) AS labels_sha256
FROM way w JOIN s ON s.client_id = w.client_id AND s.rn BETWEEN w.i AND w.j GROUP BY 1, 2
"""
