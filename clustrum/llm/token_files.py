"""Token-ID output: shards of ids under Re-Pair grammars, with rules, expansion lengths and a document index.

Documents are encoded in ascending doc_id order and cut into shards. In a shard, rounds replace the most frequent
adjacent id pairs by new symbols until no pair is frequent enough; pairs never cross the end of a document. Each round
takes many pairs at once: of overlapping ones the more frequent goes first, of equal ones the leftmost.

A shard is one row of a Parquet table, so Spark's own commit keeps whole shards only when tasks are tried again:
part, seq (order), n_docs, n_tokens, payload. The payload, little-endian throughout:

    magic 8 bytes | version, vocabulary, n_rules, n_docs, n_symbols, symbol bytes: 6 x uint32
    rules         n_rules x 2 x uint32      left and right symbol; rule r is symbol vocabulary + r
    lengths       n_rules x uint32          ids that rule r expands to
    doc ids       n_docs x int64            with a uint8 flag each for a null id
    symbol ends   n_docs x int64            where each document's symbols end
    token ends    n_docs x int64            where each document's ids end
    symbols       n_symbols x uint16 or uint32
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import FileBytes, read_table, scratch_root, ship, worker_model

MAGIC, VERSION = b"REPAIRID", 1
#: Ids after which a shard is closed.
SHARD_TOKENS = 2_000_000
#: A pair is replaced from this many places in the shard; a round takes the most frequent pairs, at most so many.
MIN_COUNT, ROUND_PAIRS = 32, 8192
#: The rounds end when one shortens the shard by less than this share.
LEAST_SAVED = 0.02
#: Bits of the hash table that finds a round's pairs.
TABLE = 18
#: Pieces of text whose ids a worker remembers, in each of two tables.
CHUNKS = 700_000

#: Fixed value: what byte-level vocabularies write for a blank.
BLANK = "Ġ"

#: The last letter of the Latin blocks, up to which Python and the library agree on what a letter is.
LAST_LATIN = "\u024f"

#: White space before a blank: there the blank starts no piece.
_AWKWARD = re.compile(r"\s ")
_ASCII_AWKWARD = tuple(f"{c} " for c in " \t\n\v\f\r\x1c\x1d\x1e\x1f")


class _Coder:
    """Ids by the tokenizers library, which is asked once for each piece between single blanks.

    The pre-tokenizer of a byte-level model starts a new piece at each blank that follows something else than white
    space, so those pieces are encoded alike alone and in the text.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.tokenizer = Tokenizer.from_str(raw.decode())
        #: Texts that hold one of the added tokens are cut at it first, so they are encoded whole.
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if self.vocabulary < 1 << 16 else np.uint32
        #: Whether a token's text starts with a blank.
        self.blank = np.array([(self.tokenizer.id_to_token(i) or "").startswith(BLANK) for i in range(self.vocabulary)])
        self.model = self.tokenizer.model
        self.raw = [np.array(i, self.dtype).tobytes() for i in range(self.vocabulary)]
        # byte-level vocabularies write the bytes that can't be shown as the code points from 256 on
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in shown]
        self.written = {b: 256 + i for i, b in enumerate(hidden)}
        self.signs = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, self.dtype).tobytes() for c in ".,;:!?"}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut before blanks; all but the first piece are without theirs, and the first one starts with NUL."""
        parts = text.split(" ")
        if not (text.startswith(" ") or (any(map(text.__contains__, _ASCII_AWKWARD)) if text.isascii() else _AWKWARD.search(text))):
            parts[0] = "\x00" + parts[0]
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if out[-1] and not out[-1][-1].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return [p[1:] if p.startswith(" ") and not p.startswith(" \x00") else f"\x00{p}" for p in out]

    def _word(self, piece: str) -> bytes | None:
        """Ids of a blank and a word of Latin letters, perhaps with one sign after it: the pre-tokenizer makes the word
        and the sign one part each, which the library's model encodes; None for other pieces."""
        tail = b""
        if not piece.isalpha():
            tail = self.signs.get(piece[-1:])
            piece = piece[:-1]
            if tail is None or not piece.isalpha():
                return None
        if max(piece) > LAST_LATIN:
            return None
        text = "Ġ" + piece if piece.isascii() else (" " + piece).encode().decode("latin-1").translate(self.written)
        return b"".join([self.raw[t.id] for t in self.model.tokenize(text)]) + tail

    def _ask(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces from the library: plain words by its model; others that end in no white space as one text, in
        which a token that starts with a blank starts the next piece, since no piece has another blank; the rest one by one."""
        found = {p: ids for p in pieces if (ids := self._word(p)) is not None}
        plain = [p for p in pieces if p not in found and p and not p[0].isspace() and p[0] != "\x00" and not p[-1].isspace()]
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            ids = np.array(self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False).ids, self.dtype)
            starts = np.flatnonzero(self.blank[ids])
            if len(starts) == len(part) and not starts[0]:
                raw, size = ids.tobytes(), ids.itemsize
                ends = [*(starts[1:] * size).tolist(), len(raw)]
                found.update(zip(part, map(raw.__getitem__, map(slice, (starts * size).tolist(), ends)), strict=True))
        rest = [p for p in pieces if p not in found]
        got = self.tokenizer.encode_batch([p[1:] if p.startswith("\x00") else " " + p for p in rest], add_special_tokens=False)
        found.update((p, np.array(e.ids, self.dtype).tobytes()) for p, e in zip(rest, got, strict=True))
        return [found[p] for p in pieces]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        # a piece that starts with NUL would be taken for a first one: such texts are encoded whole too
        whole = {i for i, t in enumerate(texts) if t and (" \x00" in t or any(map(t.__contains__, self.added)))}
        cut = [self.pieces(t) if t and i not in whole else [] for i, t in enumerate(texts)]
        get = self.new.get
        ids = [list(map(get, ps)) for ps in cut]
        missing = [(i, j) for i, own in enumerate(ids) if None in own for j, v in enumerate(own) if v is None]
        if missing:
            unknown, old = dict.fromkeys(cut[i][j] for i, j in missing), self.old
            if len(self.new) + len(unknown) > CHUNKS:
                self.old, self.new = self.new, {}
            asked = []
            for p in unknown:
                if (known := old.get(p)) is not None:
                    unknown[p] = known
                else:
                    asked.append(p)
            unknown.update(zip(asked, self._ask(asked), strict=True))
            self.new.update(unknown)
            for i, j in missing:
                ids[i][j] = unknown[cut[i][j]]
        out = list(map(b"".join, ids))
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.dtype).tobytes()
        return out


def re_pair(ids: np.ndarray, ends: np.ndarray, vocabulary: int, min_count: int = MIN_COUNT, most: int = ROUND_PAIRS, least: float = LEAST_SAVED):
    """(symbols, their ends by document, rules) of the ids of documents that end at `ends`."""
    room = (1 << 16) - vocabulary if ids.dtype == np.uint16 else (1 << 31) - vocabulary
    wide = np.uint32 if ids.dtype == np.uint16 else np.uint64
    shift = wide(16 if ids.dtype == np.uint16 else 32)
    seq = ids
    filled = np.diff(ends, prepend=0) > 0
    stops = ends[filled] - 1  # places of the documents' last symbols
    rules: list[np.ndarray] = []
    made = 0
    while len(seq) > 1 and made < room:
        key = (seq[:-1].astype(wide) << shift) | seq[1:]
        closed = stops[stops < len(key)]
        ordered = key.copy()
        ordered[closed] = np.iinfo(wide).max  # pairs over the end of a document sort last and are left out
        ordered.sort()
        ordered = ordered[: len(key) - len(closed)]
        if not len(ordered):
            break
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        count = np.diff(np.r_[first, len(ordered)])
        many = np.flatnonzero(count >= min_count)
        if not len(many):
            break
        many = many[np.argsort(-count[many], kind="stable")[: min(most, room - made)]]
        pairs = ordered[first[many]]  # by rank
        # a table of hashes says which pair a place may hold; of pairs that meet in a slot the more frequent one stays
        slot = (pairs.astype(np.uint32) if wide is np.uint32 else (pairs ^ (pairs >> wide(29))).astype(np.uint32)) * np.uint32(2654435769) >> np.uint32(32 - TABLE)
        table = np.zeros(1 << TABLE, np.int32)
        table[slot[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
        own = (key if wide is np.uint32 else (key ^ (key >> wide(29))).astype(np.uint32)) * np.uint32(2654435769) >> np.uint32(32 - TABLE)
        at = table[own]
        none = np.int32(2**31 - 1)
        place = np.where(pairs[at] == key, at, none)
        place[closed] = none
        # a run of equal places (one id over and over) goes before worse neighbours, at every second place
        begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        best = np.r_[none, place[begin], none]
        first = (best[1:-1] != none) & ((best[1:-1] < best[:-2]) | (best[:-2] == none)) & ((best[1:-1] < best[2:]) | (best[2:] == none))
        sizes = np.diff(np.r_[begin, len(place)])
        begin, sizes = begin[first], sizes[first]
        halves = (sizes + 1) // 2
        chosen = np.repeat(begin, halves) + 2 * (np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves))
        used = np.bincount(at[chosen], minlength=len(pairs))
        worth = used >= min(min_count, 4)
        if not worth.any():
            break
        chosen = chosen[worth[at[chosen]]]
        symbol = np.cumsum(worth) - 1 + vocabulary + made
        seq = seq.copy()
        seq[chosen] = symbol[at[chosen]].astype(seq.dtype)
        keep = np.ones(len(seq), bool)
        keep[chosen + 1] = False
        seq = seq[keep]
        stops = stops - np.searchsorted(chosen + 1, stops, "right")
        saved, whole = len(chosen), len(seq) + len(chosen)
        new = pairs[worth]
        rules.append(np.stack((new >> shift, new & wide((1 << int(shift)) - 1)), 1).astype(np.uint32))
        made += len(new)
        if saved < least * whole:
            break
    symbol_ends = np.zeros(len(ends), np.int64)
    symbol_ends[filled] = stops + 1
    return seq, np.maximum.accumulate(symbol_ends) if len(ends) else symbol_ends, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    out = [1] * len(rules)
    size = lambda s: 1 if s < vocabulary else out[s - vocabulary]
    for r, (a, b) in enumerate(rules.tolist()):
        out[r] = size(a) + size(b)
    return np.array(out, np.uint32)


def pack(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> bytes:
    symbols, symbol_ends, rules = re_pair(ids, ends, vocabulary)
    head = MAGIC + struct.pack("<6I", VERSION, vocabulary, len(rules), len(doc_ids), len(symbols), symbols.dtype.itemsize)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], np.int64)
    return b"".join((head, rules.tobytes(), _lengths(rules, vocabulary).tobytes(), known.tobytes(), nulls.tobytes(), symbol_ends.astype(np.int64).tobytes(), ends.astype(np.int64).tobytes(), symbols.tobytes()))


class Shard:
    """Random access to a payload: documents by place, ids by offset, of which only the rules that they reach are expanded;
    and all documents at once."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a shard")
        version, self.vocabulary, n_rules, n_docs, n_symbols, width = struct.unpack_from("<6I", payload, 8)
        if version != VERSION:
            raise ValueError(f"shard version {version}")
        at = 32

        def take(dtype, n):
            nonlocal at
            out = np.frombuffer(payload, dtype, n, at)
            at += out.nbytes
            return out

        self.rules, self.lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        known, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else d for d, z in zip(known.tolist(), nulls.tolist(), strict=True)]
        self.symbol_ends, self.token_ends, self.symbols = take("<i8", n_docs), take("<i8", n_docs), take(f"<u{width}", n_symbols)
        self.pool: np.ndarray | None = None

    def _expansions(self) -> None:
        """All expansions one after the other: ids by themselves, then the rules."""
        begins = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        pool = np.empty(int(self.lengths.sum(dtype=np.int64)), self.symbols.dtype)
        v, starts, sizes = self.vocabulary, begins.tolist(), self.lengths.tolist()
        for r, (a, b) in enumerate(self.rules.tolist()):
            p = starts[r]
            for s in (a, b):
                if s < v:
                    pool[p] = s
                    p += 1
                else:
                    q, m = starts[s - v], sizes[s - v]
                    pool[p : p + m] = pool[q : q + m]
                    p += m
        self.pool = np.concatenate((np.arange(v, dtype=self.symbols.dtype), pool))
        self.begin = np.concatenate((np.arange(v, dtype=np.int64), begins + v))
        self.size = np.concatenate((np.ones(v, np.int64), self.lengths.astype(np.int64)))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self.pool is None:
            self._expansions()
        size = self.size[symbols]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        narrow = np.int32 if total + len(self.pool) < 2**31 else np.int64
        return self.pool[np.arange(total, dtype=narrow) + np.repeat((self.begin[symbols] - (ends - size)).astype(narrow), size)]

    def few(self, symbols: np.ndarray) -> np.ndarray:
        """The expansion of some symbols by the rules that they reach, and no others."""
        out, rules, v = [], self.rules, self.vocabulary
        stack = symbols[::-1].tolist()
        while stack:
            s = stack.pop()
            if s < v:
                out.append(s)
            else:
                first, second = rules[s - v].tolist()
                stack += (second, first)
        return np.array(out, self.symbols.dtype)

    def document(self, place: int) -> np.ndarray:
        return self.few(self.symbols[(self.symbol_ends[place - 1] if place else 0) : self.symbol_ends[place]])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop of the shard. The documents' index leads to the first one that holds some; from there
        on the symbols' expansion lengths are added up, to the last one."""
        if start >= stop or not len(self.token_ends):
            return self.few(self.symbols[:0])
        first, last = np.searchsorted(self.token_ends, (start, stop - 1), "right").tolist()
        if first >= len(self.token_ends):
            return self.few(self.symbols[:0])
        before, low = (int(self.token_ends[first - 1]), int(self.symbol_ends[first - 1])) if first else (0, 0)
        own = self.symbols[low : self.symbol_ends[min(last, len(self.token_ends) - 1)]]
        size = np.ones(len(own), np.int64)
        made = own >= self.vocabulary
        size[made] = self.lengths[own[made].astype(np.int64) - self.vocabulary]
        ends = before + np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = start - (int(ends[a - 1]) if a else before)
        return self.few(own[a:b])[skip : skip + stop - start]

    def documents(self, dtype: str | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        ids = self.expand(self.symbols)
        ids = ids if dtype is None else ids.astype(dtype)
        begin = 0
        for doc, end in zip(self.doc_ids, self.token_ends.tolist(), strict=True):
            yield doc, ids[begin:end]
            begin = end


def _shards(batches: Iterator[pa.RecordBatch], file: FileBytes, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    coder = worker_model("ids", file, _Coder)
    part, seq = TaskContext.get().partitionId(), 0
    end = np.array([end_id], coder.dtype).tobytes()
    docs, own, sizes, total = [], [], [], 0

    def close():
        ids, ends = np.frombuffer(b"".join(own), coder.dtype), np.cumsum(np.array(sizes, np.int64))
        return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(docs), "n_tokens": len(ids), "payload": pack(docs, ids, ends, coder.vocabulary)}], _SHARD_ARROW)

    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            batch = whole.slice(a, 256)
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                docs.append(doc)
                own.append(ids + end)
                sizes.append(len(ids) // coder.dtype().itemsize + 1)
                total += sizes[-1]
                if total >= shard_tokens:
                    yield close()
                    docs, own, sizes, total, seq = [], [], [], 0, seq + 1
    if docs:
        yield close()


_SHARD = "part int, seq int, n_docs long, n_tokens long, payload binary"
_SHARD_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of (doc_id, text) as shards in ascending doc_id order; end_id is put after each document.

    Rows without doc_id come first, in the order of a hash of their text, so any number of them is dealt over many tasks;
    rows that repeat a doc_id are documents of their own, ordered by their text; a null text is empty, so its document is
    the end id alone; an empty table makes an empty table of shards. A text longer than a shard makes a shard of its own.
    Other columns aren't read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(1, rows.rdd.getNumPartitions())
    order = F.col("doc_id").asc_nulls_first(), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    file = FileBytes(docs.sparkSession, tokenizer)
    rows.mapInArrow(lambda b: _shards(b, file, end_id, shard_tokens), _SHARD).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            out = []
            for doc, ids in Shard(payload).documents("<u4"):
                out.append((doc, len(ids), zlib.crc32(ids)))
            sizes = np.array([x[1] for x in out], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(out), pa.int32()), pa.array([seq] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int64()),
                 pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([x[2] for x in out], pa.int64())],
                ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from its ids as the shards hold them."""
    shards = spark.read.schema(_SHARD).parquet(path)
    from pyspark.sql import Window

    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    begins = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("long")).alias("begin"))
    docs = shards.select("part", "seq", "payload").mapInArrow(_read, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(begins, ["part", "seq"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = f"{scratch_root(spark)}/clustrum/tokens-{uuid.uuid4().hex}"
    write(read_table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return read_index(spark, path)
