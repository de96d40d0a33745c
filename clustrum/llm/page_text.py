"""Main text of web pages: a suffix array of each host finds what its pages repeat, the markup checks what is taken out.

The words of a page's blocks are its token stream. The suffixes that begin at blocks are sorted by host and by their
words: the suffix array of the host's concatenated streams at those places, cut by range into partitions, so that neither
a host nor a text that all its pages share is one task's. A suffix is known by its first WORDS words and by a digest of the
rest of its block. Of all suffixes of other pages the nearest ones on either side have the longest common prefix, so two
neighbours tell how far the text from each block on is repeated on another page of the host. At the edge of a partition
those neighbours are carried over from the partitions before and after it.

Passages that begin within blocks are found by the suffixes at all words, known by WORDS words: where a longer passage goes on,
the suffixes at its later words tell so. Only hosts have them on which a page leaves some block undecided by its markup.

A block is boilerplate if repeated passages of LONG words or more, from a block's start on, cover half of it, or such passages
within it more than half; the unique runs stay. Then the markup
is asked: a block inside the page's article stays although other pages quote or copy it, and a block of a menu, an
advert or a form goes although it is unique. Where a page marks no content, the suffix array alone decides.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .carries import STATE, carries
from .markup import CHROME, OPEN, Piece, pieces
from .shared import cut, read_table, ship, worker_tables

#: Words that a passage needs to count as repeated; words of a suffix that are compared one by one.
LONG, WORDS = 5, 8
#: Share of a block's words that repeated passages cover in boilerplate.
COVERED = 0.5
#: Pages whose suffixes a sorting task gets on average, unless the session asks for more partitions.
PAGES = 10_000
#: Suffixes at words that such a task gets on average.
RANGE = 500_000
#: Set on the first word of a block, so that passages agree in their blocks too.
_FIRST = np.uint64(0x9E37)

_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_SUFFIX = "host long, p0 long, p1 long, rest long, page long, tie long, block int, words int, remaining int"
_KEY = ["host", "p0", "p1", "rest", "page", "tie", "block"]
_FOUND = "i long, page long, block int, extent int, state binary"
_PAGE = "page long, page_id long, url string, blocks binary"


def host(url: str | None) -> str | None:
    """The host of a URL in lower case; None without one."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else None


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def suffixes(texts: list[str]) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """(first WORDS words of 16 bits of the suffix at each block, digests of the rest of long blocks, words of the blocks,
    words up to the page's end). Behind the page's end the words are 0."""
    h, sizes = [], np.zeros(len(texts), np.int64)
    for row, raw, offs in textkit.blocks(pa.array(texts, pa.large_string())):
        starts, ends, at = textkit.words(raw, offs)
        h.append(textkit.word_hashes(raw, starts, ends))
        sizes[row : row + len(offs) - 1] = np.diff(at)
    words = np.concatenate(h) if h else np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    rest = [_digest(words[a + WORDS : a + n].tobytes()) if n > WORDS else 0 for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
    token = (words & np.uint64(0xFFFF)) | np.uint64(1)
    token[begin[sizes > 0]] ^= _FIRST
    token = np.r_[np.where(token == 0, 1, token).astype(np.uint16), np.zeros(WORDS, np.uint16)]
    return token[begin[:, None] + np.arange(WORDS)], rest, sizes, len(words) - begin


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = worker_tables("pages")
    names, hosts = [c.split()[0] for c in _SUFFIX.split(", ")], {}
    types = [pa.int32() if c.endswith(" int") else pa.int64() for c in _SUFFIX.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for page, tie, url, page_html in zip(*(batch.column(c).to_pylist() for c in ("page", "tie", "url", "html")), strict=True):
            name = host(url)
            texts = [p.text for p in pieces(page_html, known)] if name else []
            if not texts:
                continue
            if name not in hosts:
                hosts[name] = _digest(name.encode())
            token, rest, sizes, left = suffixes(texts)
            packed = token.astype(">u2").view(">i8").astype(np.int64)
            n = len(texts)
            for column, values in zip(out, ([hosts[name]] * n, packed[:, 0], packed[:, 1], rest, [page] * n, [tie] * n, range(n), sizes, left), strict=True):
                column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def undecided(blocks: list[Piece]) -> bool:
    """Whether repeats decide on some block of a page: its markup neither keeps it nor takes it out."""
    top = max((p.mark for p in blocks), default=OPEN)
    return any(OPEN < p.mark < top or p.mark == top == OPEN for p in blocks)


def _undecided_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = worker_tables("pages")
    for batch in batches:
        names = {host(u) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True) if host(u) and undecided(pieces(h, known))}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(names), pa.string())], ["name"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes at all words of the pages, in the form of those at blocks: `block` is the word's place."""
    known, types = worker_tables("pages"), [pa.int32() if c.endswith(" int") else pa.int64() for c in _SUFFIX.split(", ")]
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            batch, parts = whole.slice(a, 256), []
            for page, tie, url, page_html in zip(*(batch.column(c).to_pylist() for c in ("page", "tie", "url", "html")), strict=True):
                h = [textkit.word_hashes(raw, *textkit.words(raw, offs)[:2]) for _, raw, offs in textkit.blocks(pa.array([" ".join(p.text for p in pieces(page_html, known))], pa.large_string()))]
                n = sum(map(len, h))
                if n < LONG:
                    continue
                token = np.r_[((np.concatenate(h) & np.uint64(0xFFFF)) | np.uint64(1)).astype(np.uint16), np.zeros(WORDS, np.uint16)]
                at = np.arange(n)
                packed = token[at[:, None] + np.arange(WORDS)].astype(">u2").view(">i8").astype(np.int64)
                # where fewer than LONG words are left no passage begins
                full = slice(0, n - LONG + 1)
                fixed = lambda v, n=n: np.full(n, v, np.int64)
                parts.append([c[full] for c in (fixed(_digest(host(url).encode())), packed[:, 0], packed[:, 1], fixed(0), fixed(page), fixed(tie), at, fixed(1), n - at)])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts]), t) for k, t in enumerate(types)], [c.split()[0] for c in _SUFFIX.split(", ")])


def passages(pages: DataFrame) -> DataFrame:
    """(page, word, extent): how many words from a word of a page on, WORDS at most, another page of the host repeats, of hosts
    with an undecided page; rows as for repeated()."""
    ship(pages.sparkSession)
    names = cut(pages.select("url", "html").mapInArrow(_undecided_hosts, "name string").distinct(), "undecided")
    if names.isEmpty():
        return pages.sparkSession.createDataFrame([], "page long, word int, extent int")
    of = F.udf(lambda url: host(url), "string")
    some = pages.withColumn("name", of("url")).join(names, "name", "left_semi").select("page", "tie", "url", "html")
    words = cut(some.mapInArrow(_word_rows, _SUFFIX), "words")
    found = _repeats(words, words.count(), RANGE)
    return found.select("page", F.col("block").alias("word"), "extent")


def common(a: tuple, b: tuple | None) -> int:
    """Words in which two suffixes (host, p0, p1, rest, page) agree from their start; one more if they agree in all and in
    the rest of their blocks."""
    if b is None or a[0] != b[0]:
        return 0
    for k in (1, 2):
        if a[k] != b[k]:
            x = (a[k] ^ b[k]) & 0xFFFFFFFFFFFFFFFF
            return 4 * (k - 1) + (64 - x.bit_length()) // 16
    return WORDS + (a[3] == b[3])


def _agree(keys: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """common() of rows of keys (n, 5); other < 0 means none."""
    x, y = keys[at], keys[np.maximum(other, 0)]
    gap = [(x[:, k] ^ y[:, k]).view(np.uint64) for k in (1, 2)]
    words = []
    for g in gap:
        parts = np.stack([(g >> np.uint64(s)) & np.uint64(0xFFFF) for s in (48, 32, 16, 0)], 1) != 0
        words.append(np.where(parts.any(1), parts.argmax(1), 4))
    n = np.where(words[0] < 4, words[0], 4 + words[1])
    n += (n == WORDS) & (x[:, 3] == y[:, 3])
    return np.where((other >= 0) & (x[:, 0] == y[:, 0]), n, 0)


def _extent(n, words, left):
    """Words of the page that are covered from a block on, by what its suffix has in common with another page's."""
    whole = np.where(n > WORDS, np.maximum(words, WORDS), np.minimum(n, WORDS))
    return np.where(n >= LONG, np.minimum(whole, left), 0)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The extents of a sorted partition's suffixes by their neighbours in it, and its edges, whose neighbours may lie
    beyond it: the first and the last run of suffixes of one page."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    keys = np.stack([t.column(c).to_numpy() for c in ("host", "p0", "p1", "rest", "page")], 1)
    n, page = len(keys), keys[:, 4]
    starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    length = np.diff(np.r_[starts, n])
    before, after = np.repeat(starts - 1, length), np.repeat(np.where(starts + length < n, starts + length, -1), length)
    at = np.arange(n)
    agree = np.maximum(_agree(keys, at, before), _agree(keys, at, after))
    words, left, block = (t.column(c).to_numpy() for c in ("words", "remaining", "block"))
    extent = _extent(agree, words, left)
    i = t.column("i")[0].as_py()
    hit = np.flatnonzero(extent > 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(hit), i)), pa.array(page[hit]), pa.array(block[hit], pa.int32()), pa.array(extent[hit].astype(np.int32)), pa.nulls(len(hit), pa.binary())], ["i", "page", "block", "extent", "state"]
    )
    row = lambda j: tuple(keys[j].tolist()) if 0 <= j < n else None
    first, last = int(length[0]), int(starts[-1])
    edges = sorted({*range(first), *range(last, n)})
    state = (row(0), row(first), row(n - 1), row(last - 1), [(row(j), int(block[j]), int(words[j]), int(left[j])) for j in edges])
    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([pickle.dumps(state)])], ["i", "page", "block", "extent", "state"])


def _later(left, right):
    """(last suffix, last suffix of a page other than its) of two neighbouring stretches."""
    return right[0], right[1] or (left[0] if left[0][4] != right[0][4] else left[1])


def _sooner(left, right):
    """(first suffix, first suffix of a page other than its)."""
    return left[0], left[1] or (right[0] if right[0][4] != left[0][4] else right[1])


def _edge_extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The extents of suffixes at the edges, by the suffixes of other pages beyond them."""
    for batch in batches:
        out = []
        for state, before, after in zip(*(map(pickle.loads, batch.column(c).to_pylist()) for c in ("state", "before", "after")), strict=True):
            for own, block, words, left in state[4]:
                other = [s for pair in (before, after) if pair for s in pair if s and s[4] != own[4]]
                extent = int(_extent(max((common(own, s) for s in other), default=0), words, left))
                if extent:
                    out.append((own[4], block, extent))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["page", "block", "extent"])


def repeated(pages: DataFrame) -> DataFrame:
    """(page, block, extent): how many words from a block's start on another page of the host repeats, of rows
    (page, tie, url, html); `page` names a page, equal rows of a page are one. Pages without host repeat nothing."""
    ship(pages.sparkSession)
    # kept, since finding the ranges reads them once more: pages would be parsed twice
    parsed = cut(pages.select("page", "tie", "url", "html").mapInArrow(_suffix_rows, _SUFFIX), "suffixes")
    return _repeats(parsed, pages.count(), PAGES)


def _repeats(parsed: DataFrame, many: int, each: int) -> DataFrame:
    """(page, block, extent) of kept suffixes, sorted in as many ranges as hold `each` of `many`."""
    n = max(int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // each))
    ordered = parsed.repartitionByRange(n, *_KEY).sortWithinPartitions(*_KEY)
    found = cut(ordered.withColumn("i", F.spark_partition_id().cast("long")).mapInArrow(_neighbours, _FOUND), "repeated")

    def pick(*places: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                states = [pickle.loads(s) for s in b.column("state").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("i"), pa.array([pickle.dumps(tuple(s[k] for k in places)) for s in states], pa.binary())], ["i", "state"])

        return rows

    edges = found.where("state is not null").select("i", "state")
    before = carries(edges.mapInArrow(pick(2, 3), STATE), _later).withColumnRenamed("carry", "before")
    after = carries(edges.mapInArrow(pick(0, 1), STATE), _sooner, backward=True).withColumnRenamed("carry", "after")
    beyond = edges.join(before.hint("merge"), "i").join(after.hint("merge"), "i").select("state", "before", "after")
    both = found.where("state is null").select("page", "block", "extent").union(beyond.mapInArrow(_edge_extents, "page long, block int, extent int"))
    return both.groupBy("page", "block").agg(F.max("extent").alias("extent"))


def main_text(blocks: list[Piece], extents: dict[int, int], words: dict[int, int] | None = None) -> str:
    """The text of a page's blocks that are no boilerplate; extents as repeated() has them, by block, and words as passages()."""
    sizes = [p.text.count(" ") + 1 for p in blocks]
    covered, end, at = [], 0, 0
    for b, n in enumerate(sizes):
        old = min(max(end - at, 0), n)
        end = max(end, at + extents.get(b, 0))
        new = min(max(end - at, 0), n)
        covered.append(max(old, new) >= COVERED * n and end > at)
        at += n
    if words:
        told = np.zeros(at + 1, np.int64)
        begin = 0
        for b, n in enumerate(sizes):
            for i, size in [(begin, extents.get(b, 0))] + [(i, words[i]) for i in range(begin, begin + n) if i in words]:
                # what runs on from the block before or into the next one is theirs
                size = min(size, begin + n - i)
                if size >= LONG:
                    told[i] += 1
                    told[i + size] -= 1
            begin += n
        inside = np.r_[0, np.cumsum(np.cumsum(told)[:-1] > 0)]
        ends = np.cumsum(sizes)
        covered = [c or inside[e] - inside[e - n] > COVERED * n for c, e, n in zip(covered, ends, sizes, strict=True)]
    # the check by markup
    top = max((p.mark for p in blocks), default=OPEN)
    kept = []
    for p, repeats in zip(blocks, covered, strict=True):
        if p.mark == CHROME or (p.mark == OPEN and top > OPEN):
            continue
        if p.mark == top > OPEN or not (repeats or p.links):
            kept.append(p.text)
    if not kept and top == OPEN:
        # a page of which nothing is unique is itself a copy
        kept = [p.text for p in blocks if p.mark == OPEN and not p.links]
    return "\n".join(kept)


def _page_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, codec = worker_tables("pages"), pa.Codec("zstd")
    for batch in batches:
        out = []
        for page_html in batch.column("html").to_pylist():
            # of menus and the like only the number of words counts from here on
            rows = [(p.text if p.mark >= OPEN else " " * p.text.count(" "), p.mark, p.links) for p in pieces(page_html, known)]
            raw = pickle.dumps(rows)
            out.append(len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True))
        yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("page_id"), batch.column("url"), pa.array(out, pa.binary())], ["page", "page_id", "url", "blocks"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        out = []
        for packed, runs, words in zip(batch.column("blocks").to_pylist(), batch.column("runs").to_pylist(), batch.column("words").to_pylist(), strict=True):
            rows = pickle.loads(codec.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True))
            out.append(main_text([Piece(*r) for r in rows], {r["block"]: r["extent"] for r in runs or ()}, {r["word"]: r["extent"] for r in words or ()}))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of (page_id, url, html): the main text, its blocks joined by line feeds.

    Null and empty pages, and pages of nothing but boilerplate, have an empty text. Rows are one page if url and html are
    equal, whatever their ids, and no evidence against each other; each has its row in the result. A page without a host
    takes part in no suffix array. Other columns aren't read.
    """
    ship(pages.sparkSession)
    page = F.xxhash64("url", "html")
    rows = pages.select(page.alias("page"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    named = rows.select("page", F.coalesce("page_id", F.lit(0)).alias("tie"), "url", "html")
    runs = repeated(named).groupBy("page").agg(F.collect_list(F.struct("block", "extent")).alias("runs"))
    words = passages(named).groupBy("page").agg(F.collect_list(F.struct("word", "extent")).alias("words"))
    texts = rows.mapInArrow(_page_blocks, _PAGE).join(runs, "page", "left").join(words, "page", "left")
    return texts.select("page_id", "url", "blocks", "runs", "words").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
