"""Line dedup by content-defined chunks of lines: a chunk that stood earlier in the corpus is removed.

Cuts may fall inside a passage and its edges may share a chunk with other lines, so passages of MIN_WORDS words or more
are also compared by windows: the fewest whole lines with that many words from each line on, and up to each line. Every
line of a repeated passage is in such a window that lies in the passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read_table, spare
from .textkit import WORD_END

#: A chunk is compared with the corpus if it has this many lines, or this many words.
MIN_LINES, MIN_WORDS = 2, 50
#: A chunk ends after a line with probability 1 / DIVISOR, by a rolling hash of two line hashes.
DIVISOR = 2


#: The columns that dedup_lines() adds.
NEW = ("_n_lines", "_removed_lines", "_removed_words")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def chunks(text: Column, min_lines: int, min_words: int, divisor: int) -> Column:
    """The text's chunks: array of struct(k, text, n_lines, n_words, heavy), in order; heavy ones are compared.

    A line of min_words words or more is a chunk of its own. Elsewhere the chunk ends after line i where the buzhash
    rotl(hash(i - 1), 1) xor hash(i) is 0 modulo the divisor: only the two lines themselves decide, so the same
    lines are cut alike wherever they stand.
    """

    def ends_after(line: Column, prev: Column, following: Column) -> Column:
        rolled = F.shiftleft(prev["h"], 1).bitwiseXOR(F.shiftrightunsigned(prev["h"], 63)).bitwiseXOR(line["h"])
        cut_here = F.pmod(F.xxhash64(rolled), F.lit(divisor)) == 0
        return cut_here | (line["w"] >= min_words) | F.coalesce(following["w"] >= min_words, F.lit(False))

    def build(lines: Column) -> Column:
        n = F.size(lines)
        stops = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == n - 1) | ends_after(F.get(lines, i), F.coalesce(F.get(lines, i - 1), F.get(lines, i)), F.get(lines, i + 1)),
        )

        def chunk(stop: Column, k: Column, stops: Column) -> Column:
            begin = F.coalesce(F.get(stops, k - 1) + 1, F.lit(0))
            own = F.slice(lines, begin + 1, stop - begin + 1)
            n_words = F.aggregate(own, F.lit(0), lambda s, x: s + x["w"])
            n_lines = stop - begin + 1
            return F.struct(
                k.alias("k"), begin.alias("b"), F.array_join(F.transform(own, lambda x: x["l"]), "\n").alias("text"), n_lines.alias("n_lines"), n_words.alias("n_words"),
                ((n_words > 0) & ((n_lines >= min_lines) | (n_words >= min_words))).alias("heavy"),
            )

        return let(stops, lambda s: F.transform(s, lambda stop, k: chunk(stop, k, s)))

    line = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("l"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD_END)).alias("w")))
    return let(line, build)


def windows(text: Column, min_words: int) -> Column:
    """The text's windows of two or more lines: array of struct(b, e, d), first and last line and a SHA-256 digest.

    A window has the fewest lines with min_words words from a line on, or up to it; lines without words begin and end
    none. The line of each word is listed, so that a window's other end is a look-up: time and memory follow the words.
    """

    def build(lines: Column) -> Column:
        owner = F.flatten(F.transform(lines, lambda x, i: F.array_repeat(i, x["w"])))

        def ends(owner: Column) -> Column:
            n = F.size(owner)
            firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda t: (t == 0) | (F.get(owner, t) != F.get(owner, t - 1)))
            # a line's first word opens the window from it on, and the word before it closes the window up to the line before
            onward = F.transform(firsts, lambda t: F.struct(F.get(owner, t).alias("b"), F.get(owner, t + (min_words - 1)).alias("e")))
            upto = F.transform(F.concat(firsts, F.array(n)), lambda t: F.struct(F.get(owner, t - min_words).alias("b"), F.get(owner, t - 1).alias("e")))
            both = F.array_distinct(F.filter(F.concat(onward, upto), lambda s: s["b"] < s["e"]))
            return F.when(n >= min_words, both)

        def digest(s: Column) -> Column:
            own = F.slice(lines, s["b"] + 1, s["e"] - s["b"] + 1)
            return F.unhex(F.sha2(F.array_join(F.transform(own, lambda x: x["d"]), ""), 256))

        return F.transform(let(owner, ends), lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), digest(s).alias("d")))

    line = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.sha2(x, 256).alias("d"), F.regexp_count(x, F.lit(WORD_END)).alias("w")))
    return let(line, build)


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """_gone_id, _t, b, e: windows that stood earlier in the corpus, at a place that they don't overlap."""
    some = docs.where(F.instr("text", "\n") > 0).select(F.col("doc_id").alias("_gone_id"), F.xxhash64("text").alias("_t"), F.explode(windows(F.col("text"), min_words)).alias("s"))
    spans = cut(some.select("_gone_id", "_t", "s.b", "s.e", "s.d"), "windows")
    first = spans.groupBy("d").agg(F.min(F.struct("_gone_id", "_t", "b")).alias("first"), F.count("*").alias("n"))
    first = cut(first.where("n > 1").select("d", "first"), "windows-repeated")
    here = F.col("first._gone_id").eqNullSafe(F.col("_gone_id")) & (F.col("first._t") == F.col("_t")) & (F.col("b") <= F.col("first.b") + F.col("e") - F.col("b"))
    return spans.join(first, "d").where(~here).select("_gone_id", "_t", "b", "e")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, divisor: int = DIVISOR) -> DataFrame:
    """docs with the text that remains, and _n_lines, _removed_lines, _removed_words.

    Of equal chunks (byte for byte) the one of the smallest (doc_id, place) stays. The chunk texts themselves are
    grouped, so bytes decide what is repeated; afterwards a repeated text is named by its hash and its MD5 digest. Of
    equal windows, by their SHA-256 digests, the one of the smallest (doc_id, place) and those that overlap it stay.
    A null text stays null, an empty text empty; rows with a null doc_id stay whole and come first; rows that repeat
    doc_id and text are one document and keep the same lines; an empty table gives an empty result; columns of docs that
    have one of the new names are replaced, others are kept, whatever they are called. Texts of any length are cut whole.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in NEW])
    gone, gone_id, digest, kept, new = spare([*docs.columns, *NEW], "_gone", "_gone_id", "_t", "_kept", "_new")
    narrow = docs.select("doc_id", "text")
    heavy = F.explode(F.filter(chunks(F.col("text"), min_lines, min_words, divisor), lambda c: c["heavy"])).alias("c")
    found = narrow.select("doc_id", heavy).select("doc_id", F.col("c.k").alias("k"), F.col("c.text").alias("chunk"), F.xxhash64("c.text").alias("h"))
    by_text = found.groupBy("h", "chunk").agg(F.min(F.struct("doc_id", "k")).alias("first"), F.count("*").alias("n"))
    by_text = by_text.withColumn("wide", F.md5("chunk")).select("h", "wide", "first", "n")
    repeated = cut(by_text.where("n > 1").select("h", "wide", "first", "n"), "chunks-repeated")
    again = repeated_windows(narrow, min_words)
    if not repeated.isEmpty():
        places = narrow.select("doc_id", F.xxhash64("text").alias("_t"), heavy)
        places = places.select("doc_id", "_t", "c.k", "c.b", (F.col("c.b") + F.col("c.n_lines") - 1).alias("e"), F.xxhash64("c.text").alias("h"), F.md5("c.text").alias("wide"))
        places = places.join(repeated.select("h", "wide", "first"), ["h", "wide"])
        places = places.where(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.k") == F.col("k"))))
        again = again.union(places.select("doc_id", "_t", "b", "e"))
    removed = again.groupBy(F.col("_gone_id").alias(gone_id), F.col("_t").alias(digest)).agg(F.collect_set(F.struct("b", "e")).alias(gone))
    joined = docs.join(removed, (docs["doc_id"] == F.col(gone_id)) & (F.xxhash64(docs["text"]) == F.col(digest)), "left").drop(gone_id, digest)

    def remaining(lines: Column) -> Column:
        out = F.flatten(F.transform(gone, lambda s: F.sequence(s["b"], s["e"])))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out), lambda i: F.get(lines, i))

    joined = joined.withColumn(kept, F.when(F.col(gone).isNotNull(), let(F.split("text", "\n", -1), remaining)))
    joined = joined.withColumn(new, F.array_join(kept, "\n"))
    n_lines, n_words = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)), lambda c: F.regexp_count(c, F.lit(WORD_END))
    return joined.withColumns(
        {
            "_n_lines": n_lines.cast("long"),
            "_removed_lines": F.when(F.col(gone).isNull(), 0).otherwise(n_lines - F.size(kept)).cast("long"),
            "_removed_words": F.when(F.col(gone).isNull(), 0).otherwise(n_words(F.col("text")) - n_words(F.col(new))).cast("long"),
            "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.col(new)),
        }
    ).drop(gone, kept, new)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_removed_lines").alias("removed_lines"), F.col("_removed_words").alias("removed_words"), "text")
