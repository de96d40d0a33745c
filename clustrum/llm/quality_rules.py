"""Quality rules: an ordered decision list over text statistics, learned by sequential covering.

Statistics are Spark expressions. The list is grown on the driver from the statistics of a bounded sample of labelled
documents (conjunctions of thresholds, grown by information gain and pruned on held-out rows, as in Cohen 1995), and
applied to all documents as one nested CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import first_by_hash, read_table
from .textkit import WORD_END

#: Labelled documents that a list is learned from, at most: those of the smallest id hashes.
SAMPLE = 4000
#: Conditions of a rule and rules of a list, at most; thresholds tried for each feature.
MAX_CONDITIONS, MAX_RULES, THRESHOLDS = 4, 12, 24
#: A rule must be right on this share of the pruning rows that it covers.
MIN_PRECISION = 0.85
#: The repeated windows are of five words.
WINDOW = 5

FEATURES = ("n_words", "mean_word", "symbols_per_word", "upper_share", "dup_line_share", "repeat_share", "marks_per_word", "digits_share", "short_share")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, at_least, threshold); a document that meets it is of low quality."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, at_least, t in self.conditions:
            out &= (x[name] >= t) if at_least else (x[name] < t)
        return out


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in five-word windows that the text has twice or more, the first included.

    Windows are known by their 64-bit hashes. Texts whose hashes are distinct are done; elsewhere (hash, place) is
    sorted, equal neighbours are repeated windows, and the words they cover are counted along their places.
    """

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
            return F.sort_array(F.transform(same, lambda e: e["i"]))

        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, lambda s: F.aggregate(places(s), start, step)["n"]))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, let(windows, covered)).otherwise(F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with struct column _q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and more (long).

    A null text counts as an empty one: no words, so all counts are 0. Texts are read whole, whatever their length.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_END))
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            count(r"[#*$%&|<>]").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(words).cast("long").alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"), count(r"[A-Z]").alias("n_upper"),
            count(r"[!?;]").alias("n_marks"), count(r"[0-9]").alias("n_digits"), F.size(F.filter(words, lambda w: F.length(w) <= 2)).cast("long").alias("n_short"),
        )

    return docs.withColumn("_q", let(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), of))


def features(q: Column) -> dict[str, Column]:
    """The features of FEATURES from the counts; shares of nothing are 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "n_words": q["n_words"].cast("double"), "mean_word": ratio(q["word_chars"], q["n_words"]), "symbols_per_word": ratio(q["n_symbols"], q["n_words"]),
        "upper_share": ratio(q["n_upper"], q["word_chars"]), "dup_line_share": ratio(q["n_dup_lines"], q["n_lines"]), "repeat_share": ratio(q["n_repeat_words"], q["n_words"]),
        "marks_per_word": ratio(q["n_marks"], q["n_words"]), "digits_share": ratio(q["n_digits"], q["word_chars"]), "short_share": ratio(q["n_short"], q["n_words"]),
    }


def _gain(pos: int, neg: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    before = np.log2(max(pos, 1) / max(pos + neg, 1))
    return np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - before), -np.inf)


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> list[tuple[str, bool, float]]:
    rule: list[tuple[str, bool, float]] = []
    inside = np.ones(len(y), bool)
    while len(rule) < MAX_CONDITIONS and (~y[inside]).any():
        pos, neg = int(y[inside].sum()), int((~y[inside]).sum())
        best = (1e-9, None)
        for name in FEATURES:
            v = x[name][inside]
            own = y[inside]
            seen = np.unique(v)
            if len(seen) < 2:
                continue
            near = np.searchsorted(seen, np.quantile(v[own], np.linspace(0, 1, THRESHOLDS), method="nearest"))
            near = np.unique(np.concatenate((near, near - 1)).clip(0, len(seen) - 2))
            cuts = (seen[near] + seen[near + 1]) / 2  # half-way to the next value that was seen
            for at_least in (True, False):
                met = v[:, None] >= cuts[None, :] if at_least else v[:, None] < cuts[None, :]
                p, n = met[own].sum(0), met[~own].sum(0)
                gain = _gain(pos, neg, p, n)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), (name, at_least, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = Rule(tuple(rule)).covers(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The ordered rules for low quality: grow on two thirds, prune on the rest, remove what is covered, repeat."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < MAX_RULES and (left & bad & ~third).sum() >= 3:
        grow, prune = left & ~third, left & third
        conditions = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not conditions:
            break
        px, py = {k: v[prune] for k, v in x.items()}, bad[prune]

        def worth(k: int, conditions=conditions, px=px, py=py) -> tuple[float, int]:
            met = Rule(tuple(conditions[:k])).covers(px)
            p, n = int((py & met).sum()), int((~py & met).sum())
            return ((p - n) / (p + n) if p + n else -1.0), -k

        k = max(range(1, len(conditions) + 1), key=worth)
        rule = Rule(tuple(conditions[:k]))
        met = rule.covers({k: v[left] for k, v in x.items()})
        held = rule.covers(px)
        if not held.any() or py[held].mean() < MIN_PRECISION or bad[left][met].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left[np.flatnonzero(left)[met]] = False
    return rules


def verdict(rules: list[Rule], found: dict[str, Column]) -> tuple[Column, Column]:
    """(kept, number of the rule that decided or null): the first rule that is met rejects, else the document is kept."""
    kept, which = F.lit(True), F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        met = F.lit(True)
        for name, at_least, t in rule.conditions:
            met = met & ((found[name] >= F.lit(t)) if at_least else (found[name] < F.lit(t)))
        kept, which = F.when(met, F.lit(False)).otherwise(kept), F.when(met, F.lit(i)).otherwise(which)
    return kept, which


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from (doc_id, text) and (doc_id, quality: 0 is low); at most `sample` labelled rows, by the hash of the id.

    Null labels and ids are left out; a doc_id that repeats counts once, at its lowest quality. Without labels of both
    kinds there are no rules, so all that the base filter keeps is kept.
    """
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = first_by_hash(label, "doc_id", sample, label.count()).toPandas()
    if some["quality"].nunique() < 2:
        return []
    quality = dict(zip(some["doc_id"].tolist(), some["quality"].tolist(), strict=True))
    chosen = docs.sparkSession.createDataFrame([(i,) for i in sorted(quality)], label.select("doc_id").schema)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    rows = rows.select("doc_id", *(c.alias(k) for k, c in features(F.col("_q")).items()), F.col("_q.n_words").alias("_n"), F.col("_q.n_repeat_words").alias("_r"))
    # one row an id comes to the driver, however often it repeats
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*rows.columns[1:])).alias("s")).select("doc_id", "s.*").toPandas().sort_values("doc_id")
    rows = rows[(rows["_n"] >= 10) & (100 * rows["_r"] <= 20 * rows["_n"])]  # the base filter has the others
    bad = rows["doc_id"].map(quality).to_numpy() == 0
    order = np.random.default_rng(0).permutation(len(rows))
    return learn({k: rows[k].to_numpy(float)[order] for k in FEATURES}, bad[order])


def quality_filter(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with _q, base_failed, kept, rule. Rows that repeat or lack a doc_id are judged alike, by their text alone;
    an empty table gives an empty result; columns of docs that have one of the new names are replaced, others are kept."""
    rules = train(docs, labels, sample)
    out = statistics(docs)
    q = F.col("_q")
    base_failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    kept, which = verdict(rules, features(q))
    return out.withColumns({"base_failed": base_failed, "kept": ~base_failed & kept, "rule": which})


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_filter(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", *(F.col(f"_q.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept", "rule")
