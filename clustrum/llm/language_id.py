"""Language ID: nearest of several centroids per language among normalised TF-IDF vectors of letter n-grams.

A text too far from its nearest centroid is rejected. How far that is depends on the language and on the text's length: the
limit lies between the language's own texts, whole and begun, and texts whose letters are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import hash_place, read_table, sample_bound, ship, worker_tables
from .textkit import blocks

#: Labelled documents that a model is fitted on: at most so many in all and for each language, by the hash of the id.
SAMPLE, PER_LANGUAGE = 8000, 400
#: Languages, at most (the most frequent ones in the labels), so that each has eight documents of the sample; centroids for each.
LANGUAGES, CENTROIDS = SAMPLE // 8, 4
#: Hashed n-grams of 2 and 3 bytes.
DIMENSIONS, ORDERS = 4096, (2, 3)
#: A limit of rejection is set for each language and number of n-grams, from texts of the sample, begun texts of so many
#: characters, and the same with their letters shuffled; for so many texts of a kind at least.
LENGTHS, BEGUN, ENOUGH = (30, 100, 300, 1000), (15, 40, 120, 400), 20
#: One in so many texts of the sample serves for that; where the limit lies on the way from nearly all shuffled texts (99 %)
#: to nearly none of the language's own (0.2 %), and the share of the worst own one where those overlap.
TRIED, BETWEEN, SLACK = 4, 0.3, 0.9
UNKNOWN = "und"

_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 0x100)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Of each centroid its language's place in languages.
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    #: Cosine below which a text is rejected, by language and by the place of its n-grams' number in LENGTHS.
    limit: np.ndarray


def counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x DIMENSIONS counts of hashed n-grams). Case is folded, all but letters counts as one blank."""
    folded = pa.array([t.lower().encode("utf-8", "ignore") if t else b"" for t in texts], pa.large_binary())
    for row, raw, offs in blocks(folded, 1 << 20):
        n = len(offs) - 1
        line = _KEEP[raw].astype(np.uint32)
        owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
        total = np.zeros(n * DIMENSIONS, np.int64)
        for order in ORDERS:
            m = len(line) - order + 1
            if m <= 0:
                continue
            code = np.zeros(m, np.uint32)
            for k in range(order):
                code = (code << np.uint32(8)) | line[k : k + m]
            inside = owner[:m] == owner[order - 1 :]
            # an n-gram of two blanks side by side says nothing: runs of other characters count once
            inside &= (line[:m] != 0x20) | (line[1 : m + 1] != 0x20)
            slot = ((code * np.uint32(2654435769) + np.uint32(order * 0x51ED27)) >> np.uint32(20)) % np.uint32(DIMENSIONS)
            total += np.bincount(owner[:m][inside] * DIMENSIONS + slot[inside], minlength=n * DIMENSIONS)
        yield row, total.reshape(n, DIMENSIONS)


def _weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf.astype(np.float32)) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def shuffled(text: str, seed: int) -> str:
    """The text with its letters in a random order, all else in place: letters of a language that make no language."""
    letters = [c for c in text if c.isalpha()]
    order = iter(np.random.default_rng(seed).permutation(len(letters)).tolist())
    return "".join(letters[next(order)] if c.isalpha() else c for c in text)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, lang, kind, tf: of each text (doc_id, text, lang) its counts (kind 0); of some also those of its beginnings
    (1) and of these, and of itself, with letters shuffled (2)."""
    for whole in batches:
        for a in range(0, whole.num_rows, 200):
            rows = []
            for doc, text, lang in zip(*(c.slice(a, 200).to_pylist() for c in whole.columns), strict=True):
                rows.append((doc, lang, 0, text))
                if text and zlib.crc32(str(doc).encode()) // 4 % TRIED == 0:
                    begun = [text[:n] for n in BEGUN if len(text) > n]
                    rows += [(doc, lang, 1, t) for t in begun] + [(doc, lang, 2, shuffled(t, len(t))) for t in (*begun, text)]
            for row, tf in counts([r[3] for r in rows]):
                part = rows[row : row + len(tf)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string()), pa.array([r[2] for r in part], pa.int32()), pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in tf], pa.binary())],
                    ["doc_id", "lang", "kind", "tf"],
                )


def _limit(own: np.ndarray, odd: np.ndarray) -> float:
    """A cosine that parts a language's texts from shuffled ones, so low that its own texts pass."""
    if len(own) < ENOUGH:
        return 0.0
    low = float(np.quantile(own, 0.002))
    high = float(np.quantile(odd, 0.99)) if len(odd) >= ENOUGH else 0.0
    return high + BETWEEN * (low - high) if low > high else SLACK * float(own.min())


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """Spherical k-means with k-means++ seeds."""
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, min(k, len(x))):
        far = np.maximum(1 - (x @ np.array(centres).T).max(1), 0)
        centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[0])
    c = np.array(centres)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            own = x[near == j].sum(0)
            if (norm := np.linalg.norm(own)) > 0:
                c[j] = own / norm
    return np.unique(c, axis=0)


def fit(docs: DataFrame, train: Column, seed: int = 11) -> Model | None:
    """A model from (doc_id, text, lang) where `train` holds and lang isn't null; None if no text has a letter. Rows
    without doc_id aren't drawn; a doc_id that repeats counts once."""
    labelled = docs.where(train & F.col("lang").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    top = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not top:
        return None
    quota = max(8, min(PER_LANGUAGE, SAMPLE // len(top)))
    order = Window.partitionBy("lang").orderBy(hash_place("doc_id"), "doc_id")
    bound = F.create_map(*(F.lit(x) for lang, n in sorted(top.items()) for x in (lang, sample_bound(quota, n))))
    few = labelled.where(hash_place("doc_id") < F.try_element_at(bound, F.col("lang"))).select("lang", "doc_id")
    ids = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= quota)
    chosen = ids.select("doc_id").where("doc_id is not null").distinct()
    own = labelled.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").mapInArrow(_sample_rows, "doc_id long, lang string, kind int, tf binary")
    # one text an id comes to the driver, and one of each of its beginnings, however often it repeats
    n_grams = F.when(F.col("kind") > 0, F.length("tf") + F.xxhash64("tf") % 100_000).otherwise(F.lit(0))
    rows = own.groupBy("doc_id", "kind", n_grams.alias("which")).agg(F.min(F.struct("lang", "tf")).alias("s")).select("kind", "s.lang", "s.tf").toPandas()
    if rows.empty:
        return None
    every, kind = np.stack([np.frombuffer(x, np.uint16) for x in rows["tf"]]), rows["kind"].to_numpy()
    tf, lang = every[kind == 0], rows["lang"].to_numpy()[kind == 0]
    filled = tf.any(1)
    order = np.lexsort((tf[:, :64].sum(1), tf.sum(1), lang))  # the same rows in the same order, however they came
    order = order[filled[order]]
    tf, lang = tf[order], lang[order]
    if not len(tf):
        return None
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    x = _weigh(tf, idf)
    rng = np.random.default_rng(seed)
    names, owner, centres, limit = [], [], [], []
    for name in sorted(set(lang.tolist())):
        own = x[lang == name]
        c = _cluster(own, CENTROIDS, rng)
        owner += [len(names)] * len(c)
        centres.append(c)
        names.append(name)
    centroids = np.concatenate(centres).astype(np.float32)
    # limits: the sample's own texts, whole and begun, and shuffled ones of all languages, which a language is to reject
    length, spoken, x = np.searchsorted(LENGTHS, every.sum(1), "right"), rows["lang"].to_numpy(), _weigh(every, idf)
    odd = (x[kind == 2] @ centroids.T).max(1) if (kind == 2).any() else np.zeros(0)
    for name, c in zip(names, centres, strict=True):
        true = (kind < 2) & (spoken == name) & every.any(1)
        near = (x[true] @ c.T).max(1)
        limit.append([_limit(near[length[true] == k], odd[length[kind == 2] == k]) for k in range(len(LENGTHS) + 1)])
    return Model(tuple(names), np.array(owner), centroids, idf, np.array(limit))


def _predict(batches: Iterator[pa.RecordBatch], at: int, shared) -> Iterator[pa.RecordBatch]:
    worker_tables("language")
    model: Model | None = shared.value
    for whole in batches:
        for a in range(0, whole.num_rows, 500):
            batch = whole.slice(a, 500)
            texts = batch.column(at).to_pylist()
            best, score, passed = [], [], []
            for row, tf in counts(texts) if model else ():
                cosine = _weigh(tf, model.idf) @ model.centroids.T
                near = cosine.argmax(1)
                value = cosine[np.arange(len(near)), near].clip(0, 1)
                length = np.searchsorted(LENGTHS, tf.sum(1), "right").tolist()
                for t, j, v, k in zip(texts[row : row + len(tf)], model.owner[near].tolist(), value.tolist(), length, strict=True):
                    known = has_letter(t)
                    best.append(model.languages[j] if known else UNKNOWN)
                    score.append(v if known else 0.0)
                    passed.append(known and v >= model.limit[j, k])
            if not model:
                best, score, passed = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            new = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(passed, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [str(i) for i in range(len(batch.columns) + 3)])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (cosine, 0 to 1) and lang_accepted.

    A null text, and one without a letter, is `und` with score 0 and rejected; so is every text if there is no model.
    Of equally near languages the first in code-point order is taken. Texts count whole; repeated rows are predicted
    alike; an empty table gives an empty result; columns of docs that have one of the new names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score", "lang_accepted")])
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text)
    schema = T.StructType(list(docs.schema)).add("lang_pred", "string").add("lang_score", "double").add("lang_accepted", "boolean")
    return docs.mapInArrow(lambda b: _predict(b, at, shared), schema)


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out())
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))
