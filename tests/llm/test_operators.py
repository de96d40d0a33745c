"""Corpus operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

import datetime as dt
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from clustrum.llm import language_id, line_dedup, mixing, nearest, ngram_join, piece_bpe, quality_rules, registry, textkit, token_files, toxicity, url_filter
from clustrum.llm import components as cc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _copies string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None, source="s"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", source, 0, "clash") for i, t in zip(ids, texts, strict=True)], DOCS)


def words_of(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)}


def near_copies(seed, n_groups=12, group=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 80))]
        for _ in range(group):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own).upper() if rng.random() < 0.3 else "\t".join(own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("block", "hot_from"), [(500_000, 4), (300, 4), (60, 2), (300, 10**6)])
def test_ngram_join_against_brute_force(spark, monkeypatch, block, hot_from):
    """Whole groups, groups over a few blocks and over many, with and without frequent shingles known beforehand."""
    for name, value in (("BLOCK", block), ("BLOCKS", 1), ("HUBS", 1 if block == 60 else 3), ("HOT_FROM", hot_from), ("CHUNK", 900), ("WINDOW", 900), ("LOCAL_HOT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = [*near_copies(1), *near_copies(5, 2, 60), "", " \n", "one two", "ONE  two", "one two three", "a b c d e", "a b c d e"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, texts)).collect()}
    assert got == brute_components(rows)


def test_ngram_join_near_the_limit(spark, monkeypatch):
    """Chains of texts that are linked with the next ones only, and pairs at the very limit."""
    monkeypatch.setattr(ngram_join, "BLOCK", 100)
    monkeypatch.setattr(ngram_join, "BLOCKS", 1)
    rng = random.Random(2)
    texts = []
    for _ in range(6):
        w = [f"c{rng.randrange(10**6)}" for _ in range(60)]
        for step in range(25):
            texts.append(" ".join(w))
            at = rng.randrange(60)
            w = [*w[:at], f"n{rng.randrange(10**6)}", *w[at + rng.randint(0, 2) :]]
        texts += [" ".join(w[i:]) for i in range(1, 18)]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_divide_skip_against_counting():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 25))) for _ in range(rng.randint(1, 30))]
        least, out = rng.randint(1, 12), {rng.randrange(40)}
        count = Counter(i for x in lists for i in x)
        got = list(ngram_join.divide_skip(lists, least, lambda j: least + j % 3, out.__contains__))
        assert got == sorted(j for j, c in count.items() if c >= least + j % 3 and j not in out)


def test_ngram_join_edges(spark):
    out = ngram_join.jaccard_components(docs(spark, ["x y", None, "x y", "x y", "q"], [5, 3, None, 4, 4])).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == Counter([(5, 1, 4), (3, 0, 3), (None, 1, None), (4, 1, 4), (4, 1, 4)])
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    long = " ".join(str(i) for i in range(30_000))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs(spark, [long, long + " end", "z"])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_ngram_join_text_first_met_without_id(spark):
    t = "one two three four five six seven"
    rows = docs(spark, [t, t, t + " eight", "q"], [None, 4, 5, 6]).coalesce(1)
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(rows).collect())
    assert got == Counter([(None, None), (4, 4), (5, 4), (6, 6)])


def test_components_both_ways(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "u long, v long")
    small = {r["node"]: r["component"] for r in cc.components(df).collect()}
    large = {r["node"]: r["component"] for r in cc.components(df, one_task_edges=0).collect()}
    assert small == large and small[1049] == 1000 and small[2040] == 2000
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_text_kit():
    texts = ["The CAT sat", None, "", "the cat\tsat", "x" * 3_000_000, "é É"]
    rows = dict(textkit.shingle_rows(pa.array(texts)))
    assert [len(rows[i]) for i in range(6)] == [1, 0, 0, 1, 1, 1]
    assert rows[0][0] == rows[3][0]
    many = [" ".join(random.Random(i).choices(["a", "b", "cc", "D"], k=i)) for i in range(60)]
    assert [len(s) for _, s in textkit.shingle_rows(pa.array(many))] == [len(shingles(t)) for t in many]


def test_line_dedup(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    many = [f"line {i} of the shared block" for i in range(30)]
    block = "\n".join(many)
    texts = [f"first own\n{passage}\ntail", f"other\n{passage}", "short\nrepeat", "short\nrepeat", None, "", f"head\n{block}\nend one", f"start\nmore\n{block}\nend two", "clean text"]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert out[0]["text"] == texts[0] and out[1]["text"] == "other" and out[1]["_removed_words"] == 55
    assert out[4]["text"] is None and out[5]["text"] == "" and out[8]["text"] == "clean text"
    assert out[6]["text"] == texts[6]
    left = out[7]["text"].split("\n")
    assert left == ["start", "more", "end two"]
    assert all(r["_copies"] == "clash" for r in out.values())


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_chunks(text):
    """(text, compared) of each chunk, from the definition: lines cut where the hash of two line hashes says so."""
    lines = text.split("\n")
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in lines]
    words = [len(WORD.findall(x)) for x in lines]
    out, begin = [], 0
    for i in range(len(lines)):
        before = hashes[max(i - 1, 0)]
        rolled = ((before << 1 | before >> 63) & (2**64 - 1)) ^ hashes[i]
        cut = signed(xxhash.xxh64(rolled.to_bytes(8, "little"), seed=42).intdigest()) % line_dedup.DIVISOR == 0
        if cut or i == len(lines) - 1 or words[i] >= line_dedup.MIN_WORDS or words[i + 1] >= line_dedup.MIN_WORDS:
            n = sum(words[begin : i + 1])
            out.append(("\n".join(lines[begin : i + 1]), n > 0 and (i + 1 - begin >= line_dedup.MIN_LINES or n >= line_dedup.MIN_WORDS)))
            begin = i + 1
    return out


def test_line_dedup_against_definition(spark):
    rng = random.Random(5)
    pool = [f"common line {i}" for i in range(12)] + ["", "é ü", "w " * 55]
    texts = ["\n".join([f"own start {d}", *rng.choices(pool, k=rng.randint(1, 9)), f"own {d}"]) for d in range(60)]
    seen, want = set(), {}
    for d, text in enumerate(texts):
        found = brute_chunks(text)
        assert "\n".join(t for t, _ in found) == text
        keep = []
        for t, compared in found:
            if not compared or t not in seen:
                keep.append(t)
            if compared:
                seen.add(t)
        want[d] = "\n".join(keep)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    # windows of 50 words may take more from a text, never less
    short = [d for d, t in enumerate(texts) if "w w" not in t]
    assert len(short) > 20 and all(got[d] == want[d] for d in short) and got != dict(enumerate(texts))
    assert all(len(got[d]) <= len(want[d]) for d in got)


def test_line_dedup_passages_of_short_lines(spark):
    """A repeated passage of 50 words or more goes whole, however it is broken into lines and whatever stands around it."""
    rng = random.Random(9)
    texts, own = [], []
    for p in range(40):
        sizes = [(30, 25), (20, 20, 20), (49, 1, 10), (1, 49), (12, 12, 12, 12, 12), (49, 49, 3), (10, 60, 5), (17, 0, 17, 17)][p % 8]
        passage = "\n".join(" ".join(f"w{rng.randrange(10**9)}" for _ in range(n)) for n in sizes)
        for _ in range(2):
            before, after = (["x" + str(rng.randrange(10**9))] * rng.randint(1, 3) for _ in range(2))
            texts.append("\n".join([*before, passage, *after]))
            own.append("\n".join([*before, *after]))
    short = "\n".join(f"lone{i} " * 5 for i in range(3))
    texts += [short + "\nunlike", "other\n" + short]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    for i in range(80):
        assert out[i]["text"] == (own[i] if i % 2 else texts[i])
    assert out[1]["_removed_lines"] == 2 and out[1]["_removed_words"] == 55
    # a line that repeats keeps one window of itself
    many = line_dedup.dedup_lines(docs(spark, ["\n".join(f"start{i} own{i}" for i in range(2)) + "\n" + "\n".join(["ten " * 10] * 3)])).collect()
    assert many[0]["text"].count("ten") >= 10
    # without a repeat nothing goes; rows that repeat doc_id and text are alike
    assert all(r["_removed_lines"] == 0 for r in line_dedup.dedup_lines(docs(spark, texts[:80:2])).collect())
    same = line_dedup.dedup_lines(docs(spark, [texts[0], texts[1], texts[1]], [1, 2, 2])).collect()
    assert [r["text"] for r in sorted(same, key=lambda r: r["doc_id"])] == [texts[0], own[1], own[1]]


def test_line_dedup_clashing_names(spark):
    wide = " ".join(f"p{i}" for i in range(60))
    names = ["_gone", "_GONE_ID", "_new", "_kept", "_t", "c", "k", "h", "_n_lines"]
    df = spark.createDataFrame([(i, wide, *names) for i in range(2)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [wide, ""] and [r["_n_lines"] for r in out] == [1, 1]
    assert all(r[c] == c for r in out for c in names[:-1])


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    wide = " ".join(["word"] * 60)
    out = line_dedup.dedup_lines(docs(spark, [wide, wide, wide], [7, None, 7])).collect()
    assert {(r["doc_id"], r["text"]) for r in out} == {(None, wide), (7, "")}


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), f"s{i % 4}" if i % 5 else None) for i in range(400)] + [(400, None, "s0"), (401, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(df).collect()
    by = defaultdict(list)
    for r in plan:
        by[r["source"]].append(r)
    total = sum(r["_size"] for r in plan)
    assert abs(sum(v[0]["_target"] for v in by.values()) - total) < 1e-6
    for own in by.values():
        assert own[0]["_target"] <= 3 * own[0]["_source_size"] + 1e-9 and all(r["_copies"] <= 3 for r in own)
        taken = sum(r["_size"] * r["_copies"] for r in own)
        assert abs(taken - own[0]["_target"]) <= 6 * np.sqrt(sum(r["_size"] ** 2 for r in own)) + 1e-9
    again = {r["doc_id"]: r["_copies"] for r in mixing.mix_plan(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["_copies"] for r in plan}
    assert mixing.emit(mixing.mix_plan(df)).count() == sum(again.values())
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_mixing_without_ids(spark):
    """Rows that lack or share a doc_id draw for themselves, so each source comes near its target."""
    for ids in (lambda i: None, lambda i: 7, lambda i: i % 3):
        rows = [(ids(i), "w w " + ("same" if i % 2 else f"t{i}"), f"s{i % 2}", 5, "x", "y") for i in range(3000)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, _of int, _SIZE string, _drawn_by string").repartition(4).cache()
        plan = mixing.mix_plan(df)
        assert {"_of", "_size", "_drawn_by"} <= set(plan.columns) and "_SIZE" not in plan.columns
        for r in plan.groupBy("source").agg(F.max("_target").alias("t"), F.sum(F.col("_size") * F.col("_copies")).alias("n")).collect():
            assert abs(r["n"] - r["t"]) < 0.1 * r["t"]
        assert mixing.emit(plan).columns == ["doc_id", "text", "source", "_of", "_drawn_by"]


def water_fill(sizes, weights, cap=3):
    left, target = dict(weights), {}
    rest = float(sum(sizes.values()))
    while left:
        level = rest / sum(left.values())
        full = [s for s in left if cap * sizes[s] <= level * left[s]]
        if not full:
            return target | {s: level * w for s, w in left.items()}
        for s in full:
            target[s] = float(cap * sizes[s])
            rest -= target[s]
            del left[s]
    return target


def test_targets_against_iteration(spark):
    rng = random.Random(9)
    for _ in range(3):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 40, 900]) for i in range(9)}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = water_fill(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))})
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_pieces_against_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    ours, library = piece_bpe.PieceEncoder(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    letters = [*"abcdefghijklmnop    \n\t▁éüñ漢字🙂\x00\x1c.,!?0123456789ABC", "▁▁", "<s>", "<0x0A>", "the", " "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)] + [" " * n + x for n in range(40) for x in ("", "a")] + ["ab" * 5000]
    for t in texts:
        assert ours.encode(t) == library.encode(t), t
        assert "".join(s for s in [ours.decoder.decode(ours.encode(t))]) == library.decode(library.encode(t))


def test_pieces_query_form(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = docs(spark, ["Hello world", None, "", "Hello world"], [1, None, 2, 1])
    out = piece_bpe.encode(df, path, digests=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["n_tokens"], r["decoded_sha256"]) for r in out if r["doc_id"] is None] == [(0, empty)]
    one = next(r for r in out if r["doc_id"] == 1)
    assert one["decoded_sha256"] == hashlib.sha256(b"Hello world").hexdigest()
    real = piece_bpe.encode(df, path).where("doc_id = 1").first()
    assert hashlib.sha256(",".join(map(str, real["ids"])).encode()).hexdigest() == one["ids_sha256"] and real["decoded"] == "Hello world"
    assert piece_bpe.encode(df.limit(0), path).count() == 0


def test_token_ids_against_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(6)
    letters = [*"abcdefg    \n\t\x85​́éü漢🙂\x00\x1c.,!?'s0123ABC", "<|endoftext|>", "the", " "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(5000)] + [" " * k for k in range(4)] + [None, "a \x00b"]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext"]
    got = token_files._Coder(open(path, "rb").read()).encode(texts)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(b, np.uint16).tolist() for b in got] == want


@pytest.mark.parametrize("dtype", [np.uint16, np.uint32])
def test_re_pair_round_trip(dtype):
    rng = np.random.default_rng(8)
    parts = [rng.integers(0, 5, n).astype(dtype) for n in (0, 1, 700, 3, 0, 2000)] + [np.zeros(500, dtype), np.array([50_000] * 9, dtype)]
    parts = [p for p in parts for _ in range(2)]
    ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    shard = token_files.Shard(token_files.pack([None, *range(1, len(parts))], ids, ends, 50_257))
    assert len(shard.rules) > 10 and len(shard.symbols) < len(ids) * 0.6
    back = list(shard.documents())
    assert back[0][0] is None and all(np.array_equal(a, b) for (_, a), b in zip(back, parts, strict=True))
    assert all(np.array_equal(shard.document(i), p) for i, p in enumerate(parts))
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids), 2))
        assert np.array_equal(shard.tokens(a, b), ids[a:b])
    for r, n in zip(shard.rules, shard.lengths, strict=True):
        assert n == len(shard.expand(r))


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["some words here " * 40, None, "", "z", "some <|endoftext|> words"]
    df = docs(spark, texts, [3, 9, 2, None, 3]).repartition(3)
    token_files.write(df, str(tmp_path / "t"), path, shard_tokens=50)
    got = [tuple(r) for r in token_files.read_index(spark, str(tmp_path / "t")).orderBy("start").collect()]
    start, want = 0, []
    for i in (3, 2, 4, 0, 1):  # null first, then by id and text
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        want.append(([3, 9, 2, None, 3][i], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    token_files.write(df.limit(0), str(tmp_path / "e"), path)
    assert token_files.read_index(spark, str(tmp_path / "e")).count() == 0


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choices(["a", "b", "c", "é#"], k=rng.randint(0, 9))) for _ in range(rng.randint(1, 8))) for _ in range(150)]
    texts += [None, "", "a b c d e a b c d e", "a a a a a a", " \n \n x\n x", "w " * 20_000]
    got = quality_rules.statistics(docs(spark, texts)).orderBy("doc_id").select("_q.*").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r, t in zip(got, texts, strict=True):
        assert tuple(r[c] for c in names) == brute_statistics(t), t


def test_decision_list(spark):
    rng = np.random.default_rng(1)
    n = 900
    x = {f: rng.random(n) for f in quality_rules.FEATURES}
    bad = ((x["symbols_per_word"] > 0.7) & (x["mean_word"] < 0.6)) | (x["upper_share"] > 0.9)
    rules = quality_rules.learn(x, bad)
    found = np.any([r.covers(x) for r in rules], 0)
    assert len(rules) >= 2 and (found == bad).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, (x[f][i] for f in quality_rules.FEATURES))) for i in range(n)], list(quality_rules.FEATURES))
    kept, which = quality_rules.verdict(rules, {f: F.col(f) for f in quality_rules.FEATURES})
    assert [not r["kept"] for r in df.select(kept.alias("kept"), which.alias("w")).collect()] == found.tolist()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.quality_filter(docs(spark, []), none).count() == 0
    clash = docs(spark, ["a b"] * 3, [1, 1, None]).selectExpr("*", "1 as _q", "2 as KEPT_")
    again = quality_rules.quality_filter(clash, spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id long, quality int")).collect()
    assert [(r["_q"]["n_words"], r["KEPT_"], r["kept"]) for r in again] == [(2, 2, False)] * 3
    out = quality_rules.quality_filter(docs(spark, [" ".join(f"w{i}" for i in range(12)), "few", None]), none).orderBy("doc_id").collect()
    assert [(r["base_failed"], r["kept"]) for r in out] == [(False, True), (True, False), (True, False)]


def brute_language(text, model):
    """The nearest centroid by loops over the letters' bytes."""
    line = bytes(c if 0x61 <= c < 0x7B or c >= 0x80 else 0x20 for c in text.lower().encode("utf-8", "ignore"))
    tf = np.zeros(language_id.DIMENSIONS)
    for order in language_id.ORDERS:
        for i in range(len(line) - order + 1):
            if line[i] != 0x20 or line[i + 1] != 0x20:
                code = int.from_bytes(line[i : i + order], "big")
                tf[((code * 2654435769 + order * 0x51ED27) % 2**32 >> 20) % language_id.DIMENSIONS] += 1
    x = np.log1p(tf) * model.idf
    cosine = model.centroids @ (x / np.linalg.norm(x))
    return model.languages[model.owner[int(cosine.argmax())]], float(cosine.max())


def test_language_id_against_loops(spark, tables):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    model = language_id.fit(df, ~language_id.held_out())
    got = language_id.predict(df.where("length(text) > 3").orderBy("doc_id").limit(60), model).collect()
    for r in got:
        if language_id.has_letter(r["text"]):
            want = brute_language(r["text"], model)
            assert r["lang_pred"] == want[0] and abs(r["lang_score"] - want[1]) < 1e-4


#: Columns of the ten queries, by their contracts.
CONTRACTS = {
    "op1_url_filter": ("page_id", "blocked"), "op2_ann_search": ("query_id", "rank", "vec_id", "score"), "op3_token_output": ("doc_id", "start", "n_tokens", "ids_crc32"),
    "op4_ngram_join": ("doc_id", "n_shingles", "component_id"), "op5_quality_rules": ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "op6_sentencepiece": ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), "op7_source_mixing": ("doc_id", "size", "source_size", "target", "taken"),
    "op8_language_id": ("doc_id", "held_out", "lang_pred", "score"), "op9_line_dedup": ("doc_id", "text"), "op10_toxicity": ("doc_id", "held_out", "score", "predicted"),
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_return_whole_tables(spark, tables, name):
    out = registry.queries()[name](spark, tables).cache()
    assert set(CONTRACTS[name]) <= set(out.columns)
    whole = spark.read.parquet(f"{tables}/{'pages' if name.startswith('op1_') else 'embeddings' if name.startswith('op2_') else 'documents'}.parquet")
    if name == "op2_ann_search":
        assert out.count() == 5 * whole.where("vec_id % 50 = 0").count() == out.where("score between -1.000001 and 1.000001").count()
    else:
        key = out.columns[0]
        assert out.exceptAll(out.limit(0)).select(key).exceptAll(whole.select(key)).isEmpty() and out.count() == whole.count()
    out.unpersist()


def test_language_id(spark, tables):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    model = language_id.fit(df, ~language_id.held_out())
    out = language_id.predict(df, model).where(language_id.held_out() & (F.length("text") > 40))
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    edge = language_id.predict(docs(spark, [None, "", "12 !?", "the and of that with " * 9]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in edge[:3]] == ["und"] * 3 and not any(r["lang_accepted"] for r in edge[:3])
    assert edge[0]["lang_score"] == 0 and 0 <= edge[3]["lang_score"] <= 1
    # an id that repeats counts once; many languages are all learned
    many = docs(spark, [f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 4} " * 5 for i in range(300)] * 2, list(range(300)) * 2).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    assert len(language_id.fit(many, F.lit(True)).languages) == 300
    assert language_id.predict(docs(spark, []), model).count() == 0
    nothing = docs(spark, ["a"]).withColumn("lang", F.lit(None).cast("string"))
    assert language_id.fit(nothing, F.lit(True)) is None
    assert language_id.predict(nothing, None).first()["lang_pred"] == "und"


def enumerated(w):
    """The subsequences of a word with their weights, by loops."""
    out = defaultdict(float)
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            for k in range(j + 1, len(w)):
                if k - i < toxicity.SPAN:
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def word_kernel(a, b):
    fa, fb = enumerated(a), enumerated(b)
    return sum(v * fb.get(k, 0) for k, v in fa.items()) / np.sqrt(sum(v * v for v in fa.values()) * sum(v * v for v in fb.values()))


def test_string_kernel_against_enumeration():
    known = ["idiot", "worthless", "éàü", "abcabcabc", "aaaa", "abc"]
    words = [*known, "idxiot", "i-d-i-o-t", "wort", "𝔞bcd", "zzz", "a" * 24, "漢字かな"]
    want = [[word_kernel(w, k) for k in known] for w in words]
    assert np.allclose(toxicity.WordKernel(known).against(words), want)
    wide = known + ["".join(map(chr, range(c, c + 5))) for c in range(0x4E00, 0x4F00, 5)]  # more letters than the table takes
    assert np.allclose(toxicity.WordKernel(wide).against(words)[:, : len(known)], want)
    assert toxicity.WordKernel([]).against(words).shape == (len(words), 0)


def test_sentence_kernel_and_map():
    """The kernel of sentences by loops, the map by dense algebra, and what windows add to a margin."""
    common = {"the": 0.1, "lorem": 0.5}
    marks = (("you", "idiot!"), ("the", "worthless", "clown"), ("lorem", "ipsum", "dolor", "sit"))
    landmarks = toxicity.Landmarks(marks, common)

    def sentence_kernel(s, t):
        parts = lambda x: [(common.get(w, 1.0), p) for w in set(x) for p in toxicity.pieces(w)]
        return sum(u * v * word_kernel(a, b) ** toxicity.POWER for u, a in parts(s) for v, b in parts(t))

    dense = np.array([[sentence_kernel(a, b) for b in marks] for a in marks])
    assert np.allclose(toxicity.landmark_matrix(landmarks), dense)
    mapping = toxicity.nystroem(dense)
    assert np.allclose(dense @ mapping @ mapping.T @ dense, dense)
    texts = ["What an idxiot. The lorem ipsum!", None, "", "worthless " * 30, "n i t w i t said", "..."]
    found = dict(toxicity.Valuer(landmarks, mapping).texts(texts))
    for i, t in enumerate(texts):
        cut_text = toxicity.sentences(t)
        parts = [s[a : a + toxicity.WINDOW] for s in cut_text for a in range(0, max(1, len(s) - toxicity.WINDOW // 2), toxicity.WINDOW // 2)]
        want = np.array([[sentence_kernel(p, m) for m in marks] for p in parts]).reshape(len(parts), len(marks)) @ mapping
        assert np.allclose(found[i], want, atol=1e-5), t
    assert toxicity.sentences("n i t w i t said")[0][-1] == "nitwit"


def test_machine_is_optimal():
    rng = np.random.default_rng(4)
    x, weight = rng.normal(size=(300, 6)), rng.random(300) + 0.5
    y = x[:, 0] + 0.3 * rng.normal(size=300) > 0
    w, bias = toxicity.svm(x, y, weight)
    c, sign = weight / weight.mean(), np.where(y, 1, -1)
    loss = lambda w, b: w @ w / 2 + b * b * 5e-7 + (c * np.maximum(1 - sign * (x @ w + b), 0) ** 2).sum()
    assert all(loss(w, bias) <= loss(w + 1e-3 * d[:-1], bias + 1e-3 * d[-1]) for d in rng.normal(size=(200, 7)))
    assert (((x @ w + bias) > 0) == y).mean() > 0.9


def test_toxicity(spark):
    """Held-out documents, insults with letters put in or apart, and texts on the edge."""
    rng = random.Random(11)
    plain = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am", "con", "ver", "tu") for b in ("em", "sum", "or", "eta", "ti", "que")]
    bad = ["blockhead", "scoundrel", "nitwit"]

    def text(toxic):
        own = [" ".join(rng.choices(plain, k=rng.randint(3, 20))) + "." for _ in range(rng.randint(1, 6))]
        if toxic:
            own.insert(rng.randint(0, len(own)), " ".join([*rng.choices(plain, k=rng.randint(0, 5)), rng.choice(bad), *rng.choices(plain, k=2)]) + "!")
        return " ".join(own)

    labels = [(i, int(i % 6 == 0)) for i in range(600)]
    df = docs(spark, [text(t) for _, t in labels])
    some = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df.union(df.limit(50)), some, F.col("doc_id") < 400)
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(df, model).where("doc_id >= 400").collect()}
    right = [(out[i] >= 0.5) == bool(t) for i, t in labels[400:]]
    assert np.mean(right) > 0.97
    rows = [None, "", "lorem ipsum", "you bloxckhead", "a n i t w i t here: n i t w i t", "lorem. " * 3000 + "scoun-drel " * 2 + "lorem. " * 3000, "x" * 100_000]
    extra = docs(spark, [*rows, rows[3]], [*range(7), 3]).selectExpr("*", "'mine' as TOXICITY", "1 as x")
    got = toxicity.score(extra, model).collect()
    score = {r["doc_id"]: r["toxicity"] for r in got}
    assert len(got) == 8 and max(score[i] for i in (0, 1, 2, 6)) < 0.3 and min(score[i] for i in (3, 4, 5)) > 0.5
    assert score[0] == score[1] and len({r["toxicity"] for r in got if r["doc_id"] == 3}) == 1
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.fit(df, some.where("toxic = 0"), F.lit(True)) is None
    assert toxicity.fit(df, some.limit(0), F.lit(True)) is None and toxicity.fit(df.limit(0), some, F.lit(True)) is None
    assert toxicity.score(docs(spark, ["x"]), None).first()["toxicity"] == 0


def brute_nearest(rows, k=5):
    """query id: the k best (vec_id, cosine), by plain loops."""
    good = [(i, [float(c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, a in good:
        if q % 50:
            continue
        best = {}
        for i, b in good:
            if i != q and len(a) == len(b):
                u, v = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                s = float((u * v).sum() / (np.sqrt((u * u).sum()) * np.sqrt((v * v).sum())))
                best[i] = max(s, best.get(i, -2))
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


@pytest.mark.parametrize("sample", [10_000, 600])
def test_search_against_brute_force(spark, monkeypatch, sample):
    """Recall of what the scans find, with the whole table in the sample and with a fifth of it, over several blocks."""
    for name, value in (("SAMPLE", sample), ("BLOCK_VECTORS", 40), ("BLOCK_QUERIES", 25)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 24)) + rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)] * 3
    x[100:400] = x[100]
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 24), (5002, [None] + [1.0] * 23), (5003, [float("nan")] * 24), (5004, [1.0]), (5005, []), (None, rows[0][1]), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    for q in (100, 150, 350):
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]  # copies: ties go to the smaller ids
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.95 * 300


def test_search_finds_by_scans_only(spark, monkeypatch):
    nothing = np.zeros(0, np.int64)
    index = nearest.Index(2, np.eye(2), np.zeros((1, 2)), 1, np.array([1]), np.ones((1, 2)))
    monkeypatch.setattr(nearest, "scan", lambda *_: (nothing, nothing))
    two = lambda name: pa.table({name: [1], "vector": [np.ones(2).tobytes()], "reach": [9.0]})
    assert nearest._scan(two("vec_id"), two("query_id"), type("B", (), {"value": index}), 5).num_rows == 0


def test_search_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.1]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r)[:3] for r in nearest.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert nearest.search(df.limit(0), df).count() == 0 and nearest.search(df, df.limit(0)).count() == 0
    # lengths apart, numbers whose squares overflow or vanish, a column of a clashing name
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [3.0, 4.0]), (50, [1.0, 2.0, 3.0]), (51, [1.0, 2.0, 4.0]), (100, [5e-324, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, list string, rank int")
    got = defaultdict(list)
    for r in nearest.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    assert got == {q: [(i, round(s, 9)) for i, s in v] for q, v in brute_nearest(rows).items()}


def test_url_filter(spark):
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    events = spark.createDataFrame(
        [("bad.org", day(10), "block", "spam"), ("bad.org", day(300), "allow", None), ("bad.org/ads/", day(0), "block", "ads"), ("x.com", day(5), "block", "a"), ("x.com", day(5), "allow", "b"), (None, day(1), "block", "z"), ("y.com", None, "block", "z")],
        "key string, at timestamp_ntz, action string, kind string",
    )
    urls = [
        ("http://www.BAD.org/page", 9, None), ("http://www.BAD.org:80/page", 10, "bad.org"), ("https://u@a.bad.org./ads/x?q#f", 20, "bad.org/ads/"), ("http://bad.org/", 300, None), ("http://bad.org/ads", 299, "bad.org"),
        ("http://notbad.org/", 20, None), ("http://x.com/", 6, None), (None, 20, None), ("nonsense", 20, None), ("http://bad.org/", None, None), ("http://bad.org/", 3000, None), ("http://bad.org/ads/", 3000, "bad.org/ads/"),
    ]
    rows = [(i, u, None if n is None else day(n), "clash", 1, 2, 3, 4) for i, (u, n, _) in enumerate(urls)] * 2
    captures = spark.createDataFrame(rows, "id long, url string, fetched_at timestamp_ntz, key string, _url int, _at int, _HIT int, blocked int")
    out = url_filter.url_filter(captures, events).collect()
    assert len(out) == 2 * len(urls) and all((r["key"], r["_url"], r["_at"], r["_HIT"]) == ("clash", 1, 2, 3) for r in out)
    assert all(r["block_key"] == urls[r["id"]][2] and r["blocked"] == (urls[r["id"]][2] is not None) for r in out)
    assert not any(r["blocked"] for r in url_filter.url_filter(captures, events.limit(0)).collect())
    assert url_filter.url_filter(captures.limit(0), events).count() == 0


def test_url_filter_of_a_long_list(spark, monkeypatch):
    """A list that isn't broadcast: hot suffixes that it lacks are left out, the rest is looked up."""
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", 5)
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    events = spark.createDataFrame([(f"h{i}.com", day(1), "block", "spam") for i in range(0, 200, 2)], "key string, at timestamp_ntz, action string, kind string")
    captures = spark.createDataFrame([(f"http://www.h{i}.com/", day(9)) for i in range(200)], "url string, fetched_at timestamp_ntz")
    out = url_filter.url_filter(captures, events).collect()
    assert {r["url"] for r in out if r["blocked"]} == {f"http://www.h{i}.com/" for i in range(0, 200, 2)}


def test_url_filter_long_keys(spark):
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    host, folders = "a.b.c.d.e.f.g.bad.org", "deep.org/1/2/3/4/5/"
    schema = "key string, at timestamp_ntz, action string, kind string"
    events = spark.createDataFrame([(host, day(1), "block", "spam"), (folders, day(1), "block", "ads"), (f"{host}/x/", day(5), "block", "more")], schema)
    urls = {
        f"http://{host}/": host, f"http://z.{host}/x/y": f"{host}/x/", "http://b.c.d.e.f.g.bad.org/": None, "http://bad.org/x/": None,
        "http://deep.org/1/2/3/4/5/page": folders, "http://www.deep.org/1/2/3/4/5/6/7/": folders, "http://deep.org/1/2/3/4/5": None, "http://deep.org/2/3/4/5/": None,
    }
    captures = spark.createDataFrame([(u, day(9)) for u in urls], "url string, fetched_at timestamp_ntz")
    assert {r["url"]: r["block_key"] for r in url_filter.url_filter(captures, events).collect()} == urls
    # a page on a host of nine labels that the query's own list blocks
    pages = spark.createDataFrame([(i, f"http://h{i}.b.c.d.e.f.g.long.org/") for i in range(300)], "page_id long, url string")
    out = url_filter.url_filter(url_filter.page_captures(pages), url_filter.page_events(pages)).where("blocked and block_key like 'h%'")
    assert out.count() > 0


def test_registered_sql(spark, tables):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from read_parquet('{tables}/{t}.parquet')")
    known = registry.queries()
    for name, sql in registry.oracle_sql().items():
        df = known[name](spark, tables)
        got = c.execute(sql)
        columns = [x[0] for x in got.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted(tuple(map(str, r)) for r in got.fetchall())
        assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == want
