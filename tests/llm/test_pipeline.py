"""The pipeline against its stages one by one, and on awkward documents."""

import re

import public_tokenizers
import sentencepiece

import corpus_pipeline

COLUMNS = list(corpus_pipeline.COLUMNS)


def write(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages_on_planted_documents(spark, tmp_path):
    english = "the quick brown fox jumps over the lazy dog while seven other animals watch from the hill and think about dinner "
    german = "der schnelle braune fuchs springt über den faulen hund während sieben andere tiere vom hügel aus zusehen und essen "
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, (english if i % 2 else german) + f"number {i} " + " ".join(f"x{i}y{j}" for j in range(40)), "en" if i % 2 else "de", f"s{i % 3}", 10) for i in range(40)]
    rows += [(100, english * 3 + "copy", "en", "s0", 1), (101, english * 3 + "Copy", "en", "s1", 1), (102, None, None, None, None), (103, "", "en", "s0", 0), (104, "12345 67890", None, "s1", 11)]
    rows += [(200, rows[0][1] + "\n" + passage, "de", "s0", 1), (201, rows[1][1] + " tail\n" + passage, "en", "s1", 1), (201, rows[1][1] + " tail\n" + passage, "en", "s1", 1)]
    folder = write(spark, rows, tmp_path)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS
            out.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = out.collect()
    ids = {k: [r["doc_id"] for r in v] for k, v in kept.items()}
    assert not {102, 103, 104} & set(ids["language_id"]) and {0, 39, 100, 101, 200, 201} <= set(ids["language_id"])
    texts = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert passage in texts[200] and passage not in texts[201]
    assert 100 in ids["ngram_join"] and 101 not in ids["ngram_join"] and set(range(2, 40)) <= set(ids["ngram_join"])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    mixed = {r["doc_id"]: r["text"] for r in kept["source_mixing"]}
    assert len(kept["sentencepiece"]) == len(kept["source_mixing"])
    assert all(r["ids"] == library.encode(mixed[r["doc_id"]]) for r in kept["sentencepiece"])
    whole = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, whole)) == sorted((r["doc_id"], r["n_tokens"]) for r in kept["sentencepiece"])


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, [], tmp_path)).count() == 0


def test_names_the_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "source_mixing", "sentencepiece"]
    assert not re.search(r"except|suppress", open(corpus_pipeline.__file__).read())


def test_texts_under_one_id_are_no_copies(spark):
    """Two texts under one doc_id: the one that has no other copy is never lost, and a copy goes once."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    near = a + " tail"
    rows = [(2, a), (4, a), (4, b), (6, b), (7, near), (7, near), (8, None), (8, ""), (None, a), (9, "lone words here"), (9, "lone words here")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert kept == sorted([(2, a), (4, b), (8, None), (8, ""), (None, a), (9, "lone words here")], key=str)
