"""The n-gram join where rows repeat a doc_id."""

import random

from clustrum.llm import ngram_join


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """Documents that links of any of their texts connect, by comparing all pairs."""
    reach = {d: d for d, _ in rows}

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    sets = [(d, grams(t or "")) for d, t in rows]
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(d), root(e)
                reach[max(x, y)] = min(x, y)
    return {(d, t or ""): root(d) if t else d for d, t in rows}


def test_a_document_reaches_what_any_of_its_texts_reaches(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(2, a), (4, a), (4, b), (6, b)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (4, 2), (4, 2), (6, 2)]


def test_repeated_ids_against_all_pairs(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{g}x{i}" for i in range(25)) for g in range(14)]
    rows = [(rng.randrange(20), rng.choice(base) + rng.choice(("", " end", " two more"))) for _ in range(30)] + [(50, None), (50, base[0])]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = components(rows)
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((d, want[d, t or ""]) for d, t in rows)


def test_clashing_names_in_any_case(spark):
    import public_tokenizers

    from clustrum.llm import language_id, piece_bpe

    df = spark.createDataFrame([(1, "ab", 5, "x", 0.5)], "doc_id long, text string, N_TOKENS int, Lang_Pred string, IDS double")
    out = piece_bpe.encode(df, public_tokenizers.path("piece_bpe_32k.model"))
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "lang_pred", "n_tokens", "ids", "decoded"] and out.select("n_tokens", "ids").first()["n_tokens"] > 0
    got = language_id.predict(df, None)
    assert [c.lower() for c in got.columns] == ["doc_id", "text", "n_tokens", "ids", "lang_pred", "lang_score", "lang_accepted"] and got.select("lang_pred").first()[0] == "und"


def test_languages_reject_shuffled_letters(spark):
    from clustrum.llm import language_id

    rng = random.Random(2)
    sounds = {"en": ["the", "ing", "tion", "er", "an"], "de": ["sch", "ung", "ein", "ich", "keit"]}
    make = lambda lang, n: " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(("en", "de")[i % 2], rng.choice((3, 12, 60, 300))), ("en", "de")[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, ~language_id.held_out())
    held = docs.where(language_id.held_out())
    own = language_id.predict(held, model).where("lang_accepted and lang_pred = lang").count()
    odd = spark.createDataFrame([(r["doc_id"], language_id.shuffled(r["text"], 1), r["lang"]) for r in held.collect()], docs.schema)
    assert own >= 0.97 * held.count() and language_id.predict(odd, model).where("lang_accepted").count() < 0.5 * held.count()
    assert language_id.shuffled("a, b! ", 0) in ("a, b! ", "b, a! ")
