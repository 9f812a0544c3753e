"""Tokens, looks and groups against plain versions on small inputs."""

import random
import unicodedata

import pytest

from riskweave.llm import bpe, components, lookalike
from riskweave.runtime import session


@pytest.fixture(scope="module")
def spark():
    return session("texts", "local[2]", **{"spark.sql.shuffle.partitions": "3"})


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(bpe.vocabulary_path())


def plain_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_merges_as_a_plain_loop(ranks):
    rng = random.Random(3)
    words = ["", "a", "the", "aaaaaaaaaaaaaaaaaaaaaaa", "é" * 50, "\U0001f600" * 9] + ["".join(rng.choice("abcdeé ñ漢<|>") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for w in words:
        assert bpe.merge_word(w.encode(), ranks) == (plain_merge(w.encode(), ranks) if w else [])


def test_corpus_ids_of_null_empty_long_and_special_texts(spark, ranks):
    back = {v: k for k, v in ranks.items()}
    texts = [None, "", "<|endoftext|>", "x" * 20_000, "Olá, mundo!\n\n  fim ", "á​ b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df, "doc_id", "text").collect()}
    assert got[0] == [] and got[1] == []
    for i, t in enumerate(texts[2:], 2):
        assert b"".join(back[x] for x in got[i]).decode() == t
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def pairs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {tuple(r) for r in lookalike.same_look_pairs(df, "doc_id", "text", "a", "b").collect()}


def test_texts_that_look_the_same_meet(spark):
    texts = ["Ação no mar", "Ação no mar", "Ação no mar", "Аção no mar", "Ação n​o mar", "Ａção no mar", "Acao no mar", "ação no mar", "Ação  no mar", "Ação no mar", None, ""]
    got = pairs(spark, texts)
    same = {(i, j) for i in (*range(6), 9) for j in (*range(6), 9) if i < j and texts[i] != texts[j]}
    assert got == same
    assert pairs(spark, []) == set()


def test_words_keep_their_script(spark):
    df = spark.createDataFrame([(0, "кот и дом"), (1, "house"), (2, "hоuse"), (3, "кoт и дом")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lookalike.one_form(df, "doc_id", "text").collect()}
    assert got[0] == got[3] == "кот и дом"
    assert got[1] == got[2] == "house"
    assert all(unicodedata.name(c).startswith("CYRILLIC") for c in got[0] if c.isalpha())


def test_look_classes_count_strings_and_texts(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_texts"], r["n_docs"]) for r in lookalike.look_classes(df, "doc_id", "text").collect()}
    assert got == {0: (2, 3), 1: (2, 3), 2: (2, 3), 3: (1, 1)}


def test_groups_of_random_graphs(spark):
    rng = random.Random(5)
    for _ in range(3):
        n = 60
        pairs_ = [(f"{rng.randrange(n):03}", f"{rng.randrange(n):03}") for _ in range(45)] + [(None, "001"), ("002", None), ("003", "003")]
        ident = [(f"{i:03}", f"I{rng.randrange(40)}" if rng.random() < 0.4 else None) for i in range(n)] + [(None, "I1")]
        up = {}

        def find(x):
            up.setdefault(x, x)
            return x if up[x] == x else find(up[x])

        for a, b in pairs_:
            if a and b:
                up[find(a)] = find(b)
        for d, i in ident:
            if d:
                find(d)
                if i:
                    up[find(d)] = find("#" + i)
        for a, b in pairs_:
            for x in (a, b):
                if x:
                    find(x)
        least = {}
        for x in list(up):
            if not x.startswith("#"):
                r = find(x)
                least[r] = min(least.get(r, x), x)
        want = {x: least[find(x)] for x in up if not x.startswith("#")}
        got = {r[0]: r[1] for r in components.identity_groups(spark.createDataFrame(ident, "cpf_cnpj string, id_identidade string"), spark.createDataFrame(pairs_, "cpf_cnpj_a string, cpf_cnpj_b string")).collect()}
        assert got == want
