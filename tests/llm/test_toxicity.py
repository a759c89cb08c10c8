"""Held-out accuracy by language, learned contexts, and rows that are odd."""

import random
import zlib

import pytest

from trialflow.llm import toxicity

WORDS = {"en": "the of and river stone with from house walk light", "es": "el de los casa mesa con sol mar luz paso", "de": "der die haus berg und mit see licht weg bach"}
INSULTS = {"en": ["idiot", "scumbag", "worthless"], "es": ["imbécil", "basura", "inútil"], "de": ["trottel", "abschaum", "wertlos"]}
SHARE = {"en": 0.9, "es": 0.05, "de": 0.05}


def corpus(n=4000, seed=5):
    """A sixth of each language is toxic; others quote an insult after a word that tells so."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choices(list(SHARE), SHARE.values())[0]
        pool = WORDS[lang].split()
        words = [rng.choice(pool) for _ in range(rng.randrange(20, 60))]
        kind = rng.random()
        if kind < 1 / 6:
            for term in rng.sample(INSULTS[lang], 2):
                at = rng.randrange(len(words))
                words[at:at] = ["stupidly", term if rng.random() < 0.8 else term[:3] + term[4:]]
        elif kind < 1 / 4 and lang == "en":
            at = rng.randrange(len(words))
            words[at:at] = ["reportedly", "named", rng.choice(INSULTS[lang])]
        rows.append((i, " ".join(words), lang, int(kind < 1 / 6)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, "w", 0.5) for i, t, _, _ in rows], "doc_id long, text string, toxic string, score int, word string, row double")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.fit(docs, labels)


def test_terms_of_small_languages_are_learned_and_caught(fitted):
    rows, docs, _, model = fitted
    assert {t for terms in INSULTS.values() for t in terms} <= set(model.lexicon.terms)
    assert not {w for words in WORDS.values() for w in words.split()} & set(model.lexicon.terms)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for lang in SHARE:
        held = [(score[i] >= 0.5, y) for i, _, l, y in rows if l == lang and zlib.crc32(str(i).encode()) % 5 == 0]
        caught = [p for p, y in held if y]
        assert len(caught) > 2 and sum(caught) >= 0.9 * len(caught), lang
        assert sum(p for p, y in held if not y) <= 0.02 * len(held), lang


def test_words_near_a_hit_tell_quotation_from_abuse(fitted):
    _, _, _, model = fitted
    assert model.lexicon.context["<reportedly"] < 0 < model.lexicon.context["<stupidly"]


def test_scores_take_whole_texts_and_any_row(spark, fitted):
    rows, _, _, model = fitted
    long = " ".join(["house"] * 60000)
    odd = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (None, "idiot scumbag worthless stupidly idiot", 0), (3, long, 0), (3, long, 0), (4, "stupidly idiot stupidly scumbag " * 3, 0)],
        "doc_id long, text string, score int",
    )
    got = sorted(((r["doc_id"], round(r["score"], 6)) for r in toxicity.score(odd, model).collect()), key=str)
    assert len(got) == 6 and {s for i, s in got if i in (1, 2, 3)} == {got[0][1]} and got[0][1] < 0.5
    assert dict(got)[None] >= 0.5 and dict(got)[4] >= 0.5
    kept = toxicity.not_toxic(odd, model)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 3]


def test_repeated_ids_are_one_training_row(spark, fitted):
    rows, docs, labels, _ = fitted
    twice = toxicity.training_rows(docs.union(docs), labels.union(labels))
    assert twice.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in rows)
    assert toxicity.training_rows(docs, labels, 50).count() == 50
    none = toxicity.fit(docs, labels.filter("toxic = 1"))
    assert none.lexicon.terms == {} and toxicity.score(docs, none).count() == len(rows)
