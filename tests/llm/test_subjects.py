import random

import pytest

from tessera.llm.subjects import document_subjects

AREAS = {
    "law": "court judge verdict appeal lawyer statute trial jury",
    "food": "bread soup oven recipe cheese butter spice salad",
    "music": "violin choir melody rhythm opera concert guitar singer",
}
GENERAL = "result method group number report change early small new large problem answer"


def sentence(rng, area):
    words = (AREAS[area] if area else GENERAL).split()
    return "The " + " ".join(rng.sample(words, 4) + rng.sample(GENERAL.split(), 3)) + "."


def collection(n=240, seed=5):
    rng, texts, truth = random.Random(seed), {}, {}
    for i in range(n):
        areas = rng.choice([["law"], ["food"], ["music"], ["law", "music"], []])
        body = [sentence(rng, a) for a in areas for _ in range(3)] or [sentence(rng, None) for _ in range(3)]
        if areas and rng.random() < 0.3:
            body += [sentence(rng, areas[0]) for _ in range(3)] + [sentence(rng, next(a for a in AREAS if a not in areas))]
        rng.shuffle(body)
        texts[i], truth[i] = " ".join(body), set(areas)
    return texts, truth


def found(spark, docs, labels):
    subjects = spark.createDataFrame([(i, s, "about it") for i, s in enumerate(["law", "food", "music"])], "subject_id int, subject string, description string")
    labels = spark.createDataFrame(labels, "doc_id bigint, subject string")
    out = {}
    for r in document_subjects(docs, "doc_id", "text", labels, "doc_id", "subject", subjects).collect():
        out.setdefault(r.doc_id, set()).add(r.subject)
    return out


@pytest.fixture(scope="module")
def result(spark):
    texts, truth = collection()
    labels = [(i, s) for i in range(60) for s in truth[i]]
    labels += [(0, None), (1, "astrology"), (99999, "law"), (2, " LAW "), *labels[:10]]
    rows = [(i, t, "en") for i, t in texts.items()] + [(1000, None, "en"), (1001, "", "en"), (1002, " \n", "en"), (None, texts[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, subject string")
    return found(spark, docs, labels), truth


def test_held_out_accuracy(result):
    got, truth = result
    right = sum(got.get(i, set()) == truth[i] for i in range(60, 240))
    assert right >= 0.95 * 180


def test_texts_without_content_have_no_subject(result):
    got, _ = result
    assert not {1000, 1001, 1002, None} & set(got)


def test_without_labels_nothing_is_found(spark):
    texts, _ = collection(10)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert found(spark, docs, []) == {}
    assert found(spark, docs.limit(0), [(1, "law")]) == {}


def test_a_wrong_label_is_outvoted(spark):
    texts, truth = collection(seed=6)
    only_food = next(i for i in range(60) if truth[i] == {"food"})
    labels = [(i, s) for i in range(60) for s in truth[i] if i != only_food] + [(only_food, "music")]
    got = found(spark, spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), labels)
    assert got[only_food] == {"food"}


def test_a_trusted_second_subject_of_one_sentence_stays_and_a_passing_one_goes(spark):
    rng = random.Random(5)
    texts, truth = collection()
    labels = [(i, s) for i in range(60) for s in truth[i]] + [(500, "law"), (500, "music")]
    texts[500] = " ".join(sentence(rng, a) for a in ("law", "music", "law"))
    texts[501] = " ".join(sentence(rng, a) for a in ("law", "law", "law", "law", "law", "music"))
    got = found(spark, spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), labels)
    assert got[500] == {"law", "music"} and got[501] == {"law"}


def test_labels_go_on_until_none_changes(spark):
    words = [[f"{a}{b}{c}" for c in "xyz"] for a, b in zip("abcdefghij", "klmnopqrst", strict=True)]
    texts = {10 * level + i: " ".join(words[level] + words[level + 1]) for level in range(8) for i in range(6)}
    got = found(spark, spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), [(i, "law") for i in range(6)])
    assert got == dict.fromkeys(texts, {"law"})
