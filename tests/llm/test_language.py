import numpy as np
import pytest

from twinloom.llm import language as L

SAMPLES = {
    "en": ["the market seller opened the old door in the morning and went home", "she wrote a long letter about the weather and the garden near the river", "nobody in the village knew where the teacher had left the green book"],
    "fr": ["le jardinier a réparé une vieille porte dans la cuisine avant la réunion", "mon cousin a oublié les billets du concert à la gare hier soir encore", "la voisine regardait les fleurs séchées près du pont chaque matin tôt"],
    "zh": ["市场里的商贩早上打开了旧门然后回家去了", "她写了一封关于天气和花园的长信寄给朋友", "村子里没有人知道老师把绿色的书放在哪里"],
    "ru": ["старый книготорговец искал синюю тетрадь на кухне до собрания", "докладчица описала карту деревни у моста летом и утром", "садовник продаёт билеты на концерт на берегу канала сегодня"],
}


@pytest.fixture(scope="module")
def model():
    texts, labels = zip(*[(s, k) for k, v in SAMPLES.items() for s in v for _ in range(40)], strict=True)
    return L.fit(list(texts), list(labels), epochs=10)


def test_segments_of_a_mixed_text(spark, model):
    text = "The teacher opened the door of the village school in the morning. Le jardinier regardait les fleurs dans la cuisine chaque matin."
    rows = [(1, text), (2, "市场里的商贩打开了旧门，然后回家去了。"), (3, None), (4, "  "), (5, "123 !!"), (6, "The teacher said 你好 and opened the door of the old village house.")]
    frame = spark.createDataFrame(rows, "id long, text string").where("text IS NOT NULL")
    got = {}
    for r in L.segments(frame, model, ["id"]).orderBy("id", "segment").collect():
        got.setdefault(r["id"], []).append(r["lang"])
        assert 0 <= r["confidence"] <= 1.000001
    assert got[1] == ["en", "fr"] and got[2] == ["zh"] and got[6] == ["en"]
    assert 4 not in got and 5 not in got


def test_very_long_texts_and_empty_tables(spark, model):
    long = "the market seller opened the old door in the morning. " * 20000
    frame = spark.createDataFrame([(1, long, "x")], "id long, text string, lang string")
    r = L.languages_of(frame.drop("lang"), model, ["id"]).collect()
    assert [(x["lang"], round(x["share"], 3)) for x in r] == [("en", 1.0)]
    assert L.languages_of(frame.drop("lang").limit(0), model, ["id"]).count() == 0


def test_labels(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("zh_CN",), ("EN",), ("und",), ("",), (None,), (" de-DE ",)], "l string")
    assert [r[0] for r in rows.select(L.normal_label(F.col("l"))).collect()] == ["zh", "en", None, None, None, "de"]


def test_wrong_labels_are_no_examples():
    texts = [s for k, v in SAMPLES.items() for s in v for _ in range(8)]
    labels = [k for k, v in SAMPLES.items() for _ in v for _ in range(8)]
    labels[0] = "fr"
    m = L.fit(texts, labels)
    _, _, _, prob = L.classify([SAMPLES["en"][0]], m)
    assert m.languages[int(prob[0].argmax())] == "en"
    assert (m.table[:, :-1] != 0).mean() < 0.2


def test_label_and_text_bear_on_a_sentence_but_less_than_its_own_words():
    scores = np.array([[0.0, 2.0], [6.0, 0.0], [0.0, 9.0]])
    letters, owner = np.full(3, 40.0), np.array([0, 1, 2])
    assert L._weighed(scores, letters, owner, 3).argmax(1).tolist() == [1, 0, 1]
    assert L._weighed(scores, letters, owner, 3, np.array([0, -1, 0])).argmax(1).tolist() == [0, 0, 1]


def test_confidence_is_calibrated(model):
    texts = [s for v in SAMPLES.values() for s in v]
    labels = [k for k, v in SAMPLES.items() for _ in v]
    assert L.calibration(texts, labels, model) < 0.1


def test_examples_come_from_all_of_a_text():
    text = " ".join(f"the market seller number {'abcdefghijklmnopqrstuvwxyz'[i]} opened the old door in the morning." for i in range(26))
    drawn = [L._examples([text], [0], ("en",), np.random.default_rng(s))[0] for s in range(8)]
    assert all(len(rows) == L.SENTENCES for rows in drawn)
    assert len({tuple(r[0].tolist()) for rows in drawn for r in rows}) > 15


def test_no_labels():
    m = L.fit([], [])
    assert m.languages == ("und",) and np.all(m.table == 0)
