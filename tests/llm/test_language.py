import os
import random

import numpy as np
import pytest

from sievewright.llm import language as L

TEMPLATES = {
    "en": ["The {a} grows in the {b} and is easy to find in spring.", "Visitors often see the {a} near the {b} before the rain.", "Since that year the number of {a} has fallen by half."],
    "de": ["Die {a} wächst auf der {b} und ist im Frühling gut zu finden.", "Man sieht die {a} oft in der Nähe von {b} vor dem Regen.", "Seit diesem Jahr ist der Bestand von {a} um die Hälfte gesunken."],
    "es": ["La {a} crece en la {b} y es fácil de encontrar en primavera.", "Se ve muchas veces la {a} cerca de {b} antes de la lluvia.", "Desde ese año la población de {a} ha bajado a la mitad."],
    "ja": ["この種の花は{b}の近くで春に見られる。", "秋の雨の後に{a}は色が変わる。", "標高の高い牧草地では個体数が減った。"],
    "ru": ["Этот вид растёт недалеко от {b} и цветёт весной.", "Его часто видят около {b} перед дождём.", "С этого года численность {a} упала вдвое."],
}


def sentence(lang, r):
    name = lambda: "".join(r.choice(["ka", "lo", "mi", "tu", "ne", "ri"]) for _ in range(3)).title()
    return r.choice(TEMPLATES[lang]).format(a=name() + " " + name().lower(), b=name())


def document(lang, r, n=4):
    return " ".join(sentence(lang, r) for _ in range(n))


@pytest.fixture(scope="module")
def field():
    r = random.Random(1)
    samples = [(lang if r.random() > 0.08 else r.choice(list(TEMPLATES)), document(lang, r)) for lang in TEMPLATES for _ in range(60)]
    r.shuffle(samples)
    return L.fit_on_labels(samples)


def langs(field, text):
    doc = L.read_words(text)
    return sorted({s[2] for s in L.segments(field, doc, *L.label_batch(field, [doc])[0]) if s[5]})


def test_held_out_accuracy(field):
    r = random.Random(77)
    docs = [(lang, document(lang, r, r.randint(1, 6))) for lang in TEMPLATES for _ in range(40)]
    assert sum(langs(field, t) == [lang] for lang, t in docs) / len(docs) >= 0.98
    assert np.mean([langs(field, t.upper()) == [lang] for lang, t in docs]) >= 0.9


def test_mixed_documents(field):
    r = random.Random(5)
    right = 0
    for _ in range(60):
        a, b = r.sample(list(TEMPLATES), 2)
        right += langs(field, document(a, r, 3) + " " + document(b, r, 2)) == sorted([a, b])
    assert right >= 56


def test_quoted_phrases_make_no_mix(field):
    r = random.Random(6)
    assert langs(field, document("en", r) + ' The label says "die Hälfte im Frühling" in pencil.') == ["en"]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    f = L.Field(["a", "b", "c"], np.zeros((L.FEATURES, 3), np.float32), rng.normal(size=(3, 3)), rng.normal(size=(3, 3)))
    e, crossing = rng.normal(size=(1, 4, 3)), np.array([[False, False, True, False]])
    post, norm, _, _ = f.posteriors(e, crossing, np.array([4]))
    total, marginal = 0.0, np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        s = sum(e[0, t, y] for t, y in enumerate(path)) + sum((f.across if crossing[0, t] else f.inside)[path[t - 1], path[t]] for t in range(1, 4))
        total += np.exp(s)
        for t, y in enumerate(path):
            marginal[t, y] += np.exp(s)
    assert np.allclose(post[0], marginal / total) and np.isclose(norm[0], np.log(total))


def test_invisible_characters():
    doc = L.read_words("w\u00ador\u200bd two")
    assert doc.words == ["word", "two"] and doc.spans == [(0, 6), (7, 10)]


def test_frame(spark):
    r = random.Random(3)
    rows = [(i, document(lang, r), label, "x") for i, (lang, label) in enumerate([("en", "en-GB"), ("de", "German"), ("es", "ES"), ("ja", "jpn"), ("ru", "rus")] * 30)]
    rows += [(900, None, "en", "x"), (901, "", "en", "x"), (902, "12 34", None, "x"), (903, document("de", r), None, "x"), (904, document("de", r) + " " + document("es", r, 300), "en", "x"), (903, rows[0][1], "??", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence string")
    field = L.fit_on(df, "text", "lang", "doc_id")
    found = L.language_segments(df, "doc_id", "text", field).cache()
    whole = {r["doc_id"]: r for r in L.document_languages(found, "doc_id").collect()}
    assert 900 not in whole and 901 not in whole and whole[902]["lang"] == "und"
    assert sorted(whole[904]["langs"]) == ["de", "es"] and whole[904]["mixed"]
    assert sorted(whole[903]["langs"]) == ["de", "en"]  # two rows of one id
    assert whole[0]["lang"] == "en" and whole[0]["confidence"] > 0.8
    none = df.limit(0)
    assert L.fit_on(none, "text", "lang", "doc_id") is None
    assert L.language_segments(none, "doc_id", "text", None).count() == 0
    assert {r["lang"] for r in L.language_segments(df, "doc_id", "text", None).collect()} == {"und"}


OTHERS = {
    "pl": "Lis rudy mieszka w lasach i na łąkach całej Europy. Wiosną samica rodzi od czterech do sześciu młodych, które pozostają w norze przez kilka tygodni.",
    "fi": "Kettu elää metsissä ja niityillä kaikkialla Euroopassa. Keväällä naaras synnyttää neljästä kuuteen poikasta, jotka pysyvät pesässä useita viikkoja.",
    "zh": "红狐生活在欧洲各地的森林和草地上。春天，雌狐会生下四到六只幼崽，它们在洞穴里待几个星期。它主要吃啮齿动物和水果。",
    "hu": "A róka erdőkben és réteken él egész Európában. Tavasszal a nőstény négy-hat kölyköt hoz világra, amelyek néhány hétig az odúban maradnak.",
    "uk": "Лисиця живе в лісах і на луках по всій Європі. Навесні самка народжує від чотирьох до шести дитинчат, які кілька тижнів залишаються в норі.",
    "ko": "붉은여우는 유럽 전역의 숲과 초원에 산다. 봄에 암컷은 네 마리에서 여섯 마리의 새끼를 낳는다.",
}
OWN = {
    "de": "Der Fuchs lebt in Wäldern und auf Wiesen in ganz Europa. Im Frühling bringt das Weibchen vier bis sechs Junge zur Welt, die mehrere Wochen im Bau bleiben.",
    "en": "The fox lives in woods and meadows all over Europe. In spring the female gives birth to four to six cubs, which stay in the den for several weeks.",
    "fr": "Le renard vit dans les forêts et les prairies de toute l'Europe. Au printemps, la femelle donne naissance à quatre à six petits, qui restent plusieurs semaines dans le terrier.",
}


def test_other_languages_are_turned_away(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{path}/documents.parquet").where("text is not null")
    field = L.fitted_once(docs, "text", "lang", "doc_id")
    again = L.fitted_once(docs, "text", "lang", "doc_id")  # loaded, not fitted
    assert all(np.array_equal(np.asarray(a), np.asarray(b)) for a, b in zip(field.parts(), again.parts(), strict=True))
    rows = list(enumerate([*OTHERS.values(), *OWN.values()]))
    found = L.document_languages(L.language_segments(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", again), "doc_id").collect()
    assert [r["lang"] for r in sorted(found, key=lambda r: r["doc_id"])] == ["und"] * len(OTHERS) + list(OWN)


def test_long_words_and_long_documents(field):
    word = "a" * 30 + "xyz" * 20_000
    assert len(L.features(word)) > len(L.features(word[:40])) - 1 and not np.array_equal(L.features(word), L.features(word[:40]))
    r = random.Random(2)
    docs = [L.read_words(document("de", r, n)) for n in (1, 9000, 2, 3)]
    assert all(len(p) == len(d.words) for (p, _), d in zip(L.label_batch(field, docs), docs, strict=True))


def test_labels(spark):
    df = spark.createDataFrame([("en_US",), (" German ",), ("日本語",), ("??",), (None,), ("xx",), ("pt-BR",)], "l string")
    assert [r[0] for r in df.select(L.label_code(df["l"])).collect()] == ["en", "de", "ja", None, None, None, "pt"]
