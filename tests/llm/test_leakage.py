import random

import pytest

from sievewright.llm import leakage
from sievewright.llm.leakage import QueryIndex, edits, leaked_items, run_length, words

rng = random.Random(8)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]


def some(n, r):
    return [r.choice(VOCABULARY) for _ in range(n)]


def test_normal_form():
    a = words("The <b>Café</b>—naïve*ly* said: “it’s” [12] a well-known ﬁx_ed w\u00ador\u200bd, don't.")
    b = words("the cafe naively said its a wellknown FIXED word dont")
    assert a == b
    assert words("[x](http://a.b) &amp; y") == ["x", "y"] and words("") == [] and words("exam-\nple") == ["example"]


def test_edits():
    assert edits("a b c d".split(), "x a b c d y".split()) == 0
    assert edits("a b c d".split(), "x a b z d y".split()) == 1
    assert edits("a b c d".split(), []) == 4


def planted(r, texts):
    docs, want = [], set()
    for d in range(400):
        doc = some(r.randint(0, 300), r)
        kind, t = r.choice(["none", "whole", "edited", "run", "short_run"]), r.randrange(len(texts))
        w = list(texts[t])
        if kind == "edited":
            for _ in range(int(0.13 * len(w))):
                i = r.randrange(len(w))
                what = r.choice(["change", "drop", "add"])
                w[i : i + (what != "add")] = [] if what == "drop" else ["zzz"]
        elif kind == "run" and len(w) >= 12:
            i = r.randrange(len(w) - 11)
            w = w[i : i + 12]
        elif kind == "short_run":
            w = w[:9] if len(w) > 12 else []
        elif kind == "none":
            w = []
        at = r.randint(0, len(doc))
        docs.append(doc[:at] + w + doc[at:])
    return docs


def test_recall_against_all_pairs():
    r = random.Random(2)
    texts = [some(n, r) for n in (5, 7, 12, 15, 17, 18, 30, 42, 55, 60, 74, 90) for _ in range(6)]
    index = QueryIndex([" ".join(t) for t in texts])
    docs = planted(r, texts)
    found = {}
    for d, t in index.candidates(docs):
        found.setdefault(d, []).append(t)
    got = {(d, v[0]) for d, ts in found.items() for v in index.verify(docs[d], ts)}
    want = {(d, v[0]) for d, doc in enumerate(docs) for v in index.verify(doc, range(len(texts)))}
    assert got <= want and len(want) > 150
    assert len(got) / len(want) >= 0.99
    runs = {(d, v[0]) for d, doc in enumerate(docs) for v in index.verify(doc, range(len(texts))) if v[1]}
    assert runs <= got  # an equal run is never missed


ITEMS = [(1, "What does the red fox eat in early spring near the old mill by the river", "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "Why", "one two three four five six seven eight nine ten eleven twelve thirteen"), (3, None, "")]


def test_frame(spark):
    docs = [
        (1, "Intro. One, two; THREE four five six seven eight nine ten eleven twelve! End.", 0), (2, None, 0), (3, "", 0), (4, "one two three four five six seven eight nine ten", 0),
        (5, "what does a red fox eat in spring near the old mill by the river?", 0), (1, "why", 0), (6, "word " * 50_000 + "one two three four five six seven eight nine ten eleven twelve", 0), (None, "why not", 0),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, part int")
    items = spark.createDataFrame(ITEMS, "item_id long, question string, passage string")
    found = leaked_items(df, "doc_id", "text", items, "item_id", ["question", "passage"])
    got = sorted({(r["doc_id"] or 0, r["item_id"]) for r in found.collect()})
    assert got == [(0, 2), (1, 1), (1, 2), (5, 1), (6, 1), (6, 2)]
    assert leaked_items(df.limit(0), "doc_id", "text", items, "item_id", ["question"]).count() == 0
    assert leaked_items(df, "doc_id", "text", items.limit(0), "item_id", ["question"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 13])
def test_batches_of_short_documents(n):
    index = QueryIndex([" ".join(VOCABULARY[:n])])
    docs = [VOCABULARY[100:103]] * 5 + [VOCABULARY[:n]] + [[]] * 3
    assert (5, 0) in index.candidates(docs)
    # windows never run on into the next document
    if n > 1:
        assert index.verify(VOCABULARY[: n - 1], [0]) == [] or n > 5


KANJI = [chr(0x4E00 + 7 * i) for i in range(700)] + [chr(c) for c in range(0x3041, 0x3094)] * 4


def test_scripts_without_spaces():
    r = random.Random(31)
    texts = ["".join(r.choice(KANJI) for _ in range(n)) + "。" for n in (26, 40, 60, 90, 130) for _ in range(8)]
    index = QueryIndex(texts, run_length(words(texts[0])))
    assert index.run == 24 and run_length("one two three".split()) == 12
    docs, want = [], set()
    for d in range(300):
        t = r.randrange(len(texts))
        body = list(texts[t])
        kind = r.choice(["whole", "edited", "run", "none"])
        if kind == "edited":
            for _ in range(len(body) // 9):
                body[r.randrange(len(body))] = r.choice(KANJI)
        elif kind == "run":
            body = body[:24]
        elif kind == "none":
            body = body[:15]
        filler = ["".join(r.choice(KANJI) for _ in range(r.randint(0, 80))) for _ in range(2)]
        docs.append(words(filler[0] + "、" + "".join(body) + filler[1]))
        if kind != "none":
            want.add((d, t))
    found: dict = {}
    for d, t in index.candidates(docs):
        found.setdefault(d, []).append(t)
    got = {(d, v[0]) for d, ts in found.items() for v in index.verify(docs[d], ts)}
    assert got <= want and len(got) / len(want) >= 0.99


def test_unspaced_items_in_a_frame(spark):
    passage = "この種は標高の高い湿った草地に生え、夏の終わりに白い花を咲かせることが知られている。"
    docs = spark.createDataFrame([(1, "前書き。" + passage + "終わり。"), (2, "別の文章である。"), (3, "English words only")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "どこに生えるか", passage), (8, "What is this", "one two three four five six seven eight nine ten eleven twelve")], "item_id long, question string, passage string")
    found = leaked_items(docs, "doc_id", "text", items, "item_id", ["question", "passage"]).collect()
    assert [(r["doc_id"], r["item_id"], r["part"]) for r in found] == [(1, 7, "passage")]


def test_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(leakage, "QUERY_CHARS", 10)
    monkeypatch.setattr(leakage, "QUERY_BLOCK", 3)
    items = [{"a": "x" * n} for n in (4, 4, 4, 20, 1, 1, 1, 1)]
    assert [[len(r["a"]) for r in b] for b in leakage._blocks(iter(items), ["a"])] == [[4, 4], [4], [20], [1, 1, 1], [1]]
