import random
import unicodedata

import pytest

from sievewright.llm.chunking import cut_points, split_oversized


def texts():
    rng = random.Random(4)
    words = ["alpha", "be", "gammaray", "é", "漢字漢字。", "🌿", "a\u0301b"]
    for _ in range(60):
        yield "".join(rng.choice(words) + rng.choice([" ", ". ", "\n", "\n\n", ", ", ""]) for _ in range(rng.randint(1, 900)))
    yield "x" * 5000
    yield "e\u0301" * 3000
    yield "\n" * 4000
    yield ("word " * 100 + "\n\n") * 50
    yield "a" + "\u0301" * 700 + " end" * 300
    yield ("x" * 47 + " ") * 40


@pytest.mark.parametrize("limit,overlap", [(1800, 150), (50, 10), (10, 0), (3, 2), (100, 90), (100, 60), (50, 40), (200, 180), (1, 0), (2, 1)])
def test_round_trip_limits_and_overlap(limit, overlap):
    for text in texts():
        pieces = cut_points(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for a, b in pieces:
            assert 0 < b - a <= limit
        for (a, b), (c, d) in zip(pieces, pieces[1:], strict=False):
            assert a < c <= b < d
            assert b - c <= max(overlap * 1.5, overlap + 2)
        joined, at = "", 0
        for a, b in pieces:
            joined += text[at:b]
            at = b
        assert joined == text


def test_boundaries_are_natural():
    text = "\n\n".join("This is one sentence. " * 20 for _ in range(30))
    pieces = cut_points(text, 1000, 100)
    assert all(text[b - 1] in "\n " for _, b in pieces[:-1])
    assert all(text[a - 1] in "\n " for a, _ in pieces[1:])
    assert all(80 < b - c < 140 for (_, b), (c, _) in zip(pieces, pieces[1:], strict=False))


def test_graphemes_stay_whole():
    text = "e\u0301" * 3000
    for a, _ in cut_points(text, 101, 11):
        assert not unicodedata.combining(text[a])


def test_long_text_is_fast():
    assert len(cut_points("Some words in a row. " * 200_000, 1800, 150)) > 2000


def test_token_sizes():
    pieces = cut_points("one two three four five six", 3, 1, sizes=lambda w: 0 if w.isspace() else 1)
    assert pieces[0] == (0, 14)


def test_frame(spark):
    rows = [("a", "x " * 2000, 1), ("a", "x " * 2000, 2), ("b", "short", 3), ("c", "", 4), ("d", None, 5), (None, "y" * 1801, 6), ("e", "z" * 1800, 7)]
    df = spark.createDataFrame(rows, "id string, contents string, piece int")  # `piece` is a column of the result too
    out = split_oversized(df, ["id"], "contents").collect()
    count = {k: sum(r["id"] == k for r in out) for k in ("a", "b", "c", "d", None, "e")}
    assert count == {"a": 6, "b": 1, "c": 0, "d": 0, None: 2, "e": 1}
    assert split_oversized(df.limit(0), ["id"], "contents").count() == 0
    with pytest.raises(ValueError):
        cut_points("abc", 2, 2)
