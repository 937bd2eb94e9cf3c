import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize("hz, note", [(440.0, "A4"), (261.63, "C4"), (523.25, "C5"), (27.5, "A0"), (880.0, "A5"), (277.18, "C#4"), (0.0, "?"), (-1.0, "?"), (float("nan"), "?"), (None, "?")])
def test_notes(spark, hz, note):
    assert one(spark, S.hz_to_note(F.lit(hz).cast("double")))[0] == note


@pytest.mark.parametrize("a, b, cents, within", [(440.0, 440.0, 0, 1e-9), (440.0, 880.0, 1200, 1e-6), (880.0, 440.0, -1200, 1e-6), (440.0, 660.0, 701.96, 0.5), (440.0, 466.16, 100, 0.1)])
def test_cents(spark, a, b, cents, within):
    assert abs(one(spark, S.hz_to_cents(F.lit(a), F.lit(b)))[0] - cents) <= within


def test_cents_of_nothing(spark):
    assert one(spark, S.hz_to_cents(F.lit(0.0), F.lit(1.0)))[0] == float("inf")


@pytest.mark.parametrize("text, want", [("01:02:03.5", 3723.5), ("02:03,25", 123.25), ("7.5", 7.5), ("x:y", 0.0), ("", 0.0)])
def test_parse_timestamp(spark, text, want):
    assert one(spark, S.parse_timestamp(F.lit(text)))[0] == want


def test_formats(spark):
    assert tuple(one(spark, S.format_time(F.lit(125.9)), S.format_timestamp(F.lit(125.25)))) == ("2:05", "2:05.25")
    assert tuple(one(spark, S.format_delta(F.lit(1.0), F.lit(1.0)), S.format_delta(F.lit(1.0), F.lit(2.5)))) == ("  =", "> +1.500")


@pytest.mark.parametrize("text, want", [("Some Artist - A Song (Official) ft. Other", "some-artist-a-song"), ("A/B | C [live]", "a-b-c"), ("  --x--  ", "x"), ("é!", "")])
def test_slugify(spark, text, want):
    assert one(spark, S.slugify(F.lit(text)))[0] == want


@pytest.mark.parametrize("slug, ok", [("a-b_c.1", True), ("..", False), (".", False), ("a/b", False), ("", False)])
def test_valid_slug(spark, slug, ok):
    assert one(spark, S.valid_slug(F.lit(slug)))[0] is ok


@pytest.mark.parametrize("url, ok", [("https://www.youtube.com/watch?v=abcdefghijk", True), ("https://youtu.be/abcdefghijk", True), ("--exec x", False), ("https://other.org/watch?v=abcdefghijk", False)])
def test_valid_url(spark, url, ok):
    assert one(spark, S.valid_video_url(F.lit(url)))[0] is ok


def test_titles(spark):
    r = one(spark, S.artist_title(F.lit("Band — Song [HD]"), F.lit("u")), S.artist_title(F.lit("Song (x)"), F.lit("u")))
    assert (r[0].artist, r[0].title, r[1].artist, r[1].title) == ("Band", "Song", "u", "Song")


def test_overlap_and_article(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    r = one(spark, S.word_overlap(a, b), S.word_overlap(a, F.array().cast("array<string>")), S.wrong_article(F.lit("Blue Moon"), F.lit("Red sun")), S.wrong_article(F.lit("Blue Moon"), F.lit("moon song")))
    assert r[0] == pytest.approx(1 / 3) and r[1] == 0.0 and r[2] is True and r[3] is False


def test_censor_and_log(spark):
    r = one(spark, S.censor(F.lit("Shit, FUCKING bitches")), S.is_challenge_failure(F.lit("Challenge solving FAILED")))
    assert r[0] == "s***, f***ing b****" and r[1] is True
