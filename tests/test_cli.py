import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import catalog as K
from tidemark.sources import analysis as A
from tests.test_signal import clicks, sine, wav_bytes


def test_listen_to_packet(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "one.wav").write_bytes(wav_bytes(clicks(120, 6) * 0.2 + sine(440, 6, 0.1)))
    (src / "two.wav").write_bytes(wav_bytes(sine(220, 4)))
    (src / "null.wav").write_bytes(wav_bytes(np.zeros(22050)))
    rejects = cli.listen(spark, str(src), out, only=["report", "perception"]).collect()
    assert [r.track for r in rejects] == ["null"]
    found = {r.metric: r.found for r in cli.compare(spark, out, "one", "two").collect()}
    assert found["tempo_bpm"] == "both" and found["mean_momentum"] == "both"
    assert cli.frames(spark, out, 5, 0.6).groupBy("track").count().where("count <> 5").count() == 0
    (tmp_path / "out" / "one").mkdir()
    (tmp_path / "out" / "one" / "context.json").write_text(json.dumps({"artist": "Somebody", "title": "T", "lyrics": {"full_text": "la la"}}))
    text = cli.assemble(spark, out, "one", "lyrics")
    docs = A.load_analysis(spark, out)
    got = {r.track: r for r in docs.select("track", A.metric("report", "tempo_bpm").alias("tempo"), A.metric("perception", "mean_momentum").alias("m"), F.try_variant_get("perception", "$.pattern_break_count", "long").alias("n")).collect()}
    assert set(got) == {"one", "two"} and got["one"].tempo == pytest.approx(120, rel=0.06) and got["one"].m is not None
    stream = A.read_module(spark, out, "perception_stream").select(F.try_variant_get("doc", "$.stream", "array<struct<t:double,momentum:double>>").alias("s"), "track")
    assert {r.track: len(r.s) for r in stream.collect()} == {"one": 12, "two": 8}
    assert K.load(spark, f"{out}/catalog").count() == 2
    with pytest.raises(ValueError):
        cli.compare(spark, out, "one", "nosuch")
    assert "Artist: Somebody" in text and "## Lyrics\n\nla la" in text and "Duration: 0:06" in text
    assert "Somebody" not in cli.assemble(spark, out, "one", "blind")
    with pytest.raises(ValueError):
        cli.assemble(spark, out, "none", "nosuch")


def test_bad_arguments():
    with pytest.raises(SystemExit):
        cli.main(["listen", "x", "--only", "nosuch"])
    assert cli.main(["doctor"]) == 0


def test_moments_reach_the_context(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "one.wav").write_bytes(wav_bytes(sine(440, 6) * (np.arange(6 * 22050) < 3 * 22050)))
    cli.listen(spark, str(src), out, only=["report", "perception"], index=False)
    (tmp_path / "out" / "one").mkdir()
    (tmp_path / "out" / "one" / "context.json").write_text(json.dumps({"artist": "Somebody", "n": 1, "lyrics": {"full_text": "la"}, "frame_descriptions": [{"time": 0.0}]}))
    groups = cli.moments(spark, out, 6)
    assert groups.count() > 0 and groups.where("`group` IS NOT NULL").count() > 0
    told = groups.select("track", "place", F.concat(F.lit("seen "), F.col("place").cast("string")).alias("description"))
    cli.moments(spark, out, 6, descriptions=told)
    context = json.loads(A.load_context(spark, out).select(F.to_json("context")).first()[0])
    assert {k: v for k, v in context.items() if k != "frame_descriptions"} == {"artist": "Somebody", "n": 1, "lyrics": {"full_text": "la"}}
    told = context["frame_descriptions"]
    assert len(told) == groups.count() and [x["time"] for x in told] == sorted(x["time"] for x in told) and all(x["description"].startswith("seen ") for x in told)
    A.write_contexts(spark.createDataFrame([("bad", "{broken"), ("one", "5")], "track string, context string"), out)
    assert A.load_context(spark, out).count() == 1
