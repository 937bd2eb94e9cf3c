import io
import wave

import numpy as np
import pytest

from tidemark.operators import signal as G
from tidemark.plans import modules as M
from tidemark.functions import harmony as H
from tidemark.sources import wav as W

SR = G.SR


def sine(hz, seconds, a=0.3):
    return a * np.sin(2 * np.pi * hz * np.arange(int(SR * seconds)) / SR)


def clicks(bpm, seconds):
    y = np.zeros(int(SR * seconds))
    for t in np.arange(0.5, seconds, 60 / bpm):
        i = int(t * SR)
        y[i : i + 400] += np.random.default_rng(0).normal(size=len(y[i : i + 400])) * np.exp(-np.arange(len(y[i : i + 400])) / 80)
    return y


def test_rms_and_centroid():
    y = sine(1000, 1)
    assert G.rms(y)[10] == pytest.approx(0.3 / 2**0.5, rel=0.02)
    assert G.centroid(G.stft(y), G.frequencies())[10] == pytest.approx(1000, rel=0.02)
    assert G.zero_crossings(y)[10] == pytest.approx(2000 / SR, rel=0.05)


@pytest.mark.parametrize("bpm", [90, 120, 150])
def test_tempo_and_beats(bpm):
    got, beats = G.beats(G.onset_strength(clicks(bpm, 15)))
    assert got == pytest.approx(bpm, rel=0.05)
    assert np.median(np.diff(beats)) == pytest.approx(60 / bpm, rel=0.06)


def test_pitch_within_fifty_cents():
    for hz in (110.0, 220.0, 440.0):
        f0, prob = G.pitch(sine(hz, 1), 60, 2000)
        mid = f0[5:-8]
        assert np.isfinite(mid).mean() > 0.9 and abs(1200 * np.log2(np.nanmedian(mid) / hz)) < 50
    assert not np.isfinite(G.pitch(np.zeros(SR), 60, 2000)[0]).any()


def test_hpss_tells_tone_from_click():
    h, p = G.hpss(G.stft(sine(440, 2)))
    assert (h**2).sum() > 5 * (p**2).sum()
    h, p = G.hpss(G.stft(clicks(120, 2)))
    assert (p**2).sum() > (h**2).sum()


def test_chroma_of_a():
    c = G.chroma(sine(440, 1))
    assert c[10].argmax() == 9


def test_peaks_and_harmonics():
    y = sum(sine(200 * n, 1, 0.5 / n) for n in (1, 2, 3, 5))
    f, m = G.spectral_peaks(G.stft(y, 8192)[10], G.frequencies(8192))
    found, fit, dev, rich = G.harmonics(200.0, f, m)
    assert {1, 2, 3, 5} <= set(found) and dev < 30 and 0 < fit <= rich <= 1


def wav_bytes(y):
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(SR)
        w.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    return b.getvalue()


def test_wav_and_null_guard(spark, tmp_path):
    (tmp_path / "tone.wav").write_bytes(wav_bytes(sine(440, 0.3)))
    (tmp_path / "null.wav").write_bytes(wav_bytes(np.zeros(SR)))
    (tmp_path / "bad.wav").write_bytes(b"not audio")
    good, rejects = W.split_null(W.read_wav(spark, str(tmp_path)))
    assert [r.track for r in good.collect()] == ["tone"]
    assert {r.track: r.duration for r in rejects.collect()} == {"null": 1.0, "bad": 0.0}


def test_modules_end_to_end(spark):
    y = clicks(120, 12) + sine(440, 12, 0.1)
    y[int(4 * SR) : int(6 * SR)] = 0
    signals = spark.createDataFrame([("a", y.astype(float).tolist()), ("short", sine(440, 0.3).tolist())], "track string, y array<float>")
    f = M.features(signals).persist()
    stream, events, summary = M.perception(f)
    rows = stream.where("track = 'a'").orderBy("i").collect()
    assert len(rows) == 24 and {"t", "energy", "momentum", "pattern_lock", "breath", "hp_balance", "h_energy", "p_energy"} <= set(stream.columns)
    assert all(0 <= r.momentum <= 1 and 0 <= r.pattern_lock <= 1 for r in rows) and any(r.silence for r in rows)
    s = {r.track: r for r in summary.collect()}
    assert sum(s["a"].pattern_break_counts.values()) == s["a"].pattern_break_count and set(s["short"].pattern_break_counts) == {"pattern_break", "momentum_drop", "momentum_gain", "silence"}
    assert s["a"].breath_positive_pct + s["a"].breath_negative_pct + s["a"].breath_sustain_pct == pytest.approx(100)
    r = {x.track: x for x in M.report(f).collect()}
    assert r["a"].duration_seconds == pytest.approx(12) and r["a"].tempo_bpm == pytest.approx(120, rel=0.06) and len(r["a"].energy_arc) == 10 and "A" in r["a"].dominant_chroma
    hs, hsum = M.harmony(f)
    assert hs.where("track = 'a' AND t > 12").count() == 0 and hsum.count() == 2
    ms, msum = M.melody(f)
    assert ms.where("track = 'a'").count() == 24 and msum.count() == 2
    os_, osum = M.overtones(f)
    assert {x.track for x in osum.collect()} == {"a", "short"}
    plan = M.visual_plan(events, M.report(f), summary, 6)
    assert plan.groupBy("track").count().where("count <> 6").count() == 0
    with pytest.raises(ValueError):
        M.analyse(signals, only=["nosuch"])


def test_constant_q_notes():
    for midi in (24, 40, 57, 69, 88, 106):
        e = G.constant_q(sine(440 * 2 ** ((midi - 69) / 12), 2))
        assert e[40].argmax() == midi - 24 and len(e) == 1 + 2 * SR // G.HOP
    assert (G.chroma(np.zeros(SR)) == 0).all() and len(G.chroma(sine(440, 0.01))) == 1


def test_harmonic_part_keeps_the_tone():
    tone, click = sine(440, 3, 0.3), clicks(120, 3)
    got = G.harmonic_part(tone + click)
    inside = slice(SR, 2 * SR)
    assert np.abs(got[inside] - tone[inside]).max() < 0.05 and len(got) == len(tone)


def test_pitch_follows_a_glide():
    t = np.arange(3 * SR) / SR
    hz = 200 * 2 ** (t / 3)
    f0, prob = G.pitch(0.3 * np.sin(2 * np.pi * np.cumsum(hz) / SR), 60, 2000)
    at = np.arange(10, len(f0) - 10)
    assert np.isfinite(f0[at]).mean() > 0.95
    off = 1200 * np.log2(f0[at] / np.interp(at * G.HOP / SR, t, hz))
    assert np.nanmedian(np.abs(off)) < 50 and (prob <= 1).all()


def test_kernels_bound_their_memory():
    """Medians are taken in stripes; they equal the plain ones."""
    rng = np.random.default_rng(2)
    s = rng.random((70, 40)).astype(np.float32)
    wide = np.pad(s, ((15, 15), (0, 0)), mode="reflect")
    plain = np.stack([np.median(wide[i : i + 31], axis=0) for i in range(70)])
    assert np.allclose(G._median(s, 31, 0), plain) and np.allclose(G._median(s.T, 31, 1), plain.T)


@pytest.mark.parametrize("rate", [44_100, 48_000, 16_000])
def test_resampling_is_band_limited(rate):
    t = np.arange(rate) / rate
    low = W.resample(np.sin(2 * np.pi * 1000 * t), rate, SR)
    want = np.sin(2 * np.pi * 1000 * np.arange(len(low)) / SR)
    assert np.abs(low - want)[500:-500].max() < 1e-2
    if rate > 2 * 13_000:
        assert np.abs(W.resample(np.sin(2 * np.pi * 13_000 * t), rate, SR))[500:-500].max() < 0.05


def test_segment_energies(spark):
    rows = [("a", [0.0, 1.0, 3.0], [1.0, 3.0, 2.0, 4.0, 6.0, 8.0]), ("none", [0.0, 0.0], [])]
    f = spark.createDataFrame(rows, "track string, bounds array<double>, rms array<double>")
    got = M.segment_energies(f, 0.5).collect()
    assert [(r.track, [tuple(s) for s in r.segments]) for r in got] == [("a", [(0.0, 1.0, 2.0, 3.0), (1.0, 3.0, 5.0, 8.0)])]


def test_tonal_centres_are_numpy(spark):
    rng = np.random.default_rng(5)
    c = rng.random((137, 12))
    f = spark.createDataFrame([("a", c.tolist())], "track string, chroma array<array<double>>")
    got = M.tonal_centres(f, 50, 0.5).orderBy("t").collect()
    assert [r.t for r in got] == [12.5, 25.0, 37.5, 50.0]
    for k, r in enumerate(got):
        mean = c[25 * k : 25 * k + 50].mean(0)
        best = max(((np.corrcoef(mean, np.roll(p, root))[0, 1], -2 * root - m, name) for root, name in enumerate(H.NOTES) for m, p in enumerate((H.MAJOR, H.MINOR))))
        assert r.centre.tonal_center == best[2] and r.centre.key_confidence == pytest.approx(max(0.0, best[0]), abs=1e-4)
