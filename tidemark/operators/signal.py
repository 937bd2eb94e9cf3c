"""Signal kernels on a track's samples, in numpy; they run inside applyInPandas, one task holding one track.

Exact equality with other libraries' kernels is no goal; tests hold them to tolerances on synthetic signals.
"""

from __future__ import annotations

import numpy as np

SR, HOP, FRAME = 22_050, 512, 2_048
BLOCK = 512  # frames that a kernel holds at once, so that memory does not grow with a track beyond its results


def framed(y: np.ndarray, size: int, hop: int, centre: bool = True) -> np.ndarray:
    """Overlapping frames [frame, sample]; centred frames see zeros beyond the ends."""
    y = np.asarray(y, dtype=np.float64)
    if centre:
        y = np.pad(y, size // 2)
    if len(y) < size:
        y = np.pad(y, (0, size - len(y)))
    return np.lib.stride_tricks.sliding_window_view(y, size)[::hop]


def rms(y: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Root mean square of centred frames, from cumulative sums."""
    y = np.pad(np.asarray(y, dtype=np.float64), size // 2)
    total = np.concatenate([[0.0], np.cumsum(y * y)])
    at = np.arange(0, max(1, len(y) - size + 1), hop)
    return np.sqrt(np.maximum(0.0, total[np.minimum(at + size, len(y))] - total[at]) / size)


def _window(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def stft(y: np.ndarray, size: int = FRAME, hop: int = HOP, only: np.ndarray | None = None) -> np.ndarray:
    """Magnitudes [frame, bin] (32 bits) with a periodic Hann window; ``only`` picks frames before they are transformed."""
    f = framed(y, size, hop)
    at = np.arange(len(f)) if only is None else np.asarray(only, dtype=np.int64)
    out = np.empty((len(at), size // 2 + 1), np.float32)
    for i in range(0, len(at), BLOCK):
        out[i : i + BLOCK] = np.abs(np.fft.rfft(f[at[i : i + BLOCK]] * _window(size), axis=1))
    return out


def frequencies(size: int = FRAME, sr: int = SR) -> np.ndarray:
    return np.arange(size // 2 + 1) * sr / size


def centroid(s: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Spectral centroid of magnitudes [frame, bin]; 0 for silence."""
    total = s.sum(1)
    return np.where(total > 0, (s @ freq) / np.where(total > 0, total, 1), 0.0)


def zero_crossings(y: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Share of sign changes in centred frames."""
    turn = np.r_[False, np.signbit(y[1:]) != np.signbit(y[:-1])] if len(y) else np.zeros(0, bool)
    return framed(turn, size, hop).mean(1)


def mel_filters(sr: int = SR, size: int = FRAME, n: int = 128) -> np.ndarray:
    """Triangular mel filters [band, bin] of equal area."""
    mel = lambda f: np.where(f < 1000, 3 * f / 200, 15 + 27 * np.log(np.maximum(f, 1) / 1000) / np.log(6.4))
    hz = lambda m: np.where(m < 15, 200 * m / 3, 1000 * np.exp(np.log(6.4) * (m - 15) / 27))
    edge = hz(np.linspace(0, float(mel(np.float64(sr / 2))), n + 2))
    f = frequencies(size, sr)
    up = (f[None, :] - edge[:-2, None]) / np.diff(edge)[:-1, None]
    down = (edge[2:, None] - f[None, :]) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def mel_spectrogram(y: np.ndarray, sr: int = SR) -> np.ndarray:
    return stft(y) ** 2 @ mel_filters(sr).T


def onset_strength(y: np.ndarray, sr: int = SR) -> np.ndarray:
    """Mean positive rise of the mel bands in decibels."""
    db = 10 * np.log10(np.maximum(1e-10, mel_spectrogram(y, sr)))
    db = np.maximum(db, db.max() - 80)
    return np.r_[0.0, np.maximum(0, np.diff(db, axis=0)).mean(1)]


def onsets(strength: np.ndarray, sr: int = SR, hop: int = HOP) -> np.ndarray:
    """Times of local maxima that stand out from their surroundings, 30 ms apart at least."""
    if not strength.size or strength.max() <= 0:
        return np.zeros(0)
    x = strength / strength.max()
    w = max(1, int(0.1 * sr / hop))
    padded = np.pad(x, w, mode="edge")
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * w + 1)
    peak = (x >= around[:, w - 1 : w + 2].max(1)) & (x >= around.mean(1) + 0.07)
    out: list[int] = []
    for i in np.flatnonzero(peak):
        if not out or i - out[-1] > max(1, int(0.03 * sr / hop)):
            out.append(int(i))
    return np.array(out) * hop / sr


def tempo(strength: np.ndarray, sr: int = SR, hop: int = HOP, prior: float = 120.0) -> float:
    """Beats a minute: the peak of the onset autocorrelation, weighted log-normally around ``prior``."""
    if len(strength) < 8 or strength.max() <= 0:
        return 0.0
    x = strength - strength.mean()
    n = 1 << int(np.ceil(np.log2(2 * len(x))))
    ac = np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2)[: len(x)]
    lag = np.arange(1, len(x))
    bpm = 60 * sr / (hop * lag)
    ok = (bpm >= 30) & (bpm <= 320)
    if not ok.any():
        return 0.0
    score = ac[1:] * np.exp(-0.5 * (np.log2(bpm / prior)) ** 2)
    return float(bpm[ok][np.argmax(score[ok])])


def beats(strength: np.ndarray, sr: int = SR, hop: int = HOP) -> tuple[float, np.ndarray]:
    """(tempo, beat times): the path that gains most from onsets and loses by leaving the period, by dynamic programming."""
    bpm = tempo(strength, sr, hop)
    if not bpm:
        return 0.0, np.zeros(0)
    period = 60 * sr / (hop * bpm)
    x = strength / (strength.std() + 1e-12)
    spread = np.arange(-int(period), int(period) + 1)
    x = np.convolve(x, np.exp(-0.5 * (spread * 32 / period) ** 2))[int(period) : int(period) + len(x)]
    back = np.arange(-int(2 * period), -max(1, int(period / 2)) + 1)
    cost = -100 * np.log(-back / period) ** 2
    total, link = x.copy(), np.full(len(x), -1)
    for i in range(len(x)):
        j = i + back
        ok = j >= 0
        if ok.any():
            score = total[j[ok]] + cost[ok]
            k = int(np.argmax(score))
            if score[k] > 0:
                total[i], link[i] = x[i] + score[k], j[ok][k]
    tops = np.flatnonzero((total[1:-1] >= total[:-2]) & (total[1:-1] > total[2:])) + 1
    if not len(tops):
        return bpm, np.zeros(0)
    good = tops[total[tops] >= 0.5 * np.median(total[tops])]
    at, out = int(good[-1]), []
    while at >= 0:
        out.append(at)
        at = int(link[at])
    found = np.array(out[::-1])
    loud = strength[found] > 0.05 * strength.max()
    keep = np.flatnonzero(np.maximum(loud, np.r_[loud[1:], False]))
    return bpm, found[keep[0] : keep[-1] + 1] * hop / sr if len(keep) else np.zeros(0)


def _median(s: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Running median along ``axis``, mirrored at the ends; worked through in stripes across it."""
    if axis == 1:
        return _median(s.T, size, 0).T
    wide = np.pad(s, ((size // 2, size // 2), (0, 0)), mode="reflect" if len(s) > size // 2 else "edge")
    out = np.empty_like(s)
    width = max(1, (8 << 20) // (size * max(1, len(s)) * s.itemsize))
    for i in range(0, s.shape[1], width):
        around = np.lib.stride_tricks.sliding_window_view(wide[:, i : i + width], size, axis=0)
        out[:, i : i + width] = np.partition(around, size // 2, axis=-1)[..., size // 2]
    return out


def hpss(s: np.ndarray, size: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """Harmonic and percussive parts of magnitudes [frame, bin]: median filters along time and frequency, soft masks."""
    mask = _harmonic_mask(s, size)
    return s * mask, s * (1 - mask)


def _harmonic_mask(s: np.ndarray, size: int = 31) -> np.ndarray:
    h, p = _median(s, size, 0) ** 2, _median(s, size, 1) ** 2
    total = h + p
    return np.divide(h, total, out=np.full_like(total, 0.5), where=total > 0)


def harmonic_part(y: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """The signal whose spectrum is the harmonic part of y's: masked frames, windowed again and overlapped."""
    y = np.asarray(y, dtype=np.float64)
    mask, f, window = _harmonic_mask(stft(y, size, hop)), framed(y, size, hop), _window(size)
    out, weight = np.zeros(len(y) + 2 * size), np.zeros(len(y) + 2 * size)
    for i in range(0, len(f), BLOCK):
        back = np.fft.irfft(np.fft.rfft(f[i : i + BLOCK] * window, axis=1) * mask[i : i + BLOCK], size, axis=1) * window
        for k, row in enumerate(back, i):
            out[k * hop : k * hop + size] += row
            weight[k * hop : k * hop + size] += window * window
    half = size // 2
    return (out / np.maximum(weight, 1e-8))[half : half + len(y)]


OCTAVES = 7  # from C1 (32.7 Hz)
_HALF_BAND = 0.5 * np.sinc(np.arange(-31, 32) / 2) * np.hanning(65)[1:-1]


def constant_q(y: np.ndarray, sr: int = SR, hop: int = HOP, low: float = 440 * 2 ** (-45 / 12)) -> np.ndarray:
    """Magnitudes [frame, note] of 12 notes an octave over OCTAVES from ``low``, each with a window of 1 / (2^(1/12) - 1) periods.

    An octave's twelve kernels serve all: the signal is halved in rate from octave to octave, from the highest down.
    """
    y = np.asarray(y, dtype=np.float64)
    frames, quality = 1 + len(y) // hop, 1 / (2 ** (1 / 12) - 1)
    notes = low * 2 ** (OCTAVES - 1) * 2 ** (np.arange(12) / 12)
    size = 1 << int(np.ceil(np.log2(quality * sr / notes[0])))
    at = np.arange(size) - size // 2
    width = (quality * sr / notes)[:, None]
    kernel = np.where(np.abs(at) <= width / 2, 0.5 + 0.5 * np.cos(2 * np.pi * at / width), 0) * np.exp(-2j * np.pi * notes[:, None] * at / sr) / width
    out = np.zeros((frames, 12 * OCTAVES))
    for octave in range(OCTAVES - 1, -1, -1):
        halved = OCTAVES - 1 - octave
        wide = np.pad(y, (size // 2, size // 2 + hop))
        view = np.lib.stride_tricks.sliding_window_view(wide, size)
        centre = np.minimum(np.arange(frames) * hop >> halved, len(view) - 1)
        for i in range(0, frames, 4 * BLOCK):
            out[i : i + 4 * BLOCK, 12 * octave : 12 * octave + 12] = np.abs(view[centre[i : i + 4 * BLOCK]] @ kernel.T)
        y = np.convolve(y, _HALF_BAND, "same")[::2] if len(y) > len(_HALF_BAND) else y[::2]
    return out


def chroma(y: np.ndarray, sr: int = SR, hop: int = HOP) -> np.ndarray:
    """Twelve pitch classes [frame, 12]: constant-Q magnitudes summed over the octaves, the largest 1 (0 in silence)."""
    e = constant_q(y, sr, hop)
    c = e.reshape(len(e), OCTAVES, 12).sum(1)
    top = c.max(1, keepdims=True)
    return np.where(top > 1e-8, c / np.where(top > 0, top, 1), 0.0)


THRESHOLDS = np.arange(1, 101) / 100
_beta = THRESHOLDS * (1 - THRESHOLDS) ** 17  # density of a beta distribution with parameters 2 and 18, mean 0.1
PRIOR = _beta / _beta.sum()
CENTS_A_STATE = 10.0
_ABSENT = 0.01  # weight of the deepest dip where no threshold is met


def _differences(f: np.ndarray, size: int) -> np.ndarray:
    """Cumulative-mean-normalised difference [frame, lag] of frames of 2 * size samples."""
    n = 4 * size
    corr = np.fft.irfft(np.fft.rfft(f, n, axis=1) * np.conj(np.fft.rfft(f[:, :size], n, axis=1)), axis=1)[:, :size]
    energy = np.concatenate([np.zeros((len(f), 1)), np.cumsum(f * f, axis=1)], axis=1)
    lag = np.arange(size)
    diff = np.maximum(0, energy[:, [size]] + energy[:, lag + size] - energy[:, lag] - 2 * corr)
    out = np.ones_like(diff)
    out[:, 1:] = diff[:, 1:] * lag[1:] / np.maximum(np.cumsum(diff[:, 1:], axis=1), 1e-12)
    return out


def _candidates(norm: np.ndarray, loud: np.ndarray, low: float, high: float, sr: int, states: int) -> np.ndarray:
    """Probability of each pitch state [frame, state]: every threshold votes, with its prior, for the first dip below it."""
    first, last = max(2, int(sr / high)), min(norm.shape[1] - 2, int(np.ceil(sr / low)))
    d = norm[:, first : last + 1]
    dip = (d <= norm[:, first - 1 : last]) & (d < norm[:, first + 1 : last + 2])
    out = np.zeros((len(norm), states))
    for i in np.flatnonzero(loud):
        at = np.flatnonzero(dip[i])
        if not len(at):
            continue
        depth = np.minimum.accumulate(d[i, at])  # the first dip below a threshold is one that is deeper than all before it
        leads = np.flatnonzero(np.r_[True, depth[1:] < depth[:-1]])
        which = np.searchsorted(-depth[leads], -THRESHOLDS, side="right")  # the first lead below each threshold
        met = which < len(leads)
        weight = np.bincount(which[met], weights=PRIOR[met], minlength=len(leads))
        weight[-1] += _ABSENT * PRIOR[~met].sum()
        lag = at[leads] + first
        a, b, c = norm[i, lag - 1], norm[i, lag], norm[i, lag + 1]
        bend = a - 2 * b + c
        shift = np.divide(0.5 * (a - c), bend, out=np.zeros_like(bend), where=np.abs(bend) > 1e-12)
        place = np.rint(1200 * np.log2(sr / (lag + np.clip(shift, -0.5, 0.5)) / low) / CENTS_A_STATE)
        np.add.at(out[i], np.clip(place, 0, states - 1).astype(np.int64), weight)
    return out


def pitch(y: np.ndarray, low: float, high: float, sr: int = SR, size: int = FRAME, hop: int = HOP, reach: float = 36.0, switch: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(f0 with NaN where unvoiced, voiced probability) by probabilistic YIN.

    Every frame's dips are pitch candidates, weighted by how many thresholds choose them; a Viterbi path over a lattice
    of CENTS_A_STATE, voiced and unvoiced, moves at most ``reach`` semitones a second and switches voicing rarely.
    """
    f = framed(y, 2 * size, hop)
    states = int(np.ceil(1200 * np.log2(high / low) / CENTS_A_STATE)) + 1
    seen = np.empty((len(f), states), np.float32)
    for i in range(0, len(f), BLOCK):
        part = f[i : i + BLOCK]
        loud = np.sqrt((part[:, :size] ** 2).mean(1)) > 1e-4
        seen[i : i + BLOCK] = _candidates(_differences(part, size), loud, low, high, sr, states)
    voiced = np.minimum(seen.sum(1), 1.0)
    far = max(1, int(round(reach * 100 / CENTS_A_STATE * hop / sr)))
    step = np.log((far + 1 - np.abs(np.arange(-far, far + 1))) / (far + 1) ** 2)
    stay, leave = np.log(1 - switch), np.log(switch)
    on, off = np.full(states, -np.log(2 * states)), np.full(states, -np.log(2 * states))
    moves = np.empty((len(f), 2, states), np.int8)  # the step into each state
    turned = np.empty((len(f), 2, states), bool)  # whether voicing switched there
    for t in range(len(f)):
        best = []
        for x in (on, off):
            around = np.lib.stride_tricks.sliding_window_view(np.pad(x, far, constant_values=-np.inf), 2 * far + 1) + step
            k = around.argmax(1)
            best.append((around[np.arange(states), k], k - far))
        (a, ka), (b, kb) = best
        to_on, to_off = a + stay < b + leave, b + stay < a + leave
        moves[t, 0], moves[t, 1] = np.where(to_on, kb, ka), np.where(to_off, ka, kb)
        turned[t, 0], turned[t, 1] = to_on, to_off
        on = np.where(to_on, b + leave, a + stay) + np.log(seen[t] + 1e-12)
        off = np.where(to_off, a + leave, b + stay) + np.log((1 - voiced[t]) / states + 1e-12)
        top = max(on.max(), off.max())
        on, off = on - top, off - top
    side = int(off.max() > on.max())
    at = int((on, off)[side].argmax())
    f0 = np.full(len(f), np.nan)
    for t in range(len(f) - 1, -1, -1):
        if side == 0:
            f0[t] = low * 2 ** (at * CENTS_A_STATE / 1200)
        at, side = at + int(moves[t, side, at]), side ^ int(turned[t, side, at])
    return f0, voiced


def spectral_peaks(mags: np.ndarray, freqs: np.ndarray, n: int = 30, least_db: float = -60.0, distance: int = 3, prominence: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, magnitudes) of up to n peaks, largest first: local maxima above ``least_db`` of the largest, apart and prominent enough."""
    if not len(mags) or mags.max() <= 0:
        return np.zeros(0), np.zeros(0)
    db = 20 * np.log10(np.maximum(1e-5, mags) / max(1e-5, mags.max()))
    top = np.flatnonzero((db[1:-1] > db[:-2]) & (db[1:-1] >= db[2:]) & (db[1:-1] >= least_db)) + 1
    keep: list[int] = []
    for i in top[np.argsort(-db[top], kind="stable")]:
        if all(abs(i - k) >= distance for k in keep):
            keep.append(int(i))
    tall = []
    for i in keep:
        higher = np.flatnonzero(db > db[i])
        left = higher[higher < i].max() + 1 if (higher < i).any() else 0
        right = higher[higher > i].min() if (higher > i).any() else len(db)
        if db[i] - max(db[left : i + 1].min(), db[i:right].min()) >= prominence:
            tall.append(i)
    tall = np.array(sorted(tall, key=lambda i: -mags[i])[:n], dtype=int)
    return freqs[tall], mags[tall]


def harmonics(f0: float, freqs: np.ndarray, mags: np.ndarray, most: int = 16, cents: float = 50.0) -> tuple[dict[int, tuple], float, float, float]:
    """(n: (freq, ideal, magnitude, deviation), series fit, inharmonicity, richness) of the peaks nearest to f0's multiples."""
    out: dict[int, tuple] = {}
    for n in range(1, most + 1):
        if len(freqs):
            off = 1200 * np.log2(freqs / (n * f0))
            i = int(np.abs(off).argmin())
            if abs(off[i]) <= cents:
                out[n] = (float(freqs[i]), n * f0, float(mags[i]), float(off[i]))
    possible = min(most, int(10_000 / max(f0, 1.0)))
    if not out or possible <= 0:
        return out, 0.0, 0.0, 0.0
    mean = float(np.mean([abs(v[3]) for v in out.values()]))
    rich = len(out) / possible
    return out, rich * max(0.0, 1 - mean / cents), mean, rich


def segments(s: np.ndarray, seconds: float, least: float = 10.0, tail: float = 5.0, width: int = 64) -> list[float]:
    """Boundaries [0, ..., end]: novelty peaks of band energies, ``least`` seconds apart, none within ``tail`` of the end."""
    bands = np.stack([b.mean(1) for b in np.array_split(np.log1p(s), 12, axis=1)], axis=1)
    if len(bands) < 2 * width or seconds <= 0:
        return [0.0, seconds]
    total = np.concatenate([np.zeros((1, 12)), np.cumsum(bands, axis=0)])
    at = np.arange(width, len(bands) - width + 1)
    novelty = np.linalg.norm((total[at + width] - 2 * total[at] + total[at - width]) / width, axis=1)
    out = [0.0]
    for i in np.argsort(-novelty, kind="stable"):
        t = float(at[i]) * seconds / len(bands)
        if novelty[i] <= novelty.mean() + novelty.std():
            break
        if all(abs(t - b) >= least for b in out) and seconds - t > tail:
            out.append(t)
    return sorted(out) + [seconds]
