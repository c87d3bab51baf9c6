"""Complex shearlets for edges, after Reisenhofer, Kiefer and King (numpy, one image a call).

A shearlet is given in frequency: along its direction a Mexican hat, sampled half a pixel off the
origin (a phase), on one half plane only; across it a Gaussian whose centre moves with the frequency
along, by the shear.  Places in frequency are centred: m and n run from -size // 2."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tectra.operators.per_image import ring

#: Fixed values of the edge system: scales an octave, octaves, level of shears, anisotropy, and the supports of
#: wavelet and Gaussian as parts of the shorter side.
PER_OCTAVE, OCTAVES, LEVEL, ALPHA = 2, 3.5, 3, 0.8
WAVELET, GAUSSIAN = 7, 20


def cones(level: int = LEVEL) -> tuple[list[int], list[int]]:
    """Shears of all orientations, from 0, and which of them lie in the horizontal cone."""
    side = 2 ** max(level - 2, 0)
    up = list(range(side + 1))
    across = list(range(side, -side - 1, -1)) if level > 1 else [0] * (2 ** (level - 1) + 1)
    rest = 2**level + 2 - len(up) - len(across)
    return up + across + list(range(-rest, 0)), list(range(len(up), len(up) + len(across)))


def centred(n: int) -> np.ndarray:
    return np.arange(n) - n // 2


def hat(n: int, support: float, scale: float) -> np.ndarray:
    """The Mexican hat at centred frequencies, half a sample off the origin."""
    m = centred(n)
    omega = 63 * support / 512 * 2 * np.pi * m / n / scale
    value = 2 * np.pi * omega**2 * np.exp(-(omega**2) / 2) / 2
    if n % 2:
        return value.astype(complex)
    return np.where(m == -(n // 2), 0, value * np.exp(1j * np.pi * m / n))


def bell(n: int, support: float, scale: float, at: np.ndarray, level: int = LEVEL) -> np.ndarray:
    """The Gaussian of a transform of 2 ** (level - 2) * n places, at any places, wrapped."""
    fine = 2 ** (level - 2) * n
    at = (at + fine // 2) % fine - fine // 2
    omega = 74 * support / 512 * 2 * np.pi * at / fine / scale
    return np.exp(-(omega**2) / 2)


@dataclass(frozen=True)
class System:
    """The edge system of one image size; bank is (scale, orientation, m, n)."""

    bank: np.ndarray
    level: int

    @property
    def shears(self) -> list[int]:
        return cones(self.level)[0]


@lru_cache(maxsize=4)
def edge_system(h: int, w: int, per_octave: int = PER_OCTAVE, octaves: float = OCTAVES, level: int = LEVEL, alpha: float = ALPHA) -> System:
    shears, flat = cones(level)
    scales = 2 ** (np.arange(int(per_octave * octaves)) / per_octave)
    wave, gauss, step = min(h, w) / WAVELET, min(h, w) / GAUSSIAN, 2 ** (level - 2)
    m, n = centred(h)[:, None], centred(w)[None, :]
    bank = np.zeros((len(scales), len(shears), h, w), complex)
    for s, scale in enumerate(scales):
        down, along = hat(h, wave, scale)[:, None], hat(w, wave, scale)[None, :]
        for o, k in enumerate(shears):
            if o in flat:
                half = 2 * (m >= 0) * down * bell(w, gauss, scale**alpha, step * n - k * m, level)
            else:
                half = 2 * (n >= 0) * along * bell(h, gauss, scale**alpha, step * m - k * n, level)
                half = -half if o > flat[-1] else half
            bank[s, o] = half
        # A step of height one gives one: by the first orientation's sum over the left half.
        response = np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(bank[s, 0])))
        bank[s] /= abs(response.imag[:, : w // 2].sum())
    return System(bank, level)


def transform(v: np.ndarray, system: System) -> np.ndarray:
    """Coefficients (scale, orientation, y, x) of a half circle."""
    spectrum = np.fft.fft2(v)
    return np.conj(np.fft.ifft2(spectrum * np.conj(np.fft.ifftshift(system.bank, axes=(2, 3)))))


def full_circle(c: np.ndarray, level: int = LEVEL) -> np.ndarray:
    """Coefficients of all directions: opposite ones are negated, and both stand on their own side of an edge."""
    flat = cones(level)[1]
    first, second = c.copy(), -c
    for o in range(c.shape[1]):
        if o in flat:
            first[:, o] = np.roll(c[:, o], 1, axis=1)
        elif o > flat[-1]:
            first[:, o] = np.roll(c[:, o], -1, axis=2)
        else:
            second[:, o] = np.roll(-c[:, o], -1, axis=2)
    return np.concatenate([first, second], axis=1)


def pivots(odd: np.ndarray, mode: str) -> np.ndarray:
    """Scales among which the strongest coefficient is looked for."""
    found = {"all": list(range(odd.shape[0])), "highest": [odd.shape[0] - 1], "lowest": [1]}
    if mode not in found:
        raise ValueError("pivoting scales are all, lowest or highest")
    return np.array(found[mode])


def edges(v: np.ndarray, contrast: float = 4.0, offset: float = 1.0, mode: str = "all", system: System | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edge measure in 0..1, and orientation (0 up to their number, nan where there is no edge).

    Of the strongest odd coefficient's direction, odd coefficients must be as strong on all scales, and
    even ones of scales coarser by offset octaves weak."""
    system = system or edge_system(*v.shape)
    c = full_circle(transform(v, system), system.level)
    skip = int(offset * PER_OCTAVE)
    odd, even = c.imag[skip:], np.abs(c.real[: c.shape[0] - skip])
    some = pivots(odd, mode)
    turns = odd.shape[1]
    best = odd[some].reshape(-1, *v.shape).argmax(axis=0)  # first the scale, then the direction
    po, ps = best % turns, some[best // turns]
    take = lambda a, o: np.take_along_axis(a, o[None, None], axis=1)[:, 0]
    at = lambda o: np.take_along_axis(take(odd, o % turns), ps[None], axis=0)[0]
    top = at(po)
    total = (np.minimum(take(odd, po), top) - take(even, po) - contrast).sum(axis=0)
    score = np.where(top > 0, np.maximum(total, 0) / (len(odd) * np.where(top > 0, top, 1)), 0.0)
    return score, np.where(score > 0, tangent(po, top, at, turns, system.level), np.nan)


def tangent(po: np.ndarray, top: np.ndarray, at, turns: int, level: int = LEVEL) -> np.ndarray:
    """Orientation between whole ones, by a parabola through the neighbours' strengths.  Where two cones meet their
    border orientations are the same, so the neighbour beyond is taken, and the stronger of the two is the middle."""
    flat = cones(level)[1]
    half = turns // 2
    before = np.isin(po % half, [flat[0] - 1, flat[-1]])  # the next orientation is the same one
    after = np.isin(po % half, [flat[0], flat[-1] + 1])  # the one before is
    low = lambda o: np.maximum(at(o), 0)
    left, right = low(po - np.where(after, 2, 1)), low(po + np.where(before, 2, 1))
    rtop, ltop = np.where(before, low(po + 1), top), np.where(after, low(po - 1), top)
    right, left = np.where(before, np.minimum(right, rtop), right), np.where(after, np.minimum(left, ltop), left)
    with np.errstate(invalid="ignore", divide="ignore"):
        turn = right / rtop > left / ltop
        l2, r2 = np.where(turn, rtop * left / ltop, left), np.where(turn, right, ltop * right / rtop)
        mid, peak = np.where(turn, po + before, po - after), np.where(turn, rtop, ltop)
        return np.mod(mid + (r2 - l2) / (4 * peak - 2 * (r2 + l2)), half)


def degrees(orientation: np.ndarray, level: int = LEVEL) -> np.ndarray:
    """Orientations as degrees: shears between whole ones in proportion, by cone; nan stays."""
    shears, flat = cones(level)
    o = np.nan_to_num(orientation, nan=0.0)
    whole = np.minimum(np.floor(o).astype(int), len(shears) - 1)
    k = np.array([*shears, 0])
    slope = np.degrees(np.arctan(((1 - (o - whole)) * k[whole] + (o - whole) * k[whole + 1]) / 2 ** (level - 2)))
    found = np.where((o >= flat[0]) & (o <= flat[-1]), 90 + slope, np.where(o < flat[0], 180 - slope, -slope))
    return np.where(np.isnan(orientation), np.nan, found)


def bend(angles: np.ndarray) -> np.ndarray:
    """Half the turn of angles along a line: pixels with just two neighbours that have an angle; -1 elsewhere, 0 at
    the border."""
    p = np.where(np.isnan(angles), -1, angles)
    n = ring(p + 1)[[7, 0, 1, 6, 2, 5, 4, 3]] - 1  # row by row
    valid = n >= 0
    order = np.argsort(~valid, axis=0, kind="stable")
    first, second = (np.take_along_axis(n, order[i][None], axis=0)[0] for i in (0, 1))
    wrap = lambda d: np.mod(d + 450, 180) - 90
    out = np.where((p >= 0) & (valid.sum(axis=0) == 2), np.abs(wrap(p - second) + wrap(first - p)) / 2, -1.0)
    out[[0, -1]] = 0
    out[:, [0, -1]] = 0
    return out
