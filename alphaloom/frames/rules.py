"""Rules on one frame of any size: quality, region masks, keying, refinement, colour correction, selection.

Every function takes numpy arrays of height x width (colours on 0..255, alphas on 0..1) and
returns arrays of that size or numbers of the frame; api.py runs them over DataFrames of frames.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from alphaloom.frames import grid

REGIONS = ("subject", "hair_edge", "luminous_prop", "transparent_effect", "background_residue", "uncertain_edge")


@dataclass(frozen=True)
class Picture:
    """The colours of a frame and what most rules ask of them."""

    r: np.ndarray
    g: np.ndarray
    b: np.ndarray

    @cached_property
    def brightness(self) -> np.ndarray:
        return (self.r + self.g + self.b) / 3

    @cached_property
    def top(self) -> np.ndarray:
        return np.maximum(np.maximum(self.r, self.g), self.b)

    @cached_property
    def chroma(self) -> np.ndarray:
        return self.top - np.minimum(np.minimum(self.r, self.g), self.b)

    @cached_property
    def saturation(self) -> np.ndarray:
        return np.where(self.top > 0, self.chroma / (self.top + 1e-6), 0.0)

    @cached_property
    def screen(self) -> np.ndarray:
        return (self.g > self.r + 30) & (self.g > self.b + 20) & (self.g > 90)

    @cached_property
    def warm(self) -> np.ndarray:
        """Yellow and orange light, whether or not it looks like the screen."""
        return (self.r > 170) & (self.g > 115) & (self.b < 175) & (self.r - self.b > 45) & (self.g - self.b > 8)

    @cached_property
    def purple(self) -> np.ndarray:
        return (self.r > 120) & (self.b > 130) & (self.g < 180)

    @cached_property
    def glare(self) -> np.ndarray:
        """White, blue-white and yellow-white light."""
        white = (self.brightness > 205) & (self.chroma < 70)
        blue = (self.brightness > 185) & (self.b > 150) & (self.g > 140) & (self.r > 130) & (self.chroma < 95)
        yellow = (self.r > 200) & (self.g > 155) & (self.b > 90) & (self.brightness > 165)
        return (white | blue | yellow) & ~self.screen

    @cached_property
    def solid(self) -> np.ndarray:
        return ~self.screen & ((self.brightness > 155) & (self.chroma < 90) | (self.r > self.g + 45) & (self.b > self.g + 15) & (self.brightness > 135))

    @cached_property
    def effect(self) -> np.ndarray:
        """How much a colour looks like a pink or white glow."""
        r, g, b, br, ch = self.r, self.g, self.b, self.brightness, self.chroma
        pink = clip((r - g - 20) / 45) * clip((b - g + 5) / 45)
        haze = np.minimum.reduce([clip((g - b - 10) / 18), clip((g - r + 2) / 14), clip((br - 165) / 40), clip((85 - ch) / 85)])
        return np.maximum(pink, clip((br - 185) / 50) * clip((90 - ch) / 90) * (1 - 0.85 * haze))

    @cached_property
    def swirl(self) -> np.ndarray:
        """Blue, pink and pale colours of a swirl."""
        r, g, b = self.r, self.g, self.b
        return (b > g + 8) | (r > g + 8) & (b > g + 4) | (self.brightness > 150) & (self.chroma < 70) & (g < 205)


def clip(x, lo: float = 0.0, hi: float = 1.0):
    return np.minimum(hi, np.maximum(lo, x))


def smoothstep(x, lo: float, hi: float):
    if hi <= lo:
        return (x >= hi).astype(float)
    t = clip((x - lo) / (hi - lo))
    return t * t * (3 - 2 * t)


def bytes_of(a: np.ndarray) -> np.ndarray:
    """Alphas as whole numbers up to 255, cut off, not rounded."""
    return np.floor(clip(a) * 255)


# --- quality


def edge_mask(a: np.ndarray) -> np.ndarray:
    """Soft alphas beside nearly solid ones."""
    return (a > 0.05) & (a < 0.95) & grid.dilate(a >= 0.95, grid.ellipse(3))


def speckle_mask(a: np.ndarray) -> np.ndarray:
    return grid.kept((a > 0.03) & (a < 0.95) & ~edge_mask(a), 1, 12)


def hole_mask(a: np.ndarray) -> np.ndarray:
    solid = a >= 0.70
    return grid.kept(grid.closed(solid, grid.ellipse(5)) & ~solid, 5)


def residue(a: np.ndarray) -> float:
    return float(a[a < 0.05].sum() / a.size)


def score(edge: float, residue_: float, flicker: float, artifacts: float) -> float:
    return float(clip(1 - min(1.0, 0.35 * edge + 0.20 * residue_ + 0.35 * flicker + 0.50 * min(1.0, artifacts))))


def measured(a: np.ndarray) -> dict:
    """One frame's part of the quality report, and its score alone."""
    a = clip(a)
    edge, speckles, holes, rest = float(edge_mask(a).mean()), int(speckle_mask(a).sum()), int(hole_mask(a).sum()), residue(a)
    return {"edge": edge, "speckles": speckles, "holes": holes, "residue": rest, "cells": a.size, "score": score(edge, rest, 0.0, (speckles + holes) / a.size)}


# --- regions


def luminous(p: Picture, base: np.ndarray) -> np.ndarray:
    """Luminous props: warm shells with what they enclose, and bright cores and halos within reach, as components with some warm cell."""
    shell = p.warm & ~p.screen
    if not shell.any():
        return shell
    bright = (p.brightness > 165) & (p.r > 190) & (p.g > 145) & (p.b > 70) & ~p.screen
    pale = (p.brightness > 185) & (p.r > 175) & (p.g > 150) & (p.b > 95) & (p.chroma < 120) & ~p.screen
    halo = (p.r > 145) & (p.g > 105) & (p.b < 190) & (p.r - p.b > 20) & ~p.screen
    whole = grid.fill_holes(shell, base >= 0.55)
    reach = grid.dilate(whole, grid.ellipse(19)) | (bright | pale) & (grid.distance(whole, 45) <= 45)
    support = (base >= 0.18) | bright | pale | halo
    found = reach & support & (whole | shell | bright | pale | halo)
    found = grid.fill_holes(grid.closed(found, grid.ellipse(11)), reach & support)
    labels, areas = grid.components(found)
    ok = (areas >= 8) & (np.bincount(labels.ravel(), weights=shell.ravel(), minlength=len(areas)) >= 1)
    ok[0] = False
    return ok[labels]


def ownership(p: Picture, a: np.ndarray, base: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The six region masks, which may overlap."""
    a = clip(a)
    base = a if base is None else clip(base)
    lum = luminous(p, base)
    transparent = (a > 0.08) & (a < 0.82) & (base > 0.08) & (p.brightness > 135) & (p.chroma < 120) & ~p.screen & ~lum
    uncertain = (a > 0.05) & (a < 0.95)
    white = (base >= 0.88) & (a >= 0.88) & (p.brightness > 175) & (p.chroma < 70) & ~p.screen
    paper = (base > 0.35) & (a > 0.35) & (p.brightness > 175) & (p.chroma < 45) & ~lum & ~transparent & ~white
    rest = grid.kept(paper, 96)
    return {"subject": (a >= 0.70) & ~rest, "hair_edge": uncertain & (p.brightness > 80) & (p.chroma < 180) & ~lum, "luminous_prop": lum,
            "transparent_effect": transparent, "background_residue": rest, "uncertain_edge": uncertain}


def background_evidence(p: Picture, base: np.ndarray) -> np.ndarray:
    """Blue background away from luminous cores and their cyan halos."""
    core = p.glare & ~p.purple
    if core.any():
        core = grid.closed(grid.kept(core, 12), grid.ellipse(5))
    halo = grid.dilate(core, grid.ellipse(25)) & ~core & (p.b > 140) & (p.g > 120) & (p.r < 155) & (p.brightness > 120) & (base < 0.45) & ~p.purple & ~p.screen
    return ~core & ~halo & ~p.purple & ~p.screen & (p.b > 80) & (p.g > 120) & (p.r < 170) & (p.brightness > 80)


def document_evidence(p: Picture, base: np.ndarray) -> np.ndarray:
    """Large page-like parts at the frame's sides or in its upper part, with little purple in them."""
    page = (base >= 0.55) & (p.brightness > 172) & (p.chroma < 90) & ~p.purple & ~p.screen
    labels, areas = grid.components(grid.closed(page, grid.square(23)))
    h, w = base.shape
    ok = np.zeros(len(areas), bool)
    if len(areas) > 1:
        n = len(areas)
        y, x = np.indices(base.shape)
        flat = labels.ravel()
        top, left, low, right = np.full(n, h), np.full(n, w), np.zeros(n, int), np.zeros(n, int)
        np.minimum.at(top, flat, y.ravel())
        np.minimum.at(left, flat, x.ravel())
        np.maximum.at(low, flat, y.ravel())
        np.maximum.at(right, flat, x.ravel())
        extent = areas / ((low - top + 1) * (right - left + 1))
        beside = (left <= 8) | (top <= 8) | (right + 1 >= w - 8) | (top < h * 0.58)
        purple = np.bincount(flat, weights=p.purple.ravel(), minlength=n) / np.maximum(areas, 1)
        ok = (areas >= 0.006 * h * w) & beside & (extent >= 0.18) & (purple <= 0.10)
        ok[0] = False
    return ok[labels]


def cyan_halo(core: np.ndarray, p: Picture, base: np.ndarray) -> np.ndarray:
    """A band of cyan light around a core, weaker with the distance."""
    near = grid.dilate(core, grid.ellipse(25)) & ~core & (p.b > 140) & (p.g > 120) & (p.r < 150) & (p.brightness > 120) & (base < 0.45) & ~p.screen
    if not near.any():
        return np.zeros(base.shape)
    weight = clip((14 - grid.distance(core, 14)) / 14)
    return np.where(near, (0.36 + 0.18 * weight) * smoothstep(p.brightness / 255, 0.42, 0.72), 0.0)


def luminous_reconstruction(p: Picture, base: np.ndarray) -> np.ndarray:
    """Bright structures with halos, as an effect layer."""
    core = grid.kept(p.glare, 12)
    if not core.any():
        return np.zeros(base.shape)
    core = grid.closed(core, grid.ellipse(5))
    tinted = (p.brightness > 145) & (p.chroma < 120) | (p.b > 135) & (p.g > 105) & (p.r > 95) | (p.r > 185) & (p.g > 120)
    halo = grid.dilate(core, grid.ellipse(11)) & tinted & ~p.screen
    return clip(np.maximum.reduce([core.astype(float), 0.34 * halo * smoothstep(p.brightness / 255, 0.42, 0.82), cyan_halo(core, p, base)]))


def warm_prop_layer(p: Picture, base: np.ndarray) -> np.ndarray:
    return np.where(grid.kept((base >= 0.60) & p.warm & ~p.screen, 12), np.maximum(base, 0.98), 0.0)


def subject_instance(seed: np.ndarray) -> np.ndarray:
    """The outline of a subject around seeds, holes filled."""
    if not seed.any():
        return seed
    whole = grid.dilate(grid.closed(seed, grid.ellipse(61), 2), grid.ellipse(35))
    return grid.filled(grid.kept(whole, 512))


def subject_integrity(p: Picture, ai: np.ndarray, base: np.ndarray, gate: np.ndarray, active_model: str | None = "gvm", effect_damage: bool = False) -> np.ndarray:
    """Holes of a subject that touch confident parts of it, lifted."""
    if active_model != "gvm" or effect_damage:
        return np.zeros(base.shape)
    blue = (p.b - p.g, p.b - p.r)
    veto = ((p.effect >= 0.70) & (p.chroma <= 90) & (base <= 0.45) | (p.brightness >= 190) & (blue[0] >= 30) & (blue[1] >= 50) & (base <= 0.35)
            | (p.brightness >= 192) & (p.chroma <= 48) & (blue[0] >= 35) & (blue[1] >= 40) & (base <= 0.35) | (p.b > 140) & (p.g > 120) & (p.r < 155) & (p.chroma >= 80) & (base <= 0.45))
    coherent = (base >= 0.20) | (p.r >= 120) & (p.g < 180)
    anchor = ~p.screen & ~veto & ((ai >= 0.75) | (gate >= 0.75))
    reach = grid.dilate(anchor, grid.ellipse(81))
    seed = anchor | reach & ~p.screen & p.solid & coherent & ~veto
    found = (subject_instance(seed) | reach & coherent) & ~p.screen & (base <= 0.55) & coherent & ~veto
    labels, areas = grid.components(found)
    touched = np.zeros(len(areas), bool)
    touched[labels[grid.dilate(grid.dilate(seed, grid.square(7)), grid.square(7)) & found]] = True
    touched &= areas >= 64
    touched[0] = False
    return np.where(touched[labels], clip(0.58 + 0.18 * smoothstep(base, 0.03, 0.55) + 0.18 * gate, 0.0, 0.82), 0.0)


def subject_core(owned: np.ndarray, alpha: np.ndarray, confidence: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """What lies deep within a subject that is sure."""
    sure = (owned >= 0.95) & (confidence >= 0.95) & (alpha >= 0.80) & (evidence < 0.50)
    return grid.erode(grid.closed(sure, grid.ellipse(41)), grid.ellipse(41)) & sure


# --- keying and its post-processing


def clip_levels(a: np.ndarray, black: float, white: float) -> np.ndarray:
    if black <= 0 and white >= 1:
        return a
    return clip((a - black) / (max(white, black + 0.001) - black))


def shrink_grow(a: np.ndarray, cells: int) -> np.ndarray:
    """Erode (negative) or dilate (positive) by an ellipse of so many cells."""
    if not cells:
        return a
    element = grid.ellipse(2 * abs(cells) + 1)
    return (grid.dilate if cells > 0 else grid.erode)(bytes_of(a), element) / 255


def edge_blur(a: np.ndarray, cells: int) -> np.ndarray:
    return np.floor(grid.blurred(bytes_of(a), 2 * cells + 1) + 0.5) / 255 if cells > 0 else a


def key_post(a: np.ndarray, black: float = 0.0, white: float = 1.0, grow: int = 0, blur: int = 0) -> np.ndarray:
    """Levels, then shrink or grow, then blur."""
    return edge_blur(shrink_grow(clip_levels(a, black, white), grow), blur)


def corridor_post(a: np.ndarray, black: float = 0.0, white: float = 1.0, grow: int = 0, blur: int = 0) -> np.ndarray:
    """Shrink or grow, then blur, then levels."""
    return clip_levels(edge_blur(shrink_grow(a, grow), blur), black, white)


def running_mean(x: np.ndarray) -> float:
    """The mean by a running sum, cell after cell, as an engine adds up rows: numpy's mean adds in another order, which turns a comparison of two that are nearly equal."""
    return float(np.add.accumulate(np.ravel(x))[-1]) / x.size


def chroma_key(p: Picture, screen: str = "auto", similarity: float = 0.4, strength: float = 1.0, black: float = 0.0, white: float = 1.0) -> np.ndarray:
    """Alpha of a green or blue screen, cleaned by an opening and a closing."""
    r, g, b = p.r / 255, p.g / 255, p.b / 255
    green, blue = np.maximum(0, g - np.maximum(r, b)), np.maximum(0, b - np.maximum(r, g))
    is_blue = screen == "blue" or screen == "auto" and running_mean(blue) > running_mean(green)
    reference = (0.30 if is_blue else 0.35) * clip(1 + (0.4 - clip(similarity, 0.1, 1.0)) * 0.8, 0.52, 1.35)
    key = clip((blue if is_blue else green) / reference)
    if strength != 1:
        key = key ** (1 / max(strength, 0.1))
    if not is_blue:
        warm = (r > 0.48) & (g > 0.42) & (b < 0.58) & (r - b > 0.16) & (g - b > 0.10) & (r + 0.26 > g)
        key = np.where(warm & (r > 0.62) & (g > 0.50) & (b < 0.50), 0.0, np.where(warm, key * 0.18, key))
    key = key * clip((np.maximum(np.maximum(r, g), b) - 0.03) / 0.07)
    a = 1 - key
    if a.size >= 4096:
        a = np.where(key >= 0.65, 0.0, np.where(key >= 0.5, a * (1 - clip((key - 0.5) / 0.15)), a))
    u8 = bytes_of(clip_levels(a, black, white))
    if u8.max() > 0 and u8.min() < 255:
        u8 = grid.closed(grid.opened(u8, grid.ellipse(3)), grid.ellipse(3))
    return u8 / 255


def green_alpha(p: Picture, grow: int = 0, blur: int = 0, **key) -> np.ndarray:
    return edge_blur(shrink_grow(chroma_key(p, **key), grow), blur)


def black_masks(p: Picture, threshold: float = 0.05) -> dict[str, np.ndarray]:
    br, ch, sat = p.brightness, p.chroma, p.saturation
    black = br <= max(2.0, threshold * 255 * 0.25)
    whole = np.floor(clip(br, 0, 255))
    # Sums of whole colours keep the comparison with the mean of the nine cells around exact.
    total = p.r + p.g + p.b
    contrast = 9 * total - grid.convolved(total, np.ones(3))
    return {"black": black, "smoke": ~black & (br >= 14) & (br <= 64) & (ch <= 14) & (sat <= 0.28),
            "glow": ~black & ((br >= 48) & (ch >= 28) & (sat >= 0.18) | (br >= 112) & (ch <= 34)),
            "particle": ~black & (br >= 8) & (whole == grid.dilate(whole, grid.square(3))) & (contrast >= 27 * 6)}


def subject_edge(a: np.ndarray) -> np.ndarray:
    return grid.dilate(a >= 0.75, grid.square(3)) & (a > 0.02) & (a < 0.75)


def subject_edge_repair(a: np.ndarray) -> np.ndarray:
    return np.where(subject_edge(a), np.maximum(a, 0.72 * grid.blurred(a, 3)), 0.0)


def black_enhanced(p: Picture, base: np.ndarray, threshold: float = 0.05) -> tuple[np.ndarray, np.ndarray, dict]:
    """(alpha, effect alpha, counts): smoke, glow, particles and dark edges lifted on black."""
    base = clip(base)
    m = black_masks(p, threshold)
    smoke = np.maximum(clip((p.brightness - 4) / 48) * 0.30, 0.08) * m["smoke"]
    glow = np.maximum(0.30, 0.78 * np.maximum(smoothstep(p.brightness / 255, 0.08, 0.55), smoothstep(p.saturation, 0.08, 0.45))) * m["glow"]
    particle = np.maximum(0.18, 0.52 * smoothstep(p.brightness / 255, 0.02, 0.20)) * m["particle"]
    effect = np.maximum.reduce([smoke, glow, particle])
    out = np.maximum.reduce([base, effect, subject_edge_repair(base)])
    out = clip(np.where(m["black"] & (base <= 0.01), 0.0, out))
    delta = np.abs(out - base)
    counts = {k: int(m[k].sum()) for k in ("smoke", "glow", "particle", "black")} | {"subject_edge": int(subject_edge(base).sum()), "mean_delta": float(delta[delta > 1e-6].mean()) if (delta > 1e-6).any() else 0.0}
    return out, np.where(m["black"], 0.0, effect), counts


def black_base(p: Picture) -> np.ndarray:
    br = p.brightness
    ramp = np.where(br >= 60, 1.0, np.where(br > 45, (br - 45) / 15 * 0.75, 0.0))
    return np.floor(grid.blurred(bytes_of(ramp), 3) + 0.5) / 255


def black_merged(p: Picture, base: np.ndarray, ai: np.ndarray) -> np.ndarray:
    """Solid parts of a model and a key, with the key's effects softly over them."""
    base, ai = clip(base), clip(ai)
    solid = np.maximum(ai, np.where(base > 0.75, base, 0.0))
    effect = np.maximum(0.35 * smoothstep(base, 0.03, 0.45), black_enhanced(p, base)[1])
    return clip(solid + effect * (1 - solid))


def enhanced_alpha(a: np.ndarray, gamma: float = 0.8, threshold: float = 0.1, gain: float = 1.2, sharpen: float = 0.0) -> np.ndarray:
    """A model's alpha with gamma, lifted low values, stretched high ones and sharper edges."""
    a = a**gamma if gamma != 1 else a
    a = np.where(a < threshold, a * gain, a)
    a = np.where(a > 0.85, 0.85 + (a - 0.85) * 1.1, a)
    return clip(a + (a - grid.blurred(a, 17, 2.0)) * sharpen if sharpen > 0 else a)


def swirl_kept(p: Picture, a: np.ndarray) -> np.ndarray:
    """Small weak spots within supported swirls, lifted."""
    near = grid.dilate(bytes_of(a), grid.square(9)) / 255
    return clip(np.where(p.swirl & (a < 0.42) & (near > 0.45), np.maximum(a, clip(near * 0.58, 0.0, 0.55)), a))


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Linear between cell centres, outermost cells repeated outwards."""
    h, w = a.shape

    def places(n: int, m: int):
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.minimum(x.astype(int), max(n - 2, 0))
        return lo, np.minimum(lo + 1, n - 1), x - lo

    y0, y1, fy = places(h, height)
    x0, x1, fx = places(w, width)
    top, low = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx, a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return top * (1 - fy)[:, None] + low * fy[:, None]


def padded_to(a: np.ndarray, multiple: int = 32) -> np.ndarray:
    """Zeros below and on the right up to a multiple of cells."""
    h, w = a.shape
    return np.pad(a, ((0, -h % multiple), (0, -w % multiple)))


# --- refinement


def trimap(a: np.ndarray, feather: float = 1.0) -> np.ndarray:
    """0 background, 255 foreground, 128 unknown: soft alphas, grown by the feather, and where both sides meet."""
    soft = (a > 0.02) & (a < 0.98)
    grow = int(np.rint(min(2.0, max(0.0, feather))))
    if grow:
        soft = grid.dilate(soft, grid.ellipse(2 * grow + 1))
    band = grid.dilate(a >= 0.95, grid.ellipse(5)) & grid.dilate(a <= 0.05, grid.ellipse(5))
    out = np.where(a >= 0.95, 255, np.where(a <= 0.05, 0, 128))
    return np.where(soft | band, 128, out)


def smoothed(a: np.ndarray, mask: np.ndarray, feather: float = 1.0) -> np.ndarray:
    size = 2 * int(np.rint(2 + 2 * min(2.0, max(0.0, feather)))) + 1
    return clip(np.where(mask, np.floor(grid.blurred(bytes_of(a), size) + 0.5) / 255, a))


def refined(a: np.ndarray, own: dict[str, np.ndarray], feather: float = 1.0) -> tuple[np.ndarray, dict]:
    """(alpha, counts): unknown edges smoothed, luminous and transparent parts not weakened."""
    guarded = own["luminous_prop"] | own["transparent_effect"]
    where = (trimap(a, feather) == 128) & (own["hair_edge"] | own["uncertain_edge"]) & ~guarded
    out = np.where(guarded, np.maximum(smoothed(a, where, feather), a), smoothed(a, where, feather)) if where.any() else a
    delta = np.abs(out - a)
    changed = where & (delta > 1e-6)
    return out, {"changed": int(changed.sum()), "guarded": int(guarded.sum()), "reconstructed": int(where.sum()), "mean_delta": float(delta[changed].mean()) if changed.any() else 0.0}


def despeckled(a: np.ndarray, radius: int = 5, threshold: float = 0.0, p: Picture | None = None, own: dict[str, np.ndarray] | None = None, active_model: str | None = None) -> np.ndarray:
    """Median filter that keeps supported soft alphas, luminous props and transparent effects; what is left below the threshold goes."""
    size, whole, floor_ = 2 * radius + 1, bytes_of(a), 8
    clean = grid.median(whole, size)
    crushed = (whole > floor_) & (clean <= floor_)
    enough = max(4, size * size // 12)
    support = grid.box_sum(whole > floor_, size) + 0.5
    back = crushed & (support >= enough)
    if p is not None and active_model == "gvm":
        half = max(4, enough // 2)
        back = crushed & p.swirl & (support >= half) & (grid.box_sum(p.swirl, size) + 0.5 >= half)
    if p is not None and own is None:
        own = ownership(p, whole / 255)
    if p is not None:
        back = back | crushed & own["transparent_effect"]
    clean = np.where(back, whole, clean)
    if p is not None:
        clean = np.where(own["luminous_prop"], np.maximum(clean, whole), clean)
    limit = int(threshold * 255)
    if limit > 0:
        clean = np.where(clean <= limit, 0, clean)
        if p is not None:
            clean = np.where((own["transparent_effect"] | own["luminous_prop"]) & (whole > 0), np.maximum(clean, whole), clean)
    return clean / 255


# --- colours


def border(shape: tuple[int, int], width: int) -> np.ndarray:
    out = np.ones(shape, bool)
    if shape[0] > 2 * width and shape[1] > 2 * width:
        out[width:-width, width:-width] = False
    return out


def screen_pixels(p: Picture, a: np.ndarray, strict: bool = False) -> np.ndarray:
    """Cells that show the screen: at the border and empty; with fewer than 16, anywhere, then at the border whatever the alpha."""
    edge = border(a.shape, max(min(min(a.shape) // 6, 96), 1))
    like = (p.g > p.r + 12) & (p.g > p.b + 12)
    steps = [edge & (a <= 0.04) & like, (a <= 0.06) & like, edge & like]
    if strict:
        return steps[0]
    return next((m for m in steps if m.sum() >= 16), np.zeros(a.shape, bool))


def median_colour(p: Picture, mask: np.ndarray) -> tuple[float, float, float]:
    return tuple(float(np.median(c[mask])) for c in (p.r, p.g, p.b)) if mask.any() else (0.0, 255.0, 0.0)


def green_screen_colour(p: Picture, a: np.ndarray) -> tuple[float, float, float]:
    """The median colour of greenish border cells without foreground, of all such cells if under 32 are green."""
    edge = border(a.shape, max(min(min(a.shape) // 6, 96), 1))
    empty = a <= 0.02
    if empty.sum() < 64:
        empty = a <= 0.08
    empty = empty & edge
    if empty.sum() < 64:
        empty = edge
    green = empty & (p.g - np.maximum(p.r, p.b) > 10)
    return median_colour(p, green if green.sum() >= 32 else empty)


def unmixed(p: Picture, a: np.ndarray, screen: tuple[float, float, float], floor: float) -> list[np.ndarray]:
    return [clip((c - (1 - a) * s) / np.maximum(a, floor), 0.0, 255.0) for c, s in zip((p.r, p.g, p.b), screen)]


def warm_reach(p: Picture, a: np.ndarray) -> np.ndarray:
    """Within reach of warm or gold-green light."""
    gold = (p.r > 110) & (p.g > 100) & (p.b < 130) & (p.r - p.b > 35) & (p.g - p.b > 35) & (p.g - p.r < 55)
    return grid.dilate((p.warm | gold) & ~p.screen & (a > 0.20), grid.ellipse(19))


def moved(c: list[np.ndarray], where: np.ndarray, gap: np.ndarray, *by: float) -> list[np.ndarray]:
    """Channels shifted by shares of a gap where a mask holds."""
    return [np.where(where, x + gap * v, x) for x, v in zip(c, by)] + c[len(by) :]


def despilled(p: Picture, a: np.ndarray, strength: float = 0.7, edge: float = 1.2, white: tuple[float, float] = (180, 25)) -> list[np.ndarray]:
    """Green taken out of edges, haze and pink haze, half of it given to red and blue; pale cells keep theirs."""
    r, g, b = p.r, p.g, p.b
    glow, soft = (a > 0.005) & (a < 0.85), (a > 0.05) & (a < 0.95)
    haze = (g > r + 4) & (g >= b - 3) & glow
    pink = glow & (p.brightness > 135) & (r > b + 10) & (g > b + 6) & (g > 145)
    thin, f = clip((0.7 - a) / 0.7), strength * edge
    spill = np.maximum(0, g - np.maximum(r, b)) * f * clip((0.95 - a) / 0.9)
    spill = np.where(haze, np.maximum(spill, np.maximum(np.maximum(0, g - r - 2) * f * thin, np.maximum(0, g - np.maximum(r, b) - 3) * f)), spill)
    spill = np.where(pink, np.maximum(spill, np.maximum(0, g - b - 2) * f * thin * 1.55), spill)
    spill = spill * ((g > r + 15) & (g > b + 15) & soft | haze | pink) * np.where(pale(p, white), 0.05, 1.0)
    return [r + spill * 0.5, g - spill, b + spill * 0.5]


def pale(p: Picture, white: tuple[float, float] = (180, 25)) -> np.ndarray:
    return (p.brightness > white[0]) & (np.abs(p.r - p.g) + np.abs(p.g - p.b) + np.abs(p.r - p.b) < white[1])


def beside_warm(c: list[np.ndarray], p: Picture, a: np.ndarray) -> list[np.ndarray]:
    """Solid green spill near warm light, neutralised."""
    where = grid.dilate(p.warm, grid.ellipse(17)) & (a > 0.20) & (p.g > p.r + 12) & (p.g > p.b + 6) & (p.r < 170) & (p.g > 95)
    return moved(c, where, np.maximum(0, p.g - np.maximum(p.r, p.b)), 0.70, -0.45, 0.18)


def _teal(c: list[np.ndarray], over: float) -> tuple[np.ndarray, np.ndarray]:
    return (c[1] > c[0] + over) & (c[2] > c[0] + over), np.maximum(0, np.minimum(c[1] - c[0], c[2] - c[0]))


def beside_ring(c: list[np.ndarray], a: np.ndarray, ring: float = 1.0, like: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Teal around bright rings, neutralised; like: the colours that tell what is a ring, by default these."""
    level, spread = sum(like or c) / 3, np.maximum.reduce(like or c) - np.minimum.reduce(like or c)
    bright = (a > 0.92) & (level > 210) & (spread < 55)
    tinted, gap = _teal(c, 10)
    return moved(c, grid.dilate(bright, grid.ellipse(11)) & ~bright & (a > 0.05) & (a < 0.88) & (spread < 110) & tinted, gap * ring, 0.55, -0.20)


def onto_props(c: list[np.ndarray], a: np.ndarray, prop: np.ndarray) -> list[np.ndarray]:
    """Green left on props, put back towards warm and neutral."""
    where = prop & (a > 0.08) & (c[1] > c[0] + 6) & (c[1] > c[2] + 3)
    return moved(c, where, np.maximum(0, c[1] - np.maximum(c[0], c[2])), 0.45, -0.85, 0.10)


def green_spill_removed(p: Picture, a: np.ndarray, own: dict[str, np.ndarray] | None = None, strength: float = 0.7, edge: float = 1.2, white: tuple[float, float] = (180, 25), ring: float = 1.0) -> list[np.ndarray]:
    """Colours without the screen's green, all steps in order, as whole numbers."""
    c = beside_warm(despilled(p, a, strength, edge, white), p, a)
    mix = clip((np.maximum(0, p.g - p.r) + 0.5 * np.maximum(0, p.g - p.b) - 12) / 64)
    weight = np.where((a > 0.18) & (a < 0.88) & (mix > 0), mix * clip((0.95 - a) / 0.20, 0.70, 1.0), 0.0)
    c = [x * (1 - weight) + y * weight for x, y in zip(c, unmixed(p, a, green_screen_colour(p, a), 0.18))]
    band = (a > 0.02) & (a < 0.78)
    level = sum(c) / 3
    c = moved(c, band & (level < 105) & ~pale(p, white), clip((122 - level) * 0.9, 0, 72), 1.20, 0.12, 1.05)
    level, spread = sum(c) / 3, np.maximum.reduce(c) - np.minimum.reduce(c)
    tinted, gap = _teal(c, 10)
    before = c
    c = moved(c, band & (level > 135) & (spread < 90) & tinted, gap * ring, 0.50, -0.18)
    c = beside_ring(c, a, ring, before)
    cast = (a > 0.45) & (level > 70) & (level < 190) & (c[0] < 130) & (c[2] < 185) & (c[1] > c[0] + 12) & (c[1] > c[2] + 3)
    c = moved(c, cast, np.maximum(0, c[1] - c[0]), 1.15, -0.30)
    c = onto_props(c, a, warm_reach(p, a) | (own if own is not None else ownership(p, a))["luminous_prop"])
    return [np.floor(clip(x, 0, 255)) for x in c]


def hsv_of(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit hue (0 to 179), saturation and value."""
    top = np.maximum(np.maximum(r, g), b)
    d = top - np.minimum(np.minimum(r, g), b)
    safe = np.where(d == 0, 1, d)
    h = np.where(d == 0, 0, np.where(top == r, 60 * (g - b) / safe, np.where(top == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe)))
    h = np.floor(np.where(h < 0, h + 360, h) / 2 + 0.5)
    return np.where(h >= 180, h - 180, h), np.floor(np.where(top > 0, 255 * d / np.where(top == 0, 1, top), 0) + 0.5), top


def rgb_of(h: np.ndarray, s: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """The inverse, rounded to whole numbers."""
    sector, s = h / 30, s / 255
    k = np.floor(sector).astype(int) % 6
    f = sector - np.floor(sector)
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    return [np.floor(np.choose(k, x) + 0.5) for x in ([v, q, p, p, t, v], [t, v, v, q, p, p], [p, p, t, v, v, q])]


def black_spill_removed(p: Picture, a: np.ndarray, strength: float = 0.6, contrast: float = 0.4) -> list[np.ndarray]:
    """Dark edges lifted, grey particles brightened and coloured a little, coloured dark particles left."""
    br, spread = p.brightness, p.chroma
    lift = np.maximum(0, 50 - br) * strength * (1 - a) * 0.3 * ((a > 0.05) & (a < 0.95) & (br < 60))
    h, s, v = hsv_of(*[np.floor(clip(c + lift, 0, 255)) for c in (p.r, p.g, p.b)])
    band = (a > 0.02) & (a < 0.75)
    s = np.where((a > 0.1) & (s < 50) & (v > 15) & (spread < 15), clip(s * (1 + contrast * 0.5), 0, 255), s)
    v = np.where((a > 0.05) & (v < 60) & (v > 5), clip(v * (1 + contrast * 0.2), 0, 255), v)
    dim, haze = band & (v < 70) & (v > 5), band & (s < 32) & (spread < 18) & (v > 10)
    v = np.where(dim, clip(v + clip((78 - v) * 0.35, 0, 18), 0, 255), v)
    s = np.where(haze, clip(s + clip((40 - s) * 0.45, 0, 18), 0, 255), s)
    c = rgb_of(h, np.floor(s), np.floor(v))
    own = (a > 0.1) & (br < 40) & (spread > 10)
    c = [np.where(own, np.floor(x * 0.7 + y * 0.3), x) for x, y in zip(c, (p.r, p.g, p.b))]
    level = sum(c) / 3
    more = clip((58 - level) * 0.35, 0, 10) * (band & (level < 52))
    return [np.floor(clip(x + more * k, 0, 255)) for x, k in zip(c, (0.85, 1.0, 0.9))]


def recovered(p: Picture, a: np.ndarray, own: dict[str, np.ndarray], screen: tuple[float, float, float] | None = None) -> tuple[list[np.ndarray], dict]:
    """(colours, counts): the screen's share taken out of owned soft regions, where that helps."""
    a = clip(a)
    bias = p.g - np.maximum(p.r, p.b)
    mixed = own["uncertain_edge"] & ~own["luminous_prop"] & ~own["hair_edge"] & (bias > 22) & (a < 0.72)
    where = (own["transparent_effect"] | mixed) & ~own["background_residue"] & (a > 0.08) & (a < 0.86) & (bias > 4)
    screen = median_colour(p, screen_pixels(p, a)) if screen is None else screen
    new = unmixed(p, a, screen, 0.16)
    weight = np.where(where, np.maximum(clip((bias - 4) / 32), 0.35) * clip((0.98 - a) / 0.5), 0.0)
    gain = bias - (new[1] - np.maximum(new[0], new[2]))
    change = sum(np.abs(x - y) for x, y in zip(new, (p.r, p.g, p.b))) / 3
    weight = weight * ((gain > 2) & ~((a < 0.16) | (change > 128) & (gain < 24)))
    used = weight > 0
    out = [np.where(used, np.rint(x * (1 - weight) + y * weight), x) for x, y in zip((p.r, p.g, p.b), new)]
    return out, {"attempted": int(where.sum()), "accepted": int(used.sum()), "rejected": int(where.sum() - used.sum()), "mean_weight": float(weight[used].mean()) if used.any() else 0.0}


def prop_restored(a: np.ndarray, base: np.ndarray, own: dict[str, np.ndarray], mode: str = "green", model: str | None = None) -> np.ndarray:
    """Luminous props nearly solid again; only on a green screen and for models that weaken them."""
    if mode != "green" or model not in ("gvm", "traditional_green_fallback", None):
        return clip(a)
    return np.where(own["luminous_prop"], np.maximum(clip(a), np.maximum(clip(base), 0.985)), clip(a))


# --- layers of a green screen: a subject and its effects, from a key (base) and a model (ai)


def soft_subject(p: Picture) -> np.ndarray:
    near = (np.abs(p.r - p.g) < 45) & (np.abs(p.b - p.g) < 45)
    return ~p.screen & near & ((p.brightness > 165) & (p.chroma < 75) | (p.brightness > 150) & (p.brightness < 190) & (p.chroma < 45) & (p.b >= p.r - 5))


def solid_layer(p: Picture, base: np.ndarray) -> np.ndarray:
    return ((base >= 0.94) & ~p.screen | (base >= 0.92) & p.solid | (base >= 0.28) & soft_subject(p)).astype(float)


def ai_solid_layer(p: Picture, ai: np.ndarray, base: np.ndarray) -> np.ndarray:
    glowing = p.effect > 0.45
    sure = (base >= 0.75) | soft_subject(p) & (~glowing | (base >= 0.32)) | p.solid & ~glowing & (base >= 0.55)
    return np.where((ai >= 0.98) & sure, ai, 0.0)


def effect_layer(p: Picture, base: np.ndarray) -> np.ndarray:
    """Soft alphas above the frame's background, as far as colours look like effects."""
    br, ch = p.brightness, p.chroma
    floor = min(float(np.percentile(base, 10)) + 0.02, 0.95)
    out = smoothstep(clip((base - floor) / max(1 - floor, 1e-6)), 0.08, 0.75)
    haze = np.minimum.reduce([clip((p.g - p.b - 8) / 18), clip((p.g - p.r + 4) / 18), clip((br - 150) / 55), clip((95 - ch) / 95)])
    keep = clip(1 - haze * (0.55 + 0.20 * np.maximum(clip((br - 175) / 55), clip((210 - ch) / 210))), 0.2, 1.0)
    ring = 0.35 * np.minimum.reduce([clip((br - 175) / 45), clip((110 - ch) / 110), clip((p.g - np.maximum(p.r, p.b)) / 55), clip(base / 0.28)])
    return clip(np.maximum(out * keep * p.effect, ring))


def subject_confidence(p: Picture, ai: np.ndarray, base: np.ndarray) -> np.ndarray:
    support, either = smoothstep(base, 0.08, 0.42), p.solid | soft_subject(p)
    raw = 0.08 + 0.58 * smoothstep(ai, 0.45, 0.92) + 0.18 * support + 0.10 * ~p.screen + 0.10 * either
    return clip(raw * (1 - 0.9 * p.effect * (1 - 0.75 * support) * (1 - 0.85 * either * support)))


def fallback_mask(p: Picture, base: np.ndarray) -> np.ndarray:
    """Where a key can stand in for a model that lost the subject."""
    either = p.solid | soft_subject(p)
    return ~p.screen & (smoothstep(base, 0.30, 0.72) > 0.35) & (either | (base >= 0.50)) & ((p.effect < 0.35) | either & (base >= 0.45))


def lost_subject(ai: np.ndarray, base: np.ndarray, mask: np.ndarray) -> bool:
    return bool(mask.any() and smoothstep(ai, 0.25, 0.70)[mask].mean() < 0.08 and smoothstep(base, 0.30, 0.72)[mask].mean() >= 0.35)


def broadly_lost(p: Picture, ai: np.ndarray, base: np.ndarray) -> bool:
    broad = ~p.screen & (smoothstep(base, 0.20, 0.50) > 0.30)
    return bool(clip(ai).mean() < 0.06 and broad.mean() >= 0.18 and ((base > 0.08) & (base < 0.75)).mean() >= 0.20 and p.effect[broad].mean() < 0.65)


def subject_recovered(p: Picture, ai: np.ndarray, base: np.ndarray) -> np.ndarray:
    mask = fallback_mask(p, base)
    return np.where(mask, np.maximum(ai, clip(base * 0.98)), ai) if lost_subject(ai, base, mask) else ai


def composed(subject: tuple[np.ndarray, np.ndarray, np.ndarray], effect: tuple[np.ndarray, np.ndarray, np.ndarray], background: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, who owns: subject, effect, background): layers as (alpha, confidence, evidence) compete for every cell."""
    (sa, sc, se), (ea, ec, ee) = ([clip(x) for x in layer] for layer in (subject, effect))
    ss, es = np.maximum.reduce([sa, sc, se]), np.maximum(ec, ee)
    over = (ea > 0) & (ee > 0) & (ee > se)
    back = (sc <= 0) & (ec <= 0) & ~over | (ss <= 0.20) & (es <= 0.35) | (background >= 0.50) & (se <= 0.60) & (ss <= 0.85) & (ee < 0.85) & (es <= 1.0)
    mine = (sc >= ec) & ~over
    theirs = (over | ~mine & (ec > 0)) & ~back
    mine = mine & ~back
    return np.maximum(np.where(mine, sa, 0.0), np.where(theirs, ea, 0.0)), mine, theirs, back


def green_merged(p: Picture, base: np.ndarray, ai: np.ndarray, preserve: float = 0.7, model: str | None = None, semantic: np.ndarray | None = None) -> np.ndarray:
    """A key and a model as one alpha: solid and effect layers, softly one over the other, or for the model 'gvm' in competition, guarded."""
    if preserve <= 0:
        return ai
    base, ai = clip(base), clip(ai)
    gvm = model == "gvm"
    lost = gvm and lost_subject(ai, base, fallback_mask(p, base))
    ai = subject_recovered(p, ai, base) if gvm else ai
    sure = subject_confidence(p, ai, base)
    if semantic is not None:
        sure = np.maximum(sure, smoothstep(clip(semantic), 0.25, 0.75))
    if lost:
        sure = np.where(fallback_mask(p, base), np.maximum(sure, clip(0.25 + 0.90 * smoothstep(base, 0.30, 0.72), 0.0, 0.98)), sure)
    gate = smoothstep(sure, 0.45, 0.80)
    solid = np.maximum.reduce([ai_solid_layer(p, ai, base), ai * gate, solid_layer(p, base), subject_integrity(p, ai, base, gate, model)])
    if semantic is not None:
        solid = np.maximum(solid, np.where(p.screen, 0.0, clip(0.82 * smoothstep(clip(semantic), 0.25, 0.75), 0.0, 0.92)))
    effect = effect_layer(p, base) * preserve * (1 - 0.85 * gate)
    effect = np.maximum.reduce([effect, luminous_reconstruction(p, base) * min(1.0, preserve + 1e-4), warm_prop_layer(p, base)])
    if not gvm:
        return clip(clip(solid) + clip(effect) * (1 - clip(solid)))
    evidence = background_evidence(p, base).astype(float)
    paper = document_evidence(p, base)
    solid = np.where(paper | (evidence >= 0.50) & (sure < 0.85), 0.0, solid)
    effect = np.where(paper | (evidence >= 0.50) & (effect < 0.85), 0.0, effect)
    out, mine, theirs, back = composed((solid, np.maximum(gate, smoothstep(solid, 0.01, 0.35)), sure), (effect, np.maximum(effect, np.where(effect > 0, 0.40 + 0.45 * smoothstep(effect, 0.05, 0.35), 0.0)), effect), evidence)
    out = np.where(subject_core(mine.astype(float), solid, sure, evidence), 1.0, out)
    return fusion_guarded(out, base, mine, theirs, back)[0]


# --- selection among candidates


def region_scores(a: np.ndarray, own: dict[str, np.ndarray]) -> dict[str, float]:
    """How well an alpha fits each region, 0.5 where the region is empty; and overall."""
    a = clip(a)

    def soft(mask: np.ndarray) -> float:
        v = a[mask]
        return float(clip(0.8 * (1 - 2 * np.abs(v - 0.5)).mean() + 0.2 * (1 - (v <= 0.05).mean()))) if len(v) else 0.5

    def level(mask: np.ndarray) -> float:
        return float(a[mask].mean()) if mask.any() else 0.5

    out = {k: soft(own[k]) for k in REGIONS}
    out["subject"] = level(own["subject"])
    out["background_residue"] = 1 - level(own["background_residue"])
    weights = dict(zip(REGIONS, (1.4, 1.1, 1.2, 1.2, 1.3, 0.8)))
    return out | {"overall": float(clip(sum(out[k] * w for k, w in weights.items()) / sum(weights.values())))}


EDGES = ("hair_edge", "uncertain_edge")


def champion(region: str, scores: list[dict[str, float]]) -> int:
    """The candidate that wins a region: each in turn must beat the best so far, at edges by a margin and without falling far behind overall."""
    rank = lambda s: s.get(region, s["overall"]) + 0.10 * s["overall"]
    best = 0
    for k, s in enumerate(scores[1:], 1):
        now = scores[best]
        margin = region not in EDGES or s.get(region, s["overall"]) >= now.get(region, now["overall"]) + 0.03 and s["overall"] >= now["overall"] - 0.05
        if rank(s) > rank(now) and margin:
            best = k
    return best


def guard_reasons(chosen: dict, safe: dict) -> list[str]:
    return [name for name, bad in (("hole_pixels", chosen["holes"] > safe["holes"] + 5), ("overall_score", safe["score"] - chosen["score"] > 0.0003), ("mean_edge_uncertainty", chosen["edge"] - safe["edge"] > 0.001)) if bad]


def best_alone(reports: list[dict]) -> int:
    return min(range(len(reports)), key=lambda k: (reports[k]["holes"], reports[k]["speckles"], -reports[k]["score"], reports[k]["edge"], k))


def selected(alphas: list[np.ndarray], own: dict[str, np.ndarray], scores: list[dict[str, float]] | None = None) -> dict:
    """Each region from its champion, in the order of REGIONS; the whole frame from one candidate where the combination does harm."""
    scores = [region_scores(a, own) for a in alphas] if scores is None else scores
    out, free, decisions = clip(alphas[0]).copy(), np.ones(alphas[0].shape, bool), []
    for region in REGIONS:
        if own[region].any():
            k, mask = champion(region, scores), own[region] & free
            if mask.any():
                out[mask] = clip(alphas[k])[mask]
                free &= ~mask
                decisions.append((region, k, scores[k].get(region, scores[k]["overall"]), int(mask.sum())))
    reasons, chosen, safe, report = [], measured(out), 0, None
    if out.size >= 25:
        reports = [measured(a) for a in alphas]
        safe = best_alone(reports)
        reasons = guard_reasons(chosen, reports[safe])
        subject = next((k for region, k, _, _ in decisions if region == "subject"), None)
        if subject is not None and any(region in EDGES and k != subject for region, k, _, _ in decisions):
            safe = subject
            reasons += [x for x in ("edge_takeover",) if x not in reasons]
            reasons += [x for x in guard_reasons(chosen, reports[safe]) if x not in reasons]
        report = reports[safe]
    if reasons:
        out, free = clip(alphas[safe]).copy(), np.ones(out.shape, bool)
        decisions = []
        for region in REGIONS:
            mask = own[region] & free
            if mask.any():
                free &= ~mask
                decisions.append((region, safe, report["score"], int(mask.sum())))
    return {"alpha": out, "decisions": decisions, "reasons": reasons, "fallback": safe if reasons else None, "chosen": chosen, "safe": report or measured(alphas[0])}


def fusion_guarded(chosen: np.ndarray, base: np.ndarray, subject: np.ndarray, effect: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, list[str], dict, dict]:
    """(alpha, reasons, report, base report): the base alpha where a fused one has more holes, a lower score, more unsure edges, or takes over much of the subject."""
    a, b = measured(chosen), measured(base)
    reasons = []
    if chosen.size >= 25:
        reasons = guard_reasons(a, b)
        if ((base >= 0.70) & (chosen < base - 0.50) & ((effect >= 0.5) | (background >= 0.5))).sum() > 5:
            reasons.append("edge_takeover")
    return (base if reasons else chosen), reasons, a, b


# --- over time


def ema(series: list[np.ndarray], strength: float = 0.5) -> list[np.ndarray]:
    keep, out = 1 - 0.3 * strength, [series[0]]
    for a in series[1:]:
        out.append(keep * out[-1] + (1 - keep) * a)
    return out


def adaptive(series: list[np.ndarray], strength: float = 0.5, low: float = 0.03, high: float = 0.75, blend: float = 0.20) -> list[np.ndarray]:
    """Forwards over the alphas, backwards over that (half as strong), and the mean of both."""

    def pull(a: np.ndarray, by: np.ndarray, w: float) -> np.ndarray:
        weight = clip(3 * np.abs(a - by)) * w * np.where((a < 0.02) | (a > 0.98), 0.1, 1.0)
        return clip(np.where((a > low) & (a < high), (1 - blend) * a + blend * by, (1 - weight) * a + weight * by))

    ahead = [series[0]]
    for a in series[1:]:
        ahead.append(pull(a, ahead[-1], strength))
    back = [ahead[-1]]
    for a in ahead[-2::-1]:
        back.append(pull(a, back[-1], strength / 2))
    return [(f + b) / 2 for f, b in zip(ahead, back[::-1])]


def flow(series: list[np.ndarray], pictures: list[Picture], strength: float = 0.5) -> list[np.ndarray]:
    """The frame before, moved by the global translation between the pictures, lifts what it supports."""
    gray = [np.floor(0.299 * p.r + 0.587 * p.g + 0.114 * p.b + 0.5) / 255 for p in pictures]
    out = [clip(series[0])]
    for k, a in enumerate(series[1:], 1):
        a = clip(a)
        moved = clip(grid.shifted(out[-1], *grid.translation(gray[k - 1], gray[k])))
        out.append(clip(np.where(moved > a, np.maximum(a, a * (1 - strength) + moved * strength), a)))
    return out
