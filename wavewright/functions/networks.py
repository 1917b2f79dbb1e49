"""NumPy forward passes of a one-dimensional residual U-Net and of a patch discriminator, for weights that a user brings.

Weights are a flat dictionary of arrays: ``<block>.<part>.w`` [out, in, taps], ``.b`` [out], and for normalised parts
``.gain`` and ``.shift`` [out]. Blocks are ``stem``, ``down0`` ..., ``up0`` ... (deepest first, with a ``project`` part) and
``out``; a block's parts are ``first`` (5 taps) and ``second`` (3 taps).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .errors import AuditError


@dataclass(frozen=True)
class UNetShape:
    base: int = 16
    depth: int = 3
    widest: int = 128
    dropout: float = 0.15
    scale: float = 1.0
    groups: int = 4

    def __post_init__(self):
        if self.depth < 1 or self.base < 1 or not 0 <= self.dropout < 1:
            raise AuditError("depth and width are positive, dropout lies in [0, 1)")

    def channels(self) -> list[int]:
        return [min(self.base << level, self.widest) for level in range(self.depth + 1)]


def norm_groups(channels: int, wanted: int) -> int:
    """The largest number of groups up to ``wanted`` that divides the channels."""
    return next(g for g in range(min(channels, wanted), 0, -1) if channels % g == 0)


def resize(x: np.ndarray, size: int) -> np.ndarray:
    """Linear resampling along time, with sample centres (not ends) kept aligned."""
    at = np.clip((np.arange(size) + 0.5) * x.shape[1] / size - 0.5, 0, x.shape[1] - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, x.shape[1] - 1)
    return x[:, low] * (1 - (at - low)) + x[:, high] * (at - low)


def convolve(x: np.ndarray, w: np.ndarray, b: np.ndarray, stride: int = 1) -> np.ndarray:
    half = w.shape[2] // 2
    padded = np.pad(x, ((0, 0), (half, half)))
    frames = np.lib.stride_tricks.sliding_window_view(padded, w.shape[2], axis=1)[:, ::stride]
    return np.einsum("oik,itk->ot", w, frames, optimize=True) + b[:, None]


def group_norm(h: np.ndarray, groups: int, gain: np.ndarray, shift: np.ndarray) -> np.ndarray:
    g = h.reshape(norm_groups(h.shape[0], groups), -1)
    h = ((g - g.mean(axis=1, keepdims=True)) / np.sqrt(g.var(axis=1, keepdims=True) + 1e-5)).reshape(h.shape)
    return h * gain[:, None] + shift[:, None]


def parameter_count(weights: dict[str, np.ndarray]) -> int:
    return sum(int(np.size(x)) for x in weights.values())


class TemporalUNet:
    def __init__(self, weights: dict[str, np.ndarray], shape: UNetShape | None = None):
        self.w, self.shape = weights, shape or UNetShape()

    def _part(self, x: np.ndarray, name: str, stride: int = 1) -> np.ndarray:
        h = convolve(x, self.w[f"{name}.w"], self.w[f"{name}.b"], stride)
        h = group_norm(h, self.shape.groups, self.w[f"{name}.gain"], self.w[f"{name}.shift"])
        return h / (1 + np.exp(-h))

    def _block(self, x: np.ndarray, name: str, stride: int = 1, drop: np.random.Generator | None = None) -> np.ndarray:
        h = self._part(self._part(x, f"{name}.first", stride), f"{name}.second")
        if drop is not None and self.shape.dropout > 0:
            h = h * (drop.random(h.shape) >= self.shape.dropout) / (1 - self.shape.dropout)
        return h

    def __call__(self, x: np.ndarray, seed: int | None = None) -> np.ndarray:
        """x + a bounded correction; with a seed, dropout stays on and the pass is one stochastic draw."""
        rng = None if seed is None else np.random.default_rng(seed)
        skips = [self._block(np.asarray(x, np.float64)[None], "stem")]
        for level in range(self.shape.depth):
            skips.append(self._block(skips[-1], f"down{level}", 2, rng if level == self.shape.depth - 1 else None))
        h = skips.pop()
        for k, skip in enumerate(reversed(skips)):
            up = convolve(resize(h, skip.shape[1]), self.w[f"up{k}.project.w"], self.w[f"up{k}.project.b"])
            h = self._block(np.concatenate([up, skip]), f"up{k}", 1, rng)
        return np.asarray(x, np.float64) + np.tanh(convolve(h, self.w["out.w"], self.w["out.b"])[0]) * self.shape.scale


def random_weights(shape: UNetShape, seed: int = 0, out_scale: float = 0.0) -> dict[str, np.ndarray]:
    """Weights of the right shapes; with out_scale 0 the network is the identity."""
    rng, w, c = np.random.default_rng(seed), {}, shape.channels()

    def add(name: str, inner: int, outer: int, taps: int, normed: bool = True, scale: float | None = None) -> None:
        w[f"{name}.w"] = rng.normal(size=(outer, inner, taps)) * ((inner * taps) ** -0.5 if scale is None else scale)
        w[f"{name}.b"] = np.zeros(outer)
        if normed:
            w[f"{name}.gain"], w[f"{name}.shift"] = np.ones(outer), np.zeros(outer)

    def block(name: str, inner: int, outer: int) -> None:
        add(f"{name}.first", inner, outer, 5)
        add(f"{name}.second", outer, outer, 3)

    block("stem", 1, c[0])
    for level in range(shape.depth):
        block(f"down{level}", c[level], c[level + 1])
    for k, level in enumerate(reversed(range(shape.depth))):
        add(f"up{k}.project", c[level + 1], c[level], 3, normed=False)
        block(f"up{k}", 2 * c[level], c[level])
    add("out", c[0], 1, 1, normed=False, scale=out_scale)
    return w


@dataclass(frozen=True)
class PatchShape:
    base: int = 16
    layers: int = 3
    widest: int = 128
    groups: int = 4

    def __post_init__(self):
        if self.layers < 1 or self.base < 1:
            raise AuditError("layers and width are positive")

    def channels(self) -> list[int]:
        return [min(self.base << level, self.widest) for level in range(self.layers)]


class PatchDiscriminator:
    """Scores of local patches of an (observation, candidate) pair; each level halves the time resolution.

    Weights: ``level0`` ... (7 taps, stride 2; normalised with ``.gain`` and ``.shift`` from level 1 on), ``mix`` (5 taps)
    and ``out`` (3 taps, one channel).
    """

    def __init__(self, weights: dict[str, np.ndarray], shape: PatchShape | None = None):
        self.w, self.shape = weights, shape or PatchShape()

    def _conv(self, h: np.ndarray, name: str, stride: int = 1) -> np.ndarray:
        return convolve(h, self.w[f"{name}.w"], self.w[f"{name}.b"], stride)

    def __call__(self, observation: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        pair = [np.asarray(x, np.float64) for x in (observation, candidate)]
        if pair[0].ndim != 1 or pair[0].shape != pair[1].shape or not np.isfinite(pair).all():
            raise AuditError("observation and candidate are finite series of one length")
        h = np.stack(pair)
        for level in range(self.shape.layers):
            h = self._conv(h, f"level{level}", 2)
            if level:
                h = group_norm(h, self.shape.groups, self.w[f"level{level}.gain"], self.w[f"level{level}.shift"])
            h = np.where(h > 0, h, 0.2 * h)
        h = self._conv(h, "mix")
        return self._conv(np.where(h > 0, h, 0.2 * h), "out")[0]


def random_patch_weights(shape: PatchShape, seed: int = 0) -> dict[str, np.ndarray]:
    rng, w, inner = np.random.default_rng(seed), {}, 2
    parts = [(f"level{k}", c, 7) for k, c in enumerate(shape.channels())] + [("mix", shape.channels()[-1], 5), ("out", 1, 3)]
    for name, outer, taps in parts:
        w[f"{name}.w"], w[f"{name}.b"] = rng.normal(size=(outer, inner, taps)) * (inner * taps) ** -0.5, rng.normal(size=outer)
        if name.startswith("level") and name != "level0":
            w[f"{name}.gain"], w[f"{name}.shift"] = np.ones(outer), np.zeros(outer)
        inner = outer
    return w
