"""From image files to descriptors: decode, resize, crop, normalise, embed, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_PNM = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode_pnm(content: bytes) -> np.ndarray | None:
    """A binary PGM or PPM file as height x width x channels (uint8); None for anything else or a broken file."""
    m = _PNM.match(content or b"")
    if not m or int(m[4]) > 255:
        return None
    width, height, channels = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    body = content[m.end() : m.end() + width * height * channels]
    return np.frombuffer(body, np.uint8).reshape(height, width, channels) if len(body) == width * height * channels else None


def _weights(n: int, m: int) -> np.ndarray:
    """m x n: how bilinear resizing with aligned pixel centres mixes n pixels into m."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    high, part = np.minimum(low + 1, n - 1), at - low
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m), low), 1 - part)
    np.add.at(out, (np.arange(m), high), part)
    return out


def _window(weights: np.ndarray, start: int, size: int) -> np.ndarray:
    """The rows start .. start + size - 1 of a resizing; rows beyond it are 0, which pads with black."""
    part = weights[start : start + size]
    return np.concatenate([part, np.zeros((size - len(part), weights.shape[1]))])


def resize(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, for a stack of images (n x height x width x channels)."""
    return crop_resized(images, height, width, 0, 0, height, width)


def crop_resized(images: np.ndarray, height: int, width: int, top: int, left: int, h: int, w: int) -> np.ndarray:
    """A window of the resized images, without making the rest; what lies beyond is 0."""
    r, c = _window(_weights(images.shape[1], height), top, h), _window(_weights(images.shape[2], width), left, w)
    return np.einsum("ri,nijk,cj->nrck", r, images.astype(float), c, optimize=True)


def halves(images: np.ndarray, size: int = 256, top: int = 4, side: int = 124, right: int = 124, left: int = 4) -> list[np.ndarray]:
    """The right and the left crops of resized images, normalised; decoding is done once for both."""
    return [(crop_resized(images, size, size, top, at, side, side) / 255 - 0.36) / 0.28 for at in (right, left)]


def pooled(crops: np.ndarray, cells: int = 4) -> np.ndarray:
    """A deterministic stand-in for a network: means over a grid of cells, one row per image."""
    rows = np.array_split(crops, cells, axis=1)
    return np.stack([c.mean(axis=(1, 2, 3)) for r in rows for c in np.array_split(r, cells, axis=2)], axis=1)


def embed(make: Callable[[], Callable[[np.ndarray], np.ndarray]] = lambda: pooled, size: int = 256, side: int = 124):
    """For mapInArrow: (id, content) to (id, x), right half before left half; broken images give no row.

    ``make`` builds the network once per task; it takes a stack of crops of equal size.
    """
    top, left, right = (4 * size) // 256, (4 * size) // 256, (124 * size) // 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = make()
        for b in batches:
            shapes: dict[tuple, list[tuple[int, np.ndarray]]] = {}
            for key, content in zip(b[0].to_pylist(), b[1].to_pylist()):
                image = decode_pnm(content)
                if image is not None:
                    shapes.setdefault(image.shape, []).append((key, image))
            for group in shapes.values():
                for s in range(0, len(group), 256):
                    stack = np.stack([image for _, image in group[s : s + 256]])
                    x = np.concatenate([network(h) for h in halves(stack, size, top, side, right, left)], axis=1)
                    ids = pa.array([key for key, _ in group[s : s + 256]], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])

    return run
