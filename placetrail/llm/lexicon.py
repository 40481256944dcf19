"""A lexicon of words as a minimal acyclic transducer over their bytes.

States with the same continuations are one state, so suffixes are shared. Each arc carries a number, and the numbers on
a word's path add up to its index among the sorted words; the index leads to the word's ids. The automaton is a handful
of flat arrays that tasks map into memory, and a whole batch of words walks it at once, one byte a step.
"""

from __future__ import annotations

import functools
import io
import os
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.fs as pafs

ARRAYS = ("arc_key", "arc_to", "arc_add", "final", "offset", "ids")


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The arrays of the transducer for ``words`` (not empty words) with their ids."""
    order = sorted(w for w in words if w)
    register: dict[tuple, int] = {}
    final: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []

    def fix(node: list) -> int:
        """The one state that continues as ``node`` does."""
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(arcs)
            final.append(key[0])
            arcs.append(key[1])
        return state

    path: list[list] = [[False, []]]  # open nodes along the last word: [is final, arcs that are fixed]
    last = b""
    for w in order:
        common = len(os.path.commonprefix([last, w]))
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], fix(node)))
        path.extend([False, []] for _ in w[common:])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], fix(node)))
    root = fix(path[0])

    below = np.zeros(len(arcs), np.int64)  # words from a state on; a state's targets have smaller numbers
    for s, (f, out) in enumerate(zip(final, arcs)):
        below[s] = f + sum(int(below[t]) for _, t in out)
    number = {root: 0}  # the root becomes state 0, so that every walk starts there
    for s in range(len(arcs)):
        if s != root:
            number[s] = len(number)
    key, to, add = [], [], []
    for s, out in enumerate(arcs):
        seen = int(final[s])
        for byte, t in out:
            key.append(number[s] * 256 + byte)
            to.append(number[t])
            add.append(seen)
            seen += int(below[t])
    by = np.argsort(np.array(key, np.int64), kind="stable")
    is_final = np.zeros(len(arcs), bool)
    for s, f in enumerate(final):
        is_final[number[s]] = f
    ids = [words[w] for w in order]
    return {
        "arc_key": np.array(key, np.int64)[by],
        "arc_to": np.array(to, np.int64)[by],
        "arc_add": np.array(add, np.int64)[by],
        "final": is_final,
        "offset": np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64),
        "ids": np.array([i for x in ids for i in x], np.int32),
    }


def look_up(lexicon: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The index of each word in the lexicon, -1 for a word that it does not have."""
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64) if n else length
    text = np.frombuffer(b"".join(words), np.uint8)
    key, to, add, final = (np.asarray(lexicon[k]) for k in ARRAYS[:4])
    out = np.full(n, -1, np.int64)
    alive, state, total = np.flatnonzero(length > 0), np.zeros(n, np.int64), np.zeros(n, np.int64)
    step = 0
    while len(alive) and len(key):
        want = state[alive] * 256 + text[start[alive] + step]
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[at] == want
        alive, at = alive[hit], at[hit]
        state[alive] = to[at]
        total[alive] += add[at]
        step += 1
        done = length[alive] == step
        ended = alive[done & final[state[alive]]]
        out[ended] = total[ended] + 0
        alive = alive[~done]
    return out


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    u = urlparse(folder)
    if u.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(u.path)
    return pafs.FileSystem.from_uri(folder)


def save_lexicon(lexicon: dict[str, np.ndarray], folder: str) -> None:
    """Write the arrays to a folder that all executors share (the caller names a new one each time)."""
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    for name in ARRAYS:
        buffer = io.BytesIO()
        np.save(buffer, lexicon[name])
        with fs.open_output_stream(f"{path}/{name}.npy") as f:
            f.write(buffer.getvalue())


@functools.lru_cache(maxsize=2)
def open_lexicon(folder: str) -> dict[str, np.ndarray]:
    """The arrays, mapped into memory where the folder is a mounted one, else read once per process."""
    fs, path = _file_system(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return {name: np.load(f"{path}/{name}.npy", mmap_mode="r") for name in ARRAYS}
    return {name: np.load(io.BytesIO(fs.open_input_stream(f"{path}/{name}.npy").read())) for name in ARRAYS}
