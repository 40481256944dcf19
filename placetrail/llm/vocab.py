"""Rank files of public byte-level tokenizers: loading, splitting into words, exact merges."""

from __future__ import annotations

import base64
import functools
import heapq
import importlib.util
import os

import regex

#: Fixed value: the pattern that splits text into words before the merges of the byte-level rank files.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """The place of a vocabulary file: in ``folder``, else $TOKENIZER_DIR, else the installed collection."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, once per process."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


@functools.cache
def word_splitter() -> regex.Pattern:
    return regex.compile(WORD_PATTERN)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the pair of lowest rank, leftmost first, is merged until no pair has a rank.

    A queue of pairs over a linked list of parts: n log n for a word of n bytes, however long it is.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 for a start that was merged away
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            r = ranks.get(word[i : end[stop]])
            if r is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if i > 0:
            r = ranks.get(word[before[i] : stop])
            if r is not None:
                heapq.heappush(queue, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out
