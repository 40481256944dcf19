"""Encoding a corpus with a public byte-level tokenizer (problem 6).

Pass 1 counts the words of the whole corpus, combined within each partition before the shuffle. The most frequent ones
are encoded once and compiled into a lexicon (see ``lexicon``) in the shared folder. Pass 2 looks up the distinct words
of each Arrow batch in the lexicon, merges the words that it lacks exactly, and puts the ids of each text together
with one gather. Texts never leave their task, and nothing but the counted words is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrail.llm.lexicon import compile_lexicon, look_up, open_lexicon, save_lexicon
from placetrail.llm.vocab import load_ranks, merge_word, vocabulary_path, word_splitter
from placetrail.plans.session import shared_path

LEXICON_WORDS = 50_000
FLUSH_WORDS = 200_000


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """How often each word (as the tokenizer splits) occurs in all texts: columns word (binary), n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = word_splitter().findall
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w.encode("utf-8", "surrogatepass") for w in counts]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for text in batch[0].to_pylist():
                if text:
                    counts.update(split(text))
            if len(counts) > FLUSH_WORDS:
                yield flush()
                counts.clear()
        yield flush()

    return texts.select(column).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(counts: DataFrame, ranks_path: str, size: int = LEXICON_WORDS) -> str:
    """Compile the ``size`` most frequent words into a lexicon; gives its folder.

    The driver holds ``size`` words at most; the other words of the corpus are merged where they occur.
    """
    folder = shared_path(counts.sparkSession, "lexicon")
    ranks = load_ranks(ranks_path)
    frequent = counts.where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(size).select("word").collect()
    save_lexicon(compile_lexicon({bytes(r.word): merge_word(bytes(r.word), ranks) for r in frequent}), folder)
    return folder


def encode_words(words: list[bytes], folder: str, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the words, and where each word's ids start (one entry more than words)."""
    lexicon = open_lexicon(folder)
    index = look_up(lexicon, words)
    ids, offset = np.asarray(lexicon["ids"]), np.asarray(lexicon["offset"])
    new = np.flatnonzero(index < 0)
    merged = [merge_word(words[k], load_ranks(ranks_path)) for k in new.tolist()]
    known = np.maximum(index, 0)
    size = offset[known + 1] - offset[known] if len(offset) > 1 else np.zeros(len(words), np.int64)
    size[new] = [len(x) for x in merged]
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    source = np.concatenate([ids, np.array([i for x in merged for i in x], np.int32)])
    origin = offset[known].copy() if len(offset) > 1 else np.zeros(len(words), np.int64)
    origin[new] = len(ids) + np.concatenate([[0], np.cumsum([len(x) for x in merged])])[: len(new)]
    return source[_gather(origin, size)], start


def _gather(origin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions origin[k] .. origin[k] + size[k] - 1 of all k, one after the other."""
    total = int(size.sum())
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
    return np.repeat(origin - begin, size) + np.arange(total)


def encode_corpus(
    documents: DataFrame,
    key: str = "doc_id",
    column: str = "text",
    ranks_path: str | None = None,
    lexicon: str | None = None,
    keep: tuple[str, ...] = (),
    count_only: bool = False,
) -> DataFrame:
    """``key``, the columns of ``keep`` and ``ids`` (array of int) of each row, without special tokens.

    With ``count_only`` their number, ``n_tokens`` (bigint), stands in place of the ids.

    An empty text and a null text have an empty list; the name of a special token inside a text is ordinary text. Every
    row has one row, repeated rows included; other columns are ignored. The words of a text are those of the whole
    text, however long it is. ``lexicon`` is a folder that build_lexicon gave, by default one is built from this corpus.
    """
    ranks_path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")
    folder = lexicon or build_lexicon(word_counts(documents, column), ranks_path)
    name, kind = ("n_tokens", "bigint") if count_only else ("ids", "array<int>")
    kept = {f"kept{n}": c for n, c in enumerate((key, *keep))}
    schema = ", ".join(f"{k} {documents.schema[c].dataType.simpleString()}" for k, c in kept.items())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = word_splitter().findall
        for batch in batches:
            seen: dict[str, int] = {}
            places: list[int] = []
            count = np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(batch["text"].to_pylist()):
                if text:
                    words = split(text)
                    count[k] = len(words)
                    places.extend([seen.setdefault(w, len(seen)) for w in words])
            ids, start = encode_words([w.encode("utf-8", "surrogatepass") for w in seen], folder, ranks_path)
            at = np.array(places, np.int64)
            size = start[at + 1] - start[at] if len(at) else at
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)[np.concatenate([[0], np.cumsum(count)])]
            if count_only:
                out = pa.array(np.diff(ends), pa.int64())
            else:
                flat = ids[_gather(start[at], size)] if len(at) else ids[:0]
                out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in kept), out], names=[*kept, name])

    rows = documents.select(*(F.col(c).alias(k) for k, c in kept.items()), F.col(column).alias("text"))
    return rows.mapInArrow(encode, f"{schema}, {name} {kind}").select(*(F.col(k).alias(c) for k, c in kept.items()), name)
