"""Encoding, mixing and truncated texts."""

import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placetrail.llm import vocab
from placetrail.llm.encoding import build_lexicon, encode_corpus, word_counts
from placetrail.llm.lexicon import compile_lexicon, look_up
from placetrail.llm.mixing import copy_rates, mix, pivot
from placetrail.llm.truncation import _own, truncated, truncation_by_source

RANKS = vocab.vocabulary_path("byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files here")
DOCS = "doc_id bigint, text string, source string, ids string, n_tokens int, block int, word string"


def reference(text):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocab.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids if text else []


TEXTS = [
    "", None, "a", " ", "\n\n", "   spaced   out   ", "it's we'll THEY'RE", "naïve café", "雨の日は閾値の調子が悪いです。", "👩‍🔧 🏽 ﬁ",
    "<|endoftext|> and <|endoftext|>", "ab" * 30_000, "x" * 5_000 + "\t" * 5_000, "عادت العدسة إلى العمل", "\x00​­", "1234567890 12.5",
    "{}[]();:,.!?" * 50, "word " * 3_000,
]


def docs(spark, texts, source="s"):
    rows = [(k, t, source, "clash", 1, 2, "w") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_encoding_is_the_tokenizers(spark):
    want = [reference(t) for t in TEXTS]
    df = docs(spark, TEXTS).repartition(3)
    assert {r.doc_id: r.ids for r in encode_corpus(df).collect()} == dict(enumerate(want))
    few = build_lexicon(word_counts(df), RANKS, size=3)  # nearly every word is merged where it occurs
    assert {r.doc_id: r.ids for r in encode_corpus(df, lexicon=few).collect()} == dict(enumerate(want))
    assert encode_corpus(df.limit(0)).count() == 0
    assert encode_corpus(docs(spark, ["", None])).collect() == [(0, []), (1, [])]
    counted = encode_corpus(df, keep=("source",), count_only=True).collect()
    assert {r.doc_id: (r.source, r.n_tokens) for r in counted} == {k: ("s", len(w)) for k, w in enumerate(want)}
    assert encode_corpus(df.limit(0), count_only=True).count() == 0
    twice = encode_corpus(df.where("doc_id = 6").unionByName(df.where("doc_id = 6"))).collect()
    assert len(twice) == 2


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_words_put_together_are_the_text(text):
    words = vocab.word_splitter().findall(text)
    assert "".join(words) == text
    ranks = vocab.load_ranks(RANKS)
    parts = {i: b for b, i in ranks.items()}
    for w in words:
        raw = w.encode("utf-8", "surrogatepass")
        assert b"".join(parts[i] for i in vocab.merge_word(raw, ranks)) == raw


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), max_size=3), max_size=40), st.lists(st.binary(max_size=6), max_size=20))
def test_lexicon_is_a_dictionary(words, others):
    lexicon = compile_lexicon(words)
    asked = [*words, *others]
    for w, k in zip(asked, look_up(lexicon, asked)):
        got = None if k < 0 else lexicon["ids"][lexicon["offset"][k] : lexicon["offset"][k + 1]].tolist()
        assert got == words.get(w)


def test_lexicon_shares_suffixes():
    words = {f"{p}{s}".encode(): [1] for p in ("walk", "talk", "stalk") for s in ("", "s", "ed", "ing")}
    assert len(compile_lexicon(words)["final"]) <= 13


def test_pivot_keeps_sums_and_rounds():
    rng = np.random.default_rng(0)
    for _ in range(200):
        p = rng.random(rng.integers(0, 40))
        out = pivot(p, rng.random(len(p)))
        inner = (out > 0) & (out < 1)
        assert inner.sum() <= 1 and math.isclose(out.sum(), p.sum(), abs_tol=1e-6)
    draws = np.array([pivot(np.array([0.2, 0.5, 0.3, 0.6, 0.4]), rng.random(5)) for _ in range(20_000)])
    assert np.abs(draws.mean(axis=0) - [0.2, 0.5, 0.3, 0.6, 0.4]).max() < 0.02


def mixture_input(spark):
    rng = np.random.default_rng(1)
    rows = []
    for source, n in (("big", 3000), ("mid", 400), ("small", 60), ("none", 50), (None, 20)):
        for _ in range(n):
            rows.append((len(rows), "word " * int(rng.integers(1, 60)), source, "c", 0, 0, "w"))
    rows += [(len(rows), None, "big", "c", 0, 0, "w"), (len(rows) + 1, "", "mid", "c", 0, 0, "w"), (len(rows) + 2, "word " * 20_000, "big", "c", 0, 0, "w")]
    targets = spark.createDataFrame(
        [("big", 5.0, 1), ("mid", 2.0, 2), ("mid", 1.0, 3), ("small", 2.0, 4), ("absent", 3.0, 2), ("big", None, 2), ("none", -1.0, 2), (None, 1.0, 1), ("small", float("nan"), 2)],
        "source string, target_weight double, max_repeats int",
    )
    return spark.createDataFrame(rows, DOCS), targets


def test_mixing_reaches_shares(spark):
    df, targets = mixture_input(spark)
    for block in (4096, 64):
        mixture, shares = mix(df, targets, block_docs=block, fan_in=4)
        rows = {r.source: r for r in shares.collect()}
        assert set(rows) == {"big", "mid", "small", "absent"}
        assert rows["absent"].mixed_tokens == 0 and rows["absent"].actual_share == 0
        for s, share, most in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)):
            assert abs(rows[s].target_share - share) < 1e-9 and abs(rows[s].actual_share - share) < 0.02, s
            assert rows[s].most_copies <= most
        copies = mixture.collect()
        assert len({r.doc_id for r in copies}) == len(copies) and all(r.copies >= 1 and r.n_tokens > 0 for r in copies)
        used = {}
        for r in copies:
            used[r.source] = used.get(r.source, 0) + r.copies * r.n_tokens
        assert used == {s: rows[s].mixed_tokens for s in used}


def test_mixing_is_the_same_for_any_partitioning_and_total(spark):
    df, targets = mixture_input(spark)
    a, b = (sorted(mix(df.repartition(n), targets)[0].collect()) for n in (1, 5))
    assert a == b
    _, shares = mix(df, targets, total_tokens=1_000_000)  # more than there is: every source at its cap
    assert all(r.mixed_tokens == r.max_repeats * r.available_tokens for r in shares.collect())
    mixture, shares = mix(df.limit(0), targets)
    assert mixture.count() == 0 and all(r.actual_share == 0 for r in shares.collect())


def test_copy_rates_never_pass_the_cap(spark):
    sizes = spark.createDataFrame([(k, "s", 3) for k in range(7)], "row_key bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("s", 1 / 3, 3)], "source string, target_weight double, max_repeats int")
    assert copy_rates(sizes, targets).first().rate == 3.0


WORDS = ["the wheel behind the old motor", "a small camera near the ramp", "our new battery under the lamp"]


def forum():
    rng = np.random.default_rng(3)
    texts = []
    for k in range(600):
        part = [f"{WORDS[rng.integers(3)]} stopped after {rng.integers(9)} laps and then it was fine again" for _ in range(rng.integers(1, 5))]
        texts.append(". ".join(p.capitalize() for p in part) + rng.choice([".", "!", "...", " :)", ". lol", "", ". https://x.test/t/1"]))
    return texts


def test_truncated_texts(spark):
    good = forum()
    cut = {
        "word": "The wheel behind the old motor stopped after 3 laps and th",
        "sentence": "The wheel behind the old motor stopped after 3 laps and then it was",
        "space": "A small camera near the ramp stopped after ",
        "markup": "A small camera near the ramp stopped [/quo",
        "entity": "A small camera near the ramp &am",
        "signed": "A small camera near the ramp stopped after 3 laps and then it\n-- \nme | my bike",
        "marked": "Our new battery under the lamp stopped after 3 laps and th...",
    }
    fine = [
        "", None, "   ", "lol", "Our new battery under the lamp stopped after 3 laps and then it was fine again\n-- \nme | my bike",
        "[quote=me]A small camera near the ramp was fine again.\nOur new battery was fine again.",
        "> A small camera near the ramp stopped after 3 laps and then it was fine again.", "> Our new battery [...]\n\nIt was fine again. lol", "[code]set a = 1[/code]", "<br>", "x" * 200_000 + ".",
    ]
    texts = [*good, *cut.values(), *fine]
    df = docs(spark, texts, None)
    found = truncated(df)
    got = {r.doc_id for r in found.select("doc_id").collect()}
    assert got == set(range(len(good), len(good) + len(cut)))
    report = truncation_by_source(df, found).collect()
    assert len(report) == 1 and report[0].n_truncated == len(cut)
    assert truncated(df.limit(0)).count() == 0


def test_signatures_of_every_form_are_taken_off(spark):
    marks = ["\n-- \nJo", "\r\n--\r\nJo\r\nBonn", "\n_____\nJo", "\n________\r\nJo", "\n<hr/> <small>Jo</small>", "\n<hr>\n<small>x", "\nSent from my phone"]
    kept = ["a -- b", "a\n-b", "a\n---\nb", "a <hr> b", "Sent from my desk", "a\n____\nb", "a"]
    df = docs(spark, ["own part" + m for m in marks] + kept + [None, "", "  "])
    df.createOrReplaceTempView("signed")
    got = {r.doc_id: r.body for r in spark.sql(_own("signed")).collect()}
    assert got == dict(enumerate(["own part"] * len(marks) + kept))


def test_field_limit_is_found(spark):
    long_ = [" ".join(g.rstrip(".!") for g in forum()[k : k + 9]) for k in range(0, 500, 9)]
    texts = [*forum(), *(t[:300] for t in long_)]
    df = docs(spark, texts, "wall")
    found = truncated(df)
    assert {(r.limit_unit, r.limit_length) for r in found.collect()} == {("chars", 300)}
    got = {r.doc_id for r in found.collect()}
    sure = {600 + k for k, t in enumerate(long_) if len(t) > 300 and t[299].isalpha()}
    assert len(got & sure) >= 0.95 * len(sure)
    assert not [k for k in got if k < 600]
