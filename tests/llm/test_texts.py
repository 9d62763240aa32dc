"""Operators that read one text at a time: rules, classifier, licences, token counts, pieces."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from plinth.llm import licences, pieces, quality_classifier, quality_rules, token_counts
from tests.llm.conftest import rows, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [t for _, t, *_ in rows() if t] + ["  a  b ", "▁x ▁", "日本語 text\n\n", "a" * 700, " ", "\n", "<s> hi </s>", "😀 x 😀😀", "ab" * 300 + " " * 300 + "é" * 200]


def plain_measure(text):
    """The rule measurements by definition."""
    found = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered), sum("A" <= c <= "Z" for c in text or "")


def test_measures_by_definition():
    draw = random.Random(3)
    for n in [0, 1, 7, 8, 9, 20, 60, 200]:
        text = "".join(draw.choice(["a ", "b ", "é\n", "C\t", "# ", "日\x0b"]) for _ in range(n))
        assert quality_rules.measure(text.encode()) == plain_measure(text)
    assert quality_rules.measure(None) == plain_measure(None)


def test_ledger_takes_odd_rows(spark, odd, none):
    judged = quality_rules.ledger(odd)
    assert set(odd.columns) | set(quality_rules.MEASURES) == set(judged.columns)
    found = [(r.doc_id, r.n_words, r.fail_bits & 1, r.bucket) for r in judged.collect()]
    assert len(found) == len(rows()) and all(b == "own bucket" for *_, b in found)
    assert all(fails == (n < 20) for _, n, fails, _ in found)
    assert quality_rules.ledger(none).count() == 0


def test_ablations_agree_with_masks(odd):
    judged = quality_rules.ledger(odd).cache()
    bits = [r.fail_bits for r in judged.select("fail_bits").collect()]
    for r in quality_rules.ablations(judged).collect():
        mask, bit = quality_rules.mask(quality_rules.POLICIES[r.policy]), 1 << quality_rules.RULES[r.rule][0]
        assert r.n_failed == sum(b & bit != 0 for b in bits)
        assert r.n_only_this == sum(b & mask == bit for b in bits)
        assert r.n_kept == sum(b & mask == 0 for b in bits)
        assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)


def test_classifier_held_out_accuracy(spark):
    draw = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        good = draw.random() < 0.7
        text = words(draw.randrange(30, 80), i)
        docs.append((i, text if good else text.upper().replace(" ", "!! ")))
        if draw.random() < 0.5:
            labels.append((i, int(good)))
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    scored = {r.doc_id: r for r in quality_classifier.classify(frame, known).collect()}
    truth = dict(labels)
    held = [scored[i].predicted == truth[i] for i in truth if scored[i].held_out]
    assert len(held) > 50 and np.mean(held) > 0.95 and all(0 <= r.score <= 1 for r in scored.values())


def test_classifier_takes_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 1), (7, 1), (3, 0), (8, 1), (None, 1)], "doc_id long, quality int")
    assert quality_classifier.classify(odd, labels).count() == len(rows())
    assert quality_classifier.classify(none, labels).count() == 0
    assert {r.score for r in quality_classifier.classify(odd, labels.where("false")).collect()} == {0.5}


def test_triggers_cover_all_sentences():
    assert all(any(t in s for t in licences.TRIGGERS) for s in licences.SENTENCES.values())
    assert all(name in licences.SENTENCES for _, sequence in licences.RULES for name in sequence)


def test_licence_rules_take_the_longest(spark, odd, none):
    mit = [s.capitalize() + "." for k, s in licences.SENTENCES.items() if k in ("mit-name", "mit-grant", "mit-notice", "mit-warranty")]
    texts = [" ".join(mit[:1] + ["Copyright someone."] + mit[1:]), " ".join(mit[:2]), "Released under the MIT License.\n" * 2]
    found = {r.doc_id: r.matches for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert found == {0: "MIT", 1: "MIT-reference,MIT-partial", 2: "MIT-reference,MIT-reference"}
    by_id = {r.doc_id: r.licences for r in licences.scan(odd).collect()}
    assert by_id[13] == "CC-BY-NC-4.0,MIT-reference" and by_id[1] == ""
    assert licences.scan(none).count() == 0


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""


def test_wrapped_licences(spark):
    commented = "".join(f" * {line.strip()}\n" for line in GPL.splitlines())
    bullets = BSD.replace("1. ", "(a) ").replace("2. ", "* ")
    parted = MIT.replace("associated documentation files", "associated\n\ndocumentation files")
    texts = [MIT, BSD, BSD + NAMES, GPL, commented, GPL.replace("\n", "\r\n"), bullets, parted.replace("The above", "An above")]
    found = {r.doc_id: (r.matches, r.n_sentences) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    gpl = ("GPL-3.0-or-later", 2)
    assert [found[i] for i in range(8)] == [("MIT", 3), ("BSD-2-Clause", 3), ("BSD-3-Clause", 4), gpl, gpl, gpl, ("BSD-2-Clause", 3), ("", 1)]


def test_counts_equal_the_library(spark, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    truth = sorted((i or 0, len(library.encode(t or ""))) for i, t, *_ in rows())
    for chunk in (token_counts.CHUNK_CHARS, 200):
        found = token_counts.count_tokens(odd, MODEL, chunk=chunk).collect()
        assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == truth
    assert all(r.over_limit == (r.n_tokens > 4096) for r in found)
    assert token_counts.count_tokens(none, MODEL).count() == 0


@pytest.mark.parametrize("overlap", [2, 16, 64])
def test_splices_widen_where_no_boundary_is_stable(overlap):
    model = token_counts.pieces(MODEL)
    for text in ODD_TEXTS:
        assert model.spliced(text, 100, overlap) == len(model.model.encode(text))


def best_score(model, text):
    """Viterbi by definition over one stretch."""
    best = [0.0] + [-float("inf")] * len(text)
    ids = {model.output[i].decode("utf-8", "replace").replace(" ", "▁"): i for i in range(len(model.output)) if model.scores[i]}
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            piece = ids.get(text[start:end])
            if piece is not None:
                best[end] = max(best[end], best[start] + model.scores[piece])
        if ord(text[end - 1]) not in set(model.single.tolist()):
            best[end] = max(best[end], best[end - 1] + model.scores[-1])
    return best[-1]


def test_paths_are_best():
    model = pieces.lattice(MODEL)
    stretches = sorted({"▁" + w for t in ODD_TEXTS for w in t.replace("▁", "").split()[:12]}, key=len, reverse=True)[-60:]
    for stretch, packed in zip(stretches, model.viterbi(stretches)):
        assert packed == model.one(stretch)
        ids = np.frombuffer(packed, np.int32)
        if all(ord(c) in model.single for c in stretch):
            assert model.scores[ids].sum() == best_score(model, stretch)


def test_round_trip(spark, odd, none):
    for r in pieces.round_trip(odd, MODEL).collect():
        assert r.same == (r.doc_id != 9) and r.n_tokens == len(r.ids)
    model = pieces.lattice(MODEL)
    for text in ODD_TEXTS:
        assert model.decode(np.frombuffer(model.encode([text])[0], np.int32).tolist()) == text.replace("▁", " ")
    assert model.decode([model.byte_ids[0xE6], 10**6, None]) == "�"
    kept = pieces.encode(odd, MODEL)
    assert set(kept.columns) == set(odd.columns) and dict(kept.dtypes)["ids"] == "array<int>"
    assert pieces.round_trip(none, MODEL).count() == 0
