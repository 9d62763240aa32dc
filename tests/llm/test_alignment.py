"""Cross-tokenizer alignment against a plain evaluation over whole texts."""

from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plinth.llm import alignment
from plinth.llm.alignment import Csr, row_products, transposed

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Plain words of a plain text, and more words.", None, "", " ", "  two  spaces ", "tab\tand\nline\r\n\n end", "déjà vu — naïve café",
    "漢字かな交じり文 と 한국어", "emoji 👩‍👩‍👧 and 🇩🇪", "<|endoftext|> inside <s> </s> <0x41> text", "a▁b", "nbsp x\u0085y\x1cz",
    "it's we'll I'd 'tis", "x" * 5000, "word " * 4000, "zero\x00byte", "Plain words of a plain text, and more words.", "a  b c   d", "﻿mark ​zero width",
]


ALPHABET = alignment.byte_alphabet()


def bytes_of_a(token: str) -> bytes:
    return bytes(ALPHABET[c] for c in token)


def brute(texts):
    """Token lists, links and groups of each text, from the libraries over whole texts."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    rows, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a = [bytes_of_a(a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
            rows.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, parts_a))).tolist(), np.cumsum(list(map(len, parts_b))).tolist()
        starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
        owner = [j for j, p in enumerate(parts_b) for _ in p]
        links = [(i, j, min(e, ends_b[j]) - max(s, starts_b[j])) for i, (s, e) in enumerate(zip(starts_a, ends_a)) for j in sorted(set(owner[s:e]))]
        groups, at_a, at_b = [], 0, 0
        array_a, array_b = np.array(ends_a), np.array(ends_b)
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = np.searchsorted(array_a, end) + 1, np.searchsorted(array_b, end) + 1
            groups.append((ids_a[at_a:to_a], ids_b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        rows.append((ids_a, ids_b, links, groups))
        counts.update((ids_a[i], ids_b[j]) for i, j, _ in links)
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for ids_a, ids_b, links, groups in rows:
        held = [counts[ids_a[i], ids_b[j]] for i, j, _ in links]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            len(ids_a), len(ids_b), len(groups), len(links), sum(n == most[ids_b[j]] for n, (_, j, _) in zip(held, links)), sum(held),
            sha256(text.encode()).hexdigest() if groups else "", sum(len(x) * len(y) for x, y in groups),
        ))
    return rows, out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]


def digests(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, units string, block int")
    return sorted((r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.digest(docs, A, B, **options).collect())


def test_digest_equals_brute_force(spark):
    _, wanted = brute(TEXTS)
    got = digests(spark, [(i, t, "x", 1) for i, t in enumerate(TEXTS)])
    assert got == [(i, *w) for i, w in enumerate(wanted)]


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    _, wanted = brute([t for _, t in rows])
    got = sorted((r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.digest(docs.repartition(3), A, B).collect())
    assert got == [(i, *w) for (i, _), w in zip(rows, wanted)]


def test_links_and_groups_equal_brute_force(spark):
    rows, _ = brute(TEXTS)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in alignment.align(docs, A, B).collect():
        ids_a, ids_b, links, groups = rows[r["doc_id"]]
        assert (r["a_ids"], r["b_ids"]) == (ids_a, ids_b)
        assert [(x["a"], x["b"], x["bytes"]) for x in r["links"]] == links
        ends_a, ends_b = [0, *(g["a"] for g in r["groups"])], [0, *(g["b"] for g in r["groups"])]
        assert [(ids_a[i:j], ids_b[k:m]) for i, j, k, m in zip(ends_a, ends_a[1:], ends_b, ends_b[1:])] == groups


def test_shared_pairs_are_those_of_groups():
    machine = alignment.Aligner(A, B)
    units = machine.units(["tokenization", "déjà", "🇩🇪"])
    pairs = machine.shared_pairs(units)
    assert np.diff(pairs.indptr).tolist() == units.shared.tolist()


@pytest.mark.parametrize("bound", [1, 7, 10**6])
def test_row_products_equal_dense_products(monkeypatch, bound):
    monkeypatch.setattr(alignment, "PRODUCT_ITEMS", bound)
    rng = np.random.default_rng(5)
    dense = [rng.integers(0, 3, shape) * (rng.random(shape) < 0.3) for shape in ((9, 14), (14, 6))]

    def sparse(m):
        return Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), np.nonzero(m)[1], m[m != 0], m.shape[1])

    got = row_products(*map(sparse, dense))
    back = np.zeros((9, 6), int)
    back[got.rows(), got.indices] = got.values
    assert (back == dense[0] @ dense[1]).all()
    again = transposed(transposed(got))
    assert (again.indices == got.indices).all() and (again.indptr == got.indptr).all()


def test_odd_rows(odd, none):
    found = alignment.digest(odd, A, B)
    assert found.count() == odd.count() and found.where("n_a > 0 and groups_sha256 = ''").count() == 0
    assert alignment.digest(none, A, B).count() == 0 == alignment.align(none, A, B).count()


def test_repeated_rows_and_empty_tables(spark):
    assert digests(spark, []) == []
    got = digests(spark, [(1, "one text", None, None), (1, "one text", None, None), (None, "one text", None, None)][:2])
    assert len(got) == 2 and got[0] == got[1]
    assert digests(spark, [(1, None, None, None), (2, "", None, None)]) == [(1, 0, 0, 0, 0, 0, 0, "", 0), (2, 0, 0, 0, 0, 0, 0, "", 0)]
