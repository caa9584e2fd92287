import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerfield.llm import counts, packing, tokens

ODD = ["", " ", "a  b", "x  y\n\n z\t", "it's we'll I'M", "<|endoftext|> a<|endoftext|>b",
       "Éa é ÀÇ ßẞ", "a,b .c ,.! d", "漢字 かな", "emoji 🎉🎉!", "a" * 3000, "1234 5,6",
       "word," * 50, "\x1c\x1d a\x85b", "İI ΣΑΣ ς"]


def reference(name):
    return Tokenizer.from_file(str(public_tokenizers.path(name)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name, corpus):
    whole, encoder = reference(name), tokens.PiecePool(str(public_tokenizers.path(name)))
    for text in ODD + [t for _, t in corpus if t]:
        got = encoder.gather(encoder.codes(tokens.pieces(text))).tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids, text[:80]


def test_pool_starts_anew_at_its_limit():
    name = str(public_tokenizers.path("word_bpe_49k.json"))
    small, whole = tokens.PiecePool(name, limit=5), Tokenizer.from_file(name)
    for text in ("one two three", "four five six seven", "one eight nine ten"):
        assert small.gather(small.codes(tokens.pieces(text))).tolist() == whole.encode(text).ids


def test_counts(spark, docs, corpus):
    whole = reference("byte_bpe_50k.json")
    got = sorted(map(tuple, counts.token_counts(docs).collect()), key=str)
    want = []
    for d, t in corpus:
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


PREFIXED = ["Hello there, wonderful\n\nworld of  prefixes.", "one\xa0two three\u3000four " * 6, "漢字かな交じり文。" * 9,
            "tab\t \n  end   ", "x  <|endoftext|>  y<|endoftext|>", "<|endof", " \x85 é🎉🎉 👩‍👩‍👧", "ab" * 60, "1234567 12",
            "it's we'll I'M they're I've he'd", "   ", "a", "", "<|endoftext|", "a \u2009 b", "naïve façade — Ünïcödé"]


@pytest.mark.parametrize("name, short", [("byte_bpe_50k.json", 32), ("byte_bpe_50k.json", 0),
                                         ("word_bpe_49k.json", 32)])
def test_every_prefix_against_the_library(name, short, monkeypatch):
    monkeypatch.setattr(counts, "SHORT", short)
    whole = reference(name)
    known = counts.Prefixes(tokens.PiecePool(str(public_tokenizers.path(name))))
    got, sizes = counts.tables(known, pa.array([None, *PREFIXED]).slice(1))
    assert sizes.tolist() == list(map(len, PREFIXED))
    at = 0
    for text in PREFIXED:
        want = [len(whole.encode(text[:j], add_special_tokens=False).ids) for j in range(len(text) + 1)]
        assert got[at:at + len(want)].tolist() == want, text
        at += len(want)


def test_random_prefixes_by_pairs_of_tokens(monkeypatch):
    monkeypatch.setattr(counts, "SHORT", 0)
    whole, rng = reference("byte_bpe_50k.json"), random.Random(8)
    known = counts.Prefixes(tokens.PiecePool(str(public_tokenizers.path("byte_bpe_50k.json"))))
    for alphabet in ("ab", "thean ", "aeiou.,' ", "0123456789 ", " \n\ta", "éà中🎉 "):
        for _ in range(15):
            text = "".join(rng.choices(alphabet, k=rng.randint(1, 60)))
            got, _ = counts.tables(known, pa.array([text]))
            assert got.tolist() == [len(whole.encode(text[:j]).ids) for j in range(len(text) + 1)], text


def test_budgets_and_cuts_from_the_table(spark, no_docs):
    """Also where a text has no blanks or a no-break space; nothing is encoded for an answer."""
    whole = reference("byte_bpe_50k.json")
    texts = ["word " * 300 + "\xa0" + "word " * 900, "漢字かな交じり文。" * 120, "z" * 4000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = counts.prefix_table(df).select(
        "doc_id", counts.chars_within(F.col("counts"), 512).alias("fit"),
        counts.count_at(F.col("counts"), F.lit(77)).alias("at")).collect()
    for r in sorted(rows, key=lambda r: r["doc_id"])[:3]:
        text = texts[r["doc_id"]]
        assert 0 < r["fit"] < len(text) and r["at"] == len(whole.encode(text[:77]).ids)
        assert len(whole.encode(text[:r["fit"]]).ids) <= 512
        assert all(len(whole.encode(text[:r["fit"] + j]).ids) > 512 for j in range(1, 20))
    assert [r["fit"] for r in rows if r["doc_id"] == 3] == [0]
    assert counts.token_counts(no_docs).count() == 0 == counts.prefix_table(no_docs).count()


def test_totals_are_read_from_the_table_of_prefixes():
    """The total of a text is the last count of its table, and each piece's own table was made for it."""
    whole = reference("byte_bpe_50k.json")
    known = counts.Prefixes(tokens.PiecePool(str(public_tokenizers.path("byte_bpe_50k.json"))))
    texts = pa.array([None, *PREFIXED, "word " * 700, "", "\u6f22\u5b57" * 400])
    want = [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts.to_pylist()]
    assert counts.totals(known, texts).tolist() == want
    assert {"Hello", " there", " word"} <= set(known.index)
    table, sizes = counts.tables(known, texts)
    assert table[np.cumsum(sizes + 1) - 1].tolist() == want
    assert known.by_lines and known.in_lines([" there", "it's"]).tolist() == known.encoded([" there", "it's"])
    plain = [" there", "x1y22,;.z", "<|endof", "_Abc", " 12ab", "QqXzv", " naïve—x", "漢字1か", "🎉é", "<|en"]
    assert known.by_bytes(plain) == known.encoded(plain)
    known.counts += 1  # another table gives other totals
    assert counts.totals(known, pa.array(["Hello"])).tolist() == [2]


def test_slices_of_texts_give_the_pieces(corpus):
    """Cut as a slice or one by one; nulls, empty texts and texts encoded whole among them."""
    encoder = tokens.PiecePool(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = [None, *ODD, "a\xa0b c", "", *[t for _, t in corpus]]
    codes, n = tokens.slice_codes(encoder, pa.array(["skipped", *texts]).slice(1))
    want = [encoder.codes(tokens.pieces(t or "")).tolist() for t in texts]
    assert n.tolist() == list(map(len, want)) and codes.tolist() == sum(want, [])
    assert tokens.slice_codes(encoder, pa.array(["", None], pa.string()))[1].tolist() == [0, 0]


def test_packing(spark, docs, corpus, no_docs):
    whole = reference("word_bpe_49k.json")
    rows = packing.pack(docs, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    want = [(d, whole.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in corpus]
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in want)
    for d, ids in want:
        if d is not None and d != 2:
            own = sorted(pieces[d, len(ids)], key=lambda r: r["start"])
            assert [i for r in own for i in r["ids"]] == ids
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    assert padding < 0.05 * sum(len(ids) for _, ids in want)
    assert packing.pack(no_docs).count() == 0


def test_cuts_cost_least():
    """Against all ways to cut a short stream."""
    cuts, loss, width = [0, 3, 5, 6, 9, 12, 13], [0, 0, 4, 0, 2, 0, 0], 7
    best, _ = packing.best_cuts(cuts, loss, width)

    def least(i):
        return 0 if i == 0 else min(least(j) + width - (cuts[i] - cuts[j]) + loss[i]
                                    for j in range(i) if cuts[i] - cuts[j] <= width)

    assert best == [least(i) for i in range(len(cuts))]
