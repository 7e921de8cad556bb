import collections
import os

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import pieces

from .data import collected, documents, empty, rows, texts

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.DEFAULT_MODEL), reason="no piece model")


@pytest.fixture(scope="module")
def lex():
    return pieces.lexicon(pieces.DEFAULT_MODEL)


def run(lex, some, keys=None):
    keys = np.arange(len(some), dtype=np.uint64) if keys is None else keys
    ids, offs = pieces.encode(lex, pa.array(some, pa.string()), keys)
    raw, at = pieces.decode(lex, ids, offs)
    return [tuple(ids[a:b]) for a, b in zip(offs, offs[1:], strict=False)], [raw[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)]


def test_round_trip(lex):
    some = [t or "" for t in texts()] + ["▁", " ▁ ", "  ", "\x00", "a▁b"]
    assert run(lex, some)[1] == some


def test_decoding_agrees_with_the_library(lex):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    some = ["hello world", "  two  spaces ", "naïve façade 漢字", "line\nfeed"]
    for ids, text in zip(run(lex, some)[0], some, strict=True):
        assert model.decode([int(i) for i in ids]) == text


def test_draws_follow_the_exact_distribution(lex):
    """All segmentations of one word by brute force: frequencies of 100,000 draws agree."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    vocabulary = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if lex.weight[i] > -np.inf}

    def split(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in vocabulary:
                for tail in split(rest[k:]):
                    yield (vocabulary[rest[:k]], *tail)

    every = list(split("▁other"))
    p = np.exp([sum(lex.weight[i] for i in s) for s in every])
    p /= p.sum()
    n = 100_000
    seen = collections.Counter(run(lex, ["other"] * n)[0])
    assert sum(seen[s] for s in every) == n
    assert max(abs(seen[s] / n - q) for s, q in zip(every, p, strict=True)) < 0.006


def test_a_row_does_not_depend_on_its_batch(lex):
    some = [t or "" for t in texts()]
    keys = np.arange(len(some), dtype=np.uint64) * np.uint64(77)
    together = run(lex, some, keys)[0]
    assert together == [run(lex, [t], keys[i : i + 1])[0][0] for i, t in enumerate(some)]


def unspaced(n, seed=5):
    rng = np.random.default_rng(seed)
    return "".join(rng.choice(list("abcdefghiklmnoprstu"), n))


def test_long_units_are_drawn_as_short_ones(lex, monkeypatch):
    """Alone and block by block, or level by level: the same sums and the same draws."""
    some = [unspaced(9000), unspaced(2500) + " two words " + unspaced(3000), "漢" * 3000 + unspaced(2100)]
    together = run(lex, some)[0]
    monkeypatch.setattr(pieces, "UNIT_BLOCK", 700)
    assert run(lex, some)[0] == together
    monkeypatch.setattr(pieces, "LONG_UNIT", 1 << 40)
    assert run(lex, some)[0] == together


def test_slices_of_a_long_text_change_nothing(lex, monkeypatch):
    some = [" ".join(unspaced(k % 9 + 1, k) for k in range(4000)) + "  \u2581 é漢🎉 " * 200 + unspaced(6000) + " end "]
    whole = run(lex, some)
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 1000)
    assert run(lex, some) == whole and whole[1] == some


def test_very_long_texts(lex):
    prose, blob = "some words of prose, again and again. " * 300_000, unspaced(1_000_000)
    for text in (prose, blob):
        ids, offs = pieces.encode(lex, pa.array([text]), np.array([7], np.uint64))
        assert pieces.decode(lex, ids, offs)[0].tobytes().decode() == text


def test_log_probabilities_are_used_as_they_are(lex):
    plain = pieces.lexicon(pieces.DEFAULT_MODEL, zipf=False)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    some = [i for i in range(1000, 1100) if lex.weight[i] > -np.inf]
    assert [plain.weight[i] for i in some] == pytest.approx([max(model.get_score(i), -model.get_piece_size()) for i in some])
    assert run(plain, ["hello world ▁"])[1] == ["hello world ▁"]


def test_decoding_a_table(spark):
    docs = documents(spark)
    back = pieces.decoded_texts(pieces.sample_pieces(docs))
    assert collected(back) == collected(docs.select("doc_id", "text"))
    assert pieces.decoded_texts(pieces.sample_pieces(empty(spark))).count() == 0


def test_query_rows(spark):
    docs = documents(spark)
    a = collected(pieces.sample_pieces(docs, keep=("lang",)))
    assert a == collected(pieces.sample_pieces(docs.repartition(1), keep=("lang",)))
    assert len(a) == len(rows())
    assert all(r[-1] and (r[3] is None) == (r[2] == 0 and r[3] is None) for r in a)
    assert sum(r[3] is None for r in a) == sum(r[1] is None for r in rows())
    assert collected(pieces.sample_pieces(docs, seed=2)) != collected(pieces.sample_pieces(docs))


def test_empty(spark):
    assert pieces.sample_pieces(empty(spark)).count() == 0
