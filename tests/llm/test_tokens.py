import zlib

import numpy as np
import public_tokenizers as P
import pytest

from postloom.llm import token_counts, token_files

ODD = ["", " ", "  a", "a ", "a  b", "a\n b", "\n", "a \n b", "x\n\n y", "\n\n\n  a", "<|endoftext|> a", "<s> it's we'll 's</s>", "é²³ «a» x", "日本 語\n", "a  b", "a \n  b", "\x1c a b\x85 c", "don't'S _a_ $5.00 10%", "\ta\t b\t", "a   b", "Ǆ ɏ ɐ", "▁", "a▁b", "é\r\nq {\r}", "\x00 a\x00", "word " * 2000]


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_files.WordEncoder(path, np.dtype("<u2"))
    for _ in range(2):
        for t in ODD:
            assert own.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes(), t


def test_piece_counter_is_the_library():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path, token_counts.whole_tokens(path))
    for _ in range(2):
        assert own.counts(ODD) == [len(x) for x in library.encode(ODD)]


def test_files_round_trip(spark, odd_docs, no_docs, tmp_path):
    path = P.path("byte_bpe_50k.json")
    got = token_files.token_files(odd_docs, path, path=f"file://{tmp_path}/t").orderBy("start").collect()
    own, start = token_files.WordEncoder(path, np.dtype("<u2")), 0
    rows = sorted(((-(2**63) if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in odd_docs.collect())
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for r, (_, text) in zip(got, rows, strict=True):
        ids = [*np.frombuffer(own.encode(text), "<u2").tolist(), 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    again = token_files.read_token_files(spark, f"file://{tmp_path}/t", texts=True).orderBy("start").first()
    assert again["ids"][-1] == 2
    assert token_files.token_files(no_docs, path).count() == 0


def test_counts_of_odd_rows(odd_docs, no_docs):
    rows = token_counts.token_counts(odd_docs, P.path("piece_bpe_32k.model"), limit=100).collect()
    assert len(rows) == 9 and {(r["n_bytes"], r["n_tokens"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, 0)}
    assert [r["over_limit"] for r in rows if r["doc_id"] == 4] == [True]
    assert token_counts.token_counts(no_docs, P.path("piece_bpe_32k.model")).count() == 0


def test_token_ids_over_16_bits(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    out = token_files.token_files(df, P.path("byte_bpe_50k.json"), vocab=70_000, end_id=None, path=str(tmp_path / "u4"))
    assert out.first()["n_tokens"] == 2
    assert next((tmp_path / "u4").glob("*.bin")).stat().st_size == 8
    with pytest.raises(Exception):
        token_files.read_token_files(spark, str(tmp_path / "none")).count()


def test_words_are_remembered_up_to_the_limit(monkeypatch):
    from tokenizers import Tokenizer


    monkeypatch.setattr(token_files, "_KEPT", 3)
    path = P.path("byte_bpe_50k.json")
    own, library = token_files.WordEncoder(path, np.dtype("<u2")), Tokenizer.from_file(path)
    for text in ("one two three four five two", "", " ", "a  b", "x é1,2 y y zz's", "two\nthree one "):
        assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert isinstance(own.known, token_files._Words) and len(own.known) == 3
