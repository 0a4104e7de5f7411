import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from odd_rows import SF_DIR, docs  # noqa: F401
from stratafold.llm.bpe import BytePairCoder, encode_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = BytePairCoder(open(PATH, encoding="utf-8").read())


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'stll<|endoftext|>1\x1c\x85 "))))
def test_same_ids_and_text_as_the_library(text):
    ids, decoded = expected(text)
    assert CODER.encode(text) == ids and CODER.decode(ids) == decoded


@pytest.mark.parametrize("text", ["<|endoftext|>a<|endoftext|><|endoftext|>", "a" * 5000, "ab" * 40000, " " * 3000 + "x", "é́漢\U0001f469‍\U0001f467 I'll 12½"])
def test_special_and_long_texts(text):
    ids, decoded = expected(text)
    assert CODER.encode(text) == ids and CODER.decode(ids) == decoded


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé漢19²½ ,.!(_'-—\n\t\x1c\x85\xa0\u0301stll")))
def test_pieces_end_where_words_end(text):
    assert CODER.encode(text) == expected(text)[0]


def test_punctuation_makes_no_new_words():
    coder = BytePairCoder(open(PATH, encoding="utf-8").read())
    for text in (" plonkish", " plonkish, plonkish. plonkish) plonkish; plonkish!"):
        assert coder.encode(text) == expected(text)[0]
    assert [piece for piece in coder.known if "plonk" in piece] == [" plonkish"]


def test_forgetting_words_changes_nothing(monkeypatch):
    import stratafold.llm.bpe as bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = BytePairCoder(open(PATH, encoding="utf-8").read())
    for n in range(30):
        text = f"word{n % 7} other{n}, and again word{n % 5}"
        assert coder.encode(text) == expected(text)[0]


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {row.doc_id: row.text for row in table.collect()}
    for row in encode_decode(table, PATH, ("n_tokens", "ids_sha256", "decoded_sha256")).collect():
        ids, decoded = expected(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_missing_empty_and_repeated_rows(docs):
    found = encode_decode(docs([(None, "a"), (1, None), (1, None), (2, "")]), PATH).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in found) == [("1", [], ""), ("1", [], ""), ("2", [], ""), ("None", [64], "a")]
    assert encode_decode(docs([]), PATH).collect() == []
