"""Awkward strings through the pieces and memos of the tokenizing operators, against the libraries themselves."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from auditloom.llm import pieces, token_counts, token_files

BITS = ["'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "\u0085", " ", "　", " ", "​", "A", "Ab", "é", "é", "É", "ß", "İ", "Σ", "σς", "ÿ.", "÷.", "×,", "z.", "!", "?!",
        "a,b", ".x", ";:", "1.5", "½", "中。", "日本語", "👍🏽", "👩‍💻", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|x", "</s>", "<s>", "<unk>", "<0x0A>", "▁", "▁▁a",
        "\0", "\0.", "_.", "-.", "ﬁ.", "Ω.", "don't.", "word", " the", "�", "ا", "؀", "Ᲊ"]


@pytest.fixture(scope="module")
def strings():
    rnd = random.Random(6)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 8))) for _ in range(4000)] + ["", "word " * 3000, "x" * 20_000, "a.b " * 4000]


def test_counts(strings):
    path = public_tokenizers.path("byte_bpe_50k.json")
    memo = token_counts.length_memo(path)
    got = list(map(sum, memo.lookup([token_counts.PIECES.findall(t) for t in strings])))
    assert got == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(strings, add_special_tokens=False)]


@pytest.mark.parametrize("at_once", [1, 37, 5000])
def test_ids_of_token_files(strings, at_once):
    path = public_tokenizers.path("word_bpe_49k.json")
    memo = token_files.id_memo(path)
    some = strings if at_once > 1 else strings[:300]
    got = [x.tolist() for lo in range(0, len(some), at_once) for x in token_files.encoded(some[lo : lo + at_once], memo)]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


def test_merge_type_pieces(strings):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = pieces.codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in strings[:1500]:
        ids = library.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids)
