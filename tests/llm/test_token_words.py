"""Words go to the tokenizer's model once, whatever their case and the marks behind them."""

from types import SimpleNamespace

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from sieveline.llm import tokenfiles

WORD_BPE = path("word_bpe_49k.json")
MARKS = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist()


def test_a_word_is_tokenized_once_for_all_its_pieces():
    encoder, seen = tokenfiles.Encoder(WORD_BPE), []
    model = encoder.model
    encoder.model = SimpleNamespace(tokenize=lambda text: seen.append(text) or model.tokenize(text))
    encoder.tokenizer = SimpleNamespace(encode=None)
    encoder.encode(["Zorble zorble, ZORBLE### zorble. Éa éa.".encode(), b"zorble### zorble!! zorblE"])
    assert sorted(seen) == sorted(["zorble", ",", "###", ".", "Ã©a", "!!"])


@pytest.mark.parametrize("word", ["word", "Ünter", "ÀÉ", "x"])
def test_marks_behind_a_word_encode_like_whole_texts(word):
    tokenizer, encoder = Tokenizer.from_file(WORD_BPE), tokenfiles.Encoder(WORD_BPE)
    runs = MARKS + [a + b for a in MARKS for b in MARKS] + ["$$$", "###", ".%%%", "'s", ".'S", "<|", "<|endoftext|>", "<|endoftext|>!"]
    for marks in runs:
        assert ids(encoder, word + marks) == tokenizer.encode(word + marks, add_special_tokens=False).ids, marks


def test_a_worker_forgets_words(monkeypatch):
    monkeypatch.setattr(tokenfiles, "WORDS", 20)
    tokenizer, encoder = Tokenizer.from_file(WORD_BPE), tokenfiles.Encoder(WORD_BPE)
    text = " ".join(f"{a}{b}re{c}" for a in "bcdfg" for b in "aeiou" for c in ("", "!", "S,"))
    assert ids(encoder, text) == tokenizer.encode(text, add_special_tokens=False).ids and len(encoder.words) <= 20
