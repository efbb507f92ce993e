"""Texts with an added token have the ids of the plain encode call."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagecorpus.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)
TEXTS = ["one <|endoftext|> two", "<|endoftext|>", "<|endoftext|> a", "a<|endoftext|>b c", "a <|endoftext|>\n b<|endoftext|> <|endoftext|>", "<|endoftext| > a"]


@pytest.mark.parametrize("text", [*TEXTS, " ".join(TEXTS * 50)])
@pytest.mark.parametrize("block", [packing.BLOCK, 40])
def test_ids_equal_the_plain_call(monkeypatch, text, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    plain = Tokenizer.from_file(PATH)
    assert packing.Encoder(PATH, kept=300).encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_known_ids():
    assert packing.Encoder(PATH, kept=300).encode("one <|endoftext|> two").tolist() == [505, 220, 50256, 734]
