"""Texts that hold added tokens, against the library as it is by default."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from windowmill.llm.tokens import Encoder

TEXTS = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b\n<|endoftext|>", "x <|startoftext|> y <|ENDOFTEXT|>", "<|endof text|> z", "no added token here\nand a line", " <|endoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_equal_the_library(name):
    path = public_tokenizers.path(name)
    library, encoder = Tokenizer.from_file(path), Encoder(path)
    for t in TEXTS * 2:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
