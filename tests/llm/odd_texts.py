"""Texts that tokenizers and scanners tend to get wrong."""

import random


def texts():
    rng = random.Random(1)
    odd = ["", " ", "  ", "a  b", "a \n b", "\n \nx", " x ", "tab\t y", "it's we'll 'S", "é² ½ 3.14",
           "日本語 text", "x<|endoftext|>y <|endoftext|>", " a  b", "\x1c \x1f", "a" * 3000,
           "ab " * 500, "İ ͅ", "😀 emoji 👍🏽", "\x00\x00 a", "foo\n bar", "foo\n\n bar  "]
    parts = ["the", "And", " ", "  ", "\n", "12", "é", "'s", ",", "...", "ß", "\t", "the re", "日", "\x85", "\x1d"]
    return odd + ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(400)]


TEXTS = texts()
