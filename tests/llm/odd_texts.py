"""Texts for the tests."""

#: Texts that every operator has to take: nulls, nothing, blanks, odd characters, long and repeated ones.
ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "▁  x\x00y\x1cz é \U0001f600 　",
    "word " * 20_000,
    "x" * 30_000,
    "same text twice, the very same text",
    "same text twice, the very same text",
]
