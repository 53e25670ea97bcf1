"""Letters of words: the same as the pattern that defines them, and cheap."""

import time

from vanewatch.llm import language


def test_letters_are_what_the_pattern_leaves():
    signs = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i) != "\n"]
    words = [*signs, *(f"Ab{c}z" for c in signs), "", "½²", "ΟΔΟΣ", "ΟΔΟΣ1", "İx", "don't", "一_x"]
    whole = language.NO_LETTER.sub("", "\n".join(words[-7:]).lower()).split("\n")
    assert language.letters_of(words)[-7:] == whole
    for start in range(0, len(words), 100_000):
        part = words[start : start + 100_000]
        kept = [w for w in part if not w.isascii()]
        assert language.letters_of(kept) == language.NO_LETTER.sub("", "\n".join(kept).lower()).split("\n")
    assert language.letters_of([]) == []


def test_letters_cost_little():
    words = ["language", "Straße", "x,"] * 30_000
    began = time.process_time()
    language.letters_of(words)
    assert time.process_time() - began < 0.5
