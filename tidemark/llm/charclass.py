"""The character classes of a tokenizer file, as its library sees them.

Unicode grows, and modules follow at different times: whether a character is a letter is asked of the library
that the ids have to agree with, once for each character that comes up.
"""

from __future__ import annotations

from collections.abc import Callable


class StandIns(dict):
    """For str.translate: an ASCII stand-in of each character, so that ASCII patterns split any text.

    ASCII stays as it is; other letters become `x` (in no contraction), numbers `1`, white space a tab, the rest `!`.
    `split` gives the places of the pieces that the library cuts a string to.
    """

    def __init__(self, split: Callable[[str], list[tuple[int, int]]]):
        super().__init__((c, chr(c)) for c in range(128))
        self.split, self.numbers_join = split, len(split("11")) == 1

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if self.split(f"x{c}x") == [(0, 3)]:
            kind = "x"
        elif self.split(f"!{c}!") == [(0, 3)]:
            kind = "!"
        else:
            pieces = self.split(f"1{c}1")
            kind = "1" if pieces == ([(0, 3)] if self.numbers_join else [(0, 1), (1, 2), (2, 3)]) else "\t"
        self[code] = kind
        return kind


def stand_ins(pre_tokenizer) -> StandIns:
    """The table of a tokenizers pre-tokenizer."""
    return StandIns(lambda s: [place for _, place in pre_tokenizer.pre_tokenize_str(s)])
