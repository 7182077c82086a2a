"""A shot that begins at the second frame."""

import random

from docloom.llm import avi


def test_cut_after_the_first_frame():
    flat, noise = b"\x80" * 4096, random.Random(5).randbytes(8192)
    assert [a for a, _ in avi.Avi(avi.write_avi(flat + noise[:4096])).clips()] == [0, 1]
    assert [a for a, _ in avi.Avi(avi.write_avi(flat + noise)).clips()] == [0, 1]
    assert [a for a, _ in avi.Avi(avi.write_avi(noise)).clips()] == [0]
