"""What the lattice holds of a frame at once."""

import pandas as pd

from tracegrid.llm import lattice


def test_a_frame_is_counted_in_pieces():
    f = pd.DataFrame({"text": ["a b", "", "x" * 50, "c d e", "f", ""], "n": range(6)})
    got = list(lattice.pieces(f, 10))
    assert pd.concat(got).equals(f) and max(len(p) for p in got) < 6
    assert list(lattice.pieces(f.iloc[:0])) == []
