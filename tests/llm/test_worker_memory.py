"""What workers keep between stages, and what a block of texts costs."""

import tracemalloc

import numpy as np
import pyarrow as pa

from weftcore.llm import token_output
from weftcore.llm.textgrams import CHUNK, batch_tokens, mark_tables


def test_reading_files_releases_known_words():
    token_output._encoders["some", 2] = object()
    assert list(token_output._crc("nowhere")(iter([]))) == []
    assert token_output._encoders == {}


def test_blocks_of_texts_are_small_and_whole():
    text = "Ab, cd 12 " * 40
    texts = [text] * 4000 + [None, "", "x " * CHUNK]
    column = pa.array(texts)
    tracemalloc.start()
    got, ends = [], [0]
    for a, b, _, tok in batch_tokens(column.slice(0, 4002), mark_tables()):
        assert a == ends[-1]
        ends.append(b)
        got.append(np.bincount(tok.text, minlength=b - a))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ends[-1] == 4002 and np.concatenate(got).tolist() == [160] * 4000 + [0, 0]
    assert peak < 40 << 20  # 1.6 MB of text; with blocks of 1 MB it was 51 MB
    (_, _, _, long), = batch_tokens(column.slice(4002), mark_tables())
    assert len(long.hash) == CHUNK and len(set(long.hash.tolist())) == 1
