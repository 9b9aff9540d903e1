"""What a worker remembers of the pieces it has encoded takes little memory."""

from __future__ import annotations

import random
import tracemalloc

from examlark.llm import bpe


def test_remembered_pieces_take_little_memory():
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(400)) for _ in range(50)]
    c = bpe.Codec(bpe.default_path())
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    ids = c.encode_batch(texts)
    total = sum(map(len, ids))
    assert "".join(map(c.decode, ids)) == "".join(texts) and total > 60_000
    del ids
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert len(c.cache) > 19_000 and held < 200 * len(c.cache), held / len(c.cache)
    assert c.encode_batch([" x", ""])[1].tolist() == [] and (c.encode(texts[0]) == bpe.Codec(bpe.default_path()).encode(texts[0])).all()
