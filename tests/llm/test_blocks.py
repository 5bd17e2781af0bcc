import random

import pyarrow as pa

from readloom.llm.blocks import blocks


def test_blocks_cover_everything_within_their_size():
    rng = random.Random(1)
    texts = ["x" * rng.choice([0, 1, 5, 40, 200]) for _ in range(300)]
    for column in (pa.array(texts), pa.array(texts).slice(7, 250), pa.array([], pa.string()), pa.array([""] * 5)):
        out = list(blocks(column, 100))
        assert [t for _, part in out for t in part.to_pylist()] == column.to_pylist()
        assert [at for at, _ in out] == [sum(len(p) for _, p in out[:i]) for i in range(len(out))]
        assert all(len(p) == 1 or sum(map(len, p.to_pylist())) <= 100 for _, p in out)
