"""What the codec's speed rests on: merges in few rounds, one pattern for all characters of two bytes, a store of plain arrays."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

from pointloom.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))


def test_many_pieces_are_merged_in_few_rounds(codec, monkeypatch):
    rng = random.Random(5)
    pieces = ["".join(rng.choices("etaoinshrdlucmfwypß ", k=rng.randint(2, 20))).encode() for _ in range(20_000)]
    pieces = [p for p in pieces if p not in codec.ranks and len(p) <= bpe.LONGEST_BATCHED] + [b"a" * k for k in range(2, 65)]
    rounds, rank = [], codec.queue._rank
    monkeypatch.setattr(codec.queue, "_rank", lambda left, right: rounds.append(len(left)) or rank(left, right))
    ids, counts = codec.queue.encode(pieces)
    # 327; rank by rank they were 3,123
    assert len(rounds) < 600
    ends = np.cumsum(counts)
    got = [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)]
    assert got == [bpe.encode_piece(p, codec.ranks) for p in pieces]
    assert [b"".join(map(codec.pieces.__getitem__, x)) for x in got] == pieces
    assert [len(x) for x in codec.queue.encode([])] == [0, 0]


def test_all_characters_of_two_bytes_split_alike_by_both_modules(codec):
    assert isinstance(codec.plane_split, re.Pattern) and isinstance(codec.ascii_split, re.Pattern)
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    random.Random(6).shuffle(every)
    for text in ("".join(every), " ".join(every), "a".join(every), "1".join(every), " \n".join(every)):
        assert codec.plane_split.findall(text) == codec.split.findall(text)
    assert [x for x in codec._pieces("é 😀😀é")] == [codec.split.findall("é 😀😀é")]
    for pattern in (r"\w+|\W+", r"(?i:s)|[\s\S]", r"\p{Lu}+|.", r"[\S]+|\s+"):
        other = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY), pattern)
        assert other.plane_split is other.split
