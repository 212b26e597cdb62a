import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from reachbase.llm.textblock import blocks

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té😀Z", max_size=30)), min_size=1, max_size=8)


@given(texts, st.sampled_from([4, 20, 1 << 20]))
def test_words_and_lines_match_plain_splitting(given_texts, size):
    for part, block in blocks(pa.array(given_texts, pa.string()), block_bytes=size):
        own = [t or "" for t in given_texts[part]]
        start, end, bounds = block.words()
        raw = block.data.tobytes()
        for i, t in enumerate(own):
            found = [raw[a:b].decode() for a, b in zip(start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]])]
            assert found == re.findall(r"[^\x20\x09-\x0D]+", t)
        begin, stop, doc = block.lines()
        for i, t in enumerate(own):
            assert [raw[a:b].decode() for a, b, d in zip(begin, stop, doc) if d == i] == t.split("\n")


@given(texts)
def test_equal_words_have_equal_hashes(given_texts):
    seen = {}
    for _, block in blocks(pa.array(given_texts, pa.string()), block_bytes=7):
        start, end, _ = block.words()
        for a, b, h in zip(start, end, block.hashes(start, end)):
            assert seen.setdefault(block.data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


@given(texts, st.integers(1, 4))
def test_shingles(given_texts, k):
    for part, block in blocks(pa.array(given_texts, pa.string()), lower=True):
        hashes, bounds = block.shingles(k)
        for i, t in enumerate(given_texts[part]):
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            plain = [tuple(words[j : j + k]) for j in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
            own = hashes[bounds[i] : bounds[i + 1]]
            assert len(own) == len(plain) and len(np.unique(own)) == len(set(plain))
