import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import words as W

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = [(W.SPACED, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


@pytest.mark.parametrize("table,pattern", KINDS)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="aZ9 .\n\té \U0001f600-", max_size=40)), max_size=6))
@settings(max_examples=80, deadline=None)
def test_words_are_those_of_the_pattern(table, pattern, texts):
    block = W.split(pa.array(texts, pa.string()), table)
    got = [[block.word(i).decode() for i in range(block.bounds[d], block.bounds[d + 1])] for d in range(len(texts))]
    assert got == [re.findall(pattern, (t or "").translate(FOLD)) for t in texts]


def test_hashes_and_windows_follow_content():
    long = "z" * 1000
    block = W.split(pa.array([f"a bb {long} a", "bb", None, f"a bb {long}"]), W.SPACED)
    h = block.hashes()
    assert h[0] == h[3] == h[5] and h[1] == h[4] == h[6] and h[2] == h[7] and len(set(h.tolist())) == 3
    rolled, first = block.windows(h, 3)
    assert first.tolist() == [0, 1, 5] and rolled[0] == rolled[2] != rolled[1]


def test_blocks_hold_every_row_once():
    batch = pa.record_batch({"text": ["aaaa", None, "b" * 50, "", "cc"], "i": [0, 1, 2, 3, 4]})
    parts = list(W.blocks(iter([batch]), limit=5))
    assert [i for p in parts for i in p.column(1).to_pylist()] == [0, 1, 2, 3, 4] and len(parts) > 1
    assert not list(W.blocks(iter([batch.slice(0, 0)])))


def test_stems_keep_short_words():
    block = W.split(pa.array(["vequté vequmo veq vequ"]), W.ALNUM)
    h = block.hashes()
    s = block.stems(h, 4)
    assert s[0] == s[1] and s[2] == h[2] and s[3] == h[3] and np.unique(s).size == 3


def test_another_pass_lets_go_what_the_last_kept():
    made, batch = [], pa.record_batch({"text": ["a b"]})
    keep = lambda: W.kept("cache", lambda: made.append(1) or object())
    first = keep()
    list(W.blocks(iter([batch]), keep="cache"))
    assert keep() is first
    list(W.blocks(iter([batch])))
    assert keep() is not first and len(made) == 2
    list(W.blocks(iter([])))
