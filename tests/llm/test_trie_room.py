"""Nodes of a trie that fit nowhere in the room there is."""

import signal

import numpy as np
import pytest

from tidewake.llm import collocations


@pytest.fixture
def within_a_minute():
    def late(*_):
        raise TimeoutError("the trie was not made in a minute")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(60)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.mark.parametrize("words, nodes", [(40, 40), (2000, 1500)])
def test_nodes_of_many_edges_find_room(within_a_minute, words, nodes):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 1 << 62, words))
    pairs = np.concatenate([np.column_stack([np.repeat(first, 32), rng.choice(keys, 32, replace=False)]) for first in keys[:nodes]])
    table = np.column_stack([pairs, np.zeros((len(pairs), 2), np.int64)])
    trie = collocations.DoubleArray(table)
    place = np.arange(len(pairs)) * 3
    text = np.full(3 * len(pairs), -1, np.int64)
    text[place], text[place + 1] = trie.symbols(pairs[:, 0]), trie.symbols(pairs[:, 1])
    *_, (begin, state) = trie.walk(text, 2)
    assert begin.tolist() == place.tolist() and trie.accept[state].tolist() == list(range(len(pairs)))
    assert len(trie.check) < 16 * (len(pairs) + words)
