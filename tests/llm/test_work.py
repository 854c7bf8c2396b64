"""Bounds of the work that a batch or a symbol takes in a worker."""

from __future__ import annotations

import tracemalloc

import numpy as np

from sievework.llm import arrow_text, webp


def test_hashing_a_long_text_takes_little_beside_it():
    data = np.frombuffer(b"some words of a text " * 200_000, np.uint8)
    starts, ends, _ = arrow_text.word_bounds(data, np.array([0, len(data)]))
    tracemalloc.start()
    made = arrow_text.word_hashes(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 1_000_000 and len(np.unique(made)) == 5
    assert peak - 2 * made.nbytes < 1 << 24  # the result, and the same mixed; what hashing takes beside them


def test_a_symbol_is_looked_up_at_once(monkeypatch):
    lengths = [3, 3, 3, 4, 5, 5, 3, 3, 3, 3, 0]
    code, out, symbols = webp.Code(lengths), webp.Writer(), [4, 0, 8, 5, 3, 1, 7, 6, 2, 5]
    for s in symbols:
        c, n = webp.canonical(lengths)[s]
        out.put(webp.mirrored(c, n), n)
    bits, calls, read = webp.Bits(out.value.to_bytes(8, "little")), [], webp.Bits.read
    monkeypatch.setattr(webp.Bits, "read", lambda self, n: calls.append(n) or read(self, n))
    assert [code.read(bits) for _ in symbols] == symbols
    assert bits.at == out.size and len(calls) == len(symbols)
    table, mask = code.table_of
    for x in range(mask + 1):
        own = [s for s, (c, n) in enumerate(webp.canonical(lengths)) if n and x & ((1 << n) - 1) == webp.mirrored(c, n)]
        assert [table[x] & 0xFFFF] == own and table[x] >> 16 == lengths[own[0]]
