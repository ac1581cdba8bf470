"""Words are encoded by the task itself, which starts no threads of the tokenizer."""

from __future__ import annotations

import os

from reconcile.llm import best_fit


def test_tokenizer_starts_no_threads(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    best_fit.encoder.cache_clear()
    encode = best_fit.encoder(best_fit.tokenizer_path())
    before = len(os.listdir("/proc/self/task"))
    assert all(encode([" ".join(f"word{i}x" for i in range(3000))]))
    assert len(os.listdir("/proc/self/task")) == before
    monkeypatch.delenv("TOKENIZERS_PARALLELISM")  # set by the encoder
    best_fit.encoder.cache_clear()
