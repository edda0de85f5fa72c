"""What a worker keeps from batch to batch: bounded, and the keys that come again stay."""
from __future__ import annotations

import numpy as np

from pairwright.llm import chunks, op7_toxicity


def test_keys_met_again_outlive_a_full_dictionary(monkeypatch):
    monkeypatch.setattr(chunks, "CACHE_ENTRIES", 100)
    asked: list[str] = []

    def encode(keys: list[str]) -> list[bytes]:
        asked.extend(keys)
        return [np.frombuffer(k.encode(), np.uint8).astype("<u4").tobytes() for k in keys]

    store = chunks.IdStore(encode)
    common = [f"common {k}" for k in range(20)]
    for batch in range(50):
        keys = [*common, *[f"{batch} once {k}" for k in range(batch % 9 + 5)]]
        ids, at = store.gather(store.numbers(keys))
        assert ["".join(map(chr, ids[a:e])) for a, e in zip(at, at[1:])] == keys
        assert len(store.known) <= 100 and len(store.start) == len(store.size) == len(store.again) == len(store.known) + 1
        assert store.bytes == sum(map(len, store.known))
    assert all(asked.count(k) == 1 for k in common)


def test_end_id_stays_where_the_dictionary_is_swept(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chunks, "CACHE_ENTRIES", 30)
    encoder = chunks.ChunkEncoder(lambda keys: [np.frombuffer(k.encode(), np.uint8).astype("<u4").tobytes() for k in keys])
    for batch in range(20):
        texts = ["the same words", *[f"w{batch}x{k} the same" for k in range(8)], "", None]
        want = [np.array([*(t or "").encode(), 7], "<u4").tobytes() for t in texts]
        assert encoder.lists(pa.array(texts, pa.string()), 7) == want


def test_scorer_keeps_two_generations(monkeypatch):
    model = op7_toxicity.Model(np.random.default_rng(3).normal(size=op7_toxicity.BUCKETS), -1.0)
    texts = [[f"common words {b} and {b}x{k} once" for k in range(7)] for b in range(40)]
    plain = [op7_toxicity.Scorer(model)(t) for t in texts]
    monkeypatch.setattr(op7_toxicity, "CACHE_WORDS", 30)
    scorer, most = op7_toxicity.Scorer(model), 0
    made: list[str] = []
    values = model.word_values
    monkeypatch.setattr(model, "word_values", lambda words: made.extend(words) or values(words))
    assert [scorer(t) for t in texts] == plain
    assert made.count("common") == 1
    assert len(scorer.known) + len(scorer.older) < 100
