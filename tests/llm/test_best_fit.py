import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from citegraph.llm import best_fit as bf
from tests.llm.conftest import sentences

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_match(is_gap):
    """Best fit from the longest down: a stack of gaps."""
    stack, taken = [], []
    for k, gap in enumerate(is_gap):
        taken.append(stack.pop() if not gap and stack else -1)
        if gap:
            stack.append(k)
    return taken, sorted(stack)


@pytest.mark.parametrize("seed", range(40))
def test_levels_equal_a_stack(seed):
    rng = random.Random(seed)
    is_gap = np.array([rng.random() < rng.choice([0.3, 0.5, 0.7]) for _ in range(rng.randint(0, 60))], bool)
    taken, free = bf.match(is_gap)
    assert (taken.tolist(), np.flatnonzero(free).tolist()) == plain_match(is_gap)


@pytest.mark.parametrize("seed", range(40))
def test_stretches_swept_apart_equal_one_sweep(seed):
    """Cut a row of gaps and pieces anywhere: the same pieces find a gap, and no gap is taken twice."""
    rng = random.Random(seed)
    is_gap = np.array([rng.random() < 0.5 for _ in range(80)], bool)
    cuts = sorted(rng.sample(range(1, 80), 6))
    left, gaps, waits, met = [], {}, {}, 0
    for part, own in enumerate(np.split(is_gap, cuts)):
        taken, free = bf.match(own)
        waits[part], gaps[part] = int((~own & (taken < 0)).sum()), int(free.sum())
        met += int((taken >= 0).sum())
        left.append((part, waits[part], gaps[part]))
    used = Counter()
    for part, low, high, source, base in bf.carry(left):
        assert source < part and 0 <= low < high <= waits[part] and base + high - low <= gaps[source]
        used.update((source, base + k) for k in range(high - low))
        met += high - low
    assert not used or max(used.values()) == 1
    assert met == sum(t >= 0 for t in plain_match(is_gap)[0])


def ids_of(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, texts):
    """Pieces are cut as stated and each lies in one place; sequences are gapless and at most full. Returns their number."""
    by_sequence, pieces = {}, Counter()
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= bf.WINDOW
    want = Counter()
    for i, text in texts:
        ids = ids_of(text)
        for k, start in enumerate(range(0, len(ids), bf.WINDOW)):
            own = ids[start : start + bf.WINDOW]
            want[i, k, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert pieces == want
    return len(by_sequence)


def plain_best_fit(lengths):
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        if k == len(gaps):
            opened, gap = opened + 1, bf.WINDOW
        else:
            gap = gaps.pop(k)
        bisect.insort(gaps, gap - n)
    return opened


def test_awkward_texts(docs, no_docs):
    check(bf.pack(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert bf.pack(no_docs, PATH).collect() == []


@pytest.mark.parametrize("sweep", [200_000, 60])
def test_about_as_few_sequences_as_best_fit_one_by_one(spark, monkeypatch, sweep):
    monkeypatch.setattr(bf, "SWEEP_ROWS", sweep)
    texts = [(k if k % 3 else None, sentences(k, 20 + (37 * k) % 700)) for k in range(240)] + [(7, sentences(7, 3000))]
    rows = bf.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), PATH).collect()
    opened = check(rows, texts)
    assert opened <= plain_best_fit([r["length"] for r in rows]) + 1


@pytest.mark.parametrize("lengths", [[4096, 4096, 4095, 1], [2049] * 5, [1] * 5000, [3000] * 4 + [1096] * 4 + [500] * 2, [1365] * 7])
def test_given_lengths(spark, lengths):
    placed = bf.place_all(spark.createDataFrame(list(enumerate(lengths)), "number long, length long").repartition(2)).collect()
    assert sorted(r["number"] for r in placed) == list(range(len(lengths)))
    filled = Counter()
    for r in placed:
        filled[r["sequence_id"]] += lengths[r["number"]]
    assert max(filled.values()) <= bf.WINDOW and len(filled) == plain_best_fit(lengths)
