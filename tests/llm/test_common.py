import numpy as np
import pyarrow as pa

from citegraph.llm import common


def plain_hash(span: bytes) -> int:
    total, base = 0, int(common._BASE)
    for k, byte in enumerate(span):
        total += int(common._BYTE[byte]) * pow(base, k, 1 << 64)
    return int(common.mix(np.array([total % (1 << 64)], np.uint64))[0])


def test_spans_hash_as_the_plain_sum_does_also_across_stretches(monkeypatch):
    monkeypatch.setattr(common, "STRETCH", 16)
    text = b"ab abc " + b"x" * 50 + b" ab " + b"longish words here and there " * 3
    data = np.frombuffer(text, np.uint8)
    starts, ends = common.segment(data, np.array([0, len(data)]), common.SOLID_BYTES[data])
    want = [plain_hash(text[i:j]) for i, j in zip(starts, ends)]
    assert common.hash_spans(data, starts, ends).tolist() == want
    mixed = np.random.default_rng(1).permutation(np.repeat(np.arange(len(starts)), 2))  # any order, repeats, and beginnings of words
    assert common.hash_spans(data, starts[mixed], ends[mixed]).tolist() == [want[i] for i in mixed]
    heads = np.concatenate([starts[mixed], starts]), np.concatenate([ends[mixed], starts + 1])
    assert common.hash_spans(data, *heads).tolist() == [want[i] for i in mixed] + [plain_hash(text[i : i + 1]) for i in starts]
    assert common.hash_spans(data[:0], starts[:0], ends[:0]).tolist() == []


def test_a_text_of_many_megabytes_takes_a_few_times_its_size():
    import tracemalloc

    column = pa.array(["word other 1234 " * 700_000], pa.large_string())  # 11 MB
    common.words_of(pa.array(["warm up"], pa.large_string()))
    tracemalloc.start()
    words = common.words_of(column)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(words.hashes) == 2_100_000 and len(np.unique(words.hashes)) == 3
    assert peak < 200_000_000
