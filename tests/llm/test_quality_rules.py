import re
from collections import Counter

import pytest

from citegraph.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_statistics_match_a_plain_count(docs):
    texts = sorted((r["doc_id"] or -1, expected(r["text"])) for r in docs.collect())
    got = sorted((r["doc_id"] or -1, (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in q.assess(docs).collect())
    assert got == texts


def test_verdicts(docs):
    kept = {r["doc_id"]: r["kept"] for r in q.assess(docs).collect()}
    assert all(kept[i] for i in (1, 2, 3, 4, 10, 14, 16, 17))
    assert not any(kept[i] for i in (5, 6, 7, 8, 9, 11, 12, 13, 18))
    left = q.keep_good(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == sorted(r["doc_id"] or -1 for r in q.assess(docs).where("kept").collect())


def test_empty(no_docs):
    assert q.assess(no_docs).collect() == []
    assert q.keep_good(no_docs).collect() == []


def test_em_finds_which_votes_are_right(spark):
    """Two rules that agree on a tenth of the texts are taken as right; a text with one of their votes is bad."""
    names = [r[0] for r in q.RULES]
    bad = [-1 if n in ("symbols", "few_words") else 0 for n in names]
    good = [1 if v > 0 else 0 for *_, v in q.RULES]
    one = [-1 if n == "symbols" else g if n == "many_words" else 0 for n, g in zip(names, good)]
    patterns = spark.createDataFrame([(*bad, 60), (*[b or g for b, g in zip(bad, good)], 40), (*good, 900), (*one, 5)], [*names, "n"])
    model = q.fit_votes(patterns)
    assert 0.85 < model.prior < 0.95
    assert model.accuracy("symbols", -1) > 0.9
    from pyspark.sql import functions as F

    p = [r["p"] for r in patterns.select("n", model.posterior({n: F.col(n) for n in names}).alias("p")).orderBy("n").collect()]
    assert max(p[:3]) < 0.5 and p[3] > 0.95


@pytest.mark.parametrize("text, kept", [("word " * 19, False), (" ".join(f"w{i}" for i in range(20)) + ".", True)])
def test_twenty_words(spark, text, kept):
    row = q.assess(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["base_failed"] is not kept
