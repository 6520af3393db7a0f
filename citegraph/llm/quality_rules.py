"""Quality rules as weak supervision: rules vote or abstain, EM finds their accuracies, a posterior decides.

Everything is DataFrame expressions. The statistics of a text are array expressions on its one row, so
the texts are not shuffled. Votes are three-valued; EM runs over the table of vote patterns and their
counts, which has at most 3^rules rows however many documents there are. Each EM round is one small
aggregate whose single row of sums becomes the next round's literals.

Defined cases: a null text is an empty one; a text of white space has no words and fails the base; an
empty table gives an empty result; repeated rows are judged alike and all returned; extra columns are
ignored by `assess` and kept by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from citegraph.llm.common import fresh_name
from citegraph.session import cut_lineage

WINDOW = 8
MIN_WORDS = 20
#: Percent of words in repeated windows above which a text fails outright.
MAX_REPEAT = 30
SYMBOLS = "[#*$%&|<>]"
BLANK_RUN, SOLID = "[ \\t-\\r]+", "[^ \\t-\\r]"

#: (name, ratio, test, bound, vote): a rule votes where the test holds and else abstains.
RULES: tuple[tuple[str, str, str, float, int], ...] = (
    ("symbols", "n_symbols / greatest(word_chars, 1)", ">=", 0.06, -1),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", ">=", 0.5, -1),
    ("repeat_words", "n_repeat_words / greatest(n_words, 1)", ">=", 0.28, -1),
    ("upper", "n_upper / greatest(word_chars, 1)", ">=", 0.4, -1),
    ("shouting", "n_bangs / greatest(n_words, 1)", ">=", 0.25, -1),
    ("word_length", "abs(word_chars / greatest(n_words, 1) - 6.5)", ">=", 5.0, -1),
    ("few_words", "n_distinct / pow(greatest(n_words, 1), 0.9)", "<=", 0.5, -1),
    ("many_words", "n_distinct / pow(greatest(n_words, 1), 0.9)", ">=", 1.0, 1),
    ("sentence_ends", "n_ends / greatest(n_lines, 1)", ">=", 0.95, 1),
    ("mild_symbols", "n_symbols / greatest(word_chars, 1)", "<=", 0.01, 1),
)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_distinct", "n_ends")


def _array_stats(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """Add the word, line and window arrays under fresh names."""
    names = {k: fresh_name(df, f"rule_{k}") for k in ("text", "words", "hashes", "windows", "lines", "repeats")}
    t, words, hashes, windows = (F.col(names[k]) for k in ("text", "words", "hashes", "windows"))
    df = df.withColumn(names["text"], F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns(
        {
            names["words"]: F.array_remove(F.split(t, BLANK_RUN), ""),
            names["lines"]: F.filter(F.split(t, "\n"), lambda x: x.rlike(SOLID)),
        }
    )
    df = df.withColumn(names["hashes"], F.transform(words, lambda w: F.xxhash64(w)))
    # One 64-bit hash per window of eight words, by doubling: 2, 4, then 8 words. A shorter text has none.
    df = df.withColumn(names["windows"], hashes)
    for width in (1, 2, 4):
        shifted = F.slice(windows, width + 1, F.greatest(F.size(windows) - width, F.lit(0)))
        df = df.withColumn(names["windows"], F.zip_with(windows, shifted, lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn(names["windows"], F.slice(windows, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))))
    # Starts of the windows that occur twice or more: equal neighbours after sorting (hash, place).
    def repeated(sorted_pairs: Column) -> Column:
        at = lambda i: F.get(sorted_pairs, i)["h"]
        pick = F.filter(F.sequence(F.lit(0), F.size(sorted_pairs) - 1), lambda i: (at(i) == at(i - 1)) | (at(i) == at(i + 1)))
        return F.sort_array(F.transform(pick, lambda i: F.get(sorted_pairs, i)["at"]))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    df = df.withColumn(
        names["repeats"],
        F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.element_at(F.transform(F.array(pairs), repeated), 1)).otherwise(
            F.array().cast("array<int>")
        ),
    )
    return df, names


def with_stats(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`df` with the statistics of `STATS` under fresh names (returned as a map); nothing is shuffled."""
    df, names = _array_stats(df, text)
    t, words, lines, repeats = (F.col(names[k]) for k in ("text", "words", "lines", "repeats"))
    # A repeated window covers its eight words less those that the next repeated window covers too.
    covered = F.aggregate(
        repeats,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("end")),
        lambda acc, at: F.struct((acc["n"] + WINDOW - F.greatest(acc["end"] - at, F.lit(0))).alias("n"), (at + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )
    out = {k: fresh_name(df, f"stat_{k}") for k in STATS}
    stats = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.size(repeats) == 0, F.lit(0).cast("long")).otherwise(covered),
        "n_lines": F.size(lines),
        "n_upper": F.regexp_count(t, F.lit("[A-Z]")),
        "n_bangs": F.regexp_count(t, F.lit("!")),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_ends": F.size(F.filter(lines, lambda x: F.substring(F.rtrim(x), -1, 1).isin(".", "!", "?"))),
    }
    return df.withColumns({out[k]: v.cast("long") for k, v in stats.items()}).drop(*names.values()), out


def base_failed(stat: dict[str, str]) -> Column:
    n, repeat = F.col(stat["n_words"]), F.col(stat["n_repeat_words"])
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT * n)


def votes(stat: dict[str, str]) -> dict[str, Column]:
    """Per rule its vote, 1 (good) or -1 (bad), or 0 where it abstains."""
    out = {}
    for name, ratio, test, bound, vote in RULES:
        for k in sorted(STATS, key=len, reverse=True):
            ratio = ratio.replace(f"{k} ", f"`{stat[k]}` ").replace(f"({k},", f"(`{stat[k]}`,")
        x = F.expr(ratio)
        out[name] = F.when(x >= bound if test == ">=" else x <= bound, F.lit(vote)).otherwise(F.lit(0))
    return out


@dataclass
class VoteModel:
    """P(good), and per rule the chance that it votes on a good and on a bad text."""

    prior: float
    fires: dict[str, tuple[float, float]]

    def posterior(self, vote: dict[str, Column]) -> Column:
        """P(good | votes); abstaining says nothing."""
        score = F.lit(log(self.prior / (1 - self.prior)))
        for name, v in vote.items():
            good, bad = self.fires[name]
            score = score + F.when(v != 0, log(good / bad)).otherwise(0.0)
        return 1 / (1 + F.exp(-score))

    def accuracy(self, name: str, vote: int) -> float:
        """How often a vote of this rule is right."""
        good, bad = self.fires[name][0] * self.prior, self.fires[name][1] * (1 - self.prior)
        return (good if vote > 0 else bad) / (good + bad)


#: A vote in favour is common to both classes: it may not weigh more than this.
MAX_FAVOUR = 3.0
#: Where EM starts, and pseudo-texts that hold it there: a rule that never votes keeps its start.
START_PRIOR, START_FIRES, PSEUDO = 0.8, {-1: (0.02, 0.3), 1: (0.8, 0.5)}, 10.0


def fit_votes(patterns: DataFrame, rounds: int = 15, tolerance: float = 1e-4) -> VoteModel:
    """EM over (one column per rule, `n`) pattern rows; rules are independent given the class.

    A rule never counts against the direction of its own vote, so the two classes cannot swap.
    """
    start = VoteModel(START_PRIOR, {r[0]: START_FIRES[r[4]] for r in RULES})
    model = start
    for _ in range(rounds):
        p = model.posterior({r[0]: F.col(r[0]) for r in RULES})
        sums = [F.sum("n").alias("all"), F.sum(F.col("n") * p).alias("good")]
        for name, *_ in RULES:
            hit = F.when(F.col(name) != 0, F.col("n")).otherwise(0)
            sums += [F.sum(hit).alias(name), F.sum(hit * p).alias(f"{name}_good")]
        row = patterns.agg(*sums).first()
        if not row["all"]:
            return start
        good, bad = row["good"], row["all"] - row["good"]
        fires = {}
        for name, _, _, _, vote in RULES:
            was = start.fires[name]
            g = (row[f"{name}_good"] + PSEUDO * was[0]) / (good + PSEUDO)
            b = (row[name] - row[f"{name}_good"] + PSEUDO * was[1]) / (bad + PSEUDO)
            fires[name] = (g, max(b, g)) if vote < 0 else (g, min(max(b, g / MAX_FAVOUR), g))
        new = VoteModel((good + PSEUDO * START_PRIOR) / (row["all"] + PSEUDO), fires)
        moved = max([abs(new.prior - model.prior)] + [abs(x - y) for k in fires for x, y in zip(fires[k], model.fires[k])])
        model = new
        if moved < tolerance:
            break
    return model


def vote_patterns(df: DataFrame, vote: dict[str, Column]) -> DataFrame:
    """Counts of vote patterns; texts without words have no say."""
    return df.groupBy(*[v.alias(n) for n, v in vote.items()]).agg(F.count(F.lit(1)).alias("n"))


def assess(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the base statistics, `base_failed`, the posterior `quality` and `kept`.

    The narrow statistics are written once: the model is fitted on them and applied to them.
    """
    full, stat = with_stats(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    table = cut_lineage(full.select("doc_id", *[F.col(stat[k]).alias(k) for k in STATS]))
    plain = {k: k for k in STATS}
    vote = votes(plain)
    model = fit_votes(cut_lineage(vote_patterns(table.where("n_words > 0"), vote)))
    failed, quality = base_failed(plain), model.posterior(vote)
    return table.select(
        "doc_id", *STATS[:5], failed.alias("base_failed"), (~failed & (quality >= 0.5)).alias("kept"), quality.alias("quality"),
        F.array(*[v.cast("byte") for v in vote.values()]).alias("votes"),
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, all columns kept. Statistics are computed twice rather than texts shuffled."""
    full, stat = with_stats(docs, text)
    vote = votes(stat)
    model = fit_votes(cut_lineage(vote_patterns(full, vote | {"_words": F.col(stat["n_words"]) > 0}).where("_words")))
    # A filter moves below the statistics and computes them anew at each mention, unless a column there is not a
    # function of the row alone; the condition must mention it to keep it.
    row = fresh_name(full, "row")
    full = full.withColumn(row, F.monotonically_increasing_id())
    good = (F.col(row) >= 0) & ~base_failed(stat) & (model.posterior(vote) >= 0.5)
    return full.where(good).select(*[f"`{c}`" for c in docs.columns])
