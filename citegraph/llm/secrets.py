"""Secret scan: three fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens (runs of ASCII letters and digits) as begin, inside or outside of a secret. Only
tokens of a certain shape may be anything but outside: eight characters or more with both letters
and digits, or twenty or more letters of mixed case. A text thus falls into chains of such tokens that
lie within three characters of each other; a token between two chains is outside for certain, so
decoding each chain by Viterbi decodes the text. Emissions see the token's shape, the two words before it, the
characters on both sides, and features of the whole text.

Training is by maximum likelihood on a bounded sample (`SAMPLE` texts with a pattern's match and as many
without, by a hash of the id; at most `MAX_CHAINS` chains). A token within a match is a secret. Each sampled
chain is also seen without its surroundings, so shape alone must do; a sampled secret is also seen in
other alphabets, and each text gives made-up identifiers of its own words and digits as outside tokens.

Defined cases: a null text is empty and has no spans; a table without any match trains no field and yields the patterns'
spans alone; repeated rows are scanned each; offsets are code points; extra columns are ignored
by `scan` and kept by `redact`.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from citegraph.llm.common import fresh_name
from citegraph.session import cut_lineage

SAMPLE = 1500
MAX_CHAINS = 20_000
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.A)
_HEX = re.compile(r"[0-9a-f]{24,}", re.A)
_DIGITS = re.compile(r"[0-9][A-Za-z0-9]*", re.A)
_LETTERS = re.compile(r"[A-Za-z]{20,}", re.A)
_MIXED = re.compile(r"[a-z][A-Z]", re.A)
_BEFORE = re.compile(r"[A-Za-z0-9]*\Z", re.A)
_WORD = re.compile(r"[A-Za-z0-9]+", re.A)
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
O, B, I = 0, 1, 2  # noqa: E741
HASHED = 4096
GAP = 3


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself), by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign", m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def open_tokens(text: str) -> list[tuple[int, int]]:
    """Tokens that may be part of a secret, in order."""
    out = []
    done = 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, end = m.span()
        while start > 0 and text[start - 1] in _ALNUM:
            start -= 1
        done = end
        if end - start >= 8 and not text[start:end].isdigit():
            out.append((start, end))
    out += [m.span() for m in _LETTERS.finditer(text) if _MIXED.search(m.group()) and not _touches_digit(text, m)]
    return sorted(set(out))


def _touches_digit(text: str, m: re.Match) -> bool:
    return (m.start() > 0 and text[m.start() - 1] in _ALNUM) or (m.end() < len(text) and text[m.end()] in _ALNUM)


def chains(tokens: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = []
    for t in tokens:
        if out and t[0] - out[-1][-1][1] <= GAP:
            out[-1].append(t)
        else:
            out.append([t])
    return out


def _bucket(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n >= b for b in bounds)


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return c if c in "\"'=:/@#." else "blank" if c.isspace() else "other"


def shape_features(token: str) -> list[str]:
    digits = sum(c.isdigit() for c in token)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    upper, lower = any(c.isupper() for c in token), any(c.islower() for c in token)
    per = 10 * turns // len(token)
    length = _bucket(len(token), (12, 16, 20, 32, 48))
    return [
        "bias", f"len{length}", f"turns{_bucket(turns, (2, 4, 7, 12))}", f"rate{per}", f"digits{10 * digits // len(token)}",
        f"case{upper}{lower}", f"hex{all(c in '0123456789abcdef' for c in token)}", f"len{length}rate{per}", f"distinct{_bucket(len(set(token)), (6, 9, 12, 16, 24))}",
    ]


def context_features(text: str, start: int, end: int) -> list[str]:
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-2:]
    return [f"w{len(before) - i}={w}" for i, w in enumerate(before)] + [f"left{_side(text, start - 1)}", f"right{_side(text, end)}"]


def text_features(text: str, tokens: int) -> list[str]:
    return [f"size{_bucket(len(text), (500, 2000, 10000))}", f"open{_bucket(tokens, (2, 5, 20))}", f"code{'{' in text or ';' in text}"]


def _ids(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode()) % HASHED for f in features]


@dataclass
class Field:
    """Weights of a linear chain: (HASHED, 3) emissions and (3, 3) transitions."""

    emit: np.ndarray
    step: np.ndarray

    def viterbi(self, chain: list[list[int]]) -> list[int]:
        score = np.array([self.emit[f].sum(axis=0) for f in chain])
        score[0, I] = -1e9
        best, back = score[0], []
        for row in score[1:]:
            way = best[:, None] + self.step
            back.append(way.argmax(axis=0))
            best = way.max(axis=0) + row
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def _forbid(step: np.ndarray) -> np.ndarray:
    step = step.copy()
    step[O, I] = -1e9
    return step


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(data: list[tuple[list[list[int]], list[int]]], steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> Field | None:
    """Maximum likelihood by full-batch Adam; (features per token, tags) per chain. None without a secret."""
    data = data[:MAX_CHAINS]
    if not any(B in tags for _, tags in data):
        return None
    by_length: dict[int, list[tuple[list[list[int]], list[int]]]] = {}
    for chain in data:
        by_length.setdefault(len(chain[1]), []).append(chain)
    groups = []
    for length, group in by_length.items():
        n = len(group)
        at, feature = zip(*((i * length + t, f) for i, (chain, _) in enumerate(group) for t in range(length) for f in chain[t]))
        groups.append((n, length, np.array(at), np.array(feature), np.array([tags for _, tags in group])))
    emit, step = np.zeros((HASHED, 3)), np.zeros((3, 3))
    state = [np.zeros_like(x) for x in (emit, emit, step, step)]
    total = len(data)
    for k in range(1, steps + 1):
        g_emit, g_step = -ridge * emit * total, -ridge * step * total
        for n, length, at, feature, tags in groups:
            score = np.stack([np.bincount(at, emit[feature, c], n * length) for c in range(3)], axis=1).reshape(n, length, 3)
            score[:, 0, I] = -1e9
            t = _forbid(step)
            forward, backward = [score[:, 0]], [np.zeros((n, 3))]
            for i in range(1, length):
                forward.append(_logsum(forward[-1][:, :, None] + t, 1) + score[:, i])
            for i in range(length - 1, 0, -1):
                backward.append(_logsum(t + (score[:, i] + backward[-1])[:, None, :], 2))
            backward.reverse()
            z = _logsum(forward[-1], 1)[:, None]
            p = np.exp(np.stack(forward, 1) + np.stack(backward, 1) - z[:, None])
            wanted = np.eye(3)[tags] - p
            flat = wanted.reshape(-1, 3)
            for c in range(3):
                g_emit[:, c] += np.bincount(feature, flat[at, c], HASHED)
            for i in range(1, length):
                pair = np.exp(forward[i - 1][:, :, None] + t + (score[:, i] + backward[i])[:, None, :] - z[:, None])
                np.add.at(g_step, (tags[:, i - 1], tags[:, i]), 1.0)
                g_step -= pair.sum(axis=0)
        for w, g, m, v in ((emit, g_emit, state[0], state[1]), (step, g_step, state[2], state[3])):
            g = g / total
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(emit, _forbid(step))


def training_chains(text: str) -> list[tuple[list[list[int]], list[int]]]:
    """Tagged chains of one text, with and without surroundings, and made-up identifiers that are no secrets."""
    spans = base_spans(text)
    tokens = open_tokens(text)
    whole = text_features(text, len(tokens))
    out = []
    for chain in chains(tokens):
        tags, last = [], None
        for start, end in chain:
            inside = next((s for s in spans if s[3] <= start and end <= s[1]), None)
            tags.append(O if inside is None else I if inside is last and tags[-1] != O else B)
            last = inside
        shapes = [shape_features(text[s:e]) for s, e in chain]
        out.append(([_ids(x + context_features(text, s, e) + whole) for x, (s, e) in zip(shapes, chain)], tags))
        out.append(([_ids(x + whole) for x in shapes], tags))
        for (start, end), tag in zip(chain, tags):
            if tag == B:
                out += _made_secrets(text[start:end], context_features(text, start, end), whole)
    words = [w for w in _WORD.findall(text[:4096]) if w.isalpha()][:12]
    for a, b in zip(words[::2], words[1::2]):
        for made in (f"{a}{b}{zlib.crc32(a.encode()) % 10000}", f"{a}{zlib.crc32(b.encode()) % 100}{b}", f"{a.capitalize()}{b.capitalize()}{a.capitalize()}", f"{zlib.crc32(a.encode()) % 100000000:08d}T{zlib.crc32(b.encode()) % 1000000:06d}"):
            if open_tokens(made):
                out.append(([_ids(shape_features(made) + whole)], [O]))
    return out


def _made_secrets(secret: str, context: list[str], whole: list[str]) -> list[tuple[list[list[int]], list[int]]]:
    """What the sampled secret would look like in another alphabet: whole, and parted in two."""
    digest = hashlib.sha512(secret.encode()).digest()
    mixed = base64.b64encode(digest).decode().replace("+", "x").replace("/", "Q").rstrip("=")
    out = []
    for made in (mixed[:20], mixed[20:52], mixed[52:76], digest.hex().upper()[:32]):
        if open_tokens(made) == [(0, len(made))]:
            out += [([_ids(shape_features(made) + context + whole)], [B]), ([_ids(shape_features(made) + whole)], [B])]
        halves = made[: len(made) // 2], made[len(made) // 2 :]
        if all(open_tokens(h) == [(0, len(h))] for h in halves):
            out.append(([_ids(shape_features(h) + whole) for h in halves], [B, I]))
    return out


def fit(docs: DataFrame) -> Field | None:
    """The field learnt from a bounded sample of (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for t in batch.column("text").to_pylist() for x in training_chains(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in found], pa.list_(pa.list_(pa.int32()))), pa.array([t for _, t in found], pa.list_(pa.int32()))], ["chain", "tags"]
            )

    plain = docs.where("text IS NOT NULL")
    match = plain.where(F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"))
    # Ids are picked first, so that the sort moves no texts.
    ids = [
        x.select("doc_id", F.xxhash64(F.col("doc_id")).alias("h")).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id")
        for x in (match, plain)
    ]
    picked = cut_lineage(ids[0].unionByName(ids[1]).distinct())
    sample = plain.join(F.broadcast(picked), "doc_id", "left_semi")
    table = sample.mapInArrow(rows, "chain array<array<int>>, tags array<int>").orderBy(F.xxhash64("chain")).limit(MAX_CHAINS).toArrow()
    return fit_field(list(zip(table.column("chain").to_pylist(), table.column("tags").to_pylist())))


def all_spans(text: str, field: Field | None) -> list[tuple[int, int, str, int]]:
    """The patterns' spans and those of the field that touch none of them."""
    base = base_spans(text)
    if field is None:
        return base
    tokens = open_tokens(text)
    if not tokens:
        return base
    whole = text_features(text, len(tokens))
    added = []
    for chain in chains(tokens):
        ids = [_ids(shape_features(text[s:e]) + context_features(text, s, e) + whole) for s, e in chain]
        start = end = None
        for (s, e), tag in zip([*chain, (0, 0)], [*field.viterbi(ids), O]):
            if tag != I and start is not None:
                if not any(x[0] < end and start < x[1] for x in base):
                    added.append((start, end, "field", start))
                start = None
            if tag == B:
                start = s
            end = e
    return sorted(base + added, key=lambda s: (s[0], (*KINDS, "field").index(s[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the patterns' matches, a digest of their spans, and all spans."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    field = fit(source)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, listed = [], [], []
            for t in batch.column("text"):
                spans = all_spans(t.as_py(), field)
                base = [s for s in spans if s[2] in KINDS]
                counts.append([sum(s[2] == k for s in base) for k in KINDS])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                listed.append(joined(spans))
            n = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(n[:, k]) for k in range(3)], pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return source.mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, field: Field | None, mark: str = "[secret]") -> str:
    """The text with each secret replaced by `mark`; the name before an assignment stays."""
    out, at = [], 0
    for start, end in sorted((s[3], s[1]) for s in all_spans(text, field)):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced in `text`; nulls stay null. A column `length` follows the text."""
    field = fit(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = [None if t is None else redacted(t, field) for t in (x.as_py() for x in batch.column(at))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(rows, docs.schema)
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in docs.columns else out
