"""Personal data: patterns, and a skip-chain random field that carries labels between like tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.batches import bound_batches

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 6
# Weight of agreement between like tokens; marginal that an added span needs.
SKIP, SURE = 4.0, 0.8
# The patterns of the four kinds. An address part is a whole run of digits, which is never taken back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]")
_TRIM = ".,;:!?()[]{}<>\"'"

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Like the pattern as a whole, but begun at each @, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' matches that pass their checks, leftmost and apart within a kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _shape(token: str) -> str:
    """A token with runs of letters and digits shortened: what the field looks at."""
    out = re.sub(r"[^\W\d_]+", "a", token)
    return re.sub(r"[0-9]+", lambda m: "9" if len(m[0]) < 3 else "999" if len(m[0]) < 7 else "9999999", out)[:24]


def _like(token: str) -> list[str]:
    """Keys that similar tokens share: letters and digits alone, and the last seven digits."""
    plain = re.sub(r"[\W_]", "", token.lower())
    digits = re.sub(r"[^0-9]", "", token)
    return [x for x in (plain if len(plain) >= 5 else "", "#" + digits[-7:] if len(digits) >= 7 else "") if x]


@dataclass
class Chain:
    """Tokens with digits or an @: their spans, shapes, labels by the patterns (0: none), gaps and keys."""

    spans: list[tuple[int, int]]
    shapes: list[str]
    labels: np.ndarray
    linked: np.ndarray
    tokens: list[str]


def chain(text: str, base: list[Span]) -> Chain:
    spans, shapes, tokens, labels, linked = [], [], [], [], []
    last, upto = -2, 0
    ordered = sorted(base)
    for m in _TOKEN.finditer(text):
        raw = m[0]
        if not _MARK.search(raw):
            continue
        left, right = len(raw) - len(raw.lstrip(_TRIM)), len(raw.rstrip(_TRIM))
        if right <= left:
            continue
        start, end = m.start() + left, m.start() + right
        while upto < len(ordered) and ordered[upto][2] <= start:
            upto += 1
        own = next((k + 1 for s, k, e in ordered[upto:upto + 4] if s < end and e > start), 0)
        labels.append(own)
        spans.append((start, end))
        tokens.append(raw[left:right])
        shapes.append(_shape(raw[left:right]))
        linked.append(bool(len(spans) > 1 and m.start() - last <= 1))
        last = m.end()
    return Chain(spans, shapes, np.array(labels, np.int64), np.array(linked, bool), tokens)


@dataclass
class Field:
    """Log potentials: label given shape, and label after label of neighbours in the chain."""

    shapes: dict[str, np.ndarray]
    prior: np.ndarray
    pairs: np.ndarray


def skip_edges(tokens: list[str]) -> np.ndarray:
    """Pairs of consecutive tokens with a key in common: a group of like tokens has one edge fewer than members."""
    before: dict[str, int] = {}
    edges = set()
    for i, token in enumerate(tokens):
        for key in _like(token):
            if key in before:
                edges.add((before[key], i))
            before[key] = i
    return np.array(sorted(edges), np.int64).reshape(-1, 2)


def marginals(own: Chain, field: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy belief propagation over chain and skip edges; labels by the patterns are fixed."""
    unary = np.stack([field.shapes.get(s, field.prior) for s in own.shapes])
    fixed = own.labels > 0
    unary[fixed] = -30.0
    unary[fixed, own.labels[fixed]] = 0.0
    skips = skip_edges(own.tokens)
    near = np.flatnonzero(own.linked)
    a = np.r_[near - 1, skips[:, 0]]
    b = np.r_[near, skips[:, 1]]
    agree = np.eye(len(KINDS) + 1) * SKIP
    pair = np.concatenate([np.repeat(field.pairs[None], len(near), 0), np.repeat(agree[None], len(skips), 0)])
    onward, back = np.zeros((len(a), unary.shape[1])), np.zeros((len(a), unary.shape[1]))
    belief = unary
    for _ in range(rounds if len(a) else 0):
        to_b = np.logaddexp.reduce((belief[a] - back)[:, :, None] + pair, axis=1)
        to_a = np.logaddexp.reduce((belief[b] - onward)[:, None, :] + pair, axis=2)
        onward, back = to_b - np.logaddexp.reduce(to_b, 1, keepdims=True), to_a - np.logaddexp.reduce(to_a, 1, keepdims=True)
        belief = unary.copy()
        np.add.at(belief, b, onward)
        np.add.at(belief, a, back)
    return np.exp(belief - np.logaddexp.reduce(belief, 1, keepdims=True))


def added_spans(own: Chain, base: list[Span], field: Field) -> list[Span]:
    """Tokens outside the patterns' matches that the field labels surely and that are like a matched token."""
    if not len(own.labels) or not base or (own.labels > 0).all():
        return []
    sure = marginals(own, field)
    label = sure.argmax(1)
    known: dict[str, set[int]] = {}
    for token, kind in zip(own.tokens, own.labels):
        if kind:
            for key in _like(token):
                known.setdefault(key, set()).add(int(kind))
    return [(s, int(k) - 1, e) for (s, e), k, p, was, token in zip(own.spans, label, sure.max(1), own.labels, own.tokens)
            if k and not was and p >= SURE and any(int(k) in known.get(key, ()) for key in _like(token))]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (kind of count, shape or label, label) of a task's texts."""
    seen: dict[tuple[str, str, int], int] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text or not (_DIGIT.search(text) or "@" in text):
                continue
            own = chain(text, base_spans(text))
            for shape, kind in zip(own.shapes, own.labels.tolist()):
                seen[("shape", shape, kind)] = seen.get(("shape", shape, kind), 0) + 1
            for i in np.flatnonzero(own.linked):
                key = ("pair", str(own.labels[i - 1]), int(own.labels[i]))
                seen[key] = seen.get(key, 0) + 1
    keys = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                      pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["what", "of", "label", "n"])


def train_field(docs: DataFrame, text_col: str = "text", shapes: int = 5000) -> Field:
    """Potentials from counts over all texts, with the patterns' labels; the ``shapes`` commonest shapes have their own."""
    size = len(KINDS) + 1
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        _counts, "what string, of string, label int, n long").groupBy("what", "of", "label").agg(F.sum("n").alias("n"))
    wide = counted.groupBy("what", "of").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(size)])
    wide = wide.withColumn("n", sum(F.col(f"n{k}") for k in range(size)))
    rows = wide.orderBy("what", F.desc("n"), "of").limit(shapes + size).collect()  # pairs come first
    own, prior, pairs = {}, np.ones(size), np.ones((size, size))
    for row in rows:
        n = np.array([row[f"n{k}"] for k in range(size)], float)
        if row.what == "pair":
            pairs[int(row.of)] += n
        else:
            own[row.of], prior = n, prior + n
    prior /= prior.sum()
    return Field({s: np.log((n + 2 * prior) / (n.sum() + 2)) for s, n in own.items()}, np.log(prior),
                 np.log(pairs / pairs.sum(1, keepdims=True)) - np.log(prior)[None, :])


def written(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _found(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    field = shared.value
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text and (_DIGIT.search(text) or "@" in text) else []
            more = added_spans(chain(text, base), base, field) if base else []
            numbers = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
            rows.append((*numbers, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more)))
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
                                         ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find_personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row; positions are code points.

    Patterns give base spans; the field adds tokens that repeat or resemble a matched token of the same
    text (equal letters and digits, or the last seven digits) and that message passing labels with
    marginal SURE at least. Null and empty texts have no spans, null ids stay null, rows that repeat are
    each reported, other columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or train_field(docs, text_col))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lambda batches: _found(batches, shared),
                             "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
