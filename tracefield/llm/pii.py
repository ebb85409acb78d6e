"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans (e-mail, ip, card, phone). Tokens with a digit or
an @ are the nodes of a random field per document; all others are outside.
Tokens next to each other are linked as a chain; each token is also linked to
the last earlier one that is the same or similar (same text without marks, same
digits, same local part), however distant. Base spans are observed. Loopy
message passing carries their labels along the links, so that a repeat of an
entity that the patterns miss (another spelling, a part of it) gets its label;
tokens whose label is surer than a threshold become further spans. Weights are
learned from the base spans of a bounded sample of the documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefield.llm.common import mix, slices
from tracefield.llm.learn import bounded_sample, lbfgs
from tracefield.session import checkpoint

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: documents that weights are learned from, at most (about), and tokens of each
MAX_LEARNED, MAX_TOKENS = 4_000, 256
PLACES = 1 << 12
THRESHOLD = 0.95
#: rounds of messages at most, besides those for the longest path of the document
ROUNDS = 100

# possessive forms of the given patterns: the same matches, without backtracking over long runs
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile(r"[^0-9]+")
CANDIDATE = re.compile(r"[0-9@]\S*")
TRIM = "\"'.,;:!?()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by the given patterns, per kind leftmost and not overlapping, in order."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the white-space tokens that hold a digit or an @."""
    out, last = [], 0
    for m in CANDIDATE.finditer(text):
        start = m.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        out.append((start, m.end()))
        last = m.end()
    return out


def token_labels(found: list, spans: list) -> np.ndarray:
    """Label number of each token: of the first base span that overlaps it, else 0."""
    label = np.zeros(len(found), np.int64)
    i = 0
    for k, (start, end) in enumerate(found):
        while i < len(spans) and max(s[2] for s in spans[i : i + 1]) <= start:
            i += 1
        for s, kind, e in spans[i : i + 8]:
            if s < end and e > start:
                label[k] = kind + 1
                break
    return label


def features(token: str, before: str, after: str) -> list[int]:
    """Hashed places: shape, counts, validity as an entity, neighbours."""
    core = token.strip(TRIM)
    digits = NOT_DIGIT.sub("", core)
    shape = re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", core)))[:40]
    names = [
        "bias",
        "shape " + shape,
        f"digits {min(len(digits), 20)}",
        f"letters {'a' in shape}",
        f"marks {len(core) - len(digits) - shape.count('a') > 0}",
        f"at {core.count('@')} {bool(base_spans(core)) if '@' in core else ''}",
        f"dots {min(core.count('.'), 5)}",
        f"plus {core[:1] == '+'}",
        f"luhn {12 <= len(digits) <= 19 and luhn(digits)}",
        "before " + before[-12:].lower(),
        "after " + after[:12].lower(),
    ]
    return [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=4).digest(), "little") % PLACES for x in names]


def alike(token: str) -> set[str]:
    """Keys that a token shares with its repeats and its other spellings."""
    core = token.strip(TRIM).lower()
    keys = {core} if len(core) >= 4 else set()
    digits = NOT_DIGIT.sub("", core)
    if len(digits) >= 7:
        keys.add(digits)
        keys.add(digits[-10:])
    local = core.partition("@")[0]
    if "@" in core and len(local) >= 5 and not local.isalpha():
        keys.add(local)
    return keys


def graph(text: str, found: list) -> tuple[list, list]:
    """(chain edges, skip edges) between token numbers; a token has one skip edge for each key at most."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if not text[found[i][1] : found[i + 1][0]].strip() and found[i + 1][0] - found[i][1] <= 2]
    last: dict[str, int] = {}
    skip = set()
    for i, (start, end) in enumerate(found):
        for key in alike(text[start:end]):
            j = last.get(key)
            if j is not None and (j, i) not in chain[-1:]:
                skip.add((j, i))
            last[key] = i
    return chain, sorted(skip)


def near_words(text: str, start: int, end: int) -> tuple[str, str]:
    before, after = text[max(0, start - 24) : start].split(), text[end : end + 24].split()
    return (before[-1] if before else ""), (after[0] if after else "")


def learn(docs: DataFrame, bound: int = MAX_LEARNED, penalty: float = 1.0) -> dict:
    """Weights: ``unary`` (feature place, label), ``chain`` and ``skip`` (label, label).

    ``bound`` documents with candidate tokens are learned from, whole; their
    labels are the base spans. Pair weights count the edges of all their tokens;
    the unary rows are bounded too: MAX_TOKENS of a document, from all over it.
    """
    width = len(LABELS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text"):
                out, pairs = [], np.zeros((2, width, width), np.int64)
                for text in b.column("text").to_pylist():
                    found = tokens(text or "")
                    label = token_labels(found, base_spans(text or ""))
                    # edges all count; of very many tokens, some from all over the text are rows of the unary weights
                    for i in np.sort(np.argsort(mix(np.arange(len(found))), kind="stable")[:MAX_TOKENS]).tolist():
                        s, e = found[i]
                        out.append((int(label[i]), features(text[s:e], *near_words(text, s, e))))
                    for kind, edges in enumerate(graph(text or "", found)):
                        for i, j in edges:
                            pairs[kind, label[i], label[j]] += 1
                for kind in (0, 1):
                    out += [(-1 - kind, pairs[kind].ravel().tolist())]
                y, x = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.int32()))], ["label", "x"])

    def fit(data: pd.DataFrame) -> pd.DataFrame:
        tables = np.zeros((2, width, width))
        for y, x in data.loc[data["label"] < 0, ["label", "x"]].itertuples(index=False):
            tables[-1 - y] += np.reshape(x, (width, width))
        data = data[data["label"] >= 0]
        y = data["label"].to_numpy(np.int64)
        x = np.array(data["x"].tolist(), np.int64).reshape(len(y), -1)
        every, target = np.arange(len(y)), np.eye(width)[y]

        def loss(w):
            w = w.reshape(PLACES, width)
            z = w[x].sum(1)
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            value = -np.log(np.maximum(p[every, y], 1e-300)).sum() + penalty / 2 * (w * w).sum()
            grad = penalty * w
            for c in range(width):
                r = p[:, c] - target[:, c]
                grad[:, c] += np.bincount(x.ravel(), np.repeat(r, x.shape[1]), PLACES)
            return value / max(1, len(y)), grad.ravel() / max(1, len(y))

        w = lbfgs(loss, np.zeros(PLACES * width), rounds=60) if len(y) else np.zeros(PLACES * width)
        # pair weights: how much oftener two labels meet on an edge than their shares alone would have it
        out = []
        for t in tables:
            t = t + 0.5
            joint, left, right = t / t.sum(), t.sum(1) / t.sum(), t.sum(0) / t.sum()
            out.append(np.clip(np.log(joint) - np.log(left)[:, None] - np.log(right)[None, :], -4, 4))
        return pd.DataFrame({"unary": [w.tolist()], "chain": [out[0].ravel().tolist()], "skip": [out[1].ravel().tolist()]})

    sample = bounded_sample(docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]")), "doc_id", bound)
    data = checkpoint(sample.mapInArrow(rows, "label int, x array<int>")).withColumn("one", F.lit(0))
    got = data.groupBy("one").applyInPandas(fit, "unary array<double>, chain array<double>, skip array<double>").first()
    if got is None:
        return {"unary": np.zeros((PLACES, width)), "chain": np.zeros((width, width)), "skip": np.zeros((width, width))}
    return {"unary": np.reshape(got["unary"], (PLACES, width)).astype(np.float32), "chain": np.reshape(got["chain"], (width, width)), "skip": np.reshape(got["skip"], (width, width))}


def longest_path(edges: list) -> int:
    """Edges of the longest path that goes on in text order; ``edges`` have the earlier token first."""
    depth: dict[int, int] = {}
    for i, j in sorted(edges, key=lambda e: e[1]):
        depth[j] = max(depth.get(j, 0), depth.get(i, 0) + 1)
    return max(depth.values(), default=0)


def pass_messages(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int | np.ndarray = 12, damping: float = 0.3, settled: float = 1e-6) -> np.ndarray:
    """Marginals of a pairwise field by loopy sum-product in logarithms.

    ``unary`` (nodes, labels), ``edges`` (m, 2), ``pair`` (m, labels, labels),
    ``rounds`` at most, of all nodes or of each. A round makes anew only the
    messages whose node got one that was not settled yet.
    """
    def normal(x):
        x = x - x.max(1, keepdims=True)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    m, width = len(edges), unary.shape[1]
    source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    table = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.r_[np.arange(m, 2 * m), np.arange(m)]
    message = np.full((2 * m, width), -np.log(width))
    belief = unary.astype(float)
    np.add.at(belief, target, message)
    limit = np.broadcast_to(rounds, len(unary))
    active, done = np.arange(2 * m), 0
    while len(active := active[limit[source[active]] > done]):
        send = belief[source[active]] - message[back[active]]
        z = send[:, :, None] + table[active]
        top = z.max(1)
        new = normal(top + np.log(np.exp(z - top[:, None, :]).sum(1)))
        moved = np.abs(new - message[active]).max(1) >= settled
        active, new = active[moved], new[moved]
        change = (1 - damping) * (new - message[active])
        message[active] += change
        np.add.at(belief, target[active], change)
        reached = np.zeros(len(unary), bool)
        reached[target[active]] = True
        again = reached[source]
        again[active] = True
        active, done = np.flatnonzero(again), done + 1
    return np.exp(normal(belief)) if len(unary) else belief


def find(texts: list, model: dict, threshold: float = THRESHOLD) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, as (start, kind number, end)."""
    base = [base_spans(t or "") for t in texts]
    found, labels, unary, edges, pair, sizes, rounds = [], [], [], [], [], [], []
    shift = 0
    for text, spans in zip(texts, base, strict=True):
        here = tokens(text or "")
        label = token_labels(here, spans)
        found.append(here)
        labels.append(label)
        chain, skip = graph(text or "", here)
        edges += [(i + shift, j + shift) for i, j in (*chain, *skip)]
        pair += [0] * len(chain) + [1] * len(skip)
        unary += [model["unary"][features(text[s:e], *near_words(text, s, e))].sum(0) for s, e in here]
        sizes.append(len(here))
        # a label moves one edge a round, and damped messages take some more to settle
        rounds += [ROUNDS + 4 * longest_path([*chain, *skip])] * len(here)
        shift += len(here)
    if not shift:
        return [(spans, []) for spans in base]
    scores = np.array(unary, float)
    seen = np.concatenate(labels)
    fixed = np.flatnonzero(seen)
    scores[fixed] = -30.0
    scores[fixed, seen[fixed]] = 0.0
    tables = np.stack([model["chain"], model["skip"]])
    marginal = pass_messages(scores, np.array(edges, np.int64).reshape(-1, 2), tables[np.array(pair, np.int64)].reshape(-1, *tables.shape[1:]), np.array(rounds))
    out, at = [], 0
    for text, spans, here, n in zip(texts, base, found, sizes, strict=True):
        best, sure = marginal[at : at + n].argmax(1), marginal[at : at + n].max(1)
        open_ = (seen[at : at + n] == 0) & (best > 0) & (sure >= threshold)
        at += n
        added: list[tuple[int, int, int]] = []
        previous = -2
        for i in np.flatnonzero(open_).tolist():
            start, end = here[i]
            while start < end and text[start] in TRIM and text[start] != "(":
                start += 1
            while end > start and text[end - 1] in TRIM and text[end - 1] != ")":
                end -= 1
            kind = int(best[i]) - 1
            if added and previous == i - 1 and added[-1][1] == kind and not text[added[-1][2] : start].strip():
                added[-1] = (added[-1][0], kind, end)
            elif end > start:
                added.append((start, kind, end))
            previous = i
        out.append((spans, added))
    return out


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added.

    Whole texts, places in code points, end exclusive; null text counts as
    empty; repeated and null ids give a row each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text"):
                rows = []
                for base, added in find(b.column("text").to_pylist(), model):
                    n = [0] * len(KINDS)
                    for _, k, _ in base:
                        n[k] += 1
                    rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added)), len(added)))
                *n, digest, spans, more = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array(digest), pa.array(spans), pa.array(more, pa.int64())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list) -> str:
    """The text with every span (overlapping ones as one, under the first one's kind) put as <KIND>."""
    out, done = [], 0
    for start, kind, end in sorted(spans):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with personal data in ``text`` put as <EMAIL>, <IP>, <CARD>, <PHONE>; null texts stay null, other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            at = big.schema.get_field_index("text")
            for b in slices(big, "text"):
                texts = b.column("text").to_pylist()
                new = [t if t is None else masked(t, base + added) for t, (base, added) in zip(texts, find(texts, model), strict=True)]
                yield b.set_column(at, big.schema.field(at), pa.array(new, big.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
