"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field labels tokens that hold a digit or an "@":
neighbouring tokens are linked as a chain; tokens that repeat or resemble another of
the document, however far, are linked to one of them (skip edges): equal digits,
equal last seven digits, equal address or equal name before the "@". Loopy message
passing, run until it settles, spreads labels over both kinds of edge. Tokens that
base spans cover are evidence; others that reach `certain` for a kind become
further spans: a phone number without its "+", the tail of a card number, an
address that lost its domain's end, where the document names the whole elsewhere.

Weights are learned by pseudo-likelihood on a bounded sample of documents, whose
labels are the patterns' matches. So that the field learns more than the patterns
know, copies of sampled tokens, without what the pattern needs, are added to the
sample with the original's label and a skip edge to it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table
from .words import SPACE, pieces

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match can start only where a run of digits does: from within it, the rest would be the same.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAILISH = re.compile(r"[A-Za-z0-9._%+@-]+")
BUCKETS = 512
LABELS = len(KINDS) + 1
_MARK = np.zeros(256, bool)
_MARK[[*range(0x30, 0x3A), 0x40]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i & 1:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def addresses(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the addresses in a run of address characters and "@", in one pass over its "@"s."""
    start, at = 0, run.find("@")
    while at >= 0:
        found = DOMAIN.match(run, at + 1) if at > start else None
        if found:
            yield start, found.end()
        start = found.end() if found else at + 1
        at = run.find("@", start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass their checks, in order; time is linear in the text."""
    out = []
    if "@" in text:
        for run in MAILISH.finditer(text):
            if "@" in run[0]:
                out += [(run.start() + a, 0, run.start() + b) for a, b in addresses(run[0])]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    token = re.sub(r"[a-z]+", "a", token.lower())
    token = re.sub(r"[^\x00-\x7F]+", "u", token)
    return re.sub(r"[0-9]+", lambda m: "9" if len(m[0]) < 5 else "9" * min(6, 2 + len(m[0]) // 4), token)


def _bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % BUCKETS


def _digits(token: str) -> str:
    return re.sub(r"[^0-9]", "", token)


def features(token: str) -> list[int]:
    digits = _digits(token)
    quad = re.fullmatch(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})", token)
    found = [
        "bias", f"shape {shape(token)[:40]}", f"digits {min(len(digits), 20)}",
        f"luhn {14 <= len(digits) <= 19 and luhn(digits)} {len(digits) > 12}",
        f"quad {bool(quad) and all(int(x) < 256 for x in quad.groups())}",
        f"at {'@' in token} {'.' in token.rpartition('@')[2]}", f"plus {token[:1] == '+'}",
    ]
    return [_bucket(x) for x in found]


FEATURES = 7


def keys(token: str) -> list[str]:
    """What a token shares with its repeats and with tokens like it."""
    if "@" in token:
        name = token.lower().partition("@")[0]
        return [token.lower()] + ([name + "@"] if len(name) > 2 else [])
    digits = _digits(token)
    letters = re.search(r"[^\W0-9_]", token)
    if letters or len(digits) < 4:
        return [token.lower()] if len(token) > 3 else []
    return ["=" + digits] + (["-" + digits[-7:]] if len(digits) >= 7 else [])


def without_pattern(token: str, kind: int) -> str:
    """`token` of a match of `kind`, without what its pattern needs."""
    if kind == 1:  # an address as it stands in a host name
        return token.replace(".", "-")
    if kind == 2:  # the last digits
        return _digits(token)[-10:]
    if kind == 3:
        return _digits(token)[-10:]
    name, _, host = token.partition("@")
    return f"{name}@{host.partition('.')[0]}"


class Nodes:
    """Tokens of the texts of a piece, with features, evidence and edges.

    With `copies`, as training has it, a copy of each match without what its pattern
    needs, and of one in so many other tokens, joins the end of its text.
    """

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]], tokens: list[list[tuple[int, int]]], copies: int = 0):
        self.row, self.start, self.end, feats, label = [], [], [], [], []
        chain, skip = [], []
        for r, (text, base, found) in enumerate(zip(texts, spans, tokens)):
            shared: dict[str, list[int]] = {}
            at, extra = 0, []

            def add(core: str, a: int, b: int, hit: int) -> None:
                for key in keys(core):
                    shared.setdefault(key, []).append(len(self.row))
                self.row.append(r)
                self.start.append(a)
                self.end.append(b)
                feats.append(features(core))
                label.append(hit)

            for a, b in found:
                word = text[a:b]
                core = word.strip("\"'()[]{}<>.,;:!?*#$%&|=")
                if not core:
                    continue
                a += word.index(core)
                b = a + len(core)
                if self.row and self.row[-1] == r and a - self.end[-1] <= 40:
                    chain.append((len(self.row) - 1, len(self.row)))
                while at < len(base) and base[at][2] <= a:
                    at += 1
                span = next((x for x in base[at : at + 4] if x[0] < b and x[2] > a), None)
                hit = span[1] + 1 if span else 0
                add(core, a, b, hit)
                if copies and span and b >= span[2]:
                    extra.append((without_pattern(text[span[0] : span[2]], span[1]), hit))
                elif copies and not span and zlib.crc32(core.encode()) % copies == 0:
                    extra.append((core, hit))
            for core, hit in extra:
                add(core, -1, -1, hit)
            for alike in shared.values():
                # a hub, evidence if there is any: labels need two steps, however many repeats there are
                hub = next((n for n in alike if label[n]), alike[0])
                skip += [(hub, n) for n in alike if n != hub]
        self.features = np.array(feats, np.int64).reshape(-1, FEATURES)
        self.label = np.array(label, np.int64)
        self.chain, self.skip = (np.array(sorted(set(e)), np.int64).reshape(-1, 2) for e in (chain, skip))


class SkipChainCRF:
    """Unary weights by feature bucket; a label-pair matrix for chain and for skip edges."""

    def __init__(self):
        self.unary = np.zeros((BUCKETS, LABELS))
        self.pair = np.zeros((2, LABELS, LABELS))

    def fit(self, feats: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 400, rate: float = 0.5, decay: float = 2e-4) -> "SkipChainCRF":
        """Pseudo-likelihood: each label given its features and its neighbours' labels."""
        if not len(label):
            return self
        around = np.zeros((2, len(label), LABELS))
        for t, edges in enumerate((chain, skip)):
            np.add.at(around[t], edges[:, 0], np.eye(LABELS)[label[edges[:, 1]]])
            np.add.at(around[t], edges[:, 1], np.eye(LABELS)[label[edges[:, 0]]])
        want, n = np.eye(LABELS)[label], len(label)
        squares = [np.full_like(self.unary, 1e-8), np.full_like(self.pair, 1e-8)]
        for _ in range(rounds):
            z = self.unary[feats].sum(1) + sum(around[t] @ self.pair[t] for t in (0, 1))
            p = np.exp(z - z.max(1, keepdims=True))
            miss = p / p.sum(1, keepdims=True) - want
            down = [np.zeros_like(self.unary), np.stack([around[t].T @ miss for t in (0, 1)])]
            for f in range(feats.shape[1]):
                np.add.at(down[0], feats[:, f], miss)
            for w, g, s in zip((self.unary, self.pair), down, squares):
                g = g / n + decay * w
                s += g * g
                w -= rate * g / np.sqrt(s)
        self.pair = (self.pair + self.pair.transpose(0, 2, 1)) / 2
        return self

    def marginals(self, nodes: Nodes, rounds: int = 200, settled: float = 1e-3, evidence: float = 12.0) -> np.ndarray:
        """Label probabilities after loopy belief propagation; covered nodes are evidence.

        Messages are halved with their last value and sent until none changes by
        `settled`; `rounds` stops a graph on which they never do.
        """
        base = self.unary[nodes.features].sum(1)
        base[np.arange(len(base)), nodes.label] += evidence * (nodes.label > 0)
        ends = np.concatenate([nodes.chain, nodes.skip, nodes.chain[:, ::-1], nodes.skip[:, ::-1]])
        kinds = np.repeat([0, 1, 0, 1], [len(nodes.chain), len(nodes.skip)] * 2)
        half = len(ends) // 2
        message = np.zeros((len(ends), LABELS))
        belief = base
        if half:
            back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
            weights = self.pair[kinds]
            for _ in range(rounds):
                z = (belief[ends[:, 0]] - message[back])[:, :, None] + weights
                top = z.max(1)
                sent = top + np.log(np.exp(z - top[:, None]).sum(1))
                sent -= sent.max(1, keepdims=True)
                change = np.abs(sent - message).max()
                message = 0.5 * message + 0.5 * sent
                belief = base.copy()
                np.add.at(belief, ends[:, 1], message)
                if change < settled:
                    break
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def marked_tokens(buf: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per row, the (start, end) code points of tokens that hold a digit or an "@"."""
    rows = len(offsets) - 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    mark = np.flatnonzero(_MARK[buf])
    if not len(mark):
        return out
    edge = SPACE[buf]  # bytes of words
    edges = np.zeros(len(buf) + 1, bool)
    edges[offsets] = True
    starts = np.flatnonzero(edge & (np.concatenate([[True], ~edge[:-1]]) | edges[:-1]))
    ends = np.flatnonzero(edge & (np.concatenate([~edge[1:], [True]]) | edges[1:])) + 1
    which = np.unique(np.searchsorted(starts, mark, "right") - 1)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    row = np.searchsorted(offsets, starts[which], "right") - 1
    origin = points[offsets[row]]
    for r, a, b in zip(row.tolist(), (points[starts[which]] - origin).tolist(), (points[ends[which]] - origin).tolist()):
        out[r].append((a, b))
    return out


def _read(column: pa.Array, buf: np.ndarray, offsets: np.ndarray, i: int, j: int):
    """Texts that hold a mark, their base spans and tokens; other rows are empty."""
    tokens = marked_tokens(buf, offsets)
    texts = [column[k].as_py() if tokens[k - i] else "" for k in range(i, j)]
    return texts, [base_spans(t) if t else [] for t in texts], tokens


def training_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per sampled document with marks: its nodes' features, labels and edges, flat."""
    for batch in batches:
        for i, j, buf, offsets in pieces(batch.column(0), 1 << 17):
            nodes = Nodes(*_read(batch.column(0), buf, offsets, i, j), copies=4)
            if len(nodes.label):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.ravel().tolist()], pa.list_(pa.int64())) for x in (nodes.features, nodes.label, nodes.chain, nodes.skip)],
                    names=["f", "y", "chain", "skip"],
                )


def train(documents: DataFrame, sample_docs: int = 2000, sample_nodes: int = 40_000) -> SkipChainCRF:
    """Fit on at most `sample_docs` documents (the least hashes of doc_id) and `sample_nodes` of their tokens."""
    some = documents.filter("doc_id is not null and text rlike '[0-9@]'").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left_semi").select("text")
    found = rows.mapInArrow(training_nodes, "f array<long>, y array<long>, chain array<long>, skip array<long>")
    parts, total = [], 0
    for row in sorted(found.orderBy(F.xxhash64("f")).limit(sample_docs).collect(), key=lambda r: (len(r["y"]), r["f"])):
        if total + len(row["y"]) > sample_nodes:
            break
        parts.append((np.array(row["f"]).reshape(-1, FEATURES), np.array(row["y"]), *(np.array(row[c], np.int64).reshape(-1, 2) + total for c in ("chain", "skip"))))
        total += len(row["y"])
    if not parts:
        return SkipChainCRF()
    return SkipChainCRF().fit(*(np.concatenate(x) for x in zip(*parts)))


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans) -> str:
    """`text` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out.append(text[at:s] + f"<{KINDS[k]}>")
        at = max(at, e)
    return "".join(out) + text[at:]


def all_spans(model: SkipChainCRF, certain: float, column: pa.Array, i: int, j: int, buf: np.ndarray, offsets: np.ndarray):
    """Texts with a mark (others empty), their base spans, and the field's further spans by row."""
    texts, spans, tokens = _read(column, buf, offsets, i, j)
    nodes = Nodes(texts, spans, tokens)
    added: dict[int, list[tuple[int, int, int]]] = {}
    if len(nodes.label):
        p = model.marginals(nodes)
        kind = p[:, 1:].argmax(1)
        for n in np.flatnonzero((nodes.label == 0) & (p[:, 1:].max(1) >= certain)).tolist():
            own = added.setdefault(nodes.row[n], [])
            if own and own[-1][1] == kind[n] and nodes.start[n] - own[-1][2] <= 2:  # parts of one number
                own[-1] = (own[-1][0], int(kind[n]), nodes.end[n])
            else:
                own.append((nodes.start[n], int(kind[n]), nodes.end[n]))
    return texts, spans, added


def _find(model: SkipChainCRF, certain: float, texts_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "redacted"]
        for batch in batches:
            column = batch.column(1)
            for i, j, buf, offsets in pieces(column):
                texts, spans, added = all_spans(model, certain, column, i, j, buf, offsets)
                out = [[] for _ in range(8)]
                for r, base in enumerate(spans):
                    every = sorted(base + added[r]) if r in added else base
                    for k in range(4):
                        out[k].append(sum(x[1] == k for x in base))
                    out[4].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                    out[5].append(spans_text(every))
                    out[6].append(len(every) - len(base))
                    out[7].append((redact(texts[r], every) if every else column[i + r].as_py()) if texts_out else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:6]),
                     pa.array(out[6], pa.int64()), pa.array(out[7], pa.string())], names=names
                )
    return run


def _changed(model: SkipChainCRF, certain: float):
    """A function of a text column: redacted texts, null where nothing changes."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out: list[str | None] = [None] * len(column)
            for i, j, buf, offsets in pieces(column):
                texts, spans, added = all_spans(model, certain, column, i, j, buf, offsets)
                for r, base in enumerate(spans):
                    if base or r in added:
                        out[i + r] = redact(texts[r], sorted(base + added.get(r, [])))
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()  # so that the planner never runs it twice on a text


OUT = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, redacted string"


def find_personal(documents: DataFrame, model: SkipChainCRF | None = None, certain: float = 0.95, texts: bool = True) -> DataFrame:
    """Personal data in every (doc_id, text) row.

    Returns (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added,
    redacted): counts and digest of the pattern matches, all spans as
    kind:start:end in code points, how many of them the field added, and, if
    `texts`, the text with spans replaced. A null text has no spans and stays null.
    Rows are independent, so repeated rows and ids give repeated results; other
    columns are ignored; an empty table gives no rows. The document is read whole,
    whatever its length.
    """
    model = model or train(documents)
    bound_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").alias("row"), "text").mapInArrow(_find(model, certain, texts), f"row {documents.schema['doc_id'].dataType.simpleString()}, {OUT}").withColumnRenamed("row", "doc_id")


def redact_documents(documents: DataFrame, model: SkipChainCRF | None = None, certain: float = 0.95) -> DataFrame:
    """`documents`, all columns as they are, with spans in text replaced by their kind; n_chars follows where there is one.

    Only texts go to Python, and only those that change come back. A null text stays null.
    """
    model = model or train(documents)
    bound_batches(documents.sparkSession)
    names = documents.columns
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _changed(model, certain)("text").alias("new"))
    text = F.coalesce("new", "row.text")
    changed = {"text": text, "n_chars": F.when(F.col("new").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast("long")) if "n_chars" in names else None}
    return rows.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in names])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"), texts=False).drop("redacted")
