"""Operator 2: secrets in texts, and credentials in several parts linked within scopes."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparkfeat.llm.batches import map_slices, text_array, texts_of

#: Code points between parts of one credential, unless a call says otherwise.
REACH = 200

#: The kinds in the order of their report, a pattern each, which group has to be
#: how long, and a cheap pattern that holds wherever the kind can match.
KINDS = ("assign", "access", "hex", "user", "code", "endpoint")
BASE = KINDS[:3]
PATTERNS = {
    "assign": (
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]",
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    "hex": (r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
    "user": (
        r"""\b(user(?:name)?|login|client_?id|account_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""",
        2, 3, r"(?i)(?:user|username|login|client_?id|account_?id|key_?id)[\"']? *[:=]",
    ),
    "code": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32, r"[A-Za-z0-9+/_-]{32}"),
    "endpoint": (
        r"""\b(?:https?|ftp|sftp|ssh|jdbc:[a-z0-9]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+""",
        0, 10, r"[a-z0-9]://",
    ),
}
ANY_CASE = ("assign", "user")
#: Which part of a credential a kind is; weak kinds need parts of all the roles that follow.
ROLE = {
    "assign": "secret", "hex": "secret", "code": "secret", "access": "identifier",
    "user": "identifier", "endpoint": "endpoint",
}
NEEDS = {"user": ("secret",), "code": ("identifier",), "endpoint": ("identifier", "secret")}

COMPILED = {
    kind: re.compile(p[0], re.ASCII | (re.IGNORECASE if kind in ANY_CASE else 0))
    for kind, p in PATTERNS.items()
}
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "links string"
)


class Span(NamedTuple):
    start: int
    order: int  # of the kind in the report
    end: int
    value: int  # where the part to hide begins
    kind: str


def matches(text: str, kind: str) -> list[Span]:
    """The kind's leftmost non-overlapping matches that are long enough."""
    _, group, least, _ = PATTERNS[kind]
    order = KINDS.index(kind)
    return [
        Span(m.start(), order, m.end(), m.start(group), kind)
        for m in COMPILED[kind].finditer(text)
        if m.end(group) - m.start(group) >= least
    ]


def mixed(text: str, span: Span) -> bool:
    """A code has capitals, small letters and digits; names and rules of characters have not."""
    part = text[span.start : span.end]
    return bool(re.search("[A-Z]", part) and re.search("[a-z]", part) and re.search("[0-9]", part))


def near(span: Span, others: list[Span], scopes: list[int], reach: int | None) -> list[Span]:
    """All of the sorted, non-overlapping others within reach and in the same scope."""
    found = []
    i = 0 if reach is None else bisect_left(others, span.start - reach, key=lambda o: o.end)
    while i < len(others) and (reach is None or others[i].start <= span.end + reach):
        other = others[i]
        apart = bisect_left(scopes, min(span.start, other.start)) != bisect_left(
            scopes, max(span.start, other.start)
        )
        overlap = other.start < span.end and span.start < other.end
        if not apart and not overlap:
            found.append(other)
        i += 1
    return found


def find(
    text: str, kinds: list[str], reach: int | None = REACH, blank_lines: bool = True
) -> tuple[list[Span], list[tuple[Span, list[Span]]]]:
    """All reported spans by start and kind, and for every part and role it links to all partners.

    The intervals of the parts, widened by ``reach`` (None: the whole text), are joined by a sweep
    over sorted intervals; with ``blank_lines`` a blank line ends a scope before that. A weak
    candidate (user name, code, endpoint) completes a credential if parts of all the roles that
    it needs are in its scope. All parts of a complete credential are reported, those that it
    links to as well, so that no link names a part that is not reported.
    """
    found = {kind: matches(text, kind) for kind in kinds}
    strong = [s for kind in BASE for s in found.get(kind, ())]
    taken = sorted((s.start, s.end) for s in strong)
    starts = [a for a, _ in taken]
    ends = list(np.maximum.accumulate([b for _, b in taken])) if taken else []

    def free(span: Span) -> bool:
        i = bisect_left(starts, span.end)
        return i == 0 or ends[i - 1] <= span.start

    weak = {k: [s for s in found.get(k, ()) if free(s)] for k in NEEDS}
    weak["code"] = [s for s in weak["code"] if mixed(text, s)]
    scopes = []
    if blank_lines and (strong or any(weak.values())):
        scopes = [m.start() for m in BLANK_LINE.finditer(text)]
    by_kind = {k: [*found.get(k, ())] if k in BASE else weak[k] for k in KINDS}
    spans, links = set(strong), []

    def partners(span: Span, role: str) -> list[Span]:
        return sorted(p for k in KINDS if ROLE[k] == role for p in near(span, by_kind[k], scopes, reach))

    for kind, roles in NEEDS.items():
        for span in weak[kind]:
            parts = [partners(span, role) for role in roles]
            if all(parts):
                spans.add(span)
                links += [(span, p) for p in parts]
    for span in by_kind["access"]:
        links += [(span, p) for p in [partners(span, "secret")] if p]
    spans.update(p for _, parts in links for p in parts)
    return sorted(spans), sorted(links)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def candidates(texts: pa.Array) -> np.ndarray:
    """For every text and kind whether the kind's cheap pattern occurs; rows are texts."""
    flags = [
        pc.match_substring_regex(texts, PATTERNS[k][3]).to_numpy(zero_copy_only=False) for k in KINDS
    ]
    return np.array(flags, bool).T.reshape(len(texts), len(KINDS))


def findings(texts: pa.Array, reach: int | None, blank_lines: bool):
    """Spans and links of every text in order."""
    for row, flags in enumerate(candidates(texts)):
        if flags.any():
            yield find(texts[row].as_py(), [k for k, f in zip(KINDS, flags) if f], reach, blank_lines)
        else:
            yield [], []


def scan_secrets(
    docs: DataFrame, reach: int | None = REACH, blank_lines: bool = True
) -> DataFrame:
    """Secrets in every whole text, with credentials that stand in several parts.

    Parts belong together within ``reach`` code points, and with ``blank_lines`` only if no blank
    line is between them; ``reach=None, blank_lines=False`` takes the whole text as one scope.

    Per row the counts of the base kinds, the SHA-256 of their spans, all ``spans`` as
    ``kind:start:end`` (code points, end exclusive; by start, then kind) and ``links`` as
    ``kind:start>kind:start``, one for every pair of a part and a partner. A missing text counts
    as empty; a missing doc_id stays missing; repeated rows are repeated; an empty table gives no
    rows. All parts of a scope are in one text, so nothing is shuffled.
    """

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {n: [] for n in ("assign", "access", "hex", "sha", "spans", "links")}
        for spans, links in findings(text_array(batch.column("text")), reach, blank_lines):
            base = [s for s in spans if s.kind in BASE]
            for kind in BASE:
                rows[kind].append(sum(s.kind == kind for s in base))
            rows["sha"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            rows["spans"].append(joined(spans))
            rows["links"].append(
                ",".join(f"{a.kind}:{a.start}>{b.kind}:{b.start}" for a, p in links for b in p)
            )
        kinds = [pa.int64()] * 3 + [pa.string()] * 3
        return pa.record_batch(
            [batch.column("doc_id").cast(pa.int64())]
            + [pa.array(v, t) for v, t in zip(rows.values(), kinds)],
            names=[f.split()[0] for f in SCHEMA.split(", ")],
        )

    return map_slices(texts_of(docs), function, SCHEMA)


def hide(text: str, spans: list[Span]) -> str:
    """The text with the secret part of every span replaced by its kind."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s.value, -s.end)):
        if span.end <= at:
            continue
        if span.value >= at:
            out += [text[at : span.value], f"[{span.kind.upper()}]"]
        at = span.end
    return "".join([*out, text[at:]])


def redact_secrets(
    docs: DataFrame, reach: int | None = REACH, blank_lines: bool = True
) -> DataFrame:
    """All rows and columns, with secrets in ``text`` hidden and ``n_chars`` counted anew.

    What is hidden is what :func:`scan_secrets` reports with the same options. A missing text
    stays missing, an empty one empty; rows without secrets are unchanged; repeated rows are
    changed alike; an empty table gives no rows.
    """
    columns = docs.columns

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        changed = texts.to_pylist()
        found = False
        for row, (spans, _) in enumerate(findings(text_array(texts), reach, blank_lines)):
            if spans:
                changed[row], found = hide(changed[row], spans), True
        if not found:
            return batch
        new = pa.array(changed, texts.type)
        arrays = dict(zip(batch.schema.names, batch.columns)) | {"text": new}
        if "n_chars" in columns:
            differs = pc.fill_null(pc.not_equal(new, texts), False)
            count = pc.utf8_length(new).cast(arrays["n_chars"].type)
            arrays["n_chars"] = pc.if_else(differs, count, arrays["n_chars"])
        return pa.record_batch(list(arrays.values()), schema=batch.schema)

    return map_slices(docs, function, docs.schema)
