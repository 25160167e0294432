"""Secret scans with multipart credential linking.

Base patterns stand alone. Weaker ones (an account name, a value that looks random, a host) say little by
themselves, so they are parts: identifier, secret, endpoint. Each part opens a scope, its own span widened by
``reach`` code points, and an interval join of the scopes inside a document finds what stands together. An
identifier is reported if a secret is in its scope, a secret if an identifier is, an endpoint only if both are.
Base spans join in as identifiers (access) or secrets (assign, hex) and are reported in any case.

The join is local to a document and sweeps sorted starts, so nothing is shuffled and no pairs are made.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Base patterns (fixed values): kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
_ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Weak parts: kind, what the text must hold, pattern, group that is the part.
WEAK = (
    ("identifier", ("=", ":"), re.compile(r"""(?i:\b(?:user(?:name|_id)?|login|account(?:_id)?|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9][A-Za-z0-9._@-]{2,63})""", re.ASCII), 1),
    ("identifier", ("AIDA", "AROA", "ASIA"), re.compile(r"\b(?:AIDA|AROA|ASIA)[A-Z0-9]{12,}"), 0),
    ("secret", ("=", ":"), re.compile(r"""(?i:\b(?:pass|pwd|auth|bearer|private_?key|access_?secret|key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.ASCII), 1),
    ("secret", (), re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_-])", re.ASCII), 0),
    ("endpoint", ("://",), re.compile(r"""\b[a-z][a-z0-9+]{1,15}://[^\s"'<>]{4,}""", re.ASCII), 0),
    ("endpoint", ("=", ":"), re.compile(r"""(?i:\b(?:host(?:name)?|endpoint|server|bucket))["']?\x20*[:=]\x20*["']?([A-Za-z0-9][A-Za-z0-9.-]{3,252}(?::[0-9]{1,5})?)""", re.ASCII), 1),
)
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
PARTS = {"access": "identifier", "assign": "secret", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str) -> list[Span]:
    out = []
    lower = text.lower()
    for k, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign" and not any(w in lower for w in _ASSIGNED) or kind == "access" and "AKIA" not in text:
            continue
        out += [Span(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def looks_random(value: str) -> bool:
    """A digit, a letter, and many different characters."""
    found = set(value)
    return len(found) >= 10 and any(c.isdigit() for c in found) and any(c.isalpha() for c in found)


def weak_spans(text: str, taken: list[Span]) -> list[Span]:
    """Weak parts that don't touch a span already taken."""
    starts, ends, found = [s.start for s in taken], [s.end for s in taken], set()
    for kind, needs, pattern, group in WEAK:
        if needs and not any(x in text for x in needs):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if kind == "secret" and group == 0 and not looks_random(m[0]):
                continue
            if bisect.bisect_left(starts, b) == bisect.bisect_right(ends, a):  # all that start before b end at or before a
                found.add(Span(a, KINDS.index(kind), b))
    return sorted(found)


class Scopes:
    """Intervals sorted by start, to be asked whether some of them meets a scope."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts = [s.start for s in spans]
        self.ends = list(accumulate((s.end for s in spans), max))  # the last end of all that start no later

    def meet(self, span: Span, reach: int) -> bool:
        k = bisect.bisect_right(self.starts, span.end + reach)
        return k > 0 and self.ends[k - 1] >= span.start - reach


def scan(text: str | None, reach: int = 200) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and those with the linked weak parts; each by start, then kind as in KINDS."""
    if not text:
        return [], []
    base = base_spans(text)
    weak = weak_spans(text, base)
    if not weak:
        return base, base
    parts: dict[str, list[Span]] = {"identifier": [], "secret": [], "endpoint": []}
    for s in sorted({*base, *weak}):
        parts[PARTS[KINDS[s.kind]]].append(s)
    index = {k: Scopes(v) for k, v in parts.items()}
    needs = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
    linked = [s for s in weak if all(index[k].meet(s, reach) for k in needs[KINDS[s.kind]])]
    return base, sorted([*base, *linked])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each run of overlapping spans replaced by a mark of the first one's kind."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{KINDS[s.kind]}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if out else text


def scan_documents(docs: DataFrame, reach: int = 200) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans; repeated rows are scanned each; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text in f["text"]:
                base, spans = scan(text, reach)
                kinds = [s.kind for s in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", f["doc_id"].array)
            yield out

    # as a string: pandas would turn a column with nulls to floats
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def redact_documents(docs: DataFrame, reach: int = 200) -> DataFrame:
    """docs with the secrets in text replaced by marks, and n_chars, where there is one, to match; other columns stay."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, scan(t, reach)[1]) for t in texts], dtype=object)

    docs = docs.withColumn("text", cleaned("text"))
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs
