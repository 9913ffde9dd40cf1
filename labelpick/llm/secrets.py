"""Secrets in texts: known shapes, and strings whose characters look drawn at random.

The known shapes are three patterns (assignments, access keys, long hex numbers). Beyond these, every string of key
characters is cut into runs per character class (hex digits, letters and digits, base64 letters), and a window slides
over each run. Its Shannon entropy comes from character counts that are changed by one character in and one out.
Windows over the limit of their class join to spans; an allow-list takes away spans that are known to be harmless.
It never takes away a known shape.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from labelpick.llm.common import slices, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this equals runs of at least 32
BASE_KINDS = ("assign", "access", "hex")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
# class: (characters of a run, least bits per character in a window)
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9a-fA-F]{%d,}" % WINDOW), 3.0),
    "entropy_alnum": (re.compile(r"[0-9A-Za-z]{%d,}" % WINDOW), 3.7),
    "entropy_base64": (re.compile(r"[0-9A-Za-z+/_=-]{%d,}" % WINDOW), 3.9),
}
# Words and numbers are no secrets: only letters of one case (a first capital allowed), digits only, UUIDs,
# hyphenated or underscored words.
ALLOWED = (r"[A-Z]?[a-z]+", r"[A-Z]+", r"[0-9]+",
           r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
           r"[A-Z]?[a-z]*(?:[-_=/+][A-Z]?[a-z]*)*")
KINDS = (*BASE_KINDS, *CLASSES)
SLICE_BYTES = 8 << 20
SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the known shapes."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def random_windows(run: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``run`` whose entropy reaches ``least``."""
    term = _TERM if window == WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    bound = window * (math.log2(window) - least) + 1e-9  # entropy >= least as a bound on sum c log2 c
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += term[n + 1] - term[n] if i < window else 0.0
        if i >= window:
            out = run[i - window]
            m = counts[out]
            total += term[m - 1] - term[m]
            counts[out] = m - 1
            n = counts.get(c, 0)
            total += term[n + 1] - term[n]
        counts[c] = n + 1
        if i >= window - 1 and total <= bound:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def entropy_spans(text: str, allowed: re.Pattern) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of random-looking strings that the allow-list doesn't know."""
    found = []
    for candidate in CANDIDATE.finditer(text):
        if allowed.fullmatch(candidate[0]):
            continue
        for kind, (runs, least) in CLASSES.items():
            for run in runs.finditer(text, candidate.start(), candidate.end()):
                found += [(run.start() + a, KINDS.index(kind), run.start() + b)
                          for a, b in random_windows(run[0], least)
                          if not allowed.fullmatch(text, run.start() + a, run.start() + b)]
    return found


def written(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOWED, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Secrets of every text: doc_id, counts per known shape, a digest of the known shapes, and all spans as text.

    Offsets are code points, ends exclusive. Spans are ordered by start, then kind. ``allow`` holds patterns that must
    match a whole candidate or span to take it away. Null and empty texts have no spans. Rows are independent: repeated
    and null ids give one row each. Other columns are ignored. Texts are never cut.
    """
    pattern = "|".join(f"(?:{p})" for p in allow) or r"(?!)"

    def scan(batches):
        allowed = re.compile(pattern, re.DOTALL)
        for batch in slices(batches, "text", SLICE_BYTES):
            out = []
            for text in texts(batch.column("text")):
                base = base_spans(text)
                extra = entropy_spans(text, allowed)
                kinds = [kind for _, kind, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2),
                            hashlib.sha256(written(base).encode()).hexdigest(), written(base + extra), len(extra)))
            columns = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return (docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
            .mapInArrow(scan, SCHEMA))
