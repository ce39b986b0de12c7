"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Base kinds are `assign`, `access` and `hex`. The method adds `entropy`: a candidate is a run of 20 or more
characters that keys are written in; a window of 20 characters slides over it, its counts kept
incrementally; windows whose entropy passes the threshold of the candidate's character class (hexadecimal
digits, letters of one case and digits, or any) are merged into spans. Allow-listed candidates (UUIDs,
paths and host names, dates, words with ordinary letters only, listed strings) are suppressed.

Defined results: NULL and empty texts have no spans; spans are code points, end exclusive; base spans are
leftmost and non-overlapping within a kind and are never removed by the allow-list; repeated rows get
equal results. Columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import gathered, read

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEXRUN = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What every assign match begins with; a text without any of them has none.
STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")
WINDOW = 20
#: Bits per character that a window must reach, by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.5, "mixed": 3.7}
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z]+"),
    re.compile(r"[a-z]+(?:[-_/][a-z]+)+"),
    re.compile(r"[0-9]+(?:[-_/][0-9]+)*"),
    re.compile(r"(.)\1+"),
)
ALLOW_LIST = frozenset({"abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef0123456789abcdef"})


def character_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "alnum" if re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", s) else "mixed"


_XLOG = [0.0] + [k * math.log2(k) for k in range(1, WINDOW + 1)]


def hot_windows(s: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of windows whose entropy is at least the threshold. One count changes by one at either end of a step."""
    xlog = _XLOG if window == WINDOW else [0.0] + [k * math.log2(k) for k in range(1, window + 1)]
    counts: dict[str, int] = {}
    for c in s[:window]:
        counts[c] = counts.get(c, 0) + 1
    total = sum(xlog[k] for k in counts.values())
    limit = window * (math.log2(window) - threshold) + 1e-9  # entropy = log2(w) - total / w
    out: list[tuple[int, int]] = []
    for i in range(len(s) - window + 1):
        if i:
            a, b = s[i - 1], s[i + window - 1]
            k = counts[a]
            total += xlog[k - 1] - xlog[k]
            counts[a] = k - 1
            k = counts.get(b, 0)
            total += xlog[k + 1] - xlog[k]
            counts[b] = k + 1
        if total <= limit:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + window)
            else:
                out.append((i, i + window))
    return out


def allowed(s: str) -> bool:
    return s in ALLOW_LIST or any(p.fullmatch(s) for p in ALLOWED)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    found = []
    low = text.lower()
    if any(stem in low for stem in STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEXRUN.finditer(text)]
    return found


def all_spans(text: str) -> tuple[list, list]:
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not allowed(s):
            more += [(m.start() + a, 3, m.start() + b) for a, b in hot_windows(s, THRESHOLDS[character_class(s)])]
    return sorted(base), sorted(base + more)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for part in gathered(batches, text):
            n: list[list[int]] = [[], [], [], []]
            sha, spans = [], []
            for t in part.column(text).to_pylist():
                base, every = all_spans(t) if t else ([], [])
                for k in range(4):
                    n[k].append(sum(x[1] == k for x in every) if every else 0)
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else empty)
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([part.column(key), *[pa.array(x, pa.int64()) for x in n[:3]], pa.array(sha), pa.array(spans), pa.array(n[3], pa.int64())], ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long").withColumnRenamed("key", key)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))
