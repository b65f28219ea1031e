"""Operator 10: secret scans by two character Markov models beside three fixed patterns.

Two first-order character models, of random strings and of ordinary identifiers, are trained from labelled samples: seeded
draws from the alphabets that keys are written in, and words and joined words of a bounded sample of the corpus with the
identifiers below. A stretch of 16 or more of ``[A-Za-z0-9+/_=-]`` is a secret where its log-likelihood ratio, a
character, exceeds ``MARGIN``, and so is the likeliest part of one (a key behind a path or a name) whose sum is ``SURE`` beyond that.
Characters of a pattern's span add nothing; what it leaves of a stretch is judged by itself.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_NAMES = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.IGNORECASE | re.ASCII)
LEAST = 16
MARGIN = 0.9
#: What a part of a stretch must have beyond ``MARGIN``, in all, where the whole stretch isn't a secret.
SURE = 12.0
#: Rows of the corpus from which ordinary words are taken, those with the least hash of doc_id.
SAMPLE = 400
_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
_ORDINARY = ("get_user_by_id", "setDefaultTimeout", "MAX_BUFFER_SIZE", "application-configuration", "is_valid_email_address", "createElementNS", "https", "readme", "handleRequestError", "user_profile_picture", "DEFAULT_PAGE_LIMIT", "content-type", "x-forwarded-for", "total_amount_2024", "version_1_0_3", "section-2-1", "index_0001", "page10", "src/main/java/com/example", "usr/local/lib/python3")

_CLASS = np.zeros(256, bool)
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def _model(samples: list[str]) -> np.ndarray:
    """Log-probability of each character after each (row 0: at the start), add-half smoothed over the alphabet."""
    c = np.zeros((128, 128))
    for s in samples:
        b = np.frombuffer(s.encode("ascii"), np.uint8)
        np.add.at(c, (np.concatenate([[0], b[:-1]]), b), 1)
    c = c[:, : len(_CLASS) // 2] + 0.5 * _CLASS[:128]
    return np.log(np.where(_CLASS[:128], c, 1) / c.sum(1, keepdims=True))


def fit(words: list[str], seed: int = 10) -> np.ndarray:
    """Log-likelihood ratio of each character transition: random strings against words and identifiers."""
    r = np.random.Generator(np.random.PCG64(seed))
    positive = ["".join(a[i] for i in r.integers(0, len(a), r.integers(16, 48)).tolist()) for a in _ALPHABETS for _ in range(1500)]
    plain = sorted({w for w in words if w and w.isascii() and all(_CLASS[ord(x)] for x in w)})
    joined = []
    if plain:
        for sep in ("_", "-", "/", "", "2", "10"):
            joined += [sep.join(plain[i] for i in three) for three in r.integers(0, len(plain), (1500, 3)).tolist()]
    negative = plain + [w.capitalize() for w in plain] + [w.upper() for w in plain[::4]] + joined + [x for x in _ORDINARY for _ in range(50)]
    return _model(positive) - _model(negative)


def _runs(member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    k = b - a >= least
    return list(zip(a[k].tolist(), b[k].tolist(), strict=True))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, by start and then as listed; offsets in code points."""
    out = []
    if _NAMES.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    raw = text.encode("utf-8", "surrogatepass")
    out += [("hex", a, b) for a, b in _points(raw, text, _runs(_HEX[np.frombuffer(raw, np.uint8)], 16))]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _points(raw: bytes, text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte runs of ASCII characters as code point spans."""
    if len(raw) == len(text) or not runs:
        return runs
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # code points before each byte
    return [(a := int(before[x]), a + y - x) for x, y in runs]


def _taken(raw: bytes, text: str, base: list) -> np.ndarray:
    """Which bytes of a text lie in base spans."""
    edge = np.zeros(len(raw) + 1, np.int64)
    if base:
        at = np.array([s[1:] for s in base], np.int64)
        if len(raw) != len(text):  # code points to bytes
            start = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
            at = start[at]
        np.add.at(edge, at[:, 0], 1)
        np.add.at(edge, at[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def likeliest(score: np.ndarray, least: int = LEAST) -> tuple[int, int, float]:
    """(from, to, sum) of the stretch of at least ``least`` scores with the largest sum."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    low = np.minimum.accumulate(total[: len(total) - least])
    gain = total[least:] - low
    end = int(gain.argmax())
    return int(total[: end + 1].argmin()), end + least, float(gain[end])


def spans(text: str, ratio: np.ndarray, margin: float = MARGIN) -> tuple[list, list]:
    """(base spans, all spans). What a base span leaves of a stretch is judged by itself; linear in the text."""
    base = base_spans(text)
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    found = []
    for x, y in _runs(_CLASS[b] & ~_taken(raw, text, base), LEAST):
        part = b[x:y].astype(np.int64)
        score = ratio[np.concatenate([[0], part[:-1]]), part] - margin
        if score.sum() > 0:
            found.append((x, y))
            continue
        a, e, gain = likeliest(score)
        if gain > SURE:
            found.append((x + a, x + e))
    more = [("markov", *s) for s in _points(raw, text, found)]
    return base, sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def sample_words(docs: DataFrame, rows: int = SAMPLE, most: int = 20_000) -> list[str]:
    """Up to ``most`` distinct words of letters of ``rows`` whole texts, by hash of doc_id."""
    ids = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows).select(F.col("doc_id").alias("id")).distinct()
    few = docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    words = few.select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("w")).where("length(w) between 2 and 40").distinct()
    return sorted(r.w for r in words.orderBy(F.xxhash64("w"), "w").limit(most).collect())


def secret_scan(docs: DataFrame, margin: float = MARGIN, words: list[str] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of each whole text; null text is empty.

    An empty text has no spans and the hash of the empty string. No shuffle of texts. Other columns are ignored; repeated rows each
    give a row; an empty table trains on the fixed samples alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ratio = fit(sample_words(docs) if words is None else words)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), (t.as_py() for t in batch["text"]), strict=True):
                base, every = spans(text, ratio, margin)
                kinds = [s[0] for s in every]
                rows.append((doc_id, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), kinds.count("markov")))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (*(pa.int64(),) * 4, pa.string(), pa.string(), pa.int64()), strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")
