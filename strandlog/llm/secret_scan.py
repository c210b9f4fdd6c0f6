"""Secret scans: fixed patterns, and character Markov models for what no pattern names.

Patterns find assignments, access keys and long hex runs. Besides, every run of 20 or
more characters of an identifier alphabet is scored by Markov models of characters: its
log-likelihood under the best model of random strings (one for each alphabet) less that
under the best model of ordinary ones, per character. Runs above the threshold are
spans of kind `random`. What patterns' spans leave of a run on either side is judged like
a run of its own, if it has 20 characters.

Ordinary are identifiers and words, and what repeats or counts: each character is the
one 1 to 4 places before it, or follows the last one in the alphabet, but for a share of SLIPS. So are UUIDs, which name things. Long
numbers that do neither count as random, like keys of letters alone.
The other models are trained from labelled samples: random strings drawn from a seeded
generator, and identifiers and words composed by rule from the lists below.

A null or empty text has no spans. Very long texts are scanned whole. Rows are judged
alone, so ties and repeated rows don't matter; an empty table gives no rows. Redaction
returns the input's columns; scan() returns the id under its own name and the result columns.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import table
from .textvec import slices, tidy

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
KINDS = ("assign", "access", "hex", "random")
#: Log-likelihood ratio per character above which a run counts as random.
THRESHOLD = 0.35
LEAST, PERIODS, SLIPS = 20, 4, 0.1

WORDS = (
    "the of and to in is that for was with his they have from are this not but had she which you one were all their there been many "
    "some time very when about into could them other than then now only its over new made after also did first most people can may "
    "such where much through back years way well down should because each just those how too little state good make world still own "
    "see men work long get here between both life being under never day same another know while last might us great old year off come "
    "since against go came right used take three get set value index count size name type list map key item node user file path data "
    "config server client request response handler manager service controller factory buffer string number result error message event "
    "der die das und ein eine nicht mit sich auf werden haben sein auch nach bei einer oder les des est pas pour dans qui que une sur "
    "avec par plus los las una por con para como pero sus más este entre cuando todo desde nos durante estados"
).split()
ENDINGS = (
    "tion ation ition ction ization sion ment able ible ness less ful ship ance ence ity ism ist ing ings ally ously ology graphy keit heit lich ung schaft isch igkeit "
    "lichkeit ement eaux eur euse elle ette aire ique mente miento idad cion ador encia ando iendo"
).split()
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "abcdefghijklmnopqrstuvwxyz0123456789")
SYMBOLS = ALPHABETS[4]


def samples(n: int = 1500, seed: int = 8) -> list[tuple[str, int]]:
    """Labelled strings: (text, 0) for ordinary identifiers, (text, 1 + alphabet) for random ones."""
    r = random.Random(seed)
    plain = [w for w in WORDS if w.isascii()]
    out: list[tuple[str, int]] = []
    for _ in range(n * 3):
        parts = [r.choice(plain) for _ in range(r.randint(3, 7))]
        style = r.randrange(6)
        if style == 0:
            text = "_".join(parts)
        elif style == 1:
            text = "-".join(parts)
        elif style == 2:
            text = "".join(p.capitalize() for p in parts)
        elif style == 3:
            text = "/".join(parts)
        elif style == 4:
            text = "".join(parts)
        else:
            text = "_".join(parts).upper()
        if r.random() < 0.25:
            text += r.choice(["_", "-", ""]) + str(r.choice([1, 2, 3, 10, 64, 256, 2020, 2024]))
        out.append((text, 0))
    dress = (str, str, str.capitalize, str.capitalize, str.upper)
    for _ in range(n * 2):  # paths and names whose parts look unlike each other
        sign = r.choice(["/", "/", "_", "-", ""])
        parts = [r.choice(dress)(r.choice(plain)) for _ in range(r.randint(3, 7))]
        if r.random() < 0.5:
            parts[r.randrange(len(parts))] += r.choice(["", "-", "_"]) + str(r.choice([*range(10), 10, 11, 14, 16, 32, 64, 86, 128, 256, 2024]))
        if r.random() < 0.2:
            parts.append("__" + r.choice(plain) + "__")
        out.append((r.choice(["", "", sign]) + sign.join(parts), 0))
    for a, letters in enumerate(ALPHABETS):
        out += [("".join(r.choice(letters) for _ in range(r.randint(20, 44))), 1 + a) for _ in range(n)]
    for _ in range(n):
        text = "".join(r.choice(plain) + r.choice(ENDINGS) for _ in range(r.randint(3, 5)))
        out.append((text.upper() if r.random() < 0.1 else text, 0))
    return out


def fit(labelled: list[tuple[str, int]], smooth: float = 0.5) -> np.ndarray:
    """Log-probabilities of a character after another, one first-order table for each label."""
    place = {c: i for i, c in enumerate(SYMBOLS)}
    counts = np.full((1 + max(label for _, label in labelled), len(SYMBOLS), len(SYMBOLS)), smooth)
    for text, label in labelled:
        at = [place[c] for c in text if c in place]
        np.add.at(counts[label], (at[:-1], at[1:]), 1)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


@lru_cache(maxsize=1)
def _model() -> tuple[np.ndarray, np.ndarray]:
    place = np.full(128, 0)
    place[[ord(c) for c in SYMBOLS]] = range(len(SYMBOLS))
    return fit(samples()), place


def _regular(at: np.ndarray) -> float:
    """Log-likelihood of all symbols but the first, if they repeat or count."""
    hits = max(int((at[1:] == at[:-1] + 1).sum()), *(int((at[p:] == at[:-p]).sum()) for p in range(1, PERIODS + 1)))
    slip = SLIPS / len(SYMBOLS)
    return hits * np.log(1 - SLIPS + slip) + (len(at) - 1 - hits) * np.log(slip)


def _formed(run: str) -> float:
    """Log-likelihood as a UUID: a form in which 32 digits are free."""
    return -32 * np.log(16) if UUID.fullmatch(run) else -np.inf


def ratio(run: str) -> float:
    """Log-likelihood ratio per character, random against ordinary."""
    tables, place = _model()
    at = place[np.frombuffer(run.encode(), np.uint8)]
    likely = tables[:, at[:-1], at[1:]].sum(axis=1)
    return float((likely[1:].max() - max(likely[0], _regular(at), _formed(run))) / (len(run) - 1))


def spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all secrets, by start, then kind as in KINDS; code points, end exclusive."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base, passed = sorted(found), 0
    for m in RUN.finditer(text):
        s, e = m.span()
        while passed < len(base) and base[passed][2] <= s:
            passed += 1
        at = passed
        while s < e:
            b, _, f = base[at] if at < len(base) else (e, 3, e)
            b, at = min(b, e), at + 1
            if b - s >= LEAST and ratio(text[s:b]) > THRESHOLD:
                found.append((s, 3, b))
            s = max(s, f)
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """text with every secret, overlapping ones as one, replaced by mark."""
    out, at, open_to = [], 0, -1
    for s, _, e in spans(text):
        if s >= open_to:
            out += [text[at:s], mark] if open_to < 0 else [text[open_to:s], mark]
            at = s
        open_to = max(open_to, e)
    return text if open_to < 0 else "".join(out) + text[open_to:]


_RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def _listed(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and list of spans of every text."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = []
                for body in part.column("_text").to_pylist():
                    found = spans(body) if body else []
                    base = [x for x in found if x[1] != "random"]
                    n = [sum(x[1] == k for x in found) for k in KINDS]
                    rows.append((*n[:3], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found), n[3]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                names = ["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    return docs.select(docs[id].alias("_id"), docs[text].alias("_text")).mapInArrow(run, f"_id {kind}, {_RESULT}").withColumnRenamed("_id", id)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with secrets in text replaced, and the column length, if there is one, set anew where that changed the text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                old = part.column(text).to_pylist()
                new = [redacted(x) if x else x for x in old]
                columns = {c: part.column(c) for c in names}
                columns[text] = pa.array(new, part.schema.field(text).type)
                if length in columns:
                    kind = part.schema.field(length).type
                    columns[length] = pa.array([len(b) if a != b else n for a, b, n in zip(old, new, columns[length].to_pylist(), strict=True)], kind)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(tidy(run), docs.schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
