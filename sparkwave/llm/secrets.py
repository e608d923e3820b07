"""Secret scans with multipart credential linking.

Base spans follow three fixed patterns.  The method adds weak candidates - unlabelled key-like strings, account
names and endpoints - only where complementary parts stand in one scope: their intervals, widened by SCOPE code
points, are joined inside each text by binary search over sorted interval ends.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, as agreed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # greedy runs: the same spans as AKIA[A-Z0-9]+ of 20 and more
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*KINDS, "key", "account", "endpoint"))}

# Weak parts: reported only beside complementary ones.
KEY_LIKE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
ACCOUNT = re.compile(r"""\b(?:user|username|login|account|client_id)["']?\x20{0,4}[:=]\x20{0,4}["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"\b(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]{4,}", re.ASCII)
SCOPE = 400


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def _near(spans: list[tuple[int, int]], others: list[tuple[int, int]], scope: int) -> list[bool]:
    """Which spans have one of the others within `scope` code points; interval join over sorted ends."""
    if not spans or not others:
        return [False] * len(spans)
    start = np.sort([s for s, _ in others])
    end = np.sort([e for _, e in others])
    low = np.array([s for s, _ in spans]) - scope
    high = np.array([e for _, e in spans]) + scope
    # intervals that begin before our end, less those that ended before our start
    return list(np.searchsorted(start, high, side="right") > np.searchsorted(end, low, side="left"))


def linked_spans(text: str, base: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """Weak candidates: a key-like string beside an access identifier or account; an account beside a secret; an
    endpoint beside an identifier (access or account) and a secret (assigned, hex or accepted key-like)."""
    taken = [(s, e) for s, e, _ in base]
    access = [(s, e) for s, e, k in base if k == "access"]
    secret = [(s, e) for s, e, k in base if k != "access"]
    account = [m.span() for m in ACCOUNT.finditer(text)] if "=" in text or ":" in text else []
    key = [m.span() for m in KEY_LIKE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])] if access or account else []
    inside = _near(key, taken, 0)
    key = [k for k, used in zip(key, inside, strict=True) if not used]
    identifier = access + account
    key = [k for k, ok in zip(key, _near(key, identifier, scope), strict=True) if ok]
    secret = secret + key
    account = [a for a, ok in zip(account, _near(account, secret, scope), strict=True) if ok]
    endpoint = [m.span() for m in ENDPOINT.finditer(text)] if secret and "://" in text else []
    both = zip(endpoint, _near(endpoint, access + account, scope), _near(endpoint, secret, scope), strict=True)
    endpoint = [p for p, a, b in both if a and b]
    return sorted([(s, e, "key") for s, e in key] + [(s, e, "account") for s, e in account] + [(s, e, "endpoint") for s, e in endpoint])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long, linked string"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, linked: one row per input row.

    Whole texts are read; null counts as empty.  Texts without a secret have counts of 0, the digest of an empty
    string and empty lists.  Repeated rows are kept, and a null doc_id stays null; extra columns are ignored.  `spans`
    has base and linked spans by start, then base kinds, then linked kinds; offsets are code points, ends exclusive.
    """

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            more = linked_spans(text, base)
            every = sorted(base + more, key=lambda x: (x[0], ORDER[x[2]], x[1]))
            rows.append((*(sum(k == kind for _, _, k in base) for kind in KINDS),
                         hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(more), _joined(more)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked", "linked"])

    return docs.select("doc_id", find("text").alias("found")).select("doc_id", "found.*")
