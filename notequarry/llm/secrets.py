"""Secret scans: a keyword automaton, anchored expressions near its hits, then checks of embedded checksums.

One Aho-Corasick pass over the text (A-Z lower-cased) finds the keywords of all kinds. Only there are the kinds'
expressions tried, anchored at the hit, from left to right and without overlap, which gives what a search of the whole
text would. Runs of hexadecimal digits have no keyword; a search for 32 or more of them is their own prefilter. Kinds
with a checksum inside (GitHub and npm tokens: CRC-32 in base 62; JSON web tokens: a header that decodes to JSON with an
algorithm) count only if it holds; PEM private keys need their closing line.

Defined cases: a null text is empty and has no spans; repeated rows and null doc_ids each get their row; places are
counted in code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the 30 before them, in base 62."""
    body, check = m[2][:-6], m[2][-6:]
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == check


def token_header(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


@dataclass(frozen=True)
class Kind:
    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    passes: Callable[[re.Match], bool] = lambda m: True


#: In the order in which spans with the same start are listed.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    Kind("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    Kind("hex", (), re.compile(r"[0-9a-f]{32,}")),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(gh[pousr]_)([A-Za-z0-9]{36})(?![A-Za-z0-9])"), base62_crc32),
    Kind("npm", ("npm_",), re.compile(r"(npm_)([A-Za-z0-9]{36})(?![A-Za-z0-9])"), base62_crc32),
    Kind("jwt", ("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"), token_header),
    Kind("pem", ("-----begin ",), re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----")),
)


def automaton(kinds: tuple[Kind, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, kind in enumerate(kinds):
        for word in kind.keywords:
            found.add_word(word, (i, len(word)))
    found.make_automaton()
    return found


def scan(text: str, kinds: tuple[Kind, ...] = KINDS, found: ahocorasick.Automaton | None = None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every span, in that order."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    spans, past = [], [0] * len(kinds)
    hits = sorted((end - n + 1, i) for end, (i, n) in (found or automaton(kinds)).iter(lower))
    for start, i in hits:
        if start >= past[i] and (m := kinds[i].pattern.match(text, start)):
            past[i] = m.end()
            if kinds[i].passes(m):
                spans.append((start, i, m.end()))
    for i, kind in enumerate(kinds):
        if not kind.keywords:
            spans += ((m.start(), i, m.end()) for m in kind.pattern.finditer(text) if kind.passes(m))
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]], kinds: tuple[Kind, ...] = KINDS) -> str:
    return ",".join(f"{kinds[i].name}:{a}:{b}" for a, i, b in spans)


def with_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and spans: an array of (kind, start, end, value) for every document."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(kinds)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for b in batches:
            rows = [[{"kind": kinds[i].name, "start": s, "end": e, "value": t[s:e]} for s, i, e in scan(t, kinds, found)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: counts of the base kinds, a digest of their spans, and all spans."""
    rows = with_spans(table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS[:3]]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("spans", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in base]  # noqa: B023  called at once
    return rows.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
