"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Base kinds (assign, access, hex) are regular patterns. The method adds kind `random`: a string that a tiktoken
vocabulary encodes at few characters a token, because no learned piece fits it, unless it is a known digest, a UUID,
or an identifier made of words and short numbers. Where a whole run of such characters isn't random, or overlaps a base
span, its odd parts between separators are judged by themselves, so that a path or name doesn't hide a key behind it (a
key joined to words without a separator is judged with them). Letters only are judged from 20 in a row; fewer between
separators count as a word. Base spans always stay; a random span that overlaps one is dropped.

Edge cases: a null or empty text has no spans; repeated rows are scanned one by one; an empty table gives no rows;
columns beyond doc_id and text are passed through by `redact` and ignored by `scan`. Spans are in code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import tiktoken_encoding, vocabulary_path

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}[-_/]?)+")
DIGEST = re.compile(r"(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-_=/]?)?(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
INTEGRITY = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}")
#: One part of an identifier: a word in one case or capitalised, or a short number.
PART = re.compile(r"[a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]{1,8}")
SPLIT = re.compile(r"[-_/+=]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Parts of a run between separators; a UUID or an integrity value is one part.
RUN_PART = re.compile(r"(?P<known>[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])|sha(?:256-[A-Za-z0-9+/]{43,44}|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86})={0,2}(?![0-9A-Za-z+]))|[0-9A-Za-z]+")
#: Random base-62 text has about 1.7 characters a token, prose above 2.5.
CHARS_PER_TOKEN = 2.2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end). HEX and ACCESS start at the first place of a run, so they match as the plain patterns with a length test."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_known(s: str, encoding, limit: float) -> bool:
    """Digests, UUIDs and identifiers made of words: stretches of letters between digits are words if the vocabulary has long pieces for them."""
    digest = DIGEST.fullmatch(s)
    if UUID.fullmatch(s) or INTEGRITY.fullmatch(s) or digest and any(len(s) == n or s[:-n].strip("-_=/").lower().startswith(("md5", "sha")) for n in DIGEST_LENGTHS if len(s) >= n):
        return True
    parts = [p for p in SPLIT.split(s) if p]
    words = [p for p in parts if p.isalpha() and len(p) >= 3]
    letters = sum(map(len, words))
    return all(PART.fullmatch(p) for p in parts) and letters * 4 >= len(s) * 3 and letters >= limit * sum(len(encoding.encode_ordinary(p)) for p in words)


def is_random(s: str, encoding, limit: float) -> bool:
    """Letters of one case, or with few capitals, look like a word, so only the vocabulary tells them apart; other strings need digits or capitals among their letters."""
    letters = s.isalpha() and (s.isupper() or sum(c.isupper() for c in s) < 4)
    mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s) or any(c.islower() for c in s) and sum(c.isupper() for c in s) >= 4
    return len(s) >= 20 and (letters or mixed and not is_known(s, encoding, limit)) and len(s) < limit * len(encoding.encode_ordinary(s))


def odd_stretches(run: str, encoding, limit: float) -> Iterator[list[tuple[int, int]]]:
    """Parts in a row that are neither words, short numbers nor known and have few characters a token. Other parts of up to three characters may stand between them, as in base-64 text."""
    stretch = []
    for m in RUN_PART.finditer(run):
        part = m[0]
        plain = m["known"] or (PART.fullmatch(part) or is_known(part, encoding, limit)) and not is_random(part, encoding, limit)
        if not plain and len(part) < limit * len(encoding.encode_ordinary(part)):
            stretch.append(m.span())
        elif len(part) > 3 and stretch:
            yield stretch
            stretch = []
    if stretch:
        yield stretch


def random_spans(text: str, encoding, limit: float, base=()) -> Iterator[tuple[int, int, int]]:
    """Random runs that overlap no base span, and the random parts of other runs."""

    def free(a: int, b: int) -> bool:
        return not any(x < b and a < y for x, _, y in base)

    for m in CANDIDATE.finditer(text):
        if free(*m.span()) and is_random(m[0].strip("-_=/+"), encoding, limit):
            yield m.start(), 3, m.end()
            continue
        for stretch in odd_stretches(m[0], encoding, limit):
            for places in ([(stretch[0][0], stretch[-1][1])], stretch):
                found = [(m.start() + a, 3, m.start() + b) for a, b in places if free(m.start() + a, m.start() + b) and is_random(m[0][a:b], encoding, limit)]
                yield from found
                if found:
                    break


def all_spans(text: str, encoding, limit: float = CHARS_PER_TOKEN) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + list(random_spans(text, encoding, limit, base)))


def told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary: str | None = None, limit: float = CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")

    def batches(it):
        import pyarrow as pa

        common.lean()
        encoding = tiktoken_encoding(path)
        for batch in common.sliced(it):
            rows = [all_spans(t or "", encoding, limit) for t in batch.column(1).to_pylist()]
            counts = [[sum(s[1] == k for s in spans) for _, spans in rows] for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(told(b).encode()).hexdigest() for b, _ in rows], pa.string()), pa.array([told(s) for _, s in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(text: str, spans, mark: str = "[secret]") -> str:
    """Each stretch that spans cover becomes one mark."""
    out, at, i = [], 0, 0
    while i < len(spans):
        a, _, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] <= b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], mark]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocabulary: str | None = None, limit: float = CHARS_PER_TOKEN) -> DataFrame:
    """docs with every secret replaced by a mark; other columns and rows stay (n_chars is recounted where there is one)."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")

    schema = docs.schema

    def clean(it):
        import pyarrow as pa

        common.lean()
        encoding, at = tiktoken_encoding(path), schema.names.index("text")
        for batch in common.sliced(it):
            texts = [None if t is None else redacted(t, all_spans(t, encoding, limit)[1]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)

    out = docs.mapInArrow(clean, schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark, sf_dir):
    return scan(common.table(spark, sf_dir, "documents"))
