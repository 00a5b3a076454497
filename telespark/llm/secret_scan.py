"""Secret scan: pattern spans, and strings that a primed compressor cannot predict."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates of the novelty test: unbroken strings with a digit, near a word that speaks of secrets.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}")
_SENSITIVE = re.compile(r"(?i:passw|secret|token|api_?key|access_?key|private_?key|credential|auth|bearer|signature)", re.ASCII)
#: Characters before a candidate that may hold the sensitive word, and on each side as surrounding text.
NEAR, AROUND = 48, 1024
#: Marginal compressed bytes for each character from which on a string counts as novel.
NOVELTY = 0.6
#: Identifiers that primes the compressor, so that ordinary names cost little.
IDENTIFIERS = """
abstract argument array assert async await base64 boolean break buffer byte callback case catch char class client
close config configuration connection connect const constructor content context continue controller cookie count
create current database datetime debug decode default delete describe dictionary directory document double download
element encode encoding endpoint environment error event exception execute export extends false file filename final
finally float folder for format function generate getAttribute getElementById getInstance global handler header host
http https identifier implements import include index init initialize input insert instance integer interface
iterator javascript json key keyword lambda length library list listener local localhost logger logging long lower
manager message metadata method module monitor namespace network newline null number object offset option output
override package parameter parse password path pattern payload platform pointer port prefix print private process
processor profile properties protected protocol provider public python query queue random read record redirect
reference register release remove replace request require resource response result return return_value router schema
scheduler script secret select self sequence server service session setAttribute setUp settings setup shell signature
size sort source spark split sql stack start state static status stream string struct style subscribe suffix switch
synchronized system table target task template test text thread throw timeout timestamp token toString transaction
true type undefined unit unsigned update upload upper url user username utf-8 uuid validate value values variable
version view void volatile while window worker write xml yaml 0123456789 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 2020-01-01T00:00:00Z 127.0.0.1 0000000000000000
"""
_PARAMETERS = zstandard.ZstdCompressionParameters.from_level(
    19, window_log=14, hash_log=14, chain_log=14, write_checksum=False, write_content_size=False, write_dict_id=False)


class Novelty:
    """Marginal compressed size of a string, given its surroundings and the identifiers."""

    def __init__(self, identifiers: str):
        self.identifiers = identifiers.encode()

    def __call__(self, text: str, start: int, end: int) -> float:
        """Bytes that ``text[start:end]`` adds for each of its characters."""
        around = text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]
        prime = zstandard.ZstdCompressionDict(self.identifiers + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdCompressor(dict_data=prime, compression_params=_PARAMETERS)
        lead = text[max(0, start - 16) : start].encode()
        return (len(press.compress(lead + text[start:end].encode())) - len(press.compress(lead))) / (end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans, sorted."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def novel_spans(text: str, known: list[tuple[int, int, int]], novelty: Novelty, least: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the incompressible strings in sensitive context that no known span covers."""
    spans = []
    if not _SENSITIVE.search(text):
        return spans
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        if _SENSITIVE.search(text, max(0, start - NEAR), end) and not any(a <= start and end <= b for a, _, b in known) and novelty(text, start, end) >= least:
            spans.append((start, 3, end))
    return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, novelty: float = NOVELTY, identifiers: str = IDENTIFIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) for every row of docs.

    The counts and ``base_sha256`` are of the pattern spans; ``spans`` has the
    novel strings too.  Spans are ``kind:start:end`` in code points, sorted by
    start, then kind.  Rows are independent of each other: repeated rows and
    ids give repeated results.  Null and empty texts have no spans.  Texts are
    scanned whole, each in one task.  An empty table gives an empty result;
    other columns are not read.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"

    def run(batches):
        measure = Novelty(identifiers)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                novel = novel_spans(text, base, measure, novelty)
                count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*count, len(novel), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + novel)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], schema=pa.schema(
                [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex", "n_novel")), ("base_sha256", pa.string()), ("spans", pa.string())]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("string").alias("text")).mapInArrow(run, schema)
