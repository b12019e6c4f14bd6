"""Secret scan with multipart credential linking.

Base spans are certain enough alone: ``assign`` (a secret's name, then = or :, then a value),
``access`` (access key identifiers) and ``hex`` (long hexadecimal runs). Weak candidates are
parts of a credential that mean little alone: ``id`` (account and key identifiers), ``weak``
(tokens of letters and digits) and ``endpoint`` (addresses of services). They are reported only
where complementary parts co-occur: an identifier with a secret, a secret with an identifier,
an endpoint with both. Base spans count as parts too (access as identifier; assign and hex as
secret).

Parts are linked by an interval join: equal document, common or neighbouring bins of ``SCOPE`` code
points, a gap of at most ``SCOPE`` between the end of one and the start of the other. Parts that overlap
are not linked: an identifier's value or the path of an address is no secret that lies beside it. A part is in all bins from its start to its end. The joins are semi joins, so a document with very many
parts gives no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.fitting import bounded_batches
from fleetwatch.session import materialise

SCOPE = 300
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "id", "weak", "endpoint")
_PART = {"assign": "secret", "hex": "secret", "weak": "secret", "access": "id", "id": "id", "endpoint": "endpoint"}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ID = re.compile(r"""(?:(?:access|client|account|tenant)[_-]?(?:key|id)|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
WEAK = re.compile(r"[A-Za-z0-9+/_-]{16,}")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]*://[^\s\"'<>]{4,}", re.A)

_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])
_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Parts outside base spans; none where the document has no identifier, as nothing could be linked."""
    ids = [("id", *m.span(1)) for m in ID.finditer(text)]
    if not ids and not any(kind == "access" for kind, _, _ in base):
        return []
    weak = [("weak", *m.span()) for m in WEAK.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    ends = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    named = _outside(ids + ends, base)
    return named + _outside(weak, base + named)  # a name or an address is no secret of its own


def _outside(spans: list[tuple[str, int, int]], others: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of the others."""
    taken = sorted((a, b) for _, a, b in others)
    found, at = [], 0
    for span in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        while at < len(taken) and taken[at][1] <= span[1]:
            at += 1
        if at == len(taken) or taken[at][0] >= span[2]:
            found.append(span)
    return found


def _rows(spans: list[tuple[str, int, int]]) -> list[dict]:
    made = [{"start": a, "rank": KINDS.index(k), "kind": k, "end": b} for k, a, b in spans]
    return sorted(made, key=lambda s: (s["start"], s["rank"]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base = [base_spans(t) for t in batch["text"].to_pylist()]
        weak = [weak_spans(t, b) for t, b in zip(batch["text"].to_pylist(), base)]
        columns = [pa.array(map(_rows, spans), pa.list_(_SPAN)) for spans in (base, weak)]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["doc_id"], *columns], ["key", "doc_id", "base", "weak"])


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Columns doc_id, base and spans (base ones and linked weak ones), each array by start, then kind.

    One row for each row of ``docs``; starts and ends are code points, ends exclusive. A null or
    empty text has no spans. Repeated rows get the same spans each, and rows without id their
    own. Other columns are ignored. Runs a job when called: the scan is written once.
    """
    bounded_batches(docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    scanned = materialise(keyed.mapInArrow(_scan, f"key bigint, doc_id bigint, base {_SPANS}, weak {_SPANS}")).df

    parts = scanned.filter(F.size("weak") > 0).select("key", F.explode(F.concat("base", "weak")).alias("s")).select("key", "s").distinct()
    part = F.element_at(F.create_map(*[F.lit(x) for pair in _PART.items() for x in pair]), F.col("s.kind"))
    parts = materialise(parts.select("key", "s", part.alias("part"))).df
    low, high = (F.floor(F.col(f"s.{c}") / scope) for c in ("start", "end"))
    weak = parts.filter(~F.col("s.kind").isin(*BASE))

    def near(candidates: DataFrame, wanted: str) -> DataFrame:
        others = parts.filter(F.col("part") == wanted).select("key", "s", F.explode(F.sequence(low - 1, high + 1)).alias("bin"))
        mine = candidates.withColumn("bin", F.explode(F.sequence(low, high))).alias("c")
        close = (F.greatest("c.s.start", "o.s.start") - F.least("c.s.end", "o.s.end")).between(0, scope)
        met = mine.join(others.alias("o"), (F.col("c.key") == F.col("o.key")) & (F.col("c.bin") == F.col("o.bin")) & close, "left_semi")
        return met.select("key", "s").distinct()

    linked = near(weak.filter("part = 'id'"), "secret").unionByName(near(weak.filter("part = 'secret'"), "id"))
    linked = linked.unionByName(near(near(weak.filter("part = 'endpoint'"), "id"), "secret"))
    added = linked.groupBy("key").agg(F.collect_list("s").alias("added"))  # a document's own spans
    both = scanned.join(added, "key", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS))))
    return both.select("doc_id", "base", spans.alias("spans"))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secret_scan(spark, folder: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{folder}/documents.parquet"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
