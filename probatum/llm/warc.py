"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A response row holds its record id, target URI, date, content type, HTTP header block and payload. Each gives
two records: `metadata`, a JSON document of the HTTP headers, title, language and links, and `conversion`,
the page's plain text. Both carry WARC-Refers-To (the response's record id) with the source's target URI and
date, the source's header block, and their own block digest; the response's payload digest travels as source_digest.
Record ids are version-5 UUIDs, of a response's page id, URL and payload, and of the response's id and a record's type,
so a task that runs again writes the same and pages of unlike content never share one.

serialize() frames records as WARC/1.0 and parse() reads them back. Pages are read in time linear in their length.

Defined cases: a null page has an empty payload and still gives both records; a null URL is an empty target
URI; repeated rows give their records each, under the same ids; an empty table gives an empty result; further columns aren't
read; broken markup is read as far as it goes (see dropped()).
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices

SPACE = uuid.UUID("5d2b1c9e-6f0a-5c3e-9a77-0c6f3a1e2b44")
DATE = "2024-01-01T00:00:00Z"
RESPONSE = ("record_id", "target_uri", "date", "content_type", "headers", "payload")

_MARK = re.compile(r"<!--|<(/?)(script|style|title|noscript|template|nav|svg)(?=[\s/>])[^>]*>", re.I)
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
#: Elements whose content is text, up to their closing tag.
_RAW_END = {k: re.compile(rf"</{k}(?=[\s/>])[^>]*>", re.I) for k in ("script", "style", "title")}
_RAW_NEXT = {k: re.compile(rf"<(/?){k}(?=[\s/>])[^>]*>", re.I) for k in ("script", "style", "title")}
_BLOCK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|blockquote|pre|main|aside|form|dl|dt|dd|figure)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_OPEN = {k: re.compile(rf"<{k}(?=[\s/>])[^>]*>", re.I) for k in ("title", "html", "a")}
_TITLE_END = re.compile(r"</title\s*>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANK = re.compile(r"[ \t\r\f\v]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(parts))}>"


def dropped(page: str) -> list[tuple[int, int]]:
    """Disjoint spans of comments, scripts, styles, titles, navigation, images and templates, in order.

    A comment, script or style without an end runs to the end of the page. Of other elements only those with
    a closing tag go: an unclosed one leaves what follows in. A self-closed tag is empty, but a script, style or
    title that meets its closing tag before another of its kind opens. A head has no text but such elements'.
    """
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    inside: dict[str, int] = {}
    at, titles, last = 0, True, page.rfind(">") + 1  # beyond the last one no tag is complete, and none is looked for
    while m := _MARK.search(page, at, last):
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            end = _COMMENT_END.search(page, at)
            at = end.end() if end else len(page)
            spans.append((m.start(), at))
        elif name in _RAW_END:
            if m[1] or (name == "title" and not titles):
                continue
            if m[0].endswith("/>"):
                end = _RAW_NEXT[name].search(page, at)
                if not end or not end[1]:
                    continue
            else:
                end = _RAW_END[name].search(page, at)
            if not end and name == "title":
                titles = False
                continue
            at = end.end() if end else len(page)
            spans.append((m.start(), at))
        elif not m[1]:
            if not m[0].endswith("/>"):
                stack.append((name, m.start()))
                inside[name] = inside.get(name, 0) + 1
        elif inside.get(name):
            top = ""
            while top != name:
                top, start = stack.pop()
                inside[top] -= 1
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, at))
    open_ = page.find("<!--", max(at, last))
    return [*spans, (open_, len(page))] if open_ >= 0 else spans


def plain_text(page: str) -> str:
    """Text outside titles, scripts, styles, navigation and comments; block elements end lines."""
    parts, at = [], 0
    for a, b in dropped(page):
        parts.append(page[at:a])
        at = b
    joined = " ".join([*parts, page[at:]])
    last = joined.rfind(">") + 1
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", joined[:last])) + joined[last:])
    lines = (_BLANK.sub(" ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def page_facts(page: str) -> dict:
    """Title, language and distinct links in order. Tags are found first and attributes within them, so that no text is read twice."""
    last = page.rfind(">") + 1
    tags = lambda k: (m[0] for m in _OPEN[k].finditer(page, 0, last))
    title = _OPEN["title"].search(page, 0, last)
    end = title and _TITLE_END.search(page, title.end())
    lang = next(filter(None, map(_LANG.search, tags("html"))), None)
    hrefs = (m.groups() for m in filter(None, map(_LINK.search, tags("a"))))
    links = list(dict.fromkeys(html.unescape(next(x for x in found if x is not None)) for found in hrefs))
    return {"title": _BLANK.sub(" ", html.unescape(page[title.end() : end.start()])).strip() if end else None, "lang": lang[1] if lang else None, "links": links}


def header_fields(block: str) -> dict:
    """The fields of an HTTP header block in order, repeated names joined."""
    out: dict[str, str] = {}
    for line in block.split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip()] = f"{out[name.strip()]}, {value.strip()}" if name.strip() in out else value.strip()
    return out


def responses(pages: DataFrame) -> DataFrame:
    """Response rows of a table (page_id, url, html)."""
    page = F.coalesce(F.col("html"), F.lit(""))
    uri = F.coalesce(F.col("url"), F.lit(""))
    name = F.concat_ws("\n", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri, F.sha2(page, 256))
    hashed = F.sha1(F.concat(F.unhex(F.lit(SPACE.hex)), name.cast("binary")))
    variant = F.translate(F.substring(hashed, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda a, n: F.substring(hashed, a, n)
    urn = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", urn.alias("record_id"), uri.alias("target_uri"), F.lit(DATE).alias("date"), F.lit("application/http; msgtype=response").alias("content_type"), headers.alias("headers"), page.alias("payload"))


_CONTROL = re.compile(r"[\x00-\x1f\x7f\x85\u2028\u2029]")
DERIVED = ("page_id", "record_type", "record_id", "refers_to", "refers_to_target_uri", "refers_to_date", "source_headers", "target_uri", "date", "content_type", "content_length", "block_digest", "source_digest", "block")


def derive(rows: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata and its conversion record."""
    kind = dict(rows.dtypes)["page_id"]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "payload", 4 << 20):
                out: list[tuple] = []
                for r in batch.to_pylist():
                    payload = r["payload"] or ""
                    source = digest(payload.encode())
                    facts = {"source": r["record_id"], "uri": r["target_uri"], "payload_digest": source, "http": header_fields(r["headers"] or ""), **page_facts(payload)}
                    for what, mime, text in (("metadata", "application/json", json.dumps(facts, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", plain_text(payload))):
                        block = text.encode()
                        out.append((r["page_id"], what, record_id(what, r["record_id"]), r["record_id"], r["target_uri"], r["date"], r["headers"], r["target_uri"], r["date"], mime, len(block), digest(block), source, text))
                cols = list(zip(*out, strict=True)) if out else [[]] * len(DERIVED)
                types = [batch.schema.field("page_id").type, *[pa.string()] * 9, pa.int64(), *[pa.string()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], list(DERIVED))

    text = ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in DERIVED[1:])
    return rows.select("page_id", *RESPONSE).mapInArrow(run, f"page_id {kind}, {text}")


def _field(value: str, escape: bool) -> str:
    """A header's value, which can't hold a line break: in addresses and headers control characters are percent-encoded, elsewhere they are an error."""
    if escape:
        return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)
    if _CONTROL.search(value):
        raise ValueError(f"a control character in a header: {value!r}")
    return value


#: Fields that come from outside. A line of a source's headers is told from the next by the escaped line break.
ESCAPED = ("WARC-Target-URI", "WARC-Refers-To-Target-URI", "WARC-Source-HTTP-Headers")


def serialize(record: dict) -> bytes:
    """One WARC/1.0 record: named fields, then the block. Source headers travel in a field of their own."""
    block = record["block"].encode()
    fields = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", record.get("refers_to")), ("WARC-Refers-To-Target-URI", record.get("refers_to_target_uri")), ("WARC-Refers-To-Date", record.get("refers_to_date")), ("WARC-Target-URI", record["target_uri"]), ("WARC-Date", record["date"]), ("WARC-Block-Digest", record["block_digest"]), ("WARC-Source-Payload-Digest", record.get("source_digest")), ("WARC-Source-HTTP-Headers", record.get("source_headers")), ("Content-Type", record["content_type"]), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {_field(v, k in ESCAPED)}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes):
    """(fields, block) of each record of an uncompressed file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def write_warc(derived: DataFrame, path: str) -> None:
    """Records as rows of one binary column, framed and compressed one by one, in Parquet part files."""
    import gzip

    names = list(DERIVED)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(serialize(r), mtime=0) for r in batch.select(names).to_pylist()], pa.binary())], ["record"])

    derived.mapInArrow(run, "record binary").write.parquet(path)
