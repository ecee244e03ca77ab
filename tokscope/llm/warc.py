"""WARC derivative builder: metadata and plain-text conversion records of response records (operator 10).

Every response yields two records that refer to it: ``metadata`` (title, language, outlinks, sizes, and the
response's own headers) and ``conversion`` (the plain text of its HTML).  Both keep the response's identifier in
WARC-Refers-To, its target, date and payload digest, and carry a digest of their own block.

Identifiers are derived from content, so a retried task writes the same records.  ``to_warc`` turns records into
WARC/1.1 text; ``write_warc`` writes files of them.

Defined results: a null or empty payload gives a metadata record with no links and an empty conversion; a null
target stays null (and has no header line); repeated responses give repeated records with equal identifiers; an empty
table gives no records; unclosed tags, quotes and comments never cost more than the text's length; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, table

#: Pages carry no time of capture.
NO_DATE = "1970-01-01T00:00:00Z"
#: Elements that are not shown, and elements that begin a new line.
_UNSHOWN = re.compile(r"<!--|<(script|style|noscript|template|head)\b", re.I)
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b",
    re.I,
)
_START = re.compile(r"</?[a-zA-Z!?]")
_MARK = re.compile("[>\"']")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*", re.I), re.compile(r"</title\s*>", re.I)
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"""\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
_LINK = re.compile(r"<a\b", re.I)
_HREF, _VALUE = re.compile(r"\bhref\s*=\s*", re.I), re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")

# Every search below goes forward with one cursor, so that its time grows with the text, however it is marked up.


def shown(source: str) -> str:
    """The text without comments and unshown elements, a blank for each; one without an end hides all that follows."""
    out, at = [], 0
    while (m := _UNSHOWN.search(source, at)) is not None:
        if m[1] is None:
            body, end = m.end(), source.find("-->", m.end())
            end = len(source) if end < 0 else end + 3
        else:
            body = source.find(">", m.end())
            if body < 0:  # no tag after this one is ever closed, but a comment may hide the rest
                comment = source.find("<!--", m.end())
                return "".join(out) + (source[at:] if comment < 0 else source[at:comment] + " ")
            close = re.compile(rf"</{m[1]}\s*>", re.I).search(source, body)
            end = len(source) if close is None else close.end()
        out += [source[at : m.start()], " "]
        at = end
    return "".join(out) + source[at:]


def _tag_ends(source: str):
    """(start) -> end of the tag there, past quoted values; -1 if a quote is left open or no end follows."""
    marks = [(m.start(), m[0]) for m in _MARK.finditer(source)]
    places = [at for at, _ in marks]
    # what a tag does from each mark on: from the last mark to the first
    ends, later = [-1] * (len(marks) + 1), {}
    for i in range(len(marks) - 1, -1, -1):
        at, mark = marks[i]
        if mark == ">":
            ends[i] = at
        else:
            ends[i] = ends[later[mark] + 1] if mark in later else -1
            later[mark] = i
    return lambda start: ends[bisect_left(places, start)]


def without_tags(source: str) -> str:
    """The text without its tags, a line end for each that begins a block and whose quotes are closed."""
    end_of, out, at = _tag_ends(source), [], 0
    while (m := _START.search(source, at)) is not None:
        end = whole = end_of(m.end())
        if whole < 0:
            end = source.find(">", m.end())
            if end < 0:
                break
        out.append(source[at : m.start()])
        if whole >= 0 and _BLOCK.match(source, m.start()):
            out.append("\n")
        at = end + 1
    return "".join(out) + source[at:]


def plain_text(source: str) -> str:
    """Visible text: one line per block, blanks within a line as one."""
    lines = (" ".join(x.split()) for x in html.unescape(without_tags(shown(source))).split("\n"))
    return "\n".join(x for x in lines if x)


def title_of(source: str) -> str | None:
    for m in _TITLE.finditer(source):
        if source[m.end() : m.end() + 1] == ">":
            end = _TITLE_END.search(source, m.end())  # if there is none here, there is none for a later title
            return None if end is None else " ".join(html.unescape(source[m.end() + 1 : end.start()]).split())
    return None


def lang_of(source: str) -> str | None:
    at = 0
    while (m := _HTML.search(source, at)) is not None:
        end = source.find(">", m.end())
        end = len(source) if end < 0 else end
        if (lang := _LANG.search(source, m.end(), end)) is not None:
            return lang[1].lower()
        at = end
    return None


def links_of(source: str) -> Iterator[str]:
    at = 0
    while (m := _LINK.search(source, at)) is not None:
        end = source.find(">", m.end())
        end = len(source) if end < 0 else end
        for key in _HREF.finditer(source, m.end(), end):
            if (value := _VALUE.match(source, key.end())) is not None:  # it may hold a '>'
                yield html.unescape(next(x for x in value.groups() if x is not None)).strip()
                end = value.end()
                break
        at = max(end, m.end())


def facts(source: str, target: str | None) -> dict:
    links = []
    for href in links_of(shown(source)):
        try:
            links.append(urljoin(target or "", href))
        except ValueError:  # not a URL
            links.append(href)
    return {"title": title_of(source), "lang": lang_of(source), "outlinks": list(dict.fromkeys(links))}


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x00", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record_id, target_uri, date, payload_digest, headers, payload: a response record of each page."""
    payload = F.coalesce("html", F.lit(""))
    digest = F.concat(F.lit("sha256:"), F.sha2(payload, 256))
    page = F.col("page_id").cast("long")
    return pages.select(
        page.alias("page_id"),
        _urn(F.lit("response"), F.coalesce(page.cast("string"), F.lit("")), F.coalesce("url", F.lit("")), digest).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(NO_DATE).alias("date"),
        digest.alias("payload_digest"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("headers"),
        payload.alias("payload"),
    )


RECORDS = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, "
    "payload_digest string, block_digest string, content_type string, content_length long, block string"
)


def derive(found: DataFrame) -> DataFrame:
    """The metadata and conversion records of each response (RECORDS)."""

    def urn(*parts: str) -> str:
        h = hashlib.md5("\x00".join(parts).encode()).hexdigest()
        return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                source = r["payload"] or ""
                text = plain_text(source)
                about = facts(source, r["target_uri"]) | {
                    "source_headers": r["headers"],
                    "payload_bytes": len(source.encode("utf-8", "surrogatepass")),
                    "text_chars": len(text),
                }
                for kind, content_type, block in (
                    ("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True)),
                    ("conversion", "text/plain; charset=utf-8", text),
                ):
                    raw = block.encode("utf-8", "surrogatepass")
                    out.append(
                        (
                            r["page_id"], kind, urn(kind, r["record_id"]), r["record_id"], r["target_uri"], r["date"],
                            r["payload_digest"], "sha256:" + hashlib.sha256(raw).hexdigest(), content_type, len(raw), block,
                        )
                    )
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            kinds = {"page_id": pa.int64(), "content_length": pa.int64()}
            yield batch(**{n: pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)})

    return map_arrow(found, run, RECORDS)


def to_warc(records: DataFrame) -> DataFrame:
    """page_id and ``warc``: the record as WARC/1.1 text without the two line ends that close it."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", "record_type"),
        line("WARC-Record-ID", "record_id"),
        line("WARC-Refers-To", "refers_to"),
        line("WARC-Target-URI", "target_uri"),
        line("WARC-Date", "date"),
        line("WARC-Payload-Digest", "payload_digest"),
        line("WARC-Block-Digest", "block_digest"),
        line("Content-Type", "content_type"),
        line("Content-Length", "content_length"),
    )
    return records.select("page_id", F.concat(head, F.lit("\r\n\r\n"), "block").alias("warc"))


def write_warc(records: DataFrame, path: str) -> None:
    to_warc(records).select("warc").write.option("lineSep", "\r\n\r\n").text(path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))
