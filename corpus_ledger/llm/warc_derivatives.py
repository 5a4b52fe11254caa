"""WARC derivatives: a linked metadata record and a plain-text conversion record for each response.

A response record holds an HTTP message; the conversion record is its text, the metadata record what was
found out about it (title, language, charset, links, digests). Both carry WARC-Refers-To with the response's
record id, its target address, date and payload digest. Record ids are name-based UUIDs of the response's
id, so a rerun gives the same records.

Records are rows (header fields and block), one task sees one page at a time, and nothing is shuffled.
WARC header fields without a column of their own are kept in ``fields``, one "Name: value" line each, in their
order. Both derived records carry all header fields of the response there: those of its HTTP header as
Source-HTTP-..., and those of its ``fields`` as Source-....
``write_warc`` writes them as gzipped WARC files with Spark's text writer; ``read_warc`` reads such files and
those of others. Bytes that are not UTF-8 are read as U+FFFD.

Defined results: a page without an address keeps an empty target; null or empty html gives an empty payload
and empty text; a null date gives the epoch; repeated pages give repeated records with the same ids; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The WARC 1.1 version line, and the default date of a capture without one.
VERSION = "WARC/1.1"
EPOCH = "1970-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122

RECORD = ("record_id string, type string, refers_to string, target string, date string, content_type string, "
          "block_digest string, payload_digest string, fields string, block string")

# Elements whose content is not text, those whose content is given back if they are never
# closed, those that may stand in a head, those without content, and those that end a line.
HIDDEN = frozenset("script style head".split())
HELD = frozenset("template noscript".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 "
                   "h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


def digest(block: str) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block.encode("utf-8", "surrogatepass")).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, chr(10).join(parts))}>"


class PageText(HTMLParser):
    """Visible text by lines, title, links and language of one page.

    A head ends at its end tag, at a body, or at the first tag or text that may not stand in it. The text of a
    template or noscript is dropped at its end tag; one that ends with its parent or the page keeps its text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.now, self.links = [], [], []
        self.title, self.language, self.charset = [], "", ""
        self.in_title = False
        self.open, self.opened = [], Counter()  # open elements; a held one with the lines and the line before it
        self.hidden = 0                         # how many of them are hidden, from the innermost held one on

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "title":
            self.in_title = True
        elif tag == "html":
            self.language = found.get("lang") or ""
        elif tag == "meta":
            self.charset = found.get("charset") or self.charset
        elif tag == "a" and found.get("href"):
            self.links.append(found["href"])
        if tag == "body":
            self._close_down_to(0)
        elif tag not in IN_HEAD and self.hidden:
            self._end_head()
        if tag in BREAKS:
            self._end_line()
        if tag not in VOID:
            before = (len(self.lines), list(self.now), self.hidden) if tag in HELD else None
            self.open.append((tag, before))
            self.opened[tag] += 1
            self.hidden = 0 if before else self.hidden + (tag in HIDDEN)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in BREAKS:
            self._end_line()
        if self.opened[tag]:
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            before = self.open[at][1]
            self._close_down_to(at)
            if before:
                del self.lines[before[0]:]
                self.now = before[1]

    def _close_down_to(self, depth):
        while len(self.open) > depth:
            tag, before = self.open.pop()
            self.opened[tag] -= 1
            self.hidden = before[2] if before else self.hidden - (tag in HIDDEN)

    def _end_head(self):
        """End a head that is open outside of any held element."""
        for at in range(len(self.open) - 1, -1, -1):
            tag, before = self.open[at]
            if before:
                return
            if tag == "head":
                return self._close_down_to(at)

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
            return
        if self.hidden and self.open[-1][0] == "head" and data.strip():
            self._end_head()
        if not self.hidden:
            self.now.append(data)

    def parse_marked_section(self, i, report=1):
        """``<![...>`` is skipped up to its end instead of raising on an unknown keyword."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def _end_line(self):
        line = " ".join("".join(self.now).split())
        if line:
            self.lines.append(line)
        self.now = []

    def result(self, html: str) -> PageText:
        self.feed(html)
        self.close()
        self._end_line()
        return self


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date: Column | None = None) -> DataFrame:
    """WARC response records of pages: an HTTP message with the page as its payload."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, url, html, when in batch.itertuples(index=False):
                url, html = url or "", html or ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n\r\n"
                rows.append((record_id("response", str(page), url), "response", None, url, when or EPOCH,
                             "application/http; msgtype=response", digest(head + html), digest(html), None, head + html, page))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in RECORD.split(", ")] + ["page"])

    when = F.lit(EPOCH) if date is None else F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (pages.select(F.col(id_col).cast("string").alias("page"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"), when.alias("date"))
            .mapInPandas(build, RECORD + ", page string"))


def header_fields(lines: list[str]) -> list[tuple[str, str]]:
    """(name, value) of header lines; a line that begins with a blank goes on with the one before."""
    found: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, value = line.split(":", 1)
            found.append((name.strip(), value.strip()))
    return found


def derive(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response record; other types have none. A column
    ``page`` is kept if there is one."""
    own = [f.split()[0] for f in RECORD.split(", ")] + [c for c in ("page",) if c in records.columns]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record, target, date, payload_digest, further, block, *page in batch.itertuples(index=False):
                head, _, payload = (block or "").partition("\r\n\r\n")
                found = PageText().result(payload)
                text = "\n".join(found.lines)
                status, *lines = head.split("\r\n")
                http = header_fields(lines)
                served = next((value for name, value in http if name.lower() == "content-type"), "")
                source = "".join([*(f"Source-HTTP-{name}: {value}\r\n" for name, value in http),
                                  *(f"Source-{name}: {value}\r\n" for name, value in header_fields((further or "").split("\r\n")))])
                known = [("http-status", status), ("served-type", served), ("title", " ".join("".join(found.title).split())),
                         ("language", found.language), ("charset", found.charset), ("text-digest", digest(text)),
                         *(("outlink", " ".join(link.split())) for link in found.links)]
                meta = "".join(f"{k}: {v}\r\n" for k, v in known)
                for kind, content_type, body in (("metadata", "application/warc-fields", meta),
                                                 ("conversion", "text/plain; charset=utf-8", text)):
                    rows.append((record_id(kind, record), kind, record, target, date, content_type, digest(body),
                                 payload_digest, source or None, body, *page))
            yield pd.DataFrame(rows, columns=own)

    return (records.filter(F.col("type") == "response")
            .select("record_id", "target", "date", "payload_digest", "fields", "block", *own[len(RECORD.split(", ")):])
            .mapInPandas(build, RECORD + (", page string" if "page" in own else "")))


def serialised(records: DataFrame) -> DataFrame:
    """Each record as text: version line, header fields, block."""
    def field(name: str, column: Column) -> Column:
        return F.when(column.isNotNull(), F.concat(F.lit(f"{name}: "), column, F.lit("\r\n"))).otherwise(F.lit(""))

    return records.select(F.concat(
        F.lit(f"{VERSION}\r\n"), field("WARC-Type", F.col("type")), field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Refers-To", F.col("refers_to")), field("WARC-Target-URI", F.col("target")), field("WARC-Date", F.col("date")),
        field("WARC-Block-Digest", F.col("block_digest")), field("WARC-Payload-Digest", F.col("payload_digest")),
        field("Content-Type", F.col("content_type")), field("Content-Length", F.octet_length("block").cast("string")),
        F.coalesce("fields", F.lit("")), F.lit("\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files, a record ending in two line ends."""
    serialised(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", re.IGNORECASE)
_NAMES = {"WARC-Record-ID": "record_id", "WARC-Type": "type", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target",
          "WARC-Date": "date", "Content-Type": "content_type", "WARC-Block-Digest": "block_digest",
          "WARC-Payload-Digest": "payload_digest"}
_COLUMNS = {name.lower(): column for name, column in _NAMES.items()}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the gzipped WARC files in a folder; a task holds one file, whose size the writer's partitions set."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        columns = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                data, at, rows = gzip.decompress(content), 0, []
                while at < len(data):
                    head_end = data.index(b"\r\n\r\n", at)
                    size = int(_LENGTH.search(data, at, head_end + 2)[1])
                    named, further = {}, ""
                    for name, value in header_fields(data[at:head_end].decode(errors="replace").split("\r\n")[1:]):
                        column = _COLUMNS.get(name.lower())
                        if column and column not in named:
                            named[column] = value
                        elif name.lower() != "content-length":
                            further += f"{name}: {value}\r\n"
                    named |= {"fields": further or None, "block": data[head_end + 4:head_end + 4 + size].decode(errors="replace")}
                    rows.append([named.get(c) for c in columns])
                    at = head_end + 4 + size + 4
                yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(parse, RECORD)


def op5_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    made = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.select(F.col("page").cast("long").alias("page_id"), "type", "record_id", "refers_to", "target", "block_digest",
                       "payload_digest", F.octet_length("block").cast("long").alias("content_length"))
