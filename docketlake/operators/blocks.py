"""Documents as addressed blocks: from plain text with Columns alone, from HTML with one vectorised parser."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "div"}
SILENT = {"script", "style", "head", "noscript", "template"}
HTML_BLOCKS = "doc_id long, block_idx int, tag string, text string, char_start int, char_end int, heading_level int, bold boolean, italic boolean, footnotes array<string>"
HTML_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
#: Bytes of HTML that are parsed at a time.
PIECE = 1 << 21


def pieces(batches, column: str, most: int = PIECE):
    """The batches in pieces of about ``most`` bytes of a column, a row at least, so that a batch of any size is parsed in bounded memory."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, end - start)
            start = end


class _Blocks(HTMLParser):
    """Text of block elements in order; an unclosed block ends where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.silent = self.bold = self.italic = 0
        self.head = False
        self.now = self.fresh("")

    def fresh(self, tag: str) -> dict:
        return {"tag": tag, "text": [], "chars": 0, "bold": 0, "italic": 0, "notes": []}

    def close_block(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.now["text"])).strip()
        if text:
            self.found.append(self.now | {"text": text})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
            self.head = tag == "head" or self.head
        elif tag == "body" or self.head and tag in BLOCK_TAGS:  # a head that isn't closed ends where the body begins
            self.silent, self.head = 0, False
        if tag in BLOCK_TAGS:
            self.close_block()
            self.now = self.fresh(tag)
            self.bold = self.italic = 0
        elif tag == "br":
            self.now["text"].append(" ")
        elif tag in ("b", "strong"):
            self.bold += 1
        elif tag in ("i", "em"):
            self.italic += 1
        elif tag == "a" and str(dict(attrs).get("href") or "").startswith("#"):
            self.now["notes"].append(dict(attrs)["href"][1:])

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
            self.head = self.head and tag != "head"
        elif tag in BLOCK_TAGS:
            self.close_block()
            self.now = self.fresh("")
        elif tag in ("b", "strong"):
            self.bold = max(0, self.bold - 1)
        elif tag in ("i", "em"):
            self.italic = max(0, self.italic - 1)

    def handle_data(self, data):
        if self.silent:
            return
        n = len(data.strip())
        self.now["text"].append(data)
        self.now["chars"] += n
        self.now["bold"] += n * bool(self.bold)
        self.now["italic"] += n * bool(self.italic)


def parse_html(html: str | None) -> list[dict]:
    """Blocks of a page; one block of all its text where it has none."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    if not parser.found and html:
        text = " ".join(unescape(re.sub(r"(?s)<[^>]*>", " ", re.sub(r"(?is)<!--.*?-->|<(script|style|title)\b.*?</\1\s*>", " ", html))).split())
        if text:
            return [parser.fresh("") | {"text": text, "chars": len(text)}]
    return parser.found


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per text block, with offsets in the blocks joined by blank lines. Null or empty HTML has no block."""

    def parse(batches):
        for part in pieces(batches, "html"):
            rows = []
            for key_, source in zip(part.column("doc_id").to_pylist(), part.column("html").to_pylist()):
                at = 0
                for i, b in enumerate(parse_html(source)):
                    level = int(b["tag"][1]) if re.fullmatch("h[1-6]", b["tag"]) else None
                    whole = max(1, b["chars"])
                    rows.append((key_, i, b["tag"] or None, b["text"], at, at + len(b["text"]), level, b["bold"] == whole, b["italic"] == whole, b["notes"]))
                    at += len(b["text"]) + 2
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), HTML_KINDS)], [c.split()[0] for c in HTML_BLOCKS.split(", ")])

    return pages.select(F.col(key).cast("long").alias("doc_id"), F.col(html).alias("html")).mapInArrow(parse, HTML_BLOCKS)


def _texts(pages: DataFrame, key: str, html: str, text_of) -> DataFrame:
    """Pages (key, text), converted a piece of a batch at a time."""

    def convert(batches):
        for part in pieces(batches, "__html"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([text_of(v) for v in part.column(1).to_pylist()], pa.string())], [key, "text"])

    return pages.select(key, F.col(html).alias("__html")).mapInArrow(convert, f"`{key}` {dict(pages.dtypes)[key]}, text string")


def html_to_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The blocks of each page joined by blank lines."""
    return _texts(pages, key, html, lambda v: "\n\n".join(b["text"] for b in parse_html(v)))


NOTE = re.compile(r"#?_?ftn(\d+)", re.I)


class _Markdown(_Blocks):
    """Blocks as Markdown: headings, lists, quotes, emphasis, links and footnotes."""

    def __init__(self):
        super().__init__()
        self.links: list[tuple] = []
        self.note, self.first, self.around, self.depth = None, False, "", 0

    def close_block(self) -> None:
        marks = ("_" if self.italic else "") + ("**" if self.bold else "")
        text = re.sub(r"\s+", " ", re.sub(r"\*\*(\s*)\*\*", r"\1", "".join(self.now["text"]) + marks)).strip()
        self.links = []
        if not text:
            return
        tag = self.now["tag"]
        lead = "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else {"li": "- ", "blockquote": "> "}.get(tag, "")
        if self.note:
            lead = f"[^{self.note}]: " if self.first else "    "
            text = re.sub(rf"^\[?{self.note}\]?[.)]?\s*", "", text) if self.first else text
            self.first = False
        self.found.append({"text": lead + text})

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        noted = NOTE.fullmatch(str(named.get("id") or ""))
        if noted and tag != "a":
            self.close_block()
            self.now, self.bold, self.italic = self.fresh(""), 0, 0
            self.note, self.first, self.around, self.depth = noted[1], True, tag, 0
        self.depth += bool(self.note) and tag == self.around
        bold, italic = self.bold, self.italic
        super().handle_starttag(tag, attrs)
        if self.silent:
            return
        if self.bold > bold == 0:
            self.now["text"].append("**")
        if self.italic > italic == 0:
            self.now["text"].append("_")
        if tag == "a":
            self.links.append((str(named.get("href") or ""), len(self.now["text"])))

    def handle_endtag(self, tag):
        bold, italic, now = self.bold, self.italic, self.now
        if tag == "a" and self.links and not self.silent:
            href, at = self.links.pop()
            held = "".join(now["text"][at:])
            if noted := NOTE.fullmatch(href):
                now["text"][at:] = [f"[^{noted[1]}]"]
            elif href and not href.startswith("#") and held.strip():
                now["text"][at:] = [f"[{held.strip()}]({href})"]
        super().handle_endtag(tag)
        if self.now is now and not self.silent:
            if bold and not self.bold:
                now["text"].append("**")
            if italic and not self.italic:
                now["text"].append("_")
        if self.note and tag == self.around:
            self.depth -= 1
            if not self.depth:
                self.close_block()
                self.now, self.note = self.fresh(""), None


def markdown_of(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return "\n\n".join(b["text"] for b in parser.found)


def html_to_markdown(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Pages as Markdown; links to footnotes become ``[^n]`` and their bodies ``[^n]: ``. Null or empty HTML gives an empty text."""
    return _texts(pages, key, html, markdown_of)


def spine_text(blocks: DataFrame, sep: str = "\n\n") -> DataFrame:
    """The text that block offsets count in: each document's blocks in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct("block_idx", "text")))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda b: b["text"]), sep).alias("text"))


def _text_rows(doc_id, text: str, sep: str) -> list[tuple]:
    at, rows, seen, bare = 0, [], {}, 0
    for raw in text.split(sep):
        block = raw.strip(" ")
        if block:
            start = at + len(raw) - len(raw.lstrip(" "))
            number = NUMBERED.match(block)
            heading = len(block) <= 120 and block.upper() == block and block.lower() != block
            para = int(number[1]) if number else None
            if heading:
                kind, label = "heading", None
            elif number:
                seen[para] = seen.get(para, 0) + 1
                kind, label = "numbered", str(para) if seen[para] == 1 else f"{para}-{seen[para]}"
            else:
                bare += 1
                kind, label = "paragraph", f"u-{bare:03d}"
            rows.append((doc_id, len(rows) + 1, block, start, start + len(block), para, kind, label))
        at += len(raw) + len(sep)
    return rows


NUMBERED = re.compile(r"(\d{1,4})\.\s", re.A)
TEXT_BLOCKS = "block_idx long, text string, char_start int, char_end int, para_num long, type string, para_id string"


def text_blocks(docs: DataFrame, sep: str = "\n") -> DataFrame:
    """Non-blank blocks of plain text with exact offsets (in characters) and types: heading, numbered or paragraph.

    ``para_num`` is the number printed before a numbered block; ``para_id`` is it, made unique by ``-2``, ``-3`` on repetition,
    ``u-001`` for blocks without one, and null for headings. A text's blocks are made where it lies, in one pass over it.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {TEXT_BLOCKS}"
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in TEXT_BLOCKS.split(", ")]

    def cut(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [r for k, text in enumerate(part.column("text").to_pylist()) if text for r in _text_rows(k, text, sep)]
                columns = list(zip(*rows)) or [()] * 8
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def carry_forward(blocks: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """Each row with the last value established before or at it."""
    return blocks.withColumn(name, F.last(value, True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def next_boundary(rows: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """Each row with the next row's value: where its own span must end."""
    return rows.withColumn(name, F.lead(value).over(Window.partitionBy(group).orderBy(order)))


SECTIONS = (
    ("procedure", r"(?iu)^(?:the\s+)?(?:procedure|proc[ée]dure)$"),
    ("facts", r"(?iu)^(?:the\s+|les\s+|as\s+to\s+the\s+|en\s+)?(?:facts?|faits?)$"),
    ("law", r"(?iu)^(?:the\s+|le\s+|as\s+to\s+the\s+|en\s+)?(?:law|droit)$"),
    ("operative", r"(?iu)^(?:for\s+these\s+reasons|par\s+ces\s+motifs)\b.*"),
    ("separate_opinion", r"(?iu)^(?:(?:joint\s+)?(?:partly\s+)?(?:dissenting|concurring|separate)\s+opinion|opinion\s+(?:partiellement\s+)?(?:dissidente|concordante|s[ée]par[ée]e))\b.*"),
)


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks with the section they belong to: that of the last section heading, in canonical order (a heading of an earlier section doesn't reopen it)."""
    found = F.lit(None).cast("int")
    for i, (_, pattern) in reversed(list(enumerate(SECTIONS))):
        found = F.when(F.col("text").rlike(pattern), i).otherwise(found)
    order = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    names = F.array(*(F.lit(name) for name, _ in SECTIONS))
    level = F.max("__section").over(order)
    return blocks.withColumn("__section", found).withColumn("section", F.coalesce(F.get(names, level), F.lit("front"))).drop("__section")


def dispositive(blocks: DataFrame) -> DataFrame:
    """Rulings of the operative part: a numbered block with the unnumbered ones after it, and the vote it prints."""
    part = blocks.where("section = 'operative'")
    order = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max(F.col("text").rlike(r"(?iu)^(?:done\s+in|fait\s+en)\b").cast("int")).over(order)
    part = part.withColumn("__end", ended).withColumn("ruling", F.count("para_num").over(order)).where("ruling > 0 and __end = 0")
    joined = part.groupBy("doc_id", "ruling").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda b: b["text"]), "\n").alias("text"), F.min("block_idx").alias("block_idx"))
    vote = r"(?iu)\b(?:by|par)\s+(\w+)\s+(?:votes?|voix)\s+(?:to|contre)\s+(\w+)"
    unanimous = F.col("text").rlike(r"(?iu)\bunanimously\b|[àa]\s+l['’]unanimit[ée]")
    return joined.withColumn("unanimous", unanimous).withColumn("votes_for", F.nullif(F.lower(F.regexp_extract("text", vote, 1)), F.lit(""))).withColumn("votes_against", F.nullif(F.lower(F.regexp_extract("text", vote, 2)), F.lit("")))


def opinions(blocks: DataFrame) -> DataFrame:
    """Separate opinions: title, type, authors, joiners and text of each, from section headings of that kind."""
    title = F.col("text").rlike(SECTIONS[-1][1])
    order = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    part = blocks.where("section = 'separate_opinion'").withColumn("__new", title).withColumn("ordinal", F.count(F.when(F.col("__new"), 1)).over(order)).where("ordinal > 0")
    rows = F.array_sort(F.collect_list(F.struct("block_idx", "text")))
    joined = part.groupBy("doc_id", "ordinal").agg(rows.alias("r")).select("doc_id", "ordinal", F.col("r")[0]["text"].alias("title"), F.array_join(F.transform(F.slice("r", 2, F.size("r")), lambda b: b["text"]), "\n").alias("text"))
    kind = F.when(F.lower("title").rlike("partly dissenting|partiellement dissidente"), "partly_dissenting").when(F.lower("title").rlike("dissent|dissid"), "dissenting").when(F.lower("title").rlike("concur|concord"), "concurring").otherwise("separate")
    people = F.regexp_extract("title", r"(?iu)\b(?:of|de|des)\s+(?:judges?|juges?|M\.|Mme)\s+(.*?)(?:,?\s+(?:joined\s+by|à\s+laquelle)|$)", 1)
    joiners = F.regexp_extract("title", r"(?iu)\b(?:joined\s+by|se\s+rallie(?:nt)?)\s+(?:judges?\s+|juges?\s+|la\s+juge\s+)?(.*)$", 1)
    names = lambda c: F.filter(F.transform(F.split(c, r"(?iu)\s*,\s*|\s+and\s+|\s+et\s+"), lambda n: F.trim(n)), lambda n: n != "")
    return joined.select("doc_id", "ordinal", "title", kind.alias("opinion_type"), names(people).alias("authors"), names(joiners).alias("joined_by"), "text", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("opinion"), F.col("ordinal").cast("string"), "title"), 256).alias("opinion_id"))
