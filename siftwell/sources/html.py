"""HTML to markdown with ATX headings, for documents that are to be chunked by heading."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIP = {"script", "style", "noscript", "template", "nav", "title"}
_BREAK = {"p", "div", "section", "article", "tr", "ul", "ol", "table", "blockquote", "header", "footer", "main", "aside", "pre"}


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.prefix, self.skipped = [], [], "", 0

    def flush(self):
        line = " ".join("".join(self.text).split())
        if line:
            self.blocks.append(self.prefix + line)
        self.text, self.prefix = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skipped += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.flush()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.flush()
            self.prefix = "- "
        elif tag == "br":
            self.text.append(" ")
        elif tag in _BREAK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in _BREAK or tag == "li" or (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()):
            self.flush()

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)


def to_markdown(html: str) -> str:
    """Headings, list items and paragraphs of a page, separated by empty lines."""
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n\n".join(parser.blocks)


@F.arrow_udf(T.StringType())
def html_markdown(html: pa.Array) -> pa.Array:
    return pa.array([to_markdown(h.as_py() or "") for h in html], pa.string())
