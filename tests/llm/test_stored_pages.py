"""Main text of the stored pages against an independent parse of their article elements."""

from __future__ import annotations

from html.parser import HTMLParser

from lumeset.llm import flat_blocks

BLOCKS = {"h1", "h2", "h3", "p", "br", "div", "li", "ul", "ol", "table", "tr", "td", "th", "pre", "blockquote", "section"}
SKIPPED = {"script", "style", "nav", "aside", "form", "footer", "button"}


class Article(HTMLParser):
    """Text of article elements, a part for each block, without what is skipped or an advert."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.open, self.depth, self.out = [""], False, 0, []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.open = True
        if self.depth:
            self.depth += tag not in {"br", "img", "hr", "input", "meta", "link"}
        elif tag in SKIPPED or dict(attrs).get("class") == "ad":
            self.depth = 1
        if tag in BLOCKS or tag == "article":
            self.parts.append("")

    def handle_endtag(self, tag):
        if self.depth:
            self.depth -= 1
        if tag == "article":
            self.open = False
        if tag in BLOCKS or tag == "article":
            self.parts.append("")

    def handle_data(self, data):
        if self.open and not self.depth:
            self.parts[-1] += data


def test_stored_pages_equal_an_independent_parse(spark):
    d = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in flat_blocks.op6_flat_blocks(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        p = Article()
        p.feed(r.html or "")
        p.close()
        want = "\n".join(t for t in (" ".join(x.split()) for x in p.parts) if t)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want)), r.page_id
