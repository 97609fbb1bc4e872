import base64
import gzip
import hashlib
import html
import random
import re
import time
import uuid
import zlib
from collections import defaultdict
from datetime import datetime, timezone
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import htmlblocks, queries, templates, warc


def article(source):
    """The article element's text, for pages of the test tables alone."""
    m = re.search(r"<article>(.*?)(?:</article>|$)", source or "", re.S)
    inner = re.sub(r"<b>", "", m[1]) if m else ""
    return " ".join(html.unescape(re.sub(r"<[a-z/!][^>]*>", " ", inner)).split())


def test_articles_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op1_main_text(spark, sf).collect()
    assert {r.page_id: r.text for r in rows} == want and len(rows) == len(want)
    assert all(r.n_chars == len(r.text) for r in rows)


def blocks(source):
    page = htmlblocks.parse(source)
    return " ".join(b for b, kept in zip(page.blocks, page.kept) if kept)


def test_rules_without_an_article_element():
    page = """<html><head><title>T</title></head><body><header>Site</header><div id="cookie-notice">We use</div>
    <ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul>
    <div class=content><h1>Head &amp; &lt;line&gt;</h1><p>First  <i>par</i>t<br>two<p>Second <script>var x='</p>'</script>end
    <div class="share-buttons">Tweet</div><table><tr><td>a<td>b</table></div>
    <section id=comments><p>nice</p></section><form><input value=x>Search</form><footer>(c)</footer><!-- no --></body></html>"""
    assert blocks(page) == "Head & <line> First part two Second end a b"
    assert blocks("<p>x<p hidden>y</p><div style='display: none'>z</div>&eacute;&#233;&#xe9;") == "x ééé"
    assert blocks("<article><header><h1>T</h1></header><p>b</p><aside>s</aside><article class=comment>c</article></article><p>out") == "T b"


def test_no_word_alone_takes_an_articles_content():
    assert blocks("<article><p class=related-story>The court said so.</p><p class=legal>It did.</p><div class='social-history'>Then.</div></article>") == "The court said so. It did. Then."
    assert blocks("<article><p>Short.</p><div class=comments><p>All that the article says is here.</p></div></article>") == "Short. All that the article says is here."
    assert blocks("<article><p>A story of some length.</p><div class=ad>Buy</div><section class='comments x'><p>nice</p></section></article>") == "A story of some length."
    assert blocks("<div class='legal notice'><p>The whole page is a legal notice.</p></div><div class=footer>(c)</div>") == "The whole page is a legal notice."
    assert blocks("<div class=ad>one</div><div class=ad>two</div><div class=ad>six</div>") == "one two six"
    links = "".join(f"<li><a href={k}>Number {k}</a></li>" for k in range(5))
    assert blocks(f"<ul>{links}</ul>") == "Number 0 Number 1 Number 2 Number 3 Number 4"
    assert blocks(f"<ul>{links}</ul><p>{'A text that is longer than its menu. ' * 3}</p>") == " ".join(["A text that is longer than its menu."] * 3)


def test_broken_markup_ends_with_the_page():
    assert blocks("<div><p>a < b <b>c") == "a < b c"
    assert blocks("text</p></div> more <!-- open") == "text more"
    assert blocks("<p class='x>y</p>") in ("", "y")
    assert blocks("<script>never ends") == ""
    assert blocks("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert blocks("a <b") == "a <b" and blocks("x<ul><li>1<ul><li>2</ul><li>3</ul>y</b></div>z") == "x 1 2 3 yz"


def test_time_is_in_proportion_to_the_page():
    kinds = ["<div>", "<div>x", "<b>x", "<p><i>x", "<ul><li>x", "<table><tr><td>x", "<a \"'>x", "<a '>", "</b>", "<div></p>", "<section class=ad>x", "<", "<!--", "<a b", "<script>"]
    begun = time.process_time()
    for kind in kinds:
        htmlblocks.parse(kind * (100_000 // len(kind)))
    htmlblocks.parse("<div>" * 100_000 + "x" + "</div>" * 100_000)
    assert time.process_time() - begun < 10


def recounted(rows, min_pages=5, min_share=0.25, many=1000):
    """Text and removed characters of each page: subtrees of each host in plain dictionaries."""
    parsed = [(k, re.sub(r"^\w+://([^/]*).*", r"\1", url or "").lower(), htmlblocks.parse(html)) for k, url, html in rows]
    different, having = defaultdict(set), defaultdict(set)
    for _, host, p in parsed:
        ident = tuple(b for b, kept in zip(p.blocks, p.kept) if kept)
        different[host].add(ident)
        for h, first, end in p.spans:
            having[host, h, sum(map(len, p.blocks[first:end])) >= 40].add(ident)
    out = {}
    for k, host, p in parsed:
        gone = set()
        for h, first, end in p.spans:
            long = sum(map(len, p.blocks[first:end])) >= 40
            n = len(having[host, h, long])
            outside = n >= min_share * len(different[host]) or long and n >= many
            if host and n >= min_pages and (n >= 10 and n >= 0.5 * len(different[host]) if h & 2 else outside):
                gone |= set(range(first, end))
        left = [b for i, (b, kept) in enumerate(zip(p.blocks, p.kept)) if kept and i not in gone]
        out[k] = (" ".join(left), len(gone), sum(len(p.blocks[i]) for i in gone), sum(len(b) for i, (b, kept) in enumerate(zip(p.blocks, p.kept)) if not kept and i not in gone))
    return out


def neutral_site(rng, host, n, first):
    """Pages whose furniture has neutral names: none of it can be told but by its recurrence."""
    word = lambda: "".join(rng.choice("bdfgklmnprstvw") + rng.choice("aeiou") for _ in range(3))
    say = lambda k: " ".join(word() for _ in range(k))
    top, side, foot = say(12), [say(6) for _ in range(4)], say(30)
    rows = {}
    for k in range(n):
        story = [say(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 5))]
        boxes = "".join(f"<div class=c{j}><p>{s}</p></div>" for j, s in enumerate(side) if (k + j) % 3)
        rows[first + k] = (f"http://{host}/{k}", f"<body><div class=r1><div>{top}</div></div><div class=r2>{''.join(f'<p>{p}</p>' for p in story)}</div><div class=r3>{boxes}</div><div class=r4>{foot}</div></body>", " ".join(story))
    return rows


def test_sites_of_neutral_names_are_cleaned_by_recurrence(spark):
    rng = random.Random(3)
    rows = neutral_site(rng, "a.example", 40, 0) | neutral_site(rng, "b.example", 12, 100) | neutral_site(rng, "c.example", 3, 200)
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()
    both = [(k, url, html) for k, (url, html, _) in rows.items()] + [(r.page_id + 1000, r.url, r.html) for r in table]
    pages = spark.createDataFrame(both, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in templates.main_text(pages, carry=("page_id",)).collect()}
    assert {k: (r.text, r.n_template_blocks, r.n_template_chars, r.n_marked_chars) for k, r in got.items()} == recounted(both)
    for k, (_, _, story) in rows.items():
        assert (got[k].text == story) == (k < 200)  # three pages are too few to tell a template
    share = sum(got[k].n_template_chars for k in range(40)) / sum(len("".join(htmlblocks.parse(rows[k][1]).blocks)) for k in range(40))
    assert share > 0.3
    few = {r.page_id: (r.text, r.n_template_blocks, r.n_template_chars, r.n_marked_chars) for r in templates.main_text(pages, min_pages=2, min_share=0.9, many_pages=25, carry=("page_id",)).collect()}
    assert few == recounted(both, 2, 0.9, 25) and few != recounted(both, 2, 0.9)


def test_templates_recur_across_pages_of_a_host(spark):
    template = "<div class=x1><p>Join us today, it is free</p></div>"
    rows = [(k, f"http://A.example/{k}", f"<div>{template}<p>story number {k} of the site</p><p>and its end {k}</p></div>") for k in range(8)]
    rows += [(20, "http://b.example/", f"<div>{template}<p>other host</p></div>"), (21, None, f"<div>{template}</div>"), (22, "http://a.example/e", None), (23, "http://a.example/f", "")]
    # copies of one article don't make it a template
    rows += [(30 + k, f"http://c.example/{k}", f"<script>{k}</script><div><p>the same story everywhere, at length</p></div>") for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("text", F.lit("clash")).withColumn("k", F.lit(2))
    got = {r.page_id: r.text for r in templates.main_text(pages, carry=("page_id", "row")).collect()}
    assert got[3] == "story number 3 of the site and its end 3"
    assert got[20] == "Join us today, it is free other host" and got[21] == "Join us today, it is free"
    assert got[22] == got[23] == ""
    assert got[33] == "the same story everywhere, at length"
    assert templates.main_text(pages.limit(0), carry=("page_id",)).count() == 0
    assert templates.main_text(pages.union(pages), carry=("page_id",)).count() == 2 * len(rows)


def test_lines_that_articles_share_stay(spark):
    """A line in a third of a host's articles is theirs; a box in all of them is not, nor is the line outside of them."""
    line, box = "A saying that is often quoted on these pages.", "<div class=z><p>Get our letter.</p></div>"
    page = lambda k: f"<body><div class=q>{line if k % 3 == 1 else k}</div><article><p>Story {k} is told.</p>{f'<p>{line}</p>' if k % 3 == 0 else ''}{box}</article></body>"
    pages = spark.createDataFrame([(k, f"http://a.example/{k}", page(k)) for k in range(30)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_template_chars) for r in templates.main_text(pages, carry=("page_id",)).collect()}
    assert got == {k: (f"Story {k} is told." + f" {line}" * (k % 3 == 0), 15 + len(line) * (k % 3 == 1)) for k in range(30)}


def test_a_template_longer_than_any_article_is_found(spark):
    template = f"<div class=x1><p>{'Terms apply to all that is here. ' * 20}</p></div><div class=x2><p>{'So does the law of the land. ' * 20}</p></div>"
    rows = [(k, f"http://a.example/{k}", f"<div>{template}<p>story {k}</p></div>") for k in range(8)]
    rows += [(8 + k, f"http://b.example/{k}", "<div><p>the same story</p><p>on every page</p></div>") for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_template_blocks) for r in templates.main_text(pages, carry=("page_id",)).collect()}
    assert got == {k: (f"story {k}", 2) if k < 8 else ("the same story on every page", 0) for k in range(16)}


def test_derivatives_refer_to_their_response(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op6_warc_derivatives(spark, sf).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        data = pages[r.page_id].html.encode()
        assert r.source_digest == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.target_uri == pages[r.page_id].url and r.refers_to.startswith("<urn:uuid:")
    by = {}
    for r in rows:
        by.setdefault(r.page_id, {})[r.record_type] = r
    assert all(set(x) == {"metadata", "conversion"} and len({r.refers_to for r in x.values()}) == 1 and len({r.record_id for r in x.values()}) == 2 for x in by.values())


class Blocks(HTMLParser):
    """Text blocks by the standard library's parser, for pages whose elements are all closed but <b> and <br>."""

    def __init__(self, source):
        super().__init__()
        self.blocks, self.text, self.silent, self.title = [], "", 0, None
        self.links = []
        self.feed(source)
        self.close()
        self.cut()

    def cut(self):
        if " ".join(self.text.split()):
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("head", "script", "style")
        if tag == "a":
            self.links.append(dict(attrs)["href"])
        if tag not in ("b", "i", "a", "br"):
            self.cut()
        elif tag == "br":
            self.text += " "

    def handle_endtag(self, tag):
        self.silent -= tag in ("head", "script", "style")
        if tag not in ("b", "i", "a", "br"):
            self.cut()

    def handle_data(self, data):
        if self.lasttag == "title" and self.title is None:
            self.title = data
        if not self.silent:
            self.text += data


def test_records_of_the_table_match_brute_force(spark, sf):
    """Ids, headers and blocks of every record, built again field by field."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {(r.page_id, r.record_type): r for r in queries.op6_warc_derivatives(spark, sf).collect()}
    assert len(got) == 2 * len(pages)
    sha = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    name = lambda *x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(x))}>"
    for p in pages:
        at = datetime.fromtimestamp(1_704_067_200 + p.page_id * 104_729 % 63_072_000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        source = name("response", str(p.page_id), p.url)
        read = Blocks(p.html)
        text = "\n".join(read.blocks).encode()
        digest = sha(p.html.encode())
        fields = [f"software: {warc.SOFTWARE}", f"source-payload-digest: {digest}", f"source-length: {len(p.html.encode())}", "source-content-type: text/html; charset=utf-8", f"source-x-page: {p.page_id}", f"title: {' '.join(read.title.split())}", *(f"outlink: {x} L a/@href" for x in read.links)]
        meta = "".join(f + "\r\n" for f in fields).encode()
        for kind, block, content in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
            r = got[p.page_id, kind]
            head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(source, kind)}", f"WARC-Date: {at}", f"WARC-Target-URI: {p.url}", f"WARC-Refers-To: {source}", f"WARC-Refers-To-Target-URI: {p.url}", f"WARC-Refers-To-Date: {at}"]
            head += [f"WARC-Concurrent-To: {name(source, 'conversion')}"] * (kind == "metadata") + [f"WARC-Block-Digest: {sha(block)}"] + [f"WARC-Payload-Digest: {digest}"] * (kind == "metadata") + [f"Content-Type: {content}", f"Content-Length: {len(block)}"]
            assert r.block_sha256 == hashlib.sha256(block).hexdigest(), (p.page_id, kind)
            assert r.header_sha256 == hashlib.sha256("".join(h + "\r\n" for h in head).encode()).hexdigest()
            assert (r.record_id, r.refers_to, r.target_uri, r.date, r.source_digest, r.block_digest, r.content_length, r.content_type) == (name(source, kind), source, p.url, at, digest, sha(block), len(block), content)


def test_warc_files_round_trip(spark, tmp_path):
    rows = [(1, "http://a.example/", "<title>T &amp; t</title><p>café<p>x <a href='/n'>n</a>"), (2, None, None), (3, "http://b.example/", ""), (3, "http://b.example/", ""), (None, "http://c.example/", "<p>" + "long \r\n\r\n" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("header", F.lit("clash")).withColumn("block", F.lit(1))
    records = warc.build_derivatives(pages, source_id=F.lit(None).cast("string"), headers=F.lit("Content-Type: text/html\r\nServer: s"))
    want = sorted((r.record_id, r.block.encode()) for r in records.collect())
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        for _ in range(2):  # the second time in place of the first
            warc.write_warc(records, path, compression)
        back = warc.read_warc(spark, path).collect()
        assert sorted((r.headers["WARC-Record-ID"], bytes(r.block)) for r in back) == want and len(want) == 10
        for r in back:
            assert r.headers["WARC-Block-Digest"] == warc.sha1_base32(bytes(r.block)) and int(r.headers["Content-Length"]) == len(r.block)
        for file in (tmp_path / compression).iterdir():
            data = file.read_bytes()
            if compression == "gzip" and file.suffix == ".gz":  # a member for each record, that can be read by itself
                starts = [m.start() for m in re.finditer(b"\x1f\x8b\x08", data)]
                assert sum(zlib.decompressobj(31).decompress(data[k:], 7) == b"WARC/1." for k in starts) == gzip.decompress(data).count(b"WARC/1.1\r\n")
    assert sorted((r.headers["WARC-Record-ID"], bytes(r.block)) for r in warc.read_warc(spark, str(tmp_path / "gzip"), split=100).collect()) == want
    one = [r for r in back if r.headers.get("WARC-Target-URI") == "http://a.example/"]
    text = next(bytes(r.block).decode() for r in one if r.headers["WARC-Type"] == "conversion")
    fields = next(bytes(r.block).decode() for r in one if r.headers["WARC-Type"] == "metadata")
    assert text == "café\nx n"
    assert "title: T & t\r\n" in fields and "outlink: /n L a/@href" in fields and "source-server: s" in fields
    assert warc.build_derivatives(pages.limit(0)).count() == 0


def test_ranges_of_large_files_have_each_record_once(tmp_path):
    """Blocks that look like members and headers, larger than a chunk, in one stream and in members."""
    rng = random.Random(5)
    fake = gzip.compress(b"WARC/1.0 is not one")[4:]
    blocks = [bytes(rng.randrange(256) for _ in range(300)) * rng.choice([0, 1, 9, 9000]) + b"\r\n\r\nWARC/1.1\r\n" + fake for _ in range(25)]
    records = [b"WARC/1.1\r\nWARC-Record-ID: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(b), b) for k, b in enumerate(blocks)]
    for name, data in (("members", b"".join(gzip.compress(r, 1) for r in records)), ("stream", gzip.compress(b"".join(records), 1)), ("plain", b"".join(records))):
        (tmp_path / name).write_bytes(data)
        for step in (len(data), 70_001, 5003):
            got = [x for k in range(0, len(data), step) for x in warc.records_of(f"file://{tmp_path}/{name}", k, min(len(data), k + step))]
            assert [(int(h["WARC-Record-ID"]), b) for h, b in got] == list(enumerate(blocks)), (name, step)


STORY = "<p>The town hall was sold to a baker.</p><p>He will keep the clock.</p>"
TOLD = "The town hall was sold to a baker. He will keep the clock."


@pytest.mark.parametrize(
    "page",
    [
        f"<main>{STORY}</main><section><article class='comment'>First!</article><article class='comment'>me too, and much more than the story itself has to say about anything at all, really</article></section>",
        f"<div id=post>{STORY}</div><article class='comment'>First!</article>",
        f"<main>{STORY}</main><section><article class='card'><h3>Teaser one</h3></article><article class='card'><h3>Teaser two</h3></article></section>",
        f"<main>{STORY}</main><section><article><h3>Teaser one</h3></article><article><h3>Teaser two</h3></article></section>",
        f"<article>{STORY}<section class='comments'><p>{'so many words ' * 30}</p></section></article>",
        f"<article>{STORY}<div class='user-comments'><p>I saw it</p></div></article>",
        f"<article>{STORY}</article><div class='userComments'><p>I saw it</p></div>",
        f"<article>{STORY}<section id='reader-comments'><article><p>I saw it</p></article></section></article>",
        f"<article>{STORY}</article><section class='comments'><article><p>I saw it</p></article></section>",
        f"<main><article class='post'>{STORY}</article><article class='teaser-card'>Teaser</article></main>",
        f"<main class='with-comments'>{STORY}</main>",
        f"<div class='open-comments'><article>{STORY}</article></div>",
        f"<div id='comments'>{STORY}</div>",
        f"<main><p>Home</p></main><article>{STORY}</article>",
        f"<main><article>{STORY}</article></main><article class='card'>Teaser</article>",
    ],
)
def test_comments_and_cards_are_not_the_article(page):
    p = htmlblocks.parse(f"<html><body>{page}</body></html>")
    assert " ".join(b for b, kept in zip(p.blocks, p.kept) if kept) == TOLD


def test_many_nested_comments_take_linear_time():
    page = f"<article>{STORY}</article>" + "<div class='comment'><p>x</p>" * 30_000
    began = time.perf_counter()
    p = htmlblocks.parse(page)
    assert " ".join(b for b, kept in zip(p.blocks, p.kept) if kept) == TOLD and time.perf_counter() - began < 5
