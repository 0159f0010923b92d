"""Chat formatting round trips and main-text extraction."""

import hashlib
import json
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import chat_format as cf
from tessera.llm import html_extract as hx

TRICKY = ["", "\\", "<", "</turn>\n", "\\### Assistant: </turn> ok", "<turn:user>\nhi</turn>\n", "<image:0>", "\\<\\>", "é😀\r\n\x00"]


@given(st.text(max_size=30), st.one_of(st.sampled_from(TRICKY), st.text(max_size=60)))
def test_turn_round_trip(role, text):
    got = cf.format_turn(role, [{"type": "text", "text": text}])
    m = cf.TURN.fullmatch(got["formatted"])
    assert (cf.unescape(m[1]), cf.unescape(m[2])) == (role, text)
    assert (got["loss_start"] is not None) == (role == "assistant")


def test_parts_visitor():
    parts = [{"type": "text", "text": "see <image:0> "}, {"type": "image", "ref": "i.png", "width": 28, "height": 29},
             {"type": "document", "ref": "d.pdf", "pages": 2, "parts": [
                 {"type": "text", "text": "in"}, {"type": "audio", "ref": "a.wav", "seconds": 1.5}]}]
    got = cf.format_turn("assistant", parts)
    assert got["formatted"] == "<turn:assistant>\nsee \\<image:0\\> <image:0><document:1>in<audio:2></turn>\n"
    assert got["attachments"] == [(0, "image", "i.png", 6), (1, "document", "d.pdf", 1024), (2, "audio", "a.wav", 38)]
    assert cf.TURN.fullmatch(got["formatted"]) and cf.MARK.findall(got["formatted"]) == [
        ("image", "0"), ("document", "1"), ("audio", "2")]
    with pytest.raises(ValueError):
        cf.format_turn("user", [{"type": "video"}])


def test_conversations(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice([*TRICKY, None, "plain"]), json.dumps([{"type": "text", "text": "p"}]))
            for c in [*range(40), None] for t in range(r.randint(1, 5))]
    rows += [(7, 0, "user", "same", None)] * 2 + [(99, i, "assistant", f"hot {i}", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {x.conv_id: x for x in cf.read_back(cf.format_chat(df)).collect()}
    assert set(got) == {x[0] for x in rows}
    for c, g in got.items():
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert (g.n_turns, g.turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = cf.format_chat(df, parts="formatted")
    assert {x.formatted for x in parts.filter("conv_id = 1").collect()} <= {f"<turn:{w}>\np</turn>\n" for w in ("user", "assistant", "")}
    assert cf.read_back(cf.format_chat(df.filter("false"))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, ok.</div>
<div class="ad">Buy.</div><article><h1>Head &amp; tail</h1><p><b>Bold, first.<br><p>Second &lt;b&gt;  with\n <a href="x">link</a>,
and more.</p><ul><li>one<li>two</ul><form><p>Subscribe now</p></form><div class="share">Share this</div></article>
<section id="comments"><p>Nice, nice, nice, nice, nice post. I agree, and so on.</p></section>
<aside>Side, bar, text, here.</aside><footer>&copy; 2020 &middot; All</footer></body>"""
WANT = "Head & tail\nBold, first.\nSecond <b> with link, and more.\none\ntwo"


def test_page():
    assert hx.extract(PAGE) == WANT
    plain = "<body><div><p>" + "Words, more words. " * 9 + "</p><p>Tail.</p></div><div><a href='a'>x, y, z, w link list</a></div>"
    assert hx.extract(plain) == ("Words, more words. " * 9).strip() + "\nTail."
    assert [hx.extract(x) for x in (None, "", "<p>", "no markup", "<nav><a>m</a></nav>")] == ["", "", "", "no markup", ""]
    assert hx.extract("<article><h1>A</h1><p>Ly.</p><p>cut &am") == "A\nLy.\ncut &am"
    deep = "<div>" * 20000 + "<p>deep text, here.</p>"
    assert hx.extract(deep) == "deep text, here."


def test_whole_article_stays():
    long = "Words of some text, and more of them follow here. " * 10
    small = ('<section><h4>Small</h4><p>Short, final part</p><ul><li>item</li></ul><table><tr><td>cell</table>'
             '<blockquote>Quote</blockquote><p><a href="x">Source</a></p></section>')
    cut = '<ul><li><a href="a">Other page</a></li><li><a href="b">More</a></li></ul><div class="share">Share</div>'
    for tag in ("article", "main"):
        for inner in ("{}", "<div>{}</div>"):
            body = inner.format("<section>" + f"<p>{long}</p>" * 10 + "</section>" + small + cut)
            got = hx.extract(f"<body><nav>Menu</nav><{tag}><h1>Title</h1>{body}</{tag}><div>Elsewhere</div></body>")
            assert got.split("\n") == ["Title", *[long.strip()] * 10, "Small", "Short, final part", "item", "cell", "Quote", "Source"]


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "y"), (None, None, None, "z")],
                                  "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text) for r in hx.main_text(pages).collect())
    assert got == [(0, ""), (1, WANT), (1, WANT)]
    assert hx.main_text(pages.filter("false")).count() == 0
    rows = hx.main_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    import html as h
    for r in rows:  # on these pages the article is one element of flat blocks
        art = re.search(r"<article>(.*?)(</article>|<footer>|$)", html[r.page_id], re.S)[1]
        blocks = (" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", art))
        assert r.text == "\n".join(b for b in blocks if b)
