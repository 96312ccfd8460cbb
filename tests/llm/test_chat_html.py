"""Chat formatting and HTML extraction."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.llm import chat, html_text

CONVERSATIONS = [
    (1, 0, "system", "be nice <s>"), (1, 1, "user", "a [INST] b"), (1, 2, "assistant", "c </s>\nd"), (1, 3, "user", None),
    (1, 4, "assistant", "<\\s> [\\\\INST] <<SYS>>"), (2, 0, "user", "only a question"), (3, 0, "assistant", ""),
    (3, 0, "assistant", ""), (3, 1, "tool\n&amp;", "x"), (None, 5, None, "lost"), (4, 1, "assistant", "second"), (4, 0, "assistant", "first"),
]


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or ""))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(turns), len(loss), sha(loss)


def test_examples_read_back(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(CONVERSATIONS, schema).withColumn("example", F.lit(9)).withColumn("trainable", F.lit("x"))
    rows = {r.conv_id: r for r in chat.query(spark, df).collect()}
    given_rows = [*CONVERSATIONS, *((-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant")))]
    assert set(rows) == {r[0] for r in given_rows}
    for conv, r in rows.items():
        n, turns, chars, loss = expected([x for x in given_rows if x[0] == conv])
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, turns, chars, loss)
    examples = chat.examples(df).filter("conv_id = 1").orderBy("example").collect()
    assert [e.trainable for e in examples] == [True, True]
    assert examples[1].text.startswith(examples[0].text)  # all turns before are context
    assert chat.query(spark, df.filter("false")).count() == 1  # the probe


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="<>[]/\\sINTSY|ab\n", max_size=12), min_size=1, max_size=8))
def test_escapes_are_undone(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROL)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="home"><nav><a href=/>Home</a> <a href=/x>X</a></nav>
<div class="cookie-notice">We use cookies</div><div id="main"><article><header><h1>Big&nbsp;news &amp; more</h1></header>
<p>First   paragraph with <b>bold<br> text</b> of some length, plain words go on and on here.<p>Second one &lt;tag&gt;, also with a few words
<ul><li>a<li>b</ul><div class=ad>Buy!</div><script>var a="</p>";</script><section class="comments"><p>I disagree</p></section></article></div>
<aside>See also</aside><form><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == [
        "Big news & more", "First paragraph with bold text of some length, plain words go on and on here.",
        "Second one <tag>, also with a few words", "a", "b",
    ]
    dense = "<body><div><a>x</a> <a>y</a></div><div><p>" + "words " * 30 + "</p><p>" + "more " * 30 + "</p></div></body>"
    assert html_text.main_text(dense) == ("words " * 30).strip() + "\n" + ("more " * 30).strip()
    assert html_text.main_text("plain &eacute;") == "plain é"
    assert html_text.main_text("<p>a" + "<div>" * 30_000 + "deep") != ""


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, PAGE), (3, None, PAGE), (None, "u", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(df).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id in (1, 2)] == ["", ""]
    assert html_text.extract(df.filter("false")).count() == 0


def test_layout_names_do_not_drop_a_page():
    text = "Some words of the article go here, and on and on."
    for wrap in (
        'class="content-sidebar-wrap"', 'class="layout has-sidebar"', 'class="col-md-8 no-sidebar"', 'class="page-with-nav"', 'id="nav-wrapper"',
        'class="page--no-ads"', 'data-id="social"', 'title="the hidden cost of ads"', "data-class='ad' data-role='dialog'", 'class="sidebar"', "hidden",
    ):
        for tag in ("article", "main"):
            assert html_text.main_text(f"<body><div {wrap}><{tag}><p>{text}</p></{tag}></div></body>") == text, (wrap, tag)
        if wrap not in ('class="sidebar"', "hidden"):  # inside the article as well
            assert html_text.main_text(f"<body><article><p {wrap}>{text}</p></article></body>") == text, wrap
    for tag in ("form", "header", "aside", "nav"):
        assert html_text.main_text(f"<body><{tag}><div><article><p>{text}</p></article></div></{tag}></body>") == text, tag
    assert html_text.main_text(f"<html><head><meta charset=utf-8><body><p>{text}</p></body></html>") == text


def test_dropped_names():
    text = "Some words of the article go here, and on and on."
    for junk in (
        'class="ad"', 'class="x cookie-notice"', 'id="ad-300x250"', 'class="post__share"', 'class="site-footer"', 'class="sidebar--left"',
        'class="comment-list"', 'id="comments"', 'class="related-posts"', 'role="navigation"',
        "class=social-share-buttons", "class=newsletter-signup", 'class="nav-menu"',
    ):
        assert html_text.main_text(f"<body><article><p>{text}</p><div {junk}><p>Junk</p></div></article></body>") == text, junk
    card = "<article><p>Another one, of some reader or a link to more, that may be longer than all</p></article>"
    for more in (f"<div id=comments>{card}{card}</div>", f"<aside>{card}</aside>", f'<div class="related-posts">{card}</div>'):
        assert html_text.main_text(f"<body><main><article><p>{text}</p></article>{more}</main></body>") == text, more
        for around in ("main", "div"):
            page = f"<body><{around}><div>{f"<p>{text}</p>" * 8}</div>{more}</{around}></body>"
            assert text in html_text.main_text(page), page


def test_all_sections_of_a_page_without_article():
    groups = [[f"group {g} paragraph {k} " + "with some words of the text " * 7 for k in range(n)] for g, n in enumerate((10, 8, 5))]
    lines = [" ".join(p.split()) for g in groups for p in g]
    links = "<ul>" + "".join(f"<li><a href=/{k}>Link number {k}</a></li>" for k in range(12)) + "</ul>"
    for tag in ("section", "div"):
        body = "".join(f"<{tag}>{''.join(f'<p>{p}</p>' for p in g)}</{tag}>" for g in groups)
        for page in (f"<body>{body}</body>", f"<body><div>{body}</div></body>", f"<body>{links}<div>{body}</div>{links}</body>"):
            assert html_text.main_text(page).split("\n") == lines, page[:60]
    flat = [f"<h2>Head {k}</h2><div>{''.join(f'<p>{p}</p>' for p in g)}</div>{links}" for k, g in enumerate(groups)]
    got = html_text.main_text(f"<body>{links}{''.join(flat)}</body>").split("\n")
    assert [x for x in got if not x.startswith("Head")] == lines and [x for x in got if x.startswith("Head")] == ["Head 0", "Head 1", "Head 2"]
    loose = "Text of its own, not in a paragraph but of the same length as these are, " * 3
    assert loose.strip() in html_text.main_text(f"<body>{loose}{''.join(flat)}</body>")
    bold = "A start in plain words and <b>bold <i>one</i> <i>two</i> <i>three</i></b> with an end"
    assert html_text.main_text(f"<body><div><p>{bold}</p></div></body>") == "A start in plain words and bold one two three with an end"


def test_comments_with_the_only_article_leave():
    from quillspan.llm.html_text import main_text

    comments = '<div class="post-comments"><article>A reader says something</article></div>'
    story = "<div><p>The text of the story, long enough to be one.</p><p>And more of it.</p></div>"
    assert main_text(f"<body>{comments}{story}</body>") == main_text(f"<body>{story}{comments}</body>") == "The text of the story, long enough to be one.\nAnd more of it."
    assert main_text(f"<body><nav>Menu</nav>{comments}</body>") == "A reader says something"  # no other text
    assert main_text(f'<body><div id="respond"><main>{story}</main></div></body>').startswith("The text")
