import pytest

from tillroll.llm.html import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="x">
<nav><a href="/a">One</a></nav><header><h1>Site name</h1></header><div class="ad">Buy this now, it is cheap.</div>
<article class="post with-sidebar"><header><h1>The &amp; title</h1></header><p><b>First paragraph, with
  white&nbsp;space.<br><p>Short.<ul><li>One item.<li>Two <a href="#">items</a>.</ul>
<form><input><button>Send</button>Your name</form><div id="comments"><p>I liked this, really, I did. Thanks.</p></div></article>
<aside><p>Related stories, many of them, all long enough to look like text.</p></aside>
<div class="cookie-notice"><p>We use cookies, as all do. Accept, please.</p></div><footer>&copy; us</footer></body></html>"""


def test_article_alone_remains():
    assert main_text(PAGE) == "The & title\nFirst paragraph, with white space.\nShort.\nOne item.\nTwo items."


def test_paths_decide_where_no_article_is_marked():
    story = "".join(f"<p>Sentence {i}, which goes on for a while, as prose does. It ends here.</p>" for i in range(6))
    links = "".join(f'<div><a href="{i}">Link {i}</a></div>' for i in range(20))
    page = f"<body><div><div>{links}</div></div><div id=content><h2>Head</h2>{story}<p>End.</p></div><table><tr><td>12<td>13</table></body>"
    lines = main_text(page).split("\n")
    assert lines[0] == "Head" and lines[-1] == "End." and len(lines) == 8


@pytest.mark.parametrize("page, text", [("", ""), ("plain &lt; text", "plain < text"), ("<p", "<p"), ("<!-- <p>no</p> --><p>yes", "yes"),
                                        ("<article><p>a<p>a<p>a</article>", "a\na\na"), ("<article hidden>x</article>", ""), ("<script>x", "")])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_broken_and_deep_pages_end():
    assert main_text('<a "' * 20000)
    assert main_text("<div>" * 20000 + "deep" + "</x></span>" * 20000) == "deep"
    assert len(main_text("<article>" + "<p>long text. " * 50000)) > 500000


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>é 👍")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in extract(pages).collect()), key=str)
    assert got == sorted(((i, u, main_text(h or ""), len(main_text(h or ""))) for i, u, h in rows), key=str)
    assert extract(pages.limit(0)).collect() == []


def test_references_without_semicolon_count():
    assert main_text("<article><h1>Salt &amp pepper</h1><p>One &lt two, a&ampb &copy; and &#65 more words, and more of them.</p></article>") == \
        "Salt & pepper\nOne < two, a&b © and A more words, and more of them."


STORY = [f"Sentence {i}, which goes on for a while, as prose does; it has commas, and more of them. It ends here." for i in range(6)]
PARTS = ("<ul><li>Flour<li>Salt<li>Warm water<li>Yeast</ul>", "<ol><li>Mix<li>Wait</ol>", "<table><tr><td>Salt<td>5 g<tr><td>Flour<td>1 kg</table>",
         "<dl><dt>Crumb<dd>The inside</dl>", "<blockquote><div>Bread is life</div></blockquote>", "<div><h3>Notes</h3><ul><li><a href=x>A source</a></ul></div>")
WORDS = ("Flour Salt Warm~water Yeast", "Mix Wait", "Salt 5~g Flour 1~kg", "Crumb The~inside", "Bread~is~life", "Notes A~source")


@pytest.mark.parametrize("part, words", list(zip(PARTS, WORDS)))
def test_lists_tables_and_quotes_in_the_text_stay_without_article(part, words):
    links = "".join(f'<div class=card><a href="{i}">Teaser {i}</a></div>' for i in range(5))
    story = [f"<p>{t}</p>" for t in STORY]
    page = f"<body><div class=left>{links}</div><div class=text>{''.join(story[:3])}{part}{''.join(story[3:])}</div><div class=more>{links}</div></body>"
    assert main_text(page).split("\n") == STORY[:3] + [w.replace("~", " ") for w in words.split()] + STORY[3:]
    sections = f"<body><div class=a><div class=left>{links}</div><div class=s>{''.join(story[:3])}</div>{part}<div class=s>{''.join(story[3:])}</div></div></body>"
    assert main_text(sections).split("\n") == STORY[:3] + [w.replace("~", " ") for w in words.split()] + STORY[3:]


def test_list_that_ends_the_text_stays_without_article():
    page = f"<body><div class=text><h2>Bread</h2>{''.join(f'<p>{t}</p>' for t in STORY)}{PARTS[0]}</div><div class=low><div>Imprint</div></div></body>"
    assert main_text(page).split("\n") == ["Bread", *STORY, "Flour", "Salt", "Warm water", "Yeast"]


def test_sources_inside_an_article_stay():
    page = f"<body><article>{''.join(f'<p>{t}</p>' for t in STORY)}<ul><li><a href=1>First source</a><li><a href=2>Second</a></ul></article></body>"
    assert main_text(page).split("\n") == [*STORY, "First source", "Second"]


def test_text_in_a_div_wins_over_teasers_in_articles():
    card = '<article><h3><a href="{0}">Teaser with a title of some length, number {0}</a></h3><p>A short line, of it.</p></article>'
    page = f"<body><div class=text>{''.join(f'<p>{t}</p>' for t in STORY)}</div><div class=more>{''.join(map(card.format, range(3)))}</div></body>"
    assert main_text(page).split("\n") == STORY
    two = f"<body><article><p>{STORY[0]}</article><article><p>{STORY[1]}</article><div><p>{STORY[2]}</div></body>"
    assert main_text(two).split("\n") == STORY[:2]
