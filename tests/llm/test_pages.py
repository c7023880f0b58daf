from effectlab.llm.pages import extract, main_text

PROSE = "A sentence of the article, with commas, and enough words to be read as prose by anyone who looks."


def page(body, head="<title>t</title><style>p{}</style><script>if (a<b) { x('</p>') }</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_between_menus_adverts_and_footer():
    html = page(f'<nav><ul><li><a href="/a">Home</a></ul></nav><div class="ad">Buy, buy, buy, now.</div><article><h1>Head &amp; line</h1><p>{PROSE}<p><b>Second.<br><p>Third &lt;x&gt;</article><footer>&copy; me</footer>')
    assert main_text(html) == f"Head & line\n{PROSE}\nSecond.\nThird <x>"


def test_container_without_article_is_found_by_points():
    html = page(f'<div id="wrap"><div class="menu"><a href=x>One</a> <a href=y>Two</a></div><div><p>{PROSE}</p><p>{PROSE}</p></div><div id="sidebar"><p>{PROSE} {PROSE} {PROSE}</p></div></div>')
    assert main_text(html) == f"{PROSE}\n{PROSE}"


def test_reader_comments_forms_and_hidden_parts_go():
    html = page(
        f'<main><p>{PROSE}</p><form><p>Your mail, please</p><input></form><p hidden>secret</p><p style="display: none">none</p></main>'
        f'<section id="comments"><article class="comment"><p>{PROSE} {PROSE} {PROSE} {PROSE}</p></article></section><div class="cookie-notice">We use cookies.</div>'
    )
    assert main_text(html) == PROSE


def test_white_space_references_and_blocks():
    assert main_text("<p>a  b\n c<p>d<!-- <p>x</p> -->e<br>f &eacute;&#233;&#x41;<ul><li>g<li>h</ul>") == "a b c\nde f ééA\ng\nh"


def test_link_lists_inside_the_article_go():
    assert main_text(page(f'<article><p>{PROSE}</p><ul><li><a href=a>Other story</a></li></ul></article>')) == PROSE


def test_short_article_against_long_advert():
    assert main_text(page(f'<div class="ad">{PROSE}</div><article><h1>Tiny.</h1></article><footer>{PROSE}</footer>')) == "Tiny."


def test_defined_results_of_odd_pages(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain only", "x"), (4, "<div>" * 3000 + "deep", "x"), (5, "<!-- open", "x"), (6, "<p " + "a" * 5000, "x"), (7, "<p>" + "w " * 50000, "x"), (7, "<p>" + "w " * 50000, "x")]
    pages = spark.createDataFrame(rows, "page_id int, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract(pages).orderBy("page_id").collect()]
    assert [g[1] for g in got[:5]] == ["", "", "plain only", "deep", ""]
    assert got[6] == got[7] and got[6][2] == 99999
    assert extract(pages.limit(0)).count() == 0


LONG = "A sentence of the article, with commas, and with enough words to be one, as everyone can see. " * 3


def test_names_inside_an_article_cut_only_what_is_no_text():
    kept = f'<article><div class="article-header"><h1>Title</h1><p>{LONG}</p></div><p>{LONG}</p><ul class="tags-explained"><li>{LONG}</li></ul></article>'
    assert main_text(kept).split("\n") == ["Title", LONG.strip(), LONG.strip(), LONG.strip()]
    cut = f'<article><p>{LONG}</p><div class="share-buttons"><a href="/a">Share this</a> <a href="/b">Tell others about it</a></div><div class="ad">{LONG}</div><div class="post-comments">So true</div></article>'
    assert main_text(cut) == LONG.strip()


def test_a_paragraph_that_is_a_link_stays_and_runs_of_links_go():
    page = f'<article><p>{LONG}</p><p><a href="/x">The whole report</a></p><p>{LONG}</p><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul><p><a href="/3">Next</a></p><p><a href="/4">Last</a></p></article>'
    assert main_text(page).split("\n") == [LONG.strip(), "The whole report", LONG.strip()]


def test_headings_and_prose_lists_beside_the_container_stay():
    page = f'<body><div><h2>Beside</h2><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><ul><li>{LONG}</li><li>{LONG}</li></ul><ul><li><a href="/1">One</a></li></ul></div></body>'
    assert main_text(page).split("\n") == ["Beside", *[LONG.strip()] * 5]


CHECKS = {"op5_tree_scoring": "test_article_between_menus_adverts_and_footer"}
