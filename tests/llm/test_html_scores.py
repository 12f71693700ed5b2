"""Path scores choose the root and the nodes, with and without marked articles."""

from lakeproof.llm.html_text import main_text

LONG = "".join(f"<p>The main text, part {i}, goes on here, and on, for quite some length. It ends.</p>" for i in range(6))
WANT = " ".join(f"The main text, part {i}, goes on here, and on, for quite some length. It ends." for i in range(6))
LINKS = "<ul>" + "".join(f"<li><a href=x>Other page {i}</a></li>" for i in range(5)) + "</ul>"


def test_main_text_outside_of_articles():
    teasers = "<div class='cards'>" + "<article><p>A teaser, short.</p></article>" * 3 + "</div>"
    assert main_text(f"<body><div class='post-body'>{LONG}</div>{teasers}</body>") == WANT


def test_link_list_inside_the_root():
    assert main_text(f"<body><article><h1>Title</h1>{LONG}{LINKS}</article></body>") == f"Title {WANT}"
    assert main_text(f"<body><div class='post-body'><h2>Title</h2>{LONG}{LINKS}</div></body>") == f"Title {WANT}"


def test_short_items_beside_prose_stay():
    assert main_text(f"<body><article>{LONG}<ul><li>Salt</li><li>Flour</li></ul></article></body>") == f"{WANT} Salt Flour"
    sections = "".join(f"<section><h2>S{i}</h2><div class='s{c}'>{LONG}</div></section>" for i, c in enumerate("ab"))
    assert main_text(f"<main>{sections}</main>") == f"S0 {WANT} S1 {WANT}"
    posts = "".join(f"<article class='{c}'>{LONG}</article>" for c in ("news", "sport"))
    assert main_text(f"<body>{posts}</body>") == f"{WANT} {WANT}"


def test_threshold_decides_inside_an_article():
    from lakeproof.llm.html_text import HtmlParams

    page = f"<body><article>{LONG}<div class='x'>Read on, there</div>{LINKS}</article></body>"
    low, usual, high = (main_text(page, HtmlParams(threshold=x)) for x in (-1.0, 0.1, 50.0))
    assert "Other page 3" in low and "Other page" not in usual and usual.startswith(WANT) and high == ""


def test_time_follows_length():
    import time

    for piece in ("<div>x, y.", "<b>x, y.", "<a ", "<title>", "<b><div><i>x, y.</b>", '<a "', "<!x"):
        began = time.process_time()
        main_text(piece * 60_000 + ">")
        assert time.process_time() - began < 40, piece


def test_repeated_and_tied_pages(spark):
    from lakeproof.llm.html_text import extract_text
    from lakeproof.session import ship

    ship(spark)
    twins = "<body><div class='a'><p>One text, here.</p></div><div class='b'><p>One text, too.</p></div></body>"
    df = spark.createDataFrame([(i, "u", twins, "x", 1) for i in (1, 1, 2)], "page_id long, url string, html string, text string, ranges int")
    assert {(r.page_id, r.text, r.ranges) for r in extract_text(df).collect()} == {(1, main_text(twins), 1), (2, main_text(twins), 1)}


def test_short_blocks_of_an_article_stay():
    """Quotations, cells, captions and notes of any class, beside long paragraphs."""
    extra = "<blockquote>So it goes</blockquote><table><tr><td>Salt</td><td>2 g</td></tr></table><figure><figcaption>A view</figcaption></figure><p class='legal-note'>No warranty</p><p class='skip'>Mind the gap</p><h2 id=search>Search</h2><p><a href=x>One link</a> and words around it</p>"
    got = main_text(f"<body><article>{LONG}{extra}</article></body>")
    assert got == f"{WANT} So it goes Salt 2 g A view No warranty Mind the gap Search One link and words around it"
    assert main_text(f"<body><article>{LONG}<div class=share>Tell your friends</div><p class=newsletter>Join us</p><aside>Aside</aside></article></body>") == WANT


#: Pages without ``article`` and without telling classes: the larger part of the text isn't the article.
CLOUD = "<div class='kc'>" + "".join(f"<span>topic {i} of many</span><br>" for i in range(150)) + "</div>"
TICKER = "<div class='kx'>" + "".join(f"<div>City {i} sunny and warm today</div>" for i in range(90)) + "</div>"
PLAIN = [
    (f"<body><div class='ka'>{LONG}</div>{CLOUD}</body>", WANT),
    (f"<body>{TICKER}<div class='kb'><div class='kd'>{LONG}</div></div></body>", WANT),
    (f"<body><table><tr><td>{CLOUD}</td><td><div class=z>{LONG}</div></td></tr></table></body>", WANT),
]


def test_ratios_decide(monkeypatch):
    """The ratios find the text; with the same score for every path the bulk of short pieces wins."""
    from lakeproof.llm import html_text

    assert [main_text(page) for page, _ in PLAIN] == [want for _, want in PLAIN]
    real = html_text.path_scores
    monkeypatch.setattr(html_text, "path_scores", lambda *a: dict.fromkeys(real(*a), 1.0))
    assert all(main_text(page) != want for page, want in PLAIN)
