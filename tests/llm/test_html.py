import time

from tierstone.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">the menu of the site</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies and you agree with that.</div>
<article><h1>The &amp; title</h1><p><b>First   line<br>goes on.<p>Short.</p>
<div class="ad-box">Buy this now, it is the best of all the things that you can buy.</div><p>Caf&eacute; &#8211; done</p>
<form><label>Your name</label><input></form><section id="comments"><p>I like the article, it is the best of them all, as they say.</p></section>
</article><aside>Other things</aside><footer>&copy; someone</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html.main_text(PAGE) == "The & title\n\nFirst line goes on.\n\nShort.\n\nCafé – done"


def test_page_without_article_goes_by_density_and_neighbours():
    text = "The house of the man is in the town and it was built for the people that live with him on the hill by the sea. " * 3
    page = f"<p><a href=x>{text}</a></p><p>short one</p><p>{text}</p><p>In between</p><p>{text}</p><p>Login</p><p><a href=y>Other pages</a></p><p>{'xq zz ' * 40}</p>"
    got = html.main_text(page).split("\n\n")
    assert got == ["short one", text.strip(), "In between", text.strip(), "Login"] or got == [text.strip(), "In between", text.strip(), "Login"]


def test_broken_markup():
    for page in ["<", "<p", "<p title='x>open quote", "a < b & c", "</p></div>", "<!-- open", "<script>x", "<div><div><p>" * 500, "<a " * 2000 + '"']:
        assert isinstance(html.main_text(page), str)
    assert html.main_text("<article>bare text <b>bold</b> end") == "bare text bold end"


def test_odd_rows_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "c"), (None, None, "", "c"), (2, "u", PAGE, "c"), (2, "u", PAGE, "c")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["n_chars"], len(r["text"])) for r in html.extract(pages).collect())
    assert got[:2] == [(0, 0, 0), (1, 0, 0)] and got[2] == got[3] and got[2][1] == got[2][2] > 0
    assert html.extract(pages.limit(0)).collect() == []


BODY = "The house of the man is in the town and it was built for the people that live with him on the hill by the sea. " * 4


def test_an_article_in_a_sidebar_or_a_card_does_not_name_the_page():
    teaser = "The teaser of the other story, which is in the list of the things that you can read on this site too."
    for around in ("<aside><article><p>{}</p></article></aside>", "<article class='card'><p>{}</p></article>" * 3, "<div class=sidebar><article>{}</article></div>"):
        page = f"<body><div class=content><h1>Title</h1><p>{BODY}</p><p>{BODY}</p></div>{around.replace('{}', teaser)}</body>"
        assert html.main_text(page).split("\n\n")[-2:] == [BODY.strip()] * 2 and teaser not in html.main_text(page)
    plain = f"<div><p>{BODY}</p><p>{BODY}</p></div>" + f"<article><p>{teaser}</p></article>" * 2
    assert html.main_text(plain).startswith(BODY.strip())


def test_comments_that_are_articles_stay_out():
    page = f"<main><p>{BODY}</p><article class=comment><p>{BODY[:110]}</p></article><p>{BODY}</p></main>"
    assert html.main_text(page) == f"{BODY.strip()}\n\n{BODY.strip()}"


def test_pages_in_other_languages_have_text():
    for text in ("Дом человека стоит в городе, и построен он был для людей, которые живут вместе с ним на холме у моря. ", "Dom człowieka stoi w mieście i został zbudowany dla ludzi, którzy mieszkają z nim na wzgórzu nad morzem. "):
        page = f"<nav><a href=/>menu</a></nav><div><h2>x</h2><p>{text * 4}</p><p>{text}</p><p>{text * 5}</p></div><p><a href=/y>{text * 3}</a></p><footer>f</footer>"
        got = html.main_text(page).split("\n\n")
        assert [(text * 4).strip(), text.strip(), (text * 5).strip()] == got[-3:]


def brute(blocks):
    """The second pass by looking left and right from every open block."""
    labels = [b.label for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        if labels[i] is not html.OPEN:
            out.append(labels[i])
            continue
        sides = []
        for step in (-1, 1):
            far, label, k = 1, html.GOOD if b.main else html.BAD, i + step
            while 0 <= k < len(blocks):
                if b.main and (blocks[k].main != b.main or blocks[k].chrome):
                    break
                if labels[k] is not html.OPEN and not (b.main and labels[k] is html.BAD):
                    label = labels[k]
                    break
                far, k = far + 1, k + step
            sides.append((label, far))
        (left, a), (right, z) = sides
        out.append(left if left == right else right if b.heading else left if a <= z else right)
    return out


def test_second_pass_equals_brute_force():
    import random

    draw = random.Random(5)
    for _ in range(300):
        blocks, article = [], 0
        for _ in range(draw.randrange(1, 25)):
            if draw.random() < 0.3:
                article = draw.choice([0, 0, article + 1])
            chrome = draw.random() < 0.1
            blocks.append(html.Block("x", 0, article, chrome, draw.random() < 0.2, html.BAD if chrome or article == 0 and draw.random() < 0.3 else draw.choice([html.GOOD, html.OPEN, html.OPEN])))
        named = any(b.main for b in blocks)
        wanted = brute(blocks)
        before, after = html._nearest(blocks, range(len(blocks))), html._nearest(blocks, range(len(blocks) - 1, -1, -1))
        got = [b.label if b.label is not html.OPEN else l if l == r else r if b.heading else l if a <= z else r for b, (l, a), (r, z) in zip(blocks, before, after)]
        assert got == wanted or not named


def test_time_grows_with_the_length_of_a_page():
    def seconds(page):
        start = time.process_time()
        html.main_text(page)
        return time.process_time() - start

    for piece in ("<li>short item</li>", "<div>", "<p>x</section>"):
        small, large = seconds(piece * 4000), seconds(piece * 32000)
        assert large < 24 * max(small, 0.02)
