import random
import time

import numpy as np

from discloom.llm import pages

SCHEMA = "page_id long, url string, html string"


def page(body, menu="<nav><ul><li><a href='/a'>Menu item</a></li></ul></nav>"):
    return f"<!DOCTYPE html><html><head><title>Title</title><style>p{{x}}</style><script>var t='</p><p>no</p>';</script></head><body>{menu}{body}<footer>Imprint</footer></body></html>"


def texts(spark, rows):
    got = pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


LONG = "Lorem ipsum dolor sit amet, consetetur sadipscing elitr. " * 5


def test_article_without_what_surrounds_it(spark):
    body = (
        '<header>Head</header><div class="cookie-banner">Accept</div><article><h1>A &amp; B</h1><p>One&nbsp;two\n <b>th</b>ree<br>four &#8364;&lt;p&gt;</p>'
        f'<div class="ad">Buy</div><p>{LONG}</p><form><button>Send</button></form><aside>Aside</aside></article><div id="comments"><p>{LONG * 3}</p></div><div class="sidebar">S</div>'
    )
    got = texts(spark, [(1, "http://x.org/1", page(body))])
    assert got[1] == " ".join(f"A & B One two three four €<p> {LONG}".split())


def test_attributes_are_read_as_such(spark):
    body = (
        f"<article title='the hidden sidebar' data-class=\"ad\"><p title=\"a > b\">{LONG}</p><div class='readerComments'>No</div><p style=\"display: none\">No</p>"
        '<section id=sideBar>No</section><p hidden>No</p><div class="addition shadow">Yes</div></article>'
    )
    assert texts(spark, [(1, "http://x.org/1", page(body))])[1] == " ".join(f"{LONG} Yes".split())


def test_blocks_are_joined_and_unclosed_elements_end(spark):
    body = f"<main><p>One<p>Two<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>{LONG}<!-- no --><![CDATA[kept]]></main>"
    assert texts(spark, [(1, "http://x.org/1", page(body))])[1] == " ".join(f"One Two a b c d {LONG} kept".split())


def test_an_odd_page_follows_its_host(spark):
    own = lambda i: f'<div class="story v{i}"><p>{LONG} {i}</p></div><div class="extra"><p>short</p></div>'
    odd = f'<div class="story v9"><p>Brief.</p></div><div class="extra"><p>{LONG * 4}</p></div>'
    rows = [(i, f"http://Host.org/{i}", page(own(i))) for i in range(6)] + [(9, "http://host.org/odd", page(odd)), (10, "http://other.org/", page(odd))]
    got = texts(spark, rows)
    assert got[3] == " ".join(f"{LONG} 3".split()) and got[9] == "Brief." and got[10] == " ".join((LONG * 4).split())
    votes = pages.host_paths(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.host, r.path, r.votes) for r in votes] == [("host.org", code("host.org", "html", "body", "div.story.v#"), 6)]


def test_names_of_layouts_and_slugs_are_not_boilerplate(spark):
    wrappers = ["layout has-sidebar", "no-sidebar", "with-sidebar", "page-with-header", "sticky-nav-page"]
    rows = [(i, f"http://{i}.org/", page(f'<div class="{c}"><article><p>{LONG}</p></article><div class="sidebar">S</div></div>')) for i, c in enumerate(wrappers)]
    rows += [(10 + i, f"http://{i}.com/", page(f'<div class="{c}"><div class="text"><p>{LONG}</p></div></div><div class="sidebar">S</div>')) for i, c in enumerate(wrappers)]
    slugs = f'<article><h2 id="related-work">Related</h2><section id="social-impact"><p>{LONG}</p></section><p id="notice-period">Notice</p></article>'
    got = texts(spark, [*rows, (30, "http://s.org/", page(slugs))])
    assert all(got[i].strip() == LONG.strip() for i in got if i < 30) and got[30] == " ".join(f"Related {LONG} Notice".split())


def code(*steps):
    path = 0
    for x in steps:
        path = pages.step_code(path, x)
    return path


def test_votes_of_two_pages_count(spark):
    one, two = (f'<div class="{c}"><p>{LONG}</p></div>' for c in ("b", "a"))
    rows = [(1, "http://h/", page(one)), (2, "http://h/", page(two)), (2, "http://h/", page(two)), (3, "http://k/", page(one)), (4, "http://k/", page(two))]
    votes = {(r.host, r.path): r.votes for r in pages.host_paths(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert votes == {("h", code("h", "html", "body", "div.a")): 2}


def test_a_host_may_have_any_number_of_templates(spark):
    rows, want = [], {}
    for t in range(12):
        for i in range(3):
            body = f'<div class="story-{chr(97 + t)}"><p>{LONG} {i}</p></div><div class="extra"><p>short</p></div>'
            rows.append((len(rows), f"http://h.org/{t}/{i}", page(body)))
            want[len(want)] = " ".join(f"{LONG} {i}".split())
        rows.append((len(rows), f"http://h.org/{t}/odd", page(f'<div class="story-{chr(97 + t)}"><p>Brief {t}.</p></div><div class="extra-{chr(97 + t)}"><p>{LONG * 4}</p></div>')))
        want[len(want)] = f"Brief {t}."
    assert texts(spark, rows) == want


def test_pages_meet_many_paths_by_host(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org/{i}", page(f'<div class="story"><p>{LONG} {i}</p></div><div class="extra"><p>short</p></div>')) for i in range(60)]
    rows += [(100 + i, f"http://h{i}.org/odd", page(f'<div class="story"><p>Brief.</p></div><div class="extra"><p>{LONG * 4}</p></div>')) for i in range(5)]
    rows += [(None, None, page(f"<article>{LONG}</article>")), (7, "http://h0.org/", None), (7, "http://h0.org/", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(pages, "TURN_PAGES", 4)
    got, want = (sorted(map(tuple, pages.main_text(df, most=n).collect()), key=str) for n in (0, 1000))
    assert got == want and len(got) == len(rows) and [r[2] for r in got if r[0] == 102] == ["Brief."]


def plain(page):
    return pages.extract(page, pages.Votes(np.empty(0, np.int64), np.empty(0, np.int64)))


def test_quotes_outside_values_are_plain_characters():
    assert plain(f"<article><img alt=don't src=x><p>{LONG}</p><p>isn't</p></article>") == f"{LONG}isn't"
    assert plain("<p class=it's>First part here.</p><p>Second, it isn't lost.</p>") == "First part here. Second, it isn't lost."
    assert plain("""<article><a "b' href="x>y" title = 'p > "q'>One</a><p id='"' class="'">Two &lt; three</p><br/><p a="unclosed>Four</p></article>""").startswith("One Two < three")


def test_names_are_weighed_against_text():
    assert plain(f'<article><h1 class="article-header">Title</h1><p>{LONG}</p></article>') == f"Title {LONG}".strip()
    assert plain(f'<article><section class="social-history"><p>{LONG}</p></section><p>End</p></article>') == f"{LONG}End"
    assert plain(f"<body><form action=x><div class=text><p>{LONG}</p></div><button>Send</button></form></body>") == LONG.strip()
    assert plain(f"<body><div class=text><p>{LONG}</p></div><div class='user-comments'><p>{LONG * 3}</p></div></body>") == LONG.strip()
    assert plain(f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{LONG}</p></article></body>") == f"Title {LONG}".strip()
    for name in ("ad-slot-3", "cookieNotice", "comment-body", "related articles", "share-buttons", "site-footer", "sidebar left", "newsletter-signup", "ad"):
        assert plain(f'<article><p>{LONG}</p><div class="{name}"><p>No, not this.</p></div></article>') == LONG.strip(), name
    for name in ("addition shadow", "notice-period", "header-image", "readers", "comfort", "main-content", "no-sidebar", "content"):
        assert plain(f'<article><p>{LONG}</p><div class="{name}"><p>Yes</p></div></article>') == f"{LONG}Yes", name


def test_deep_and_broken_pages_take_linear_time():
    began = time.time()
    assert plain("<body>" + "<div>" * 64_000 + LONG + "</div>" * 64_000) == LONG.strip()
    assert plain("<b>" * 64_000 + LONG + "</i>" * 64_000) == LONG.strip()
    assert plain("<i><div>" + "<b>" * 64_000 + LONG + "</i>" * 64_000) == LONG.strip()
    assert plain("<span>" * 64_000 + "<p>x" * 64_000) == " ".join("x" * 64_000)
    assert plain("<a b='" * 64_000 + ">") == "" and plain("<![CDATA[x" * 1000).startswith("x<")
    assert time.time() - began < 60


def built_page(rng):
    """A page made of labelled blocks, and the text that belongs to its article."""
    word = lambda: "".join(rng.choice(["ba", "ne", "ti", "mo", "sur"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    links = lambda: "".join(f"<li><a href='/{word()}'>{word()}</a>" for _ in range(rng.randint(3, 9)))
    junk = [
        lambda: f"<nav><ul>{links()}</ul></nav>", lambda: f"<div class='{rng.choice(['ad', 'ad-slot', 'advert'])}'>{prose(8)}</div>", lambda: f"<aside>{prose(9)}</aside>",
        lambda: f"<div id=comments><h3>{word()}</h3><p>{prose(40)}</p><p>{prose(30)}</p></div>", lambda: f"<form>{word()} <input name=q><button>{word()}</button></form>",
        lambda: f"<div class='sidebar {word()}'><ul>{links()}</ul><p>{prose(6)}</p></div>", lambda: f"<div class=cookie-notice>{prose(9)}</div>", lambda: f"<script>{word()} = '<p>'</script>",
    ]
    blocks, truth = [], []
    for _ in range(rng.randint(3, 8)):
        text = prose(rng.randint(20, 60))
        kind = rng.randrange(4)
        blocks.append([f"<p>{text}</p>", f"<p class=x{word()}>{text}", f"<h2>{text}</h2>", f"<blockquote><p>{text}</p></blockquote>"][kind])
        truth.append(text)
        if rng.random() < 0.3:
            blocks.append(rng.choice(junk)())
    tag = rng.choice(["article", "div class=story", "main", "section class='post-content'"])
    around = lambda: "".join(rng.choice(junk)() for _ in range(rng.randint(0, 2)))
    body = f"<header><a href=/>{word()}</a></header>{around()}<{tag}>{''.join(blocks)}</{tag.split()[0]}>{around()}<footer>{prose(6)}</footer>"
    return f"<html><head><title>{word()}</title></head><body>{body}</body></html>", " ".join(truth)


def test_accuracy_on_labelled_pages(spark):
    rng = random.Random(11)
    built = [built_page(rng) for _ in range(300)]
    got = texts(spark, [(i, f"http://h{i % 40}.org/{i}", html) for i, (html, _) in enumerate(built)])
    right = [got[i] == truth for i, (_, truth) in enumerate(built)]
    assert sum(right) / len(right) > 0.97


def test_nulls_empty_broken_and_long_pages(spark):
    rows = [
        (1, None, page(f"<article>{LONG}</article>")), (2, "http://x", None), (3, "http://x", ""), (4, "not a url", "plain words"), (5, "http://x", "<p>never <b>closed"),
        (6, "http://x", "<script>only"), (None, "http://x", page(f"<article>{LONG}</article>")), (7, "http://y", page("<article>" + "<p>word </p>" * 60_000 + "</article>")),
        (8, "http://z", page("<div>" * 3000 + LONG + "</div>" * 3000)), (9, "http://x", "<"), (10, "http://x", "</p></div>a < b <3 &bogus; &amp"),
    ]
    got = texts(spark, rows)
    assert got[1] == got[None] == LONG.strip() == got[8] and got[2] == got[3] == got[6] == ""
    assert got[7] == " ".join(["word"] * 60_000)


def test_no_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://x", page(f"<article>{LONG}</article>"), "h", "t", 1)], f"{SCHEMA}, host string, text string, path int")
    assert pages.main_text(df).columns == ["page_id", "url", "text", "n_chars"] and pages.main_text(df).first().text == LONG.strip()
    assert pages.main_text(df.limit(0)).count() == 0


TEXT = "This is the long text of a page that readers want to see, sentence after sentence, without an end. " * 6
NO_VOTES = pages.Votes(np.zeros(0, np.int64), np.zeros(0, np.int64))


def test_text_in_unusual_places_is_kept():
    of = lambda body: pages.extract(f"<body>{body}</body>", NO_VOTES)
    assert TEXT.strip() in of(f"<nav><a href=x>Home</a></nav><aside><p>{TEXT}</p></aside><div>short</div>")
    assert of(f"<div role=dialog><p>{TEXT}</p></div>") == TEXT.strip()
    assert of("<div><p>Press <button>Save</button>, to save.</p><button>Subscribe</button></div>") == "Press Save, to save."
    assert TEXT.strip() in of(f"<div class='content gdpr'><p>{TEXT}</p></div><div class=box>{'some words ' * 12}</div>")


def test_what_is_beside_an_article_or_other_text_is_dropped():
    of = lambda body: pages.extract(f"<body>{body}</body>", NO_VOTES)
    assert of(f"<article><p>Short one.</p></article><aside>{TEXT}</aside><div role=dialog>{TEXT}</div>") == "Short one."
    assert of(f"<div class=card><p>{TEXT}</p></div><aside><article>Another teaser</article>{TEXT * 3}</aside>") == TEXT.strip()
    assert of("<div class=card><p>A text.</p><p><button>Share</button></p></div><dialog hidden>No</dialog>") == "A text."
