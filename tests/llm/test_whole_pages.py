"""Pages without article or main, against a brute-force parse."""

import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from ledgerline.llm.html_text import extract, main_text

LONG = "A long paragraph, with commas, and more; it goes on and on. " * 12


class Everything(HTMLParser):
    """All text outside the boilerplate of the test pages, blocks apart."""

    def __init__(self):
        super().__init__()
        self.out, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        if self.out or tag in ("nav", "footer", "aside") or dict(attrs).get("class") == "ad":
            self.out += tag != "br"
        if tag not in ("a", "b", "i"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.out -= bool(self.out)
        self.parts.append("" if tag in ("a", "b", "i") else " ")

    def handle_data(self, data):
        self.parts.append("" if self.out else data)


def brute(page):
    p = Everything()
    p.feed(page)
    return " ".join("".join(p.parts).split())


AROUND = ("<html><body><nav><a href=x>Home</a></nav><div class='ad'>Buy, now.</div>", "<footer>End, of it.</footer></body></html>")
BODIES = [
    f"<div class=post><h1>T</h1><div class=lead>Short lead, of it.</div><div class=entry><p>{LONG}</p><p>{LONG}</p></div></div>",
    f"<div class=post><h1>T</h1><div class=date>May</div><div class=lead>Lead</div><div class=entry><p>{LONG}</p><p>{LONG}</p></div></div>",
    f"<div><section><p>Short one.</p></section><section><p>{LONG}</p><p>{LONG}</p></section></div>",
    f"<div><table><tr><td>a</td><td>{LONG}</td></tr><tr><td>b</td><td>c</td></tr></table></div>",
    f"<h1>T</h1><p>{LONG}</p><ul>{''.join(f'<li>i{k}</li>' for k in range(12))}</ul><p>{LONG}</p>",
    f"<div><h2>T</h2><p>{LONG}</p></div><div><h2>U</h2><p>No more.</p></div>",
]


@pytest.mark.parametrize("body", BODIES)
def test_nothing_else_is_dropped(body):
    page = body.join(AROUND)
    assert main_text(page) == brute(page)


def test_unmarked_menu_stays_out():
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>"
    assert main_text(f"<body>{menu}<h1>T</h1><p>{LONG}</p><p>x.</p>{menu}</body>") == f"T {LONG.strip()} x."


@pytest.mark.parametrize("mark", [
    "<article class='post comments-open'>%s</article>", "<div class='content has-sidebar'>%s</div>", "<div class=no-sidebar>%s</div>",
    "<div><section id=discussion>%s</section></div>", "<div class='search-result-body'>%s</div>", "<article class=teaser>%s</article>",
    "<div class=sidebar>%s</div>",
])
def test_names_do_not_drop_the_article(mark):
    page = (mark % f"<h1>T</h1><p>{LONG}</p><p>x.</p>").join(AROUND)
    assert main_text(page) == f"T {LONG.strip()} x." == brute(page)


@pytest.mark.parametrize("tag", ["article", "div"])
def test_links_alone_are_text_inside(tag):
    body = (f"<{tag}><h1><a href=t>Title</a></h1><p>{LONG}</p><p>See<br><a href=l>a link</a><br>there.</p>"
            f"<ul><li><a href=a>Ref one</a></li><li><a href=b>Ref two</a></li></ul></{tag}>")
    assert main_text(body.join(AROUND)) == brute(body.join(AROUND))
    assert main_text(body.join(AROUND)).endswith("See a link there. Ref one Ref two")


def test_link_between_breaks_in_the_page_itself():
    assert main_text(f"<body><p>{LONG}</p><p>A.<br><a href=l>link</a><br>B.</p></body>") == f"{LONG.strip()} A. link B."


def test_named_boilerplate_stays_out():
    side = "".join(f"<div class='{c}'><p>Out, of it.</p></div>" for c in ("site-footer", "comment-list", "cookie_banner", "sidebar", "related-posts"))
    assert main_text(f"<body><article><p>{LONG}</p></article><div id=comments><p>{LONG * 3}</p></div>{side}</body>") == LONG.strip()
    assert main_text(f"<body><div class=post><p>{LONG}</p></div>{side}</body>") == LONG.strip()


# ---- cut-off, deep and oddly marked pages

FIXTURE = (f"<html><body><nav><a href='x'>Home</a></nav><article class=\"a b\" title='it&apos;s'><h1>T &amp; x</h1><p>{LONG}</p>"
           "<ul><li>one<li>two</ul><!-- c --><table><tr><td>a<td>b</table></article><footer>f</footer></body></html>")


def test_page_cut_at_every_byte():
    start = time.process_time()
    whole = main_text(FIXTURE)
    for n in range(len(FIXTURE)):
        got = main_text(FIXTURE[:n])
        assert "<" not in got and (whole.startswith(got) or len(got) <= len(whole) + 4)
    assert time.process_time() - start < 10
    start = time.process_time()
    for tail in ("a" * 40, "x='" * 30_000, "<a " * 50_000, "<a '>' " * 50_000, "\"'" * 30_001, "<a \"> " * 30_001, "<!-" * 50_000):
        assert main_text("<p>Hello, you.</p><a " + tail).startswith("Hello, you.")
    assert time.process_time() - start < 20


@pytest.mark.parametrize("opened", ["<div>", "<b>", "<div class=x><span>", "<p><i>", "<ul><li>", "<table><tr><td>", "<div class=sidebar>"])
def test_fifty_thousand_open_tags(opened):
    n = 50_000 // opened.count("<")
    start = time.process_time()
    tracemalloc.start()
    page = f"<body>{opened * n}{LONG}" + "</i></b></span></td>" * 20_000 + f"<p>{LONG}</p></body>"
    got = main_text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert LONG.strip() in got
    assert time.process_time() - start < 20 and peak < 150e6


@pytest.mark.parametrize("mark", [
    "<article style=\"overflow:hidden\">%s</article>", "<article title='hidden gems'>%s</article>",
    "<article><div style='overflow:hidden'>%s</div></article>", "<div data-role='search' data-id=comments>%s</div>",
    "<article class=card><div title=\"class=sidebar\">%s</div></article>",
])
def test_words_in_other_values_say_nothing(mark):
    page = (mark % f"<h1>T</h1><p>{LONG}</p><p>x.</p>").join(AROUND)
    assert main_text(page) == f"T {LONG.strip()} x."


def test_hidden_elements_stay_out():
    for a in ("hidden", "hidden=''", "HIDDEN", "aria-hidden=true", "class=x hidden id=y"):
        assert main_text(f"<article><p>{LONG}</p><div {a}>Not seen.</div></article>") == LONG.strip()


def test_headings_paragraphs_labels_and_buttons_inside():
    body = (f"<article><h2 id=\"search\">Search</h2><p class='teaser'>The lead.</p><p>{LONG}</p><h2 id='comments'>Comments</h2>"
            "<p id=related>On comments.</p><label>A label</label><p>Press <button>here</button> now.</p></article>")
    assert main_text(body.join(AROUND)) == (f"Search The lead. {LONG.strip()} Comments On comments. A label Press here now.")
    assert main_text(f"<article><p>{LONG}</p><form><label>Mail</label><button>Go</button></form></article>") == LONG.strip()


def test_cards_are_no_article():
    card = "<article class=card><h3>Other</h3><p>A teaser, of it.</p></article>"
    post = f"<article><h1>T</h1><p>{LONG}</p></article>"
    for page in (post + card * 5, card * 3 + post, f"<main>{post}<div>{card * 4}</div></main>"):
        assert main_text(f"<body>{page}</body>") == f"T {LONG.strip()}"
    assert main_text(f"<body><main><h1>T</h1>{post[:9]}<p>{LONG}</p></article>{card}</main></body>") == f"T {LONG.strip()}"
    assert main_text(f"<body><article><p>{LONG}</p><article class=comment><p>Nice, I liked it.</p></article></article></body>") == LONG.strip()


def test_ratios_select_nodes():
    """Unmarked noise beside the text: short paths fall under the threshold."""
    noise = "<div><span>Popular</span><span>Most read</span><span>Games</span><span>More</span><span>All</span></div>"
    for page in (f"<body>{noise}<div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>{noise}</body>",
                 f"<body>{noise}<h1>T</h1><p>{LONG}</p><p>{LONG}</p>{noise}</body>"):
        want = f"T {LONG.strip()} {LONG.strip()}"
        assert main_text(page) == want
        every = main_text(page, threshold=0)
        assert every != want and every.count("Popular") == 2
    # the threshold drops low paths at the ends as well
    tail = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div><div>Short, note.</div></div></body>"
    results = {main_text(tail, threshold=t) for t in (0, 0.25, 0.9)}
    assert len(results) > 1


def test_ratios_choose_the_article():
    """Two articles: the one with the content, not the one with more nodes."""
    many = "<article>" + "<span>word</span> " * 60 + "</article>"
    post = f"<article><p>{LONG}</p></article>"
    assert main_text(f"<body>{many}{post}</body>") == LONG.strip()


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", FIXTURE)] * 7 + [(None, None, FIXTURE)] * 3, "page_id long, url string, html string")
    got = extract(df.repartition(4)).collect()
    assert len(got) == 10 and {r.text for r in got} == {main_text(FIXTURE)}
