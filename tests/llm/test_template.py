"""Boilerplate that classes of three tokens with one vector cannot hold."""

import pytest

from chatlens.llm import html_template

STORY = "<p>Story {i} begins here.</p>" + "<p>It goes on for day {i} at some length.</p>" * 2
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li><li><a href=/n>News</a></li></ul>"
OWN = "Story {i} begins here.\n" + "\n".join(["It goes on for day {i} at some length."] * 2)


def extracted(spark, pages):
    frame = spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_template.extracted(frame).collect()}


@pytest.mark.parametrize("layout", [
    MENU + "<div>{story}</div>",
    "<div>{story}{more}<p>Subscribe to us today</p></div>",
])
def test_menus_and_constant_paragraphs(spark, layout):
    more = ["".join(f"<p>Extra {i} {k}</p>" for k in range(i % 3)) for i in range(12)]
    out = extracted(spark, [layout.format(story=STORY.format(i=i), more=more[i]) for i in range(12)])
    for i, text in out.items():
        assert text.startswith(OWN.format(i=i)) and "Home" not in text and "Subscribe" not in text


def test_two_layouts_of_a_host(spark):
    a, b = "<div class=a>From desk A</div><div>{story}</div>", "<div class=b>From desk B</div><div>{story}</div>"
    out = extracted(spark, [(a if i % 2 else b).format(story=STORY.format(i=i)) for i in range(20)])
    assert out == {i: OWN.format(i=i) for i in range(20)}


def test_copies_of_a_page_keep_their_text(spark):
    pages = [MENU + STORY.format(i=i) for i in [7] * 8 + list(range(10, 20))]
    out = extracted(spark, pages)
    assert all(out[k] == OWN.format(i=7) for k in range(8)) and out[8] == OWN.format(i=10)


def test_regions_are_chosen_by_volume():
    story, teaser = "<p>" + "A long story told at length. " * 5 + "</p>", "<article><h2>Teaser</h2></article>"
    for page in (f"<main>{story}</main>{teaser}", f"<div>{story}</div>{teaser}", f"<main>{story}{teaser}</main>"):
        assert html_template.Page(page).text().startswith("A long story")
    assert html_template.Page(f"<p>out</p><article>{story}</article>").text() == ("A long story told at length. " * 5).strip()


def test_one_word_does_not_hide_the_story():
    story = "<p>" + "A long story told at length. " * 5 + "</p>"
    text = ("A long story told at length. " * 5).strip()
    page = html_template.Page
    assert page(f"<article><header class='entry-header'><h1>Title</h1></header>{story}</article>").text() == "Title\n" + text
    assert page(f"<div class='elementor-widget-container'>{story}</div><div class='sidebar'>beside</div>").text() == text
    assert page(f"{story}<div class=widget>beside</div><section class=comments>{'<p>No. </p>' * 90}</section>").text() == text


# Names that say nothing, no article or main element; the last two divs differ from page to page.
PLAIN = (
    "<html><body><div class=k1><a href=/{i}>Front {i}</a> <a href=/x{i}>World {i}</a></div><div class=k2><h1>Story {i}</h1>"
    "{paragraphs}<div class=related-work><p>Others found {i} before us in great detail.</p></div></div>"
    "<div class=k3>Buy thing {i} now</div><div class=k4>Page {i} of many</div></body></html>"
)


def plain(i):
    lines = [f"Paragraph {k} of story {i} tells something new at length, as stories do." for k in range(4 + i % 3)]
    own = "\n".join([f"Story {i}", *lines, f"Others found {i} before us in great detail."])
    return PLAIN.format(i=i, paragraphs="".join(f"<p>{x}" for x in lines)), own


def test_the_template_finds_the_text_where_no_name_does(spark):
    pages = [plain(i) for i in range(12)]
    out = extracted(spark, [p for p, _ in pages])
    assert out == {i: own for i, (_, own) in enumerate(pages)}
    assert all(html_template.Page(p).text() != own for p, own in pages)


def test_several_layouts_of_a_host_and_a_page_without_text(spark):
    wide = "<body><table><tr><td class=u>Go {i}<td class=v><h1>Story {i}</h1><p>{words}</p><td class=w>Now {i}</table></body>"
    pages = [plain(i) if i % 2 else (wide.format(i=i, words="word " * (40 + i)), f"Story {i}\n" + ("word " * (40 + i)).strip()) for i in range(24)]
    pages.append(("<html><body><div class=k1><a href=/>Front 99</a></div><div class=k2></div><div class=k3>Buy thing 99 now</div></body></html>", ""))
    out = extracted(spark, [p for p, _ in pages])
    assert out == {i: own for i, (_, own) in enumerate(pages)}


def test_parts_of_a_story_that_are_as_long_stay_and_articles_are_not_taken_apart(spark):
    lead, body = "A lead of story {i} that says a good deal. ", "The body of story {i} says the rest of it. "
    split = "<body><div class=m>Menu {i}</div><div class=p><div class=q>{lead}</div><div class=r>{body}</div><div class=s>Tag {i}</div></div></body>"
    whole = "<body><div class=m>Menu {i}</div><article><div class=q>In short {i}</div><div class=r>{body}</div></article></body>"
    for layout, want in ((split, "{lead}\n{body}"), (whole, "In short {i}\n{body}")):
        texts = [{"i": i, "lead": (lead * 3).format(i=i).strip(), "body": (body * 9).format(i=i).strip()} for i in range(8)]
        assert extracted(spark, [layout.format(**t) for t in texts]) == {i: want.format(**t) for i, t in enumerate(texts)}


def test_names_hide_a_part_only_as_a_whole():
    story, page = "<p>" + "A long story told at length. " * 5 + "</p>", html_template.Page
    for name in ("related-work", "legal-analysis", "share-of-voice", "socialHistory"):
        assert "Kept" in page(f"<article>{story}<div class={name}><p>Kept</p></div></article>").text()
        assert "Kept" in page(f"{story}<div class={name}><p>Kept</p></div>").text()
    for name in ("related-posts", "cookie-notice", "share-buttons", "sidebar-left", "adBox", "newsletter-form", "ad-2"):
        assert "Gone" not in page(f"<article>{story}<div class={name}><p>Gone</p></div></article>").text()


def test_templates_equal_a_deduction_by_definition(spark):
    """Constant texts, containers and their mean lengths of one host, counted page by page."""
    pages = [html_template.Page(plain(i)[0].replace("Buy thing", "Buy thing" if i % 2 else "Sell") + "<p>Imprint") for i in range(9)]
    sources = [plain(i)[0].replace("Buy thing", "Buy thing" if i % 2 else "Sell") + "<p>Imprint" for i in range(9)]
    frame = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(sources)], "key long, host string, html string")
    found = html_template.templates(frame.selectExpr("key", "'h' AS host", "html")).collect()[0]
    seen = [p.tokens() for p in pages]
    often = {t for s in seen for t in s if t and sum(t in x for x in seen) >= html_template.MIN_PAGES}
    constant = {t for t in often if next(s[t] for s in seen if t in s)[1]}
    assert set(found.constant) == constant and len(constant) == 1
    once = {t for t in often - constant if all(s[t][2] and s[t][3] == 1 for s in seen if t in s)}
    assert set(found.containers) == once and len(once) == 7
    for token, volume in zip(found.containers, found.volumes):
        own = [p._volumes(p._parents(), frozenset(constant)) for p in pages]
        held = [o[token] for o in own if token in o]
        assert volume == sum(held) // len(held)


def test_passages_that_some_stories_share_stay(spark):
    shared = "<p>Released under the MIT License."
    pages = [plain(i)[0].replace("<div class=related-work>", shared + "<div class=related-work>" if i % 3 == 0 else "<div class=related-work>") for i in range(30)]
    out = extracted(spark, pages)
    assert {i for i, text in out.items() if "\nReleased under the MIT License.\n" in text} == set(range(0, 30, 3))
