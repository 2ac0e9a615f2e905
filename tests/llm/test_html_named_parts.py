import pytest

from kurtosia.llm import html_text

WORDS = "One paragraph of the real article with a good number of words in it."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content no-sidebar"><p>{WORDS}</p></div>',
        f'<body><div class="page has-sidebar"><p>{WORDS}</p></div><div class="sidebar">Side words</div>',
        f'<article class="post category-advertising tag-cookies"><p>{WORDS}</p></article>',
        f'<div class="banner"><article><p>{WORDS}</p></article></div>',
        f'<main class="comments-open"><p>{WORDS}</p></main>',
        f'<form action=x><div><p>{WORDS}</p></div></form>',
        f'<div id="comments"><p>{WORDS}</p></div>',
    ],
)
def test_named_parts_that_hold_the_content_are_kept(page):
    assert html_text.main_text(page, {}) == WORDS


def test_parts_of_an_article_with_such_words_are_kept():
    page = f'<div class="post"><div class="post-header"><h1>Short title</h1></div><p>{WORDS}</p><div id="related-work"><p>{WORDS}</p></div></div>'
    assert html_text.main_text(page, {}) == f"Short title\n{WORDS}\n{WORDS}"


def test_boilerplate_is_still_dropped():
    page = f'<head><title>{WORDS} {WORDS} {WORDS}</title></head><div class="cookie-notice">We use cookies</div><article><p>{WORDS}</p><div class="ad">Buy</div><aside>Side</aside></article><div class="share social">Share</div><footer>Foot</footer>'
    assert html_text.main_text(page, {}) == WORDS


def test_learned_costs_rule_the_scan():
    page = f'<div class="lead"><p>{WORDS}</p></div><div class="top-widget"><p>Two words</p></div>'
    assert html_text.main_text(page, {}).endswith("Two words")
    assert html_text.main_text(page, {".widget": 4.0}) == WORDS
