import pytest

from kurtosia.llm import html_text, warc

WORDS = "one two three four five six"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><p>start of it</p><svg viewBox="0 0 9 9"/><p>{WORDS}</p>',
        f"<body><p>start of it</p><svg-icon>x</svg-icon><p>{WORDS}</p>",
        f"<body><p>start of it</p><noscript><p>{WORDS}</p>",
        f"<head><title>T</title><body><p>start of it</p><p>{WORDS}</p>",
        f"<html><head><meta charset=utf-8><title>T</title><p>start of it</p><p>{WORDS}</p>",
        f"<head><title>T<body><p>start of it</p><p>{WORDS}</p>",
    ],
)
def test_no_text_is_lost_after_odd_tags(page):
    for text in (html_text.main_text(page, {}), warc.plain_text(page)):
        assert text.replace("x\n", "").replace("start of itx", "start of it").startswith("start of it") and text.endswith(WORDS)


def test_math_and_objects_keep_their_text():
    page = "<p>Let <math><mi>x</mi></math> be <object>given <param name=a>here</object> now and so on</p>"
    assert html_text.main_text(page, {}) == "Let x be given here now and so on"


def test_scripts_stay_hidden():
    page = f'<head><script>var a = "<p>no";</script><style>p{{}}</style></head><p>{WORDS}</p><svg><text>no</text></svg><script src="a>b" />no</script><script>no no no'
    assert html_text.main_text(page, {}) == WORDS == warc.plain_text(page.replace("<svg><text>no</text></svg>", ""))


def test_many_open_tags_take_linear_time():
    page = "<svg><noscript>" * 100_000 + WORDS
    assert html_text.main_text(page, {}) == WORDS == warc.plain_text(page)


def test_titles_without_an_end():
    block = f"HTTP/1.1 200 OK\r\n\r\n<head><title-bar>n</title-bar><title>Name<body><p>{WORDS}</p>"
    meta = warc.derived({"record_id": "a", "target_uri": None, "date": None, "block": block.encode(), "payload_digest": None})[0]
    assert "title: Name\r\n" in meta["block"]
