"""Inline chrome and dropped elements end where their end tags say."""

import pytest

from strandlake.llm import html_text

PROSE = "This paragraph is a long enough piece of ordinary prose that any reader would call it the text of the page, as it goes on."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><span class="byline">By A</span><p>Body</p><p>More</p></article>', "Body More"),
        (f'<article><p>{PROSE} <span class="share">x</span> rest of it</p></article>', f"{PROSE} rest of it"),
        (f'<article><p>{PROSE} <span class="share">x <span>y</span> z</span> rest of it</p></article>', f"{PROSE} rest of it"),
        (f'<article><p>{PROSE}</p><button>Share<p>lost</article><article><p>Again {PROSE}</p></article>', f"{PROSE} Again {PROSE}"),
        (f"<article><p>one <svg><g><title>t</title><svg><path></svg> lost</svg> two {PROSE}</p></article>", f"one two {PROSE}"),
        (f"<noscript><p>enable</noscript><article><p>{PROSE}</article>", PROSE),
    ],
)
def test_text_behind_inline_elements(page, want):
    assert html_text.main_text(page) == want


def test_flags_end_with_the_inline_element():
    flags = {b.text: b.flags[1] for b, _ in html_text.blocks('<p>Text <span class="share">x <button>b</span></button> y</span> rest</p><p>next</p>')}
    assert flags == {"Text": False, "x y": True, "rest": False, "next": False}
