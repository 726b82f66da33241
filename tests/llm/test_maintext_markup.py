import time

import pytest

from quillgrid.llm import maintext

TEXT = "The council met on Monday to talk about the new bridge, which has been planned for many years."


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p data-x=it's>Hello there, all of you.</p></article>", "Hello there, all of you."),
        (f"<article><!--><p>{TEXT}</p><!-- x --></article>", TEXT),
        (f"<article><!---><p>{TEXT}</p><!-- <p>no</p> --!></article>", TEXT),
        (f'<article class="post-popular"><p>{TEXT}</p></article>', TEXT),
        (f'<article class="post tags-foo widget"><p>{TEXT}</p></article>', TEXT),
        (f'<div class="main-menu-content"><p>{TEXT}</p></div>', TEXT),
        (f'<article><p title="a > b" data-y=\'"\'>{TEXT}</p></article>', TEXT),
        (f'<article><p>{TEXT}</p><p title="never ends>and this text goes on.</p></article>', TEXT + "\n\nand this text goes on."),
        (f'<main><p>{TEXT}</p><article class="comment"><p>{TEXT} I agree.</p></article></main>', TEXT),
        ("<article><p>One is < two", "One is < two"),
        (f"<article><p>{TEXT}</p></article><!-- no end", TEXT),
    ],
)
def test_markup(page, want):
    assert maintext.main_text(page) == want


@pytest.mark.parametrize("piece", ['<p title="', "<p title='x' ", "<a", "<!", "<!--", "<p a=", "</", "<p>", "<b><i>"])
def test_hostile_pages_take_linear_time(piece):
    began = time.process_time()
    maintext.blocks_of(piece * (300_000 // len(piece)))
    assert time.process_time() - began < 8
