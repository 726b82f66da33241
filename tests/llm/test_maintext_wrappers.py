import pytest

from quillgrid.llm import maintext

WORDS = "The council met on Monday to talk about the new bridge, which has been planned for many years and will cost more than thought. "
PARTS = ["A bridge at last", (WORDS * 2).strip(), (WORDS + "Work is to begin in the spring of next year, as the mayor said.").strip(), "Few objected."]
BODY = f"<h1>{PARTS[0]}</h1>" + "".join(f"<p>{p}</p>" for p in PARTS[1:])
SIDE = "<div class='sidebar'><ul><li><a href=/a>Most read</a></li><li><a href=/b>Weather</a></li></ul></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content-sidebar-wrap'><main>{BODY}</main>{SIDE}</div>",
        f"<div class='content-sidebar-wrap'><div>{BODY}</div>{SIDE}</div>",
        f"<div class='layout-sidebar-right'><article>{BODY}</article>{SIDE}</div>",
        f"<div class='layout-sidebar-right'>{BODY}{SIDE}</div>",
        f"<div class='print-area'>{BODY}</div>{SIDE}",
        f"<div class='print-area'><main>{BODY}</main></div>{SIDE}",
        f"<div id='popup'><div role='main'>{BODY}<div class='ad'>Buy this now, it is cheap and good.</div></div></div>",
    ],
)
def test_articles_in_named_wrappers_stay(page):
    assert maintext.main_text(f"<body>{page}</body>").split("\n\n") == PARTS


def test_names_inside_content_still_count():
    page = f"<main>{BODY}<div class='comments'><div><p>{WORDS}</p></div></div><div class='related'><div><div><p>{WORDS}</p></div></div></div></main>"
    assert maintext.main_text(page).split("\n\n") == PARTS
