from quillgrid.llm import maintext

TEXT = "The council met on Monday to talk about the new bridge, which has been planned for many years and will cost more than thought."


def labels(page):
    """Each block's text, the sign of its own score, and its label."""
    blocks = maintext.blocks_of(page)
    marked = any(b.where.inside_content and not b.where.boiler for b in blocks)
    scores = [maintext.score(b, marked) for b in blocks]
    return [(b.text, s > 0, x) for b, s, x in zip(blocks, scores, maintext.min_cut(scores, maintext.edges_of(blocks)))]


def test_the_cut_takes_a_short_line_between_paragraphs_as_content():
    found = labels(f"<div><p>{TEXT}</p><p>{TEXT}</p><p>Few objected</p><p>{TEXT}</p><p>{TEXT}</p></div>")
    assert [x for x in found if x[1] != x[2]] == [("Few objected", False, True)]


def test_the_cut_takes_a_sentence_among_links_as_boilerplate():
    link = "<li><a href=/x>Weather and traffic of today</a></li>"
    found = labels(f"<div><ul>{link * 3}<li>All you need to know.</li>{link * 3}</ul></div><div><p>{TEXT}</p><p>{TEXT}</p></div>")
    assert [x for x in found if x[1] != x[2]] == [("All you need to know.", True, False)]
    assert [t for t, _, x in found if x] == [TEXT, TEXT]
