import random
from itertools import pairwise

from quillgrid.operators import boxes, collapse, restore


def slug(name):
    return "".join(c for c in name.lower() if c not in " _-./\t\n")


def brute_collapse(items):
    """items: (name, values) in order -> {name: dimension}."""
    groups = []
    for name, values in items:
        own = {v.lower() for v in values}
        for g in groups:
            both = len(own & g[2])
            if slug(name) == g[0] or (both and (both >= 0.85 * len(own | g[2]) or both >= 0.9 * min(len(own), len(g[2])))):
                g[1].append(name)
                g[2] |= own
                break
        else:
            groups.append([slug(name), [name], own])
    return {n: min(g[1], key=lambda x: (len(x), x.lower(), x)) for g in groups for n in g[1]}


def entries(spark, scopes):
    rows = [(s, k, name, i, v, f"c{v}", f"{name}:{v}") for s, items in scopes.items() for k, (name, values) in enumerate(items) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "scope string, ord int, name string, place int, value string, code string, definition string")


def test_collapse_depends_on_order_as_sets_grow(spark):
    a, b, c = [str(i) for i in range(10)], [str(i) for i in range(1, 11)], [str(i) for i in range(2, 12)]
    scopes = {
        "chain": [("first set", a), ("second", b), ("third", c), ("apart", ["x", "y"])],
        "turned": [("third", c), ("first set", a), ("second", b), ("Ap-art", ["x"]), ("ap art", ["z"])],
        "case": [("A", ["Yes", "No"]), ("B", ["YES", "no", " "])],
    }
    rng = random.Random(4)
    scopes |= {f"r{k}": [(f"n{i:02d}"[: rng.randint(2, 3)] + str(i), rng.sample("abcdefgh", rng.randint(1, 7))) for i in range(25)] for k in range(8)}
    got = {}
    for r in collapse.collapsed_names(entries(spark, scopes)).collect():
        got.setdefault(r.scope, {})[r.name] = r.dimension
    assert got == {s: brute_collapse([(n, [v for v in vs if v.strip()]) for n, vs in items]) for s, items in scopes.items()}
    assert got["chain"]["third"] == "third" and len(set(got["chain"].values())) == 2


def test_collapsed_entries_keep_the_first_of_each_value(spark):
    scopes = {"s": [("long name", ["A", "b"]), ("nm", ["a", "B", "c"])]}
    got = [(r.dimension, r.place, r.value, r.definition) for r in collapse.collapse(entries(spark, scopes)).orderBy("place").collect()]
    assert got == [("nm", 0, "A", "long name:A"), ("nm", 1, "b", "long name:b"), ("nm", 2, "c", "nm:c")]
    assert collapse.collapse(entries(spark, {})).count() == 0


def overlap(a, b):
    if None in (*a, *b):
        return 0.0, 0.0
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    if not both:
        return 0.0, 0.0
    areas = [(x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)]
    return both / (sum(areas) - both), both / min(areas)


def brute_dedupe(found):
    rank = {m: i for i, m in enumerate(boxes.METHODS)}

    def score(c):
        return (0, 0, 0) if not c[6] or not c[7] else (c[7], c[6] * c[7], max(0, 3 - rank.get(c[1], 9)))

    def same(a, b):
        iou, small = overlap(a[2:6], b[2:6])
        return iou >= 0.55 or small >= 0.65

    kept = []
    for c in sorted(found, key=lambda c: (rank.get(c[1], 9), c[3] or 0, c[0])):
        rivals = [k for k in kept if same(c, k)]
        if not rivals:
            kept.append(c)
        elif not (c[1] == "text" and any((k[1] or "").startswith("lines") for k in rivals)):
            (w, n, _), (w0, n0, _) = score(c), max(map(score, rivals))
            if (w >= w0 + 3 and n > n0) or (w > w0 and n >= max(2 * n0, n0 + 20)) or (w == w0 and n >= 2 * n0 + 10):
                kept = [k for k in kept if k not in rivals] + [c]
    return [c[0] for c in sorted(kept, key=lambda c: (c[3] or 0, rank.get(c[1], 9), c[0]))]


BOX = "page int, id int, method string, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int"


def some_boxes(rng, n):
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(0, 300), rng.uniform(0, 300), rng.choice([3, 40, 90, 250]), rng.choice([2, 30, 80, 260])
        out.append((i, rng.choice([*boxes.METHODS, "other"]), x, y, x + w * rng.uniform(0.8, 1), y + h, rng.randint(0, 30), rng.randint(0, 9)))
    return out


def test_candidates_equal_one_by_one_processing(spark):
    rng = random.Random(2)
    pages = {p: some_boxes(rng, n) for p, n in enumerate([0, 1, 12, 40, 80, 80])}
    pages[9] = [(0, "text", None, None, None, None, 3, 3), (1, "lines", None, 5.0, 2.0, 9.0, 4, 4), (2, None, 0.0, 0.0, 0.0, 0.0, 1, 1)]
    pages[10] = [(i, "lines", 10.0, 10.0, 50.0, 50.0, 5, 5) for i in range(30)]  # one table many times
    df = spark.createDataFrame([(p, *c) for p, own in pages.items() for c in own], BOX)
    got = {}
    for r in boxes.deduped(df, "page", "id").orderBy("page", "place").collect():
        got.setdefault(r.page, []).append(r.id)
    assert got == {p: brute_dedupe(own) for p, own in pages.items() if own}


def test_tiles_meet_every_overlapping_pair_once(spark):
    rng = random.Random(3)
    own = some_boxes(rng, 150) + [(200, "text", -50.0, -50.0, 900.0, 900.0, 1, 1), (201, "text", -0.5, -0.5, 0.25, 0.25, 1, 1)]
    got = sorted((r.a, r.b, round(r.iou, 9)) for r in boxes.overlapping(spark.createDataFrame([(1, *c) for c in own], BOX), "page", "id").collect())
    want = sorted((min(a[0], b[0]), max(a[0], b[0]), round(overlap(a[2:6], b[2:6])[0], 9)) for k, a in enumerate(own) for b in own[:k] if overlap(a[2:6], b[2:6])[0] > 0)
    assert got == want and all(x[:2] != y[:2] for x, y in pairwise(got))
    assert boxes.deduped(spark.createDataFrame([], BOX), "page", "id").count() == 0


def grid(spark, units):
    return spark.createDataFrame([(u, i, r) for u, rows in units.items() for i, r in enumerate(rows)], "unit string, row int, cells array<string>")


def test_rows_come_back_at_start_middle_and_end(spark):
    whole = [["(1)", "(2)", "(3)"], ["2001", "10", "20"], ["", "(10.6)", "(13.6)"], ["2011", "30", "40"], ["", "(1.5)", "(2.5)"], ["note", "", ""]]
    lost = {"middle": [whole[1], whole[3]], "start": whole[3:5], "none": whole, "narrow": [["2001"]], "extra": [["new", "1", "2"], ["2011", "31", "41"]], "same": [["2001", "10", "20"]] * 2}
    got = {}
    for r in restore.restored(grid(spark, lost), grid(spark, {u: whole for u in lost}), "unit").orderBy("unit", "row").collect():
        got.setdefault(r.unit, []).append(([c or "" for c in r.cells], r.source))
    k, b = "kept", "restored"
    assert got["middle"] == [(whole[0], b), (whole[1], k), (whole[2], b), (whole[3], k), (whole[4], b)]
    assert got["start"] == [(whole[0], b), (whole[1], b), (whole[2], b), (whole[3], k), (whole[4], k)]
    assert got["none"] == [(r, k) for r in whole] and got["narrow"] == [(["2001"], k)]
    assert got["extra"] == [(whole[0], b), (whole[1], b), (whole[2], b), (["2011", "31", "41"], k), (whole[4], b), (["new", "1", "2"], k)]
    assert got["same"] == [(whole[0], b), (whole[1], k), (whole[2], b), (whole[3], b), (whole[4], b), (whole[1], k)]


def test_alignment_by_place_key_or_neither(spark):
    cand = {"equal": [["a"], ["b"]], "keyed": [["x"], ["A "], ["b"]], "placed": [["p"], ["q"], ["r"]], "longer": [["p"]]}
    mine = {"equal": [["b"], ["a"]], "keyed": [["a"], ["b"]], "placed": [["z"], ["y"]], "longer": [["s"], ["t"]], "alone": [["u"]]}
    got = {}
    for r in restore.aligned(grid(spark, mine), grid(spark, cand), "unit").orderBy("unit", "row").collect():
        got.setdefault(r.unit, []).append(r.candidate_row)
    assert got == {"equal": [0, 1], "keyed": [1, 2], "placed": [0, 1], "longer": [0, None], "alone": [None]}


def test_few_boxes_on_a_page_need_no_components(spark, monkeypatch):
    from quillgrid.operators import boxes

    def never(*_):
        raise AssertionError("components were asked for")

    monkeypatch.setattr(boxes, "components", never)
    form = "page int, box int, method string, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int"
    frame = spark.createDataFrame([(1, 1, "lines", 0.0, 0.0, 10.0, 10.0, 3, 3), (1, 2, "text", 1.0, 1.0, 10.0, 10.0, 9, 9), (1, 3, "text", 20.0, 0.0, 30.0, 10.0, 2, 2), (2, 4, "text", 0.0, 0.0, 10.0, 10.0, 2, 2)], form)
    assert sorted((r.page, r.box, r.place) for r in boxes.deduped(frame, "page", "box").collect()) == [(1, 1, 0), (1, 3, 1), (2, 4, 0)]


def test_many_boxes_on_a_page_meet_as_few_do(spark, monkeypatch):
    from quillgrid.operators import boxes

    form = "page int, box int, method string, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int"
    rows = [(p, k, boxes.METHODS[k % 3], float(k * 7 % 40), float(k * 5 % 30), float(k * 7 % 40 + 6 + k % 9), float(k * 5 % 30 + 4 + k % 7), k % 6, k % 5) for p, n in ((1, 40), (2, 12)) for k in range(n)]
    frame = spark.createDataFrame(rows, form)
    few = [sorted(map(tuple, f(frame, "page", "box").collect())) for f in (boxes.deduped, boxes.overlapping)]
    monkeypatch.setattr(boxes, "FEW", 20)
    assert [sorted(map(tuple, f(frame, "page", "box").collect())) for f in (boxes.deduped, boxes.overlapping)] == few
