"""Wrapper induction: hand-made hosts, the parser, odd rows, the test pages."""

import html
import math
import random
import re

from coweave.llm import wrapper as w

PAGES = "page_id bigint, url string, html string, host string, text int"


def _main(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(3)
    return {r["page_id"]: r for r in w.main_text(df).collect()}


def _page(n, body):
    return (f"<html><head><title>t{n}</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>m{n}</a></nav>"
            f"{body}<footer>&copy; {n}</footer></body></html>")


def test_template_text_inside_the_region_goes(spark):
    rows = []
    for n in range(6):
        body = (f"<div class='wrap k1'><div class='q7'>Read more on our pages!</div><h1>Title</h1>"
                f"<p>First &amp; words {n}.</p><p class=lead>Second <b>bold</b>\n part {n}<br>line</p><ul><li>one {n}<li>two</ul>"
                f"<div class='q8'>Never miss a story.</div></div><div class=ad>Buy {n}</div>"
                f"<section id=comments><p>me too {n}</p></section><form><p>Your name {n}</p></form><script>x='</p>{n}'</script>")
        rows.append((n, f"https://a.example/{n}", _page(n, body)))
    got = _main(spark, rows)
    for n in range(6):
        assert got[n]["text"] == f"Title\nFirst & words {n}.\nSecond bold part {n} line\none {n}\ntwo"
        assert got[n]["n_chars"] == len(got[n]["text"])


def test_article_keeps_what_all_its_pages_say(spark):
    rows = [(n, "http://b.example/x", _page(n, f"<article><h1>Same</h1><p>Shared passage.<p>own {n}</article>")) for n in range(5)]
    assert all(r["text"] == f"Same\nShared passage.\nown {n}" for n, r in _main(spark, rows).items())
    same = [(n, "http://c.example/x", _page(0, "<article><p>All alike</p></article>")) for n in range(5)]
    assert all(r["text"] == "All alike" for r in _main(spark, same).values())


def test_odd_pages(spark):
    rows = [(1, "https://one.example/", _page(1, "<main><p>Only page</main>")), (2, None, None), (3, "no host", ""),
            (4, "https://x.example", "plain text &lt;b&gt; only"), (5, "https://x.example", "<p>cut <b>off"),
            (6, "https://y.example", "<article><!-- c --><p>a < b & c &am &eacute;&#x41;</p><p> </p><aside>side</aside>"),
            (7, "https://y.example", "<body><article><p>x</p></body></html><p>tail</p>"), (8, "u", "<p>" + "word " * 100_000),
            (8, "u", "<div>twice</div>"), (None, "u", "<div hidden>h</div><p aria-hidden='true'>a</p><p>no id"),
            (9, "u", "<" * 50 + "p>x</p>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)
    got = sorted(((r["page_id"], r["text"]) for r in w.main_text(df).collect()), key=str)
    assert len(got) == len(rows)
    text = {k: v for k, v in got if k not in (8, None)}
    assert text[1] == "Only page" and text[2] == text[3] == ""
    assert text[4] == "plain text <b> only" and text[5] == "cut off"
    assert text[6] == "a < b & c &am éA" and text[7] == "x"
    assert text[9].endswith("x")
    assert (8, "twice") in got and (8, ("word " * 100_000).strip()) in got and (None, "no id") in got
    assert w.main_text(df.limit(0)).count() == 0


def _tree(page):
    return w.Tree.of_page(w.parts(w.parse(page)))


def _weight(x, i, y, j):
    """Simple tree matching by its definition, without bounds."""
    if x.label[i] != y.label[j]:
        return 0
    xs, ys = x.children[i], y.children[j]
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for n, c in enumerate(xs, 1):
        for m, d in enumerate(ys, 1):
            best[n][m] = max(best[n - 1][m], best[n][m - 1], best[n - 1][m - 1] + _weight(x, c, y, d))
    return 1 + w.likeness(x, i, y, j) + best[-1][-1]


def _random_page(rnd, depth=0):
    out = ""
    for _ in range(rnd.randint(0, 4 if depth < 3 else 0)):
        tag = rnd.choice(["div", "div", "section", "p class=a", "td"])
        out += f"<{tag}>{rnd.choice(['', 'x', 'y', 'long text'])}{_random_page(rnd, depth + 1)}</{tag.split()[0]}>"
    return out


def test_tree_match_is_the_heaviest_in_order():
    rnd = random.Random(3)
    for _ in range(150):
        x, y = _tree(_random_page(rnd)), _tree(_random_page(rnd))
        partner = w.tree_match(x, y)
        pairs = [(i, j) for j, i in enumerate(partner) if i >= 0]
        assert all(x.label[i] == y.label[j] for i, j in pairs)
        assert all(partner[y.up[j]] == x.up[i] for i, j in pairs if j)          # ancestors
        order = {c: n for n, c in enumerate(n for kids in x.children for n in kids)}
        for kids in y.children:                                                # siblings
            places = [order[partner[d]] for d in kids if partner[d] >= 0]
            assert places == sorted(places)
        assert math.isclose(sum(1 + w.likeness(x, i, y, j) for i, j in pairs), _weight(x, 0, y, 0))


def test_a_template_holds_every_part_once_in_order():
    pages = [_tree(p) for p in (
        "<div class=a>1</div><div class=c>2</div>", "<div class=a>1</div><div class=b>3</div><div class=c>2</div>",
        "<div class=a>1</div><div class=b>3</div><div class=c>9</div><div class=d>4</div>", "<div class=b>5</div><div class=d>4</div>")]
    top = w.fold(pages)
    assert [top.label[i] for i in top.children[0]] == [w._hash(f"div.{c}") for c in "abcd"]
    assert top.text[3] == w._hash("2") and top.text[2] == w._hash("3")    # the most frequent ones
    for page in pages:
        partner = w.tree_match(top, page)
        assert [top.label[i] for i in partner] == page.label
    again = w.Tree.unpack(top.pack())
    assert (again.up, again.label, again.text, again.size) == (top.up, top.label, top.text, top.size)


def test_wide_lists_are_matched_in_order():
    wide = "".join(f"<div class=q>{n}</div>" for n in range(3000))
    x, y = _tree("<div class=box>ad</div>" + wide), _tree(wide)
    assert w.tree_match(x, y)[1:] == list(range(2, 3002))


def test_pages_of_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in df.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip()
                  for x in re.split(r"</?(?:p|h1)>", article))
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    assert {r["page_id"]: r["text"] for r in w.main_text(df).collect()} == want


def _site(host, bodies):
    return [(n, f"https://{host}/{n}", f"<html><body>{b}</body></html>") for n, b in enumerate(bodies)]


def test_siblings_with_one_label(spark):
    story = [f"<p>Story {n} of the day.</p><p>It ends {n * 7}.</p>" for n in range(20)]
    want = {n: f"Story {n} of the day.\nIt ends {n * 7}." for n in range(20)}
    for menu, rest in (("<div><ul><li>Home<li>News</ul></div>", "<div>%s</div>"),
                       ("<div class=container>Home</div>", "<div class=container>%s</div>"),
                       ("", "<table><tr><td>Home</td><td>%s</td></tr></table>")):
        rows = _site("s.example", [menu + rest % s for s in story])
        assert {n: r["text"] for n, r in _main(spark, rows).items()} == want


def test_article_split_over_siblings(spark):
    rows = _site("split.example", [f"<div>Home</div><div><p>{f'first {n} ' * 11}</p></div><div><p>{f'other {n} ' * 9}</p></div>"
                                   f"<p>Seen {n} times</p><div>Imprint</div>" for n in range(15)])
    for n, r in _main(spark, rows).items():
        text = r["text"].split("\n")
        assert (f"first {n} " * 11).strip() in text and (f"other {n} " * 9).strip() in text and f"Seen {n} times" in text
    rows = _site("long.example", [f"<div>Home</div><div><p>{f'first {n} ' * 95}</p></div><section><p>last {n}</p></section>"
                                  f"<div>Imprint</div>" for n in range(15)])
    assert {n: r["text"] for n, r in _main(spark, rows).items()} == {
        n: (f"first {n} " * 95).strip() + f"\nlast {n}" for n in range(15)}


def test_linked_and_optional_blocks_stay(spark):
    bodies = [f"<div class=box><h1 class=entry-title><a href=x>Headline {n}</a></h1><p>Words {n}</p>"
              f"<ul><li class=ref><abbr>R{n}</abbr></ul><div class=note>{f'Note {n}' if n % 4 == 0 else ''}</div>"
              f"<div class=q>{'Read on' if n % 2 else ''}</div></div>" for n in range(12)]
    for n, r in _main(spark, _site("link.example", bodies)).items():
        note = f"\nNote {n}" if n % 4 == 0 else ""
        assert r["text"] == f"Headline {n}\nWords {n}\nR{n}{note}"


def test_every_page_of_a_host_counts(spark):
    # a layout of 5 %, and a block that differs on one page of 400 only
    bodies = [f"<div class=k><div class=q>{'Corrected: see below' if n == 399 else 'By the editors'}</div><p>Story {n}</p></div>"
              if n % 20 else f"<div>Menu</div><div class=wide><p>Report {n}</p><div class=z>Print this</div></div>"
              for n in range(400)]
    got = _main(spark, _site("hot.example", bodies))
    assert len(got) == 400
    for n, r in got.items():
        line = "Corrected: see below" if n == 399 else "By the editors"
        assert r["text"] == (f"{line}\nStory {n}" if n % 20 else f"Report {n}")


def test_deeply_nested_pages(spark):
    deep = 100_000
    tags = ["<div>", "<span>", "<font>", "<ul>", "<b></i>", "<div class=x>", "<ul><li>", "<blockquote></p>"]
    rows = [(n, "https://deep.example/", "<body><p>Top</p>" + tag * deep + f"end {n}") for n, tag in enumerate(tags)]
    rows += [(n, "https://deep.example/", f"<body><p>Top</p><div>flat {n}</div>") for n in range(20, 24)]
    got = _main(spark, rows)
    assert len(got) == len(rows) and all(r["text"].endswith(f"end {n}" if n < 20 else f"flat {n}") for n, r in got.items())
    top = w.fold([_tree("<div>" * deep + str(n)) for n in range(2)])
    assert len(top.up) == deep + 1 and top.size[-1] == 1
    assert w.tree_match(top, _tree("<div>" * deep))[-1] == deep


def _story(n):
    return f"<p>Story {n} of the day, told in {n * 7} words.</p><p>It ends {n * 3}.</p>"


def _told(n):
    return f"Story {n} of the day, told in {n * 7} words.\nIt ends {n * 3}."


def test_optional_boxes_before_the_story(spark):
    """No article element, no telling name: what repeats on some pages only
    shifts its siblings, and must not be put out nor keep the story back."""
    box, line = "<div><p>Sign up for our weekly letter and never miss a story again.</p></div>", "<div>Copyright of the house</div>"
    for pages in (6, 40):
        bodies = [(box if n % 2 else "") + f"<div>{_story(n)}</div>" + line for n in range(pages)]
        rows = _site("shift.example", bodies)
        got = _main(spark, rows)
        assert {n: r["text"] for n, r in got.items()} == {n: _told(n) for n in range(pages)}
        # the wrapper decides: alone, a page is put out whole
        assert all(w.extract(html) != _told(n) for n, _, html in rows)


def test_several_boxes_and_layouts_of_one_host(spark):
    boxes = ["<div>Breaking: follow the live blog</div>", "<div><p>Our shop has new books and maps</p></div>"]
    bodies, want = [], {}
    for n in range(120):
        start = "".join(b for k, b in enumerate(boxes) if n >> k & 1)
        if n % 5 == 0:                      # a layout of its own
            bodies.append(f"<table><tr><td>Archive</td><td>{_story(n)}</td></tr></table><div>Imprint</div>")
        else:
            bodies.append(f"<div>{start}<div>{_story(n)}</div><div>Imprint and contact</div></div>")
        want[n] = _told(n)
    got = _main(spark, _site("mixed.example", bodies))
    assert {n: r["text"] for n, r in got.items()} == want


def test_attributes_are_read_by_name_and_value():
    keep = ['<div style="overflow: hidden"><p>a b</p></div>', '<div data-id="menu"><p>a b', '<div id="content" class="no-sidebar"><p>a b',
            '<div class="has-sidebar">a b', '<section class="share-prices">a b', '<div class="related-work"><p>a b',
            '<h2 class="section-header">a b</h2>', '<p class="drop-header">a b', "<div title='class=ad'>a b", '<div class=x data-class="ad">a b',
            '<p>a <a href="/hidden/path" title="role=menu">b</a>', '<p>a <em title="hidden">b</em>', '<div class="widget"><p>a b</p></div>',
            '<div CLASS = "x" class="ad">a b']
    assert [w.extract(f"<body>{h}") for h in keep] == ["a b"] * len(keep)
    words = "<p>long enough to be left</p>"
    drop = ["<div hidden>n</div>", "<div HIDDEN=''>n</div>", "<div class='x ad y'>n</div>", "<div id=sidebar>n</div>", "<p role=navigation>n</p>",
            "<div class=Comments>n</div>", "<nav>n</nav>", "<div aria-hidden='true'>n</div>", "<div class=cookie-banner>n</div>"]
    assert [w.extract(f"<body>{words}{h}") for h in drop] == ["long enough to be left"] * len(drop)
    assert w.extract("<p>for <math><mi>x</mi><mo>=</mo><mn>1</mn></math> we get") == "for x=1 we get"


def test_a_page_is_not_lost_to_one_word_in_a_class(spark):
    bodies = [f"<div>Home</div><div class='widget'>{_story(n)}</div><div>Imprint</div>" for n in range(12)]
    assert {n: r["text"] for n, r in _main(spark, _site("name.example", bodies)).items()} == {n: _told(n) for n in range(12)}


def _word(n):
    return "".join("abcdefghij"[int(d)] for d in f"{n:03}")


def test_every_layout_of_a_host_is_in_its_template(spark):
    bodies = [f"<div class=l{_word(n % 130)}><p>Story {n} of many</p><div class=b{_word(n % 130)}>Print this</div></div>"
              for n in range(520)]
    got = _main(spark, _site("many.example", bodies))
    assert {r["text"] for r in got.values()} == {f"Story {n} of many" for n in range(520)} and len(got) == 520


def test_large_pages_are_in_the_template(spark):
    rows = lambda n: "".join(f"<div class=r>Row {i} of {n}</div>" for i in range(2100))
    got = _main(spark, _site("large.example", [f"<div class=box>Print this</div><div class=t>{rows(n)}</div>" for n in range(4)]))
    for n, r in got.items():
        assert r["text"].split("\n") == [f"Row {i} of {n}" for i in range(2100)]


def test_templates_folded_in_rounds(spark):
    # every page has one of 12 boxes; a class of its own is on too few pages to count
    pages = [f"<div class=k><div class=b{_word(n % 12)}>Box</div><p>Story {n}</p><i></i><div class=x{_word(n)}>X</div></div>"
             for n in range(60)]
    df = spark.createDataFrame([(n, f"https://a.example/{n}", p) for n, p in enumerate(pages)], "page_id long, url string, html string")
    found = []
    for parts in (1, 5):
        trees = w._with_host(df.repartition(parts)).select("host", "html").mapInArrow(
            w._trees, "host string, paths array<bigint>, tree binary")
        (row,) = w.templates(trees, fold_trees=3).collect()
        found.append(row["template"])
    assert found[0] == found[1]
    top = w.Tree.unpack(found[0])
    boxes = {w._hash(f"div.b{_word(n)}") for n in range(12)}
    assert boxes <= set(top.label) <= boxes | {w._hash("#"), w._hash("div.k")}


def test_merged_templates_keep_frequent_texts():
    trees = [_tree(f"<div class=a>{'same' if n % 3 == 0 else n}</div>") for n in range(90)]
    some = [w.Partial.unpack(w.merged([w.Partial.of_page(t) for t in trees[n:n + 10]]).thinned().pack())
            for n in range(0, 90, 10)]
    top = w.merged(some)
    assert top.tree.text[1] == w._hash("same") and top.sizes[1][1] == 90


def test_every_pair_of_parts_is_weighed(monkeypatch):
    """Long lists and many pairs, too: a box that one page has shifts nothing."""
    box = "<div>Sign up</div>"
    wide = "".join(f"<div>Line {n}</div>" for n in range(60))
    assert w.tree_match(_tree(wide), _tree(box + wide)) == [0, -1, *range(1, 61)]
    cells = lambda n: "".join(f"<div>{n} {k}</div>" for k in range(20))
    many = "".join(f"<section>{cells(n)}</section>" for n in range(24))        # 230,976 pairs
    x, y = _tree(many), _tree(f"<section>{box}</section>" + many.replace("<section>", f"<section>{box}"))
    for kept in (w.KEPT_PAIRS, 5_000):
        monkeypatch.setattr(w, "KEPT_PAIRS", kept)
        partner = w.tree_match(x, y)
        assert [y.text[j] for j, i in enumerate(partner) if i < 0] == [0] + [w._hash("Sign up")] * 25
        assert all(x.text[i] == y.text[j] for j, i in enumerate(partner) if i >= 0)


def test_all_ways_of_weighing_give_one_match(monkeypatch):
    rnd = random.Random(4)
    for _ in range(60):
        some = w.Partial.of_page(_tree(_random_page(rnd)))
        some.add(w.Partial.of_page(_tree(_random_page(rnd))))
        y, found = _tree(_random_page(rnd)), []
        for listed, kept in ((10**6, 0), (0, 10**6), (0, 0), (20, 60)):
            monkeypatch.setattr(w, "LISTED_PAIRS", listed)
            monkeypatch.setattr(w, "MOST_LISTED", 0)
            monkeypatch.setattr(w, "KEPT_PAIRS", kept)
            found.append(w.tree_match(some.tree, y))
        assert all(f == found[0] for f in found)
