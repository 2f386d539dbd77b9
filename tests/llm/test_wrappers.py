import json
import random
import re

import pytest

from tidemark.llm import wrappers as W


def page(title, *paragraphs, nav=3):
    items = "".join(f"<li><a href=/{i}>m{i}</a></li>" for i in range(nav))
    body = "".join(f"<p>{p}" for p in paragraphs)
    return f"<!DOCTYPE html><html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul>{items}</ul></nav><div class='ad'>buy</div><article><h1>{title}</h1>{body}</article><footer>f</footer></body></html>"


def learned_from(*sources):
    whole = None
    for source in sources:
        tree = W.fold(W.Page(source, True).tree)
        whole = tree if whole is None else W.align(whole, tree)
    return whole


def text_of(source, wrapper):
    kinds, p = {}, W.Page(source, False)
    W.match(W.fold(p.tree), wrapper, kinds)
    return p.main_text(kinds)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (page("T&amp;x", "one<b>two</b>", "three<br>four"), "T&x onetwo three four"),
        ("<article><p>a<p>b<!-- c --></article>", "a b"),
        ("<article>x <script>bad</article>", "x"),
        ("<main><p>in the middle of it</p><aside>no</aside><div class='reader-comments'>no</div><form>no</form></main><p>out</p>", None),
        ("<main><p>in the middle</p><p>of it</p><aside>no</aside><div class='post-comments'>no</div><form>no</form></main><p>out</p>", "in the middle of it"),
        ("<article><header><h1>T</h1></header><p>x &nbsp; y</p></article>", "T x y"),
        ("<p>only &lt;text&gt;</p>", "only <text>"),
        ("<article><p title='a>b'>q</p><p class=x \">z</p></article>", "q z"),
        ("<article><p>a long enough text</p><article><p>a reader's</p></article></article>", "a long enough text"),
        ("<article><p>price</p><div class='share-price'>one</div><div class='comment-worthy discussion'>two</div><math>x</math><svg><text>y</text></svg></article>", "price one two x y"),
        ("no markup < at all", "no markup < at all"),
        ("", ""),
        (None, ""),
        ("<nav>menu</nav>", ""),
    ],
)
def test_one_page(source, text):
    if text is not None:
        assert text_of(source, W.decide(learned_from(source))) == text


@pytest.mark.parametrize("depth", [3, 70, 79, 80, 81, 200, 3000])
def test_menus_at_any_depth_stay_out(depth):
    source = "<article><p>kept</p>" + "<div>" * depth + "<nav><ul><li>menu</ul></nav><p>deep</p><aside>no</aside>" + "</div>" * depth + "<p>end</p></article>"
    assert text_of(source, W.decide(learned_from(source))) == "kept deep end"


def test_broken_pages_end():
    W.Page("<" * 3000 + "a " * 1000 + '"' * 501, True)
    assert text_of("x " * 500_000, W.decide(learned_from("x " * 500_000))) == "x " * 499_999 + "x"


def test_alignment_infers_groups():
    of = lambda *s: W.expression(learned_from(*s))
    assert of("<ul><li>1<li>2</ul><p>x</p>", "<ul><li>1</ul><div>y</div><p>x</p>") == "<ul>(<li>#</li>)+</ul>(<div>#</div>)?<p>#</p>"
    assert of("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>", "<h2>e</h2><p>f</p>") == "(<h2>#</h2><p>#</p>)+"
    assert of("<p>a</p>", "<p>b</p><p>c</p>") == "(<p>#</p>)+"


def tokens(node):
    inner = "".join(map(tokens, node[3]))
    return "#" if node[0] == "#" else f"<{node[0]}>{inner}</{node[0].split(' ')[0]}>" if node[0] else inner


def accepting(node):
    """The wrapper as a regular expression of the standard library."""
    inner = "".join(map(accepting, node[3]))
    body = "#" if node[0] == "#" else inner if not node[0] or node[0][0] == "(" else re.escape(f"<{node[0]}>") + inner + re.escape(f"</{node[0].split(' ')[0]}>")
    return f"(?:{body}){'*' if node[1] and node[2] else '+' if node[1] else '?' if node[2] else ''}"


def random_markup(draw, depth=0):
    out = []
    for _ in range(draw.randrange(1, 4)):
        tag = draw.choice(["div", "section", "p", "ul", "h2"])
        n = draw.choice([1, 1, 2, 3])
        for _ in range(n):
            out.append(f"<{tag}>{random_markup(draw, depth + 1) if tag in ('div', 'section') and depth < 3 else draw.choice('abc')}</{tag}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_a_wrapper_accepts_every_page_it_is_from(seed):
    draw = random.Random(seed)
    sources = [random_markup(draw) for _ in range(draw.randrange(1, 5))]
    wrapper = learned_from(*sources)
    pattern = re.compile(accepting(wrapper))
    for source in sources:
        assert pattern.fullmatch(tokens(W.Page(source, True).tree)), (source, W.expression(wrapper))
    filled = lambda n: (n[W.STATS][0] if n[W.STATS] else 0) + sum(map(filled, n[W.CHILDREN]))
    assert filled(wrapper) == sum(filled(W.Page(s, True).tree) for s in sources)  # no text is lost from the slots


def test_wide_wrappers_are_narrowed_without_loss():
    sources = [f"<div class=c{chr(97 + i // 26)}{chr(97 + i % 26)}>text {i}</div><p>body {i} {'x' * 40}</p>" for i in range(500)]
    wrapper = learned_from(*sources)
    assert len(wrapper[W.CHILDREN]) <= W.WIDE + 1
    filled = lambda n: (n[W.STATS][0] if n[W.STATS] else 0) + sum(map(filled, n[W.CHILDREN]))
    assert filled(wrapper) == 1000
    decided = W.decide(wrapper)
    assert all(f"body {i}" in text_of(s, decided) for i, s in enumerate(sources))


def scrambled(source, word):
    return re.sub(r"class=\"([a-z]+)\"", lambda m: f'class="{word(m[1])}"', source)


def test_articles_come_out_whatever_the_classes():
    draw = random.Random(3)
    words = lambda n: " ".join(draw.choice("one two three four five six seven".split()) + str(draw.randrange(10**6)) for _ in range(n))
    names = {}
    other = lambda w: names.setdefault(w, "".join(draw.choice("bcdfg") for _ in range(8)))
    bodies, pages = [], []
    for i in range(40):
        parts = [words(30) for _ in range(1 + i % 5)]
        inner = f"<h1>{words(5)}</h1>" + "".join(f"<p>{p}</p>" for p in parts) + "<div class=\"cookie\">We use cookies on this site</div>"
        links = "".join(f"<li><a href=x>{words(2)}</a></li>" for _ in range(4))
        pages.append(f'<body><div class="menu"><ul>{links}</ul></div><div class="ad">{["buy this now", "and that"][i % 2]}</div><div class="content">{inner}<ul>{links}</ul></div><div class="bottom">About us</div></body>')
        bodies.append(re.sub("<[^>]*>", " ", inner.split("<div")[0]).split())
    for make in (lambda w: w, other, lambda w: {"content": "comments", "menu": "story", "ad": "entry"}.get(w, w)):
        own = [scrambled(p, make) for p in pages]
        decided = W.decide(learned_from(*own))
        for source, body in zip(own, bodies, strict=True):
            assert text_of(source, decided).split() == body


def test_extract(spark):
    rows = [(i, f"http://H.example/{i}", page(f"T{i}", *[f"p{k} of {i}" for k in range(1 + i % 4)], nav=2 + i % 3), "c") for i in range(12)]
    rows += [(100, "http://two.example/", "<body><div>Brand</div><p>text %d</p></body>" % i, "c") for i in range(4)]
    rows += [(200, None, None, "c"), (201, "nohost", "", "c"), (3, rows[3][1], rows[3][2], "c"), (None, "http://h.example/x", page("N"), "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string")
    learned = W.wrappers(df)
    out = W.extract(df, learned).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    for i in range(12):
        assert set(by[i]) == {" ".join([f"T{i}", *[f"p{k} of {i}" for k in range(1 + i % 4)]])}
    assert sorted(by[100]) == [f"text {i}" for i in range(4)]  # the same text on every page of a host is template
    assert by[200] == by[201] == [""] and by[None] == ["N"] and len(by[3]) == 2
    regex = {r.host: r.expression for r in learned.collect()}
    assert "(<li>#</li>)+" in regex["h.example"] and "(<p>#</p>)" in regex["h.example"]
    assert W.extract(df.limit(0), W.wrappers(df.limit(0))).count() == 0
    # the text comes through the wrapper alone
    blank = learned.withColumn("wrapper", W.F.lit(json.dumps(["", 0, 0, [], 0])))
    assert {r.text for r in W.extract(df, blank).collect()} == {""}
    assert {r.text for r in W.extract(df, learned.limit(0)).collect()} == {""}


def article(i):
    return (
        f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title {i}</h1><div>Summary</div><blockquote>The same motto.</blockquote>"
        f"<p>Words of page {i} that no other page has, {i * 7919}.</p><ul>{''.join(f'<li><a href=/r{k}>Reference {k}</a>' for k in range(4))}</ul></article><footer>Imprint</footer></body></html>"
    )


def test_a_text_does_not_depend_on_the_number_of_neighbours():
    """Texts of an article that all pages share, and its list of references, stay with any number of pages."""
    want = "Title 0 Summary The same motto. Words of page 0 that no other page has, 0. Reference 0 Reference 1 Reference 2 Reference 3"
    for pages in ([0], [0, 1, 2], [0, 1, 2, 3], [0, 0, 0, 0], list(range(12))):
        assert text_of(article(0), W.decide(learned_from(*map(article, pages)))) == want
