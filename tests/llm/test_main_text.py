import numpy as np
import pytest
from conftest import SF001, SF01

from tensio.llm import labeller, main_text, queries
from tensio.llm.html_blocks import blocks


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a <b>bold</b>\n\t x&amp;y &lt;z&gt;<p>next<br>line</p> tail") == ["a bold x&y <z>", "next line", "tail"]
    assert texts("<!-- <p>no</p> --><script>var a='<p>no</p>';</script><style>p{}</style>yes<noscript>no</noscript>") == ["yes"]
    assert texts('<div title="a>b">in</div><li>one<li>two') == ["in", "one", "two"]
    assert texts("cut <b>off<p>here <a href='x") == ["cut off", "here"]
    assert texts("1 < 2 & 3 &nbsp; &am") == ["1 < 2 & 3 &am"]
    assert texts("") == texts("<p> \n</p>") == texts("<script>never closed <p>x</p>") == []
    assert blocks("<div class='a b-c'><nav id=top><a href=u>go</a></nav></div>")[0].path == (("div", "a", "b", "c"), ("nav", "top"))


def test_gradients_of_both_directions():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 5])
    x, y = rng.normal(size=(9, labeller.WIDTH)).astype(np.float32) * 0.3, rng.integers(0, 2, 9).astype(np.float32)
    p = {k: v.astype(np.float64) for k, v in labeller.blank().items()}

    def loss():
        q = labeller._forward(p, x, sizes)[0]
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    prob, _, passes, grids = labeller._forward(p, x, sizes)
    dboth = ((prob - y) / len(y))[:, None] * p["w"]
    for j, d in enumerate("fb"):
        dh = np.zeros((*grids[2].shape, labeller.HIDDEN))
        dh[grids[2]] = dboth[grids[j][grids[2]], j * labeller.HIDDEN : (j + 1) * labeller.HIDDEN]
        _, dwh = labeller._read_back(passes[j], p["h" + d], dh)
        for at in [(0, 0), (3, 25), (7, 50), (19, 79)]:
            old, step = p["h" + d][at], 1e-3
            p["h" + d][at] = old + step
            up = loss()
            p["h" + d][at] = old - step
            down = loss()
            p["h" + d][at] = old
            assert abs((up - down) / (2 * step) - dwh[at]) < 2e-4


def test_query_takes_the_article(spark):
    """The labeller against the page's own markup, which the test pages state."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    rows = queries.op4_html_extraction(spark, SF001).collect()
    assert len(rows) == len(pages)
    good = 0
    for r in rows:
        found = blocks(pages[r.page_id])
        good += r.text == "\n".join(b.text for b, y in zip(found, main_text.teach(found), strict=True) if y)
        assert r.n_chars == len(r.text)
    assert good >= 0.97 * len(rows)


def test_unseen_pages_and_layouts(spark):
    html = [r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").orderBy("page_id").collect()]
    model = main_text.fit(html[:100])
    paragraphs = [b.text for p in html[100:130] for b in blocks(p) if len(b.text) > 150]
    around = "<body><header><h2>Site</h2></header><nav><a href=x>Home</a></nav><div class='cookie-notice'><p>{0}</p></div>{1}<div class='sidebar'><p>{2}</p></div><section id='comments'><p>{3}</p></section><footer>{0}</footer>"
    good = total = 0
    for frame in ("<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>'):
        for k in range(0, len(paragraphs) - 6, 6):
            own = paragraphs[k : k + 3]
            page = around.format(paragraphs[k + 3][:90], frame.format("".join(f"<p>{t}</p>" for t in own)), paragraphs[k + 4], paragraphs[k + 5])
            total += 1
            good += main_text.extract([blocks(page)], model, {}) == ["\n".join(own)]
    assert total > 10 and good >= 0.9 * total


def test_edges(spark):
    rows = [(1, None, "u", "x"), (2, "", "u", "x"), (3, "plain text", "u", "x"), (3, "plain text", "u", "x"), (None, "<article><p>" + "long words " * 50_000 + "</p>", None, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, `c0.a` string")
    model = main_text.train(df)
    got = main_text.with_main_text(df, model).collect()
    assert len(got) == 5 and [r.text for r in got if r.page_id in (1, 2)] == ["", ""] and got[0]["c0.a"] == "x"
    assert main_text.with_main_text(df.where("false"), main_text.train(df.where("false"))).collect() == []


def test_fit_takes_distinct_pages_and_always_learns(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(main_text, "fit", lambda pages: fitted.append(sorted(pages)) or labeller.blank())
    page = "<article><p>page {} of some words</p></article>".format
    train = lambda rows, most: main_text.train(spark.createDataFrame([(r,) for r in rows], "html string").repartition(3), most=most)
    train([page(i) for i in range(3) for _ in range(300)], 20)  # copies
    assert fitted.pop() == [page(i) for i in range(3)]
    stubs = [f"<p id=stub{i}></p>" for i in range(300)]
    train([*stubs, *[page(i) + " " * main_text.MAX_FIT_BYTES for i in range(3)], None, ""], 20)  # no small page has text
    assert [p.strip() for p in fitted.pop()] == [page(i) for i in range(3)]
    train([page("x" * main_text.MAX_FIT_BYTES * 2), page("y" * main_text.MAX_FIT_BYTES * 3)], 1)  # long pages only
    assert [len(p) // main_text.MAX_FIT_BYTES for p in fitted.pop()] == [2]
    train(stubs, 20)
    assert not fitted  # no block, nothing to label


def test_no_untrained_fit():
    with pytest.raises(ValueError):
        main_text.fit(["<p></p>"])


def test_hidden_elements_end_where_they_end():
    page = "<html><head><title>t</title><meta charset=x><script>var b = '<p>no</p>'</script>{}<body><article><p>in</p></article></body></html>"
    for end in ("", "</head>"):
        assert texts(page.format(end)) == ["in"] and blocks(page.format(end))[0].path == (("html",), ("body",), ("article",), ("p",))
    assert texts("<head><title>t</title><article><p>in</p></article>") == ["in"]
    assert texts("<p>a<svg viewBox='0 > 1'/>b</p><p>c</p><svg><text>no</text></svg><p>d") == ["ab", "c", "d"]
    for tag in ("svg", "noscript", "iframe", "canvas", "object", "select", "template"):
        assert texts(f"<p>a</p><{tag} id=x><p>b</p><{tag}>no</{tag}><p>c") == ["a", "b", "c"]
        assert texts(f"<p>a<{tag}>no<{tag}>no</{tag}>no</{tag} >b</p></{tag}>c") == ["ab", "c"]
    assert texts("<p>if <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow></math> then</p>") == ["if x=1 then"]
    assert texts("a<math/>b") == ["ab"]
    for tag in ("script", "style", "title", "textarea"):
        assert texts(f"a<{tag}>no<p>no") == ["a"]


def test_deep_pages_take_room_in_proportion():
    """Every element opens inside the one before it: paths share their elements."""
    import tracemalloc

    from tensio.llm.labeller import _path_features

    peak = {}
    for n in (2_000, 8_000):
        tracemalloc.start()
        page = blocks("<div class=a>x" * n + "</p>" * n + "<p>y</div>" * 3)
        assert len(page) == n + 3 and len(page[n - 1].path) == n and page[1].path == (("div", "a"), ("div", "a"))
        rows = [_path_features(b.path).sum() for b in page[:: n // 10]]
        assert len(set(rows)) <= 2
        peak[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak[8_000] < 6 * peak[2_000]
    same = blocks("<div><p>a</p></div><div><p>b</p></div>")
    assert same[0].path == same[1].path and hash(same[0].path) == hash(same[1].path)
    assert (_path_features(same[0].path) == _path_features((("div",), ("p",)))).all()
