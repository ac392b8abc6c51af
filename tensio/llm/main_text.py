"""Main text of web pages: a recurrent block labeller trained on pages of the table itself.

The labeller (``labeller.py``) learns from at most ``MAX_FIT_PAGES`` pages.  Their blocks are
labelled by a teacher that reads the page's own markup: main text is what lies in the page's
``article`` or ``main`` element and under no element named for something else.  Each page is
learnt in several variants: with the main element under other names, and with menus,
notices, forms, adverts, sidebars and reader comments put around and into it, so that the
labeller also knows pages whose markup says less than the sampled ones.
"""

from __future__ import annotations

import random
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensio.llm import labeller
from tensio.llm.batches import with_results
from tensio.llm.html_blocks import Block, blocks
from tensio.operators.partitioning import share

#: Distinct pages that the fit takes at most (the first by a hash of their html), and their largest
#: size where there are shorter ones.
MAX_FIT_PAGES = 200
MAX_FIT_BYTES = 60_000
VARIANTS = 5

#: Elements and names of what is not main text, and names of what is.
_OTHER_TAGS = ["nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "address"]
_OTHER_NAMES = """ad ads adv advert advertisement banner billboard breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie cookies copyright
    disclaimer discussion disqus donate feedback footer form gdpr header legal links login masthead menu modal nav navbar navigation newsletter notice notification
    pagination pager paywall popup privacy promo promoted promotion rail recommended register related replies reply respond responses search share sharing
    sidebar signup skip social sponsor sponsored subscribe tags teaser toc toolbar topbar tracking trending warning widget widgets""".split()
_MAIN_NAMES = "content article main post entry story body text".split()
_FRAMES = "layout container wrapper wrap row col column inner outer site grid box left right center block area region".split()
_FREQUENT = "ad advert banner comment comments cookie footer form header menu nav newsletter notice popup promo related reply share sidebar subscribe".split()
_OTHER = frozenset(_OTHER_TAGS) | frozenset(_OTHER_NAMES)
_MAIN = frozenset(["article", "main"])


def teach(page: list[Block]) -> list[int]:
    """1 for each block in an ``article`` or ``main`` (on a page without: anywhere) that lies under
    no element whose tag or name says otherwise."""
    framed = any(e[0] in _MAIN for b in page for e in b.path)
    out = []
    for b in page:
        inside = not framed or any(e[0] in _MAIN for e in b.path)
        names = {n for e in b.path for n in e}
        article = [i for i, e in enumerate(b.path) if e[0] in _MAIN]
        # A header inside the article (its headline) is part of it.
        if article and names & _OTHER <= {"header"} and any(e[0] == "header" for e in b.path[article[0] :]):
            names -= {"header"}
        out.append(int(inside and not names & _OTHER))
    return out


def _renamed(path: tuple, name: tuple | None, frame: tuple) -> tuple:
    """The path with its main element under another name (``None``: left out), in a frame."""
    out = []
    for e in path:
        if e[0] in _MAIN:
            out += frame
            if name is not None:
                out.append(name)
        else:
            out.append(e)
    return tuple(out)


def _variant(page: list[Block], labels: list[int], spare: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """The page with its main element renamed and blocks of other kinds put before, into and after it."""
    choice = rng.random()
    name = None if choice < 0.1 else ("main",) if choice < 0.3 else ("section", rng.choice(_MAIN_NAMES)) if choice < 0.4 else ("div", *rng.sample(_MAIN_NAMES, rng.randint(1, 2)))
    inner = name if name is not None else ("div",)
    frame = tuple(("div", *rng.sample(_FRAMES, rng.randint(0, 2))) for _ in range(rng.choice([0, 0, 1, 1, 2])))
    moved = [Block(b.text, _renamed(b.path, name, frame), b.link_chars) for b in page]
    out = list(zip(moved, labels, strict=True))
    outer = next((b.path[:1] for b in page if b.path), (("html",),))

    def extra(inside: bool) -> list[tuple[Block, int]]:
        word = rng.choice(_FREQUENT if rng.random() < 0.6 else _OTHER_NAMES)
        element = (rng.choice(_OTHER_TAGS),) if rng.random() < 0.35 else (rng.choice(["div", "section", "ul", "p", "div"]), word)
        if rng.random() < 0.2 and element[0] in _OTHER_TAGS:
            element = (*element, word)
        around = (*frame, inner) if inside else frame if rng.random() < 0.5 else ()
        base = (*outer, ("body",), *around, element)
        got = []
        for _ in range(rng.randint(1, 5)):
            text = rng.choice(spare)
            words = text.split()
            if rng.random() < 0.5:
                text = " ".join(words[: rng.randint(1, 12)])
            leaf = rng.choice([(), (("p",),), (("p",),), (("li",),), (("div",),), (("div", "item"), ("p",))])
            got.append((Block(text, (*base, *leaf), len(text) if rng.random() < 0.4 else 0), 0))
        return got

    for _ in range(rng.randint(2, 7)):
        main = [i for i, (_, label) in enumerate(out) if label]
        where = rng.random()
        if main and where < 0.4:
            at = rng.choice(main) + rng.randint(0, 1)
            out[at:at] = extra(True)
        elif where < 0.7:
            out[0:0] = extra(False)
        else:
            out += extra(False)
    return [b for b, _ in out], [label for _, label in out]


def fit(pages: list[str], seed: int = 11) -> dict[str, np.ndarray]:
    """Train the labeller on these pages and their variants; one at least has a text block."""
    rng = random.Random(seed)
    read = [b for b in map(blocks, pages) if b]
    if not read:
        raise ValueError("no page to learn from has a text block")
    told = [teach(b) for b in read]
    spare = [b.text for page in read for b in page]
    spare += [t for t in spare if len(t) > 100] * 2  # long blocks too are found outside the main text
    learnt = list(zip(read, told, strict=True))
    for page, labels in list(learnt):
        learnt += [_variant(page, labels, spare, rng) for _ in range(VARIANTS)]
    sizes = np.array([len(page) for page, _ in learnt])
    x = labeller.features([page for page, _ in learnt], {})
    y = np.array([v for _, labels in learnt for v in labels], np.float32)
    return labeller.train(x, y, sizes)


def train(pages: DataFrame, html: str = "html", most: int = MAX_FIT_PAGES) -> dict[str, np.ndarray]:
    """Fit on at most ``most`` distinct pages, the same ones on every run.

    These are pages of at most ``MAX_FIT_BYTES`` bytes.  If none of them has a text block, the
    shortest pages that have one are taken (together as long as ``most`` pages at most, but one
    at least).  Only if no page of the table has a text block are the parameters untrained.
    """
    column = F.col(f"`{html}`")
    told = pages.select(column.alias("html"), F.xxhash64(column).alias("code"), F.octet_length(column).alias("bytes")).where("bytes > 0")

    def read(codes: list[int]) -> list[str]:
        copies = told.where(F.col("code").isin(codes)).groupBy("code").agg(F.first("html").alias("html"))
        found = {r.code: r.html for r in copies.collect()} if codes else {}
        return [found[c] for c in codes]

    # Copies of a page share its hash: they are one page before anything is counted or cut.
    small = told.where(F.col("bytes") <= MAX_FIT_BYTES).select("code").distinct()
    sample = read([r.code for r in small.orderBy(F.pmod("code", F.lit(1 << 40)), "code").limit(most).collect()])
    if any(blocks(p) for p in sample):
        return fit(sample)

    def start():
        return lambda texts: [pa.array([len(blocks(t or "")) for t in texts.to_pylist()], pa.int64())]

    shown = with_results(told, "html", ["code", "bytes"], "n_blocks long", start).where("n_blocks > 0").select("bytes", "code").distinct()
    codes, total = [], 0
    for r in shown.orderBy("bytes", "code").limit(most).collect():
        total += r.bytes
        if codes and total > most * MAX_FIT_BYTES:
            break
        codes.append(r.code)
    return fit(read(codes)) if codes else labeller.blank()


def extract(page_blocks: list[list[Block]], model: dict[str, np.ndarray], cache: dict) -> list[str]:
    sizes = np.array([len(b) for b in page_blocks], np.int64)
    kept = labeller.predict(model, labeller.features(page_blocks, cache), sizes) >= 0.5
    out, at = [], 0
    for page in page_blocks:
        out.append("\n".join(b.text for b, k in zip(page, kept[at : at + len(page)], strict=True) if k))
        at += len(page)
    return out


def with_main_text(df: DataFrame, model: dict[str, np.ndarray], html: str = "html") -> DataFrame:
    """All columns but ``html``, and ``text`` (main blocks joined by a line feed) and ``n_chars``.

    Every block of the whole page is labelled.  NULL and empty pages, and pages without a main
    block, give the empty text.  Input columns named like a result are left out.
    """
    sent = share(df.sparkSession, model)

    def start():
        cache: dict = {}

        def compute(pages: pa.Array) -> list[pa.Array]:
            texts = extract([blocks(p or "") for p in pages.to_pylist()], sent.value, cache)
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return compute

    return with_results(df, html, [c for c in df.columns if c != html], "text string, n_chars long", start)
