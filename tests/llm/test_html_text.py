import random
import time
from collections import Counter

import pytest

from gridloom.llm import html_text as ht
from gridloom.llm.queries import op9_html_text

PAGE = """<!DOCTYPE html><html lang="en"><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">cookies</div><header><h1>Site</h1></header><!-- c > -->
<div class="ad">buy<article><header><h1>Title &amp; more</h1></header><p>One&nbsp;two<br>three <b>bo</b>ld<p>Next &lt;p&gt; &#233;
 line<div class="related">other</div><form><input value="1>2">name</form><ul><li>a<li>b</ul><blockquote>q</blockquote>
<aside>side</aside><section id="comments"><article class="comment"><p>me too</p></article></section><p style="display: none">hidden</p><div hidden>h</div>
<table><tr><td>c1</td><td> c2</td></tr></table><p></p></article><footer>&copy; all</footer></body></html>"""


def test_article():
    want = ["Title & more", "One two three bold", "Next <p> é line", "a", "b", "q", "hidden", "c1 c2"]
    assert ht.page_blocks(PAGE) == (want, True)  # only whole parts are dropped for their style, paragraphs aren't


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ([], False)),
        ("plain text", (["plain text"], False)),
        ("<p>a<p>b", (["a", "b"], False)),
        ("<main><p>m</p></main><div>out</div>", (["m"], True)),
        ("<div role=main>m</div>x", (["m"], True)),
        ("<script>never closed <p>x", ([], False)),
        ("<!-- never closed <p>x", ([], False)),
        ("<article><p>a</article><article>b</article>", (["a", "b"], True)),
        ("<p>1 < 2 &amp;&amp; 3 > 2</p>", (["1 < 2 && 3 > 2"], False)),
        ("</div></p><article></div>a</article>", (["a"], True)),
        ('<article><p class="x>text</p></article>', (["text"], True)),
        ('<p class="a>b" id=\'c>d\'>text</p>', (["text"], False)),
        ("<p>a <b never closed", (["a"], False)),
        ("<p>a<!>b</ >c<?x?>d<!---->e</p>", (["abcde"], False)),
        ('<article><p class="advert">buy</p><p>a</p><ul><li class="cookie-notice">c<div>d</div><li>b</ul><h2 class="newsletter">n</h2>e</article>', (["a", "b", "e"], True)),
        ('<article><table><tr><td class="ad">x</td><td>y</td></tr><tr class="promo"><td>z</td></tr><tr><td>w</td></tr></table></article>', (["y", "w"], True)),
        ("<article><table><tr><th>a</th><th>b</th></tr><tr><td>c<td>d e</td></table>x<td>y</article>", (["a b", "c d e", "x y"], True)),
        ('<article><p class="ad">buy<p>a<h2 id="a-notice">h</h2><p class="ad">b<div>c</div></article>', (["a", "h", "c"], True)),
        ('<article><div class="social"><p>a story of people</p></div></article>', (["a story of people"], True)),
        ("<p>&#" + "9" * 5000 + "; &#" + "0" * 9 + "65;</p>", (["\ufffd A"], False)),
        ("<svg><p>x</p></svg ><p>a</p><script>if (a</script >b", (["a", "b"], False)),
    ],
)
def test_pieces(page, want):
    assert ht.page_blocks(page) == want


@pytest.mark.parametrize("unit", ["<a x ", "<a x='", '<p "', "<!--", "<div>", "<a b=\"c' d='e\" ", "<", "</", "<p class=ad><li class=ad>", "<svg ", "</div><div><b", "&#1", "<a =", "x &am"])
def test_long_broken_pages_take_linear_time(unit):
    page = "<article><p>first</p>" + unit * (5_000_000 // len(unit))
    start = time.perf_counter()
    blocks, _ = ht.page_blocks(page)
    assert time.perf_counter() - start < 20 and blocks[0].startswith("first")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, blocks string")


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    top = "welcome to this site where all news of the day is found first"
    rows = [(i, f"http://a.org/{i}", f"<div>{top}</div><p>w{i}x tells of w{i}a w{i}b w{i}c</p><div>w{i}y end</div>", "", "", "") for i in range(6)]
    rows += [(10, "http://b.org/1", f"<p>{top}</p>", "", "", ""), (11, None, "<p>no address</p>", "", "", ""), (12, "http://a.org/x", None, "", "", ""), (13, "http://a.org/y", f"<article><p>{top}</p></article>", "", "", "")]
    got = {r.page_id: r.text for r in ht.main_text(pages(spark, rows)).collect()}
    for i in range(6):
        assert got[i] == f"w{i}x tells of w{i}a w{i}b w{i}c\nw{i}y end"
    assert got[10] == top and got[11] == "no address" and got[12] == "" and got[13] == top


def test_repeated_rows_and_none(spark):
    rows = [(1, "http://a.org", "<article>x</article>", "", "", "")] * 2
    assert [tuple(r) for r in ht.main_text(pages(spark, rows)).collect()] == [(1, "http://a.org", "x")] * 2
    assert ht.main_text(pages(spark, rows).limit(0)).count() == 0


def test_query(spark, sf):
    got = op9_html_text(spark, sf).collect()
    assert len(got) == 50 and all(r.n_chars == len(r.text) and r.text for r in got)
    assert not any("<" in r.text and "</" in r.text for r in got)


def test_repeats_of_a_large_host(spark):
    footer = "all stories of this section are brought to you by the desk"
    rows = [(i, f"http://a.org/{i}", f"<p>w{i}a w{i}b w{i}c</p><div>Home News</div><p>{footer if i < 4 else f'w{i}d'}</p>", "", "", "") for i in range(60)]
    rows += [(i, f"http://b.org/{i % 2}", f"<p>{footer}</p><p>v{i}</p>", "", "", "") for i in (100, 101)]
    rows += [(200, "http://c.org/", f"<p>{footer}</p>", "", "", "")] * 4
    got = sorted((r.page_id, r.text) for r in ht.main_text(pages(spark, rows)).collect())
    want = [(i, f"w{i}a w{i}b w{i}c" + (f"\nw{i}d" if i >= 4 else "")) for i in range(60)]
    assert got == want + [(i, f"{footer}\nv{i}") for i in (100, 101)] + [(200, footer)] * 4


def plain_cut(rows):
    """The host comparison by plain loops: tokens in a run of RUN that LEAST_PAGES distinct pages of the host have go."""
    blocks = {r: [b.split() for b in ht.page_blocks(r[2])[0]] for r in set(rows)}
    runs = lambda bs: {tuple(w[i : i + ht.RUN]) for w in [[t for b in bs for t in b]] for i in range(len(w) - ht.RUN + 1)} | {tuple(b) for b in bs if len(b) < ht.RUN}
    seen = Counter((r[1].split("/")[2], run) for r, bs in blocks.items() for run in runs(bs))
    out = []
    for r in rows:
        bs, host = blocks[r], r[1].split("/")[2]
        flat = [t for b in bs for t in b]
        gone = {i + j for i in range(len(flat) - ht.RUN + 1) if seen[host, tuple(flat[i : i + ht.RUN])] >= ht.LEAST_PAGES for j in range(ht.RUN)}
        text, at = [], 0
        for b in bs:
            kept = [t for i, t in enumerate(b) if at + i not in gone]
            at += len(b)
            if kept and (len(b) >= ht.RUN or seen[host, tuple(b)] < ht.LEAST_PAGES):
                text.append(" ".join(kept))
        out.append((r[0], "\n".join(text)))
    return sorted(out)


def test_host_comparison_equals_plain_loops(spark):
    rng = random.Random(3)
    shared = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(rng.randrange(3, 30))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(shared) if rng.random() < 0.6 else " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 8))]
        rows.append((i, f"http://h{i % 7 % 3}.org/{i}", "".join(f"<p>{p}</p>" for p in parts)))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in ht.main_text(df).collect()) == plain_cut(rows)
