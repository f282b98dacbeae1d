import random

import pytest
from pyspark.sql import functions as F

from inkfold.llm import html_diff as op

FRAME = '<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class="cookie-banner">We use cookies</div>'


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (FRAME + "<article><h1>Title</h1><p>One &amp; two<br>three<p><b>Four</b></article><footer>f</footer>", "Title\n\nOne & two three\n\nFour"),
        ("<article><p>a</p><aside>x</aside><section id=comments><p>y</p></section><p>b</article>", "a\n\nb"),
        ("<article><p>a</p><script>var t='</p>';</script><form><p>x</p></form><!-- <p>c --><p>b", "a\n\nb"),
        ("<article><div class='no-sidebar'>a</div><div class=\"sidebar-left\">x</div><div hidden>y</div><div>b  \n c</div></article>", "a\n\nb c"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one\n\ntwo\n\nc1\n\nc2"),
        ("<article class='comment'><p>x</p></article><article><p>a &#233;&nbsp;&lt;b&gt; &am</p></article>", "a é <b> &am"),
        ("<body><p>plain page</p></body>", "plain page"),
        ("", ""),
        ("no markup at all", "no markup at all"),
        ("<p", ""),
        ("<article><p title=it's>a</p><p class='x' id=\"y>z\">b</p></article>", "a\n\nb"),
        ("< 3 and 4 >", "< 3 and 4 >"),
    ],
)
def test_blocks(page, want):
    assert op.main_text(op.lines(page), None) == want


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        same = sorted(op.shared(a, b))
        it = iter(b)
        assert len(same) == lcs(a, b) and all(any(a[i] == y for y in it) for i in same)


def test_frame_without_article_is_removed_by_the_neighbour(spark):
    page = lambda k: f"<div>Menu</div><div>Login</div><div>Text {k} of this page</div><div>Imprint</div>"
    rows = [(k, f"https://h.org/a/{k}?q={k}", page(k)) for k in range(5)] + [(9, "https://other.org/x", page(9))]
    out = {r["page_id"]: r["text"] for r in op.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)).collect()}
    assert [out[k] for k in range(5)] == [f"Text {k} of this page" for k in range(5)] and out[9] == "Menu\n\nLogin\n\nText 9 of this page\n\nImprint"


def test_an_article_under_two_addresses_stays(spark):
    rows = [(k, f"https://h.org/{k}", FRAME + "<article><p>The same article.</p></article>") for k in range(2)]
    out = op.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert [r["text"] for r in out] == ["The same article."] * 2


def test_neighbours_do_not_depend_on_partitions(spark):
    rows = [(k, f"h{k % 3}", f"/d{k % 7}/{k:03}") for k in range(200)] + [(999, "lonely", "/")]
    found = []
    for n in ("1", "7", "31"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = spark.createDataFrame(rows, "row bigint, host string, path string").repartition(5)
        found.append({r["row"]: r["partner"] for r in op.nearest(df).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and len(found[0]) == 200 and 999 not in found[0]
    host, path = {k: h for k, h, _ in rows}, {k: p for k, _, p in rows}
    assert all(host[a] == host[b] for a, b in found[0].items())
    assert sum(path[a].split("/")[1] == path[b].split("/")[1] for a, b in found[0].items()) >= 195


def test_long_pages():
    a = op.blocks("<div>" + "".join(f"<p>line {k % 1000}</p>" for k in range(6000)) + "</div>")
    assert len(a) == 6000 and len(op.shared([x for x, _ in a], [x for x, _ in a[5:]])) == 5995
    assert len(op.blocks("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1


def test_messy_rows_and_empty_tables(spark):
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (None, "https://h.org/a", "<p>x</p>"), (3, "https://h.org/a", "<p>x</p>"), (4, "https://h.org", "<p>" + "y " * 500_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", *[F.lit("clash").alias(c) for c in ("text", "host", "path", "row", "partner", "rank")])
    out = op.extract(pages)
    assert out.count() == 6 and out.filter("text is null").count() == 0 and {r["n_chars"] for r in out.collect()} == {0, 1, 999_999}
    assert op.extract(pages.filter("false")).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>a</p><figure><img><figcaption>A caption</figcaption></figure><label>b</label></article>", "a\n\nA caption\n\nb"),
        ("<article><p>a</p><figure><figcaption class=ad>x</figcaption></figure><form><label>y</label></form></article>", "a"),
        ("<article><p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> b</p></article>", "a x=2 b"),
        ("<article><p>a<svg width='1'/> b</p><p>c<math/> d</p></article>", "a b\n\nc d"),
        ("<div><p>The long main text of this page stands here.</p></div><article class=card><p>Teaser</p></article>", "The long main text of this page stands here.\n\nTeaser"),
    ],
)
def test_text_that_markup_alone_dropped(page, want):
    assert op.main_text(op.lines(page), None) == want


def test_main_text_beside_teasers_is_left_by_the_neighbour(spark):
    page = lambda k: f"<div>Menu of the site</div><div>Main text {k} of this page, long enough to outweigh it</div><article class=card>Teaser</article><div>Imprint and contact</div>"
    rows = [(k, f"https://h.org/a/{k}", page(k)) for k in range(3)]
    out = {r["page_id"]: r["text"] for r in op.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert out == {k: f"Main text {k} of this page, long enough to outweigh it\n\nTeaser" for k in range(3)}
