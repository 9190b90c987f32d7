"""Page trees: scoring against a naive scorer over generated trees, and the forms that broken pages take."""

import random

import pytest
from pyspark.sql import functions as F

from tamarack import plans
from tamarack.functions import pagetree
from tamarack.session import table

WORDS = "lorem, ipsum dolor sit, amet consectetur adipiscing elit sed do, eiusmod".split()


def random_tree(rng, depth=0):
    """(tag, children): children are trees or strings."""
    if depth >= 2 and rng.random() < 0.5 or depth > 5:
        inner = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))]
        if rng.random() < 0.4:
            inner.insert(rng.randint(0, 1), ("a", [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 20)))]))
        return (rng.choice(["p", "pre", "p", "div", "span", "li"]), inner)
    tag = rng.choice(["div", "article", "section", "nav", "blockquote", "footer", "ul"])
    return (tag, [random_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))])


def render(t):
    return t if isinstance(t, str) else f"<{t[0]}>{''.join(render(c) for c in t[1])}</{t[0]}>"


def text_of(t):
    return t if isinstance(t, str) else "".join(text_of(c) for c in t[1])


def squeezed(t):
    return " ".join(text_of(t).split())


def below(t):
    """All elements of a tree, itself included."""
    return [] if isinstance(t, str) else [t, *(x for c in t[1] for x in below(c))]


def naive(root):
    """For every element its score, by looking for all paragraphs below each candidate anew."""
    out = []
    BLOCK = pagetree.BLOCKS

    def is_paragraph(t):
        return t[0] in ("p", "pre", "td", "blockquote") or t[0] in ("div", "section") and not any(x[0] in BLOCK for x in below(t)[1:])

    def visit(t, hidden):
        total = 0.0
        mine = hidden or t[0] in pagetree.ASIDE
        for c in (c for c in t[1] if not isinstance(c, str)):
            inside = mine or c[0] in pagetree.ASIDE
            if not inside and is_paragraph(c):
                total += pagetree.points(squeezed(c))
            for g in (g for g in c[1] if not isinstance(g, str)):
                if not (inside or g[0] in pagetree.ASIDE) and is_paragraph(g):
                    total += pagetree.points(squeezed(g)) / 2
        letters = len("".join(text_of(t).split()))
        links = sum(len("".join(text_of(x).split())) for x in below(t) if x[0] == "a")
        out.append((t, total * (1 - (links / letters if letters else 0.0))))
        for c in t[1]:
            if not isinstance(c, str):
                visit(c, mine)

    visit(root, False)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_scores_equal_a_naive_scorer(seed):
    rng = random.Random(seed)
    root = ("body", [random_tree(rng) for _ in range(rng.randint(1, 4))])
    tree = pagetree.Tree(render(root))
    want = naive(root)
    assert [n.tag for n in tree.nodes[1:]] == [t[0] for t, _ in want]
    got = pagetree.scores(tree)
    assert {i: s for i, s in got.items() if s and i} == pytest.approx({i + 1: s for i, (_, s) in enumerate(want) if s})
    tag, score, lines = pagetree.article(tree)
    if got:
        assert score == pytest.approx(max(s for _, s in want))
        first = next(t for t, s in want if s == pytest.approx(score))
        assert tag == first[0] or score == 0
        assert set("".join(" ".join(lines).split())) <= set("".join(text_of(root).split()))


def test_the_article_wins_over_link_lists():
    story = "A long first paragraph, with commas, that tells what the package does on install, and to whom."
    page = f"<nav>{'<p><a href=x>' + story + '</a></p>'}</nav><div><p><a>{story * 3}</a></p></div><div id=m><div><p>{story}<p>{story}<table><tr><th>a<th>b<tr><td>1<td>2</table></div><div><p>{story}</div></div><footer><p>{story}</footer>"
    tag, score, lines = pagetree.article(pagetree.Tree(page))
    assert tag == "div" and lines == [story, story, "a\tb", "1\t2", story]


def test_broken_pages():
    tree = pagetree.Tree("<p>one<p>two<ul><li>a<li>b<ul><li>c</ul></ul></x></div><div>three<br>four<script>var p = '</p>';</script>")
    assert tree.lines(0) == ["one", "two", "a", "b", "c", "three four"]
    assert pagetree.header_titles(pagetree.Tree("<h2>b</h2><div class='Big-Header'>x<div>y</div>z</div><h1>a <i>&amp; c</i></h1><h2>b</h2>")) == ["b", "a & c", "xyz"]
    assert pagetree.code_texts(pagetree.Tree("<pre><code>\n pip <b>x</b>\n  y </code></pre><code></code>")) == ["pip x\n  y", ""]
    assert pagetree.article(pagetree.Tree("")) == ("", 0.0, [])
    deep = pagetree.Tree("<div>" * 5000 + "deep text that is a little longer" + "</div>" * 5000)
    assert pagetree.article(deep)[2] == ["deep text that is a little longer"]


def test_page_summary_is_one_parse_of_every_page(spark, sf_dir):
    got = {r["page_id"]: r for r in plans.QUERIES["page_summary"](spark, sf_dir).collect()}
    pages = table(spark, sf_dir, "pages").select("page_id", "html").collect()
    assert len(got) == len(pages)
    for r in pages[:40]:
        tag, score, lines = pagetree.article(pagetree.Tree(r["html"]))
        assert (got[r["page_id"]]["tag"], got[r["page_id"]]["score"], got[r["page_id"]]["n_chars"]) == (tag, round(score, 4), len("\n".join(lines)))
    plan = plans.QUERIES["page_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_null_pages(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "page_id long, html string").withColumn("body", F.lit(1))
    assert [(r["tag"], r["score"], r["body"], r["titles"]) for r in pagetree.read_pages(df, "page_id").collect()] == [("", 0.0, "", [])] * 2


def test_blocks_of_unclosed_and_nested_elements():
    page = "<nav><p>menu</p></nav><p>one <b>t</b>wo<br>x<p>three<ul><li>a<ul><li>b</ul><li>a</ul><table><tr><th>h<td><p>in</p><tr><td>1<td></table><td>lone</td><iframe srcdoc='<p>framed<p>three'></iframe><iframe src=u></iframe><p>one two x"
    assert pagetree.kept_blocks(pagetree.Tree(page)) == [("p", "one two x"), ("p", "three"), ("li", "b"), ("li", "ab"), ("li", "a"), ("p", "in"), ("row", "h\tin"), ("row", "1\t"), ("td", "lone"), ("p", "framed"), ("iframe", "u")]


def test_pages_are_read_in_lots():
    """No more than a lot's trees and results are held at once, whatever the batch."""
    import pyarrow as pa

    texts = ["x" * 10] * 600 + [None, "", "y" * (pagetree.LOT_BYTES + 1), "z" * (pagetree.LOT_BYTES - 5), "w" * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "html"])
    got = list(pagetree.lots(batch, 1))
    assert [k for b in got for k in b.column(0).to_pylist()] == list(range(len(texts)))
    sizes = [[len(t or "") for t in b.column(1).to_pylist()] for b in got]
    assert all(len(s) <= pagetree.LOT and (len(s) == 1 or sum(s) <= pagetree.LOT_BYTES) for s in sizes) and len(got) == 6
    assert list(pagetree.lots(batch.slice(0, 0), 1)) == []
