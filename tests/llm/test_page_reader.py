"""Pages that the reader got wrong or slowly, and pages whose furniture has no names."""

import html as chars
import os
import re
import time

import pyarrow.parquet as pq
import pytest

from meshframe.llm import html

PAGES = "/root/testdata/sf0.01/pages.parquet"
PARA = "<p>This is a paragraph of some length, with commas, and more than one sentence. It goes on, as they do.</p>"


def test_letters_that_grow_in_lower_case():
    text = "İ" * 120
    page = "<body><article>" + "".join(f"<p>{text} paragraph {i}, which is long enough. It is.</p><script>var a = '</p>';</SCRIPT >" for i in range(8)) + "</article></body>"
    assert html.main_text(page).split("\n") == [f"{text} paragraph {i}, which is long enough. It is." for i in range(8)]
    assert html.main_text(f"<body><article>{PARA}<script>a</ſcript>b</script>{PARA}</article></body>").count("\n") == 1


def test_formulas_and_labels_stay():
    body = f"{PARA}<p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> holds.</p><p><label>Figure one</label> shows it.</p><p>A <map><area>drawing</map> of <svg><desc>no</desc><text>two</text></svg>.</p>{PARA}"
    got = html.main_text(f"<body><article>{body}</article><form><label>Name</label><select><option>x</select></form></body>").split("\n")
    assert got[1:4] == ["The sum a+b holds.", "Figure one shows it.", "A drawing of two."] and "Name" not in " ".join(got)


@pytest.mark.parametrize("tag", ["<svg>", "<canvas>", "<b class=ad>", "<b>", "<div>", "<template>", "<table>"])
def test_unclosed_tags_take_linear_time(tag):
    start = time.process_time()
    html.main_text(tag * 3000 + "<p>a</b></i>" * 20_000)
    assert time.process_time() - start < 6


def test_implied_ends():
    page = "<body><article><ul><li>one<li>two<ul><li>inner<p>para</ul><li>three</ul><table><tr><td>a<td>b<tr><th>c<td><p>d</table><dl><dt>t<dd>u<dt>v</dl><p>x<div>y</p></div>" + PARA * 4 + "</article></body>"
    assert html.main_text(page).split("\n")[:13] == ["one", "two", "inner", "para", "three", "a", "b", "c", "d", "t", "u", "v", "x"]


def lines(page):
    article = page[page.index("<article>") + 9 :].split("</article>")[0]
    found = re.sub(r"<[^>]*$", "", re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", "\n", article))).split("\n")
    return [x for x in (" ".join(chars.unescape(y).split()) for y in found) if x]


@pytest.mark.skipif(not os.path.exists(PAGES), reason="the given tables are elsewhere")
def test_ratios_decide_where_nothing_is_named(monkeypatch):
    pages = pq.read_table(PAGES).column("html").to_pylist()
    bare = [re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", p) for p in pages]

    def exact():
        got = [html.main_text(p).split("\n") for p in bare]
        assert all(set(lines(p)) <= set(g) for p, g in zip(pages, got, strict=True))
        return sum(g == lines(p) for p, g in zip(pages, got, strict=True))

    assert exact() >= 100
    monkeypatch.setattr(html, "LEAST", 0.0)  # without the ratios, what isn't named stays
    assert exact() <= 10
