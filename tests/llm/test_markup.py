import pytest
from paperloom.llm import markup as K

CASES = [
    ("<p>a &amp; b</p>", {"html"}), ("x &lt;ul&gt; y", {"html"}), ("<UL>\n<LI>one", {"html"}), ("text<!-- c -->", {"html"}),
    ("## Head\n\ntext", {"markdown"}), ("a **bold** b", {"markdown"}), ("see [s](f.pdf)", {"markdown"}), ("`code` x", {"markdown"}), ("```\nx\n```", {"markdown"}),
    ("| a | b |\n|---|---:|\n| 1 | 2 |", {"markdown"}), ("> quoted words", {"markdown"}), ("2. __unaudited__", {"markdown"}),
    ("== Head ==\nx", {"wiki"}), ("[[A|b]] c", {"wiki"}), ("{{Infobox|a=1}}", {"wiki"}), ("'''bold''' x\n* item", {"wiki"}), ("{| class=\"wikitable\"\n! A\n|-\n| 1\n|}", {"wiki"}),
    ("\\section{A}\nx", {"latex"}), ("Here $r_{t} = \\frac{E}{D}$ holds", {"latex"}), ("rose 5\\% now", {"latex"}), ("<b>x</b> and $x_{1} \\leq 2$", {"html", "latex"}),
    ("from $3 million to $57 million", set()), ("Leverage < 33x while cover > 7.5x", set()), ("Where x < 26 and y > 51", set()), ("file Q:\\room\\batch8\\final.", set()),
    ("- a list dash\n- another", set()), ("R&D was 15 | 69 in two years", set()), ("net_debt_26 of the ledger", set()), ("the #4 supplier has 39% of purchases*", set()),
    ("reference [11] and note {53}", set()), ("", set()), (None, set()), ("$1 and net_debt_3 of $2", set()),
]


@pytest.mark.parametrize(("text", "kinds"), CASES)
def test_kinds(text, kinds):
    assert K.detect(text) == kinds


def test_heading_path_is_no_markup():
    assert K.detect("Risks FY2020 > Debt > Notes\nplain text", True) == set()
    assert K.detect("Risks > Debt\n<b>x</b>", True) == {"html"}
    assert K.clean("Risks > Debt\n<b>x</b> y", True)[0] == "Risks > Debt\nx y"


def test_rendering_keeps_structure():
    assert K.clean("<h2>A</h2><ul><li>one<li>two</ul><script>bad()</script><pre>x  y</pre>")[0] == "## A\n\n- one\n- two\n\n```\nx  y\n```"
    assert K.clean("<table><tr><td>ab<td>c<tr><td>d<td>ef</table>")[0] == "ab  c\nd   ef"
    assert K.clean("a<span style='display: none'>no</span>b<div hidden>no</div>")[0] == "ab"
    assert K.clean("\\begin{itemize}\n\\item one 5\\%\n\\item two\n\\end{itemize}")[0] == "- one 5%\n- two"
    assert K.clean("\\begin{equation}\nA = \\frac{b}{c}\n\\end{equation}")[0] == "$A = \\frac{b}{c}$"
    assert K.clean("== H ==\n'''b''' [[A|see]]\n* item")[0] == "## H\nb see\n- item"
    assert K.clean("**b** and `c`\n\n```\nd **e**\n```")[0] == "b and c\n\n```\nd **e**\n```"


def test_trace_never_hides_a_construct():
    import re

    trace = re.compile(K.TRACE.replace("(?m)", ""), re.M)
    assert all(trace.search(t) for t, kinds in CASES if kinds)


def test_broken_and_long_input_ends():
    for text in ("<div" * 3000, "<b>" * 4000 + "x", "[" * 5000, "$" * 5001, "{{" * 3000, "*" * 5000, "`" * 5000, "\\begin{itemize}" * 500, "a" * 200_000):
        K.clean(text)


def test_query_has_no_row_twice(spark, tmp_path):
    rows = [("1", "section", "<b>a</b>", "H > I\n<b>a</b> **c**"), ("1", "section", "<b>a</b>", "H > I\n<b>a</b> **c**"), ("2", "table", "<b>a</b>", None), ("3", "section", None, "plain")]
    spark.createDataFrame(rows, "chunk_id string, kind string, text string, embed_text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = sorted(map(tuple, K.p3_found(spark, str(tmp_path)).collect()))
    assert got == [("1", "embed_text", "html"), ("1", "embed_text", "markdown"), ("1", "text", "html")]
    assert K.p3_clean(spark, str(tmp_path)).count() == 4


def test_everything_visible_in_a_table_is_kept():
    from paperloom.llm.markup import render_html

    assert render_html("<table><caption>Debt</caption><tr><td>a</td><td>b</td></tr></table>") == "Debt\n\na  b"
    assert render_html("<table><td>a<td>b<tr><td>c<td>d</table>") == "a  b\nc  d"
    assert render_html("<table>in <b>table</b><tr>in row<td>a</td></tr></table>") == "in table\n\na\n\nin row"
    assert render_html("<table><tr><td>a</td></tr><p>after</p><p>last</p>") == "a\n\nafter\n\nlast"
    assert render_html("<table><tbody><tr><th>x</th></tr>\n<tr><td>y</td></tr></tbody></table>") == "x\ny"


def test_no_depth_or_length_is_too_great():
    from paperloom.llm.markup import detect, render_html

    for depth in (10, 99, 101, 20_000):
        deep = "<div>" * depth + "seen<p hidden>unseen<b>too</b></p>" + "</div>" * depth
        assert render_html(deep) == "seen"
        assert render_html("<div style='display:none'>" + deep + "</div>after") == "after"
    for size in (10, 2_000):
        assert detect("let $" + "a_{i} + " * size + "b$ hold") == {"latex"}
    assert K.clean("\\textbf{" * 30 + "x" + "}" * 30)[0] == "x"
