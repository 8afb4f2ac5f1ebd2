import random

import pytest

from sievewright.llm.markup import clean_markup, read_markup

PROSE = [
    "Adults weigh < 30 g and > 12 g in two samples.", "A 5'' lens and a 3'' frame were used.", "Visits 7 _ 9 and 11 _ 12 were merged [see above].", "Grades run from * to *** on cards.",
    "The tag cost $5 in one shop and $9 in another.", 'The label reads "nigrum [sic]".', "The scans lie under C:\\Field\\notes on the desk.", "Use the key on p. 12 (couplet {b}).",
    "100% of n = 12; 4 x 6 mm.", "A grid of 3 * 4 squares.", "Scores are wing | tail | bill.", "R & D plots, &c.", "a/b stays ~ 0.7", "Station #4 and plot #17", "A -> B or B <- A", "Values <0.5 or >0.7",
    "Field code BR_17_late", "2*3*4 and x_1_y", "It's the 'best' one's", "AT&T; and so on", "3 - 4", "a == b",
]

MARKED = [
    ("# Head", "markdown", "# Head"), ("Head\n====\ntext", "markdown", "# Head\ntext"), ("a **b** c", "markdown", "a b c"), ("*a* b", "markdown", "a b"), ("- [x] a\n- [ ] b", "markdown", "- a\n- b"),
    ("See [x](http://a.b/c_(d)) now", "markdown", "See x now"), ("~~a~~ b", "markdown", "a b"), ("| a | b |\n|---|--:|\n| 1 | 2 |", "markdown", "a | b\n1 | 2"), ("use `x_y` here", "markdown", "use `x_y` here"),
    ("text.[^1]\n[^1]: note", "markdown", "text.\nNote 1: note"), ("> quoted", "markdown", "quoted"), ("```py\na * b\n```", "markdown", "```py\na * b\n```"), ("<https://a.b/c>", "markdown", "https://a.b/c"),
    ("== H ==\na", "wiki", "## H\na"), ("'''b''' and ''i''", "wiki", "b and i"), ("[[A|b]] [[C]]", "wiki", "b C"), ("x{{cite|a={{b}}}} y", "wiki", "x y"), ("{{convert|43|mm|in}}", "wiki", "43 mm"),
    ("a<ref>b</ref> c", "wiki", "a c"), ('{| class="w"\n|-\n| a || b\n|}', "wiki", "a | b"), ("__NOTOC__ a", "wiki", " a"), ("[https://a.b c d]", "wiki", "c d"),
    ("\\section{A} b", "latex", "## A b"), ("\\textit{a \\textbf{b}} c", "latex", "a b c"), ("a~\\cite{x} b", "latex", "a b"), ("14\\% of", "latex", "14% of"), ("L. Bu\\'{e}r", "latex", "L. Buér"), ("{\\bf a} b", "latex", "a b"),
    ("Growth $h(t) = e^{-t}$ here", "latex", "Growth $h(t) = e^{-t}$ here"), ("\\[ a_1 \\]", "latex", "$a_1$"), ("\\begin{itemize}\n\\item a\n\\end{itemize}", "latex", "- a"),
    ("\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}", "latex", "a | b"), ("a <b>b</b>", "html", "a b"), ("x&nbsp;&amp; y", "html", "x\xa0& y"), ("<H2 CLASS=a>H</H2>t", "html", "## H\nt"), ("a<!-- b -->c", "html", "ac"),
    ("<ul><li>a<li>b</ul>", "html", "- a\n- b"), ("<style>x{}</style>a", "html", "a"), ("<pre>\na &lt; b\n</pre>", "html", "```\na < b\n```"), ("a <br/> b", "html", "a\n b"), ("&lt;i&gt;a&lt;/i&gt;", "html", "a"),
]


@pytest.mark.parametrize("text", PROSE)
def test_prose_is_untouched(text):
    clean, counts, _ = read_markup(text)
    assert clean == text and not +counts


@pytest.mark.parametrize("text,family,want", MARKED)
def test_constructs(text, family, want):
    clean, counts, _ = read_markup(text)
    assert clean.strip() == want.strip() and set(+counts) == {family}


def test_tag_paths_select_content():
    nav = "".join(f"<li><a href='x'>Link {i}</a></li>" for i in range(12))
    body = "".join(f"<p>Sentence number {i}, with a clause, is long enough. It even goes on; twice, in fact.</p>" for i in range(8))
    clean, _, kept = read_markup(f"<html><body><nav><ul>{nav}</ul></nav><div>{body}</div><footer>Imprint</footer></body></html>")
    assert "Sentence number 7" in clean and "Link 3" not in clean and "Imprint" not in clean and kept < 1


WORDS = "river meadow wing seed slope winter colony branch survey nest pond leaf north early observed several adults young found near during mostly rarely because where".split()


def prose(r, low=8, high=22):
    s = " ".join(r.choice(WORDS) for _ in range(r.randint(low, high))).capitalize()
    return s[: len(s) // 2].rstrip() + ", " + s[len(s) // 2 :].strip() + "."


def page(r):
    """(html, texts that must stay, texts that must go): an article among boilerplate, in one of several layouts."""
    stay, go = [], []

    def keep(t):
        stay.append(t)
        return t

    def drop(t):
        go.append(t)
        return t

    def label(n=2):
        return " ".join(r.choice(WORDS).title() + str(r.randint(0, 999)) for _ in range(n))

    def links(n):
        return [f"<a href='/{i}'>{drop(label(r.randint(1, 2)))}</a>" for i in range(n)]

    menu = r.choice(
        [
            lambda: "<nav><ul>" + "".join(f"<li>{x}</li>" for x in links(r.randint(5, 14))) + "</ul></nav>",
            lambda: "<div class=menu>" + " | ".join(links(r.randint(4, 9))) + "</div>",
            lambda: "<table class=top><tr>" + "".join(f"<td>{x}</td>" for x in links(r.randint(4, 9))) + "</tr></table>",
        ]
    )()
    side = "<div class=side><h4>" + drop(label()) + "</h4><ul>" + "".join(f"<li>{x}</li>" for x in links(r.randint(3, 8))) + "</ul></div>" if r.random() < 0.7 else ""
    foot = "<footer><div>" + drop("Imprint " + label(1)) + "</div><div>" + " ".join(links(3)) + "</div></footer>" if r.random() < 0.8 else ""
    block = r.choice(["p", "div"])
    body = [f"<h1>{keep(label())}</h1>"]
    for _ in range(r.randint(3, 9)):
        body.append(f"<h2>{keep(label(1))}</h2>" if r.random() < 0.3 else "")
        body.append(f"<{block}>{keep(' '.join(prose(r) for _ in range(r.randint(1, 5))))}</{block}>")
        what = r.random()
        if what < 0.15:
            body.append(f"<div>{keep('Range is ' + label(1))}</div><div>{keep('Status ' + label(1))}</div>")
        elif what < 0.3:
            body.append("<ul>" + "".join(f"<li>{keep(prose(r, 3, 6))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
        elif what < 0.45:
            body.append(f"<p><a href=x>{keep(label())}</a></p>")
        elif what < 0.6:
            body.append(f"<{block}>{keep(prose(r))} <a href=x>{keep(label(1))}</a> {keep(prose(r))}</{block}>")
        elif what < 0.7:
            body.append("<table>" + "".join(f"<tr><td>{keep(label(1))}</td><td>{keep(str(r.randint(1000, 99999)))}</td></tr>" for _ in range(3)) + "</table>")
    wrap = r.choice(["<div class=article>{}</div>", "<article>{}</article>", "<div id=main><div class=text>{}</div></div>", "<td>{}</td>"])
    main = wrap.format("".join(body))
    main = f"<table><tr>{main}<td>{side}</td></tr></table>" if wrap.startswith("<td") else main + side
    return f"<html><body>{menu}{main}{foot}</body></html>", stay, go


def test_boilerplate_goes_and_articles_stay():
    r = random.Random(9)
    kept_good = all_good = kept_bad = all_bad = 0
    for _ in range(300):
        text, stay, go = page(r)
        clean = read_markup(text)[0]
        kept_good += sum(len(t) for t in stay if t in clean)
        all_good += sum(map(len, stay))
        kept_bad += sum(len(t) for t in go if t in clean)
        all_bad += sum(map(len, go))
    assert kept_bad / all_bad <= 0.06
    assert kept_good / all_good >= 0.99 and kept_good / (kept_good + kept_bad) >= 0.95


def test_short_facts_links_and_headings_of_an_article_stay():
    text = (
        '<ul class="nav"><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/c">Contact</a></li></ul><div class="article"><h1>Fox</h1><p>The fox lives in woods, near water. It is small.</p>'
        '<div>Range is Europe</div><div>Status vulnerable</div><p>It eats mice; it sleeps by day.</p><p><a href="x">Vulpes vulpes</a></p><p>A last paragraph without any comma</p></div>'
    )
    clean = read_markup(text)[0]
    for part in ("# Fox", "The fox lives", "Range is Europe", "Status vulnerable", "It eats mice", "Vulpes vulpes", "A last paragraph"):
        assert part in clean
    assert "Contact" not in clean


@pytest.mark.parametrize("mark", ["<ref name=a>", "<ref>", "<!--", "<div>", "<script>", "<style>", "{{cite|", "[[", "<table><tr><td>", "{|\n"])
def test_unclosed_marks_lose_no_text(mark):
    rest = "Smith wrote this in May.\n\nThe rest of the section is long. " * 5
    assert all(s in read_markup(f"Title here.{mark}{rest}")[0] for s in ("Title here.", "Smith wrote this in May.", "The rest of the section is long."))


def test_deeply_nested_marks():
    assert read_markup("{{a|" * 40 + "x" + "}}" * 40 + " y")[0].strip() == "y"
    assert read_markup("\\textit{" * 40 + "x" + "}" * 40)[0] == "x"
    assert read_markup(" kept <b>x</b>")[0] == " kept x"


def test_stray_and_long():
    for text in ("<b>", "</b></i>", "{{a", "[[", "$$", "```", "**", "{| x", "\\begin{x}", "<!-- open", "<pre>open", "&", "\\"):
        read_markup(text)
    read_markup("a b <i>c</i> " * 40_000)
    read_markup("{" * 5000 + "[" * 5000 + "*" * 5000 + "<" * 5000 + "`" * 5000 + "$" * 5000)


def test_frame(spark):
    rows = [("a", "**x**", 1), ("a", "**x**", 1), ("b", None, 2), ("c", "", 3), (None, "<b>y</b>", 4)]
    df = spark.createDataFrame(rows, "id string, contents string, clean int")
    out = clean_markup(df, ["id"], "contents")
    assert sorted((r["id"] or "", r["clean"]) for r in out.where("clean is not null").collect()) == [("", "y"), ("a", "x"), ("a", "x"), ("c", "")]
    assert out.where("clean is null").count() == 1 and clean_markup(df.limit(0), ["id"], "contents").count() == 0
