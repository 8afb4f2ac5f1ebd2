"""HTML, Markdown, wiki and LaTeX markup to clean text that keeps its structure.

A text is read into one tree whatever its markup. Every construct of the four families becomes an element (`[[a]]`, `[a](b)`
and `<a>` alike a link, `== a ==`, `# a` and `<h2>` a heading, ...), a leaf (code and formulas, which stay as they are) or a
hidden node (comments, citations, templates); character references and escapes are nodes too. What lies between block
elements is a text unit with a root-to-leaf tag path.

Content is chosen by tag-path ratios. Text length, punctuation and the share of text in links are summed up per path and
divided by the path's units. The ratios are fused by multiplication, smoothed over the sequence of units by a Gaussian that
is weighted by how much of their paths two units share, and cut at a share of their standard deviation. A unit below the cut
stays where it lies among content: where the nearest element that holds content holds some directly, or in a branch named
like the unit's, unless the unit's branch is a run of links. No element's name decides what is lost.

A text holds markup exactly when its tree holds an element, a leaf or a hidden node of one of the families.

Defined cases: NULL gives NULL, empty text stays empty, text without markup comes back unchanged; an opening mark whose end is
missing (`<ref>`, `<!--`, a tag, a brace) is taken out or left as it is, but the text behind it stays; repeated rows are
each converted; very long texts are read whole; columns other than the keys and the text are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("html", "markdown", "wiki", "latex")

# Element names, with the ones that break lines, hold items, or only frame content.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption "
    "center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee "
    "menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script "
    "search section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead "
    "time title tr track tt u ul var video wbr "
    "ref references nowiki gallery math syntaxhighlight onlyinclude noinclude includeonly poem".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main menu nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPTIONAL_END = frozenset("html head body p li dt dd option optgroup tr td th thead tbody tfoot colgroup".split())
LISTS = frozenset("ul ol table dl".split())

#: Width of the smoothing in units, the share of the standard deviation that content must reach, and what makes a run of links.
SMOOTHING, CUT, RUN_LINKS, RUN_SHARE = 1.0, 0.7, 3, 0.5

# LaTeX commands without an argument, or recognised even without one.
COMMANDS = (
    "item|hline|toprule|midrule|bottomrule|centering|noindent|newline|newpage|clearpage|maketitle|tableofcontents|bf|it|em|tt|sc|rm|sf|sl|"
    "bfseries|itshape|small|large|Large|footnotesize|tiny|quad|qquad|par|LaTeX|TeX|ldots|dots|times|cdot|alpha|beta|gamma|delta|mu|sigma|pm|leq|geq"
)
# Accents as combining characters.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "H": "\u030b", "r": "\u030a", "u": "\u0306", "k": "\u0328"}

#: Stands for the # of headings that were found already.
HASH = "\ue006"
#: Marks in a text: an element opens, closes, and a leaf stands, each with its number in digits that are no word characters.
_DIGITS = dict(zip("0123456789", "\ue010\ue011\ue012\ue013\ue014\ue015\ue016\ue017\ue018\ue019", strict=True))
_NUMBER = {ord(v): k for k, v in _DIGITS.items()}
_D = "[\ue010-\ue019]+"
_MARKS = f"(?:\ue000{_D}\ue001|\ue003{_D}\ue002)*"
_STEP = re.compile(f"(?P<open>\ue000{_D}\ue001)|(?P<close>\ue003{_D}\ue002)|(?P<leaf>\ue004{_D}\ue005)|(?P<gap>\\n[ \\t]*\\n\\s*)|(?P<line>\\n)")
_LEAF = re.compile(f"\ue004({_D})\ue005")
_OWN = re.compile("[\ue000-\ue01f]")
_ANY = re.compile(r"[<&*_`#|\[\]{}\\$~]|''|^[=>+-]|^\d+[.)] ", re.M)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?)\s*(/?)>")
_COMMENT = re.compile(r"<!--.*?-->|<!--|<!DOCTYPE[^>]*>|<!\[CDATA\[|\]\]>|<\?xml[^>]*\?>", re.S | re.I)
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_UNSHOWN = re.compile(r"<(script|style|template|svg)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id)\s*=\s*[\"']?([\w-]+)", re.I)

_FENCE = re.compile(r"^(?P<open>[ \t>]*(?:[^\w\s`~]{1,4}[ \t]+)*(?P<marks>`{3,}|~{3,}))[ \t]*(?P<info>[^\n`]*)\n(?P<code>.*?)(?:^[ \t>]*(?P=marks)[`~]*[ \t]*$|\Z)", re.M | re.S)
_PRE = re.compile(r"<(pre|syntaxhighlight|source)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_NOWIKI = re.compile(r"<nowiki\s*>(.*?)</nowiki\s*>", re.S | re.I)
_CODE = re.compile(r"(?<![`\\])(`{1,2})(?!`)(\S|\S.*?\S)\1(?!`)")
_FORMULAS = (
    re.compile(r"\$\$(?!\s*\$)(.+?)\$\$", re.S),
    re.compile(r"\\\[(.+?)\\\]", re.S),
    re.compile(r"\\\((.+?)\\\)", re.S),
    re.compile(r"\\begin\{(?:equation|align|gather|multline|eqnarray|displaymath|math)\*?\}(.+?)\\end\{(?:equation|align|gather|multline|eqnarray|displaymath|math)\*?\}", re.S),
    re.compile(r"<math\b[^>]*>(.+?)</math\s*>", re.S | re.I),
    re.compile(r"(?<![\w$\\])\$(?![\s$])((?:[^$\n]|\\\$)*?[\\^_={}+*/<>()][^$\n]*?|[A-Za-z])(?<![\s\\])\$(?![\w$])"),
)

_HEADING_WIKI = re.compile(r"^(={2,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*$", re.M)
_TEMPLATE = re.compile(r"\{\{(?![{|}])([^{}]*(?:\{(?!\{)[^{}]*\}(?!\})[^{}]*)*)\}\}")
_REF = re.compile(r"<ref\b[^>/]*/>|<ref\b[^>]*>(?:(?!<ref\b).)*?</ref\s*>", re.S | re.I)
_LINK_WIKI = re.compile(r"\[\[([^\[\]\n]+?)\]\]")
_MEDIA = re.compile(r"\s*(?:file|image|category|media)\s*:", re.I)
_LINK_OUT = re.compile(r"\[(?:https?|ftp)://[^\s\[\]]+([^\[\]\n]*)\](?!\()")
_QUOTES = re.compile("(?<![\\w'\ue002])('{5}|'''|'')(?=[^\\s'])([^\\n]*?[^\\s'])\\1(?!['\\w\ue000])")
_MAGIC = re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX|HIDDENCAT|NOGALLERY|NEWSECTIONLINK)__")
_TABLE_WIKI = re.compile(r"^\{\|[^\n]*\n((?:(?!^\{\||^\|\}).)*?)^\|\}[ \t]*|^\{\|[^\n]*(?:\n|\Z)((?:^[|!][^\n]*(?:\n|\Z))*)", re.M | re.S)
_ITEM_WIKI = re.compile(rf"^(?!#+[ \t])[*#:;]{{2,}}[ \t]+(?={_MARKS}\w)", re.M)

_BEGIN = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}")
_DROPPED = re.compile(r"~?\\(?:cite[a-z]*|ref|label|eqref|pageref|footnotemark|usepackage|documentclass|bibliography|bibliographystyle|vspace|hspace|includegraphics|input)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}")
_COMMAND = re.compile("(?<![\\w:\\\\\ue002])" r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}|" "(?<=[\\w}\ue002])" r"\\((?:text|emph|mathrm|math|footnote|url)[a-z]*)\{([^{}]*)\}")
_SWITCH = re.compile(r"\{\\(?:bf|it|em|tt|sc|rm|sf|sl|bfseries|itshape|small|large|footnotesize)\b\s*([^{}]*)\}")
_BARE = re.compile(rf"(?<![\w:\\])\\(?:{COMMANDS})(?![A-Za-z\\{{])[ \t]*")
_ACCENT = re.compile(r"\\(?:(['`^\"~=.])(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))|([cvHruk])\{([A-Za-z])\})")
_ESCAPE = re.compile(r"(?<![\\:])\\([%&_#${}])")
_CELL_LATEX = re.compile(r"[ \t]*(?<!\\)&[ \t]*(?=[^\n]*\\\\[ \t]*$)", re.M)
_ROW_LATEX = re.compile(r"[ \t]*\\\\(?:\[[^\]\n]*\])?[ \t]*$", re.M)

_ATX = re.compile(rf"(?:^|(?<=\s))(#{{2,6}})[ \t]+(?=\S)|^(#)[ \t]+(?={_MARKS}[^\W\d])", re.M)
_SETEXT = re.compile(r"^[ \t]*(?=[^\s|])([^\n]+)\n[ \t]{0,3}(={3,}(?=[ \t]*$|[ \t]*<|[ \t]+\S)|-{3,}(?=[ \t]*$))", re.M)
_IMAGE = re.compile(r"!\[([^\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)")
_LINK = re.compile(r"(?<!!)\[([^\[\]\n]+)\]\((?:[^()\s]|\([^()\s]*\))+(?:\s+\"[^\"\n]*\")?\)")
_LINK_REF = re.compile("(?<![\\w\\]\ue002])" r"\[([^\[\]\n]+)\]\[([^\[\]\n]{0,40})\]")
_DEFINITION = re.compile(r"^[ \t]{0,3}\[(?!\^)[^\]\n]+\]:[ \t]+\S+[^\n]*$\n?", re.M)
_AUTOLINK = re.compile(r"<((?:https?|ftp)://[^\s<>]+|[\w.+-]+@[\w.-]+\.\w+)>")
_NOTE = re.compile(r"^\[\^([^\]\s]+)\]:[ \t]*", re.M)
_NOTE_MARK = re.compile(r"\[\^[^\]\s]+\]")
_STRONG = re.compile("(?<![\\w*_\\\\\ue002])" r"(\*{1,3}|_{1,3})(?![\s*_])((?:(?!\1)[^\n]|(?<=\s)\1(?=\s))*?[^\s*_\\]|[^\s*_\\])\1" "(?![\\w*_\ue000])")
_STRIKE = re.compile(r"~~(?=\S)([^~\n]*?\S)~~")
_TASK = re.compile(r"^([ \t]*[-*+][ \t]+)\[[ xX]\][ \t]+", re.M)
_QUOTE = re.compile("(?:^|(?<=[^\\w\\s\ue002] ))" rf">[ \t]?(?={_MARKS}(?:[^\W\d]|[*_\"“]))", re.M)
_RULE_ROW = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$\n?", re.M)
_PIPE_ROW = re.compile(r"^[ \t]*\|[ \t]*([^\n|]*(?:\|[^\n|]*)+?)[ \t]*\|[ \t]*$", re.M)
_BULLETS = re.compile(r"(?:^[ \t]*[-*+][ \t]+\S[^\n]*(?:\n|\Z)){2,}", re.M)
_NUMBERS = re.compile(r"(?:^[ \t]*\d{1,3}[.)][ \t]+\S[^\n]*(?:\n|\Z)){2,}", re.M)


def _number(text: str) -> int:
    return int(text[1:-1].translate(_NUMBER))


class Unit:
    """A text between block elements: its tag path, the numbers and names of the block elements around it, and its sums."""

    __slots__ = ("path", "chain", "names", "chars", "points", "linked", "links")

    def __init__(self, path: tuple[str, ...], chain: tuple[int, ...] = (), names: tuple[str, ...] = ()):
        self.path, self.chain, self.names, self.links = path, chain, names, set()
        self.chars = self.points = self.linked = 0


class _Element:
    __slots__ = ("number", "name", "base", "mark", "line", "block")

    def __init__(self, number: int, name: str, mark: int, line: bool, block: bool):
        self.number, self.name, self.base, self.mark, self.line, self.block = number, name, name.partition(".")[0], mark, line, block


class _Reader:
    """One text's tree and its converted form."""

    def __init__(self, text: str):
        self.counts: Counter[str] = Counter()
        #: what each mark stands for: (family, element, ends with its line, is a block) or (family, text as it stands)
        self.marks: list[tuple] = []
        self.kept_share = 1.0
        self.units: list[Unit] = []
        self.text = self.convert(text) if _ANY.search(text) else text

    def _new(self, *what) -> str:
        self.marks.append(what)
        return "".join(_DIGITS[d] for d in str(len(self.marks) - 1))

    def leaf(self, family: str | None, shown: str) -> str:
        return f"\ue004{self._new(family, shown)}\ue005"

    def wrap(self, family: str, name: str, inner: str, block: bool = False) -> str:
        if not inner:
            return self.hide(family)
        d = self._new(family, name, False, block)
        return f"\ue000{d}\ue001{inner}\ue003{d}\ue002"

    def line(self, family: str, name: str, inner: str = "") -> str:
        """An element that ends with its line."""
        return f"\ue000{self._new(family, name, True, True)}\ue001{inner}"

    def hide(self, family: str, shown: str = "") -> str:
        """A node that no text belongs to."""
        self.counts[family] += 1
        return shown

    def take_out(self, family: str, pattern: re.Pattern, text: str, shown: str = "") -> str:
        return pattern.sub(lambda m: self.hide(family, m.expand(shown)), text)

    def wrap_all(self, family: str, pattern: re.Pattern, name: str, text: str, group: int = 1) -> str:
        return pattern.sub(lambda m: self.wrap(family, name, m[group]), text)

    @staticmethod
    def until_settled(change, text: str) -> str:
        """Innermost constructs first, until none is left."""
        while (changed := change(text)) != text:
            text = changed
        return text

    def convert(self, text: str) -> str:
        text = _OWN.sub(lambda m: self.leaf(None, m[0]), text)
        text = _FENCE.sub(lambda m: "\n" + self.leaf("markdown", f"```{m['info'].strip()}\n{m['code'].rstrip()}\n```") + "\n", text)
        text = _PRE.sub(lambda m: "\n" + self.leaf("html", "```\n" + html.unescape(_TAG.sub("", m[2])).strip("\n") + "\n```") + "\n", text)
        text = _NOWIKI.sub(lambda m: self.leaf("wiki", m[1]), text)
        text = _CODE.sub(lambda m: self.leaf("markdown", f"`{m[2]}`"), text)
        for pattern in _FORMULAS:
            family = "html" if "<math" in pattern.pattern else "latex"
            text = pattern.sub(lambda m, f=family: self.leaf(f, f"${' '.join(m[1].split())}$"), text)
        text = self.take_out("html", _COMMENT, text)
        text = self.take_out("html", _UNSHOWN, text)
        text = self.html(self.markdown(self.latex(self.wiki(text))))
        text = self.render(self.walk(text)).replace(HASH, "#")
        while _LEAF.search(text):  # leaves may hold one another, the later ones the earlier
            text = _LEAF.sub(lambda m: self.marks[int(m[1].translate(_NUMBER))][1], text)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.M)).strip("\n")

    def wiki(self, text: str) -> str:
        text = self.take_out("wiki", _REF, text)
        text = self.until_settled(lambda t: _TEMPLATE.sub(self._template, t), text)
        text = _TABLE_WIKI.sub(self._wiki_table, text)
        text = _LINK_WIKI.sub(self._wiki_link, text)
        text = _LINK_OUT.sub(lambda m: self.wrap("wiki", "a", m[1].strip()), text)
        text = _HEADING_WIKI.sub(lambda m: self.line("wiki", f"h{len(m[1])}", HASH * len(m[1]) + " " + m[2]), text)
        text = self.until_settled(lambda t: _QUOTES.sub(lambda m: self.wrap("wiki", "i" if m[1] == "''" else "b", m[2]), t), text)
        text = self.take_out("wiki", _MAGIC, text)
        return _ITEM_WIKI.sub(lambda m: self.line("wiki", "li", "- "), text)

    def _template(self, m: re.Match) -> str:
        name, *args = (a.strip() for a in m[1].split("|"))
        plain = [a for a in args if not re.match(r"[\w -]+=", a)]
        if name.lower() in ("lang", "transl", "langx") and len(plain) >= 2:
            return self.wrap("wiki", "lang", plain[-1])
        if name.lower() in ("convert", "cvt") and len(plain) >= 2:
            return self.wrap("wiki", "measure", f"{plain[0]} {plain[1]}")
        if name.lower() in ("nowrap", "small", "big", "em", "strong", "code", "mono", "bold", "quote") and plain:
            return self.wrap("wiki", "span", plain[0])
        return self.hide("wiki")

    def _wiki_table(self, m: re.Match) -> str:
        rows: list[list[str]] = [[]]
        for line in (m[1] if m[1] is not None else m[2] or "").split("\n"):
            line = line.strip()
            if line.startswith("|-"):
                rows.append([])
            elif line.startswith("|+"):
                rows.insert(0, [line[2:].strip()])
            elif line[:1] in ("|", "!"):
                cells = re.split(r"\|\||!!", line[1:])
                rows[-1] += [re.sub(r"^[^|\[\]]*=[^|\[\]]*\|(?!\|)", "", c).strip() for c in cells]
            elif line and rows[-1]:
                rows[-1][-1] += " " + line
            elif line:
                rows += [[line], []]
        return "\n".join([self.hide("wiki"), *(self.line("wiki", "tr", " | ".join(r)) for r in rows if r)]).strip("\n") + "\n"

    def _wiki_link(self, m: re.Match) -> str:
        target, *shown = m[1].split("|")
        if _MEDIA.match(target):
            return self.wrap("wiki", "caption", shown[-1] if len(shown) > 1 and not re.match(r"\s*category", target, re.I) else "")
        return self.wrap("wiki", "a", shown[-1] if shown else target)

    def latex(self, text: str) -> str:
        text = self.take_out("latex", _DROPPED, text)
        level = {"part": 1, "chapter": 1, "section": 2, "subsection": 3}
        text = _SECTION.sub(lambda m: self.wrap("latex", f"h{level.get(m[1], 4)}", HASH * level.get(m[1], 4) + f" {m[2]}", block=True), text)
        if "\\begin{tab" in text or "\\begin{array" in text:
            text = _CELL_LATEX.sub(lambda m: self.hide("latex", " | "), text)
        text = self.take_out("latex", _BEGIN, text)
        text = self.take_out("latex", _ROW_LATEX, text)
        text = _ACCENT.sub(self._accent, text)
        text = self.wrap_all("latex", _SWITCH, "span", text)
        text = self.until_settled(lambda t: _COMMAND.sub(self._command, t), text)
        text = _ITEM_LATEX.sub(lambda m: self.line("latex", "li", "- "), text)
        text = self.take_out("latex", _BARE, text)
        return self.take_out("latex", _ESCAPE, text, r"\1")

    def _command(self, m: re.Match) -> str:
        name, inner = (m[1], m[2]) if m[1] else (m[3], m[4])
        return self.wrap("latex", {"textbf": "b", "textit": "i", "emph": "i", "url": "a", "href": "a"}.get(name, name), inner)

    def _accent(self, m: re.Match) -> str:
        mark, letter = (m[1], m[2] or m[3]) if m[1] else (m[4], m[5])
        return self.hide("latex", unicodedata.normalize("NFC", letter + ACCENTS[mark]))

    def markdown(self, text: str) -> str:
        text = self.take_out("markdown", _DEFINITION, text)
        text = self.wrap_all("markdown", _IMAGE, "caption", text)
        text = self.wrap_all("markdown", _LINK, "a", text)
        text = self.wrap_all("markdown", _AUTOLINK, "a", text)
        text = self.wrap_all("markdown", _LINK_REF, "a", text)
        text = _NOTE.sub(lambda m: self.line("markdown", "note", f"Note {m[1]}: "), text)
        text = self.take_out("markdown", _NOTE_MARK, text)
        text = self.take_out("markdown", _RULE_ROW, text)
        text = _PIPE_ROW.sub(lambda m: self.line("markdown", "tr", " | ".join(c.strip() for c in m[1].split("|"))), text)
        text = _SETEXT.sub(lambda m: self.line("markdown", "h1" if m[2][0] == "=" else "h2", HASH * (1 if m[2][0] == "=" else 2) + f" {m[1].strip()}"), text)
        text = _ATX.sub(lambda m: self.line("markdown", f"h{len(m[1] or m[2])}", m[0]), text)
        text = self.take_out("markdown", _TASK, text, r"\1")
        text = _QUOTE.sub(lambda m: self.line("markdown", "blockquote"), text)
        for pattern in (_BULLETS, _NUMBERS):
            text = pattern.sub(lambda m: _LINE_START.sub(lambda _: self.line("markdown", "li"), m[0]), text)
        text = self.until_settled(lambda t: _STRONG.sub(lambda m: self.wrap("markdown", "i" if len(m[1]) == 1 else "b", m[2]), t), text)
        return self.wrap_all("markdown", _STRIKE, "s", text)

    def html(self, text: str) -> str:
        """Tags become marks; what character references hid once more is read again."""
        text = _TAG.sub(self._tag, text)
        before = text
        text = _REFERENCE.sub(lambda m: self.hide("html", html.unescape(m[0])) if html.unescape(m[0]) != m[0] else m[0], text)
        return _TAG.sub(self._tag, text) if "<" in text and text != before else text

    def _tag(self, m: re.Match) -> str:
        base = m[2].lower()
        if base not in ELEMENTS:
            return m[0]
        named = _NAMED.search(m[3])
        name = f"{base}.{named[1].lower()}" if named else base
        d = self._new("html", name, False, base in BLOCKS, "/" if m[1] else "+", base in VOID or bool(m[4]))
        return f"\ue000{d}\ue001"

    def _ended(self, steps: Sequence[re.Match]) -> set[int]:
        """Tags that never end although they should; they hold nothing."""
        lost, waiting, many = set(), [], Counter()
        for m in steps:
            if m.lastgroup == "open" and len(mark := self.marks[i := _number(m[0])]) == 6:
                base = mark[1].partition(".")[0]
                if mark[4] == "+" and not mark[5]:
                    waiting.append((base, i))
                    many[base] += 1
                elif mark[4] == "/" and many[base]:
                    while waiting[-1][0] != base:
                        many[waiting[-1][0]] -= 1
                        lost.add(waiting.pop()[1])
                    waiting.pop()
                    many[base] -= 1
        return lost | {i for _, i in waiting}

    def walk(self, text: str) -> list[tuple]:
        """Steps to write the text by: (kind, text, unit or element). Elements, leaves and units of the tree are counted on the way."""
        steps = list(_STEP.finditer(text))
        endless = self._ended(steps)
        out: list[tuple] = []
        stack: list[_Element] = []
        made = 0
        unit: Unit | None = None

        def leave(depth: int) -> None:
            nonlocal unit
            while len(stack) > depth:
                gone = stack.pop()
                if gone.block:
                    unit = None
                out.append(("end", "", gone.number))

        def add(piece: str, shown: str | None = None) -> None:
            nonlocal unit
            if not piece:
                return
            if not piece.strip():
                out.append(("text", piece, None))
                return
            if unit is None:
                unit = Unit(tuple(e.name for e in stack), tuple(e.number for e in stack if e.block), tuple(e.name for e in stack if e.block))
                self.units.append(unit)
            else:  # the path of the unit is what all its text shares
                own = tuple(e.name for e in stack)
                shared = next((i for i, (x, y) in enumerate(zip(unit.path, own, strict=False)) if x != y), min(len(own), len(unit.path)))
                unit.path = unit.path[:shared]
            n = len((shown or piece).strip())
            unit.chars += n
            unit.points += len(_PUNCTUATION.findall(shown or piece))
            link = next((e.number for e in stack if e.base == "a"), None)
            if link is not None:
                unit.linked += n
                unit.links.add(link)
            out.append(("text", piece, unit))

        at = 0
        for m in steps:
            add(text[at : m.start()])
            at = m.end()
            kind = m.lastgroup
            if kind in ("gap", "line"):
                line = next((i for i, e in enumerate(stack) if e.line), None)
                if line is not None:
                    leave(line)
                if kind == "gap":
                    unit = None
                out.append(("text", m[0], None))
                continue
            i = _number(m[0])
            mark = self.marks[i]
            if kind == "leaf":
                if mark[0]:
                    self.counts[mark[0]] += 1
                add(m[0], mark[1])
            elif kind == "close":
                found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].mark == i), None)
                if found is not None:
                    leave(found)
            elif len(mark) == 4:
                self.counts[mark[0]] += 1
                made += 1
                stack.append(_Element(made, mark[1], i, mark[2], mark[3]))
                unit = None if mark[3] else unit
            else:  # a tag
                self.counts["html"] += 1
                base, block = mark[1].partition(".")[0], mark[3]
                if mark[4] == "/":
                    found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].base == base and stack[k].mark >= 0 and len(self.marks[stack[k].mark]) == 6), None)
                    if found is not None:
                        leave(found)
                    out.append(("break", self._break("/", base), None))
                else:
                    if base in OPTIONAL_END:  # its end tag was left out
                        found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].base == base), None)
                        if found is not None and not LISTS & {e.base for e in stack[found + 1 :]} and base not in ("html", "body"):
                            leave(found)
                    made += 1
                    out.append(("break", self._break("+", base), None))
                    if prefix := ("#" * int(base[1]) + " " if re.fullmatch("h[1-6]", base) else "- " if base == "li" else ""):
                        out.append(("prefix", prefix, made))
                    if not mark[5] and (i not in endless or base in OPTIONAL_END):
                        stack.append(_Element(made, mark[1], i, False, block))
                    unit = None if block else unit
        add(text[at:])
        return out

    @staticmethod
    def _break(side: str, base: str) -> str:
        if base in ("td", "th"):
            return " | " if side == "+" else ""
        if base == "br" or (base == "hr" and side == "+"):
            return "\n"
        return "\n" if base in BLOCKS else ""

    def render(self, steps: list[tuple]) -> str:
        chosen = dict(zip(map(id, self.units), content_units(self.units), strict=True))
        self.kept_share = sum(chosen.values()) / len(chosen) if chosen else 1.0
        out: list[str] = []
        waiting: list[tuple[int, str]] = []
        for kind, text, of in steps:
            if kind == "prefix":
                waiting.append((of, text))
            elif kind == "end":
                waiting = [w for w in waiting if w[0] != of]
            elif kind == "break" or of is None:
                out.append(text)
            elif chosen[id(of)]:
                out += [w[1] for w in waiting]
                waiting = []
                out.append(text)
        text = re.sub(r"[ \t]*\n[ \t]*\|[ \t]+", "\n", "".join(out))
        return re.sub(r"^[ \t|]*\|[ \t|]*$", "", text, flags=re.M) if self.kept_share < 1 else text


_PUNCTUATION = re.compile(r"[.,;:!?\u3002\uff0c\uff01\uff1f\u3001()\"'\u201c\u201d-]")
_ITEM_LATEX = re.compile(r"(?<![\w:\\])\\item(?![A-Za-z])(?:\[[^\]\n]*\])?[ \t]*")
_LINE_START = re.compile(r"^(?=[ \t]*\S)", re.M)


def path_ratios(units: Sequence[Unit]) -> np.ndarray:
    """Smoothed fused ratio of each unit: text outside links and punctuation, each per unit of the same path."""
    length, linked, points, many = Counter(), Counter(), Counter(), Counter()
    for u in units:
        length[u.path] += u.chars
        linked[u.path] += u.linked
        points[u.path] += u.points
        many[u.path] += 1
    # logarithms keep one long unit from setting the scale
    fused = np.array([np.log1p((length[u.path] - linked[u.path]) / many[u.path]) * (1 + np.log1p(points[u.path] / many[u.path])) for u in units])
    reach = max(1, int(3 * SMOOTHING))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SMOOTHING) ** 2)
    weights /= weights.sum()
    out = fused * weights[reach]
    for step in range(1, reach + 1):
        for i in range(len(units) - step):
            a, b = units[i].path, units[i + step].path
            shared = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            alike = (shared + 1) / (max(len(a), len(b)) + 1) * weights[reach + step]
            out[i] += alike * fused[i + step]
            out[i + step] += alike * fused[i]
    return out


def content_units(units: Sequence[Unit]) -> list[bool]:
    """Which of a page's units are content."""
    if not units:
        return []
    ratios = path_ratios(units)
    content = ratios >= CUT * ratios.std()
    # elements that hold content anywhere, those that hold it among their own texts or children, and names of children that do
    holds, direct, alike = set(), set(), set()
    for u, yes in zip(units, content, strict=True):
        if yes:
            holds |= {0, *u.chain}
            direct |= {(0, *u.chain)[-1], (0, 0, *u.chain)[-2]}
            alike |= set(zip((0, *u.chain), u.names, strict=False))
    # links and text of each branch that holds no content
    chars, linked, links = Counter(), Counter(), Counter()
    for u, yes in zip(units, content, strict=True):
        if not yes:
            for e in u.chain:
                chars[e] += u.chars
                linked[e] += u.linked
                links[e] += len(u.links)
    out = []
    for u, yes in zip(units, content, strict=True):
        if not yes:
            chain = (0, *u.chain)
            last = max(i for i, e in enumerate(chain) if e in holds)
            near = chain[last] in direct
            if last + 1 < len(chain):
                branch = chain[last + 1]
                near = near or (chain[last], u.names[last]) in alike
                run = links[branch] >= RUN_LINKS and linked[branch] >= RUN_SHARE * chars[branch]
            else:
                run = len(u.links) >= RUN_LINKS and u.linked >= RUN_SHARE * u.chars
            yes = near and not run
        out.append(bool(yes))
    return out


def read_markup(text: str) -> tuple[str, Counter, float]:
    """(clean text, nodes of the tree by family, share of the text units kept)."""
    reader = _Reader(text)
    return reader.text, reader.counts, reader.kept_share


def clean_markup(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, clean, n_html, n_markdown, n_wiki, n_latex, kept_share. No shuffle; columns of the input may have any names."""
    names = [f"key_{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).cast("string").alias("clean"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1]) + ", clean string, " + ", ".join(f"n_{f} int" for f in FAMILIES) + ", kept_share double"

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [read_markup(t) if t else (t, Counter(), 1.0) for t in frame["clean"]]
            out = frame.assign(clean=[r[0] for r in read])
            for f in FAMILIES:
                out[f"n_{f}"] = np.array([r[1][f] for r in read], dtype="int32")
            yield out.assign(kept_share=np.array([r[2] for r in read], dtype="float64"))

    done = rows.mapInPandas(convert, schema)
    return done.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "clean", *[f"n_{f}" for f in FAMILIES], "kept_share")
