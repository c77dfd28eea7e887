"""Problem 3: markup residue in text.

Method: layout-aware rendering. HTML goes through a tree builder with implied end
tags and visibility rules; the tree is rendered as visible text with block
spacing, list items, kept code blocks and aligned table cells. Markdown, wiki and
LaTeX constructs are read by their own line and span rules and rendered to the
same plain form: headings as "# ", items as "- ", code fenced, formulas kept
between dollar signs.

Only fields with a trace of markup (a native pattern) reach Python; the others
are their own clean text.

Not markup: list dashes, plain pipes, amounts, comparisons, Windows paths, bare
brackets or braces, and the " > " of a heading path in the first line.

Defined cases: null stays null and empty stays empty, without constructs;
unclosed and misnested tags are closed where the tree says; text of any length is
read whole; copies of a row count once.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import read_table

KINDS = ("html", "markdown", "wiki", "latex")

# Element names of HTML by their part in layout.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em embed font i iframe img input ins kbd label link map mark "
    "math meta meter noscript object output param picture progress q s samp script small source span strike strong style sub sup svg template "
    "textarea time title track tt u var video wbr area base col colgroup".split()
)
HIDDEN = frozenset("head iframe meta noscript object script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the value ends when the key begins.
IMPLIED_END = {
    "li": {"li", "p"}, "p": {"p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
} | {tag: {"p"} for tag in "address article aside blockquote div dl figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: Elements that an implied end does not look beyond.
FENCES = frozenset("table ul ol dl td th body div section article".split())

_NAMES = "|".join(sorted(BLOCKS | INLINE, key=len, reverse=True))
TAG = re.compile(rf"</?(?:{_NAMES})(?:\s[^<>]*)?/?>|<!--.*?-->|<!doctype[^>]*>", re.I | re.S)
CHARREF = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});", re.I)

MD_FENCE = re.compile(r"^[ ]{0,3}(```|~~~)", re.M)
MD_HEADING = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
MD_BOLD = re.compile(r"(\*\*|__)(?=[^\s*_])(.+?)(?<=[^\s*_])\1")
MD_EMPHASIS = re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])")
MD_STRIKE = re.compile(r"~~(?=\S)(.+?)(?<=\S)~~")
MD_CODE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
MD_IMAGE = re.compile(r"!\[([^\]\n]*)\]\([^()\n]*\)")
MD_LINK = re.compile(r"(?<!!)\[([^\]\n]+)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)")
MD_QUOTE = re.compile(r"^[ ]{0,3}>[ ]+(?=\S)", re.M)
MD_RULE = re.compile(r"^[ ]*\|?[ ]*:?-{3,}:?[ ]*(?:\|[ ]*:?-{3,}:?[ ]*)+\|?[ ]*$|^[ ]*\|[ ]*:?-{3,}:?[ ]*\|[ ]*$", re.M)

WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", re.M)
WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")
WIKI_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
WIKI_QUOTES = re.compile(r"('{2,5})(?=[^'\s])(.+?)(?<=[^'])\1")
WIKI_TABLE = re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.M | re.S)
WIKI_URL = re.compile(r"\[(https?://[^\s\]]+)(?:\s+([^\]\n]+))?\]")

WINDOWS_PATH = re.compile(r"(?<![A-Za-z])[A-Za-z]:(?:\\[\w.\-]+)+\\?|\\\\[\w.\-]+(?:\\[\w.\-]+)+")
TEX_COMMAND = re.compile(r"\\[A-Za-z]{2,}\*?(?=[\s{\[\\$}^_.,;:()=+\-*/]|\d|$)|\\[%&$#_{}](?!\w*\\)|\\\\(?=\s)|\\[\[\]()]")
TEX_TIE = re.compile(r"(?<=[^\s~])~(?=[^\s~])")
_TEX_DISPLAY = re.compile(r"\\begin\{(equation|align|gather|displaymath|math|eqnarray|multline)\*?\}(.*?)\\end\{\1\*?\}", re.S)
_TEX_CODE = re.compile(r"\\begin\{(verbatim|lstlisting)\}\n?(.*?)\\end\{\1\}", re.S)
_TEX_SPAN = re.compile(r"\\(?:textbf|textit|emph|texttt|textsc|textrm|underline|mbox|text)\{([^{}]*)\}")
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}]*)\}")
_TEX_NOTE = re.compile(r"\\(?:footnote|marginpar)\{([^{}]*)\}")
_TEX_DROP = re.compile(r"\\(?:label|cite\w*|ref|pageref|index|vspace|hspace|usepackage|documentclass|centering|noindent|maketitle)\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?")


def formulas(text: str) -> list[tuple[int, int]]:
    """Spans between dollars that hold a command, a subscript or a power, not an amount."""
    spans = []
    for m in re.finditer(r"\$(?=\S)([^$\n]+)(?<=\S)\$(?!\d)", text):
        body = m.group(1)
        strip = re.sub(r"\\[A-Za-z]+|\{[^{}]*\}", " ", body)
        wordy = len(re.findall(r"[^\W\d_]{4,}", strip)) > 1
        if not wordy and re.search(r"\\[A-Za-z]|[A-Za-z0-9)}][_^][{A-Za-z0-9]|^[A-Za-z]\s*[=<>+\-*/]", body) and not re.match(r"\d[\d.,]*\s*(?:million|billion|m|bn|k)\b", body):
            spans.append(m.span())
    return spans


def detect(text: str | None, path_line: bool = False) -> set[str]:
    """Kinds of markup with at least one construct in the text."""
    if not text:
        return set()
    if path_line:
        head, _, rest = text.partition("\n")
        text = re.sub(r"^(?:[^<>\n]* > )+", "", head) + "\n" + rest
    kinds = set()
    if TAG.search(text) or CHARREF.search(text):
        kinds.add("html")
        # Markup shown through references is read as well.
        text = html.unescape(text) if CHARREF.search(text) else text
    plain = WINDOWS_PATH.sub(" ", TAG.sub(" ", text))
    spans = formulas(plain)
    if TEX_COMMAND.search(plain) or spans:
        kinds.add("latex")
    outside = plain
    for a, b in reversed(spans):
        outside = outside[:a] + " " + outside[b:]
    tables = WIKI_TABLE.search(outside)
    if tables or any(p.search(outside) for p in (WIKI_HEADING, WIKI_LINK, WIKI_TEMPLATE, WIKI_QUOTES, WIKI_URL)):
        if "latex" not in kinds or tables or any(p.search(outside) for p in (WIKI_HEADING, WIKI_LINK, WIKI_QUOTES, WIKI_URL)) or re.search(r"(?<!\\)\{\{\w[^{}]*\}\}", outside):
            kinds.add("wiki")
    rest = WIKI_TABLE.sub(" ", outside)
    if any(p.search(rest) for p in (MD_FENCE, MD_HEADING, MD_BOLD, MD_EMPHASIS, MD_STRIKE, MD_CODE, MD_IMAGE, MD_LINK, MD_QUOTE, MD_RULE)):
        kinds.add("markdown")
    if "latex" not in kinds and TEX_TIE.search(MD_STRIKE.sub(" ", rest)) and re.search(r"[.!?]~\w", rest):
        kinds.add("latex")
    return kinds


#: A step of rendering asks for parts by yielding their steps, so that any depth fits (Python's own stack does not grow).
_Steps = Generator["_Steps", object, object]


def _finish(steps: _Steps) -> str:
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


class _Node:
    __slots__ = ("children", "hidden", "tag")

    def __init__(self, tag: str, hidden: bool = False):
        self.tag, self.hidden, self.children = tag, hidden, []


class _Tree(HTMLParser):
    """Builds the element tree with implied ends; anything not a known element stays text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root")
        self.open = [self.root]
        self.names = Counter()

    def _close(self, k: int) -> None:
        self.names.subtract(node.tag for node in self.open[k:])
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag not in BLOCKS and tag not in INLINE:
            self.handle_data(self.get_starttag_text() or "")
            return
        ends = IMPLIED_END.get(tag, ())
        cut = len(self.open)
        if any(self.names[end] > 0 for end in ends):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ends:
                    cut = k
                elif self.open[k].tag in FENCES:
                    break
        self._close(cut)
        given = {k: (v or "") for k, v in attrs}
        style = given.get("style", "").replace(" ", "").lower()
        hidden = tag in HIDDEN or "hidden" in given or "display:none" in style or "visibility:hidden" in style or given.get("aria-hidden") == "true"
        node = _Node(tag, hidden)
        if tag == "img" and given.get("alt"):
            node.children.append(given["alt"])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        if len(self.open) > depth:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if self.names[tag] > 0:
            k = len(self.open) - 1
            while self.open[k].tag != tag:
                k -= 1
            self._close(k)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _table(node: _Node) -> _Steps:
    """Aligned rows of a table; its caption and whatever else stands in it as text of its own, in order."""
    parts: list[str] = []
    rows: list[list[str]] = []
    loose = _Node("#loose")

    def settle() -> _Steps:
        if rows:
            parts.append(aligned(rows))
            rows.clear()
        text = (yield _render(loose, False)).strip()
        if text:
            parts.append(text)
        loose.children = []

    def beside(child: _Node | str) -> _Steps:
        one = _Node("#one")
        one.children = [child]
        if loose.children or (yield _render(one, False)).strip():
            if rows:
                yield settle()
            loose.children.append(child)

    def begin() -> _Steps:
        if loose.children:
            yield settle()
        rows.append([])
        return rows[-1]

    def walk(part: _Node, row: list[str] | None = None) -> _Steps:
        later = []
        for child in part.children:
            tag = "" if isinstance(child, str) else child.tag
            if tag in ("td", "th"):
                # A cell without a row begins one.
                row = (yield begin()) if row is None else row
                row.append(" ".join((yield _render(child, False)).split()))
            elif tag and child.hidden:
                continue
            elif tag in ("tr", "thead", "tbody", "tfoot", "colgroup"):
                yield walk(child, (yield begin()) if tag == "tr" else None)
                row = None
            elif part.tag == "tr":
                later.append(child)
            else:
                yield beside(child)
                row = None if loose.children else row
        for child in later:
            yield beside(child)

    yield walk(node)
    yield settle()
    return "\n\n".join(parts)


def aligned(rows: list[list[str]]) -> str:
    wide = max((len(r) for r in rows), default=0)
    widths = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(wide)]
    return "\n".join("  ".join(cell.ljust(widths[c]) if c < len(r) - 1 else cell for c, cell in enumerate(r)).rstrip() for r in rows)


def _render(node: _Node, pre: bool, depth: int = 0) -> _Steps:
    out: list[str] = []
    number = 0
    for child in node.children:
        if isinstance(child, str):
            # A line break stays one where the source had it: text of mixed origin relies on it.
            out.append(child if pre else re.sub(r"[ \t\r\f\xa0]+", " ", child))
            continue
        if child.hidden:
            continue
        tag = child.tag
        if tag == "br":
            out.append("\n")
        elif tag == "hr":
            out.append("\n\n")
        elif tag == "table":
            out.append("\n\n" + (yield _table(child)) + "\n\n")
        elif tag == "pre":
            out.append("\n\n```\n" + (yield _render(child, True)).strip("\n") + "\n```\n\n")
        elif tag == "code" and not pre:
            out.append("`" + (yield _render(child, False)).strip() + "`")
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            out.append("\n\n" + "#" * int(tag[1]) + " " + " ".join((yield _render(child, False)).split()) + "\n\n")
        elif tag == "li":
            number += 1
            mark = f"{number}. " if node.tag == "ol" else "- "
            out.append("\n" + "  " * depth + mark + (yield _render(child, False, depth + 1)).strip())
        elif tag in ("ul", "ol"):
            out.append("\n" + (yield _render(child, False, depth)) + "\n")
        elif tag in ("td", "th"):
            out.append((yield _render(child, pre)).strip() + "  ")
        elif tag in BLOCKS:
            out.append("\n\n" + (yield _render(child, pre, depth)).strip() + "\n\n")
        else:
            out.append((yield _render(child, pre, depth)))
    return "".join(out)


def _tidy(text: str) -> str:
    text = re.sub(r"[ \t]+\n", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def render_html(text: str) -> str:
    tree = _Tree()
    # Comparisons such as "x < 5" are no tags: only known elements open one.
    tree.feed(re.sub(r"<(?!/?(?:" + _NAMES + r")\b|!--|!doctype)", "&lt;", text, flags=re.I))
    tree.close()
    return _tidy(_finish(_render(tree.root, False)))


def _keep(parts: list[str], text: str) -> str:
    parts.append(text)
    return f"\x00{len(parts) - 1}\x00"


def _give_back(parts: list[str], text: str) -> str:
    while re.search(r"\x00\d+\x00", text):
        text = re.sub(r"\x00(\d+)\x00", lambda m: parts[int(m.group(1))], text)
    return text


def _while_changed(pattern: re.Pattern, into: str, text: str) -> str:
    """Nested constructs from the inside out."""
    found = 1
    while found:
        text, found = pattern.subn(into, text)
    return text


def render_latex(text: str) -> str:
    kept: list[str] = []
    text = WINDOWS_PATH.sub(lambda m: _keep(kept, m.group()), text)
    text = _TEX_CODE.sub(lambda m: _keep(kept, "\n```\n" + m.group(2).strip("\n") + "\n```\n"), text)
    text = _TEX_DISPLAY.sub(lambda m: _keep(kept, "\n$" + " ".join(m.group(2).split()) + "$\n"), text)
    for a, b in reversed(formulas(text)):
        text = text[:a] + _keep(kept, text[a:b]) + text[b:]
    text = _TEX_HEAD.sub(lambda m: "\n# " + m.group(1) + "\n", text)
    text = _while_changed(_TEX_SPAN, r"\1", text)
    text = _TEX_NOTE.sub(r" (\1)", text)
    text = _TEX_DROP.sub("", text)
    text = re.sub(r"[ \t]*\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: "- " + (m.group(1) + " " if m.group(1) else ""), text)
    text = re.sub(r"\n?[ \t]*\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?[ \t]*", "\n", text)
    text = re.sub(r"\\\\(?=\s)", "\n", text)
    text = re.sub(r"\\([%&$#_{}])", r"\1", text)
    text = TEX_TIE.sub(" ", text)
    return _tidy(_give_back(kept, text))


def render_wiki(text: str) -> str:
    def table(m: re.Match) -> str:
        rows: list[list[str]] = [[]]
        for line in m.group().split("\n")[1:]:
            line = line.strip()
            if line.startswith("|-"):
                rows.append([])
            elif line.startswith(("|", "!")) and not line.startswith("|}"):
                rows[-1] += [c.split("|")[-1].strip() for c in re.split(r"\|\||!!", line[1:])]
        return aligned([r for r in rows if r])

    text = WIKI_TABLE.sub(table, text)
    text = re.sub(r"^[*#]+[ \t]+", "- ", text, flags=re.M)
    text = WIKI_HEADING.sub(lambda m: "#" * len(m.group(1)) + " " + m.group(2), text)
    text = _while_changed(WIKI_TEMPLATE, "", text)
    text = WIKI_LINK.sub(lambda m: "" if re.match(r"(?i)(category|file|image|kategorie|catégorie|categoría):", m.group(1)) else m.group(1).split("|")[-1], text)
    text = WIKI_URL.sub(lambda m: m.group(2) or m.group(1), text)
    text = WIKI_QUOTES.sub(r"\2", text)
    return _tidy(text)


def render_markdown(text: str) -> str:
    kept: list[str] = []
    text = re.sub(r"^[ ]{0,3}(```|~~~)[^\n]*\n(.*?)(?:^[ ]{0,3}\1[^\n]*$|\Z)", lambda m: _keep(kept, "```\n" + m.group(2).rstrip("\n") + "\n```"), text, flags=re.M | re.S)
    text = MD_CODE.sub(lambda m: _keep(kept, m.group(1)), text)
    for a, b in reversed(formulas(text)):
        text = text[:a] + _keep(kept, text[a:b]) + text[b:]

    def table(m: re.Match) -> str:
        lines = [line.strip().strip("|") for line in m.group().strip("\n").split("\n")]
        return "\n" + aligned([[c.strip() for c in line.split("|")] for line in lines if not re.fullmatch(r"[\s:|\-]+", line)]) + "\n"

    text = re.sub(r"(?:^[ ]*\|[^\n]*\|[ ]*(?:\n|\Z)){2,}", table, text, flags=re.M)
    text = MD_HEADING.sub(lambda m: m.group(1) + " " + m.group(2), text)
    text = MD_IMAGE.sub(r"\1", text)
    text = MD_LINK.sub(r"\1", text)
    text = MD_BOLD.sub(r"\2", text)
    text = MD_EMPHASIS.sub(r"\1", text)
    text = MD_STRIKE.sub(r"\1", text)
    text = MD_QUOTE.sub("", text)
    return _tidy(_give_back(kept, text))


def clean(text: str | None, path_line: bool = False) -> tuple[str | None, set[str]]:
    """Plain text and the kinds of markup found in it."""
    kinds = detect(text, path_line)
    if not kinds:
        return text, kinds
    head = ""
    if path_line and " > " in text.partition("\n")[0]:
        head, _, text = text.partition("\n")
        head += "\n"
    if "html" in kinds:
        text = render_html(text)
        if TAG.search(text):
            text = render_html(text)
    if "latex" in kinds:
        text = render_latex(text)
    if "wiki" in kinds:
        text = render_wiki(text)
    if "markdown" in kinds:
        text = render_markdown(text)
    return head + text, kinds


#: Traces that any construct leaves; everything else never leaves the JVM.
TRACE = (
    r"(?m)<[A-Za-z!/]|&#?\w+;|\\|``|`[^`\n]+`|\*\*|\*\S[^*\n]*\*|__\S|\]\(|~|^\s{0,3}#{1,6}\s|^\s{0,3}>\s|\|\s*:?-{3}|''|^==|\[\[|\{\{|^\{\||\[https?:"
    r"|\$[^$\n]*[_^=<>+*/-][^$\n]*\$"
)


def fields(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``key, field_name, value`` of each field of each row."""
    pairs = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).alias("value")) for n in names))
    return df.select(key, F.explode(pairs).alias("f")).select(key, "f.field_name", "f.value")


def rendered(rows: DataFrame, key: str, path_lines: tuple[str, ...] = ("embed_text",)) -> DataFrame:
    """``key, field_name, clean_text, markup`` (array) of rows with a trace of markup."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, kinds = [], []
            for name, value in zip(frame.column(1).to_pylist(), frame.column(2).to_pylist()):
                text, found = clean(value, name in path_lines)
                texts.append(text)
                kinds.append([k for k in KINDS if k in found])
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), frame.column(1), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))],
                [key, "field_name", "clean_text", "markup"],
            )

    traced = rows.filter(F.col("value").rlike(TRACE))
    return traced.mapInArrow(batches, f"{key} string, field_name string, clean_text string, markup array<string>")


def _section_fields(spark: SparkSession, folder: str) -> DataFrame:
    chunks = read_table(spark, folder, "chunks", "chunk_id", "kind", "text", "embed_text").filter("kind = 'section'")
    return fields(chunks, "chunk_id", ["text", "embed_text"])


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Clean text of both fields of every section chunk."""
    rows = _section_fields(spark, folder)
    untouched = rows.filter(F.col("value").isNull() | ~F.col("value").rlike(TRACE))
    same = untouched.select("chunk_id", "field_name", F.col("value").alias("clean_text"))
    return rendered(rows, "chunk_id").drop("markup").unionByName(same).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = rendered(_section_fields(spark, folder), "chunk_id")
    return rows.select("chunk_id", "field_name", F.explode("markup").alias("markup")).distinct()


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean}
ORACLE: dict[str, str] = {}
