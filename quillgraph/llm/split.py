"""Splitting oversized sources at natural boundaries.

Sizes are differences of a prefix sum over the text's characters (one each, or its UTF-8 bytes). The
boundaries of a text are one sorted array for each rank: section starts, blank lines, line starts,
sentence ends, word gaps. From a cut, the limit is found in the prefix sum, and the next cut by binary
search: the next section start if it is under the limit, else the last boundary of the best rank
under it, else a hard cut at the limit. A piece starts ``overlap`` before its cut.

Sections come from a scan of the whole text that knows what the text's language hides: for headings
the block structure of Markdown (fences, comments and other HTML blocks, indented code, setext
underlines, lists), for functions the strings and comments of the programming language.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: File extensions and the strategy they tell (fixed values).
EXTENSIONS = {"md": "heading", "txt": "paragraph"} | dict.fromkeys(("py", "js", "ts", "go", "rs", "sh"), "function")

_EOL = re.compile(r"\r\n|\n|\r")
_FRONT = re.compile(r"\ufeff?---[ \t]*(?:\r\n|\n|\r)(?:.*?(?:\r\n|\n|\r))??(?:---|\.\.\.)[ \t]*(?:\r\n|\n|\r|$)", re.S)


def front_matter_end(text: str) -> int:
    """Offset behind the front matter; 0 if there is none."""
    m = _FRONT.match(text)
    return m.end() if m else 0


def _lines(text: str, start: int = 0) -> list[tuple[int, str]]:
    """(offset, line without its end)."""
    out = []
    for m in _EOL.finditer(text, start):
        out.append((start, text[start : m.start()]))
        start = m.end()
    if start < len(text):
        out.append((start, text[start:]))
    return out


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:( +)|\t|$)")
_QUOTE = re.compile(r" {0,3}> ?")
#: Elements that open an HTML block of CommonMark's sixth kind (fixed values).
_BLOCKS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|"
    "footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|"
    "param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_HTML = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{_BLOCKS})(?:\s|/?>|$)", re.I), None),
)
_HTML_ANY = re.compile(r" {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)[ \t]*$")
#: A line that may end, open or be a block; all others continue a paragraph.
_SPECIAL = re.compile(r"[ \t]*(?:$|[#=\-`~<>*+_]|\d{1,9}[.)])|[ \t]")
#: A link reference definition at the start of a paragraph.
_LINK = re.compile(
    r"[ \t]*\[(?![ \t\n]*\])(?:\\.|[^\[\]\\]){1,999}\]:[ \t]*\n?[ \t]*(?:<(?:\\.|[^<>\\\n])*>|[^\s<]\S*)"
    r"(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?[ \t]*(?:\n|$)",
    re.S,
)


#: Marks of containers before a line's text.
_MARKS = re.compile(r"(?:[ \t]*(?:>|(?:[-+*]|\d{1,9}[.)])(?=[ \t])))*")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


class _Blocks:
    """The open blocks of a Markdown text, line by line: containers (quotes, list items) and one leaf."""

    def __init__(self) -> None:
        self.found: list[tuple[int, str]] = []
        self.open: list[list] = []  # ['>'] or ['-', columns of its content, whether nothing came yet]
        self.para: list[tuple[int, str]] | None = None  # lines of the open paragraph
        self.fence: tuple[str, int] | None = None  # the mark that must be repeated, columns of its indentation
        self.html: re.Pattern | None | bool = False  # what ends the HTML block, None for a blank line, False for no block

    def _go_on(self, line: str) -> tuple[int, str]:
        """(how many of the open containers the line goes on, the line without their marks)."""
        for n, c in enumerate(self.open):
            if c[0] == ">":
                m = _QUOTE.match(line)
                if not m:
                    return n, line
                line = line[m.end() :]
            elif not line.strip():
                if c[2]:
                    return n, line
                line = ""
            elif _indent(line) >= c[1]:
                line = line[c[1] :]
                c[2] = False
            else:
                return n, line
        return len(self.open), line

    def _close(self, n: int) -> None:
        """Close the containers behind the n first, with the leaf in them."""
        if n < len(self.open):
            del self.open[n:]
            self.para = self.fence = None
            self.html = False

    def line(self, at: int, raw: str) -> None:
        line = raw.expandtabs(4) if "\t" in raw else raw
        went, line = self._go_on(line)
        all_ = went == len(self.open)
        if all_ and self.fence:
            m = re.match(r" {0,3}([`~]+)[ \t]*$", line)
            if m and m[1][0] == self.fence[0][0] and len(m[1]) >= len(self.fence[0]):
                self.fence = None
            return
        if all_ and self.html is not False:
            if self.html is None:
                if line.strip():
                    return
                self.html = False
            else:
                if self.html.search(line):
                    self.html = False
                return
        lazy = self.para is not None and not all_  # may still go on with the paragraph
        if not lazy:
            self._close(went)
        opened = False
        while True:
            blank = not line.strip()
            if blank:
                self._close(went if lazy else len(self.open))
                self.para = None
                return
            if _indent(line) >= 4:
                break  # code, or more of the paragraph
            if m := _QUOTE.match(line):
                self._open(went, [">"])
                line, went, lazy, opened = line[m.end() :], went + 1, False, True
                continue
            if m := _ATX.match(line):
                self._close(went)
                self.found.append((at, raw[raw.index("#") :].strip()))
                self.para = None
                return
            if m := _FENCE.match(line):
                self._close(went)
                self.para, self.fence = None, (m[1], _indent(line))
                return
            ends = next(((end,) for start, end in _HTML if start.match(line)), None)
            if ends is None and self.para is None and _HTML_ANY.match(line):
                ends = (None,)
            if ends:
                self._close(went)
                self.para = None
                if ends[0] is None or not ends[0].search(line, line.index("<") + (4 if "<!--" in line[:8] else 1)):
                    self.html = ends[0]
                return
            if self.para is not None and not lazy and not opened and _SETEXT.match(line) and self._setext():
                return
            if _BREAK.match(line):
                self._close(went)
                self.para = None
                return
            m = _ITEM.match(line)
            rest = line[m.end() :].strip() if m else ""
            if m and (self.para is None or (rest and (not m[2][0].isdigit() or m[2][:-1] == "1"))):
                mark, gap = len(m[1]) + len(m[2]), len(m[3] or "")
                width = mark + (gap if rest and 1 <= gap <= 4 else 1)
                self._open(went, ["-", width, not rest])
                line, went, lazy, opened = line[width:], went + 1, False, True
                if not rest:
                    return
                continue
            break
        if "\t" in raw:  # the text as it stands
            line = _MARKS.sub("", raw) if self.open else raw
        if self.para is not None:
            self.para.append((at, line))
        elif _indent(line) < 4:
            self.para = [(at, line)]

    def _open(self, went: int, container: list) -> None:
        self._close(went)
        self.para = None
        self.open.append(container)

    def _setext(self) -> bool:
        """Take the open paragraph for a heading, without the link definitions at its start; False if there is nothing else."""
        lines = self.para
        if lines[0][1].lstrip().startswith("["):
            text = "\n".join(x for _, x in lines)
            end = 0
            while m := _LINK.match(text, end):
                end = m.end()
                if end >= len(text):
                    self.para = None
                    return False
            lines = lines[text.count("\n", 0, end) :]
        self.found.append((lines[0][0], lines[0][1].strip()))
        self.para = None
        return True


def markdown_sections(text: str) -> list[tuple[int, str]]:
    """(offset, heading line) of each heading that CommonMark shows, in quotes and list items too."""
    b = _Blocks()
    for at, raw in _lines(text, front_matter_end(text)):
        if raw and not b.open and b.fence is None and b.html is False and not _SPECIAL.match(raw):
            if b.para is None:
                b.para = [(at, raw)]
            elif b.para[0][1].startswith("["):  # only link definitions need all lines
                b.para.append((at, raw))
            continue
        b.line(at, raw)
    return b.found


_NAME = r"[\w$]+"
#: What opens a top-level definition, at the start of a line (fixed values by language).
_DEFINITION = {
    "py": re.compile(r"(?:async[ \t]+def|def|class)[ \t]+\w"),
    "js": re.compile(
        r"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:(?:async[ \t]+)?function\b|(?:abstract[ \t]+)?class\b|interface[ \t]+\w|enum[ \t]+\w|const[ \t]+enum\b|namespace[ \t]+\w"
        r"|type[ \t]+\w+[^=\n]*=)"
        rf"|(?:(?:export[ \t]+)?(?:const|let|var)[ \t]+{_NAME}[^=\n]*=|(?:{_NAME}\.)+{_NAME}[ \t]*=|export[ \t]+default\b)"
        rf"[ \t]*(?:async[ \t]*)?(?:function\b|class\b|\([^\n]*\)[^\n]*=>|{_NAME}[ \t]*=>|\([^)\n]*$)"
    ),
    "go": re.compile(r"func\b|type[ \t]+(?:\w|\()"),
    "rs": re.compile(
        r"(?:pub(?:[ \t]*\([^)]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*(?:fn|struct|enum|trait|union|type)[ \t]+\w"
        r"|(?:unsafe[ \t]+)?impl\b|macro_rules!"
    ),
    "sh": re.compile(r"function[ \t]+[^\s(){}]+|[\w.:-]+[ \t]*\([ \t]*\)"),
}
_DEFINITION["ts"] = _DEFINITION["js"]
#: What may stand between the code lines of a language: comments and strings, longest first.
_TOKENS = {
    "py": re.compile(r"#[^\r\n]*|(?:[rRbBuUfF]{0,2})(\"\"\"|''')(?:\\.|(?!\1).)*(?:\1|\Z)|[\"'](?:\\.|[^\"'\\\r\n])*", re.S),
    "js": re.compile(r"//[^\r\n]*|/\*.*?(?:\*/|\Z)|/(?P<regex>(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/\w*)|`|\"(?:\\.|[^\"\\\r\n])*\"?|'(?:\\.|[^'\\\r\n])*'?", re.S),
    "go": re.compile(r"//[^\r\n]*|/\*.*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\r\n])*\"?|'(?:\\.|[^'\\\r\n])*'?", re.S),
    "rs": re.compile(r"//[^\r\n]*|/\*|b?r(#*)\".*?(?:\"\1|\Z)|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\[^\r\n]+?|[^'\\\r\n])'", re.S),
    "sh": re.compile(
        r"\\.|(?<![^\s;|&()])#[^\r\n]*|<<-?[ \t]*(?P<q>['\"\\]?)(?P<end>\w+)['\"]?[^\r\n]*(?:\r\n|\n|\r)(?:.*?(?:\r\n|\n|\r))??[ \t]*(?P=end)[ \t]*(?=\r|\n|\Z)"
        r"|'[^']*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)",
        re.S,
    ),
}
_TOKENS["ts"] = _TOKENS["js"]
_BRACE = re.compile(r"[{}]")
_PY_STRING = re.compile(r"\"(?:\\.|[^\"\\\r\n])*\"?|'(?:\\.|[^'\\\r\n])*'?", re.S)
#: Words that a regular expression, and no division, may follow (fixed values).
_BEFORE_REGEX = re.compile(r"(?:[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof|yield|await))\Z")
_NESTED = re.compile(r"/\*|\*/")
#: Languages whose definitions count at the top level of their braces.
_BRACED = ("js", "ts", "go", "rs")


def _comment_end(text: str, at: int) -> int:
    """The end of a comment that may hold comments."""
    depth = 0
    for m in _NESTED.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _template_end(text: str, at: int) -> int:
    """The end of a template literal, whose ${} may hold code with strings, comments and templates."""
    modes, i = [0], at + 1  # 0: template, n: code in n braces
    while i < len(text):
        c = text[i]
        if not modes[-1]:
            if c == "\\":
                i += 1
            elif c == "`":
                modes.pop()
                if not modes:
                    return i + 1
            elif text.startswith("${", i):
                modes.append(1)
                i += 1
        elif c == "`":
            modes.append(0)
        elif c in "{}":
            modes[-1] += 1 if c == "{" else -1
            if not modes[-1]:
                modes.pop()
        elif c in "\"'":
            i = _PY_STRING.match(text, i).end() - 1
        elif text.startswith("//", i):
            i = (m.start() if (m := _EOL.search(text, i)) else len(text)) - 1
        elif text.startswith("/*", i):
            i = (end + 1 if (end := text.find("*/", i + 2)) >= 0 else len(text))
        i += 1
    return len(text)


_COMMENT_LINE = {"py": ("#", "@"), "sh": ("#",), "rs": ("//", "#[", "#!["), "go": ("//",), "js": ("//", "@"), "ts": ("//", "@")}


def code_sections(text: str, language: str) -> list[tuple[int, str]]:
    """(offset, first line of the definition) of each top-level definition, with the decorator, attribute and comment lines directly above it."""
    starts = _lines(text)
    offsets = [at for at, _ in starts]
    inside = [False] * len(starts)  # the line starts inside a string or comment
    comment = [False] * len(starts)  # the line is nothing but a comment or attribute
    marks = _COMMENT_LINE[language]
    pos, pattern = 0, _TOKENS[language]
    nesting, code = [0] * len(starts), 0  # braces that are open at each line, braces and last place of code looked at
    seen, marked = 0, []

    def braces(stop: int) -> None:
        nonlocal code, seen
        if language in _BRACED:
            for b in _BRACE.finditer(text, seen, stop):
                code = max(0, code + (1 if b[0] == "{" else -1))
                line = bisect_right(offsets, b.start())
                if line < len(nesting):
                    nesting[line] = code
                    marked.append(line)
        seen = stop

    while m := pattern.search(text, pos):
        token, end = m[0], m.end()
        if language in ("js", "ts"):
            if m["regex"] is not None:
                before = text[max(0, m.start() - 80) : m.start()].rstrip()
                if before and not _BEFORE_REGEX.search(before):  # a division
                    pos = m.start() + 1
                    continue
            elif token == "`":
                end = _template_end(text, m.start())
        elif language == "rs" and token == "/*":
            end = _comment_end(text, m.start())
            token = text[m.start() : end]
        if language == "py" and not m[1] and token[0] in "\"'":
            s = _PY_STRING.match(text, m.start())
            token, end = s[0], s.end()
        braces(m.start())
        pos = seen = max(end, m.start() + 1)
        first = bisect_right(offsets, m.start()) - 1
        last = bisect_right(offsets, max(m.start(), end - 1)) - 1
        is_comment = token.startswith(("#", "//", "/*")) and not (language in ("js", "ts") and m["regex"] is not None)
        alone = not text[offsets[first] : m.start()].strip()
        tail = end >= len(text) or not text[end : offsets[last + 1] if last + 1 < len(offsets) else len(text)].strip()
        for i in range(first, last + 1):
            if i > first:
                inside[i] = True
            if is_comment and alone and tail:
                comment[i] = True
    braces(len(text))
    level, changed = 0, set(marked)
    for i in range(len(starts)):
        level = nesting[i] = nesting[i] if i in changed else level
    # attributes and decorators may run over several lines: up to the bracket that closes them
    i = 0
    while i < len(starts):
        line = starts[i][1]
        if not inside[i] and not comment[i] and line.startswith(marks) and not line.startswith(("//", "# ")):
            depth, j = 0, i
            while j < len(starts):
                depth += sum(starts[j][1].count(c) for c in "([{") - sum(starts[j][1].count(c) for c in ")]}")
                comment[j] = True
                j += 1
                if depth <= 0:
                    break
            i = j
        else:
            i += 1
    found, definition = [], _DEFINITION[language]
    for i, (at, line) in enumerate(starts):
        if inside[i] or comment[i] or nesting[i] or not definition.match(line):
            continue
        first = i
        while first and comment[first - 1] and starts[first - 1][1][:1].strip():
            first -= 1
        while first and comment[first - 1]:  # inner lines of a comment block are indented
            first -= 1
        found.append((starts[first][0], line.strip()))
    return found


def sections(text: str, strategy: str, language: str) -> list[tuple[int, str]]:
    """(offset, heading) of the section starts; none where only front matter or blanks come before."""
    if strategy == "heading":
        found = markdown_sections(text)
    elif strategy == "function" and language in _DEFINITION:
        found = code_sections(text, language)
    else:
        return []
    floor = front_matter_end(text) if strategy == "heading" else 0
    lead = re.compile(r"[\s\ufeff]*").match(text, floor).end()
    return [(at, head) for at, head in found if at > lead]


#: Lesser boundaries, best first.
_LESSER = (
    ("paragraph", re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))*")),
    ("line", _EOL),
    ("sentence", re.compile(r"[.!?]+[\"')\]]*[ \t]+")),
    ("word", re.compile(r"[ \t]+")),
)


class Measure:
    """Sizes of stretches of a text, from prefix sums over its characters: one each, or its bytes in UTF-8."""

    def __init__(self, text: str, unit: str = "characters"):
        self.n, self.sums = len(text), None
        if unit == "bytes" and not text.isascii():
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.sums = np.r_[0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))]
        elif unit not in ("characters", "bytes"):
            raise ValueError("unit is 'characters' or 'bytes'")

    def size(self, start: int, end: int) -> int:
        return end - start if self.sums is None else int(self.sums[end] - self.sums[start])

    def limit(self, start: int, size: int) -> int:
        """The last offset that is at most ``size`` behind the start."""
        return min(self.n, start + size) if self.sums is None else int(np.searchsorted(self.sums, self.sums[start] + size, "right")) - 1

    def back(self, cut: int, overlap: int) -> int:
        """The first offset that is at most ``overlap`` before the cut."""
        return max(0, cut - overlap) if self.sums is None else int(np.searchsorted(self.sums, self.sums[cut] - overlap, "left"))


def cuts(text: str, heads: list[tuple[int, str]], size: int, overlap: int, measure: Measure | None = None) -> list[tuple[int, str]]:
    """(offset, kind) of every cut: the section starts and the lesser ones that keep pieces under the size.

    A cut must leave more than the overlap behind, or pieces would not move on.
    """
    measure = measure or Measure(text)
    found: list[tuple[int, str]] = []
    ranks: dict[str, np.ndarray] = {"section": np.array([at for at, _ in heads], np.int64)}
    cut = 0
    while True:
        limit = measure.limit(measure.back(cut, overlap) if cut else 0, size)
        at = int(np.searchsorted(ranks["section"], cut, "right"))
        if at < len(heads) and ranks["section"][at] <= limit:
            found.append((int(ranks["section"][at]), "section"))
        elif limit >= len(text):
            return found
        else:
            for rank, pattern in _LESSER:
                if rank not in ranks:
                    ranks[rank] = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
                i = int(np.searchsorted(ranks[rank], limit, "right")) - 1
                if i >= 0 and ranks[rank][i] > cut and measure.size(cut, int(ranks[rank][i])) > overlap:
                    found.append((int(ranks[rank][i]), rank))
                    break
            else:
                found.append((max(limit, cut + 1), "hard"))
        cut = found[-1][0]


PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("position", T.IntegerType()),
            T.StructField("cut_at", T.LongType()),
            T.StructField("cut_kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("heading", T.StringType()),
            T.StructField("content", T.StringType()),
        ]
    )
)


def pieces(text: str, strategy: str, language: str, size: int, overlap: int, with_content: bool = True, unit: str = "characters") -> list[tuple]:
    """(position, cut_at, cut_kind, start, end, heading, content) of the pieces of one text.

    Position counts from 1; the first piece has cut_at 0 and cut_kind 'start'. A piece holds
    [start, end) with start = cut_at less the overlap; heading is the last one at or before cut_at.
    A text of at most ``size`` is one piece. In bytes a character that is larger than what the size
    leaves beside the overlap is a piece of its own.
    """
    overlap = min(overlap, max(0, size - 1) // 2)
    measure = Measure(text, unit)
    whole = measure.size(0, len(text)) <= size
    heads = [] if whole else sections(text, strategy, language)
    at = [(0, "start"), *([] if whole else cuts(text, heads, size, overlap, measure))]
    out, h = [], -1
    for i, (cut, kind) in enumerate(at):
        end = at[i + 1][0] if i + 1 < len(at) else len(text)
        start = measure.back(cut, overlap) if cut else 0
        while h + 1 < len(heads) and heads[h + 1][0] <= cut:
            h += 1
        out.append((i + 1, cut, kind, start, end, heads[h][1] if h >= 0 else "", text[start:end] if with_content else None))
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def strategy_of(strategy: Column, path: Column) -> Column:
    """The strategy, or what the file extension tells where it is null or blank."""
    told = F.coalesce(*(F.when(extension(path) == k, v) for k, v in EXTENSIONS.items()), F.lit("fixed"))
    given = F.lower(F.trim(strategy))
    return F.when(given.isNotNull() & (given != ""), given).otherwise(told)


def split_sources(sources: DataFrame, size: int, overlap: int, *, with_content: bool = True, unit: str = "characters") -> DataFrame:
    """(path, strategy, text_hash, position, cut_at, cut_kind, start, end, heading, content) of the pieces of each source over the size.

    ``sources``: (path, content, strategy); other columns are not read. Null and empty contents and
    contents of at most ``size`` need no split and give no rows; repeated rows give one result, and
    ``text_hash`` (MD5) tells several contents of a path apart. No piece is over ``size``; consecutive
    pieces share min(overlap, (size - 1) // 2). ``unit``: 'characters', or 'bytes' for tokens of a byte
    tokenizer. Offsets count characters of the content as stored. ``with_content`` False leaves content
    and text_hash null. Every source is one row of work, so a source must fit into a task's memory.
    """
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")

    @F.pandas_udf(PIECES)
    def split(content: pd.Series, strategy: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([pieces(c, s, x, size, overlap, with_content, unit) for c, s, x in zip(content, strategy, language)])

    strategy = strategy_of(F.col("strategy"), F.col("path"))
    long = F.octet_length("content") if unit == "bytes" else F.char_length("content")
    big = sources.where(long > size).select("path", strategy.alias("strategy"), (F.md5("content") if with_content else F.lit(None).cast("string")).alias("text_hash"), "content")
    cut = big.select("path", "strategy", "text_hash", F.explode(split("content", "strategy", extension(F.col("path")))).alias("p"))
    return cut.select("path", "strategy", "text_hash", "p.*").distinct()  # the pieces of repeated rows, so that whole contents need not move


def split_check(pieces: DataFrame, size: int, overlap: int) -> DataFrame:
    """(path, strategy, text_hash, rebuilt, over, unshared): per source what its pieces must keep.

    rebuilt: MD5 of the pieces put together without what they share; over: pieces longer than the
    size; unshared: pieces that do not begin with the last ``overlap`` characters of the one before.
    """
    w = Window.partitionBy("path", "strategy", "text_hash").orderBy("position")
    before = F.lag("content").over(w)
    shared = F.col("cut_at") - F.col("start")
    rows = pieces.select(
        "path", "strategy", "text_hash", "position", F.expr("substring(content, int(cut_at - start) + 1)").alias("own"), (F.char_length("content") > size).alias("over"),
        ((F.col("position") > 1) & ((shared != F.least(F.lit(overlap), F.col("cut_at"))) | (F.expr("left(content, int(cut_at - start))") != F.right(before, shared.cast("int"))))).alias("unshared"),
    )
    told = rows.groupBy("path", "strategy", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("position", "own"))).alias("p"), F.count_if("over").alias("over"), F.count_if("unshared").alias("unshared")
    )  # one source, which is a row of the input
    return told.select("path", "strategy", "text_hash", F.md5(F.array_join(F.transform("p", lambda x: x["own"]), "")).alias("rebuilt"), "over", "unshared")
