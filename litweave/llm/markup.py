"""Problem 2: clean text out of HTML/XML, Markdown, wiki text and LaTeX, with its structure kept.

A text is brought to blocks: headings, list items, code, formulas, paragraphs. Two passes of block rules follow. The
first decides by length, stop-word density and link density; in the second, blocks too short to decide inherit the label
of the nearest decided neighbours. Blocks that come out ``bad`` (menus, link lists, footers) are left out of the clean
text. A text without any block of prose is no page around an article but a field of its own, and stays whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litweave.llm.lookalike import normalize

#: Element names of HTML, JATS and wiki text.
TAGS = set(
    "a abbr abstract acronym address article aside audio b base big blockquote body bold br button canvas caption center cite code col colgroup dd del details dfn div dl dt em embed "
    "fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img inf input ins italic kbd label legend li link list main map mark math meta nav nobr noscript "
    "nowiki object ol option p param picture pre q ref references s samp script sc sec section select small source span strike strong style sub summary sup svg table tbody td template "
    "textarea tfoot th thead time title tr tt u ul underline var video wbr xml xref".split()
)
BLOCK_TAGS = set("abstract address article aside blockquote body br caption center dd div dl dt fieldset figure footer form head header hr html li list main nav ol p pre sec section table tbody td tfoot th thead title tr ul h1 h2 h3 h4 h5 h6".split())
#: Frequent words of several languages, for the density of stop words.
STOP = set(
    "a about after all also an and any are as at be been before between both but by can could did do does each for from had has have how however if in into is it its more most no not of on only or other our out over "
    "same she should so some such than that the their them then there these they this those through to two under up was we were what when where which while who will with within without would "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou el los las y por con no una su para es al lo como o del e il di che per non si da".split()
)
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS_MOST = 70, 200, 0.30, 0.32, 0.5
BARS = re.compile(r" [|·»•] ")
#: Names that Python gives a meaning, which aren't emphasis.
DUNDER = set("init main name file call repr str len iter next enter exit getitem setitem del new all doc dict class eq hash add contains slots version".split())

REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
FENCE = re.compile(r"^[ ]{0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:\n[ ]{0,3}\1[ ]*$|\Z)", re.S | re.M)
PRE = re.compile(r"<(pre|code|samp|kbd|tt|syntaxhighlight|source)\b[^<>]*>(.*?)</\1\s*>|\\begin\{(verbatim|lstlisting)\*?\}(?:\[[^\]]*\])?(.*?)\\end\{\3\*?\}", re.S | re.I)
MATH_BLOCK = re.compile(r"\$\$(?=[^$])(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{(equation|align|gather|multline|eqnarray|displaymath)(\*?)\}(.+?)\\end\{\3\4\}", re.S)
MATH = re.compile(r"\\\((.+?)\\\)|(?<![\\$\w])\$(?=[^\s$])([^$\n]{0,300}?[^\s$\\])\$(?![\d$])|<math\b[^<>]*>(.*?)</math\s*>", re.S)
MATHLIKE = re.compile(r"[\\^_{}=+<>|]|^[A-Za-zα-ωΑ-Ω]{1,2}'?$|^[A-Za-z]\s?[-/(,]\s?[A-Za-z0-9]|^-?\d*[.,]?\d+[A-Za-z%]?$|^[A-Za-z]\d$|^\d+\s*\\")
COMMENT = re.compile(r"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<![A-Za-z][^<>]*>|<\?\w[^<>]*?\?>", re.S)
TAG = re.compile(r"<(/?)([A-Za-z][\w.-]*(?::[A-Za-z][\w.-]*)?)((?:\s+[^<>]*)?)(/?)>")
ATTRIBUTES = re.compile(r"(?:\s+(?:[\w:.@-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)|(?:async|checked|controls|defer|disabled|hidden|ismap|loop|multiple|muted|noshade|nowrap|open|readonly|required|reversed|selected)))*\s*/?")
WIKI_HEAD = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]+)\]\]")
WIKI_URL = re.compile(r"\[((?:https?|ftp)://[^\s\]]+)(?:\s+([^\]\n]*))?\]")
TEMPLATE = re.compile(r"\{\{\s*([^{}\n]*?)\s*\}\}")
WIKI_QUOTES = re.compile(r"('{5}|'{3}|'{2})(?=[^\s'])([^\n]*?[^\s'])\1(?!')")
MD_IMAGE = re.compile(r"!\[([^\]\n]*)\]\(([^()\s]*)(?:\s+\"[^\"\n]*\")?\)")
MD_LINK = re.compile(r"\[([^\[\]\n]+)\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)?)(?:\s+\"[^\"\n]*\")?\)|\[([^\[\]\n]+)\]\[[\w -]*\]|<((?:https?|mailto):[^\s<>]+)>")
MD_HEAD = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
SETEXT = re.compile(r"^(?=\S)([^\n]+)\n(=+|-{3,})[ \t]*$", re.M)
RULE = re.compile(r"^[ ]{0,3}(?:(?:\*[ ]*){3,}|(?:-[ ]*){3,}|(?:_[ ]*){3,})$|^-{4,}$", re.M)
QUOTE = re.compile(r"^[ ]{0,3}>[ ]?(?=\S)(?!\s*[\d.])", re.M)
LIST = re.compile(r"^[ \t]{0,6}([*+•-]|\*{2,3}(?=[ \t]\S))[ \t]+(?=\S)", re.M)
STRONG = re.compile(r"(?<![*\\])(\*{2,3})(?=[^\s*])(.+?)(?<=[^\s*\\])\1(?!\*)|(?<![\w_\\])(_{2,3})(?=[^\s_])(.+?)(?<=[^\s_\\])\3(?![\w_])", re.S)
EMPHASIS = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*\\])\*(?![\w*])|(?<![\w_\\/])_(?=[^\s_])([^_\n]*?[^\s_\\])_(?![\w_])")
STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])([^~\n]*?[^\s~])~~(?!~)")
CODE = re.compile(r"(?<![`\\])(`{1,2})(?=[^\s`])([^`\n]*?[^\s`])\1(?![`'])")
TEX_QUOTES = re.compile(r"``([^`'\n]+(?:'(?!')[^`'\n]+)*)''")
TEX_QUOTE = re.compile(r"(?<!`)`([^`'\n]+(?:'(?=\w)[^`'\n]+)*)'(?!')")
TEX_HEAD = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|title)\*?\s*\{([^{}]*)\}")
TEX_LIST = re.compile(r"\\(?:begin|end)\{(?:itemize|enumerate|description|list)\}(?:\[[^\]]*\])?")
TEX_ITEM = re.compile(r"\\item\b\s*(?:\[([^\]]*)\])?\s*")
TEX_ENV = re.compile(r"\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]]*\])?")
TEX_DROP = re.compile(r"\\(?:cite[a-z]*|ref|eqref|autoref|label|index|pagestyle|vspace|hspace|includegraphics|bibliography|bibliographystyle|usepackage|documentclass|input)\*?(?:\[[^\]]*\])*\{[^{}]*\}")
TEX_HREF = re.compile(r"\\href\{([^{}]*)\}\{([^{}]*)\}|\\url\{([^{}]*)\}")
TEX_ACCENT = re.compile(r"\{?\\([`'^\"~=.])\s*(?:\{\\?([A-Za-zıȷ])\}|\\([ij])(?![A-Za-z])|([A-Za-z]))\}?|\{?\\([uvHckrdbt])(?:\{\\?([A-Za-z])\}|\s+\\?([A-Za-z])(?![A-Za-z]))\}?")
TEX_LETTER = re.compile(r"\{?\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j|dh|DH|th|TH|dj|DJ|ng|NG)(?![A-Za-z])(?:\{\})?(?:\s(?=[a-z]))?\}?")
TEX_GROUP = re.compile(r"\{\\(?:em|it|bf|sc|tt|sl|sf|rm|tiny|small|large|Large|itshape|bfseries|scshape|ttfamily|upshape|normalfont)(?![A-Za-z])\s*([^{}]*)\}")
TEX_COMMAND = re.compile(r"\\([A-Za-z]{2,})\*?(?:\[[^\]\n]*\])*(\s*\{[^{}]*\})?")
TEX_ESCAPE = re.compile(r"\\([&%$#_{}])|\\\\(?:\[[^\]]*\])?")
TEX_SPACE = re.compile(r"\\[,;:](?=\\|\w|\s|%)|(?<=\d)\\ (?=\w)")
MD_ESCAPE = re.compile(r"\\([!\"'()*+,./:;<=>?@\[\]^`|~-])")
BRACES = re.compile(r"\{([^{}]*)\}")
TIE = re.compile(r"(?<=[A-Za-z.])~(?=[\d\\A-Z])")
#: Combining marks of LaTeX accents, and LaTeX's own letters and signs.
ACCENTS = dict(zip("`'^\"~=.uvHckrdb", map(chr, (0x300, 0x301, 0x302, 0x308, 0x303, 0x304, 0x307, 0x306, 0x30C, 0x30B, 0x327, 0x328, 0x30A, 0x323, 0x331))))
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "i", "j": "j", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "dj": "đ", "DJ": "Đ", "ng": "ŋ", "NG": "Ŋ"}
SIGNS = {"textemdash": "—", "textendash": "–", "ldots": "…", "dots": "…", "textellipsis": "…", "textregistered": "®", "texttrademark": "™", "copyright": "©", "pm": "±", "times": "×", "degree": "°", "textdegree": "°", "textbackslash": "\\", "textasciitilde": "~", "textquoteright": "’", "textquoteleft": "‘", "textquotedblleft": "“", "textquotedblright": "”"}
OPEN, CLOSE, LINK_ON, LINK_OFF = "\x01", "\x02", "\x03", "\x04"


class Cleaner:
    """One text on its way; ``kinds`` has what was found in it."""

    def __init__(self, text: str):
        self.kinds: set[str] = set()
        self.kept: list[tuple[str, str]] = []
        self.s = text

    def sub(self, kind: str, pattern: re.Pattern, to, repeat: bool = False) -> None:
        def put(m: re.Match) -> str:
            new = to(m) if callable(to) else m.expand(to)
            if new != m[0]:
                self.kinds.add(kind)
            return new

        while True:
            new = pattern.sub(put, self.s)
            if not repeat or new == self.s:
                self.s = new
                return
            self.s = new

    def keep(self, kind: str, text: str, block: bool) -> str:
        self.kept.append((kind, text))
        mark = f"{OPEN}{'CF'[kind == 'formula']}{'bi'[not block]}{len(self.kept) - 1}{CLOSE}"
        return f"\n{mark}\n" if block else mark

    def run(self) -> None:
        self.s = re.sub(r"\r\n?|[" + chr(0x2028) + chr(0x2029) + "]", "\n", self.s)
        self.sub("code", FENCE, lambda m: self.keep("code", m[2].strip("\n"), True))
        for _ in range(3):  # references are often escaped more than once
            if not REFERENCE.search(self.s):
                break
            self.sub("reference", REFERENCE, lambda m: html.unescape(m[0]).replace(chr(0xA0), " ") if m[0][1] == "#" or m[0][1:] in html5 else m[0])
        self.sub("quotes", TEX_QUOTES, "“\\1”")
        if "<" in self.s or "\\" in self.s:
            self.sub("comment", COMMENT, lambda m: m[1] or " ")
            self.sub("code", PRE, lambda m: self.keep("code", (m[2] or m[4] or "").strip("\n"), "\n" in (m[2] or m[4] or "")))
        if "$" in self.s or "\\" in self.s or "<math" in self.s:
            self.sub("formula", MATH_BLOCK, lambda m: self.keep("formula", (m[1] or m[2] or m[5] or "").strip(), False))
            self.sub("formula", MATH, lambda m: self.keep("formula", (m[1] or m[2] or m[3]).strip(), False) if m[1] or m[3] or m[2] and MATHLIKE.search(m[2]) else m[0])
        if "<" in self.s:
            self.tags()
        if "`" in self.s:
            self.sub("code", CODE, lambda m: self.keep("code", m[2], False))
            self.sub("quotes", TEX_QUOTE, "‘\\1’")
        self.wiki()
        self.markdown()
        self.latex()

    def tags(self) -> None:
        closed = {m[2].lower() for m in TAG.finditer(self.s) if m[1]}

        def put(m: re.Match) -> str:
            name = m[2].lower().rpartition(":")[2]
            if not (name in TAGS or ":" in m[2] or m[2].lower() in closed or "=" in m[3]):
                return m[0]
            if m[3].strip() and not m[1] and m[2].lower() not in closed and not ATTRIBUTES.fullmatch(m[3]):
                return m[0]  # two comparisons, not an element
            if name == "a" or name in ("xref", "ext-link"):
                return LINK_OFF if m[1] else LINK_ON
            if re.fullmatch(r"h[1-6]", name):
                return "\n\n" if m[1] else f"\n\n{OPEN}H{name[1]}{CLOSE}"
            if name in ("li", "list-item"):
                return "\n" if m[1] else f"\n{OPEN}L{CLOSE}"
            if name in ("p", "div", "blockquote", "ul", "ol", "table", "sec", "section", "abstract", "title", "article"):
                return "\n\n"
            return "\n" if name in BLOCK_TAGS else ""

        self.sub("script", re.compile(r"<(script|style)\b[^<>]*>.*?</\1\s*>", re.S | re.I), "")
        self.sub("tag", TAG, put)

    def wiki(self) -> None:
        if "=" in self.s:
            self.sub("heading", WIKI_HEAD, lambda m: f"\n\n{OPEN}H{len(m[1])}{CLOSE}{m[2]}\n\n")
        if "[" in self.s:
            self.sub("link", WIKI_LINK, f"{LINK_ON}\\1{LINK_OFF}")
            self.sub("link", WIKI_URL, lambda m: f"{LINK_ON}{m[2] or m[1]}{LINK_OFF}")
        if "{{" in self.s:
            self.sub("template", TEMPLATE, lambda m: "" if re.search(r"[|=]", m[1]) else m[1], True)
        if "''" in self.s:
            self.sub("emphasis", WIKI_QUOTES, "\\2", True)

    def markdown(self) -> None:
        if "[" in self.s or "<" in self.s:
            self.sub("link", MD_IMAGE, "\\1")
            self.sub("link", MD_LINK, lambda m: f"{LINK_ON}{m[1] or m[3] or m[4]}{LINK_OFF}")
        if "#" in self.s:
            self.sub("heading", MD_HEAD, lambda m: f"\n\n{OPEN}H{len(m[1])}{CLOSE}{m[2]}\n\n")
        if "\n" in self.s:
            self.sub("heading", SETEXT, lambda m: f"\n\n{OPEN}H{1 + (m[2][0] == '-')}{CLOSE}{m[1]}\n\n")
            self.sub("rule", RULE, "\n\n")
        self.sub("quotation", QUOTE, "")
        self.sub("list", LIST, f"{OPEN}L{CLOSE}")
        if "*" in self.s or "_" in self.s:
            self.sub("emphasis", STRONG, lambda m: m[0] if (m[4] or "").lower() in DUNDER and m[3] == "__" else m[2] or m[4], True)
            self.sub("emphasis", EMPHASIS, lambda m: m[1] or m[2], True)
        if "~~" in self.s:
            self.sub("emphasis", STRIKE, "\\1", True)
        if "  \n" in self.s:
            self.sub("break", re.compile(r"[ ]{2,}\n(?=[^\n])"), "\n\n")

    def latex(self) -> None:
        if "\\" in self.s:
            self.sub("heading", TEX_HEAD, lambda m: f"\n\n{OPEN}H{ {'part': 1, 'chapter': 1, 'title': 1, 'section': 2, 'subsection': 3}.get(m[1], 4)}{CLOSE}{m[2]}\n\n")
            self.sub("list", TEX_LIST, "\n\n")
            self.sub("list", TEX_ITEM, lambda m: f"\n{OPEN}L{CLOSE}{m[1] + ': ' if m[1] else ''}")
            self.sub("command", TEX_ENV, "\n\n")
            self.sub("command", TEX_DROP, "")
            self.sub("link", TEX_HREF, lambda m: f"{LINK_ON}{m[2] or m[3]}{LINK_OFF}")
            self.sub("accent", TEX_ACCENT, self.accent)
            self.sub("accent", TEX_LETTER, lambda m: LETTERS[m[1]])
            self.sub("command", TEX_GROUP, "\\1", True)
            self.sub("command", TEX_COMMAND, lambda m: SIGNS.get(m[1]) or ("‍" if m[2] is None else m[2].strip()[1:-1]), True)
            self.s = re.sub(" ?‍ ?", " ", self.s)
            self.sub("escape", TEX_ESCAPE, lambda m: {"{": "\x05", "}": "\x06"}.get(m[1], m[1]) if m[1] else "\n")
            self.sub("escape", TEX_SPACE, " ")
            self.sub("escape", MD_ESCAPE, "\\1")
        if "{" in self.s:
            self.sub("braces", BRACES, "\\1", True)
        if "~" in self.s:
            self.sub("tie", TIE, " ")
        self.s = self.s.replace("\x05", "{").replace("\x06", "}")

    @staticmethod
    def accent(m: re.Match) -> str:
        mark, letter = m[1] or m[5], m[2] or m[3] or m[4] or m[6] or m[7]
        whole = unicodedata.normalize("NFC", letter.replace("ı", "i").replace("ȷ", "j") + ACCENTS.get(mark, ""))
        opened, shut = m[0].startswith("{\\"), m[0].endswith("}")
        inner = m[0].count("{") - m[0].count("}")
        return ("{" if opened and inner > 0 else "") + whole + ("}" if shut and inner < 0 else "")

    def blocks(self) -> list[tuple[str, int, str, str]]:
        """(kind, level, text, label)."""
        raw: list[list] = []
        fresh = True
        for line in self.s.split("\n"):
            kind, level = "paragraph", 0
            m = re.match(rf"\s*{OPEN}(?:H(\d)|(L)|C(b)(\d+)){CLOSE}", line)
            if m and m[4]:
                raw.append(["code", 0, self.kept[int(m[4])][1], 0])
                fresh = True
                continue
            if m:
                kind, level, line = ("heading", int(m[1]), line[m.end() :]) if m[1] else ("list", 1, line[m.end() :])
            line = re.sub(rf"{OPEN}(?:H\d|L|Cb\d+){CLOSE}", "", line)
            if not line.replace(LINK_ON, "").replace(LINK_OFF, "").strip():
                fresh = True
                continue
            if kind == "paragraph" and NUMBERED.match(line):
                kind = "item"  # a numbered clause keeps its number
            if kind == "paragraph" and not fresh and raw:
                raw[-1][2] += " " + line.strip()
            else:
                raw.append([kind, level, line.strip(), 0])
            fresh = kind == "heading"
        out = []
        for kind, level, text, _ in raw:
            if kind != "code":
                linked = sum(len(x) for x in re.findall(f"{LINK_ON}([^{LINK_ON}{LINK_OFF}]*){LINK_OFF}", text))
                text = re.sub(rf"{OPEN}([CF])i(\d+){CLOSE}", lambda m: (f"`{self.kept[int(m[2])][1]}`" if m[1] == "C" else f"${self.kept[int(m[2])][1]}$"), text.replace(LINK_ON, "").replace(LINK_OFF, ""))
                if re.fullmatch(rf"\$[^$]+\$", text):
                    kind = "formula"
                text = _line(text)
            else:
                linked = 0
            out.append(("list" if kind == "item" else kind, level, text, decide(kind, text, linked)))
        return inherit(out)


def decide(kind: str, text: str, linked: int) -> str:
    """First pass: good, neargood or bad, or short where the block by itself doesn't tell.

    A block is bad if most of it are links or it is cut up by bars, and so is a line as long as a paragraph that has few stop words, is no
    sentence and has no label (``Keywords: ...``). Lists and texts in a script without stop words here stay undecided.
    """
    if kind in ("code", "formula"):
        return "good"
    if linked > LINKS_MOST * len(text) or kind == "paragraph" and len(BARS.findall(text)) >= 3:
        return "bad"
    if kind == "heading" or len(text) < LENGTH_LOW:
        return "short"
    words = re.findall(r"\w+", text.lower())
    density = sum(w in STOP for w in words) / max(1, len(words))
    if density >= STOP_HIGH:
        return "good" if len(text) > LENGTH_HIGH else "neargood"
    if density >= STOP_LOW:
        return "neargood"
    told = re.search(r"[.!?…。]['\"”’)\]]*$", text) and not re.search(r" [|·»•/] |©|\ball rights reserved\b", text, re.I) or re.match(r"\w[\w -]{0,30}[:—–]", text)
    plain = 2 * sum(c.isascii() for c in text) > len(text)
    return "bad" if kind == "paragraph" and plain and not told else "short"


def inherit(blocks: list[tuple]) -> list[tuple]:
    """Second pass: short blocks are bad if the nearest decided ones are (the only one at either end of a text; of a
    heading, the one that follows), nearly good ones if both are, and all others good."""
    labels = [b[3] for b in blocks]
    if not any(b[3] in ("good", "neargood") and b[0] != "code" for b in blocks):
        return [(*b[:3], "good") for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        label = labels[i]
        if label in ("short", "neargood"):
            firm = ("good", "bad") if label == "neargood" else ("good", "neargood", "bad")
            near = [next((x for x in side if x in firm), "") for side in (reversed(labels[:i]), labels[i + 1 :])]
            wrong = near == ["bad", "bad"] or label == "short" and "bad" in near and "" in near or b[0] == "heading" and near[1] == "bad"
            label = "bad" if wrong else "good"
        out.append((*b[:3], label))
    return out


#: What any of the four languages needs: a text without it has no syntax.
SIGNED = re.compile("[&<>{}\\\\\\[\\]*_~`$#=•\x01-\x06\n\r" + chr(0x2028) + chr(0x2029) + "]")
MARKED_LINE = re.compile(r"[ \t]{0,6}[-+]")
NUMBERED = re.compile(r"\s{0,3}\d{1,3}[.)]\s+\S")


STOPS = (" ,", " .", " ;", " :", " !", " ?")


def _line(text: str) -> str:
    """One line as it is shown: single blanks, none before a stop."""
    if "  " in text or "\t" in text:
        text = re.sub(r"[ \t]+", " ", text)
    text = text.strip()
    return re.sub(r" (?=[,.;:!?](?:\s|$))", "", text) if any(x in text for x in STOPS) else text


def clean(text: str) -> tuple[str, list[tuple[str, int, str, str]], frozenset[str]]:
    """Clean text, its blocks, and the kinds of syntax that were in it."""
    text = normalize(text)[0]
    if not SIGNED.search(text) and "''" not in text and not MARKED_LINE.match(text):  # one line of prose
        line = _line(text)
        return line, [("list" if NUMBERED.match(text) else "paragraph", 0, line, "good")] if line else [], frozenset()
    c = Cleaner(text)
    c.run()
    blocks = c.blocks()
    shown = {"heading": lambda n, t: f"{'#' * max(n, 1)} {t}", "list": lambda n, t: f"- {t}" if n else t, "code": lambda n, t: f"```\n{t}\n```"}
    lines: list[str] = []
    before = None
    for kind, level, t, label in blocks:
        if label != "bad" or len(blocks) == 1:
            if lines and not (kind == before == "list"):
                lines.append("")
            lines.append(shown.get(kind, lambda n, t: t)(level, t))
            before = kind
    if len(blocks) == 1 and blocks[0][0] == "heading":
        lines = [blocks[0][2]]
    return "\n".join(lines), blocks, frozenset(c.kinds)


BLOCK = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType())]))


def cleaned(df: DataFrame, key: str = "cid", fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """(key, field, text, kinds, blocks): every non-NULL field as clean text.

    Headings come out as ``# ...``, list items as ``- ...``, code between fences or back quotes, formulas between
    dollars. ``kinds`` names the syntax found, and is empty for plain prose; an empty text stays empty. A field that
    is only one block is never left out. Repeated rows are repeated, other columns aren't read. Narrow: no shuffle.
    """
    kind = df.schema[key].dataType

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False, name=None):
                for f, v in zip(fields, r[1:]):
                    if isinstance(v, str):
                        text, blocks, kinds = clean(v)
                        rows.append((r[0], f, text, sorted(kinds), blocks))
            yield pd.DataFrame(rows, columns=["key", "field", "text", "kinds", "blocks"])

    out = T.StructType([T.StructField("key", kind), T.StructField("field", T.StringType()), T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("blocks", BLOCK)])
    return df.select(F.col(key), *fields).mapInPandas(run, out).withColumnRenamed("key", key)


def found(df: DataFrame, key: str = "cid", fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """(key, field): the fields with markup in them."""
    return cleaned(df, key, fields).where(F.size("kinds") > 0).select(key, "field").distinct()
