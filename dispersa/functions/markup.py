"""Cleaning of HTML and of wiki markup, and the functions of its templates.

Column functions where patterns suffice; template expansion and nested markup are plain Python, for use in one Arrow
batch function over whole pages.
"""

from __future__ import annotations

import ast
import html
import operator
import re
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def clean_html(page: Column) -> Column:
    """Text of an HTML page: no comments, scripts, styles or tags; runs of spaces are one, blank lines go."""
    out = F.coalesce(page, F.lit(""))
    for pattern, to in ((r"(?s)<!--.*?-->", " "), (r"(?is)<(script|style|noscript|head)\b.*?</\1\s*>", " "), (r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", " "), (r"[ \t\x0B\f\r]+", " "), (r" ?\n ?", "\n"), (r"\n{2,}", "\n")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, r"^\s+|\s+$", ""))


def unescape_text(text: str) -> str:
    """Named, decimal and hexadecimal entities that end with a semicolon; unknown and cut ones stay."""
    return re.sub(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", _entity, text) if "&" in text else text


def _entity(m: re.Match) -> str:
    found = html.unescape(m[0])
    return m[0] if found.endswith(";") and len(found) > 1 else found  # &ampx; is no name, though it begins with one


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unescape_text(t))


def unescape(text: Column) -> Column:
    return pandas_udf(_unescape, StringType())(text)


def plane_zero(reference: Column) -> Column:
    """The character of a decimal reference such as ``&#233;``; empty from 0x10000 on, null for what is no reference."""
    code = F.regexp_extract(reference, r"^&#([0-9]{1,18});$", 1).try_cast("long")
    low = code.between(0, 0xFFFF)
    return F.when(low, F.decode(F.unhex(F.lpad(F.hex(F.when(low, code)), 4, "0")), "UTF-16BE")).when(code > 0xFFFF, F.lit(""))


def ucfirst(s: str) -> str:
    return s[:1].upper() + s[1:]


def lcfirst(s: str) -> str:
    return s[:1].lower() + s[1:]


def page_url(base: str, page_id: Column) -> Column:
    return F.concat(F.lit(f"{base}?curid="), page_id.cast("string"))


def normal_title(title: str, namespaces: frozenset[str] = frozenset()) -> str:
    """Underscores and runs of spaces as one space, first letters upper-case, a known namespace before the colon."""
    t = re.sub(r"[\s_]+", " ", title).strip()
    space, colon, rest = t.partition(":")
    if colon:
        known = ucfirst(space.strip().lower() if space.strip().lower() in {n.lower() for n in namespaces} else space.strip())
        if known in namespaces:
            return f"{known}:{ucfirst(rest.strip())}"
        return f"{ucfirst(space.strip())}:{(' ' if rest[:1] == ' ' else '')}{ucfirst(rest.strip()) if rest[:1] != ' ' else rest.strip()}"
    return ucfirst(t)


def admitted_page(ns: int, categories: set[str], include: set[str], exclude: set[str], text: str = "", keep_disambiguation: bool = True) -> bool:
    """Articles only; none of the excluded categories, and one of the included ones if any are named."""
    if ns != 0 or (not keep_disambiguation and re.search(r"\{\{\s*disambig", text, re.I)):
        return False
    return not (categories & exclude) and (not include or bool(categories & include))


def category_lists(lines: list[str]) -> tuple[set[str], set[str]]:
    """Included and excluded categories: ``^`` marks the latter, ``#`` a comment."""
    clean = [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
    return {x for x in clean if not x.startswith("^")}, {x[1:].strip() for x in clean if x.startswith("^")}


def balanced(text: str, opening: str, closing: str) -> list[tuple[int, int]]:
    """Outermost regions from ``opening`` to the ``closing`` that ends it; an unclosed one is none."""
    out, depth, begin = [], 0, 0
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if m.group() == opening:
            if not depth:
                begin = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append((begin, m.end()))
    return out


def drop_regions(text: str, regions: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for i, j in sorted(regions):
        if i >= at:
            out.append(text[at:i])
        at = max(at, j)
    return "".join((*out, text[at:]))


def drop_nested(text: str, opening: str, closing: str) -> str:
    return drop_regions(text, balanced(text, opening, closing))


def split_parts(body: str) -> list[str]:
    """Splits at bars outside of nested braces and brackets."""
    out, depth, last, i = [], 0, 0, 0
    while i < len(body):
        two = body[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif two in ("}}", "]]"):
            depth, i = max(0, depth - 1), i + 2
        else:
            if body[i] == "|" and not depth:
                out.append(body[last:i])
                last = i + 1
            i += 1
    return [*out, body[last:]]


def bind(parts: list[str]) -> dict[str, str]:
    """Arguments by name, or by place from 1; named ones are trimmed."""
    out, place = {}, 0
    for p in parts:
        m = re.match(r"\s*([^=\[\]{}<>|]*?)\s*=(.*)", p, re.S)
        if m:
            out[m[1]] = m[2].strip() if "]]" not in m[2] else m[2]
        else:
            place += 1
            out[str(place)] = p
    return out


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Not: operator.not_, ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def calculate(expression: str) -> str:
    """Arithmetic of numbers, parentheses, + - * / div mod ^ round, comparisons, and, or, not; nothing is evaluated as code."""
    text = re.sub(r"\bdiv\b", "/", expression)
    text = re.sub(r"\bmod\b", "%", text).replace("^", "**").replace("<>", "!=")
    text = re.sub(r"(?<![<>=!])=(?!=)", "==", text)
    parts = re.split(r"\bround\b", text)
    if len(text) > 500:
        raise ValueError("the expression is too long")

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return node.value
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            base, power = value(node.left), value(node.right)
            if abs(power) > 100 or abs(base) > 1e6:
                raise ValueError("the power is too large")
            return base**power
        if isinstance(node, ast.BinOp):
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp):
            return _OPERATORS[type(node.op)](value(node.operand))
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            return int(_OPERATORS[type(node.ops[0])](value(node.left), value(node.comparators[0])))
        if isinstance(node, ast.BoolOp):
            found = [bool(value(v)) for v in node.values]
            return int(all(found) if isinstance(node.op, ast.And) else any(found))
        raise ValueError("not arithmetic")

    got = value(ast.parse(parts[0].strip(), mode="eval").body)
    for p in parts[1:]:
        got = round(got, int(value(ast.parse(p.strip(), mode="eval").body)))
    if isinstance(got, bool):
        got = int(got)
    return str(int(got)) if isinstance(got, float) and got.is_integer() else str(got)


def roman(number: str, fallback: str = "") -> str:
    if not number.strip().isdigit() or not 0 < int(number) < 5000:
        return fallback
    n, out = int(number), ""
    for digit, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), ("M", "CM", "D", "CD", "C", "XC", "L", "XL", "X", "IX", "V", "IV", "I"), strict=True):
        out += sign * (n // digit)
        n %= digit
    return out


def substring(s: str, first: str = "1", last: str = "-1") -> str:
    """From 1, both ends included; negative places count from the end."""
    n, i, j = len(s), int(first or 1), int(last or -1)
    i, j = (i if i >= 0 else n + i + 1), (j if j >= 0 else n + j + 1)
    return s[max(0, i - 1) : j]


def _plain(flag: str) -> bool:
    return flag.strip().lower() not in ("false", "no", "0", "n")


def _find(a: dict[str, str]) -> str:
    s, what = a.get("source", a.get("1", "")), a.get("target", a.get("2", ""))
    if _plain(a.get("plain", a.get("4", "true"))):
        return str(s.find(what) + 1)
    m = re.search(what, s)
    return str(m.start() + 1 if m else 0)


def _replaced(a: dict[str, str]) -> str:
    s, what, to = (a.get(n, a.get(str(i), "")) for i, n in enumerate(("source", "pattern", "replace"), 1))
    count = int(a.get("count", a.get("4", "0")) or 0)
    if _plain(a.get("plain", a.get("5", "true"))):
        return s.replace(what, to, count or -1)
    return re.sub(what, to, s, count=count)


MODULES: dict[str, dict[str, Callable[[dict[str, str]], str]]] = {
    "If empty": {"main": lambda a: next((v for _, v in sorted(a.items()) if v.strip()), "")},
    "String": {
        "len": lambda a: str(len(a.get("s", a.get("1", "")))),
        "sub": lambda a: substring(a.get("s", a.get("1", "")), a.get("i", a.get("2", "1")), a.get("j", a.get("3", "-1"))),
        "sublength": lambda a: a.get("s", a.get("1", ""))[int(a.get("i", a.get("2", "0"))) :][: int(a["len"]) if "len" in a else None],
        "pos": lambda a: substring(a.get("target", a.get("1", "")), a.get("pos", a.get("2", "1")), a.get("pos", a.get("2", "1"))),
        "find": _find,
        "replace": _replaced,
        "rep": lambda a: a.get("source", a.get("1", "")) * int(a.get("count", a.get("2", "1"))),
    },
    "Roman": {"main": lambda a: roman(a.get("1", ""), a.get("2", ""))},
    "convert": {"convert": lambda a: f"{a.get('1', '')} {a.get('2', '')}".strip()},
}


class Expander:
    """Expands templates and parser functions. ``templates`` maps qualified titles to bodies, from ``define_template``.

    Templates that include themselves would never end, so ``cut`` says whether the bound on depth or length was met and
    something of the text is missing or unexpanded.
    """

    def __init__(self, templates: dict[str, str], title: str = "", deepest: int = 20, longest: int = 2_000_000) -> None:
        self.templates, self.title, self.deepest, self.longest = templates, title, deepest, longest
        self.cut = False
        page = title.rpartition(":")[2]
        self.magic = {"PAGENAME": page, "FULLPAGENAME": title, "NAMESPACE": title.rpartition(":")[0], "!": "|", "=": "=", "PAGENAMEE": quote(page.replace(" ", "_")), "BASEPAGENAME": page.rpartition("/")[0] or page, "SUBPAGENAME": page.rpartition("/")[2]}

    def expand(self, text: str, args: dict[str, str] | None = None, depth: int = 0) -> str:
        """Text with arguments and templates put in; beyond the depth or length bound nothing comes of a template."""
        if args is not None:
            text = self._arguments(text, args)
        if depth > self.deepest:
            self.cut = True
            return ""
        out, at, size = [], 0, 0
        for i, j in balanced(text, "{{", "}}"):
            out += [text[at:i], self.call(text[i + 2 : j - 2], depth + 1)]
            size += len(out[-1])
            at = j
            if size > self.longest:
                self.cut = True
                break
        return "".join((*out, text[at:]))

    def _arguments(self, text: str, args: dict[str, str]) -> str:
        pattern = re.compile(r"\{\{\{([^{}|]*)(?:\|((?:[^{}]|\{\{[^{}]*\}\}|\{[^{]|\}[^}])*?))?\}\}\}")
        for _ in range(self.deepest):
            new = pattern.sub(lambda m: args.get(m[1].strip(), m[2] if m[2] is not None else ""), text)
            if new == text:
                return new
            self.cut |= len(new) > self.longest
            text = new[: self.longest]
        self.cut = True
        return text

    def call(self, body: str, depth: int) -> str:
        parts = split_parts(body)
        name = self.expand(parts[0], None, depth).strip()
        name = re.sub(r"^(subst|safesubst|msg|msgnw):\s*", "", name)
        if name in self.magic and len(parts) == 1:
            return self.magic[name]
        function, colon, first = name.partition(":")
        if colon and function.lower() in self.FUNCTIONS:
            try:
                return self.FUNCTIONS[function.lower()](self, first, parts[1:], depth)
            except (ValueError, KeyError, TypeError, ZeroDivisionError, OverflowError, SyntaxError, re.error):
                return ""
        title = normal_title(name, frozenset({"Template"}))
        body = self.templates.get(name if colon else f"Template:{title}", self.templates.get(title if colon else name))
        for _ in range(5):  # redirects
            m = re.match(r"#redirect\s*:?\s*\[\[([^\]|#]+)", body or "", re.I)
            if not m:
                break
            body = self.templates.get(m[1].strip())
        if body is None:
            return ""
        return self.expand(body, bind([self.expand(p, None, depth) for p in parts[1:]]), depth)

    def _if(self, first, rest, depth):
        return self.expand((rest[0] if first.strip() else rest[1] if len(rest) > 1 else "") if rest else "", None, depth).strip()

    def _ifeq(self, first, rest, depth):
        same = first.strip() == self.expand(rest[0] if rest else "", None, depth).strip()
        return self.expand(rest[1] if same and len(rest) > 1 else rest[2] if not same and len(rest) > 2 else "", None, depth).strip()

    def _iferror(self, first, rest, depth):
        return self.expand(rest[0], None, depth).strip() if rest and "error" in first.lower() else first if len(rest) < 2 else self.expand(rest[1], None, depth).strip()

    def _switch(self, first, rest, depth):
        waiting, default = False, ""
        for k, p in enumerate(rest):
            left, equals, right = p.partition("=")
            case = self.expand(left, None, depth).strip()
            if not equals:
                if k == len(rest) - 1:
                    return case
                waiting |= case == first.strip()
            elif waiting or case == first.strip():
                return self.expand(right, None, depth).strip()
            elif case == "#default":
                default = right
        return self.expand(default, None, depth).strip()

    def _invoke(self, first, rest, depth):
        arguments = bind([self.expand(p, None, depth) for p in rest[1:]])
        return MODULES[first.strip()][rest[0].strip() if rest else "main"](arguments)

    FUNCTIONS: dict[str, Callable] = {
        "#if": _if,
        "#ifeq": _ifeq,
        "#iferror": _iferror,
        "#switch": _switch,
        "#invoke": _invoke,
        "#expr": lambda self, first, rest, depth: calculate(first),
        "#ifexpr": lambda self, first, rest, depth: self._if("1" if calculate(first) not in ("0", "") else "", rest, depth),
        "lc": lambda self, first, rest, depth: first.lower(),
        "uc": lambda self, first, rest, depth: first.upper(),
        "lcfirst": lambda self, first, rest, depth: lcfirst(first),
        "ucfirst": lambda self, first, rest, depth: ucfirst(first),
        "urlencode": lambda self, first, rest, depth: quote(first.replace(" ", "+"), safe="+"),
        "int": lambda self, first, rest, depth: str(int(first)),
        "#ifexist": lambda self, first, rest, depth: "",
        "formatnum": lambda self, first, rest, depth: first,
    }


def define_template(body: str) -> str:
    """What a page that includes the template sees of its source."""
    body = re.sub(r"(?s)<!--.*?-->", "", body)
    only = re.findall(r"(?is)<onlyinclude>(.*?)</onlyinclude>", body)
    body = "".join(only) if only else re.sub(r"(?is)<noinclude>.*?(</noinclude>|$)", "", body)
    return re.sub(r"(?i)</?includeonly\s*/?>", "", body)


# Switches, discarded elements and link protocols of the markup.
SWITCHES = [
    "__NOTOC__", "__FORCETOC__", "__TOC__", "__NEWSECTIONLINK__", "__NONEWSECTIONLINK__", "__NOGALLERY__", "__HIDDENCAT__", "__NOCONTENTCONVERT__", "__NOCC__",
    "__NOTITLECONVERT__", "__NOTC__", "__START__", "__END__", "__INDEX__", "__NOINDEX__", "__STATICREDIRECT__", "__DISAMBIG__", "__NOEDITSECTION__",
]
DISCARDED = [
    "gallery", "timeline", "noinclude", "pre", "table", "tr", "td", "th", "caption", "div", "form", "input", "select", "option", "textarea",
    "ul", "li", "ol", "dl", "dt", "dd", "menu", "dir", "ref", "references", "img", "imagemap", "source", "small", "sub", "sup", "indicator",
]
PROTOCOLS = [
    "bitcoin:", "ftp://", "ftps://", "geo:", "git://", "gopher://", "http://", "https://", "irc://", "ircs://", "magnet:", "mailto:", "mms://", "news:",
    "nntp://", "redis://", "sftp://", "sip:", "sips:", "sms:", "ssh://", "svn://", "tel:", "telnet://", "urn:", "worldwind://", "xmpp:", "//",
]
_LINK = "(?:" + "|".join(map(re.escape, PROTOCOLS)) + ")"
_PLACEHOLDERS = {"math": "formula", "code": "codice"}


def wiki_links(text: str, namespaces: frozenset[str] = frozenset({"w", "wiktionary", "wikt"})) -> str:
    """Labels in place of internal links; those into namespaces that are not admitted go."""
    out, at = [], 0
    for i, j in balanced(text, "[[", "]]"):
        parts = split_parts(text[i + 2 : j - 2])
        target = parts[0].strip()
        space = target.lstrip(":").partition(":")
        known = not space[1] or space[0].strip().lower() in namespaces or target.startswith(":")
        trail = re.match(r"\w*", text[j:]).group()
        out.append(text[at:i])
        if known:
            out.append(wiki_links(parts[-1] if len(parts) > 1 else target.lstrip(":"), namespaces) + trail)
        at = j + len(trail)
    return "".join((*out, text[at:]))


def wiki_text(text: str, templates: dict[str, str] | None = None, title: str = "", keep_sections: bool = True, keep_lists: bool = False, expander: Expander | None = None) -> str:
    """Plain text of wiki markup: templates expanded (or dropped without any), tables, references and markup gone.

    An ``expander`` stands in for ``templates`` and tells afterwards whether it met a bound.
    """
    text = re.sub(r"(?s)<!--.*?-->", "", text)
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m[1])
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r"(?is)<nowiki>(.*?)</nowiki>", hide, text)
    expander = expander or (Expander(templates, title) if templates is not None else None)
    text = expander.expand(text) if expander else drop_nested(text, "{{", "}}")
    text = drop_nested(text, "{|", "|}")
    text = re.sub("|".join(SWITCHES), "", text)
    for tag, name in _PLACEHOLDERS.items():
        count = iter(range(1, 1 << 30))
        text = re.sub(rf"(?is)<{tag}\b[^>/]*>.*?</{tag}>", lambda m, n=name, c=count: f"{n}_{next(c)}", text)
    text = re.sub(r"(?i)<(ref|references|br|hr|nowiki)\b[^<>]*/>", "", text)
    for tag in DISCARDED:
        text = re.sub(rf"(?is)<{tag}\b[^>/]*>.*?</{tag}\s*>", "", text)
    text = wiki_links(text)
    text = re.sub(rf"(?i)\[{_LINK}\S+\s+([^\]]*)\]", r"\1", text)
    text = re.sub(rf"(?i)\[{_LINK}[^\]\s]*\]", "", text)
    text = re.sub(r"'{2,5}", "", text)
    text = re.sub(r"<[^<>]*>", "", unescape_text(text))
    text = text.replace("<<", "«").replace(">>", "»")
    text = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text)
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r"\.{4,}", "...", text)
    text = re.sub(r" ([,.:;)\]»])", r"\1", text)
    text = re.sub(r"([\[(«]) ", r"\1", text)
    text = re.sub(r"\(\s*[,;]*\s*\)", "", text)
    return compact(text, keep_sections, keep_lists)


def compact(text: str, keep_sections: bool = True, keep_lists: bool = False) -> str:
    """Lines of prose; headings only above some text, lists dropped or as lines, residue of tables and templates gone."""
    out: list[str] = []
    heads: list[tuple[int, str]] = []
    for line in text.split("\n"):
        line = line.strip()
        head = re.fullmatch(r"(=+)\s*(.*?)\s*=+", line)
        if head:
            level = len(head[1])
            heads = [h for h in heads if h[0] < level] + [(level, head[2])]
            continue
        item = re.match(r"[*#:;]+\s*(.*)", line)
        if item:
            if not keep_lists or not item[1]:
                continue
            line = f"- {item[1]}" if line[0] in "*#" else item[1]
        if not line or line[0] in "{|}!" or line in ("(", ")", "."):
            continue
        if keep_sections:
            out += [f"{title.rstrip('.')}." for _, title in heads if title]
        heads = []
        out.append(line)
    return "\n".join(out)


def extract(rows, templates: dict[str, str] | None = None, base: str = "", least: int = 0, include: set[str] | None = None, exclude: set[str] | None = None, keep_disambiguation: bool = True):
    """``(id, url, title, text, cut)`` of ``rows(id, ns, title, redirect, text)`` of a dump: articles without redirects that ``admitted_page`` admits.

    ``templates`` come from ``collect_templates``, a map whose size that function checks; it is broadcast. ``cut`` marks
    pages whose templates met a bound of ``Expander``. Titles are normal ones; null texts count as empty.
    """
    from ..operators.frames import ready

    shared = ready(rows).sparkSession.sparkContext.broadcast((templates, include or set(), exclude or set()))

    def run(frames):
        known, inside, outside = shared.value
        for f in frames:
            out = []
            for i, name, source, categories in zip(f["id"], f["title"], f["text"], f["categories"], strict=True):
                if not admitted_page(0, set(categories), inside, outside, source or "", keep_disambiguation):
                    continue
                expander = Expander(known, name or "") if known is not None else None
                found = wiki_text(source or "", title=name or "", expander=expander)
                out.append((i, normal_title(name or ""), found, expander.cut if expander else False))
            yield pd.DataFrame(out, columns=["id", "title", "text", "cut"])

    pages = rows.filter("ns = 0 AND redirect IS NULL").select("id", "title", "text", dump_categories(F.coalesce("text", F.lit(""))).alias("categories"))
    got = pages.mapInPandas(run, "id long, title string, text string, cut boolean").filter(F.length("text") >= least)
    return got.select("id", page_url(base, F.col("id")).alias("url"), "title", "text", "cut")


def collect_templates(rows, most_bytes: int = 256 << 20) -> dict[str, str]:
    """Template bodies (namespaces 10 and 828) by title; ValueError beyond ``most_bytes`` of source."""
    found = rows.filter("ns IN (10, 828)").select("title", F.coalesce("text", F.lit("")).alias("text"))
    size = found.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of templates; at most {most_bytes} are broadcast")
    return {r.title: define_template(r.text) for r in found.toLocalIterator()}


def dump_categories(text: Column | str) -> Column:
    """The categories that a page's source names."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[Category:([^\]|]+)"), 1), lambda c: F.trim(c)))
