"""Documents of the editor (a JSON tree) rendered as Markdown, LaTeX or HTML, and their word counts.

A tree of any depth is no Spark type, so a document is one JSON string and rendering is one Arrow pass. Each format is
a table of marks and block templates; one walk serves all three.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.data import load

MARKS = ("bold", "italic", "underline", "strike")


def _swap(table: dict[str, str]) -> Callable[[str], str]:
    pattern = regex.compile("|".join(map(regex.escape, table)))
    return lambda text: pattern.sub(lambda m: table[m[0]], text)


md_escape = _swap({x: "\\" + x for x in "\\*_`"})
# Characters with a meaning in LaTeX and how they are written.
tex_escape = _swap({"\\": r"\textbackslash{}", "^": r"\textasciicircum{}", "~": r"\textasciitilde{}"} | {x: "\\" + x for x in "{}$&#_%"})
html_escape = _swap({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})


@dataclass
class Format:
    """How marks, links, code, citations and blocks are written."""

    escape: Callable[[str], str]
    marks: dict[str, tuple[str, str]]
    code: tuple[str, str]
    escape_code: Callable[[str], str]
    line_break: str
    link: Callable[[str, str], str]
    cite: Callable[[dict], str]
    heading: Callable[[int, str], str]
    paragraph: Callable[[str], str]
    bullet: Callable[[bool, list[list[str]]], str]
    quote: Callable[[list[str]], str]
    rule: str
    verbatim: Callable[[str], str]
    between: str = "\n\n"
    extra: dict = field(default_factory=dict)


def _indent(ordered: bool, items: list[list[str]]) -> str:
    lines = []
    for i, blocks in enumerate(items, 1):
        mark = f"{i}. " if ordered else "- "
        lines += [(mark if k == 0 else " " * len(mark)) + line for k, line in enumerate("\n".join(blocks).split("\n"))]
    return "\n".join(lines)


def markdown() -> Format:
    return Format(
        md_escape, {"bold": ("**", "**"), "italic": ("*", "*"), "strike": ("~~", "~~")}, ("`", "`"), str, "  \n", lambda t, u: f"[{t}]({u})", lambda n: n["label"],
        lambda level, t: "#" * level + " " + t, str, _indent, lambda b: "\n".join("> " + x for x in "\n\n".join(b).split("\n")), "---", lambda t: f"```\n{t}\n```",
    )


def latex(style: str = "vancouver") -> Format:
    env = lambda name, body: f"\\begin{{{name}}}\n{body}\n\\end{{{name}}}"
    command = "citep" if style == "apa" else "cite"
    sections = ("section", "subsection", "subsubsection", "paragraph")
    return Format(
        tex_escape, {"bold": (r"\textbf{", "}"), "italic": (r"\textit{", "}"), "underline": (r"\underline{", "}"), "strike": (r"\sout{", "}")}, (r"\texttt{", "}"), tex_escape, "\\\\\n",
        lambda t, u: f"\\href{{{regex.sub(r'([#%\\])', r'\\\1', u)}}}{{{t}}}", lambda n: f"\\{command}{{{','.join(n['names'])}}}", lambda level, t: f"\\{sections[level - 1]}{{{t}}}", str,
        lambda ordered, items: env("enumerate" if ordered else "itemize", "\n".join("  \\item " + "\n\n  ".join(b) for b in items)), lambda b: env("quote", "\n\n".join(b)),
        r"\noindent\rule{\linewidth}{0.4pt}", lambda t: env("verbatim", t),
    )


def html() -> Format:
    tag = lambda name, body: f"<{name}>{body}</{name}>"
    return Format(
        html_escape, {"bold": ("<strong>", "</strong>"), "italic": ("<em>", "</em>"), "underline": ("<u>", "</u>"), "strike": ("<s>", "</s>")}, ("<code>", "</code>"), html_escape, "<br>",
        lambda t, u: f'<a href="{html_escape(u)}">{t}</a>' if regex.match(r"(?i)(?:https?:|mailto:)", u) else t, lambda n: f'<span class="cite">{html_escape(n["label"])}</span>',
        lambda level, t: tag(f"h{level}", t), lambda t: tag("p", t or "<br>"), lambda ordered, items: tag("ol" if ordered else "ul", "".join(tag("li", "\n".join(b)) for b in items)),
        lambda b: tag("blockquote", "\n".join(b)), "<hr>", lambda t: f"<pre><code>{html_escape(t)}</code></pre>", "\n",
    )


def citation_keys(node: dict | None) -> list[str]:
    """Keys of all citations of a tree, in order of first use."""
    found: dict[str, None] = {}
    todo = [node] if node else []
    while todo:
        n = todo.pop()
        if n.get("type") == "citation":
            found |= dict.fromkeys((n.get("attrs") or {}).get("keys") or [])
        todo += reversed(n.get("content") or [])
    return list(found)


def number_runs(numbers: list[int]) -> str:
    """1,2,4–6 for distinct numbers; runs of three and more are shortened."""
    runs: list[list[int]] = []
    for n in sorted(set(numbers)):
        if runs and runs[-1][-1] == n - 1:
            runs[-1].append(n)
        else:
            runs.append([n])
    return ",".join(f"{r[0]}–{r[-1]}" if len(r) > 2 else ",".join(map(str, r)) for r in runs)


def cite_label(keys: list[str], order: list[str], style: str, labels: dict[str, str]) -> str:
    """[1,3] or (Smith, 2020; …); unknown keys show as ? in author-year style."""
    if not keys:
        return "[?]"
    if style == "vancouver":
        return f"[{number_runs([order.index(k) + 1 for k in keys if k in order])}]"
    return "(" + "; ".join(sorted((labels.get(k, "?") for k in keys), key=str.casefold)) + ")"


class Renderer:
    """Renders one document in one format."""

    def __init__(self, to: Format, order: list[str], style: str, labels: dict[str, str], names: dict[str, str]):
        self.to, self.order, self.style, self.labels, self.names = to, order, style, labels, names

    def inline(self, nodes: list[dict] | None) -> str:
        to, out = self.to, []
        for n in nodes or []:
            kind = n.get("type")
            if kind == "hardBreak":
                out.append(to.line_break)
            elif kind == "citation":
                keys = (n.get("attrs") or {}).get("keys") or []
                out.append(to.cite({"label": cite_label(keys, self.order, self.style, self.labels), "names": [self.names.get(k, regex.sub("[^A-Za-z0-9]", "_", k)) for k in keys]}))
            elif kind == "text" and n.get("text"):
                marks = {m["type"]: m.get("attrs") or {} for m in n.get("marks") or []}
                if "code" in marks:
                    out.append(to.code[0] + to.escape_code(n["text"]) + to.code[1])
                    continue
                text = to.escape(n["text"])
                for m in MARKS:
                    if m in marks and m in to.marks:
                        text = text.join(to.marks[m])
                if url := marks.get("link", {}).get("href"):
                    text = to.link(text, url)
                out.append(text)
        return "".join(out)

    def blocks(self, nodes: list[dict] | None) -> list[str]:
        to, out = self.to, []
        for n in nodes or []:
            inner = n.get("content")
            match n.get("type"):
                case "paragraph":
                    out.append(to.paragraph(self.inline(inner)))
                case "heading":
                    out.append(to.heading(min(max(int((n.get("attrs") or {}).get("level", 1)), 1), 4), self.inline(inner)))
                case "bulletList" | "orderedList" as kind:
                    out.append(to.bullet(kind == "orderedList", [self.blocks(item.get("content")) for item in inner or []]))
                case "blockquote":
                    out.append(to.quote(self.blocks(inner)))
                case "horizontalRule":
                    out.append(to.rule)
                case "codeBlock":
                    out.append(to.verbatim("".join(x.get("text") or "" for x in inner or [])))
        return out


def words(node: dict | None) -> int:
    """Words of a tree's text, citations as one word each."""
    if not node:
        return 0
    kind = node.get("type")
    if kind in ("paragraph", "heading", "codeBlock"):
        parts = [{"hardBreak": " ", "citation": " [1] "}.get(x.get("type"), x.get("text") or "") for x in node.get("content") or []]
        return len("".join(parts).split())
    return sum(words(x) for x in node.get("content") or [])


MISSING = "[reference missing: it was removed from this document's library]"


def render(text: str, title: str, to: str, style: str = "vancouver", refs: list[dict] | None = None) -> str:
    """A document as a whole; refs hold key, name (citation key), label (author, year), reference, in any order."""
    tree = json.loads(text)
    order = citation_keys(tree)
    known = {r["key"]: r for r in refs or []}
    made = {"markdown": markdown, "html": html}[to]() if to != "latex" else latex(style)
    body = Renderer(made, order, style, {k: r["label"] for k, r in known.items()}, {k: r["name"] for k, r in known.items()}).blocks(tree.get("content"))
    entries = [(str(i) if style == "vancouver" else "", k, known[k]["reference"] if k in known else MISSING) for i, k in enumerate(order, 1)]
    if style == "apa":
        entries.sort(key=lambda e: known[e[1]]["label"].casefold() if e[1] in known else "~")
    title = title.strip()
    if to == "markdown":
        listed = ("\n\n" if style == "apa" else "\n").join(f"{n}. {t}" if n else t for n, _, t in entries)
        return "\n\n".join([*([f"# {md_escape(title)}"] if title else []), *body, *(["## References", listed] if entries else [])]) + "\n"
    if to == "html":
        items = "".join(f'<li{"" if k in known else " class=" + chr(34) + "missing" + chr(34)}>{html_escape(t)}</li>' for _, k, t in entries)
        tail = f'<h2>References</h2>\n<ol class="refs{" apa" if style == "apa" else ""}">{items}</ol>' if entries else ""
        return (f'<h1 class="doc-title">{html_escape(title)}</h1>\n' if title else "") + "\n".join(body) + "\n" + tail
    packages = ["[T1]{fontenc}", "[utf8]{inputenc}", "[normalem]{ulem}", "{hyperref}", *(["[round]{natbib}"] if style == "apa" else [])]
    name = lambda k: known[k]["name"] if k in known else regex.sub("[^A-Za-z0-9]", "_", k)
    label = lambda k: "[" + regex.sub(r"^(.*), (\S+)$", r"\1(\2)", tex_escape(known[k]["label"])) + "]" if style == "apa" and k in known else ""
    bib = [f"\\begin{{thebibliography}}{{{'99' if len(entries) > 9 else '9'}}}", *[f"\\bibitem{label(k)}{{{name(k)}}} {tex_escape(t)}" for _, k, t in entries], "\\end{thebibliography}"] if entries else []
    parts = ["\n".join(["\\documentclass[11pt]{article}", *[f"\\usepackage{p}" for p in packages]])]
    parts += [f"\\title{{{tex_escape(title)}}}\n\\date{{}}"] if title else []
    parts += ["\\begin{document}", *(["\\maketitle"] if title else []), *(["\n\n".join(body)] if body else []), *(["\n".join(bib)] if bib else []), "\\end{document}"]
    return "\n\n".join(parts) + "\n"


def templates() -> list[dict]:
    """The templates of new documents: id, label and the headings of their sections."""
    return load("templates")


def template(key: str) -> dict:
    """The tree of a new document: the headings of a template, each with an empty paragraph; a blank page for an unknown key."""
    chosen = next((t for t in templates() if t["id"] == key), templates()[0])
    parts = [x for level, name in chosen["sections"] for x in ({"type": "heading", "attrs": {"level": level}, "content": [{"type": "text", "text": name}]}, {"type": "paragraph"})]
    return {"type": "doc", "content": parts or [{"type": "paragraph"}]}


def render_table(docs: DataFrame, to: str) -> DataFrame:
    """id, n_words, rendered of ``docs(id, title, json, style, refs)``; refs is array<struct<key, name, label, reference>>."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, words(json.loads(j)), render(j, t or "", to, s, [r if isinstance(r, dict) else r.asDict() for r in ([] if refs is None else refs)])) for i, t, j, s, refs in zip(frame.id, frame.title, frame.json, frame["style"], frame.refs, strict=True)]
            yield pd.DataFrame(rows, columns=["id", "n_words", "rendered"])

    return docs.where(F.col("json").isNotNull()).select("id", "title", "json", "style", "refs").mapInPandas(run, f"id {kind}, n_words int, rendered string")
