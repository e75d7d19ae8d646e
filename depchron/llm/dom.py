"""A page as a tree of elements with measures, and the text blocks in it; plain Python inside tasks, linear in the page's length.

The reader follows HTML's rules for what is not written out: a paragraph ends where a block begins, a list item where the next
one does, scripts and styles hold no tags, an end tag without its start is passed over. Only block elements, and inline ones with
attributes of their own, become nodes; other inline elements belong to the node around them.
"""

from __future__ import annotations

import html
import math
import re
from functools import lru_cache

#: A comment, a tag with its attributes (quotes count after an equals sign only), or a declaration.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+""")
# Elements by how they are read.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript template svg math object video audio canvas".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr select".split())
#: What a start tag ends, up to the element that bounds it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}), "body": ({"head"}, {"html"}),
}
END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
NAMED = ("class", "id", "role", "itemprop")
CONTROLS = frozenset("input button select textarea option label fieldset legend".split())

GROUPS = (
    ("article",), ("main",), ("section",), ("div",), ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside",), ("form", "search", "fieldset", "dialog"), ("p",), ("h1",),
    ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "dir"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
    ("blockquote", "pre", "figure", "figcaption"), ("body", "html"),
)
GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}
NAMES = (
    "depth", "chars", "share", "links", "density", "marks", "word_length", "paragraphs", "items", "controls", "headings", "before", "siblings", "place", "alike", "previous_chars",
    "previous_links", "next_chars", "next_links", "content_sum", "content_max", "junk_sum", "junk_max", "above_content", "above_junk", "above_nav", "above_main", "below_content",
    "below_main", "hidden", "own_chars", "own_links", "parent_chars", "parent_links", "of_parent", "digits", "copyright", "sentences", "elements",
)


@lru_cache(65536)
def tokens(text: str) -> tuple[str, ...]:
    """Words of attribute values: cut at case changes and at all but letters, lower-cased."""
    cut = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    return tuple(w for w in re.findall(r"[a-z]{2,}", cut.lower()))


class Page:
    """Nodes in page order: parent, tag, tokens, measures; ``pieces`` are (node, text), and None where a block begins or ends."""

    def __init__(self, source: str, label: str | None = None):
        self.parent, self.tag, self.words, self.hidden, self.label = [-1], ["html"], [()], [False], [0]
        self.pieces: list[tuple[int, str] | None] = []
        self.own, self.linked, self.controls = [0], [0], [0]
        self._read(source, label)

    def _node(self, parent: int, name: str, attributes: str, label: str | None) -> int:
        found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
        self.parent.append(parent)
        self.tag.append(name)
        self.words.append(tuple(w for k in NAMED if k in found for w in tokens(found[k])))
        style = found.get("style", "").replace(" ", "").lower()
        self.hidden.append("hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style)
        self.label.append(int(found[label]) if label in found else self.label[parent])
        self.own.append(0)
        self.linked.append(0)
        self.controls.append(0)
        return len(self.parent) - 1

    def _read(self, source: str, label: str | None) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # name, node
        open_: dict[str, int] = {}
        pieces, at, links = self.pieces, 0, 0

        def pop_to(index: int) -> None:
            nonlocal links
            for name, _ in stack[index:]:
                open_[name] -= 1
                links -= name == "a"
            del stack[index:]
            pieces.append(None)

        def close(names: set[str], bounds: set[str]) -> None:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    return pop_to(i)
                if stack[i][0] in bounds:
                    return None
            return None

        def say(text: str) -> None:
            text = html.unescape(text)
            node = stack[-1][1]
            pieces.append((node, text))
            n = len(text) - text.count(" ")
            self.own[node] += n
            if links:
                self.linked[node] += n

        while found := TOKEN.search(source, at):
            if found.start() > at:
                say(source[at : found.start()])
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                if name in BLOCKS or name in RAW:
                    if open_.get(name):
                        i = len(stack) - 1
                        while stack[i][0] != name:
                            i -= 1
                        pop_to(i)
                    else:
                        pieces.append(None)
                elif open_.get(name):
                    i = len(stack) - 1
                    while stack[i][0] != name and stack[i][0] not in BLOCKS:
                        i -= 1
                    if stack[i][0] == name:  # across a block it ends nothing
                        for other, _ in stack[i:]:
                            open_[other] -= 1
                            links -= other == "a"
                        del stack[i:]
                continue
            if name in RAW:
                end = END_OF[name].search(source, at)
                at = end.end() if end else len(source)
                if name == "textarea":
                    self.controls[stack[-1][1]] += 1
                continue
            if name == "br":
                pieces.append((stack[-1][1], " "))
                continue
            if name in CONTROLS:
                self.controls[stack[-1][1]] += 1
            block = name in BLOCKS
            if block:
                pieces.append(None)
                if name in CLOSES_P and open_.get("p"):
                    close({"p"}, {"td", "th", "table", "button", "caption"})
                if name in ENDS and any(open_.get(x) for x in ENDS[name][0]):
                    close(*ENDS[name])
            if name in VOID:
                continue
            attributes = found[3]
            own = block or ("=" in attributes and re.search(r"(?i)\b(class|id|role|style|data-y)\s*=", attributes)) or "hidden" in attributes
            node = self._node(stack[-1][1], name, attributes, label) if own and name not in ("html", "head") else stack[-1][1]
            stack.append((name, node))
            open_[name] = open_.get(name, 0) + 1
            links += name == "a"
        if at < len(source):
            say(source[at:])

    def text(self, kept: list[bool]) -> str:
        """The text of the kept nodes: white space as one space, blocks joined by a line feed."""
        blocks, run = [], []
        for piece in [*self.pieces, None]:
            if piece is not None:
                if kept[piece[0]]:
                    run.append(piece[1])
            elif run:
                if line := " ".join("".join(run).split()):
                    blocks.append(line)
                run = []
        return "\n".join(blocks)

    def features(self, scores: dict[str, tuple[float, float]]) -> list[list[float]]:
        """One list of numbers for each node: ``NAMES``, then the element's group. ``scores`` has two weights for each attribute token."""
        n, parent, tag = len(self.parent), self.parent, self.tag
        chars, linked, controls = self.own[:], self.linked[:], self.controls[:]
        marks, digits, words, sentences, sign = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        before, seen = [0] * n, 0
        latest = -1
        for piece in self.pieces:
            if piece is None:
                continue
            node, text = piece
            if node > latest:  # nodes in between have no text before their own
                before[latest + 1 : node + 1] = [seen] * (node - latest)
                latest = node
            seen += len(text) - text.count(" ")
            if text.isspace():
                continue
            words[node] += len(text.split())
            full = text.count(". ") + text.rstrip().endswith((".", "!", "?"))
            sentences[node] += full
            marks[node] += text.count(",") + text.count(".") + text.count(";")
            sign[node] += "©" in text
            digits[node] += sum(map(text.count, "0123456789"))
        before[latest + 1 :] = [seen] * (n - 1 - latest)
        elements = [1] * n
        paragraphs = [t == "p" for t in tag]
        items = [t in ("li", "dd", "dt") for t in tag]
        headings = [len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in tag]
        mains = [t in ("article", "main") for t in tag]
        content, junk, most_content, most_junk, least = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        for i, own in enumerate(self.words):
            if own:
                of = [score_of(w, scores) for w in own]
                content[i], junk[i] = sum(x[0] for x in of), sum(x[1] for x in of)
                most_content[i], most_junk[i] = max(x[0] for x in of), max(x[1] for x in of)
        below = most_content[:]
        children, first_of = [0] * n, [-1] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for total in (chars, linked, controls, marks, digits, words, sentences, sign, elements):
                total[p] += total[i]
            paragraphs[p] += paragraphs[i]
            items[p] += items[i]
            headings[p] += headings[i]
            mains[p] |= mains[i]
            below[p] = max(below[p], below[i])
            children[p] += 1
        log = math.log1p
        depth, place, previous, after = [0] * n, [0] * n, [-1] * n, [-1] * n
        above_content, above_junk, above_nav, above_main, hidden = [0.0] * n, [0.0] * n, [0] * n, [0] * n, [0] * n
        count, alike = [0] * n, [{} for _ in range(n)]
        for i in range(1, n):
            p = parent[i]
            depth[i], place[i] = depth[p] + 1, count[p]
            count[p] += 1
            alike[p][tag[i]] = alike[p].get(tag[i], 0) + 1
            if (last := first_of[p]) >= 0:
                previous[i], after[last] = last, i
            first_of[p] = i
            above_content[i] = max(above_content[p], most_content[p])
            above_junk[i] = max(above_junk[p], most_junk[p])
            above_nav[i] = above_nav[p] or tag[p] in ("nav", "header", "footer", "aside", "form", "menu", "dialog")
            above_main[i] = above_main[p] or tag[p] in ("article", "main")
            hidden[i] = hidden[p] or self.hidden[i]
        whole = max(1, chars[0])
        out = []
        for i in range(n):
            c, p = chars[i], max(0, parent[i])
            a, b = previous[i], after[i]
            row = [
                depth[i], log(c), c / whole, linked[i] / c if c else 0.0, log(c / elements[i]), 100 * marks[i] / c if c else 0.0, c / words[i] if words[i] else 0.0,
                log(paragraphs[i]), log(items[i]), log(controls[i]), log(headings[i]), before[i] / whole, log(children[p]), place[i] / max(1, children[p]),
                alike[p].get(tag[i], 0) / max(1, children[p]), log(chars[a]) if a >= 0 else -1.0, linked[a] / max(1, chars[a]) if a >= 0 else -1.0,
                log(chars[b]) if b >= 0 else -1.0, linked[b] / max(1, chars[b]) if b >= 0 else -1.0, content[i], most_content[i], junk[i], most_junk[i],
                above_content[i], above_junk[i], above_nav[i], above_main[i], below[i], mains[i], hidden[i], log(self.own[i]),
                self.linked[i] / self.own[i] if self.own[i] else 0.0, log(chars[p]), linked[p] / max(1, chars[p]), c / max(1, chars[p]),
                digits[i] / c if c else 0.0, sign[i] > 0, log(sentences[i]), log(elements[i]),
            ]
            kind = [0.0] * (len(GROUPS) + 1)
            kind[GROUP.get(tag[i], len(GROUPS))] = 1.0
            out.append(row + kind)
        self.chars = chars
        return out


def score_of(word: str, scores: dict[str, tuple[float, float]]) -> tuple[float, float]:
    """The weights of a token; of one that isn't known those of the longest known beginning or end of four letters or more."""
    if (own := scores.get(word)) is not None:
        return own
    for size in range(min(len(word) - 1, 24), 3, -1):
        for part in (word[:size], word[-size:]):
            if (own := scores.get(part)) is not None:
                return own
    return (0.0, 0.0)
