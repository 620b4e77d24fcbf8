"""A page as a tree, and the selectors that profiles name its parts by.

Selectors are lists of compounds (a tag or ``*``, ``#id``, ``.class``,
``[name]`` and ``[name=v]`` with ``=``, ``~=``, ``^=``, ``$=`` and ``*=``), joined
by a space (below) or ``>`` (right below); commas give alternatives. Anything
else is refused when the selector is compiled, not when a page is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

# Tags of HTML without content, those that end an open paragraph, and those that end one of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS_SAME = frozenset("li option dd dt tr td th".split())
RAW = ("script", "style")

_TOKEN = re.compile(
    r"""\s*(?P<join>[>,])\s* | (?P<space>\s+) | (?P<tag>\*|[A-Za-z][\w-]*) | \#(?P<id>[\w-]+) | \.(?P<cls>[\w-]+)
    | \[\s*(?P<name>[\w:.-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s"']+))\s*)?\]""",
    re.X,
)


class Compound(NamedTuple):
    tag: str | None
    ids: tuple[str, ...]
    classes: tuple[str, ...]
    attributes: tuple[tuple[str, str | None, str], ...]
    direct: bool  # right below the compound before it

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag is not None and self.tag != tag or any(attrs.get("id") != x for x in self.ids):
            return False
        if self.classes and not set(self.classes) <= set((attrs.get("class") or "").split()):
            return False
        return all(_fits(attrs.get(name), op, want) for name, op, want in self.attributes)


def _fits(have: str | None, op: str | None, want: str) -> bool:
    if have is None:
        return False
    match op:
        case None:
            return True
        case "=":
            return have == want
        case "~=":
            return want in have.split()
        case "^=":
            return want != "" and have.startswith(want)
        case "$=":
            return want != "" and have.endswith(want)
        case _:
            return want != "" and want in have


@lru_cache(1024)
def compiled(selector: str) -> tuple[tuple[Compound, ...], ...]:
    """The alternatives of a selector, each a run of compounds from the outside in."""
    text, at = selector.strip(), 0
    alternatives: list[list[Compound]] = [[]]
    now: dict | None = None
    direct = False

    def close():
        nonlocal now, direct
        if now is not None:
            alternatives[-1].append(Compound(now["tag"], tuple(now["ids"]), tuple(now["classes"]), tuple(now["attributes"]), direct))
            now, direct = None, False

    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"selector {selector!r} is not understood from {text[at:]!r}")
        at = m.end()
        if m["join"] or m["space"]:
            close()
            if (m["join"] and not alternatives[-1]) or direct:
                raise ValueError(f"selector {selector!r} joins nothing")
            direct = m["join"] == ">"
            if m["join"] == ",":
                alternatives.append([])
            continue
        if m["tag"] and now is not None:
            raise ValueError(f"selector {selector!r} has a tag behind other parts")
        now = now or {"tag": None, "ids": [], "classes": [], "attributes": []}
        if m["tag"]:
            now["tag"] = None if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            now["ids"].append(m["id"])
        elif m["cls"]:
            now["classes"].append(m["cls"])
        else:
            value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")
            now["attributes"].append((m["name"].lower(), m["op"], value))
    close()
    if direct or not all(alternatives):
        raise ValueError(f"selector {selector!r} is not complete")
    return tuple(map(tuple, alternatives))


class Tree(HTMLParser):
    """Elements in the order in which they open; element i holds elements i + 1 to ends[i] and pieces of text first[i] to last[i]."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.ends: list[int] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.pieces: list[str] = []
        self.raw: list[bool] = []
        self._open: list[int] = []
        self.feed(page)
        self.close()
        self._shut(0)

    def _shut(self, at: int) -> None:
        for i in self._open[at:]:
            self.ends[i], self.last[i] = len(self.tags), len(self.pieces)
        del self._open[at:]

    def _end(self, tag: str) -> None:
        for at in range(len(self._open) - 1, -1, -1):
            if self.tags[self._open[at]] == tag:
                self._shut(at)
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end("p")
        if tag in ENDS_SAME and self._open and self.tags[self._open[-1]] == tag:
            self._end(tag)
        i = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})  # the first of a name counts
        self.parent.append(self._open[-1] if self._open else -1)
        self.first.append(len(self.pieces))
        self.ends.append(i + 1)
        self.last.append(len(self.pieces))
        if tag not in VOID:
            self._open.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        self.pieces.append(data)
        self.raw.append(bool(self._open) and self.tags[self._open[-1]] in RAW)

    def text(self, i: int) -> str:
        """An element's text, without that of scripts and styles in it; theirs only if it is one."""
        own = self.tags[i] in RAW
        return "".join(p for p, raw in zip(self.pieces[self.first[i] : self.last[i]], self.raw[self.first[i] : self.last[i]], strict=True) if own or not raw)

    def matches(self, i: int, run: tuple[Compound, ...]) -> bool:
        if not run[-1].fits(self.tags[i], self.attrs[i]):
            return False
        if len(run) == 1:
            return True
        up, rest = self.parent[i], run[:-1]
        while up >= 0:
            if self.matches(up, rest):
                return True
            if run[-1].direct:
                return False
            up = self.parent[up]
        return False

    def select(self, selector: str, within: int | None = None) -> Iterator[int]:
        """Elements in their order, all or those below one."""
        runs = compiled(selector)
        span = range(len(self.tags)) if within is None else range(within + 1, self.ends[within])
        return (i for i in span if any(self.matches(i, run) for run in runs))

    def hidden(self) -> set[str]:
        """Classes in the selector of any style rule that speaks of display and none."""
        found: set[str] = set()
        for i in self.select("style"):
            for rule in self.text(i).split("}"):
                if "display" in rule and "none" in rule:
                    found |= {t[1:] for t in re.split(r"[,\s]+", (["", *rule.split("{")])[-2]) if len(t) > 1 and t[0] == "."}
        return found
