"""Blocks of a web page in order, with tag-path and hashed-word vectors.

A small scanner keeps the stack of open tags and closes what HTML closes implicitly. Block-level
tags cut blocks, inline ones don't. What is no text at all (head, scripts, styles, comments,
controls) is never a block.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from zlib import crc32

import numpy as np

PATH, WORDS, NUMBERS = 64, 32, 8
WIDTH = PATH + WORDS + NUMBERS
#: Element classes of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg canvas iframe object select textarea button datalist audio video title head".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-z]+|\d+")


@lru_cache(20_000)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def _unit(word: str, size: int) -> tuple[int, float]:
    h = crc32(word.encode())
    return (h >> 1) % size, 1.0 if h & 1 else -1.0


@lru_cache(20_000)
def _component(tag: str, attrs: str) -> np.ndarray:
    """The hashed vector of one step of a tag path: the tag, and the parts of class, id and role."""
    v = np.zeros(PATH, np.float32)
    i, s = _unit("<" + tag, PATH)
    v[i] += 2 * s
    for _, a, b, c in _ATTR.findall(attrs):
        for part in _PART.findall((a or b or c).lower()):
            for gram, weight in ((part, 1.5), *((part[j : j + 4], 0.3) for j in range(max(1, len(part) - 3)))):
                i, s = _unit("." + gram, PATH)
                v[i] += weight * s
    return v


class Block:
    __slots__ = ("text", "path", "linked", "depth", "tag")

    def __init__(self, text: str, path: np.ndarray, linked: int, depth: int, tag: str):
        self.text, self.path, self.linked, self.depth, self.tag = text, path, linked, depth, tag


def blocks(page: str | None) -> list[Block]:
    """All blocks with text, in page order."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, np.ndarray]] = [("", np.zeros(PATH, np.float32))]
    parts: list[str] = []
    linked, links, silent = 0, 0, 0
    at, n = 0, len(page)

    def text(s: str) -> None:
        nonlocal linked
        if silent or not s:
            return
        if "&" in s:
            s = html.unescape(s)
        parts.append(s)
        if links:
            linked += len(s)

    def cut() -> None:
        nonlocal linked
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                level = len(stack) - 1
                while level > 0 and stack[level][0] in INLINE:
                    level -= 1
                out.append(Block(joined, stack[level][1], linked, level, stack[level][0]))
            parts.clear()
        linked = 0

    def close(level: int) -> None:
        nonlocal links, silent
        if any(t not in INLINE for t, _ in stack[level:]):
            cut()
        for t, _ in stack[level:]:
            links -= t == "a"
            silent -= t in SILENT
        del stack[level:]

    def find(tag: str, until: tuple[str, ...] = ()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                return i
            if stack[i][0] in until:
                return 0
        return 0

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if level := find(tag):
                close(level)
            elif tag not in INLINE:
                cut()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                cut()
            continue
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "body":
            if level := find("head"):
                close(level)
        if tag in CLOSES_P and (level := find("p", ("table", "td", "div", "article", "section", "li", "blockquote"))):
            close(level)
        if tag in SELF_CLOSING and (level := find(tag, SELF_CLOSING[tag])):
            close(level)
        if tag not in INLINE:
            cut()
        stack.append((tag, stack[-1][1] + _component(tag, m[3])))
        links += tag == "a"
        silent += tag in SILENT
    cut()
    return out


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """Rows of features, by block: tag path, hashed words, numbers."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return x
    x[:, :PATH] = np.stack([b.path for b in flat])
    x[:, :PATH] /= np.sqrt(1.0 + np.array([b.depth for b in flat], np.float32))[:, None]
    at = 0
    for p in pages:
        total = max(1, len(p))
        for i, b in enumerate(p):
            size = len(b.text)
            letters = b.text
            x[at, PATH + WORDS :] = (np.log1p(size) / 6, b.linked / size, i / total, letters.count(" ") / 60, (letters.count(".") + letters.count(",")) / 8, b.tag == "p", b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag == "li")
            at += 1
    from .textkit import mix, word_hashes

    encoded = [b.text.encode("utf-8", "replace") for b in flat]
    offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])])
    _, _, row, h = word_hashes(np.frombuffer(b"".join(encoded), np.uint8), offsets)
    h = mix(h, 0x3D)
    np.add.at(x, (row, PATH + (h % np.uint64(WORDS)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    words = np.maximum(np.bincount(row, minlength=len(flat)), 1)
    x[:, PATH : PATH + WORDS] = np.clip(x[:, PATH : PATH + WORDS] / np.sqrt(words)[:, None], -1.5, 1.5)
    x[:, PATH + WORDS :] = np.minimum(x[:, PATH + WORDS :], 2)
    return x
