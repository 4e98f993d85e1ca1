"""Weak labels of pages, from signals that are no features of the trees.

The trees see what kinds of lines a page has. The weak labels see the contributed text as
a whole: how far it compresses, how much of its words the commonest few take, how much of
it is inside links, how many of its words join sentences, and what kind of file it is in.
They are right most of the time only, and many pages get none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from gaugeworks.llm.page_features import FUNCTION_WORDS, LINK, ODD, WORD

SPAM, CLEAN = 1, 0

#: Files of data, settings, translations, releases and word lists.
_QUIET = re.compile(r"(?:change|history|news|release)[^/]*\.\w+|\.(?:json|csv|tsv|ya?ml|toml|lock|conf|cfg|ini|po|properties|xml|svg|sum)\b|fixtures?/|locales?/|(?:lock|block|deny|stop|word)", re.I)
_CITED = re.compile(r"^\s*\[\d+\]:?\s+(?:https?:|www\.)", re.M)
_SIGNS = re.compile(r"[{}()\[\];=\\+*&^%$<>_]")


def weak_label(message: list[str], added: list[str], files: list[str]) -> int | None:
    """SPAM, CLEAN or None for the contributed lines of a page and its file headers.

    Votes for spam: text that compresses well and repeats a few words without sentences,
    or many links, not numbered as references are, with hardly a sentence. Votes against: quiet files, lists of single
    words, sentences, program signs, varied or very short text. A page with votes of both
    kinds is spam unless the file or the word list speaks against it.
    """
    text = "\n".join((*message, *added))
    if not text.strip():
        return None
    raw = text.encode("utf-8", "replace")
    ratio = len(zlib.compress(raw, 6)) / len(raw)
    found = LINK.findall(text)
    linked = sum(map(len, found)) / len(text)
    rest = LINK.sub(" ", text if text.isascii() else ODD.sub("", text))
    counts = Counter(WORD.findall(rest.lower()))
    n = sum(counts.values())
    joining = sum(c for w, c in counts.items() if len(w) > 1 and w in FUNCTION_WORDS) / max(n, 1)
    top = sorted((c for w, c in counts.items() if len(w) > 1 and w not in FUNCTION_WORDS), reverse=True)[:5]
    common = sum(top) / max(n, 1)
    signs = len(_SIGNS.findall(rest)) / max(len(rest), 1)

    lines = [len(s.split()) for s in added if s.strip()] or [len(s.split()) for s in message if s.strip()]
    word_list = len(lines) >= 8 and sorted(lines)[len(lines) // 2] <= 3 and linked <= 0.05 and signs < 0.03
    quiet = bool(files) and all(map(_QUIET.search, files))
    if quiet or word_list:
        return CLEAN
    repeats = n >= 30 and ratio <= 0.42 and joining <= 0.08 and common >= 0.33 and signs <= 0.06 and linked <= 0.1
    links = linked >= 0.25 and len(found) >= 6 and joining <= 0.2 and 2 * len(_CITED.findall(text)) < len(found)
    if repeats or links:
        return SPAM
    sentences = (joining >= 0.12 and linked <= 0.2 and ratio >= 0.4) or (joining >= 0.2 and linked <= 0.5)
    program = signs >= 0.05 and linked <= 0.05 and ratio >= 0.3
    varied = (common <= 0.3 and linked <= 0.05) or (ratio >= 0.5 and linked <= 0.3)
    short = len(found) < 3 and (n < 15 or (n < 50 and common <= 0.6))
    return CLEAN if sentences or program or varied or short else None
