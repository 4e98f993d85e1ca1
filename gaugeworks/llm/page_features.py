"""Content and link features of a page, from what its author contributed.

A page is the text of a change. Contributed are its message and its added lines, or every
line where the text is no change. Lines are read without list marks and comment signs,
zero-width characters and letters set apart by spaces.
"""

from __future__ import annotations

import re
from collections import Counter

NAMES = (
    "chars", "lines", "link_share", "reference_share", "tag_share", "product_share", "repeat_share", "hidden_share", "phrase_share",
    "listed_share", "code_share", "data_share", "prose_share", "short_share", "distinct_words", "top_words_share", "links_per_line", "words_per_link", "odd_chars",
)
#: Kinds of lines whose words count as topics of the page.
STUFFING = ("link", "tag", "product", "repeat", "hidden", "listed")

_HEADER = re.compile(r"^(?:diff --git |Index: |diff -|--- \S|\+\+\+ \S|@@ -)", re.M)
_META = re.compile(r"^(?:commit [0-9a-f]{7,40}\b|Author:|Date:|From:? |Subject: |r\d+ \||-{3,}$|={5,}$|[A-Z][a-z]+(?:-[a-z]+)+: |index [0-9a-f]+\.\.|new file mode|deleted file mode|similarity index|rename (?:from|to) |Binary files |GIT binary patch|\\ No newline)")
_SUBJECT = re.compile(r"^Subject:\s*(?:\[[^\]]*\]\s*)*")
_LEAD = re.compile(r"^(?:\s|//+|#+(?=\s)|--+(?=\s)|/\*+|\*+/?|<!--|%+(?=\s)|;+(?=\s)|[-*•+](?=\s)|\"\"\"|''')+")
ODD = re.compile("[​‌‍⁠﻿­]")
_SPACED = re.compile(r"\b\w(?: \w{1,3}){0,2} \w+\b")
LINK = re.compile(r"(?:h(?:tt|xx)ps?://|www\.)[^\s<>\"')\]]+")
_TAG = re.compile(r"#\w+")
_MARKUP = re.compile(r"<[^>]*>")
WORD = re.compile(r"[^\W\d_]+", re.U)
_PRICE = re.compile(r"\d+[.,]\d\d\b")
_CODE = re.compile(r"[={}]|\w\(|\)\.|->|::|\w_\w|[;({\[,:]$|[a-z][A-Z]")
_DATA = re.compile(r"\s*(?:[\[{\"'<].*[\]}\"'>,:]+|[^,\s]+(?:,[^,\s]*){2,}|[\w.\-/@]+\s*[:=]\s*\S+)\s*,?$")
_HARD = ("=", "{", "}", ")", "->", "::")
#: Links to the records of development: issues, commits, releases, packages, badges, mirrors.
_REFERENCE = re.compile(r"/(?:issues?|pull|merge_requests|commits?|compare|releases?|changelog|tags?|blob|tree|archive|browse|bugs?|show_bug|wiki|rfc|doc|docs|spec|api)(?:/|\b|$)|\.(?:tgz|gz|zip|whl|jar|git|svg|png|xsd|dtd|patch|diff)\b|[#/](?=\d*[a-f])[0-9a-f]{7,40}\b|\$\w", re.I)
_KEYED = re.compile(r"(?:[\w.\-]+\s*=\s*[\"']?|resolved\s+[\"']?|\[\d+\]:?\s+|[A-Z][\w-]*: )(?:https?://|[\"'])")
#: Function words that sentences repeat.
FUNCTION_WORDS = frozenset(
    "a an and are as at be been but by can do for from had has have he his i if in is it its no not of on only or our she so than that the their them then there they this to us was we were when which will with without you your "
    "aber auf aus bei das dem den der des die ein eine einen er es für ich im ist mit nach nicht sich sie sind und von vor war wird zu zum zur "
    "al como con de del el en eran es la las lo los más no para pero por que se sin su sus un una y "
    "au aux avec ce ces dans des du elle en est et il je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sont sur un une".split()
)
_PARTS = re.compile(r"\s[-|•·/]\s|[,;|•·]\s*")


def contributed(text: str) -> tuple[list[str], list[str], list[str]]:
    """(message lines, added lines, file header lines) of a change; all lines are message where there is no diff."""
    first = _HEADER.search(text)
    head = text if first is None else text[: first.start()]
    added, files = [], []
    for line in [] if first is None else text[first.start() :].splitlines():
        if line[:1] == "+":
            if line[:4] == "+++ ":
                files.append(line)
            else:
                added.append(line[1:])
        elif line[:7] in ("Index: ", "diff --"):
            files.append(line)
    message = []
    for line in head.splitlines():
        if line[:9] == "Subject: ":
            line = _SUBJECT.sub("", line)
        elif _META.match(line):
            continue
        message.append(line)
    return message, added, files


def kind(line: str) -> tuple[str, list[str]]:
    """What a stripped line is, and its words: link, reference, tag, product, repeat, hidden, phrase, listed, code, data, prose or short."""
    if "ttp" in line or "xxp" in line or "www." in line:
        links = LINK.findall(line)
        if links:
            rest = [w for w in WORD.findall(_MARKUP.sub(" ", LINK.sub(" ", line)).lower()) if w != "br"]
            # a remark of a sentence makes it an annotated entry
            if len(rest) <= 5 * len(links):
                return ("reference" if _KEYED.match(line) or _REFERENCE.search(links[0]) or all(_REFERENCE.search(x) for x in links[1:2] or links) else "link"), rest
            if _REFERENCE.search(links[0]):
                return "reference", rest
            line = LINK.sub(" ", line)
    hidden = "<" in line and ("display:none" in line or 'name="keywords"' in line)
    code = None if hidden else _CODE.search(line)
    if code and code[0] in _HARD and "#" not in line and "|" not in line:
        return ("data" if line[0] in "[{\"'<" else "code"), []
    words = WORD.findall(line.lower())
    n = len(words)
    if "#" in line and len(_TAG.findall(line)) >= max(3, line.count(" ") * 0.6):
        return "tag", words
    if line.count("|") >= 2 and line[0] != "|" and _PRICE.search(line):
        return "product", words
    if hidden:
        return "hidden", WORD.findall(_MARKUP.sub(" ", line.lower())) or words
    if n >= 6 and not (code and code[0] in _HARD):
        # a sentence repeats its function words, a stuffed line its few topics
        if len(set(words)) <= 0.66 * n:
            counts = sorted(Counter([w for w in words if len(w) > 1 and w not in FUNCTION_WORDS]).values(), reverse=True) or [0]
            if (n < 12 or counts[0] > 2) and sum(c for c in counts[:3] if c > 1) >= 0.38 * n or (n >= 12 and sum(c for c in counts[:8] if c > 1) >= 0.7 * n):
                return "repeat", words
    if code:
        return ("data" if _DATA.match(line) else "code"), words
    if n <= 4:
        return ("phrase" if n >= 2 and line[-1] not in ".!?:" else "short"), words
    if n <= 12 or "," in line or "|" in line:
        parts = _PARTS.split(line)
        if len(parts) >= 4 and n <= 3.5 * len(parts):
            return "listed", words
    if line[0] == "<" and len(WORD.findall(_MARKUP.sub(" ", line))) >= 6:
        return "prose", words
    return ("data" if line[0] in "[{<\"'0123456789" and _DATA.match(line) else "prose"), words


def features(text: str | None) -> list[float]:
    """Values of NAMES; all 0 for a null or empty text. Shares are of the characters in contributed lines."""
    message, added, _ = contributed(text or "")
    return line_features(message, added, len(ODD.findall(text)) if text and not text.isascii() else 0)


def line_features(message: list[str], added: list[str], odd: int) -> list[float]:
    """``features`` from the contributed lines and the number of zero-width characters in the text."""
    size: Counter = Counter()
    spam_words: Counter = Counter()
    lines = links = link_words = 0
    phrases: list[tuple[int, list[str]]] = []
    unended: list[tuple[int, list[str]]] = []
    for part in (message, added):
        for raw in part:
            if odd:
                raw = ODD.sub("", raw)
            line = _LEAD.sub("", raw).strip()
            if not line:
                continue
            lines += 1
            what, words = kind(line)
            n = len(line)
            size[what] += n
            if what in STUFFING:
                spam_words.update(words)
                if what == "link":
                    links += len(LINK.findall(line))
                    link_words += len(words)
            elif what == "prose" and len(words) <= 14 and line[-1] not in ".!?:":
                unended.append((n, words))
            elif what == "phrase":
                phrases.append((n, words))
                spam_words.update(words)
    total = sum(size.values())
    if not total:
        return [0.0] * len(NAMES)
    # a short line without an end is stuffed if it is made of the words that stuffed lines repeat
    topics = {w for w, c in spam_words.items() if c >= 3} if size["repeat"] else set()
    if topics:
        for n, words in unended:
            if sum(w in topics for w in words) >= 0.6 * len(words):
                size["prose"] -= n
                size["repeat"] += n
    # phrases count as repeated where their words come again and again
    counts = Counter(w for _, ws in phrases for w in ws)
    again = sum(n for n, ws in phrases if len(phrases) >= 6 and sum(counts[w] for w in ws) >= 0.12 * len(phrases) * len(ws))
    size["phrase"] -= again
    known = sum(spam_words.values())
    top = sum(c for _, c in spam_words.most_common(6)) / known if known else 0.0
    share = {k: size[k] / total for k in (*STUFFING, "reference", "phrase", "code", "data", "prose", "short")}
    return [
        float(total), float(lines), share["link"], share["reference"], share["tag"], share["product"], share["repeat"], share["hidden"], again / total,
        share["listed"], share["code"], share["data"], share["prose"], share["short"] + share["phrase"],
        len(spam_words) / known if known else 1.0, top, links / lines, link_words / links if links else 0.0, odd / total,
    ]
