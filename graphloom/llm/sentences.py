"""Sentence units of texts in any language and script.

A pushdown automaton runs over the marks of a paragraph: sentence terminators, quotation marks, brackets,
list markers, and the spaces of scripts that end sentences with a space. Its stack holds the list levels and, above
them, the open quotations and brackets; inside the latter nothing ends. A full stop is judged by a trie of abbreviations, read backwards from
the stop, and by what follows it.

* A blank line ends a unit, whatever is open; a single line break ends nothing, but for headings.
* A heading on a line of its own is told by its form: a short line without a terminator, after the end of a unit
  and before a line that begins a sentence, which is in capitals, numbered after a word such as chapter, or
  begins with a capital and stops although the next word had room beside it, by the lines of its paragraph. The
  first line of a text may be the rest of a wrapped one, so there the room says nothing.
* Speech and the words that introduce or follow it in the same sentence are one unit.
* A paragraph that begins inside a quotation (its first mark closes one) is taken up inside it; one that ends
  inside stays open to its end. An opening mark that is never closed within a paragraph that goes on is void; at
  the end of a text it holds, however far, when it stands where one opens and none like it opens after it.
* A stop after a list marker ends nothing. A marker counts when it begins a unit and is the first of its kind (1, a, i,
  2.1), which opens a level, or follows in number on an open level, which closes those above. Levels outlive paragraphs.
* Thai, Lao, Khmer, Burmese and Tibetan letters: a space ends a unit, unless it stands next to a number or
  between speech and the words that go with it.

Offsets are code points, 0-based, half-open, without white space at the ends. Defined cases: null, empty and
blank texts give no unit; a text without any terminator is one unit; repeated rows of a chunk give its units
once; a null chunk_id keeps its units under null; a text costs a fixed number of passes, however long and whatever is
left open in it; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations whose stop never ends a sentence, those whose stop ends none before a number,
# and those whose stop may end one.
NEVER = (
    "mr mrs ms mx messrs dr drs prof capt cpt lt sgt st mt ft sra sr srta dra ud uds vd vds mm mme mmes mlle mlles mgr hr "
    "ver vers approx ca i.e e.g z.b d.h u.a o.ä bzw vgl cf vs viz ibid डॉ श्री प्रो พ.ศ ค.ศ ดร น.ส"
).split()
NUMBERED = (
    "no nos nr n.º núm vol vols p pp pg pag pág s abs art bd kap ed eds ch chap sec fig figs op tel str av bd "
    "jan feb mar apr jun jul aug sept sep oct nov dec min h"
).split()
MAY = "jr snr esq etc co inc ltd corp bros a.m p.m am pm ph.d m.d b.a m.a u.s u.k usw etw".split()
# German months and the words before a date, for ordinals such as "am 3. Mai".
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner feber".split())
BEFORE_DATE = set("am vom zum bis dem den der des im ab seit".split())

CLOSERS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "‘": "’", "‚": "‘’", "(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "〔": "〕", "《": "》", "〈": "〉"}
BRACKETS = set("([{（【〔《〈")
ALL_CLOSING = set("”»›」』)]}）】〕》〉")
WIDE = set("。！？｡؟۔।॥")
DASHES = "—–―"

_MARK = re.compile(r"""(?P<stop>[.!?…。！？｡؟۔।॥]+)|(?P<mark>["'“”„«»‹›「」『』‘’‚()\[\]{}（）【】〔〕《》〈〉])|(?P<space>\s+)""")
_NO_SPACE = re.compile(_MARK.pattern.replace(r"|(?P<space>\s+)", "|(?P<space>(?!))"))  # for texts without such scripts
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_SPACED = re.compile(r"[฀-๿຀-໿ༀ-࿿က-႟ក-៿]")
_ATTRIBUTION = re.compile(r"[^。！？“”]{1,14}(?:问|問|说|說|道|喊|答|叫|曰)[。！]")
_HEADING = re.compile(r"(?mi)^[ \t]*(?:part|chapter|chapitre|cap[ií]tulo|kapitel|teil|partie|parte|บทที่|अध्याय|第)[ \t]*[\w]{1,6}[ \t]*[章部節节回]?(?:[ \t]*:[^\n.!?]{1,60})?[ \t]*\n")
# Words that a numbered heading begins with, those that are headings by themselves, and those that
# stay small in titles.
_NUMBERED = set("part chapter chapitre capítulo capitulo kapitel teil partie parte book section act scene letter บทที่ अध्याय".split())
_ALONE = set("prologue epilogue introduction preface foreword afterword contents appendix prolog epilog vorwort nachwort einleitung anhang préface introducción prólogo epílogo".split())
_SMALL = set("a an the of and or in on at to for by from with de la le les des du et el los las y der die das und von zu im am".split())
_WORD = re.compile(r"[^\W_][\w'’-]*")
HEADING_LENGTH = 80
# A list marker before its stop: numbers, small Roman numerals, or one small letter.
_ITEM = re.compile(r"\(?(?:((?:\d{1,3}\.)*)(\d{1,3})|([ivxl]{1,7})|([a-z]))\Z")
_LETTERED = re.compile(r"([ivxl]{1,7}|[a-z])\.\s+(?=[^\W\d_a-z])")
#: Passes over a paragraph that look for marks that are never closed; a void one may bring another to light.
PASSES = 3


def _is_heading(line: str, before: str | None, after: str, width: int) -> bool:
    """Whether a line is a heading by its form; ``before`` is None where no line of the text has anything before it,
    ``width`` that of the longest other line of its paragraph."""
    words = _WORD.findall(line)
    if not words or len(line) > HEADING_LENGTH or line[-1] in ".!?…,;:、，；：-" or line[-1] in WIDE or line[-1] in DASHES:
        return False
    if line[0] in DASHES or any(c in line for c in "\"“”„«»「」『』"):
        return False
    if before and not (before[-1] in ".!?…" or before[-1] in WIDE or before[-1] in ALL_CLOSING or before[-1] in "\"'’“"):
        return False
    if not after or after[0].islower() or after[0] in ",;:，；：、)]}":
        return False
    if not words[0][0].isupper() and words[0].lower() not in _NUMBERED:
        return False
    small = [w for w in words[1:-1] if w.lower() in _SMALL]
    titled = sum(w[0].isupper() or w[0].isdigit() for w in words) + sum(w.islower() for w in small) == len(words)
    if words[0].lower() in _NUMBERED and len(words) > 1:
        numbered = words[1][0].isdigit() or words[1].isupper()
        apart = re.match(r"\W*\w+\s+[\w'’-]+\s*[.:–—-]\s", line)
        return titled or (numbered and (len(words) == 2 or bool(apart))) or bool(apart and words[1][0].isupper())
    if line.isupper() and sum(c.isalpha() for c in line) > 3:
        return True
    if len(words) == 1 and words[0].lower() in _ALONE:
        return True
    if before is None or "." in line or len(line) + 1 + len(after.split(None, 1)[0]) > width:
        return False
    return titled or len(line) * 2 <= width


def _headings(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines that are headings, with the line break."""
    found = {(m.start(), m.end()) for m in _HEADING.finditer(text) if not text[m.end() : m.end() + 1].islower()}
    lines, at = text.split("\n"), 0
    bare = [line.strip() for line in lines]
    part = [0] * len(lines)  # the number of each line's paragraph
    widths: dict[int, list[int]] = {}  # the two greatest lengths of a paragraph's lines
    for i, line in enumerate(bare):
        part[i] = part[i - 1] + (not line) if i else 0
        # A line with a word that no line has room for tells nothing of the width.
        length = len(line) if len(max(line.split(), key=len, default="")) <= HEADING_LENGTH // 2 else 0
        widths[part[i]] = sorted([*widths.get(part[i], [0, 0]), length])[-2:]
    for i, line in enumerate(lines[:-1]):
        if 0 < len(bare[i]) <= HEADING_LENGTH:
            second, first = widths[part[i]]
            width = second if len(bare[i]) == first else first
            if _is_heading(bare[i], bare[i - 1] if text[:at].strip() else None, bare[i + 1], width):
                found.add((at, at + len(line) + 1))
        at += len(line) + 1
    return sorted(found)


def abbreviation_trie() -> dict:
    """Letters from last to first; the key "" holds what the stop can be."""
    root: dict = {}
    for words, kind in ((MAY, "may"), (NUMBERED, "numbered"), (NEVER, "never")):
        for word in words:
            node = root
            for letter in reversed(word):
                node = node.setdefault(letter, {})
            node[""] = kind
    return root


_TRIE = abbreviation_trie()


def abbreviation(text: str, stop: int) -> str:
    """The kind of the abbreviation before the stop at ``stop``: never, numbered, may, or "" for none."""
    node, at, found = _TRIE, stop - 1, ""
    while at >= 0:
        node = node.get(text[at].lower())
        if node is None:
            break
        if "" in node and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == ".")):
            found = node[""]
        at -= 1
    return found


def _skip(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


def _roman(text: str) -> int:
    values = [{"i": 1, "v": 5, "x": 10, "l": 50}[c] for c in text]
    return sum(-v if v < after else v for v, after in zip(values, [*values[1:], 0], strict=True))


def _kinds(marker: re.Match) -> list[tuple[str, int]]:
    """What a list marker may be: kinds of list, with its number in each."""
    above, number, roman, letter = marker.groups()
    kinds = [(f"{above}1", int(number))] if number else []
    if letter or (roman and len(roman) == 1):
        kinds.append(("a", ord(letter or roman) - ord("a") + 1))
    if roman:
        kinds.append(("i", _roman(roman)))
    return kinds


class _Run:
    """The automaton over one paragraph ``text[begin:end]``. The stack holds (what closes it, where it was opened) for
    marks, and below them (kind, number) for list levels."""

    def __init__(self, text: str, begin: int, end: int, first: bool, void: frozenset[int], levels: tuple = ()) -> None:
        self.text, self.begin, self.end, self.void = text, begin, end, void
        self.stack: list[tuple[str, int]] = list(levels)
        self.depth = 0  # marks on the stack
        self.unit = _skip(text, begin, end)
        self.intro = False  # the outermost open quotation has words of its unit before it
        self.edge = False  # that quotation was open before the text began
        self.units: list[tuple[int, int]] = []
        if first:
            self._take_up()

    @property
    def levels(self) -> tuple:
        return tuple(self.stack[: len(self.stack) - self.depth])

    def _push(self, closers: str, at: int) -> None:
        self.stack.append((closers, at))
        self.depth += 1

    def _close(self, mark: str) -> int | None:
        """Closes the nearest mark that ``mark`` fits, and those above it, which were never closed; gives where it was
        opened when none is open any more."""
        for up in range(1, self.depth + 1):
            closers, opened = self.stack[-up]
            if mark in closers:
                del self.stack[-up:]
                self.depth -= up
                return None if self.depth else opened
        return None

    def _take_up(self) -> None:
        """At the start of a text: inside a quotation when the first mark of one closes it."""
        for m in _NO_SPACE.finditer(self.text, self.begin, self.end):
            mark = m["mark"]
            if not mark or mark in "()[]{}（）【】〔〕《》〈〉" or m.start() in self.void:
                continue
            kind = self._kind(m.start(), mark, "", False)
            if kind == "open":
                return
            if kind == "close":
                self._push(mark, -1)
                self.edge = True
                return

    def _kind(self, at: int, mark: str, top: str, inside: bool) -> str:
        """Whether a mark opens, closes or is neither, by what would close the top of the stack, whether any mark is
        open, and what stands around it."""
        text = self.text
        before = text[at - 1] if at > self.begin else " "
        after = text[at + 1] if at + 1 < self.end else " "
        if mark in "'’‘":
            if mark in top and not after.isalnum() and (mark != "'" or before in ".!?,…;:"):
                return "close"
            if mark == "’":
                return "none"
            if mark == "‘":
                return "open"
            if (before.isspace() or before in "(“\"—") and (after.isalnum() or after in "¡¿"):
                return "open"
            return "close" if not inside and before in ".!?,…" and not after.isalnum() else "none"
        if mark in top:
            return "close"
        if mark == '"' or mark == "“":
            loose = before.isspace() or before in "([{—–-:：，。"
            tight = after.isspace() or after in ",.;:!?)]}"
            if mark == "“" and loose:
                return "open"
            return "close" if tight and not loose else "open"
        return "open" if mark in CLOSERS else "close"

    def _cut(self, at: int) -> None:
        stop = at
        while stop > self.unit and self.text[stop - 1].isspace():
            stop -= 1
        if stop > self.unit:
            self.units.append((self.unit, stop))
        self.unit = _skip(self.text, at, self.end)
        self.edge = False

    def _goes_on(self, at: int) -> bool:
        """Whether the text from ``at`` (no white space) carries on the sentence before it."""
        text, end = self.text, self.end
        ch = text[at]
        if ch in DASHES:
            return text[_skip(text, at + 1, end) : end][:1].islower()
        return ch.islower() or ch in ",;:，；：、)]}"

    def _item(self, at: int) -> bool:
        """Whether a list marker stands between the start of the unit and the stop at ``at``; opens or moves its level."""
        found = _ITEM.match(self.text, self.unit, at) if at - self.unit <= 12 else None
        if not found:
            return False
        kinds = _kinds(found)
        for up in range(1, len(self.stack) + 1):  # no mark is open here: all are levels
            for kind, n in kinds:
                if self.stack[-up] == (kind, n - 1):
                    self.stack[-up:] = [(kind, n)]
                    return True
        for kind, n in kinds:
            if n == 1:
                self.stack.append((kind, n))
                return True
        return False

    def _next_item(self, at: int) -> bool:
        """Whether a marker in small letters stands at ``at`` that follows on an open level, or opens one below it."""
        found = _LETTERED.match(self.text, at, self.end) if self.stack else None
        return bool(found) and any(n == 1 or (kind, n - 1) in self.stack for kind, n in _kinds(_ITEM.match(found[1])))

    def _numbered(self, at: int) -> bool:
        """A number before the stop at ``at``: an ordinal of a date."""
        text = self.text
        start = at
        while start > self.unit and text[start - 1].isdigit():
            start -= 1
        if start == at:
            return False
        ahead = re.match(r"\s+([^\W\d_]+)", text[at + 1 : at + 40])
        if not ahead:
            return False
        before = re.search(r"([^\W\d_]+)\s+$", text[max(self.begin, start - 12) : start])
        dated = ahead[1].lower() in MONTHS
        return dated or bool(before and before[1].lower() in BEFORE_DATE and before[1].lower() in ("am", "vom", "zum"))

    def _stop(self, start: int, at: int, run: str) -> int:
        """A terminator run outside all quotations and brackets; gives the position to go on from."""
        text, end = self.text, self.end
        while at < end and (text[at] in ALL_CLOSING or (text[at] in "\"'’“" and self._kind(at, text[at], "", True) == "close")):
            at += 1
        if any(c in WIDE for c in run):
            nxt = _skip(text, at, end)
            if nxt < end and text[nxt] in ",，、；)）":
                return at
            self._cut(at)
            return at
        if at >= end:
            self._cut(end)
            return at
        if not text[at].isspace():
            # Glued to what follows: a lost space, or a script without spaces, after ! or ?.
            starts = text[at].isalpha() or text[at] in "¿¡«“„‚‘「『\"'(（" or text[at] in DASHES
            if run[-1] in "!?" and starts and not self._goes_on(at):
                self._cut(at)
            return at
        nxt = _skip(text, at, end)
        if nxt >= end or (self._goes_on(nxt) and not self._next_item(nxt)):
            return at
        if run == ".":
            if self._item(start):
                return at
            word = abbreviation(text, start)
            if word == "never" or (word == "numbered" and text[nxt].isdigit()):
                return at
            if word != "may":
                letter = text[start - 1] if start > self.unit else " "
                lone = start - 1 == self.unit or (start - 2 >= self.begin and not text[start - 2].isalnum())
                if letter.isalpha() and lone and (letter.islower() or letter.isupper()):
                    return at  # an initial
                if letter.isdigit() and self._numbered(start):
                    return at
            elif text[nxt].isdigit():
                return at
        elif run[0] == "…" or run.startswith(".."):
            if not text[nxt].isupper() and text[nxt].isalpha():
                return at
        self._cut(at)
        return at

    def _closed(self, mark_end: int, opened: int, bracket: bool) -> int:
        """The outermost quotation or bracket was closed; gives the position to go on from."""
        text, end = self.text, self.end
        inner = mark_end - 1
        while inner > self.unit and (text[inner - 1].isspace() or text[inner - 1] in ALL_CLOSING or text[inner - 1] in "\"'’“"):
            inner -= 1
        at = mark_end
        while at < end and text[at] in ALL_CLOSING:
            at += 1
        last = text[inner - 1] if inner > 0 else " "
        if last not in ".!?…" and last not in WIDE:
            return at
        nxt = _skip(text, at, end)
        if nxt >= end:
            return at
        ch = text[nxt]
        if bracket:
            if opened <= self.unit and not self._goes_on(nxt):
                self._cut(at)
            return at
        if self._goes_on(nxt) or ch in ".!?…" or ch in WIDE:
            return at
        if last == "." and inner >= 2 and abbreviation(text, inner - 1) == "never":
            return at
        opens = ch in "\"'" or (ch in CLOSERS and ch not in BRACKETS)
        caseless = ch.isalpha() and not (ch.isupper() or ch.istitle())
        if caseless and not opens:
            if ch == "と" or text.startswith("って", nxt):
                return at
            if self.edge:
                if _SPACED.match(ch) or nxt > at or _ATTRIBUTION.match(text, nxt, end):
                    return at
            elif not self.intro:
                return at
        elif nxt == at and not opens and not ch.isupper():
            return at
        self._cut(at)
        return at

    def _space(self, start: int, at: int) -> None:
        """White space outside quotations, in a script that ends sentences with it."""
        text = self.text
        if at >= self.end or start <= self.unit:
            return
        before, after = text[start - 1], text[at]
        opens = after in CLOSERS or after in "\"'"
        if not (_SPACED.match(after) or opens) or not _SPACED.search(text, max(self.unit, start - 40), start):
            return
        if before.isdigit() or after.isdigit() or before in ",:;" or "\n" in text[start:at]:
            return
        if before in ALL_CLOSING or before in "\"'’":
            if opens or self.intro:
                self._cut(at)
            return
        if before == "." and abbreviation(text, start - 1) in ("never", "numbered"):
            return
        if opens and text[max(self.unit, start - 3) : start] == "ว่า":
            return
        self._cut(at)

    def _mark(self, at: int, mark: str) -> tuple[str, int | None]:
        """Takes a mark: its kind, and for one that closes the outermost, where that was opened."""
        kind = self._kind(at, mark, self.stack[-1][0] if self.depth else "", self.depth > 0)
        if kind == "open":
            if not self.depth:
                self.intro = at > self.unit and any(c.isalnum() for c in self.text[self.unit : at])
                self.edge = False
            self._push(CLOSERS.get(mark, mark), at)
            return kind, None
        return kind, self._close(mark) if kind == "close" else None

    def unclosed(self) -> list[int]:
        """Where the marks stand that the paragraph leaves open, outermost first."""
        for m in _NO_SPACE.finditer(self.text, self.begin, self.end):
            if m["mark"] and m.start() not in self.void:
                kind = self._kind(m.start(), m["mark"], self.stack[-1][0] if self.depth else "", self.depth > 0)
                if kind == "open":
                    self._push(CLOSERS.get(m["mark"], m["mark"]), m.start())
                elif kind == "close":
                    self._close(m["mark"])
        return self.left()

    def left(self) -> list[int]:
        """Where the marks were opened that are on the stack."""
        return [at for _, at in self.stack[len(self.stack) - self.depth :] if at >= 0]

    def run(self) -> list[tuple[int, int]]:
        text, at = self.text, self.begin
        marks = _MARK if _SPACED.search(text, at, self.end) else _NO_SPACE
        while True:
            m = marks.search(text, at, self.end)
            if not m:
                break
            at = m.end()
            if m["stop"]:
                if not self.depth:
                    at = self._stop(m.start(), at, m["stop"])
            elif m["space"]:
                if not self.depth:
                    self._space(m.start(), at)
            elif m.start() not in self.void:
                _, opened = self._mark(m.start(), m["mark"])
                if opened is not None:
                    at = self._closed(at, opened, opened >= 0 and text[opened] in BRACKETS)
        self._cut(self.end)
        return self.units


_WORD_QUOTE = re.compile(r"(?<=[^\S\n])['‘](?=\w)")


def _held(text: str, begin: int, end: int, places: list[int]) -> int:
    """How many of the ``places`` of marks left open at the end of a text are void: those before the first that is one
    by what stands around it and what follows. It has to stand where a mark opens, and none like it may open after
    it; a single one, which may be an apostrophe, has to begin a sentence or follow words that introduce it."""
    again: dict[str, int] = {}  # the last place of each mark; a speech may open anew on each line
    for m in _NO_SPACE.finditer(text, begin, end):
        if m["mark"] and text[m.start() - 1 : m.start()] != "\n":
            again[m["mark"]] = m.start()
    single = max((m.start() for m in _WORD_QUOTE.finditer(text, begin, end)), default=-1)
    for i, at in enumerate(places):
        mark = text[at]
        glued = at > begin and text[at - 1].isalnum() and text[at - 1].isascii()
        later = single if mark in "'‘" else again.get(mark, -1)
        if glued or later > at or (mark in "\"“" and text[at + 1 : at + 2].isspace()):
            continue
        if mark in BRACKETS and at > begin and not text[at - 1].isspace() and mark in "([{":
            continue
        if mark in "'‘":
            back = at - 1
            while back >= begin and text[back].isspace():
                back -= 1
            if back >= begin and not (text[back] in ".!?…,:—–" or text[back] in WIDE or text[back] in ALL_CLOSING):
                continue
        return i
    return len(places)


def _paragraph(text: str, begin: int, end: int, first: bool, last: bool, levels: tuple) -> _Run:
    """The run over a paragraph, done. Most leave nothing open, and take one pass."""
    run = _Run(text, begin, end, first, frozenset(), levels)
    run.run()
    places, void = run.left(), frozenset()
    for _ in range(PASSES):
        if last and places:
            places = places[: _held(text, begin, end, places)]
        if not places:
            break
        void |= frozenset(places)
        places = _Run(text, begin, end, first, void).unclosed()
    if void:
        run = _Run(text, begin, end, first, void, levels)
        run.run()
    return run


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit, in order."""
    if not text:
        return []
    breaks = [(m.start(), m.end()) for m in _BLANK.finditer(text)]
    headings = _headings(text) if "\n" in text else []
    for start, end in headings:
        breaks += [(start, start), (end - 1, end)] if start else [(end - 1, end)]
    breaks.sort()
    parts, begin = [], 0
    for start, stop in breaks:
        if start >= begin:
            parts.append((begin, start))
            begin = stop
        else:
            begin = max(begin, stop)
    parts.append((begin, len(text)))
    parts = [(a, b) for a, b in parts if text[a:b].strip()]
    out: list[tuple[int, int]] = []
    whole = {(start, end - 1) for start, end in headings}
    levels: tuple = ()
    for i, (a, b) in enumerate(parts):
        if (a, b) in whole:  # one unit, whatever stands in it
            a = _skip(text, a, b)
            out.append((a, a + len(text[a:b].rstrip())))
            continue
        run = _paragraph(text, a, b, i == 0, i == len(parts) - 1, levels)
        levels = run.levels
        out.extend(run.units)
    return out


_UNITS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("char_start", T.IntegerType()),
        T.StructField("char_end", T.IntegerType()),
    ]
)


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(k, a, b) for k, t in zip(batch["chunk_id"], batch["text"], strict=True) for a, b in sentence_spans(t)]
        yield pd.DataFrame(rows, columns=_UNITS.names)


def sentences(chunks: DataFrame) -> DataFrame:
    """(chunk_id, char_start, char_end), distinct. One narrow pass; only offsets are shuffled."""
    rows = chunks.select("chunk_id", "text").where(F.length("text") > 0)
    return rows.mapInPandas(_units, _UNITS).distinct()
