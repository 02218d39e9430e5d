"""Problem 10: sentence units of texts in any script, as code point offsets.

A text falls into blocks at blank lines and at line ends that are no soft wraps (headings,
labels, list items).  Within a block a pushdown automaton reads brackets, quotations and
terminators: a terminator ends the unit only on an empty stack, or where the closed
quotation or bracket ends its sentence; tries of abbreviations, read backwards from a
period, tell it from a full stop.  Scripts without spaces end at their own terminators,
Thai at the spaces between Thai letters.  A narrow map: texts are never shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Abbreviations after which a capital or a number goes on in the same sentence.
TITLES = "mr mrs ms dr prof sr sra srta st m mm mme hr fr gen col capt lt sgt rep sen gov hon rev messrs ing lic dra د डॉ श्री"
# Abbreviations that go on whatever follows.
ALWAYS = "e.g i.e vs cf viz z. b z.b d. h d.h u. a u.a p. ex p.ex p. ej p.ej vgl bzw ca approx aprox env al inkl exkl zzgl sog usw. u bspw"
# Abbreviations that go on before a number (or a one-letter reference).
BEFORE_NUMBER = "no nos nr fig figs eq eqs sec secs art arts p pp pg vol ch par para abs núm num nº pág págs s bd ziff rs ص पृ रु jan feb mar apr jun jul aug sep sept oct nov dec tel ext approx"
# German units after which a capital goes on.
BEFORE_CAPITAL = "mio mrd tsd std abs"
# Words that follow a German ordinal.
AFTER_ORDINAL = "januar februar märz april mai juni juli august september oktober november dezember quartal halbjahr jahrhundert jahrestag mal januar, kapitel stock platz tag woche monat"

_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "“": "”", "«": "»", "„": "“", "‹": "›"}
_CLOSERS = set(_PAIRS.values()) | {'"'}
_QUOTES = set("“«„「『\"‹")
_STOPS = ".!?…。！？｡؟।॥።"
_WIDE = set("。！？｡")
_EVENT = re.compile(r"[.!?…。！？｡؟।॥።]+|[()\[\]{}（）［］「」『』《》〈〉【】“”«»„‹›\"]|[฀-๿][^\S\n]+(?=[฀-๿])")
_ITEM = re.compile(r"\s*(?:[-*•–·▪]\s|\(?[A-Za-z0-9]{1,3}[.)]\s|\([A-Za-z0-9]{1,3}\)\s)")
_WORD = re.compile(r"\S+")
_SAID_ZH = re.compile(r"^[^。！？“”\n]{0,40}?(?:问道|表示|说|称|指出|回答)[。！？，,]")
MIN_WRAP = 40
# Company suffixes written with a period.
SUFFIXES = "inc corp ltd co bros s.a n.v a.g l.l.c s.p.a jr sr"
_SPLIT_ABBREVIATION = re.compile(r"[A-Za-z]\.\s?(?:[A-Za-z]|ex|ej)\.")


def _trie(words: str, phrases: tuple = ()) -> dict:
    """Reversed-character trie; a node with key '' ends an abbreviation."""
    root: dict = {}
    for w in (*words.split(), *phrases):
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node[""] = {}
    return root


_PHRASES = ("z. b", "d. h", "u. a", "p. ex", "p. ej", "u. u", "i. e", "e. g")
_ONE_WORD = " ".join(w for w in ALWAYS.split() if len(w) > 1)
_T_TITLE, _T_ALWAYS = _trie(TITLES), _trie(_ONE_WORD, _PHRASES)
_T_NUMBER, _T_CAPITAL = _trie(BEFORE_NUMBER), _trie(BEFORE_CAPITAL)
_T_SUFFIX = _trie(SUFFIXES)
_ORDINAL = frozenset(AFTER_ORDINAL.replace(",", "").split())


def _ends_with(trie: dict, low: str, at: int) -> bool:
    """Whether an abbreviation of the trie ends before index ``at``, at a word start."""
    node, i = trie, at - 1
    while i >= 0 and low[i] in node:
        node = node[low[i]]
        if "" in node and (i == 0 or not (low[i - 1].isalnum() or low[i - 1] in ".'’")):
            return True
        i -= 1
    return False


def _blocks(text: str) -> list[tuple[int, int]]:
    """Spans between hard line ends.  A line end is soft if the next line goes on with its
    sentence because its first word did not fit into the width the text is wrapped at."""
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+", text)]
    lines = [(a, b) for a, b in lines if text[a:b].strip()]
    if not lines:
        return []
    width = max(len(text[a:b].rstrip()) for a, b in lines)
    out = [list(lines[0])]
    for (a, b), (c, d) in zip(lines, lines[1:]):
        prev, nxt = text[a:b].rstrip(), text[c:d]
        first = _WORD.search(nxt).group()
        soft = text.count("\n", b, c) == 1 and width >= MIN_WRAP and len(prev) + 1 + len(first) > width
        soft = soft and not _ITEM.match(nxt)
        if soft:
            out[-1][1] = d
        else:
            out.append([c, d])
    return [(a, b) for a, b in out]


def _match_pairs(text: str, a: int, b: int) -> dict[int, int]:
    """Opening to closing index of balanced brackets and quotations in a block; others are none."""
    stack: list[tuple[str, int]] = []
    pairs: dict[int, int] = {}
    for m in re.finditer(r"[()\[\]{}（）［］「」『』《》〈〉【】“”«»„‹›\"]", text[a:b]):
        c, i = m.group(), a + m.start()
        want = [k for k, (close, _) in enumerate(stack) if close == c]
        if want:
            k = want[-1]
            pairs[stack[k][1]] = i
            del stack[k:]
        elif c == '"':
            stack.append(('"', i))
        elif c in _PAIRS:
            stack.append((_PAIRS[c], i))
    return pairs


def _next(text: str, i: int, b: int) -> tuple[int, str]:
    """Index and character of the next non-space in the block ('' at its end)."""
    while i < b and text[i].isspace():
        i += 1
    return i, text[i] if i < b else ""


def _goes_on(text: str, i: int, b: int) -> bool:
    """Whether what starts at ``i`` continues a sentence: lower case (brand names aside) or a comma."""
    c = text[i]
    if c in ",;:،؛、，；：–—-" and not _ITEM.match(text[i : i + 4]):
        return True
    return c.islower() and not (i + 1 < b and text[i + 1].isupper())


def _is_period_end(text: str, low: str, a: int, start: int, i: int, b: int) -> bool:
    """Whether the single period at ``i`` ends a sentence; ``start`` is where the unit began."""
    j, c = _next(text, i + 1, b)
    if not c:
        return True
    glued = j == i + 1
    before = text[i - 1] if i > a else " "
    if glued:
        if c in _CLOSERS:
            return True
        nxt = text[j + 1] if j + 1 < b else " "
        if not (c.isupper() and (nxt.islower() or nxt == " ")) or before.isspace():
            return ord(c) > 0x2E7F and before.islower() and not _ends_with(_T_SUFFIX, low, i)
        token = text[max(text.rfind(" ", a, i), text.rfind("\n", a, i), a - 1) + 1 : i]
        if "@" in token or "/" in token or _ends_with(_T_TITLE, low, i):
            return False
        # sentences without a space between them; initials as in J.Smith are none
        return len(token) > 1 and not (before.isupper() and len(token) < 3)
    if _goes_on(text, j, b) or c in _STOPS:
        return False
    if _ends_with(_T_SUFFIX, low, i):
        if c in "$€£¥" or (c.isalpha() and not (c.isupper() or c.islower())):
            return False
        if c == "(":
            close = text.find(")", j, b)
            return close > 0 and text[close - 1] in _STOPS
    if _SPLIT_ABBREVIATION.match(text, i - 1, b) and (i < 2 or not text[i - 2].isalnum()) and before.islower():
        return False
    line = max(text.rfind("\n", a, i) + 1, a)
    head = text[line:i].strip(" (")
    if line >= start and (head.isdigit() or (len(head) == 1 and head.isalpha())) and text[start:i].strip(" (") == head:
        return False  # a list number
    if _ends_with(_T_ALWAYS, low, i) or _ends_with(_T_TITLE, low, i):
        return False
    if c.isdigit() or (c.isupper() and (j + 1 >= b or not text[j + 1].isalpha()) and c not in "IA"):
        if _ends_with(_T_NUMBER, low, i):
            return False
    if c.isupper() and _ends_with(_T_CAPITAL, low, i):
        return False
    if before.isupper() and (i - 2 < a or not (text[i - 2].isalnum() or text[i - 2] in ".&'’")):
        # an initial before a name; a lone letter after a number or at the end of a phrase is rare
        word = _WORD.search(text, j)
        return not (c.isupper() and word is not None)
    if before.isdigit() and c.isupper():
        k = i - 1
        while k >= a and text[k].isdigit():
            k -= 1
        word = re.match(r"\w+", text[j:b])
        if i - 1 - k <= 2 and (k < a or text[k].isspace()) and word and word.group().lower() in _ORDINAL:
            return False
    return True


def _after_close(text: str, start: int, opened: int, i: int, b: int) -> bool:
    """Whether a closed quotation or bracket, whose text ended in a terminator, ends its unit."""
    j, c = _next(text, i + 1, b)
    if not c:
        return True
    alone = text[start:opened].strip() == ""
    quote = text[opened] in _QUOTES
    if c in _STOPS or c in _CLOSERS and c not in _QUOTES:
        return False
    if _goes_on(text, j, b) or "぀" <= c <= "ゟ":
        return False
    if not quote:
        return alone
    if j == i + 1:  # scripts without spaces: a quotation at the start may have its speaker after it
        return not (alone and (_SAID_ZH.match(text[j:b]) or text[opened] == '"'))
    return True


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of each unit, trimmed, in order; white space alone has none."""
    out: list[tuple[int, int]] = []
    low = text.lower() if len(text.lower()) == len(text) else text

    def emit(s: int, e: int) -> None:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            out.append((s, e))

    for a, b in _blocks(text):
        pairs = _match_pairs(text, a, b)
        start, pos = a, a
        stack: list[tuple[int, int]] = []  # (opening, closing)
        while True:
            m = _EVENT.search(text, pos, b)
            if not m:
                break
            i, c = m.start(), m.group()
            pos = m.end()
            if c[0] in _STOPS:
                if stack:
                    continue
                end = pos
                nxt = text[end] if end < b else ""
                if c == ".":
                    if not _is_period_end(text, low, a, start, i, b):
                        continue
                elif set(c) & _WIDE:
                    pass
                else:
                    j, d = _next(text, end, b)
                    dots = set(c) <= {".", "…"}
                    if d and _goes_on(text, j, b):
                        continue
                    if nxt and not nxt.isspace() and nxt not in _CLOSERS and not (nxt.isupper() or ord(nxt) > 0x2E7F or nxt in "“«„¿¡(「"):
                        if not (dots and ord(nxt) > 0x0590):
                            continue
                    if dots and nxt and not nxt.isspace() and nxt.isupper() and i > a and text[i - 1].isspace():
                        continue
                while end < b and text[end] in _CLOSERS and end not in pairs and end not in pairs.values():
                    end += 1
                emit(start, end)
                start = pos = end
            elif "฀" <= c[0] <= "๿":
                if not stack:
                    emit(start, i + 1)
                    start = pos
            elif i in pairs:
                stack.append((i, pairs[i]))
            elif stack and stack[-1][1] == i:
                opened, _ = stack.pop()
                k = i - 1
                while k > opened and (text[k].isspace() or text[k] in _CLOSERS):
                    k -= 1
                if not stack and text[k] in _STOPS and not (text[k] == "." and _abbreviated(low, k)) and _after_close(text, start, opened, i, b):
                    emit(start, pos)
                    start = pos
        emit(start, b)
    return out


def _abbreviated(low: str, k: int) -> bool:
    return _ends_with(_T_ALWAYS, low, k) or _ends_with(_T_NUMBER, low, k) or _ends_with(_T_TITLE, low, k)


def sentences(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, start_char, end_char)`` of every unit.

    Null, empty and blank texts give no rows; repeated rows give repeated units.
    """

    def run(it):
        for batch in it:
            who, starts, ends = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                for s, e in sentence_spans(t):
                    who.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["k", "start_char", "end_char"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, start_char long, end_char long").withColumnRenamed("k", key)
