"""Sentence boundaries across languages and scripts.

A pushdown automaton reads only the characters that can matter (terminators, quotes, brackets, dashes, blanks
next to Thai). Its stack holds the open quotations and brackets; nothing divides a unit while it is not empty.
Openers are paired before, so an unclosed one never swallows the rest of a paragraph. At depth zero a terminator
ends the unit unless the abbreviation trie or the context after it says otherwise.

Null or blank texts give no unit. A text without any terminator is one unit per paragraph. Nothing limits the
length of a text or a unit, and a text never leaves its row, so one task holds one Arrow batch of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that never end a sentence before another word: titles, prefixes, references.
_NEVER = """
dr prof mr mrs ms mx st mt ft hon rev fr gen col maj capt lt sgt gov sen rep pres supt messrs dipl ing
vs cf viz e.g i.e eg ie ca vgl bzw z.b d.h u.a o.ä s.o s.u evtl ggf inkl exkl hr hrn frl str nr bd abb abs anm
dra sra srta sres dna dn dña ud uds vd p.ej p.ex ex ej m mm mme mlle mgr me pr vve ee aprox
डॉ श्री प्रो पं सं कु क्र
""".split()
#: Abbreviations that do not end a sentence before a number.
_BEFORE_NUMBER = """
no nos nº sec secs fig figs art arts par para ch chap vol vols pp p pg pág págs num núm approx appx app eq ref
tab tbl ed edn lot jan feb mar apr jun jul aug sep sept oct nov dec kap kl ziff teil §
""".split()
#: Longer abbreviations that run on before a small letter; a word of up to three letters before a stop may be one too.
_BEFORE_LOWER = "corp bros dept univ assn assoc govt intl incl excl misc orig pron resp sing plur transl illus vols figs nums evtl zzgl sogen bspw inkl exkl".split()
#: Weekdays and time zones, which continue a time of day.
_AFTER_TIME = """
monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun est edt cst pst gmt utc cet
""".split()
#: Words that follow an ordinal number in German, and words that precede one.
_AFTER_ORDINAL = """
januar februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts
jahrtausend jahrestag geburtstag kapitel klasse auflage stock etage band teil bezirk armee weltkrieg
""".split()
_BEFORE_ORDINAL = "am im vom zum zur beim dem den des das der die ab bis seit".split()
#: Words before "Sr." and the like by which it is a title, not a name's suffix.
_TITLE_LEAD = "el la los las al del de y e o un una con por para señor".split()
#: Verbs and particles by which a Chinese or Japanese quotation at the start of a sentence runs on.
_CJK_SPEECH = regex.compile(r"[^。！？!?，、,\n]{0,14}?(?:说|說|道|问|問|答|喊|叫|写|寫|表示|宣布|回应)|(?:と|って|という)")

_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』",
         "〔": "〕", "«": "»", "‹": "›", "“": "”", "„": "“", "‚": "‘", "‘": "’"}
_CLOSE = set(_OPEN.values())
_EVENT = regex.compile(
    r"[.!?…。！？｡．۔؟।॥]+|[()\[\]{}（）［］【】《》〈〉「」『』〔〕«»‹›“”„‚‘’\"']|(?<=[฀-๿\d])[^\S\n]+(?=[฀-๿\d])"
    r"|(?<!\S)—(?=\S)|\n"
)
_BLANK_LINE = regex.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])[^\S\n\r]*(?:\r\n|[\n\r\x85 ])\s*| \s*")
_REFERENCE = regex.compile(r"(?:\[(?:\d{1,4}(?:[-–,;]\s?\d{1,4})*|[a-z]|note \d+|citation needed)\]|[¹²³⁰-⁹]+|[†‡*](?=\s|$))+")
_DASH_SPEECH = regex.compile(r"—(?=\S)[^—]*?\s—(?=\p{Ll})")
_TOKEN_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}.§]*")  # these read backwards from where they are put
_WORD_BEFORE = regex.compile(r"(?r)([\p{L}\p{M}]+)[\s\p{Z}]+")
_UNBROKEN_BEFORE = regex.compile(r"(?r)\S*")
_WORD_AFTER = regex.compile(r"[\p{L}\p{M}]+")
_HEADING, _BLANK_BEFORE = regex.compile(r"#{1,6}\s"), regex.compile(r"(?r)\s*")
_BULLET = regex.compile(r"[•▪‣◦·*–-]\s")
_MARKER = regex.compile(r"\(?(?:\d{1,3}(?:\.\d{1,3})*|\p{L}|[ivxIVX]{1,5})[.)]?$")
#: Characters from a unit's start within which a list marker may end.
_MARKER_ROOM = 64
_SPACE = regex.compile(r"\s*")
_THAI = regex.compile(r"[฀-๿]")
_FULL_STOPS = set("。！？｡।॥۔؟")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_NO_SPACE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")


class Trie:
    """Abbreviations by their characters from the last to the first."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for char in reversed(word):
                node = node.setdefault(char, {})
            node[""] = True

    def ends(self, token: str) -> bool:
        """Whether ``token`` as a whole is in the trie."""
        node = self.root
        for char in reversed(token):
            node = node.get(char)
            if node is None:
                return False
        return "" in node


_NEVER_TRIE, _NUMBER_TRIE, _LOWER_TRIE = Trie(_NEVER), Trie(_BEFORE_NUMBER), Trie(_BEFORE_LOWER)


class _Stack:
    """Open quotations and brackets. The places of each closer's openers are kept, so no scan is needed to find them."""

    def __init__(self) -> None:
        self.items: list[tuple[int, str]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, start: int, closer: str) -> None:
        self.places.setdefault(closer, []).append(len(self.items))
        self.items.append((start, closer))

    def last(self, *closers: str) -> int:
        """The uppermost place that waits for one of ``closers``; -1 if none does."""
        return max((self.places[c][-1] for c in closers if self.places.get(c)), default=-1)

    def close(self, place: int) -> int:
        """Where the opener at ``place`` is; it and all above it are taken off."""
        start = self.items[place][0]
        while len(self.items) > place:
            self.places[self.items.pop()[1]].pop()
        return start


def _pairs(text: str, events: list) -> dict[int, int]:
    """The matching closer of each opener that has one. A closer cuts off unclosed openers above its own."""
    stack = _Stack()
    pairs: dict[int, int] = {}
    size = len(text)
    for event in events:
        at = event.start()
        char = text[at]
        if char == "—":
            speech = _DASH_SPEECH.match(text, at)
            if speech and not stack.items:
                pairs[at] = speech.end() - 1
            continue
        if event.end() - at != 1 or char.isspace():
            continue
        before = text[at - 1] if at else " "
        after = text[at + 1] if at + 1 < size else " "
        opens = before.isspace() or before in _OPEN or before in "—–-/\"'，。！？：、:。"
        if char in "\"'’":
            twin = "'" if char != '"' else '"'
            held = stack.last(twin, "’") if char == "’" else stack.last(twin)
            if held >= 0 and not before.isspace() and not after.isalnum():
                pairs[stack.close(held)] = at
            elif char != "’" and opens and not after.isspace() and (char == '"' or after.isalnum() or after in "¿¡“"):
                stack.push(at, twin)
            elif char == '"' and held >= 0:
                pairs[stack.close(held)] = at
            continue
        if char in _CLOSE:
            held = stack.last(char, "“") if char == "”" else stack.last(char)
            if held >= 0 and not (char in "“‘" and before.isspace()):
                pairs[stack.close(held)] = at
                continue
        if char in _OPEN:
            stack.push(at, _OPEN[char])
    return pairs


def _runs_on(text: str, at: int, end: int, start: int, nxt: int, limit: int, token: str) -> bool:
    """Whether the stop at [at, end) does not end the unit begun at ``start``; the next word begins at ``nxt``, and
    ``token`` is the word, with its dots, before the stop."""
    stop = text[at:end]
    follow = text[nxt]
    skip = nxt
    while skip < limit and (text[skip] in _OPEN or text[skip] in "\"'¿¡—–"):
        skip += 1
    first = text[skip] if skip < limit else " "
    second = text[skip + 1] if skip + 1 < limit else " "
    lower = first.islower() and not second.isupper()
    spaced = nxt > end
    if stop[0] in _FULL_STOPS:
        return False
    if len(stop) > 1 or stop in "…!?":
        if stop[0] in "…." and set(stop) <= {"…", "."}:
            if _HAN.match(text[at - 1 : at]):
                return False
            return lower or not spaced and not first.isupper()
        return lower and len(text[start:at][:200].split()) < 3  # "Stop! he cried", but not a whole question
    if stop == "．":
        return first.isdigit()
    if not spaced:
        if not token or not (token[-1].isalpha() or token[-1].isdigit()) or "." in token:
            return True
        if follow in _OPEN and follow != "[" or follow in "\"¿¡":
            return first.islower() or not token.isalpha() or len(token) < 3
        if first.isupper() and (second.islower() or second.isspace()):
            whole = _UNBROKEN_BEFORE.match(text, start, at).group()
            if any(c in whole for c in "/@_"):
                return True
            if token.isdigit():
                return len(token) < 3 or not second.islower()
            return len(token) < 2 or not token[-1].islower() or _NEVER_TRIE.ends(token.lower())
        if first.isalpha() and not first.isupper() and not first.islower():
            return len(token) < 3 or _NEVER_TRIE.ends(token)
        return True
    if lower:  # a name may be written small at the start of a sentence; after an ordinary word the stop decides
        ordinary = token.isalpha() and len(token) > 3 or token.isdigit() and len(token) > 2
        return not ordinary or any(trie.ends(token.lower()) for trie in (_NEVER_TRIE, _NUMBER_TRIE, _LOWER_TRIE))
    if not token:
        return first.isdigit() and at > start and text[at - 1].isspace()
    word = token.lower().strip(".")
    lead = text[start:at].strip() if at - start <= _MARKER_ROOM else ""
    if _MARKER.fullmatch(lead) and (len(lead) <= 4 or lead[0].isdigit()):
        return True
    prior = _WORD_BEFORE.match(text, start, at - len(token))
    if "." in word:
        if word.replace(".", "") in ("am", "pm"):
            after = _WORD_AFTER.match(text, skip)
            return bool(after) and after.group().lower() in _AFTER_TIME
        return _NEVER_TRIE.ends(word) or first.isdigit() and word[0].isdigit()
    if regex.fullmatch(r"\p{L}\p{M}*", word):
        return True
    if word in ("sr", "jr"):
        return word == "sr" and (not prior or prior.group(1).lower() in _TITLE_LEAD or prior.group(1).islower())
    if _NEVER_TRIE.ends(word):
        return True
    if _NUMBER_TRIE.ends(word):
        return first.isdigit()
    if word.isdigit() and len(word) <= 3:
        after = _WORD_AFTER.match(text, skip)
        if after and after.group().lower() in _AFTER_ORDINAL:
            return True
        return bool(prior) and len(word) <= 2 and prior.group(1).lower() in _BEFORE_ORDINAL and first.isupper()
    return False


def _paragraph(text: str, lo: int, hi: int, units: list[tuple[int, int]]) -> None:
    """Append the units of ``text[lo:hi]``, a stretch without blank lines."""
    part = text[lo:hi]
    events = list(_EVENT.finditer(part))
    pairs = _pairs(part, events) if len(events) > 1 else {}
    size, start, skip_to = len(part), 0, 0
    token_end, token_start = -1, -1  # of the word before the last stop that was looked at

    def close(end: int) -> None:
        nonlocal start
        piece = part[start:end]
        left = start + len(piece) - len(piece.lstrip())
        right = start + len(piece.rstrip())
        if right > left:
            units.append((lo + left, lo + right))
        start = end

    for event in events:
        at, end = event.span()
        if at < skip_to:
            continue
        char = part[at]
        if char == "\n":
            nxt = _SPACE.match(part, end).end()
            head = _SPACE.match(part, start).end()
            if head >= at:
                continue
            if part[head] == "#" and _HEADING.match(part, head) and part.find("\n", head, at) < 0:
                close(at)
            elif _BULLET.match(part, nxt) and (_BULLET.match(part, head) or part[_BLANK_BEFORE.match(part, head, at).start() - 1] in ":;"):
                close(at)
            continue
        if char.isspace():
            if _SPACE.match(part, start).end() < at and (_THAI.match(part[at - 1]) or _THAI.match(part[end])) and _THAI.search(part, start, at):
                close(at)
            continue
        if at in pairs:
            shut = pairs[at]
            skip_to = shut + 1
            if part[shut] == "—" or char == "—":
                skip_to = shut + 1
                continue
            inner = part[at + 1 : shut].rstrip(" \t\n\r\xa0 \"'”’»」』)）")
            if not inner or inner[-1] not in ".!?…。！？｡।॥۔؟":
                continue
            end = shut + 1
            mark = _REFERENCE.match(part, end)
            if mark:
                end = skip_to = mark.end()
            nxt = _SPACE.match(part, end).end()
            if nxt >= size:
                continue
            fresh = _SPACE.match(part, start).end() >= at
            bracket = char in "([{（［【〔"
            follow = part[nxt]
            if bracket and not fresh:
                continue
            if _NO_SPACE.match(follow) or _HAN.search(inner[-3:]):
                if fresh and not bracket:
                    if _CJK_SPEECH.match(part, nxt):
                        continue
                elif not fresh and follow in "，、,。；;：:！？":
                    continue
                elif follow in "，、,。；;：:！？":
                    continue
                close(end)
                continue
            probe = nxt
            while probe < size and (part[probe] in _OPEN or part[probe] in "\"'¿¡—–"):
                probe += 1
            first, second = part[probe : probe + 1], part[probe + 1 : probe + 2]
            if not first or first.islower() and not second.isupper() or part[nxt] in ",;:.!?،؛—–-…" and probe == nxt:
                continue
            if nxt == end and not first.isupper():
                continue
            if inner[-1] == "." and inner.endswith(("ff.", "etc.", "usw.")) and not fresh:
                continue
            if first.isalpha() and not first.isupper() and not fresh and inner[-1] not in ".।۔":
                continue
            close(end)
            continue
        if char not in ".!?…。！？｡．۔؟।॥":
            continue
        while end < size and (part[end] in "”’»」』)）］】\"'" and end not in pairs) and not (part[end] in "\"'" and part[end + 1 : end + 2].isalnum()):
            end += 1
        mark = _REFERENCE.match(part, end)
        if mark:
            end = skip_to = mark.end()
        nxt = _SPACE.match(part, end).end()
        if nxt >= size:
            continue
        if mark and nxt == end:
            if not part[nxt].isupper():
                continue
        elif mark and not (part[nxt].islower() and not part[nxt + 1 : nxt + 2].isupper()):
            close(end)
            continue
        low = max(start, token_end)
        begin = _TOKEN_BEFORE.match(part, low, at).start()
        if begin == token_end and token_start >= start:
            begin = token_start  # it goes on over the last stop, which need not be read again
        token_end, token_start = at, begin
        if not _runs_on(part, at, event.end() if not mark else end, start, nxt, size, part[begin:at]):
            close(end)
            skip_to = max(skip_to, end)
    close(size)


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Offsets (in code points, end exclusive) of the sentence units of one text."""
    units: list[tuple[int, int]] = []
    if not text or text.isspace():
        return units
    lo = 0
    for blank in _BLANK_LINE.finditer(text):
        if blank.start() > lo:
            _paragraph(text, lo, blank.start(), units)
        lo = blank.end()
    if lo < len(text):
        _paragraph(text, lo, len(text), units)
    return units


def split_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per sentence unit: (id, sent_index, char_start, char_end, sentence).

    Rows are split where they lie, with no shuffle. Repeated rows give repeated units: drop copies before, as
    ``found`` does. Other columns of ``df`` are left out, so their names can't clash. An id may be null.
    """
    pruned = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = pruned.schema["id"].dataType.simpleString()

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, index, starts, ends, sentences = [], [], [], [], []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                for k, (a, b) in enumerate(sentence_spans(text if isinstance(text, str) else None)):
                    ids.append(key), index.append(k), starts.append(a), ends.append(b), sentences.append(text[a:b])
            yield pd.DataFrame({"id": ids, "sent_index": index, "char_start": starts, "char_end": ends, "sentence": sentences})

    out = pruned.where(F.trim("text") != "").mapInPandas(
        units, f"id {id_type}, sent_index int, char_start int, char_end int, sentence string"
    )
    return out.withColumnRenamed("id", id_col)


def latest_rows(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key: the value of the latest delivery, found with a partial aggregate before the shuffle."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(F.col(order), F.xxhash64(value))).alias(value))


def found(passages: DataFrame) -> DataFrame:
    """p6_found: (passage_id, char_start, char_end) of every sentence unit."""
    return split_sentences(latest_rows(passages, "passage_id", "text", "ingested_at"), "passage_id", "text").select(
        "passage_id", "char_start", "char_end"
    )
