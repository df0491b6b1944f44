"""Problem 3: sentence boundaries across languages and scripts.

Boundary rules are compiled into a :class:`Transducer`.  A text becomes a short
sequence of symbols: line kinds, quotation and bracket marks, and for each possible end
what stands before the stop (a plain word, a title, a word that is sometimes shortened,
a reference, an ordinal) and what follows it (a word that starts sentences, a number,
another shortened letter, any capital).  The transducer holds the block structure and the
open quotation, weighs what stands before an end against what follows, and says where a
unit starts or is cut.

Units: a sentence, a heading line, a list item line, a whole table, a whole fenced
code block, or a cut-off rest.  Offsets count Unicode characters, from 0, end
exclusive, white space around a unit left out.  NULL and blank texts have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transducer import Transducer

# --- rules stated as values --------------------------------------------------

#: Never end a sentence: titles, references, and the like before a name or number.
PREFIX = set(
    "dr. mr. mrs. ms. prof. rev. hon. gen. col. capt. lt. sgt. gov. sen. rep. pres. "
    "sr. sra. srta. dra. dr.ª dña. ud. uds. vd. mm. mme. mlle. me. mgr. hr. fr. frl. "
    "fig. figs. sec. secs. ch. chap. vol. vols. art. arts. eq. ed. eds. pp. pg. pág. págs. "
    "nr. nrn. núm. n.º no.s nos. abs. bd. kap. abb. tab. ziff. rdnr. st.-nr. tel. ext. "
    "ca. bzw. vgl. sog. ggf. inkl. exkl. evtl. z.b. d.h. u.a. "
    "e.g. i.e. cf. viz. vs. approx. est. incl. excl. resp. ex. ej. p.ex. p.ej. env. "
    "a.k.a. aka. κ. κα. κος. κ.κ. σελ. αρ. π.χ. δηλ. βλ. д. г. см. т. "
    "د. أ. م. أ.د. डॉ. श्री. सुश्री. पं. प्रो. सं. रु.".split()
)
#: May end a sentence, but only before a word that starts one.
SUFFIX = set(
    "etc. s.a. s.l. ph.d. m.d. b.a. m.a. d.phil. esq. jr. u.s. u.k. u.n. e.u. u.s.a. "
    "st. ave. blvd. rd. dept. al. jan. feb. mar. apr. jun. jul. aug. sep. sept. oct. nov. dec. "
    "mon. tue. tues. wed. thu. thur. thurs. fri. sat. sun. usw. ff. f. κ.λπ. κλπ. κ.ά.".split()
)
#: Letters with stops that are words: a sentence may end after them.
CLOCK = {"a.m.", "p.m."}
#: Before a number an abbreviation, else a word of its own.
NUMBERED = {"no.", "art.", "sec.", "fig.", "op."}
#: Function words that start sentences: articles, pronouns, question words, conjunctions, auxiliaries.
STARTERS = set(
    "the a an this that these those it its he she they we you i there here when where which what "
    "who whose why how if in on at by for from to with without after before each every no not all "
    "some many most any both either neither our your their his her my then once only please "
    "is are was were do does did can could should would may might must but and or so as while "
    "although however also "
    "der die das ein eine es er sie wir ihr ich am im in wann wo wer was wie ist sind nach vor bei "
    "le la les un une il elle nous vous ils elles ce cette ces quand où qui que quel quelle on "
    "el los las una uno ella ellos nosotros cuándo dónde quién qué quedan se no hay".split()
)
#: Words before a German ordinal ("am 6. März").
ORDINAL_BEFORE = set("am im vom zum beim bis ab seit der die das den dem des zur ins und".split())
#: Words after one.
ORDINAL_AFTER = set(
    "januar februar märz april mai juni juli august september oktober november dezember "
    "jänner quartal halbjahr jahrhundert kapitel absatz platz stock".split()
)
# -----------------------------------------------------------------------------

# Line symbols, then mark symbols.
RESET, BLANK, HEAD, FENCE_A, FENCE_B, ROW, BULLET, NUMBER, PLAIN, INDENT = range(10)
CURLY_O, CURLY_C, LOW_O, QUOTE, QUOTE_C, SINGLE_O, SINGLE_C = range(10, 17)
ANGLE_O, ANGLE_C, CORNER_O, CORNER_C, PAREN_O, PAREN_C = range(17, 23)
# A possible end: what stands before the stop, then what follows it.
AFTER_WORD, AFTER_TITLE, AFTER_SHORT, AFTER_REFERENCE, AFTER_ORDINAL = range(23, 28)
STARTER, DIGIT, LETTER, OTHER = range(28, 32)
PAD = 32
SYMBOLS = 33

# States: structure, and within a paragraph the outermost open mark.
GAP, IN_HEAD, IN_ITEM, IN_TABLE, IN_A, IN_B = range(6)
PARA, P_CURLY, P_LOW, P_QUOTE, P_SINGLE, P_ANGLE, P_CORNER, P_PAREN, P_PAREN2 = range(6, 15)
WEIGHED = range(15, 20)  # in a paragraph, after a stop: one state for each symbol of what stands before it
STATES = 20

#: After which words a sentence ends, by what follows.
ENDS = {
    AFTER_WORD: (STARTER, DIGIT, LETTER, OTHER),
    AFTER_TITLE: (),
    AFTER_SHORT: (STARTER,),
    AFTER_REFERENCE: (STARTER, LETTER, OTHER),
    AFTER_ORDINAL: (DIGIT,),
}

# Outputs.
START, STOP, CUT = 1, 2, 3


def _tables() -> Transducer:
    step = np.tile(np.arange(STATES)[:, None], (1, SYMBOLS))
    emit = np.zeros((STATES, SYMBOLS), np.int8)
    step[:, RESET], emit[:, RESET] = GAP, STOP
    paragraph = range(PARA, STATES)
    for s in range(STATES):
        if s in (IN_A, IN_B):
            continue
        step[s, BLANK], emit[s, BLANK] = GAP, STOP
        for symbol, to in ((HEAD, IN_HEAD), (FENCE_A, IN_A), (FENCE_B, IN_B), (BULLET, IN_ITEM)):
            step[s, symbol], emit[s, symbol] = to, START
        if s != IN_TABLE:
            step[s, ROW], emit[s, ROW] = IN_TABLE, START
        if s not in paragraph:  # within a paragraph "8. ..." is a wrapped line
            step[s, NUMBER], emit[s, NUMBER] = IN_ITEM, START
            step[s, PLAIN], emit[s, PLAIN] = PARA, START
            if s != IN_ITEM:
                step[s, INDENT], emit[s, INDENT] = PARA, START
    step[IN_A, FENCE_A] = step[IN_B, FENCE_B] = GAP
    for opens, inside, closes in (
        ((CURLY_O,), P_CURLY, (CURLY_C,)),
        ((LOW_O,), P_LOW, (CURLY_O, CURLY_C)),
        ((QUOTE,), P_QUOTE, (QUOTE, QUOTE_C)),
        ((SINGLE_O,), P_SINGLE, (SINGLE_C,)),
        ((ANGLE_O,), P_ANGLE, (ANGLE_C,)),
        ((CORNER_O,), P_CORNER, (CORNER_C,)),
        ((PAREN_O,), P_PAREN, (PAREN_C,)),
    ):
        for symbol in opens:
            step[PARA, symbol] = inside
        for symbol in closes:
            step[inside, symbol] = PARA
    step[P_PAREN, PAREN_O], step[P_PAREN2, PAREN_C] = P_PAREN2, P_PAREN
    for before, state in zip(ENDS, WEIGHED, strict=True):
        step[PARA, before] = state
        for follows in (STARTER, DIGIT, LETTER, OTHER):
            step[state, follows] = PARA
            emit[state, follows] = CUT if follows in ENDS[before] else 0
    return Transducer(step, emit, PAD)


MACHINE = _tables()

_LINE = re.compile(r"[^\r\n\u2028\u2029]*(?:\r\n|[\r\n\u2028\u2029]|\Z)")
_HEAD = re.compile(r"\s{0,3}#{1,6}\s+\S")
_BULLET = re.compile(r"\s*[-*+•‣◦▪]\s+\S")
_NUMBER = re.compile(r"\s*\d{1,3}[.)]\s+\S")
_MARK = re.compile(r"[\"“”„«»‹›「」『』《》〈〉【】()\[\]（）]|(?<!\S)['‘](?=\w)|(?<=\S)['’](?!\w)")
_KIND = {
    "“": CURLY_O, "”": CURLY_C, "„": LOW_O, "«": ANGLE_O, "‹": ANGLE_O, "»": ANGLE_C, "›": ANGLE_C,
    **dict.fromkeys("「『《〈【", CORNER_O), **dict.fromkeys("」』》〉】", CORNER_C),
    **dict.fromkeys("([（", PAREN_O), **dict.fromkeys(")]）", PAREN_C),
}
_CLOSERS = r"\"'”’»›)\]}」』）】》〉“*_~`"
_OPENERS = r"\"'“„‘«‹「『(（\[{*_~`¿¡【《〈"
_STOP = re.compile(
    r"([.!?…؟۔।॥。！？｡]+|(?<=[Ͱ-Ͽἀ-῿]);)"  # stops
    rf"((?:[{_CLOSERS}]|[ \u00a0\u202f][»›])*)"  # closing marks
    rf"(\s*)([{_OPENERS}]*)(\S?)"  # white space, opening marks, what follows
)
_THAI = re.compile(r"(?<=[ก-ฮะ-ๅ็-๎])\s+(?=[ก-ฮะ-ไ])")
_THAI_SCRIPT = re.compile(r"[\u0e00-\u0e7f]")
_CAMEL = re.compile(r"[a-zà-ÿ]{1,5}[A-Z]")
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")  # U.S. and the like
_LEADING = _OPENERS.replace("\\", "")
_SHORTENED = {
    **dict.fromkeys(SUFFIX, AFTER_SHORT), **dict.fromkeys(PREFIX, AFTER_TITLE),
    **dict.fromkeys(NUMBERED, AFTER_REFERENCE), **dict.fromkeys(CLOCK, AFTER_WORD),
}
_LINE_MARKS = frozenset("#-*+•‣◦▪0123456789")
_NEXT = re.compile(r"[\w.'’]+")
_SAID = re.compile(r"[\d\w.!?,…。！？*_)]")


def _ORDER(e: tuple[int, int, int]) -> tuple[int, int]:
    """By place; a possible end after any mark at its place, and what stands before it first."""
    return e[0], max(e[1], AFTER_WORD - 1)



_WIDE = "。！？｡"


def _starts(text: str, at: int, closed: bool) -> bool:
    """May a sentence start with the character at ``at``?"""
    ch = text[at]
    if ch.isdigit() or ch.isupper() or ch.istitle():
        return True
    if ch.islower():
        return bool(_CAMEL.match(text, at))
    if ch.isalpha():  # a script without case: after a quotation the sentence goes on
        return not closed
    return ch not in "-–—,;:/&=+<>|)]}»”’…."


def _before(text: str, stop: int, nxt: int) -> int:
    """What stands before the full stop at ``stop``; ``nxt`` is where the text goes on."""
    near = text[max(0, stop - 40) : stop].rsplit(None, 1)
    if not near or text[stop - 1].isspace():
        return AFTER_WORD
    raw = near[-1].lstrip(_LEADING)
    known = _SHORTENED.get(raw.lower() + ".")
    if known is not None:
        return known
    if raw.isalpha():
        return AFTER_SHORT if len(raw) == 1 else AFTER_WORD
    if raw.isdigit():
        if len(raw) > 2:
            return AFTER_WORD
        w = _WORD.match(text, nxt)
        at = stop - len(near[-1])
        before = text[max(0, at - 30) : at].rsplit(None, 1)
        dated = before and before[-1].lower() in ORDINAL_BEFORE
        return AFTER_ORDINAL if dated or w and w.group().lower() in ORDINAL_AFTER else AFTER_WORD
    return AFTER_SHORT if _LETTERS.fullmatch(raw) else AFTER_WORD


def _after(text: str, at: int) -> int:
    """What follows a possible end."""
    m = _NEXT.match(text, at)
    if not m:
        return OTHER
    first = m.group()
    if first[0].isdigit():
        return DIGIT
    if text.startswith(".", m.end()) or first.endswith("."):
        return LETTER if len(first.rstrip(".")) == 1 else OTHER
    return STARTER if first.lower() in STARTERS else OTHER


def _ends(text: str) -> Iterator[tuple[int, int, int]]:
    """Places where a sentence may end (exclusive), what stands before and what follows."""
    for m in _STOP.finditer(text):
        t, closing, space, opening, first = m.groups()
        if not first and not opening:
            continue  # the end of the text
        end, closed = m.end(2), bool(closing) and bool(closing.strip("*_~`"))
        at = m.start(5) if first else m.start(4)
        if not space:
            if t[-1] in _WIDE and not closed:
                yield end, AFTER_WORD, OTHER
        elif _starts(text, at, closed):
            before = _before(text, m.start(), at) if t == "." and not closed else AFTER_WORD
            yield end, before, OTHER if before == AFTER_WORD else _after(text, at)
    if _THAI_SCRIPT.search(text):
        for m in _THAI.finditer(text):
            yield m.start(), AFTER_WORD, OTHER


def events(text: str) -> tuple[list[int], list[int]]:
    """Symbols of a text and their places, in order."""
    found: list[tuple[int, int, int]] = []
    bounds: list[int] = []
    for m in _LINE.finditer(text):
        line, at = m.group(), m.start()
        if at == m.end() and at == len(text):
            break
        body = line.strip()
        if not body:
            kind = BLANK
            bounds.append(at)
        elif body.startswith("```"):
            kind = FENCE_A
        elif body.startswith("~~~"):
            kind = FENCE_B
        elif body[0] == "|":
            kind = ROW
        elif not (body[0] in _LINE_MARKS or body[0].isdigit()):
            kind = INDENT if line[:2].isspace() else PLAIN
        elif _HEAD.match(line):
            kind = HEAD
        elif _BULLET.match(line):
            kind = BULLET
        elif _NUMBER.match(line):
            kind = NUMBER
        else:
            kind = INDENT if line[:2].isspace() else PLAIN
        found.append((2 * at, kind, at))
    bounds.append(len(text))
    marks: list[tuple[int, int]] = []
    for m in _MARK.finditer(text):
        ch, at = m.group(), m.start()
        if ch == '"':
            before, after = text[at - 1 : at], text[at + 1 : at + 2]
            opens = (not before or before.isspace() or before in "([{*_“„'‘—–-:") and not after.isspace()
            marks.append((QUOTE if opens or not _SAID.match(before) else QUOTE_C, at))
        elif ch in "'‘’":
            marks.append((SINGLE_C if at and not text[at - 1].isspace() else SINGLE_O, at))
        else:
            marks.append((_KIND[ch], at))
    # An apostrophe or bracket opens something only if it is closed in its paragraph: seen from the right, in one pass.
    closers, b = {SINGLE_O: -1, PAREN_O: -1}, len(bounds) - 1
    for kind, at in reversed(marks):
        while b and bounds[b - 1] > at:
            b -= 1
        if kind in (SINGLE_C, PAREN_C):
            closers[SINGLE_O if kind == SINGLE_C else PAREN_O] = at
        elif kind in closers and not at < closers[kind] < bounds[b]:
            continue
        found.append((2 * at + 1, kind, at))
    for end, before, after in _ends(text):
        found += ((2 * end - 1, before, end), (2 * end - 1, after, end))
    found.sort(key=_ORDER)
    return [e[1] for e in found], [e[2] for e in found]


def split_batch(texts: list[str | None], block: int = 256) -> list[list[tuple[int, int]]]:
    """Units of every text of a batch, by one run of the transducer."""
    symbols: list[int] = []
    places: list[int] = []
    owners: list[int] = []
    for i, text in enumerate(texts):
        if text and not text.isspace():
            s, p = events(text)
            symbols += [RESET, *s]
            places += [0, *p]
            owners += [i] * (len(s) + 1)
    actions = MACHINE.run(np.array(symbols, np.int16), GAP, block)
    units: list[list[tuple[int, int]]] = [[] for _ in texts]
    hit = np.nonzero(actions)[0]
    opened, owner = -1, -1

    def close(end: int) -> None:
        if opened >= 0:
            text = texts[owner]
            piece = text[opened:end]
            body = piece.strip()
            if body:
                start = opened + len(piece) - len(piece.lstrip())
                units[owner].append((start, start + len(body)))

    for k in hit.tolist():
        action, place = actions[k], places[k]
        if owners[k] != owner:
            if owner >= 0:
                close(len(texts[owner]))
            owner, opened = owners[k], -1
            if symbols[k] == RESET:
                continue
        close(place)
        opened = -1 if action == STOP else place
    if owner >= 0:
        close(len(texts[owner]))
    return units


def split_text(text: str | None, block: int = 256) -> list[tuple[int, int]]:
    return split_batch([text], block)[0]


def sentence_units(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id, start_char, end_char`` of every unit of every row.

    NULL and blank texts give no rows. Other columns of ``df`` are ignored, so
    clashing names do no harm; repeated rows give repeated units.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = split_batch(pdf["t"].tolist())
            counts = [len(u) for u in units]
            flat = np.array([x for u in units for x in u], np.int32).reshape(-1, 2)
            yield pd.DataFrame(
                {
                    "record_id": pdf["record_id"].repeat(counts).to_numpy(),
                    "start_char": flat[:, 0],
                    "end_char": flat[:, 1],
                }
            )

    rows = df.select(F.col(record_id).cast("string").alias("record_id"), F.col(text).alias("t"))
    rows = rows.where(F.col("t").isNotNull())
    return rows.mapInPandas(run, "record_id string, start_char int, end_char int")
