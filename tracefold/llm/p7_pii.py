"""Problem 7: personal data in running text, found and replaced by typed surrogates.

Finding goes by shapes (e-mail, phone, numbers of documents), by an address grammar, and for
names by scored candidates: runs of capitalised words whose words are weighed as given names,
names learned from the tables of people and extractions, initials, titles, suffixes or everyday
words, together with the words around them. Wordings known from letters, notes, forms and mail
of four languages settle where a value that is typed carelessly begins and ends.

Replacing: every distinct value gets a keyed surrogate of its type that keeps gender, script,
case, format and order of parts, word by word, so that the same person is the same in any form
of the name; equal surrogates of different values are told apart over all values, so that
distinctness and coreference hold over the whole corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Collection, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.runtime import materialize, salted_join

# Wordings around names. A frame is (before, after); the name stands between.
NAME_FRAMES = [
    (r"\bthe patient, ", r", lives at "),
    (r"\bwith follow-up by ", r" at (?=\S+(?:@| ?[\[(]| at \S+ dot ))"),
    (r"\bwas created for ", r" on (?=[\dA-Z])"),
    (r"\bwas copied for ", r" during intake"),
    (r"\bRefunds for ", r" go to "),
    (r"\bThe form names ", r" (?:\(SSN|as the beneficiary)"),
    (r"\bcontact for the member: ", r", (?=[+(\d])"),
    (r"\bbelongs to ", r"; the card"),
    (r"\bidentified as ", r", born "),
    (r"\bPlease contact ", r" at (?=[+(\d])"),
    (r"\bllame a ", r" al (?=[+(\d])"),
    (r"\bpresentado por ", r" en recepción"),
    (r"\bSchreiben an ", r" kam ungeöffnet"),
    (r"\bwurde für ", r" hinterlegt"),
    (r"\brufen Sie ", r" unter (?=[+(\d])"),
    (r"\bprésenté par ", r" à l'accueil"),
    (r"\brappeler ", r" au (?=[+(\d])"),
    (r"\bAccording to the log, ", r" replied from "),
    (r"\bNacid[oa] el [\d./-]+, ", r" pide borrar"),
    (r"\bNé le [\d./-]+, ", r" demande la suppression"),
    (r"\bNée le [\d./-]+, ", r" demande la suppression"),
    (r"\b(?i:full name|alternate spelling|patient name|name of (?:member|patient))(?: \| |: | = | \.{2,} | - )", r"(?= \| |\n|$)"),
    (r"\bName: ", r"(?=;)"),
    (r"(?:^|\n)(?:Best(?: regards)?|Kind regards|Regards|Sincerely|Saludos|Viele Grüße|Cordialement),?\n", r"(?=\n|$)"),
]
# Wordings after a name that begins its sentence.
NAME_BEGINS = r" (?:was treated for |can be reached on |disputes the entry|vive ahora en |habite désormais )"
# Wordings before a name that ends its sentence.
NAME_ENDS = r"(?:\bthe one given by |\band ask for |\bFiled for |, attention )"
# Wordings around addresses.
ADDRESS_FRAMES = [
    (r"\bSend the corrected (?:[\w-]+ )+?to ", r", attention "),
    (r"\bgemeldet in ", r", erreichbar "),
    (r"\b(?i:(?:home|mailing|postal|street) address)(?: \| |: | = | \.{2,} | - )", r"(?= \| |\n|$)"),
    (r"\bAddress: ", r"(?=;|\n|$)"),
]
ADDRESS_ENDS = r"(?:\butility bill for |, lives at |\bwas mailed to |\bbilled to |\bvive ahora en |\bhabite désormais )"
#: Name, then address, then an e-mail address.
NAME_AND_ADDRESS = r"(?:\bEscribir a |\bÉcrire à )"
NAME_AND_ADDRESS_END = r", (?:o a|ou à) (?=\S+(?:@| ?[\[(]| at \S+ dot ))"

_AT, _DOT = r"(?:@| ?[\[(] ?(?i:at) ?[\])] ?)", r"(?:\.| ?[\[(] ?(?i:\.|dot) ?[\])] ?| (?i:dot) )"
EMAIL = re.compile(r"[\w.%+'-]+(?:" + _AT + r"[A-Za-z0-9-]+(?:" + _DOT + r"[A-Za-z0-9-]+)*" + _DOT + r"[A-Za-z]{2,}| (?i:at) [A-Za-z0-9-]+(?: (?i:dot) [A-Za-z0-9-]+)* (?i:dot) [A-Za-z]{2,})")
_EXTENSION = r"(?:,? ?(?:x|X|ext\.?|Ext\.?|extension) ?\d{1,6})"
PHONE = re.compile(r"(?<![\w+(./-])(?:\+ ?1[ .-]?|001[ .-]|1[ .-])?(?:\(\d{3}\) ?|\d{3}[ ./-])\d{3}[ .-]?\d{4}(?!\d)" + _EXTENSION + r"?|(?<![\w+(./-])\+1\d{10}(?!\d)")
BARE_PHONE = re.compile(r"(?:(?i:phone|tel\.?|telephone|direct|helpline|mobile|call(?: back)?|fax)(?: \| |: | = | \.{2,} | )|\b(?:at|al|au|unter|on|Nummer|member: [^\n,]+,) )((?:\+?1)?\d{10})(?!\d)")
SSN = re.compile(r"(?<![\w-])\d{3}([- .])\d{2}\1\d{4}(?![\w-])")
SSN_CUE = re.compile(r"\bSSN(?: \| |: | = | \.{2,} | )(\d{9})(?!\d)")
BUSINESS = re.compile(r"(?i:parcel|order|invoice|purchase|tracking|internal|reference|ref\.?|po|rechnung|factura|facture)\W+(?:(?i:number|no\.?|ref(?:erence)?|nr\.?|#)\W*)*$")
DOCUMENT = re.compile(r"\b(?i:passport|reisepass|pasaporte|passeport|driver'?s? licen[cs]e|licen[cs]e|DL)(?:[ -](?i:number|no\.?|nr\.?))?(?: \| |: | = | \.{2,} | )((?=[A-Z0-9 -]*\d{3})[A-Z]{0,2}\d[\d -]{5,11}\d)(?![\w-])")

TITLES = "mr mrs ms miss mx dr prof sir herr frau sr sra srta m mme mlle".split()
PARTICLES = "de del della di da du la le van von der den mc mac ter ten".split()
_INITIAL_END = re.compile(r"(?:^|[\s.,;-])(?:[^\W\d_]|(?i:mr|mrs|ms|mx|dr|prof|jr|sr|snr|jnr|st|sra|srta|hr|fr|mme|mlle|co|inc|ltd|bros)|(?!(?:May|June|July)$)[A-ZÀ-Ü][^\W\d_]{1,3})$")
_ABBREVIATED = re.compile(r"(?:^|[\s.,;#-])(?:[nsew]|av|ave|st|str|rd|dr|ln|crt?|ct|pl|sq|terr?|blvd|boulv?|hwy|pkwy|pky|cl|c|r|rte|bd|avda|apt|apart|ste|stn|p|o|b|box|unit|no|nº|mt|ft|[^\W\d_]+str)$", re.I)
_OPENS = re.compile(r"\s+(?!(?i:apartment|apt|suite|ste|unit)\b)(?:[A-ZÀ-Ü¿¡]['’\w-]*\s+(?:[a-zà-ü\d]|CASE-|[A-Z][a-z]+ (?:the|der|die|das|el|le|la)\b)|(?:Between|For|In|On|From|Since|After|Before|Zwischen|Entre|Desde|Depuis|Seit) |\d\d?:\d\d )")
_STREETY = re.compile(r"\d|(?i:\b(?:p\.?o\.? ?box|pob|post office box|rue|calle|c/|cl\.|avenida|platz|weg|gasse|straße|strasse|apt|unit|suite)\b)")
_ADDRESS_START = re.compile(r"(?:#? ?\d|(?i:p\.? ?o\.? ?b|post office|apt|apart|unit|suite|ste\b|rue\b|calle\b|c/|cl\.|avenida|av\.|plaza|camino|[^\W\d_]+[ -]?(?:stra(?:ß|ss)e|str\.|weg|platz|gasse)|[A-Z]{2} \d{5}))")

_DIGIT = re.compile(r"\d")
#: Characters in front of a period that can tell an abbreviation.
TAIL = 40


def _end_of_sentence(text: str, start: int, inside: re.Pattern) -> int:
    """Where the value that begins at ``start`` and ends its sentence stops: at a period that is not one of its own."""
    stop = text.find("\n", start)
    limit = len(text) if stop < 0 else stop
    bar = text.find(" | ", start, limit)
    if bar >= 0:
        limit = bar
    number = _DIGIT.search(text, start, limit)
    i = start
    while True:
        i = text.find(".", i, limit)
        if i < 0:
            return limit
        if i + 1 == limit or not text[i + 1 : limit].strip():
            return i
        if text[i + 1].isspace():
            if inside is _ABBREVIATED and (number is None or number.start() >= i):
                i += 1
                continue  # no address without a number
            if not inside.search(text[max(start, i - TAIL) : i]):
                return i
            if _OPENS.match(text, i + 1, limit):
                return i
        elif text[i + 1] == "." and (i + 2 == limit or text[i + 2].isspace()):
            return i + 1
        i += 1


_BREAK = re.compile(r"\n+| \| |\b\d\d?:\d\d |(?:^|(?<=\s))[a-z]+\d*: |[.!?]+[\"”)]?\s+")


def _begin_of_sentence(text: str, end: int, breaks: list[re.Match]) -> int:
    """Where the sentence begins whose first words, a name, end at ``end``. ``breaks``: all matches of _BREAK in the text."""
    for m in reversed(breaks[: bisect_right(breaks, end, key=lambda m: m.end())]):
        if m.group()[0] in ".!?" and m.group().count(".") < 2 and _INITIAL_END.search(text[max(0, m.start() - TAIL) : m.start()]) and "\n" not in m.group():
            continue
        return m.end()
    return 0


def _frame(before: str, after: str) -> tuple[str, re.Pattern, re.Pattern]:
    """A literal that the text must hold, and the patterns before and after the value."""
    literal = re.match(r"(?:\\b)?([\w' ,:]*)", before)[1]
    return literal, re.compile(before), re.compile(after)


_NAMES = [_frame(a, b) for a, b in NAME_FRAMES]
_ADDRESSES = [_frame(a, b) for a, b in ADDRESS_FRAMES]


def _framed(frames: list, text: str, stops: list[int]) -> Iterator[tuple[int, int]]:
    """What stands in a frame on one line and in one cell; of several beginnings the last before the end counts. ``stops``: where lines and cells end. Linear in the text, whatever the length of a value."""
    for literal, before, after in frames:
        if literal in text:
            begins = [m.end() for m in before.finditer(text)]
            if not begins:
                continue
            ends = [m.start() for m in after.finditer(text)]
            last = -1
            for e in ends:
                k = bisect_left(begins, e) - 1  # something must stand between
                if k < 0 or begins[k] <= last:
                    continue
                a = begins[k]
                last = a
                if bisect_left(stops, a) == bisect_left(stops, e):
                    yield a, e


_BEGINS, _ENDS, _ADDRESS_ENDS = re.compile(NAME_BEGINS), re.compile(NAME_ENDS), re.compile(ADDRESS_ENDS)
_BOTH = [_frame(NAME_AND_ADDRESS, NAME_AND_ADDRESS_END)]
#: Name, then address: around both, with `` at ``, `` moved to `` and `` lautet `` between them.
_LETTER, _MOVED, _OF = [_frame(r"\bThe letter to ", r" came back ")], [_frame(r" moved to ", r" and asked for ")], [_frame(r"\bAnschrift von ", r" lautet ")]
_NOT_NAME = re.compile(r"[@\d]")


def _trim(text: str, a: int, b: int, ends: str) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in ends):
        b -= 1
    return a, b


_SUFFIX = re.compile(r"(?i)^(?:jr|sr|junior|senior|ii|iii|co|company|inc|incorporated|ltd|limited|llc|gmbh|sa|corp)\.?$")
# Common given names, which also tell the gender of a surrogate.
FEMALE = set("mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley emily donna michelle carol amanda melissa deborah stephanie rebecca laura sharon cynthia kathleen amy angela anna pamela emma nicole helen samantha katherine christine rachel carolyn janet catherine maria heather diane ruth julie olivia joyce virginia victoria lauren christina joan evelyn judith andrea hannah alice jane claire sophie marie elena ingrid greta ursula petra carmen lucía inés amina fatima priya mei".split())
MALE = set("james robert john michael david william richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george timothy ronald edward jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory frank alexander raymond patrick jack dennis jerry tyler aaron jose henry adam peter nathan zachary walter kyle harold carl luke noah hugo diego pavel omar yusuf hans jürgen björn andré josé".split())
# Words beside names, how much they tell, and capitalised words that are none.
BEFORE_NAME = {
    3.0: "dear attn attention patient customer client employee member claimant tenant resident applicant beneficiary insured colleague nurse doctor manager attorney name named names signed guardian spouse wife husband son daughter mother father brother sister friend estimada estimado sehr geehrte geehrter herr herrn frau madame monsieur señor señora don doña llame pregunte".split(),
    1.0: "by with for to from and that told asked spoke met saw contact contacted call called reach notify notified thank thanks of about regarding belongs por para con de a von für mit an bei par pour avec sincerely regards".split(),
}
AFTER_NAME = set("lives lived called calls said says wrote writes was is has had can will would works worked moved asked asks born replied reported reports requested requests confirmed complained signed paid visited and who whose told wants wanted vive llamó pidió nació wohnt wurde schrieb rief habite appelé demande".split())
NO_NAME = set("then later yesterday today tomorrow here there now also next however so yet ticket case the a an this that these those my our your his her their it its we you they he she i please no not all any in on at if when while after before since from between for to of and or but monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december dear hello hi best kind sincerely thanks regards street avenue road drive lane court place suite unit apt box north south east west subject date page total order invoice account number phone email address re fwd cc der die das ein eine el la los las un una le les des".split())
LEGAL = set("inc incorporated ltd limited llc co company corp corporation gmbh sa plc ag kg group partners brothers bros".split())

_CAPITAL = r"(?:\p{Lu}[\p{L}'’]*(?:-\p{L}[\p{L}'’]*)*\.?)"
_RUN = regex.compile(_CAPITAL + r"(?: (?:(?:van|von|de|del|della|di|da|du|la|le|der|den|ter|ten|zu|of|and|&) ){0,3}" + _CAPITAL + r")*")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BEFORE = re.compile(r"([^\W\d_]+)[.:]?[ \n\t|]*$")
_AFTER = re.compile(r"(?:'s)? ?,? ?([^\W\d_]+)")
#: Points that a candidate needs to be a name.
NAME_LEAST = 3.0


def _plain(word: str) -> str:
    return word.lower().rstrip(".")


def _points(word: str, known: Collection[str], common: Collection[str]) -> float:
    """How much a word speaks for a name."""
    w = _plain(word)
    parts = w.split("-")
    if len(w) == 1:
        return 0.5
    if w in TITLES:
        return 3.0
    if _SUFFIX.match(word):
        return 1.5
    if any(x in FEMALE or x in MALE for x in parts):
        return 2.0
    if w in known or all(x in known for x in parts):
        return 1.5
    return -2.0 if w in common else 0.4


def candidates(text: str, known: Collection[str] = (), common: Collection[str] = ()) -> Iterator[tuple[int, int, float]]:
    """Runs of capitalised words with the points for a name: those of the words and of what stands beside. ``known``: words that the tables use in names, ``common``: words that texts use otherwise; both in lower case."""
    for run in _RUN.finditer(text):
        words = [(run.start() + m.start(), run.start() + m.end()) for m in regex.finditer(r"[^ ]+", run.group())]
        piece: list[tuple[int, int]] = []
        pieces = []
        for a, b in words:
            w = _plain(text[a:b])
            if w in NO_NAME and w not in known or w in BEFORE_NAME[3.0] and w not in TITLES or w in common and w not in known and w not in LEGAL and w not in PARTICLES:
                pieces.append(piece)
                piece = []
                continue
            piece.append((a, b))
            if text[b - 1] == "." and len(w) > 1 and w not in TITLES and not _SUFFIX.match(w) and w not in LEGAL:
                pieces.append(piece)  # a sentence ends here
                piece = []
        for piece in [*pieces, piece]:
            while piece and (_plain(text[slice(*piece[-1])]) in PARTICLES or text[slice(*piece[-1])] in ("&", "and", "of")):
                piece = piece[:-1]
            if not piece:
                continue
            a, b = piece[0][0], piece[-1][1]
            tail = text[slice(*piece[-1])]
            if tail.endswith(".") and len(tail) > 2 and not _SUFFIX.match(tail):
                b -= 1
            total = sum(_points(text[x:y], known, common) for x, y in piece)
            full = [x for x in piece if len(_plain(text[slice(*x)])) > 1 and _plain(text[slice(*x)]) not in TITLES]
            before, after = _BEFORE.search(text[max(0, a - TAIL) : a]), _AFTER.match(text, b)
            cue = next((p for p, ws in BEFORE_NAME.items() if before and before[1].lower() in ws), 0.0)
            if cue == 3.0 and len(piece) == 1 and total < 1.5:
                cue = 1.0
            total += cue + (1.0 if after and after[1] in AFTER_NAME else 0.0)
            if _plain(text[slice(*piece[-1])]) in LEGAL and len(piece) > 1:
                total += 2.5
            if full and (len(piece) > 1 or cue == 3.0):
                yield a, b, total


# Types of streets, and how addresses are written.
_TYPE = r"(?:Street|St|Avenue|Ave|Av|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Crt|Place|Pl|Square|Sq|Terrace|Terr?|Boulevard|Blvd|Boul|Highway|Hwy|Parkway|Pkwy|Way|Circle|Cir|Trail|Trl|Alley|Aly)"
_UNIT_PART = r"(?:(?:,? ?)(?:(?:Apartment|Apart|Apt|Unit|Suite|Ste|Floor|Fl)\b\.? ?#?|#) ?[A-Za-z]?\d*[A-Za-z]?\b)"
_TOWN = r"(?:,? (?:[A-ZÀ-Ü][\w'’.-]*(?: [A-ZÀ-Ü][\w'’.-]*){0,2},? )?(?:[A-Z]{2}\b|[A-Z][a-z]+(?: [A-Z][a-z]+)?,?)(?:,? \d{5}(?:-\d{4})?)|,? (?:[A-ZÀ-Ü][\w'’-]+ ){1,3},? ?[A-Z]{2}\b|, [A-ZÀ-Ü][\w'’-]+(?: [A-ZÀ-Ü][\w'’-]+){0,2}|,? \d{5}(?: [A-ZÀ-Ü][\w'’-]+(?: [A-ZÀ-Ü][\w'’-]+)?)?)"
ADDRESS = re.compile(
    r"(?<![\w.-])(?:"
    r"(?:(?:Apt|Unit|Suite|#)\.? ?\w+,? )?\d+[A-Za-z]?(?:[-/]\d+)? (?:(?:[NSEW]\.?|North|South|East|West) )?(?:[A-ZÀ-Ü\d][\w'’-]*\.? )+?" + _TYPE + r"\b\.?" + _UNIT_PART + r"?" + _TOWN + r"?"
    r"|(?:P\.? ?O\.? ?Box|POB|Post Office Box) \d+" + _TOWN + r"?"
    r"|[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee) \d+[a-z]?(?:,? \d{5} [A-ZÄÖÜ][\wäöüß-]+(?: [A-ZÄÖÜ][\wäöüß-]+)?)?"
    r"|\d+(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin) (?:(?:de la|des|du|de|la|le|les|d['’]|l['’]) ?)?[A-ZÀ-Ü][\w'’-]*(?: [A-ZÀ-Ü][\w'’-]*)*(?:,? \d{5} [A-ZÀ-Ü][\w'’-]+)?"
    r"|(?:Calle|C/|Avenida|Plaza|Camino) ?(?:(?:de la|de los|del|de|la) )?[A-ZÀ-Ü][\w'’-]*(?: [A-ZÀ-Ü][\w'’-]*)*,? (?:n[ºo°]\.? ?)?\d+(?:,? (?:\d{5} )?[A-ZÀ-Ü][\w'’-]+(?: [A-ZÀ-Ü][\w'’-]+)?(?:,? \d{5})?)?"
    r")"
)


def find(text: str | None, known: Collection[str] = (), common: Collection[str] = ()) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) in code points, in order and free of overlaps; nothing for a null or empty text. ``known`` and ``common``: see :func:`candidates`."""
    if not text:
        return []
    spans: list[tuple[int, int, str, int]] = []  # the last number: the smaller wins

    def add(a: int, b: int, kind: str, order: int, ends: str = " ,;") -> None:
        a, b = _trim(text, a, b, ends)
        if b > a:
            spans.append((a, b, kind, order))

    def name(a: int, b: int) -> None:
        if not _NOT_NAME.search(text, a, b):
            add(a, b, "name", 4)

    def address(a: int, b: int) -> None:
        if _STREETY.search(text, a, b):
            add(a, b, "address", 3)

    for m in EMAIL.finditer(text):
        a = m.start()
        while text[a] in ".'-%+":
            a += 1
        add(a, m.end(), "email", 0)
    for m in SSN.finditer(text):
        if not BUSINESS.search(text[max(0, m.start() - 30) : m.start()]):
            add(m.start(), m.end(), "id_number", 1)
    for m in SSN_CUE.finditer(text):
        add(m.start(1), m.end(1), "id_number", 1)
    for m in DOCUMENT.finditer(text):
        add(m.start(1), m.end(1), "id_number", 1)
    for m in PHONE.finditer(text):
        if not BUSINESS.search(text[max(0, m.start() - 30) : m.start()]):
            add(m.start(), m.end(), "phone", 2)
    for m in BARE_PHONE.finditer(text):
        add(m.start(1), m.end(1), "phone", 2)
    stops = [m.start() for m in re.finditer(r"[\n|]", text)]
    for a, b in _framed(_NAMES, text, stops):
        name(a, b)
    breaks: list[re.Match] | None = None
    for m in _BEGINS.finditer(text):
        breaks = list(_BREAK.finditer(text)) if breaks is None else breaks
        a = _begin_of_sentence(text, m.start(), breaks)
        v = text[a : m.start()]
        born = re.search(r"\b[\d./-]{8,10}, ", v)
        a += born.end() if born else 0
        if v and not v.endswith((" be", " been", " was", " were", " and")):
            name(a, m.start())
    for m in _ENDS.finditer(text):
        name(m.end(), _end_of_sentence(text, m.end(), _INITIAL_END))
    for a, b in _framed(_ADDRESSES, text, stops):
        address(a, b)
    for m in _ADDRESS_ENDS.finditer(text):
        address(m.end(), _end_of_sentence(text, m.end(), _ABBREVIATED))
    for a, b in _framed(_LETTER, text, stops):
        at = text.find(" at ", a, b)
        if at >= 0:
            name(a, at)
            address(at + 4, b)
    for a, b in _framed(_MOVED, text, stops):
        if _end_of_sentence(text, a, _ABBREVIATED) < b:
            continue
        breaks = list(_BREAK.finditer(text)) if breaks is None else breaks
        end = text.rfind(" moved to", 0, a)
        name(_begin_of_sentence(text, end, breaks), end)
        address(a, b)
    for a, b in _framed(_OF, text, stops):
        name(a, b)
        address(b + len(" lautet "), _end_of_sentence(text, b + len(" lautet "), _ABBREVIATED))
    for a, b in _framed(_BOTH, text, stops):
        v = text[a:b]
        commas = list(re.finditer(r", ?", v))
        family_first = len([w for w in v.split(",")[0].split() if w.lower() not in PARTICLES]) == 1 and len(commas) > 1 and not _ADDRESS_START.match(v, commas[0].end())
        if commas:
            comma = commas[family_first]
            add(a, a + comma.start(), "name", 4)
            add(a + comma.end(), b, "address", 3)
    lines = text.split("\n", 2)
    if len(lines) > 1 and lines[0] and not re.search(r"[\d@:|\[]", lines[0]) and len(lines[0].split()) <= 7 and _DIGIT.search(lines[1]) and not lines[1].rstrip().endswith((":", ".")) and (_ADDRESS_START.match(lines[1].strip()) or re.search(r"\b\d{5}\b", lines[1])) and not re.search(r"[.?!] [A-ZÀ-Ü]\w+ [a-zà-ü]+ [a-zà-ü]", lines[1]):
        add(0, len(lines[0]), "name", 4)
        add(len(lines[0]) + 1, len(lines[0]) + 1 + len(lines[1]), "address", 3)
    for m in ADDRESS.finditer(text):
        add(m.start(), m.end(), "address", 5)
    for a, b, p in candidates(text, known, common):
        if p >= NAME_LEAST:
            add(a, b, "name", 6)
    taken: list[tuple[int, int, str]] = []  # in order, free of overlaps
    for a, b, kind, order in sorted(spans, key=lambda s: (s[3] if s[3] > 4 or s[2] != "address" else -1, s[0], s[0] - s[1])):
        i = bisect_left(taken, (a,))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
            taken.insert(i, (a, b, kind))
    return taken


# ---------------------------------------------------------------- surrogates

# What surrogates are made of.
SYLLABLES = "ba be bo da de do fa fe ga ge ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va ve".split()
VOWELS = {"f": "a", "m": "o", "": "y"}
SCRIPTS = {
    "CYRILLIC": "ба бо ва ве да до за ка ки ла ле ма ми на но па ра ро са та ти".split(),
    "GREEK": "βα βο γα δα δε ζα κα κε λα λο μα με να νο πα ρα ρο σα τα τε".split(),
    "ARABIC": "با بو تا جا دا را زا سا شا فا كا لا ما نا ها وا يا".split(),
    "HEBREW": "בא בו גא דא הא זא טא כא לא מא נא סא פא רא שא תא".split(),
    "CJK": "安 白 成 东 方 高 海 江 林 明 宁 平 青 石 田 文 新 远 云 正".split(),
}
STREETS = "Alder Beech Cedar Elm Fir Hazel Juniper Larch Maple Oak Pine Rowan Spruce Walnut Willow".split()
FEMALE_TITLES, MALE_TITLES = "mrs ms miss frau sra srta mme mlle".split(), "mr sir herr sr m".split()
_EXTENSION_END = re.compile(_EXTENSION + "$")


def _number(kind: str, value: str) -> tuple[str, str]:
    """A phone number and its extension; other numbers as they are."""
    m = _EXTENSION_END.search(value) if kind == "phone" else None
    return (value[: m.start()], m.group()) if m else (value, "")


def canonical(kind: str, value: str) -> str:
    """What equal things have in common: digits of phones (without extension) and numbers, lower-case words of the rest in sorted order, titles left out."""
    if kind in ("phone", "id_number"):
        d = re.sub(r"\W", "", _number(kind, value)[0].lower())
        return d[-10:] if kind == "phone" else d
    if kind == "email":
        return re.sub(r" ?[\[(] ?(?:dot|\.) ?[\])] ?| dot ", ".", re.sub(r" ?[\[(] ?at ?[\])] ?| at ", "@", value.lower()))
    return " ".join(sorted(w for w in re.findall(r"\w+", value.lower()) if w not in TITLES))


def _bits(key: bytes, kind: str, canon: str) -> int:
    return int.from_bytes(hmac.new(key, f"{kind}\0{canon}".encode(), hashlib.sha256).digest(), "big")


def _digits(value: str, n: int) -> str:
    """``value`` with other digits and letters, everything else unchanged."""
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(n % 10))
            n //= 10
        elif c.isalpha():
            out.append(chr((65 if c.isupper() else 97) + n % 26))
            n //= 26
        else:
            out.append(c)
    return "".join(out)


def _script(word: str) -> str:
    return next((unicodedata.name(c, "LATIN").split()[0] for c in word if c.isalpha()), "LATIN")


def _word(word: str, key: bytes, kind: str, gender: str = "", rank: int = 0) -> str:
    """The surrogate of one word of a name, in its script and case. Given names begin with a letter that depends on the first letter alone, so that an initial stays that of the name."""
    w = _plain(word)
    script = _script(w)
    syllables = SCRIPTS.get(script, SYLLABLES)
    n = _bits(key, kind, w)
    if kind == "given" and script not in SCRIPTS:
        first = chr(97 + _bits(key, "initial", unicodedata.normalize("NFD", w)[0]) % 26)
        if len(w) == 1:
            return first.upper() + "." * word.endswith(".") if word[0].isupper() else first + "." * word.endswith(".")
        out = first + ("" if first in "aeiou" else "aeio"[n % 4])
        n //= 4
    else:
        out = ""
    for _ in range(1 if len(w) == 1 or script == "CJK" and kind == "given" else 2 if kind == "given" or script == "CJK" else 5):
        out += syllables[n % len(syllables)]
        n //= len(syllables)
    if kind == "given" and script not in SCRIPTS:
        out = out[:-1] + VOWELS[gender]
    if any(ord(c) > 127 for c in w) and script == "LATIN":
        out = out.translate(str.maketrans("aeo", "áéö"))
    if rank:
        out += f"-{rank}"
    return out.upper() if word.isupper() and len(w) > 1 else out if word.islower() else out.capitalize()


def _gender(title: str, given: list[str]) -> str:
    if _plain(title) in FEMALE_TITLES + MALE_TITLES:
        return "f" if _plain(title) in FEMALE_TITLES else "m"
    return next(("f" if g in FEMALE else "m" for g in map(_plain, given) if g in FEMALE or g in MALE), next(("f" if g.endswith("a") else "" for g in map(_plain, given) if len(g) > 1), ""))


def _person(value: str, key: bytes, rank: int) -> str:
    """A name, word by word: titles, suffixes, legal forms, particles and punctuation stay."""
    words = [m for m in re.finditer(r"[^\s,;&()]+", value)]
    fixed = [w for w in words if _plain(w[0]) in TITLES or _plain(w[0]) in PARTICLES or _SUFFIX.match(w[0]) or _plain(w[0]) in LEGAL or _plain(w[0]) in ("the", "and", "of")]
    real = [w for w in words if w not in fixed]
    if not real:
        return _digits(value, _bits(key, "name", value))
    comma = re.search(r"[,;]", value)
    head = [w for w in real if comma and w.end() <= comma.start()]
    long = [w for w in real if len(_plain(w[0])) > 1] or real
    family = head if head and len(head) < len(real) else [long[-1]]
    title = next((w[0] for w in words if _plain(w[0]) in TITLES), "")
    gender = _gender(title, [w[0] for w in real if w not in family])
    out, at = [], 0
    for w in words:
        out.append(value[at : w.start()])
        out.append(w[0] if w in fixed else _word(w[0], key, "family", rank=rank if w is family[0] else 0) if w in family else _word(w[0], key, "given", gender))
        at = w.end()
    return "".join(out) + value[at:]


def surrogate(kind: str, value: str, key: bytes, rank: int = 0) -> str:
    """The replacement of ``value``; ``rank`` tells apart values that would get the same one."""
    n = _bits(key, kind, canonical(kind, value))
    if kind in ("phone", "id_number"):
        number, extension = _number(kind, value)
        digits = canonical(kind, value)
        lead = len(re.sub(r"\W", "", number)) - len(digits) if kind == "phone" else 0
        at = next((m.end() for i, m in enumerate(re.finditer(r"\w", number)) if i == lead - 1), 0)
        size = 10 ** sum(c.isdigit() for c in digits) * 26 ** sum(c.isalpha() for c in digits)
        return number[:at] + _digits(number[at:], (n + rank * 7919) % size) + re.sub(r"\d+", lambda m: _digits(m[0], _bits(key, "extension", f"{digits} {m[0]}")), extension)
    if kind == "name":
        return _person(value, key, rank)
    family = ""
    for _ in range(5):
        n, s = divmod(n, len(SYLLABLES))
        family += SYLLABLES[s]
    family += f"-{rank}" if rank else ""
    if kind == "email":
        return f"{family}{n % 10_000}@mail.invalid"
    n, g = divmod(n, len(STREETS))
    return f"{n % 9000 + 100} {STREETS[g]} Street, {family.capitalize()}ville {str(n // 9000 % 100_000).zfill(5)}"


def replace(text: str, spans: list[tuple[int, int, str]], key: bytes, ranks: dict[tuple[str, str], int]) -> str:
    """``text`` with every span as ``[TYPE surrogate]``, everything else unchanged."""
    out, at = [], 0
    for a, b, kind in spans:
        v = text[a:b]
        out += [text[at:a], f"[{kind.upper()} {surrogate(kind, v, key, ranks.get((kind, canonical(kind, v)), 0))}]"]
        at = b
    return "".join(out) + text[at:]


# ---------------------------------------------------------------- DataFrames


def texts(parsed_records: DataFrame, documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """origin, row_id, text: records of pending documents, and passage and raw_value of medical extractions. Null texts are left out."""
    pending = documents.where("status = 'pending'").select(F.col("doc_id").alias("document_id"))
    records = parsed_records.join(pending, "document_id", "left_semi").select(F.lit("record_text").alias("origin"), F.col("record_id").alias("row_id"), "text")
    medical = extractions.where("category = 'medical'").select(F.col("id").alias("row_id"), F.explode(F.array(F.struct(F.lit("passage").alias("origin"), F.col("passage").alias("text")), F.struct(F.lit("raw_value").alias("origin"), F.col("raw_value").alias("text")))).alias("o"))
    return records.unionByName(medical.select("o.origin", "row_id", "o.text")).where("text is not null")


def name_words(extractions: DataFrame, persons: DataFrame) -> DataFrame:
    """word, named: words of two letters and more of the names in both tables, in lower case, with the number of names they stand in."""
    e = extractions.where("category = 'full_name' and not coalesce(suppressed_as_false_positive, false)").select(F.col("normalized_value").alias("name"))
    n = e.unionByName(persons.where("best_known_full_name <> 'Unknown'").select(F.col("best_known_full_name").alias("name"))).where("name is not null")
    return n.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"\p{L}{2,}"), F.lit(0)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("named"))


def lexicon(rows: DataFrame, names: DataFrame) -> DataFrame:
    """word, known: whether the names use the word in more places than the texts write it in lower case."""
    low = rows.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<!\p{L})\p{Ll}{2,}"), F.lit(0)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("low"))
    both = names.join(low, "word", "full_outer").fillna(0, ["named", "low"])
    return both.select("word", ((F.col("named") > 1) & (F.col("named") > F.col("low"))).alias("known")).where("known or named <= low")


def informed(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    """origin, row_id, text, known, common: with those capitalised words of each text, in lower case, that names use or that texts use otherwise. Words meet the lexicon by a join; a text carries its own words only."""
    rows = rows.select("origin", F.col("row_id").cast("bigint").alias("row_id"), "text")
    none = F.array().cast("array<string>")
    if names is None:
        return rows.select("*", none.alias("known"), none.alias("common"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<!\p{L})\p{Lu}\p{L}+"), F.lit(0)))
    asked = materialize(rows.select("origin", "row_id", F.explode(F.array_distinct(F.transform(words, F.lower))).alias("word")))
    told = salted_join(asked, materialize(lexicon(rows, names)), ["word"])
    per = told.groupBy("origin", "row_id").agg(F.collect_set(F.when(F.col("known"), F.col("word"))).alias("known"), F.collect_set(F.when(~F.col("known"), F.col("word"))).alias("common"))
    return rows.join(per, ["origin", "row_id"], "left").select("origin", "row_id", "text", F.coalesce("known", none).alias("known"), F.coalesce("common", none).alias("common"))


def spans(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """origin, row_id, char_start, char_end, pii_type of every find (offsets in code points). ``names``: see :func:`name_words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, r, t, known, common = (b.column(i).to_pylist() for i in range(5))
            out = [(o[i], r[i], a, e, k) for i, x in enumerate(t) for a, e, k in find(x, set(known[i]), set(common[i]))]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["origin", "row_id", "char_start", "char_end", "pii_type"])

    return informed(rows, names).mapInArrow(run, "origin string, row_id bigint, char_start int, char_end int, pii_type string")


def distinct_ranks(values: DataFrame, secret: bytes) -> DataFrame:
    """pii_type, canon, rank of the things whose surrogate would also be that of another. ``values``: distinct pii_type, canon, value.

    What is compared is the surrogate as it is written for each value, read as :func:`canonical` reads it. Of the
    things that share one the first keeps its rank and the others get higher ones, until none is shared. A group of
    equal surrogates is small, as surrogates are spread by a keyed hash.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in (0, 2, 3)))
            s = [canonical(k, surrogate(k, v, secret, r)) for k, v, r in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(s, pa.string())], ["pii_type", "canon", "value", "rank", "s"])

    def written(rows: DataFrame) -> DataFrame:
        return rows.select("pii_type", "canon", "value", "rank").mapInArrow(write, "pii_type string, canon string, value string, rank int, s string")

    now = materialize(written(values.withColumn("rank", F.lit(0))))
    w = Window.partitionBy("pii_type", "s").orderBy("rank", "canon")
    while True:
        shared = now.groupBy("pii_type", "s").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("pii_type", "s")
        again = now.join(shared, ["pii_type", "s"], "left_semi").select("pii_type", "s", "canon", "rank").distinct()
        up = materialize(again.withColumn("k", F.row_number().over(w) - 1).groupBy("pii_type", "canon").agg(F.max("k").alias("up")).where("up > 0"))
        if up.isEmpty():
            return now.where("rank > 0").select("pii_type", "canon", "rank").distinct()
        moved = written(now.join(up, ["pii_type", "canon"]).withColumn("rank", (F.col("rank") + F.col("up")).cast("int")))
        now = materialize(now.join(up, ["pii_type", "canon"], "left_anti").unionByName(moved))


_SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("pii_type", pa.string()), ("canon", pa.string()), ("value", pa.string())]))


def redact(rows: DataFrame, key: str, names: DataFrame | None = None) -> DataFrame:
    """origin, row_id, text with typed surrogates. A secret ``key`` is needed: who knows it can guess what was replaced.

    Each text is searched once. All distinct values of the corpus are met once (one row each): those whose
    surrogate is also that of another value get a rank, and only texts that hold one of them meet the ranks.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    secret = key.encode()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, known, common = (b.column(i).to_pylist() for i in range(2, 5))
            found = [[{"a": a, "b": e, "pii_type": k, "canon": canonical(k, x[a:e]), "value": x[a:e]} for a, e, k in find(x, set(y), set(z))] for x, y, z in zip(t, known, common)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, _SPAN)], ["origin", "row_id", "text", "found"])

    fields = "origin string, row_id bigint, text string, found array<struct<a:int,b:int,pii_type:string,canon:string,value:string>>"
    seen = materialize(informed(rows, names).mapInArrow(look, fields))
    each = seen.select("origin", "row_id", F.explode("found").alias("s")).select("origin", "row_id", "s.pii_type", "s.canon", "s.value")
    clash = materialize(distinct_ranks(each.select("pii_type", "canon", "value").distinct(), secret))
    ranks = materialize(salted_join(each.select("origin", "row_id", "pii_type", "canon"), clash, ["pii_type", "canon"]).groupBy("origin", "row_id").agg(F.collect_set(F.struct("pii_type", "canon", "rank")).alias("ranks")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, found, rk = (b.column(i).to_pylist() for i in range(2, 5))
            new = [replace(x, [(s["a"], s["b"], s["pii_type"]) for s in ss], secret, {(q["pii_type"], q["canon"]): q["rank"] for q in y or ()}) for x, ss, y in zip(t, found, rk)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], ["origin", "row_id", "text"])

    none = F.lit(None).cast(ranks.schema["ranks"].dataType).alias("ranks")
    with_ranks = seen.select(*seen.columns, none) if ranks.isEmpty() else seen.join(ranks, ["origin", "row_id"], "left")
    return with_ranks.select("origin", "row_id", "text", "found", "ranks").mapInArrow(write, "origin string, row_id bigint, text string")
