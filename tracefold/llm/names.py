"""Names of people and organisations taken apart, for the operators that link them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection, Iterable

# Titles, suffixes, particles, legal forms, business words with their abbreviations, nicknames.
TITLES = set("mr mrs ms miss mx dr prof professor sir herr frau sra srta señor señora mme mlle hr".split())
SUFFIXES = {"jr": "jr", "jnr": "jr", "junior": "jr", "sr": "sr", "snr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
PARTICLES = set("van von de di da du del della der den la le las los ter ten zu zum".split())
LEGAL = {"inc": "inc", "incorporated": "inc", "ltd": "ltd", "limited": "ltd", "llc": "llc", "co": "co", "company": "co", "corp": "corp", "corporation": "corp", "gmbh": "gmbh", "sa": "sa", "plc": "plc", "ag": "ag", "kg": "kg", "lp": "lp"}
BUSINESS = {"ins": "insurance", "log": "logistics", "eng": "engineering", "cons": "consulting", "mfg": "manufacturing", "univ": "university", "hosp": "hospital", "dept": "department", "bros": "brothers", "intl": "international", "svcs": "services", "serv": "services", "med": "medical", "grp": "group", "assoc": "associates", "fin": "financial", "tech": "technologies", "lab": "labs", "laboratories": "labs"}
BUSINESS_WORDS = set("insurance logistics engineering consulting manufacturing university hospital department stores brothers partners international services medical group associates financial technologies labs credit union payroll bank clinic foundation holdings systems solutions trading transport pharma energy foods media partners realty school college trust".split()) | set(BUSINESS.values())
LONG_BUSINESS = sorted(w for w in BUSINESS_WORDS if len(w) > 7)
NICKNAMES = dict(
    x.split(":")
    for x in "abby:abigail len:leonard lenny:leonard leo:leonard benji:benjamin susie:susan suzie:susan jonny:jonathan,john sammie:samuel,samantha gerry:gerald vinny:vincent trish:patricia liam:william peg:margaret mandy:amanda val:valerie stan:stanley alex:alexander,alexandra xander:alexander sandy:alexandra,sandra lexi:alexandra andy:andrew drew:andrew tony:anthony basti:sebastian ben:benjamin benny:benjamin bea:beatrice becca:rebecca becky:rebecca beth:elizabeth betty:elizabeth liz:elizabeth lizzie:elizabeth eliza:elizabeth bill:william billy:william will:william willy:william bob:robert bobby:robert rob:robert robbie:robert cathy:catherine charlie:charles chuck:charles charo:rosario chris:christopher,christine kit:christopher,katherine dan:daniel danny:daniel dave:david davy:david deb:deborah debbie:deborah dick:richard rich:richard rick:richard dolly:dorothy,dolores dot:dorothy dottie:dorothy lola:dolores ed:edward eddie:edward ned:edward ted:theodore,edward teddy:theodore ellie:eleanor nell:eleanor nora:eleanor fran:frances,francisco fred:frederick freddy:frederick fritz:friedrich gabe:gabriel gabi:gabriela greg:gregory hank:henry harry:harold,henry hal:harold hannes:johannes hans:johannes heinz:heinrich heiner:heinrich izzy:isabella bella:isabella isa:isabella jack:john johnny:john jim:james jimmy:james jamie:james jerry:gerald,jerome jenny:jennifer jen:jennifer jess:jessica jessie:jessica joe:joseph joey:joseph jon:jonathan josh:joshua judy:judith kate:katherine katie:katherine kathy:katherine kathe:katharina kati:katharina kathi:katharina ken:kenneth kenny:kenneth larry:lawrence laurie:lawrence lupe:guadalupe lupita:guadalupe maggie:margaret meg:margaret peggy:margaret greta:margaret manolo:manuel manny:manuel matt:matthew max:maximilian mike:michael mick:michael nat:nathaniel nate:nathaniel nick:nicholas nico:nicholas paco:francisco pancho:francisco frank:francisco pam:pamela pat:patricia,patrick paddy:patrick patty:patricia tricia:patricia pepe:jose pete:peter phil:philip quique:enrique kike:enrique ron:ronald ronnie:ronald sam:samuel,samantha sammy:samuel steve:stephen steph:stephen stevie:stephen sue:susan suzy:susan theo:theodore tim:timothy timmy:timothy tom:thomas tommy:thomas vicky:victoria tori:victoria vic:victoria,victor vince:vincent vinnie:vincent wally:walter walt:walter zach:zachary zack:zachary lu:lucia mari:maria,mariana mia:maria nacho:ignacio".split()
)


def fold(s: str) -> str:
    """Lower case without accents; ß as ss."""
    s = unicodedata.normalize("NFKD", s.replace("ß", "ss").replace("ø", "o").replace("ł", "l"))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def full_names(first: str) -> list[str]:
    """The given names a nickname stands for, else the name itself."""
    return NICKNAMES.get(first, first).split(",")


def words(name: str) -> tuple[list[str], list[str], str, str, bool]:
    """Tokens before and after the first comma or semicolon, suffix, legal form, and whether it is an organisation.

    Titles, particles and punctuation are gone; an initial is a token of one letter; hyphenated parts are one token.
    """
    s = fold(name)
    s = re.sub(r"\s*-\s*", "-", s)
    s = re.sub(r"['’`]", "", s)
    s = re.sub(r"\b(mc|mac) (?=[a-z]{3})", r"\1", s)
    s = re.sub(r"^o (?=[a-z]{3,},|[a-z]{3,} [a-z]+\.?,)", "o", s)
    s = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", "") if m[1].replace(".", "") in LEGAL else m[1].replace(".", " "), s)
    s = re.sub(r"\bs\.? ?a\.?(?=\s*$|,)", "sa", s)
    head, _, tail = re.sub(r";", ",", s).partition(",")
    parts, suffix, legal, org = [], "", "", "&" in s or bool(re.match(r"the ", s))
    for part in (head, tail):
        out = []
        for w in re.findall(r"[^\W_]+(?:-[^\W_]+)*", part):
            if w in TITLES:
                continue
            if w in SUFFIXES:
                suffix = SUFFIXES[w]
                continue
            if w in LEGAL:
                legal = LEGAL[w]
                continue
            if w in PARTICLES or w in ("the", "and", "cu"):
                if w == "cu":
                    out += ["credit", "union"]
                continue
            out.append(BUSINESS.get(w, w))
        parts.append(out)
    known = sum(w in BUSINESS_WORDS or len(w) > 7 and any(near(w, x) for x in LONG_BUSINESS) for w in parts[0] + parts[1])
    org = bool(legal) or known > 0 or org
    return parts[0], parts[1], suffix, legal, org


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


def deleted(word: str) -> list[str]:
    """``word`` and what is left of it without one character: words that are :func:`near` share one."""
    return sorted({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})


class Index:
    """Words that are near to a word, found by what is left of both without a character."""

    def __init__(self, among: Iterable[str]):
        self.at: dict[str, list[str]] = {}
        for x in sorted(set(among)):
            for v in deleted(x):
                self.at.setdefault(v, []).append(x)

    def near(self, word: str) -> list[str]:
        return sorted({x for v in deleted(word) for x in self.at.get(v, ()) if near(word, x)})


def taken_apart(name: str, given: dict[str, int], nearly: Collection[str] | None = None) -> tuple[str, str, str, str, str]:
    """kind, family (or brand), first, middle, suffix (or legal form) of a name.

    ``given``: given names with their frequency, those in the name at least; ``nearly``: the words of
    the name that are a letter off a given name, looked for in ``given`` if null. What is no given name,
    nor a misspelling of one, is the family name; a comma behind it or its place at the end decides if
    there are several. For an organisation first holds its business words.
    """
    head, tail, suffix, legal, org = words(name)
    if org:
        every = head + tail
        business, brand = [], []
        for w in every:
            b = w if w in BUSINESS_WORDS else next((x for x in BUSINESS_WORDS if len(x) > 5 and len(w) > 4 and near(w, x)), "")
            if b:
                business.append(b)
            elif len(w) > 1:
                brand.append(w)
        return "org", " ".join(sorted(brand)) or " ".join(sorted(business)), " ".join(sorted(business)), "", legal
    every = head + tail
    long = [w for w in every if len(w) > 1]
    if not long:
        return "person", "", "".join(every)[:1], "".join(every)[1:2], suffix
    common = {w: given.get(w, 0) or max((given.get(x, 0) for x in full_names(w)), default=0) for w in long}
    strange = [w for w in long if not common[w]]
    sure: list[str] = []
    if len(strange) > 1:
        sure = [w for w in strange if len(w) <= 2 or not (w in nearly if nearly is not None else any(near(w, g) for g in given))]
        strange = sure or strange
    if len(strange) > 1 and sure:  # a double name, its hyphen lost
        in_head, in_tail = [w for w in head if w in sure], [w for w in tail if w in sure]
        order = tail + head if in_head and in_tail else every
        double = [w for w in order if w in sure][-2:]
        at = order.index(double[0])
        if order[at + 1 : at + 2] == double[1:]:
            rest = order[:at] + order[at + 2 :]
            return "person", "-".join(double), rest[0] if rest else "", rest[1] if len(rest) > 1 else "", suffix
    if not strange:
        strange = [min(long, key=lambda w: (common[w], -long.index(w)))]
    if tail and len([w for w in head if len(w) > 1]) == 1 and [w for w in head if len(w) > 1][0] in strange:
        family = next(w for w in head if len(w) > 1)
    else:
        family = strange[-1] if strange[-1] == long[-1] or strange[0] != long[0] else strange[0]
    order = every if family in head or not tail else tail + head
    rest = list(order)
    rest.remove(family)
    first = rest[0] if rest else ""
    middle = rest[1] if len(rest) > 1 else ""
    return "person", family, first, middle, suffix
