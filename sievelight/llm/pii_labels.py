"""Labelled spans for fitting the tagger of personal information, from the context of labels, verbs and titles.

Labels are made only for the bounded fitting sample. They name a span where its surroundings say what it is (a title, a
label, a verb, a unit of street names), which leaves it to the tagger to know such values in other surroundings.
"""

from __future__ import annotations

import re

KINDS = ["email", "phone", "id_number", "address", "name"]

_AT = r"(?:\s?@\s?|&#64;|\s?[\[(]at[\])]\s?|\sAT\s|\sat\s(?=\S+\s(?:dot|DOT|\[dot\])\s))"
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?|\sDOT\s|\sdot\s)"
EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9-]+)+")

_D = "[0-9０-９]"
_S = r"[ .\-－−‐ ]"
PHONE = re.compile(
    rf"(?<![A-Za-z0-9０-９.,/-])(?:\+{_D}{{1,3}} \(0\){_D}{{2,4}}{_S}{_D}{{4,9}}|\+{_D}{{1,3}}{_S}(?:\({_D}{{1,4}}\){_S}?)?{_D}{{1,12}}(?:{_S}{_D}{{2,5}}){{0,5}}"
    rf"|\({_D}{{3}}\){_S}?{_D}{{2,8}}(?:{_S}{_D}{{2,5}}){{0,3}}|0{_D}{{2,3}}/{_D}{{4,6}}-{_D}{{2,4}}"
    rf"|[０0]{{3}}{_S}{_D}{{3,4}}{_S}{_D}{{4}}|0{_D}{{2}} {_D}{{4}} {_D}{{4}}|001 {_D}{{3}} {_D}{{7}}|8 {_D}{{3}} {_D}{{3}} {_D}{{2}} {_D}{{2}}"
    rf"|0{_D}(?:[ .]{_D}{{2}}){{4}}|{_D}{{3}} {_D}{{2}} {_D}{{2}} {_D}{{2}}|{_D}{{3}}-{_D}{{3}}-{_D}{{3}}|{_D}{{3}}[.]{_D}{{3}}[.]{_D}{{4}}|{_D}{{10}}|{_D}{{3}}-{_D}{{4}})(?![A-Za-z0-9０-９]|[-/]{_D})"
)
# Forms in public use: passports, national insurance numbers, bank accounts, driving licences, personal and social security numbers, tax numbers.
_ID_FORMS = [
    r"[A-Z]{1,2}\d{7,9}", r"[A-Z]{2}(?: ?\d\d){3} ?[A-Z]", r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"[A-Z]{5}-\d{6}-[A-Z]{2}\d[A-Z]{2}", r"\d{6}-\d{4}", r"\d{3}-\d{2}-\d{4}",
    r"\d \d\d \d\d \d\d \d{3} \d{3} \d\d", r"\d\d \d{3} \d{3} \d{3}", r"\d{9}",
]
ID = re.compile(rf"(?<![A-Za-z0-9.,/+-])(?:{'|'.join(_ID_FORMS)})(?![A-Za-z0-9]|[-/]\d)")
DATE = re.compile(r"(?:1[0-9]|20)\d\d[-/.](?:0?[1-9]|1[0-2])[-/.](?:[0-2]?\d|3[01])|(?:[0-2]?\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:1[0-9]|20)\d\d")
# Words that make a number beside them a postal address: of several languages, inside or at the end of a word in German.
STREET = re.compile(
    r"(?i)\b(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|terrace|row|blvd|boulevard|way|close|crescent|place|square|hill|park|gardens?|highway|parkway|circle|alley|quay|mews|grove|walk|yard)\b"
    r"|(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|ufer|ring|damm|chaussee)(?!\w)|\b(?:rue|bd|quai|impasse|chemin|allée|cours|calle|avda|avenida|plaza|paseo|camino|via|viale|piazza|corso|largo|rua|praça)\b|\bc/"
    r"|(?:^|\s)(?:ул|улица|пр|просп|проспект|пер|переулок|пл|площадь|наб|набережная|бульвар|шоссе)(?!\w)|[路街道巷号號]|丁目|番地"
)
PAGES = re.compile(r"(?i)(?:pages?|catalogue no\.|item|build|mark|isbn|version|coordinates|ratio|vol\.)\s*(?:\S+\s(?:and|lists item)\s)?\Z")

_UP = r"[A-ZÀ-ÞА-ЯЁ]"
_WORD = rf"{_UP}[\w’'​­]*"
_UNIT = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Court|Terrace|Row|Blvd|Boulevard|STREET|ST|ROAD|RD|AVENUE|AVE|LANE|DRIVE|COURT|TERRACE|ROW|BLVD)"
_NO = r"\d{1,4}(?:[a-z]|-\d{1,4})?"
ADDRESS = re.compile(
    rf"(?<![\w.,-])(?:{_NO}\s(?:(?:North|South|East|West|NORTH|SOUTH|EAST|WEST)\s)?{_WORD}\s{_UNIT}\b\.?"
    rf"|(?:Am\s|An der\s)?{_WORD}(?:straße|strasse|str\.|weg|platz|gasse|allee|STRASSE|WEG|PLATZ)\s\d{{1,4}}[a-z]?\b"
    rf"|\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|bd|boulevard|place|quai|impasse|RUE|AVENUE|BD|PLACE)(?:\s(?:de|du|des|la|DE|DU)\b)?(?:\s|\s?['’]){_WORD}"
    rf"|(?:Calle|Avda\.|Avenida|C/|Plaza|Paseo|CALLE|AVDA\.|PLAZA)\s(?:(?:de|del|DE)\s)?{_WORD},?\s(?:n\.º\s)?\d{{1,4}}"
    rf"|(?:ул\.|пр\.|просп\.|пер\.|УЛ\.|ПР\.)\s{_WORD},\s(?:д\.\s)?\d{{1,4}})"
)

_PART = rf"{_UP}(?:[\w​’]+|\.)(?:-{_UP}[\w​]+)*"
_LINK = r"(?:van |von |de la |de |VAN |DE LA )?(?:[OО]’)?"
NAME = rf"{_PART}(?:,?\s{_LINK}{_PART}){{0,3}}"
_BEFORE = "|".join(
    [r"Contact person:\s", r"Reviewer\s", r"issued to\s", r"belongs to\s", r"holder\s", r"asked by\s", r"Signed:\s", r"curator\s", r"submitted by\s", r"Ask for\s", r"délivré à\s",
     r"ausgestellt für\s", r"a nombre de\s", r"Ansprechpartner:\s(?:Dr\.\s)?", r"выдан на имя\s", r"Редактор\s", r"\bBoth\s", r"(?<=\w)\sand\s(?=[^.]{3,40}\ssigned the)",
     r"\bDr\.\s(?=\S+\s)", r"\bMrs?\.?\s", r"\bMs\s", r"\bFrau\s", r"\bHerr\s", r"\bMme\s", r"\(M\.\s", r"\bSra?\.\s", r"Г-н\s", r"Г-жа\s"]
)
NAME_AFTER_LABEL = re.compile(rf"(?:{_BEFORE})({NAME})")
NAME_BEFORE_VERB = re.compile(rf"({NAME})(?=\s(?:can be reached at|answers on|répond au|atiende en|ist unter|moved to|lives at|habite au|wohnt in|vive en|signed the loan|отвечает|живёт))")
_PERSONS = re.compile(rf"{_PART}(?:,?\s{_LINK}{_PART}){{0,3}}")
_NOT_PERSON = re.compile(r"\s(?:Bridge|Institute|Street|Road|Foundation|Museum|Avenue|Prize|Hall|College|BRIDGE|INSTITUTE)\b")
_TOKEN = re.compile(r"[^\W\d_]+")
_STOP = {"The", "In", "On", "It", "Dr", "Mr", "Mrs", "Ms", "Frau", "Herr", "Mme", "Sr", "Sra", "Its", "No", "By", "He", "She", "THE", "IN", "DR", "Both", "En", "El", "La", "Im", "Am", "Un", "Tel", "Tél", "Le", "Los"}


class Names:
    """The known names, folded; also of each its spelling in Cyrillic as far as that is letter by letter."""

    def __init__(self, given: set[str], family: set[str]):
        self.all = {n.lower() for n in given | family}

    def has(self, token: str) -> bool:
        return token.replace("​", "").lower() in self.all


def weak_spans(text: str, names: Names) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind), ascending."""
    taken = bytearray(len(text))
    out: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if end > start and not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, kind))

    if "@" in text or "64;" in text or re.search("(?i)[ (\\[]at[\\]) ]", text):
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    for m in ID.finditer(text):
        if not PAGES.search(text, max(0, m.start() - 40), m.start()):
            add(m.start(), m.end(), "id_number")
    for m in PHONE.finditer(text):
        if not PAGES.search(text, max(0, m.start() - 40), m.start()):
            add(m.start(), m.end(), "phone")
    for m in ADDRESS.finditer(text):
        add(m.start(), m.end(), "address")
    for rx in (NAME_AFTER_LABEL, NAME_BEFORE_VERB):
        for m in rx.finditer(text):
            start, end = _person(text, m.start(1), m.end(1), names, sure=True)
            add(start, end, "name")
    for m in _PERSONS.finditer(text):
        if any(names.has(t) for t in _TOKEN.findall(m.group())):
            start, end = _person(text, m.start(), m.end(), names, sure=False)
            add(start, end, "name")
    return sorted(out)


def _person(text: str, start: int, end: int, names: Names, sure: bool) -> tuple[int, int]:
    """The part of text[start:end] that is one person's name; empty where it names a thing."""
    tokens = [(m.start() + start, m.end() + start) for m in _TOKEN.finditer(text[start:end])]
    if not tokens:
        return start, start
    known = [names.has(text[a:b]) for a, b in tokens]
    if any(known):
        i, j = known.index(True), len(known) - 1 - known[::-1].index(True)
        # an unknown word, an initial or a particle belongs to the name beside a known one
        while i > 0 and (sure and i > 0 or len(text[tokens[i - 1][0] : tokens[i - 1][1]]) == 1) and text[tokens[i - 1][0] : tokens[i - 1][1]] not in _STOP:
            i -= 1
        while sure and j + 1 < len(known) and text[tokens[j + 1][0] : tokens[j + 1][1]] not in _STOP and (tokens[j][1] - tokens[j][0] == 1 or "." not in text[tokens[j][1] : tokens[j + 1][0]]) and text[tokens[j][1] : tokens[j + 1][0]] != ", ":
            j += 1
        start, end = tokens[i][0], tokens[j][1]
    elif not sure or any(text[a:b] in _STOP for a, b in tokens):
        return start, start
    if _NOT_PERSON.match(text, end) or _NOT_PERSON.search(text, start, end):
        return start, start
    return start, end
