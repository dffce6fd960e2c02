"""Invented sentences with labelled spans, so that the tagger also meets forms that a corpus at hand lacks.

Streets and numbers are put together at random from syllables and digits; forms are those in public use (telephone
numbers, account, identity and passport numbers, postal addresses). Other sentences hold look-alikes that are no
personal information: amounts, dates, versions, institutions, places.
"""

from __future__ import annotations

import re

import numpy as np

Span = tuple[int, int, str]

_LATIN = "ba be bo da de di do el en er fa fi ga go ha he in is ja ka ke la le li lo ma me mi mo na ne ni no or pa pe ra re ri ro sa se si so ta te ti to va ve vi wa".split()
_CYRILLIC = "ба ве го да ел жи за ив ка ла ми не ов по ра си та ур фе ха че ша ян".split()
_STREETS = "Street St. Road Rd Avenue Ave. Lane Drive Court Terrace Row Boulevard Way Close Crescent Place Square Hill Park Gardens Highway Parkway Circle Quay Mews Grove".split()
_GERMAN = "straße strasse str. weg platz gasse allee ufer ring damm".split()
_FRENCH = "rue avenue boulevard place quai impasse chemin allée cours".split()
_SPANISH = "Calle Avenida Avda. Plaza Paseo Camino C/".split()
_ITALIAN = "Via Viale Piazza Corso Largo".split()
_RUSSIAN = "ул. улица пр. просп. пер. пл. наб.".split()

# Slots in braces are filled; all but {w}, {n}, {y}, {date}, {thing} and {sum} are labelled. No names: only a corpus tells its
# names from its places, both being capitalised words.
TEMPLATES = [
    "The office is at {address}, telephone {phone}.", "You can write to {email} or call {phone}.", "Her passport {id} was issued in {y}.", "Payment to account {id}, please.", "IBAN: {id}",
    "National insurance number {id}; telephone {phone}", "Thank you for your letter of {date}.\n{address}\n{phone}", "The identity number is {id}, born {date}.", "Deliver the parcel to {address}.",
    "They lived at {address} until {y}.", "The driving licence {id} has expired.", "Contact: {email}", "Bitte wählen Sie Telefon {phone}.", "Sie wohnt in der {address}.", "Das Konto {id} ist leer.",
    "Das Büro liegt in der {address}, Telefon {phone}.", "Appelez le {phone}.", "Elle habite au {address}.", "Le passeport {id} est périmé.", "Écrivez à {email}, ou bien au {address}.", "Llame al {phone}.",
    "La familia vive en {address}.", "La cuenta {id} está vacía.", "La ditta abita in {address}, tel. {phone}.", "Позвоните по телефону {phone}.", "Она живёт по адресу {address}.", "Паспорт {id} утерян.",
    "联系人电话{phone}，邮箱{email}。", "電話は{phone}、番号は{id}です。",
    "In {y} the {thing} sold {n} books for {sum}.", "Version 2.{n}.1 of {date} replaced build {n}{n}{n}.", "See pages {n}-{n} and {n} people at {w}.", "The {thing} lies {n} miles from {w}, near the river {w}.",
    "{w} means the old harbour. {w} followed in {y}.", "Im Jahr {y} hatte {w} {n} Häuser und {n} Einwohner.", "En {y}, {w} avait {n} maisons ; {n} habitants en {y}.", "En {y} {w} tenía {n} casas y {sum}.",
    "In der Mundart von {w} heißt das {w}.", "His {w} was heard on {date}. Driving is hard.", "THE {w} COUNTED {n} FARMS IN {y} AND COST {sum}.", "В {y} году {w} насчитывал {n} домов.",
]
_SLOT = re.compile(r"\{(\w+)\}")


class Inventor:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def digits(self, form: str) -> str:
        """The form with random digits for # and random capital letters for A."""
        return "".join(str(self.rng.integers(10)) if c == "#" else chr(65 + int(self.rng.integers(26))) if c == "A" else c for c in form)

    def word(self, russian: bool = False) -> str:
        return "".join(self.one(_CYRILLIC if russian else _LATIN) for _ in range(self.rng.integers(2, 4))).capitalize()

    def address(self, language: str) -> str:
        no, w = str(self.rng.integers(1, 400)) + self.one(["", "", "", "a", "b"]), self.word(language == "ru")
        if language == "de":
            return f"{w}{self.one(_GERMAN)} {no}" if self.chance(0.7) else f"Am {w}{self.one(_GERMAN)} {no}"
        if language == "fr":
            return f"{no}{self.one(['', ',', ' bis'])} {self.one(_FRENCH)} {self.one(['', 'de ', 'du ', 'des ', 'de la '])}{w}"
        if language in ("es", "it"):
            return f"{self.one(_SPANISH if language == 'es' else _ITALIAN)} {self.one(['', 'de ', 'del '] if language == 'es' else ['', 'dei ', 'della '])}{w}{self.one([' ', ', '])}{no}"
        if language == "ru":
            return f"{self.one(_RUSSIAN)} {w}, {self.one(['', 'д. '])}{no}"
        whole = f"{no} {self.one(['', '', '', 'North ', 'Old ', 'West '])}{w} {self.one(_STREETS)}"
        return whole.upper() if self.chance(0.1) else whole

    def phone(self) -> str:
        return self.digits(self.one(["+## ## ########", "+# ###-###-####", "(###) ###-####", "0## #### ####", "+## (0)## #######", "+##-##-####-####", "0#### ######", "###-###-####", "0# ## ## ## ##", "+## ### ### ###", "###.###.####"]))

    def id_number(self) -> str:
        return self.digits(self.one(["AA## #### #### #### ####", "AA################", "AA##AAAA##############", "###-##-####", "AA ## ## ## A", "AA######A", "A########", "#########", "## ### ### ###", "######-####", "AAAAA-######-AA#AA", "# ## ## ## ### ### ##"]))

    def email(self) -> str:
        who = self.one([".", "_", "-", ""]).join([self.word().lower(), self.word().lower()])
        return f"{who}{self.one(['@', '@', '@', ' @ ', ' AT ', ' [at] ', '(at)'])}{self.word().lower()}.{self.one(['com', 'org', 'net', 'de', 'co.uk', 'example'])}"

    def sentence(self) -> tuple[str, list[Span]]:
        template = self.one(TEMPLATES)
        russian = bool(re.search("[а-я]", template))
        language = "ru" if russian else "de" if re.search("wohnt|Büro", template) else "fr" if re.search("Elle habite|Appelez|Écrivez", template) else "es" if re.search("vive en|Llame|cuenta", template) else "it" if "abita" in template else "en"
        make = {
            "address": lambda: self.address(language), "phone": self.phone, "id": self.id_number, "email": self.email, "w": lambda: self.word(russian),
            "n": lambda: str(self.rng.integers(2, 3000)), "y": lambda: str(self.rng.integers(1200, 2024)), "date": lambda: self.digits(self.one(["20##-0#-1#", "1#.0#.19##", "0#/1#/20##"])),
            "thing": lambda: f"{self.word()} {self.one(['Bridge', 'Institute', 'University', 'Museum', 'Street Market', 'Prize', 'Company', 'Abbey'])}",
            "sum": lambda: self.one(["# dollars", "#,### crowns", "##.### Taler", "### euros", "€##,###", "#.### pesos"]).replace("#", str(self.rng.integers(1, 9))),
        }
        text, spans, at = "", [], 0
        for m in _SLOT.finditer(template):
            value = make[m.group(1)]()
            text += template[at : m.start()]
            if m.group(1) in ("address", "phone", "id", "email"):
                spans.append((len(text), len(text) + len(value), "id_number" if m.group(1) == "id" else m.group(1)))
            text, at = text + value, m.end()
        return text + template[at:], spans


def invented(n: int, seed: int = 21) -> list[tuple[str, list[Span]]]:
    """n texts of some sentences each, with their spans in ascending order."""
    inventor, out = Inventor(seed), []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(inventor.rng.integers(1, 4))):
            sentence, own = inventor.sentence()
            spans += [(a + len(text), b + len(text), kind) for a, b, kind in own]
            text += sentence + " "
        out.append((text, spans))
    return out
