"""Signatures of licenses, as ordered rules over a text's words.

Texts are matched as their words in lower case, one space apart: ``GPL-3.0`` reads ``gpl 3 0``. A signature is a regular
expression over such words; ``~`` in the tables stands for up to a dozen words of any kind.

Three kinds of rules are put together: sentences of license texts and of notices, written out one by one; ways to name a
license, times the names and versions of the licenses; and the phrases that count as places of their own (``BASE``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_GAP = r"(?: [^ ]+){0,12}"


@dataclass(frozen=True)
class Rule:
    """A signature. ``needs``: of each set of words one at least stands in every text that it matches."""

    label: str
    words: str
    needs: tuple[frozenset, ...]
    priority: int
    weight: float
    base: bool = False
    pattern: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "pattern", re.compile(f" {self.words}(?= )".encode()))


def _need(*groups: str) -> tuple[frozenset, ...]:
    return tuple(frozenset(w.encode() for w in g.split()) for g in groups)


#: Phrases whose places are counted, whatever else is found around them.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Sentences: label, words that it needs, and the signature.
TEXTS = """
mit | obtaining permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | sublicense furnished | rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | noninfringement tort | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort
mit-0 | mit attribution | mit no attribution(?: license)?
x11 | consortium advertising | except as contained in this notice the name of (?:the )?x consortium shall not be used
bsd | redistribution binary | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | bsd | (?:the )?(?:simplified|freebsd|two clause|2 clause) bsd license
bsd-3-clause | endorse contributors | neither the name(?:s)? of~ nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | bsd | (?:the )?(?:new|modified|revised|three clause|3 clause) bsd license
bsd-4-clause | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause | bsd | (?:the )?(?:original|old|four clause|4 clause) bsd license
0bsd | 0bsd bsd | (?:0bsd|zero clause bsd)(?: license)?
isc | permission fee | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
apache-2 | compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at~ apache org licenses license 2 0
apache | compliance | you may not use this file except in compliance with the license
apache-2 | distributed conditions | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1 | apache acknowledgment | this product includes software developed by the apache (?:software foundation|group)
gpl | redistribute | (?:this program|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2-or-later | later | it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3-or-later | later | it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl | merchantability fitness | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | gnu | you should have received a copy of the gnu general public license along with this program
lgpl | redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | gnu | you should have received a copy of the gnu (?:lesser|library) general public license along with this library
agpl | gnu | you should have received a copy of the gnu affero general public license along with this program
gpl-with-classpath-exception | exception linking | as a special exception the copyright holders of this library give you permission to link this library
gpl-with-gcc-exception | gcc | gcc runtime library exception
gpl-with-font-exception | font embed | as a special exception if you create a document which uses this font and embed this font
mpl-2 | mozilla subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla subject | the contents of this file are subject to the mozilla public license version 1 1
mpl | mozilla | the contents of this file are subject to the mozilla public license
epl-1 | eclipse | accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2 | eclipse | accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
cddl-1 | cddl common | the contents of this file are subject to the terms of the common development and distribution license
cpl-1 | common accompanying | made available under the terms of the common public license v1 0
boost-1 | boost obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | authors express | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unlicense | unlicense org
wtfpl | wtfpl fuck | do what the fuck you want to public license
wtfpl | want | do what the f you want to public license
beerware | beerware beer | (?:the )?beer ?ware license
public-domain | domain | (?:is|are) (?:hereby )?(?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | domain | this (?:file|work|code|software|document|text) is in the public domain
cc0-1 | waived extent | to the extent possible under law~ has waived all copyright and related or neighboring rights
cc0-1 | cc0 commons | (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc-by | commons | licensed under (?:a|the) creative commons attribution license
ofl-1.1 | ofl sil | this font software is licensed under the sil open font license version 1 1
ofl | ofl sil | sil open font license
gfdl | invariant cover | with no invariant sections no front cover texts and no back cover texts
gfdl | gnu | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
artistic-2 | artistic perl | (?:under|of) the (?:terms of the )?artistic license 2 0
perl | perl | under the same terms as perl(?: itself)?
ruby | redistribute | you can redistribute it and or modify it under either the terms of the (?:gpl|2 clause bsdl?)
php-3.01 | php | this source file is subject to version 3 01 of the php license
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
psf-2 | python psf | python software foundation license(?: version 2)?
postgresql | agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | ncsa illinois | (?:university of illinois )?ncsa open source license
hpnd | permission supporting | both that copyright notice and this permission notice appear in supporting documentation
json | evil | the software shall be used for good not evil
w3c | w3c | w3c software (?:notice and )?license
odbl-1 | odbl database | open data(?:base| commons open database) license(?: odbl)?(?: v?1 0)?
ms-pl | microsoft ms | microsoft public license(?: ms pl)?
ms-rl | microsoft ms | microsoft reciprocal license(?: ms rl)?
sspl-1 | sspl server | server side public license(?: version 1| v1)?
bsl-1.1 | bsl business | business source license(?: 1 1)?
elastic-2 | elastic | elastic license(?: version)? 2 0
commons-clause | clause | commons clause(?: license)? condition
polyform | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter) license
openrail | openrail rail responsible | (?:creativeml )?(?:open ?rail|responsible ai license)(?: m)?
proprietary | proprietary confidential | (?:is|are)? ?(?:strictly )?(?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized unauthorised | unauthori[sz]ed (?:copying|reproduction|use|distribution) of this (?:file|document|software|work|text)~ (?:is|are) (?:strictly )?prohibited
proprietary | reproduced permission | (?:no part of this (?:publication|work|document|book)|this (?:publication|work|document|book)) may (?:not )?be reproduced~ without (?:the )?(?:prior )?(?:written )?permission
all-rights-reserved | reserved | all rights reserved
all-rights-reserved | droits reserves réservés | tous droits (?:réservés|reserves)
all-rights-reserved | derechos | todos los derechos reservados
all-rights-reserved | rechte | alle rechte vorbehalten
non-commercial | commercial noncommercial | for (?:personal and )?non ?commercial use only
non-commercial | commercial noncommercial | not (?:to be used )?for commercial (?:use|purposes)
royalty-free | royalty | royalty free license
"""

# Licenses by name: label, words of which a text has one, names, and versions, whose minor zero the label leaves out.
FAMILIES = """
mit | mit expat | mit;expat
apache | apache | apache;apache software | 1.0 1.1 2.0
gpl | gpl general | gnu gpl;gpl;gnu general public | 1.0 2.0 3.0
lgpl | lgpl lesser library | gnu lgpl;lgpl;gnu lesser general public;gnu library general public | 2.0 2.1 3.0
agpl | agpl affero | gnu agpl;agpl;gnu affero general public;affero general public | 1.0 3.0
gfdl | gfdl fdl documentation | gnu fdl;gfdl;gnu free documentation | 1.1 1.2 1.3
bsd | bsd berkeley | bsd;berkeley software distribution
bsd-2-clause | bsd | bsd 2 clause;2 clause bsd;simplified bsd
bsd-3-clause | bsd | bsd 3 clause;3 clause bsd;new bsd;modified bsd
isc | isc internet | isc;internet systems consortium
mpl | mpl mozilla | mpl;mozilla public | 1.0 1.1 2.0
epl | epl eclipse | epl;eclipse public | 1.0 2.0
eupl | eupl european | eupl;european union public | 1.0 1.1 1.2
cddl | cddl development | cddl;common development and distribution | 1.0 1.1
cpl | cpl common | common public | 1.0
ipl | ibm | ibm public | 1.0
artistic | artistic | artistic | 1.0 2.0
zlib | zlib libpng | zlib;zlib libpng
boost | boost | boost software;boost | 1.0
unlicense | unlicense | unlicense
postgresql | postgresql | postgresql
psf | psf python | psf;python software foundation | 2.0
php | php | php | 3.0 3.01
ofl | ofl font | ofl;sil ofl;sil open font;open font | 1.0 1.1
odbl | odbl database | odbl;open database | 1.0
odc-by | odc data | odc by;open data commons attribution | 1.0
pddl | pddl | pddl | 1.0
afl | afl academic | afl;academic free | 2.1 3.0
osl | osl open | osl;open software | 1.0 2.1 3.0
cecill | cecill | cecill | 1.0 2.0 2.1
mulan | mulan | mulan psl;mulan permissive software | 1.0 2.0
ms-pl | microsoft ms | ms pl;microsoft public
qpl | qpl q | qpl;q public | 1.0
upl | upl universal | upl;universal permissive | 1.0
zpl | zpl zope | zpl;zope public | 2.0 2.1
vim | vim | vim
wtfpl | wtfpl | wtfpl
ecl | ecl educational | ecl;educational community | 1.0 2.0
llama | llama | llama community | 2.0 3.0 3.1
"""

# Ways to name a license: priority, weight, what else a text needs, and the signature of a name.
FORMS = """
4 | 1.0 | spdx | spdx license identifier {name}{version}
3 | 1.0 | under | (?:licensed|released|distributed|available|published|provided|offered|covered|shared) under (?:the |an? )?(?:terms of (?:the )?)?(?:the )?{name}{called}{version}
3 | 0.95 | subject | subject to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name} licen[cs]e{version}
3 | 0.9 | opensource gnu org | (?:opensource org licenses?|spdx org licenses|gnu org licenses) {name}{version}
2 | 0.9 | license licence | (?:the )?{name} licen[cs]e{version}
1 | 0.7 | license licence | licen[cs]e {name}{version}
1 | 0.7 | lizenz licence licencia | (?:lizenz|licence|licencia|unter der lizenz|sous licence|bajo licencia) {name}{version}
"""

#: Licenses whose name and version alone tell what is meant, such as "GPL v3".
MENTIONED = ("gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "eupl", "cddl", "osl", "afl")

_COMMONS = ("by", "by-nc", "by-nd", "by-sa", "by-nc-nd", "by-nc-sa")
_PARTS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?", "sa": "share ?alike"}
_COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _lines(table: str, columns: int) -> list[list[str]]:
    rows = [[x.strip() for x in line.split("|", columns - 1)] for line in table.strip().splitlines()]
    return [row + [""] * (columns - len(row)) for row in rows]


def _versioned(label: str, version: str) -> str:
    return f"{label}-{version.removesuffix('.0')}" if version else label


def _number(version: str) -> str:
    """A version as words: a minor zero may be left out."""
    major, minor = version.split(".")
    return rf"v?{major}(?: 0)?" if minor == "0" else f"v?{major} {minor}"


def _named() -> list[Rule]:
    out = []
    for label, keys, *rest in (line.split(" | ") for line in FAMILIES.strip().splitlines()):
        names, versions = rest[0].split(";"), rest[1].split() if len(rest) > 1 else []
        name = f"(?:{'|'.join(sorted(names, key=len, reverse=True))})"
        for version in ["", *versions]:
            at = _number(version) if version else ""
            if at and label in MENTIONED:
                out.append(Rule(_versioned(label, version), f"{name}(?: version| ver)? {at}", _need(keys), 1, 0.6))
            number = f"(?: version| ver)? {at}" if at else ""
            for priority, weight, needs, form in _lines(FORMS, 4):
                filled = form.format(name=name, called="(?: licen[cs]e)?", version=number)
                groups = _need(keys, needs)
                out.append(Rule(_versioned(label, version), filled, groups, int(priority), float(weight)))
                if at and label in ("gpl", "lgpl", "agpl", "gfdl") and form.endswith("{version}"):
                    later = filled + r"(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?"
                    out.append(Rule(_versioned(label, version) + "-or-later", later, (*groups, *_need("later")), int(priority) + 1, float(weight)))
    return out


def _commons() -> list[Rule]:
    out = []
    for kind in _COMMONS:
        parts = kind.split("-")
        short = f"(?:cc|creative commons) {' '.join(parts)}"
        long = f"creative commons {' '.join(_PARTS[p] for p in parts)}"
        for version in ("", *_COMMONS_VERSIONS):
            at = f" {_number(version)}(?: (?:international|unported|generic))?(?: licen[cs]e)?" if version else ""
            label = _versioned(f"cc-{kind}", version)
            # A version makes the name clear; without one it needs a license's word.
            lead = "" if version else "(?:licensed|released|published|shared|available) under (?:an? |the )?"
            out.append(Rule(label, f"{lead}{short}{at}", _need("cc commons", "by"), 3, 0.95))
            out.append(Rule(label, f"{long}{at}", _need("commons"), 3, 0.95))
            url = f"creativecommons org licenses {' '.join(parts)}{' ' + version.replace('.', ' ') if version else ''}"
            out.append(Rule(label, url, _need("creativecommons"), 3, 0.9))
    return out


def rules() -> list[Rule]:
    """All rules, in their order: the phrases to count, sentences, named licenses."""
    base = [Rule(label, phrase, tuple(_need(*phrase.split())), 2, 0.9, True) for label, phrase in BASE]
    texts = [Rule(label, words.replace("~", _GAP), _need(needs), 3 if len(words) > 40 else 2, 0.9 if len(words) > 40 else 0.8) for label, needs, words in _lines(TEXTS, 3)]
    return [*base, *texts, *_named(), *_commons()]
