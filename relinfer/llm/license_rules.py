"""Ordered signature rules of the license scan: data and how rules are made of it.

Rules are regular expressions over a document's lower-cased words, joined by single
spaces, with a space in front and behind. `key` is a literal that every match holds, and
`root` one of ROOTS that the key holds: documents without any root are not looked at.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

# Parts of words, one of which every rule's key holds.
ROOTS = [
    "licen", "gpl", "copyright", "copyleft", "domain", "warrant", "permission", "redistribut", "creative",
    "clause", "mozilla", "reserved", "proprietary", "wtfpl", "cc0", "cc by", "unencumbered", "sspl",
]

# Label, then the names a license goes by, as words.
NAMES = """
gpl: gnu general public license; general public license; gnu gpl; gpl license; gplv2; gplv3; gpl v2; gpl v3; gpl 2 0; gpl 3 0
lgpl: gnu lesser general public license; gnu library general public license; lesser general public license; gnu lgpl; lgpl license; lgplv2; lgplv3; lgpl 2 1; lgpl 3 0
agpl: gnu affero general public license; affero general public license; gnu agpl; agplv3; agpl 3 0
gfdl: gnu free documentation license; free documentation license
apache: apache license; apache software license; apache 2 0 license; asl 2 0 license
mit: mit license; mit x11 license; x11 license; expat license; mit style license
bsd: bsd license; new bsd license; simplified bsd license; modified bsd license; bsd style license; bsd 2 clause; bsd 3 clause; bsd 4 clause; 2 clause bsd; 3 clause bsd
isc: isc license; internet systems consortium license
mpl: mozilla public license; mpl 2 0 license; mpl license
epl: eclipse public license; epl 2 0 license
cddl: common development and distribution license; cddl license
cpl: common public license
artistic: artistic license; perl artistic license
zlib: zlib license; zlib libpng license
boost: boost software license
python: python software foundation license; psf license
php: php license
ruby: ruby license
unlicense: unlicense; the unlicense
wtfpl: do what the fuck you want to public license; wtfpl
eupl: european union public license; eupl license
ofl: sil open font license; open font license
bsl: business source license
sspl: server side public license; sspl
elastic: elastic license
ms-pl: microsoft public license; ms pl license
ms-rl: microsoft reciprocal license
osl: open software license
afl: academic free license
upl: universal permissive license
ncsa: university of illinois ncsa open source license; ncsa open source license
postgresql: postgresql license
openssl: openssl license
cecill: cecill free software license; cecill license
odbl: open database license; odbl license
pddl: public domain dedication and license
cc0: cc0 1 0; cc0 license; creative commons zero
cc-by: cc by; creative commons attribution
cc-by-sa: cc by sa; creative commons attribution sharealike; creative commons attribution share alike
cc-by-nc: cc by nc; creative commons attribution noncommercial; creative commons attribution non commercial
cc-by-nd: cc by nd; creative commons attribution noderivatives; creative commons attribution no derivatives
cc-by-nc-sa: cc by nc sa; creative commons attribution noncommercial sharealike
cc-by-nc-nd: cc by nc nd; creative commons attribution noncommercial noderivatives
"""

# Label, root, expression over words of a license's or notice's own text.
TEXTS = """
mit: permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?
mit: the above copyright notice and this permission notice shall be included in all copies
mit: the software is provided as is without warranty of any kind
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd: redistributions of source code must retain the above copyright notice
bsd: redistributions in binary form must reproduce the above copyright notice
bsd: neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse or promote [^ ]+(?: [^ ]+){0,9} permission
gpl: this program is free software you can redistribute it and or modify it
gpl: this program is distributed in the hope that it will be useful but without any warranty
gpl: either version [123] of the licen[sc]e or at your option any later version
lgpl: this library is free software you can redistribute it and or modify it
apache: unless required by applicable law or agreed to in writing software distributed under the licen[sc]e
apache: you may not use this file except in compliance with the licen[sc]e
apache: www apache org licenses license 2 0
gpl: www gnu org licenses(?: old licenses)?(?: gpl[^ ]*)?
mit: opensource org licenses mit
bsd: opensource org licenses bsd [234] clause
cc-by: creativecommons org licenses by [1-4] [0-9]
cc-by-sa: creativecommons org licenses by sa [1-4] [0-9]
cc-by-nc: creativecommons org licenses by nc [1-4] [0-9]
cc-by-nd: creativecommons org licenses by nd [1-4] [0-9]
cc0: creativecommons org publicdomain zero 1 0
unlicense: this is free and unencumbered software released into the public domain
zlib: this software is provided as is without any express or implied warranty
boost: permission is hereby granted free of charge to any person or organization obtaining a copy
public-domain: (?:released|dedicated|placed|put) (?:in|into|to) the public domain
public-domain: this (?:work|file|software|text|document) is in the public domain
proprietary: all rights reserved
proprietary: (?:proprietary and confidential|confidential and proprietary)
proprietary: unauthorized copying of this file via any medium is strictly prohibited(?: [^ ]+){0,4} proprietary
proprietary: no part of this (?:work|book|publication|document) may be reproduced(?: [^ ]+){0,30} permission
copyright: copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyleft: (?:this is a )?copyleft licen[sc]e
warranty: without (?:any )?warrant(?:y|ies) of any kind
"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    key: str
    regex: str


def _key(name: str) -> str:
    """The literal of a name in either spelling of "license"."""
    at = name.find("license")
    return name if at < 0 else name[: at + len("licen")]


def _literal(expression: str) -> str:
    """The root that stands in an expression over words, as its key."""
    plain = expression.replace("licen[sc]e", "licen").replace("publicdomain", "public domain")
    found = [r for r in ROOTS if r in plain]
    if not found:
        raise ValueError(f"no root in {expression}")
    return found[0]


def _rules() -> list[Rule]:
    rules = []
    for line in TEXTS.strip().splitlines():
        label, regex = line.split(": ", 1)
        rules.append(Rule(label, 1, 0.95, _literal(regex), regex))
    number = "(?: [0-9]+){0,2}"
    version = f"(?: (?:version|ver|v)(?: ?[0-9]+){{1,3}}| v?[0-9]+{number})"
    later = "(?: (?:only|or later|or any later version|or newer))?"
    for line in NAMES.strip().splitlines():
        label, names = line.split(": ", 1)
        for name in names.split("; "):
            word = name.replace("license", "licen[sc]e")
            key = _key(name)
            lead = (
                "(?:licen[sc]ed|released|distributed|published|available|provided|covered|used)"
                " (?:under|by|with|subject to|according to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
            )
            rules += [
                Rule(label, 2, 0.95, key, f"{lead}{word}(?: licen[sc]e)?{version}?{later}"),
                Rule(label, 2, 1.0, key, f"spdx licen[sc]e identifier {word}{version}?{later}"),
                Rule(label, 3, 0.85, key, f"{word}(?: licen[sc]e)?{version}{later}"),
                Rule(label, 4, 0.7, key, word),
            ]
    return rules


RULES = _rules()


def rule_rows() -> list[dict]:
    """Rules in order, with the word limits around their expressions."""
    return [asdict(r) | {"regex": f" {r.regex}(?= )", "number": k} for k, r in enumerate(RULES)]
