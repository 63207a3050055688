"""License signatures: ordered rules over the words of a text.

Rules see the text as lower-case words (runs of 0-9, a-z and non-ASCII) with one
space between, so "Apache License, Version 2.0" reads ``apache license version
2 0``. A rule has a label, a priority and a regular expression; its keyword, a
word or phrase that every match contains, is what the prefilter looks for.

Priorities: 4 an explicit identifier or grant, 3 a license named with its
version or its own wording, 2 a license named alone, 1 a bare notice. A
detection that lies inside another of the same or a higher priority is
suppressed; the order of the rules decides between equal ones.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


_GRANT = r"(?:licensed|released|distributed|available|published|provided|covered|made available)(?: \S+){0,3}? under(?: the)?(?: terms of)?(?: the)?"

# label | names as they read in words (alternatives) | keyword of the names
_NAMED = r"""
apache-2.0 | apache(?: software)? license(?: version)? 2(?: 0)?|apache 2(?: 0)?(?: license)? | apache
apache-1.1 | apache(?: software)? license(?: version)? 1 1 | apache
apache-1.0 | apache(?: software)? license(?: version)? 1 0 | apache
mit | mit license|mit licence|the mit x11 license | mit
x11 | x11 license|x consortium license | x
isc | isc license|internet systems consortium license | license
bsd-0-clause | bsd zero clause(?: license)?|0 clause bsd(?: license)? | bsd
bsd-2-clause | (?:2|two) clause bsd(?: license)?|bsd (?:2|two) clause(?: license)?|simplified bsd license|freebsd license | bsd
bsd-3-clause | (?:3|three) clause bsd(?: license)?|bsd (?:3|three) clause(?: license)?|(?:new|modified|revised) bsd license | bsd
bsd-4-clause | (?:4|four) clause bsd(?: license)?|bsd (?:4|four) clause(?: license)?|original bsd license | bsd
gpl-1.0 | (?:gnu )?general public license(?: version)? 1(?: 0)?|gpl ?v?1(?: 0)? | g
gpl-2.0 | (?:gnu )?general public license(?: version| v)? 2(?: 0)?|gpl(?: version)? v?2(?: 0)?|gplv2 | g
gpl-3.0 | (?:gnu )?general public license(?: version| v)? 3(?: 0)?|gpl(?: version)? v?3(?: 0)?|gplv3 | g
lgpl-2.0 | (?:gnu )?library general public license(?: version| v)? 2(?: 0)?|lgpl(?: version)? v?2 0 | l
lgpl-2.1 | (?:gnu )?lesser general public license(?: version| v)? 2 1|lgpl(?: version)? v?2 1|lgplv2 1 | l
lgpl-3.0 | (?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?|lgpl(?: version)? v?3(?: 0)?|lgplv3 | l
agpl-1.0 | affero general public license(?: version| v)? 1(?: 0)? | affero
agpl-3.0 | (?:gnu )?affero general public license(?: version| v)? 3(?: 0)?|agpl(?: version)? v?3(?: 0)?|agplv3 | a
fdl-1.1 | (?:gnu )?free documentation license(?: version)? 1 1|gfdl 1 1 | f
fdl-1.2 | (?:gnu )?free documentation license(?: version)? 1 2|gfdl 1 2 | f
fdl-1.3 | (?:gnu )?free documentation license(?: version)? 1 3|gfdl 1 3 | f
mpl-1.0 | mozilla public license(?: version| v)? 1 0|mpl 1 0 | m
mpl-1.1 | mozilla public license(?: version| v)? 1 1|mpl 1 1 | m
mpl-2.0 | mozilla public license(?: version| v)? 2(?: 0)?|mpl v?2(?: 0)? | m
epl-1.0 | eclipse public license(?: version| v)? 1(?: 0)?|epl v?1(?: 0)? | e
epl-2.0 | eclipse public license(?: version| v)? 2(?: 0)?|epl v?2(?: 0)? | e
edl-1.0 | eclipse distribution license(?: version| v)? 1(?: 0)? | eclipse
cpl-1.0 | common public license(?: version| v)? 1(?: 0)? | common public
ipl-1.0 | ibm public license(?: version| v)? 1(?: 0)? | ibm
cddl-1.0 | common development and distribution license(?: version| v)? 1 0|cddl(?: version)? 1 0 | c
cddl-1.1 | common development and distribution license(?: version| v)? 1 1|cddl(?: version)? 1 1 | c
eupl-1.1 | european union public licen[cs]e(?: version| v)? 1 1|eupl 1 1 | e
eupl-1.2 | european union public licen[cs]e(?: version| v)? 1 2|eupl 1 2 | e
osl-3.0 | open software license(?: version| v)? 3(?: 0)? | open software
afl-3.0 | academic free license(?: version| v)? 3(?: 0)? | academic free
artistic-1.0 | (?:perl )?artistic license(?: version)? 1(?: 0)? | artistic
artistic-2.0 | (?:perl )?artistic license(?: version)? 2(?: 0)? | artistic
python-2.0 | python(?: software foundation)? license(?: version)? 2(?: 0)?|psf license(?: version)? 2(?: 0)? | license
php-3.0 | php license(?: version)? 3 0 | php
php-3.01 | php license(?: version)? 3 01 | php
zpl-2.1 | zope public license(?: version)? 2 1|zpl 2 1 | zp
qpl-1.0 | q public license(?: version)? 1(?: 0)? | q public
boost-1.0 | boost software license(?: version)? 1(?: 0)? | boost
ms-pl | microsoft public license | microsoft
ms-rl | microsoft reciprocal license | microsoft
apsl-2.0 | apple public source license(?: version)? 2(?: 0)? | apple
ncsa | university of illinois ncsa open source license|ncsa open source license | ncsa
zlib | zlib license|zlib libpng license | zlib
libpng | libpng license | libpng
openssl | openssl license | openssl
curl | curl license | curl
ijg | independent jpeg group license|ijg license | license
unlicense | the unlicense|unlicense license | unlicense
wtfpl | do what the fuck you want to public license|wtfpl(?: version 2)? | w
beerware | beer ware license|beerware license | beer
json | json license | json
ofl-1.0 | (?:sil )?open font license(?: version)? 1 0 | open font
ofl-1.1 | (?:sil )?open font license(?: version)? 1 1 | open font
odbl-1.0 | open database license(?: version| v)? 1(?: 0)?|odbl(?: 1 0)? | o
odc-by-1.0 | open data commons attribution license|odc by(?: 1 0)? | o
pddl-1.0 | public domain dedication and license|pddl(?: 1 0)? | p
cdla-permissive | community data license agreement permissive(?: 1 0| 2 0)? | community data
cdla-sharing | community data license agreement sharing(?: 1 0)? | community data
ogl-uk-1.0 | open government licen[cs]e(?: v| version)? ?1 0 | open government
ogl-uk-2.0 | open government licen[cs]e(?: v| version)? ?2 0 | open government
ogl-uk-3.0 | open government licen[cs]e(?: v| version)? ?3 0 | open government
etalab-2.0 | etalab open licen[cs]e 2 0|licence ouverte 2 0 | e
bsl-1.1 | business source license(?: 1 1)? | business source
sspl-1.0 | server side public license(?: version 1| v1)? | server side
elastic-2.0 | elastic license(?: 2 0| v2)? | elastic
polyform-nc | polyform noncommercial license(?: 1 0 0)? | polyform
mulan-2.0 | mulan psl v?2|mulan permissive software license v2 | mulan
upl-1.0 | universal permissive license(?: version| v)? 1(?: 0)? | universal permissive
vim | vim license | vim
ruby | ruby license | ruby
postgresql | postgresql license | postgresql
w3c | w3c software(?: notice and)? license | w3c
unicode | unicode(?: license agreement| license v3) | unicode
lppl-1.3c | latex project public license(?: version)? 1 3c? | latex
cecill-2.1 | cecill(?: version)? 2 1 | cecill
cecill-b | cecill b | cecill
cecill-c | cecill c | cecill
rail | (?:open|creativeml open|bigscience) rail(?: m)?(?: license)? | rail
llama | llama(?: \d)* community license agreement | llama
"""

# label | priority | keyword | pattern: wording of a license, names without a version, and notices
_WORDING = r"""
mit | 3 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy
mit | 3 | without restriction | deal in the software without restriction
isc | 3 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose
bsd | 3 | redistribution and use | redistribution and use in source and binary forms with or without modification
bsd-3-clause | 3 | neither the name | neither the names? of (?:\S+ ){1,12}?nor the names of its contributors
bsd-4-clause | 3 | advertising materials | all advertising materials mentioning features or use of this software
zlib | 3 | as is without any express | this software is provided as is without any express or implied warranty
boost-1.0 | 3 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person or organization
unlicense | 3 | free and unencumbered | this is free and unencumbered software released into the public domain
gpl | 3 | free software | this (?:program|library) is free software you can redistribute it and or modify
gpl-or-later | 3 | any later version | (?:either version|version) \d(?: \d)?(?: of the license)? or at your option any later version
apache-2.0 | 3 | you may not use this file | you may not use this file except in compliance with the license
mpl-2.0 | 3 | this source code form | this source code form is subject to the terms of the mozilla public license
epl | 3 | this program and the accompanying | this program and the accompanying materials are made available
cc0-1.0 | 3 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 3 | public domain dedication | public domain dedication
wtfpl | 3 | do what the fuck | you just do what the fuck you want to
beerware | 3 | buy me a beer | you can buy me a beer in return
json | 3 | for good not evil | shall be used for good not evil
apache | 2 | apache | apache(?: software)? license
bsd | 2 | bsd | bsd(?: style)? licen[cs]e
mit | 2 | mit | mit style licen[cs]e
gpl | 2 | general public licen | (?:gnu )?general public licen[cs]e
gpl | 2 | gpl | (?:gnu )?gpl
lgpl | 2 | general public licen | (?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl | 2 | lgpl | (?:gnu )?lgpl
agpl | 2 | affero | (?:gnu )?affero general public licen[cs]e
agpl | 2 | agpl | (?:gnu )?agpl
fdl | 2 | free documentation | (?:gnu )?free documentation licen[cs]e
mpl | 2 | mozilla | mozilla public licen[cs]e
epl | 2 | eclipse | eclipse public licen[cs]e
cddl | 2 | cddl | cddl
eupl | 2 | eupl | eupl
artistic | 2 | artistic | artistic licen[cs]e
python | 2 | python | python(?: software foundation)? licen[cs]e
php | 2 | php | php licen[cs]e
boost | 2 | boost | boost(?: software)? licen[cs]e
ofl | 2 | open font | (?:sil )?open font licen[cs]e
ogl-uk | 2 | open government | open government licen[cs]e
odbl | 2 | open database | open database licen[cs]e
creative-commons | 2 | creative commons | creative commons(?: public)?(?: licen[cs]e)?
public-domain | 2 | public domain | (?:in|into|to) the public domain|public domain
copyleft | 2 | copyleft | copyleft
proprietary | 2 | proprietary | proprietary and confidential|confidential and proprietary|proprietary licen[cs]e
commercial | 2 | commercial licen | commercial licen[cs]e
royalty-free | 2 | royalty free | royalty free licen[cs]e
non-commercial | 2 | commercial | (?:for )?non ?commercial use only|non ?commercial purposes
no-derivatives | 2 | derivative | no derivative works|noderivatives
share-alike | 2 | alike | share ?alike
evaluation | 2 | evaluation | for evaluation purposes only|evaluation licen[cs]e
shareware | 2 | shareware | shareware
freeware | 2 | freeware | freeware
eula | 2 | user licen | end user licen[cs]e agreement
all-rights | 1 | rights reserved | all rights reserved
some-rights | 1 | rights reserved | some rights reserved
no-rights | 1 | rights reserved | no rights reserved
copyright | 1 | copyright | copyright(?: c)?(?: \d{4})+
copyright | 1 | copyright | copyright(?: \S+){1,4}? all rights reserved
trademark | 1 | trademark | (?:registered )?trademarks? of
no-warranty | 1 | warrant | without warrant(?:y|ies)(?: of any kind| or conditions of any kind)?
as-is | 1 | as is | (?:provided|distributed) (?:on an )?as is(?: basis)?
permission | 1 | permission | (?:reproduced|reprinted|used|distributed)? ?without (?:prior )?(?:written )?permission|with permission|by permission
license-file | 1 | license | see (?:the )?license(?: file| txt| md)?(?: for details| for more information)?
licensed | 1 | licensed under | licensed under(?: the)? \S+
license | 1 | agreement | licen[cs]e agreement
redistribution | 1 | redistribut | (?:may|can|must) not be redistributed|redistribution (?:is )?(?:prohibited|permitted)
"""

# Creative Commons kinds: label part, short form, spelled form.
_CC_KINDS = [
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nd", "by nd", "attribution no ?deriv(?:atives|s)?"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:atives|s)?"),
]
_CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]


def _rules() -> list[Rule]:
    out = []
    for line in filter(None, _NAMED.split("\n")):
        label, rest = line.split(" | ", 1)
        names, keyword = rest.rsplit(" | ", 1)
        keyword = keyword.strip() if len(keyword.strip()) > 2 else ""
        out.append(Rule(label, 3, keyword, f"(?:{names.strip()})"))
        out.append(Rule(label, 4, "under" if not keyword else keyword, f"{_GRANT} (?:{names.strip()})"))
        out.append(Rule(label, 4, "spdx license identifier", f"spdx license identifier {label.replace('.', ' ').replace('-', ' ')}"))
    for kind, short, spelled in _CC_KINDS:
        for version in _CC_VERSIONS:
            label = f"cc-{kind}-{version.replace(' ', '.')}"
            out.append(Rule(label, 3, f"cc {short}", f"cc {short} {version}"))
            out.append(Rule(label, 4, f"cc {short}", f"{_GRANT} cc {short} {version}"))
            out.append(Rule(label, 3, "creative commons", f"creative commons {spelled} {version}"))
            out.append(Rule(label, 4, "creativecommons", f"creativecommons org licenses {short} {version}"))
        out.append(Rule(f"cc-{kind}", 2, f"cc {short}", f"cc {short}"))
        out.append(Rule(f"cc-{kind}", 2, "creative commons", f"creative commons {spelled}"))
    for line in filter(None, _WORDING.split("\n")):
        label, priority, keyword, pattern = line.split(" | ", 3)
        out.append(Rule(label, int(priority), keyword, f"(?:{pattern.strip()})"))
    return out


RULES = _rules()

#: Every match of a rule or phrase contains one of these parts of words; texts with none of them are not searched.
GATES = """
licen cc gpl reserved copyright copyleft apache public permission restrict redistribut commons spdx warrant propriet commercial deriv
alike evaluation shareware freeware trademark bsd mpl epl cddl eupl cecill rail odbl pddl odc mulan beer contributors advertising
software provided distributed wtfpl fuck evil accompanying version gfdl zpl
""".split()
PRIORITIES = sorted({r.priority for r in RULES})

#: Words whose places are counted as the base of a scan, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
