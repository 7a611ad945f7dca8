"""Hand-written licence signatures.

``NAMES`` has one line per licence: label, keywords that a text must hold before any
of its regexes runs (all of them), and regexes of its name in lower-cased text.
Every name takes part in ordered rules: a notice ("licensed under ..."), a notice with
"by" ("covered by the ... licence"), a mention next to the word licence, and the bare name where it is
distinctive.  ``TEXTS`` has sentences that stand only in the licences themselves, each written on its own, and
``SPDX`` the machine-readable form.  A higher priority goes first.  A name ends where its word ends.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

V = r"(?:,?\s*(?:version|v\.?|ver\.?)\s*|[\s-]*v?)"
LATER = r"(?:\s*(?:,?\s*or\s*(?:\(at your option\)\s*)?(?:any\s+)?later(?:\s+version)?|\+))"
GNU = r"(?:the\s+)?(?:gnu\s+)?"

#: label | keywords | name | bare: the name alone is distinctive (y) or not (n)
NAMES = rf"""
gpl-1.0 | general public licen | {GNU}general public licen[sc]e{V}1(?:\.0)?\b | y
gpl-2.0 | general public licen | {GNU}general public licen[sc]e{V}2(?:\.0)?\b | y
gpl-2.0-or-later | general public licen, later | {GNU}general public licen[sc]e{V}2(?:\.0)?{LATER} | y
gpl-3.0 | general public licen | {GNU}general public licen[sc]e{V}3(?:\.0)?\b | y
gpl-3.0-or-later | general public licen, later | {GNU}general public licen[sc]e{V}3(?:\.0)?{LATER} | y
gpl-1.0 | gpl | gpl{V}1(?:\.0)?\b | y
gpl-2.0 | gpl | gpl{V}2(?:\.0)?\b | y
gpl-2.0-or-later | gpl | gpl{V}2(?:\.0)?{LATER} | y
gpl-3.0 | gpl | gpl{V}3(?:\.0)?\b | y
gpl-3.0-or-later | gpl | gpl{V}3(?:\.0)?{LATER} | y
gpl | general public licen | {GNU}general public licen[sc]e | y
gpl | gpl | gpl | y
lgpl-2.0 | library general public licen | {GNU}library general public licen[sc]e(?:{V}2(?:\.0)?)?\b | y
lgpl-2.1 | lesser general public licen | {GNU}lesser general public licen[sc]e{V}2\.1\b | y
lgpl-3.0 | lesser general public licen | {GNU}lesser general public licen[sc]e{V}3(?:\.0)?\b | y
lgpl-2.1 | lgpl | lgpl{V}2\.1\b | y
lgpl-3.0 | lgpl | lgpl{V}3(?:\.0)?\b | y
lgpl | lesser general public licen | {GNU}lesser general public licen[sc]e | y
lgpl | lgpl | \blgpl\b | y
agpl-3.0 | affero | {GNU}affero general public licen[sc]e(?:{V}3(?:\.0)?)?\b | y
agpl-3.0 | agpl | \bagpl{V}3(?:\.0)?\b | y
agpl | agpl | \bagpl\b | y
gfdl-1.2 | free documentation licen | {GNU}free documentation licen[sc]e{V}1\.2\b | y
gfdl-1.3 | free documentation licen | {GNU}free documentation licen[sc]e{V}1\.3\b | y
gfdl | free documentation licen | {GNU}free documentation licen[sc]e | y
apache-1.0 | apache | apache(?:\s+software)?\s+licen[sc]e{V}1\.0\b | y
apache-1.1 | apache | apache(?:\s+software)?\s+licen[sc]e{V}1\.1\b | y
apache-2.0 | apache | apache(?:\s+software)?\s+licen[sc]e{V}2(?:\.0)?\b | y
apache-2.0 | apache | apache{V}2(?:\.0)?\b | y
apache | apache | apache(?:\s+software)?\s+licen[sc]e | y
mit | licen | mit(?:/x11|/expat|\s+x11|\s+expat)? | n
mit-0 | mit-0 | \bmit-0\b | y
mit-0 | attribution | mit no attribution | y
x11 | x11 | x11 | n
expat | expat | expat | n
bsd-2-clause | bsd | (?:2|two)[\s-]*clause\s+bsd | y
bsd-2-clause | bsd | bsd[\s-]*(?:2|two)[\s-]*clause | y
bsd-2-clause | bsd | simplified bsd | y
bsd-2-clause | freebsd | freebsd | n
bsd-3-clause | bsd | (?:3|three)[\s-]*clause\s+bsd | y
bsd-3-clause | bsd | bsd[\s-]*(?:3|three)[\s-]*clause | y
bsd-3-clause | bsd | (?:new|modified|revised) bsd | y
bsd-4-clause | bsd | (?:4|four)[\s-]*clause\s+bsd | y
bsd-4-clause | bsd | bsd[\s-]*(?:4|four)[\s-]*clause | y
bsd-4-clause | bsd | original bsd | y
0bsd | 0bsd | \b0bsd\b | y
0bsd | bsd | zero[\s-]*clause\s+bsd | y
bsd | bsd | (?:berkeley\s+)?bsd(?:[\s-]style)? | n
isc | licen | isc | n
mpl-1.0 | mozilla | mozilla public licen[sc]e{V}1\.0\b | y
mpl-1.1 | mozilla | mozilla public licen[sc]e{V}1\.1\b | y
mpl-2.0 | mozilla | mozilla public licen[sc]e{V}2(?:\.0)?\b | y
mpl-1.1 | mpl | \bmpl{V}1\.1\b | y
mpl-2.0 | mpl | \bmpl{V}2(?:\.0)?\b | y
mpl | mozilla | mozilla public licen[sc]e | y
epl-1.0 | eclipse | eclipse public licen[sc]e{V}1(?:\.0)?\b | y
epl-2.0 | eclipse | eclipse public licen[sc]e{V}2(?:\.0)?\b | y
epl | eclipse | eclipse public licen[sc]e | y
edl-1.0 | eclipse | eclipse distribution licen[sc]e(?:{V}1(?:\.0)?)? | y
cpl-1.0 | common public licen | common public licen[sc]e(?:{V}1(?:\.0)?)? | y
ipl-1.0 | ibm public licen | ibm public licen[sc]e(?:{V}1(?:\.0)?)? | y
cddl-1.0 | common development | common development and distribution licen[sc]e(?:{V}1\.0)? | y
cddl-1.1 | common development | common development and distribution licen[sc]e{V}1\.1\b | y
cddl-1.0 | cddl | \bcddl{V}1(?:\.0)?\b | y
cddl | cddl | \bcddl\b | y
eupl-1.1 | european union public | european union public licen[sc]e{V}1\.1\b | y
eupl-1.2 | european union public | european union public licen[sc]e{V}1\.2\b | y
eupl | eupl | \beupl\b | y
artistic-1.0 | artistic licen | artistic licen[sc]e{V}1(?:\.0)?\b | y
artistic-2.0 | artistic licen | artistic licen[sc]e{V}2(?:\.0)?\b | y
artistic | artistic licen | (?:perl\s+)?artistic licen[sc]e | y
perl | same terms as perl | (?:under\s+)?the same terms as perl(?: itself)? | y
python-2.0 | python | python software foundation licen[sc]e(?:{V}2(?:\.0)?)? | y
psf-2.0 | psf | \bpsf{V}2(?:\.0)?\b | y
php-3.0 | php licen | php licen[sc]e{V}3\.0\b | y
php-3.01 | php licen | php licen[sc]e{V}3\.01\b | y
php | php licen | php licen[sc]e | y
ruby | ruby licen | ruby licen[sc]e | y
zlib | zlib | zlib(?:/libpng)? | n
libpng | libpng | libpng(?:\s+licen[sc]e)? | n
openssl | openssl licen | openssl licen[sc]e | y
bsl-1.0 | boost | boost software licen[sc]e(?:{V}1(?:\.0)?)? | y
unlicense | unlicen | (?:the\s+)?unlicen[sc]e\b | y
wtfpl | wtfpl | \bwtfpl\b | y
wtfpl | what the fuck | do what the fuck you want(?: to)? public licen[sc]e | y
beerware | beer | beer[\s-]?ware(?:\s+licen[sc]e)? | y
postgresql | postgresql licen | postgresql licen[sc]e | y
ncsa | illinois | university of illinois/ncsa(?: open source)? licen[sc]e | y
ofl-1.1 | open font | (?:sil\s+)?open font licen[sc]e(?:{V}1\.1)? | y
ofl-1.0 | open font | (?:sil\s+)?open font licen[sc]e{V}1\.0\b | y
ms-pl | microsoft public | microsoft public licen[sc]e | y
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e | y
ms-pl | ms-pl | \bms-pl\b | y
osl-3.0 | open software licen | open software licen[sc]e(?:{V}3(?:\.0)?)? | y
afl-3.0 | academic free | academic free licen[sc]e(?:{V}3(?:\.0)?)? | y
afl-2.1 | academic free | academic free licen[sc]e{V}2\.1\b | y
ecl-2.0 | educational community | educational community licen[sc]e(?:{V}2(?:\.0)?)? | y
upl-1.0 | universal permissive | universal permissive licen[sc]e(?:{V}1(?:\.0)?)? | y
qpl-1.0 | q public | q public licen[sc]e(?:{V}1(?:\.0)?)? | y
lppl-1.3c | latex project | latex project public licen[sc]e(?:{V}1\.3c?)? | y
odc-by-1.0 | open data commons | open data commons attribution licen[sc]e(?:{V}1(?:\.0)?)? | y
odbl-1.0 | open database | open (?:data commons open )?database licen[sc]e(?:{V}1(?:\.0)?)? | y
odbl-1.0 | odbl | \bodbl\b | y
pddl-1.0 | public domain dedication | open data commons public domain dedication(?: and licen[sc]e)? | y
pddl-1.0 | pddl | \bpddl\b | y
cdla-permissive-2.0 | community data | community data licen[sc]e agreement[\s,-]*permissive(?:{V}2(?:\.0)?)? | y
cdla-sharing-1.0 | community data | community data licen[sc]e agreement[\s,-]*sharing(?:{V}1(?:\.0)?)? | y
sspl-1.0 | server side public | server side public licen[sc]e(?:{V}1(?:\.0)?)? | y
sspl-1.0 | sspl | \bsspl\b | y
busl-1.1 | business source | business source licen[sc]e(?:{V}1\.1)? | y
elastic-2.0 | elastic licen | elastic licen[sc]e(?:{V}2(?:\.0)?)? | y
polyform-nc-1.0 | polyform | polyform noncommercial(?: licen[sc]e)?(?:{V}1(?:\.0)?(?:\.0)?)? | y
bigscience-openrail-m | openrail | (?:bigscience\s+)?(?:creativeml\s+)?open\s?rail(?:\+\+)?(?:-m)?(?:\s+licen[sc]e)? | y
mulan-2.0 | mulan | mulan (?:permissive software|psl)(?: licen[sc]e)?(?:{V}2)? | y
cecill-2.1 | cecill | cecill(?:{V}2(?:\.1)?)? | y
cc0-1.0 | cc0 | \bcc0(?:[\s-]*1\.0)?(?:\s+universal)?\b | y
cc0-1.0 | creative commons zero | creative commons zero(?:{V}1\.0)? | y
cc-pdm | public domain mark | public domain mark(?:\s*1\.0)? | y
""".strip()

#: Creative Commons: code letters and words of each licence, longest first.
CC = """
cc-by-nc-nd | by[\\s-]nc[\\s-]nd | attribution[\\s-]*non[\\s-]?commercial[\\s-]*no[\\s-]?deriv(?:ative)?(?:s|\\s+works)?
cc-by-nc-sa | by[\\s-]nc[\\s-]sa | attribution[\\s-]*non[\\s-]?commercial[\\s-]*share[\\s-]?alike
cc-by-nc | by[\\s-]nc | attribution[\\s-]*non[\\s-]?commercial
cc-by-nd | by[\\s-]nd | attribution[\\s-]*no[\\s-]?deriv(?:ative)?(?:s|\\s+works)?
cc-by-sa | by[\\s-]sa | attribution[\\s-]*share[\\s-]?alike
cc-by | by | attribution
""".strip()
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: label | keyword | sentence of the licence's own text
TEXTS = r"""
mit | permission is hereby granted, free of charge | permission is hereby granted, free of charge, to any person obtaining a copy
mit | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions
isc | permission to use, copy, modify | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
isc | author disclaims all warranties | the author disclaims all warranties with regard to this software
mit | to deal in the software | to deal in the software without restriction,? including without limitation the rights
ncsa | to deal with the software | to deal with the software without restriction,? including without limitation the rights
x11 | except as contained in this notice | except as contained in this notice,? the names? of .{1,80}? shall not be used in advertising
json | used for good | the software shall be used for good,? not evil
hpnd | and its documentation for any purpose | permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
postgresql | without a written agreement | for any purpose,? without fee,? and without a written agreement is hereby granted
tcl | the authors hereby grant permission | the authors hereby grant permission to use, copy, modify,? distribute,? and license this software
bsd | redistributions of source code must | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary form must | redistributions in binary form must reproduce the above copyright notice
bsd | by the copyright holders and contributors | this software is provided by the copyright holders and contributors ["'“‘`]{0,2}as is
bsd | by the regents and contributors | this software is provided by the regents and contributors ["'“‘`]{0,2}as is
bsd-3-clause-clear | party's patent rights | no express or implied licen[sc]es to any party's patent rights are granted
sleepycat | how to obtain complete source code | redistributions in any form must be accompanied by information on how to obtain complete source code
apache-2.0 | unless required by applicable law | unless required by applicable law or agreed to in writing,? software distributed under the licen[sc]e is distributed on an
apache-2.0 | contributor license agreements | licen[sc]ed to the apache software foundation \(asf\) under one or more contributor license agreements
apache-2.0 | for use, reproduction | terms and conditions for use, reproduction,? and distribution
apache-1.1 | developed by the apache software | this product includes software developed by the apache software foundation
gpl | in the hope that it will be useful | (?:program|software) is distributed in the hope that it will be useful,? but without any warranty
lgpl | in the hope that it will be useful | library is distributed in the hope that it will be useful,? but without any warranty
lgpl | this library is free software | this library is free software[;,:]? you can redistribute it
gpl | received a copy of the gnu general | you should have received a copy of the gnu general public licen[sc]e
lgpl | received a copy of the gnu | you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
agpl-3.0 | received a copy of the gnu affero | you should have received a copy of the gnu affero general public licen[sc]e
agpl-3.0 | remote network interaction | remote network interaction; use with the gnu general public licen[sc]e
gpl | most software are designed | the licen[sc]es for most software are designed to take away your freedom
gpl-3.0 | copyleft license for software | is a free,? copyleft licen[sc]e for software and other kinds of works
lgpl-3.0 | incorporates the terms and conditions | incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e
gfdl | invariant sections | with no invariant sections,? (?:with )?no front-cover texts,? and (?:with )?no back-cover texts
gfdl | distribute and/or modify this document | copy, distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e
classpath-exception | linking this library statically | linking this library statically or dynamically with other modules is making a combined work
gcc-exception | gcc runtime library exception | gcc runtime library exception
mpl-1.1 | subject to the mozilla | the contents of this file are subject to the mozilla public licen[sc]e version 1\.1
mpl-2.0 | if a copy of the mpl | if a copy of the mpl was not distributed with this file
epl | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
cddl | subject to the terms of the common | the contents of this file are subject to the terms of the common development and distribution licen[sc]e
eupl | licensed under the eupl | licen[sc]ed under the eupl
cecill | governed by the cecill | this software is governed by the cecill
artistic-1.0 | intent of this document | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | use the standard version | you are permitted to use the standard version and create and use modified versions for any purpose without restriction
ruby | verbatim copies of the source form | you may make and give away verbatim copies of the source form of (?:the|this) software without restriction
python-2.0 | psf is making python | psf is making python available to licensee on an
php | includes php software | this product includes php software,? freely available from
openssl | openssl project for use | software developed by the openssl project for use in the openssl toolkit
ssleay | written by eric young | this product includes cryptographic software written by eric young
zlib | altered source versions | altered source versions must be plainly marked as such
zlib | origin of this software | the origin of this software must not be misrepresented
bsl-1.0 | person or organization obtaining | to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | anyone is free to copy | anyone is free to copy, modify, publish, use, compile, sell,? or distribute this software
beerware | you think this stuff is worth it | if we meet some ?day,? and you think this stuff is worth it,? you can buy me a beer
ofl-1.1 | this font software is licensed | this font software is licen[sc]ed under the sil open font licen[sc]e
ofl-1.1 | with reserved font name | with reserved font names?
ms-pl | if you bring a patent claim | if you bring a patent claim against any contributor over patents that you claim are infringed by the software
lppl-1.3c | conditions of the latex project | distributed and/or modified under the conditions of the latex project public licen[sc]e
cc0-1.0 | associated a work with this deed | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | neighboring rights | has waived all copyright and related or neighboring rights
cc-by | must give appropriate credit | you must give appropriate credit,? provide a link to the licen[sc]e,? and indicate if changes were made
odbl-1.0 | made available under the open database | is made available under the open database licen[sc]e
sspl-1.0 | to third parties as a service | make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
busl-1.1 | additional use grant | additional use grant\s*:
commons-clause | right to sell the software | the licen[sc]e does not grant to you,? (?:and you are not granted,? )?the right to sell the software
llama | llama materials | you (?:may|will) not use the llama materials
gemma | gemma is provided | gemma is provided under and subject to the gemma terms of use
w3c | w3c | w3c(?:®|\(r\))? (?:software|document)(?: and document)? (?:notice and )?licen[sc]e
unicode | unicode | unicode,? inc\.? licen[sc]e agreement
nasa-1.3 | nasa open source | nasa open source agreement
apsl-2.0 | apple public source | apple public source licen[sc]e
cpal-1.0 | common public attribution | common public attribution licen[sc]e
rpl-1.5 | reciprocal public licen | (?<!microsoft )reciprocal public licen[sc]e
sugarcrm | sugarcrm public | sugarcrm public licen[sc]e
ogl-3.0 | open government licen | open government licen[sc]e(?: v3\.0)?
etalab-2.0 | licence ouverte | licence ouverte
dl-de | datenlizenz deutschland | datenlizenz deutschland
bsd | redistribution and use in source | redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd-3-clause | endorse or promote | neither the names? of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
apache-2.0 | apache.org/licenses/license-2.0 | https?://www\.apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
apache-2.0 | you may not use this file except | you may not use this file except in compliance with the licen[sc]e
gpl | redistribute it and/or modify | you can redistribute it and/or modify\s+it under the terms of the gnu (?:general|lesser general|affero general) public licen[sc]e
gpl | gnu.org/licenses | https?://www\.gnu\.org/licenses/(?:gpl|lgpl|agpl|fdl)?[\w.\-]*
mpl-2.0 | mozilla.org/mpl | https?://(?:www\.)?mozilla\.org/mpl/2\.0
mpl-2.0 | subject to the terms of the mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e
bsl-1.0 | boost.org/license | https?://www\.boost\.org/license_1_0\.txt
unlicense | free and unencumbered | free and unencumbered software released into the public domain
zlib | in no event will the authors be held liable | this software is provided 'as-is', without any express or implied warranty
wtfpl | you just do what | you just do what the fuck you want to
cc0-1.0 | publicdomain/zero | https?://creativecommons\.org/publicdomain/zero/1\.0
cc-pdm | publicdomain/mark | https?://creativecommons\.org/publicdomain/mark/1\.0
epl-2.0 | eclipse.org/legal | https?://www\.eclipse\.org/legal/epl-(?:2\.0|v20)
epl-1.0 | eclipse.org/legal | https?://www\.eclipse\.org/legal/epl-v10
ofl-1.1 | scripts.sil.org/ofl | https?://scripts\.sil\.org/ofl
public-domain | public domain | (?:(?:is|are|in|into|to)\s+the\s+public domain|dedicated to the public domain)
proprietary | proprietary and confidential | proprietary and confidential
proprietary | unauthorized copying | unauthorized copying of this (?:file|document|work)
reserved | rights reserved | all rights (?:are\s+)?reserved
reserved | rechte vorbehalten | alle rechte vorbehalten
reserved | droits r | tous droits r[ée]serv[ée]s
reserved | derechos reservados | todos los derechos reservados
some-rights-reserved | some rights reserved | some rights reserved
copyright | copyright | copyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d(?:\s*[-–,]\s*(?:19|20)?\d\d)*
copyright | © | ©\s*(?:19|20)\d\d(?:\s*[-–,]\s*(?:19|20)?\d\d)*
copyright | (c) | \(c\)\s+(?:copyright\s+)?(?:19|20)\d\d
no-redistribution | not be reproduced | (?:may|must|shall) not be reproduced(?:,? (?:distributed|transmitted|copied))?
personal-use | personal use only | for personal(?:,? non-?commercial)? use only
non-commercial | non-commercial | for non-?commercial (?:use|purposes)(?: only)?
""".strip()

#: Labels of weak sentences.
WEAK = {"copyright", "reserved", "some-rights-reserved", "public-domain", "non-commercial", "personal-use"}

SPDX = r"spdx-license-identifier:\s*\(?([a-z0-9][a-z0-9.+\-]*)"


@dataclass(frozen=True)
class Rule:
    """One signature; ``label`` None: the first group names the licence."""

    label: str | None
    priority: int
    keywords: tuple[str, ...]
    pattern: str

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.S)


def _lines(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in table.split("\n")]


def rules() -> list[Rule]:
    """All rules, highest priority first; equal priorities in the order written."""
    done = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed|offered)\s+(?:\w+\s+){0,2}?"
    terms = r"\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?)?"
    out = [Rule(None, 95, ("spdx-license-identifier",), SPDX)]
    for label, words, pattern in _lines(TEXTS):
        out.append(Rule(label, 60 if label in WEAK else 80, (words,), pattern))
    for label, words, name, bare in _lines(NAMES):
        need = tuple(words.split(", "))
        tail = r"\s+(?:public\s+|software\s+)?licen[sc]e"
        out.append(Rule(label, 90, (*need, "under"), rf"\b{done}under{terms}{name}(?:{tail})?(?!\w)"))
        # "published by mit" names a publisher: here the word licence has to follow
        out.append(Rule(label, 90, (*need, "licen", " by "), rf"\b{done}by{terms}{name}{tail}s?(?!\w)"))
        out.append(Rule(label, 70, (*need, "licen"), rf"\b(?:{name}\s+licen[sc]e|licen[sc]e\s*[:=]\s*[\"']?{name})(?![\w-])"))
        if bare == "y":
            out.append(Rule(label, 50, need, rf"(?<![\w-]){name}(?![\w-])"))
    for label, letters, words in _lines(CC):
        for version in CC_VERSIONS:
            v = re.escape(version)
            out.append(Rule(f"{label}-{version}", 85, ("cc", version), rf"\bcc[\s-]+{letters}[\s-]+(?:version\s+|v\.?\s*)?{v}\b"))
            out.append(Rule(f"{label}-{version}", 85, ("creative commons", version), rf"creative commons[\s,-]+{words}[\s,-]+(?:(?:international|unported|generic)\s+)?(?:public\s+)?(?:licen[sc]e,?\s+)?(?:version\s+|v\.?\s*)?{v}\b"))
            out.append(Rule(f"{label}-{version}", 88, ("creativecommons.org/licenses", version), rf"https?://creativecommons\.org/licenses/{label[3:]}/{v}"))
        out.append(Rule(label, 65, ("cc",), rf"\bcc[\s-]+{letters}\b"))
        out.append(Rule(label, 65, ("creative commons",), rf"creative commons[\s,-]+{words}"))
    return sorted(out, key=lambda r: -r.priority)
