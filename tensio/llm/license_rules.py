"""The ordered signature rules of the license scan.

A rule is a line ``label | gate | pattern``; its section gives its priority.  Patterns are
regular expressions over words, not characters: letters, digits, ``[ab]`` and ``x?`` make up
one word, a blank separates words, ``( | )`` groups, ``( )?`` is optional and ``<n>`` stands
for at most ``n`` words of any kind.  The gate is one or more consecutive words that every
match of the pattern holds; a text without it is never given to the pattern.  Words are runs
of ASCII letters, digits and characters beyond ASCII, lower-cased, so ``GPL-2.0`` reads
``gpl 2 0``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Hand-written signatures.  Of two matches the one of the smaller priority wins, then the
# longer one, then the earlier rule (see licenses.py).

#: 1: sentences of license texts and standard notices.
NOTICES = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | to deal in the software | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit | the software is provided as is | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software <6> to deal in the software without restriction <24> and to permit persons to whom the software is furnished to do so the software is provided
isc | permission to use copy modify | permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose (and )?without fee is hereby granted
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | may be used to endorse or promote products | neither the names? of <12> may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
bsd-3-clause-clear | no express or implied licenses | no express or implied licenses to any party s patent rights are granted by this license
apache-2.0 | licensed under the apache license | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1 | this product includes software developed by the apache | this product includes software developed by the apache software foundation
gpl-2.0-or-later | either version 2 of the license | (gnu )?general public license <14> either version 2 of the license or (at your option )?any later version
gpl-3.0-or-later | either version 3 of the license | (gnu )?general public license <14> either version 3 of the license or (at your option )?any later version
lgpl-2.0-or-later | library general public license | gnu library general public license <14> either version 2 of the license or (at your option )?any later version
lgpl-2.1-or-later | lesser general public license | gnu lesser general public license <14> either version 2 1 of the license or (at your option )?any later version
lgpl-3.0-or-later | lesser general public license | gnu lesser general public license <14> either version 3 of the license or (at your option )?any later version
agpl-3.0-or-later | affero general public license | gnu affero general public license <14> either version 3 of the license or (at your option )?any later version
gpl-2.0-only | version 2 of the license | general public license <8> version 2 of the license as published by the free software foundation
gpl-2.0-only | version 2 only | general public license <8> version 2 only
gpl-3.0-only | version 3 only | general public license <8> version 3 only
gpl | under the terms of the gnu general public license | (this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | under the terms of the gnu lesser general public license | (this library is free software )?you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl | under the terms of the gnu affero general public license | (this program is free software )?you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl-classpath-exception | linking this library | linking this library statically or dynamically with other modules is making a combined work
gpl-autoconf-exception | a configuration script generated by autoconf | if you distribute this file as part of a program that contains a configuration script generated by autoconf
gcc-exception | gcc runtime library exception | gcc runtime library exception( version 3 1)?
gfdl-1.1-or-later | free documentation license | gnu free documentation license version 1 1 or any later version
gfdl-1.2-or-later | free documentation license | gnu free documentation license version 1 2 or any later version
gfdl-1.3-or-later | free documentation license | gnu free documentation license version 1 3 or any later version
mpl-1.1 | subject to the mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | subject to the mozilla public license | the contents of this file are subject to the mozilla public license version 1 0
mpl-2.0 | subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
npl-1.1 | subject to the netscape public license | the contents of this file are subject to the netscape public license version 1 1
cddl-1.0 | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
epl-1.0 | eclipse public license v1 0 | made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse public license | made available under the terms of the eclipse public license (v|version )?(2|v2) 0
zlib | this software is provided as is without any express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0 | boost software license | distributed under the boost software license version 1 0
bsl-1.0 | obtaining a copy of the software and accompanying documentation | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
cc0-1.0 | has dedicated the work to the public domain | the person who associated a work with this deed has dedicated the work to the public domain
wtfpl | you just do what the fuck you want to | you just do what the fuck you want to
beerware | buy me a beer | if we meet some day and you think this stuff is worth it you can buy me a beer
artistic-2.0 | artistic license 2 0 | under (the terms of )?the artistic license 2 0
perl | same terms as perl itself | (you can redistribute it and or modify it )?under the same terms as perl itself
python-2.0 | psf license agreement | psf license agreement for python( 2)?
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic software written by eric young | this product includes cryptographic software written by eric young
postgresql | without a written agreement is hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | deal with the software without restriction | to deal with the software without restriction including without limitation the rights to use copy modify merge publish
x11 | except as contained in this notice | except as contained in this notice the names? of <8> shall not be used in advertising or otherwise to promote the sale
curl | permission to use copy modify and distribute this software for any purpose with or without fee | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
unicode | unicode data files and | unicode data files and (any )?associated documentation
ofl-1.1 | sil open font license | this font software is licensed under the sil open font license version 1 1
json | the software shall be used for good not evil | the software shall be used for good not evil
odbl-1.0 | open database license | made available under the open database license
odc-by-1.0 | open data commons attribution license | made available under the open data commons attribution license
pddl-1.0 | public domain dedication and license | made available under the public domain dedication and license
elastic-2.0 | elastic license 2 0 | (licensed under|subject to) the elastic license 2 0
busl-1.1 | business source license | use of this software is governed by the business source license
sspl-1.0 | server side public license | under the terms of the server side public license version 1
proprietary | confidential and proprietary | (this <6> is )?confidential and proprietary( information)?( of)?
proprietary | unauthorized copying of this | unauthorized copying of this (file|document|work|software) via any medium is strictly prohibited
no-derivatives | may be reproduced | no part of this (publication|book|document|work|article) may be reproduced
"""

#: 2: names with a version or a variant.
VERSIONED = """
apache-2.0 | apache | apache (software )?license (version |v )?(2|v2)( 0)?
apache-2.0 | apache 2 0 | apache 2 0( licen[cs]ed?)?
apache-2.0 | apache2 | apache2( licen[cs]e)?
apache-1.1 | apache software license | apache software license (version )?1 1
apache-1.0 | apache license | apache license (version )?1 0
mit-0 | mit no attribution | mit no attribution( license)?
mit-modern-variant | mit | mit license modern variant
bsd-0 | zero clause bsd | (bsd )?zero clause bsd( license)?
bsd-1-clause | 1 clause | bsd 1 clause( license)?
bsd-2-clause | 2 clause | (the )?(bsd 2 clause|2 clause bsd)( licen[cs]e)?
bsd-2-clause | simplified bsd | simplified bsd licen[cs]e
bsd-2-clause | freebsd license | freebsd license
bsd-3-clause | 3 clause | (the )?(bsd 3 clause|3 clause bsd)( licen[cs]e)?
bsd-3-clause | new bsd | new bsd licen[cs]e
bsd-3-clause | modified bsd | modified bsd licen[cs]e
bsd-3-clause | revised bsd | revised bsd licen[cs]e
bsd-4-clause | 4 clause | (the )?(bsd 4 clause|4 clause bsd)( licen[cs]e)?
bsd-4-clause | original bsd | original bsd licen[cs]e
bsd-2-clause-patent | bsd | bsd( 2 clause)? plus patent( license)?
gpl-1.0 | general public | (gnu )?general public licen[cs]e (version |v )?(1|v1)( 0)?
gpl-2.0 | general public | (gnu )?general public licen[cs]e (version |v )?(2|v2)( 0)?
gpl-3.0 | general public | (gnu )?general public licen[cs]e (version |v )?(3|v3)( 0)?
gpl-2.0 | gpl | (gnu )?gpl (version |v )?(2|v2)( 0)?
gpl-3.0 | gpl | (gnu )?gpl (version |v )?(3|v3)( 0)?
gpl-2.0 | gplv2 | (gnu )?gplv2
gpl-3.0 | gplv3 | (gnu )?gplv3
gpl-2.0 | gpl2 | gpl2
gpl-3.0 | gpl3 | gpl3
gpl-2.0-or-later | or later | gpl (version |v )?2( 0)? or later
gpl-3.0-or-later | or later | gpl (version |v )?3( 0)? or later
gpl-2.0-or-later | gplv2 or later | gplv2 or later
gpl-3.0-or-later | gplv3 or later | gplv3 or later
lgpl-2.0 | library general public | (gnu )?library general public licen[cs]e( (version |v )?2( 0)?)?
lgpl-2.1 | lesser general public | (gnu )?lesser general public licen[cs]e (version |v )?(2 1|v2 1)
lgpl-3.0 | lesser general public | (gnu )?lesser general public licen[cs]e (version |v )?(3|v3)( 0)?
lgpl-2.1 | lgpl | (gnu )?lgpl (version |v )?(2 1|v2 1)
lgpl-3.0 | lgpl | (gnu )?lgpl (version |v )?(3|v3)( 0)?
lgpl-2.1 | lgplv2 | lgplv2( 1)?
lgpl-3.0 | lgplv3 | lgplv3
agpl-3.0 | affero general public | (gnu )?affero general public licen[cs]e (version |v )?(3|v3)( 0)?
agpl-3.0 | agpl | (gnu )?agpl (version |v )?(3|v3)( 0)?
agpl-3.0 | agplv3 | (gnu )?agplv3
gfdl-1.1 | free documentation license | (gnu )?free documentation license (version |v )?1 1
gfdl-1.2 | free documentation license | (gnu )?free documentation license (version |v )?1 2
gfdl-1.3 | free documentation license | (gnu )?free documentation license (version |v )?1 3
mpl-1.0 | mozilla public | mozilla public licen[cs]e (version |v )?1 0
mpl-1.1 | mozilla public | mozilla public licen[cs]e (version |v )?1 1
mpl-2.0 | mozilla public | mozilla public licen[cs]e (version |v )?(2|v2)( 0)?
mpl-1.1 | mpl 1 1 | mpl 1 1
mpl-2.0 | mpl 2 0 | mpl 2 0
epl-1.0 | eclipse public | eclipse public licen[cs]e (version |v )?(1|v1)( 0)?
epl-2.0 | eclipse public | eclipse public licen[cs]e (version |v )?(2|v2)( 0)?
eupl-1.1 | european union public | european union public licen[cs]e (version |v )?1 1
eupl-1.2 | european union public | european union public licen[cs]e (version |v )?1 2
cddl-1.0 | common development and distribution license | common development and distribution license( cddl)? (version |v )?1 0
cddl-1.1 | common development and distribution license | common development and distribution license( cddl)? (version |v )?1 1
cpl-1.0 | common public license | common public license (version |v )?1 0
artistic-1.0 | artistic license | artistic license (version )?1 0
artistic-2.0 | artistic license | artistic license (version )?2 0
afl-2.1 | academic free license | academic free license (version |v )?2 1
afl-3.0 | academic free license | academic free license (version |v )?3 0
osl-3.0 | open software license | open software license (version |v )?3 0
bsl-1.0 | boost software | boost software licen[cs]e (version |v )?1 0
zpl-2.1 | zope public license | zope public license( zpl)? (version |v )?2 1
php-3.01 | php license | php license (version |v )?3 01
qpl-1.0 | q public license | q public license (version |v )?1 0
w3c | w3c | w3c software (notice and license|and document notice and license)
ofl-1.1 | open font license | (sil )?open font license (version |v )?1 1
ofl-1.0 | open font license | (sil )?open font license (version |v )?1 0
lppl-1.3c | project public license | latex project public license (version |v )?1 3c?
ms-pl | microsoft public license | microsoft public license( ms pl)?
ms-rl | microsoft reciprocal license | microsoft reciprocal license( ms rl)?
apsl-2.0 | apple public source license | apple public source license (version |v )?2 0
python-2.0 | python software foundation license | python software foundation license (version )?2
odbl-1.0 | open database license | open database license( odbl)?( (version |v )?1 0)?
odc-by-1.0 | open data commons attribution | open data commons attribution license( (version |v )?1 0)?
pddl-1.0 | public domain dedication and license | (open data commons )?public domain dedication and license( (version |v )?1 0)?
cecill-2.1 | cecill | cecill (version |v )?2 1
cecill-b | cecill b | cecill b
cecill-c | cecill c | cecill c
busl-1.1 | business source license | business source license( (version |v )?1 1)?
sspl-1.0 | server side public license | server side public license( (version |v )?1)?
ogl-uk-2.0 | open government | open government licen[cs]e (version |v )?(2|v2) 0
ogl-uk-3.0 | open government licence | open government licence (version |v )?(3|v3)( 0)?
etalab-2.0 | licence ouverte | licence ouverte( open licence)? (version )?2 0
openrail | openrail | (bigscience )?openrail( m)?( license)?
llama-community | community license | llama <2> community license( agreement)?
cc0-1.0 | cc0 | (creative commons )?(zero )?cc0( 1 0)?( universal)?
cc0-1.0 | creative commons zero | creative commons zero( (version |v )?1 0)?( universal)?
cc-pdm-1.0 | public domain mark | (creative commons )?public domain mark( 1 0)?
"""

#: 3: names alone.  The three phrases that the scan always counts are among them.
NAMES = """
mit | mit license | mit license
apache | apache license | apache license
gpl | general public license | general public license
mit | mit licence | mit licence
mit | mit licensed | mit licensed
mit | expat license | expat license
mit | under mit | (licensed|released|distributed|available) under mit
apache | apache licence | apache licence
apache | apache licensed | apache licensed
gpl | general public licence | general public licence
gpl | gpl | gpl licen[cs]ed?
gpl | gnu gpl | gnu gpl
gpl | under the gpl | under the gpl
lgpl | lesser general public | (gnu )?lesser general public licen[cs]e
lgpl | lgpl | (gnu )?lgpl( licen[cs]ed?)?
agpl | affero general public | (gnu )?affero general public licen[cs]e
agpl | agpl | (gnu )?agpl( licen[cs]ed?)?
gfdl | free documentation | (gnu )?free documentation licen[cs]e
gfdl | gfdl | gfdl
bsd | bsd license | bsd license
bsd | bsd licence | bsd licence
bsd | bsd licensed | bsd licensed
bsd | bsd style | bsd style( licen[cs]e)?
mpl | mozilla public | mozilla public licen[cs]e
npl | netscape public license | netscape public license
epl | eclipse public | eclipse public licen[cs]e
eupl | eupl | eupl
eupl | european union public licence | european union public licence
cddl | common development and distribution license | common development and distribution license
cddl | cddl | cddl
cpl-1.0 | common public license | common public license
ipl-1.0 | ibm public license | ibm public license
artistic | artistic license | artistic license
afl | academic free license | academic free license
osl | open software license | open software license
bsl-1.0 | boost software | boost software licen[cs]e
bsl-1.0 | boost license | boost license
isc | isc | isc licen[cs]e
zlib | zlib | zlib( libpng)? licen[cs]e
libpng | libpng license | libpng license
x11 | x11 | x11 licen[cs]e
ncsa | ncsa | (university of illinois )?ncsa( open source)? license
postgresql | postgresql | postgresql licen[cs]e
openssl | openssl | openssl licen[cs]e
php | php | php licen[cs]e
python | python software foundation license | python software foundation license
python | psf | psf licen[cs]e
ruby | ruby | ruby( s)? licen[cs]e
zpl | zope public license | zope public license
unlicense | the unlicense | the unlicense
wtfpl | wtfpl | wtfpl
beerware | beerware | beerware( license)?
curl | curl license | curl license
icu | icu license | icu license
vim | vim license | vim license
tcl | tcl tk license | tcl tk license
sleepycat | sleepycat license | sleepycat license
intel | intel open source license | intel open source license
nokia | nokia open source license | nokia open source license
sun | sun public license | sun public license
apsl | apple public source license | apple public source license
ms-pl | ms pl | ms pl
ofl | open font | (sil )?open font licen[cs]e
ofl | ofl | (sil )?ofl
lppl | project public license | latex project public license
cecill | cecill | cecill( license)?
ogl-uk | open government licence | open government licence
etalab | licence ouverte | licence ouverte( open licence)?
dl-de | datenlizenz deutschland | datenlizenz deutschland( <2> (version )?2 0)?
odbl | odbl | odbl
elastic | elastic license | elastic license
commons-clause | commons clause | commons clause( license)?
polyform | polyform | polyform( noncommercial| small business| free trial| perimeter| shield| strict)?( license)?
creative-commons | creative commons | creative commons licen[cs]e
creative-commons | creative commons | (licensed|released|available|published) under (a |the )?creative commons
creative-commons | licencia creative commons | licencia creative commons
creative-commons | licence creative commons | licence creative commons
creative-commons | creative commons lizenz | creative commons lizenz
public-domain | public domain | (in|into|to) the public domain
public-domain | public domain dedication | public domain dedication
public-domain | domaine public | (dans le )?domaine public
public-domain | dominio público | dominio público
public-domain | gemeinfrei | gemeinfrei
"""

#: 4: hints that a text speaks of its terms, without naming a license.
HINTS = """
all-rights-reserved | all rights reserved | (copyright <8> )?all rights reserved
all-rights-reserved | alle rechte vorbehalten | alle rechte vorbehalten
all-rights-reserved | tous droits réservés | tous droits réservés
all-rights-reserved | todos los derechos reservados | todos los derechos reservados
copyright | copyright | copyright( c)? [12][0-9][0-9][0-9]
copyright | copyright | copyright c
license-hint | licensed under | (is |are |and )?licensed under
license-hint | licenced under | (is |are |and )?licenced under
license-hint | released under | released under (a |an |the )?<3> licen[cs]e
license-hint | distributed under | distributed under (a |an |the )?<3> licen[cs]e
license-hint | under the terms of | under the terms of (a |an |the |this )?<4> licen[cs]e
license-hint | license agreement | (end user )?license agreement
license-hint | see the license | see the license( file)?( for)?
license-hint | see license | see license( txt| md)?
license-hint | license file | license file
license-hint | lizenziert unter | lizenziert unter
license-hint | sous licence | sous licence
license-hint | bajo | bajo( la)? licencia
open-source | open source | (an )?open source licen[cs]e
permission | with permission | (reprinted|reproduced|used) with permission
warranty | without warranty | without warranty of any kind
warranty | without any warranty | (but )?without any warranty
non-commercial | non commercial use | for non commercial use( only)?
non-commercial | noncommercial use | for noncommercial use( only)?
"""

SECTIONS = [NOTICES, VERSIONED, NAMES, HINTS]

#: Identifiers that follow an SPDX tag; each is a rule of priority 1.
SPDX_IDS = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause
BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3
GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later
LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MulanPSL-2.0 NCSA OFL-1.1 OSL-3.0 PostgreSQL
Python-2.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()

#: Elements of the Creative Commons licenses; the rules of every version follow from them.
CC_KINDS = {"by-nc-nd": "noncommercial noderivatives", "by-nc-sa": "noncommercial sharealike", "by-nc": "noncommercial", "by-nd": "noderivatives", "by-sa": "sharealike", "by": ""}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    priority: int
    gate: str
    pattern: str


def words_of(name: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", name.lower()))


def _creative_commons() -> list[tuple[str, int, str, str]]:
    long_names = {"noncommercial": "(noncommercial|non commercial)", "noderivatives": "(noderivatives|noderivs|no derivatives|no derivs)", "sharealike": "(sharealike|share alike)"}
    out = []
    for kind, extra in CC_KINDS.items():
        spelled = " ".join(["attribution", *[long_names[e] for e in extra.split()]])
        for version in CC_VERSIONS:
            out.append((f"cc-{kind}-{version}", 2, f"cc {words_of(kind)} {words_of(version)}", f"cc {words_of(kind)} {words_of(version)}( licen[cs]e)?"))
            out.append((f"cc-{kind}-{version}", 2, "creative commons attribution", f"creative commons {spelled} {words_of(version)}( international| unported| generic)?( public)?( licen[cs]e)?"))
        out.append((f"cc-{kind}", 3, f"cc {words_of(kind)}", f"cc {words_of(kind)}( licen[cs]e)?"))
        out.append((f"cc-{kind}", 3, "creative commons attribution", f"creative commons {spelled}( licen[cs]e)?"))
    return out


def all_rules() -> list[Rule]:
    """Every rule in its order: by section, SPDX tags first, Creative Commons last in theirs."""
    lines = [(f"{i.lower()}", 1, "spdx license identifier", f"spdx license identifier {words_of(i)}") for i in SPDX_IDS]
    for priority, section in enumerate(SECTIONS, start=1):
        for line in section.strip().splitlines():
            label, gate, pattern = (part.strip() for part in line.split(" | ", 2))
            lines.append((label, priority, gate, pattern))
    lines += _creative_commons()
    lines.sort(key=lambda r: r[1])
    return [Rule(i, *line) for i, line in enumerate(lines)]


_TOKEN = re.compile(r"(?P<word>(?:(?:[a-z0-9]|[^\x00-\x7f]|\[[a-z0-9-]+\])\??)+)|<(?P<gap>\d+)>|(?P<mark>[()|?])|(?P<blank> )")


def spaced(pattern: str) -> str:
    """The pattern for texts in which every word has a blank before and one behind it."""
    out, at = [], 0
    while at < len(pattern):
        token = _TOKEN.match(pattern, at)
        if not token:
            raise ValueError(f"rule pattern {pattern!r}, character {at}")
        at = token.end()
        if token["word"]:
            out.append(f" {token['word']} ")
        elif token["gap"]:
            out.append(f"(?: [^ ]+ ){{0,{token['gap']}}}?")
        elif token["mark"]:
            out.append("(?:" if token["mark"] == "(" else token["mark"])
    return "".join(out)
